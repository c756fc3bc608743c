"""Queries that run the Chinese grammars over a whole table.

The driver tables hold no Chinese text, so each part stands for one line of a
script, by its number. The SQL twin does not parse anything: it lists what each
line must give, as read from the rules by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import rules as RU
from quern.functions import spans as SP
from quern.functions import text as T
from quern.operators import completeness as CP
from quern.operators import consistency as CO
from quern.operators import quality as QU
from quern.operators import review as V
from quern.operators import standards as ST
from quern.operators import structure as S
from quern.operators import workitems as W
from quern.plans.common import query, table


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def scripted(name: str, columns: Sequence[str], cases: Sequence[tuple], doc: str, build: Callable[[Column], Sequence[Column]]) -> None:
    """Register query ``name``: each part's line through ``build``, beside the listed results. A case is a line and one value for each of ``columns``."""
    rows = ", ".join(f"({i}, {', '.join(map(_literal, case[1:]))})" for i, case in enumerate(cases))
    sql = f"select p_partkey, {', '.join(columns)} from part join (values {rows}) v(i, {', '.join(columns)}) on p_partkey % {len(cases)} = i"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        line = F.element_at(F.array(*(F.lit(case[0]) for case in cases)), (F.col("p_partkey") % len(cases) + 1).cast("int"))
        lines = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
        return lines.select("p_partkey", *(c.alias(n) for n, c in zip(columns, build(F.col("line")), strict=True)))

    run.__doc__ = doc
    query(sql, name)(run)


def _said(spans: Column) -> Column:
    """Spans as start-end:text, by bars."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("", s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["text"])), "|")


scripted(
    "plan_headings", ("title", "level"), (
        ("第一章 工程概况", "工程概况", 1), ("一、编制依据", "编制依据", 1), ("（二）施工准备", "施工准备", 2), ("3.2.1 立杆搭设", "立杆搭设", 3), ("2、施工准备", "施工准备", 1), ("2、随便写写", None, None),
        ("应急预案", "应急预案", 1), ("1.1 间距为 1.5mm", None, None), ("一、采用钢管搭设", None, None), ("一、施工方法：", None, None), ("1.2 ", None, None), ("第二节 质量标准", "质量标准", 1),
    ),
    "P01, P02, P35: headings of plans by ordered prefixes, and which titles are none.", lambda t: (T.heading(t)["title"], T.heading(t)["level"]),
)
scripted(
    "standard_headings", ("number", "title", "level"), (
        ("第十二章 附则", "12", "附则", 1), ("附录 A 检验", "A", "检验", 1), ("6.1 构造", "6.1", "构造", 2), ("1 总则", "1", "总则", 1), ("6.1 应符合下列要求", None, None, None), ("结束。", None, None, None),
        ("6.1.2 立杆应设置", None, None, None), ("", None, None, None),
    ),
    "P10: headings of standards: chapters, sections and appendices, but no sentences.", lambda t: tuple(T.standard_heading(t)[f] for f in ("number", "title", "level")),
)
scripted(
    "article_starts", ("number", "content"), (
        ("6.1.2 立杆应设置", "6.1.2", "立杆应设置"), ("第6.1.2条 立杆", "6.1.2", "立杆"), ("a.1.2 附录", "A.1.2", "附录"), ("2024.10.01", None, None), ("表 6.1.2 参数", None, None), ("第6.1.2条规定执行", None, None),
        ("6.1 构造", None, None), ("1900.1.2 x", None, None),
    ),
    "P09, P27: lines that open an article, but no dates, tables or references.", lambda t: tuple(T.article_start(t)[f] for f in ("number", "content")),
)
scripted(
    "text_forms", ("searched", "tokens", "phrases", "cleaned", "squeezed", "closed", "preview"), (
        ("ＧＢ  立 杆 间距 Abc ", "gb 立杆间距 abc", "gb abc 立杆间距 立杆 杆间 间距 立杆间 杆间距", "立杆间距", "ＧＢ 立 杆 间距 Abc", "GB 立 杆 间距 Abc", "ｇｂ立杆间距abc", "ＧＢ  立 "),
        ("立杆间距 1.5-2 a/b 立杆", "立杆间距 1.5-2 a/b 立杆", "1.5-2 a/b 立杆间距 立杆 杆间 间距 立杆间 杆间距", "立杆间距 立杆", "立杆间距 1.5-2 a/b 立杆", "立杆间距 1.5-2 a/b 立杆", "立杆间距1.5-2a/b立杆", "立杆间距 1"),
        ("", "", "", "", "", "", "", ""), ("注：第一；第二", "注:第一;第二", "注 第一 第二", "第一 第二", "注：第一；第二", "注:第一;第二", "注：第一；第二", "注：第一；第"),
    ),
    "F01, F02, F03, F04, F05, F07, S03: normal forms of texts, tokens with n-grams of CJK runs, phrases, and a preview.",
    lambda t: (T.search_form(t), F.array_join(T.tokens(t), " "), F.array_join(T.cjk_phrases(t), " "), T.clean_page(t), T.standard_page(t), T.compact(t), F.substring(t, 1, 6)),
)
scripted(
    "dates_codes_decimals", ("date", "code", "blanked", "canonical"), (
        ("2022年4月15日开工", "2022-04-15", None, "2022年4月15日开工", None), ("2023-02-30", None, None, "2023-02-30", None), ("按《规范》gb/t 50001-2017 执行", None, "GB/T50001-2017", "按《规范》" + " " * 16 + "执行", None),
        ("30.00", None, None, "30.00", "30"), ("2.50", None, None, "2.50", "2.5"), ("-0.10", None, None, "-0.10", "-0.1"), ("2021.3.5 JGJ 130-2011", "2021-03-05", "JGJ130-2011", "2021.3.5" + " " * 13, None),
    ),
    "F18, F26, F27, F32, P08: dates, codes of standards, masked references, and canonical decimals.",
    lambda t: (T.iso_date(t), T.standard_code(t), T.masked(t, T.CODE), T.decimal_text(F.when(F.regexp_like(t, F.lit(r"^-?[0-9]+\.[0-9]+$")), t).cast("decimal(38,18)"))),
)
scripted(
    "requirement_decomposition", ("modality", "atomicity", "operator", "value", "unit", "reason", "spans"), (
        ("立杆伸出长度不应小于150mm", "NUMERIC_LIMIT", "PROVEN", ">=", "150", "mm", None, "立杆伸出长度不应小于150mm"),
        ("当高度大于8m时，间距不得大于1.2m", "CONDITIONAL", "UNRESOLVED", None, None, None, "CONDITIONAL_UNSUPPORTED", "当高度大于8m时，间距不得大于1.2m"),
        ("间隙不得大于3mm，长度不得小于150mm", "UNSUPPORTED", "UNRESOLVED", None, None, None, "COMPOUND_STRUCTURE_UNRESOLVED", "间隙不得大于3mm，长度不得小于150mm"),
        ("应设置剪刀撑", "UNSUPPORTED", "PROVEN", None, None, None, None, "应设置剪刀撑"), ("应设置；必须检查", "UNSUPPORTED", "UNRESOLVED", None, None, None, "COMPOUND_STRUCTURE_UNRESOLVED", "应设置；|必须检查"),
        ("x shall not exceed 2.5 mm", "NUMERIC_LIMIT", "PROVEN", "<=", "2.5", "mm", None, "x shall not exceed 2.5 mm"),
        ("除特殊情况外，间距应为1.2m", "NUMERIC_LIMIT", "PROVEN", "=", "1.2", "m", "EXCEPTION_SCOPE_UNRESOLVED", "除特殊情况外，间距应为1.2m"),
        ("1、甲应乙。丙必须丁；", "UNSUPPORTED", "UNRESOLVED", None, None, None, "COMPOUND_STRUCTURE_UNRESOLVED", "1、甲应乙。|丙必须丁；"), ("天气很好", "UNSUPPORTED", "UNRESOLVED", None, None, None, "AMBIGUOUS_SPLIT", "天气很好"),
    ),
    "R03, P12, F11, F13, F14: requirements, their limits, why one stays unresolved, and atomic spans.",
    lambda t: (*(V.requirement(t)[f] for f in ("modality", "atomicity", "operator")), T.decimal_text(V.requirement(t)["value"]), V.requirement(t)["unit"], V.unresolved_reason(t), F.array_join(V.atoms(t), "|")),
)
scripted(
    "plan_fact_extraction", ("parsing_status", "value", "unit", "rejected", "assertion", "fits"), (
        ("伸出长度为150 mm", "PROVEN", "150", "mm", None, "EXACT_VALUE", ">=<=="), ("宽为150mm 或 200mm", "AMBIGUOUS", None, None, None, "EXACT_VALUE", ">=<=="), ("没有数字", "UNSUPPORTED", None, None, "NO_NUMERIC_FACT", None, ""),
        ("当为150mm", "PROVEN", "150", "mm", "CONDITIONAL_UNSUPPORTED", "EXACT_VALUE", ">=<=="), ("截面48×3mm", "PROVEN", "3", "mm", "COMPOUND_DIMENSION_UNSUPPORTED", None, ""), ("100~150mm", "PROVEN", "150", "mm", "RANGE_UNSUPPORTED", None, ""),
        ("步距不大于1.8m", "PROVEN", "1.8", "m", None, "UPPER_BOUND_CONTROL", "<="), ("厚度不小于50mm", "PROVEN", "50", "mm", None, "LOWER_BOUND_CONTROL", ">="), ("设计厚度50mm", "PROVEN", "50", "mm", None, "DESIGN_CONTROL", ">=<=="),
        ("端部位置为5mm", "PROVEN", "5", "mm", "LOCATION_QUALIFIER_UNSUPPORTED", "EXACT_VALUE", ">=<=="), ("厚度5mm", "PROVEN", "5", "mm", "ASSERTION_UNSUPPORTED", None, ""),
    ),
    "R04, P13, P14, F15: facts of plans, why clauses are rejected, kinds of assertion and the operators that they fit.",
    lambda t: (V.plan_fact(t)["parsing_status"], T.decimal_text(V.plan_fact(t)["value"]), V.plan_fact(t)["unit"], V.clause_reject(t, F.lit(True)), V.assertion(t), F.concat(*(F.when(F.coalesce(V.compatible(F.lit(o), V.assertion(t)), F.lit(False)), o).otherwise("") for o in (">=", "<=", "=", "<")))),
)
scripted(
    "bounded_spans", ("clauses", "bounded", "windowed"), (
        ("甲应乙。 丙，丁；", "0-4:甲应乙。|5-7:丙，|7-9:丁；", "0-4:甲应乙。|5-9:丙，丁；", "0-4:甲应乙。|5-7:丙，|7-9:丁；"),
        ("一" * 200 + "，" + "二" * 200 + "。短句。", f"0-201:{'一' * 200}，|201-402:{'二' * 200}。|402-405:短句。", f"0-201:{'一' * 200}，|201-402:{'二' * 200}。|402-405:短句。", f"0-201:{'一' * 200}，|201-402:{'二' * 200}。|402-405:短句。"),
        ("x" * 300 + "应" + "y" * 300, f"0-601:{'x' * 300}应{'y' * 300}", "", f"160-440:{'x' * 140}应{'y' * 139}"), ("", "", "", ""),
    ),
    "F09, F10, F12, U08: clauses with offsets, bounded sentences, and windows around signals.", lambda t: (_said(SP.clauses(t)), _said(SP.bounded_clauses(t)), _said(SP.windows(t, "应"))),
)

CLAUSES = (
    ("支护结构水平位移报警值为30 mm。", "SUPPORT_STRUCTURE", "HORIZONTAL_DISPLACEMENT_ALARM_VALUE", "30", "mm", "DECLARED_CONTROL_VALUE", None), ("支护结构水平位移报警值为20", None, None, None, None, None, "MISSING_UNIT"),
    ("支护结构水平位移报警值为10~20mm", None, None, None, None, None, "INSUFFICIENT_CONTEXT"), ("没有", None, None, None, None, None, None), ("立杆间距为1.2m，步距1.5m", None, None, None, None, None, "INSUFFICIENT_CONTEXT"),
    ("立杆步距不大于1.80m", "UPRIGHT_MEMBER", "STEP_SPACING", "1.8", "m", "UPPER_BOUND_CONTROL", None),
)
_FACT = ("object", "parameter", "value", "unit", "assertion", "reason")


@query(f"select p_partkey, {', '.join(_FACT)} from part join (values {', '.join(f'({i}, ' + ', '.join(map(_literal, c[1:])) + ')' for i, c in enumerate(CLAUSES))}) v(i, {', '.join(_FACT)}) on p_partkey % {len(CLAUSES)} = i")
def consistency_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of clauses by profiles of objects and parameters, or why there is none."""
    line = F.element_at(F.array(*(F.lit(c[0]) for c in CLAUSES)), (F.col("p_partkey") % len(CLAUSES) + 1).cast("int"))
    rows = CO.facts(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")), "line")
    return rows.select("p_partkey", *(T.decimal_text(F.col(c)).alias(c) if c == "value" else F.col(c) for c in _FACT))


#: Chapter titles of plans and the evidence that each is, by check and kind.
TITLES = (
    ("工程概况", ("CR-001:chapters",)), ("编制依据", ("CR-002:chapters",)), ("施工进度计划", ("CR-003:chapters",)), ("施工准备", ("CR-004:broad",)), ("技术准备", ("CR-004:components",)), ("材料准备", ("CR-004:components", "CR-005:chapters")),
    ("施工方法", ("CR-006:chapters",)), ("质量保证措施", ("CR-007:chapters",)), ("安全管理体系", ("CR-008:chapters",)), ("应急预案", ("CR-009:chapters",)), ("环境保护", ("CR-010:chapters",)), ("项目组织机构", ("CR-011:broad",)),
    ("岗位职责", ("CR-011:components",)), ("检查验收", ("CR-012:chapters",)), ("验收程序", ("CR-012:components",)), ("沉降监测", ("CR-013:chapters", "CR-013:components")), ("计算书", ("CR-014:chapters",)), ("封面", ()), ("质量", ()),
)
#: Paths of an analysis and the evidence that a filled one is.
PATHS = (("project.name", "CR-001:fields"), ("schedule.days", "CR-003:fields"), ("compilation_basis[0]", "CR-002:items"), ("compilation_basis[1]", "CR-002:items"), ("main_materials[0]", "CR-005:items"), ("main_methods[0]", "CR-006:items"), ("main_methods[1]", "CR-006:items"), ("main_methods[2]", "CR-006:items"), ("section_presence.quality", "CR-007:flag"), ("section_presence.safety", "CR-008:flag"), ("other.field", None))
_CHAPTER_ROWS = ", ".join(f"({i}, '{title}', '{e[:6]}', '{e[7:]}')" for i, (title, es) in enumerate(TITLES) for e in es)
_FIELD_ROWS = ", ".join(f"({i}, '{path}', '{e[:6]}', '{e[7:]}')" for i, (path, e) in enumerate(PATHS) if e)
SQL_PLAN_EVIDENCE = f"""
e as (select p_size as doc, check_id, kind, case kind when 'components' then title else title || chr(10) || p_partkey % 3 end as value from part join (values {_CHAPTER_ROWS}) t(i, title, check_id, kind) on p_partkey % {len(TITLES)} = i
  union select p_size, check_id, kind, path from part join (values {_FIELD_ROWS}) f(i, path, check_id, kind) on p_partkey % {len(PATHS)} = i
  where case when path like 'section%' then p_partkey % 2 = 0 else p_partkey % 5 <> 0 end),
c as (select doc, check_id, {", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in CP.KINDS)}, bool_or(kind = 'flag') as flag from e group by 1, 2),
k as (select doc, 'CR-' || lpad(cast(n as varchar), 3, '0') as check_id from (select distinct p_size as doc from part), range(1, 15) r(n)),
s as (select doc, check_id, {", ".join(f"coalesce({k}, 0) as {k}" for k in CP.KINDS)}, coalesce(flag, false) as flag from k left join c using (doc, check_id)),
r as (select doc, check_id, case {" ".join(f"when check_id = '{c}' then case when {p} then 'PASS' when {q} then 'PARTIAL' when {'doc % 2 = 0' if c == RU.SPECIAL_CHECK else str(need).lower()} then 'MISSING' else 'NOT_APPLICABLE' end" for c, p, q, need in RU.CHECKS)} end as status from s)"""


def _plan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_size", "doc")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    chapters = part.select("doc", pick([t for t, _ in TITLES]).alias("title"), (F.col("p_partkey") % 3).alias("page"))
    fields = part.select("doc", pick([p for p, _ in PATHS]).alias("path"), "p_partkey")
    value = F.when(F.startswith("path", F.lit("section")), (F.col("p_partkey") % 2 == 0).cast("string")).otherwise(F.when(F.col("p_partkey") % 5 != 0, "x").otherwise(" "))
    return CP.chapter_evidence(chapters, "doc").union(CP.field_evidence(fields.select("doc", "path", value.alias("value")), "doc"))


@query(f"with {SQL_PLAN_EVIDENCE} select doc, check_id, kind, count(*) as n from e group by 1, 2, 3")
def plan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for completeness from chapter titles and fields of an analysis."""
    return _plan_evidence(spark, sf_dir).groupBy("doc", "check_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SQL_PLAN_EVIDENCE} select doc, {", ".join(f"count(*) filter (status = '{x}') as {x.lower()}" for x in ("PASS", "PARTIAL", "MISSING", "NOT_APPLICABLE"))},
cast(floor(100 * (count(*) filter (status = 'PASS') + 0.5 * count(*) filter (status = 'PARTIAL')) / count(*) filter (status <> 'NOT_APPLICABLE') + 0.5) as bigint) as score from r group by 1""")
def plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen checks of plans by their profile, and the score."""
    docs = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc")).distinct()
    special = CP.profile(F.when(F.col("doc") % 2 == 0, "深基坑专项施工方案").otherwise("施工方案")) == "special_construction_plan"
    return CP.score(CP.checks(_plan_evidence(spark, sf_dir), "doc", docs, special), "doc")


scripted(
    "work_names", ("plain", "same"), (
        ("给水管道安装施工", "给水管道安装", True), ("给水管道安装", "给水管道", True), ("生活给水系统：立管", "生活给水系统", False), ("立杆 搭设（一）工程", "立杆搭设一", False), ("给水", "给水", False), ("给水管道安装（主管）", "给水管道安装主管", True),
    ),
    "P33: plain names of work items, and which are the same as 给水管道安装.", lambda t: (W.plain_work_name(t), W.same_work_item(W.plain_work_name(t), F.lit("给水管道"))),
)

#: Chapters of a plan: title, level, and whether the chapter above it holds methods.
OUTLINE = (("工程概况", 1, False), ("地质", 2, False), ("施工方法", 1, False), ("立杆搭设", 2, True), ("细部", 3, False), ("剪刀撑", 2, True), ("质量管理及施工方法", 1, False), ("检查", 2, False), ("过深", 4, False))


@query(f"select p_size, p_partkey, construction from part join (values {', '.join(f'({i}, {str(c).lower()})' for i, (_, _, c) in enumerate(OUTLINE))}) v(i, construction) on p_partkey % {len(OUTLINE)} = i")
def construction_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters right below one that holds methods; each run of parts is one plan."""
    at = F.col("p_partkey") % len(OUTLINE)
    pick = lambda i: F.element_at(F.array(*(F.lit(row[i]) for row in OUTLINE)), (at + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_size", "p_partkey", F.floor(F.col("p_partkey") / len(OUTLINE)).alias("plan"), pick(0).alias("title"), pick(1).alias("level"))
    return W.construction_child(rows, "plan", "p_partkey").select("p_size", "p_partkey", "construction")


#: What an item cites, and whether its page shows it: numbered first lines only.
CITED = (("1、立杆搭设\n说明", "1、立杆搭设", True), ("立杆搭设", "立杆搭设", False), ("1.2．剪刀撑", "前文 1.2．剪刀撑 后文", True), ("2、水平杆", "别处", False), ("", "x", False), (None, "x", False))


@query(f"select p_partkey, verified and p_partkey % 5 <> 0 as verified from part join (values {', '.join(f'({i}, {str(c).lower()})' for i, (_, _, c) in enumerate(CITED))}) v(i, verified) on p_partkey % {len(CITED)} = i")
def verified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose numbered first line stands on the page that they name."""
    at = (F.col("p_partkey") % len(CITED) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(row[i]) for row in CITED)), at)
    part = table(spark, sf_dir, "part")
    items = part.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, 2).otherwise(1).alias("page_number"), pick(0).alias("source_text"))
    pages = part.select("p_partkey", F.lit(1).alias("page_number"), pick(1).alias("text"))
    return W.verified_sources(items, pages, "p_partkey").select("p_partkey", "verified")


def _documents(spark: SparkSession, sf_dir: str, rows: Sequence[object]) -> DataFrame:
    """Every len(rows) parts as one document: doc, at (from 0) and line."""
    line = F.element_at(F.array(*map(F.lit, rows)), (F.col("p_partkey") % len(rows) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / len(rows)).alias("doc"), (F.col("p_partkey") % len(rows)).alias("at"), line.alias("line"))


def _listed(rows: Sequence[object], columns: Sequence[str], expected: Sequence[tuple], **kinds: str) -> str:
    """SQL of the ``expected`` rows, once for each document of :func:`_documents`; ``kinds`` has the types of columns that literals do not tell."""
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in expected)
    typed = ", ".join(f"cast({c} as {kinds[c]}) as {c}" if c in kinds else c for c in columns)
    return f"select doc, {typed} from (select distinct p_partkey // {len(rows)} as doc from part), (values {values}) v({', '.join(columns)})"


#: Pages of a standard, and its articles: number, region, pages, content, sequence, and whether the number came before.
STANDARD = (
    "某标准\n目 次\n1 总则.....3\n6 构造.....4\n1", "某标准\n1 总则\n1.0.1 为了安全\n2", "某标准\n6.1 构造\n6.1.1 立杆应设置\n6.1.2 水平杆\n3", "某标准\n应与立杆连接\n6.1.3 剪刀撑\n附录 A\nA.0.1 检验\n4", "某标准\n条文说明\n1.0.1 解释\n2024.10.01\n5",
)
ARTICLES = (
    ("1.0.1", "NORMATIVE_BODY", 1, 1, "为了安全", 1, False), ("6.1.1", "NORMATIVE_BODY", 2, 2, "立杆应设置", 2, False), ("6.1.2", "NORMATIVE_BODY", 2, 3, "水平杆应与立杆连接", 3, False), ("6.1.3", "NORMATIVE_BODY", 3, 3, "剪刀撑", 4, False),
    ("A.0.1", "APPENDIX", 3, 3, "检验", 5, False), ("1.0.1", "EXPLANATION", 4, 4, "解释\n2024.10.01", 6, False),
)
_ARTICLE = ("article_number", "region", "page_start", "page_end", "content", "sequence", "ambiguous")


@query(f"""select *, 'article_' || sha256('["sum' || doc || '","' || article_number || '","' || region || '","' || replace(content, chr(10), '\\n') || '"]') as article_id from ({_listed(STANDARD, _ARTICLE, ARTICLES, page_start='bigint', page_end='bigint', sequence='bigint')})""")
def standard_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the pages of standards to articles with identities."""
    pages = _documents(spark, sf_dir, STANDARD).select("doc", "at", F.col("line").alias("text"))
    return ST.parse(pages, "doc", "at", F.concat(F.lit("sum"), F.col("doc").cast("string"))).select("doc", *_ARTICLE, "article_id")


#: Pages of a plan with a contents list, and its chapters: title, level, first and last page.
PLAN_PAGES = ("封面", "目录\n第一章 工程概况......3\n第二章 施工方法......4", "第一章 工程概况\n正文", "第二章 施工方法\n（一）土方开挖\n正文", "（二）脚手架搭设\n第三章 应急预案")
CHAPTERS = (("工程概况", 1, 2, 3), ("施工方法", 1, 3, 4), ("应急预案", 1, 4, 4))


@query(_listed(PLAN_PAGES, ("title", "level", "start_page", "end_page"), CHAPTERS, start_page="bigint", end_page="bigint"))
def plan_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of plans by their contents lists, with the pages they take."""
    pages = _documents(spark, sf_dir, PLAN_PAGES).select("doc", F.col("at").alias("page"), F.col("line").alias("text"))
    return ST.chapters(pages, "doc", "page").select("doc", "title", "level", "start_page", "end_page")


#: Lines of a plan, and the text under each heading with whether its chapter holds methods.
BODY_LINES = ("一、施工方法", "引言", "（一）土方开挖", "分层开挖", "修整边坡", "二、计算书", "（一）立杆验算", "公式", "三、应急预案", "电话")
BODIES = (("施工方法", 1, "引言\n分层开挖\n修整边坡", True), ("土方开挖", 2, "分层开挖\n修整边坡", True), ("计算书", 1, "公式", False), ("立杆验算", 2, "公式", False), ("应急预案", 1, "电话", False))


@query(_listed(BODY_LINES, ("title", "level", "body", "allowed"), BODIES))
def work_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies under headings, and which headings stand among methods."""
    lines = S.once(_documents(spark, sf_dir, BODY_LINES), h=T.heading(F.col("line")))
    texts = W.bodies(lines, "doc", "at", F.col("h.title"), F.col("h.level"))
    heads = lines.where("h is not null").select("doc", F.col("at").alias("seq"), "h.title", "h.level").withColumn("parent", S.parent_position("doc", "seq", "level"))
    allowed = W.method_context(heads, "doc").select("doc", F.col("seq").alias("first"), "allowed")
    return texts.join(allowed, ["doc", "first"]).select("doc", "title", "level", "body", "allowed")


_FLAG = lambda name: (lambda t: F.contains(t, F.lit(f"#{name}")))
scripted(
    "work_item_filter", ("kept",), (
        ("脚手架搭设", True), ("记录表", False), ("某公司", False), ("30 mm", False), ("土方", True), ("土方 #related", True), ("钢管 #is_material", False), ("应急预案 #is_chapter", True), ("脚手架搭设 #in_calculation", False), ("钢管 #is_material #numbered", True),
    ),
    "P18, P19: which work items stay, rule by rule.", lambda t: (W.keep_work_item(F.trim(F.regexp_replace(t, " #.*", "")), {k: _FLAG(k)(t) for k in ("in_calculation", "is_chapter", "numbered", "related", "is_material")}),),
)


#: Pages of a plan with a header, a footer and page numbers, and the edges that repeat: by first and last line, by the outer two lines, and by slot.
EDGED = ("某工程方案\n编制单位\n正文甲乙\n内部资料\n第1页共5页", "某工程方案\n编制单位\n正文丙丁\n内部资料\n第2页共5页", "某工程方案\n其他\n正文戊己\n内部资料\n第3页共5页", "某工程方案\n编制单位\n庚辛\n内部资料\n第4页共5页", "封底")
EDGES = (
    ("occurrence", "", "某工程方案", 4), ("occurrence", "", "第#页共#页", 4), ("distinct", "", "某工程方案", 4), ("distinct", "", "编制单位", 3), ("distinct", "", "内部资料", 4),
    ("slot", "top-0", "某工程方案", 4), ("slot", "top-1", "编制单位", 3), ("slot", "bottom-1", "内部资料", 4),
)


@query(_listed(EDGED, ("mode", "slot", "edge", "pages"), EDGES, pages="bigint"))
def repeated_edges_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and footers of plans in all three ways."""
    pages = _documents(spark, sf_dir, EDGED).select("doc", "at", F.col("line").alias("text"))
    every = [S.repeated_edges(pages, "doc", mode).select("doc", F.lit(mode).alias("mode"), F.coalesce("slot", F.lit("")).alias("slot"), "edge", "pages") for mode in ("occurrence", "distinct", "slot")]
    return every[0].union(every[1]).union(every[2])


@query(_listed(EDGED, ("page_count", "effective", "meaningful", "repeated_ratio", "has_structure", "status"), ((5, 12, 0, 0.533333, False, "TEXT_READY"),), page_count="bigint", effective="bigint", meaningful="bigint", repeated_ratio="double"))
def plan_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages of plans hold besides repeated edges."""
    pages = _documents(spark, sf_dir, EDGED).select("doc", F.col("line").alias("text"), F.lit(0).alias("image_count"), F.lit(0.0).alias("image_coverage"))
    out = S.inspect_documents(pages, "doc", "第一章")
    columns = ("page_count", "raw_count", "effective", "meaningful", "image_pages", "heavy_pages", "repeated_ratio", "has_structure")
    return out.select("doc", "page_count", "effective", "meaningful", "repeated_ratio", "has_structure", S.inspection_status({c: F.col(c) for c in columns}).alias("status"))


#: Recognised lines: text, raster support, height ratio and aspect ratio, and the issues that they have.
RECOGNISED = (
    ("6.1.2 立杆", 0.9, 1.0, 9.0, ""), ("6,1,2 立杆", 0.9, 1.0, 9.0, "ARTICLE_NUMBER_AMBIGUITY"), ("6.12 水平杆", 0.9, 1.0, 9.0, "ARTICLE_NUMBER_AMBIGUITY"), ("印章", 0.2, 1.4, 2.0, "INSUFFICIENT_RASTER_TEXT_SUPPORT"), ("印章", 0.3, 1.4, 2.0, ""),
    ("印章", 0.2, 1.3, 2.0, ""), ("印章", 0.2, 1.4, 3.5, ""), ("6,1 印", 0.1, 1.5, 1.0, "ARTICLE_NUMBER_AMBIGUITY|INSUFFICIENT_RASTER_TEXT_SUPPORT"), ("正文", 0.9, 1.0, 9.0, ""), ("7.1 标题", 0.9, 1.0, 9.0, "ARTICLE_NUMBER_AMBIGUITY"),
)


@query(f"select p_partkey, issue from part join (values {', '.join(f'({i}, {_literal(x)})' for i, c in enumerate(RECOGNISED) for x in c[4].split('|') if x)}) v(i, issue) on p_partkey % {len(RECOGNISED)} = i")
def recognition_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose pixels do not support their text, and numbers that may be articles."""
    at = (F.col("p_partkey") % len(RECOGNISED) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(row[i]) for row in RECOGNISED)), at)
    lines = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / len(RECOGNISED)).alias("page"), F.col("p_partkey").alias("line_id"), pick(0).alias("text"), F.lit(0.95).alias("confidence"), F.lit(10.0).alias("height"), F.lit(90.0).alias("width"), F.lit(0.0).alias("angle"),
        pick(1).alias("relative_support"), pick(2).alias("height_ratio"), pick(3).alias("aspect_ratio"),
    )
    return QU.line_issues(lines, "page").select(F.col("line_id").alias("p_partkey"), "issue")
