"""Review operators on fixtures: candidates, requirements, facts, comparison, consistency, completeness, quality, structure."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.operators import completeness as CP
from quern.operators import consistency as CO
from quern.operators import extract as X
from quern.operators import quality as QU
from quern.operators import regions as R
from quern.operators import review as V
from quern.operators import structure as S


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")


def column(spark, c, *values):
    return [r.x for r in texts(spark, *values).select("id", c.alias("x")).orderBy("id").collect()]


def test_candidate_classes(spark):
    got = {r.t: r for r in V.discover(texts(spark, "立杆间距不得大于1.5m。", "钢管材料应当检验合格", "现场作业前应检查脚手架", "天气很好", "必须安全防护"), "t").collect()}
    assert got["立杆间距不得大于1.5m。"].candidate_class == "NUMERIC_CONTROL"
    assert got["立杆间距不得大于1.5m。"].topic == "立杆"
    assert got["现场作业前应检查脚手架"].candidate_class == "INSPECTION_REQUIREMENT"
    assert got["钢管材料应当检验合格"].candidate_class == "MATERIAL_REQUIREMENT"
    assert got["必须安全防护"].candidate_class == "SAFETY_REQUIREMENT"
    assert "天气很好" not in got
    assert got["立杆间距不得大于1.5m。"].confidence == 0.95


def test_requirements(spark):
    got = column(spark, V.requirement(F.col("t")), "立杆伸出长度不应小于150mm", "当高度大于8m时，间距不得大于1.2m", "间隙不得大于3mm，长度不得小于150mm", "应设置剪刀撑", "应设置；必须检查", "x shall not exceed 2.5 mm")
    assert (got[0].modality, got[0].atomicity, got[0].operator, got[0].value, got[0].unit) == ("NUMERIC_LIMIT", "PROVEN", ">=", Decimal(150), "mm")
    assert (got[1].modality, got[1].atomicity) == ("CONDITIONAL", "UNRESOLVED")
    assert (got[2].modality, got[2].atomicity) == ("UNSUPPORTED", "UNRESOLVED")
    assert (got[3].modality, got[3].atomicity) == ("UNSUPPORTED", "PROVEN")
    assert (got[4].modality, got[4].atomicity) == ("UNSUPPORTED", "UNRESOLVED")
    assert (got[5].operator, got[5].value) == ("<=", Decimal("2.5"))
    assert column(spark, V.atoms(F.col("t")), "1、甲应乙。丙必须丁；\n2、戊") == [["1、甲应乙。", "丙必须丁；", "2、戊"]]


def test_plan_facts(spark):
    got = column(spark, V.plan_fact(F.col("t")), "伸出长度为150 mm", "150mm 或 200mm", "没有数字")
    assert [(g.parsing_status, g.value, g.unit) for g in got] == [("PROVEN", Decimal(150), "mm"), ("AMBIGUOUS", None, None), ("UNSUPPORTED", None, None)]
    reasons = column(spark, V.clause_reject(F.col("t"), F.lit(True)), "没有", "当为150mm", "截面48×3mm", "100~150mm", "长度为150mm")
    assert reasons == ["NO_NUMERIC_FACT", "CONDITIONAL_UNSUPPORTED", "COMPOUND_DIMENSION_UNSUPPORTED", "RANGE_UNSUPPORTED", None]


@pytest.mark.parametrize(
    ("operator", "limit", "actual", "unit", "facts", "expected"),
    [
        (">=", 150.0, 150.0, "mm", 1, ("COMPLIANT", "NUMERIC_LIMIT_SATISFIED")), ("<=", 2.5, 3.0, "MM", 1, ("NON_COMPLIANT", "NUMERIC_LIMIT_VIOLATED")),
        ("<=", 2.5, 3.0, "cm", 1, ("INSUFFICIENT_INFORMATION", "UNSUPPORTED_UNIT")), ("<=", 2.5, 3.0, "mm", 0, ("INSUFFICIENT_INFORMATION", "PLAN_FACT_MISSING")), ("<=", 2.5, 3.0, "mm", 2, ("INSUFFICIENT_INFORMATION", "PLAN_FACT_AMBIGUOUS")),
    ],
)
def test_comparison(spark, operator, limit, actual, unit, facts, expected):
    m = {"atomicity": F.lit("PROVEN"), "modality": F.lit("NUMERIC_LIMIT"), "operator": F.lit(operator), "limit": F.lit(limit), "limit_unit": F.lit("mm"), "n_facts": F.lit(facts), "n_proven": F.lit(facts), "actual": F.lit(actual), "unit": F.lit(unit)}
    assert tuple(spark.range(1).select(V.comparison(m).alias("x")).first().x) == expected


def test_assertions_fit_operators(spark):
    rows = spark.createDataFrame([("EXACT_VALUE", ">"), ("EXACT_VALUE", ">="), ("LOWER_BOUND_CONTROL", ">="), ("LOWER_BOUND_CONTROL", "<="), ("UPPER_BOUND_CONTROL", "<=")], "k string, o string")
    assert [r.x for r in rows.select(V.compatible(F.col("o"), F.col("k")).alias("x")).collect()] == [False, True, True, False, True]


def test_consistency_case(spark):
    rows = texts(spark, "支护结构水平位移报警值为30 mm。", "支护结构水平位移报警值为20 mm。", "支护结构水平位移报警值为20.0 mm。", "报警值为20 mm", "支护结构水平位移报警值为20", "支护结构水平位移报警值为10~20mm", "没有", "立杆间距为1.2m，步距1.5m").withColumn("doc", F.lit("d"))
    facts = {r.id: r for r in CO.facts(rows, "t").collect()}
    assert (facts[0].object, facts[0].parameter, facts[0].value, facts[0].unit, facts[0].assertion) == ("SUPPORT_STRUCTURE", "HORIZONTAL_DISPLACEMENT_ALARM_VALUE", Decimal(30), "mm", "DECLARED_CONTROL_VALUE")
    assert facts[4].reason == "MISSING_UNIT"
    assert facts[5].reason == "INSUFFICIENT_CONTEXT"
    assert (facts[6].reason, facts[6].object) == (None, None)
    assert facts[7].reason == "INSUFFICIENT_CONTEXT"
    found = CO.groups(CO.facts(rows, "t").where("value is not null"), ["doc", "object", "parameter", "unit", "assertion"], "value", "id").collect()
    assert [(g.n_values, g.n_facts, g.low, g.high) for g in found] == [(2, 3, Decimal(20), Decimal(30))]


def test_consistency_does_not_depend_on_order(spark):
    rows = [(f"d{i % 4}", i % 2, i) for i in range(2400)]
    a = spark.createDataFrame(rows, "doc string, v int, id int")
    b = spark.createDataFrame(rows[::-1], "doc string, v int, id int").repartition(5)
    ga, gb = (sorted(map(tuple, CO.groups(x, ["doc"], "v", "id").collect())) for x in (a, b))
    assert ga == gb
    assert len(ga) in (0, 4)


def test_completeness(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc string")
    evidence = spark.createDataFrame([("a", "CR-001", "chapters", "x"), ("a", "CR-001", "fields", "y"), ("a", "CR-002", "items", "1"), ("a", "CR-002", "items", "2"), ("a", "CR-003", "fields", "f"), ("a", "CR-003", "fields", "f")], "doc string, check_id string, kind string, value string")
    rows = CP.checks(evidence, "doc", docs)
    status = {(r.doc, r.check_id): r.status for r in rows.collect()}
    assert status["a", "CR-001"] == "PASS"
    assert status["a", "CR-002"] == "PASS"
    assert status["a", "CR-003"] == "PARTIAL"
    assert status["b", "CR-009"] == "NOT_APPLICABLE"
    assert status["b", "CR-001"] == "MISSING"
    score = {r.doc: r for r in CP.score(rows, "doc").collect()}
    assert score["a"].score == int(100 * 2.5 / 11 + 0.5)
    assert score["b"].score == 0


#: Two plans whose scores are published: type, chapter titles, filled fields beside three methods and a project name, sections that are there, and the score.
PLANS = {
    "plumbing": ("给排水管道施工方案", ("工程概况", "编制依据及主要施工方案", "施工进度计划", "施工准备", "主要材料进场计划", "施工方法", "质量标准及保护措施", "文明施工与环境保护措施", "施工部署及劳动力配置"), ("schedule.duration_days", "compilation_basis[0]", "main_materials[0]"), ("quality", "safety", "environment"), 82),
    "scaffold": ("悬挑脚手架工程专项施工方案", ("工程概况", "编制说明及依据", "脚手架工程施工进度计划", "材料与设备计划", "施工工艺技术", "安全保证措施", "应急处置措施", "文明施工与绿色施工措施", "施工组织管理", "项目管理人员职责分工表", "附图及计算书"), ("compilation_basis[0]", "main_materials[0]"), ("quality", "safety", "environment", "emergency"), 77),
}


def test_published_completeness_scores(spark):
    docs = spark.createDataFrame([(name, plan[0]) for name, plan in PLANS.items()], "doc string, kind string")
    chapters = spark.createDataFrame([(name, t, i) for name, plan in PLANS.items() for i, t in enumerate(plan[1])], "doc string, title string, page int")
    fields = [(name, path, "x") for name, plan in PLANS.items() for path in ("project.project_name", *(f"main_methods[{i}]" for i in range(3)), *plan[2])]
    fields += [(name, f"section_presence.{s}", str(s in plan[3]).lower()) for name, plan in PLANS.items() for s in ("quality", "safety", "environment", "emergency")]
    fields += [("plumbing", "project.location", "  "), ("plumbing", "schedule.plan_start_date", None)]
    evidence = CP.chapter_evidence(chapters, "doc").union(CP.field_evidence(spark.createDataFrame(fields, "doc string, path string, value string"), "doc"))
    rows = CP.checks(evidence, "doc", docs, CP.profile(F.col("kind")) == "special_construction_plan")
    status = {(r.doc, r.check_id): r.status for r in rows.collect()}
    assert {r.doc: r.score for r in CP.score(rows, "doc").collect()} == {name: plan[4] for name, plan in PLANS.items()}
    assert [status["plumbing", f"CR-{i:03}"] for i in (1, 8, 9, 11, 12, 14)] == ["PASS", "PARTIAL", "NOT_APPLICABLE", "PARTIAL", "MISSING", "NOT_APPLICABLE"]
    assert [status["scaffold", f"CR-{i:03}"] for i in (3, 7, 9, 11, 12, 13, 14)] == ["PARTIAL", "PARTIAL", "PASS", "PASS", "MISSING", "NOT_APPLICABLE", "PASS"]
    without = CP.checks(evidence.where("check_id <> 'CR-009'"), "doc", docs, CP.profile(F.col("kind")) == "special_construction_plan").where("check_id = 'CR-009'").collect()
    assert {r.doc: r.status for r in without} == {"plumbing": "NOT_APPLICABLE", "scaffold": "MISSING"}


def test_quality_lines(spark):
    box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    lines = spark.createDataFrame([("p", "a", "6.1.2 立杆", 0.95, box(0.0, 0.0, 100.0, 10.0)), ("p", "b", "正文内容很长很长", 0.6, box(0.0, 20.0, 100.0, 10.0)), ("p", "c", "3", 0.9, box(0.0, 41.0, 5.0, 10.0)), ("p", "d", "列表内容", 0.9, box(10.0, 40.0, 90.0, 10.0)), ("p", "e", "印章", 0.9, box(0.0, 60.0, 60.0, 30.0)), ("p", "f", "1,2,3 错误", 0.3, box(0.0, 100.0, 90.0, 10.0))], "page string, line_id string, text string, confidence double, polygon array<array<double>>")
    lines = lines.select("*", *(c.alias(n) for n, c in QU.box(F.col("polygon")).items()))
    issues = {(r.line_id, r.issue) for r in QU.line_issues(lines, "page").collect()}
    assert issues == {("b", "CONFIDENCE_REVIEW_REQUIRED"), ("e", "SUSPICIOUS_OVERLAY_GEOMETRY"), ("f", "CONFIDENCE_REJECTED"), ("f", "ARTICLE_NUMBER_AMBIGUITY")}
    assert [(r.line_id, r.body_id) for r in QU.detached_numbers(lines, "page").collect()] == [("c", "d")]
    assert QU.page_states(lines, QU.line_issues(lines, "page"), "page").first().state == "OCR_LOW_CONFIDENCE"
    assert QU.page_issues(lines, "page").count() == 0


def regions_of(spark, text):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text)], "doc string, line_index int, line string")
    return R.standard_regions(lines, "doc", ["line_index"])


def test_regions_of_a_standard(spark):
    text = ["封面", "目 次", "1 总则.....1", "2 术语.....3", "", "1 总则", "1.0.1 为了安全", "附录 A", "A.0.1 检验", "条文说明", "1.0.1 说明"]
    got = [r.region for r in regions_of(spark, text).orderBy("line_index").collect()]
    assert got == ["FRONT_MATTER"] * 5 + ["NORMATIVE_BODY"] * 2 + ["APPENDIX"] * 2 + ["EXPLANATION"] * 2
    runs = S.islands(regions_of(spark, text), "doc", ["line_index"], "region").orderBy("island").collect()
    assert [(r.region, r.first, r.last) for r in runs] == [("FRONT_MATTER", 0, 4), ("NORMATIVE_BODY", 5, 6), ("APPENDIX", 7, 8), ("EXPLANATION", 9, 10)]


@pytest.mark.parametrize(("text", "expected"), [
    (["正文部分", "前言", "第一章 总则", "1.0.1 甲"], "OONN"),
    (["第一", "章", "1.0.1 甲"], "NNN"),
    (["附录 A", "1.0.1 甲", "附录 B", "附录 C.....9"], "FNNN"),
    (["1.0.1 甲", "附录 A", "A.0.1 乙", "1 总则", "1.0.1 丙", "附录 B", "x"], "NAAOOOO"),
    (["废止的条文", "乙", "丙"], "FFF"),
    (["废止的条文", "一、乙", "1 总则", "1.0.1 甲", "同时废止下列标准的", "强制性条文：", "1.0.2 乙"], "RRNNRRR"),
    (["目录", "1 总则...1", "2 章", "2.0.1 甲"], "FFFF"),
    (["条文说明", "无", None, "起草说明", "x"], "FFFOO"),
    (["正文", "废止的条文", "一、甲", "1 总则", "1.0.1 乙"], "OOONN"),
])
def test_regions_case_by_case(spark, text, expected):
    names = {"F": "FRONT_MATTER", "N": "NORMATIVE_BODY", "A": "APPENDIX", "E": "EXPLANATION", "R": "REPEALED_LIST", "O": "OTHER"}
    assert [r.region for r in regions_of(spark, text).orderBy("line_index").collect()] == [names[x] for x in expected]


def test_repeated_edges(spark):
    pages = spark.createDataFrame([("d", i, f"某工程方案\n正文{i}甲乙\n第{i}页共9页") for i in range(1, 5)] + [("e", 1, "x"), ("e", 2, "x")], "doc string, page int, text string")
    assert {(r.edge, r.pages) for r in S.repeated_edges(pages, "doc", "occurrence").collect()} == {("某工程方案", 4), ("第#页共#页", 4)}
    assert {r.edge for r in S.repeated_edges(pages, "doc", "distinct").collect()} == {"某工程方案"}
    assert {(r.slot, r.edge) for r in S.repeated_edges(pages, "doc", "slot").collect()} == {("top-0", "某工程方案")}


def test_chunks_hold_all_text(spark):
    pages = spark.createDataFrame([("d", 1, "a" * 50), ("d", 2, "b" * 500), ("d", 3, None)], "doc string, page int, text string")
    chunks = [r.content for r in S.chunk_pages(pages, "doc", "page", 120).orderBy("chunk").collect()]
    assert all(len(c) <= 120 for c in chunks)
    assert sum(c.count("a") - c.count("page") for c in chunks) == 50
    assert sum(c.count("b") for c in chunks) == 500


def test_cited_standards_takes_all_codes_of_a_line(spark):
    text = [(1, "《甲规范》GB 50010-2010、《乙标准》（JGJ/T 46—2005）"), (1, "TB 10001-2016《丙规范》和 DL/T 5210.1-2012《丁规程》"), (1, "DB11/T 1234-2010、JT/T 280-2004、CECS 102-2002、T/CECS 500-2018、T/ABC-12-2019、AB-CD-1"), (2, "无"), (2, "《旧名》GB 50010-2010"), (3, "编制依据"), (3, "《新名》GB 50010-2010")]
    lines = spark.createDataFrame([("d", page, i, x) for i, (page, x) in enumerate(text)], "doc string, page_number int, line_index int, line string")
    got = {r.code: r.name for r in X.cited_standards(lines, "doc").collect()}
    assert set(got) == {"GB50010-2010", "JGJ/T46-2005", "TB10001-2016", "DL/T5210.1-2012", "DB11/T1234-2010", "JT/T280-2004", "CECS102-2002", "T/CECS500-2018", "T/ABC-12-2019", "AB-CD-1"}
    assert (got["GB50010-2010"], got["JGJ/T46-2005"], got["TB10001-2016"], got["DL/T5210.1-2012"]) == ("新名", "乙标准", "丙规范", "丁规程")
    calculation = {r.code: r.name for r in X.cited_standards(lines, "doc", F.col("page_number") == 3).collect()}
    assert calculation["GB50010-2010"] == "甲规范"


def test_extraction(spark):
    text = ["工程名称：某厂房 建设单位：甲公司", "计划开工日期：2022年4月15日", "计划竣工日期：2023-05-10", "总工期390天", "《混凝土规范》", "GB 50010-2010", "质量保证措施", "联系人：张三 13812345678"]
    lines = spark.createDataFrame([("d", 1, i, x) for i, x in enumerate(text)], "doc string, page_number int, line_index int, line string")
    values = {r.field: r.value for r in X.label_values(lines, "doc").collect()}
    assert values["project_name"] == "某厂房"
    assert values["owner"] == "甲公司"
    s = X.schedule(lines, "doc").first()
    assert (s.start_date, s.end_date, s.days) == ("2022-04-15", "2023-05-10", 390)
    assert [(r.code, r.name) for r in X.cited_standards(lines, "doc").collect()] == [("GB50010-2010", "混凝土规范")]
    presence = X.section_presence(lines, "doc").first()
    assert (presence.quality, presence.emergency) == (True, False)
    assert column(spark, X.is_contact(F.col("t"), F.col("t")), "联系人：张三 13812345678", "甲公司") == [True, False]
    assert column(spark, X.work_item(F.col("t")), "3.1 土钉墙支护", "脚手架施工方法") == ["土钉墙支护施工", "脚手架"]
    assert column(spark, X.malformed_code(F.col("t")), "GB 50010-2010", "GB 50010", "无") == [False, True, False]
    codes = spark.createDataFrame([("d", "A", 200), ("d", "B", 180), ("e", "A", 200), ("e", "B", 100)], "doc string, code string, score int")
    assert {r.doc: r.status for r in X.identify_standard(codes, "doc").collect()} == {"d": "CONFLICT", "e": "IDENTIFIED"}
