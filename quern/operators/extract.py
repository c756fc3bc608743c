"""Extraction of plan metadata, schedule, cited standards and work items from lines, with where each was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Field, label pattern and priority of labelled plan metadata.
LABELS = (
    ("project_name", "工程名称|项目名称", 30), ("location", "工程地点|建设地点|工程地址", 20), ("owner", "建设单位|业主单位", 20), ("designer", "设计单位", 20),
    ("supervisor", "监理单位", 20), ("contractor", "施工单位|总包单位", 20), ("planned_start", "计划开工(?:日期|时间)|开工日期", 20), ("planned_end", "计划(?:竣工|完工)(?:日期|时间)|竣工日期", 20),
)
MOBILE = "1[3-9][0-9]{9}"
#: Headings of the list of standards.
BASIS = "编制(?:说明及)?依据|依据文件|主要规范标准"
CONTACT = "联系人|联系电话|电话|手机|负责人"
PRESENCE = {
    "quality": "质量|验收标准", "safety": "安全|危险源", "environment": "环境|文明施工|扬尘|防噪音|绿色施工", "emergency": "应急",
}
CATEGORIES = (("脚手架工程", "脚手架|悬挑"), ("模板工程", "模板|支模"), ("深基坑工程", "基坑|支护"), ("给排水工程", "给水|排水|管道"), ("弱电工程", "弱电|布线"), ("边坡工程", "边坡|锚索"))


def label_values(lines: DataFrame, doc: str, labels: Sequence[tuple[str, str, int]] = LABELS) -> DataFrame:
    """doc, field, value, page_number and line: for each labelled field the value with the highest priority, then the first place.

    A value follows its label after a colon or a space; where the next label
    starts it ends. The labels are literals, so no join is needed.
    """
    every = "|".join(p for _, p, _ in labels)
    found = []
    for field, pattern, priority in labels:
        value = T.strip(F.regexp_extract("line", f"(?:{pattern})\\s*[：:]\\s*(.+?)(?=\\s+(?:{every})\\s*[：:]|$)", 1))
        found.append(F.when(value != "", F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(priority).alias("priority"))))
    rows = lines.select(doc, "page_number", "line_index", "line", F.explode(F.array_compact(F.array(*found))).alias("f"))
    best = F.min_by(F.struct("f.value", "page_number", "line"), F.struct(-F.col("f.priority"), "page_number", "line_index"))
    return rows.groupBy(doc, F.col("f.field").alias("field")).agg(best.alias("b")).select(doc, "field", "b.value", "b.page_number", "b.line")


def is_contact(value: Column, context: Column) -> Column:
    """A person rather than an organisation: a contact word, a mobile number, and a name of two to four characters left."""
    rest = F.regexp_replace(F.regexp_replace(value, f"{CONTACT}|{MOBILE}", ""), r"(?U)[\s：:，,（）()]+", "")
    return F.regexp_like(context, F.lit(CONTACT)) & F.regexp_like(context, F.lit(MOBILE)) & F.regexp_like(rest, F.lit("^[㐀-鿿]{2,4}$"))


def schedule(lines: DataFrame, doc: str) -> DataFrame:
    """doc, start_date, end_date and days from labelled dates and durations; the first of each counts."""
    dated = label_values(lines, doc, tuple(x for x in LABELS if x[0].startswith("planned")))
    pivot = dated.groupBy(doc).agg(*(F.max(F.when(F.col("field") == f, T.iso_date(F.col("value")))).alias(n) for f, n in (("planned_start", "start_date"), ("planned_end", "end_date"))))
    length = F.regexp_extract("line", "(?:总工期|工期)[^0-9]{0,8}([0-9]{1,4}) *(?:个)?(?:日历)?天", 1)
    days = lines.withColumn("d", length).where("d <> ''").groupBy(doc).agg(F.min_by(F.col("d").cast("int"), F.struct("page_number", "line_index")).alias("days"))
    return pivot.join(days, doc, "full")


def cited_standards(lines: DataFrame, doc: str, in_calculation: Column | None = None) -> DataFrame:
    """doc, code, name, page_number, place and position: all cited codes with the title on their line or beside it; the best citation counts, in order of first place (line, then position in it).

    Named citations, pages that list what a plan is based on and, with
    ``in_calculation`` (a flag of the line's page), pages outside calculations come
    first. Where a line cites several codes, each has the title next to it.
    """
    w = Window.partitionBy(doc).orderBy("page_number", "line_index")
    title_in = lambda c: F.nullif(F.regexp_extract(c, "《([^》]{2,60})》", 1), F.lit(""))
    basis = F.coalesce(F.max(F.regexp_like("line", F.lit(BASIS))).over(Window.partitionBy(doc, "page_number")), F.lit(False))
    calculation = F.lit(False) if in_calculation is None else F.coalesce(in_calculation, F.lit(False))
    bonus = F.when(basis, 300).otherwise(0) - F.when(calculation, 500).otherwise(0)
    rows = lines.withColumn("title", title_in(F.col("line"))).withColumn("bonus", bonus).withColumn("codes", T.standard_codes(F.col("line"))).withColumn("parts", F.split("line", T.CITED, -1))
    rows = rows.withColumn("near", F.coalesce("title", F.lag("title").over(w), F.lead("title").over(w))).withColumn("seq", F.row_number().over(w))
    after = F.when(title_in(F.col("parts")[0]).isNull(), 1).otherwise(0)
    rows = rows.withColumn("after", after).select(doc, "page_number", "seq", "bonus", "near", "parts", "after", F.posexplode("codes").alias("position", "code")).where("code is not null")
    name = F.coalesce(title_in(F.get("parts", F.col("position") + F.col("after"))), "near")
    rows = rows.withColumn("name", name)
    score = F.col("bonus") + F.when(F.col("name").isNotNull(), 100).otherwise(0)
    best = F.max_by(F.struct("name", "page_number"), F.struct(score, -F.col("page_number"), -F.col("seq"), -F.col("position")))
    found = rows.groupBy(doc, "code").agg(best.alias("b"), F.min(F.struct("seq", "position")).alias("first"))
    return found.select(doc, "code", "b.name", "b.page_number", F.col("first.seq").alias("place"), "first.position")


def identify_standard(candidates: DataFrame, doc: str, margin: int = 30) -> DataFrame:
    """doc, code, score and status: the best code, CONFLICT if another code comes within ``margin`` of it. ``candidates``: doc, code, score."""
    best = candidates.groupBy(doc, "code").agg(F.max("score").alias("score"))
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), "code")))
    top = ranked.groupBy(doc).agg(F.max(F.when(F.col("n") == 1, F.col("code"))).alias("code"), F.max(F.when(F.col("n") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("n") == 2, F.col("score"))).alias("second"))
    return top.select(doc, "code", "score", F.when(F.col("score") - F.col("second") < margin, "CONFLICT").otherwise("IDENTIFIED").alias("status"))


def identity_score(page: Column, distance: Column, in_title: Column, on_cover: Column, referenced: Column) -> Column:
    """Score of a code's place: early pages, a title on the line or near it, and less for mere references."""
    near = F.when(distance == 0, 120).when(distance <= 3, 95 - 15 * distance).otherwise(0)
    return 100 - 20 * (page - 1) + near + F.when(in_title, 25).otherwise(0) + F.when(on_cover, 20).otherwise(0) - F.when(referenced, 120).otherwise(0)


def category(text: Column) -> Column:
    """The engineering category with the most pattern hits, at least two; ties go to the first listed."""
    hits = F.array(*(F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, p) in enumerate(CATEGORIES)))
    best = F.array_max(hits)
    return F.when(best["n"] >= 2, best["name"])


def section_presence(lines: DataFrame, doc: str) -> DataFrame:
    """doc and a flag for each of PRESENCE: short lines that are numbered or end without punctuation count as headings."""
    line = T.strip(F.col("line"))
    numbered = F.regexp_like(line, F.lit("^(?:第[一二三四五六七八九十百0-9]+章|[一二三四五六七八九十]+、|[0-9]+(?:\\.[0-9]+)+[、.．]?|[0-9]+[、.．])"))
    likely = (line != "") & (F.length(line) <= 60) & (numbered | ~F.regexp_like(line, F.lit("[。；;，,]$")))
    return lines.groupBy(doc).agg(*(F.coalesce(F.bool_or(likely & F.regexp_like(line, F.lit(p))), F.lit(False)).alias(n) for n, p in PRESENCE.items()))


def edition(code: Column, explicit_year: Column) -> Column:
    """struct(edition, confidence): the year of the code; a different explicit one makes it null and LOW."""
    year = F.nullif(F.regexp_extract(code, "-([0-9]{4})$", 1), F.lit(""))
    clash = explicit_year.isNotNull() & year.isNotNull() & (explicit_year != year)
    return F.struct(F.when(~clash, F.coalesce(explicit_year, year)).alias("edition"), F.when(clash, "LOW").when(year.isNull() & explicit_year.isNull(), "NONE").otherwise("HIGH").alias("confidence"))


def work_item(title: Column) -> Column:
    """A work item's name from a chapter title: without number and method suffixes, a bare support wall gets its work."""
    name = F.regexp_replace(T.strip(title), "^[0-9.、（）()一二三四五六七八九十]+\\s*", "")
    name = F.regexp_replace(name, "(?:施工)?(?:方法|工艺|技术|措施|方案|要求|流程)+$", "")
    return F.when(F.endswith(name, F.lit("支护")), F.concat(name, F.lit("施工"))).otherwise(name)


def keep_method(name: Column, depth: Column, in_calculation: Column) -> Column:
    """Whether a heading names a method: no statement, calculation or formula, deep ones end in a noun of work, shallow ones are short."""
    statement = F.regexp_like(name, F.lit("^(?:采用|应|必须|不得|严禁|确保)|[。；;，,：:]$"))
    deep = F.regexp_like(name, F.lit("(?:施工|安装|拆除|搭设|浇筑|开挖|回填|吊装|焊接|敷设|调试)$"))
    return ~in_calculation & ~statement & T.is_title(name) & F.when(depth >= 4, deep).when(depth == 1, F.length(name) <= 20).otherwise(True)


def malformed_code(text: Column) -> Column:
    """Whether a code's prefix and a number stand in a text without making a whole code."""
    rest = F.regexp_replace(text, T.CODE, " ")
    return F.regexp_like(rest, F.lit(r"(?i)(?<![A-Z0-9])(?:(?:GB|JGJ|CJJ)(?:\s*/\s*T)?|T\s*/\s*CECS)\s*[0-9]"))
