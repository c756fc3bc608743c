"""Work items and methods: bodies under headings, ancestors, evidence pages, and which of them stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Chapters that hold methods, and those that never do.
METHOD_PARENTS = "施工方法|施工工艺|施工技术|安装施工|施工方案"
EXCLUDED_PARENTS = "计算书|验算|编制依据|应急|质量|安全|环境|管理|组织机构"
SNIPPET = 300


def bodies(lines: DataFrame, doc: str, order: str, title: Column, level: Column, most: int = SNIPPET) -> DataFrame:
    """doc, title, level, first and body: the text under each heading up to the next of its level or above, cut to ``most`` characters.

    title and level are null on lines that are no headings. Text goes to the
    nearest heading; a heading's body also holds those of the headings below it.
    """
    rows = lines.withColumn("__t", title).withColumn("__l", level)
    heads = rows.where("__t is not null").select(doc, F.col("__t").alias("title"), F.col("__l").alias("level"), F.col(order).alias("first"))
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # A line lies under the last heading of level n or above, if that has level n.
    over = [F.last(F.when(F.col("__t").isNotNull() & (F.col("__l") <= n), F.struct(F.col(order).alias("at"), F.col("__l").alias("l"))), ignorenulls=True).over(upto) for n in range(1, 7)]
    owners = F.array_compact(F.array(*(F.when(F.col(f"__o{n}.l") == n, F.col(f"__o{n}.at")) for n in range(1, 7))))
    owned = rows.select("*", *(o.alias(f"__o{n}") for n, o in enumerate(over, 1))).where("__t is null")
    owned = owned.select(F.col(doc).alias("__d"), F.col(order).alias("__p"), "line", F.explode(owners).alias("__first"))
    before = Window.partitionBy("__d", "__first").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    near = owned.withColumn("__before", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).where(F.col("__before") < most)
    parts = F.array_sort(F.collect_list(F.struct("__p", "line")))
    body = F.substring(F.array_join(F.transform(parts, lambda p: p["line"]), "\n"), 1, most)
    texts = near.groupBy("__d", "__first").agg(body.alias("body"))
    met = heads.join(texts, (F.col(doc) == F.col("__d")) & (F.col("first") == F.col("__first")), "left")
    return met.select(doc, "title", "level", "first", F.coalesce("body", F.lit("")).alias("body"))


def method_context(chapters: DataFrame, doc: str) -> DataFrame:
    """chapters (doc, seq, title, parent) with ``allowed``: no title on the way up is excluded and some is a method chapter."""
    from quern.operators.structure import ancestors_all

    flags = chapters.withColumn("__fine", ~F.regexp_like("title", F.lit(EXCLUDED_PARENTS)))
    up = ancestors_all(flags, doc, "seq", "parent", "__fine").drop("any_ancestor")
    marks = up.withColumn("__method", F.regexp_like("title", F.lit(METHOD_PARENTS)))
    both = ancestors_all(marks.withColumnRenamed("all_ancestors", "__all"), doc, "seq", "parent", "__method")
    return both.withColumn("allowed", F.col("__all") & (F.col("any_ancestor") | F.col("__method"))).drop("__fine", "__method", "__all", "any_ancestor", "all_ancestors")


def keep_work_item(name: Column, m: dict[str, Column]) -> Column:
    """Whether a work item stays, rule by rule: calculation page, title, action or number, related item, material, entity, form, quantity.

    ``m``: in_calculation, is_chapter, numbered, related, is_material flags.
    """
    action = F.regexp_like(name, F.lit("(?:施工|安装|拆除|搭设|浇筑|开挖|回填|吊装|焊接|敷设|调试|工程)$"))
    entity = F.regexp_like(name, F.lit("(?:公司|单位|部门|负责人)$"))
    form = F.regexp_like(name, F.lit("(?:表|图|记录|清单)$"))
    quantity = F.regexp_like(name, F.lit("^[0-9.]+ *(?:m|mm|cm|kg|t|个|根|套|㎡|m²|m³)?$"))
    return (
        F.when(m["in_calculation"], False).when(m["is_chapter"] & T.is_title(name), True).when(action | m["numbered"], True).when(m["related"], True)
        .when(m["is_material"], False).when(entity | form | quantity, False).otherwise(True)
    )


def provenance_score(exact_chapter: Column, heading_is_name: Column, has_heading: Column, has_page: Column, source: Column) -> Column:
    """How well an item's source shows it: exact chapter, heading equal to the name, any heading, a page, and the source's length."""
    part = lambda c, n: F.when(c, n).otherwise(0)
    return part(exact_chapter, 10_000) + part(heading_is_name, 5_000) + part(has_heading, 2_000) + part(has_page, 1_000) + F.length(F.coalesce(source, F.lit("")))


def source_pages(items: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """items with page_number and snippet of the page that shows the item best; null where none does.

    ``items``: doc, item, name and source_text; ``pages``: doc, page_number, text.
    Both sides compare without white space. Source text counts 90, the name 50, a
    contents page -100; ties go to the first page. One equality join by document.
    """
    flat = pages.select(F.col(doc).alias("__d"), "page_number", T.compact(F.col("text")).alias("__t"), F.regexp_like("text", F.lit("(?m)(?:\\.{3,}|…{2,})\\s*[0-9]+\\s*$")).alias("__toc"))
    asked = items.withColumn("__n", T.compact(F.col("name"))).withColumn("__s", T.compact(F.coalesce("source_text", F.lit(""))))
    has = lambda c: (F.length(c) > 0) & F.contains(F.col("__t"), F.col(c))
    score = F.when(has("__s"), 90).otherwise(0) + F.when(has("__n"), 50).otherwise(0)
    met = asked.join(flat, F.col(doc) == F.col("__d")).withColumn("score", score).where("score > 0").withColumn("score", F.col("score") - F.when(F.col("__toc"), 100).otherwise(0))
    at = F.greatest(F.lit(1), F.instr(F.col("__t"), F.col("__n")))
    best = met.groupBy(doc, "item").agg(F.max_by(F.struct("page_number", F.substring(F.col("__t"), at, F.lit(SNIPPET)).alias("snippet")), F.struct("score", -F.col("page_number"))).alias("b"))
    return items.join(best.select(doc, "item", "b.page_number", "b.snippet"), [doc, "item"], "left")


def construction_child(chapters: DataFrame, doc: str, order: str) -> DataFrame:
    """chapters (doc, order, title, level) with ``construction``: whether the chapter right above it by level holds methods and none that never do.

    The parent is the last chapter before with a smaller level; it must be one level up.
    """
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce("level", F.lit(1))
    parent = F.lit(None).cast("struct<l:int,t:string>")
    for n in range(2, 7):
        above = F.last(F.when(level < n, F.struct(level.cast("int").alias("l"), F.col("title").alias("t"))), ignorenulls=True).over(before)
        parent = F.when(level == n, above).otherwise(parent)
    holds = F.regexp_like(parent["t"], F.lit(METHOD_PARENTS)) & ~F.regexp_like(parent["t"], F.lit(EXCLUDED_PARENTS))
    return chapters.withColumn("construction", F.coalesce((level == parent["l"] + 1) & holds, F.lit(False)))


def plain_work_name(name: Column) -> Column:
    """A work item's name up to a colon, without a closing 施工, 工程 or 安装, white space and punctuation."""
    head = F.regexp_replace(F.get(F.split(F.trim(name), "[：:]", 2), F.lit(0)), "(?:施工|工程|安装)$", "")
    return F.regexp_replace(head, r"(?U)[\s、，,。；;：:（）()]+", "")


def same_work_item(a: Column, b: Column) -> Column:
    """Equal plain names, or one of four characters or more that starts the other; the water part of a building also names its supply system."""
    part, system = "给水部分", "生活给水系统"
    water = ((a == part) & F.contains(b, F.lit(system))) | ((b == part) & F.contains(a, F.lit(system)))
    return (a == b) | water | ((F.least(F.length(a), F.length(b)) >= 4) & (F.startswith(a, b) | F.startswith(b, a)))


#: How the first line of a numbered method and of a numbered work item begins.
NUMBERED_METHOD, NUMBERED_WORK = r"^\s*[0-9]+(?:\.[0-9]+)*[、.．]", r"^\s*[（(]?[0-9]+[）)]?、"


def verified_sources(items: DataFrame, pages: DataFrame, doc: str, numbered: str = NUMBERED_METHOD) -> DataFrame:
    """items (doc, page_number, source_text) with ``verified``: whether the first line is numbered and stands on the page that the item names."""
    first = F.get(F.split(T.strip(F.coalesce("source_text", F.lit(""))), T.LINE_END, 2), F.lit(0))
    met = items.join(pages.select(doc, "page_number", F.col("text").alias("__t")), [doc, "page_number"], "left")
    return met.withColumn("verified", F.coalesce(F.regexp_like(first, F.lit(numbered)) & F.contains(F.col("__t"), first), F.lit(False))).drop("__t")
