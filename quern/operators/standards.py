"""Standards: chapters from contents and headings, articles over pages, structural evidence, reading order, and what recognised text may enter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import text as T
from quern.operators import regions as R
from quern.operators import structure as S
from quern.operators.joins import rows_after

#: Fixed value: contents entries end in dots and a page number.
CONTENTS_SUFFIX = r"(?:\.{2,}|…{2,}|·{2,}|\s{2,})\s*\d+\s*$"


def contents_pages(pages: DataFrame, doc: str, page: str, most: int = 5) -> DataFrame:
    """pages with ``in_contents``: from the page titled contents (within the first ``most``) while pages hold contents entries."""
    w = Window.partitionBy(doc).orderBy(page)
    lines = F.transform(F.split("text", "\n"), lambda x: T.strip(x))
    titled = F.exists(lines, lambda x: F.regexp_like(x, F.lit("(?i)^(?:目录|目 *录|contents)$"))) & (F.row_number().over(w) <= most)
    rows = pages.withColumn("__t", titled).withColumn("__e", F.exists(lines, lambda x: F.regexp_like(x, F.lit(CONTENTS_SUFFIX))))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__on", F.max(F.col("__t").cast("int")).over(upto) == 1)
    broken = F.max((F.col("__on") & ~F.col("__t") & ~F.col("__e")).cast("int")).over(upto) == 1
    return rows.withColumn("in_contents", F.col("__on") & ~broken).drop("__t", "__e", "__on")


def chapters(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, title, level, start_page, end_page: contents titles at the first body page with that heading, and body headings that contents lack.

    An end may be the next chapter's start page.
    """
    marked = contents_pages(pages, doc, page)
    lines = S.explode_lines(marked, [doc, page, "in_contents"])
    body = S.once(lines.where(~F.col("in_contents")), h=T.heading(F.col("line"))).where("h is not null").select(doc, page, "line_index", "h.title", "h.level")
    entries = S.once(lines.where("in_contents"), h=T.heading(F.regexp_replace("line", CONTENTS_SUFFIX, ""))).where("h is not null").select(doc, F.col("h.title").alias("title")).distinct()
    place = F.struct(page, "line_index")
    first = body.groupBy(doc, "title").agg(F.min_by(F.struct(page, "line_index", "level"), place).alias("f")).select(doc, "title", f"f.{page}", "f.line_index", "f.level")
    listed = first.join(entries.withColumn("listed", F.lit(True)), [doc, "title"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    any_listed = F.max(F.col("listed").cast("int")).over(Window.partitionBy(doc)) == 1
    chosen = listed.withColumn("__any", any_listed).where("listed or not __any or level = 1").withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy(page, "line_index")).cast("long"))
    ends = chosen.withColumn("next_seq", S.next_boundary(doc, "seq", "level"))
    starts = chosen.select(F.col(doc).alias("__d"), F.col("seq").alias("__s"), F.col(page).alias("next_page"))
    last = pages.groupBy(F.col(doc).alias("__l")).agg(F.max(page).alias("last_page"))
    out = ends.join(starts, (F.col(doc) == F.col("__d")) & (F.col("next_seq") == F.col("__s")), "left").join(last, F.col(doc) == F.col("__l"))
    return out.select(doc, "title", "level", F.col(page).alias("start_page"), F.greatest(page, F.least(F.coalesce("next_page", F.col("last_page")), "last_page")).alias("end_page"))


def articles(lines: DataFrame, doc: str, order: Sequence[str]) -> DataFrame:
    """doc, article_number, session, region, first and last (of order's columns), content and ambiguous (a number that came before).

    ``lines``: doc, the order columns, line and region. An article opens at its
    start line, takes the lines of its region over pages, and closes at a chapter
    heading or a change of region.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    rows = S.once(lines, a=T.article_start(F.col("line")), h=T.standard_heading(F.col("line")))
    moved = ~F.col("region").eqNullSafe(F.lag("region").over(w))
    rows = S.sessions(rows.withColumn("moved", moved), doc, order, F.col("a").isNotNull() & (F.col("region") != "FRONT_MATTER"), F.col("h").isNotNull() | F.col("moved"))
    place = F.struct(*order)
    body = F.coalesce("a.content", T.strip(F.col("line")))
    parts = F.array_sort(F.collect_list(F.struct(place.alias("p"), body.alias("t"))))
    out = rows.where("session is not null").groupBy(doc, "session").agg(
        F.max("a.number").alias("article_number"), F.min("region").alias("region"), F.min(place).alias("first"), F.max(place).alias("last"), T.join_lines(F.transform(parts, lambda p: p["t"])).alias("content")
    )
    before = F.count(F.lit(1)).over(Window.partitionBy(doc, "region", "article_number").orderBy("session").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("ambiguous", before > 0)


def parse(pages: DataFrame, doc: str, page: str, checksum: Column) -> DataFrame:
    """The articles of standards from their pages (doc, page, text, and what ``checksum`` needs): article_id, article_number, region, page_start, page_end, content, sequence and ambiguous.

    Page numbers and outer lines that repeat are left out first; regions and
    articles run over pages. An empty table gives an empty result.
    """
    kept = S.strip_edges(pages.select(doc, page, "text"), doc, page).where(~T.is_page_number(F.col("line")))
    lines = R.standard_regions(kept, doc, [page, "line_index"])
    found = articles(lines, doc, [page, "line_index"]).join(pages.groupBy(doc).agg(F.min(checksum).alias("__sum")), doc)
    placed = article_ids(found, F.col("__sum"))
    return placed.select(doc, "article_id", "article_number", "region", F.col(f"first.{page}").alias("page_start"), F.col(f"last.{page}").alias("page_end"), "content", F.col("session").alias("sequence"), "ambiguous")


def article_ids(rows: DataFrame, checksum: Column) -> DataFrame:
    """rows with article_id: a positional identity of what an article is and says."""
    return rows.withColumn("article_id", ids.positional_id("article_", checksum, F.upper("article_number"), F.col("region"), F.col("content")))


def structural_gates(candidates: DataFrame) -> DataFrame:
    """candidates with ``gate``: the first condition that a heading candidate fails, or RESOLVED.

    Columns: checksum, source_checksum, contiguous, region, inside_article,
    number, kind, text, source_text, previous_article, next_article.
    """
    wanted = F.when(F.regexp_like("number", F.lit("^[A-Z]")), F.when(F.contains("number", F.lit(".")), "APPENDIX_SECTION").otherwise("APPENDIX")).otherwise(F.when(F.contains("number", F.lit(".")), "SECTION").otherwise("CHAPTER"))
    gate = (
        F.when(F.col("checksum") != F.col("source_checksum"), "CHECKSUM_MISMATCH").when(~F.col("contiguous"), "SOURCE_NOT_CONTIGUOUS").when(~F.col("region").isin("NORMATIVE_BODY", "APPENDIX"), "REGION_NOT_ALLOWED")
        .when(F.col("inside_article"), "INSIDE_ARTICLE").when(wanted != F.col("kind"), "NUMBER_KIND_MISMATCH").when(T.compact(F.col("text")) != T.compact(F.col("source_text")), "TEXT_NOT_GROUNDED")
        .when(F.col("next_article").isNotNull() & ~T.number_prefix(F.col("next_article"), F.col("number")), "NEXT_ARTICLE_INCOMPATIBLE").when(F.coalesce(T.number_prefix(F.col("previous_article"), F.col("number")), F.lit(False)), "PREVIOUS_ARTICLE_INSIDE")
        .otherwise("RESOLVED")
    )
    return candidates.withColumn("gate", gate)


def reading_order(lines: DataFrame, page: str) -> DataFrame:
    """lines with reading_order from 1: by page, top, left and line_id."""
    return lines.withColumn("reading_order", F.row_number().over(Window.partitionBy(page).orderBy("top", "left", "line_id")).cast("long"))


def article_intervals(lines: DataFrame, doc: str, order: str) -> DataFrame:
    """doc, article_number, first, until (start of the next article, null at the end) and cut (first structural heading in between, which ends the article)."""
    ahead = rows_after(doc, [order])
    rows = S.once(lines, number=T.article_start(F.col("line"))["number"], __s=T.standard_heading(F.col("line"))).withColumn("__h", F.col("__s").isNotNull() & F.col("number").isNull()).drop("__s")
    rows = rows.withColumn("until", F.min(F.when(F.col("number").isNotNull(), F.col(order))).over(ahead)).withColumn("__c", F.min(F.when(F.col("__h"), F.col(order))).over(ahead))
    cut = F.when(F.col("until").isNull() | (F.col("__c") < F.col("until")), F.col("__c"))
    return rows.where("number is not null").select(doc, F.col("number").alias("article_number"), F.col(order).alias("first"), "until", cut.alias("cut"))


def offsets(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """lines with char_start and char_end in the text that joins them by line ends."""
    before = F.coalesce(F.sum(F.length(text) + 1).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("char_start", before).withColumn("char_end", before + F.length(text))


def accepted_slots(lines: DataFrame, accepted: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """lines whose text is blank unless accepted, so that places stay; ``accepted`` has keys."""
    met = lines.join(accepted.select(*keys).distinct().withColumn("__ok", F.lit(True)), list(keys), "left")
    return met.withColumn(text, F.when(F.col("__ok"), F.col(text)).otherwise("")).drop("__ok")


def verified_spans(spans: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans with ``verified``: VERIFIED, MISMATCH (other text at the offsets), AMBIGUOUS (no offsets and the text stands twice) or MISSING.

    ``spans``: keys, start (null if unknown) and span; ``pages``: keys and text.
    """
    met = spans.join(pages.select(*keys, F.col("text").alias("__t")), list(keys), "left")
    size = F.length("span")
    times = (F.length("__t") - F.length(F.replace(F.col("__t"), F.col("span"), F.lit("")))) / size
    at = F.substring(F.col("__t"), F.col("start") + 1, size) == F.col("span")
    status = F.when(F.col("__t").isNull() | (size == 0), "MISSING").when(F.col("start").isNotNull(), F.when(at, "VERIFIED").otherwise("MISMATCH")).when(times == 0, "MISSING").when(times == 1, "VERIFIED").otherwise("AMBIGUOUS")
    return met.withColumn("verified", status).drop("__t")


def qualified_bindings(bindings: DataFrame, stored: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """bindings with ``qualified``: whether exactly one stored row has the key and all fields equal."""
    named = stored.select(F.col(key).alias("__k"), *(F.col(f).alias(f"__{f}") for f in fields))
    single = named.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"), *(F.min(f"__{f}").alias(f"__{f}") for f in fields))
    met = bindings.join(single, F.col(key) == F.col("__k"), "left")
    same = F.coalesce(F.col("__n") == 1, F.lit(False))
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return met.select(*bindings.columns, same.alias("qualified"))
