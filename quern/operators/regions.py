"""Regions of a standard: front matter, normative body, appendices, explanation, lists of repealed rules.

Which heading opens which region depends on the region so far. Three headings
open theirs from anywhere (RESETS); between two of them only few changes are
possible, and each has a closed form as a running count or the last of some
marks. So regions come from windows over a document's lines, without a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: The shapes of lines. White space in lines is single blanks.
SHAPES = {
    "toc": "(?i)^(?:目 ?录|目 ?次|contents)$",
    "toc_entry": r"(?:\.{2,}|…{2,}|·{2,}|-{3,}|—{3,}) ?[0-9]+ ?$",
    "explanation": "^(?:[一二三四五六七八九十]+[、.．] ?)?(?:本(?:规范|标准))?条文说明$",
    "drafting": "^(?:附 ?[:：]? ?)?起草说明$",
    "normative": "^(?:规范|标准)?正文(?:部分)?$",
    "repealed": "^(?:废止的?条文|废止条款(?:清单|目录)?|现行工程建设标准相关强制性条文同时废止)$",
    "repealed_intro": "同时废止下列.*(?:强制性)?条文[:：]?$",
    "repealed_item": "^[一二三四五六七八九十]+[、.．]",
    "appendix": "(?i)^附录 ?[A-Z](?: [^.·…]{1,40})?$",
    "appendix_article": r"(?i)^[A-Z]\.(?:[0-9]+\.)+[0-9]+(?:-[0-9]+)?(?: |条|$)",
    "root": "^(?:第 ?[一1] ?章(?: .+)?|1 总 ?则)$",
    "chapter": r"^(?:第 ?[一二三四五六七八九十百0-9]+ ?章|[0-9]+ \S+)",
    "article": r"^(?:第 ?)?(?:[0-9]+\.){2,3}[0-9]+(?:-[0-9]+)?(?: |条|$)",
}
#: Headings that open a region whatever came before, and that region. After a mark of the normative text the body waits for its first chapter.
RESETS = {"normative": "OTHER", "drafting": "OTHER", "explanation": "EXPLANATION"}
#: Lines that a heading may look ahead, blank ones not counted.
AHEAD = 3


def _is(text: Column, *shapes: str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.regexp_like(text, F.lit(SHAPES[s])), F.lit(False)) for s in shapes))


def _headings(line: Column, ahead: list[Column]) -> dict[str, Column]:
    """kind -> whether the line is such a heading, given the lines after it. Some headings run over two lines."""
    both = F.concat(line, F.coalesce(ahead[0], F.lit("")))
    follows = lambda *shapes: reduce(lambda a, b: a | b, (_is(x, *shapes) for x in ahead))
    return {
        "normative": _is(line, "normative"),
        "drafting": _is(line, "drafting"),
        "explanation": _is(line, "explanation") & follows("chapter", "article"),
        "repealed": (_is(line, "repealed") | _is(both, "repealed_intro")) & follows("article", "repealed_item"),
        "root": (_is(line, "root") | _is(both, "root")) & follows("article"),
        "appendix": _is(line, "appendix") & ahead[0].isNotNull() & (_is(ahead[0], "appendix_article") | ~_is(ahead[0], "toc_entry")),
        "opening": _is(line, "article") | (_is(line, "chapter") & follows("article")),
    }


def standard_regions(lines: DataFrame, doc: str, order: Sequence[str]) -> DataFrame:
    """lines with ``region``: FRONT_MATTER, NORMATIVE_BODY, APPENDIX, EXPLANATION, REPEALED_LIST or OTHER.

    ``lines``: doc, the columns of ``order`` and line. A contents list, from its
    title to the first line that is no entry, is front matter wherever it stands;
    it, blank lines and other lines that look like entries open no region. Null
    lines count as blank. An empty table gives an empty result.
    """
    c, upto = F.col, Window.unboundedPreceding
    line = Window.partitionBy(doc).orderBy(*order)
    rows = lines.withColumn("__t", F.coalesce(T.squeeze(F.col("line")), F.lit(""))).withColumn("__blank", c("__t") == "")
    filled = Window.partitionBy(doc, "__blank").orderBy(*order)
    rows = rows.select("*", *(F.lead("__t", k).over(filled).alias(f"__a{k}") for k in range(1, AHEAD + 1)), _is(c("__t"), "toc").alias("__toc"), _is(c("__t"), "toc_entry").alias("__entry"))
    listed = F.last(F.when(c("__toc"), True).when(~c("__blank") & ~c("__entry"), False), ignorenulls=True).over(line.rowsBetween(upto, 0))
    rows = rows.withColumn("__listed", F.coalesce(listed, F.lit(False))).withColumn("__seen", F.max("__toc").over(line.rowsBetween(upto, 0)))
    kinds = _headings(c("__t"), [c(f"__a{k}") for k in range(1, AHEAD + 1)])
    kinds["opening"] = kinds["opening"] & ~c("__seen")
    kind = reduce(lambda out, k: F.when(kinds[k], k).otherwise(out), reversed(kinds), F.lit(None).cast("string"))
    rows = rows.withColumn("__kind", F.when(~(c("__blank") | c("__toc") | c("__entry")), kind))

    reset = c("__kind").isin(*RESETS)
    rows = rows.withColumn("__from", F.last(F.when(reset, c("__kind")), ignorenulls=True).over(line.rowsBetween(upto, 0))).withColumn("__part", F.sum(reset.cast("int")).over(line.rowsBetween(upto, 0)))
    rows = rows.withColumn("__part", F.coalesce("__part", F.lit(0)))
    part = Window.partitionBy(doc, "__part").orderBy(*order)
    so_far, before = part.rowsBetween(upto, 0), part.rowsBetween(upto, -1)
    is_ = lambda *kinds: F.coalesce(c("__kind").isin(*kinds), F.lit(False))
    number = lambda cond, frame: F.coalesce(F.sum(cond.cast("int")).over(frame), F.lit(0))
    # Body or repealed list by the last heading of either; an opening counts before both, a repealed list after a normative mark only behind a chapter.
    front = c("__from").isNull()
    rows = rows.withColumn("__roots", number(is_("root"), so_far)).withColumn("__moved", number(is_("root", "repealed"), before))
    phase = F.when(is_("root") | (is_("opening") & front & (c("__moved") == 0)), "NORMATIVE_BODY").when(is_("repealed") & (front | (c("__roots") > 0)), "REPEALED_LIST")
    rows = rows.withColumn("__phase", F.last(phase, ignorenulls=True).over(so_far))
    # Appendices begin in the body and end with the first chapter after them, for good.
    rows = rows.withColumn("__appended", number(is_("appendix") & c("__phase").eqNullSafe("NORMATIVE_BODY"), so_far) > 0)
    rows = rows.withColumn("__closed", number(c("__appended") & is_("root"), so_far) > 0)
    walked = F.when(c("__closed"), "OTHER").when(c("__appended"), "APPENDIX").otherwise(c("__phase"))
    region = F.when(c("__listed"), "FRONT_MATTER").when(front, F.coalesce(walked, F.lit("FRONT_MATTER"))).when(c("__from") == "normative", F.coalesce(walked, F.lit(RESETS["normative"])))
    for k in ("drafting", "explanation"):
        region = region.when(c("__from") == k, RESETS[k])
    return rows.select(*lines.columns, region.alias("region"))
