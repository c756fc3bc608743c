"""Quality of recognised text lines: geometry, confidence, reading order, and what may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence bands and geometry thresholds.
CONFIDENCE_REJECT, CONFIDENCE_ACCEPT = 0.50, 0.80
ANGLE, TALL, TALLER, COMPACT, OVERLAP, LEFT = 8.0, 1.35, 2.35, 3.0, 0.35, 1.5
RASTER_HEIGHT, RASTER_ASPECT, RASTER_SUPPORT = 1.35, 3.0, 0.25
LEAST_CHARACTERS = 12
ARTICLE = r"^(?:第 *)?(?:[0-9]+\.){2,3}[0-9]+(?:-[0-9]+)?(?: |条|$)"
ARTICLE_LIKE = r"^[0-9]+[.,·][0-9]+[.,·]?[0-9]*"
FUSED = r"^([0-9]+)\.([0-9])[0-9]+(?: |$)"
#: Issues that put a whole article aside.
ARTICLE_ISSUES = ("STRUCTURAL_SEQUENCE_GAP", "ARTICLE_NUMBER_AMBIGUITY", "CONFIDENCE_REJECTED", "READING_ORDER_ANOMALY")


def box(polygon: Column) -> dict[str, Column]:
    """left, right, top, bottom, width, height and angle (degrees of the top edge) of an array of points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    dx, dy = polygon[1][0] - polygon[0][0], polygon[1][1] - polygon[0][1]
    angle = F.when(F.size(polygon) < 2, 0.0).otherwise(F.degrees(F.atan2(dy, dx)))
    return {"left": left, "right": right, "top": top, "bottom": bottom, "width": right - left, "height": bottom - top, "angle": angle}


def line_issues(lines: DataFrame, page: str) -> DataFrame:
    """page, line_id and issue of single lines. ``lines``: page, line_id, text, confidence and the parts of :func:`box`; optional relative_support, height_ratio and aspect_ratio of raster support."""
    of_page = Window.partitionBy(page)
    typical = F.coalesce(F.percentile(F.when(F.col("height") > 0, F.col("height")), F.lit(0.5)).over(of_page), F.lit(1.0))
    prefixes = F.collect_set(F.when(F.regexp_like("text", F.lit(ARTICLE)), F.regexp_extract("text", r"([0-9]+\.[0-9]+)", 1))).over(of_page)
    rows = lines.withColumn("__t", typical).withColumn("__p", prefixes)
    tilted = (F.abs("angle") >= ANGLE) & (F.col("height") >= F.col("__t") * TALL)
    large = (F.col("height") >= F.col("__t") * TALLER) & (F.col("width") <= F.col("height") * COMPACT)
    fused = F.regexp_like("text", F.lit(FUSED)) & F.array_contains("__p", F.concat_ws(".", F.regexp_extract("text", FUSED, 1), F.regexp_extract("text", FUSED, 2)))
    found = [
        F.when(F.col("confidence") < CONFIDENCE_REJECT, "CONFIDENCE_REJECTED").when(F.col("confidence") < CONFIDENCE_ACCEPT, "CONFIDENCE_REVIEW_REQUIRED"),
        F.when(tilted | large, "SUSPICIOUS_OVERLAY_GEOMETRY"),
        F.when((F.regexp_like("text", F.lit(ARTICLE_LIKE)) & ~F.regexp_like("text", F.lit(ARTICLE))) | fused, "ARTICLE_NUMBER_AMBIGUITY"),
    ]
    if "relative_support" in lines.columns:
        found.append(F.when((F.col("height_ratio") >= RASTER_HEIGHT) & (F.col("aspect_ratio") <= RASTER_ASPECT) & (F.col("relative_support") <= RASTER_SUPPORT), "INSUFFICIENT_RASTER_TEXT_SUPPORT"))
    return rows.select(page, "line_id", F.explode(F.array_compact(F.array(*found))).alias("issue"))


def page_issues(lines: DataFrame, page: str) -> DataFrame:
    """page, line_id and issue for all lines of pages with under LEAST_CHARACTERS filled characters or repeated line ids."""
    of_page = Window.partitionBy(page)
    filled = F.sum(F.length(F.regexp_replace("text", r"(?U)\s+", ""))).over(of_page)
    twice = F.count(F.lit(1)).over(Window.partitionBy(page, "line_id"))
    rows = lines.withColumn("__f", filled).withColumn("__r", twice)
    found = F.array_compact(F.array(F.when(F.col("__f") < LEAST_CHARACTERS, "LOW_TEXT_COVERAGE"), F.when(F.col("__r") > 1, "SOURCE_MAPPING_FAILURE")))
    return rows.select(page, "line_id", F.explode(found).alias("issue"))


def detached_numbers(lines: DataFrame, page: str) -> DataFrame:
    """page, line_id and body_id: number lines that overlap a body line in height by more than OVERLAP of the lower one and do not stand right of its start; the first body line by id counts.

    An equality join by page with a residual on the boxes; only number lines enter
    one side, so pairs grow with numbers times lines of a page.
    """
    typical = F.coalesce(F.percentile(F.when(F.col("height") > 0, F.col("height")), F.lit(0.5)).over(Window.partitionBy(page)), F.lit(1.0))
    rows = lines.withColumn("typical", typical)
    n = rows.where(F.regexp_like("text", F.lit("^[0-9]{1,3}$"))).alias("n")
    b = rows.alias("b")
    shared = F.least("n.bottom", "b.bottom") - F.greatest("n.top", "b.top")
    meets = (F.col(f"n.{page}") == F.col(f"b.{page}")) & (F.col("n.line_id") != F.col("b.line_id")) & (shared > F.least(F.col("n.height"), F.col("b.height")) * OVERLAP)
    meets = meets & (F.col("n.left") <= F.col("b.left") + F.col("n.typical") * LEFT) & (F.abs("b.angle") < ANGLE)
    return n.join(b, meets).groupBy(F.col(f"n.{page}").alias(page), F.col("n.line_id").alias("line_id")).agg(F.min("b.line_id").alias("body_id"))


def widen_to_articles(issues: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """issues, and for those of ARTICLE_ISSUES one row for each line of the article they lie in. ``lines``: page, line_id, article."""
    held = issues.where(F.col("issue").isin(*ARTICLE_ISSUES)).join(lines.select(page, "line_id", "article"), [page, "line_id"]).where("article is not null").select("article", "issue").distinct()
    return issues.select(page, "line_id", "issue").union(lines.join(held, "article").select(page, "line_id", "issue")).distinct()


def page_states(lines: DataFrame, issues: DataFrame, page: str) -> DataFrame:
    """page, n_lines, n_accepted and state: REJECTED with no line left, LOW_CONFIDENCE with any issue, else ACCEPTED."""
    touched = issues.select(page, "line_id").distinct().withColumn("__x", F.lit(True))
    rows = lines.select(page, "line_id").join(touched, [page, "line_id"], "left")
    out = rows.groupBy(page).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("__x").isNull()).alias("n_accepted"))
    return out.withColumn("state", F.when(F.col("n_accepted") == 0, "OCR_REJECTED").when(F.col("n_accepted") < F.col("n_lines"), "OCR_LOW_CONFIDENCE").otherwise("OCR_ACCEPTED"))


def run_state(states: DataFrame) -> DataFrame:
    """One row: the state of a run from its pages'."""
    return states.agg(F.when(F.bool_and(F.col("state") == "OCR_REJECTED"), "OCR_REJECTED").when(F.bool_or(F.col("state") != "OCR_ACCEPTED"), "OCR_LOW_CONFIDENCE").otherwise("OCR_ACCEPTED").alias("state"))


def capability_decision(requested: Column, authorised: Column, needed: Column, available: Column) -> Column:
    """NOT_REQUIRED, REQUIRED, MIXED, UNAVAILABLE or BLOCKED for a request of pages: requested, authorised and needed are arrays of page numbers."""
    outside = F.size(F.array_except(requested, authorised)) > 0
    n = F.size(F.array_intersect(requested, needed))
    return F.when(outside, "BLOCKED").when(n == 0, "NOT_REQUIRED").when(~available, "UNAVAILABLE").when(n == F.size(requested), "REQUIRED").otherwise("MIXED")
