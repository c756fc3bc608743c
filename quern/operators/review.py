"""Review of plans: candidates, routing, requirements, plan facts, comparison, findings, workspace and report.

Each step is an expression on rows or one join; identities are content hashes.
Rule sets are data, so that classifying costs no join and no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import rules as RU
from quern.functions import text as T


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def candidate_class(text: Column, r: RU.ReviewRules) -> Column:
    """The first of seven ordered classes that a text's signals fit, else UNRESOLVED."""
    has = lambda name: _has(text, getattr(r, name))
    return (
        F.when(has("number_with_unit") & has("numeric_control"), RU.CLASSES[0]).when(has("inspection") & has("context"), RU.CLASSES[1])
        .when(has("material") & has("obligation"), RU.CLASSES[2]).when(has("safety") & (has("obligation") | has("procedure")), RU.CLASSES[3])
        .when(has("structural") & has("obligation"), RU.CLASSES[4]).when(has("procedure") & has("obligation"), RU.CLASSES[5])
        .when(has("obligation") & has("context"), RU.CLASSES[6]).otherwise(RU.CLASSES[7])
    )


def review_worthy(text: Column, r: RU.ReviewRules) -> Column:
    """Numeric control, inspection in context, an obligation of some length, or safety or procedure in context."""
    has = lambda name: _has(text, getattr(r, name))
    long_enough = F.length(F.regexp_replace(text, r"(?U)\s+", "")) >= r.least_obligation
    return (has("number_with_unit") & has("numeric_control")) | (has("inspection") & has("context")) | (has("obligation") & long_enough) | ((has("safety") | has("procedure")) & has("context"))


def topic(text: Column, r: RU.ReviewRules) -> Column:
    """The label of the only topic that matches; the general one if none or several do."""
    labels = F.array_compact(F.array(*(F.when(_has(text, p), F.lit(name)) for name, p in r.topics)))
    return F.when(F.size(labels) == 1, F.get(labels, F.lit(0))).otherwise(r.general_topic)


def confidence(text: Column, cls: Column, r: RU.ReviewRules) -> Column:
    """0.45 and, in hundredths, 35 for numeric control, 10 for obligation, 5 for context, 10 for a class; at most 0.95, unresolved 0.55."""
    has = lambda name: _has(text, getattr(r, name))
    score = F.lit(45) + F.when(has("number_with_unit") & has("numeric_control"), 35).otherwise(0) + F.when(has("obligation"), 10).otherwise(0)
    score = score + F.when(has("context"), 5).otherwise(0) + F.when(cls != "UNRESOLVED", 10).otherwise(0)
    return F.least(score, F.when(cls == "UNRESOLVED", 55).otherwise(95)) / 100


def discover(spans: DataFrame, text: str, r: RU.ReviewRules = RU.REVIEW) -> DataFrame:
    """Spans that are worth a review, with candidate_class, topic, confidence and status."""
    t = F.col(text)
    out = spans.where(review_worthy(t, r)).withColumn("candidate_class", candidate_class(t, r))
    return out.select("*", topic(t, r).alias("topic"), confidence(t, F.col("candidate_class"), r).alias("confidence"), F.when(F.col("candidate_class") == "UNRESOLVED", "UNRESOLVED").otherwise("DISCOVERED").alias("status"))


def route(candidates: DataFrame, text: str, available: DataFrame, r: RU.ReviewRules = RU.REVIEW) -> DataFrame:
    """candidates with codes (available codes of matching domain rules, sorted) and route: ROUTED, AMBIGUOUS_SCOPE or NO_SCOPE.

    ``available``: code, one row for each qualified installed standard. Rules are
    literals in the plan; matching costs no join.
    """
    hits = F.array_compact(F.array(*(F.when(_has(F.col(text), p) & F.col("candidate_class").isin(*classes), F.lit(code)) for _, code, p, classes in r.domains)))
    codes = [code for _, code, _, _ in r.domains]
    known = sorted(row[0] for row in available.where(F.col("code").isin(*codes)).select("code").distinct().collect())
    found = F.array_sort(F.array_intersect(F.array_distinct(hits), F.array(*map(F.lit, known)).cast("array<string>")))
    out = candidates.withColumn("codes", found)
    return out.withColumn("route", F.when(F.size("codes") == 1, "ROUTED").when(F.size("codes") > 1, "AMBIGUOUS_SCOPE").otherwise("NO_SCOPE"))


def numeric_limits(text: Column) -> Column:
    """Array of (operator, value, unit) of the limits in a text; of patterns that would overlap the earlier listed one counts."""
    out, rest = [], text
    for operator, lead in RU.NUMERIC_LIMITS:
        pattern = rf"(?i){lead}\s*({RU.NUMBER})\s*({RU.UNIT})"
        values, units = (F.regexp_extract_all(rest, F.lit(pattern), F.lit(g)) for g in (1, 2))
        out.append(_limits(values, units, operator))
        rest = F.regexp_replace(rest, pattern, "\u0000")
    return F.concat(*out)


def _limits(values: Column, units: Column, operator: str) -> Column:
    return F.zip_with(values, units, lambda v, u: F.struct(F.lit(operator).alias("operator"), v.cast("decimal(38,18)").alias("value"), u.alias("unit")))


def requirement(text: Column) -> Column:
    """struct(modality, atomicity, operator, value, unit): a condition is never proven, one limit is, several are not, none counts cues."""
    limits, condition = numeric_limits(text), _has(text, RU.CONDITION)
    one = F.get(limits, F.lit(0))
    cues, separated = F.regexp_count(text, F.lit(RU.NORMATIVE_CUE)), _has(text, r"[；;]\s*")
    numeric = ~condition & (F.size(limits) == 1)
    modality = F.when(condition, "CONDITIONAL").when(numeric, "NUMERIC_LIMIT").otherwise("UNSUPPORTED")
    proven = numeric | (~condition & (F.size(limits) == 0) & (cues == 1) & ~separated)
    return F.struct(
        modality.alias("modality"), F.when(proven, "PROVEN").otherwise("UNRESOLVED").alias("atomicity"),
        F.when(numeric, one["operator"]).alias("operator"), F.when(numeric, one["value"]).alias("value"), F.when(numeric, one["unit"]).alias("unit"),
    )


def unresolved_reason(text: Column, numeric_token: str = r"\d") -> Column:
    """Why a span is no proven requirement; null where nothing forces it."""
    cues = F.regexp_count(text, F.lit(RU.NORMATIVE_CUE))
    return (
        F.when(_has(text, RU.CONDITION), "CONDITIONAL_UNSUPPORTED").when(_has(text, RU.EXCEPTION), "EXCEPTION_SCOPE_UNRESOLVED").when(cues > 1, "COMPOUND_STRUCTURE_UNRESOLVED")
        .when(requirement(text)["atomicity"] == "PROVEN", None).when(_has(text, numeric_token), "UNSUPPORTED_NUMERIC_FORM").when(cues == 1, "QUALITATIVE_UNSUPPORTED").otherwise("AMBIGUOUS_SPLIT")
    )


def decomposition_status(n_proven: Column, n_unresolved: Column, qualified: Column) -> Column:
    return F.when(~qualified, "SOURCE_NOT_QUALIFIED").when(n_proven == 0, "UNRESOLVED").when(n_unresolved > 0, "PARTIAL").otherwise("DECOMPOSED")


def plan_fact(text: Column, pattern: str = rf"(?i)({RU.NUMBER})\s*({RU.UNIT})") -> Column:
    """struct(parsing_status, value, unit): one number with a unit is PROVEN, several AMBIGUOUS, none UNSUPPORTED."""
    values, units = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    n = F.size(values)
    return F.struct(
        F.when(n == 1, "PROVEN").when(n > 1, "AMBIGUOUS").otherwise("UNSUPPORTED").alias("parsing_status"),
        F.when(n == 1, F.get(values, F.lit(0)).cast("decimal(38,18)")).alias("value"), F.when(n == 1, F.get(units, F.lit(0))).alias("unit"),
    )


def clause_reject(text: Column, same_object: Column) -> Column:
    """The first reason why a clause states no usable fact, or null."""
    out = F.when(~_has(text, rf"{RU.NUMBER}\s*{RU.UNIT}"), "NO_NUMERIC_FACT")
    for reason, pattern in RU.CLAUSE_REJECTS:
        out = out.when(_has(text, pattern), reason)
    return out.when(~same_object, "OBJECT_MISMATCH").when(assertion(text).isNull(), "ASSERTION_UNSUPPORTED")


def assertion(text: Column, ordered: Sequence[tuple[str, str]] = RU.ASSERTIONS) -> Column:
    """The first assertion kind whose pattern a text has."""
    out = None
    for kind, pattern in ordered:
        out = F.when(_has(text, pattern), kind) if out is None else out.when(_has(text, pattern), kind)
    return out


def compatible(operator: Column, kind: Column) -> Column:
    """Exact and design values fit >=, <= and =, a lower bound fits >=, an upper bound <=."""
    return F.when(kind.isin("EXACT_VALUE", "DESIGN_CONTROL"), operator.isin(">=", "<=", "=")).when(kind == "LOWER_BOUND_CONTROL", operator == ">=").when(kind == "UPPER_BOUND_CONTROL", operator == "<=").otherwise(False)


def shared_anchors(a: Column, b: Column, anchors: Sequence[str]) -> Column:
    """The anchors that both texts hold."""
    return F.filter(F.array(*map(F.lit, anchors)), lambda x: F.contains(a, x) & F.contains(b, x))


def extraction_status(n_facts: Column, n_ambiguous: Column, first_unsafe: Column) -> Column:
    return F.when(n_facts == 1, "EXTRACTED").when((n_facts > 1) | (n_ambiguous > 0), "AMBIGUOUS").when(first_unsafe.isNotNull(), "UNSUPPORTED").otherwise("NOT_FOUND")


def satisfies(actual: Column, operator: Column, limit: Column) -> Column:
    return F.when(operator == "<", actual < limit).when(operator == "<=", actual <= limit).when(operator == ">", actual > limit).when(operator == ">=", actual >= limit).when(operator == "=", actual == limit)


def comparison(m: Mapping[str, Column]) -> Column:
    """struct(decision, reason) by a ladder that fails closed.

    ``m``: atomicity, modality, operator, limit, limit_unit; n_facts, n_proven,
    actual and unit of the facts.
    """
    met = satisfies(m["actual"], m["operator"], m["limit"])
    reason = (
        F.when((m["atomicity"] != "PROVEN") & (m["modality"] == "CONDITIONAL"), "CONDITION_UNRESOLVED").when(m["atomicity"] != "PROVEN", "REQUIREMENT_DECOMPOSITION_UNRESOLVED")
        .when(m["modality"] != "NUMERIC_LIMIT", "UNSUPPORTED_REQUIREMENT_CLASS").when(m["n_facts"] == 0, "PLAN_FACT_MISSING")
        .when((m["n_facts"] != 1) | (m["n_proven"] != 1), "PLAN_FACT_AMBIGUOUS").when(~F.lower(F.trim(m["limit_unit"])).eqNullSafe(F.lower(F.trim(m["unit"]))), "UNSUPPORTED_UNIT")
        .when(met, "NUMERIC_LIMIT_SATISFIED").otherwise("NUMERIC_LIMIT_VIOLATED")
    )
    decision = F.when(reason == "NUMERIC_LIMIT_SATISFIED", "COMPLIANT").when(reason == "NUMERIC_LIMIT_VIOLATED", "NON_COMPLIANT").otherwise("INSUFFICIENT_INFORMATION")
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def terminal_state(route_: Column, retrieval: Column, decomposition: Column) -> Column:
    """Where the review of a candidate ends."""
    return (
        F.when(route_ != "ROUTED", route_).when(retrieval != "ACCEPT", "EVIDENCE_NOT_QUALIFIED").when(decomposition == "SOURCE_NOT_QUALIFIED", "REQUIREMENT_SOURCE_NOT_QUALIFIED")
        .when(decomposition == "UNRESOLVED", "REQUIREMENT_UNRESOLVED").otherwise("REQUIREMENTS_PROCESSED")
    )


def conditional_counts(rows: DataFrame, column: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """total and one count for each value, as columns."""
    counts = [F.count_if(F.col(column) == v).alias(v.lower()) for v in values]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)


def workspace(findings: DataFrame, gaps: DataFrame, errors: DataFrame, order: Sequence[str]) -> DataFrame:
    """Items of three kinds as one table with item_kind and position by a total order."""
    kinds = [df.withColumn("item_kind", F.lit(kind)) for df, kind in ((findings, "FINDING"), (gaps, "REVIEW_GAP"), (errors, "INTERNAL_ERROR"))]
    every = kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)
    doc = order[0]
    rest = [F.asc_nulls_last(c) for c in (*order[1:], "item_kind")]
    return every.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(*rest)).cast("long"))


def apply_commands(items: DataFrame, commands: DataFrame, key: str) -> DataFrame:
    """items with action and inclusion of their command, and review_state: UNREVIEWED, REVIEWED or CONFLICT.

    Equal commands collapse; different commands for one item conflict.
    """
    distinct = commands.select(key, "action", "inclusion").distinct()
    told = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("action").alias("action"), F.min("inclusion").alias("inclusion"))
    out = items.join(told, key, "left")
    clear = F.col("n") == 1
    state = F.when(F.col("n").isNull(), "UNREVIEWED").when(clear, "REVIEWED").otherwise("CONFLICT")
    return out.select(*items.columns, F.when(clear, F.col("action")).alias("action"), F.when(clear, F.col("inclusion")).otherwise("UNDECIDED").alias("inclusion"), state.alias("review_state"))


def stale_commands(items: DataFrame, commands: DataFrame, key: str) -> DataFrame:
    """Commands whose item is gone."""
    return commands.join(items.select(key), key, "left_anti")


def inclusion_basis(inclusion: Column, action: Column) -> Column:
    """Why an item stands in the report; EXCLUDED items go to the list of exclusions."""
    return F.when(inclusion == "EXCLUDE", "EXCLUDED").when(inclusion == "INCLUDE", "REVIEWER_INCLUDED").when(action.isNotNull(), "REVIEWED_UNDECIDED").otherwise("DEFAULT_UNREVIEWED")


def contract_violations(rows: DataFrame, predicates: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """keys and violated (names of the predicates that do not hold) of the rows that break a contract."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in predicates.items())))
    return rows.select(*keys, broken.alias("violated")).where(F.size("violated") > 0)


def atoms(text: Column) -> Column:
    """Requirement spans: cut before numbered items and after full stops and semicolons, trimmed, without empty ones."""
    marked = F.regexp_replace(F.regexp_replace(text, RU.NUMBERED_ITEM, "\u0001$0"), "([。；;])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: T.strip(x)), lambda x: x != "")
