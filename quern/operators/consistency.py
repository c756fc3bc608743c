"""Internal consistency: numeric facts by object, parameter, unit and assertion, and groups with more than one value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules as RU
from quern.functions import text as T
from quern.operators.review import assertion


def _anchor_at(lead: Column, anchors: Sequence[str]) -> Column:
    """struct(first, last) of the last chain of anchors, in order, in a text; null without one. Offsets from 0."""
    head, end, held = lead, None, F.lit(True)
    for anchor in reversed(anchors):
        held = held & F.contains(head, F.lit(anchor))
        at = F.length(head) - F.length(F.substring_index(head, anchor, -1)) - len(anchor)
        end = at + len(anchor) if end is None else end
        head = F.left(head, at)
    return F.when(held, F.struct(F.length(head).alias("first"), end.alias("last")))


def _profile(lead: Column, profiles: Sequence[tuple[str, tuple[str, ...]]]) -> Column:
    """Array of (name, first) of the profiles whose anchors end at most GAP_MOST before the text's end."""
    found = []
    for name, anchors in profiles:
        at = _anchor_at(lead, anchors)
        found.append(F.when(F.length(lead) - at["last"] <= RU.GAP_MOST, F.struct(F.lit(name).alias("name"), at["first"].alias("first"))))
    return F.array_compact(F.array(*found))


def facts(clauses: DataFrame, text: str) -> DataFrame:
    """clauses with object, parameter, value, unit, assertion and reason: a fact, an unresolved clause (reason) or neither (all null).

    The rules come in order: no number or no anchor is nothing; a range, a
    product or more than one number lacks context; then parameter, object, unit
    and assertion must each be exactly one.
    """
    view = F.regexp_replace(T.nfkc(F.col(text)), r"(?U)\s+", "")
    rows = clauses.withColumn("__v", view)
    v = F.col("__v")
    rows = rows.withColumn("__bare", F.regexp_count("__v", F.lit(RU.CONSISTENCY_NUMBER))).withColumn("__units", F.regexp_count("__v", F.lit(RU.CONSISTENCY_UNIT)))
    first = F.when(F.col("__units") > 0, F.length(F.get(F.split(v, RU.CONSISTENCY_UNIT, 2), F.lit(0)))).otherwise(F.length(F.get(F.split(v, RU.CONSISTENCY_NUMBER, 2), F.lit(0))))
    rows = rows.withColumn("__lead", F.left("__v", F.when(F.col("__bare") > 0, first)))
    rows = rows.withColumn("__p", _profile(F.col("__lead"), RU.PARAMETERS))
    rows = rows.withColumn("__one", F.get("__p", F.lit(0))).withColumn("__o", _profile(F.left("__v", F.col("__one.first")), RU.OBJECTS))
    holds = lambda profiles: F.lit(False) if not profiles else _any([_all_in(v, anchors) for _, anchors in profiles])
    anchored = holds(RU.OBJECTS) | holds(RU.PARAMETERS)
    object_before = _any([_anchor_at(F.col("__lead"), anchors).isNotNull() for _, anchors in RU.OBJECTS])
    kind = assertion(v, RU.CONSISTENCY_ASSERTIONS)
    ranged = F.regexp_like("__v", F.lit(rf"{RU.NUMBER}\s*(?:[-~～至到])\s*{RU.NUMBER}")) | F.regexp_like("__v", F.lit(rf"{RU.NUMBER}\s*[×xX*]\s*{RU.NUMBER}"))
    reason = (
        F.when((F.col("__bare") == 0) | ~anchored, "NOTHING").when(ranged, "INSUFFICIENT_CONTEXT").when((F.col("__units") > 1) | ((F.col("__units") == 0) & (F.col("__bare") != 1)), "INSUFFICIENT_CONTEXT")
        .when(F.size("__p") != 1, F.when(object_before | (F.size("__p") > 0), "PARAMETER_IDENTITY_UNRESOLVED").otherwise("NOTHING"))
        .when(F.size("__o") != 1, "OBJECT_IDENTITY_UNRESOLVED").when(F.col("__units") == 0, "MISSING_UNIT").when(kind.isNull(), "INSUFFICIENT_CONTEXT").otherwise("FACT")
    )
    rows = rows.withColumn("__r", reason)
    fact = F.col("__r") == "FACT"
    return rows.select(
        *clauses.columns, F.when(fact, F.get("__o", F.lit(0))["name"]).alias("object"), F.when(fact, F.col("__one.name")).alias("parameter"),
        F.when(fact, F.regexp_extract("__v", RU.CONSISTENCY_UNIT, 1).cast("decimal(38,18)")).alias("value"), F.when(fact, F.lower(F.regexp_extract("__v", RU.CONSISTENCY_UNIT, 2))).alias("unit"),
        F.when(fact, kind).alias("assertion"), F.when(~F.col("__r").isin("FACT", "NOTHING"), F.col("__r")).alias("reason"),
    )


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _all_in(view: Column, anchors: Sequence[str]) -> Column:
    out = F.lit(True)
    for a in anchors:
        out = out & F.contains(view, F.lit(a))
    return out


def groups(rows: DataFrame, keys: Sequence[str], value: str, fact: str) -> DataFrame:
    """keys, n_values, n_facts and the values with their first fact: groups whose facts state more than one value.

    Two aggregations: values within groups are pre-aggregated, so one hot value
    is one row before the second shuffle.
    """
    by_value = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(fact).alias("first_fact"))
    out = by_value.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_facts"), F.min(value).alias("low"), F.max(value).alias("high"), F.min("first_fact").alias("first_fact"))
    return out.where("n_values > 1")


def value_groups(rows: DataFrame, keys: Sequence[str], value: str, fact: str) -> DataFrame:
    """keys, value, n and first_fact of the conflicting groups, one row a value."""
    by_value = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(fact).alias("first_fact"))
    several = by_value.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1").select(*keys)
    return by_value.join(several, list(keys))


def mismatches(rows: DataFrame, doc: str, profile: str, assertion_: str, unit: str) -> DataFrame:
    """doc, profiles_with_assertions and assertions_with_units: profiles stated with more than one assertion, and (profile, assertion) with more than one unit."""
    fine = rows.select(doc, profile, assertion_, unit).distinct()
    pairs = fine.groupBy(doc, profile, assertion_).agg(F.count(F.lit(1)).alias("units"))
    per = pairs.groupBy(doc, profile).agg(F.count(F.lit(1)).alias("assertions"), F.count_if(F.col("units") > 1).alias("mixed"))
    return per.groupBy(doc).agg(F.count_if(F.col("assertions") > 1).alias("profiles_with_assertions"), F.sum("mixed").alias("assertions_with_units"))
