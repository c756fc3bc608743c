"""Queries on candidates, routing, requirements, comparison and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import rules as RU
from quern.functions import spans as SP
from quern.operators import review as V
from quern.operators import structure as S
from quern.plans.common import query, table

E = RU.ENGLISH


def _sql_classes(t: str) -> str:
    """candidate_class of a text as DuckDB SQL, from the same rules."""
    has = lambda n: f"regexp_matches({t}, '{getattr(E, n)}')"
    return (
        f"case when {has('number_with_unit')} and {has('numeric_control')} then 'NUMERIC_CONTROL' when {has('inspection')} and {has('context')} then 'INSPECTION_REQUIREMENT' "
        f"when {has('material')} and {has('obligation')} then 'MATERIAL_REQUIREMENT' when {has('safety')} and ({has('obligation')} or {has('procedure')}) then 'SAFETY_REQUIREMENT' "
        f"when {has('structural')} and {has('obligation')} then 'STRUCTURAL_CONFIGURATION' when {has('procedure')} and {has('obligation')} then 'PROCEDURAL_REQUIREMENT' "
        f"when {has('obligation')} and {has('context')} then 'CONSTRUCTION_REQUIREMENT' else 'UNRESOLVED' end"
    )


def _sql_worthy(t: str) -> str:
    has = lambda n: f"regexp_matches({t}, '{getattr(E, n)}')"
    return f"(({has('number_with_unit')} and {has('numeric_control')}) or ({has('inspection')} and {has('context')}) or ({has('obligation')} and length(regexp_replace({t}, '\\s+', '', 'g')) >= 4) or (({has('safety')} or {has('procedure')}) and {has('context')}))"


#: Sentences with offsets: pieces and gaps of one grammar, running sums of their lengths.
SQL_SPANS = r"""
m as (select doc_id, regexp_extract_all(text, '[^.\n]+[.]?') as spans, string_split_regex(text, '[^.\n]+[.]?') as gaps from documents),
x as (select doc_id, generate_subscripts(spans, 1) - 1 as span_index, unnest(spans) as span, unnest(gaps[1:len(spans)]) as gap from m),
s as (select doc_id, span_index, span, cast(sum(length(gap) + length(span)) over (partition by doc_id order by span_index rows unbounded preceding) as bigint) as "end" from x)"""


@query(f"""
with {SQL_SPANS},
c as (select doc_id, "end" - length(span) as start, "end", span, {_sql_classes("span")} as candidate_class,
       list_filter([case when regexp_matches(span, 'The|Der') then 'articles' end, case when regexp_matches(span, 'And|Und') then 'links' end, case when regexp_matches(span, 'In|Im') then 'places' end], lambda t: t is not null) as topics from s where {_sql_worthy("span")})
select doc_id, start, "end", candidate_class, case when len(topics) = 1 then topics[1] else 'general' end as topic,
  least(45 + case when regexp_matches(span, '{E.number_with_unit}') and regexp_matches(span, '{E.numeric_control}') then 35 else 0 end + case when regexp_matches(span, '{E.obligation}') then 10 else 0 end
    + case when regexp_matches(span, '{E.context}') then 5 else 0 end + case when candidate_class <> 'UNRESOLVED' then 10 else 0 end, case when candidate_class = 'UNRESOLVED' then 55 else 95 end) / 100 as confidence,
  case when candidate_class = 'UNRESOLVED' then 'UNRESOLVED' else 'DISCOVERED' end as status from c""")
def candidate_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences worth a review with class, topic and confidence."""
    spans = S.exploded_spans(table(spark, sf_dir, "documents"), ["doc_id"], "text", r"[^.\n]+[.]?")
    return V.discover(spans, "span", E).select("doc_id", "start", "end", "candidate_class", "topic", "confidence", "status")


@query(f"""
with c as (select doc_id, {_sql_classes("text")} as candidate_class, text from documents),
h as (select doc_id, candidate_class, list_filter([case when regexp_matches(text, 'tion') then 'S1' end, case when regexp_matches(text, 'keit|heit') and candidate_class in ('NUMERIC_CONTROL', 'INSPECTION_REQUIREMENT', 'MATERIAL_REQUIREMENT', 'SAFETY_REQUIREMENT') then 'S2' end,
   case when regexp_matches(text, 'ment') then 'S3' end], lambda x: x is not null and x in ('S1', 'S2')) as codes from c)
select doc_id, candidate_class, array_to_string(codes, ',') as codes, case when len(codes) = 1 then 'ROUTED' when len(codes) > 1 then 'AMBIGUOUS_SCOPE' else 'NO_SCOPE' end as route from h""")
def domain_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain rules that match and are installed decide the route."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", V.candidate_class(F.col("text"), E).alias("candidate_class"))
    available = spark.range(2).select(F.concat(F.lit("S"), (F.col("id") + 1).cast("string")).alias("code"))
    return V.route(docs, "text", available, E).select("doc_id", "candidate_class", F.array_join("codes", ",").alias("codes"), "route")


@query(r"""
with a as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.;])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) as atom from documents),
r as (select doc_id, len(regexp_extract_all(atom, '[Tt]he|[Dd]er')) as cues, regexp_matches(atom, '(?:^|, )(?:In|If|Im)') as conditional, regexp_matches(atom, '[0-9]') as numeric from a),
k as (select doc_id, case when conditional then 'CONDITIONAL_UNSUPPORTED' when cues > 1 then 'COMPOUND_STRUCTURE_UNRESOLVED' when cues = 1 and not numeric then 'PROVEN' when numeric then 'UNSUPPORTED_NUMERIC_FORM' else 'AMBIGUOUS_SPLIT' end as reason from r),
g as (select doc_id, count(*) as atoms, count(*) filter (reason = 'PROVEN') as proven from k group by 1)
select doc_id, atoms, proven, case when proven = 0 then 'UNRESOLVED' when proven < atoms then 'PARTIAL' else 'DECOMPOSED' end as status from g""")
def requirement_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R03 with ASCII cues: how many spans of a text are requirements; requirement_decomposition runs the rules."""
    from quern.functions import text as T

    parts = F.filter(F.transform(F.split(F.regexp_replace("text", "([.;])", "$1\u0001"), "\u0001"), lambda x: T.strip(x)), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(parts).alias("atom"))
    cues = F.regexp_count("atom", F.lit("[Tt]he|[Dd]er"))
    conditional, numeric = F.regexp_like("atom", F.lit("(?:^|, )(?:In|If|Im)")), F.regexp_like("atom", F.lit("[0-9]"))
    reason = F.when(conditional, "CONDITIONAL_UNSUPPORTED").when(cues > 1, "COMPOUND_STRUCTURE_UNRESOLVED").when((cues == 1) & ~numeric, "PROVEN").when(numeric, "UNSUPPORTED_NUMERIC_FORM").otherwise("AMBIGUOUS_SPLIT")
    counts = rows.select("doc_id", reason.alias("reason")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("atoms"), F.count_if(F.col("reason") == "PROVEN").alias("proven"))
    return counts.withColumn("status", V.decomposition_status(F.col("proven"), F.col("atoms") - F.col("proven"), F.lit(True)))


@query(r"""
with f as (select event_id, regexp_extract_all(props, '[0-9]+') as v from events)
select event_id, case when len(v) = 1 then 'PROVEN' when len(v) > 1 then 'AMBIGUOUS' else 'UNSUPPORTED' end as parsing_status, case when len(v) = 1 then cast(v[1] as bigint) end as value from f""")
def plan_fact_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """none, one or many numbers in a text; plan_fact_extraction runs the reject chain."""
    fact = V.plan_fact(F.col("props"), "([0-9]+)()")
    return table(spark, sf_dir, "events").select("event_id", fact.alias("f")).select("event_id", "f.parsing_status", F.col("f.value").cast("long").alias("value"))


SQL_LIMITS = "(values ('A', '<=', 30.0, 'UNIT'), ('N', '>', 5.0, 'unit '), ('R', '=', 17.0, 'unit')) l(flag, operator, lim, unit)"


@query(f"""
with r as (select l_orderkey, l_linenumber, l_quantity, operator, lim,
  case l_linenumber % 5 when 0 then 'UNRESOLVED' else 'PROVEN' end as atomicity, case when l_partkey % 11 = 0 then 'CONDITIONAL' when l_partkey % 13 = 0 then 'UNSUPPORTED' else 'NUMERIC_LIMIT' end as modality,
  l_suppkey % 3 as n_facts, case when l_tax > 0.07 then 'box' else ' unit' end as fact_unit, l.unit from lineitem join {SQL_LIMITS} on l_returnflag = flag)
select l_orderkey, l_linenumber, l_quantity, reason, case reason when 'NUMERIC_LIMIT_SATISFIED' then 'COMPLIANT' when 'NUMERIC_LIMIT_VIOLATED' then 'NON_COMPLIANT' else 'INSUFFICIENT_INFORMATION' end as decision
from (select *, case when atomicity <> 'PROVEN' and modality = 'CONDITIONAL' then 'CONDITION_UNRESOLVED' when atomicity <> 'PROVEN' then 'REQUIREMENT_DECOMPOSITION_UNRESOLVED' when modality <> 'NUMERIC_LIMIT' then 'UNSUPPORTED_REQUIREMENT_CLASS'
  when n_facts = 0 then 'PLAN_FACT_MISSING' when n_facts <> 1 then 'PLAN_FACT_AMBIGUOUS' when lower(trim(unit)) <> lower(trim(fact_unit)) then 'UNSUPPORTED_UNIT'
  when (operator = '<=' and l_quantity <= lim) or (operator = '>' and l_quantity > lim) or (operator = '=' and l_quantity = lim) then 'NUMERIC_LIMIT_SATISFIED' else 'NUMERIC_LIMIT_VIOLATED' end as reason from r)""")
def numeric_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison ladder over line items and limits."""
    limits = spark.createDataFrame([("A", "<=", 30.0, "UNIT"), ("N", ">", 5.0, "unit "), ("R", "=", 17.0, "unit")], "l_returnflag string, operator string, lim double, unit string")
    rows = table(spark, sf_dir, "lineitem").join(limits, "l_returnflag")
    m = {
        "atomicity": F.when(F.col("l_linenumber") % 5 == 0, "UNRESOLVED").otherwise("PROVEN"),
        "modality": F.when(F.col("l_partkey") % 11 == 0, "CONDITIONAL").when(F.col("l_partkey") % 13 == 0, "UNSUPPORTED").otherwise("NUMERIC_LIMIT"),
        "operator": F.col("operator"), "limit": F.col("lim"), "limit_unit": F.col("unit"), "n_facts": F.col("l_suppkey") % 3, "n_proven": F.col("l_suppkey") % 3,
        "actual": F.col("l_quantity"), "unit": F.when(F.col("l_tax") > 0.07, "box").otherwise(" unit"),
    }
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", V.comparison(m).alias("c")).select("l_orderkey", "l_linenumber", "l_quantity", "c.reason", "c.decision")


SQL_STATES = """
t as (select o_orderkey, o_custkey, case when route <> 'ROUTED' then route when retrieval <> 'ACCEPT' then 'EVIDENCE_NOT_QUALIFIED' when d = 'SOURCE_NOT_QUALIFIED' then 'REQUIREMENT_SOURCE_NOT_QUALIFIED' when d = 'UNRESOLVED' then 'REQUIREMENT_UNRESOLVED' else 'REQUIREMENTS_PROCESSED' end as state
from (select o_orderkey, o_custkey, case o_orderkey % 6 when 0 then 'NO_SCOPE' when 1 then 'AMBIGUOUS_SCOPE' else 'ROUTED' end as route, case o_orderstatus when 'F' then 'ACCEPT' when 'O' then 'ACCEPT' else 'NO_MATCH' end as retrieval,
  case substr(o_orderpriority, 1, 1) when '1' then 'SOURCE_NOT_QUALIFIED' when '2' then 'UNRESOLVED' else 'DECOMPOSED' end as d from orders))"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    route = F.when(F.col("o_orderkey") % 6 == 0, "NO_SCOPE").when(F.col("o_orderkey") % 6 == 1, "AMBIGUOUS_SCOPE").otherwise("ROUTED")
    retrieval = F.when(F.col("o_orderstatus").isin("F", "O"), "ACCEPT").otherwise("NO_MATCH")
    decomposed = F.when(first == "1", "SOURCE_NOT_QUALIFIED").when(first == "2", "UNRESOLVED").otherwise("DECOMPOSED")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", V.terminal_state(route, retrieval, decomposed).alias("state"))


@query(f"with {SQL_STATES} select * from t")
def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each candidate's review ends; plan_findings builds findings."""
    return _states(spark, sf_dir)


@query(f"""with {SQL_STATES} select count(*) as total, count(*) filter (state = 'NO_SCOPE') as no_scope, count(*) filter (state = 'AMBIGUOUS_SCOPE') as ambiguous_scope, count(*) filter (state = 'EVIDENCE_NOT_QUALIFIED') as evidence_not_qualified,
count(*) filter (state = 'REQUIREMENT_SOURCE_NOT_QUALIFIED') as requirement_source_not_qualified, count(*) filter (state = 'REQUIREMENT_UNRESOLVED') as requirement_unresolved, count(*) filter (state = 'REQUIREMENTS_PROCESSED') as requirements_processed from t""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts over the states in one aggregation."""
    names = ("NO_SCOPE", "AMBIGUOUS_SCOPE", "EVIDENCE_NOT_QUALIFIED", "REQUIREMENT_SOURCE_NOT_QUALIFIED", "REQUIREMENT_UNRESOLVED", "REQUIREMENTS_PROCESSED")
    return V.conditional_counts(_states(spark, sf_dir), "state", names)


@query("""
with f as (select o_custkey as doc, o_orderkey as item, 'FINDING' as item_kind, o_totalprice as amount, null as note from orders where o_orderstatus = 'F'),
g as (select o_custkey, o_orderkey, 'REVIEW_GAP', null, o_orderpriority from orders where o_orderstatus = 'O'),
e as (select o_custkey, o_orderkey, 'INTERNAL_ERROR', null, null from orders where o_orderstatus = 'P'), u as (select * from f union all select * from g union all select * from e)
select *, row_number() over (partition by doc order by item, item_kind) as position from u""")
def workspace_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of three kinds in one total order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("item"), "o_orderstatus", F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("note"))
    part = lambda s, *c: orders.where(F.col("o_orderstatus") == s).select("doc", "item", *c)
    return V.workspace(part("F", "amount"), part("O", "note"), part("P"), ["doc", "item"]).select("doc", "item", "item_kind", "amount", "note", "position")


SQL_COMMANDS = """
k as (select l_orderkey as item, case when l_returnflag = 'R' then 'REJECT' else 'CONFIRM' end as action, case l_linestatus when 'O' then 'INCLUDE' else 'EXCLUDE' end as inclusion from lineitem where l_linenumber = 1 or l_partkey % 50 = 0),
d as (select item, count(*) as n, min(action) as action, min(inclusion) as inclusion from (select distinct * from k) group by 1),
r as (select o_orderkey as item, case when n = 1 then action end as action, case when n = 1 then inclusion else 'UNDECIDED' end as inclusion, case when n is null then 'UNREVIEWED' when n = 1 then 'REVIEWED' else 'CONFLICT' end as review_state from orders left join d on o_orderkey = item)"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 or l_partkey % 50 = 0")
    commands = lines.select(F.col("l_orderkey").alias("item"), F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("CONFIRM").alias("action"), F.when(F.col("l_linestatus") == "O", "INCLUDE").otherwise("EXCLUDE").alias("inclusion"))
    return V.apply_commands(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")), commands, "item")


@query(f"with {SQL_COMMANDS} select * from r")
def command_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review commands on items; equal ones collapse, different ones conflict."""
    return _reviewed(spark, sf_dir)


@query(f"with {SQL_COMMANDS} select case when inclusion = 'EXCLUDE' then 'EXCLUDED' when inclusion = 'INCLUDE' then 'REVIEWER_INCLUDED' when action is not null then 'REVIEWED_UNDECIDED' else 'DEFAULT_UNREVIEWED' end as basis, review_state, count(*) as n from r group by 1, 2")
def report_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why items stand in the report."""
    return _reviewed(spark, sf_dir).groupBy(V.inclusion_basis(F.col("inclusion"), F.col("action")).alias("basis"), "review_state").agg(F.count(F.lit(1)).alias("n"))


@query("""
select s_suppkey, list_sort(list_filter([case when not s_acctbal > 0 then 'positive_balance' end, case when not s_nationkey between 0 and 20 then 'known_nation' end, case when not length(s_name) > 5 then 'named' end], lambda x: x is not null)) as violated
from supplier where not (s_acctbal > 0 and s_nationkey between 0 and 20 and length(s_name) > 5)""")
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J29, contract validation: rows that break a contract and the predicates they break."""
    rules = {"positive_balance": F.col("s_acctbal") > 0, "known_nation": F.col("s_nationkey").between(0, 20), "named": F.length("s_name") > 5}
    return V.contract_violations(table(spark, sf_dir, "supplier"), rules, ["s_suppkey"]).withColumn("violated", F.array_sort("violated"))


@query(r"""
with m as (select doc_id, text, list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0), lambda x: x) as ls from documents)
select doc_id, len(regexp_extract_all(text, '[^.!?;\n\r]+[.!?;]?')) as sentences, list_max(list_transform(regexp_extract_all(text, '[^.!?;\n\r]+[.!?;]?'), lambda x: length(x))) as longest from m""")
def clause_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence spans of each document, counted and measured."""
    found = SP.pattern_spans(F.col("text"), r"[^.!?;\n\r]+[.!?;]?")
    longest = F.array_max(F.transform(found, lambda s: s["end"] - s["start"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("sentences"), longest.cast("long").alias("longest"))
