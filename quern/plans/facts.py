"""Queries on joins, facts, merges, consistency, completeness, quality and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import rules as RU
from quern.functions import text as T
from quern.operators import completeness as CP
from quern.operators import consistency as CO
from quern.operators import joins as J
from quern.operators import merge as M
from quern.operators import quality as QU
from quern.operators import retrieval as R
from quern.plans.common import query, table


def _micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


@query("""
select a.event_id, b.event_id as signal_id, cast(abs(epoch_us(a.ts) - epoch_us(b.ts)) as bigint) as gap_us
from events a join events b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'click' and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000""")
def proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with clicks of the user within an hour, by time buckets."""
    events = table(spark, sf_dir, "events")
    at = _micros("ts")
    a = events.where("event_type = 'purchase'").select("user_id", "event_id", at.alias("at_a"))
    b = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("signal_id"), at.alias("at_b"))
    pairs = J.band_join(a, b, ["user_id"], F.col("at_a"), F.col("at_b"), 3_600_000_000)
    return pairs.select("event_id", "signal_id", F.abs(F.col("at_a") - F.col("at_b")).alias("gap_us"))


@query("""
select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (w rows unbounded preceding) as owner,
  first_value(case when event_type = 'signup' then event_id end ignore nulls) over (w rows between 1 following and unbounded following) as until from events window w as (partition by user_id order by ts, event_id)""")
def asof_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker that owns each row and the one that ends it."""
    mark = F.when(F.col("event_type") == "signup", F.col("event_id"))
    order = ["ts", "event_id"]
    return table(spark, sf_dir, "events").select("event_id", J.asof_backward("user_id", order, mark).alias("owner"), J.asof_forward("user_id", order, mark).alias("until"))


@query("""
select o_orderkey, l_linenumber, l_suppkey from orders join lineitem on o_orderkey = l_orderkey and epoch_us(l_shipdate) between epoch_us(o_orderdate) and epoch_us(o_orderdate) + 30 * 86400000000""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within thirty days from the order, by buckets of ten days."""
    day = 86_400_000_000
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", _micros("l_shipdate").alias("at"))
    spans = table(spark, sf_dir, "orders").select("o_orderkey", _micros("o_orderdate").alias("begin"))
    return J.interval_join(points, spans, ["o_orderkey"], F.col("at"), F.col("begin"), F.col("begin") + 30 * day, 10 * day).select("o_orderkey", "l_linenumber", "l_suppkey")


@query("""
with e as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
p as (select a.event_id, floor(b.value) - 3 * abs(a.rn - b.rn) as score, -abs(a.rn - b.rn) as near, a.rn - b.rn as back, b.event_id as best from e a join e b on a.user_id = b.user_id and a.rn <> b.rn and abs(a.rn - b.rn) <= 3)
select e.event_id, p.best, p.score from e left join (select * from p qualify row_number() over (partition by event_id order by score desc, near desc, back desc) = 1) p using (event_id)""")
def band_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best neighbour within three rows, by value less distance."""
    rows = table(spark, sf_dir, "events").withColumn("score", F.floor("value").cast("double")).withColumn("id", F.col("event_id"))
    best = J.neighbour_best("user_id", ["ts", "event_id"], 3, "score", "id")
    return rows.select("event_id", best.alias("b")).select("event_id", F.col("b.value").alias("best"), F.col("b.score").cast("double").alias("score"))


@query("""
with e as (select *, case when value > 50 then event_type end as name from events)
select event_id, coalesce(name, lag(name) over w, lead(name) over w) as name from e window w as (partition by user_id order by ts, event_id)""")
def adjacent_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's own name, else that of the row before, else of the row after."""
    name = F.when(F.col("value") > 50, F.col("event_type"))
    rows = table(spark, sf_dir, "events").withColumn("own", name)
    return rows.select("event_id", J.adjacent("user_id", ["ts", "event_id"], F.col("own")).alias("name"))


@query(r"""
with i as (select distinct item_id, unnest(regexp_extract_all(text, '[^.\n]+')) as part from benchmark), d as (select distinct doc_id, unnest(regexp_extract_all(text, '[^.\n]+')) as part from documents),
s as (select item_id, doc_id, cast(sum(length(part)) as bigint) as score from i join d using (part) group by 1, 2)
select item_id, doc_id, score from s qualify row_number() over (partition by item_id order by score desc, doc_id) = 1""")
def locate_best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the document that holds most of it."""
    cut = lambda name, key: table(spark, sf_dir, name).select(key, F.explode(F.regexp_extract_all("text", F.lit(r"[^.\n]+"), F.lit(0))).alias("part")).distinct()
    return J.best_match(cut("benchmark", "item_id"), cut("documents", "doc_id"), "item_id", "doc_id")


@query("""
select s_suppkey, n_name, case when n_name is null then 'UNKNOWN' when s_nationkey % 5 = 0 then 'SUPERSEDED' else 'ACTIVE' end as status, s_nationkey % 5 = 0 as is_error from supplier left join nation on n_nationkey = s_nationkey + 3""")
def scope_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each scope id; superseded ones are errors, unknown ones warnings."""
    rows = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_nationkey") + 3).join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"), "left")
    old = F.col("s_nationkey") % 5 == 0
    return rows.select("s_suppkey", "n_name", F.when(F.col("n_name").isNull(), "UNKNOWN").when(old, "SUPERSEDED").otherwise("ACTIVE").alias("status"), old.alias("is_error"))


@query("""
with c as (select n_regionkey as k, count(distinct n_name) as n, min(n_name) as name from nation where n_nationkey % 3 = 0 or n_regionkey = 1 group by 1)
select r_regionkey, case when n = 1 then name end as n_name, case when n is null then 'UNKNOWN' when n = 1 then 'FOUND' else 'CONFLICT' end as lookup from region left join c on r_regionkey = k""")
def trusted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trusted dimension that tells conflicts."""
    trusted = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0 or n_regionkey = 1").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return J.lookup_status(table(spark, sf_dir, "region").select("r_regionkey"), trusted, "r_regionkey", ["n_name"])


SQL_FACTS = "f as (select event_id, user_id, event_type, cast(floor(value / 10) as bigint) as v from events)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("value") / 10).alias("v"))


@query(f"with {SQL_FACTS} select user_id, event_type, count(distinct v) as n_values, count(*) as n_facts, min(v) as low, max(v) as high, min(event_id) as first_fact from f group by 1, 2 having count(distinct v) > 1")
def consistency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose facts state more than one value."""
    return CO.groups(_facts(spark, sf_dir), ["user_id", "event_type"], "v", "event_id")


@query(f"with {SQL_FACTS}, g as (select user_id, event_type, v, count(*) as n, min(event_id) as first_fact from f group by 1, 2, 3) select * from g qualify count(*) over (partition by user_id, event_type) > 1")
def consistency_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of those groups."""
    return CO.value_groups(_facts(spark, sf_dir), ["user_id", "event_type"], "v", "event_id")


@query("""
with f as (select distinct user_id, event_type as profile, cast(floor(value / 20) as bigint) as assertion, event_id % 3 as unit from events),
p as (select user_id, profile, assertion, count(*) as units from f group by 1, 2, 3), q as (select user_id, profile, count(*) as assertions, count(*) filter (units > 1) as mixed from p group by 1, 2)
select user_id, count(*) filter (assertions > 1) as profiles_with_assertions, cast(sum(mixed) as bigint) as assertions_with_units from q group by 1""")
def consistency_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreement at two coarser grains, in one chain of aggregations."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("profile"), F.floor(F.col("value") / 20).alias("assertion"), (F.col("event_id") % 3).alias("unit"))
    return CO.mismatches(rows, "user_id", "profile", "assertion", "unit")


@query("select text, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return M.first_wins(table(spark, sf_dir, "documents").select("text", "doc_id", "source", F.col("doc_id").alias("seq")), ["text"], "seq").select("text", "doc_id", "source")


@query("""
select source, lang, arg_max(doc_id, row(n_chars, -doc_id)) as doc_id, max(n_chars) as n_chars, min(doc_id) as place from documents group by 1, 2""")
def argmax_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each source and language, at the place of the first."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars", F.col("doc_id").alias("seq"))
    return M.best_at_first_place(rows, ["source", "lang"], "seq", F.col("n_chars")).select("source", "lang", "doc_id", "n_chars", "place")


@query(r"""
with l as (select doc_id, source, lang, lower(regexp_replace(string_split(text, chr(10))[1], '[\s[:punct:]]+', '', 'g')) as key from documents)
select key, source, min(doc_id) as doc_id from l group by 1, 2""")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedupe by a normalised key, first place kept."""
    key = F.lower(F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), r"[\s\p{Punct}]+", ""))
    rows = table(spark, sf_dir, "documents").select(key.alias("key"), "source", "doc_id", F.col("doc_id").alias("seq"))
    return M.first_wins(rows, ["key", "source"], "seq").select("key", "source", "doc_id")


@query("""
with s as (select l_orderkey, l_shipdate as a, l_shipdate + interval 10 day as b, l_linestatus = 'F' as summary from lineitem)
select l_orderkey, coalesce(min(a) filter (summary), min(a)) as first, coalesce(max(b) filter (summary), max(b)) as last, bool_or(summary) as from_summary,
  case when bool_or(summary) then cast(date_diff('day', cast(coalesce(min(a) filter (summary), min(a)) as date), cast(coalesce(max(b) filter (summary), max(b)) as date)) as bigint) end as days from s group by 1""")
def schedule_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span of a schedule, summary rows first."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("a"), (F.col("l_shipdate") + F.expr("interval 10 days")).alias("b"), (F.col("l_linestatus") == "F").alias("summary"))
    return M.span_with_summary(rows, ["l_orderkey"], "a", "b", F.col("summary"))


@query(r"""
with l as (select source, doc_id, string_split(text, chr(10))[1] as title from documents),
c as (select source, title, bool_or(doc_id % 10 = 0) as cover, count(*) as votes, min(doc_id) as place from l group by 1, 2)
select source, title, cover, votes, place from c qualify row_number() over (partition by source order by cover desc, length(title) desc, votes desc, place) = 1""")
def title_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each source by cover, length and votes."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    return M.vote(rows, "source", "title", F.col("doc_id") % 10 == 0, "doc_id")


@query("select source, coalesce(bool_or(regexp_matches(text, 'License')), false) as license, coalesce(bool_or(regexp_matches(text, 'token')), false) as token, coalesce(bool_or(regexp_matches(text, 'zzzz')), false) as nothing from documents group by 1")
def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any text of a source has each pattern."""
    return M.presence(table(spark, sf_dir, "documents"), "source", "text", {"license": "License", "token": "token", "nothing": "zzzz"})


def _sql_checks() -> str:
    whens = " ".join(f"when check_id = '{c}' then case when {p} then 'PASS' when {q} then 'PARTIAL' else '{'MISSING' if need else 'NOT_APPLICABLE'}' end" for c, p, q, need in RU.CHECKS)
    return f"case {whens} end"


SQL_EVIDENCE = f"""
e as (select distinct source, 'CR-' || lpad(cast(1 + doc_id % 14 as varchar), 3, '0') as check_id, (['chapters', 'fields', 'items', 'components', 'broad', 'flag'])[1 + (doc_id // 14) % 6] as kind, lang as value from documents where n_chars > 2000),
c as (select source, check_id, count(*) filter (kind = 'chapters') as chapters, count(*) filter (kind = 'fields') as fields, count(*) filter (kind = 'items') as items, count(*) filter (kind = 'components') as components,
   count(*) filter (kind = 'broad') as broad, bool_or(kind = 'flag') as flag from e group by 1, 2),
a as (select source, 'CR-' || lpad(cast(n as varchar), 3, '0') as check_id from (select distinct source from documents), range(1, 15) r(n)),
k as (select source, check_id, coalesce(chapters, 0) as chapters, coalesce(fields, 0) as fields, coalesce(items, 0) as items, coalesce(components, 0) as components, coalesce(broad, 0) as broad, coalesce(flag, false) as flag from a left join c using (source, check_id)),
s as (select *, {_sql_checks()} as status from k)"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.get(F.array(*map(F.lit, (*CP.KINDS, "flag"))), (F.floor(F.col("doc_id") / 14) % 6).cast("int"))
    evidence = docs.where("n_chars > 2000").select("source", F.concat(F.lit("CR-"), F.lpad((1 + F.col("doc_id") % 14).cast("string"), 3, "0")).alias("check_id"), kind.alias("kind"), F.col("lang").alias("value"))
    return CP.checks(evidence, "source", docs.select("source").distinct())


@query(f"with {SQL_EVIDENCE} select source, check_id, chapters, fields, items, components, broad, flag, status from s")
def completeness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen checks by a rule table over evidence counts."""
    return _checks(spark, sf_dir).select("source", "check_id", *CP.KINDS, "flag", "status")


@query(f"""
with {SQL_EVIDENCE}, n as (select source, count(*) filter (status = 'PASS') as pass, count(*) filter (status = 'PARTIAL') as partial, count(*) filter (status = 'MISSING') as missing, count(*) filter (status = 'NOT_APPLICABLE') as not_applicable from s group by 1)
select *, cast(coalesce(floor(100 * (pass + 0.5 * partial) / nullif(pass + partial + missing, 0) + 0.5), 0) as bigint) as score from n""")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and the score."""
    return CP.score(_checks(spark, sf_dir), "source")


@query("""
with c as (select c_nationkey as k, c_custkey as seq, case when c_acctbal > 5000 then c_name end as name, case when c_mktsegment <> 'BUILDING' then c_mktsegment end as segment from customer)
select k, arg_min(name, seq) filter (name is not null) as name, arg_min(segment, seq) filter (segment is not null) as segment from c group by 1""")
def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first non-null of each field by order."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("seq"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return M.first_values(rows, ["k"], "seq", ["name", "segment"])


@query("""
select s_nationkey as k, s_name as name, 'supplier' as origin from supplier union all
select c_nationkey, c_name, 'customer' from customer where c_nationkey not in (select s_nationkey from supplier where s_nationkey is not null)""")
def append_if_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of one side, and what is new of the other."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("origin"))
    return M.append_new(a, b, ["k"])


SQL_BOXES = """
b as (select l_orderkey as page, l_linenumber as line_id, l_partkey % 50 as "left", l_suppkey % 40 as top, l_suppkey % 40 + 5 + l_quantity % 9 as bottom, 5 + l_quantity % 9 as height, 10 + l_partkey % 30 as width,
   case when l_partkey % 4 = 0 then cast(l_linenumber as varchar) else '1.2.' || (l_partkey % 30) || ' text' end as text, (l_suppkey % 100) / 100.0 as confidence, cast(l_partkey % 12 as double) as angle from lineitem),
t as (select *, coalesce(median(case when height > 0 then height end) over (partition by page), 1.0) as typical from b)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    number = F.when(c("l_partkey") % 4 == 0, c("l_linenumber").cast("string")).otherwise(F.concat(F.lit("1.2."), (c("l_partkey") % 30).cast("string"), F.lit(" text")))
    height = 5 + c("l_quantity") % 9
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("page"), c("l_linenumber").alias("line_id"), (c("l_partkey") % 50).alias("left"), (c("l_suppkey") % 40).alias("top"), (c("l_suppkey") % 40 + height).alias("bottom"),
        height.alias("height"), (10 + c("l_partkey") % 30).alias("width"), number.alias("text"), ((c("l_suppkey") % 100) / 100.0).alias("confidence"), (c("l_partkey") % 12).cast("double").alias("angle"),
    )


@query(f"""
with {SQL_BOXES}
select n.page, n.line_id, min(b.line_id) as body_id from t n join t b on n.page = b.page and n.line_id <> b.line_id and regexp_matches(n.text, '^[0-9]{{1,3}}$') and least(n.bottom, b.bottom) - greatest(n.top, b.top) > least(n.height, b.height) * 0.35
  and n."left" <= b."left" + n.typical * 1.5 and abs(b.angle) < 8 group by 1, 2""")
def qa_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number lines that overlap a body line."""
    return QU.detached_numbers(_boxes(spark, sf_dir), "page")


SQL_ISSUES = f"""{SQL_BOXES},
i as (select page, line_id, unnest(list_filter([case when confidence < 0.5 then 'CONFIDENCE_REJECTED' when confidence < 0.8 then 'CONFIDENCE_REVIEW_REQUIRED' end,
  case when (abs(angle) >= 8 and height >= typical * 1.35) or (height >= typical * 2.35 and width <= height * 3) then 'SUSPICIOUS_OVERLAY_GEOMETRY' end], lambda x: x is not null)) as issue from t)"""


@query(f"with {SQL_ISSUES} select * from i")
def line_quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of single lines by confidence and geometry."""
    return QU.line_issues(_boxes(spark, sf_dir), "page")


@query(f"""
with {SQL_ISSUES}, x as (select distinct page, line_id, 1 as hit from i)
select page, count(*) as n_lines, count(*) filter (hit is null) as n_accepted, case when count(*) filter (hit is null) = 0 then 'OCR_REJECTED' when count(*) filter (hit is null) < count(*) then 'OCR_LOW_CONFIDENCE' else 'OCR_ACCEPTED' end as state
from b left join x using (page, line_id) group by 1""")
def page_quality_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each page may be used, and its state."""
    boxes = _boxes(spark, sf_dir)
    return QU.page_states(boxes, QU.line_issues(boxes, "page"), "page")


@query(f"""
with {SQL_ISSUES}, h as (select distinct page, line_id % 2 as half, issue from i where issue = 'CONFIDENCE_REJECTED')
select page, line_id, issue from i union select page, line_id, issue from b join h using (page) where b.line_id % 2 = half""")
def quarantined_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that put the whole enclosing article aside."""
    boxes = _boxes(spark, sf_dir)
    lines = boxes.select("page", "line_id", F.concat_ws(":", "page", F.col("line_id") % 2).alias("article"))
    return QU.widen_to_articles(QU.line_issues(boxes, "page"), lines, "page")


@query("""select sha256('[' || string_agg('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}', ',' order by n_name, n_nationkey, n_regionkey) || ']') as fingerprint, count(*) as n from nation""")
def manifest_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over all rows of a small table, sorted."""
    row = F.struct("n_name", "n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "nation").agg(ids.table_fingerprint(row).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("select doc_id, sha256(string_agg(source || ':' || lang, '|' order by source, lang)) as fingerprint from documents group by 1")
def row_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ordered parts, one for each key."""
    parts = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "lang"))), "|")
    return table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.sha2(parts, 256).alias("fingerprint"))


@query(r"""
select doc_id, len(regexp_extract_all(lower(text), '[a-z]+(?:/[a-z]+)?|[0-9]+(?:[.-][0-9]+)*')) as n_tokens, length(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) as squeezed,
 length(regexp_replace(text, '\s+', '', 'g')) as compact, regexp_extract(text, '((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})', 1) as date from documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of plain forms of texts; text_forms runs F01 to F07."""
    t = F.col("text")
    squeezed = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    tokens = F.regexp_count(F.lower(t), F.lit(T.ASCII_TOKEN))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.cast("long").alias("n_tokens"), F.length(squeezed).cast("long").alias("squeezed"), F.length(F.regexp_replace(t, r"\s+", "")).cast("long").alias("compact"), F.regexp_extract(t, "((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})", 1).alias("date"))


@query("""
with r as (select o_orderkey, case o_orderpriority when '1-URGENT' then [1, 2, 3] when '2-HIGH' then [4, 9] else [2] end as requested, [1, 2, 3, 4, 5] as authorised, case when o_orderkey % 2 = 0 then [2, 3] else [1, 2, 3] end as needed, o_custkey % 5 <> 0 as available from orders)
select o_orderkey, case when len(list_filter(requested, lambda x: not list_contains(authorised, x))) > 0 then 'BLOCKED' when len(list_intersect(requested, needed)) = 0 then 'NOT_REQUIRED' when not available then 'UNAVAILABLE' when len(list_intersect(requested, needed)) = len(requested) then 'REQUIRED' else 'MIXED' end as decision from r""")
def capability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request of pages may do."""
    pages = lambda *n: F.array(*map(F.lit, n))
    requested = F.when(F.col("o_orderpriority") == "1-URGENT", pages(1, 2, 3)).when(F.col("o_orderpriority") == "2-HIGH", pages(4, 9)).otherwise(pages(2))
    needed = F.when(F.col("o_orderkey") % 2 == 0, pages(2, 3)).otherwise(pages(1, 2, 3))
    decision = QU.capability_decision(requested, pages(1, 2, 3, 4, 5), needed, F.col("o_custkey") % 5 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"))


@query("""
select a.l_orderkey, count(distinct a.l_suppkey) as suppliers, len(list_intersect(list(distinct a.l_linenumber), [1, 3, 5])) = 3 as has_all from lineitem a group by 1""")
def number_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all wanted numbers are there."""
    wanted = F.array(F.lit(1), F.lit(3), F.lit(5))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("suppliers"), R.containment(wanted, F.collect_set("l_linenumber")).alias("has_all"))


@query("""
select n_name, s.n as suppliers, c.n as customers from nation left join (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 0 group by 1) s on s.k = n_nationkey
left join (select c_nationkey as k, count(*) as n from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1) c on c.k = n_nationkey where lower(n_name) like '%a%'""")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered listing with counted members; registry_entries and registry_scopes run the registry."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return table(spark, sf_dir, "nation").where(F.lower("n_name").like("%a%")).join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_name", "suppliers", "customers")
