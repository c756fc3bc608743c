"""Queries on findings, their sources and reviews, and on the registry of standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import findings as FI
from quern.operators import registry as RG
from quern.operators import vectors as VS
from quern.plans.common import query, table
from quern.sources import pages as PG

_SCOPE = "LOCAL_REQUIREMENT"
SQL_FOUND = f"""
r as (select o_orderkey, o_custkey, o_orderstatus as sha_before, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as sha_after, case when o_orderkey % 5 <> 0 then 'comparison_' || o_orderkey end as comparison_id,
  case o_orderstatus when 'F' then 'COMPLIANT' when 'O' then 'NON_COMPLIANT' else 'INSUFFICIENT_INFORMATION' end as decision, o_orderpriority as reason_code, case when o_custkey % 11 <> 0 then 'e' || o_custkey end as evidence_id,
  o_orderkey % 9 as page_start, o_orderkey % 9 + o_custkey % 4 - 1 as page_end, '条文 ' || o_custkey as source_text, case when o_orderkey % 13 = 0 then 99 else 5 + length('条文 ' || o_custkey) end as char_end from orders),
f as (select *, case when sha_before <> sha_after then 'SOURCE_CHANGED' when comparison_id is null then 'AUTHORITY_UNAVAILABLE'
    when evidence_id is null or page_end < page_start or char_end <> 5 + length(source_text) then 'AUTHORITY_MISMATCH' else 'FOUND' end as finding_state from r),
g as (select o_orderkey, o_custkey, finding_state, case when finding_state = 'FOUND' then 'finding_' || sha256('{{"comparison_id":"' || comparison_id || '","decision":"' || decision || '","decision_scope":"{_SCOPE}","document_sha256":"' || sha_after
    || '","finding_version":"{FI.FINDING_VERSION}","reason_code":"' || reason_code || '"}}') end as finding_id,
  case when finding_state = 'FOUND' then 'Plan evidence states: "' || source_text || '". Standard requirement states: "应为 5m". Local {_SCOPE} decision: ' || decision || '. Reason: ' || reason_code || '.'
    || case when decision = 'INSUFFICIENT_INFORMATION' then ' Missing or unresolved information: ' || reason_code else '' end end as summary from f)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = F.concat(F.lit("条文 "), c("o_custkey").cast("string"))
    decision = F.when(c("o_orderstatus") == "F", "COMPLIANT").when(c("o_orderstatus") == "O", "NON_COMPLIANT").otherwise("INSUFFICIENT_INFORMATION")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", c("o_orderstatus").alias("sha_before"), F.when(c("o_orderkey") % 7 == 0, "X").otherwise(c("o_orderstatus")).alias("sha_after"),
        F.when(c("o_orderkey") % 5 != 0, F.concat(F.lit("comparison_"), c("o_orderkey").cast("string"))).alias("comparison_id"), decision.alias("decision"), c("o_orderpriority").alias("reason_code"), F.lit(_SCOPE).alias("decision_scope"),
        F.when(c("o_custkey") % 11 != 0, F.concat(F.lit("e"), c("o_custkey").cast("string"))).alias("evidence_id"), F.lit("应为 5m").alias("requirement_text"), (c("o_orderkey") % 9).alias("page_start"),
        (c("o_orderkey") % 9 + c("o_custkey") % 4 - 1).alias("page_end"), text.alias("source_text"), F.lit(5).alias("char_start"), F.when(c("o_orderkey") % 13 == 0, 99).otherwise(5 + F.length(text)).alias("char_end"),
        F.sha2(text, 256).alias("source_sha256"), F.when(decision == "INSUFFICIENT_INFORMATION", F.array(c("o_orderpriority"))).otherwise(F.array().cast("array<string>")).alias("missing_information"),
    )
    return FI.build(rows)


@query(f"with {SQL_FOUND} select o_orderkey, finding_state, finding_id, summary from g")
def findings_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from comparisons whose sources stand, with identity and summary."""
    return _found(spark, sf_dir).select("o_orderkey", "finding_state", "finding_id", "summary")


@query(f"""
with {SQL_FOUND}, k as (select cast(o_custkey as varchar) as document_id, coalesce(finding_id, 'none') as finding_id, finding_state, o_orderkey, 'note ' || o_orderkey as note, o_orderdate as moment, o_orderkey % 17 = 0 as wrong from g join orders using (o_orderkey, o_custkey)),
e as (select *, case when wrong then 'other' else document_id end as asked, finding_state = 'FOUND' and not wrong as known from k)
select o_orderkey, case when known then 'RECORDED' else 'AUTHORITY_MISMATCH' end as event_state, sha256(note) as reviewer_note_sha256,
  case when known then 'reviewevent_' || sha256('{{"disposition":"ACCEPTED","document_id":"' || asked || '","finding_id":"' || finding_id || '","occurred_at":"' || strftime(moment, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","report_inclusion":"INCLUDE","review_event_version":"{FI.EVENT_VERSION}","reviewer_id":"r1","reviewer_identity_assurance":"{FI.ASSURANCE}","reviewer_note_sha256":"' || sha256(note) || '"}}') end as review_event_id from e""")
def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviewers say of findings, as events; commands for findings that are not there record nothing."""
    found = _found(spark, sf_dir).withColumn("document_id", F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("occurred_at"))
    commands = found.join(orders, "o_orderkey").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, "other").otherwise(F.col("document_id")).alias("document_id"), F.coalesce("finding_id", F.lit("none")).alias("finding_id"), F.lit("r1").alias("reviewer_id"),
        F.lit("ACCEPTED").alias("disposition"), F.lit("INCLUDE").alias("report_inclusion"), F.concat(F.lit("note "), F.col("o_orderkey").cast("string")).alias("reviewer_note"), "occurred_at",
    )
    return FI.review_events(found.where("finding_id is not null"), commands).select("o_orderkey", "event_state", "reviewer_note_sha256", "review_event_id")


SQL_ARTICLES = "a as (select p_size as standard_id, p_partkey as article_id, p_partkey % 20 || '.1' as article_number, p_brand as source_checksum, p_name as article_text, p_size as page_start, p_size + p_partkey % 3 as page_end from part)"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(c("p_size").alias("standard_id"), c("p_partkey").alias("article_id"), F.concat((c("p_partkey") % 20).cast("string"), F.lit(".1")).alias("article_number"), c("p_brand").alias("source_checksum"), c("p_name").alias("article_text"), c("p_size").alias("page_start"), (c("p_size") + c("p_partkey") % 3).alias("page_end"))


@query(f"""
with {SQL_ARTICLES},
s as (select l_orderkey, l_linenumber, l_suppkey, l_partkey as article_id, p_size as standard_id, case when l_suppkey % 7 = 0 then 'x' else p_brand end as source_checksum, case when l_suppkey % 11 = 0 then '0.0' else l_partkey % 20 || '.1' end as article_number,
  l_linenumber as char_start, l_linenumber + 4 + case when l_suppkey % 13 = 0 then 1 else 0 end as char_end, case when l_suppkey % 5 = 0 then 'zzzz' else substr(p_name, l_linenumber + 1, 4) end as source_text, l_suppkey % 3 = 0 as forged from lineitem join part on l_partkey = p_partkey)
select l_orderkey, l_linenumber, l_suppkey, article_id, case when s.source_checksum <> a.source_checksum then 'CHECKSUM_MISMATCH' when s.article_number <> a.article_number then 'ARTICLE_MISMATCH'
    when char_end <> char_start + length(source_text) or substr(article_text, char_start + 1, length(source_text)) <> source_text then 'SPAN_MISMATCH' when forged then 'HASH_MISMATCH' else 'LOCATED' end as location from s join a using (standard_id, article_id)""")
def located_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of requirements, located in the stored article by identity, span and digest."""
    c = F.col
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_name")
    rows = table(spark, sf_dir, "lineitem").join(part, c("l_partkey") == c("p_partkey"))
    said = F.when(c("l_suppkey") % 5 == 0, "zzzz").otherwise(F.substring(c("p_name"), c("l_linenumber") + 1, F.lit(4)))
    sources = rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", c("l_partkey").alias("article_id"), c("p_size").alias("standard_id"), F.when(c("l_suppkey") % 7 == 0, "x").otherwise(c("p_brand")).alias("source_checksum"),
        F.when(c("l_suppkey") % 11 == 0, "0.0").otherwise(F.concat((c("l_partkey") % 20).cast("string"), F.lit(".1"))).alias("article_number"), c("l_linenumber").alias("char_start"),
        (c("l_linenumber") + 4 + F.when(c("l_suppkey") % 13 == 0, 1).otherwise(0)).alias("char_end"), said.alias("source_text"), F.when(c("l_suppkey") % 3 == 0, "forged").otherwise(F.sha2(said, 256)).alias("source_text_sha256"),
    )
    return FI.locate(sources, _articles(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_suppkey", "article_id", "location")


@query(f"""
with {SQL_ARTICLES},
b as (select l_orderkey, l_linenumber, l_suppkey, l_partkey as article_id, case when l_suppkey % 4 = 0 then 'LOW_CONFIDENCE' else 'ACCEPT' end as decision, case l_returnflag when 'R' then 'EXPLANATION' else 'NORMATIVE' end as kind, case when l_suppkey % 9 = 0 then 0 else p_size end as standard_id,
  p_size as evidence_standard_id, case when l_suppkey % 6 = 0 then 1 else p_size end as routed, case when l_suppkey % 11 = 0 then '0.0' else l_partkey % 20 || '.1' end as article_number, case when l_suppkey % 5 = 0 then 'z' else p_name end as source_text, case when l_suppkey % 7 = 0 then 'x' else p_brand end as source_checksum
  from lineitem join part on l_partkey = p_partkey)
select l_orderkey, l_linenumber, l_suppkey, b.article_id, array_to_string(list_filter([case when decision <> 'ACCEPT' then '1' end, case when kind <> 'NORMATIVE' then '2' end, case when b.standard_id <> routed then '3' end, case when evidence_standard_id <> routed then '4' end, case when a.article_id is null then '5' end,
  case when a.standard_id is distinct from routed then '6' end, case when a.article_number is distinct from b.article_number then '7' end, case when a.article_text is distinct from source_text then '8' end, case when a.source_checksum is distinct from b.source_checksum then '9' end], lambda x: x is not null), '') as failed
from b left join a on a.article_id = b.article_id and a.standard_id = evidence_standard_id""")
def binding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine equalities between a binding, its route and the stored article."""
    c = F.col
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_name")
    rows = table(spark, sf_dir, "lineitem").join(part, c("l_partkey") == c("p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", c("l_partkey").alias("article_id"), F.when(c("l_suppkey") % 4 == 0, "LOW_CONFIDENCE").otherwise("ACCEPT").alias("retrieval_decision"),
        F.when(c("l_returnflag") == "R", "EXPLANATION").otherwise("NORMATIVE").alias("article_type"), F.when(c("l_suppkey") % 9 == 0, 0).otherwise(c("p_size")).alias("standard_id"), c("p_size").alias("evidence_standard_id"),
        F.when(c("l_suppkey") % 6 == 0, 1).otherwise(c("p_size")).alias("routed_standard_id"), F.when(c("l_suppkey") % 11 == 0, "0.0").otherwise(F.concat((c("l_partkey") % 20).cast("string"), F.lit(".1"))).alias("article_number"),
        F.when(c("l_suppkey") % 5 == 0, "z").otherwise(c("p_name")).alias("source_text"), F.when(c("l_suppkey") % 7 == 0, "x").otherwise(c("p_brand")).alias("source_checksum"),
    )
    out = FI.bindings(rows, _articles(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "article_id", F.array_join(F.col("failed").cast("array<string>"), "").alias("failed"))


SQL_REGISTRY = """
g as (select 'GB ' || n_nationkey % 9 || '-20' || (10 + n_nationkey % 7) as standard_code, n_name as standard_name, case n_nationkey % 3 when 0 then 'SUPERSEDED' else 'ACTIVE' end as status, case n_regionkey when 1 then 'Civil' when 2 then 'CIVIL' else 'x' end as discipline, n_nationkey from nation)"""
SQL_INSTALLED = """
d as (select s_suppkey as standard_id, s_name as standard_name, 'GB' || s_suppkey % 9 || '-20' || (10 + s_nationkey % 7) as code, case when s_suppkey % 4 <> 0 then 'CONFIRMED' else 'REVIEW' end as identity_status, sha256(s_name) as source_checksum, s_suppkey % 6 <> 0 as confirmed, s_suppkey % 10 = 0 as stale, s_suppkey % 7 as page_count from supplier)"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    code = F.concat(F.lit("GB "), (c("n_nationkey") % 9).cast("string"), F.lit("-20"), (10 + c("n_nationkey") % 7).cast("string"))
    discipline = F.when(c("n_regionkey") == 1, "Civil").when(c("n_regionkey") == 2, "CIVIL").otherwise("x")
    return table(spark, sf_dir, "nation").select("n_nationkey", code.alias("standard_code"), c("n_name").alias("standard_name"), F.when(c("n_nationkey") % 3 == 0, "SUPERSEDED").otherwise("ACTIVE").alias("status"), discipline.alias("discipline"), F.lit("CN").alias("jurisdiction"), F.lit(None).cast("date").alias("effective_date"))


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    code, digest = F.concat(F.lit("GB"), (c("s_suppkey") % 9).cast("string"), F.lit("-20"), (10 + c("s_nationkey") % 7).cast("string")), F.sha2(c("s_name"), 256)
    bound = F.struct((c("s_suppkey") % 6 != 0).alias("confirmed"), F.when(c("s_suppkey") % 10 == 0, "other").otherwise(digest).alias("source_checksum"))
    return table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("standard_id"), c("s_name").alias("standard_name"), code.alias("standard_code"), code.alias("canonical_code"), F.when(c("s_suppkey") % 4 != 0, "CONFIRMED").otherwise("REVIEW").alias("identity_status"), F.lit("PARSED").alias("parse_status"), digest.alias("source_checksum"), bound.alias("binding"), (c("s_suppkey") % 7).alias("page_count"))


@query(f"with {SQL_REGISTRY} select n_nationkey, standard_code, row_number() over (order by lower(standard_code), lower(standard_name)) as place from g where status = 'ACTIVE' and lower(discipline) = 'civil'")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the registry by status and discipline, in order."""
    return RG.listing(_registry(spark, sf_dir), "ACTIVE", "civil").select("n_nationkey", "standard_code", "place")


@query(f"""with {SQL_REGISTRY}, {SQL_INSTALLED} select standard_id, code as canonical_code, standard_name, source_checksum from d
where identity_status = 'CONFIRMED' and confirmed and not stale and code in (select replace(standard_code, ' ', '') from g where status = 'ACTIVE')""")
def registry_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed documents that are qualified and whose standard is active."""
    return RG.qualified_scopes(_registry(spark, sf_dir), _installed(spark, sf_dir)).select("standard_id", "canonical_code", "standard_name", "source_checksum")


@query("select distinct 3 * p_size as standard_id from part where 3 * p_size not in (select s_suppkey from supplier)")
def unknown_scope_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards that are asked for and not installed."""
    return RG.unknown_ids(table(spark, sf_dir, "part").select((3 * F.col("p_size")).alias("standard_id")), _installed(spark, sf_dir))


@query(f"""
with {SQL_REGISTRY}, {SQL_INSTALLED},
a as (select p_partkey, 1 + p_partkey % (select count(*) from supplier) as standard_id, p_partkey % 30 || '.2' as article_number, case when p_partkey % 2 = 0 then '' else p_brand end as chapter_title, p_name as content, (['NORMATIVE', 'APPENDIX', 'TOC', 'EXPLANATION'])[1 + p_partkey % 4] as kind, p_partkey % 4 as page_start, p_partkey % 4 + p_size % 3 - 1 as page_end from part)
select article_number, content, standard_id, standard_name || case when chapter_title = '' then '' else chr(10) || chapter_title end || chr(10) || article_number || chr(10) || content as embedding_text,
  case when page_start <= page_end and page_end <= page_count then page_start end as page_start, case when page_start <= page_end and page_end <= page_count then page_end end as page_end
from a join d using (standard_id) where kind <> 'TOC' and lower(code) in (select lower(replace(standard_code, ' ', '')) from g where status = 'ACTIVE')""")
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search sees: articles of some kinds of documents with active codes, the text to embed, and pages."""
    c = F.col
    documents = _installed(spark, sf_dir)
    n = documents.count()
    kind = F.element_at(F.array(*map(F.lit, ("NORMATIVE", "APPENDIX", "TOC", "EXPLANATION"))), (c("p_partkey") % 4 + 1).cast("int"))
    articles = table(spark, sf_dir, "part").select(
        (1 + c("p_partkey") % n).alias("standard_id"), F.concat((c("p_partkey") % 30).cast("string"), F.lit(".2")).alias("article_number"), F.lit("1").alias("chapter_number"), F.when(c("p_partkey") % 2 == 0, "").otherwise(c("p_brand")).alias("chapter_title"),
        c("p_name").alias("content"), kind.alias("article_type"), (c("p_partkey") % 4).alias("page_start"), (c("p_partkey") % 4 + c("p_size") % 3 - 1).alias("page_end"),
    )
    records = RG.search_records(documents, articles, active=RG.listing(_registry(spark, sf_dir), "ACTIVE"))
    return records.select("article_number", "content", "standard_id", "embedding_text", "page_start", "page_end")


#: Clauses of plans, the article that governs each and how it was found, and what the run must say: route, trace state, decision and reason. The last is no candidate.
PLAN = (
    ("脚手架立杆伸出长度至少为150 mm。", "立杆伸出长度不应小于150mm", "ACCEPT", "ROUTED", "REQUIREMENTS_PROCESSED", "COMPLIANT", "NUMERIC_LIMIT_SATISFIED"),
    ("脚手架间隙不得大于3 mm。", "间隙不得大于2.5mm", "ACCEPT", "ROUTED", "REQUIREMENTS_PROCESSED", "NON_COMPLIANT", "NUMERIC_LIMIT_VIOLATED"),
    ("脚手架必须设置连墙件。", "应设置连墙件", "ACCEPT", "ROUTED", "REQUIREMENTS_PROCESSED", "INSUFFICIENT_INFORMATION", "UNSUPPORTED_REQUIREMENT_CLASS"),
    ("脚手架间距不得大于1.5 m。", "当高度大于8m时，间距不得大于1.2m", "ACCEPT", "ROUTED", "REQUIREMENT_UNRESOLVED", "INSUFFICIENT_INFORMATION", "CONDITION_UNRESOLVED"),
    ("脚手架步距不得大于1.8 m，间距不得大于1.5 m。", "步距不得大于1.8m", "ACCEPT", "ROUTED", "REQUIREMENTS_PROCESSED", "INSUFFICIENT_INFORMATION", "PLAN_FACT_AMBIGUOUS"),
    ("脚手架步距不得大于180 cm。", "步距不得大于1.8m", "ACCEPT", "ROUTED", "REQUIREMENTS_PROCESSED", "INSUFFICIENT_INFORMATION", "UNSUPPORTED_UNIT"),
    ("脚手架立杆间距不得大于1.5 m。", "间距不得大于1.2m", "LOW_CONFIDENCE", "ROUTED", "EVIDENCE_NOT_QUALIFIED", None, None),
    ("会议必须准时。", None, "ACCEPT", "NO_SCOPE", "NO_SCOPE", None, None),
    ("天气很好。", None, "ACCEPT", None, None, None, None),
)
_PLAN_ROWS = ", ".join("(" + ", ".join([str(i), *("null" if x is None else f"'{x}'" for x in case[3:])]) + ")" for i, case in enumerate(PLAN) if case[3])


@query(f"""
select p_partkey, route, trace_state, decision, reason_code, case when p_size % 10 = 0 then 'SOURCE_CHANGED' when decision is null then 'AUTHORITY_UNAVAILABLE' when p_size % 7 = 0 then 'AUTHORITY_MISMATCH' else 'FOUND' end as finding_state
from part join (values {_PLAN_ROWS}) v(i, route, trace_state, decision, reason_code) on p_partkey % {len(PLAN)} = i""")
def plan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run over plans, from clauses to findings; each candidate ends in a state of its own."""
    c = F.col
    at = (c("p_partkey") % len(PLAN) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(case[i]) for case in PLAN)), at)
    part = table(spark, sf_dir, "part")
    size = c("p_size").cast("string")
    spans = part.select(size.alias("document_id"), size.alias("sha_before"), F.when(c("p_size") % 10 == 0, "changed").otherwise(size).alias("sha_after"), c("p_partkey").alias("span_id"), F.lit(0).alias("char_start"), pick(0).alias("text"))
    evidence = part.select(
        F.lit("GB55023-2022").alias("code"), c("p_partkey").alias("span_id"), pick(2).alias("retrieval"), F.concat(F.lit("e"), c("p_partkey").cast("string")).alias("evidence_id"), pick(1).alias("article_text"),
        F.lit(2).alias("page_start"), F.when(c("p_size") % 7 == 0, 1).otherwise(3).alias("page_end"),
    )
    run = FI.review_plan(spans, evidence.where("article_text is not null"), spark.range(1).select(F.lit("GB55023-2022").alias("code")))
    return run.select(c("span_id").alias("p_partkey"), "route", "trace_state", "decision", "reason_code", "finding_state")


SQL_STORE = "s as (select vec_id, embedding[1] as first, len(embedding) as dim from embeddings where label <> 1 and vec_id % 10 <> 0 union all select vec_id, embedding[1] * 2, 2 from embeddings where vec_id % 10 = 0)"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    new = rows.where("vec_id % 10 = 0").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x * F.lit(2).cast("float")).alias("embedding"))
    return VS.upsert(VS.delete(rows.select("vec_id", "embedding"), rows.where("label = 1").select("vec_id")), new)


@query(f"with {SQL_STORE} select vec_id, first, dim from s")
def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of vectors after deletions and replacements."""
    return _store(spark, sf_dir).select("vec_id", F.get("embedding", F.lit(0)).alias("first"), F.size("embedding").cast("long").alias("dim"))


@query(f"with {SQL_STORE} select count(*) as n, min(dim) as least_dim, max(dim) as most_dim, min(vec_id) as first_id, max(vec_id) as last_id, 0::bigint as n_unusable from s")
def vector_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds."""
    return VS.manifest(_store(spark, sf_dir))


_UUID = "substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12)"


@query(f"select c_custkey, case when c_custkey % 5 = 0 then 'MALFORMED' when c_custkey % 3 = 0 then 'FOUND' else 'NOT_FOUND' end as lookup from (select c_custkey, {_UUID} as id from customer)")
def plan_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored plans by ids of the right shape."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_UUID).alias("id"))
    asked = rows.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.substring("id", 2, 35)).otherwise(F.col("id")).alias("document_id"))
    return PG.lookup(asked, rows.where("c_custkey % 3 = 0").select(F.col("id").alias("document_id"))).select("c_custkey", "lookup")


@query("select l_orderkey, l_linenumber as page_number from lineitem union select l_orderkey, l_suppkey % 9 from lineitem where l_returnflag = 'R'")
def page_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with text or a structural position."""
    rows = table(spark, sf_dir, "lineitem")
    positions = rows.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_suppkey") % 9).alias("page_number"))
    return PG.page_numbers(rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("page_number")), positions, "l_orderkey")
