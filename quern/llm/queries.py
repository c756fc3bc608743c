"""The queries of this subpackage over the tables of one folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, langid, lines, mixing, quality, secrets, simhash, substrings
from .storage import table


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, "documents", sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = secrets.secret_report(table(spark, "documents", sf_dir))
    return report.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.quality_filter(table(spark, "documents", sf_dir), table(spark, "labels", sf_dir))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, "documents", sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, "conversations", sf_dir).select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.chat_digests(chat.format_chats(turns.unionByName(more)))


def op6_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.round_trip_digests(table(spark, "documents", sf_dir), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = langid.identify(table(spark, "documents", sf_dir).select("doc_id", "text", "lang"))
    return said.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, "documents", sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, "embeddings", sf_dir))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, "documents", sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_mixing": op2_mixing,
    "op3_substrings": op3_substrings,
    "op4_embeddings": op4_embeddings,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_chat": op7_chat,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
}

def _sql_secrets(scope: int = 256) -> str:
    """The scan and its links as SQL, from the same patterns."""
    parts = []
    for kind, (pattern, group, least, holds) in secrets.PATTERNS.items():
        quoted = pattern.replace("'", "''")
        fine = " and ".join([f"length(v) >= {least}", *(f"regexp_matches(v, '{h}')" for h in holds)])
        parts.append(
            f"select doc_id, '{kind}' as kind, {secrets.RANK[kind]} as rank, '{secrets.ROLE[kind]}' as role, e - length(m) as s, e from ("
            f"select doc_id, m, v, cast(sum(length(g) + length(m)) over (partition by doc_id order by n rows unbounded preceding) as bigint) as e from ("
            f"select doc_id, unnest(regexp_extract_all(text, '{quoted}')) as m, unnest(regexp_extract_all(text, '{quoted}', {group})) as v, unnest(string_split_regex(text, '{quoted}')[1:len(regexp_extract_all(text, '{quoted}'))]) as g, "
            f"unnest(range(len(regexp_extract_all(text, '{quoted}')))) as n from documents)) where {fine}"
        )
    return f"""
with a as ({" union all ".join(parts)}), b as (select * from a where rank < {len(secrets.BASE)}),
w as (select * from a where rank >= {len(secrets.BASE)} and not exists (select 1 from b where b.doc_id = a.doc_id and b.s < a.e and b.e > a.s)), p as (select * from b union all select * from w),
t as (select * from b union all select w.* from w where exists (select 1 from p where p.doc_id = w.doc_id and p.role <> w.role and abs(p.s - w.s) <= {scope})),
r as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < {len(secrets.BASE)}) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from t group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents left join r using (doc_id)"""


SQL_SECRETS = _sql_secrets()
ORACLE_SQL = {
    "op2_mixing": r"""
with d as (
  select doc_id, source, source is null as no_source, coalesce(source, '') as name,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5('7:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
s0 as (
  select no_source, name, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by no_source, name) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from d group by 1, 2),
s1 as (select *, 2 * source_size as cap, (select sum(source_size) from s0) * 1.5::double as total from s0),
s2 as (
  select *, (total - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (w rows between current row and unbounded following) as own_level
  from s1 window w as (order by cap / weight, no_source, name)),
s3 as (select *, (select own_level from s2 where own_level * weight < cap order by cap / weight, no_source, name limit 1) as level from s2),
s as (
  select no_source, name, source_size,
         case when level is null or cap <= level * weight then cast(cap as double) else level * weight end as target
  from s3),
p as (
  select d.doc_id, d.size, s.source_size, s.target, cast(floor(s.target) as bigint) as budget,
         cast(sum(d.size) over (partition by d.no_source, d.name order by d.key, d.doc_id, d.size rows unbounded preceding) as bigint) as upto
  from d join s using (no_source, name)),
q as (select *, case when source_size > 0 then budget // source_size else 0 end as whole from p)
select doc_id, size, source_size, target,
       cast(whole * size + greatest(0, least(size, budget - whole * source_size - upto + size)) as bigint) as taken
from q""",
    "op3_substrings": r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
f as (select g, min(doc_id) as first from p group by 1),
c as (select distinct doc_id, i + k as pos from p join f using (g), range(13) r(k) where first < doc_id),
t as (select doc_id, generate_subscripts(w, 1) as pos, unnest(w) as word from d),
s as (select doc_id, count(c.pos) as n_removed, coalesce(string_agg(word, ' ' order by t.pos) filter (c.pos is null), '') as kept from t left join c using (doc_id, pos) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join s using (doc_id)""",
    "op4_embeddings": """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
g as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by 1), n as (select a as vec_id, count(*) as n_links from l group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from c left join n using (vec_id)""",
    "op7_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, k, case k when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(k)),
e as (select *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##') as t, replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '###', '#\##'), ':', '\:') as r from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('### ' || r || ': ' || t || '</turn>' || chr(10))) as bigint) as formatted_chars
from e group by 1""",
    "op8_lines": r"""
with x as (select doc_id, string_split(text, chr(10)) as ls from documents),
l as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from x),
m as (select *, row_number() over (order by doc_id, line_no) as pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
k as (select *, min(pos) over (partition by line) as first from m),
p as (select distinct pos, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as phrase, len(w) < 5 as short from k where pos = first),
n as (select pos, count(*) as n from p group by 1),
o as (select a.pos as later, b.pos as earlier, count(*) as shared from p a join p b on a.phrase = b.phrase and a.short = b.short and b.pos < a.pos group by 1, 2),
g as (select distinct later from o join n a on a.pos = later join n b on b.pos = earlier where 9 * shared >= 4 * (a.n + b.n)),
z as (select doc_id, line_no from k where pos <> first or pos in (select later from g)),
s as (select doc_id, count(z.line_no) as n_removed, coalesce(string_agg(line, chr(10) order by l.line_no) filter (z.line_no is null), '') as kept from l left join z using (doc_id, line_no) group by 1)
select x.doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from x left join s using (doc_id)""",
    "op5_secrets": SQL_SECRETS,
}
