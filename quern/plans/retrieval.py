"""Queries on ranked retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import joins as J
from quern.operators import retrieval as R
from quern.plans.common import SQL_TOKENS, query, table

TOP = 20

#: Benchmark items with an id divisible by 100 are the stated query set of searches.
ASKED = "item_id % 100 = 0"

SQL_BM25 = f"""
d as (select doc_id, {SQL_TOKENS.format("text")} as tokens from documents),
s as (select doc_id, len(tokens) as length, unnest(tokens) as token from d),
st as (select count(*) as n, greatest(avg(len(tokens)), 1.0) as mean from d),
q as (select item_id as query_id, unnest({SQL_TOKENS.format("text")}) as token from benchmark where item_id % 100 = 0),
df as (select token, count(*) as df from s where token in (select token from q) group by 1),
scores as (
  select q.query_id, s.doc_id,
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * length / mean))) as score
  from q join s using (token) join df using (token), st group by 1, 2)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").where(ASKED)
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.ascii_tokens(F.col("text")).alias("tokens"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", T.ascii_tokens(F.col("text")).alias("tokens"))


@query(f"""
with {SQL_BM25},
r as (select query_id, doc_id, round(score, 6) as score from scores)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank
from r qualify rank <= {TOP}""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top 20 for the stated queries."""
    scores = R.bm25_scores(_docs(spark, sf_dir), _asked(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return R.top_ranks(scores, [F.desc("score"), F.asc("doc_id")], TOP)


@query(f"""
with f as (
  select p_partkey, unnest({SQL_TOKENS.format("p_name")}) as token, 3 as w from part union all
  select p_partkey, unnest({SQL_TOKENS.format("p_type")}), 2 from part union all
  select p_partkey, unnest({SQL_TOKENS.format("p_brand")}), 1 from part)
select p_partkey, token, cast(sum(w) as bigint) as weight from f group by 1, 2""")
def weighted_field_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of tokens by the fields that hold them."""
    fields = {"content": T.ascii_tokens(F.col("p_name")), "chapter": T.ascii_tokens(F.col("p_type")), "name": T.ascii_tokens(F.col("p_brand"))}
    return R.postings(table(spark, sf_dir, "part"), R.weighted_tokens(fields), "p_partkey")


SQL_BOOST = f"""
qs as (select item_id as query_id, text as query, {SQL_TOKENS.format("text")} as qt,
              list_filter(string_split_regex(text, '[.\\n]+ *'), lambda x: x <> '') as phrases
       from benchmark where item_id % 100 = 0),
ds as (select doc_id, text, source, {SQL_TOKENS.format("text")} as dt from documents),
b as (select query_id, doc_id,
        len(list_filter(phrases, lambda p: contains(text, p))) * 4.0 as phrase_boost,
        len(list_filter(phrases, lambda p: contains(text, p))) as n_phrases,
        case when contains(query, source) then 5.0 else 0.0 end as code_boost,
        len(list_intersect(qt, dt)) / len(qt) as overlap
      from qs, ds)"""


@query(f"""
with {SQL_BOOST}, r as (select query_id, doc_id, round(phrase_boost + code_boost + overlap, 6) as boost from b where phrase_boost + code_boost + overlap > 0)
select query_id, doc_id, boost, row_number() over (partition by query_id order by boost desc, doc_id) as rank from r qualify rank <= {TOP}""")
def exact_boost_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts by whole sentences, source name and token overlap."""
    asked = _asked(spark, sf_dir).select("query_id", "query", F.col("tokens").alias("qt"), _phrases(F.col("query")).alias("phrases"))
    pairs = J.against(_docs(spark, sf_dir), "doc_id", asked)
    parts = {"phrases": F.col("phrases"), "numbers": F.array().cast("array<string>"), "text": F.col("query"), "tokens": F.col("qt")}
    boost = R.exact_boost(parts, F.col("text"), F.col("tokens"), F.lit(""), F.col("source"))
    scored = pairs.select("query_id", "doc_id", F.round(boost, 6).alias("boost")).where("boost > 0")
    return R.top_ranks(scored, [F.desc("boost"), F.asc("doc_id")], TOP)


def _phrases(text):
    return F.filter(F.split(text, "[.\n]+ *"), lambda p: p != "")


SQL_COSINE = """
vq as (select vec_id as query_id, embedding as query from embeddings{0}),
vs as (select query_id, vec_id, round(list_cosine_similarity(cast(embedding as double[]), cast(query as double[])), 6) as score
       from embeddings, vq where vec_id <> query_id),
vr as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from vs where score > 0)"""

SQL_VECTOR = SQL_COSINE.format(" where vec_id % 100 = 0")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"with {SQL_VECTOR} select query_id, vec_id, score, rank from vr where rank <= 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors by cosine for the stated queries."""
    return R.vector_top(table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 5)


@query(f"""
with {SQL_VECTOR},
la as (select query_id, vec_id, row_number() over (partition by query_id order by same desc, abs(vec_id - query_id), vec_id) as rank
       from (select q.vec_id as query_id, v.vec_id, cast(v.label = q.label as int) as same from embeddings v, embeddings q
             where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id and v.label = q.label)),
f as (select query_id, vec_id, rank, 0 as route from vr where rank <= 20 union all select query_id, vec_id, rank, 1 from la where rank <= 20),
g as (select query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) as hybrid_score, max(case when route = 0 then rank end) as rank_0, max(case when route = 1 then rank end) as rank_1
      from f group by 1, 2)
select *, row_number() over (partition by query_id order by hybrid_score desc, vec_id) as rank from g qualify rank <= 5""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of a cosine route with one by equal label and nearest id."""
    pool = R.pool_size(5)
    vectors = table(spark, sf_dir, "embeddings")
    near = R.vector_top(vectors, _vector_queries(spark, sf_dir), pool)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    same = vectors.join(asked, "label").where("vec_id <> query_id").withColumn("gap", F.abs(F.col("vec_id") - F.col("query_id")))
    by_label = R.top_ranks(same, [F.asc("gap"), F.asc("vec_id")], pool)
    fused = R.fuse(near, by_label).withColumn("hybrid_score", F.round("hybrid_score", 9))
    return R.top_ranks(fused, [F.desc("hybrid_score"), F.asc("vec_id")], 5)


@query(f"""
with {SQL_BM25}, {SQL_BOOST},
pool as (select query_id, doc_id, round(score, 6) as keyword_score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as kr from scores qualify kr <= {TOP * 4}),
r as (select pool.query_id, pool.doc_id, keyword_score, round((n_phrases * 4.0 + 3.0 * overlap + code_boost) / 100, 6) as rerank_score from pool join b using (query_id, doc_id))
select query_id, doc_id, keyword_score, rerank_score, row_number() over (partition by query_id order by rerank_score desc, keyword_score desc, doc_id) as rank from r qualify rank <= {TOP}""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rerank a BM25 pool; a keyword-only hit has base zero, so BM25 only breaks ties."""
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    scores = R.bm25_scores(docs, asked).withColumn("keyword_score", F.round("score", 6)).drop("score")
    pool = R.top_ranks(scores, [F.desc("keyword_score"), F.asc("doc_id")], 4 * TOP).drop("rank")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = pool.join(texts, "doc_id").withColumn("tokens", T.ascii_tokens(F.col("text"))).join(asked.select("query_id", "query", F.col("tokens").alias("qt")), "query_id")
    phrases = F.size(F.filter(_phrases(F.col("query")), lambda p: F.contains(F.col("text"), p)))
    overlap = F.size(F.array_intersect("qt", "tokens")) / F.size("qt")
    score = R.rerank_score(F.lit(None).cast("double"), phrases, F.lit(False), overlap, F.contains(F.col("query"), F.col("source")))
    scored = rows.select("query_id", "doc_id", "keyword_score", F.round(score, 6).alias("rerank_score"))
    return R.top_ranks(scored, [F.desc("rerank_score"), F.desc("keyword_score"), F.asc("doc_id")], TOP)


@query(f"""
with {SQL_BM25},
best as (select query_id, doc_id from scores qualify row_number() over (partition by query_id order by round(score, 6) desc, doc_id) = 1),
held as (select query_id, token, true as held from best join s using (doc_id)),
c as (select q.query_id, round(coalesce(sum(case when held then ln(1 + (n + 0.5) / (coalesce(df, 0) + 0.5)) else 0.0 end) / sum(ln(1 + (n + 0.5) / (coalesce(df, 0) + 0.5))), 0.0), 6) as coverage
      from q left join df using (token) left join held using (query_id, token), st group by 1)
select query_id, doc_id, coverage,
  case when doc_id is null then 'NO_MATCH' when coverage >= 0.6 then 'ACCEPT' when coverage >= 0.3 then 'LOW_CONFIDENCE' else 'NO_MATCH' end as decision
from c left join best using (query_id)""")
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision by the idf-weighted coverage of the best hit."""
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    scores = R.bm25_scores(docs, asked).withColumn("score", F.round("score", 6))
    best = R.top_ranks(scores, [F.desc("score"), F.asc("doc_id")], 1).select("query_id", "doc_id")
    words = asked.select("query_id", F.explode("tokens").alias("token"))
    held = R.held_tokens(docs, asked)
    df = held.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    top = texts.join(best, "doc_id").select("query_id", F.explode(T.ascii_tokens(F.col("text"))).alias("token"))
    cover = R.coverage(words, top, df, held.agg(F.count(F.lit(1)).alias("n")).scalar()).join(best, "query_id", "left")
    decision = R.acceptance(F.col("coverage"), F.lit(False), F.lit(False), F.col("doc_id").isNotNull())
    return cover.select("query_id", "doc_id", "coverage", decision.alias("decision"))


@query(f"""
with {SQL_COSINE.format("")},
rel as (select q.vec_id as query_id, v.vec_id from embeddings v, embeddings q where v.vec_id <> q.vec_id and v.label = q.label),
one as (select query_id, count(*) filter (rank <= 1) / count(*) as recall_1, count(*) filter (rank <= 3) / count(*) as recall_3, count(*) filter (rank <= 5) / count(*) as recall_5,
               count(*) filter (rank <= 10) / count(*) as recall_10, coalesce(1 / min(rank), 0.0) as rr
        from rel left join (select * from vr where rank <= 10) using (query_id, vec_id) group by 1),
e as (select query_id from vr where rank <= 10 union select query_id from rel)
select round(avg(coalesce(recall_1, 0)), 6) as recall_1, round(avg(coalesce(recall_3, 0)), 6) as recall_3, round(avg(coalesce(recall_5, 0)), 6) as recall_5,
       round(avg(coalesce(recall_10, 0)), 6) as recall_10, round(avg(coalesce(rr, 0)), 6) as mrr from e left join one using (query_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of cosine search for equal labels, every vector being a query."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    ranks = R.vector_top(vectors, asked, 10).withColumnRenamed("vec_id", "item")
    return R.label_metrics(ranks, vectors.select(F.col("vec_id").alias("item"), "label"), asked.select("query_id", "label"))


@query("""
with h as (select l_suppkey as query_id, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber) as rank,
                  l_partkey as number, l_returnflag = 'R' as flagged, l_orderkey, l_linenumber from lineitem),
a as (select *, row_number() over (partition by query_id, number order by flagged desc, rank) as turn from h),
p as (select query_id, number, rank as position, row_number() over (partition by query_id, number order by rank) as turn from h)
select query_id, l_orderkey, l_linenumber, rank, position from a join p using (query_id, number, turn)""")
def prefer_flagged_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each supplier's order, returned twins of a part go first."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_partkey").alias("number"), (F.col("l_returnflag") == "R").alias("flagged"))
    hits = hits.withColumn("rank", F.row_number().over(order).cast("long"))
    return R.prefer_flagged(hits).select("query_id", "l_orderkey", "l_linenumber", "rank", "position")


@query("""
with q as (
  select s_suppkey as query_id, s_nationkey,
         case s_suppkey % 4 when 0 then [s_nationkey] when 1 then [s_nationkey + 20] when 2 then [s_nationkey, s_nationkey + 1] else cast([] as integer[]) end as codes,
         s_suppkey % 7 = 0 as malformed from supplier),
n as (select n_nationkey + (n_nationkey % 3) as code, count(*) as matches from nation group by 1)
select query_id,
  case when len(codes) = 0 and not malformed then 'NO_EXPLICIT_SCOPE' when malformed then 'INVALID_SCOPE' when len(codes) <> 1 then 'CONFLICTING_SCOPE'
       when coalesce(matches, 0) = 0 then 'UNKNOWN_SCOPE' when matches > 1 then 'AMBIGUOUS_SCOPE' when query_id % 5 = 0 then 'CONFLICTING_SCOPE' else 'RESOLVED_UNIQUE_SCOPE' end as status,
  (select count(*) from (values (1), (5), (9)) t(x) where x not in (select n_nationkey from nation)) as missing
from q left join n on n.code = codes[1]""")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the scope that each supplier names."""
    key = F.col("s_nationkey")
    turn = F.col("s_suppkey") % 4
    codes = F.when(turn == 0, F.array(key)).when(turn == 1, F.array(key + 20)).when(turn == 2, F.array(key, key + 1)).otherwise(F.array().cast("array<int>"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), codes.alias("codes"), (F.col("s_suppkey") % 7 == 0).alias("malformed"))
    nations = table(spark, sf_dir, "nation")
    have = nations.groupBy((F.col("n_nationkey") + F.col("n_nationkey") % 3).alias("code")).agg(F.count(F.lit(1)).alias("matches"))
    numbers = nations.agg(F.collect_set("n_nationkey").alias("have"))
    rows = asked.join(have, F.get("codes", F.lit(0)) == F.col("code"), "left").join(numbers, F.lit(True))
    status = R.scope_status(F.col("codes"), F.col("malformed"), F.coalesce("matches", F.lit(0)), F.col("query_id") % 5 != 0)
    missing = F.size(F.array_except(F.array(F.lit(1), F.lit(5), F.lit(9)), F.col("have"))).cast("long")
    return rows.select("query_id", status.alias("status"), missing.alias("missing"))


@query("""
select o_orderkey, o_custkey, o_totalprice, (select count(*) from orders where o_orderstatus = 'F') as total
from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 50 offset 100""")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a listing with its total."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.page_of(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 50)
