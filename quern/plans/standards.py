"""Queries on standards, recognised lines and verified spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import standards as ST
from quern.operators import structure as S
from quern.plans.common import query, table


@query("""
with l as (select doc_id, generate_subscripts(x, 1) - 1 as line_index, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
s as (select *, coalesce(cast(sum(length(line) + 1) over (partition by doc_id order by line_index rows between unbounded preceding and 1 preceding) as bigint), 0) as char_start from l)
select doc_id, line_index, char_start, char_start + length(line) as char_end from s""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """places of lines in their text, by running sums."""
    rows = ST.offsets(S.explode_lines(table(spark, sf_dir, "documents"), ["doc_id"]), "doc_id", "line_index", "line")
    return rows.select("doc_id", F.col("line_index").cast("long").alias("line_index"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("""
with l as (select doc_id, generate_subscripts(x, 1) - 1 as line_index, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents)),
s as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_index rows between unbounded preceding and 1 preceding), 0) as start from l)
select s.doc_id, line_index, case when length(line) = 0 then 'MISSING' when line_index % 3 = 2 then case when (length(text) - length(replace(text, line, ''))) // length(line) = 1 then 'VERIFIED' else 'AMBIGUOUS' end
  when line_index % 3 = 1 and substr(text, cast(start as bigint) + 2, length(line)) <> line then 'MISMATCH' else 'VERIFIED' end as verified from s join documents using (doc_id)""")
def span_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans against the page text: right, wrong and unknown offsets."""
    docs = table(spark, sf_dir, "documents")
    rows = ST.offsets(S.explode_lines(docs, ["doc_id"]), "doc_id", "line_index", "line")
    start = F.when(F.col("line_index") % 3 == 0, F.col("char_start")).when(F.col("line_index") % 3 == 1, F.col("char_start") + 1).cast("int")
    spans = rows.select("doc_id", F.col("line_index").cast("long").alias("line_index"), start.alias("start"), F.col("line").alias("span"))
    return ST.verified_spans(spans, docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "line_index", "verified")


@query("""
select l_orderkey as page, l_linenumber as line_id, row_number() over (partition by l_orderkey order by l_suppkey, l_partkey, l_linenumber) as reading_order from lineitem""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page from top to bottom."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_id"), F.col("l_suppkey").alias("top"), F.col("l_partkey").alias("left"))
    return ST.reading_order(rows, "page").select("page", "line_id", "reading_order")


@query("""
with c as (select o_custkey, o_orderkey, o_orderstatus = 'F' as is_article, o_orderstatus = 'P' as is_head from orders),
a as (select *, min(case when is_article then o_orderkey end) over (w rows between 1 following and unbounded following) as until, min(case when is_head then o_orderkey end) over (w rows between 1 following and unbounded following) as c from c window w as (partition by o_custkey order by o_orderkey))
select o_custkey, '1.2.' || (o_orderkey % 100) as article_number, o_orderkey as first, until, case when until is null or c < until then c end as cut from a where is_article""")
def article_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of articles, cut at the first heading between them."""
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("1.2."), (F.col("o_orderkey") % 100).cast("string"), F.lit(" text"))).when(F.col("o_orderstatus") == "P", "3 Heading").otherwise("plain words")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", text.alias("line"))
    return ST.article_intervals(rows, "o_custkey", "o_orderkey")


@query("""
with b as (select l_orderkey as k, l_quantity as q, l_linestatus as s from lineitem where l_linenumber = 1), n as (select o_orderkey as k, o_orderstatus as s, count(*) over (partition by o_orderkey) as c from orders)
select b.k, b.s, b.q, coalesce(c = 1 and n.s = b.s, false) as qualified from b left join n using (k)""")
def qualified_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings that exactly one stored row confirms field by field."""
    bound = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s"), F.col("l_quantity").alias("q"))
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return ST.qualified_bindings(bound, stored, "k", ["s"])


@query("""
select doc_id, line_index, case when line_index % 2 = 0 then line else '' end as line from (select doc_id, generate_subscripts(x, 1) - 1 as line_index, unnest(x) as line from (select doc_id, string_split(text, chr(10)) as x from documents))""")
def accepted_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not accepted go blank in place."""
    rows = S.explode_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    kept = rows.where("line_index % 2 = 0").select("doc_id", "line_index")
    out = ST.accepted_slots(rows, kept, ["doc_id", "line_index"], "line")
    return out.select("doc_id", F.col("line_index").cast("long").alias("line_index"), "line")
