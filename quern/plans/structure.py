"""Queries on lines, regions, hierarchies and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import text as T
from quern.operators import regions as R
from quern.operators import structure as S
from quern.plans.common import query, table

#: Filled, trimmed lines of a text as DuckDB SQL.
SQL_FILLED = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
SQL_PAGES = f"p as (select source, doc_id, {SQL_FILLED} as ls from documents), np as (select source, count(*) as of_pages from documents group by 1)"
SQL_PAGE_NUMBER = r"'^(?:[-—–]? ?[0-9]{1,4} ?[-—–]?|第 ?[0-9]{1,4} ?页(?:/?共 ?[0-9]{1,4} ?页)?)$'"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: a source is a document, each row a page."""
    return table(spark, sf_dir, "documents").select("source", "doc_id", "text")


@query("select doc_id, generate_subscripts(l, 1) - 1 as line_index, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows, with their place."""
    return S.explode_lines(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.col("line_index").cast("long").alias("line_index"), "line")


@query(f"""
with {SQL_PAGES},
e as (select source, regexp_replace(unnest([ls[1], ls[len(ls)]]), '[0-9]+', '#', 'g') as edge from p where len(ls) > 0),
c as (select source, edge, count(*) as pages from e where edge <> '' and length(edge) <= 80 group by 1, 2)
select source, edge, pages, of_pages from c join np using (source) where of_pages >= 3 and pages >= greatest(3, (of_pages + 1) // 2)
union all by name
select source, edge, pages, of_pages from (
  select source, edge, count(*) as pages from (select source, regexp_replace(unnest([ls[1], ls[len(ls)]]), '[0-9]+', '#', 'g') as edge from
    (select source, doc_id, list_filter(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\\S')) as ls from (select 'pages' as source, page_id as doc_id, html from pages)) where len(ls) > 0)
  where edge <> '' and length(edge) <= 80 group by 1, 2), (select count(*) as of_pages from pages) where of_pages >= 3 and pages >= greatest(3, (of_pages + 1) // 2)""".replace(
        "list_filter(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\\S'))",
        r"list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')",
    )
)
def repeated_edges_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that repeat over the pages of a source, and of the web pages."""
    web = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return S.repeated_edges(_pages(spark, sf_dir).union(web), "source", "occurrence").select("source", "edge", "pages", "of_pages")


@query(f"""
with p as (select 'site' as source, page_id, list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ls from pages),
e as (select distinct source, page_id, lower(regexp_replace(x, '\\s+', '', 'g')) as edge from (select source, page_id, unnest(ls[1:2] || ls[greatest(1, len(ls) - 1):len(ls)]) as x from p)
      where length(x) between 2 and 80 and not regexp_matches(x, {SQL_PAGE_NUMBER})),
c as (select source, edge, count(*) as pages from e group by 1, 2)
select source, edge, pages, of_pages from c, (select count(*) as of_pages from pages) where of_pages >= 3 and pages >= greatest(3, ceil(of_pages * 0.6))""")
def repeated_edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer two lines at each end, once a page."""
    web = table(spark, sf_dir, "pages").select(F.lit("site").alias("source"), F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return S.repeated_edges(web, "source", "distinct").select("source", "edge", "pages", "of_pages")


@query(f"""
with p as (select 'site' as source, page_id, list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ls from pages),
i as (select source, page_id, ls, len(ls) as n, unnest(list_distinct(list_filter([0, 1, len(ls) - 2, len(ls) - 1], lambda x: x >= 0 and x < len(ls)))) as pos from p),
e as (select distinct source, page_id, case when pos <= 1 then 'top-' || pos else 'bottom-' || (n - 1 - pos) end as slot, lower(regexp_replace(ls[pos + 1], '\\s+', '', 'g')) as edge
      from i where not regexp_matches(ls[pos + 1], '应当|应|不得|不应|严禁|宜|可')),
c as (select source, slot, edge, count(*) as pages from e where length(edge) between 2 and 80 and not regexp_matches(edge, {SQL_PAGE_NUMBER}) group by 1, 2, 3)
select source, slot, edge, pages, of_pages from c, (select count(*) as of_pages from pages) where of_pages >= 3 and pages >= greatest(3, ceil(of_pages * 0.6))""")
def repeated_edges_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer lines by slot."""
    web = table(spark, sf_dir, "pages").select(F.lit("site").alias("source"), F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return S.repeated_edges(web, "source", "slot").select("source", "slot", "edge", "pages", "of_pages")


@query(r"""
with p as (select 'site' as source, page_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') as text from pages),
f as (select source, page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from p),
e as (select source, regexp_replace(unnest([ls[1], ls[len(ls)]]), '[0-9]+', '#', 'g') as edge from f where len(ls) > 0),
c as (select edge, count(*) as n from e where edge <> '' and length(edge) <= 80 group by 1),
r as (select edge from c, (select count(*) as np from pages) where np >= 3 and n >= greatest(3, (np + 1) // 2)),
l as (select page_id, generate_subscripts(x, 1) - 1 as line_index, unnest(x) as line from (select page_id, string_split(text, chr(10)) as x from p))
select page_id, line_index, line from l where regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '[0-9]+', '#', 'g') not in (select edge from r)""")
def strip_repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the web pages without those that repeat as edges."""
    web = table(spark, sf_dir, "pages").select(F.lit("site").alias("source"), "page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return S.strip_edges(web, "source", "page_id").select("page_id", F.col("line_index").cast("long").alias("line_index"), "line")


@query(r"""
with p as (select source, doc_id, text, doc_id % 3 as image_count, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '\s+', '', 'g'))) as ls from documents),
g as (select source, doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) as raw, image_count, (doc_id % 10) / 10 as coverage, regexp_matches(text, '(?i)license|copyright') as structured,
        coalesce(list_sum(list_filter(list_transform(list_filter(ls, lambda x: not regexp_matches(x, '^(?:[-—–]? ?[0-9]{1,4} ?[-—–]?)$')), lambda x: length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g'))), lambda x: x >= 4)), 0) as effective from p),
d as (select source, count(*) as page_count, cast(sum(raw) as bigint) as raw_count, cast(sum(effective) as bigint) as effective,
        count(*) filter (effective >= 24 or (effective >= 8 and structured)) as meaningful, count(*) filter (image_count > 0) as image_pages, count(*) filter (coverage >= 0.6) as heavy_pages,
        cast(0 as double) as repeated_ratio, bool_or(structured) as has_structure from g group by 1)
select *, case when raw_count = 0 then case when image_pages > 0 then 'OCR_REQUIRED' else 'EMPTY_DOCUMENT' end
  when heavy_pages / page_count > 0.5 and (meaningful / page_count < 0.5 or effective < greatest(120, page_count * 35)) then 'OCR_REQUIRED'
  when has_structure and meaningful >= 1 and heavy_pages / page_count < 0.5 then 'TEXT_READY' when heavy_pages = 0 and effective >= 8 then 'TEXT_READY'
  when meaningful = 0 or effective < 10 then 'TEXT_INSUFFICIENT' when heavy_pages / page_count >= 0.2 and meaningful / page_count < 0.75 then 'TEXT_INSUFFICIENT'
  when has_structure or effective >= greatest(80, page_count * 30) then 'TEXT_READY' else 'TEXT_INSUFFICIENT' end as status from d""")
def document_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and capability of each source as a document."""
    pages = _pages(spark, sf_dir).withColumn("image_count", F.col("doc_id") % 3).withColumn("image_coverage", (F.col("doc_id") % 10) / 10)
    return S.inspect_documents(pages, "source", "(?i)license|copyright")


#: Region names of events, as SQL and as markers.
EVENT_REGION = "case when event_type = 'purchase' then 'calculation' when event_type = 'signup' then 'embedded' end"


@query(f"""
select event_id, user_id, coalesce(last_value({EVENT_REGION} ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 'normal') as region from events""")
def region_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last region marker carries on."""
    events = table(spark, sf_dir, "events")
    region = S.fill_forward(events, "user_id", ["ts", "event_id"], F.expr(EVENT_REGION))
    return events.select("event_id", "user_id", region.alias("region"))


@query("""
with e as (select *, coalesce(max(cast(event_type = 'purchase' as int)) over (w rows between unbounded preceding and 1 preceding), 0) as seen,
   max(cast(value > 50 as int)) over (w rows between current row and 11 following) as a, max(cast(event_type = 'view' as int)) over (w rows between current row and 11 following) as b
   from events window w as (partition by user_id order by ts, event_id))
select event_id, user_id, seen = 1 and event_type = 'click' and a = 1 and b = 1 as starts from e""")
def embedded_document_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title after a calculation page with all terms in the next twelve pages."""
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    kind = F.col("event_type")
    starts = S.embedded_starts(events, "user_id", "at", kind == "purchase", kind == "click", [F.col("value") > 50, kind == "view"])
    return events.select("event_id", "user_id", starts.alias("starts"))


@query("""
with a as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
b as (select *, cast(sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) - 1 as bigint) as island from a)
select user_id, island, event_type, min(ts) as first, max(ts) as last, count(*) as n from b group by 1, 2, 3""")
def region_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type."""
    return S.islands(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


SQL_PARTS = "t as (select p_brand, p_partkey, cast(ceil(p_size / 10.0) as int) as level from part)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.ceil(F.col("p_size") / 10.0).cast("int").alias("level"))


@query(f"with {SQL_PARTS} select a.p_partkey, a.level, min(b.p_partkey) as ends from t a left join t b on a.p_brand = b.p_brand and b.p_partkey > a.p_partkey and b.level <= a.level group by 1, 2")
def hierarchy_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each heading's section ends."""
    return _tree(spark, sf_dir).select("p_partkey", "level", S.next_boundary("p_brand", "p_partkey", "level").alias("ends"))


@query(f"with {SQL_PARTS} select a.p_partkey, a.level, max(b.p_partkey) as parent from t a left join t b on a.p_brand = b.p_brand and b.p_partkey < a.p_partkey and b.level < a.level group by 1, 2")
def hierarchy_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading above each heading."""
    return _tree(spark, sf_dir).select("p_partkey", "level", S.parent_position("p_brand", "p_partkey", "level").alias("parent"))


@query(f"""
with recursive {SQL_PARTS}, tp as (select a.p_brand, a.p_partkey, a.level, max(b.p_partkey) as parent from t a left join t b on a.p_brand = b.p_brand and b.p_partkey < a.p_partkey and b.level < a.level group by 1, 2, 3),
c as (select p_partkey, p_partkey as up, parent, 0 as depth, p_partkey % 7 <> 0 as ok from tp
      union all select c.p_partkey, tp.p_partkey, tp.parent, depth + 1, tp.p_partkey % 7 <> 0 from c join tp on c.parent = tp.p_partkey)
select p_partkey, bool_and(ok) as all_ancestors, coalesce(bool_or(ok) filter (depth > 0), false) as any_ancestor from c group by 1""")
def hierarchy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over all headings above."""
    tree = _tree(spark, sf_dir).withColumn("parent", S.parent_position("p_brand", "p_partkey", "level")).withColumn("ok", F.col("p_partkey") % 7 != 0)
    return S.ancestors_all(tree, "p_brand", "p_partkey", "parent", "ok").select("p_partkey", "all_ancestors", "any_ancestor")


@query("""
with s as (select *, sum(cast(role = 'user' as int)) over (partition by conv_id order by turn rows unbounded preceding) as session from conversations)
select conv_id, cast(session as bigint) as session, min(turn) as first, max(turn) as last, count(*) as n_rows, string_agg(text, chr(10) order by turn, text) as content from s where session > 0 group by 1, 2""")
def article_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article opens at a start and takes all lines up to the next."""
    turns = S.sessions(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "user")
    return S.session_texts(turns, "conv_id", "turn", "text")


@query("""
with l as (select l_orderkey, l_linenumber * (1 + l_partkey % 2) as number, l_linenumber from lineitem),
g as (select *, lag(number) over w as before, row_number() over w as n from l window w as (partition by l_orderkey order by number, l_linenumber))
select l_orderkey, before, number as after, number - coalesce(before, 0) - 1 as missing from g where (before is not null and number > before + 1) or (n = 1 and number <> 1)""")
def sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers left out between neighbours or at the start."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * (1 + F.col("l_partkey") % 2)).alias("number"), "l_linenumber")
    return S.sequence_gaps(lines, "l_orderkey", ["number", "l_linenumber"], "number")


@query("""
with l as (select l_orderkey, l_partkey % 12 as number, l_linenumber, l_suppkey from lineitem),
g as (select *, lag(number) over w as before, lag(l_linenumber) over w as from_at, count(*) over (partition by l_orderkey) as items from l window w as (partition by l_orderkey order by l_linenumber, l_suppkey, number))
select l_orderkey, before, number as after, from_at, l_linenumber as to_at from g where items >= 4 and number > before + 1 and before >= 1""")
def list_gap_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in lists of four items or more, with the band they lie in."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 12).alias("number"), "l_linenumber", "l_suppkey")
    return S.list_gaps(lines, ["l_orderkey"], ["l_linenumber", "l_suppkey", "number"], "number")


@query("select event_id, max(cast(event_type = 'purchase' as int)) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) = 1 as in_context from events")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within two after a marked one."""
    return table(spark, sf_dir, "events").select("event_id", S.in_context("user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 2).alias("in_context"))


@query("""
with e as (select event_id, event_type, [case when coalesce(lead(event_type = 'purchase', 1) over w, true) then null else lead(event_type, 1) over w end,
   case when coalesce(lead(event_type = 'purchase', 2) over w, true) then null else lead(event_type, 2) over w end, case when coalesce(lead(event_type = 'purchase', 3) over w, true) then null else lead(event_type, 3) over w end] as a
   from events window w as (partition by user_id order by ts, event_id))
select event_id, event_type || case when a[1] is null then '' when a[2] is null then a[1] when a[3] is null then a[1] || a[2] else a[1] || a[2] || a[3] end as captured from e""")
def continuation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line and up to three that continue it."""
    events = table(spark, sf_dir, "events").withColumn("stop", F.col("event_type") == "purchase")
    return events.select("event_id", S.continuation("user_id", ["ts", "event_id"], "event_type", F.col("stop")).alias("captured"))


@query(r"""
with l as (select page_id, unnest(string_split(regexp_replace(html, '<(?:h[1-6]|p|li|title|div)[^>]*>', chr(10), 'g'), chr(10))) as raw from pages),
t as (select page_id, regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g') as line from l)
select page_id, regexp_extract(line, '^([A-Z][a-z]+)', 1) as number, length(line) as size, case when length(line) <= 60 and regexp_matches(line, '^[A-Z][a-z]+ ') and not regexp_matches(line, '(?:\.|,|;|:)$') then 1 else 2 end as level
from t where line <> '' and length(line) <= 60""")
def heading_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines by shape, with ASCII rules; plan_headings and standard_headings run the grammars."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.regexp_replace("html", "<(?:h[1-6]|p|li|title|div)[^>]*>", "\n"), "\n")).alias("raw"))
    line = T.strip(F.regexp_replace("raw", "<[^>]*>", ""))
    rows = rows.select("page_id", line.alias("line")).where((F.col("line") != "") & (F.length("line") <= 60))
    title = F.regexp_like("line", F.lit("^[A-Z][a-z]+ ")) & ~F.regexp_like("line", F.lit(r"(?:\.|,|;|:)$"))
    return rows.select("page_id", F.regexp_extract("line", "^([A-Z][a-z]+)", 1).alias("number"), F.length("line").cast("long").alias("size"), F.when(title, 1).otherwise(2).alias("level"))


@query("""
with n as (select l_orderkey, l_linenumber, (1 + l_orderkey % 9) || '.' || (1 + l_partkey % 9) || '.' || l_linenumber as article from lineitem),
h as (select distinct (1 + l_orderkey % 9) || '.' || (1 + l_partkey % 5) as section from lineitem)
select l_orderkey, l_linenumber, article, section from n left join h on starts_with(article, section || '.')""")
def article_number_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and the section whose number is a prefix of theirs."""
    lines = table(spark, sf_dir, "lineitem")
    part = lambda n: (1 + F.col("l_partkey") % n).cast("string")
    chapter = (1 + F.col("l_orderkey") % 9).cast("string")
    said = F.concat(F.concat_ws(".", chapter, part(9), F.col("l_linenumber").cast("string")), F.lit(" text"))
    articles = lines.select("l_orderkey", "l_linenumber", T.article_start(said)["number"].alias("article")).withColumn("section", F.substring_index("article", ".", 2))
    sections = lines.select(F.concat_ws(".", chapter, part(5)).alias("section")).distinct().withColumn("known", F.lit(True))
    out = articles.join(sections, "section", "left")
    return out.select("l_orderkey", "l_linenumber", "article", F.when(F.col("known") & T.number_prefix(F.col("article"), F.col("section")), F.col("section")).alias("section"))


@query("""
select doc_id, 'candidate_' || sha256('{"doc_id":' || doc_id || ',"identity_version":"v1","lang":' || to_json(lang) || ',"source":' || to_json(source) || ',"text_sha256":"' || sha256(text) || '"}') as content_id from documents""")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identities by canonical JSON."""
    fields = {"identity_version": F.lit("v1"), "doc_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source"), "text_sha256": ids.text_hash(F.col("text"))}
    return table(spark, sf_dir, "documents").select("doc_id", ids.canonical_id("candidate_", fields).alias("content_id"))


#: A line of a standard for each part number, so that the documents made of an order's items have headings of all kinds.
SCRIPT = ("目 录", "1 总则.....1", "1 总则", "1.0.1 为了安全", "", "附录 A", "A.0.1 检验", "条文说明", "起草说明", "正文部分", "废止的条文", "一、旧条", "第一", "章 总则", "2.0.1 一般规定", "普通文字")
_SHAPE = lambda t, *kinds: "(" + " or ".join(f"regexp_matches(coalesce({t}, ''), '{R.SHAPES[k]}')" for k in kinds) + ")"
_AHEAD = lambda *kinds: "(" + " or ".join(_SHAPE(f"a{i}", *kinds) for i in (1, 2, 3)) + ")"


@query(f"""
with recursive l as (select l_orderkey // 8 as doc, row_number() over (partition by l_orderkey // 8 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as pos, {list(SCRIPT)}[1 + l_partkey % {len(SCRIPT)}] as t from lineitem),
n as (select *, lead(t, 1) over w as a1, lead(t, 2) over w as a2, lead(t, 3) over w as a3 from l window w as (partition by doc, t = '' order by pos)),
f as (select doc, pos, t = '' as blank, {_SHAPE("t", "toc")} as toc, {_SHAPE("t", "toc_entry")} as entry, {_SHAPE("t", "normative")} as normative, {_SHAPE("t", "drafting")} as drafting,
  {_SHAPE("t", "explanation")} and {_AHEAD("chapter", "article")} as explanation, ({_SHAPE("t", "repealed")} or {_SHAPE("t || coalesce(a1, '')", "repealed_intro")}) and {_AHEAD("article", "repealed_item")} as repealed,
  ({_SHAPE("t", "root")} or {_SHAPE("t || coalesce(a1, '')", "root")}) and {_AHEAD("article")} as root, {_SHAPE("t", "appendix")} and a1 is not null and ({_SHAPE("a1", "appendix_article")} or not {_SHAPE("a1", "toc_entry")}) as appendix,
  {_SHAPE("t", "article")} or ({_SHAPE("t", "chapter")} and {_AHEAD("article")}) as opening from n),
s as (select distinct doc, 0::bigint as pos, 'FRONT_MATTER' as state, false as waits, false as listed, false as seen from f union all
  select f.doc, f.pos, case when toc or blank or entry then state when normative or drafting then 'OTHER' when explanation then 'EXPLANATION'
      when repealed and state in ('FRONT_MATTER', 'NORMATIVE_BODY') then 'REPEALED_LIST' when root and (waits or state in ('FRONT_MATTER', 'REPEALED_LIST')) then 'NORMATIVE_BODY' when root and state = 'APPENDIX' then 'OTHER'
      when appendix and state = 'NORMATIVE_BODY' then 'APPENDIX' when opening and not seen and state = 'FRONT_MATTER' then 'NORMATIVE_BODY' else state end,
    case when toc or blank or entry then waits when normative then true when drafting or explanation or root then false else waits end,
    toc or (listed and (blank or entry)), seen or toc from s join f on f.doc = s.doc and f.pos = s.pos + 1)
select doc, pos, case when listed then 'FRONT_MATTER' else state end as region from s where pos > 0""")
def standard_region_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of standards, whose lines follow SCRIPT by part number."""
    at = Window.partitionBy("doc").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").withColumn("doc", F.floor(F.col("l_orderkey") / 8))
    said = F.element_at(F.array(*map(F.lit, SCRIPT)), (F.col("l_partkey") % len(SCRIPT) + 1).cast("int"))
    lines = items.select("doc", F.row_number().over(at).cast("long").alias("pos"), said.alias("line"))
    return R.standard_regions(lines, "doc", ["pos"]).select("doc", "pos", "region")


@query("""
select doc_id, chunk, case when chunk = 0 then '[page 1]' || chr(10) || substr(text, 1, 3990) else '[page 1 continued]' || chr(10) || substr(text, 3991 + (chunk - 1) * 3980, 3980) end || chr(10) as content
from (select doc_id, coalesce(text, '') as text, unnest(range(0, 1 + cast(ceil(greatest(0, length(coalesce(text, '')) - 3990) / 3980.0) as bigint))) as chunk from documents)""")
def chunked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each one page, cut into chunks of at most 4,000 characters with page marks."""
    pages = table(spark, sf_dir, "documents").withColumn("page", F.lit(1))
    return S.chunk_pages(pages, "doc_id", "page", 4000)


@query("select event_id, lag(event_type) over w as prev, event_type || case when right(event_type, 1) = left(lead(event_type) over w, 1) then substr(lead(event_type) over w, 2) else coalesce(lead(event_type) over w, '') end as joined from events window w as (partition by user_id order by ts, event_id)")
def overlap_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring titles joined with their overlap written once (here of one character)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = F.coalesce(F.lead("event_type").over(w), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_type").over(w).alias("prev"), S.overlap_join(F.col("event_type"), after, 1).alias("joined"))
