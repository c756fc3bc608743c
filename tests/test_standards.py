"""Chapters, articles, structural evidence and work items on fixtures."""

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import standards as ST
from quern.operators import structure as S
from quern.operators import workitems as WI


def test_chapters_from_contents(spark):
    pages = [
        (1, "封面"), (2, "目录\n第一章 工程概况......3\n第二章 施工方法......4"), (3, "第一章 工程概况\n正文"), (4, "第二章 施工方法\n1.1 土方开挖\n正文"), (5, "1.2 脚手架搭设\n第三章 应急预案"),
    ]
    df = spark.createDataFrame([("d", p, t) for p, t in pages], "doc string, page int, text string")
    assert [r.in_contents for r in ST.contents_pages(df, "doc", "page").orderBy("page").collect()] == [False, True, False, False, False]
    got = [(r.title, r.level, r.start_page, r.end_page) for r in ST.chapters(df, "doc", "page").orderBy("start_page", "title").collect()]
    assert ("工程概况", 1, 3, 4) in got
    assert ("施工方法", 1, 4, 5) in got
    assert ("应急预案", 1, 5, 5) in got


def test_articles_over_pages(spark):
    text = [(3, "6.1 构造"), (3, "6.1.1 立杆应设置"), (3, "6.1.2 水平杆"), (4, "应与立杆连接"), (4, "6.1.3 剪刀撑"), (4, "7 检验"), (4, "不属于条文"), (4, "2024.10.01"), (5, "6.1.2 重复")]
    df = spark.createDataFrame([("s", p, i, t, "NORMATIVE_BODY") for i, (p, t) in enumerate(text)], "doc string, page int, line_index int, line string, region string")
    got = ST.articles(df, "doc", ["page", "line_index"]).orderBy("session").collect()
    assert [(r.article_number, r.first.page, r.last.page, r.ambiguous) for r in got] == [("6.1.1", 3, 3, False), ("6.1.2", 3, 4, False), ("6.1.3", 4, 4, False), ("6.1.2", 5, 5, True)]
    assert got[1].content == "水平杆应与立杆连接"
    one = ST.article_ids(ST.articles(df, "doc", ["page", "line_index"]), F.lit("x")).collect()
    assert len({r.article_id for r in one}) == 4
    spans = ST.article_intervals(df.where("line_index < 8"), "doc", "line_index").orderBy("first").collect()
    assert [(r.article_number, r.first, r.until, r.cut) for r in spans] == [("6.1.1", 1, 2, None), ("6.1.2", 2, 4, None), ("6.1.3", 4, None, 5)]


def test_structural_gates(spark):
    fine = ("c", "c", True, "NORMATIVE_BODY", False, "6.1", "SECTION", "6.1 构造", "6.1构造", "5.9.9", "6.1.1")
    bad = [("x", *fine[1:]), (*fine[:2], False, *fine[3:]), (*fine[:3], "OTHER", *fine[4:]), (*fine[:4], True, *fine[5:]), (*fine[:6], "CHAPTER", *fine[7:]), (*fine[:8], "别的", *fine[9:]), (*fine[:10], "7.1.1"), (*fine[:9], "6.1.4", "6.1.5")]
    names = "checksum string, source_checksum string, contiguous boolean, region string, inside_article boolean, number string, kind string, text string, source_text string, previous_article string, next_article string"
    got = [r.gate for r in ST.structural_gates(spark.createDataFrame([fine, *bad], names)).collect()]
    assert got == ["RESOLVED", "CHECKSUM_MISMATCH", "SOURCE_NOT_CONTIGUOUS", "REGION_NOT_ALLOWED", "INSIDE_ARTICLE", "NUMBER_KIND_MISMATCH", "TEXT_NOT_GROUNDED", "NEXT_ARTICLE_INCOMPATIBLE", "PREVIOUS_ARTICLE_INSIDE"]


def test_bodies_and_context(spark):
    text = ["一、施工方法", "引言", "（一）土方开挖", "分层开挖", "二、计算书", "（一）立杆验算", "公式"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc string, n long, line string").withColumn("h", T.heading(F.col("line")))
    got = {r.title: r.body for r in WI.bodies(df, "doc", "n", F.col("h.title"), F.col("h.level")).collect()}
    assert got["施工方法"] == "引言\n分层开挖"
    assert got["土方开挖"] == "分层开挖"
    heads = df.where("h is not null").select("doc", F.col("n").alias("seq"), "h.title", "h.level").withColumn("parent", S.parent_position("doc", "seq", "level"))
    allowed = {r.title: r.allowed for r in WI.method_context(heads, "doc").collect()}
    assert allowed == {"施工方法": True, "土方开挖": True, "计算书": False, "立杆验算": False}


def test_source_pages(spark):
    pages = spark.createDataFrame([("d", 1, "土方开挖......3"), ("d", 2, "说明 土方 开挖 分层进行"), ("d", 3, "土方开挖")], "doc string, page_number int, text string")
    items = spark.createDataFrame([("d", 1, "土方开挖", "分层进行"), ("d", 2, "没有的", None)], "doc string, item int, name string, source_text string")
    got = {r.item: (r.page_number, r.snippet) for r in WI.source_pages(items, pages, "doc").collect()}
    assert got == {1: (2, "土方开挖分层进行"), 2: (None, None)}
    flags = {k: F.lit(False) for k in ("in_calculation", "is_chapter", "numbered", "related", "is_material")}
    rows = spark.createDataFrame([("脚手架搭设",), ("记录表",), ("某公司",), ("30 mm",), ("土方",)], "t string")
    assert [r.x for r in rows.select(WI.keep_work_item(F.col("t"), flags).alias("x")).collect()] == [True, False, False, False, True]
