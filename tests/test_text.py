"""Text expressions on CJK and other fixtures."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import ids
from quern.functions import spans as SP
from quern.functions import text as T


#: Published identities.
PROFILE_VERSION = "v0.1-d9-exact-profiles"
PROFILES = (
    ("object", "SUPPORT_STRUCTURE", ("支护结构",), "objectprofile_ace6c5ce26806961ddc12629ead232a4bb7761a8289c94f9ca75d92a0528102b"),
    ("parameter", "HORIZONTAL_DISPLACEMENT_ALARM_VALUE", ("水平位移", "报警值"), "parameterprofile_374c97483c9edcd901399076aee0598a0da37e7cad460dda2df2115b222c61d4"),
)


def one(spark, column, **values):
    row = spark.createDataFrame([values], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_search_form_and_tokens(spark):
    assert one(spark, T.search_form(F.col("t")), t="ＧＢ  立 杆\t间距 Abc ") == "gb 立杆间距 abc"
    assert one(spark, T.tokens(F.col("t")), t="立杆间距 1.5-2 a/b 立杆") == ["1.5-2", "a/b", "立杆间距", "立杆", "杆间", "间距", "立杆间", "杆间距"]
    assert one(spark, T.cjk_phrases(F.col("t")), t="立 a 间距 b") == ["间距"]
    assert one(spark, T.tokens(F.col("t")), t="") == []


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("第一章 工程概况", ("工程概况", 1)), ("一、编制依据", ("编制依据", 1)), ("（二）施工准备", ("施工准备", 2)), ("3.2.1 立杆搭设", ("立杆搭设", 3)), ("2、施工准备", ("施工准备", 1)),
        ("2、随便写写", None), ("应急预案", ("应急预案", 1)), ("1.1 间距为 1.5mm", None), ("一、采用钢管搭设", None), ("一、施工方法：", None), ("x" * 70, None), ("1.2 ", None),
    ],
)
def test_heading(spark, line, expected):
    got = one(spark, T.heading(F.col("t")), t=line)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    ("line", "expected"),
    [("第十二章 附则", ("12", "附则", 1)), ("附录 A 检验", ("A", "检验", 1)), ("A.1 一般规定条款", None), ("6.1 构造", ("6.1", "构造", 2)), ("1 总则", ("1", "总则", 1)), ("6.1 应符合下列要求", None), ("结束。", None)],
)
def test_standard_heading(spark, line, expected):
    got = one(spark, T.standard_heading(F.col("t")), t=line)
    if line.startswith("A.1"):
        assert got is not None
        assert got.level == 2
    else:
        assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    ("line", "expected"),
    [("6.1.2 立杆应设置", ("6.1.2", "立杆应设置")), ("第6.1.2条 立杆", ("6.1.2", "立杆")), ("a.1.2 附录", ("A.1.2", "附录")), ("2024.10.01", None), ("表 6.1.2 参数", None), ("第6.1.2条规定执行", None), ("6.1 构造", None), ("1900.1.2 x", None)],
)
def test_article_start(spark, line, expected):
    got = one(spark, T.article_start(F.col("t")), t=line)
    assert (tuple(got) if got else None) == expected


def test_dates_codes_and_decimals(spark):
    assert one(spark, T.iso_date(F.col("t")), t="2022年4月15日开工") == "2022-04-15"
    assert one(spark, T.iso_date(F.col("t")), t="2023-02-30") is None
    assert one(spark, T.standard_code(F.col("t")), t="按《规范》gb/t 50001-2017 执行") == "GB/T50001-2017"
    assert one(spark, T.standard_code(F.col("t")), t="无") is None
    for text, expected in (("30.00", "30"), ("30", "30"), ("2.50", "2.5"), ("-0.10", "-0.1")):
        assert one(spark, T.decimal_text(F.col("t").cast("decimal(38,18)")), t=text) == expected


def test_masking_keeps_offsets(spark):
    text = "按 GB 55023-2022 和 6.1.2 执行"
    got = one(spark, T.masked(F.col("t"), T.CODE), t=text)
    assert len(got) == len(text)
    assert "GB" not in got
    assert got.index("6.1.2") == text.index("6.1.2")


def test_lines(spark):
    assert one(spark, T.lines_of(F.col("t")), t="a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, T.clean_page(F.col("t")), t=" a　\t b \r\n\n\n\nc\n\n") == "a b\n\nc"
    assert one(spark, T.join_lines(F.split(F.col("t"), "\n")), t="立杆\n间距\nabc\ndef\n1. x") == "立杆间距abc def\n1. x"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from("ab ｱ①é²立。，;\n😀"), max_size=40))
def test_spans_and_nfkc_on_any_text(spark, text):
    assert one(spark, T.nfkc(F.col("t")), t=text) == unicodedata.normalize("NFKC", text)
    for s in one(spark, SP.clauses(F.col("t")), t=text):
        assert text[s.start : s.end] == s.text
        assert s.text == s.text.strip()


def test_bounded_clauses_and_windows(spark):
    long = "一" * 200 + "，" + "二" * 200 + "。短句。"
    assert [(s.start, s.end) for s in one(spark, SP.bounded_clauses(F.col("t")), t=long)] == [(0, 201), (201, 402), (402, 405)]
    text = "x" * 300 + "应" + "y" * 300
    cut = one(spark, SP.windows(F.col("t"), "应"), t=text)
    assert len(cut) == 1
    assert cut[0].end - cut[0].start == 280
    assert "应" in cut[0].text


def test_published_identities(spark):
    """Identities that the specification publishes for two profiles."""
    for kind, name, anchors, expected in PROFILES:
        fields = {"profile_version": F.lit(PROFILE_VERSION), "profile_kind": F.lit(kind), "profile_name": F.lit(name), "ordered_anchors": F.array(*map(F.lit, anchors))}
        assert spark.range(1).select(ids.canonical_id(f"{kind}profile_", fields).alias("x")).first().x == expected
