"""Stores, sinks, providers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import pages, providers, report, store
from quern.streaming import sessions


def test_store_and_listing(spark, tmp_path):
    s = store.StandardStore(spark, str(tmp_path))
    docs = spark.createDataFrame([("s1", "A", "1", "1", "2024-01-01"), ("s2", "B", "1", "2", "2024-02-01")], "standard_id string, name string, parser_version string, semantics_version string, created_at string")
    s.write("documents", docs)
    s.write("articles", spark.createDataFrame([("s1", "6.1.1"), ("s1", "6.1.2")], "standard_id string, number string"))
    s.write("articles", spark.createDataFrame([("s2", "1.0.1")], "standard_id string, number string"))
    assert [(r.standard_id, r.n_articles) for r in s.listing().collect()] == [("s2", 1), ("s1", 2)]
    assert s.read("articles", ["s2"]).count() == 1
    assert s.has_fields("articles", ["number"])
    assert not s.has_fields("articles", ["missing"])
    assert not s.has_fields("chapters", ["number"])
    assert [r.standard_id for r in s.compatible("1", "1").collect()] == ["s1"]
    assert s.unknown(spark.createDataFrame([("s9",), ("s1",)], "standard_id string")).first().standard_id == "s9"


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert store.append_once(spark, path, rows, "k").count() == 0
    again = spark.createDataFrame([("b", "2"), ("b", "3"), ("c", "4")], "k string, v string")
    assert [r.k for r in store.append_once(spark, path, again, "k").collect()] == ["b"]
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", "1"), ("b", "2"), ("c", "4")]


def test_cached_computes_only_what_is_new(spark, tmp_path):
    path, seen = str(tmp_path / "derived"), []

    def compute(df):
        seen.append(df.count())
        return df.select("k", F.upper("v").alias("u"))

    one = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    two = spark.createDataFrame([("a", "x"), ("b", "z")], "k string, v string")
    assert sorted(r.u for r in store.cached(spark, path, one, "k", "1", compute).collect()) == ["X", "Y"]
    assert sorted(r.u for r in store.cached(spark, path, two, "k", "1", compute).collect()) == ["X", "Z"]
    assert seen == [2, 1]


def test_reports(spark):
    items = spark.createDataFrame([(1, "<b>", None), (2, "ok", "说明")], "id int, name string, note string")
    rows = report.rows_of(items, ["id"])
    name, content = report.render_json({"findings": rows, "gaps": []})
    assert name == report.render_json({"gaps": [], "findings": rows})[0]
    assert json.loads(content)["findings"][1]["note"] == "说明"
    page = report.render_html("报告", {"findings": rows, "gaps": []})[1].decode()
    assert "&lt;b&gt;" in page
    assert "No items." in page
    with pytest.raises(ValueError, match="at most"):
        report.rows_of(spark.range(3000), ["id"])


def test_pages_and_providers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-one\ftwo")
    docs = pages.binary_documents(spark, str(tmp_path))
    assert {r.name: r.fits for r in docs.collect()} == {"a.pdf": True}
    got = pages.extract_pages(docs, lambda b: [(i + 1, t, 0, 0.0) for i, t in enumerate(b.decode().split("\f"))])
    assert [(r.page_number, r.text) for r in got.orderBy("page_number").collect()] == [(1, "%PDF-one"), (2, "two")]
    assert pages.unreadable(docs, got).count() == 0
    assert {r.reason for r in pages.unreadable(docs, got.limit(0)).collect()} == {"UNREADABLE"}
    assert pages.documents_of(got).first().text == "%PDF-one\ntwo"
    chunks = spark.createDataFrame([(1, "x")], "id int, content string")
    assert providers.complete(chunks, "id").count() == 0
    answered = providers.complete(chunks, "id", lambda c: 'text ```json\n{"a": 1}\n``` more')
    assert answered.select(providers.parse_object(F.col("answer"), "a int").alias("o")).first().o.a == 1
    vectors = providers.embed(chunks, "content", lambda ts: [[1.0, 2.0] for _ in ts], 2)
    assert vectors.first().embedding == [1.0, 2.0]


def test_image_coverage(spark):
    images = spark.createDataFrame([("d", 1, 7, 5.0, 10.0), ("d", 1, 7, 5.0, 10.0), ("d", 1, 8, 10.0, 10.0)], "document_id string, page_number int, xref int, width double, height double")
    area = spark.createDataFrame([("d", 1, 100.0), ("d", 2, 100.0)], "document_id string, page_number int, area double")
    assert [(r.image_count, r.coverage) for r in pages.image_coverage(images, area).orderBy("page_number").collect()] == [(2, 1.0), (0, 0.0)]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df in (("s", sessions.session_stream(stream, "user_id", "ts")), ("c", sessions.consistency_stream(stream, ["user_id"], "value", "ts"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0


def test_manifests_are_strict(spark, tmp_path):
    import hashlib

    from quern.sources import manifest as MF

    content = '{"b": [1, "é"], "a": {"x": null}}'.encode()
    (tmp_path / "m.json").write_bytes(content)
    digest = hashlib.sha256(content).hexdigest()
    got = MF.load_manifest(spark, str(tmp_path / "m.json"), digest)
    assert got == {"b": [1, "é"], "a": {"x": None}}
    assert MF.canonical_sha256(got) == hashlib.sha256('{"a":{"x":null},"b":[1,"é"]}'.encode()).hexdigest()
    for bad, pin in ((content, "0" * 64), (b'{"a": 1, "a": 2}', None), (b'{"a": NaN}', None), (b"[1]", None), (b"\xff", None), (b"{", None)):
        with pytest.raises(MF.ManifestError):
            MF.parse_manifest(bad, pin)
    with pytest.raises(MF.ManifestError):
        MF.load_manifest(spark, str(tmp_path / "m.json"), most=3)


def test_bodies_of_headings(spark):
    from quern.operators import workitems as W

    rows = [("一、甲", "甲", 1), ("第一行", None, None), ("1.1 乙", "乙", 2), ("第二行", None, None), ("二、丙", "丙", 1), ("第三行" * 200, None, None), ("第四行", None, None)]
    lines = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc string, seq int, line string, t string, l int")
    got = {r.title: r.body for r in W.bodies(lines, "doc", "seq", F.col("t"), F.col("l")).collect()}
    assert got == {"甲": "第一行\n第二行", "乙": "第二行", "丙": ("第三行" * 200)[:300]}
