"""Every query of the engine against its SQL twin, and for a stable result under another partitioning."""

import pytest
from compare import rows, same

import __spark_entry__
from quern.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, oracle, name):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), oracle(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).toPandas() is not None


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "doc_id", "score", "rank"]
    assert out.count() > 0


def test_driver_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(catalog.QUERIES) >= 70


@pytest.mark.parametrize("name", ["region_islands", "article_sessions", "consistency_groups", "title_vote", "argmax_dedupe", "hybrid_rrf"])
def test_result_does_not_depend_on_partitions(spark, sf_dir, name):
    before = rows(catalog.QUERIES[name](spark, sf_dir).toPandas())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(catalog.QUERIES[name](spark, sf_dir).toPandas()) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_cosine_search_in_blocks(spark, monkeypatch):
    """Blocks, ties, repeated ids, nulls, NaN, zeros and other lengths against all pairs in Spark's own arithmetic."""
    import random

    from quern.operators import retrieval as R

    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 60)
    rng, nan = random.Random(5), float("nan")
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], i % 4) for i in range(300)]
    rows += [(7, [1.0, 2.0, 0.0], 1), (300, None, 1), (310, [1.0, None, 2.0], 2), (320, [0.0, 0.0, 0.0], 2), (330, [nan, 1.0, 1.0], None), (340, [1e38, 1.0, 1.0], 3), (350, [1.0, 2.0], 0), (351, [1.0, 2.1], 0), (352, [], 0), (None, [1.0, 1.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = vectors.where("vec_id % 10 = 0 or vec_id = 7").selectExpr("vec_id as query_id", "embedding as query")
    double = "cast({} as array<double>)"
    a, b = double.format("embedding"), double.format("query")
    total = lambda x: f"aggregate({x}, 0d, (s, x) -> s + x)"
    norm = lambda x: f"sqrt({total(f'transform({x}, x -> x * x)')})"
    score = f"round({total(f'zip_with({a}, {b}, (x, y) -> x * y)')} / nullif({norm(a)} * {norm(b)}, 0d), 6) as score"
    pairs = vectors.crossJoin(queries).where("vec_id <> query_id").selectExpr("query_id", "vec_id", score).where("score > 0")
    pairs.createOrReplaceTempView("pairs_of_vectors")
    ranked = spark.sql("select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs_of_vectors").where("rank <= 5")
    # 7 is there twice: its equal rows are alike but for the order of their scores.
    key = lambda df: sorted((str(r["query_id"]), r["rank"], r["vec_id"], str(r["score"])) for r in df.collect())
    got = R.vector_top(vectors, queries, 5)
    assert key(got) == key(ranked)

    ranks = got.withColumnRenamed("vec_id", "item")
    asked = vectors.where("vec_id % 10 = 0 or vec_id = 7").selectExpr("vec_id as query_id", "label")
    relevant = vectors.join(asked, "label").where("vec_id <> query_id").selectExpr("query_id", "vec_id as item")
    by_label = R.label_metrics(ranks, vectors.selectExpr("vec_id as item", "label"), asked)
    assert by_label.collect() == R.ranking_metrics(ranks, relevant).collect()


def test_search_and_metrics_list_no_pairs(spark, sf_dir):
    """Neither pairs of vector and query nor pairs of equal label are rows of the plan."""
    import __spark_entry__

    plan = __spark_entry__.queries()["retrieval_metrics"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "__queries" not in plan and "NOT (vec_id" not in plan


def test_metrics_ask_for_every_vector(spark, tmp_path):
    """Figures of search quality come from all vectors as queries, not from the ids that 100 divides, in the query and in its SQL."""
    import duckdb

    up, right = [1.0, 0.1], [0.1, 1.0]
    rows = [(1, up, 0), (2, up, 0), (3, right, 0), (4, right, 1), (100, up, 1), (7, up, None), (8, None, 0), (None, up, 0), (9, right, 5), (9, up, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/three/embeddings.parquet")
    query, sql = (x["retrieval_metrics"] for x in (__spark_entry__.queries(), __spark_entry__.oracle_sql()))
    for at in (tmp_path, tmp_path / "three"):
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from read_parquet('{at}/embeddings.parquet/*.parquet')")
        same(query(spark, str(at)).toPandas(), con.execute(sql).df())
    # Vectors 1 and 2 find each other first, then 3; vector 3 finds both at ranks 1 and 2.
    assert query(spark, str(tmp_path / "three")).first().asDict() == {"recall_1": 0.5, "recall_3": 1.0, "recall_5": 1.0, "recall_10": 1.0, "mrr": 1.0}


def test_cosine_search_in_slices(monkeypatch):
    """Ties, repeated ids, NaN, zeros and numbers out of range do not depend on slices; all pairs beside them."""
    import numpy as np

    from quern.operators import retrieval as R

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (230, 3)).astype(float)
    v[100:180] = v[100]
    v[[5, 50, 200]] = [[np.nan, 1, 1], [0, 0, 0], [1e150, 2e150, 0]]
    code = rng.permutation(np.arange(230) // 2 * 2)
    with np.errstate(all="ignore"):
        dot = sum(a[:, None] * b[None] for a, b in zip(v.T, v.T, strict=True))
        size = R._norms(v)[:, None] * R._norms(v)[None]
        score = R._half_up((dot / size).ravel(), 6).reshape(dot.shape)
    want = []
    for q in range(len(v)):
        hits = [(np.inf if np.isnan(score[q, i]) else score[q, i], int(code[i])) for i in range(len(v)) if code[i] != code[q] and size[q, i] != 0 and not score[q, i] <= 0]
        want += [(q, c, s) for s, c in sorted(hits, key=lambda x: (-x[0], x[1]))[:10]]
    for queries, vectors in ((512, 2048), (7, 30), (1, 12), (100, 3)):
        monkeypatch.setattr(R, "QUERY_SLICE", queries)
        monkeypatch.setattr(R, "SLICE", vectors)
        q_in, v_in, found = R._best_pairs(v, v, code, code, 10, 6)
        got = zip(q_in.tolist(), code[v_in].tolist(), np.where(np.isnan(found), np.inf, found).tolist(), strict=True)
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("queries, vectors, want", [(0, 0, (1, 1)), (9, 5, (1, 1)), (90, 90, (6, 1)), (190, 190, (3, 2)), (1000, 1000, (10, 10)), (9, 5000, (1, 50))])
def test_blocks_of_cosine_search(monkeypatch, queries, vectors, want):
    """Blocks of queries are no more than calls need, and neither side's are longer than they may be."""
    from quern.operators import retrieval as R

    for name, n in (("QUERY_BLOCK", 10), ("VECTOR_BLOCK", 100), ("CALLS", 6)):
        monkeypatch.setattr(R, name, n)
    assert R._blocks(queries, vectors) == want


@pytest.mark.parametrize("x, digits, want", [(0.1234565, 6, 0.123457), (0.1234564999, 6, 0.123456), (0.5, 0, 1.0), (0.0000005, 6, 0.000001), (1.0000000000000002, 6, 1.0)])
def test_rounded_as_spark_rounds(spark, x, digits, want):
    import numpy as np

    from quern.operators.retrieval import _half_up

    assert _half_up(np.array([x]), digits)[0] == want == spark.range(1).selectExpr(f"round(cast('{x!r}' as double), {digits})").first()[0]
