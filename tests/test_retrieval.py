import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions import quantize
from kestrel.functions.distance import distance, kind_of, saturated, similarity, vector
from kestrel.operators import ann, measures, text
from kestrel.operators.filters import Restriction, where
from kestrel.plans import catalog
from kestrel.sources import datasets
from kestrel.streaming import merge

SIMILAR = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [2.0, 0.0, 0.0])]


def vectors(spark, rows=SIMILAR):
    return spark.createDataFrame(rows, "pk int, v array<float>")


def ids(df, key="pk"):
    return [r[key] for r in df.collect()]


@pytest.mark.parametrize(("kind", "k", "want"), [("EUCLIDEAN", 1, [1]), ("COSINE", 2, [1, 4]), ("DOT_PRODUCT", 1, [4])])
def test_metrics(spark, kind, k, want):
    assert ids(ann.search(vectors(spark), "v", ["pk"], [1, 0, 0], k, kind)) == want


def test_scores(spark):
    df = vectors(spark, [(1, [0.0]), (2, [1.0]), (3, [3.0])])
    rows = ann.search(df, "v", ["pk"], [0], 3, "EUCLIDEAN").collect()
    assert [r.distance for r in rows] == [0, 1, 9]
    assert [r.similarity_score for r in rows] == [1, 0.5, 0.1]


def test_hamming_nan_zero_and_zero_norm(spark):
    df = vectors(spark, [(1, [0.5, float("nan"), -1.0])])
    assert df.select(distance("HAMMING", F.col("v"), vector([1, 0, 0]))).head()[0] == 0
    assert vectors(spark, [(1, [0.0])]).select(distance("COSINE", F.col("v"), vector([1]))).head()[0] == 1
    assert df.select(similarity("HAMMING", F.lit(25.0), 100)).head()[0] == 0.75
    assert spark.range(1).select(saturated(F.lit(float("-inf")))).head()[0] == -3.4028234663852886e38
    assert (kind_of("euclidean"), kind_of("x"), kind_of(None)) == ("EUCLIDEAN", "COSINE", "COSINE")


def test_nulls_limits_and_dimensions(spark):
    df = vectors(spark, [(1, None), (None, [1.0]), (2, [1.0]), (3, [1.0, 2.0])])
    assert ids(ann.search(df, "v", ["pk"], [1], 10, "EUCLIDEAN")) == [2]
    with pytest.raises(ValueError):
        ann.search(df, "v", ["pk"], [1], 0)
    with pytest.raises(ValueError):
        ann.search(df, "v", ["pk"], [1, 2], 1, dimension=3)


def test_filtered(spark):
    df = spark.createDataFrame([(i // 10, i % 10, i, [float(i)] * 3) for i in range(100)], "pk int, ck int, f int, v array<float>")

    def got(*r):
        return {(x.pk, x.ck) for x in ann.search(df, "v", ["pk", "ck"], [1, 2, 3], 100, "EUCLIDEAN", r).collect()}

    every = {(i // 10, i % 10) for i in range(100)}
    both = ("pk", "ck")
    assert got(Restriction("pk", "==", 3), Restriction("ck", ">", 7)) == {(3, 8), (3, 9)}
    assert got(Restriction("f", "IN", [1, 50])) == {(0, 1), (5, 0)}
    for op, f in (("<", lambda t: t < (3, 4)), ("<=", lambda t: t <= (3, 4)), (">", lambda t: t > (3, 4)), (">=", lambda t: t >= (3, 4)), ("==", lambda t: t == (3, 4))):
        assert got(Restriction(both, op, (3, 4))) == {t for t in every if f(t)}
    assert got(Restriction(both, "IN", [(3, 4), (9, 9)])) == {(3, 4), (9, 9)}
    with pytest.raises(ValueError):
        got(Restriction("nothing", "==", 1))
    with pytest.raises(ValueError):
        got(Restriction(both, "==", (1,)))
    with pytest.raises(ValueError):
        got(Restriction("f", "==", None))


def test_comparisons_that_never_hold(spark):
    df = spark.createDataFrame([(True, float("nan"), None, 2), (False, 1.0, 3, 2)], "b boolean, d double, y int, x int")
    assert where(df, [Restriction("b", "==", True)]).count() == 0
    assert where(df, [Restriction("d", ">", 0.0)]).count() == 1
    assert where(df, [Restriction(("x", "y"), ">", (1, 3))]).count() == 2  # the first pair decides
    assert where(df, [Restriction(("x", "y"), ">", (2, 1))]).count() == 1


def test_batch_partition_ivf(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(a) for a in r], i % 3) for i, r in enumerate(x)], "id long, v array<double>, part int")
    q = df.where("id < 7").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = {(r.q, r["rank"]): r.id for r in ann.batch(df, "v", "id", q, "q", "qv", 4, "EUCLIDEAN").collect()}
    for i in range(7):
        assert [got[i, k + 1] for k in range(4)] == list(np.argsort(((x - x[i]) ** 2).sum(1))[:4])
    assert ann.batch(df, "v", "id", q.limit(0), "q", "qv", 4).count() == 0
    assert ann.per_partition(df, "v", ["id"], "part", list(x[0]), 2, "EUCLIDEAN").count() == 6
    index = ann.InvertedFile.build(df, "v", "id", str(tmp_path / "ivf"), 8)
    hits = sum(len(set(ids(index.search(spark, list(x[i]), 10, 6), "id")) & set(np.argsort(((x - x[i]) ** 2).sum(1))[:10])) for i in range(10))
    assert hits >= 90


def test_registered_ivf_finds_every_neighbour(spark, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(21)
    x = rng.normal(size=(700, 64)).astype(np.float32)
    x[:200] = x[0] + 0.05 * x[:200]  # a tight group
    rows = [(i, [float(a) for a in v], i % 10) for i, v in enumerate(x)]
    spark.createDataFrame([*rows, (700, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in __spark_entry__.queries()["ann_ivf"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.distance)
    x = x.astype(float)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(d, 1, kind="stable")[:, :10]
    assert sorted(got) == list(range(0, 700, 50))
    for q in got:
        assert [got[q][k][0] for k in range(1, 11)] == near[q].tolist()
        assert [got[q][k][1] for k in range(1, 11)] == pytest.approx(d[q, near[q]].tolist(), abs=1e-6)


def test_an_index_is_built_from_tasks_without_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    rows = spark.sparkContext.parallelize([(i, [float(a) for a in v]) for i, v in enumerate(x)], 45)  # a third has none
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = ann.InvertedFile.build(df, "v", "id", str(tmp_path / "ivf"), 3)
    asked = df.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = {(r.q, r["rank"]): r.id for r in index.search_all(asked, "q", "qv", 4).collect()}
    for i in (0, 10, 20):
        assert [got[i, k + 1] for k in range(4)] == list(np.argsort(((x - x[i]) ** 2).sum(1))[:4])
    assert index.near(asked, "q", "qv", 4, 3).count() == 12


@pytest.mark.parametrize("name", ["recall_at_k", "recall_summary"])
def test_recall_over_splits_without_rows(spark, tmp_path, name):
    import __spark_entry__

    x = np.random.default_rng(6).normal(size=(300, 64))
    spark.createDataFrame([(i, [float(a) for a in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, "8k")
        got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)
    assert (len(got), got[0]["queries"] if name == "recall_summary" else 6) == (6 if name == "recall_at_k" else 1, 6)
    assert got[0]["recall_avg"] >= 0.9 if name == "recall_summary" else np.mean([r["recall"] for r in got]) >= 0.9


def test_recall_over_odd_vectors(spark, tmp_path):
    import __spark_entry__

    x = np.random.default_rng(7).normal(size=(120, 8)).tolist()
    odd = [(1000, []), (1050, []), (1001, [float("inf"), *x[0][1:]]), (1002, None), (1003, x[0][:3])]
    for name, rows in (("odd", [*enumerate(x), *odd]), ("none", [])):
        spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / name / "embeddings.parquet"))
    run = lambda query, name: __spark_entry__.queries()[query](spark, str(tmp_path / name)).collect()
    got = run("recall_at_k", "odd")
    assert sorted(r["query_id"] for r in got) == [0, 50, 100] and np.mean([r["recall"] for r in got]) >= 0.9
    assert run("recall_at_k", "none") == [] and run("ann_ivf", "none") == []


def test_recall_after_the_index_is_gone(spark, tmp_path):
    import __spark_entry__
    from kestrel import queries
    from kestrel.session import drop_path

    x = np.random.default_rng(8).normal(size=(60, 8)).tolist()
    spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    drop_path(spark, queries._index(spark, str(tmp_path))[1].path)
    assert __spark_entry__.queries()["recall_summary"](spark, str(tmp_path)).head()["queries"] == 2


def test_a_text_search_after_the_index_is_gone(spark, tmp_path):
    import __spark_entry__
    from kestrel import queries
    from kestrel.session import drop_path

    spark.createDataFrame([(1, "que es"), (2, "die hand"), (3, "nada")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    drop_path(spark, queries.fts(spark, str(tmp_path)).root)
    assert sorted(r["doc_id"] for r in __spark_entry__.queries()["bm25_or"](spark, str(tmp_path)).collect()) == [1, 2]


def test_quantization(spark):
    q = np.array([0.5, 0.3, 0.7])
    rows = [(i, [float(v) for v in q + i * 0.001 * np.array([2, 4, 8])]) for i in range(500)]
    df = vectors(spark, rows)
    assert ids(ann.search(df, "v", ["pk"], list(q), 100, "EUCLIDEAN")) == list(range(100))
    assert ids(ann.rescored(df, "v", ["pk"], list(q), 20, "EUCLIDEAN", 5.0)) == list(range(20))
    assert vectors(spark, [(1, [0.9, 0.1, 0.1])]).select(distance("EUCLIDEAN", quantize.i8(F.col("v")), vector([127, 0, 0]))).head()[0] == 507
    one = vectors(spark, [(1, [0.5, 0.0, -1.0]), (2, None)])
    assert [r[0] for r in one.select(quantize.b1(F.col("v"))).collect()] == [b"\x01", None]
    assert one.select(quantize.f16(F.col("v"))).head()[0] == [0.5, 0.0, -1.0]
    assert vectors(spark, [(1, [1.00390625])]).select(quantize.bf16(F.col("v"))).head()[0] == [1.0]
    assert quantize.metric_for("COSINE", "B1") == "HAMMING"
    with pytest.raises(ValueError):
        quantize.metric_for("HAMMING", "F32")


DOCS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a slow turtle walks through the garden"), (3, "the fox runs across the meadow")]


@pytest.mark.parametrize(
    ("query", "want"),
    [("fox", {1, 3}), ("FOX", {1, 3}), ("the fox", {1, 3}), ("fox AND meadow", {3}), ("fox OR turtle", {1, 2, 3}), ("fox turtle", {1, 2, 3}), ("fox NOT meadow", {1}), ('"quick brown fox"', {1}),
     ('"jumps over the lazy"', {1}), ("(fox OR turtle) AND meadow", {3}), ("the", set()), ("zebra", set()), ("NOT fox", set()), ("", set())],
)
def test_text_queries(spark, query, want):
    df = spark.createDataFrame([*DOCS, (4, None), (5, "")], "pk int, content string")
    assert set(ids(text.bm25(df, "content", "pk", query, 10))) == want


def test_text_ranking_limits_and_errors(spark):
    df = spark.createDataFrame([(1, "fox fox fox jumps"), (2, "fox runs across the meadow"), (3, "turtle")], "pk int, content string")
    assert ids(text.bm25(df, "content", "pk", "fox", 10)) == [1, 2]
    assert ids(text.bm25(df, "content", "pk", "fox", 1)) == [1]
    for bad in ("(fox", "fox AND", '"fox', "fox)", "OR"):
        with pytest.raises(ValueError):
            text.bm25(df, "content", "pk", bad, 1)
    with pytest.raises(ValueError):
        text.bm25(df, "content", "pk", "fox", 0)
    assert spark.createDataFrame([("Café Über, naïve Straße! the",)], "t string").select(text.analyzed(F.col("t"))).head()[0] == ["café", "über", "naïve", "straße"]


def test_newest_cell_wins_in_any_order(spark, tmp_path):
    rows = [(1, 100, 1, "a", 5, False), (1, 50, 2, "old", None, False), (1, 150, 3, None, 7, False), (2, 10, 4, "x", 1, False), (2, 20, 5, None, None, True), (2, 15, 6, "late", 2, False), (None, 9, 7, "n", 1, False), (3, 5, 9, "tie2", 1, False), (3, 5, 8, "tie1", 2, False)]
    schema = "k int, ts long, id int, c string, d int, gone boolean"
    want = {(1, "a", 7), (2, None, None), (3, "tie1", 2)}
    random.Random(1).shuffle(rows)
    got = merge.latest(spark.createDataFrame(rows, schema), ["k"], ["c", "d"], "ts", "id", "gone")
    assert {(r.k, r.c, r.d) for r in got.collect()} == want
    # The stream gives what the batch gives, and a replay changes nothing.
    for i in range(3):
        spark.createDataFrame(sorted(rows, key=lambda r: r[2])[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    snapshot = merge.Snapshot(["k"], ["c", "d"], "ts", "id", "gone")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    snapshot.start(stream, str(tmp_path / "check")).awaitTermination()
    first = {(r.k, r.c, r.d) for r in spark.read.parquet(snapshot.path).collect()}
    assert {x for x in first if x[0] != 3} == {x for x in want if x[0] != 3}
    snapshot.apply(spark.createDataFrame(rows, schema), 99)
    assert {(r.k, r.c, r.d) for r in spark.read.parquet(snapshot.path).collect()} == first


def test_classify_and_unrepeated(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 4)], "k int, v int")
    b = spark.createDataFrame([(1, 1), (2, 5), (3, 3), (4, None), (6, 6)], "k int, v int")
    assert {(r.k, r.op) for r in merge.classify(a, b, ["k"], "v").collect()} == {(2, "update"), (3, "insert"), (4, "remove"), (6, "insert")}
    c = spark.createDataFrame([(1, 1, "u", 1), (1, 1, "u", 2), (1, 2, "u", 3), (None, 2, "u", 4)], "k int, ts int, op string, id int")
    assert merge.unrepeated(c, ["k"], "ts", "op", "id").count() == 2


def test_catalog():
    assert catalog.parse_target('{"tc": "v", "pk": ["a"], "fc": ["f"]}') == (("v",), ("a",), ("f",))
    assert catalog.parse_target("v") == (("v",), (), ())
    assert catalog.parse_dimension("vector<float, 3>") == 3
    assert catalog.parse_options({"similarity_function": "dot_product", "construction_beam_width": "x"})["metric"] == "DOT_PRODUCT"
    assert (catalog.kind_of_class(None), catalog.kind_of_class("fulltext_index"), catalog.kind_of_class("x")) == ("vector", "fulltext", None)
    glob = catalog.Index("k", "g", "t", ("pk", "ck"), ("v",), filtering=("f",))
    local = catalog.Index("k", "l", "t", ("pk", "ck"), ("v",), partition=("pk",))
    best = lambda r, **x: catalog.best_index([glob, local], "k", "t", ["v"], r, **x).name
    assert best([]) == "g"
    assert best([Restriction("pk", "==", 1)]) == "l"
    with pytest.raises(ValueError):
        best([Restriction("f", "==", 1)])
    assert best([Restriction("f", "==", 1)], allow_filtering=True) == "g"
    with pytest.raises(catalog.NoGlobalIndex):
        catalog.best_index([local], "k", "t", ["v"], [])
    with pytest.raises(catalog.NotFound):
        catalog.best_index([local], "k", "t", ["w"], [])
    assert catalog.changes([glob], [local]) == ({glob}, {local})


def test_coercion():
    assert catalog.coerce(5, "integer") == 5
    assert catalog.coerce("2023-10-01 08:12:54.213", "timestamp") == datetime(2023, 10, 1, 8, 12, 54, 213000)
    assert catalog.coerce("T08:12:54.2137", "time") == 29574213700000
    assert str(catalog.coerce("-98765432109876543210", "decimal(38,0)")) == "-98765432109876543210"
    assert catalog.to_json(catalog.coerce("0xdeadbeef", "binary")) == "0xdeadbeef"
    for value, kind in ((1 << 31, "integer"), (True, "integer"), (None, "string"), ([1], "string"), ("x", "date"), (1e300, "float"), ("1", "boolean")):
        with pytest.raises(ValueError):
            catalog.coerce(value, kind)


def test_measures(spark):
    r = spark.createDataFrame([(1, [1, 2, 3], [1, 9]), (2, [1], [])], "q int, f array<int>, t array<int>")
    assert [x[0] for x in r.orderBy("q").select(measures.recall(F.col("f"), F.col("t"), 3)).collect()] == [0.5, 1.0]
    results = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "q int, rank int, d int")
    grades = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (2, 5, 1)], "q int, d int, grade int")
    one, two = measures.ranking(results, grades, "q", "d", 2).orderBy("q").collect()
    assert (one.precision, one.recall, one.rr, round(one.ndcg, 2)) == (1, 1, 1, 0.71)
    assert (two.precision, two.recall, two.rr, two.ndcg) == (0, 0, 0, 0)


def test_datasets(spark, tmp_path):
    p = str(tmp_path / "x.fbin")
    datasets.write_vectors_binary([[1.5, 2.0], [3.0, 4.0]], p)
    assert [(r.id, r.emb) for r in datasets.vectors_binary(spark, p).orderBy("id").collect()] == [(0, [1.5, 2.0]), (1, [3.0, 4.0])]
    (tmp_path / "t.txt").write_text("1, 7, [1.0, 2.5]\n\n2, 8, [3, 4]\n")
    assert [(r.id, r.bucket, r.emb) for r in datasets.vectors_text(spark, str(tmp_path / "t.txt"), True).collect()] == [(1, 7, [1.0, 2.5]), (2, 8, [3.0, 4.0])]
    b = str(tmp_path / "buckets.bin")
    datasets.write_buckets([(5, 0), (-1, 3)], b)
    assert [(r.id, r.bucket) for r in datasets.read_buckets(spark, b).collect()] == [(5, 0), (-1, 3)]
    assert len(datasets.buckets(1001)) == 1001 and sum(b < 0 for b in datasets.buckets(1001)) > 100
    assert datasets.format_of(str(tmp_path)) == "parquet"
    blob = spark.createDataFrame([(b"\x05" + np.array([1.5], ">f4").tobytes(),), (b"\x04" + json.dumps({"L": [{"N": "2.5"}]}).encode(),), (b"\x09",), (None,)], "b binary")
    assert [r[0] for r in blob.select(datasets.decoded(F.col("b"))).collect()] == [[1.5], [2.5], None, None]


def test_entry_without_the_subpackage(spark):
    import __spark_entry__

    assert "ann_euclidean_topk" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
