"""The stored inverted index, the request path, durable snapshots, buckets and batched neighbours against plain versions."""

import itertools
import random
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import ann, measures, text
from kestrel.operators.filters import Restriction, where
from kestrel.operators.inverted import InvertedIndex
from kestrel.plans import catalog
from kestrel.plans.catalog import Index, NoGlobalIndex, NotFound, NotServing
from kestrel.plans.engine import FilteringNeeded, LocalText, Service, columns_of, exposition
from kestrel.sources import datasets, sinks
from kestrel.streaming import merge

QUERIES = ("fox", "the fox", "fox AND meadow", "fox OR turtle", "fox turtle", "fox NOT meadow", '"quick brown fox"', '"jumps over the lazy"', "(fox OR turtle) AND meadow", "the", "zebra", "NOT fox", "", '"fox fox"', "fox AND NOT quick")


def test_stored_index_gives_what_a_scan_gives(spark, tmp_path):
    rng = random.Random(2)
    words = "the quick brown fox jumps over lazy dog slow turtle walks through garden meadow".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)] + [(70, None), (71, ""), (None, "fox")]
    df = spark.createDataFrame(rows, "pk int, content string")
    index = InvertedIndex(spark, f"file://{tmp_path}/i", parts=4)
    assert index.search("fox", 3).count() == 0 and index.count() == 0
    assert index.add(df, "content", "pk") == 1 and index.count() == 61
    for q in QUERIES:
        want = [(r.pk, round(r.score, 9)) for r in text.bm25(df, "content", "pk", q, 100).collect()]
        assert [(r.key, round(r.score, 9)) for r in index.search(q, 100).collect()] == want, q
    assert {(r.term, r.df) for r in index.document_frequency().collect()} == {(r.term, r.n) for w in words if w != "the" for r in text.expand(df.where("pk is not null"), "content", w).where(F.col("term") == w).collect()}
    plan = index.search("fox", 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(term,fox)" in plan
    with pytest.raises(ValueError):
        index.search("fox", 0)


def test_documents_are_replaced_and_deleted_at_a_commit(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "pk int, content string")
    index = InvertedIndex(spark, f"file://{tmp_path}/i", parts=2)
    index.add(docs((1, "fox"), (2, "fox runs"), (3, "turtle")), "content", "pk")
    index.delete(docs((1, ""), (9, "")), "pk")
    index.add(docs((3, "fox and turtle"), (1, None)), "content", "pk")
    index.commit(docs((4, "fox again"), (2, "gone")), "content", "pk", docs((2, "")))
    live = docs((3, "fox and turtle"), (4, "fox again"))
    for stored in (index, InvertedIndex(spark, f"file://{tmp_path}/i")):  # one that is opened anew sees the same
        assert stored.count() == 2
        for q in ("fox", "turtle", "gone", "runs"):
            assert [(r.key, round(r.score, 9)) for r in stored.search(q, 9).collect()] == [(r.pk, round(r.score, 9)) for r in text.bm25(live, "content", "pk", q, 9).collect()]
    index.optimize()
    assert len(index.state()["commits"]) == 1 and index.count() == 2 and {r.key for r in index.search("fox", 9).collect()} == {3, 4}
    index.add(docs((1, "fox")), "content", "pk")
    assert {r.key for r in index.search("fox", 9).collect()} == {1, 3, 4}


def test_prefix_and_fuzzy_terms(spark, tmp_path):
    df = spark.createDataFrame([(1, "quick quiet"), (2, "quack"), (3, "fox"), (4, "foxes")], "pk int, content string")
    index = InvertedIndex(spark, f"file://{tmp_path}/i")
    index.add(df, "content", "pk")
    for q, want in (("qui*", {1}), ("qu*", {1, 2}), ("quick~1", {1, 2}), ("fox~2", {3, 4}), ("fox~0", {3}), ("zz*", set()), ("qu* AND quiet", {1}), ("fo* NOT foxes", {3})):
        assert {r.key for r in index.search(q, 9).collect()} == want, q
        assert {r.pk for r in text.bm25(df, "content", "pk", q, 9).collect()} == want, q


def service(spark):
    s = Service(spark)
    s.table("k", "t", spark.createDataFrame([(i // 5, i % 5, i % 2, [float(i // 5), float(i % 5), 0.0], f"fox {i}" if i % 3 else "dog") for i in range(20)] + [(9, 9, 1, None, "fox")], "pk int, ck int, f int, v array<float>, doc string"))
    return s


LOCAL = Index("k", "local", "t", ("pk", "ck"), ("v",), partition=("pk",), metric="EUCLIDEAN")
GLOBAL = Index("k", "glob", "t", ("pk", "ck"), ("v",), filtering=("f",), metric="EUCLIDEAN")
EQ = {"type": "==", "lhs": "pk", "rhs": 2}


def test_requests(spark):
    s = service(spark)
    s.create(LOCAL)
    ask = lambda *a, **k: [(r.pk, r.ck) for r in s.ann("k", *a, **k).collect()]
    assert s.status("k", "local").head().asDict() == {"status": "SERVING", "count": 20, "build_progress": 100.0}
    with pytest.raises(NoGlobalIndex):
        ask("local", [0, 0, 0])
    assert ask("local", [0, 1, 0], 2, [EQ]) == [(2, 1), (2, 0)]
    assert ask("local", [0, 0, 0], 9, [{"type": "==", "lhs": "pk", "rhs": 77}]) == []
    # What counts as an equality when an index is chosen, and can't choose a partition.
    assert ask("local", [0, 0, 0], 9, [{"type": "IN", "lhs": "pk", "rhs": [2]}]) == []
    assert ask("local", [0, 0, 0], 9, [{"type": "()==()", "lhs": ["pk", "ck"], "rhs": [2, 1]}], allow_filtering=True) == []
    with pytest.raises(FilteringNeeded):
        ask("local", [0, 0, 0], 9, [EQ, {"type": ">", "lhs": "ck", "rhs": 2}])
    assert set(ask("local", [0, 0, 0], 9, [EQ, {"type": ">", "lhs": "ck", "rhs": 2}], allow_filtering=True)) == {(2, 3), (2, 4)}
    s.create(GLOBAL)
    assert s.route("k", "glob", [Restriction("pk", "==", 2)]).name == "local"  # whichever of the group is named
    assert s.route("k", "local", []).name == "glob"
    assert len(ask("local", [0, 0, 0], 99)) == 20  # null vectors aren't indexed
    with pytest.raises(FilteringNeeded):
        ask("glob", [0, 0, 0], 9, [{"type": "==", "lhs": "f", "rhs": 1}])
    assert {(pk * 5 + ck) % 2 for pk, ck in ask("glob", [0, 0, 0], 99, [{"type": "==", "lhs": "f", "rhs": 1}], allow_filtering=True)} == {1}
    for bad in ({"type": "~", "lhs": "pk", "rhs": 1}, {"type": "==", "lhs": "doc", "rhs": "x"}, {"type": "==", "lhs": "pk", "rhs": "1"}, {"type": "==", "lhs": "pk", "rhs": None}, {"type": "()==()", "lhs": ["pk", "ck"], "rhs": [1]}, {"type": "IN", "lhs": "pk", "rhs": 1}, {"type": "==", "lhs": ["pk"], "rhs": [1]}):
        with pytest.raises(ValueError):
            ask("glob", [0, 0, 0], 9, [bad], allow_filtering=True)
    with pytest.raises(NotFound):
        ask("nothing", [0, 0, 0])
    with pytest.raises(ValueError):
        ask("glob", [0, 0, 0], 0)
    body = columns_of(s.ann("k", "glob", [0.0, 0.0, 0.0], 2), ["pk", "ck"], "distance", "similarity_score")
    assert body == {"primary_keys": {"pk": [0, 0], "ck": [0, 1]}, "distance": [0.0, 1.0], "similarity_score": [1.0, 0.5]}
    assert "ann_requests" in exposition(s.counters()) and s.counts["ann_errors"] > 0


def test_building_dropping_and_listing_indexes(spark):
    s = service(spark)
    assert s.state == "DISCOVERING_INDEXES" and Service(spark).state == "CONNECTING_TO_DB"
    s.create(GLOBAL), s.create(LOCAL)
    assert s.advance("k", "glob", 1, 4).status == "BOOTSTRAPPING" and s.status("k", "glob").head().build_progress == 25.0 and s.state == "INDEXING_EMBEDDINGS"
    # Some index serves, and doesn't fit; then none serves, whether it would fit or not.
    with pytest.raises(NoGlobalIndex):
        s.ann("k", "glob", [0, 0, 0])
    s.advance("k", "local", 0, 4)
    with pytest.raises(NotServing):
        s.ann("k", "local", [0, 0, 0])
    s.advance("k", "glob", 4, 4)
    assert s.ann("k", "local", [0, 0, 0]).count() == 1
    assert {tuple(r) for r in s.listed().collect()} == {("k", "glob"), ("k", "local")}
    assert s.info("k", "local")["options"]["space_type"] == "EUCLIDEAN" and s.service_info()["engine"] == "spark"
    before = s.version
    assert s.discover([LOCAL]) == ({"glob", "local"}, {"local"}) or s.version > before
    s.drop("k", "local")
    with pytest.raises(NotFound):
        s.status("k", "local")
    s.create(GLOBAL)
    assert s.drop_table("k", "t") == ["glob"] and not s.indexes
    with pytest.raises(NotFound):
        s.create(GLOBAL)


def test_text_requests_and_quantized_indexes(spark):
    s = service(spark)
    words = Index("k", "words", "t", ("pk",), ("doc",), kind="fulltext")
    s.create(words)
    assert s.bm25("k", "words", "fox", 99).count() == 14
    with pytest.raises(ValueError):
        s.create(Index("k", "bad", "t", ("pk",), ("f",), kind="fulltext"))
    s.create(Index("k", "own", "t", ("pk",), ("doc",), partition=("f",), kind="fulltext"))
    with pytest.raises(LocalText):
        s.bm25("k", "own", "fox", 1)
    with pytest.raises(NotFound):
        s.ann("k", "words", [0, 0, 0])
    with pytest.raises(NotFound):
        s.bm25("k", "nothing", "fox", 1)
    off = service(spark)
    off.fulltext = False
    assert not off.create(words) and off.listed().count() == 0
    with pytest.raises(ValueError):
        s.create(Index("k", "h", "t", ("pk", "ck"), ("v",), metric="HAMMING"))
    s.create(Index("k", "bits", "t", ("pk", "ck"), ("v",), metric="COSINE", quantization="B1"))
    near = s.ann("k", "bits", [1.0, 0.0, -1.0], 1).head()
    assert near.distance == 0 and near.similarity_score == 1 and s.info("k", "bits")["options"]["space_type"] == "COSINE"
    s.table("k", "one", spark.createDataFrame([(1, [0.9, 0.1, 0.1])], "pk int, v array<float>"))
    s.create(Index("k", "i8", "one", ("pk",), ("v",), metric="EUCLIDEAN", quantization="I8"))
    assert s.ann("k", "i8", [1.0, 0.0, 0.0], 1).head().distance == 507 and s.rescored("k", "i8", [1.0, 0.0, 0.0], 1, 3.0).head().distance == pytest.approx(0.03)
    s.table("k", "few", spark.createDataFrame([(i, [float(i)], "fox" if i % 2 else "dog") for i in range(6)], "pk int, v array<float>, doc string"))
    s.create(Index("k", "v", "few", ("pk",), ("v",), metric="EUCLIDEAN")), s.create(Index("k", "d", "few", ("pk",), ("doc",), kind="fulltext"))
    assert [r.pk for r in s.ann("k", "v", [0.0], 9, allow_filtering=True, match=("d", "fox")).collect()] == [1, 3, 5]


CHANGES = "k int, ts long, id int, c string, part int, gone boolean"


def changed(rng, n):
    return [(rng.randrange(6), rng.randrange(8), i, rng.choice([None, f"c{i}"]), rng.choice([None, rng.randrange(3)]), rng.random() < 0.2) for i in range(n)]


def test_snapshot_of_a_stream_equals_the_batch_also_after_a_restart(spark, tmp_path):
    rows = changed(random.Random(6), 90)  # with many ties in time
    key, cells = ["k"], ["c", "part"]
    want = {tuple(r) for r in merge.latest(spark.createDataFrame(rows, CHANGES), key, cells, "ts", "id", "gone", ["part"]).collect()}
    names = merge.latest(spark.createDataFrame(rows, CHANGES), key, cells, "ts", "id", "gone", ["part"]).columns
    order = list(rows)
    random.Random(1).shuffle(order)
    for i in range(3):
        spark.createDataFrame(order[i::3], CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = merge.change_log(spark, f"{tmp_path}/in", CHANGES, 1)
        one = merge.Snapshot(key, cells, "ts", "id", "gone", buckets=3, kept=["part"])  # a new process each time
        one.start(stream, f"{tmp_path}/check").awaitTermination()
    assert {tuple(r) for r in one.read(spark).select(*names).collect()} == want
    state = one._state(spark)
    one.apply(spark.createDataFrame([(1, 99, 1000, "late", 1, False)], CHANGES), state["batch"])  # a replay of what was committed
    assert one._state(spark) == state
    one.apply(spark.createDataFrame(rows, CHANGES), state["batch"] + 1)
    assert {tuple(r) for r in one.read(spark).select(*names).collect()} == want
    live = {*one._state(spark)["buckets"].values(), *one._state(spark)["before"]}
    there = {f"{p.parent.name}/{p.name}" for p in Path(f"{tmp_path}/check-snapshot").glob("v*/bucket=*")}
    assert live == there  # one version back is kept, older ones are gone


def test_moves_deletes_and_write_times(spark):
    b = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "a"), (4, None, "a"), (5, 1, None), (6, 1, "a"), (7, 1, "a")], "k int, p int, v string")
    a = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "a"), (4, 1, "a"), (5, 2, "a"), (6, 2, None), (7, 1, "a"), (8, 1, "n")], "k int, p int, v string")
    assert {(r.k, r.op) for r in merge.moves(b, a, ["k"], "v", "p").collect()} == {(1, "move"), (2, "update"), (3, "remove"), (4, "insert"), (5, "insert"), (6, "remove"), (8, "insert")}
    log = spark.createDataFrame([(1, "row_insert", 5, 3), (1, "pre_image", 6, None), (2, "row_delete", 7, None), (None, "partition_delete", 8, None), (3, "row_range_delete", 9, None)], "k int, op string, ts long, wt long")
    assert {tuple(r) for r in merge.mapped(log, ["k"], "op", "ts", "wt").select("k", "deleted", "written").collect()} == {(1, False, 3), (2, True, 7)}
    table = spark.createDataFrame([(1, "now")], "k int, c string")
    seen = merge.reread(spark.createDataFrame([(1, False), (2, False), (1, True)], "k int, deleted boolean"), table, ["k"])
    assert sorted((r.k, r.deleted, r.c) for r in seen.collect()) == [(1, False, "now"), (1, True, "now"), (2, True, None)]
    scan = merge.scanned(spark.createDataFrame([(1, "old", None, "x"), (2, "new", 50, "y")], "k int, c string, c__wt long, d string"), ["c", "d"])
    assert sorted((r.k, r.c__wt, r.d__wt, r.ts) for r in scan.collect()) == [(1, 0, 0, 0), (2, 50, 0, 0)]
    late = spark.createDataFrame([(1, "change", 1, 7, False), (2, "change", 20, 8, False)], "k int, c string, ts long, tie long, deleted boolean").withColumn("c__wt", F.lit(None).cast("long"))
    both = scan.select("k", "c", "ts", "tie", "deleted", "c__wt").unionByName(late)
    assert {(r.k, r.c) for r in merge.latest(both, ["k"], ["c"], "ts", "tie", "deleted", times={"c": "c__wt"}).collect()} == {(1, "change"), (2, "new")}
    now = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 10),), (datetime(2024, 1, 1, 0, 1),)], "ts timestamp")
    at = F.lit(datetime(2024, 1, 1, 0, 0, 30))
    assert sorted(r.lag for r in merge.lag(now, "ts", at).collect()) == [0.0, 20.0] and merge.settled(now, "ts", at, 20.0).count() == 1 and merge.settled(now, "ts", at, 21.0).count() == 0


def test_a_failed_stream_is_started_again():
    class Query:
        def __init__(self, fine):
            self.fine = fine

        def awaitTermination(self):  # noqa: N802
            if not self.fine:
                raise RuntimeError

    tries = iter([Query(False), Query(False), Query(True)])
    assert merge.kept_running(lambda: next(tries), 5, 0.0) == 2
    with pytest.raises(RuntimeError):
        merge.kept_running(lambda: Query(False), 2, 0.0)


@pytest.mark.parametrize("kind", ["EUCLIDEAN", "COSINE", "DOT_PRODUCT", "HAMMING"])
def test_batched_neighbours_equal_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, 6)), 1)
    x[100:200] = x[100]  # ties
    x[7] = 0
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(500, None), (501, [1.0]), (502, [float("nan")] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asked = df.where("id % 50 = 0 or id = 7 or id = 501").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    got = {}
    for r in ann.batch(df, "v", "id", asked, "q", "qv", 5, kind).collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.id, r.distance)
    assert got.pop(501) == {1: (501, got_self)} if (got_self := ann.exact(kind, np.ones(1), np.ones(1)).item()) is not None else False
    assert set(got) == {i for i in range(400) if i % 50 == 0 or i == 7} | ({500} & set(got))
    for q in got:
        d = ann.exact(kind, x[q][None], x)
        near = np.lexsort((np.arange(400), d))[:5]
        assert [got[q][k][0] for k in range(1, 6)] == near.tolist()
        assert [got[q][k][1] for k in range(1, 6)] == pytest.approx(d[near].tolist(), abs=1e-12)
        one = ann.search(df, "v", ["id"], [float(a) for a in x[q]], 5, kind).collect()
        assert [r.id for r in one] == near.tolist()
    with pytest.raises(ValueError):
        ann.batch(df, "v", "id", asked, "q", "qv", 5, "MANHATTAN")


def test_ragged_and_nan_vectors_dont_break_an_index(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)] + [(90, None), (91, [1.0]), (92, [float("nan"), 1.0]), (93, [None, 1.0])], "id long, v array<double>")
    index = ann.InvertedFile.build(df, "v", "id", str(tmp_path / "i"), 4)
    assert [r.id for r in index.search(spark, [3.1, 1.0], 3, 4).collect()] == [3, 4, 2]
    asked = df.where("id % 10 = 0 or id > 80").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    rough, exact = (measures.found_share(f(asked, "q", "qv", 3), ann.batch(df, "v", "id", asked.where("q < 80"), "q", "qv", 3, "EUCLIDEAN"), "q", "id") for f in (index.near, index.search_all))
    assert exact.where("recall < 1").count() == 0 and rough.agg(F.avg("recall")).head()[0] >= 0.9


def test_buckets_equal_a_plain_loop(spark):
    limits = [2, 5, 10, 20, 50, 100, 200, 500, 1000]
    counts, want = [0] * 9, []
    for i in range(3500):
        found = None
        for b, most in enumerate(limits):
            counts[b] += 1
            if found is None and counts[b] >= most:
                found = b
                counts[b] -= most
        if found is not None:
            want.append((3 * i, found))
    ids = spark.range(3500).select((F.col("id") * 3).alias("id")).orderBy(F.rand(1)).repartition(7)
    assert sorted((r.id, r.bucket) for r in datasets.bucketed(ids).collect()) == want
    assert [(3 * i, b) for i, b in enumerate(datasets.buckets(3500)) if b >= 0] == want
    assert datasets.bucketed(ids.limit(0)).count() == 0


def test_datasets_and_their_questions(spark, tmp_path):
    assert datasets.format_of(str(tmp_path)) == "parquet"
    for body, want in (("[fbin]\ntrain = 'a'\n", ("fbin", {"train": "a"})), ("[parquet]\n", ("parquet", {})), ("[fbin]\n[parquet]\nx = 1\n", ("parquet", {"x": 1})), ("format = 'fbin'\n", ("parquet", {}))):
        (tmp_path / "dataset.toml").write_text(body)
        assert datasets.settings(str(tmp_path)) == want
    spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, emb array<double>").write.parquet(f"{tmp_path}/test.parquet")
    spark.createDataFrame([(1, [9, 7, 8])], "id long, neighbors_id array<long>").write.parquet(f"{tmp_path}/neighbors.parquet")
    asked = lambda *a: {r.id: r.neighbors for r in datasets.questions(spark, str(tmp_path), *a).collect()}
    assert asked() == {1: [9, 7, 8], 2: []} and asked(2) == {1: [9, 7], 2: []}
    assert asked(2, spark.createDataFrame([(8,), (7,)], "id long")) == {1: [7, 8], 2: []}
    (tmp_path / "q.txt").write_text("1, 2.5\n\n3,4\n"), (tmp_path / "t.txt").write_text("5, 6\n7\n")
    assert [(r.id, r.emb) for r in datasets.questions_text(spark, f"{tmp_path}/q.txt").collect()] == [(0, [1.0, 2.5]), (1, [3.0, 4.0])]
    assert [(r.id, r.neighbors) for r in datasets.truth_text(spark, f"{tmp_path}/t.txt").collect()] == [(0, [5, 6]), (1, [7])]
    (tmp_path / "c.tsv").write_text("d1\tthe fox\nd2\ta dog\n")
    assert [tuple(r) for r in datasets.corpus_tsv(spark, f"{tmp_path}/c.tsv", "doc_id string, body string").collect()] == [("d1", "the fox"), ("d2", "a dog")]
    rows = spark.createDataFrame([({"v": b"\x05" + np.array([1.5], ">f4").tobytes()},), ({},)], "attrs map<string,binary>")
    assert [r[0] for r in rows.select(datasets.decoded(datasets.attribute(F.col("attrs"), "v"))).collect()] == [[1.5], None]


def test_in_treats_values_as_equality_does(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 0, 1200), float("nan"), 1), (datetime(2024, 1, 1, 0, 0, 0, 5000), 2.0, 2)], "t timestamp, d double, id int")
    for column, value in (("t", datetime(2024, 1, 1, 0, 0, 0, 1000)), ("d", float("nan")), ("d", 2.0)):
        both = [[r.id for r in where(df, [Restriction(column, op, v)]).collect()] for op, v in (("==", value), ("IN", [value]))]
        assert both[0] == both[1]
    assert [r.id for r in where(df, [Restriction("t", "IN", [datetime(2024, 1, 1, 0, 0, 0, 1000)])]).collect()] == [1]


def test_index_versions_and_routing_order():
    ready, early = (Index("k", n, "t", ("pk",), ("v",), partition=p, status=s) for n, p, s in (("a", ("pk",), "SERVING"), ("b", (), "INITIALIZING")))
    with pytest.raises(NoGlobalIndex):
        catalog.best_index([ready, early], "k", "t", ["v"], [])
    with pytest.raises(NotServing):
        catalog.best_index([early], "k", "t", ["v"], [Restriction("nothing", "==", 1)])
    old, new = (Index("k", n, "t", ("pk",), ("v",), version=v) for n, v in (("old", "1b4e28ba-2fa1-11d2-883f-0016d3cca427"), ("new", "1b4e28ba-2fa1-11d3-883f-0016d3cca427")))
    assert all(catalog.best_index(list(x), "k", "t", ["v"], []).name == "new" for x in itertools.permutations([old, new]))


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5, 2.0), ("a", 1.0, 4.0), ("b", 0.0, 300.0)], "kind string, recall double, ms double")
    assert [tuple(r) for r in measures.searches(df, "recall", "ms", 2.0).collect()] == [(3, 1.5, 2.0, 300.0, 0.0, 0.5, 1.0)]
    bins = measures.linear_histogram(df, "ms", 0.0, 100.0, 100)
    assert {r.bin: r.n for r in bins.collect()} == {2: 1, 4: 1, 99: 1}
    assert {r.percent: r.value for r in measures.histogram_percentiles(bins, 0.0, 100.0, (25, 50, 99), 100).collect()} == {25.0: 3.0, 50.0: 5.0, 99.0: 100.0}
    parts = spark.createDataFrame([(3.0, True), (1.0, False)], "length double, done boolean")
    assert measures.progress(parts, "length", "done").head()[0] == 75.0 and measures.progress(parts.limit(0), "length", "done").head()[0] == 100.0


def test_the_library_works_without_the_subpackage(tmp_path):
    """In a copy without the folders, with an empty one, and with one of its imports missing."""
    root = Path(__file__).parent.parent
    for case in ("gone", "empty", "broken"):
        copy = tmp_path / case
        subprocess.run(["cp", "-r", str(root / "kestrel"), str(root / "__spark_entry__.py"), str(copy)] if copy.mkdir() is None else [], check=True)
        if case == "broken" and (copy / "kestrel/llm").exists():
            (copy / "kestrel/llm/queries.py").write_text("import a_module_that_isnt_there\n")
        else:
            subprocess.run(["rm", "-rf", str(copy / "kestrel/llm")], check=True)
            if case == "empty":
                (copy / "kestrel/llm").mkdir()
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"], cwd=copy, capture_output=True, text=True, check=True)
        assert out.stdout.split()[1:] == ["False", "True"]


def test_bulk_writes_and_columnar_results(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    table = sinks.Table(spark, f"file://{tmp_path}/t", ["k"])
    assert table.delete(rows((1, "a"))) == 0
    table.upload(rows((1, "a"), (2, "b"), (None, "c")))
    table.upload(rows((3, "c")))
    assert table.upload(rows((2, "B"), (4, "d")), replace=True) == 3
    assert table.delete(rows((1, "")).select("k")) == 4
    assert {tuple(r) for r in sinks.Table(spark, f"file://{tmp_path}/t", ["k"]).read().collect()} == {(2, "B"), (3, "c"), (4, "d")}
    one = sinks.columnar(spark.createDataFrame([(2, 7, 0.5), (1, 9, 0.25)], "rank int, k int, d double"), ["k"], "d").head()
    assert (one.k, one.d) == ([9, 7], [0.25, 0.5])


def test_values_of_further_types():
    assert catalog.coerce("1B4E28BA-2FA1-11D2-883F-0016D3CCA427", "timeuuid") == "1b4e28ba-2fa1-11d2-883f-0016d3cca427"
    assert catalog.to_json(catalog.coerce("T08:12:54.2137", "time"), "time") == "08:12:54.2137" and catalog.to_json(0, "time") == "00:00:00" and catalog.coerce("abc", "ascii") == "abc"
    for value, kind in (("1b4e28ba-2fa1-41d2-883f-0016d3cca427", "timeuuid"), ("x", "uuid"), ("é", "ascii"), ("25:00:00", "time"), (5, "uuid")):
        with pytest.raises(ValueError):
            catalog.coerce(value, kind)
    assert (catalog.dimension_of("vector<float, 3>", {}), catalog.dimension_of("blob", {"dimensions": "7"}), catalog.dimension_of(None, {"dimensions": "x"})) == (3, 7, None)


def test_tables_of_a_piece_of_work_are_deleted(spark, tmp_path):
    from kestrel import session

    with session.work(spark):
        path = session.scratch(spark, "x")
        session.cut(spark.range(3), "y").write.parquet(f"{tmp_path}/out")
        folder = Path(path.removeprefix("file://")).parent
        assert folder.exists()
    assert not folder.exists() and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_parts_of_terms_are_those_of_the_write(spark, tmp_path):
    words = [f"w{i}" for i in range(40)] + ["é", "日本語", "a" * 100]
    index = InvertedIndex(spark, f"file://{tmp_path}/i", parts=7)
    index.add(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pk int, content string"), "content", "pk")
    assert {r.term for r in index.postings(words).collect()} == set(words) and index.postings(["é"]).count() == 1


def test_postings_are_stored_as_blocks_of_bounded_tasks(spark, tmp_path, monkeypatch):
    from kestrel.operators import inverted

    rng = random.Random(4)
    words = "the quick brown fox jumps over lazy dog slow turtle walks garden meadow".split()
    rows = [(f"k{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    twice = [("k3", "fox"), ("k3", "turtle fox fox"), ("k5", "a")]
    df = spark.createDataFrame([*rows, *twice], "pk string, content string").repartition(3)
    kept = {}
    for k, t in [*rows, *twice]:
        kept[k] = max(t, kept.get(k, ""))  # the greatest text of a key
    one = spark.createDataFrame(sorted(kept.items()), "pk string, content string")
    monkeypatch.setattr(inverted, "TOKENS", 100, raising=False)
    monkeypatch.setattr(inverted, "SIGNS", 500, raising=False)
    index = InvertedIndex(spark, f"file://{tmp_path}/i", parts=2)
    index.add(df, "content", "pk")
    assert 11 < spark.read.parquet(f"{tmp_path}/i/postings").count() < index.postings().count()
    want = {(r.term, r.pk, r.tf, tuple(r.positions)) for r in text.postings(one, "content", "pk").collect()}
    assert {(r.term, r.key, r.tf, tuple(r.positions)) for r in index.postings().collect()} == want
    for q in ("fox", '"quick brown"', "fox NOT turtle"):
        assert [(r.key, round(r.score, 9)) for r in index.search(q, 99).collect()] == [(r.pk, round(r.score, 9)) for r in text.bm25(one, "content", "pk", q, 99).collect()]


def test_a_load_reads_each_text_twice_and_keeps_the_lengths(spark, tmp_path):
    texts = ["the fox", "", "the", "fox fox meadow", "a turtle walks", "..."] * 5
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(i):
        seen.add(1)
        return texts[i]

    index = InvertedIndex(spark, f"file://{tmp_path}/i", parts=3)
    index.add(spark.range(len(texts)).select(F.col("id").alias("pk"), read.asNondeterministic()("id").alias("content")), "content", "pk")
    assert seen.value <= 2 * len(texts)
    assert sorted((r.key, r.len) for r in spark.read.parquet(f"{tmp_path}/i/documents").collect()) == [(i, len([w for w in t.strip(".").split() if w not in text.STOP])) for i, t in enumerate(texts)]
    assert index.count() == len(texts) and {r.term for r in index.document_frequency().collect()} == {"fox", "meadow", "turtle", "walks"}


def test_postings_move_packed(spark):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from kestrel.operators import inverted

    rng = random.Random(5)
    docs = spark.createDataFrame([(i, [rng.choice("abcdefgh") + str(rng.randrange(20)) for _ in range(200)]) for i in range(300)], "key long, all array<string>").coalesce(1)
    schema = _parse_datatype_string(f"{inverted.BLOCK}, part int".replace("KEY", "long"))
    packed = docs.mapInArrow(inverted._blocks(to_arrow_schema(schema), 64, 1, 8), "task int, packed binary").cache()
    rows = packed.mapInArrow(lambda batches: (b.select(["packed"]) for b in batches), "packed binary").mapInArrow(inverted._unpacked(to_arrow_schema(schema)), schema).collect()
    numbers = sum(2 * len(r["keys"]) + len(r["tfs"]) + len(r["lens"]) + len(r["at"]) + len(r["positions"]) for r in rows)
    assert packed.agg(F.sum(F.length("packed"))).head()[0] < 4 * numbers / 2  # half of what they are as numbers
    assert sum(len(r["positions"]) for r in rows) == 300 * 200 and {r["part"] == -1 for r in rows if r["term"] is None} == {True}
    assert all(r["at"] == [sum(r["tfs"][:i]) for i in range(len(r["tfs"]))] for r in rows)
    packed.unpersist()


def test_only_texts_of_repeated_keys_are_shuffled(spark):
    from kestrel.operators import inverted

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "key int, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for several, joins in ((1, "BroadcastHashJoin"), (inverted.FEW + 1, "SortMergeJoin")):
            got = inverted._unrepeated(docs, several)
            assert got._jdf.queryExecution().executedPlan().toString().count(joins) == 2
            assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
