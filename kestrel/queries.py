"""Queries of the retrieval operators over the driver's tables, and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import quantize
from kestrel.operators import ann, measures, text
from kestrel.operators.filters import Restriction, where
from kestrel.operators.inverted import InvertedIndex
from kestrel.plans.catalog import Index
from kestrel.plans.engine import Service
from kestrel.session import scratch, there
from kestrel.sources import datasets
from kestrel.streaming import merge

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP) + ")"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _v(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of different lengths, so that metrics rank differently."""
    e = _t(spark, sf, "embeddings")
    return e.withColumn("v", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5)))


def _q(spark: SparkSession, sf: str) -> list[float]:
    return list(_v(spark, sf).where("vec_id = 0").select("v").head()[0])


def _add(name: str, query: Query, sql: str | None = None) -> None:
    FOUND[name] = query
    if sql:
        SQL[name] = sql


_CORPUS = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)"
_SUM = "list_sum(list_transform(list_zip({a}, {b}), lambda p: {f}))"
_DOT = lambda a, b: _SUM.format(a=a, b=b, f="p[1] * p[2]")
_D = {
    "EUCLIDEAN": _SUM.format(a="v", b="q", f="(p[1] - p[2]) * (p[1] - p[2])"),
    "COSINE": f"greatest(0, least(2, 1 - {_DOT('v', 'q')} / (sqrt({_DOT('v', 'v')}) * sqrt({_DOT('q', 'q')}))))",
    "DOT_PRODUCT": f"1 - {_DOT('v', 'q')}",
    "HAMMING": _SUM.format(a="v", b="q", f="CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
}
_S = {"EUCLIDEAN": "1 / (1 + d)", "COSINE": "(2 - d) / 2", "DOT_PRODUCT": "(2 - d) / 2", "HAMMING": "1 - d / 64.0"}


def _top(spark, sf, kind="EUCLIDEAN", filters=(), limit=10):
    found = ann.search(_v(spark, sf), "v", ["vec_id"], _q(spark, sf), limit, kind, filters)
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity_score", 6).alias("similarity_score"))


def _top_sql(kind="EUCLIDEAN", cond="true", limit=10):
    return f"{_CORPUS}, r AS (SELECT vec_id, {_D[kind]} AS d FROM e, q WHERE {cond} ORDER BY d, vec_id LIMIT {limit}) SELECT vec_id, round(d, 6)::DOUBLE AS distance, round({_S[kind]}, 6)::DOUBLE AS similarity_score FROM r"


for _kind in _D:
    _add(f"ann_{_kind.lower().split('_')[0]}_topk", partial(_top, kind=_kind), _top_sql(_kind))
for _name, _r, _sql in (
    ("eq", Restriction("label", "==", 3), "label = 3"), ("in", Restriction("label", "IN", [1, 4]), "label IN (1, 4)"), ("lt", Restriction("vec_id", "<", 100), "vec_id < 100"),
    ("lte", Restriction("vec_id", "<=", 100), "vec_id <= 100"), ("gt", Restriction("vec_id", ">", 300), "vec_id > 300"), ("gte", Restriction("vec_id", ">=", 300), "vec_id >= 300"),
):
    _add(f"ann_filter_{_name}", partial(_top, filters=(_r,)), _top_sql(cond=_sql))
_add("ann_filter_range", partial(_top, filters=(Restriction("vec_id", ">", 100), Restriction("vec_id", "<", 200))), _top_sql(cond="vec_id > 100 AND vec_id < 200"))
_add("ann_local_partition", partial(_top, filters=(Restriction("label", "==", 5), Restriction("vec_id", ">", 50))), _top_sql(cond="label = 5 AND vec_id > 50"))
_add("ann_local_missing_partition", partial(_top, filters=(Restriction("label", "==", 999),)), _top_sql(cond="label = 999"))

for _name, _op, _value, _sql in (
    ("eq", "==", (7, 2), "l_orderkey = 7 AND l_linenumber = 2"), ("in", "IN", [(7, 2), (32, 1)], "(l_orderkey = 7 AND l_linenumber = 2) OR (l_orderkey = 32 AND l_linenumber = 1)"),
    ("lt", "<", (500, 3), "l_orderkey < 500 OR (l_orderkey = 500 AND l_linenumber < 3)"), ("lte", "<=", (500, 3), "l_orderkey < 500 OR (l_orderkey = 500 AND l_linenumber <= 3)"),
    ("gt", ">", (500, 3), "l_orderkey > 500 OR (l_orderkey = 500 AND l_linenumber > 3)"), ("gte", ">=", (500, 3), "l_orderkey > 500 OR (l_orderkey = 500 AND l_linenumber >= 3)"),
):
    _add(f"filter_tuple_{_name}", lambda spark, sf, r=Restriction(("l_orderkey", "l_linenumber"), _op, _value): where(_t(spark, sf, "lineitem"), [r]).select("l_orderkey", "l_linenumber", "l_quantity"), f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE {_sql}")
_add("filter_text_gt", lambda spark, sf: where(_t(spark, sf, "orders"), [Restriction("o_orderpriority", ">", "3")]).select("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '3'")
_add("filter_double_lte", lambda spark, sf: where(_t(spark, sf, "orders"), [Restriction("o_totalprice", "<=", 50000.0)]).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 50000.0")


def _post(spark, sf):
    return ann.search(_v(spark, sf), "v", ["vec_id", "label"], _q(spark, sf), 50, "EUCLIDEAN").where("label = 2").select("vec_id", F.round("distance", 6).alias("distance"))


_add("ann_post_filter", _post, f"{_CORPUS}, r AS (SELECT vec_id, label, {_D['EUCLIDEAN']} AS d FROM e, q ORDER BY d, vec_id, label LIMIT 50) SELECT vec_id, round(d, 6)::DOUBLE AS distance FROM r WHERE label = 2")


def _batch(spark, sf, kind="EUCLIDEAN"):
    e = _v(spark, sf)
    return ann.batch(e, "v", "vec_id", e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id", "qv", 5, kind).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def _batch_sql(kind, corpus, limit, digits=True):
    d = _D[kind].replace("list_zip(v, q)", "list_zip(e.v, a.v)").replace("list_zip(v, v)", "list_zip(e.v, e.v)").replace("list_zip(q, q)", "list_zip(a.v, a.v)")
    return f"""{corpus}, p AS (SELECT a.vec_id AS query_id, e.vec_id, {d} AS d FROM e, e a WHERE a.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INT AS rank FROM p) SELECT query_id, rank, vec_id, round(d, 6)::DOUBLE AS distance FROM r WHERE rank <= {limit}"""


_E = _CORPUS.replace(", q AS (SELECT v AS q FROM e WHERE vec_id = 0)", "")
for _kind in _D:
    _add("ann_batch_topk" if _kind == "EUCLIDEAN" else f"ann_batch_{_kind.lower().split('_')[0]}", partial(_batch, kind=_kind), _batch_sql(_kind, _E, 5))
_add("ann_topk_per_partition", lambda spark, sf: ann.per_partition(_v(spark, sf), "v", ["vec_id"], "label", _q(spark, sf), 3, "EUCLIDEAN").select("label", "rank", "vec_id", F.round("distance", 6).alias("distance")),
     f"{_CORPUS}, p AS (SELECT label, vec_id, {_D['EUCLIDEAN']} AS d FROM e, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id)::INT AS rank FROM p) SELECT label, rank, vec_id, round(d, 6)::DOUBLE AS distance FROM r WHERE rank <= 3")
_add("ann_fetch_rows", lambda spark, sf: ann.search(_v(spark, sf), "v", ["vec_id"], _q(spark, sf), 10, "EUCLIDEAN").join(_t(spark, sf, "embeddings"), "vec_id").select("vec_id", "label"),
     f"{_CORPUS}, r AS (SELECT vec_id, {_D['EUCLIDEAN']} AS d FROM e, q ORDER BY d, vec_id LIMIT 10) SELECT vec_id, label FROM r JOIN embeddings USING (vec_id)")

_I8 = "list_transform({v}, lambda x: greatest(-127, least(127, round(x * 127)::INT)))"
_RAW = f"WITH e AS (SELECT vec_id, embedding AS f, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0), i AS (SELECT vec_id, v, q, {_I8.format(v='v')} AS iv, {_I8.format(v='q')} AS iq FROM e, q)"
_ID = _SUM.format(a="iv", b="iq", f="((p[1] - p[2]) * (p[1] - p[2]))::DOUBLE")


def _raw(spark, sf):
    e = _t(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e, list(e.where("vec_id = 0").select("v").head()[0])


def _i8(spark, sf):
    e, q = _raw(spark, sf)
    return ann.quantized(e, "v", ["vec_id"], q, 10)


def _rescored(spark, sf):
    e, q = _raw(spark, sf)
    return ann.rescored(e, "v", ["vec_id"], q, 10, "EUCLIDEAN", 3.0).select("vec_id", F.round("distance", 6).alias("distance"))


_add("ann_i8_topk", _i8, f"{_RAW} SELECT vec_id, {_ID} AS distance FROM i ORDER BY distance, vec_id LIMIT 10")
_add("ann_i8_oversampled_rescored", _rescored, f"{_RAW}, r AS (SELECT vec_id, v, q, {_ID} AS rough FROM i ORDER BY rough, vec_id LIMIT 30), s AS (SELECT vec_id, {_D['EUCLIDEAN']} AS d FROM r ORDER BY d, vec_id LIMIT 10) SELECT vec_id, round(d, 6)::DOUBLE AS distance FROM s")


def _b1(spark, sf):
    e, q = _raw(spark, sf)
    rough = ann.search(e, "v", ["vec_id"], q, 50, "HAMMING").select("vec_id")
    return ann.search(e.join(rough, "vec_id"), "v", ["vec_id"], q, 10, "EUCLIDEAN").select("vec_id", F.round("distance", 6).alias("distance"))


_add("ann_b1_rescored_topk", _b1, f"{_RAW}, r AS (SELECT vec_id, v, q, {_D['HAMMING']} AS rough FROM i ORDER BY rough, vec_id LIMIT 50), s AS (SELECT vec_id, {_D['EUCLIDEAN']} AS d FROM r ORDER BY d, vec_id LIMIT 10) SELECT vec_id, round(d, 6)::DOUBLE AS distance FROM s")
_add("f16_round_trip", lambda spark, sf: _t(spark, sf, "embeddings").select("vec_id", quantize.f16(F.col("embedding")).alias("v")))
_add("bf16_round_trip", lambda spark, sf: _t(spark, sf, "embeddings").select("vec_id", quantize.bf16(F.col("embedding")).alias("v")))


_CELLS: dict[tuple[str, str], ann.InvertedFile] = {}
_PLAIN = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _index(spark, sf):
    """The inverted file over all rows, built once in a session for each folder and again where its files are gone, and as queries the rows whose id is divisible by 50."""
    e, at = _t(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), (spark.sparkContext.applicationId, sf)
    if at not in _CELLS or not there(spark, _CELLS[at].path):
        _CELLS[at] = ann.InvertedFile.build(e, "v", "vec_id", scratch(spark, "ivf"), max(16, math.isqrt(e.count())))
    return e, _CELLS[at], e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))


def _ivf(spark, sf):
    _, index, asked = _index(spark, sf)
    return index.search_all(asked, "query_id", "qv", 10).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


_add("ann_ivf", _ivf, _batch_sql("EUCLIDEAN", _PLAIN, 10))
_add("index_count", lambda spark, sf: _t(spark, sf, "embeddings").where("embedding is not null").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL")
_add("partition_sizes", lambda spark, sf: _t(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n")), "SELECT label, count(*) AS n FROM embeddings GROUP BY label")

# Text

_BUILT: dict[tuple[str, str], InvertedIndex] = {}


def fts(spark, sf):
    """The stored index of documents, built once in a session for each folder and again where its files are gone."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _BUILT or not there(spark, _BUILT[at].root):
        _BUILT[at] = InvertedIndex(spark, scratch(spark, "fts"))
        _BUILT[at].add(_t(spark, sf, "documents"), "text", "doc_id")
    return _BUILT[at]


_TOKENS = rf"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, w, list_filter(w, lambda x: x NOT IN {STOP}) AS kept FROM t)"
_add("term_document_frequency", lambda spark, sf: fts(spark, sf).document_frequency(),
     f"{_TOKENS}, o AS (SELECT doc_id, unnest(kept) AS term FROM k) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM o GROUP BY term")
_add("doc_length_stats", lambda spark, sf: _t(spark, sf, "documents").where("text is not null").select(F.size(text.analyzed(F.col("text"))).alias("n")).agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("tokens"), F.max("n").cast("long").alias("longest")),
     f"{_TOKENS} SELECT count(*) AS docs, sum(len(kept))::BIGINT AS tokens, max(len(kept))::BIGINT AS longest FROM k")


def _bm25(query, limit=20):
    return lambda spark, sf: fts(spark, sf).search(query, limit).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def _bm25_sql(words, cond, limit=20):
    tf = lambda w: f"len(list_filter(kept, lambda x: x = '{w}'))"
    parts = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(words)))
    cols = ", ".join(f"{tf(w)}::DOUBLE AS tf{i}" for i, w in enumerate(words))
    dfs = ", ".join(f"sum((tf{i} > 0)::INT)::DOUBLE AS df{i}" for i in range(len(words)))
    return f"{_TOKENS}, c AS (SELECT doc_id, kept, ' ' || array_to_string(w, ' ') || ' ' AS joined, len(kept)::DOUBLE AS size, {cols} FROM k), s AS (SELECT count(*)::DOUBLE AS n, avg(size) AS mean, {dfs} FROM c), r AS (SELECT doc_id, {parts} AS score FROM c, s WHERE {cond} ORDER BY score DESC, doc_id LIMIT {limit}) SELECT doc_id, round(score, 6)::DOUBLE AS score FROM r WHERE score > 0"


_has = "list_contains(kept, '{}')".format
for _name, _query, _words, _cond in (
    ("term", "que", ["que"], _has("que")), ("or", "que die", ["que", "die"], f"{_has('que')} OR {_has('die')}"), ("and", "que AND en", ["que", "en"], f"{_has('que')} AND {_has('en')}"),
    ("not", "que NOT le", ["que"], f"{_has('que')} AND NOT {_has('le')}"), ("grouped", "(que OR die) AND en", ["que", "die", "en"], f"({_has('que')} OR {_has('die')}) AND {_has('en')}"),
    ("phrase", '"en que"', ["en", "que"], "contains(joined, ' en que ')"), ("no_match", "zzzzqqqq", ["zzzzqqqq"], _has("zzzzqqqq")),
):
    _add(f"bm25_{_name}", _bm25(_query), _bm25_sql(_words, _cond))
_add("prefix_term", lambda spark, sf: text.expand(_t(spark, sf, "documents"), "text", "quel"), f"{_TOKENS}, o AS (SELECT DISTINCT doc_id, unnest(kept) AS term FROM k) SELECT term, count(*) AS n FROM o WHERE starts_with(term, 'quel') GROUP BY term")
_add("fuzzy_term", lambda spark, sf: text.expand(_t(spark, sf, "documents"), "text", "that", 1), f"{_TOKENS}, o AS (SELECT DISTINCT doc_id, unnest(kept) AS term FROM k) SELECT term, count(*) AS n FROM o WHERE levenshtein(term, 'that') <= 1 GROUP BY term")
_add("bm25_scan", lambda spark, sf: text.bm25(_t(spark, sf, "documents"), "text", "doc_id", "que AND en", 20).select("doc_id", F.round("score", 6).alias("score")), SQL["bm25_and"])
_add("fts_postings", lambda spark, sf: fts(spark, sf).postings(["que", "that"]).select("term", F.col("key").alias("doc_id"), "tf", "len", F.element_at("positions", 1).alias("first")),
     f"{_TOKENS} SELECT t.term, doc_id, len(list_filter(kept, lambda x: x = t.term))::INT AS tf, len(kept)::INT AS len, (list_position(w, t.term) - 1)::INT AS first FROM k, (VALUES ('que'), ('that')) t(term) WHERE list_contains(kept, t.term)")


def _changed(spark, sf):
    """The index after every seventh text was deleted and the text of every other eleventh one became another's."""
    docs = _t(spark, sf, "documents").where("doc_id is not null").select("doc_id", "text")
    index = InvertedIndex(spark, scratch(spark, "fts"))
    index.add(docs, "text", "doc_id")
    index.delete(docs.where("doc_id % 7 = 0"), "doc_id")
    index.add(docs.where("doc_id % 11 = 3").withColumn("text", F.lit("que nueva")), "text", "doc_id")
    return index.search("que", 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_add("fts_after_changes", _changed, _bm25_sql(["que"], _has("que")).replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'que nueva' ELSE text END AS text FROM documents WHERE doc_id % 7 > 0 OR doc_id % 11 = 3) WHERE text IS NOT NULL"))


def _lists(spark, sf):
    """All texts by BM25 with their rank, and as a second list the vectors of the same ids by distance."""
    a = text.ranked(fts(spark, sf).matches("que").withColumnRenamed("key", "doc_id"), "doc_id", F.col("score").desc())
    near = ann.scored(_v(spark, sf), "v", ["vec_id"], _q(spark, sf), "EUCLIDEAN").select(F.col("vec_id").alias("doc_id"), (1 / (1 + F.col("distance"))).alias("score"))
    return a, text.ranked(near, "doc_id", F.col("score").desc())


_SCORED = _bm25_sql(["que"], _has("que")).replace("round(score, 6)::DOUBLE", "score").replace("ORDER BY score DESC, doc_id LIMIT 20", "")
_LISTS = f"a AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_SCORED})), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_CORPUS} SELECT vec_id AS doc_id, 1 / (1 + {_D['EUCLIDEAN']}) AS score FROM e, q))"
_RRF = "coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0)"
_add("hybrid_rrf", lambda spark, sf: text.rank_fusion(*_lists(spark, sf), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score")), f"WITH {_LISTS} SELECT doc_id, round({_RRF}, 6)::DOUBLE AS score FROM a FULL JOIN b USING (doc_id) ORDER BY {_RRF} DESC, doc_id LIMIT 20")
_add("hybrid_weighted", lambda spark, sf: text.weighted_fusion(*_lists(spark, sf), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score")), f"WITH {_LISTS}, f AS (SELECT doc_id, 0.5::DOUBLE * coalesce(a.score, 0) + 0.5::DOUBLE * coalesce(b.score, 0) AS score FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20) SELECT doc_id, round(score, 6)::DOUBLE AS score FROM f")
_add("ann_match_filter", lambda spark, sf: ann.search(_v(spark, sf).join(fts(spark, sf).matches("que").select(F.col("key").alias("vec_id")), "vec_id", "left_semi"), "v", ["vec_id"], _q(spark, sf), 10, "EUCLIDEAN").select("vec_id", F.round("distance", 6).alias("distance")),
     f"{_CORPUS}, m AS ({_SCORED}), r AS (SELECT vec_id, {_D['EUCLIDEAN']} AS d FROM e, q WHERE vec_id IN (SELECT doc_id FROM m) ORDER BY d, vec_id LIMIT 10) SELECT vec_id, round(d, 6)::DOUBLE AS distance FROM r")

# Changes


def _changes(spark, sf):
    return _t(spark, sf, "events").withColumn("gone", F.col("event_type") == "error").withColumn("view_value", F.when(F.col("event_type") == "view", F.col("value")))


_EV = "WITH ev AS (SELECT *, event_type = 'error' AS gone FROM events)"
_add("lww_snapshot", lambda spark, sf: merge.latest(_changes(spark, sf), ["user_id"], ["value"], "ts", "event_id", "gone").where("value is not null").select("user_id", "value"),
     f"{_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM ev WHERE user_id IS NOT NULL AND ts IS NOT NULL AND (gone OR value IS NOT NULL)) SELECT user_id, value FROM r WHERE k = 1 AND NOT gone")
_add("lww_per_cell", lambda spark, sf: merge.latest(_changes(spark, sf), ["user_id"], ["value", "view_value"], "ts", "event_id", "gone").select("user_id", "value", "view_value"),
     f"""{_EV}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM ev WHERE gone OR value IS NOT NULL),
     b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM ev WHERE gone OR (event_type = 'view' AND value IS NOT NULL)), u AS (SELECT DISTINCT user_id FROM ev WHERE user_id IS NOT NULL)
     SELECT u.user_id, CASE WHEN NOT a.gone THEN a.value END AS value, CASE WHEN NOT b.gone THEN b.value END AS view_value FROM u LEFT JOIN a ON a.user_id = u.user_id AND a.k = 1 LEFT JOIN b ON b.user_id = u.user_id AND b.k = 1""")  # fmt: skip
_LAST = "(SELECT user_id, CASE WHEN NOT gone THEN value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM ev WHERE {c}) WHERE k = 1)"


def _classified(spark, sf):
    e = _changes(spark, sf)
    take = lambda d: merge.latest(d, ["user_id"], ["value"], "ts", "event_id", "gone")
    return merge.classify(take(e.where("ts < timestamp'2024-01-10'")), take(e), ["user_id"], "value").groupBy("op").agg(F.count("*").alias("n"))


_add("cdc_op_classification", _classified, f"{_EV}, a AS {_LAST.format(c=chr(116) + 's < TIMESTAMP ' + repr('2024-01-10'))}, b AS {_LAST.format(c='true')}, j AS (SELECT a.value AS x, b.value AS y FROM a FULL JOIN b USING (user_id)), o AS (SELECT CASE WHEN x IS NULL AND y IS NOT NULL THEN 'insert' WHEN x IS NOT NULL AND y IS NULL THEN 'remove' WHEN x IS DISTINCT FROM y THEN 'update' END AS op FROM j) SELECT op, count(*) AS n FROM o WHERE op IS NOT NULL GROUP BY op")
_add("cdc_dedupe", lambda spark, sf: merge.unrepeated(_t(spark, sf, "events").withColumn("day", F.date_trunc("DAY", "ts")), ["user_id"], "day", "event_type", "event_id").select("event_id", "user_id"),
     "SELECT event_id, user_id FROM (SELECT *, lag(d) OVER w IS NOT DISTINCT FROM d AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type AS same FROM (SELECT *, date_trunc('day', ts) AS d FROM events WHERE user_id IS NOT NULL) WINDOW w AS (PARTITION BY user_id ORDER BY d, event_id)) WHERE NOT coalesce(same, false)")
_add("change_lookup_join", lambda spark, sf: _t(spark, sf, "orders").select("o_custkey").distinct().join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_custkey", F.col("c_custkey").isNull().alias("removed")),
     "SELECT o_custkey, c_custkey IS NULL AS removed FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey")
_add("stream_min_progress", lambda spark, sf: _t(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("m")).agg(F.min("m").alias("progress")), "SELECT min(m) AS progress FROM (SELECT max(ts) AS m FROM events GROUP BY event_type)")



def _log(spark, sf):
    """events as a change log: their kinds stand for those of changes."""
    kinds = {"click": "row_insert", "view": "row_update", "purchase": "post_image", "error": "row_delete", "signup": "pre_image"}
    op = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()), F.lit("range_delete"))
    return _t(spark, sf, "events").withColumn("op", op).withColumn("write_time", F.when(F.col("event_id") % 3 == 0, F.expr("ts - interval 1 hour"))).withColumn("part", (F.col("value") % 4).cast("int"))


_LOG = "WITH log AS (SELECT *, CASE event_type WHEN 'click' THEN 'row_insert' WHEN 'view' THEN 'row_update' WHEN 'purchase' THEN 'post_image' WHEN 'error' THEN 'row_delete' WHEN 'signup' THEN 'pre_image' ELSE 'range_delete' END AS op, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 HOUR END AS write_time, trunc(value % 4)::INT AS part FROM events), ch AS (SELECT *, op = 'row_delete' AS deleted, coalesce(write_time, ts) AS written FROM log WHERE op IN ('row_insert', 'row_update', 'post_image', 'row_delete') AND user_id IS NOT NULL)"


def _mapped(spark, sf):
    return merge.mapped(_log(spark, sf), ["user_id"], "op", "ts", "write_time")


def _kept(rows):
    return merge.latest(rows, ["user_id"], ["value", "part"], "written", "event_id", "deleted", kept=["part"])


_CELL = "(SELECT user_id, CASE WHEN NOT gone THEN v END AS {c} FROM (SELECT user_id, {v} AS v, {g} AS gone, row_number() OVER (PARTITION BY user_id ORDER BY written DESC, event_id) AS k FROM ch WHERE written IS NOT NULL AND ({g} OR {v} IS NOT NULL){w}) WHERE k = 1)"
_STATE = lambda w="": f"(SELECT u.user_id, a.value, b.part FROM (SELECT DISTINCT user_id FROM ch WHERE written IS NOT NULL{w}) u LEFT JOIN {_CELL.format(c='value', v='value', g='deleted', w=w)} a USING (user_id) LEFT JOIN {_CELL.format(c='part', v='part', g='false', w=w)} b USING (user_id))"
_add("cdc_op_mapping", lambda spark, sf: _mapped(spark, sf).select("event_id", "deleted", "written"), f"{_LOG} SELECT event_id, deleted, written FROM ch")
_add("cdc_delete_keeps_partition", lambda spark, sf: _kept(_mapped(spark, sf)).select("user_id", "value", "part"), f"{_LOG} SELECT user_id, value, part FROM {_STATE()}")
_add("lww_partition_move", lambda spark, sf: merge.moves(_kept(_mapped(spark, sf).where("written < timestamp'2024-01-15'")), _kept(_mapped(spark, sf)), ["user_id"], "value", "part"),
     f"""{_LOG}, a AS {_STATE(" AND written < TIMESTAMP '2024-01-15'")}, b AS {_STATE()}, j AS (SELECT user_id, a.value AS x, b.value AS y, a.part AS p, b.part AS q FROM a FULL JOIN b USING (user_id)),
     o AS (SELECT user_id, CASE WHEN x IS NOT NULL AND p IS NOT NULL AND y IS NOT NULL AND q IS NOT NULL AND p <> q THEN 'move' WHEN x IS NOT NULL AND p IS NOT NULL AND y IS NOT NULL AND q IS NOT NULL AND x <> y THEN 'update'
     WHEN x IS NOT NULL AND p IS NOT NULL AND (y IS NULL OR q IS NULL) THEN 'remove' WHEN (x IS NULL OR p IS NULL) AND y IS NOT NULL AND q IS NOT NULL THEN 'insert' END AS op, p AS "from", q AS "to" FROM j) SELECT * FROM o WHERE op IS NOT NULL""")  # fmt: skip
_add("local_index_rows", lambda spark, sf: _kept(_mapped(spark, sf)).where("value is not null and part is not null").groupBy("part").agg(F.count("*").alias("n")), f"{_LOG} SELECT part, count(*) AS n FROM {_STATE()} WHERE value IS NOT NULL AND part IS NOT NULL GROUP BY part")


def _both(spark, sf):
    """A scan of customer with the changes of events: a change is newer than what was scanned."""
    scan = merge.scanned(_t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("value")), ["value"])
    ticks = F.unix_micros(F.col("written").cast("timestamp_ltz"))
    changes = _mapped(spark, sf).select(F.col("user_id").cast("long").alias("user_id"), "value", F.lit(None).cast("long").alias("value__wt"), ticks.alias("ts"), F.col("event_id").alias("tie"), "deleted")
    rows = scan.select("user_id", "value", "value__wt", "ts", "tie", "deleted").unionByName(changes)
    return merge.latest(rows, ["user_id"], ["value"], "ts", "tie", "deleted", times={"value": "value__wt"}).select("user_id", "value")


_add("scan_and_changes", _both, f"{_LOG}, r AS (SELECT c_custkey::BIGINT AS user_id, c_acctbal::DOUBLE AS value, false AS deleted, NULL::TIMESTAMP AS written, -1 AS event_id FROM customer UNION ALL SELECT user_id, value, deleted, written, event_id FROM ch WHERE written IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY written DESC NULLS LAST, event_id) AS k FROM r WHERE deleted OR value IS NOT NULL), u AS (SELECT DISTINCT user_id FROM r) SELECT u.user_id, CASE WHEN NOT deleted THEN value END AS value FROM u LEFT JOIN k ON k.user_id = u.user_id AND k.k = 1")
_NOW = "2024-02-01 00:00:00"
_add("cdc_lag_histogram", lambda spark, sf: measures.histogram(merge.lag(_t(spark, sf, "events"), "ts", F.lit(_NOW).cast("timestamp_ntz")).withColumn("lag", F.col("lag") / 86400), "lag", measures.LAG),
     "SELECT CASE " + " ".join(f"WHEN greatest(epoch(TIMESTAMP '{_NOW}') - epoch(ts), 0) / 86400 <= {b} THEN {i}" for i, b in enumerate(measures.LAG)) + f" ELSE {len(measures.LAG)} END AS bucket, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
_add("change_reread", lambda spark, sf: merge.reread(_mapped(spark, sf).select("event_id", F.col("user_id").cast("long").alias("c_custkey"), "deleted"), _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name").where("c_custkey % 2 = 0"), ["c_custkey"]).select("event_id", "deleted", "c_name"),
     f"{_LOG} SELECT event_id, deleted OR c_custkey IS NULL AS deleted, c_name FROM ch LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id")

# Requests


def _service(spark, sf):
    s = Service(spark)
    s.table("ks", "emb", _v(spark, sf))
    s.table("ks", "docs", _t(spark, sf, "documents"))
    s.create(Index("ks", "every", "emb", ("vec_id",), ("v",), filtering=("label",), metric="EUCLIDEAN", dimension=64, version="1b4e28ba-2fa1-11d2-883f-0016d3cca427"))
    s.create(Index("ks", "by_label", "emb", ("vec_id",), ("v",), partition=("label",), metric="EUCLIDEAN", dimension=64, version="2b4e28ba-2fa1-11d2-883f-0016d3cca427"))
    s.create(Index("ks", "texts", "docs", ("doc_id",), ("text",), kind="fulltext"), fts(spark, sf))
    return s


def _asked(filters, **more):
    return lambda spark, sf: _service(spark, sf).ann("ks", "every", _q(spark, sf), 10, filters, **more).select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity_score", 6).alias("similarity_score"))


_add("route_local_partition", _asked([{"type": "==", "lhs": "label", "rhs": 5}]), _top_sql(cond="label = 5"))
_add("route_local_residual", _asked([{"type": "==", "lhs": "label", "rhs": 5}, {"type": ">", "lhs": "vec_id", "rhs": 50}], allow_filtering=True), _top_sql(cond="label = 5 AND vec_id > 50"))
_add("route_global_filter", _asked([{"type": "IN", "lhs": "vec_id", "rhs": [5, 7, 90]}], allow_filtering=True), _top_sql(cond="vec_id IN (5, 7, 90)"))
_add("route_in_on_partition_is_empty", _asked([{"type": "IN", "lhs": "label", "rhs": [5]}]), _top_sql(cond="false"))
_add("index_status", lambda spark, sf: _service(spark, sf).status("ks", "by_label"), "SELECT 'SERVING' AS status, count(*) AS count, 100.0::DOUBLE AS build_progress FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL")
_add("list_indexes_union", lambda spark, sf: _service(spark, sf).listed(), "SELECT * FROM (VALUES ('ks', 'every'), ('ks', 'by_label'), ('ks', 'texts')) x(keyspace, \"index\")")
_add("service_bm25", lambda spark, sf: _service(spark, sf).bm25("ks", "texts", "que NOT le", 20).select("doc_id", F.round("score", 6).alias("score")), SQL["bm25_not"])
_add("build_progress", lambda spark, sf: measures.progress(_t(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("length"), (F.col("o_orderstatus") == "F").alias("done")), "length", "done").select(F.round("build_progress", 6).alias("build_progress")),
     "SELECT round(100 * sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey::DOUBLE ELSE 0 END) / sum(o_orderkey::DOUBLE), 6)::DOUBLE AS build_progress FROM orders")
_add("dirty_indexes", lambda spark, sf: _t(spark, sf, "events").select("event_type").distinct(), "SELECT DISTINCT event_type FROM events")

# Measures


def _recall(spark, sf, probes=4):
    """Of an approximate search: the nearest cells of the inverted file alone."""
    e, index, asked = _index(spark, sf)
    truth = ann.batch(e, "v", "vec_id", asked, "query_id", "qv", 10, "EUCLIDEAN")
    return measures.found_share(index.near(asked, "query_id", "qv", 10, max(probes, len(index.centres) * 2 // 3)), truth, "query_id", "vec_id")


_add("recall_at_k", _recall)
_add("recall_summary", lambda spark, sf: _recall(spark, sf).agg(F.count("*").alias("queries"), F.round(F.min("recall"), 6).alias("recall_min"), F.round(F.avg("recall"), 6).alias("recall_avg"), F.round(F.max("recall"), 6).alias("recall_max")))


def _bucketed(spark, sf):
    return datasets.bucketed(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


_K, _CYCLE = datasets.cycle()
_DEALT = f"(SELECT id, ({_CYCLE})[(CASE WHEN place < {len(_CYCLE)} THEN place ELSE {_K} + (place - {_K}) % {len(_CYCLE) - _K} END) + 1]::INT AS bucket FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings))"
_add("buckets", _bucketed, f"SELECT id, bucket FROM {_DEALT} WHERE bucket >= 0")
_add("bucket_shares", lambda spark, sf: _bucketed(spark, sf).groupBy("bucket").agg(F.count("*").alias("n")), f"SELECT bucket, count(*) AS n FROM {_DEALT} WHERE bucket >= 0 GROUP BY bucket")


def _swept(spark, sf):
    """The nearest rows of one query in each bucket."""
    rows = _v(spark, sf).join(_bucketed(spark, sf).withColumnRenamed("id", "vec_id"), "vec_id")
    return ann.per_partition(rows, "v", ["vec_id"], "bucket", _q(spark, sf), 3, "EUCLIDEAN").select("bucket", "rank", "vec_id", F.round("distance", 6).alias("distance"))


_add("bucket_sweep", _swept, f"{_CORPUS}, b AS {_DEALT}, p AS (SELECT bucket, vec_id, {_D['EUCLIDEAN']} AS d FROM e, q, b WHERE b.id = vec_id AND bucket >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY d, vec_id)::INT AS rank FROM p) SELECT bucket, rank, vec_id, round(d, 6)::DOUBLE AS distance FROM r WHERE rank <= 3")
_add("search_report", lambda spark, sf: measures.searches(_t(spark, sf, "events").where("value is not null"), "value", "value", 60.0, ["event_type"]).select("event_type", "queries", F.round("qps", 6).alias("qps"), "latency_min", "latency_max", F.round("recall_avg", 6).alias("recall_avg")),
     "SELECT event_type, count(*) AS queries, round(count(*) / 60.0::DOUBLE, 6)::DOUBLE AS qps, min(value) AS latency_min, max(value) AS latency_max, round(avg(value), 6)::DOUBLE AS recall_avg FROM events WHERE value IS NOT NULL GROUP BY event_type")
_add("latency_bins", lambda spark, sf: measures.linear_histogram(_t(spark, sf, "events"), "value", 1.0, 100.0), "SELECT least(greatest(floor((value - 1.0) * 10000 / 99.0), 0), 9999)::INT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")


def _ranking(spark, sf):
    docs, grades = _t(spark, sf, "documents"), _t(spark, sf, "labels").select(F.lit("que").alias("query"), "doc_id", F.col("quality").alias("grade"))
    found = text.ranked(text.bm25(docs, "text", "doc_id", "que", 20), "doc_id", F.col("score").desc()).withColumn("query", F.lit("que"))
    m = measures.ranking(found, grades, "query", "doc_id", 20)
    return m.select("query", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ndcg")))


_add("ranking_quality", _ranking, f"WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25_sql(['que'], _has('que')).replace('round(score, 6)::DOUBLE', 'score')})), g AS (SELECT doc_id, quality AS grade FROM labels), h AS (SELECT count(*) AS hits, min(rank) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM r JOIN g USING (doc_id) WHERE grade > 0), i AS (SELECT sum((pow(2, grade) - 1) / log2(k + 1)) AS ideal FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC) AS k FROM g) WHERE k <= 20), n AS (SELECT sum((grade > 0)::INT) AS relevant FROM g) SELECT 'que' AS query, round(hits / 20.0::DOUBLE, 6)::DOUBLE AS precision, round(hits / relevant::DOUBLE, 6)::DOUBLE AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6)::DOUBLE AS rr, round(coalesce(dcg, 0) / ideal, 6)::DOUBLE AS ndcg FROM h, i, n")
_add("latency_histogram", lambda spark, sf: measures.histogram(_t(spark, sf, "events"), "value", measures.LATENCY), "SELECT CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(measures.LATENCY)) + f" ELSE {len(measures.LATENCY)} END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
_add("latency_percentiles", lambda spark, sf: _t(spark, sf, "events").agg(*(F.round(F.percentile("value", p / 100), 6).alias(f"p{p}") for p in (1, 10, 25, 50, 75, 90, 99))), "SELECT " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6)::DOUBLE AS p{p}" for p in (1, 10, 25, 50, 75, 90, 99)) + " FROM events")


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
