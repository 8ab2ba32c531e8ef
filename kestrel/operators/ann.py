"""Nearest neighbours: exact, filtered, local, batched, rescored, and an inverted-file index."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from kestrel.functions.distance import KINDS, similarity
from kestrel.operators.filters import Restriction, where
from kestrel.session import cut


def _checked(limit: int, query: Sequence[float], dimension: int | None) -> None:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has {len(query)} dimensions, the index {dimension}")


def exact(kind: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of vectors q and x, row by row (either may be a single one), in double precision."""
    if kind == "EUCLIDEAN":
        return ((q - x) ** 2).sum(-1)
    if kind == "HAMMING":
        return ((q > 0) != (x > 0)).sum(-1).astype(float)
    d = (q * x).sum(-1)
    if kind == "DOT_PRODUCT":
        return 1 - d
    if kind != "COSINE":
        raise ValueError(f"unknown metric {kind}")
    norms = np.sqrt((q * q).sum(-1)) * np.sqrt((x * x).sum(-1))
    return np.where(norms == 0, 1.0, np.clip(1 - d / np.where(norms == 0, 1, norms), 0, 2))


def rough(kind: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all q from all x by one matrix product, and how much rounding may have moved them."""
    if kind == "HAMMING":
        a, b = (q > 0).astype(float), (x > 0).astype(float)
        return a.sum(1)[:, None] + b.sum(1)[None] - 2 * a @ b.T, np.full((len(q), 1), 0.5)
    both = q @ x.T
    if kind == "EUCLIDEAN":
        size = (q * q).sum(1)[:, None] + (x * x).sum(1)[None]
        return size - 2 * both, 1e-9 * (1 + size.max(1, keepdims=True))
    if kind == "DOT_PRODUCT":
        return 1 - both, 1e-9 * (1 + np.abs(both).max(1, keepdims=True))
    if kind != "COSINE":
        raise ValueError(f"unknown metric {kind}")
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
    return np.where(norms == 0, 1.0, np.clip(1 - both / np.where(norms == 0, 1, norms), 0, 2)), np.full((len(q), 1), 1e-9)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors of one length as rows; a null among the numbers is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dimension)


def _finite(vec: Column) -> Column:
    """Whether a vector has numbers, and none of them is null, NaN or infinite."""
    return (F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < math.inf, F.lit(False)))


def codes(x: np.ndarray) -> np.ndarray:
    """I8 codes, as functions.quantize.i8 makes them."""
    return np.clip(np.sign(x) * np.floor(np.abs(x) * 127 + 0.5), -127, 127)


def scored(df: DataFrame, vec: str, keep: Sequence[str], query: Sequence[float], kind: str, most: int | None = None, order: Sequence[str] = (), coded: bool = False) -> DataFrame:
    """(keep..., distance) of the rows whose vector has the query's length and a distance.

    Vectors go to numpy as Arrow batches. With `most` a task hands on its
    `most` nearest rows only, ties by `order`; it holds no more than that and
    one batch.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown metric {kind}")
    q = np.asarray(query, np.float64)
    q = codes(q) if coded else q
    size, by = len(q), [("distance", "ascending"), *((c, "ascending") for c in order)]
    rows = df.where(F.size(vec) == size).select(*keep, F.col(vec).cast("array<double>").alias("__v"))
    kinds = StructType([*(df.schema[c] for c in keep), StructField("distance", DoubleType())])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(len(keep)), size)
            gone = np.isnan(x).any(1)
            d = exact(kind, q, codes(x) if coded else x)
            if kind != "HAMMING":
                d = np.where(gone, np.nan, d)
            fine = pa.array(~np.isnan(d))
            some = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(d)], kinds.names).filter(fine)
            if most is None:
                yield some
                continue
            held = pa.Table.from_batches([some] if held is None else [*held.to_batches(), some])
            if held.num_rows > most:
                held = held.take(pc.select_k_unstable(held, most, by))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return rows.mapInArrow(run, kinds)


def search(df: DataFrame, vec: str, key: Sequence[str], query: Sequence[float], limit: int = 1, kind: str = "COSINE", filters: Sequence[Restriction] = (), dimension: int | None = None) -> DataFrame:
    """(key..., distance, similarity_score): the `limit` nearest rows that fulfil all filters.

    Equality on partition columns prunes the scan. Null vectors and keys are
    left out, and so are vectors of another length; ties go by key.
    """
    _checked(limit, query, dimension)
    rows = where(df, filters).dropna(subset=list(key))
    found = scored(rows, vec, key, query, kind, limit, key).orderBy("distance", *key).limit(limit)
    return found.withColumn("similarity_score", similarity(kind, F.col("distance"), len(query)))


def batch(df: DataFrame, vec: str, key: str, queries: DataFrame, query_id: str, query_vec: str, limit: int, kind: str = "COSINE") -> DataFrame:
    """(query_id, rank, key, distance) of each query's nearest rows, ties by key.

    Each task compares its vectors with all queries, a matrix product a block,
    and keeps one list of `limit` rows a query over all its batches, so that
    only those are shuffled. Queries are sent to every task, 4096 at a time.
    Vectors that are null, empty, have a null or NaN in them, or another
    length than the query are left out.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown metric {kind}")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = df.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where("k is not null and v is not null")
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where("q is not null and size(v) > 0")
    kinds = StructType([StructField("q", queries.schema[query_id].dataType), StructField("k", df.schema[key].dataType), StructField("distance", DoubleType())])
    sizes = [r[0] for r in asked.select(F.size("v")).distinct().orderBy(F.size("v")).limit(64).collect()]
    if len(sizes) > 63:
        raise ValueError("the queries have too many different dimensions")
    n = max(1, math.ceil(asked.count() / 4096))
    out = None
    for size in sizes:
        for i in range(n):
            got = asked.where((F.size("v") == size) & (F.pmod(F.xxhash64("q"), F.lit(n)) == i)).collect()
            if not got:
                continue
            ids, q = np.array([r[0] for r in got]), np.array([r[1] for r in got], np.float64)

            def run(batches, ids=ids, q=q, size=size):
                best = Nearest(len(q), limit)
                for batch in batches:
                    x, k = _matrix(batch.column(1), size), batch.column(0).to_numpy(zero_copy_only=False)
                    fine = ~np.isnan(x).any(1)
                    x, k = x[fine], k[fine]
                    for a in range(0, len(x), 4096):
                        for b in range(0, len(q), 1024):
                            best.add(kind, q[b : b + 1024], x[a : a + 4096], k[a : a + 4096], b)
                if best.k is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.k), pa.array(best.d)], kinds.names).cast(to_arrow_schema(kinds))

            own = rows.where(F.size("v") == size).mapInArrow(run, kinds)
            out = own if out is None else out.union(own)
    if out is None:
        out = df.sparkSession.createDataFrame([], kinds)
    w = Window.partitionBy("q").orderBy("distance", "k")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(F.col("q").alias(query_id), "rank", F.col("k").alias(key), "distance")


class Nearest:
    """The `limit` nearest keys of each of n queries so far, as rows (q, d, k) in order of q, d and k."""

    def __init__(self, n: int, limit: int):
        self.limit, self.last = limit, np.full(n, np.inf)
        self.q, self.d, self.k = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, kind: str, q: np.ndarray, x: np.ndarray, k: np.ndarray, at: int = 0) -> None:
        """Look at vectors x with keys k for the queries q, the first of which is number `at`."""
        d, slack = rough(kind, q, x)
        most = self.last[at : at + len(q), None]
        if len(x) > self.limit and np.isinf(most).any():
            most = np.minimum(most, np.partition(d, self.limit - 1, 1)[:, self.limit - 1 : self.limit])
        i, j = np.nonzero(d <= most + slack)
        if not len(i):
            return
        qs, ds, ks = np.concatenate([self.q, i + at]), np.concatenate([self.d, exact(kind, q[i], x[j])]), k[j] if self.k is None else np.concatenate([self.k, k[j]])
        turn = np.lexsort((ks, ds, qs))
        qs, ds, ks = qs[turn], ds[turn], ks[turn]
        place = np.arange(len(qs)) - np.searchsorted(qs, qs)
        use = place < self.limit
        self.q, self.d, self.k = qs[use], ds[use], ks[use]
        full = self.q[place[use] == self.limit - 1]
        self.last[full] = self.d[place[use] == self.limit - 1]


def per_partition(df: DataFrame, vec: str, key: Sequence[str], part: str, query: Sequence[float], limit: int, kind: str = "COSINE") -> DataFrame:
    """The nearest rows of each local partition; rows without a partition aren't indexed."""
    rows = scored(df.where(F.col(part).isNotNull()), vec, [part, *key], query, kind)
    w = Window.partitionBy(part).orderBy("distance", *key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rescored(df: DataFrame, vec: str, key: Sequence[str], query: Sequence[float], limit: int, kind: str = "EUCLIDEAN", oversampling: float = 1.0) -> DataFrame:
    """The nearest by I8 codes, oversampling times as many, then ranked by exact distances."""
    _checked(limit, query, None)
    if oversampling < 1:
        raise ValueError("oversampling must be at least 1")
    most = math.ceil(limit * oversampling)
    near = scored(df, vec, [*key, vec], query, kind, most, key, coded=True).orderBy("distance", *key).limit(most)
    return scored(near.drop("distance"), vec, key, query, kind).orderBy("distance", *key).limit(limit)


def quantized(df: DataFrame, vec: str, key: Sequence[str], query: Sequence[float], limit: int, kind: str = "EUCLIDEAN") -> DataFrame:
    """The nearest by I8 codes alone."""
    return scored(df, vec, key, query, kind, limit, key, coded=True).orderBy("distance", *key).limit(limit)


class InvertedFile:
    """Vectors in cells by their nearest centre, written partitioned by cell; a search reads the `probes` nearest cells only."""

    def __init__(self, path: str, centres: np.ndarray, vec: str, key: str, schema: StructType | None = None):
        self.path, self.centres, self.vec, self.key, self.schema = path, centres, vec, key, schema

    def rows(self, spark) -> DataFrame:
        """Every row with its cell; the schema is given, as no file has it where no vector is indexed."""
        return (spark.read.schema(self.schema) if self.schema else spark.read).parquet(self.path)

    @classmethod
    def build(cls, df: DataFrame, vec: str, key: str, path: str, cells: int = 16, seed: int = 1) -> InvertedFile:
        """Centres by k-means over all vectors, a Spark job a round, then one pass that writes all rows.

        Vectors that are null, empty, have a null, NaN or infinity in them, or
        another length than most have aren't indexed.
        """
        fine = F.col(vec).isNotNull() & _finite(F.col(vec))
        size = df.where(fine).groupBy(F.size(vec).alias("size")).count().orderBy(F.col("count").desc(), "size").limit(1).collect()
        df = df.where(fine & (F.size(vec) == (size[0]["size"] if size else 0)))
        rows = df.select(F.col(vec).cast("array<double>").alias("v"))
        some = [r.v for r in rows.orderBy(F.xxhash64("v", F.lit(seed))).limit(cells).collect()]
        centres = np.array(some) if some else np.zeros((1, 1))
        for _ in range(12 if some else 0):

            def sums(frames, centres=centres):
                total, n = np.zeros_like(centres), np.zeros(len(centres))
                for f in frames:
                    x = np.stack(f["v"].to_numpy())
                    near = ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(centres))
                at = np.flatnonzero(n)
                if len(at):  # a task may have no rows, and pandas no type for an empty column of lists
                    yield pd.DataFrame({"cell": at, "n": n[at], "total": list(total[at])})

            every = rows.mapInPandas(sums, "cell long, n double, total array<double>").groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(centres.shape[1])))
            centres = centres.copy()
            for r in every.collect():
                centres[r[0]] = np.array(r[2:]) / r[1]

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            a = np.stack(v.to_numpy()).astype(float)
            return pd.Series(((centres * centres).sum(1)[None] - 2 * a @ centres.T).argmin(1).astype(np.int32))

        dealt = df.withColumn("cell", cell(F.col(vec)))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(path)
        return cls(path, centres, vec, key, dealt.schema)

    def search_list(self, spark, query: Sequence[float], limit: int, listed: int = 64, kind: str = "EUCLIDEAN") -> DataFrame:
        """A search that looks at `listed` rows or `limit`, whichever is more, by reading nearest cells until they have so many; it takes no filter."""
        sizes = {r["cell"]: r["count"] for r in self.rows(spark).groupBy("cell").count().collect()}  # one row a cell
        near = exact(kind, np.asarray(query, np.float64)[None], self.centres).argsort(kind="stable")
        seen = np.cumsum([sizes.get(int(c), 0) for c in near])
        return self.search(spark, query, limit, 1 + int(np.searchsorted(seen, max(limit, listed))), kind)

    def search(self, spark, query: Sequence[float], limit: int, probes: int = 4, kind: str = "EUCLIDEAN") -> DataFrame:
        q = np.asarray(query, np.float64)
        near = exact(kind, q[None], self.centres).argsort(kind="stable")[:probes]  # by the metric that is asked for
        rows = self.rows(spark).where(F.col("cell").isin([int(i) for i in near]))
        return search(rows, self.vec, [self.key], query, limit, kind)

    def near(self, queries: DataFrame, query_id: str, query_vec: str, limit: int, probes: int = 4) -> DataFrame:
        """(query_id, rank, key, distance) of the nearest rows, by squared Euclidean distance, in each query's `probes` nearest cells: some may be missed."""
        return self.search_all(queries, query_id, query_vec, limit, probes, missed=True)

    def search_all(self, queries: DataFrame, query_id: str, query_vec: str, limit: int, probes: int = 4, missed: bool = False) -> DataFrame:
        """(query_id, rank, key, distance) of each query's nearest rows by squared Euclidean distance, none missed.

        The `probes` nearest cells bound a query's last distance; then each
        other cell is read that may hold something nearer, by the triangle
        inequality with the cell's radius.
        """
        spark, centres, key = queries.sparkSession, self.centres, self.key
        rows = self.rows(spark).select("cell", F.col(key).alias("k"), F.col(self.vec).cast("array<double>").alias("v")).where("k is not null")
        gap = lambda x: np.sqrt(np.maximum(((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T), 0))

        def radii(frames):
            for f in frames:
                far = gap(np.stack(f["v"].to_numpy()))[np.arange(len(f)), f["cell"]]
                yield pd.DataFrame({"cell": f["cell"], "far": far}).groupby("cell", as_index=False).max()

        radius = np.full(len(centres), -np.inf)
        for r in rows.mapInPandas(radii, "cell int, far double").groupBy("cell").agg(F.max("far")).collect():
            radius[r[0]] = r[1]
        asked = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where(F.size("v") == centres.shape[1]).where("q is not null").where(_finite(F.col("v")))

        def nearest(q):
            """(distance to each centre, whether the cell is among the `probes` nearest)."""
            d = gap(q)
            near = np.zeros(d.shape, bool)
            np.put_along_axis(near, np.where(radius >= 0, d, np.inf).argsort(1, kind="stable")[:, :probes], True, 1)
            return d, near & (radius >= 0)[None]

        def routed(frames):
            for f in frames:
                i, cell = np.nonzero(nearest(np.stack(f["v"].to_numpy()))[1])
                yield pd.DataFrame({"cell": cell, "q": f["q"].to_numpy()[i], "v": f["v"].to_numpy()[i]})

        def blocks(df, *cols):  # of one cell each, and of bounded size
            w = Window.partitionBy("cell").orderBy(cols[0])
            return df.withColumn("b", F.floor((F.row_number().over(w) - 1) / 1024)).groupBy("cell", "b").agg(F.collect_list(F.struct(*cols)).alias(cols[0] + "s")).drop("b")

        def compared(frames):
            for f in frames:
                for qs, ks in zip(f["qs"], f["ks"], strict=True):
                    q, x = np.array([r["v"] for r in qs]), np.array([r["v"] for r in ks])
                    ids, k = np.array([r["q"] for r in qs]), np.array([r["k"] for r in ks])
                    order = np.argsort(k, kind="stable")
                    x, k = x[order], k[order]
                    best = ((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T).argsort(1, kind="stable")[:, : limit + 8]
                    d = ((q[:, None] - x[best]) ** 2).sum(2)  # exact for those, so that ties go by key
                    turn = np.lexsort((best, d))[:, :limit]
                    best, d = np.take_along_axis(best, turn, 1), np.take_along_axis(d, turn, 1)
                    yield pd.DataFrame({"q": np.repeat(ids, best.shape[1]), "k": k[best].ravel(), "distance": d.ravel()})

        out = f"q {asked.schema['q'].dataType.simpleString()}, k {rows.schema['k'].dataType.simpleString()}, distance double"
        pairs = blocks(asked.mapInPandas(routed, f"cell int, q {asked.schema['q'].dataType.simpleString()}, v array<double>"), "q", "v")
        w = Window.partitionBy("q").orderBy("distance", "k")
        best = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
        rough = cut(best(pairs.join(blocks(rows, "k", "v"), "cell").select("qs", "ks").mapInPandas(compared, out)), "rough").drop("rank")
        if missed:
            return best(rough).select(F.col("q").alias(query_id), "rank", F.col("k").alias(key), "distance")
        last = rough.groupBy("q").agg(F.max("distance").alias("last"), F.count("*").alias("n")).where(F.col("n") >= limit).select("q", "last")
        asked = cut(asked.join(last, "q", "left"), "asked")
        found, n = rough, max(1, math.ceil(asked.count() / 4096))
        for b in range(n):
            got = asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b).collect()
            if not got:
                continue
            ids, q, most = np.array([r["q"] for r in got]), np.array([r["v"] for r in got]), np.array([np.inf if r["last"] is None else r["last"] for r in got])
            d, near = nearest(q)
            need = ~near & (d - radius[None] <= np.sqrt(most)[:, None] + 1e-6 * (1 + d))

            def nearer(frames, ids=ids, q=q, most=most, need=need):
                for f in frames:
                    for a in range(0, len(f), 1024):
                        x, k, cell = np.stack(f["v"].to_numpy()[a : a + 1024]), f["k"].to_numpy()[a : a + 1024], f["cell"].to_numpy()[a : a + 1024]
                        for c in range(0, len(q), 256):
                            p, top = q[c : c + 256], most[c : c + 256]
                            size = (p * p).sum(1)[:, None] + (x * x).sum(1)[None]
                            i, j = np.nonzero((size - 2 * p @ x.T <= top[:, None] + 1e-9 * (1 + size)) & need[c : c + 256][:, cell])
                            d = ((p[i] - x[j]) ** 2).sum(1)
                            turn = np.lexsort((k[j], d, i))
                            i, j, d = i[turn], j[turn], d[turn]
                            use = (np.arange(len(i)) - np.searchsorted(i, i) < limit) & (d <= top[i])
                            if use.any():
                                yield pd.DataFrame({"q": ids[c + i[use]], "k": k[j[use]], "distance": d[use]})

            cells = [int(i) for i in np.flatnonzero(need.any(0))]
            if cells:
                found = found.union(rows.where(F.col("cell").isin(cells)).mapInPandas(nearer, out))
        return best(found).select(F.col("q").alias(query_id), "rank", F.col("k").alias(key), "distance")
