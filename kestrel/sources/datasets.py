"""Readers of vector and text collections."""

from __future__ import annotations

import struct
import tomllib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.session import cut

#: A bucket takes one of so many rows: 50 %, 20 %, 10 %, 5 %, 2 %, 1 %, 0.5 %, 0.2 % and 0.1 % of a collection.
STEPS = (2, 5, 10, 20, 50, 100, 200, 500, 1000)


def vectors_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(id, emb) with single-precision vectors of either list type."""
    return spark.read.parquet(path).select(F.col("id").cast("long").alias("id"), F.col("emb").cast("array<float>").alias("emb"))


def vectors_binary(spark: SparkSession, path: str, integers: bool = False) -> DataFrame:
    """(id, emb) of a file of a count, a dimension and that many little-endian rows; ids are row numbers.

    Tasks read ranges of the file, which every executor must reach.
    """
    with open(path, "rb") as f:
        count, dim = struct.unpack("<II", f.read(8))
    kind = "<i4" if integers else "<f4"

    def run(frames):
        for f in frames:
            for a in range(0, len(f), 8192):
                ids = f["id"].to_numpy()[a : a + 8192]
                with open(path, "rb") as file:
                    file.seek(8 + int(ids[0]) * dim * 4)
                    body = np.frombuffer(file.read(len(ids) * dim * 4), kind).reshape(len(ids), dim)
                yield pd.DataFrame({"id": ids, "emb": list(body)})

    return spark.range(count).mapInPandas(run, f"id long, emb array<{'int' if integers else 'float'}>")


def write_vectors_binary(rows: list[list[float]], path: str) -> None:
    a = np.asarray(rows, "<f4")
    Path(path).write_bytes(struct.pack("<II", *a.shape) + a.tobytes())


def vectors_text(spark: SparkSession, path: str, bucketed: bool = False) -> DataFrame:
    """(id[, bucket], emb) of lines `id, [v, ...]` or `id, bucket, [v, ...]`."""
    line = spark.read.text(path).where("trim(value) != ''")
    part = lambda i: F.trim(F.split_part("value", F.lit(","), F.lit(i))).cast("long")
    emb = F.transform(F.split(F.regexp_extract("value", r"\[(.*)\]", 1), ","), lambda x: F.trim(x).cast("float"))
    return line.select(part(1).alias("id"), *([part(2).alias("bucket")] if bucketed else []), emb.alias("emb"))


def corpus_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema)


def settings(folder: str) -> tuple[str, dict]:
    """(format, its settings) by the table [parquet] or [fbin] of dataset.toml, parquet first; parquet without either."""
    file = Path(folder) / "dataset.toml"
    body = tomllib.loads(file.read_text()) if file.exists() else {}
    return next(((k, body[k]) for k in ("parquet", "fbin") if isinstance(body.get(k), dict)), ("parquet", {}))


def format_of(folder: str) -> str:
    return settings(folder)[0]


def questions(spark: SparkSession, folder: str, limit: int | None = None, bucket: DataFrame | None = None) -> DataFrame:
    """(id, emb, neighbors) of a folder's test.parquet and neighbors.parquet.

    With `bucket`, a table of ids, only neighbours in it count; with `limit` a
    query's first so many count.
    """
    tests, truth = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("test", "neighbors"))
    near = truth.select(F.col("id").cast("long").alias("id"), F.posexplode(F.col("neighbors_id").cast("array<long>")).alias("pos", "neighbor"))
    if bucket is not None:
        near = near.join(bucket.select(F.col("id").cast("long").alias("neighbor")).distinct(), "neighbor", "left_semi")
    lists = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "neighbor"))), lambda x: x["neighbor"]).alias("neighbors"))
    lists = lists.withColumn("neighbors", F.slice("neighbors", 1, limit)) if limit else lists
    one = tests.select(F.col("id").cast("long").alias("id"), F.col("emb").cast("array<float>").alias("emb"))
    return one.join(lists, "id", "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<long>")))


def questions_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, emb) of lines `v, ...`; ids are line numbers from 0."""
    return _numbered(spark, path).select("id", F.transform("parts", lambda x: F.trim(x).cast("float")).alias("emb"))


def truth_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, neighbors) of lines `id, ...`; ids are line numbers from 0."""
    return _numbered(spark, path).select("id", F.transform("parts", lambda x: F.trim(x).cast("long")).alias("neighbors"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(id, parts) of one text file's lines that aren't blank, which a single reader numbers."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    return lines.select(F.posexplode("lines").alias("id", "line")).select(F.col("id").cast("long").alias("id"), F.split("line", ",").alias("parts"))


def attribute(attributes: Column, name: str) -> Column:
    """A named column of a row that keeps its cells in one map of binary values."""
    return F.element_at(attributes, F.lit(name))


def decoded(blob: Column) -> Column:
    """Vectors of tagged binary values: 5 and big-endian floats, or 4 and JSON {"L": [{"N": "..."}]}."""

    @F.pandas_udf("array<float>")
    def read(rows: pd.Series) -> pd.Series:
        import json

        def one(b):
            if not b:
                return None
            if b[0] == 5:
                return np.frombuffer(b[1:], ">f4").astype(np.float32) if len(b) % 4 == 1 else None
            if b[0] == 4:
                try:
                    return np.array([float(x["N"]) for x in json.loads(b[1:])["L"]], np.float32)
                except (ValueError, KeyError, TypeError):
                    return None
            return None

        return rows.map(one)

    return read(blob)


def bucketed(ids: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(id, bucket): each id in order counts for every bucket, and goes to the first whose count is full; the rest has no row.

    A bucket's count then starts over with what is more than a full one. What
    becomes of an id depends on its place in the order alone, and repeats: so
    ids are numbered, range by range, and looked up in one round of the rule.
    """
    before, table = cycle(steps)
    rows = cut(ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    sums = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))  # one row a range
    carry = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    place = F.col("carry") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    at = F.when(F.col("place") < len(table), F.col("place")).otherwise(before + F.pmod(F.col("place") - before, F.lit(len(table) - before)))
    found = rows.join(F.broadcast(carry), "part").select("id", place.alias("place")).select("id", F.element_at(F.array(*map(F.lit, table)), (at + 1).cast("int")).alias("bucket"))
    return found.where("bucket >= 0")


@lru_cache
def cycle(steps: tuple[int, ...] = STEPS) -> tuple[int, list[int]]:
    """(k, buckets): from place k on the buckets repeat those from k to the end."""
    counts, seen, out = [0] * len(steps), {}, []
    while tuple(counts) not in seen:
        seen[tuple(counts)] = len(out)
        out.append(deal(counts, steps))
    return seen[tuple(counts)], out


def deal(counts: list[int], steps: tuple[int, ...] = STEPS) -> int:
    """The bucket of the next id, -1 if none is full; counts are moved on."""
    found = -1
    for i, step in enumerate(steps):
        counts[i] += 1
        if found < 0 and counts[i] >= step:
            found = i
            counts[i] -= step
    return found


def buckets(count: int, steps: tuple[int, ...] = STEPS) -> list[int]:
    """Bucket of each of `count` rows in order, -1 for those that have none."""
    counts = [0] * len(steps)
    return [deal(counts, steps) for _ in range(count)]


def write_buckets(rows: list[tuple[int, int]], path: str) -> None:
    Path(path).write_bytes(b"".join(struct.pack(">qB", i, b) for i, b in rows))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """(id, bucket) of a file of big-endian ids and bytes."""
    size = Path(path).stat().st_size
    if size % 9:
        raise ValueError("a bucket file has 9 bytes a row")

    def run(frames):
        for f in frames:
            if len(f):
                a, n = int(f["id"].iloc[0]), len(f)
                with open(path, "rb") as file:
                    file.seek(a * 9)
                    body = np.frombuffer(file.read(n * 9), [("id", ">i8"), ("bucket", "u1")])
                yield pd.DataFrame({"id": body["id"].astype(np.int64), "bucket": body["bucket"].astype(np.int32)})

    return spark.range(size // 9).mapInPandas(run, "id long, bucket int")
