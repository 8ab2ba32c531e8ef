"""Quality of rankings, histograms and percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERCENTS = (1, 10, 25, 50, 75, 90, 99)
LATENCY = (0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
LAG = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def recall(found: Column, truth: Column, k: int) -> Column:
    """Share of the first min(k, n) true ids among the found ones; 1 if there are none."""
    first = F.slice(truth, 1, k)
    return F.when(F.size(first) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), first)) / F.size(first))


def ranking(results: DataFrame, grades: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, precision, recall, rr, ndcg) at k of ranked results (query, rank, key) against graded ones (query, key, grade).

    Queries are those of grades. A position from 200 on is discounted by its
    number instead of its logarithm.
    """
    at = lambda i: F.when(i <= 200, F.log2(i + 1)).otherwise(i + 1)
    top = results.where(F.col("rank") <= k)
    hits = grades.where("grade > 0").join(top, [query, key]).groupBy(query).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), "grade") - 1) / at(F.col("rank"))).alias("dcg"))
    lists = grades.groupBy(query).agg(F.sort_array(F.collect_list(F.col("grade").cast("double")), asc=False).alias("g"), F.sum((F.col("grade") > 0).cast("int")).alias("relevant"))
    gain = F.transform(F.slice("g", 1, k), lambda x, i: (F.pow(F.lit(2.0), x) - 1) / at(i + 1))
    ideal = F.aggregate(gain, F.lit(0.0), lambda a, x: a + x)
    both = lists.join(hits, query, "left")
    n = F.coalesce("hits", F.lit(0))
    return both.select(query, F.when(F.col("relevant") == 0, 0.0).otherwise(n / k).alias("precision"), F.when(F.col("relevant") == 0, 1.0).otherwise(n / F.col("relevant")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), F.when(ideal > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """(bucket, n): rows by the first bound that isn't below the value; the last bucket has none."""
    c = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        c = F.when(F.col(value) <= bounds[i], i).otherwise(c)
    return df.where(F.col(value).isNotNull()).groupBy(c.alias("bucket")).agg(F.count("*").alias("n"))


def linear_histogram(df: DataFrame, value: str, least: float, most: float, bins: int = 10_000) -> DataFrame:
    """(bin, n): rows by equal bins between least and most; what is beyond either goes to the first or last one."""
    at = F.floor((F.col(value) - least) * bins / (most - least))
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentiles(histogram: DataFrame, least: float, most: float, percents: Sequence[float] = PERCENTS, bins: int = 10_000) -> DataFrame:
    """(percent, value): the upper end of the bin that holds each percentile of a linear histogram."""
    run = histogram.select("bin", F.sum("n").over(Window.orderBy("bin")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))  # at most `bins` rows
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in percents))).alias("percent")
    hits = run.select("*", wanted).where(F.col("upto") >= F.col("percent") / 100 * F.col("total"))
    return hits.groupBy("percent").agg((least + (F.min("bin") + 1) * (most - least) / bins).alias("value"))


def searches(df: DataFrame, recall_: str | None, latency: str, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., queries, qps, latency_min, latency_max[, recall_min, recall_avg, recall_max]) of measured searches."""
    out = [F.count("*").alias("queries"), (F.count("*") / F.lit(float(seconds))).alias("qps"), F.min(latency).alias("latency_min"), F.max(latency).alias("latency_max")]
    if recall_:
        out += [F.min(recall_).alias("recall_min"), F.avg(recall_).alias("recall_avg"), F.max(recall_).alias("recall_max")]
    return df.groupBy(*by).agg(*out)


def found_share(found: DataFrame, truth: DataFrame, query: str, key: str) -> DataFrame:
    """(query, recall): the share of each query's true keys that were found; both are rows (query, key)."""
    hits = truth.select(query, key).distinct().join(found.select(query, key, F.lit(1).alias("__hit")).distinct(), [query, key], "left")
    return hits.groupBy(query).agg((F.count("__hit") / F.count("*")).alias("recall"))


def progress(ranges: DataFrame, length: str, done: str) -> DataFrame:
    """(build_progress): the per cent of the key space whose ranges are scanned; 100 of none."""
    covered = F.sum(F.when(F.col(done), F.col(length).cast("double")).otherwise(0.0))
    return ranges.agg(F.coalesce(100 * covered / F.sum(F.col(length).cast("double")), F.lit(100.0)).alias("build_progress"))
