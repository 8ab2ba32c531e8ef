"""Change streams: the newest write of each cell wins, whatever the order of arrival."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from kestrel.session import drop_path, latest_json, scratch, write_json

#: Kinds of change that are a write, and those that take a row away; pre-images and deleted ranges say nothing of a row.
UPSERTS = ("row_insert", "row_update", "post_image")
DELETES = ("row_delete", "partition_delete")
#: Time of a cell that a scan reads without one: any change is newer.
EARLIEST = 0
#: Seconds between triggers, and how far behind the present each of the two readers of a change log stays.
WIDE, FINE = (10.0, 30.0), (0.5, 0.1)


def _newest(cells: Sequence[str], wrote: Callable[[str], Column], value: Callable[[str], Column], ts: Callable[[str], Column], tie: Callable[[str], Column]) -> list[Column]:
    """Each cell's value, time and tie-break of its newest write; of equal times the lowest tie-break wins."""
    out = []
    for c in cells:
        order = F.when(wrote(c), F.struct(ts(c), -tie(c)))
        out += [F.max_by(F.struct(value(c).alias("v")), order)["v"].alias(c), F.max(F.when(wrote(c), ts(c))).alias(f"{c}__ts"), F.max_by(tie(c), order).alias(f"{c}__tie")]
    return out


def latest(changes: DataFrame, key: Sequence[str], cells: Sequence[str], ts: str, tie: str, deleted: str | None = None, kept: Sequence[str] = (), times: Mapping[str, str] | None = None) -> DataFrame:
    """(key..., each cell, cell__ts, cell__tie): per key and cell the value of the newest change that has one.

    A change with `deleted` true sets every cell but the `kept` ones (those a
    local index is partitioned by) to null at its time; a null cell of another
    change isn't a write. `times` names columns with write times of their own;
    where one is null the change's time counts. Of equal times the first by
    `tie`, a number, wins. Rows without a key or time are left out; deleted
    rows stay, with nulls, so that an older late write can't bring them back.
    """
    times = times or {}
    rows = changes.dropna(subset=[*key, ts])
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    drops = lambda c: F.lit(False) if c in kept else gone
    at = lambda c: F.when(gone, F.col(ts)).otherwise(F.coalesce(times[c], ts)) if c in times else F.col(ts)
    return rows.groupBy(*key).agg(*_newest(cells, lambda c: drops(c) | F.col(c).isNotNull(), lambda c: F.when(~drops(c), F.col(c)), at, lambda c: F.col(tie)))


def combine(old: DataFrame, new: DataFrame, key: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Two results of latest as one: what latest gives for the changes of both. Merging twice changes nothing."""
    return old.unionByName(new).groupBy(*key).agg(*_newest(cells, lambda c: F.col(f"{c}__ts").isNotNull(), F.col, lambda c: F.col(f"{c}__ts"), lambda c: F.col(f"{c}__tie")))


def scanned(table: DataFrame, cells: Sequence[str], tie: int = -1) -> DataFrame:
    """Rows of a full scan as changes: each cell's time from `cell__wt`, else EARLIEST; at equal times a scanned row comes first."""
    have = [F.coalesce(F.col(f"{c}__wt"), F.lit(EARLIEST)).alias(f"{c}__wt") if f"{c}__wt" in table.columns else F.lit(EARLIEST).cast("long").alias(f"{c}__wt") for c in cells]
    rest = [c for c in table.columns if not c.endswith("__wt")]
    return table.select(*rest, *have, F.lit(EARLIEST).cast("long").alias("ts"), F.lit(tie).cast("long").alias("tie"), F.lit(False).alias("deleted"))


def mapped(changes: DataFrame, key: Sequence[str], op: str, ts: str, write_time: str | None = None) -> DataFrame:
    """Changes with `deleted` and `written`: kinds that say nothing of a row, and changes without a key, are left out.

    `written` is the write time, or the change's own where there is none. A row that
    expires comes as one that is deleted.
    """
    rows = changes.where(F.col(op).isin(*UPSERTS, *DELETES)).dropna(subset=list(key))
    written = F.coalesce(write_time, ts) if write_time else F.col(ts)
    return rows.withColumn("deleted", F.col(op).isin(*DELETES)).withColumn("written", written)


def reread(changes: DataFrame, table: DataFrame, key: Sequence[str], deleted: str = "deleted") -> DataFrame:
    """Changes with the table's present cells; an upsert whose row is gone by now is a delete."""
    there = table.withColumn("__there", F.lit(True))
    cells = [c for c in table.columns if c not in key]
    rows = changes.drop(*cells).join(there, list(key), "left")
    return rows.withColumn(deleted, F.col(deleted) | F.col("__there").isNull()).drop("__there")


def classify(before: DataFrame, after: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """(key..., op): insert, update or remove, as the target value of a snapshot changed."""
    a, b = before.select(*key, F.col(target).alias("__a"), F.lit(1).alias("__in")), after.select(*key, F.col(target).alias("__b"))
    op = F.when(F.col("__a").isNull() & F.col("__b").isNotNull(), "insert").when(F.col("__a").isNotNull() & F.col("__b").isNull(), "remove").when(~F.col("__a").eqNullSafe(F.col("__b")), "update")
    return a.join(b, list(key), "full_outer").select(*key, op.alias("op")).where("op is not null")


def moves(before: DataFrame, after: DataFrame, key: Sequence[str], target: str, partition: str) -> DataFrame:
    """(key..., op, from, to): what a local index does, by target value and partition before and after.

    A row is indexed where both are there. One that stays indexed and changes
    its partition moves, also at an equal target; without a partition it is
    removed.
    """
    a = before.select(*key, F.col(target).alias("__a"), F.col(partition).alias("from"))
    b = after.select(*key, F.col(target).alias("__b"), F.col(partition).alias("to"))
    was, now = (F.col(v).isNotNull() & F.col(p).isNotNull() for v, p in (("__a", "from"), ("__b", "to")))
    op = F.when(was & now & (F.col("from") != F.col("to")), "move").when(was & now & (F.col("__a") != F.col("__b")), "update").when(was & ~now, "remove").when(~was & now, "insert")
    return a.join(b, list(key), "full_outer").select(*key, op.alias("op"), "from", "to").where("op is not null")


def unrepeated(changes: DataFrame, key: Sequence[str], ts: str, op: str, tie: str) -> DataFrame:
    """Changes without those that repeat the change before them of the same key in time and kind."""
    w = Window.partitionBy(*key).orderBy(ts, tie)
    same = F.lag(ts).over(w).eqNullSafe(F.col(ts)) & F.lag(op).over(w).eqNullSafe(F.col(op))
    return changes.dropna(subset=list(key)).withColumn("__same", F.coalesce(same, F.lit(False))).where("not __same").drop("__same")


def lag(changes: DataFrame, ts: str, now: Column) -> DataFrame:
    """changes with lag, the seconds from ts to now, 0 at least."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    return changes.withColumn("lag", F.greatest(seconds(now) - seconds(F.col(ts)), F.lit(0.0)))


def settled(changes: DataFrame, ts: str, now: Column, behind: float) -> DataFrame:
    """The changes that are at least `behind` seconds old: what a reader that stays behind the present sees."""
    return changes.where(F.col(ts) <= now - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {behind})"))


def change_log(spark: SparkSession, path: str, schema: StructType | str, files: int = 1000) -> DataFrame:
    """A stream of the change files of a folder, at most `files` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def kept_running(start: Callable[[], StreamingQuery], restarts: int, wait: float = 5.0) -> int:
    """Wait for start()'s query; start it again `wait` seconds after an error, `restarts` times at most; how often that was."""
    for n in range(restarts + 1):
        try:
            start().awaitTermination()
            return n
        except Exception:
            if n == restarts:
                raise
            time.sleep(wait)
    return restarts


class Snapshot:
    """A snapshot that a stream keeps up to date in a folder.

    Rows lie in buckets by a hash of their key. A micro-batch rewrites the
    buckets that it touches and then commits a manifest with its number, by a
    rename that replaces nothing; so a restart goes on from what was
    committed, a replayed batch is known by its number, and readers of the
    version before still find its files. Older ones are deleted.
    """

    def __init__(self, key: Sequence[str], cells: Sequence[str], ts: str, tie: str, deleted: str | None = None, root: str | None = None, buckets: int = 16, kept: Sequence[str] = (), times: Mapping[str, str] | None = None):
        self.key, self.cells, self.ts, self.tie, self.deleted = key, cells, ts, tie, deleted
        self.root, self.buckets, self.kept, self.times = root, buckets, kept, times

    def _state(self, spark: SparkSession) -> dict:
        return (self.root and latest_json(spark, f"{self.root}/manifests")) or {"batch": -1, "version": 0, "buckets": {}}

    @property
    def path(self) -> str | None:
        """A path that reads the whole snapshot; None before the first batch."""
        state = self._state(SparkSession.active())
        return f"{self.root}/{{{','.join(sorted(set(state['buckets'].values())))}}}" if state["buckets"] else None

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Merge one micro-batch; a replayed one changes nothing."""
        spark = changes.sparkSession
        self.root = self.root or scratch(spark, "snapshot")
        state = self._state(spark)
        if batch <= state["batch"]:
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        new = latest(changes, self.key, self.cells, self.ts, self.tie, self.deleted, self.kept, self.times)
        touched = [r[0] for r in changes.dropna(subset=[*self.key, self.ts]).select(bucket).distinct().collect()]  # at most `buckets` numbers
        if touched:
            old = [f"{self.root}/{state['buckets'][str(b)]}" for b in touched if str(b) in state["buckets"]]
            merged = combine(spark.read.schema(new.schema).parquet(*old), new, self.key, self.cells) if old else new
            name = f"v{state['version'] + 1}-{batch}"
            drop_path(spark, f"{self.root}/{name}")  # what a failed attempt at this batch left
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        before = {*state["buckets"].values(), *state.get("before", ())}
        now = state["buckets"] | {str(b): f"{name}/bucket={b}" for b in touched}
        write_json(spark, f"{self.root}/manifests", state["version"] + 1, {"batch": batch, "version": state["version"] + 1, "buckets": now, "before": sorted(state["buckets"].values())})
        for gone in before - {*now.values(), *state["buckets"].values()}:
            drop_path(spark, f"{self.root}/{gone}")

    def read(self, spark: SparkSession) -> DataFrame:
        """(key..., each cell, cell__ts, cell__tie) as of the last committed batch."""
        return spark.read.parquet(self.path)

    def start(self, stream: DataFrame, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
        """No watermark: late changes count, and deleted rows are kept. With `seconds` it goes on, triggered so often."""
        self.root = self.root or f"{checkpoint.rstrip('/')}-snapshot"  # found again by whoever restarts from this checkpoint
        when = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**when).start()
