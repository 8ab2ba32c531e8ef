"""Size-tiered compaction of immutable shards under an atomically committed, versioned manifest."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrel.llm.names import fresh
from kestrel.session import scratch

#: Size of a finished shard.
TARGET = 128 << 20
#: Runs of one tier that are merged together; a tier's sizes differ by at most this factor.
FANOUT = 4
#: Sizes below this are one tier.
SMALLEST = 1 << 20
#: Seconds after which a write that was announced and never committed counts as dead.
DEAD = 7 * 86400


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


class ShardStore:
    """A folder of Parquet shards and manifests.

    A shard is never changed. A manifest lists the shards of one version; it
    is written beside and renamed into place without overwriting, so of two
    writers of a version one fails with Conflict, and readers see either the
    old version or the new one. A writer announces its folder in `intents`
    before it writes and takes that back once it has committed, so that
    vacuum() spares what is being written. A job that dies leaves files that
    no manifest names. Reading an old version works until vacuum().
    """

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        if target < 1 or fanout < 2:
            raise ValueError("target must be positive and fanout at least 2")
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], StructType | None]:
        """(version, shards, schema) of a version, the last by default; 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return 0, [], None
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        body = json.loads(text)
        return version, [Shard(s["path"], s["size"]) for s in body["shards"]], StructType.fromJson(body["schema"])

    def commit(self, base: int, shards: list[Shard], schema: StructType) -> int:
        """Make shards the version after base, or raise Conflict."""
        body = json.dumps({"version": base + 1, "schema": schema.jsonValue(), "shards": [{"path": s.path, "size": s.size} for s in shards]})
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            # FileContext's rename without options never replaces a file.
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.isAbsolute() and draft.toUri().getScheme() else self._fs.getUri(), self._conf)
            none = self._spark_array()
            context.rename(draft, self._path(f"{self.root}/manifests/v{base + 1:010d}.json"), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _spark_array(self):
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        return self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0) if kind else None

    def _written(self, path: str) -> list[Shard]:
        files = [x for x in self._fs.listStatus(self._path(path)) if x.getPath().getName().startswith("part-")]
        return sorted((Shard(str(x.getPath().toString()), x.getLen()) for x in files), key=lambda s: s.path)

    @contextmanager
    def _writing(self) -> Iterator[str]:
        """A new folder for shards, announced for as long as its files aren't committed."""
        name = uuid.uuid4().hex
        note = self._path(f"{self.root}/intents/{name}")
        self._fs.create(note, False).close()
        yield f"{self.root}/shards/{name}"
        self._fs.delete(note, False)  # not after an error: the files are then dead, and deleted in time

    def _add(self, new: list[Shard], like: StructType) -> int:
        while True:
            version, old, schema = self.manifest()
            if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in like]:
                raise ValueError("the rows' columns differ from the store's")
            try:
                return self.commit(version, old + new, like)
            except Conflict:
                continue

    def append(self, rows: DataFrame) -> int:
        """Write rows as new shards, as they are partitioned, and commit a version that has them too."""
        with self._writing() as path:
            rows.write.option("compression", "zstd").parquet(path)
            return self._add(self._written(path), rows.schema)

    def append_apart(self, rows: DataFrame, arrivals: int) -> int:
        """Write rows once, dealt out to `arrivals` sets of shards, and commit each set as a version of its own.

        Rows aren't shuffled or sorted: each task writes a file for each set.
        """
        (number,) = fresh(rows.columns, "arrival")
        conf, name = self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(name, None)
        with self._writing() as path:
            try:
                conf.set(name, str(arrivals))
                rows.withColumn(number, F.pmod(F.monotonically_increasing_id(), F.lit(arrivals))).write.option("compression", "zstd").partitionBy(number).parquet(path)
            finally:
                conf.unset(name) if before is None else conf.set(name, before)
            there = {x.getPath().getName(): str(x.getPath().toString()) for x in self._fs.listStatus(self._path(path))}
            version = 0
            for i in range(arrivals):  # a set without rows is a version without new shards
                of = there.get(f"{number}={i}")
                version = self._add(self._written(of) if of else [], rows.schema)
            return version

    def tier(self, size: int) -> int:
        return int(math.log(max(size, SMALLEST) / SMALLEST, self.fanout) + 1e-9)

    def plan(self, shards: list[Shard]) -> list[Shard]:
        """The runs to merge next: those of the lowest tier that has `fanout` of them; none from half the target on."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target / 2:
                tiers.setdefault(self.tier(s.size), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merge until no tier has `fanout` runs; each merge is a commit of its own. The last version is returned.

        Files are packed up to the target into read partitions, each written
        as one file: rows aren't shuffled.
        """
        while True:
            version, shards, schema = self.manifest()
            todo = self.plan(shards)
            if not todo:
                return version
            total = sum(s.size for s in todo)
            files = max(1, round(total / self.target))
            conf = self.spark.conf
            names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
            before = {n: conf.get(n, None) for n in names}
            with self._writing() as path:
                try:
                    conf.set(names[0], str(max(-(-total // files), max(s.size for s in todo)) + 1))
                    conf.set(names[1], "0")
                    conf.set(names[2], "1")
                    rows = self.spark.read.schema(schema).parquet(*(s.path for s in todo))
                    rows.write.option("compression", "zstd").parquet(path)
                finally:
                    for n, v in before.items():
                        conf.unset(n) if v is None else conf.set(n, v)
                new, gone = self._written(path), {s.path for s in todo}
                if len(new) >= len(todo):
                    return version  # nothing was gained, as when every run fills a partition
                try:
                    self.commit(version, [s for s in shards if s.path not in gone] + new, schema)
                except Conflict:
                    continue

    def read(self, version: int | None = None) -> DataFrame:
        _, shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("the store is empty")
        reader = self.spark.read.schema(schema)
        return reader.parquet(*(s.path for s in shards)) if shards else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, dead: float = DEAD) -> int:
        """Delete shards that the last `keep` versions don't name, and older manifests; the number of files deleted.

        Folders that a writer announced stay, unless that was `dead` seconds
        ago. Announcements are read before manifests: a writer that is no
        longer announced then has committed, and is named.
        """
        notes = self._path(f"{self.root}/intents")
        now, open_ = time.time() * 1000, set()
        for x in self._fs.listStatus(notes) if self._fs.exists(notes) else []:
            if now - x.getModificationTime() < dead * 1000:
                open_.add(x.getPath().getName())
            else:
                self._fs.delete(x.getPath(), False)
        versions = self.versions()
        named = {self._path(s.path).toUri().getPath() for v in versions[-keep:] for s in self.manifest(v)[1]}
        n = 0
        for v in versions[:-keep]:
            n += self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        base = self._path(f"{self.root}/shards")
        for folder in self._fs.listStatus(base) if self._fs.exists(base) else []:
            if folder.getPath().getName() in open_:
                continue
            files = self._fs.listFiles(folder.getPath(), True)
            while files.hasNext():
                x = files.next().getPath()
                if x.getName().startswith("part-") and x.toUri().getPath() not in named:
                    n += self._fs.delete(x, False)
        return n


def shard(docs: DataFrame, arrivals: int = 4, target: int = TARGET, fanout: int = FANOUT, root: str | None = None) -> ShardStore:
    """A store of docs: its rows arrive in `arrivals` appends of small shards, then runs are compacted and stale files deleted.

    All columns and rows are kept as they are, whatever their names: nulls,
    empty and long texts, ties, repeated rows. An empty table makes a store
    without rows.
    """
    store = ShardStore(docs.sparkSession, root or scratch(docs.sparkSession, "shards"), target, fanout)
    store.append_apart(docs, arrivals)
    store.compact()
    store.vacuum()
    return store


ORACLE_SQL = "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents"
