"""Session factory and the shared working folder."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "kestrel", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset (a local session) a temporary folder is made, named in
    the session and removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="kestrel-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, or in that of the work at hand."""
    return f"{_folder.get() or f'{shared_dir(spark)}/kestrel'}/{name}-{uuid.uuid4().hex}"


@contextmanager
def work(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end; what is returned from there must be written elsewhere before."""
    path = scratch(spark, "work")
    token = _folder.set(path)
    try:
        yield
    finally:
        _folder.reset(token)
        drop_path(spark, path)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table written in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _fs(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def there(spark: SparkSession, path: str) -> bool:
    made, fs = _fs(spark, path)
    return fs.exists(made)


def write_json(spark: SparkSession, folder: str, version: int, body: dict) -> None:
    """Commit body as a version: written beside and renamed into place; FileExistsError if another one was first."""
    _, fs = _fs(spark, folder)
    draft, target = (_fs(spark, f"{folder}/{name}")[0] for name in (f".{uuid.uuid4().hex}.tmp", f"{version:010d}.json"))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise FileExistsError(f"version {version} of {folder}") from e
        raise


def latest_json(spark: SparkSession, folder: str) -> dict | None:
    """The last version that was committed; None if there is none."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path):
        return None
    names = sorted(n for n in (x.getPath().getName() for x in fs.listStatus(path)) if n.endswith(".json") and not n.startswith("."))
    if not names:
        return None
    stream = fs.open(_fs(spark, f"{folder}/{names[-1]}")[0])
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def table_bytes(df: DataFrame) -> int:
    """Size of a written table, as its files say."""
    spark = df.sparkSession
    total = 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def maybe_broadcast(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """The broadcast hint for a written table of at most `limit` bytes; beyond it the planner joins by shuffle."""
    return F.broadcast(df) if table_bytes(df) <= limit else df
