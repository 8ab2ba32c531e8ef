"""Bulk writes and deletes of a table's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import latest_json, scratch, write_json


class Table:
    """Rows in a folder of versions; a write or delete makes a new one, named by a rename that replaces nothing.

    An upload adds files. It replaces rows of equal keys only if asked to, as
    that rewrites the table.
    """

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)

    def _state(self) -> dict:
        return latest_json(self.spark, f"{self.root}/manifests") or {"version": 0, "files": []}

    def _commit(self, state: dict, files: list[str]) -> int:
        write_json(self.spark, f"{self.root}/manifests", state["version"] + 1, {"version": state["version"] + 1, "files": files})
        return state["version"] + 1

    def read(self) -> DataFrame:
        files = self._state()["files"]
        if not files:
            raise ValueError("the table has no rows yet")
        return self.spark.read.schema(self.spark.read.parquet(files[-1]).schema).parquet(*files)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.root}/{scratch(self.spark, 'rows').rsplit('/', 1)[-1]}"
        rows.write.option("compression", "zstd").parquet(path)
        return path

    def upload(self, rows: DataFrame, replace: bool = False) -> int:
        """Add rows that have a key; with `replace` they take the place of rows with theirs."""
        state, rows = self._state(), rows.dropna(subset=self.key)
        if replace and state["files"]:
            kept = self.read().join(rows.select(*self.key).distinct(), self.key, "left_anti")
            return self._commit(state, [self._write(kept.unionByName(rows))])
        return self._commit(state, [*state["files"], self._write(rows)])

    def delete(self, keys: DataFrame) -> int:
        """Take away the rows of these keys."""
        state = self._state()
        if not state["files"]:
            return state["version"]
        return self._commit(state, [self._write(self.read().join(keys.select(*self.key).distinct(), self.key, "left_anti"))])


def columnar(found: DataFrame, key: Sequence[str], *values: str) -> DataFrame:
    """One row of lists, a column each, in the order of a result whose `rank` is given."""
    rows = F.array_sort(F.collect_list(F.struct("rank", *key, *values)))  # as many as the search's limit
    return found.agg(rows.alias("rows")).select(*(F.col("rows")[c].alias(c) for c in (*key, *values)))
