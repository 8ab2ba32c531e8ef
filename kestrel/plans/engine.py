"""The request path: an index is looked up, the filter checked, the best index of its group chosen, and the search run."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.distance import distance, saturated, similarity, vector
from kestrel.functions.quantize import metric_for
from kestrel.operators import ann, text
from kestrel.operators.filters import Restriction, where
from kestrel.operators.inverted import InvertedIndex
from kestrel.plans.catalog import Index, NoGlobalIndex, NotFound, NotServing, best_index, coerce, to_json

#: States of an index while it is made, and of the service.
STATUS = ("INITIALIZING", "BOOTSTRAPPING", "SERVING")
STATES = ("INITIALIZING", "CONNECTING_TO_DB", "DISCOVERING_INDEXES", "INDEXING_EMBEDDINGS", "SERVING")
NEEDS_TEXT = ("string", "varchar", "char")
_JSON_OPS = {"==": "==", "IN": "IN", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "()==()": "==", "()IN()": "IN", "()<()": "<", "()<=()": "<=", "()>()": ">", "()>=()": ">="}


class FilteringNeeded(ValueError):
    """The filter isn't covered by the index, and filtering wasn't allowed."""


class LocalText(ValueError):
    """A text index of single partitions can't be searched as a whole."""


@dataclass
class Progress:
    """How far the scan of an index has come: covered and all ranges of the key space."""

    covered: int = 1
    whole: int = 1

    @property
    def percent(self) -> float:
        return 100.0 * self.covered / self.whole if self.whole else 100.0


@dataclass
class Service:
    """Tables, the indexes on them, and the searches that they answer.

    Results are DataFrames; `columns_of` makes one the columnar body of a
    response. Text indexes can be left out by a flag.
    """

    spark: SparkSession
    tables: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    indexes: dict[tuple[str, str], Index] = field(default_factory=dict)
    progress: dict[tuple[str, str], Progress] = field(default_factory=dict)
    stored: dict[tuple[str, str], InvertedIndex] = field(default_factory=dict)
    fulltext: bool = True
    version: int = 0
    counts: dict[str, int] = field(default_factory=dict)

    # The catalog.

    def table(self, keyspace: str, name: str, rows: DataFrame) -> None:
        self.tables[keyspace, name] = rows
        self.version += 1

    def create(self, index: Index, stored: InvertedIndex | None = None) -> bool:
        """Add an index; False if its kind is switched off. The target of a text index must be text."""
        rows = self.tables.get((index.keyspace, index.table))
        if rows is None:
            raise NotFound(f"no table {index.keyspace}.{index.table}")
        gone = [c for c in (*index.key, *index.target, *index.partition, *index.filtering) if c not in rows.columns]
        if gone:
            raise ValueError(f"no such columns: {', '.join(gone)}")
        if index.kind == "fulltext":
            if not self.fulltext:
                return False
            if any(rows.schema[c].dataType.typeName() not in NEEDS_TEXT for c in index.target):
                raise ValueError("a text index needs a text column")
        else:
            metric_for(index.metric, index.quantization)
        self.indexes[index.keyspace, index.name] = index
        self.progress.setdefault((index.keyspace, index.name), Progress())
        if stored is not None:
            self.stored[index.keyspace, index.name] = stored
        self.version += 1
        return True

    def drop(self, keyspace: str, name: str) -> None:
        if self.indexes.pop((keyspace, name), None) is None:
            raise NotFound(f"missing index: {keyspace}.{name}")
        self.progress.pop((keyspace, name), None)
        self.stored.pop((keyspace, name), None)
        self.version += 1

    def drop_table(self, keyspace: str, name: str) -> list[str]:
        """Forget a table and its indexes, whose names are returned."""
        self.tables.pop((keyspace, name), None)
        gone = sorted(i.name for i in self.indexes.values() if (i.keyspace, i.table) == (keyspace, name))
        for n in gone:
            self.drop(keyspace, n)
        return gone

    def discover(self, wanted: Sequence[Index]) -> tuple[set[str], set[str]]:
        """Make the indexes those of a catalog: (names dropped, names added). One that changed is dropped and added."""
        now, new = set(self.indexes.values()), set(wanted)
        lost, found = now - new, new - now
        for i in lost:
            self.drop(i.keyspace, i.name)
        return {i.name for i in lost}, {i.name for i in found if self.create(i)}

    def advance(self, keyspace: str, name: str, covered: int, whole: int) -> Index:
        """Note how far an index's scan has come: it serves once the whole is covered."""
        index, before = self._index(keyspace, name), self.progress[keyspace, name]
        self.progress[keyspace, name] = Progress(max(covered, before.covered if before.whole == whole else 0), whole)
        done = self.progress[keyspace, name].percent >= 100
        self.indexes[keyspace, name] = replace(index, status="SERVING" if done else "BOOTSTRAPPING")
        return self.indexes[keyspace, name]

    def _index(self, keyspace: str, name: str) -> Index:
        found = self.indexes.get((keyspace, name))
        if found is None:
            raise NotFound(f"missing index: {keyspace}.{name}")
        return found

    @property
    def state(self) -> str:
        """The service's own state, by those of its indexes."""
        if not self.tables:
            return STATES[1]
        if not self.indexes:
            return STATES[2]
        return STATES[4] if all(i.status == "SERVING" for i in self.indexes.values()) else STATES[3]

    # What there is.

    def listed(self) -> DataFrame:
        """(keyspace, index): the vector indexes and the text indexes."""
        of = lambda kind: self.spark.createDataFrame([(i.keyspace, i.name) for i in self.indexes.values() if i.kind == kind], "keyspace string, `index` string")
        return of("vector").unionByName(of("fulltext"))

    def _rows(self, index: Index) -> DataFrame:
        """The rows that an index has: with target, key and partition."""
        return self.tables[index.keyspace, index.table].dropna(subset=[*index.key, *index.target, *index.partition])

    def status(self, keyspace: str, name: str) -> DataFrame:
        """(status, count, build_progress)."""
        index = self._index(keyspace, name)
        return self._rows(index).agg(F.lit(index.status).alias("status"), F.count("*").alias("count"), F.lit(self.progress[keyspace, name].percent).alias("build_progress")).select("status", "count", "build_progress")

    def info(self, keyspace: str, name: str) -> dict[str, Any]:
        """An index's options. A single-bit index is searched by HAMMING, and shows the metric it was declared with."""
        i = self._index(keyspace, name)
        if i.kind == "fulltext":
            return {"keyspace": i.keyspace, "index": i.name, "kind": "fulltext", "options": {}}
        return {"keyspace": i.keyspace, "index": i.name, "kind": "vector", "options": {"dimensions": i.dimension, "space_type": i.metric, "quantization": i.quantization, "connectivity": i.connectivity, "expansion_add": i.expansion_add, "expansion_search": i.expansion_search}}

    def service_info(self) -> dict[str, Any]:
        return {"service": "kestrel", "engine": "spark", "version": self.spark.version, "state": self.state}

    def counters(self) -> DataFrame:
        """(name, value) of the requests so far."""
        return self.spark.createDataFrame(sorted(self.counts.items()), "name string, value long")

    def _count(self, what: str, run: Callable[[], DataFrame]) -> DataFrame:
        self.counts[f"{what}_requests"] = self.counts.get(f"{what}_requests", 0) + 1
        try:
            return run()
        except Exception:
            self.counts[f"{what}_errors"] = self.counts.get(f"{what}_errors", 0) + 1
            raise

    # Searches.

    def restrictions(self, index: Index, filters: Sequence[Mapping[str, Any]]) -> list[Restriction]:
        """A JSON filter (type, lhs, rhs) against the columns that the index knows, values as the columns' types."""
        rows = self.tables[index.keyspace, index.table]
        known = {*index.key, *index.partition, *index.filtering}
        out = []
        for f in filters:
            kind, left, right = f.get("type"), f.get("lhs"), f.get("rhs")
            if kind not in _JSON_OPS:
                raise ValueError(f"unknown restriction {kind!r}")
            op, many = _JSON_OPS[kind], kind.startswith("()")
            names = tuple(left) if many and isinstance(left, list) else (left,)
            if many != isinstance(left, list) or not all(isinstance(n, str) for n in names) or not names:
                raise ValueError("a restriction's left side is a column, or a list of columns for a tuple")
            for n in names:
                if n not in known or n not in rows.columns:
                    raise ValueError(f"{n} is neither a key, a partition nor a filtering column of {index.name}")
            cast = lambda n, v: coerce(v, _kind(rows, n))
            if many:
                values = right if op == "IN" else [right]
                if not isinstance(values, list) or any(not isinstance(v, list) or len(v) != len(names) for v in values):
                    raise ValueError("a tuple's length differs from its columns'")
                made = [tuple(cast(n, v) for n, v in zip(names, row, strict=True)) for row in values]
                out.append(Restriction(names, op, made if op == "IN" else made[0]))
            elif op == "IN":
                if not isinstance(right, list):
                    raise ValueError("IN needs a list")
                out.append(Restriction(left, op, [cast(left, v) for v in right]))
            else:
                out.append(Restriction(left, op, cast(left, right)))
        return out

    def route(self, keyspace: str, name: str, restrictions: Sequence[Restriction], allow_filtering: bool = False) -> Index:
        """The index of the group of the one that is named which answers the query best."""
        asked = self._index(keyspace, name)
        if asked.kind != "vector":
            raise NotFound(f"missing index: {keyspace}.{name}")
        group = [i for i in self.indexes.values() if i.kind == "vector"]
        try:
            return best_index(group, keyspace, asked.table, asked.target, restrictions, allow_filtering)
        except NotServing as e:
            raise NotServing(f"{keyspace}.{name}: {self.progress[keyspace, name].percent:.1f} % of it is built") from e
        except (NotFound, NoGlobalIndex):
            raise
        except ValueError as e:
            raise FilteringNeeded(str(e)) from e

    def ann(self, keyspace: str, name: str, query: Sequence[float], limit: int = 1, filters: Sequence[Mapping[str, Any]] = (), allow_filtering: bool = False, match: tuple[str, str] | None = None) -> DataFrame:
        """(key..., distance, similarity_score) of the nearest rows.

        `match` is (text index, query): only rows that it finds are looked at,
        which needs filtering to be allowed, as any filter of a global index.
        """
        return self._count("ann", lambda: self._ann(keyspace, name, query, limit, filters, allow_filtering, match))

    def _ann(self, keyspace, name, query, limit, filters, allow_filtering, match) -> DataFrame:
        asked = self._index(keyspace, name)
        if asked.kind != "vector":
            raise NotFound(f"missing index: {keyspace}.{name}")
        given = self.restrictions(asked if not filters else self._widest(asked), filters)
        index = self.route(keyspace, name, given, allow_filtering)
        if match is not None and not allow_filtering:
            raise FilteringNeeded("a text query as a filter needs filtering to be allowed")
        (target,), rows = index.target, self._rows(index)
        if index.partition:
            single = {r.columns for r in given if r.op == "==" and isinstance(r.columns, str)}
            if not set(index.partition) <= single:  # an IN or a tuple has chosen the index, and can't choose a partition
                rows = rows.limit(0)
        if match is not None:
            found = self._text(keyspace, match[0]).matches(match[1]) if (keyspace, match[0]) in self.stored else self._scanned(keyspace, match[0], match[1])
            rows = rows.join(found.select(F.col("key").alias(index.key[0])), index.key[0], "left_semi")
        metric = metric_for(index.metric, index.quantization)
        if index.dimension is not None and len(query) != index.dimension:
            raise ValueError(f"the query has {len(query)} dimensions, the index {index.dimension}")
        if index.quantization == "I8":
            near = ann.quantized(where(rows, given), target, list(index.key), query, limit, metric)
            out = near.withColumn("similarity_score", similarity(metric, F.col("distance"), len(query)))
        else:
            out = ann.search(rows, target, list(index.key), query, limit, metric, given, index.dimension)
        return out.withColumn("distance", saturated(F.col("distance"))).withColumn("similarity_score", saturated(F.col("similarity_score")))

    def _widest(self, asked: Index) -> Index:
        """An index that knows every column which any index of the group knows."""
        group = [i for i in self.indexes.values() if (i.keyspace, i.table, i.target, i.kind) == (asked.keyspace, asked.table, asked.target, asked.kind)]
        return replace(asked, partition=tuple(dict.fromkeys(c for i in group for c in i.partition)), filtering=tuple(dict.fromkeys(c for i in group for c in i.filtering)))

    def _text(self, keyspace: str, name: str) -> InvertedIndex:
        return self.stored[keyspace, name]

    def _scanned(self, keyspace: str, name: str, query: str) -> DataFrame:
        index = self._index(keyspace, name)
        return text.matching(self._rows(index), index.target[0], index.key[0], query).select(F.col(index.key[0]).alias("key"))

    def bm25(self, keyspace: str, name: str, query: str, limit: int) -> DataFrame:
        """(key..., score) of the best texts; from the stored index where there is one, else by a scan."""
        return self._count("bm25", lambda: self._bm25(keyspace, name, query, limit))

    def _bm25(self, keyspace: str, name: str, query: str, limit: int) -> DataFrame:
        index = self._index(keyspace, name)
        if index.kind != "fulltext":
            raise NotFound(f"missing index: {keyspace}.{name}")
        if index.status != "SERVING":
            raise NotServing(f"{keyspace}.{name}: {self.progress[keyspace, name].percent:.1f} % of it is built")
        if index.partition:
            raise LocalText("a text index of single partitions can't be searched as a whole")
        (target,), (key, *_) = index.target, index.key
        if (keyspace, name) in self.stored:
            return self._text(keyspace, name).search(query, limit).withColumnRenamed("key", key)
        return text.bm25(self._rows(index), target, key, query, limit)

    def rescored(self, keyspace: str, name: str, query: Sequence[float], limit: int, oversampling: float) -> DataFrame:
        """(key..., distance) of an index's nearest rows, oversampling times as many, ranked by exact distances."""
        index = self._index(keyspace, name)
        (target,), many = index.target, max(limit, round(limit * oversampling))
        near = self.ann(keyspace, name, query, many).select(*index.key)
        exact = distance(index.metric, F.col(target), vector(query))
        return self._rows(index).join(F.broadcast(near), list(index.key)).select(*index.key, exact.alias("distance")).orderBy("distance", *index.key).limit(limit)  # at most `many` keys


def _kind(rows: DataFrame, name: str) -> str:
    """A column's type as coerce names it."""
    kind = rows.schema[name].dataType
    return kind.simpleString() if kind.typeName() == "decimal" else {"int": "integer", "bigint": "long", "smallint": "short", "tinyint": "byte"}.get(kind.simpleString(), kind.typeName())


def columns_of(found: DataFrame, key: Sequence[str], *values: str) -> dict[str, Any]:
    """A result of bounded size as a response has it: {"primary_keys": {column: [...]}, value: [...]}, in its order."""
    rows = found.collect()  # as many as the search's limit
    return {"primary_keys": {c: [to_json(r[c]) for r in rows] for c in key}} | {v: [r[v] for r in rows] for v in values}


def exposition(counters: DataFrame) -> str:
    """Counters (name, value) as lines of the text format that scrapers read."""
    return "".join(f"# TYPE {r.name} counter\n{r.name} {r.value}\n" for r in counters.orderBy("name").collect())
