"""A stored inverted index: postings by term, documents added and deleted in commits, searches that read their terms alone."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from kestrel.operators.text import B, K1, STOP, Node, parse, terms, tokens
from kestrel.session import latest_json, write_json

#: Parts that terms are dealt to by hash; a search reads one for each of its terms.
PARTS = 64
#: Tokens whose postings are put together at once, and signs of text whose postings are sorted by one task.
TOKENS, SIGNS = 2_000_000, 64_000_000
#: Keys that are there more than once and go to every task, so that no other text is shuffled.
FEW = 100_000
#: A block of one term's postings; `at` says where each one's positions begin.
BLOCK = "term string, keys array<KEY>, tfs array<int>, lens array<int>, at array<int>, positions array<int>"


def _block(term: np.ndarray, words: pa.Array, keys: pa.Array, tf: np.ndarray, size: np.ndarray, positions: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Blocks of postings that stand together by term; term has a number in words for each posting."""
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    rows, begin = np.r_[first, len(term)].astype(np.int32), np.r_[0, np.cumsum(tf)].astype(np.int32)
    at = begin[:-1] - np.repeat(begin[first], np.diff(rows))
    lists = lambda values, offsets=rows: pa.ListArray.from_arrays(pa.array(offsets), values)
    columns = [words.take(pa.array(term[first])), lists(keys), *(lists(pa.array(x.astype(np.int32))) for x in (tf, size, at)), lists(pa.array(positions.astype(np.int32)), begin[rows])]
    return pa.RecordBatch.from_arrays(columns, schema.names[: len(columns)])


def _packed(block: pa.RecordBatch) -> bytes:
    """Blocks as one compressed message by columns, without `at`, which follows from tfs."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema.remove(block.schema.get_field_index("at")), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block.drop_columns(["at"]))
    return sink.getvalue().to_pybytes()


def _unpacked(schema: pa.Schema):
    """A function of batches (packed) that gives their blocks."""

    def run(batches):
        for batch in batches:
            for message in batch.column(0):
                for block in pa.ipc.open_stream(message.as_buffer()):
                    tfs = block.column("tfs")
                    rows, begin = tfs.offsets.to_numpy(), np.r_[0, np.cumsum(tfs.values.to_numpy())]
                    at = pa.array((begin[:-1] - np.repeat(begin[rows[:-1]], np.diff(rows))).astype(np.int32))
                    columns = {n: block.column(n) for n in block.schema.names} | {"at": pa.ListArray.from_arrays(tfs.offsets, at)}
                    yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema.names).cast(schema)

    return run


def _blocks(schema: pa.Schema, parts: int, salts: int, tasks: int):
    """A function of batches (key, tokens) that gives (task, packed): blocks put together from at most TOKENS tokens or one text, for the task of their part.

    A part has `salts` tasks, of which each time another one is meant. A block
    without a term, of part -1, has the texts' lengths, so that texts are read
    and cut once.
    """

    def dealt(block: pa.RecordBatch, salt: int) -> pa.RecordBatch:
        part = np.array([-1 if w is None else _part_of(w, parts) for w in block.column(0).to_pylist()], np.int32)
        block = pa.RecordBatch.from_arrays([*block.columns, pa.array(part)], schema.names).cast(schema)
        task = (part * salts + salt % salts) % tasks
        every = np.unique(task)
        messages = pa.array([_packed(block.take(pa.array(np.flatnonzero(task == t)))) for t in every], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(every.astype(np.int32)), messages], ["task", "packed"])

    def run(batches):
        salt = TaskContext.get().partitionId()
        for batch in batches:
            ends = np.r_[0, np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + TOKENS, "right")) - 1)
                keys, sizes = batch.column(0).slice(a, b - a), np.diff(ends[a : b + 1])
                every = batch.column(1).slice(a, b - a).flatten().dictionary_encode()
                a = b
                words = every.dictionary
                kept = ~pc.is_in(words, value_set=pa.array(STOP)).to_numpy(zero_copy_only=False)
                code, doc = every.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                spot = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                use = kept[code] if len(code) else np.zeros(0, bool)
                code, doc, spot = code[use], doc[use], spot[use]
                size, none = np.bincount(doc, minlength=len(sizes)), np.zeros(0, np.int32)
                salt += 1
                row = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, pa.array(none), pa.array(size.astype(np.int32)), pa.array(none), pa.array(none)))
                yield dealt(pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *row], schema.names[:-1]), salt)
                if not len(code):
                    continue
                order = np.argsort(code, kind="stable")
                code, doc, spot = code[order], doc[order], spot[order]
                first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])
                doc = doc[first]
                made = _block(code[first], words, keys.take(pa.array(doc)), np.diff(np.r_[first, len(code)]), size[doc], spot, schema)
                yield dealt(made, salt)

    return run


def _repacked(schema: pa.Schema):
    """A function of batches of postings (term, key, tf, len, positions), sorted by term, that gives blocks."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                every = batch.column(0).dictionary_encode()
                tf, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                yield _block(every.indices.to_numpy(), every.dictionary, batch.column(1), tf, size, batch.column(4).flatten().to_numpy(zero_copy_only=False), schema).cast(schema)

    return run


def _part_of(term: str, parts: int) -> int:
    """As _part has it."""
    return _signed(xxhash.xxh64_intdigest(term.encode(), 42)) % parts


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _unrepeated(docs: DataFrame, several: int) -> DataFrame:
    """docs (key, text) with one text a key, the greatest; `several` keys are there more than once, and of up to FEW the texts alone are shuffled."""
    twice = docs.groupBy("key").count().where("count > 1").select("key")
    twice = F.broadcast(twice) if several <= FEW else twice
    return docs.join(twice, "key", "left_anti").union(docs.join(twice, "key", "left_semi").groupBy("key").agg(F.max("text").alias("text")))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def words_of(node: Node) -> list[str]:
    """Every term whose postings a query needs, those it excludes too."""
    if node.kind == "none":
        return []
    if node.kind in ("term", "phrase", "prefix", "fuzzy"):
        return [w for w in node.parts if isinstance(w, str) and w not in STOP]
    return list(dict.fromkeys(t for p in node.parts for t in words_of(p)))


class InvertedIndex:
    """Postings (term, key, tf, len, positions, seq) in folders by a hash of the term, blocks of many in a row, sorted by term within a file.

    Folder -1 of a commit has the lengths of its texts, from which its
    documents are written.

    Each commit adds a folder of postings, a folder of its documents' lengths
    and one of deleted keys, and becomes visible when its manifest is renamed
    into place. A document that is added again or deleted counts from then on
    as its last commit has it. Texts that are null aren't indexed; empty ones
    count as documents.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root = spark, root.rstrip("/")
        self.parts = (self.state() or {}).get("parts", parts)

    def state(self) -> dict:
        return latest_json(self.spark, f"{self.root}/manifests") or {"version": 0, "commits": [], "kind": None, "n": 0, "tokens": 0}

    def _read(self, state: dict, kind: str, columns: str) -> DataFrame:
        schema = columns.replace("KEY", state["kind"] or "long")
        found = [self._folder(kind, c) for c in state["commits"]]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, `commit` string").option("basePath", f"{self.root}/{kind}").parquet(*found).drop("commit")

    def _folder(self, kind: str, commit: str) -> str:
        return f"{self.root}/{kind}/commit={commit}"

    def commit(self, added: DataFrame | None, text: str, key: str, deleted: DataFrame | None = None) -> int:
        """Add documents and take away those with the keys of `deleted`, at once; the new version.

        Texts are read twice, for their keys and number of signs, and for
        their words. They aren't shuffled, those apart whose key is there
        twice (the greatest stays; beyond FEW such keys all texts are). Their postings are, as packed blocks, to tasks whose number
        grows with the texts, so that each sorts what its memory holds.
        """
        state, name = self.state(), f"c{uuid.uuid4().hex}"
        seq = state["version"] + 1
        some = added if added is not None else deleted
        kind = state["kind"] or some.schema[key].dataType.simpleString()
        gone = []
        if added is not None:
            docs = added.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text"))
            every = docs.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("signs"))
            signs, several = every.agg(F.coalesce(F.sum("signs"), F.lit(0)), F.count_if(F.col("n") > 1)).head()
            if several:
                docs = _unrepeated(docs, several)
            tasks = max(1, math.ceil(signs / SIGNS), min(self.spark.sparkContext.defaultParallelism, self.parts, math.ceil(signs / (SIGNS // 8))))
            salts = math.ceil(tasks / self.parts)
            tasks = self.parts * salts if salts > 1 else tasks
            schema = _parse_datatype_string(f"{BLOCK}, part int".replace("KEY", kind))
            made = docs.select("key", tokens(F.col("text")).alias("all")).mapInArrow(_blocks(to_arrow_schema(schema), self.parts, salts, tasks), "task int, packed binary")
            made = made.repartitionById(tasks, F.col("task")).select("packed").mapInArrow(_unpacked(to_arrow_schema(schema)), schema).withColumn("seq", F.lit(seq))
            made.sortWithinPartitions("part", "term").write.option("compression", "zstd").partitionBy("part").parquet(self._folder("postings", name))
            sizes = self._read({"commits": [name], "kind": kind}, "postings", f"{BLOCK}, seq int, part int").where("part = -1")
            sizes.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("lens").alias("len"))), "seq").write.option("compression", "zstd").parquet(self._folder("documents", name))
            gone.append(added.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key")))
        else:
            self.spark.createDataFrame([], f"{BLOCK}, seq int, part int".replace("KEY", kind)).write.partitionBy("part").parquet(self._folder("postings", name))
            self.spark.createDataFrame([], f"key {kind}, len int, seq int").write.parquet(self._folder("documents", name))
        if deleted is not None:
            gone.append(deleted.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key")))
        old = self._live(state) if state["commits"] else None
        dead = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
        # Keys that hid nothing before aren't written, so that a first load has no deletions.
        dead = dead.distinct().join(old.select("key"), "key", "left_semi") if old is not None else dead.limit(0)
        dead.withColumn("seq", F.lit(seq)).write.parquet(self._folder("deleted", name))
        if added is not None and deleted is not None:  # deleted in the same commit: later than its own additions
            deleted.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("key"), F.lit(seq + 1).alias("seq")).distinct().write.mode("append").parquet(self._folder("deleted", name))
        now = state | {"version": seq, "commits": [*state["commits"], name], "kind": kind, "parts": self.parts}
        n, total = self._live(now).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).head()
        write_json(self.spark, f"{self.root}/manifests", seq, now | {"n": n, "tokens": total})
        return seq

    def add(self, docs: DataFrame, text: str, key: str) -> int:
        return self.commit(docs, text, key)

    def delete(self, keys: DataFrame, key: str) -> int:
        return self.commit(None, "", key, keys)

    def optimize(self) -> int:
        """One commit in place of all, without what is hidden; the new version. Searches of the version before still work."""
        state, name = self.state(), f"c{uuid.uuid4().hex}"
        seq = state["version"] + 1
        if len(state["commits"]) < 2:
            return state["version"]
        schema = _parse_datatype_string(BLOCK.replace("KEY", state["kind"]))
        rows = self.postings().repartition(_part(F.col("term"), self.parts)).sortWithinPartitions("term", "key").mapInArrow(_repacked(to_arrow_schema(schema)), schema)
        rows.withColumn("seq", F.lit(seq)).withColumn("part", _part(F.col("term"), self.parts)).sortWithinPartitions("part", "term").write.option("compression", "zstd").partitionBy("part").parquet(self._folder("postings", name))
        self._live(state).withColumn("seq", F.lit(seq)).write.option("compression", "zstd").parquet(self._folder("documents", name))
        self.spark.createDataFrame([], f"key {state['kind']}, seq int").write.parquet(self._folder("deleted", name))
        write_json(self.spark, f"{self.root}/manifests", seq, state | {"version": seq, "commits": [name]})
        return seq

    def _hidden(self, rows: DataFrame, state: dict) -> DataFrame:
        """rows (key, seq, ...) without those that a later commit replaced or deleted."""
        if len(state["commits"]) < 2:
            return rows
        dead = self._read(state, "deleted", "key KEY, seq int").groupBy("key").agg(F.max("seq").alias("until"))
        return rows.join(dead, "key", "left").where(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")

    def _live(self, state: dict) -> DataFrame:
        return self._hidden(self._read(state, "documents", "key KEY, len int, seq int"), state)

    def count(self) -> int:
        return self.state()["n"]

    def postings(self, words: Sequence[str] | None = None, positions: bool = True) -> DataFrame:
        """(term, key, tf, len[, positions]) of the words, or of all, in documents that are there."""
        state = self.state()
        rows = self._read(state, "postings", f"{BLOCK}, seq int, part int")
        if words is None:
            rows = rows.where("part >= 0")
        else:
            parts = sorted({_part_of(w, self.parts) for w in words}) or [-1]
            rows = rows.where(F.col("part").isin(parts) & F.col("term").isin(list(words)))
        place = lambda x, i: F.struct(x.alias("key"), F.get("tfs", i).alias("tf"), F.get("lens", i).alias("len"), *([F.slice("positions", F.get("at", i) + 1, F.get("tfs", i)).alias("positions")] if positions else []))
        return self._hidden(rows.select("term", "seq", F.inline(F.transform("keys", place))), state).select("term", "key", "tf", "len", *["positions"] * positions)

    def document_frequency(self) -> DataFrame:
        """(term, df, tf) of all terms."""
        return self.postings(positions=False).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))

    def expand(self, term: str, edits: int | None = None) -> DataFrame:
        """(term, n): terms that begin with term, or are within `edits` of it, and the documents that hold them."""
        near = F.col("term").startswith(term) if edits is None else F.levenshtein("term", F.lit(term), edits).between(0, edits)
        return self.postings(positions=False).where(near).groupBy("term").agg(F.count("*").alias("n"))

    def _rewritten(self, node: Node) -> Node:
        """t* and t~N as the terms of the index that they stand for, joined by OR."""
        if node.kind in ("prefix", "fuzzy"):
            found = [r.term for r in self.expand(*node.parts).select("term").distinct().orderBy("term").collect()]  # terms of the dictionary that are alike
            return Node("or", tuple(Node("term", (t,)) for t in found)) if found else Node("none")
        if node.kind in ("and", "or", "not"):
            return Node(node.kind, tuple(self._rewritten(p) for p in node.parts))
        return node

    def matches(self, query: str) -> DataFrame:
        """(key, score) of all documents that match, those with a score over 0."""
        node = self._rewritten(parse(query))
        wanted, words = terms(node), words_of(node)
        state = self.state()
        if not wanted or not state["commits"]:
            return self.spark.createDataFrame([], f"key {state['kind'] or 'long'}, score double")
        rows = self.postings(words, bool(_phrases(node)))
        stats = rows.where(F.col("term").isin(wanted)).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row a term of the query
        df = {r.term: r.df for r in stats}
        pick = lambda c, w: F.max(F.when(F.col("term") == w, F.col(c)))
        at = {w: i for i, w in enumerate(words)}
        spots = sorted({w for p in _phrases(node) for w in p if w not in STOP})
        docs = rows.groupBy("key").agg(F.max("len").alias("len"), *(pick("tf", w).alias(f"tf{i}") for w, i in at.items()), *(pick("positions", w).alias(f"at{at[w]}") for w in spots))
        mean, score = max(state["tokens"] / max(state["n"], 1), 1e-9), F.lit(0.0)
        for w in wanted:
            if w in df:
                tf, n = F.coalesce(F.col(f"tf{at[w]}"), F.lit(0)).cast("double"), df[w]
                idf = F.log(F.lit(1 + (state["n"] - n + 0.5) / (n + 0.5)))
                score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / mean))
        return docs.where(_holds(node, at)).select("key", score.alias("score")).where("score > 0")

    def search(self, query: str, limit: int) -> DataFrame:
        """(key, score): the `limit` best matches, ties by key."""
        if limit is None or limit < 1:
            raise ValueError("a text search needs a limit of at least 1")
        return self.matches(query).orderBy(F.col("score").desc(), "key").limit(limit)


def _phrases(node: Node) -> list[tuple[str, ...]]:
    if node.kind == "phrase":
        return [node.parts]
    return [p for x in node.parts for p in _phrases(x)] if node.kind in ("and", "or", "not") else []


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def _holds(node: Node, at: dict[str, int]) -> Column:
    """Whether a document's terms and positions match; NOT alone matches nothing."""
    if node.kind == "term":
        return F.col(f"tf{at[node.parts[0]]}").isNotNull()
    if node.kind == "phrase":
        # Positions that the phrase may begin at, word by word; stop words inside only count.
        begins = None
        for i, w in enumerate(node.parts):
            if w not in STOP:
                own = _shifted(F.coalesce(f"at{at[w]}", F.array().cast("array<int>")), i)
                begins = own if begins is None else F.array_intersect(begins, own)
        return F.size(begins) > 0
    if node.kind == "or":
        out = F.lit(False)
        for p in node.parts:
            out = out | _holds(p, at)
        return out
    if node.kind == "and":
        positive = [p for p in node.parts if p.kind != "not"]
        out = F.lit(bool(positive))
        for p in positive:
            if p.kind != "none":  # a stop word asks for nothing
                out = out & _holds(p, at)
        for p in node.parts:
            if p.kind == "not":
                out = out & ~_holds(p.parts[0], at)
        return out
    return F.lit(False)
