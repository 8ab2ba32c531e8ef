"""MinHash near duplicates: banded candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.names import fresh, own
from kestrel.llm.textnp import U, Words, mix, slices
from kestrel.session import cut, maybe_broadcast

#: Words of a shingle, and the Jaccard similarity of shingle sets from which two texts are near duplicates.
SHINGLE, THRESHOLD = 3, 0.55
#: Bands of ROWS hashes each propose candidates: a pair at THRESHOLD is met with probability 0.95.
BANDS, ROWS = 32, 4
#: Further hashes, compared BATCH at a time; a pair is dropped once P(similarity >= THRESHOLD) is below MISS.
CHECKS, BATCH, MISS = 96, 32, 0.005
_rng = np.random.default_rng(20240)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS + CHECKS, dtype=np.uint64) * U(2) + U(1)


@lru_cache
def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ...: the fewest matches m of n with P(s >= threshold | m, n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper
    tail is a binomial sum.
    """
    out = []
    for n in range(BATCH, CHECKS + 1, BATCH):
        tail = lambda m: sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))  # noqa: B023, E731
        out.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return tuple(out)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each shingle; a text of fewer words than SHINGLE has one, all its words."""
    n = np.diff(words.first)
    at = words.starts(SHINGLE)
    owner = words.text_of[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    h = np.concatenate([words.spans(at, SHINGLE), words.spans(words.first[short], n[short])])
    owner = np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    return h[order], owner[order]


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with words, their band keys (row x BANDS), their check hashes (row x CHECKS, 16 bits each))."""
    h, owner = shingles(Words(column))
    rows, first = np.unique(owner, return_index=True)
    low = np.empty((len(rows), len(_A)), U)
    if len(rows):
        for i, a in enumerate(_A):
            low[:, i] = np.minimum.reduceat(h * a, first)
    keys = np.empty((len(rows), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(rows), b + 1, U)
        for r in range(ROWS):
            key = mix(key ^ low[:, b * ROWS + r])
        keys[:, b] = key
    return rows, keys, (mix(low[:, BANDS * ROWS :]) & U(0xFFFF)).astype(np.uint16)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _signed(texts: DataFrame) -> DataFrame:
    """(key, bands, checks) of (key, text)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                rows, keys, checks = signatures(part.column(1))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                raw = [x.tobytes() for x in checks]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), bands, pa.array(raw, pa.binary())], ["key", "bands", "checks"])

    return texts.mapInArrow(run, "key binary, bands array<long>, checks binary")


def _alive(checks: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the members `at`: those not pruned against one row, and their matches."""
    got = np.zeros(len(at), np.int32)
    for step, least in enumerate(least_matches()):
        s = slice(step * BATCH, (step + 1) * BATCH)
        got = got + (checks[at, s] == row[s]).sum(1, dtype=np.int32)
        fine = got >= least
        at, got = at[fine], got[fine]
        if not len(at):
            break
    return at, got


def forest(checks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of greatest estimated similarity over the pairs that aren't pruned."""
    left = np.arange(len(checks))
    best, link = np.full(len(checks), -1, np.int32), np.full(len(checks), -1)
    now = 0
    while len(left):
        left = left[left != now]
        near, got = _alive(checks, left, checks[now])
        better = got > best[near]
        best[near[better]], link[near[better]] = got[better], now
        if not len(left):
            return
        now = int(left[np.argmax(best[left])])
        if link[now] >= 0:
            yield int(link[now]), now


def across(checks: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs of different groups that aren't pruned."""
    if (group == group[0]).all():
        return
    for i in range(1, len(checks)):
        at = np.flatnonzero(group[:i] != group[i])
        if len(at):
            for j in _alive(checks, at, checks[i])[0]:
                yield int(j), i


def _propose(members: DataFrame, grouped: bool) -> DataFrame:
    """(a, b), a < b, of members (band, key, checks[, group]): candidates of each bucket, which arrives as a run of rows."""

    def run(batches):
        held: list = []

        def pairs(rows):
            rows = sorted(rows, key=lambda r: r[1])
            checks = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), CHECKS)
            if grouped:
                names = {g: i for i, g in enumerate(dict.fromkeys(r[3] for r in rows))}
                found = across(checks, np.array([names[r[3]] for r in rows]))
            else:
                found = forest(checks)
            return [(rows[min(i, j)][1], rows[max(i, j)][1]) for i, j in found]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["a", "b"])

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    found += pairs(held)
                    held = []
                held.append(row)
            yield out(found)
        if held:
            yield out(pairs(held))

    some = members.select("band", "key", "checks", *(["group"] if grouped else []))
    return some.repartition("band").sortWithinPartitions("band", "key").mapInArrow(run, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of THRESHOLD at least."""
    need = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "need")
    those = cut(texts.join(maybe_broadcast(need), "key", "left_semi").dropDuplicates(["key"]), "texts")
    both = pairs.join(those.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(those.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")

    def sets(column):
        h, owner = shingles(Words(column))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), np.bool_)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return h[new], owner[new]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                (hx, ox), (hy, oy) = sets(part.column(2)), sets(part.column(3))
                n = part.num_rows
                code = lambda h, o: mix(h ^ mix(o.astype(U) + U(1)))
                shared = np.bincount(ox[np.isin(code(hx, ox), code(hy, oy))], minlength=n)
                union = np.bincount(ox, minlength=n) + np.bincount(oy, minlength=n) - shared
                yield part.select([0, 1]).filter(pa.array(shared >= THRESHOLD * union))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, group): connected components of edges (a, b) named by their least key, by large-star and small-star steps."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        new = cut(small, "edges")
        if new.count() == now.count() and new.join(now, ["u", "v"], "left_anti").isEmpty():
            return new.select(F.col("u").alias("key"), F.col("v").alias("group")).union(new.select(F.col("v").alias("key"), F.col("v").alias("group")).distinct())
        now = new


def groups(docs: DataFrame) -> DataFrame:
    """(key, group): the near-duplicate component of each text, by its MD5, that has a near duplicate.

    A component is connected by exactly verified pairs. The first round
    verifies each bucket's spanning forest of most similar members; the second
    one all remaining pairs of members that the first left in different
    components. So no bucket is capped, and what is skipped is connected.
    """
    texts = docs.select(text_key(docs["text"].cast("string")).alias("key"), docs["text"].cast("string").alias("text")).where("text is not null")
    signed = cut(_signed(texts).dropDuplicates(["key"]), "signatures")
    bands = signed.select("key", F.explode("bands").alias("band"))
    full = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    met = bands.join(full, "band")
    members = cut(met.join(signed.select("key", "checks"), "key"), "members")
    first = cut(_propose(members, False), "pairs")
    edges = cut(_verified(first, texts), "verified")
    so_far = components(edges)
    known = members.join(so_far, "key", "left").withColumn("group", F.coalesce("group", "key"))
    second = cut(_propose(known, True).join(first, ["a", "b"], "left_anti"), "pairs")
    if second.isEmpty():
        return so_far
    more = cut(_verified(second, texts), "verified")
    return so_far if more.isEmpty() else components(edges.union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, size, keep): each row's group, the group's rows, and whether the row stays.

    group_id is the least doc_id of the group, and of its rows that with the
    least doc_id stays (nulls last; of repeated rows and of ties one). Texts of
    any length are compared whole. A row that has no
    near or exact copy is a group of its own. Null and wordless texts aren't
    compared: each is alone and stays. An empty table gives an empty one;
    other columns are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"].cast("string")).alias("key"), _worded(docs["text"]).alias("worded"))
    found = rows.where("worded").join(cut(groups(docs), "groups"), "key", "left").select("doc_id", F.coalesce("group", "key").alias("group"), "key")
    w = Window.partitionBy("group")
    every = found.select("doc_id", F.min("doc_id").over(w).alias("group_id"), F.count("*").over(w).alias("size"), (F.row_number().over(w.orderBy(F.col("doc_id").asc_nulls_last(), "key")) == 1).alias("keep"))
    return every.union(rows.where("not worded").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long"), F.lit(True)))


def _worded(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike("[A-Za-z0-9]|[^\\x00-\\x7F]"), F.lit(False))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group and with all their columns; only rows of texts that have copies are moved.

    The row that stays is that which near_duplicates keeps. Null, empty and
    wordless texts are alone and all stay; of repeated rows and of ties in
    doc_id one stays; very long texts are compared whole; an empty table gives
    an empty one; columns may have any names.
    """
    name, many, least, stays, rank = fresh([*docs.columns, "key", "group"], "name", "many", "least", "stays", "rank")
    key = text_key(docs["text"].cast("string"))
    of = cut(groups(docs), "groups").withColumnRenamed("key", name)
    counts = docs.where(_worded(docs["text"])).groupBy(key.alias(name)).agg(F.count("*").alias(many), F.min(docs["doc_id"].cast("long")).alias(least))
    some = counts.join(of, name, "left").where(F.col("group").isNotNull() | (F.col(many) > 1)).withColumn("group", F.coalesce("group", name))
    w = Window.partitionBy("group").orderBy(F.col(least).asc_nulls_last(), name)
    told = maybe_broadcast(cut(some.select(name, many, (F.row_number().over(w) == 1).alias(stays)), "told"))
    rows = docs.withColumn(name, F.when(_worded(docs["text"]), key)).join(told, name, "left")
    alone = rows.where(F.col(stays).isNull() | (F.col(stays) & (F.col(many) == 1)))
    one = Window.partitionBy(name).orderBy(F.col("doc_id").asc_nulls_last())
    copied = rows.where(F.col(stays) & (F.col(many) > 1)).withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1)
    return alone.select(*own(docs)).union(copied.select(*own(docs)))
