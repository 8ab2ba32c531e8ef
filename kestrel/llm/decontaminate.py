"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit distances."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.names import map_rows
from kestrel.llm.textnp import _WORD, U, mix, raw, slices

#: A leak is a passage within this share of the item's characters, in edits, of the item.
EDITS = 0.05
#: Share of leaks with as many edits as are allowed that the tables are to find; their number follows from it.
RECALL = 0.99
#: Coordinates that a table samples of its own random walk.
BITS = 6
#: Normalized items of fewer bytes are in every text and are left out.
LEAST_BYTES = 8
#: Bytes of items that are held at once; a larger benchmark takes several passes.
ITEM_BYTES = 8 << 20
#: Bytes of text that are searched at once, windows that are embedded and places of pieces that are looked at at once.
SLICE, BLOCK, HITS = 4 << 20, 4096, 1 << 18
_STEPS = 4096


@dataclass(frozen=True)
class Table:
    """A random walk of its own and the coordinates it is sampled at, as shares of its length.

    step[j % _STEPS, c] is whether the walk moves on after byte c at step j.
    """

    step: np.ndarray
    at: np.ndarray
    number: int

    @staticmethod
    def drawn(number: int, bits: int = BITS) -> Table:
        rng = np.random.default_rng([77, number])
        return Table(rng.integers(0, 2, (_STEPS, 257), dtype=np.uint8), np.sort(rng.random(bits)), number)


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts in lower case, each run of other signs than letters and digits one space, none at the ends."""
    data, offsets = raw(pc.utf8_lower(column.cast(pa.large_string())))
    word = _WORD[data]
    first = np.zeros(len(data) + 1, np.bool_)
    first[offsets] = True
    last_word = np.ones(len(data), np.bool_)
    last_word[1:] = word[:-1]
    keep = word | (last_word & ~first[:-1])  # the first sign after a word, as its space
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    out = np.where(word, data, np.uint8(32))[keep]
    return out, total[offsets]


def embed(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: np.ndarray) -> np.ndarray:
    """CGK embeddings of the windows: 3 * size symbols each, 256 where a walk has left its window or the data."""
    steps = 3 * int(size.max(initial=0))
    out = np.full((steps, len(start)), 256, np.uint16)
    at, end = start.astype(np.int64), np.minimum(start + size, len(data))
    for j in range(steps):
        inside = (at < end) & (at >= 0)
        if not inside.any():
            break
        sign = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 256).astype(np.uint16)
        out[j] = sign
        at = at + np.where(inside, step[j % _STEPS][sign], 1 - (at >= end))
    return out


def sampled(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: Table) -> np.ndarray:
    """Bucket key of each window in the table, for windows of an item's size."""
    signs = embed(data, start, size, table.step)
    h = mix(size.astype(U) * U(1000) + U(table.number + 1))
    for u in table.at:
        h = mix(h ^ (signs[np.floor(u * 3 * size).astype(np.int64), np.arange(len(start))].astype(U) + U(1)))
    return h


@lru_cache
def tables_for(edits: float, recall: float, size: int = 240, pairs: int = 48, trials: int = 48) -> int:
    """How many tables find a pair that is `edits` of its characters apart with probability `recall`.

    The share of tables in which such a pair meets is measured on drawn pairs,
    each with as many edits at random as are allowed; a pair that meets in the
    share h is missed by n tables with probability (1 - h) ** n.
    """
    if not 0 < recall < 1:
        raise ValueError("recall must be between 0 and 1")
    k = int(size * edits)
    if k == 0:
        return 1
    rng = np.random.default_rng(5)
    bodies = []
    for _ in range(pairs):
        one = rng.integers(97, 123, size).tolist()
        two = list(one)
        for _ in range(k):
            at, kind = int(rng.integers(len(two))), rng.random()
            if kind < 1 / 3:
                two[at] = 95
            elif kind < 2 / 3 and len(two) > 1:
                del two[at]
            else:
                two.insert(at, 95)
        bodies.append((one, (two + [32] * size)[:size]))
    data = np.array([c for pair in bodies for body in pair for c in body], np.uint8)
    start, sizes = np.arange(2 * pairs) * size, np.full(2 * pairs, size)
    met = np.zeros(pairs)
    for t in range(trials):
        keys = sampled(data, start, sizes, Table.drawn(1000 + t))
        met += keys[0::2] == keys[1::2]
    share = (met + 0.25) / (trials + 0.5)
    n = 1
    while np.mean((1 - share) ** n) > 1 - recall:
        n += 1
    return n


def nearest(item: str, text: str, most: int) -> int | None:
    """The least edit distance between item and a substring of text, if it is at most `most` (bit-parallel, exact)."""
    n = len(item)
    if n == 0:
        return 0
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        d = ((((x & up) + up) & full) ^ up) | x
        hp, hn = down | (full & ~(d | up)), up & d
        score += 1 if hp & top else -1 if hn & top else 0
        hp, hn = (hp << 1) & full, (hn << 1) & full  # a match may begin anywhere
        up, down = hn | (full & ~(d | hp)), hp & d
        best = min(best, score)
    return best if best <= most else None


@dataclass
class Items:
    """A benchmark ready for search: ids, normalized texts, their pieces and their keys in each table."""

    ids: list[int | None]
    texts: list[str]
    most: np.ndarray
    size: np.ndarray
    piece: np.ndarray  # first 8 bytes of each piece, sorted
    piece_end: np.ndarray  # its last 8 bytes
    piece_size: np.ndarray
    piece_item: np.ndarray
    piece_at: np.ndarray
    there: np.ndarray  # hashed bytes of pieces that occur
    open: np.ndarray  # items whose pieces are too short to look for
    tables: list[Table]
    keys: np.ndarray  # item x table

    @staticmethod
    def of(ids: list[int | None], texts: list[str | None], edits: float = EDITS, recall: float = RECALL, least: int = LEAST_BYTES) -> Items:
        data, offsets = normalized(pa.array(texts, pa.large_string()))
        rows = []
        for i in range(len(ids)):
            body = data[offsets[i] : offsets[i + 1]].tobytes().rstrip(b" ")
            if len(body) >= max(1, least):
                rows.append((ids[i], body.decode("utf-8"), body))
        most = np.array([int(len(t) * edits) for _, t, _ in rows], np.int64)
        pieces, open_ = [], []
        for i, (_, text, _) in enumerate(rows):
            # Of most + 1 pieces that edits don't share one is intact.
            n = int(most[i]) + 1
            ends = [len(text) * j // n for j in range(n + 1)]
            if min(b - a for a, b in zip(ends, ends[1:], strict=False)) < 8:
                open_.append(i)
                continue
            for a, b in zip(ends, ends[1:], strict=False):
                part = text[a:b].encode()
                pieces.append((int.from_bytes(part[:8], "little"), int.from_bytes(part[-8:], "little"), len(part), i, len(text[:a].encode())))
        pieces.sort()
        col = lambda k, t: np.array([p[k] for p in pieces], t)
        first = col(0, U)
        there = np.zeros(1 << 20, np.bool_)
        there[(first * U(0x9E3779B97F4A7C15)) >> U(44)] = True
        size = np.array([len(b) for *_, b in rows], np.int64)
        tables = [Table.drawn(i) for i in range(tables_for(edits, recall))]
        keys = np.empty((len(rows), len(tables)), U)
        if rows:
            body = np.frombuffer(b"".join(b for *_, b in rows), np.uint8)
            for t, table in enumerate(tables):
                for a in range(0, len(rows), BLOCK):
                    s = slice(a, a + BLOCK)
                    keys[s, t] = sampled(body, (np.cumsum(size) - size)[s], size[s], table)
        return Items([r[0] for r in rows], [r[1] for r in rows], most, size, first, col(1, U), col(2, np.int64), col(3, np.int64), col(4, np.int64), there, np.array(open_, np.int64), tables, keys)

    def ranges(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (item, from, to) of starts at which a window may be within reach of its item, in order, apart from one another.

        A window is within reach only if it holds one of the item's pieces, so
        that where pieces are of 8 signs at least, only starts around such
        places count, as far as the allowed edits can move them. For an item
        of shorter pieces all starts do. Places on one diagonal, as of
        repetitive texts, count once.
        """
        found = [np.zeros((0, 3), np.int64)]
        for i in self.open.tolist():
            found.append(np.stack([np.full(len(offsets) - 1, i), offsets[:-1], offsets[1:]], 1)[np.diff(offsets) > 0])
        if len(data) >= 8 and len(self.piece):
            padded = np.concatenate([data, np.zeros(8, np.uint8)])
            eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(U).ravel()
            every = np.flatnonzero(self.there[(eight * U(0x9E3779B97F4A7C15)) >> U(44)])
            low, high = np.searchsorted(self.piece, eight[every], "left"), np.searchsorted(self.piece, eight[every], "right")
            every, low, n = every[high > low], low[high > low], (high - low)[high > low]
            upto = np.cumsum(n)
            a = 0
            while a < len(every):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS, "right")))
                k = n[a:b]
                at, p = np.repeat(every[a:b], k), np.repeat(low[a:b] - np.cumsum(k) + k, k) + np.arange(k.sum())
                ends = at + self.piece_size[p] - 8
                fine = ends < len(data)
                fine[fine] = eight[ends[fine]] == self.piece_end[p[fine]]
                at, p = at[fine], p[fine]
                text = np.searchsorted(offsets, at, "right") - 1
                item = self.piece_item[p]
                begin = at - self.piece_at[p]
                one = np.stack([item, np.maximum(begin - self.most[item], offsets[text]), np.maximum(begin + self.most[item] + 1, offsets[text] + 1)], 1)
                found.append(np.unique(one, axis=0))
                a = b
        rows = np.unique(np.concatenate(found), axis=0)
        if not len(rows):
            return rows
        # Ranges of one item that meet are one; texts lie apart, as a range begins within its text.
        text = np.searchsorted(offsets, rows[:, 1], "right") - 1
        rows[:, 2] = np.minimum(rows[:, 2], offsets[text + 1])
        reach = np.maximum.accumulate(rows[:, 2] + rows[:, 0] * (len(data) + 1)) - rows[:, 0] * (len(data) + 1)
        new = np.ones(len(rows), np.bool_)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > reach[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        return np.stack([rows[first, 0], rows[first, 1], np.maximum.reduceat(rows[:, 2], first)], 1)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, start) of windows that share a bucket with their item, in order of text, item and start."""
        hits = [np.zeros((0, 2), np.int64)]
        rows = self.ranges(data, offsets)
        n = rows[:, 2] - rows[:, 1]
        upto = np.concatenate([[0], np.cumsum(n)])
        for a in range(0, int(upto[-1]), BLOCK):
            which = np.arange(a, min(a + BLOCK, int(upto[-1])))
            r = np.searchsorted(upto, which, "right") - 1
            item, begin = rows[r, 0], rows[r, 1] + which - upto[r]
            left = np.arange(len(item))
            for t, table in enumerate(self.tables):  # what has met its item needs no further table
                met = sampled(data, begin[left], self.size[item[left]], table) == self.keys[item[left], t]
                hits.append(np.stack([item[left[met]], begin[left[met]]], 1))
                left = left[~met]
                if not len(left):
                    break
        both = np.concatenate(hits)
        text = np.searchsorted(offsets, both[:, 1], "right") - 1
        order = np.lexsort((both[:, 1], both[:, 0], text))
        return text[order], both[order, 0], both[order, 1]

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, int | None, int]]:
        """(row, item_id, distance) of every leaked item of every text."""
        data, offsets = normalized(column)
        text, item, begin = self.candidates(data, offsets)
        best: dict[tuple[int, int], int] = {}
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for t, i, b in zip(text.tolist(), item.tolist(), begin.tolist(), strict=True):
            k = 4 * int(self.most[i])
            a, z = max(int(offsets[t]), b - k), min(int(offsets[t + 1]), b + int(self.size[i]) + k)
            own = spans.setdefault((t, i), [])
            if own and a <= own[-1][1]:
                own[-1][1] = max(z, own[-1][1])  # begins come in order
            else:
                own.append([a, z])
        for (t, i), own in spans.items():
            for a, z in own:
                found = nearest(self.texts[i], data[a:z].tobytes().decode("utf-8", "ignore"), int(self.most[i]))
                if found is not None:
                    best[t, i] = min(found, best.get((t, i), found))
        for (t, i), d in sorted(best.items()):
            yield t, self.ids[i], d


def item_sets(benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, most: int = ITEM_BYTES, least: int = LEAST_BYTES) -> Iterator[Items]:
    """The benchmark in sets of about `most` bytes at most, by a hash of the text: one, unless it is large."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = max(1, math.ceil(size / most))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else rows
        got = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield Items.of([r.item_id for r in got], [r.text for r in got], edits, recall, least)


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, least: int = LEAST_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): every row of docs with every item that it holds.

    distance is the least number of edits between the item and a passage of
    the text, both in lower case and with single spaces for other signs; at
    most the share `edits` of the item's characters, rounded down. A leak of
    just so many edits is found with probability `recall`, one of fewer edits
    more often, an exact one always. Null and empty texts hold nothing; very
    long texts are searched whole; repeated rows are each reported; of several
    places in a text the nearest counts; null ids are kept; items that are
    null or of under `least` bytes are left out; empty tables give an empty
    result; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    for items in item_sets(benchmark, edits, recall, least=least):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                for a, b in slices(batch.column(1), SLICE):
                    part = batch.slice(a, b - a)
                    found = list(shared.value.leaks(part.column(1)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())], ["doc_id", "item_id", "distance"])

        own = rows.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = own if out is None else out.union(own)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, least: int = LEAST_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever those are called.

    Null and empty texts hold nothing and stay; repeated rows and ties go or
    stay together; very long texts are searched whole; an empty table gives an
    empty one; an empty benchmark takes nothing away. See leaks.
    """
    place, out = docs.columns.index("text"), docs
    for items in item_sets(benchmark, edits, recall, least=least):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            for batch in batches:
                for a, b in slices(batch.column(place), SLICE):
                    part = batch.slice(a, b - a)
                    clean = np.ones(part.num_rows, np.bool_)
                    clean[[f[0] for f in shared.value.leaks(part.column(place))]] = False
                    yield part.filter(pa.array(clean))

        out = map_rows(out, run)
    return out
