"""Language-model scoring by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.textnp import U, raw, slices
from kestrel.session import cut, scratch

#: Bytes of context of each predictor, and the bits of its table's slots for a small corpus.
ORDERS, SLOTS = (2, 3, 5), 20
#: Texts fall in two folds by a hash of themselves; a text is predicted from the other fold's counts.
FOLDS = 2
#: Bytes between updates of the weights, and bytes after which they start anew.
BLOCK, SEGMENT = 64, 8192
RATE = 0.005
#: Bytes that are coded side by side.
LANES = 1 << 19
#: Slots for each one that the corpus's own contexts take, at least.
ROOM = 2
#: Slots that travel together when counts are added up, and distinct counts that a task holds.
CELL, HELD = 1 << 16, 1 << 22
_MASK = (1 << SLOTS) - 1


def _nodes() -> np.ndarray:
    """Offset of each bit of each byte: the bits before it in a half byte lie side by side."""
    out = np.empty((256, 8), np.int64)
    for c in range(256):
        for j in range(8):
            if j < 4:
                out[c, j] = (1 << j) | (c >> (8 - j))
            else:
                out[c, j] = (((c >> 4) + 1) * 0x9E3779B1 >> 8 & 0xFFF0) + ((1 << (j - 4)) | ((c >> (8 - j)) & ((1 << (j - 4)) - 1)))
    return np.ascontiguousarray(out.T)


_NODE = _nodes()
_BIT = ((np.arange(256) >> np.arange(7, -1, -1)[:, None]) & 1).astype(np.float32)
_SQUASH = (1 / (1 + np.exp(8 - (np.arange(4096) + 0.5) / 256))).astype(np.float32)


def ranges(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of the bytes of texts, of about `most`; a text is cut at a multiple of SEGMENT of its own bytes."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    begin = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    if not len(begin):
        return
    edge = np.append(begin, offsets[-1])
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + most, "right")) - 1)
        yield int(edge[at]), int(edge[to])
        at = to


def contexts(data: np.ndarray, offsets: np.ndarray, order: int, lo: int, hi: int) -> np.ndarray:
    """Hashed context of the bytes lo to hi: the `order` bytes before each in its text, or as many as there are."""
    index = np.arange(lo, hi)
    h = np.full(hi - lo, order, np.uint32)
    near = np.searchsorted(offsets, [lo, hi], "right")
    begins = offsets[max(0, near[0] - 1) : near[1]]
    for k in range(1, order + 1):
        before = data[np.maximum(index - k, 0)].astype(np.uint32)
        before += np.uint32(1)
        for d in range(k):  # bytes at distance d of a text's start have no byte k before
            first = begins + d - lo
            first = first[(first >= 0) & (first < hi - lo)]
            before[first] = 0
        h ^= before
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def size(slots: int) -> int:
    """Slots of a table whose contexts have so many bits; the second half bytes reach beyond them."""
    return (1 << slots) + CELL


def count(data: np.ndarray, offsets: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashed context and byte, how often) of texts, the distinct ones of each range, in order."""
    out = []
    for lo, hi in ranges(offsets, 1 << 22):
        pair = contexts(data, offsets, order, lo, hi).astype(U)
        pair <<= U(8)
        pair |= data[lo:hi]
        pair.sort()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        out.append((pair[first], np.diff(np.append(first, len(pair))).astype(U)))
    return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(key, sum) of the parts' keys, in order."""
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
    return key[first], np.add.reduceat(n, first) if len(key) else n


def packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Keys in order and their counts, compressed."""
    return zlib.compress(np.diff(key, prepend=U(0)).tobytes() + n.tobytes(), 1)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(body), U)
    return np.cumsum(both[: len(both) // 2], dtype=U), both[len(both) // 2 :]


def slots_of(key: np.ndarray, n: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(2 * slot + bit, how often) of counted pairs of context and byte."""
    byte = (key & U(255)).astype(np.int64)
    slot = ((key >> U(8) & U((1 << slots - 4) - 1)).astype(np.int64) << 4) + _NODE[:, byte]
    return added([((2 * slot + _BIT[:, byte].astype(np.int64)).ravel().astype(U), np.tile(n, 8))])


def fold_of(column: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) % FOLDS if t is not None else 0 for t in column.to_pylist()], np.int64)


def stretched(counts: np.ndarray) -> np.ndarray:
    """The logit of each slot's bit, in sixteenths, from its counts (slot x 2)."""
    n = counts.astype(np.float64)
    return np.round(16 * np.clip(np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)), -7.9, 7.9)).astype(np.int8)


@dataclass
class Model:
    """logit[fold, order, slot], in sixteenths, in a file of the shared folder that each worker maps."""

    path: str
    slots: int

    @cached_property
    def logit(self) -> np.ndarray:
        return np.asarray(np.memmap(self.path, np.int8, "r", shape=(FOLDS, len(ORDERS), size(self.slots))))

    def __getstate__(self) -> dict:
        return {"path": self.path, "slots": self.slots}

    def bits(self, column: pa.Array, fold: int) -> np.ndarray:
        """Bits of each text.

        Per text (and again each SEGMENT bytes) weights start equal: one set
        for each bit of a byte, chosen by which bit is coded, plus a bias. A
        block is coded with the weights as the blocks before left them; then
        they move along the coding cost's gradient. Last, the mixed logit's
        bucket is refined by how its bits turned out so far in the segment.
        """
        data, offsets = raw(column)
        total = np.zeros(len(offsets) - 1)
        for lo, hi in ranges(offsets, LANES):
            self._code(data, offsets, lo, hi, fold, total)
        return total / np.log(2)

    def _code(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, fold: int, total: np.ndarray) -> None:
        """Add the natural-log cost of the bytes lo to hi to their texts' total; each segment is a lane."""
        own = np.arange(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi, "left"))
        start, end = np.maximum(offsets[own], lo), np.minimum(offsets[own + 1], hi)
        pieces = -(-(end - start) // SEGMENT)
        owner = np.repeat(own, pieces)
        begin = np.repeat(start, pieces) + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        size = np.minimum(np.repeat(end, pieces) - begin, SEGMENT)
        order = np.argsort(-size, kind="stable")
        owner, begin, size = owner[order], begin[order] - lo, size[order]
        body = data[lo:hi]
        ctx = [(contexts(data, offsets, o, lo, hi) & np.uint32((1 << self.slots - 4) - 1)).astype(np.int64) << 4 for o in ORDERS]
        lanes = len(owner)
        w = np.full((len(ORDERS), 8, lanes), 0.45 / 16, np.float32)
        bias = np.zeros((8, lanes), np.float32)
        ones = np.tile((2 / (1 + np.exp(-np.arange(-7.5, 8)))).astype(np.float32), (lanes, 1))  # of two bits
        met = np.full((lanes, 16), 2, np.float32)
        cost = np.zeros(lanes)
        steps = np.arange(BLOCK)
        for step in range(0, int(size[0]), BLOCK):
            n = int(np.searchsorted(-size, -step, "left"))  # lanes that have bytes left
            at = begin[:n, None] + (step + steps)
            there = None
            if size[n - 1] < step + BLOCK:
                there = steps < (size[:n, None] - step)
                at = np.minimum(at, len(body) - 1)
            c = body[at]
            node, bit = np.take(_NODE, c, 1), np.take(_BIT, c, 1)  # (8, lanes, BLOCK)
            z = np.repeat(bias[:, :n, None], BLOCK, 2)
            x = []
            for i in range(len(ORDERS)):
                slot = ctx[i][at] + node
                x.append(np.take(self.logit[fold, i], slot, mode="clip").astype(np.float32))
                z += w[i, :, :n, None] * x[i]
            np.clip(z, -7.99, 7.99, out=z)
            z += np.float32(8)
            p = np.take(_SQUASH, (z * np.float32(256)).astype(np.int64), mode="clip")
            error = bit - p
            if there is not None:
                error *= there
            for i in range(len(ORDERS)):
                w[i, :, :n] += np.float32(RATE / 256) * np.einsum("jlb,jlb->jl", error, x[i])
            bias[:, :n] += np.float32(RATE) * error.sum(2)
            bucket = z.astype(np.int64)
            bucket += (np.arange(n) * 16)[:, None]
            p *= np.float32(0.75)
            p += np.take((0.25 * ones[:n] / met[:n]).ravel(), bucket, mode="clip")
            p += bit  # 1 - |bit + p - 1| is p at a one and 1 - p at a zero
            p -= np.float32(1)
            np.abs(p, out=p)
            if there is not None:
                p[:, ~there] = 1
                bucket[:, ~there] = 16 * n
            cost[:n] -= np.log(np.multiply.reduce(p, 0)).sum(1, dtype=np.float64)
            bucket *= 2
            bucket += bit.astype(np.int64)
            seen = np.bincount(bucket.ravel(), minlength=32 * n)[: 32 * n].reshape(n, 16, 2)
            met[:n] += seen.sum(2)
            ones[:n] += seen[:, :, 1]
        np.add.at(total, owner, cost)


def _counted(docs: DataFrame) -> DataFrame:
    """(tab, bucket, counts): what each task counted, by fold and order and by ranges of hashed contexts."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            fold = fold_of(batch.column(0))
            for f in range(FOLDS):
                column = batch.column(0).filter(pa.array(fold == f))
                for a, b in slices(column, 1 << 22):
                    data, offsets = raw(column.slice(a, b - a))
                    for i, order in enumerate(ORDERS):
                        now = held.setdefault(f * len(ORDERS) + i, [])
                        now += count(data, offsets, order)
                        if len(now) > 8:
                            now[:] = [added(now)]
                    if sum(len(p[0]) for now in held.values() for p in now) > HELD:
                        yield from out(held)
        yield from out(held)

    def out(held):
        for tab, now in held.items():
            if now:
                key, n = added(now)
                bounds = np.append(np.searchsorted(key, np.arange(64, dtype=U) << U(34)), len(key))
                for bucket in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[bucket], bounds[bucket + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([bucket], pa.int32()), pa.array([packed(key[a:b], n[a:b])], pa.binary())], ["tab", "bucket", "counts"])
        held.clear()

    return docs.select(docs["text"].cast("string").alias("text")).where("text is not null").mapInArrow(run, "tab int, bucket int, counts binary")


def _grouped(batches):
    """((tab, part), (key, sum)) of rows (tab, part, counts) that come sorted by the first two."""
    now, parts = None, []
    for batch in batches:
        for *at, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != now and parts:
                yield now, added(parts)
                parts = []
            now = at
            parts.append(unpacked(body))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [added(parts)]
    if parts:
        yield now, added(parts)


def _summed(counts: DataFrame) -> DataFrame:
    """(tab, lines, counts) of all tasks' counts; lines are the runs of 16 slots that they take."""

    def run(batches):
        for (tab, _), (key, n) in _grouped(batches):
            lines = sum(1 + int(np.count_nonzero(np.diff(key >> U(s)))) for s in (8, 4))
            yield pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([lines], pa.int64()), pa.array([packed(key, n)], pa.binary())], ["tab", "lines", "counts"])

    return counts.repartition("tab", "bucket").sortWithinPartitions("tab", "bucket").mapInArrow(run, "tab int, lines long, counts binary")


def _written(counts: DataFrame, model: Model) -> DataFrame:
    """(tab, cell): cells of slots whose logits were written at their place in the model's file."""
    slots, path = model.slots, model.path

    def spread(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for tab, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(tab, []).append(slots_of(*unpacked(body), slots))
                if sum(len(p[0]) for now in held.values() for p in now) > HELD:
                    yield from out(held)
        yield from out(held)

    def out(held):
        for tab, now in held.items():
            key, n = added(now)
            cell = (key // U(2 * CELL)).astype(np.int64)
            for own in np.split(np.arange(len(key)), np.flatnonzero(np.diff(cell)) + 1):
                yield pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([cell[own[0]]], pa.int32()), pa.array([packed(key[own], n[own])], pa.binary())], ["tab", "cell", "counts"])
        held.clear()

    def write(batches):
        with open(path, "r+b") as file:
            for (tab, cell), (key, n) in _grouped(batches):
                both = np.zeros(2 * CELL, U)
                both[(key % U(2 * CELL)).astype(np.int64)] = n
                file.seek(tab * size(slots) + cell * CELL)
                file.write(stretched(both.reshape(-1, 2)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([cell], pa.int32())], ["tab", "cell"])

    spreads = counts.select("tab", "counts").mapInArrow(spread, "tab int, cell int, counts binary")
    return spreads.repartition("tab", "cell").sortWithinPartitions("tab", "cell").mapInArrow(write, "tab int, cell int")


def fit(docs: DataFrame) -> Model:
    """Bit counts of all texts' contexts.

    Distinct pairs of context and byte are counted in a table, and the slots
    are ROOM times as many as the largest fold's predictor takes in it, so the
    model grows with the corpus. Neither the driver nor a task holds it.
    """
    spark = docs.sparkSession
    counts = cut(_summed(_counted(docs)), "counts")
    most = counts.groupBy("tab").agg(F.sum("lines").alias("n")).agg(F.max("n")).head()[0] or 0
    slots = max(SLOTS, 4 + (ROOM * most - 1).bit_length()) if most else SLOTS
    url = urlparse(scratch(spark, "logits"))
    if url.scheme not in ("", "file"):
        raise ValueError("op4's model is mapped from spark.checkpoint.dir, which must be a mounted folder")
    model = Model(unquote(url.path), slots)
    os.makedirs(os.path.dirname(model.path), exist_ok=True)
    with open(model.path, "wb") as file:
        file.truncate(FOLDS * len(ORDERS) * size(slots))
    _written(counts, model).agg(F.count("*")).collect()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                fold = fold_of(part.column(1))
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                bits = np.zeros(part.num_rows)
                for f in range(FOLDS):
                    at = np.flatnonzero(fold == f)
                    if len(at):
                        # A fold's texts are coded with the other folds' counts.
                        bits[at] = shared.value.bits(part.column(1).take(pa.array(at)), (f + 1) % FOLDS)
                per = np.divide(bits, size, out=np.zeros(len(bits)), where=size > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(np.round(bits, 3)), pa.array(np.round(per, 6), mask=size == 0)], ["doc_id", "n_bytes", "bits", "bits_per_byte"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, bits double, bits_per_byte double")


def bits_per_byte(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte): the length of every row's whole text as coded by the mixed predictors.

    A null or empty text has 0 bytes, 0 bits and a null rate. Equal texts
    cost the same, so repeated rows do; a null doc_id is kept; an empty table
    gives an empty one; other columns are ignored.
    """
    return score(docs, fit(docs))
