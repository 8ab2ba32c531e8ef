"""Repeated passages by a distributed merge sort of word suffixes that uses their common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.neardup import text_key
from kestrel.llm.textnp import U, Words, mix, slices
from kestrel.session import cut, maybe_broadcast

#: A passage of so many words that occurs twice is a repeat.
PASSAGE = 50
#: A suffix is sorted by its first PASSAGE words, as these runs of words.
PARTS = (17, 17, 16)
#: Words of an anchor; each passage holds PASSAGE - ANCHOR + 1 of them, and its least one names it.
ANCHOR = 26
#: Suffixes of a sorted run.
RUN = 1 << 20


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    size, now = 1, h
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    return np.minimum(now[: len(now) - (width - size)], now[width - size :]) if width > size else now


def anchored(words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, least anchor, first passage, number of passages, whether it is at two places in them) of each run of passages that share their least anchor.

    In a text that repeats itself every PASSAGE - ANCHOR + 1 words or less, a
    passage and its repeat lie in one run, which then holds the anchor twice.
    """
    width = PASSAGE - ANCHOR + 1
    n = np.diff(words.first)
    for t in np.flatnonzero(n >= PASSAGE):
        at = np.arange(words.first[t], words.first[t + 1] - ANCHOR + 1)
        every = mix(words.spans(at, ANCHOR) ^ U(0x5851F42D4C957F2D))
        low = _least(every, width)
        new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(new, len(low)))
        # The run's first place of the anchor is in its first passage, the last one in its last.
        of, last = np.lib.stride_tricks.sliding_window_view(every, width), new + size - 1
        again = new + of[new].argmin(1) != last + width - 1 - of[last][:, ::-1].argmin(1)
        yield int(t), low[new], new, size, again


def _anchors(texts: DataFrame) -> DataFrame:
    """(key, anchor, at, n, again) of (key, text)."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                found = list(anchored(Words(part.column(1))))
                if found:
                    rows = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    col = lambda k, t: pa.array(np.concatenate([f[k] for f in found]).astype(t))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate([f[1] for f in found]).view(np.int64)), col(2, np.int32), col(3, np.int32), col(4, bool)], ["key", "anchor", "at", "n", "again"])

    return texts.mapInArrow(run, "key binary, anchor long, at int, n int, again boolean")


# A run, as it is exchanged: its suffixes in order, each as the number of parts
# that it shares with the one before, the other parts, and where it occurs.


def pack(parts: np.ndarray, text: np.ndarray, at: np.ndarray, keys: list[bytes]) -> bytes:
    """Front-code sorted suffixes (row x part) that occur at word `at` of `text`, an index of keys."""
    same = np.zeros(len(parts), np.int64)
    if len(parts):
        eq = parts[1:] == parts[:-1]
        same[1:] = np.cumprod(eq, axis=1).sum(1)
    new = same < len(PARTS)
    first = np.flatnonzero(new)
    shared = same[first].astype(np.uint8)
    tails = parts[first][np.arange(len(PARTS)) >= shared[:, None]]
    count = np.diff(np.append(first, len(parts))).astype(np.uint32)
    used, index = np.unique(text, return_inverse=True)
    head = np.array([len(first), len(tails), len(parts), len(used)], np.uint32)
    return b"".join([head.tobytes(), shared.tobytes(), tails.tobytes(), count.tobytes(), index.astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), *(keys[i] for i in used)])


class Run:
    """A run's suffixes one after the other."""

    def __init__(self, blob: bytes):
        n, tails, every, texts = np.frombuffer(blob, np.uint32, 4).tolist()
        at = 16
        self.n, self.i = n, -1
        self.shared = blob[at : at + n]
        at += n
        self.tails = np.frombuffer(blob, U, tails, at).tolist()
        at += 8 * tails
        self.count = np.frombuffer(blob, np.uint32, n, at).tolist()
        at += 4 * n
        self.text = np.frombuffer(blob, np.uint32, every, at).tolist()
        at += 4 * every
        self.at = np.frombuffer(blob, np.uint32, every, at).tolist()
        at += 4 * every
        self.keys = [blob[at + 16 * j : at + 16 * j + 16] for j in range(texts)]
        self.now: list[int] = []
        self.tail = self.place = 0

    def step(self) -> int:
        """Go on to the next suffix; the number of parts shared with the one before, or -1 at the end."""
        if self.i >= 0:
            self.place += self.count[self.i]
        self.i += 1
        if self.i >= self.n:
            return -1
        same = self.shared[self.i]
        more = len(PARTS) - same
        self.now = self.now[:same] + self.tails[self.tail : self.tail + more]
        self.tail += more
        return same

    def occurs(self) -> list[tuple[bytes, int]]:
        a, b = self.place, self.place + self.count[self.i]
        return [(self.keys[t], p) for t, p in zip(self.text[a:b], self.at[a:b], strict=True)]


def merged(runs: list[Run]) -> Iterator[tuple[bool, Run]]:
    """(equal to the one before, run whose suffix it is) in order, by a loser tree that keeps common prefixes.

    Each loser knows how many parts it shares with the suffix that beat it,
    each newcomer how many it shares with its forerunner, the last output.
    The one that shares more is the less; only at a draw are parts compared,
    and those after the shared ones alone.
    """
    size = 1
    while size < len(runs):
        size *= 2
    depth = len(PARTS)
    runs = runs + [None] * (size - len(runs))
    shared = [r.step() if r is not None else -1 for r in runs]

    def beats(a: int, b: int) -> bool:
        """Whether a's suffix comes before b's; the loser's shared is brought up to date."""
        x, y = shared[a], shared[b]
        if x < 0 or y < 0:
            return y < 0
        if x != y:
            return x > y
        p, q = runs[a].now, runs[b].now
        while x < depth and p[x] == q[x]:
            x += 1
        if x == depth or p[x] < q[x]:
            shared[b] = x
            return True
        shared[a] = x
        return False

    tree = [0] * size
    level = list(range(size))
    at = size // 2
    while len(level) > 1:
        new = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if not beats(a, b):
                a, b = b, a
            new.append(a)
            tree[at + i // 2] = b
        level, at = new, at // 2
    now = level[0]
    while shared[now] >= 0:
        run = runs[now]
        yield shared[now] == depth, run
        shared[now] = run.step()
        node = (now + size) // 2
        while node:
            if not beats(now, tree[node]):
                now, tree[node] = tree[node], now
            node //= 2


def _sorted_runs(texts: DataFrame, parts: int) -> DataFrame:
    """(part, run) of (key, text, live): the suffixes of the live passages, sorted, front-coded and cut by range."""

    def run(batches):
        sums, text, at, keys = [], [], [], []
        held = 0

        def out():
            nonlocal held
            s, t, p = np.concatenate(sums), np.concatenate(text), np.concatenate(at)
            order = np.lexsort((p, t, s[:, 2], s[:, 1], s[:, 0]))
            s, t, p = s[order], t[order], p[order]
            bound = np.searchsorted(s[:, 0], np.array([(i << 64) // parts for i in range(1, parts)], U))
            for i, (a, b) in enumerate(zip([0, *bound], [*bound, len(s)], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(s[a:b], t[a:b], p[a:b], keys)], pa.binary())], ["part", "run"])
            sums.clear(), text.clear(), at.clear(), keys.clear()
            held = 0

        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                words, live = Words(part.column(1)), part.column(2).to_pylist()
                for i, (key, spans) in enumerate(zip(part.column(0).to_pylist(), live, strict=True)):
                    start = np.concatenate([np.arange(x["at"], x["at"] + x["n"]) for x in spans])
                    begin, here = words.first[i] + start, []
                    for n in PARTS:
                        here.append(words.spans(begin, n))
                        begin = begin + n
                    sums.append(np.stack(here, 1)), text.append(np.full(len(start), len(keys))), at.append(start), keys.append(key)
                    held += len(start)
                if held >= RUN:
                    yield from out()
        if held:
            yield from out()

    return texts.mapInArrow(run, "part int, run binary")


def _repeats(runs: DataFrame, parts: int) -> DataFrame:
    """(key, at): starts of passages that occur twice, each as twice the word's index, plus 1 if the passage occurs earlier."""

    def merge(blobs):
        out: dict[bytes, list[int]] = {}

        def take(group):
            if sum(r[1] for r in group) > 1:
                every = [o for r in group for o in r[0]]
                first = min(every)
                for o in every:
                    out.setdefault(o[0], []).append(2 * o[1] + (o != first))

        group: list = []
        for equal, r in merged([Run(b) for b in blobs]):
            if not equal:
                if group and (len(group) > 1 or group[0][1] > 1):
                    take([(x() if callable(x) else x, n) for x, n in group])
                group = []
            group.append((r.occurs(), r.count[r.i]) if equal or r.count[r.i] > 1 else (_later(r, r.place), 1))
        if group and (len(group) > 1 or group[0][1] > 1):
            take([(x() if callable(x) else x, n) for x, n in group])
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.list_(pa.int32()))], ["key", "at"])

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and blobs:
                    yield merge(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield merge(blobs)

    return runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "key binary, at array<int>")


def _later(run: Run, place: int):
    """The only occurrence of a suffix, made when it turns out to be needed."""
    return lambda: [(run.keys[run.text[place]], run.at[place])]


def _union(starts: np.ndarray) -> list[dict[str, int]]:
    """Spans of words that the passages at sorted starts cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + PASSAGE) + 1
    first, last = starts[np.concatenate([[0], gap])], starts[np.concatenate([gap - 1, [len(starts) - 1]])]
    return [{"from": int(a), "to": int(b) + PASSAGE} for a, b in zip(first, last, strict=True)]


def _spans(found: DataFrame) -> DataFrame:
    """(key, spans, later) of (key, list of lists)."""

    def run(batches):
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            spans, later = [], []
            for lists in batch.column(1).to_pylist():
                code = np.unique(np.concatenate([np.array(x, np.int64) for x in lists]))
                spans.append(_union(np.unique(code >> 1))), later.append(_union(code[(code & 1) == 1] >> 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(later, kind)], ["key", "spans", "later"])

    return found.groupBy("key").agg(F.collect_list("at").alias("at")).mapInArrow(run, "key binary, spans array<struct<from:int,to:int>>, later array<struct<from:int,to:int>>")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, later): each row with a passage of PASSAGE words that also occurs elsewhere, in it or another row.

    spans are the words [from, to) that such passages cover; words are those
    of textnp, and letter case and other signs don't count. later are the
    spans to drop so that of each passage one occurrence stays: those that
    aren't the first, by the text's MD5 and place, and of equal texts the row
    with the least doc_id (nulls last). Null, empty and shorter texts have no
    passages; an empty table gives no rows; other columns are ignored.

    Passages occur twice only where their least anchors do, in two runs or at
    two places of one run, so only such passages are sorted.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    copies = maybe_broadcast(cut(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1"), "copies"))
    # Of equal texts that have other ids one row is sorted.
    texts = rows.join(copies, "key", "left").where("copies is null or doc_id <=> first_id").select("key", "text")
    anchors = cut(_anchors(texts), "anchors")
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("k"), F.max("again").alias("again")).where("k > 1 or again").select("anchor")
    live = cut(anchors.join(twice, "anchor").groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("live")).select("key", "live"), "live")
    runs = _sorted_runs(texts.join(live, "key"), parts)
    found = cut(_spans(_repeats(runs, parts)), "spans")
    kind = "array<struct<from:int,to:int>>"
    words = F.size(F.expr(r"regexp_extract_all(text, '[A-Za-z0-9\\x{80}-\\x{10FFFF}]+', 0)"))
    whole = F.array(F.struct(F.lit(0).alias("from"), words.alias("to"))).cast(kind)
    same = rows.join(copies, "key").where(words >= PASSAGE)
    first = F.row_number().over(_by_key()) == 1
    same = same.withColumn("one", first).join(found.select("key", F.col("later").alias("own")), "key", "left").select("doc_id", whole.alias("spans"), F.when(~F.col("one"), whole).otherwise(F.coalesce("own", F.array().cast(kind))).alias("later"))
    other = rows.select("doc_id", "key").join(copies, "key", "left_anti").join(found, "key").select("doc_id", "spans", "later")
    return other.union(same)


def _by_key():
    from pyspark.sql.window import Window

    return Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last())
