"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut

#: Character n-grams of a word between boundary marks.
NGRAMS = (3, 4, 5)
BITS, DIM = 18, 8
#: Words of a bag: a text's score is that of its most toxic bag, so length doesn't dilute it.
BAG = 16
#: The model is fitted on at most so many labelled texts of each class.
SAMPLE = 4000
#: Signs of text that are held as n-grams at once, signs of a piece of a long text, bags of a minibatch, and parts of the sample's table.
CHUNK, PIECE, BATCH, PARTS = 1 << 19, 1 << 17, 2048, 4
_B = np.uint32(0x9E3779B1)


def _letters() -> np.ndarray:
    table = np.ones(0x110000, np.bool_)
    table[:0xC0] = False
    table[[*range(48, 58), *range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA]] = True
    table[0x2000:0x2070] = table[0x3000:0x3040] = table[0xFF00:0xFF10] = False
    return table


_LETTER = _letters()


def features(texts: list[str | None], bag: int = BAG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bag) of every character n-gram of every word, and the text of each bag.

    Bags are runs of `bag` words of one text; a text without words has none.
    """
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _LETTER[points]
    sign = np.where(word, points, np.uint32(1))
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = np.flatnonzero(first)  # the first letter of each word
    ends = np.cumsum([len(t) + 1 for t in low]) + 1
    text_of = np.searchsorted(ends, at, "right")
    counts = np.bincount(text_of, minlength=len(low))
    starts = np.cumsum(counts) - counts
    bags = -(-counts // bag)
    base = np.cumsum(bags) - bags
    bag_of_word = base[text_of] + (np.arange(len(at)) - starts[text_of]) // bag
    word_of = np.cumsum(first) - 1
    breaks = np.zeros(len(points) + 1, np.int32)
    np.cumsum(~word, out=breaks[1:])
    h, buckets, owners = sign * _B, [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for n in range(2, max(NGRAMS) + 1):
        if len(sign) < n:
            break
        h = h[: len(sign) - n + 1] * _B + sign[n - 1 :]
        if n in NGRAMS:
            fine = np.flatnonzero(breaks[n - 1 : len(sign)] == breaks[1 : len(sign) - n + 2])  # no break inside
            x = h[fine]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            buckets.append(x >> np.uint32(32 - BITS))
            owners.append(bag_of_word[word_of[fine + 1]])
    return np.concatenate(buckets), np.concatenate(owners), np.repeat(np.arange(len(low)), bags)


@dataclass
class Model:
    """Each bucket's part of the logit, its bias, and the logit from which a text is toxic."""

    weight: np.ndarray
    bias: float
    cut: float

    def bags(self, bucket: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        """Logit of each bag: the softmax of an averaged bag needs only each bucket's product with the classes."""
        total = np.bincount(bag, self.weight[bucket], n)
        return total / np.maximum(np.bincount(bag, minlength=n), 1) + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Logit of each text, that of its highest bag; -inf for a text without words."""
        bucket, bag, owner = features(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, self.bags(bucket, bag, len(owner)))
        return out


def pieces(text: str | None) -> list[str]:
    """The text in lower case, cut so that each piece has about PIECE signs and all but the last a whole number of bags."""
    low = (text or "").lower()
    if len(low) <= PIECE:
        return [low]
    word = np.concatenate([_LETTER[np.frombuffer(low[a : a + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)] for a in range(0, len(low), PIECE)])
    word[1:] &= ~word[:-1]
    begins = np.flatnonzero(word)[::BAG]  # of bags
    at = np.searchsorted(begins, np.arange(PIECE, len(low), PIECE))
    edges = [0, *np.unique(begins[at[at < len(begins)]]).tolist(), len(low)]
    return [low[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def chunks(rows: Iterable[tuple[str | None, int]]) -> Iterator[tuple[list[str], np.ndarray, list[int]]]:
    """(pieces, the text that each is of, labels) of whole texts, of about CHUNK signs together."""
    parts, owner, label, size = [], [], [], 0
    for text, y in rows:
        own = pieces(text)
        parts += own
        owner += [len(label)] * len(own)
        label.append(y)
        size += sum(map(len, own))
        if size > CHUNK:
            yield parts, np.array(owner), label
            parts, owner, label, size = [], [], [], 0
    if label:
        yield parts, np.array(owner), label


class Trainer:
    """Embeddings of the n-grams (table) and the classes' weights (head, its last row their bias), moved together by Adagrad, an n-gram's numbers at one pace.

    With two classes a bag's error is one number e, and -e for the other class.
    So a minibatch's gradient of the table is its sum of e / size by n-gram,
    times the difference of the classes' weights; that of the weights is the
    same sum over the table. Both are those of the averaged bag's softmax.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.table = rng.normal(0, 0.01, (1 << BITS, DIM)).astype(np.float32)
        self.head = rng.normal(0, 0.5, (DIM + 1, 2)).astype(np.float32)
        self.met = np.zeros(1 << BITS, np.bool_)  # what training never met says nothing
        self.fresh()

    def fresh(self) -> None:
        self.seen, self.seen_head = np.full(len(self.table), 1e-3, np.float32), np.full(self.head.shape, 1e-3, np.float32)

    def model(self) -> Model:
        turn = self.head[:, 1] - self.head[:, 0]
        return Model(np.where(self.met, self.table @ turn[:-1], 0).astype(np.float32), float(turn[-1]), 0.0)

    def step(self, bucket: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One minibatch: the bags' n-grams side by side, how many each has, its class and weight."""
        turn = self.head[:, 1] - self.head[:, 0]
        z = np.add.reduceat((self.table @ turn[:-1])[bucket], np.cumsum(size) - size) / size + turn[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        g = np.bincount(bucket, np.repeat(e / size, size), 1 << BITS).astype(np.float32)
        back = np.append(g @ self.table, e.sum()).astype(np.float32)
        both = np.stack([-back, back], 1)
        self.seen += g * g * np.mean(turn[:-1] ** 2)
        self.table -= (np.float32(rate) * g / np.sqrt(self.seen))[:, None] * turn[:-1]
        self.seen_head += both * both
        self.head -= rate * 0.2 * both / np.sqrt(self.seen_head)

    def epoch(self, rows: Iterable[tuple[str | None, int]], share: np.ndarray, best: bool, rate: float = 0.3) -> None:
        """Every bag of every text once; with `best`, of a toxic text only its highest bags as the model stands."""
        for parts, owner, label in chunks(rows):
            bucket, bag, part = features(parts)
            n = np.bincount(bag, minlength=len(part))
            y, text = np.array(label)[owner[part]], owner[part]
            use = n > 0
            if best:
                z = self.model().bags(bucket, bag, len(part))
                top = np.full(len(label), -np.inf)
                np.maximum.at(top, text, z)
                use &= (y == 0) | (z >= np.minimum(top[text], 0.0)) & (z >= top[text] - 3)
            else:
                self.met[bucket] = True
            order = np.argsort(bag, kind="stable")
            bucket, edge = bucket[order], np.concatenate([[0], np.cumsum(n)])
            todo = self.rng.permutation(np.flatnonzero(use))
            for own in np.array_split(todo, max(1, -(-len(todo) // BATCH))):
                if len(own):
                    size = edge[own + 1] - edge[own]
                    at = np.repeat(edge[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    self.step(bucket[at], size, y[own], 0.5 / np.maximum(share[y[own]], 1e-9), rate)


def highest(model: Model, rows: Iterable[tuple[str | None, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(logit, class) of each text."""
    top, classes = [np.zeros(0)], [np.zeros(0, np.int64)]
    for parts, owner, label in chunks(rows):
        z = np.full(len(label), -np.inf)
        np.maximum.at(z, owner, model.score(parts))
        top.append(z)
        classes.append(np.array(label))
    return np.concatenate(top), np.concatenate(classes)


def train_on(rows: Callable[[], Iterable[tuple[str | None, int]]], seed: int = 7) -> Model:
    """Fit on what rows() gives, which is read once an epoch and never held whole.

    First every bag has its text's label; then a toxic text counts by its
    highest bags alone, and a clean one by all. The cut lies between the
    training texts' classes. Without both classes nothing is toxic.
    """
    trainer, bags = Trainer(seed), np.zeros(2)
    for text, y in rows():
        bags[y] += 1 + len(text or "") // 100
    if not bags.all():
        return Model(np.zeros(1 << BITS, np.float32), -20.0, 0.0)
    share = bags / bags.sum()
    for step in range(3):
        trainer.fresh()
        for _ in range(4 if step == 0 else 3):
            trainer.epoch(rows(), share, step > 0)
    model = trainer.model()
    top, y = highest(model, rows())
    clean, bad = np.sort(top[y == 0]), np.sort(top[y == 1])
    steps = np.unique(top[np.isfinite(top)])
    if not len(steps):
        return Model(np.zeros(1 << BITS, np.float32), -20.0, 0.0)
    wrong = len(clean) - np.searchsorted(clean, steps, "left") + np.searchsorted(bad, steps, "left")
    best = np.flatnonzero(wrong == wrong.min())
    mid = best[len(best) // 2]
    model.cut = float((steps[mid] + steps[max(0, mid - 1)]) / 2)
    return model


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """train_on texts that are in memory."""
    return train_on(lambda: zip(texts, map(int, toxic), strict=True), seed)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(id, text, toxic): at most `most` labelled texts of each class, chosen and ordered by a hash of doc_id.

    Labels without a doc_id or class, and texts that are null, are left out;
    of several labels of one doc_id the highest counts, of several texts the
    least.
    """
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    first = lambda y: one.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(most)  # noqa: E731  (each task hands on its `most` first)
    # at most 2 * most rows: small whatever the table's size
    some = F.broadcast(first(0).union(first(1)))
    every = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return every.join(some, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled texts, which stays in a table; the driver holds a part of it at a time."""
    rows = training_rows(docs, labels, most).withColumn("turn", F.xxhash64("id"))
    made = cut(rows.repartition(PARTS, "turn").sortWithinPartitions("turn", "id"), "labelled").select("text", "toxic")
    return train_on(lambda: ((r.text, r.toxic) for r in made.toLocalIterator()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity, toxic): each row's probability and class, from all bags of its whole text.

    A null, empty or wordless text has toxicity 0 and isn't toxic. A text of
    any length is read whole, piece by piece; one at the cut isn't toxic.
    Repeated rows score alike, a null doc_id is kept, an empty table gives an
    empty one, and other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            at = 0
            for parts, owner, texts in chunks((t, 0) for t in batch.column(1).to_pylist()):
                z = np.full(len(texts), -np.inf)
                for a in range(0, len(parts), 64):
                    np.maximum.at(z, owner[a : a + 64], model.score(parts[a : a + 64]) - model.cut)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                p[np.isneginf(z)] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(np.round(p, 6)), pa.array(z > 0)], ["doc_id", "toxicity", "toxic"])
                at += len(texts)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, toxicity double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Fit on labels, then score every row of docs; see fit and score."""
    return score(docs, fit(docs, labels, most))
