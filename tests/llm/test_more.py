"""Odd rows, clashing names, and plain versions of what SQL can't express."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrel.llm import bpe, chat, decontaminate, mixing, neardup, pii, quality, sharding, suffixes, toxicity
from tests.llm.test_llm import prose, table


def test_chat_takes_odd_rows(spark):
    long = prose(random.Random(3), 20_000)
    rows = [
        (1, 0, "user", "hi", "x", 1), (1, 1, None, None, "x", 2), (1, 1, None, None, "x", 2),  # null role and text, a repeated row
        (2, 0, "user", "hi", "y", 1), (2, 5, "assistant", "b", "y", 1), (2, 5, "assistant", "a", "y", 1),  # a tied turn
        (3, None, "system", "", "z", 1), (3, 0, "user", long, "z", 1),  # a null turn is the first
        (None, 0, "user", "hi", "w", 1), (4, 0, "user", "hi", "v", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, tree string, a int")
    nodes = {(r.tree, r.node): r for r in chat.prefix_tree(df).collect()}
    enc = bpe.encoding(bpe.default_ranks())
    said = lambda r, t: enc.encode_ordinary(chat.TEMPLATE.format(role=r, text=t))
    assert len(nodes) == 6
    ended = {c: r for r in nodes.values() for c in r.conv_ids}
    assert set(ended) == {1, 2, 3, 4} and ended[4].depth == 0 and ended[1].depth == 1 and ended[2].depth == 2
    assert ended[1].tokens == said("", "") and ended[3].tokens == said("user", long)
    ties = sorted((r for r in nodes.values() if r.tree == ended[2].tree and r.node not in (ended[4].node, ended[1].node)), key=lambda r: r.depth)
    assert sorted(r.tokens for r in ties) == sorted([said("assistant", "a"), said("assistant", "b")])


def test_chat_trees_of_many_branches(spark):
    """Starts are depth first in a tree that branches at every turn, and in one long conversation."""
    rng = random.Random(4)
    paths = {}
    for c in range(80):
        k = rng.randrange(1, 13)
        paths[c] = ["root", *("same" if i < k else rng.choice("pq") for i in range(1, rng.randrange(k, 14)))]
    paths[99] = ["root", *(f"t{i}" for i in range(120))]
    df = spark.createDataFrame([(c, i, "user", t) for c, p in paths.items() for i, t in enumerate(p)], "conv_id long, turn int, role string, text string")
    rows = sorted(chat.prefix_tree(df).collect(), key=lambda r: r.node)
    want = {tuple(p[: i + 1]) for p in paths.values() for i in range(len(p))}
    enc, stack, at, found = bpe.encoding(bpe.default_ranks()), [], 0, set()
    for r in rows:
        stack = [*stack[: r.depth], r]
        assert len(stack) == r.depth + 1 and r.start == at
        assert [(a["from"], a["to"]) for a in r.attend] == [(s.start, s.start + len(s.tokens)) for s in stack]
        at += len(r.tokens)
        found.add(tuple(enc.decode(s.tokens).split("\n")[1] for s in stack))
    assert found == want and len(rows) == len(want)
    assert {c: len(p) - 1 for c, p in paths.items()} == {c: r.depth for r in rows for c in r.conv_ids}


def plain_logit(model, text):
    """The highest bag's mean weight of its n-grams, one at a time."""
    words, word = [], ""
    for c in [*(text or "").lower(), "\n"]:
        if toxicity._LETTER[ord(c)]:
            word += c
        elif word:
            words.append(word)
            word = ""
    best = -np.inf
    for a in range(0, len(words), toxicity.BAG):
        total, n = 0.0, 0
        for w in words[a : a + toxicity.BAG]:
            signs = [1, *map(ord, w), 1]
            for k in toxicity.NGRAMS:
                for i in range(len(signs) - k + 1):
                    h = signs[i] * 0x9E3779B1 & 0xFFFFFFFF
                    for s in signs[i + 1 : i + k]:
                        h = (h * 0x9E3779B1 + s) & 0xFFFFFFFF
                    h = ((h ^ h >> 15) * (0x85EBCA6B + 2 * k)) & 0xFFFFFFFF
                    total, n = total + float(model.weight[h >> 32 - toxicity.BITS]), n + 1
        best = max(best, total / max(n, 1) + model.bias)
    return best


def test_toxicity_equals_a_plain_scorer(spark, monkeypatch):
    rng = random.Random(31)
    model = toxicity.Model(np.random.default_rng(2).normal(size=1 << toxicity.BITS).astype(np.float32), 0.25, 0.4)
    texts = [None, "", " .. ", "a", "Straße ΑΒΓ don't 12", prose(rng, 5), prose(rng, 16), prose(rng, 17), prose(rng, 700), "x" * 3000, "same", "same"]
    want = [plain_logit(model, t) for t in texts]
    assert model.score(texts) == pytest.approx(want, rel=1e-4)
    for size in (1 << 17, 300):  # whole, and in pieces
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert all("".join(toxicity.pieces(t)) == (t or "").lower() for t in texts)
        assert [max(model.score(toxicity.pieces(t))) for t in texts] == pytest.approx(want, rel=1e-4)
    got = {r.doc_id: (r.toxicity, r.toxic) for r in toxicity.score(table(spark, texts), model).collect()}
    for i, z in enumerate(want):
        assert got[i] == (0.0 if z == -np.inf else pytest.approx(1 / (1 + np.exp(model.cut - z)), abs=1e-5), z > model.cut)


def test_toxicity_step_is_the_softmax_gradient():
    """One minibatch moves along the numerical gradient of the averaged bags' softmax loss."""
    t = toxicity.Trainer(1)
    bucket, size, label, weight = np.array([5, 9, 9, 7, 5, 8]), np.array([3, 1, 2]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss(table, head):
        total, at = 0.0, 0
        for n, y, w in zip(size, label, weight, strict=True):
            z = table[bucket[at : at + n]].mean(0) @ head[:-1] + head[-1]
            total += w * (np.log(np.exp(z).sum()) - z[y])
            at += n
        return total

    table, head = t.table.astype(float), t.head.astype(float)
    t.seen[:] = 1e6  # so that the pace is 1e-3
    t.seen_head[:] = 1e12
    t.step(bucket, size, label, weight, 1.0)
    moved = (t.table - table) / -1e-3
    for u in (5, 7, 8, 9):
        for d in range(toxicity.DIM):
            up = table.copy()
            up[u, d] += 1e-5
            assert moved[u, d] == pytest.approx((loss(up, head) - loss(table, head)) / 1e-5, rel=0.02, abs=2e-3)
    assert np.abs(moved[[0, 1, 2]]).max() < 1e-3


def test_toxicity_of_odd_labels(spark):
    docs = table(spark, ["fine words", "bad words", "bad words", None, ""], [1, 2, 2, 3, None])
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, 1), (9, 1)], "doc_id long, toxic int")
    assert sorted((r.id, r.text, r.toxic) for r in toxicity.training_rows(docs, labels).collect()) == [(1, "fine words", 0), (2, "bad words", 1)]
    assert [r.toxic for r in toxicity.training_rows(docs, labels, 1).collect()] .count(1) <= 1
    assert toxicity.toxicity(docs, labels.limit(0)).where("toxic").count() == 0


CLASH = ("name", "many", "least", "stays", "rank", "key", "group", "q", "t", "keep", "lang_of", "source_of", "mine", "n_entities", "kind", "norm", "attempt", "id", "band", "checks", "arrival", "__n", "__q", "__lang", "__key", "a.b", "MANY")


def test_columns_may_have_any_names(spark):
    rng = random.Random(41)
    texts = [*(prose(rng, 60) for _ in range(30)), "mail me at who@where.org now " + prose(rng, 50), None, ""]
    texts += texts[:3]
    docs = table(spark, texts).drop("key", "group")
    wide = docs
    for i, c in enumerate(CLASH[:-1]):
        wide = wide.withColumn(c, F.lit(i))
    bench = spark.createDataFrame([(1, texts[5])], "item_id long, text string")
    for f in (quality.quality_filter, neardup.drop_near_duplicates, lambda d: decontaminate.drop_leaks(d, bench), lambda d: pii.pseudonymize_rows(d, "k")):
        plain, found = f(docs), f(wide)
        assert found.columns == wide.columns
        rows = sorted(found.collect(), key=str)
        assert sorted(map(str, plain.collect())) == sorted(map(str, found.select(*docs.columns).collect()))
        assert all(tuple(r)[len(docs.columns) :] == tuple(range(len(CLASH) - 1)) for r in rows)
    for f in (quality.quality_rules, neardup.near_duplicates, lambda d: pii.pseudonymize(d, "k"), mixing.bits_per_byte, bpe.tokenize, lambda d: suffixes.repeated_passages(d), lambda d: decontaminate.leaks(d, bench)):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(wide).collect()))
    assert sharding.shard(wide).read().columns == wide.columns


def test_surrogates_of_used_up_shapes_end(spark):
    """All 676 addresses x@y.com are real, and all one-digit octets of a net."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(f"{a}@{b}.com" for b in letters) for a in letters] + [" ".join(f"{i}.{j}.{k}.{m}" for k in range(1, 10) for m in range(1, 10)) for i in range(1, 10) for j in range(1, 10)]
    real = {e[:2] for t in texts for e in pii.entities(t)}
    assert len(real) == 676 + 6561
    made = {(r.kind, r.norm): r.sur for r in pii.mapping(table(spark, texts), "key").collect()}
    assert set(made) == real and len({(k, s) for (k, _), s in made.items()}) == len(real)
    assert not {(k, s) for (k, _), s in made.items()} & real


def plain_surrogates(texts, key):
    """Draws made in plain Python, all of one round before the next."""
    real = {e[:2] for t in texts if t for e in pii.entities(t)}
    tries = dict.fromkeys(real, 0)
    while True:
        drawn = {e: (e[0], pii.surrogate(*e, n, key)) for e, n in tries.items()}
        firsts = {}
        for e, s in drawn.items():
            firsts[s] = min(firsts.get(s, e[1]), e[1])
        again = [e for e, s in drawn.items() if s in real or firsts[s] != e[1]]
        if not again:
            return tries
        for e in again:
            tries[e] += 1


@pytest.mark.parametrize("joined", [False, True])
def test_surrogates_equal_a_plain_version(spark, monkeypatch, joined):
    if joined:  # exceptions that are too many to be sent to every task
        monkeypatch.setattr(pii, "EXCEPTION_BYTES", -1)
    rng = random.Random(17)
    names = ["Mrs. Anna Berg", "Mr. Berg", "Anna Berg", "John Smith", "Dr. Jean-Luc Picard", "Mr. Иван Петров", "MRS. ANNA BERG"]
    make = (lambda: f"{rng.choice('abcdefghijklmnop')}@{rng.choice('abcdefghijklmnop')}.com", lambda: f"{rng.randrange(1, 4)}.{rng.randrange(1, 4)}.1.1", lambda: rng.choice(names), lambda: f"555-{rng.randrange(100):03d}-0000", lambda: "4111 1111 1111 1111", lambda: "plain words", lambda: "token=abcd1234")
    texts = [" and ".join(rng.choice(make)() for _ in range(rng.randrange(9))) for _ in range(200)] + [None, "", "no one"]
    tries = plain_surrogates(texts, b"key")
    assert max(tries.values()) > 0
    for r in pii.pseudonymize(table(spark, texts), "key").collect():
        t = texts[r.doc_id]
        if t is None:
            assert (r.text, r.n_entities) == (None, 0)
            continue
        out, at = "", 0
        every = list(pii.entities(t))
        for kind, norm, mention, start, end in every:
            out, at = out + t[at:start] + pii.render(kind, pii.surrogate(kind, norm, tries[kind, norm], b"key"), mention), end
        assert (r.text, r.n_entities) == (out + t[at:], len(every))


def test_names_without_a_title():
    assert [e[2] for e in pii.entities("Anna Berg met John Smith, and Jean-Luc Picard saw Paul. May Day; Annabel Lee; Maria said no.")] == ["Anna Berg", "John Smith", "Jean-Luc Picard"]
    one = lambda t: pii.replace(t, b"k", lambda k, n: 0)[0]
    assert one("Mrs. Anna Berg").removeprefix("Mrs. ") == one("Anna Berg")  # one person
    assert one("Mrs. Anna Berg").split()[-1] != "Berg" and pii.surrogate("person", "female|anna berg", 0, b"k").split()[-1] == pii.surrogate("person", "male|john berg", 3, b"k").split()[-1]  # a family stays one


def test_leaks_at_the_promised_recall(spark):
    """Pairs with just as many edits as are allowed, for several shares of edits; none is capped."""
    rng = random.Random(23)
    for edits, recall in ((0.05, 0.9), (0.1, 0.95), (0.2, 0.9)):
        items = [prose(rng, 9)[:50].strip() for _ in range(12)]
        texts = []
        for t in items:
            s = list(t)
            for _ in range(int(len(t) * edits)):
                s[rng.randrange(len(s))] = rng.choice("xyz")
            texts.append(prose(rng, 6) + " " + "".join(s) + " " + prose(rng, 6))
        built = decontaminate.Items.of(list(range(12)), items, edits, recall)
        assert [int(len(t) * edits) for t in built.texts] == built.most.tolist()
        found = {(t, i) for t, i, _ in built.leaks(pa.array(texts))}
        truth = {(t, i) for t in range(12) for i in range(12) if decontaminate.nearest(built.texts[i], decontaminate.normalized(pa.array([texts[t]]))[0].tobytes().decode(), int(built.most[i])) is not None}
        assert found <= truth and {(i, i) for i in range(12)} <= truth and len(found) >= recall * len(truth)
    assert decontaminate.tables_for(0.05, 0.9) < decontaminate.tables_for(0.05, 0.99) < decontaminate.tables_for(0.1, 0.99)


def test_leaks_of_repetitive_and_short_items():
    built = decontaminate.Items.of([1, 2, 3], ["ha " * 400, "tiny", "abc"], least=4)
    assert list(built.leaks(pa.array(["ha " * 4000, "a tiny bit", "abc", "", None, "ha " * 399]))) == [(0, 1, 0), (1, 2, 0), (5, 1, 2)]  # the last text ends in a space


def test_shards_of_any_table_arrive_apart_and_are_compacted(spark, tmp_path):
    docs = table(spark, [f"text {i}" for i in range(400)])
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")  # a single file
    some = spark.read.parquet(f"{tmp_path}/one").where("doc_id % 3 > 0")  # and not all of it
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fanout=4)
    assert store.append_apart(some, 4) == 4
    sizes = [store.read(v).count() for v in (1, 2, 3, 4)]
    assert sizes[0] > 0 and sizes == sorted(set(sizes)) and sizes[-1] == some.count() and len(store.manifest()[1]) == 4
    assert store.compact() == 5 and len(store.manifest()[1]) == 1
    assert sorted(map(str, store.read().collect())) == sorted(map(str, some.collect()))
    assert sorted(map(str, sharding.shard(some, 3, root=f"file://{tmp_path}/u").read().collect())) == sorted(map(str, some.collect()))


def test_vacuum_spares_what_is_being_written(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(table(spark, ["one"]))
    rows, other = table(spark, ["two"]), sharding.ShardStore(spark, f"file://{tmp_path}/s")
    add = store._add

    def late(new, like):  # between the write and the commit another process cleans up
        assert other.vacuum() == 0
        return add(new, like)

    store._add = late
    store.append(rows)
    assert sorted(r.text for r in store.read().collect()) == ["one", "two"]
    with pytest.raises(ZeroDivisionError), store._writing() as path:
        rows.write.parquet(path)
        1 / 0  # noqa: B018
    n = len(list((tmp_path / "s/shards").rglob("part-*")))
    assert store.vacuum() == 1 and len(list((tmp_path / "s/shards").rglob("part-*"))) == n  # an older manifest alone
    assert store.vacuum(dead=0) > 0 and store.read().count() == 2


def test_tokenize_and_detokenize_equal_the_plain_encoding(spark):
    texts = [None, "", "a", "two words\n", "日本語 текст 12", prose(random.Random(3), 9000), "same", "same", "<|endoftext|>"]
    docs, enc = table(spark, texts, [0, 1, 2, 3, 4, 5, 6, 6, None]), bpe.encoding(bpe.default_ranks())
    made = bpe.tokenize(docs)
    want = sorted((i, None if t is None else tuple(enc.encode_ordinary(t)), 0 if t is None else len(enc.encode_ordinary(t)), None if t is None else len(t.encode())) for i, t in zip((0, 1, 2, 3, 4, 5, 6, 6, -1), texts, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, None if r.tokens is None else tuple(r.tokens), r.n_tokens, r.n_bytes) for r in made.collect()) == want
    assert made.where("exact").count() == 8
    raw = sorted(((-1 if r.doc_id is None else r.doc_id, None if r.raw is None else bytes(r.raw)) for r in bpe.detokenize(made).collect()), key=str)
    assert raw == sorted(((i, None if t is None else t.encode()) for i, t in zip((0, 1, 2, 3, 4, 5, 6, 6, -1), texts, strict=True)), key=str)


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """Each stage in plain Python or SQL, one after another."""
    import corpus_pipeline

    rng = random.Random(77)
    items = [prose(rng, 25) for _ in range(6)]
    texts = [prose(rng, rng.randrange(60, 140)) for _ in range(90)]
    for i in range(30):
        w = texts[i].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(("changed", "word"))
        texts.append(" ".join(w))
    for i in range(12):
        w = prose(rng, 80).split()
        texts.append(" ".join([*w[:40], items[i % 6], *w[40:]]))
    texts += [f"{prose(rng, 50)} write to {a}@{b}.com or Mrs. Anna Berg {prose(rng, 30)}" for a in "abc" for b in "xyz"]
    texts += ["#$% " * 60, "AB CD EF " * 40, "the same words again " * 50, None, "", texts[0], texts[95]]
    rows = [(i, t, rng.choice(["en", "de", None]), "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.oracle_sql()}) WHERE keep").fetchall())
    assert 100 < len(kept) < len(texts) - 4
    sets = {i: {tuple(texts[i].split()[k : k + 3]) for k in range(len(texts[i].split()) - 2)} for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in kept:
        for b in kept:
            if a < b and len(sets[a] & sets[b]) >= neardup.THRESHOLD * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [i for i in kept if find(i) == i]
    built = decontaminate.Items.of(list(range(6)), items)
    plain = lambda i: decontaminate.normalized(pa.array([texts[i]]))[0].tobytes().decode()
    kept = [i for i in kept if all(decontaminate.nearest(t, plain(i), int(m)) is None for t, m in zip(built.texts, built.most, strict=True))]
    tries = plain_surrogates([texts[i] for i in kept], corpus_pipeline.PII_KEY.encode())
    enc = bpe.encoding(bpe.default_ranks())
    want = {i: enc.encode_ordinary(pii.replace(texts[i], corpus_pipeline.PII_KEY.encode(), lambda k, n: tries[k, n])[0]) for i in kept}
    got = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and got == want and len(tries) >= 10 and len(want) < 110


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    table(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
