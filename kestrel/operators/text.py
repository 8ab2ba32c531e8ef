"""Full-text search: analyzer, query grammar, BM25 and fusion of rankings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STOP = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def analyzed(text: Column) -> Column:
    """Tokens without English stop words; no stemming."""
    return F.filter(tokens(text), lambda x: ~x.isin(*STOP))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


@dataclass(frozen=True)
class Node:
    kind: str  # term, phrase, prefix, fuzzy, and, or, not, none
    parts: tuple = ()


def parse(query: str) -> Node:
    """Terms, "phrases", t*, t~N, AND, OR, NOT and parentheses; what stands side by side is joined by OR.

    NOT excludes from what stands before it. An error of syntax is a
    ValueError; stop words and signs alone match nothing.
    """
    spaced = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+|"', query)
    if '"' in spaced:
        raise ValueError("a quotation mark isn't closed")
    at = 0

    def peek():
        return spaced[at] if at < len(spaced) else None

    def union() -> Node:
        nonlocal at
        parts, bars = [both()], []
        while peek() not in (None, ")"):
            if peek() == "OR":
                at += 1
                if peek() in (None, ")", "OR", "AND"):
                    raise ValueError("OR lacks an operand")
            if peek() == "NOT":
                at += 1
                bars.append(atom())
                continue
            parts.append(both())
        found = Node("or", tuple(parts)) if len(parts) > 1 else parts[0]
        return Node("and", (found, *(Node("not", (b,)) for b in bars))) if bars else found

    def both() -> Node:
        nonlocal at
        parts = [signed()]
        while peek() == "AND":
            at += 1
            parts.append(signed())
        return Node("and", tuple(parts)) if len(parts) > 1 else parts[0]

    def signed() -> Node:
        nonlocal at
        if peek() == "NOT":
            at += 1
            return Node("not", (atom(),))
        return atom()

    def atom() -> Node:
        nonlocal at
        x = peek()
        if x in (None, ")", "AND", "OR", "NOT"):
            raise ValueError(f"unexpected {x or 'end'}")
        at += 1
        if x == "(":
            inner = union()
            if peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return inner
        words = _words(x)
        near = re.fullmatch(r"([^\W_]+)(?:(\*)|~(\d?))", x.lower())
        if near:  # of letters and digits up to the sign; without a number two edits
            return Node("prefix", (near[1], None)) if near[2] else Node("fuzzy", (near[1], int(near[3] or 2)))
        if x.startswith('"') or len(words) > 1:
            while words and words[0] in STOP:
                words = words[1:]
            while words and words[-1] in STOP:
                words = words[:-1]
            return Node("phrase", tuple(words)) if len(words) > 1 else Node("term", tuple(words)) if words else Node("none")
        return Node("term", (words[0],)) if words and words[0] not in STOP else Node("none")

    if not spaced:
        return Node("none")
    out = union()
    if at < len(spaced):
        raise ValueError(f"unexpected {spaced[at]}")
    return out


def terms(node: Node) -> list[str]:
    """Distinct terms that add to the score, in order."""
    if node.kind == "not" or node.kind == "none":
        return []
    if node.kind == "term":
        return list(node.parts)
    if node.kind == "phrase":
        return [w for w in node.parts if w not in STOP]
    return list(dict.fromkeys(t for p in node.parts for t in terms(p)))


def _pattern(words: tuple[str, ...]) -> str:
    """A phrase among tokens joined by spaces; a stop word inside stands for any one token."""
    return " " + " ".join(r"[^ ]+" if w in STOP else w for w in words) + " "


def matches(node: Node, words: Column, joined: Column) -> Column:
    """Whether a text matches, from its tokens and those joined by spaces; NOT alone matches nothing."""
    if node.kind == "none":
        return F.lit(False)
    if node.kind == "term":
        return F.array_contains(words, node.parts[0])
    if node.kind == "phrase":
        return joined.rlike(_pattern(node.parts))
    if node.kind == "not":
        return F.lit(False)
    if node.kind == "or":
        out = F.lit(False)
        for p in node.parts:
            out = out | matches(p, words, joined)
        return out
    positive = [p for p in node.parts if p.kind != "not"]
    out = F.lit(bool(positive))
    for p in positive:
        if p.kind != "none":  # a stop word asks for nothing
            out = out & matches(p, words, joined)
    for p in node.parts:
        if p.kind == "not":
            out = out & ~matches(p.parts[0], words, joined)
    return out


def bm25(docs: DataFrame, text: str, key: str, query: str, limit: int) -> DataFrame:
    """(key, score): the `limit` best matches with a score over 0, from a scan of the texts; see inverted for a stored index."""
    if limit is None or limit < 1:
        raise ValueError("a text search needs a limit of at least 1")
    return matching(docs, text, key, query).orderBy(F.col("score").desc(), key).limit(limit)


def matching(docs: DataFrame, text: str, key: str, query: str) -> DataFrame:
    """(key, score) of all matches with a score over 0.

    Two scans and one row of statistics (texts, their lengths, each term's
    frequency), which alone is exchanged; postings aren't.
    """
    node = parse(query)
    if any(k in _kinds(node) for k in ("prefix", "fuzzy")):
        node = _expanded(node, docs, text)
    wanted = terms(node)
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, tokens(F.col(text)).alias("all")).withColumn("kept", F.filter("all", lambda x: ~x.isin(*STOP)))
    often = lambda t: F.size(F.filter("kept", lambda x: x == t))
    tf = [often(t).alias(f"tf{i}") for i, t in enumerate(wanted)]
    rows = rows.select(key, "all", "kept", F.size("kept").alias("len"), *tf)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))))
    joined = F.concat(F.lit(" "), F.array_join("all", " "), F.lit(" "))
    hits = rows.where(matches(node, F.col("kept"), joined)).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, d = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hits.select(key, score.alias("score")).where("score > 0")


def _kinds(node: Node) -> set[str]:
    return {node.kind}.union(*(_kinds(p) for p in node.parts if isinstance(p, Node)))


def _expanded(node: Node, docs: DataFrame, text: str) -> Node:
    """t* and t~N as the words of docs that they stand for."""
    if node.kind in ("prefix", "fuzzy"):
        found = [Node("term", (r.term,)) for r in expand(docs, text, *node.parts).orderBy("term").collect()]  # words of the dictionary that are alike
        return Node("or", tuple(found)) if found else Node("none")
    return Node(node.kind, tuple(_expanded(p, docs, text) for p in node.parts)) if node.kind in ("and", "or", "not") else node


def postings(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(term, key, tf, positions): the inverted index; positions count stop words."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term")).where(~F.col("term").isin(*STOP))
    return rows.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def rank_fusion(a: DataFrame, b: DataFrame, key: str, limit: int, k: int = 60) -> DataFrame:
    """(key, score) by the sum of 1 / (k + rank) over two ranked lists (key, rank)."""
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full_outer")
    part = lambda r: F.coalesce(1.0 / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    return both.select(key, (part("ra") + part("rb")).alias("score")).orderBy(F.col("score").desc(), key).limit(limit)


def weighted_fusion(a: DataFrame, b: DataFrame, key: str, limit: int, share: float = 0.5) -> DataFrame:
    """(key, score) by share * a's score + (1 - share) * b's."""
    both = a.select(key, F.col("score").alias("sa")).join(b.select(key, F.col("score").alias("sb")), key, "full_outer")
    return both.select(key, (share * F.coalesce("sa", F.lit(0.0)) + (1 - share) * F.coalesce("sb", F.lit(0.0))).alias("score")).orderBy(F.col("score").desc(), key).limit(limit)


def ranked(df: DataFrame, key: str, by: Column) -> DataFrame:
    """df with rank; for lists that a limit keeps short."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(by, key)))


def expand(docs: DataFrame, text: str, term: str, edits: int | None = None) -> DataFrame:
    """(term, n): words of docs that begin with term, or are within `edits` of it, and the texts that hold them."""
    words = docs.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(analyzed(F.col(text)))).alias("term"))
    near = F.col("term").startswith(term) if edits is None else F.levenshtein("term", F.lit(term)) <= edits
    return words.where(near).groupBy("term").agg(F.count("*").alias("n"))
