"""Byte-level BPE with tiktoken, a local rank file and safe splits of long texts."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text of more characters is encoded in pieces.
PIECE = 1 << 16
# No pre-token goes on from a non-space to a space, nor from a letter to a digit or back.
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_loaded: dict[str, tiktoken.Encoding] = {}


def default_ranks() -> str:
    """The rank file that the machine's public tokenizer files offer."""
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoding(ranks: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 bytes and rank), loaded once a process."""
    if ranks not in _loaded:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        _loaded[ranks] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _loaded[ranks]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """text in pieces of about `most` characters, cut only where no pre-token crosses.

    The cut is the first safe boundary from `most` characters on: before a
    space between two non-spaces, or between a letter and a digit. Where there
    is none the rest is one piece.
    """
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc: tiktoken.Encoding, most: int = PIECE) -> list[int]:
    """Token ids of one text; special-token strings in it are ordinary text."""
    if len(text) <= most:
        return enc.encode_ordinary(text)
    return [t for part in pieces(text, most) for t in enc.encode_ordinary(part)]


def decode(tokens: list[int], enc: tiktoken.Encoding) -> bytes:
    """The raw bytes of the tokens, which need not be valid UTF-8 for a part of a text."""
    return enc.decode_bytes(tokens)


def tokenize(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, tokens, exact): the tokens of every row's whole text.

    exact says whether decoding the tokens to raw bytes gives the text back.
    A null text gives null tokens, n_bytes and exact, and 0 n_tokens; an empty
    text gives an empty list and exact. Repeated rows stay, a null doc_id is
    kept, an empty table gives an empty one, and other columns are ignored.
    """
    path = ranks or default_ranks()

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            # Short runs of rows: a list of ids takes far more memory than its text.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, sizes, same = [], [], []
                for text in part.column(1).to_pylist():
                    if text is None:
                        ids.append(None), sizes.append(None), same.append(None)
                        continue
                    body = text.encode("utf-8")
                    found = encode(text, enc)
                    ids.append(pa.array(found, pa.int32()).to_numpy(zero_copy_only=False)), sizes.append(len(body)), same.append(decode(found, enc) == body)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array([0 if x is None else len(x) for x in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "tokens", "exact"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens int, tokens array<int>, exact boolean")


def detokenize(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, raw): the raw bytes of each row of (doc_id, tokens); null tokens give null."""
    path = ranks or default_ranks()

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            body = [None if x is None else decode(x, enc) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["doc_id", "raw"])

    return tokens.select(tokens["doc_id"].cast("long").alias("doc_id"), tokens["tokens"]).mapInArrow(run, "doc_id long, raw binary")
