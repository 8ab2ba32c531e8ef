"""Keyed surrogates for personal data: type, gender, script and format stay, distinct entities stay distinct."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.names import fresh, map_rows, own
from kestrel.session import cut, table_bytes

#: Bytes of exceptions that go to every executor; more of them are joined to the texts that need them.
EXCEPTION_BYTES = 8 << 20
#: Draws in the shape of the entity; each further one is a sign longer, so that a shape that is used up can't keep a text waiting.
SHAPED = 8

_MALE, _FEMALE = r"Mr|Mister|Sir|Herr|Señor|Sr|Don|Monsieur|Господин", r"Mrs|Ms|Miss|Madam|Frau|Señora|Señorita|Sra|Doña|Madame|Mme|Mlle|Госпожа"
_TITLE = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?P<male>{_MALE})|(?P<female>{_FEMALE})|Dr|Prof)\b")
_PERSON = rf"(?P<title>(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE}|Dr|Prof)\.? +)(?P<person>\p{{Lu}}[\p{{L}}\p{{M}}’'-]+(?: \p{{Lu}}[\p{{L}}\p{{M}}’'-]+){{0,2}})"
_OTHERS = (
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<label>(?:password|passwd|secret|token|api_key)\s?[=:]\s?)(?P<secret>[A-Za-z0-9_\-]{8,})"
    r"|(?<=\")(?P<hex>[0-9a-f]{32,64})(?=\")"
    r"|(?<![A-Za-z0-9])(?P<key>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w-])(?P<card>\d{4}([ -]?)\d{4}\g<-1>\d{4}\g<-1>\d{4})(?![\w-])"
    r"|(?<![\w])(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])"
).replace(r"([ -]?)\d{4}\g<-1>\d{4}\g<-1>", r"(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)")
_KINDS = ("email", "secret", "hex", "key", "ip", "iban", "ssn", "card", "phone", "person")
_TRIGGER = regex.compile(r"[0-9@]|(?:password|passwd|secret|token|api_key)\s?[=:]")
_TITLES = (*_MALE.split("|"), *_FEMALE.split("|"), "Dr", "Prof")

_GIVEN = {
    ("latin", "male"): "James Peter Lukas Martin Paul Henri Diego Carlos Anton Felix Oliver Hugo Marco Simon Victor Adrian".split(),
    ("latin", "female"): "Mary Anna Laura Clara Julia Marie Elena Sofia Greta Alice Emma Nora Paula Irene Lucia Helena".split(),
    ("latin", "any"): "Robin Alex Kim Sascha Andrea Noa Charlie Dominique Camille Ariel Jules Sam".split(),
    ("cyrillic", "male"): "Иван Пётр Сергей Алексей Николай Михаил Дмитрий Андрей".split(),
    ("cyrillic", "female"): "Анна Мария Елена Ольга Ирина Наталья Вера Татьяна".split(),
    ("cyrillic", "any"): "Саша Женя Валя Шура".split(),
    ("greek", "male"): "Γιώργος Νίκος Πέτρος Κώστας".split(),
    ("greek", "female"): "Μαρία Ελένη Άννα Σοφία".split(),
    ("greek", "any"): "Άρης Χρύσα".split(),
}
#: Given names that tell a person where a capitalized word follows, besides those above.
_MORE = {
    "male": "John Michael David Robert William Richard Joseph Charles Christopher Daniel Matthew Anthony Andrew Joshua Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Nicholas Jonathan Hans Jürgen Klaus Wolfgang Stefan Andreas Thomas Markus Jean Pierre Jacques François Luc Antoine Juan José Luis Javier Miguel Ángel Fernando Jorge Владимир Александр".split(),
    "female": "Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sabine Petra Ursula Monika Katrin Heike Isabelle Nathalie Sylvie Céline Carmen Ana Lucía Isabel Pilar Rosa Татьяна Светлана Екатерина".split(),
}
_GENDER = {n.casefold(): g for (_, g), names in _GIVEN.items() for n in names if g != "any"} | {n.casefold(): g for g, names in _MORE.items() for n in names}
_NAMES = sorted({n for (_, g), names in _GIVEN.items() if g != "any" for n in names} | {n for names in _MORE.values() for n in names})
_NAMED = rf"(?<![\p{{L}}\p{{N}}’'-])(?P<named>(?:{'|'.join(_NAMES)})(?:-\p{{Lu}}\p{{L}}+)?(?: \p{{Lu}}[\p{{L}}\p{{M}}’'-]+){{1,2}})"
_ENTITY, _ENTITY_NAMED = (regex.compile(x) for x in (f"{_OTHERS}|{_PERSON}", f"{_OTHERS}|{_PERSON}|{_NAMED}"))
_NAME = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_NAMES)})(?:-\p{{Lu}}\p{{L}}+)? \p{{Lu}}")
_PARTS = {
    "latin": ("bar ben cor dal der fal gar hal kel lan mar mor nor pel ran ros sal tal ver win".split(), "berg dale field ford man ley ner sen son ton wick worth".split()),
    "cyrillic": ("бар вер гор дал зор кор лан мар нор пет рад сол тар".split(), "ев ин ов ский енко".split()),
    "greek": ("βαρ γερ δαλ καρ λαν μαρ νικ παπ ραλ σαλ".split(), "άκης ίδης όπουλος έας".split()),
}


def kinds_of(m: regex.Match) -> tuple[str, str]:
    """Kind and group of a match."""
    if m.lastgroup == "named":
        return "person", "named"
    kind = m.lastgroup if m.lastgroup in _KINDS else next(k for k in _KINDS if m.group(k) is not None)
    return kind, kind


def script(text: str) -> str:
    c = next((x for x in text if x.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def gender(title: str, name: str) -> str:
    m = _TITLE.search(title)
    if m and m["male"]:
        return "male"
    if m and m["female"]:
        return "female"
    return _GENDER.get(name.split()[0].casefold(), "any")


def normal(kind: str, text: str, title: str = "") -> str:
    """What makes two mentions one entity: digits of a number, a name without case, an address in lower case."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "email":
        return text.casefold()
    if kind == "person":
        return f"{gender(title, text)}|{' '.join(text.casefold().split())}"
    return text


def entities(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, normal form, mention, start, end) of each entity in a whole text, from left to right."""
    named = any(t in text for t in _NAMES) and _NAME.search(text) is not None
    if not named and not _TRIGGER.search(text) and not any(t in text for t in _TITLES):
        return
    for m in (_ENTITY_NAMED if named else _ENTITY).finditer(text):
        kind, group = kinds_of(m)
        found = m.group(group)
        yield kind, normal(kind, found, m.group("title") or "" if kind == "person" else ""), found, m.start(group), m.end(group)


class _Draw:
    """A stream of keyed pseudo-random numbers."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.of, self.n, self.pool = key, "\x1f".join(map(str, of)).encode(), 0, 0
        self.left = 1

    def __call__(self, below: int) -> int:
        if self.left < below << 32:
            self.pool = int.from_bytes(hmac.new(self.key, self.of + self.n.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.left, self.n = 1 << 256, self.n + 1
        self.pool, out = divmod(self.pool, below)
        self.left //= below
        return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shaped(text: str, draw: _Draw, hexed: bool = False) -> str:
    low = "abcdef" if hexed else _LOWER
    return "".join(str(draw(10)) if c.isdigit() else _UPPER[draw(26)] if c in _UPPER else low[draw(len(low))] if c in _LOWER else c for c in text)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The normal form of the replacement: same kind, gender, script and shape, drawn from the key, the entity and the attempt.

    From attempt SHAPED on the shape grows, a sign with each attempt.
    """
    draw, more = _Draw(key, kind, norm, attempt), max(0, attempt - SHAPED + 1)
    if kind == "email":
        name, _, host = norm.rpartition("@")
        labels = host.split(".")
        return f"{_shaped(name + 'a' * more, draw)}@{'.'.join([*(_shaped(x, draw) for x in labels[:-1]), labels[-1]])}"
    if kind == "ip":
        if more > 4:  # IPv4 is used up as far as draws can tell
            return "fd" + ":".join(f"{draw(1 << 16):04x}" for _ in range(8))[2:]
        ranges = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        pick = lambda x: (lambda r: r[0] + draw(r[1] - r[0] + 1))((1, 255) if more else ranges[len(x)])
        return ".".join(str(pick(x)) for x in norm.split("."))
    if kind == "card":
        body = norm[0] + "".join(str(draw(10)) for _ in range(len(norm) - 2 + more))
        if _luhn(norm):
            return body + str(draw(10))
        return body + str((10 - _luhn(body + "0")) % 10)
    if kind == "phone":
        lead = max(0, len(norm) - 10)  # the country stays
        return norm[:lead] + "".join(str(2 + draw(8)) if i in (0, 3) else str(draw(10)) for i in range(len(norm) - lead + more))
    if kind == "ssn":
        return "".join(str(draw(10)) for _ in range(len(norm) + more))
    if kind == "iban":
        return norm[:2] + _shaped(norm[2:] + "0" * more, draw)
    if kind == "key":
        pool = _UPPER + "0123456789"
        return norm[:4] + "".join(pool[draw(36)] for _ in range(len(norm) - 4 + more))
    if kind == "person":
        sex, _, name = norm.partition("|")
        words, kind_of = name.split(" "), script(name)
        first, last = _PARTS[kind_of]
        pool = _GIVEN[kind_of, sex]
        # A full name changes by its given names, which are joined when drawn again, so that a family stays one.
        made = ["-".join(pool[draw(len(pool))] for _ in range(1 + attempt)).casefold() for _ in words[:-1]]
        family = _Draw(key, "family", words[-1], 0 if made else attempt)
        made.append("".join(first[family(len(first))] for _ in range(3 + (0 if made else attempt))) + last[family(len(last))])
        return f"{sex}|{' '.join(made)}"
    if kind == "hex" or (kind == "secret" and all(c in "0123456789abcdef" for c in norm)):
        return _shaped(norm + "0" * more, draw, hexed=True)
    return _shaped(norm + "0" * more, draw)


def render(kind: str, norm: str, mention: str) -> str:
    """A surrogate's normal form in the format of the mention that it replaces: separators, case."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(norm)
        return "".join([*(next(signs, c) if c.isalnum() else c for c in mention), *signs])
    if kind == "person":
        name = norm.partition("|")[2]
        return name.upper() if mention.isupper() and len(mention) > 1 else regex.sub(r"(?<![\p{L}’'])\p{L}", lambda m: m[0].upper(), name)
    if kind == "email" and mention.isupper():
        return norm.upper()
    return norm


def replace(text: str, key: bytes, attempt: Callable[[str, str], int]) -> tuple[str, int]:
    """text with every entity replaced, and their number."""
    out, at, n = [], 0, 0
    for kind, norm, mention, start, end in entities(text):
        out += [text[at:start], render(kind, surrogate(kind, norm, attempt(kind, norm), key), mention)]
        at, n = end, n + 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


def _found(docs: DataFrame, keyed: bool) -> DataFrame:
    """(kind, norm) of all mentions, with the text's hash if keyed."""

    def run(batches):
        for batch in batches:
            kinds, norms, keys = [], [], []
            ids = batch.column(1).to_pylist() if keyed else None
            for i, text in enumerate(batch.column(0).to_pylist()):
                for kind, norm in {(e[0], e[1]) for e in entities(text)}:
                    kinds.append(kind), norms.append(norm)
                    if ids:
                        keys.append(ids[i])
            columns = [pa.array(kinds, pa.string()), pa.array(norms, pa.string())] + ([pa.array(keys, pa.string())] if keyed else [])
            yield pa.RecordBatch.from_arrays(columns, ["kind", "norm", "id"][: len(columns)])

    text = docs["text"].cast("string")
    some = docs.where(text.isNotNull()).select(text.alias("text"), *([F.md5(text.cast("binary")).alias("id")] if keyed else []))
    return some.mapInArrow(run, "kind string, norm string" + ", id string" * keyed)


def mapping(docs: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt, sur): the surrogate of every entity of docs, as a written table.

    Where two entities drew one surrogate, all but the first in order draw
    again, and so does an entity whose surrogate is itself an entity of docs;
    this goes on until surrogates are distinct and strange to docs. From the
    draw SHAPED on each has more values than the last, so it ends.
    """
    secret = key.encode()

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, norm: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, n, a, secret) for k, n, a in zip(kind, norm, attempt, strict=True)], dtype=object)

    known = cut(_found(docs, False).distinct(), "entities")
    now = cut(known.select("kind", "norm", F.lit(0).alias("attempt")).withColumn("sur", drawn("kind", "norm", "attempt")), "surrogates")
    while True:
        shared = now.groupBy("kind", "sur").agg(F.min("norm").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "sur", "first")
        again = now.join(shared, ["kind", "sur"]).where("norm != first").select("kind", "norm")
        real = now.join(known.select("kind", F.col("norm").alias("sur")), ["kind", "sur"], "left_semi").select("kind", "norm")
        clash = cut(again.union(real).distinct().withColumn("again", F.lit(1)), "clashes")
        if clash.isEmpty():
            return now
        moved = now.join(clash, ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"), "sur", "again")
        now = cut(moved.withColumn("sur", F.when(F.col("again").isNull(), F.col("sur")).otherwise(drawn("kind", "norm", "attempt"))).drop("again"), "surrogates")


def _replaced(docs: DataFrame, key: str, n: str) -> DataFrame:
    """docs with text replaced and n, the number of mentions."""
    later = mapping(docs, key).where("attempt > 0").select("kind", "norm", "attempt")
    later = cut(later, "exceptions")
    secret, inner = key.encode(), docs.withColumn("text", F.col("text").cast("string"))
    mine, name = fresh([*docs.columns, n, "kind", "norm", "attempt"], "mine", "name")
    small = table_bytes(later) <= EXCEPTION_BYTES
    shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.norm): r.attempt for r in later.collect()} if small else {})
    if not small:
        exceptions = _found(docs, True).join(later, ["kind", "norm"]).groupBy(F.col("id").alias(name)).agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias(mine))
        inner = inner.withColumn(name, F.md5(F.col("text").cast("binary"))).join(exceptions, name, "left").select(*own(docs), F.col(mine))
    place = docs.columns.index("text")

    def run(batches):
        table = shared.value
        for batch in batches:
            told = batch.column(len(batch.columns) - 1).to_pylist() if not small else None
            texts, counts = [], []
            for i, text in enumerate(batch.column(place).to_pylist()):
                if text is None:
                    texts.append(None), counts.append(0)
                    continue
                here = table if small else {(x["kind"], x["norm"]): x["attempt"] for x in told[i] or ()}
                new, k = replace(text, secret, lambda kind, norm, t=here: t.get((kind, norm), 0))
                texts.append(new), counts.append(k)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*map(str, range(len(columns) + 1))])

    return map_rows(inner, run, **{n: "int"}).drop(*([] if small else [mine]))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, text): every row's text with surrogates for its entities.

    One entity has one surrogate in all texts, in the format of each mention.
    Null texts stay null with 0 entities; empty and clean texts stay as they
    are; very long texts are read whole; repeated rows get equal texts, and of
    entities that tie for a surrogate the first in order keeps it; a null
    doc_id is kept; an empty table gives an empty one; other columns are
    ignored.
    """
    d = _replaced(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), key, "n_entities")
    return d.select("doc_id", "n_entities", "text")


def pseudonymize_rows(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_chars (if there) the new length; other columns stay, whatever their names.

    Nulls, empty and very long texts, ties, repeated rows and empty tables are
    treated as in pseudonymize.
    """
    d = _replaced(docs, key, fresh(docs.columns, "n_entities")[0])
    if "n_chars" in d.columns:
        d = d.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return d.select(*own(docs))
