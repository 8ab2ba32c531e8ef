"""Index definitions, their choice for a query, and JSON values of filters."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from kestrel.functions.distance import kind_of
from kestrel.functions.quantize import name_of
from kestrel.operators.filters import Restriction


class NotFound(KeyError):
    """No index has these columns."""


class NotServing(RuntimeError):
    """The index isn't ready."""


class NoGlobalIndex(ValueError):
    """Only local indexes exist, and the query names no partition of one."""


@dataclass(frozen=True)
class Index:
    keyspace: str
    name: str
    table: str
    key: tuple[str, ...]
    target: tuple[str, ...]
    partition: tuple[str, ...] = ()
    filtering: tuple[str, ...] = ()
    kind: str = "vector"
    dimension: int | None = None
    metric: str = "COSINE"
    quantization: str = "F32"
    connectivity: int = 16
    expansion_add: int = 128
    expansion_search: int = 64
    version: str = field(default_factory=lambda: str(uuid.uuid1()))
    status: str = "SERVING"

    @property
    def age(self) -> int:
        return uuid.UUID(self.version).time


def parse_target(text: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """(target, partition, filtering) of {"tc": ..., "pk": [...], "fc": [...]} or a bare column."""
    if not text.lstrip().startswith("{"):
        return (text.strip().strip('"'),), (), ()
    body = json.loads(text)
    many = lambda x: (x,) if isinstance(x, str) else tuple(x or ())
    if "tc" in body:
        return many(body["tc"]), many(body.get("pk")), many(body.get("fc"))
    return many(body.get("ck"))[:1], many(body.get("pk")), many(body.get("ck"))[1:]


def kind_of_class(name: str | None) -> str | None:
    """vector or fulltext by class name, vector without one; None for others."""
    return {None: "vector", "": "vector", "vector_index": "vector", "fulltext_index": "fulltext"}.get(name)


def parse_dimension(column_type: str) -> int | None:
    m = re.fullmatch(r"\s*vector<\s*float\s*,\s*(\d+)\s*>\s*", column_type)
    return int(m[1]) if m and int(m[1]) > 0 else None


def dimension_of(column_type: str | None, options: dict[str, str]) -> int | None:
    """The dimension by the column's type, or by the option `dimensions` where the type tells none, as of binary cells."""
    found = parse_dimension(column_type or "")
    if found is None and str(options.get("dimensions", "")).isdigit():
        found = int(options["dimensions"]) or None
    return found


def parse_options(options: dict[str, str]) -> dict[str, Any]:
    """Options with defaults for what is absent or malformed."""

    def number(name: str, default: int) -> int:
        try:
            return int(options[name])
        except (KeyError, ValueError):
            return default

    return {
        "metric": kind_of(options.get("similarity_function")), "quantization": name_of(options.get("quantization")), "connectivity": number("maximum_node_connections", 16),
        "expansion_add": number("construction_beam_width", 128), "expansion_search": number("search_beam_width", 64),
    }


def changes(now: Iterable[Index], wanted: Iterable[Index]) -> tuple[set[Index], set[Index]]:
    """(to delete, to add)."""
    a, b = set(now), set(wanted)
    return a - b, b - a


def _columns(restrictions: Sequence[Restriction]) -> tuple[set[str], set[str]]:
    """Columns under equality (or IN), and under ranges."""
    equal = {n for r in restrictions if r.op in ("==", "IN") for n in r.names}
    return equal, {n for r in restrictions if r.op not in ("==", "IN") for n in r.names}


def uncovered(index: Index, restrictions: Sequence[Restriction]) -> int | None:
    """How many restricted columns the index doesn't consume; None if it can't answer."""
    equal, ranged = _columns(restrictions)
    if any(c not in {*index.key, *index.partition, *index.filtering} for c in equal | ranged):
        return None
    if not index.partition:
        return len(equal) + len(ranged)
    return len(equal) - len(index.partition) + len(ranged) if set(index.partition) <= equal else None


def best_index(indexes: Iterable[Index], keyspace: str, table: str, target: Sequence[str], restrictions: Sequence[Restriction], allow_filtering: bool = False) -> Index:
    """The serving index that leaves fewest columns uncovered, the newest of equals.

    NotServing where none of the group serves, whether or not it would fit;
    NoGlobalIndex where some serve and none fits. Uncovered columns need
    allow_filtering.
    """
    group = [i for i in indexes if (i.keyspace, i.table, i.target) == (keyspace, table, tuple(target))]
    if not group:
        raise NotFound(f"no index on {keyspace}.{table}({', '.join(target)})")
    ready = [i for i in group if i.status == "SERVING"]
    if not ready:
        raise NotServing("the index isn't serving yet")
    fit = [(n, i) for i in ready if (n := uncovered(i, restrictions)) is not None]
    if not fit:
        raise NoGlobalIndex("only local indexes: an equality on each partition column is needed")
    n, found = min(fit, key=lambda x: (x[0], -x[1].age))
    if n and not allow_filtering:
        raise ValueError("the filter isn't covered by the index: allow filtering to run it")
    return found


_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def coerce(value: Any, kind: str) -> Any:
    """A JSON value as a literal of a Spark type's name, or ValueError."""
    wrong = ValueError(f"{value!r} isn't a {kind}")
    if value is None or isinstance(value, list | dict):
        raise wrong
    if kind in _BITS:
        if isinstance(value, bool) or not isinstance(value, int) or not -(1 << _BITS[kind] - 1) <= value < 1 << _BITS[kind] - 1:
            raise wrong
        return value
    if kind in ("float", "double"):
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or (kind == "float" and abs(value) > 3.4028234663852886e38):
            raise wrong
        return float(value)
    if kind == "boolean":
        if not isinstance(value, bool):
            raise wrong
        return value
    if kind in ("string", "ascii"):
        if not isinstance(value, str) or (kind == "ascii" and not value.isascii()):
            raise wrong
        return value
    if kind in ("uuid", "timeuuid"):
        try:
            found = uuid.UUID(value) if isinstance(value, str) else None
        except ValueError:
            found = None
        if found is None or (kind == "timeuuid" and found.version != 1):
            raise wrong
        return str(found)
    if kind.startswith("decimal"):
        if isinstance(value, bool):
            raise wrong
        try:
            found = Decimal(str(value))
        except ArithmeticError as e:
            raise wrong from e
        if not found.is_finite() or len(found.as_tuple().digits) > 38:
            raise wrong
        return found
    if not isinstance(value, str):
        raise wrong
    try:
        if kind == "date":
            return date.fromisoformat(value)
        if kind == "timestamp":
            return datetime.fromisoformat(value)
        if kind == "time":
            h, m, s = value.removeprefix("T").split(":")
            if not (0 <= int(h) < 24 and 0 <= int(m) < 60 and 0 <= Decimal(s) < 60):
                raise wrong
            return (int(h) * 3600 + int(m) * 60) * 10**9 + int(Decimal(s) * 10**9)
        if kind == "binary" and value.startswith("0x"):
            return bytes.fromhex(value[2:])
    except (ValueError, ArithmeticError) as e:
        raise wrong from e
    raise wrong


def to_json(value: Any, kind: str | None = None) -> Any:
    """A key's value as JSON has it; a time of day is told from a number by its kind alone."""
    if kind == "time" and isinstance(value, int):
        seconds, nanos = divmod(value, 10**9)
        text = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
        return f"{text}.{nanos:09d}".rstrip("0") if nanos else text
    if isinstance(value, bool | int | str) or value is None:
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a finite number")
        return value
    if isinstance(value, bytes | bytearray):
        return "0x" + bytes(value).hex()
    if isinstance(value, datetime):
        return value.isoformat(timespec="milliseconds")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    raise ValueError(f"no JSON for {type(value).__name__}")
