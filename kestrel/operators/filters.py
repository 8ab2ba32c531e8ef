"""Restrictions, alone and on tuples, and their conjunction as a column.

A comparison with a null or NaN holds nowhere, and neither does one on a
boolean or binary column, even for equality.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("==", "IN", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Restriction:
    """column op value; for a tuple columns and values are tuples, and for IN value is a list."""

    columns: str | tuple[str, ...]
    op: str
    value: Any

    @property
    def names(self) -> tuple[str, ...]:
        return (self.columns,) if isinstance(self.columns, str) else tuple(self.columns)


def _never(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("boolean", "binary")


def _one(df: DataFrame, name: str, op: str, value: Any) -> Column:
    c = df[name]
    if _never(df, name):
        return F.lit(False)
    v = F.lit(value)
    if df.schema[name].dataType.typeName() == "timestamp":
        c = F.date_trunc("MILLISECOND", c)
    made = {"==": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
    return made & ~F.isnan(c) if df.schema[name].dataType.typeName() in ("float", "double") else made


def _tuple(df: DataFrame, names: Sequence[str], op: str, values: Sequence[Any]) -> Column:
    """Lexicographic: the first pair that differs decides."""
    head = _one(df, names[0], op if len(names) == 1 else op[0], values[0])
    if len(names) == 1:
        return head
    return head | (_one(df, names[0], "==", values[0]) & _tuple(df, names[1:], op, values[1:]))


def condition(df: DataFrame, r: Restriction) -> Column:
    if r.op not in OPS:
        raise ValueError(f"unknown operator {r.op}")
    if any(n not in df.columns for n in r.names):
        raise ValueError(f"no such column: {r.names}")
    if isinstance(r.columns, str):
        if r.op != "IN":
            return _one(df, r.columns, r.op, _checked(r.value))
        if _never(df, r.columns) or not r.value:
            return F.lit(False)
        kind = df.schema[r.columns].dataType.typeName()
        c = F.date_trunc("MILLISECOND", df[r.columns]) if kind == "timestamp" else df[r.columns]
        made = c.isin([_checked(v) for v in r.value])
        return made & ~F.isnan(c) if kind in ("float", "double") else made
    rows = r.value if r.op == "IN" else [r.value]
    if any(len(v) != len(r.names) for v in rows):
        raise ValueError("a tuple's length differs from its columns'")
    every = lambda v: _all([_one(df, n, "==", _checked(x)) for n, x in zip(r.names, v, strict=True)])
    if r.op == "==":
        return every(r.value)
    if r.op == "IN":
        out = F.lit(False)
        for v in rows:
            out = out | every(v)
        return out
    return _tuple(df, r.names, r.op, [_checked(v) for v in r.value])


def _checked(value: Any) -> Any:
    if value is None or isinstance(value, list | dict):
        raise ValueError("a restriction's value must be a scalar")
    return value


def _all(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def where(df: DataFrame, restrictions: Sequence[Restriction]) -> DataFrame:
    """The rows that fulfil every restriction."""
    return df.where(_all([condition(df, r) for r in restrictions])) if restrictions else df
