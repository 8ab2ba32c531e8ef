"""Names for inner columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be new, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """All columns of df, also those with dots in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], **more: str) -> DataFrame:
    """df.mapInArrow with all columns of df and then `more`, name to type; batches have columns in that order, under any names.

    Spark's own takes no names with dots.
    """
    width = len(df.columns)
    plain = df.toDF(*(f"c{i}" for i in range(width)))
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])
    for i, kind in enumerate(more.values()):
        schema = schema.add(f"c{width + i}", DataType.fromDDL(kind))

    def named(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, schema.names)

    return plain.mapInArrow(named, schema).toDF(*df.columns, *more)
