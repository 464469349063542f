"""Joins of many rows with a table of one row a key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, parts: int = 2000) -> DataFrame:
    """Left join of *rows* with *table* on *key*; *n* is a column of *table*, the number of rows of the key, and is dropped.

    Rows without a key are not shuffled. Keys of more than ``total / parts``
    rows are *parts* at most, so their part of the table is broadcast; the rows
    of any other key are few enough for one task.
    """
    extra = [c for c in table.columns if c not in (key, n)]
    kinds = {f.name: f.dataType for f in table.schema.fields}
    heavy = F.broadcast(table.where(F.col(n) > max(1, total // parts)).drop(n))
    light = table.where(F.col(n) <= max(1, total // parts)).drop(n)
    keyed = rows.where(F.col(key).isNotNull())
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    columns = [*rows.columns, *extra]
    return keyed.join(heavy, key).select(columns).unionAll(keyed.join(heavy.select(key), key, "left_anti").join(light, key, "left").select(columns)).unionAll(none)
