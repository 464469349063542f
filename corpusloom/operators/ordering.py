"""Order-dependent building blocks that never gather a table or a hot group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least *order* for each value of the keys (nulls are equal); partial aggregates meet in the shuffle, so hot keys do not hurt."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col("__r").getField(c).alias(c) for c in rest]).select(df.columns)


def ranked(df: DataFrame, order: list[str], rank: str = "rank", weight: Column | None = None, total: str | None = None) -> DataFrame:
    """Adds the global 1-based rank in *order* (and the running total of *weight* up to and with the row).

    Two phases: range partitions are written once and counted; their offsets (a
    row per partition) are joined back, and each partition is ranked on its own.
    """
    x = df.withColumn("__w", (weight if weight is not None else F.lit(1)).cast("long"))
    x = written(x.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = x.groupBy("__part").agg(F.count("*").alias("__n"), F.sum("__w").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as partitions
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"))
    own = Window.partitionBy("__part").orderBy(*order)
    out = x.join(F.broadcast(offsets), "__part").withColumn(rank, F.row_number().over(own) + F.col("__n0"))
    if total:
        out = out.withColumn(total, F.sum("__w").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__s0"))
    return out.drop("__part", "__w", "__n0", "__s0")
