"""Connected components by alternating large-star and small-star rounds.

Only minima per node are aggregated and joined back, so the neighbours of a hot
node are never gathered into one task; every round is cut by a checkpoint in
the shared folder. It ends when every component is a star: each node is tied to
one other, which is tied to none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir


def _stars(e: DataFrame) -> bool:
    ends = e.select(F.col("v").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("root")).unionAll(e.select(F.col("u"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("root").alias("root")).where((F.col("n") > 1) | (F.col("n") > 0) & (F.col("root") > 0)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), any orderable type, nulls and loops ignored -> (node, root), root the least node of the component.

    Nodes without an edge are absent. Log-many rounds suffice.
    """
    shared_dir(edges.sparkSession)
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct().checkpoint()
    )
    while not _stars(e):
        both = e.select("v", "u").union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        large = large.distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("x"), "m", "v")
        e = (
            small.select(F.col("x").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u")))
            .where("v <> u").distinct().checkpoint()
        )
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
