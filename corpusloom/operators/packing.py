"""Token streams packed into fixed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import ranked


def packed(df: DataFrame, order: list[str], tokens: str, block: int, eos) -> DataFrame:
    """block_no (from 0), input_ids, targets: the stream of all rows' tokens, each row's followed by *eos*, in windows of block + 1 every block tokens.

    Offsets come from a two-phase prefix sum; a row then meets only the blocks
    it reaches into, a slice for each, and a block is put together from the
    slices of its few rows. The incomplete tail is dropped.
    """
    kind = df.schema[tokens].dataType
    x = df.where(F.col(tokens).isNotNull()).select(*order, F.concat(F.col(tokens), F.array(F.lit(eos)).cast(kind)).alias("t"))
    x = ranked(x.withColumn("n", F.size("t")), order, "row", F.col("n"), "upto").withColumn("at", F.col("upto") - F.col("n"))
    # block b takes positions b * block to (b + 1) * block, both included
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - 1) / block)).cast("long")
    last = F.floor((F.col("upto") - 1) / block).cast("long")
    x = x.select("row", "t", "at", "n", F.explode(F.sequence(first, last)).alias("block_no"))
    low = F.greatest(F.col("block_no") * block - F.col("at"), F.lit(0))
    high = F.least((F.col("block_no") + 1) * block - F.col("at"), F.col("n") - 1)
    x = x.where(high >= low).select("block_no", "row", F.slice("t", (low + 1).cast("int"), (high - low + 1).cast("int")).alias("s"))
    y = x.groupBy("block_no").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row", "s"))), lambda z: z["s"])).alias("w")).where(F.size("w") == block + 1)
    return y.select("block_no", F.slice("w", 1, block).alias("input_ids"), F.slice("w", 2, block).alias("targets"))


def padded_batches(df: DataFrame, order: list[str], batch: int, ids: str = "input_ids", labels: str = "labels", pad: int = 0, ignored: int = -100) -> DataFrame:
    """Rows with batch_no, padded to the longest of their batch: ids and mask with 0, labels ignored."""
    from ..functions.numbers import padded

    x = ranked(df, order, "__r").withColumn("batch_no", ((F.col("__r") - 1) / batch).cast("long"))
    width = x.groupBy("batch_no").agg(F.max(F.size(ids)).alias("__w"))
    x = x.join(width, "batch_no").withColumn("attention_mask", padded(F.array_repeat(F.lit(1), F.size(ids)), F.col("__w"), 0))
    return x.withColumns({ids: padded(F.col(ids), F.col("__w"), pad), labels: padded(F.col(labels), F.col("__w"), ignored)}).drop("__r", "__w")


def encoded_totals(df: DataFrame, group: str, tokens: str) -> DataFrame:
    """(group, records, tokens, avg_tokens) of each group and of all (null group)."""
    n = F.coalesce(F.sum(F.size(tokens).cast("long")), F.lit(0))
    return df.rollup(group).agg(F.count("*").alias("records"), n.alias("tokens"), F.round(n / F.greatest(F.count("*"), F.lit(1)), 2).alias("avg_tokens"))
