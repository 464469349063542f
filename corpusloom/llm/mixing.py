"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Blocks go one by one to the source with the highest quotient share / (2q + 1)
that has blocks left under its cap of repeats; each source's quota is
apportioned to its shards the same way, and a shard uses its documents in a
seeded order: all of them as often as its quota covers it, and the first blocks
once more. A divisor is sought by bisection, so the number of blocks costs
nothing, and a block is small against every shard and every source.

Only totals of sources (a configuration's number of rows) reach the driver.
Shards, of ``shard_tokens`` tokens or ``shard_docs`` documents each, are counted
and apportioned in tables, the shards of a source in one group of a row each
(12,500 rows at 25 T tokens); a shard bounds every window over documents.

Defined results: documents without tokens, with a null source or a source
without a target are not used; a source that is too small is used
``max_repeats`` times and the rest goes to the others; one without documents has
a report of noughts and does not lower the total; an empty table gives no uses.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Blocks that a shard, and the smallest source, hold at least.
SHARD_BLOCKS, SOURCE_BLOCKS = 256, 16


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotient weight / (2 seats + 1), none beyond its cap; ties go to the earlier."""
    w, cap = np.array(weights, float), np.array(caps, np.int64)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    seats = min(seats, int(cap.sum()))
    if not seats:
        return [0] * len(w)

    def at(divisor: float) -> np.ndarray:
        # the seats whose quotients w / (2q + 1) are at least divisor / 2
        return np.minimum(cap, np.floor(np.minimum(w / divisor + 0.5, 2.0**62)).astype(np.int64))

    low, high = float(w[w > 0].min()) / 4 / max(1, seats), float(w.max()) * 4  # too many or just enough seats, and none
    if at(low).sum() <= seats:
        high = low
    else:
        while high > low * (1 + 1e-15):
            middle = (low * high) ** 0.5
            if not low < middle < high:
                break
            low, high = (middle, high) if at(middle).sum() > seats else (low, middle)
    got = at(high)
    # what ties, or the last bits of the divisor, leave
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in range(len(w)) if got[i] < cap[i]]
    heapq.heapify(heap)
    left = seats - int(got.sum())
    while left > 0:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def largest_total(shares: list[float], caps: list[float], max_shortfall: float) -> int:
    """The largest total at which the sources that fall short of their share leave at most *max_shortfall* of it unmet."""
    low, high = 0.0, float(sum(caps))
    for _ in range(80):
        t = (low + high) / 2
        unmet = sum(max(0.0, w * t - c) for w, c in zip(shares, caps))
        low, high = (t, high) if unmet <= max_shortfall * t else (low, t)
    return int(low)


def block_size(total: int, pools: list[int], blocks: int, shard_tokens: int) -> int:
    """Tokens of a block: a *blocks*-th of the total, but small against a shard and the smallest source."""
    return max(1, min(total // blocks, shard_tokens // SHARD_BLOCKS, min(pools, default=1) // SOURCE_BLOCKS))


def shard_quotas(tokens: list[int], quota: int, block: int, repeats: int) -> list[tuple[int, int]]:
    """(whole uses, tokens used once more) of each shard; all blocks of the quota are placed.

    Caps are differences of the running total, so what a shard has beyond its last whole block counts for the next one.
    """
    upto = np.cumsum(np.array(tokens, dtype=object)) * repeats // block
    caps = [int(x) for x in np.diff(upto, prepend=0)]
    seats = sainte_lague([float(n) for n in tokens], caps, quota)
    if sum(seats) != quota:
        raise AssertionError(f"{sum(seats)} of {quota} blocks placed")
    return [(q * block // n, q * block % n) for n, q in zip(tokens, seats)]


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, max_shortfall: float = 0.05, blocks: int = 100_000, shard_tokens: int = 2_000_000_000,
        shard_docs: int = 4_000_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, tokens), targets(source, target_share, max_repeats) -> (uses, report).

    uses(doc_id, source, tokens, uses); report(source, target_share, max_repeats, n_docs, pool_tokens, used_docs, mixed_tokens, mean_uses, actual_share).
    *total_tokens* defaults to :func:`largest_total`, so that sources too small for their share leave little to the others.
    """
    spark = docs.sparkSession
    # one row a source: the number of targets is a configuration
    want = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0")
            .groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}
    names = sorted(want)
    listed = spark.createDataFrame([(s, *want[s]) for s in names], "source string, target_share double, max_repeats int")
    pool = docs.join(F.broadcast(listed), "source").where("tokens > 0").select("doc_id", "source", "tokens", "target_share", "max_repeats")
    held = {r[0]: (int(r[1]), r[2]) for r in pool.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
    size = {s: held[s][0] for s in held}
    present = [s for s in names if size.get(s)]  # a source without tokens falls short of any total
    weight = sum(want[s][0] for s in present) or 1.0
    total = total_tokens or largest_total([want[s][0] / weight for s in present], [float(want[s][1] * size[s]) for s in present], max_shortfall)
    block = block_size(total, [size[s] for s in present], blocks, shard_tokens)
    quota = dict(zip(names, sainte_lague([want[s][0] for s in names], [want[s][1] * size.get(s, 0) // block for s in names], total // block)))
    parts = {s: max(1, -(-held[s][0] // shard_tokens), -(-held[s][1] // shard_docs)) if s in held else 1 for s in names}
    shards = spark.createDataFrame([(s, parts[s]) for s in names], "source string, shards long")
    pool = pool.join(F.broadcast(shards), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "shards"))

    def apportion(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("shard")
        got = shard_quotas([int(n) for n in own["tokens"]], quota[key[0]], block, want[key[0]][1])
        return pd.DataFrame({"source": own["source"], "shard": own["shard"], "whole": [a for a, _ in got], "rest": [b for _, b in got]})

    plan = pool.groupBy("source", "shard").agg(F.sum("tokens").cast("long").alias("tokens")).groupBy("source").applyInPandas(apportion, "source string, shard long, whole long, rest long")
    before = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    uses = (
        pool.withColumn("at", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(plan, ["source", "shard"])
        .select("doc_id", "source", "tokens", F.least(
            F.col("max_repeats").cast("long"), F.col("whole") + F.when(F.col("at") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
        ).alias("uses"))
    )
    got = uses.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("tokens").alias("pool_tokens"), F.sum((F.col("uses") > 0).cast("long")).alias("used_docs"),
        F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"), F.round(F.avg("uses"), 6).alias("mean_uses"), F.max("uses").alias("most_uses"),
    )
    every = got.agg(F.sum("mixed_tokens").alias("every"))
    report = listed.join(got, "source", "left").crossJoin(F.broadcast(every)).select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "pool_tokens", "used_docs", "mixed_tokens", "mean_uses", "most_uses")],
        F.round(F.coalesce(F.col("mixed_tokens") / F.nullif(F.col("every"), F.lit(0)), F.lit(0.0)), 6).alias("actual_share"),
    )
    return uses, report
