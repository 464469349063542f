"""Structured Streaming variants: deduplication, packing with carried state, append-only history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First of each key; with an event time, state is kept for *delay* only."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def packed(stream: DataFrame, key: str, tokens: str, block: int, eos: int, order: str) -> DataFrame:
    """key, block_no, input_ids, targets: blocks of each key's token stream, within a micro-batch in *order*; the rest is carried to the next one."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, no = state.get if state.exists else ([], 0)
        held, out = list(held), []
        f = pd.concat(list(frames)).sort_values("order", kind="stable")
        for t in f[tokens]:
            held += [*map(int, t), eos] if t is not None else []
        full = max(0, (len(held) - 1) // block)
        for at in range(0, full * block, block):
            out.append((k[0], no, held[at : at + block], held[at + 1 : at + block + 1]))
            no += 1
        held = held[full * block :]
        state.update((held, no))
        yield pd.DataFrame(out, columns=["key", "block_no", "input_ids", "targets"])

    return stream.select(F.col(key).cast("string").alias("key"), F.col(tokens).cast("array<int>").alias(tokens), F.col(order).alias("order")).groupBy("key").applyInPandasWithState(
        step, "key string, block_no long, input_ids array<int>, targets array<int>", "held array<int>, no long", "append", GroupStateTimeout.NoTimeout)


def write_available(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> None:
    """Append all that is there now and stop; a later call goes on from the checkpoint."""
    stream.writeStream.format(form).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
