"""Encoding a corpus with a public byte-level tokenizer, and exact token counts.

The encoder (a vocabulary of fixed size) is broadcast once; texts stream
through it in Arrow batches, and nothing is shuffled. For counts, documents
beyond ``long_chars`` are cut where a pre-token ends whatever stands on either
side, so the chunks' counts add up exactly; the chunks are spread over all
workers and summed per document.

Defined results: null and empty texts have an empty list of ids and no tokens;
rows of repeated keys are counted each; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .bpe import DEFAULT_RANKS, ByteBpe

#: Where the pattern's pre-tokens must part: other than white space before white
#: space; a letter before ASCII that is no letter; a digit before an ASCII letter.
SAFE_END = r"(?:(?<=[^\s\p{Z}\x85\x1c-\x1f])(?=[ \t\n\x0B\f\r])|(?<=\p{L})(?=[\x21-\x40\x5B-\x60\x7B-\x7E])|(?<=[0-9])(?=[A-Za-z]))"


def _apply(broadcast, f: Callable[[ByteBpe, pa.Array], pa.Array], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = broadcast.value
        for b in batches:
            names = [*b.schema.names[:-1], "out"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], f(bpe, b.column(b.num_columns - 1)).cast(kind)], names=names)

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(ByteBpe.load(ranks))
    kind = df.schema[key].dataType.simpleString()
    run = _apply(shared, lambda bpe, t: bpe.encode_array(t), pa.list_(pa.int32()))
    return df.select(F.col(key), F.col(text).cast("string").alias("t")).mapInArrow(run, f"`{key}` {kind}, out array<int>").withColumnRenamed("out", "ids")


def safe_chunks(text: Column, chars: int) -> Column:
    """Chunks of a text of about *chars* code points that tokenise as they do within it."""
    # a quantifier per thousand keeps each alternative's backtracking short
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{chars}}}\z|.{{{chars - chars // 8},{chars}}}{SAFE_END}|.{{{chars}}}.*?(?:{SAFE_END}|\z)"), F.lit(0))


def token_counts(df: DataFrame, key: str, text: str = "text", ranks: str = DEFAULT_RANKS, long_chars: int = 100_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, tokens) of every row, by one scan and without a join.

    Rows are counted as they stream by; only long texts are passed on, cut,
    spread by a salt and summed under the number that their row got.
    """
    shared = df.sparkSession.sparkContext.broadcast(ByteBpe.load(ranks))
    own = [key, *(c for c in keep if c != key)]
    # the columns may be called anything, so they travel under numbers
    types = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(own)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for b in batches:
            t = b.column(b.num_columns - 1)
            long = pc.fill_null(pc.greater(pc.utf8_length(t), long_chars), False)
            counted = pa.array(bpe.count_array(pc.if_else(long, pa.scalar(None, t.type), t)), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pc.if_else(long, pa.scalar(None, pa.int64()), counted), pc.if_else(long, t, pa.scalar(None, t.type))],
                                             names=[*b.schema.names[:-1], "out", "long"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(bpe.count_array(b.column(b.num_columns - 1)), pa.int64())], names=["row", "out"])

    seen = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(own)], F.col(text).cast("string").alias("t")).mapInArrow(first, f"{', '.join(types)}, out long, long string")
    seen = seen.withColumn("row", F.when(F.col("long").isNotNull(), F.monotonically_increasing_id()))
    seen = written(seen, "token-counts")
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(own)]
    short = seen.where("long is null").select(*names, F.col("out").alias("tokens"))
    # long rows are few; their other columns meet the sums again by the row's number
    rest = seen.where("long is not null")
    chunks = rest.select("row", F.posexplode(safe_chunks(F.col("long"), long_chars // 2)).alias("no", "t")).repartition(F.xxhash64("row", "no")).select("row", "t")
    sums = chunks.mapInArrow(second, "row long, out long").groupBy("row").agg(F.sum("out").alias("tokens"))
    return short.union(rest.drop("out", "long").join(sums, "row").select(*names, "tokens"))
