"""Cutting oversized items at natural boundaries, JVM-side.

One bounded-quantifier regular expression, its alternatives ordered by the
strength of the boundary, consumes an item segment by segment: the rest if it
fits, a paragraph end, a sentence end, a clause end, white space, a grapheme,
any character. Each segment but the first is preceded by a lookback of the
segment before it, which begins at a word where one begins near.

Defined results: null and short items give no piece; ``keep_short=True`` gives
them back as one piece; an item without any boundary is cut between
characters; repeated items are cut alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: Segments of a block, whose lengths are summed once.
BLOCK = 256


def segment_pattern(body: int) -> str:
    """Pattern of one segment of at most *body* code points."""
    low = max(1, body // 2)
    return "(?s)" + "|".join([
        rf".{{1,{body}}}\z",
        rf".{{{low},{body}}}(?<=\n[ \t\r]{{0,8}}\n)",
        rf".{{{low},{body}}}(?<=[.!?।॥。][\"')\]”’]{{0,2}}\s)",
        rf".{{{low},{body}}}(?<=[,;:—|]\s)",
        rf".{{{low},{body}}}(?<=\s)",
        rf".{{{low},{body}}}(?!\p{{M}})",
        rf".{{1,{body}}}",
    ])


def segments(text: Column, limit: int, overlap: int) -> Column:
    """Ordered segments that join to the whole text."""
    return F.regexp_extract_all(text, F.lit(segment_pattern(limit - overlap)), F.lit(0))


def lookback(segment: Column, overlap: int) -> Column:
    """The last *overlap* code points of a segment, or up to a fifth fewer so as to begin at a word."""
    if overlap == 0:
        return F.lit("")
    return F.regexp_extract(F.right(segment, F.lit(overlap + 1)), rf"(?s)^(?:\S{{0,{overlap // 5}}}\s|.)(.*)$", 1)


def cut(df: DataFrame, keys: list[str], text: str, limit: int = 1200, overlap: int = 150, keep_short: bool = False) -> DataFrame:
    """keys, piece_no (from 1), start (code point from 1, overlap included), overlap_chars, piece — of each value of *text* beyond *limit*."""
    if not 0 <= overlap * 3 < limit:
        raise ValueError("overlap must be non-negative and less than a third of limit")
    t = F.col(text).cast("string")
    base = df.select(*keys, t.alias("__t")).where(F.length("__t") > limit if not keep_short else F.length("__t") > 0)
    base = base.select(*keys, F.when(F.length("__t") > limit, segments(F.col("__t"), limit, overlap)).otherwise(F.array("__t")).alias("__s"))
    sizes = F.transform("__s", F.length)
    tails = F.transform("__s", lambda s: lookback(s, overlap))
    # where each segment begins: totals of whole blocks of segments, then the segments before it in its block
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.sequence(F.lit(0), F.floor((F.size("__n") - 1) / BLOCK).cast("int"))
    out = base.select(*keys, F.col("__s"), sizes.alias("__n"), tails.alias("__b")).withColumn("__t", F.transform(blocks, lambda b: add(F.slice("__n", b * BLOCK + 1, F.lit(BLOCK)))))
    out = out.withColumn("__q", F.transform(blocks, lambda b: add(F.slice("__t", F.lit(1), b)))).select(
        *keys,
        F.transform("__s", lambda s, i: F.struct(
            (i + 1).alias("piece_no"),
            F.when(i == 0, F.lit("")).otherwise(F.get("__b", i - 1)).alias("back"),
            s.alias("own"),
            (1 + F.get("__q", F.floor(i / BLOCK).cast("int")) + add(F.slice("__n", i - i % BLOCK + 1, i % BLOCK))).alias("at"),
        )).alias("__p"),
    ).select(*keys, F.explode_outer("__p").alias("__p"))  # a plain explode infers a filter on the size, for which the pattern runs once more
    return out.select(
        *keys, F.col("__p.piece_no").alias("piece_no"), (F.col("__p.at") - F.length("__p.back")).alias("start"),
        F.length("__p.back").alias("overlap_chars"), F.concat("__p.back", "__p.own").alias("piece"),
    )


def cut_fields(tables: dict[str, tuple[DataFrame, str, list[str]]], limit: int = 1200, overlap: int = 150) -> DataFrame:
    """tab, row_id, field and the columns of :func:`cut`; tables: name -> (frame, key column, text fields)."""
    out = None
    for tab, (df, key, fields) in tables.items():
        # one scan for all fields of a table
        long = df.select(
            F.col(key).cast("long").alias("row_id"),
            F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("t")) for f in fields])).alias("x"),
        ).select(F.lit(tab).alias("tab"), "row_id", "x.field", "x.t")
        one = cut(long, ["tab", "row_id", "field"], "t", limit, overlap)
        out = one if out is None else out.unionByName(one)
    return out
