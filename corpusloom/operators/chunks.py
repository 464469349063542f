"""Pages to chunks: headings, sections, windows, carried sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import written
from .ordering import ranked

SIZE, OVERLAP = 1200, 150
# Fixed value: a heading, that is a number and a full stop at a line's start, then a title of up to 300 characters that crosses no other such line, up to a dash.
HEADING = r"(?ms)(?:^|\n)\s*(\d+[A-Z]?)\.\s+((?:(?!\n\s*\d+[A-Z]?\.\s+).){1,300}?)(?:\s*[—–-]\s*)"


def windows(df: DataFrame, keys: list[str], text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """keys, window_no (from 0), chunk, character_count: windows of *size* every size - overlap characters, stripped, blank ones out."""
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    x = df.where(n > 0).select(*keys, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    x = x.select(*keys, "window_no", T.strip(F.substring(F.col("__t"), F.col("window_no") * step + 1, F.lit(size))).alias("chunk"))
    return x.where("chunk <> ''").withColumn("character_count", F.length("chunk"))


def headings(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ord, section, title: headings of a text in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(HEADING), F.lit(0))
    x = df.select(*keys, F.posexplode(found).alias("ord", "__h"))
    return x.select(*keys, "ord", F.regexp_extract("__h", HEADING, 1).alias("section"), T.strip(F.regexp_extract("__h", HEADING, 2)).alias("title"))


def _cut(text: str) -> list[tuple[int, str | None, str | None, str]]:
    marks = list(regex.finditer(HEADING, text))
    out = []
    first = marks[0].start() if marks else len(text)
    if text[:first].strip():
        out.append((0, None, None, text[:first].strip()))
    for i, m in enumerate(marks):
        end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        if (body := text[m.start() : end].strip()):
            out.append((len(out), m[1], m[2].strip(), body))
    return out


def sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, segment, section, title, body: the part before the first heading (no section), then one segment a heading."""
    types = {c: df.schema[c].dataType.simpleString() for c in keys}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(*[r[k] for k in keys], *s) for r in f.to_dict("records") if r["__t"] for s in _cut(r["__t"])]
            yield pd.DataFrame(rows, columns=[*keys, "segment", "section", "title", "body"])

    schema = ", ".join([*[f"`{k}` {t}" for k, t in types.items()], "segment int, section string, title string, body string"])
    return df.select(*keys, F.col(text).alias("__t")).mapInPandas(run, schema)


def carried(df: DataFrame, value: str, order: list[str], within: list[str], out: str) -> DataFrame:
    """Adds *out*: the last value that is not null, up to and with the row, in *order* within the groups.

    Range partitions carry what the ones before them leave of a group (a row for
    each group they touch), so a group may span any number of tasks.
    """
    x = written(df.repartitionByRange(*within, *order).withColumn("__part", F.spark_partition_id()), "carried")
    # a struct, for a group of nulls must join with itself and a value may be null
    left = x.groupBy("__part", *within).agg(F.max_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__v"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("__from", F.last("__v", ignorenulls=True).over(before)).select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in within], "__from")
    same = F.col("__part") == F.col("__p")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    own = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    y = x.join(left, same).withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(own), F.col("__from").getField(value)))
    return y.select(*df.columns, out)


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """source_file, page_number, text -> chunks with carried sections and running ids ``contract_00001``. A section is carried on in the order of files and pages, over the end of a file too."""
    p = pages.select("source_file", "page_number", T.clean_page(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    s = sections(p, ["source_file", "page_number"], "t")
    named = carried(s.withColumn("mark", F.when(F.col("section").isNotNull(), F.struct("section", "title"))), "mark", ["source_file", "page_number", "segment"], [], "now")
    w = windows(named.select("source_file", "page_number", "segment", "now", "body"), ["source_file", "page_number", "segment", "now"], "body", size, overlap)
    return ranked(w, ["source_file", "page_number", "segment", "window_no"], "n").select(
        F.format_string("contract_%05d", "n").alias("chunk_id"), "source_file", "page_number", F.col("now.section").alias("section_number"),
        F.col("now.title").alias("section_title"), F.col("chunk").alias("text"), "character_count",
    )


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Number of chunks, their characters and mean length."""
    return chunks.agg(F.count("*").alias("chunks"), F.sum("character_count").alias("characters"), F.round(F.avg("character_count"), 2).alias("mean_characters"))


def page_totals(pages: DataFrame, text: Column | None = None) -> DataFrame:
    """Number of pages, of those with text, and characters."""
    t = T.strip(F.coalesce(F.col("text") if text is None else text, F.lit("")))
    return pages.agg(F.count("*").alias("pages"), F.count_if(t != "").alias("with_text"), F.sum(F.length(t)).alias("characters"))
