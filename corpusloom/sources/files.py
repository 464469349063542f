"""Readers and writers. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import RECORDS

# Fixed value: how a PDF file begins.
PDF_MAGIC = b"%PDF"


def read_jsonl(spark: SparkSession, path: str | list[str], record: str) -> DataFrame:
    """Rows of a record type; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(RECORDS[record]).option("mode", "FAILFAST").json(path)


def read_jurisdictions(spark: SparkSession, root: str, names: list[str], pattern: str = "in_{}_legislation.parquet") -> DataFrame:
    """Raw provisions, a file for each jurisdiction, with ``jurisdiction`` and ``source_ord``."""
    from ..operators.corpus import union_sources

    return union_sources({n: spark.read.parquet(f"{root.rstrip('/')}/{pattern.format(n)}") for n in names})


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ``history`` array of a JSON document."""
    return read_document(spark, path, f"history ARRAY<STRUCT<{', '.join(f.strip().replace(' ', ': ', 1) for f in RECORDS['history'].split(','))}>>").select(F.inline("history"))


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of PDF files; needs pypdf on the executors. Pages count from 1, text is stripped, missing text is empty."""
    files = spark.read.format("binaryFile").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF pages needs pypdf") from e
        for f in frames:
            for p, raw in zip(f["path"], f["content"]):
                if not raw.startswith(PDF_MAGIC):
                    raise ValueError(f"{p} is no PDF file")
                texts = [(page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(raw)).pages]
                yield pd.DataFrame({"source_file": p.rsplit("/", 1)[-1], "page_number": range(1, len(texts) + 1), "text": texts, "character_count": [len(t) for t in texts]})

    return files.select("path", "content").mapInPandas(run, RECORDS["pdf_pages"])


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself; raises if it has no row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, overwriting or appending."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", form: str = "parquet", files: int = 1) -> None:
    """A folder of about *files* files for each split: rows meet by split and one of as many random numbers."""
    spread = df.withColumn("__f", F.floor(F.rand(1) * files)).repartition(split, "__f").drop("__f")
    spread.write.mode("overwrite").partitionBy(split).format(form).save(path)


def write_report(df: DataFrame, path: str, key: str = "rows") -> None:
    """A small result as one JSON document: its rows, in no order, under *key*."""
    df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias(key)), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
