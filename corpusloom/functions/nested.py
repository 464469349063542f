"""Maps, JSON documents and instants as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resolved(document: Column, names: list[str], default) -> Column:
    """Value at the first of several JSON paths that is there; a configuration's fields go by several names."""
    return F.coalesce(*[F.get_json_object(document, n if n.startswith("$") else f"$.{n}") for n in names], F.lit(default).cast("string"))


def sample_map(df: DataFrame, prompt: str, sample: str, order: str, n: int) -> DataFrame:
    """One row: a map of the first *n* prompts to their samples; of a prompt seen twice the last sample counts."""
    first = df.where(F.col(prompt).isNotNull()).orderBy(order).limit(n)
    one = first.groupBy(prompt).agg(F.max_by(sample, order).alias(sample), F.min(order).alias("o"))
    rows = F.sort_array(F.collect_list(F.struct("o", prompt, sample)))
    return one.agg(rows.alias("r")).select(F.map_from_arrays(F.transform("r", lambda x: x[prompt]), F.transform("r", lambda x: x[sample])).alias("samples"))


def iso_utc(instant: Column) -> Column:
    """ISO 8601 text of an instant, in a session whose zone is UTC."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def now_utc() -> Column:
    """This instant as ISO 8601 text."""
    return iso_utc(F.current_timestamp())


def elapsed(start: Column, end: Column) -> Column:
    """Seconds from one instant to another."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6
