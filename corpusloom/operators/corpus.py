"""Corpus stages: normalise, clean, deduplicate, split, measure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import written
from .graph import components
from .ordering import first_wins, ranked

MIN_CHARS = 200
SHARES = (0.9, 0.05)


def normalized(df: DataFrame, jurisdiction: Column, snapshot: str, dataset: str) -> DataFrame:
    """Provisions with trimmed strings; a missing state is the jurisdiction; two provenance columns."""
    names = ("act_id", "title", "chapter", "section_number", "section_title", "act_status", "section_status", "source_url", "source_publisher", "text")
    return df.withColumns({
        **{c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in names},
        "state": T.strip(F.coalesce(F.nullif(F.col("state"), F.lit("")), jurisdiction, F.lit(""))),
        "source_snapshot": F.lit(snapshot), "source_dataset": F.lit(dataset),
    })


def union_sources(sources: dict[str, DataFrame], column: str = "jurisdiction") -> DataFrame:
    """Rows of several sources in their order, with the source's name and ordinal."""
    out = None
    for i, (name, df) in enumerate(sources.items()):
        one = df.withColumns({column: F.lit(name), "source_ord": F.lit(i)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def raw_dedup(df: DataFrame, order: str) -> DataFrame:
    """First of each (act, section, text); empty texts out."""
    return first_wins(df.where(F.coalesce(F.col("text"), F.lit("")) != ""), ["act_id", "section_number", "text"], order)


#: Rows that are taken of each jurisdiction.
PER_JURISDICTION = 12_500


def capped(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """The first *cap* rows of each group; only that many of a partition reach the shuffle."""
    n = Window.partitionBy(group).orderBy(order)
    return df.withColumn("__n", F.row_number().over(n)).where(F.col("__n") <= cap).drop("__n")


def cleaned(df: DataFrame, text: str = "text") -> DataFrame:
    """With the clean text and its digest; all other columns as they are."""
    return df.withColumn(text, T.clean_corpus(F.coalesce(F.col(text), F.lit("")))).withColumn("text_sha256", T.sha256(F.col(text)))


def _settled(open_rows: DataFrame) -> DataFrame:
    """Open rows that come first in both of their groups."""
    x = open_rows.join(open_rows.groupBy("a").agg(F.min("o").alias("ma")), "a").join(open_rows.groupBy("b").agg(F.min("o").alias("mb")), "b")
    return x.where((F.col("o") == F.col("ma")) & (F.col("o") == F.col("mb"))).select("a", "b", "o")


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """The kept rows of one component, by going through it in order."""
    seen_a, seen_b, kept = set(), set(), []
    rows = rows.sort_values("o")
    for a, b in zip(rows["a"], rows["b"]):
        kept.append(a not in seen_a and b not in seen_b)
        if kept[-1]:
            seen_a.add(a)
            seen_b.add(b)
    return rows.loc[kept, ["a", "b", "o"]]


def greedy_kept(pairs: DataFrame, rounds: int = 3, component_rows: int = 200_000) -> DataFrame:
    """pairs(a, b, o), one row a pair -> those kept when rows are gone through by *o* and one is kept if neither key belongs to a kept row.

    A few parallel rounds settle nearly all: a row that is the first of both of
    its groups is kept, rows sharing a key with it are dropped; minima are
    aggregated and joined, so no group is gathered. What hangs on long chains
    is parted into components, each of bounded size gone through in its own
    task; larger ones get further rounds, which drop rows and part them. There
    is no bound on the rounds.
    """
    open_rows, kept = written(pairs.select("a", "b", "o"), "greedy-open"), []
    while not open_rows.isEmpty():
        for _ in range(rounds):
            now = written(_settled(open_rows), "greedy-kept")
            kept.append(now)
            open_rows = written(open_rows.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("a", "b", "o"), "greedy-open")
            if open_rows.isEmpty():
                break
        else:
            parts = written(parted(open_rows), "greedy-parts")
            small = parts.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") <= component_rows).select("part")
            kept.append(written(parts.join(small, "part").groupBy("part").applyInPandas(lambda f: _in_order(f), open_rows.schema), "greedy-kept"))
            open_rows = written(parts.join(small, "part", "left_anti").select("a", "b", "o"), "greedy-open")
    out = pairs.select("a", "b", "o").limit(0)
    for one in kept:
        out = out.unionAll(one)
    return out


def parted(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, o) with ``part``: the same for rows tied by keys, directly or through others."""
    node = lambda kind, c: F.unhex(F.md5(F.concat(F.lit(kind), F.col(c).cast("string"))))
    x = pairs.withColumns({"a_node": node("a", "a"), "b_node": node("b", "b")})
    roots = components(x.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return x.join(roots.select(F.col("node").alias("a_node"), F.col("root").alias("part")), "a_node").select("a", "b", "o", "part")


def greedy_dedup(df: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Adds ``status``: kept, duplicate_id or duplicate_text.

    Going through the rows in order, a row is kept if neither of its keys
    belongs to a row kept before; the first key is asked first. Only the keys
    take part, the earliest row of each pair; the rows themselves are joined
    with their status once, by *order*, which must be unique.
    """
    keyed = df.select(F.col(first).alias("a"), F.col(second).alias("b"), F.col(order).alias("o"))
    slim = written(keyed, "greedy-keys")
    kept = written(greedy_kept(slim.groupBy("a", "b").agg(F.min("o").alias("o"))), "greedy-all")
    # one kept row a key at most; copies of a pair share its fate but for the first
    decided = (
        slim.groupBy("a", "b").agg(F.min("o").alias("o")).join(kept.select("a", F.col("o").alias("ka")), "a", "left").join(kept.select("b", F.col("o").alias("kb")), "b", "left")
        .select("a", "b", "ka", "kb")
    )
    status = F.when((F.col("ka") == F.col("o")) & (F.col("kb") == F.col("o")), "kept").when(F.col("ka") < F.col("o"), "duplicate_id").otherwise("duplicate_text")
    of = slim.join(decided, ["a", "b"]).select(F.col("o").alias(order), status.alias("status"))
    return df.join(of, order).select(*df.columns, "status")


def clean_outcomes(df: DataFrame, order: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Clean rows with ``status``: too_short, duplicate_id, duplicate_text or kept."""
    part = lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit("None")))
    x = cleaned(df).withColumn("provision_id", F.concat_ws(":", part("act_id"), part("section_number")))
    short = F.length("text") < min_chars
    # keys are hashed, so that the rounds move 32 bytes a row whatever the ids
    keys = x.where(~short).withColumns({"__a": F.unhex(F.md5("provision_id")), "__b": F.unhex("text_sha256")})
    rest = greedy_dedup(keys, "__a", "__b", order).drop("__a", "__b")
    return rest.unionByName(x.where(short).withColumn("status", F.lit("too_short")))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(outcome, n): every reason, kept rows, kept rows without a source, and the input."""
    reasons = ("kept", "duplicate_id", "duplicate_text", "too_short")
    counts = outcomes.agg(
        F.count("*").alias("input"), *[F.count_if(F.col("status") == r).alias(r) for r in reasons],
        F.count_if((F.col("status") == "kept") & (F.coalesce(T.strip(F.col("source_url")), F.lit("")) == "")).alias("missing_source"),
    )
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in counts.columns])).alias("x")).select("x.*")


def hash_split(df: DataFrame, key: str, seed: int = 42, shares: tuple[float, float] = SHARES) -> DataFrame:
    """Adds ``split`` by the rank of a seeded digest: int(.9 n) train, int(.05 n) validation, the rest test. Writes the ranks while the plan is made."""
    x = ranked(df.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)), ["__h", key], "__rank")
    n = x.agg(F.max("__rank")).first()[0] or 0
    train = int(n * shares[0])
    held = train + int(n * shares[1])
    return x.withColumn("split", F.when(F.col("__rank") <= train, "train").when(F.col("__rank") <= held, "validation").otherwise("test")).drop("__h", "__rank")


def corpus_stats(df: DataFrame, group: str = "split", text: str = "text") -> DataFrame:
    """Per group: records, characters, words, shortest, longest and mean length, estimated tokens, size, acts and sections."""
    chars, n_words = F.coalesce(F.length(text), F.lit(0)), T.word_count(F.col(text))
    act, section = F.coalesce("act_id", F.lit("")), F.coalesce("section_number", F.lit(""))
    return df.groupBy(group).agg(
        F.count("*").alias("records"), F.sum(chars).alias("characters"), F.sum(n_words).alias("words"), F.min(chars).alias("min_chars"), F.max(chars).alias("max_chars"),
        F.round(F.avg(chars), 2).alias("avg_chars"), F.bround(F.sum(n_words) * 1.33).cast("long").alias("estimated_tokens"), F.round(F.sum(chars) / 1e6, 2).alias("size_mb"),
        F.countDistinct(F.nullif(act, F.lit(""))).alias("unique_acts"),
        F.countDistinct(F.when((act != "") | (section != ""), F.concat(act, F.lit(":"), section))).alias("unique_sections"),
    )


def stats_total(stats: DataFrame) -> DataFrame:
    """Totals over groups; rounded estimates are summed as they are."""
    return stats.agg(*[F.sum(c).alias(c) for c in ("records", "characters", "words", "estimated_tokens")])


def histogram(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n); null and blank values are ``unknown``."""
    return df.groupBy(F.col(group), T.or_default(T.strip(F.col(value)), "unknown").alias(value)).agg(F.count("*").alias("n"))


def histogram_map(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(group, counts): a map per group."""
    return counts.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias("counts"))


def merged_maps(maps: DataFrame, column: str = "counts") -> DataFrame:
    """(key, n): maps added up by key."""
    return maps.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
