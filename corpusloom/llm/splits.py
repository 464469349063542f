"""Splits that keep related records together.

Records are tied by act (``act_id`` reduced to its letters and digits, case
ignored) and by ``source_id`` as written; ties carry on through any number of
records. Components are placed by grouped iterative stratification: the label
with the fewest records outstanding goes first, its components go, largest
first, to the split that needs that label most.

Scale: sources are contracted to edges between acts before components are
sought. Components of more than ``1 / heavy_parts`` of all records (at most
``heavy_parts`` of them, a proven bound) are placed on the driver; all others
are hashed into shards of bounded size, each of which runs the same placement
against its share of what the heavy ones left outstanding.

Defined results: null ids, and acts without letters or digits, tie nothing; a
record without ties is its own component; repeated rows are rows of one
component like any other; an empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from ..operators.graph import components
from .skew import lookup

SPLITS = ("train", "validation", "test")


def act_key(c: Column) -> Column:
    """Letters and digits of an act id in lower case; null where there are none."""
    return F.nullif(F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{Nd}]", ""), F.lit(""))


def _node(kind: str, c: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(kind), c)))


def related_records(tables: dict[str, tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """(tab, row_id, act_id, act, source, labels) of every record; tables: name -> (frame, key column, label columns)."""
    out = None
    for tab, (df, key, labels) in tables.items():
        one = df.select(
            F.lit(tab).alias("tab"), F.col(key).cast("long").alias("row_id"), F.col("act_id").cast("string").alias("act_id"),
            _node("a", act_key(F.col("act_id").cast("string"))).alias("act"),
            _node("s", F.col("source_id").cast("string")).alias("source"),
            F.array(*[F.concat(F.lit(f"{tab}.{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in labels.items()],
                    F.lit(f"{tab}")).alias("labels"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def act_roots(records: DataFrame) -> DataFrame:
    """(act, root) of every act, root the least act of its component."""
    pairs = records.where("act is not null").select("act", "source").distinct()
    tied = pairs.where("source is not null")
    first = tied.groupBy("source").agg(F.min("act").alias("a"), F.max("act").alias("z")).where("a <> z").select("source", "a")
    edges = tied.join(first, "source").select("a", F.col("act").alias("b")).where("a <> b").distinct()
    roots = components(edges).withColumnRenamed("node", "act")
    return pairs.select("act").distinct().join(roots, "act", "left").select("act", F.coalesce("root", "act").alias("root"))


def act_groups(records: DataFrame) -> DataFrame:
    """(act_id, root): each spelling of an act with the least act of its component; a row a spelling, however many are tied."""
    return records.where("act is not null").select("act_id", "act").distinct().join(act_roots(records), "act").select("act_id", "root")


def tied_acts(records: DataFrame) -> DataFrame:
    """p1_found: every pair of different act_id spellings that must share a split."""
    ids = act_groups(records)
    many = ids.groupBy("root").count().where("count > 1").select("root")
    ids = written(ids.join(many, "root"), "p1-ids")
    a, b = ids.select("root", F.col("act_id").alias("act_id_a")), ids.select("root", F.col("act_id").alias("act_id_b"))
    return a.join(b, "root").where("act_id_a < act_id_b").select("act_id_a", "act_id_b")


def record_components(records: DataFrame) -> DataFrame:
    """(tab, row_id, labels, component) of every record."""
    total = records.count()
    roots = act_roots(records)
    by_act = records.where("act is not null").groupBy("act").agg(F.count("*").alias("n")).join(roots, "act")
    by_source = (
        records.where("act is not null and source is not null").select("act", "source").distinct()
        .groupBy("source").agg(F.min("act").alias("act")).join(roots, "act").select("source", F.col("root").alias("source_root"))
    )
    # only records without an act go by their source
    sizes = records.where("act is null and source is not null").groupBy("source").agg(F.count("*").alias("n"))
    named = lookup(records.where("act is not null"), by_act, "act", "n", total).withColumn("source_root", F.lit(None).cast("binary"))
    unnamed = lookup(records.where("act is null"), by_source.join(sizes, "source"), "source", "n", total).withColumn("root", F.lit(None).cast("binary"))
    return named.unionByName(unnamed).select("tab", "row_id", "labels", F.coalesce(
        "root", "source_root", "source", F.unhex(F.md5(F.concat_ws(":", F.lit("r"), "tab", F.col("row_id").cast("string"))))
    ).alias("component"))


def stratify(counts: np.ndarray, desired: np.ndarray) -> np.ndarray:
    """Grouped iterative stratification. counts[c, l]: records of label l in component c; desired[s, l]: still wanted. Returns the split of each component.

    Components must come in a fixed order; ties fall to the earlier component and the earlier split.
    *desired* is used up in place; its last column counts records.
    """
    n, labels = counts.shape
    placed, left = np.full(n, -1, np.int8), counts.sum(0).astype(float)
    while (placed < 0).any():
        open_labels = np.where(left > 0.5)[0]
        if not len(open_labels):
            placed[placed < 0] = int(np.argmax(desired[:, -1]))
            break
        label = open_labels[np.argmin(left[open_labels])]
        own = np.where((placed < 0) & (counts[:, label] > 0))[0]
        for c in own[np.argsort(-counts[own, label], kind="stable")]:
            most = desired[:, label] >= desired[:, label].max() - 1e-9
            s = int(np.argmax(np.where(most, desired[:, -1], -np.inf)))
            placed[c] = s
            desired[s] -= counts[c]
            left -= counts[c]
        left[label] = 0
    return placed


def assign(records: DataFrame, shares: tuple[float, ...] = (0.9, 0.05, 0.05), names: tuple[str, ...] = SPLITS,
           heavy_parts: int = 2000, shard_components: int = 20000) -> DataFrame:
    """(tab, row_id, component, split) of every record, in the given proportions, no component cut."""
    own = written(record_components(records), "p1-components")
    vectors = written(
        own.select("component", F.explode("labels").alias("label")).groupBy("component", "label").count()
        .groupBy("component").agg(F.collect_list(F.struct("label", "count")).alias("v")), "p1-vectors",
    )
    totals = {r[0]: r[1] for r in own.select(F.explode("labels").alias("label")).groupBy("label").count().collect()}
    kinds = sorted(k for k in totals if "=" in k)
    tabs = sorted(k for k in totals if "=" not in k)
    every = float(sum(totals[t] for t in tabs))
    at = {k: i for i, k in enumerate(kinds + tabs)}
    width = len(at) + 1

    def matrix(vs: list) -> np.ndarray:
        m = np.zeros((len(vs), width))
        for i, v in enumerate(vs):
            for label, count in v:
                m[i, at[label]] += count
                if label in tabs:
                    m[i, -1] += count
        return m

    whole = np.array([totals[k] for k in kinds + tabs] + [every])
    desired = np.outer(np.array(shares) / sum(shares), whole)
    records_of = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.when(x["label"].isin(tabs), x["count"]).otherwise(0))
    sized = vectors.withColumn("records", records_of)
    bound = every / heavy_parts
    heavy = sorted(((bytes(r["component"]), r["v"]) for r in sized.where(F.col("records") > bound).collect()), key=lambda x: x[0])
    fixed: dict[bytes, str] = {}
    if heavy:
        m = matrix([v for _, v in heavy])
        for (c, _), s in zip(heavy, stratify(m, desired)):
            fixed[c] = names[s]
        whole = whole - m.sum(0)
    light = sized.where(F.col("records") <= bound)
    shards = max(1, -(-light.count() // shard_components))
    rest = desired / np.maximum(whole, 1)  # of each label, the part of the outstanding records that each split still wants

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("component", key=lambda s: s.map(bytes))
        m = matrix([[(x["label"], x["count"]) for x in v] for v in frame["v"]])
        picked = stratify(m, rest * m.sum(0))
        return pd.DataFrame({"component": frame["component"].to_numpy(), "split": [names[s] for s in picked]})

    placed = light.withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards))).groupBy("shard").applyInPandas(
        place, "component binary, split string"
    )
    if fixed:
        placed = placed.unionByName(own.sparkSession.createDataFrame([(bytearray(k), v) for k, v in fixed.items()], "component binary, split string"))
    return own.join(placed, "component").select("tab", "row_id", F.lower(F.hex("component")).alias("component"), "split")


def share_report(assigned: DataFrame, records: DataFrame) -> DataFrame:
    """(label, split, n_records, n_components, share): what each label got."""
    wide = assigned.join(records.select("tab", "row_id", F.explode("labels").alias("label")), ["tab", "row_id"])
    counts = wide.groupBy("label", "split").agg(F.count("*").alias("n_records"), F.countDistinct("component").alias("n_components"))
    total = counts.groupBy("label").agg(F.sum("n_records").alias("t"))
    return counts.join(total, "label").select("label", "split", "n_records", "n_components", F.round(F.col("n_records") / F.col("t"), 6).alias("share"))
