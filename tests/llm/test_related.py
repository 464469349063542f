"""Splits of related records, and overlaps across splits."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import overlap, splits
from corpusloom.operators import graph


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find([(a, b) for a, b in edges if a is not None and a != b])
    assert set(got) == set(want)
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in combinations(got, 2))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


SPLITS = [
    (1, "A-1", "x"), (2, " a1 ", None), (3, "B-2", "x"), (4, "C-3", "y"), (5, "c 3", "z"), (6, "D-4", "z"), (7, None, "w"), (8, "--", "w"), (9, "", None), (10, "E-5", "w"), (11, "E-5", "w"), (12, "A-11", None),
]


def records(spark, rows=SPLITS, qa=((1, "F-6", "w"), (2, None, None))):
    # an extra column with a clashing name must not matter
    s = spark.createDataFrame(rows, "row_id long, act_id string, source_id string").withColumns({"state": F.lit("s"), "act": F.lit("q"), "root": F.lit(1), "component": F.lit(2)})
    q = spark.createDataFrame(list(qa), "qa_id long, act_id string, source_id string").withColumn("labels", F.lit(0))
    return splits.related_records({"splits": (s, "row_id", {"state": F.col("state")}), "qa_v1": (q, "qa_id", {})})


def test_tied_acts(spark):
    got = {tuple(r) for r in splits.tied_acts(records(spark)).collect()}
    ties = [{"A-1", " a1 ", "B-2"}, {"C-3", "c 3", "D-4"}, {"E-5", "F-6"}]
    groups = {}
    for x in splits.act_groups(records(spark)).collect():
        groups.setdefault(bytes(x["root"]), set()).add(x["act_id"])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [*ties, {"A-11"}]))
    assert got == {tuple(sorted(p)) for t in ties for p in combinations(sorted(t), 2)}
    assert splits.tied_acts(records(spark, [(1, None, None)][:0], ())).count() == 0


def test_assignment_cuts_no_component(spark):
    r = random.Random(3)
    rows = [(i, f"A{r.randint(0, 300)}", f"s{r.randint(0, 900)}" if r.random() < 0.4 else None) for i in range(1500)] + [(2000 + i, "HOT", None) for i in range(700)]
    got = splits.assign(records(spark, rows), shard_components=200)
    assert got.count() == 2202 and got.select("tab", "row_id").distinct().count() == 2202
    assert got.groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {x[0]: x[1] / 2202 for x in got.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.9) < 0.03 and all(abs(share[s] - 0.05) < 0.03 for s in ("validation", "test"))
    assert splits.assign(records(spark, [], ())).count() == 0


def test_stratify_takes_rarest_label_first():
    counts = np.array([[1, 0, 1], [1, 0, 1], [0, 1, 1], [0, 1, 1]], float)
    placed = splits.stratify(counts, np.outer([0.5, 0.5], counts.sum(0)))
    assert sorted(placed[:2]) == [0, 1] and sorted(placed[2:]) == [0, 1]


def brute(rows, share=0.8):
    out = set()
    for (a, s, t), (b, u, v) in combinations(rows, 2):
        if None in (s, u, t, v) or (s == "train") == (u == "train") or not {s, u} <= {"train", "validation", "test"}:
            continue
        x, y = ([w for w in "".join(c if c.isalnum() else " " for c in z).lower().split()] for z in (t, v))
        if x and y:
            d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, p in enumerate(x):
                for j, q in enumerate(y):
                    d[i + 1][j + 1] = d[i][j] + 1 if p == q else max(d[i][j + 1], d[i + 1][j])
            if d[-1][-1] >= share * max(len(x), len(y)):
                out.add((min(a, b), max(a, b)))
    return out


def test_overlaps(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(40, 90))] for _ in range(12)]
    rows, i = [], 0
    for b in base:
        for k in range(5):
            w = list(b)
            for _ in range(r.randint(0, len(w) // 12) if k else 0):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w) if k % 2 else ", ".join(w).upper() + "!"
            rows.append((i, r.choice(["train", "train", "validation", "test"]), text))
            i += 1
    rows += [(900, "train", None), (901, "test", ""), (902, "test", "?!"), (903, None, rows[0][2]), (904, "other", rows[0][2]), (905, "train", "one"), (906, "test", "One."), (907, "train", "x " * 20000), (908, "test", "x " * 20000)]
    rows += [(1000 + k, "train", "same text for a hot class of copies") for k in range(60)] + [(1100, "test", "Same text, for a hot class of copies")]
    df = spark.createDataFrame(rows, "row_id long, split string, text string").withColumns({"cls": F.lit(1), "keys": F.lit(2)})
    got = [(x["row_id_a"], x["row_id_b"]) for x in overlap.overlaps(df).collect()]
    want = brute([x for x in rows if x[0] < 907 or x[0] > 999]) | {(907, 908)}
    assert len(got) == len(set(got)) and set(got) <= want
    assert set(got) == want and len(want) > 100
    # elements of many pairs are parted, and the pairs are the same
    assert {(x["row_id_a"], x["row_id_b"]) for x in overlap.overlaps(df, block_pairs=3).collect()} == want
    # links of rows are those of the pairs
    linked = {x["row_id"]: x["n_links"] for x in overlap.links(df).collect()}
    assert linked == {i: sum(i in p for p in want) for i in linked} and {i for p in want for i in p} <= set(linked) and not {900, 901, 902, 903} & set(linked)
    # counts of classes are those of the pairs
    of = {x[0]: x[1] for x in rows}
    named = df.withColumn("source_publisher", F.when(F.col("row_id") % 3 > 0, F.concat(F.lit("s"), (F.col("row_id") % 3).cast("string"))))
    counts = {}
    for a, b in want:
        e, t = (a, b) if of[a] != "train" else (b, a)
        c = counts.setdefault((of[e], f"s{e % 3}" if e % 3 else "unknown"), (set(), set(), set()))
        c[0].add((a, b)), c[1].add(e), c[2].add(t)
    assert {(x["split"], x["source"]): (x["n_pairs"], x["n_held"], x["n_train"]) for x in overlap.report(named).collect()} == {k: tuple(map(len, v)) for k, v in counts.items()}
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_overlaps_of_scattered_edits(spark):
    # words replaced at random places down to the least share: every pair is found
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows, want = [], set()
    for share in (0.8, 0.85, 0.9):
        for _ in range(12):
            n = r.choice([40, 100, 200])
            a = [r.choice(vocab) for _ in range(n)]
            b = list(a)
            for at in r.sample(range(n), round(n * (1 - share))):
                b[at] = f"e{r.randrange(10**9)}"
            want.add((len(rows), len(rows) + 1))
            rows += [(len(rows), "train", " ".join(a)), (len(rows) + 1, "test", " ".join(b))]
    rows += [(len(rows), "train", " ".join(f"v{i}" for i in range(100))), (len(rows) + 1, "validation", " ".join(f"v{i}" if i % 5 or i == 0 else "other" for i in range(98)))]
    got = {(x["row_id_a"], x["row_id_b"]) for x in overlap.overlaps(spark.createDataFrame(rows, "row_id long, split string, text string")).collect()}
    assert got == brute(rows) and want <= got and len(want) == 36


def test_common_in_order():
    assert overlap.common_in_order("a b c d".split(), "b a c x d".split()) == 3
    assert overlap.near_same("a b c d e", "a b c d x") is not None and overlap.near_same("a b c d e", "a b c x y") is None


@pytest.mark.parametrize("share", [0.92, 0.9, 0.88, 0.85, 0.82, 0.8])
def test_signatures_miss_no_pair(share):
    # of 300 pairs each, with words replaced at random places: an element in common to join on, and bits within the bound
    r = random.Random(int(share * 100))
    vocab = [f"w{i}" for i in range(2000)]
    a = [[r.choice(vocab) for _ in range(r.randint(40, 300))] for _ in range(300)]
    b = []
    for words in a:
        w = list(words)
        for at in r.sample(range(len(w)), int(len(w) * (1 - share) + 1e-9)):
            w[at] = r.choice(vocab)
        b.append(w)
    cost = np.random.default_rng(1).integers(1, 1000, overlap.BUCKETS).astype(np.float32)
    signer = overlap.Signer(cost)
    size, ((keys, n), *_), lanes = signer.sign([" ".join(w) for w in a + b])
    own = [set(x) for x in np.split(keys, np.cumsum(n)[:-1])]
    for i in range(300):
        assert overlap.near_same(" ".join(a[i]), " ".join(b[i])) is not None and own[i] & own[300 + i]
        apart = sum(int(x).bit_count() for x in (lanes[i] ^ lanes[300 + i]).view(np.uint64))
        assert apart <= size[i] + size[300 + i] - 2 * overlap.needed(max(size[i], size[300 + i]), 0.8)


def test_lookup(spark):
    from corpusloom.llm.skew import lookup

    rows = spark.createDataFrame([(i, b"hot" if i % 3 == 0 else None if i % 3 == 1 else bytes([i % 50])) for i in range(600)], "i long, k binary")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = {x["i"]: x["least"] for x in lookup(rows, table, "k", "n", 600, parts=10).collect()}
    want = {}
    for x in rows.collect():
        want[x["i"]] = None if x["k"] is None else min(y for y in range(600) if (b"hot" if y % 3 == 0 else None if y % 3 == 1 else bytes([y % 50])) == bytes(x["k"]))
    assert got == want and lookup(rows.limit(0), table, "k", "n", 0).count() == 0


def test_assignment_keeps_label_shares(spark):
    r = random.Random(9)
    rows = [(i, f"A{r.randint(0, 2500)}", None) for i in range(12_000)]
    s = spark.createDataFrame(rows, "row_id long, act_id string, source_id string").withColumn("state", F.concat(F.lit("s"), (F.col("row_id") % 7).cast("string")))
    records = splits.related_records({"splits": (s, "row_id", {"state": F.col("state")})})
    got = splits.share_report(splits.assign(records), records).collect()
    for x in got:
        want = {"train": 0.9, "validation": 0.05, "test": 0.05}[x["split"]]
        assert abs(x["share"] - want) < (0.01 if x["label"] == "splits" else 0.025), x
    assert len({x["label"] for x in got}) == 8 and len(got) == 24
