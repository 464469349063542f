"""Same or near-same records across splits.

Two texts are near-same if at least ``share`` of the words of the longer stand
in the other in the same order, letter case and punctuation aside. The search
is exact: words are numbered by their occurrence in the text, and of two texts
that hold ``need`` of these elements in common, the first ``size - need + 1`` of
each, in any order that is the same for all texts, have one in common.

1. Counts of elements by hashed bucket, all of the evaluation rows and every
   eighth of the training rows, give that order: elements come first that would
   make the fewest pairs. An element of no evaluation row joins nothing.
2. One pass makes a digest of the words, the elements to join on, and 512 bits
   of parity over all elements of every row.
3. Rows of equal words form a class; only representatives go on, so a hot group
   of copies costs one row.
4. Train and evaluation representatives meet on elements; an element of more
   than ``block_pairs`` pairs is parted into as many keys as keep each under
   that (a training row goes under one of them, an evaluation row under all).
   Lengths and the number of different bits rule out pairs in the join, the
   others are kept once.
5. Texts of candidates are joined; the bag of words and the shingles that the
   share leaves whole must agree, then the words' longest common subsequence
   decides.
6. Class pairs are expanded by membership, train against evaluation rows.

Defined results: null and wordless texts pair with nothing, nor do rows of an
unknown split; equal texts of both splits always pair; repeated rows pair each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .skew import lookup

SHINGLE, BUCKETS, LANES, SAMPLED = 3, 1 << 18, 8, 8


def norm_words(texts: pa.Array) -> pa.Array:
    """Words of letters, marks and digits in lower case, parted by one blank."""
    return pc.utf8_trim(pc.utf8_lower(pc.utf8_upper(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\p{L}\p{M}\p{N}]+", " "))), " ")


def needed(longer: int, share: float) -> int:
    """Words in common that the share asks of the longer text."""
    return math.ceil(longer * share)


class Signer:
    """Elements of texts, (word, its how-manieth in the text) as a hash, and what is derived of them."""

    def __init__(self, cost: np.ndarray | None = None, share: float = 0.8, keep: int = 300_000, block_pairs: int = 4_000_000):
        self.cost, self.share, self.keep, self.block_pairs = cost, share, keep, block_pairs
        self.word: dict[str, int] = {}

    def _hash(self, w: str) -> int:
        h = self.word.get(w)
        if h is None:
            if len(self.word) > self.keep:
                self.word.clear()
            h = self.word[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return h

    def elements(self, norms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(element, its text, words of each text); the elements of a text lie together. Every text has a word."""
        words = [n.split(" ") for n in norms]
        size = np.array([len(w) for w in words])
        h = np.fromiter((self._hash(w) for t in words for w in t), np.uint64, int(size.sum()))
        text = np.repeat(np.arange(len(norms)), size)
        h = h[np.lexsort((h, text))]
        at = np.arange(len(h))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
        s = h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        s = (s ^ (s >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return s ^ (s >> np.uint64(29)), text, size

    def sign(self, norms: list[str]) -> tuple[np.ndarray, tuple[tuple[np.ndarray, np.ndarray], ...], np.ndarray]:
        """(words by text, (elements to join on, number of them by text) of both sides, of training rows and of evaluation rows, [text, lane] parity bits)."""
        e, text, size = self.elements(norms)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        bit = e >> np.uint64(58 - (LANES - 1).bit_length())
        one = np.uint64(1) << (bit & np.uint64(63))
        lanes = np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == lane, one, np.uint64(0)), start) for lane in range(LANES)], 1)
        cost = self.cost[(e % np.uint64(BUCKETS)).astype(np.int64)]
        order = np.lexsort((e, cost, text))
        first = size - np.array([needed(int(n), self.share) for n in size]) + 1
        kept = order[(np.arange(len(e)) - start[text] < first[text]) & (cost[order] > 0)]
        keys, of, parts = e[kept], text[kept], np.ceil(cost[kept] / self.block_pairs).astype(np.int64)
        hot = parts > 1
        plain = (keys[~hot].view(np.int64), np.bincount(of[~hot], minlength=len(norms)))
        own = lanes[of[hot], 0]  # any hash of the text
        trained = (_part(keys[hot], own % parts[hot].astype(np.uint64)), np.bincount(of[hot], minlength=len(norms)))
        each = np.repeat(np.arange(hot.sum()), parts[hot])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot])
        evaluated = (_part(keys[hot][each], nth.astype(np.uint64)), np.bincount(of[hot][each], minlength=len(norms)))
        return size, (plain, trained, evaluated), lanes.view(np.int64)


def _part(keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Keys of the *nth* parts of elements."""
    k = (keys + (nth + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (k ^ (k >> np.uint64(31))).view(np.int64)


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def jaccard(a: list[str], b: list[str], shingle: int = SHINGLE) -> tuple[float, int, int]:
    """(similarity of the sets of shingles, common ones, size of the smaller set)."""
    x = {tuple(a[i : i + shingle]) for i in range(max(1, len(a) - shingle + 1))}
    y = {tuple(b[i : i + shingle]) for i in range(max(1, len(b) - shingle + 1))}
    n = len(x & y)
    return n / (len(x) + len(y) - n), n, min(len(x), len(y))


def near_same(a: str, b: str, share: float = 0.8, shingle: int = SHINGLE) -> tuple[float, float] | None:
    """(Jaccard similarity, share of words in order) of two word strings if near-same."""
    x, y = a.split(" "), b.split(" ")
    longer, shorter = max(len(x), len(y)), min(len(x), len(y))
    need = needed(longer, share)
    if shorter < need:
        return None
    counts: dict[str, int] = {}
    for w in x:
        counts[w] = counts.get(w, 0) + 1
    bag = 0
    for w in y:
        if counts.get(w, 0) > 0:
            counts[w] -= 1
            bag += 1
    if bag < need:
        return None
    # Of k-word shingles, a lost word breaks at most k of its own text's and k - 1 of the other's, where it stands between two kept words.
    j, common, most = jaccard(x, y, shingle)
    if common < most - (2 * shingle - 1) * (longer - need):
        return None
    n = common_in_order(x, y)
    return (j, n / longer) if n >= need else None


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows by the thousand whose texts have words, and the texts' words."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            norms = norm_words(part.column(column))
            has = pc.greater(pc.binary_length(norms), 0)
            if pc.any(has).as_py():
                yield part.filter(has), norms.filter(has).to_pylist()


def element_costs(rows: DataFrame) -> np.ndarray:
    """Pairs that joining on an element may make, by bucket; 0 only where no evaluation row holds one."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, n = Signer(), np.zeros(2 * BUCKETS, np.int64)
        for part, norms in _parts(batches, 1):
            e, text, _ = signer.elements(norms)
            train = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            n += np.bincount((e % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS * train[text], minlength=2 * BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["at", "n"])

    some = rows.where(~F.col("train") | (F.pmod(F.xxhash64("row_id"), F.lit(SAMPLED)) == 0)).select("train", "t")
    got = some.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(2 * BUCKETS)
    n[got["at"].to_numpy()] = got["n"].to_numpy()
    return (n[:BUCKETS] * (SAMPLED * n[BUCKETS:] + 1)).astype(np.float32)


def near_classes(df: DataFrame, key: str = "row_id", split: str = "split", text: str = "text", train: tuple[str, ...] = ("train",), held: tuple[str, ...] = ("validation", "test"),
                 share: float = 0.8, source: str | None = None, block_pairs: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(near, members): near(x, y, jaccard, in_order) of near-same classes with a train and a held-out row, x <= y; members(row_id, train, split, source, cls)."""
    of_source = F.coalesce(F.col(source).cast("string"), F.lit("unknown")) if source else F.lit(None).cast("string")
    rows = df.select(F.col(key).cast("long").alias("row_id"), F.col(split).isin(*train).alias("train"), F.col(text).cast("string").alias("t"),
                     F.col(split).alias("split"), of_source.alias("source")).where(F.col(split).isin(*train, *held) & F.col("row_id").isNotNull() & F.col("t").isNotNull())
    cost = rows.sparkSession.sparkContext.broadcast(element_costs(rows))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(cost.value, share, block_pairs=block_pairs)
        for part, norms in _parts(batches, 2):
            size, sides, lanes = signer.sign(norms)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), part.column(3), part.column(4),
                pa.array([hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest() for t in norms], pa.binary()), pa.array(size, pa.int32()),
                *(pa.array(lanes[:, i]) for i in range(LANES)), *(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(keys)) for keys, n in sides),
            ], names=["row_id", "train", "split", "source", "digest", "n", *bits, "keys", "train_keys", "held_keys"])

    bits = [f"b{i}" for i in range(LANES)]
    signed = written(rows.mapInArrow(sign, f"row_id long, train boolean, split string, source string, digest binary, n int, {', '.join(f'{c} long' for c in bits)}, "
                                           "keys array<long>, train_keys array<long>, held_keys array<long>"), "p5-signed")
    classes = signed.groupBy("digest").agg(F.min("row_id").alias("cls"), F.max("train").alias("has_train"), F.min("train").alias("only_train"), F.count("*").alias("size"))
    slim = signed.select("row_id", "train", "split", "source", "digest")
    members = written(lookup(slim, classes, "digest", "size", slim.count()).select("row_id", "train", "split", "source", "cls", "has_train", "only_train"), "p5-members")
    # representatives only: rows of a class but its first are few, or the join shuffles by row
    copies = members.where("row_id <> cls").select("row_id")
    flags = members.where("row_id = cls and has_train and not only_train").select("row_id", F.lit(True).alias("both"))
    reps = signed.join(copies, "row_id", "left_anti").join(flags, "row_id", "left").select(
        F.col("row_id").alias("cls"), (F.col("train") | F.col("both").isNotNull()).alias("has_train"), (F.col("train") & F.col("both").isNull()).alias("only_train"),
        "n", *bits, "keys", "train_keys", "held_keys",
    )
    of = lambda side: [F.col("cls").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", *bits))]
    trained = reps.where("has_train").select(F.explode(F.concat("keys", "train_keys")).alias("k"), *of("x"))
    evaluated = reps.where("not only_train").select(F.explode(F.concat("keys", "held_keys")).alias("k"), *of("y"))
    need = F.ceil(F.greatest("x_n", "y_n") * F.lit(share))
    apart = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in bits[1:]), F.bit_count(F.col(f"x_{bits[0]}").bitwiseXOR(F.col(f"y_{bits[0]}"))))
    may = (F.least("x_n", "y_n") >= need) & (apart <= F.col("x_n") + F.col("y_n") - 2 * need)
    pairs = trained.join(evaluated, (trained["k"] == evaluated["k"]) & (F.col("x") != F.col("y")) & may).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = written(pairs, "p5-candidates")
    wanted = pairs.select(F.col("x").alias("row_id")).union(pairs.select("y")).distinct()
    texts = rows.select("row_id", "t").join(wanted, "row_id", "left_semi").dropDuplicates(["row_id"])
    texts = written(texts.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), norm_words(b.column(1))], names=["row_id", "t"]) for b in bs), "row_id long, t string"), "p5-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(x, y, *m) for x, y, s, t in zip(*(c.to_pylist() for c in b.columns)) if (m := near_same(s, t, share))]
            x, y, j, n = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(j, pa.float64()), pa.array(n, pa.float64())], names=["x", "y", "jaccard", "in_order"])

    near = (
        pairs.join(texts.select(F.col("row_id").alias("x"), F.col("t").alias("s")), "x").join(texts.select(F.col("row_id").alias("y"), "t"), "y")
        .select("x", "y", "s", "t").mapInArrow(verify, "x long, y long, jaccard double, in_order double")
    )
    both = members.where("row_id = cls and has_train and not only_train").select("cls").distinct()
    return written(near.union(both.select("cls", "cls", F.lit(1.0), F.lit(1.0))), "p5-near"), members.drop("has_train", "only_train")


def overlaps(df: DataFrame, **options) -> DataFrame:
    """(row_id_a, row_id_b, train_id, held_id, jaccard, in_order): every near-same pair of a train and a held-out row; *options* as of :func:`near_classes`."""
    near, members = near_classes(df, **options)
    sides = near.union(near.where("x <> y").select("y", "x", "jaccard", "in_order"))
    t = members.where("train").select(F.col("cls").alias("x"), F.col("row_id").alias("train_id"))
    e = members.where("not train").select(F.col("cls").alias("y"), F.col("row_id").alias("held_id"))
    return sides.join(t, "x").join(e, "y").select(
        F.least("train_id", "held_id").alias("row_id_a"), F.greatest("train_id", "held_id").alias("row_id_b"), "train_id", "held_id",
        F.round("jaccard", 6).alias("jaccard"), F.round("in_order", 6).alias("in_order"),
    )


def links(df: DataFrame, **options) -> DataFrame:
    """(row_id, cls, n_links): a row for each row with words, its class of equal words, and how many rows of the other side are near-same. Sizes of classes are summed, copies are not expanded."""
    near, members = near_classes(df, **options)
    sides = near.select("x", "y").union(near.where("x <> y").select("y", "x"))
    sizes = written(members.groupBy("cls", "train").agg(F.count("*").alias("n")), "p5-sizes")
    # partners of a class on either side; a class is its own partner where both sides hold it
    per = sides.join(sizes.select(F.col("cls").alias("y"), F.col("train").alias("other"), "n"), "y").groupBy(F.col("x").alias("cls"), (~F.col("other")).alias("train")).agg(F.sum("n").alias("n_links"))
    # a class may hold a third of all rows
    side = F.struct("cls", "train").alias("side")
    table = per.join(sizes, ["cls", "train"]).select(side, "n_links", "n")
    got = lookup(members.select("row_id", "cls", side), table, "side", "n", members.count())
    return got.select("row_id", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def report(df: DataFrame, source: str = "source_publisher", **options) -> DataFrame:
    """(split, source, n_pairs, n_held, n_train): confirmed pairs by the held-out row's split and source. Classes are counted and their sizes multiplied, so copies cost nothing."""
    near, members = near_classes(df, source=source, **options)
    sides = near.select("x", "y").union(near.where("x <> y").select("y", "x"))
    trained = members.where("train").groupBy(F.col("cls").alias("x")).agg(F.count("*").alias("n_x"))
    held = members.where("not train").groupBy(F.col("cls").alias("y"), "split", "source").agg(F.count("*").alias("n_y"))
    links = written(sides.join(trained, "x").join(held, "y"), "p5-links")
    each = links.groupBy("split", "source", "y").agg(F.sum(F.col("n_x") * F.col("n_y")).alias("pairs"), F.max("n_y").alias("n_y"))
    counted = each.groupBy("split", "source").agg(F.sum("pairs").alias("n_pairs"), F.sum("n_y").alias("n_held"))
    partners = links.select("split", "source", "x", "n_x").distinct().groupBy("split", "source").agg(F.sum("n_x").alias("n_train"))
    return counted.join(partners, ["split", "source"])
