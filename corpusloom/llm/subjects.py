"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs.

Training runs on a bounded, hash-ordered sample of labelled documents
(``max_labelled``, the one bound) whose features are written once in shards.
Every step broadcasts the parameters, each shard returns the gradient of its
own features, and the summed gradient moves the parameters by Adam. The first
stage fits whole documents; the next two fit sentences, whose targets are the
document's own labels where the model of the stage before sees them.

Scoring covers every document: a sentence's outputs are those of its mean
embedding, and a document has the areas that hold at least ``share`` of what
its sentences are about. It is one pass without a shuffle.

Defined results: null, empty and blank texts, and texts of merely formal
content, have no area; the label ``none`` is a document without an area; labels
of unknown documents or areas are ignored; repeated labels count once; without
labels nothing is assigned.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written

#: A word is a run free of white space, digits and punctuation; a sentence ends at one of the marks.
_TOKEN = re.compile(r"[^\s\d.,;:!?()|\[\]{}<>\"“”‘’/–—।॥_-]+|[.;।॥!?\n]")
_ENDS = frozenset(".;।॥!?\n")
BUCKETS = 1 << 16
GRAMS = (4, 5)
#: Where a document's sentences show less of all areas together, shares are of this much; formal texts so get none.
LEAST_TOPICAL = 0.25


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its character n-grams."""
    marked = f"<{word}>"
    return [zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS] + [
        BUCKETS + zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)
    ]


def tokens(texts: list[str | None], word_id: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word id, sentence, document) of every word; sentences are numbered through. word_id grows by new words."""
    ids: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            found = [-1 if t in _ENDS else word_id.setdefault(t, len(word_id)) for t in _TOKEN.findall(text.lower())]
            found.append(-1)
            ids += found
            sizes[k] = len(found)
    at = np.array(ids, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    sentence = np.cumsum(at < 0)
    real = at >= 0
    _, sentence = np.unique(sentence[real], return_inverse=True)
    return at[real], sentence, doc[real]


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(raw)))


def _sum_rows(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; group is sorted and holds every number under n."""
    if not len(rows):
        return np.zeros((n, rows.shape[1]), rows.dtype)
    return np.add.reduceat(rows, np.searchsorted(group, np.arange(n)), axis=0)


def build_shard(texts: list[str], targets: np.ndarray) -> dict[str, np.ndarray]:
    """Features of labelled documents."""
    word_id: dict[str, int] = {}
    word, sentence, doc = tokens(texts, word_id)
    n = int(sentence[-1]) + 1 if len(sentence) else 0
    # one entry per different word of a sentence
    key, count = np.unique(sentence * max(1, len(word_id)) + word, return_counts=True)
    word, own = key % max(1, len(word_id)), key // max(1, len(word_id))
    size = np.bincount(own, weights=count, minlength=n)
    features = [word_features(w) for w in word_id]
    parts = np.array([len(f) for f in features], np.int64)
    used, index = np.unique(np.concatenate([np.array(f, np.int64) for f in features]) if features else np.zeros(0, np.int64), return_inverse=True)
    owner = np.zeros(n, np.int64)
    owner[sentence] = doc
    docs, owner = np.unique(owner, return_inverse=True)
    return {
        "word": word, "sentence": own, "weight": (count / size[own]).astype(np.float32), "size": size.astype(np.float32), "owner": owner,
        "labels": targets[docs].astype(np.float32), "targets": np.zeros((0, targets.shape[1]), np.float32),
        "used": used, "index": index, "part": np.repeat(np.arange(len(features)), parts), "inverse": (1 / parts).astype(np.float32),
    }


@dataclass
class Parameters:
    features: np.ndarray  # sorted feature numbers
    E: np.ndarray
    V: np.ndarray
    b: np.ndarray


def _forward(s: dict[str, np.ndarray], p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word vectors, sentence means, sentence probabilities)."""
    local = p.E[np.searchsorted(p.features, s["used"])]
    words = _sum_rows(local[s["index"]], s["part"], len(s["inverse"])) * s["inverse"][:, None]
    mean = _sum_rows(words[s["word"]] * s["weight"][:, None], s["sentence"], len(s["size"]))
    return words, mean, 1 / (1 + np.exp(-np.clip(mean @ p.V + p.b, -30, 30)))


def gradient(s: dict[str, np.ndarray], p: Parameters) -> dict[str, np.ndarray]:
    """Summed gradient of a shard: of sentences if it has targets, else of documents."""
    _, mean, prob = _forward(s, p)
    if len(s["targets"]):
        g, h = prob - s["targets"], mean
        per = g
        weight = s["weight"]
    else:
        n = len(s["labels"])
        total = np.bincount(s["owner"], weights=s["size"], minlength=n)
        share = (s["size"] / total[s["owner"]]).astype(np.float32)
        h = _sum_rows(mean * share[:, None], s["owner"], n)
        g = 1 / (1 + np.exp(-np.clip(h @ p.V + p.b, -30, 30))) - s["labels"]
        per = g[s["owner"]]
        weight = s["weight"] * share[s["sentence"]]
    back = (per @ p.V.T).astype(np.float32)
    order = np.argsort(s["word"], kind="stable")
    of_word = _sum_rows(back[s["sentence"][order]] * weight[order][:, None], s["word"][order], len(s["inverse"])) * s["inverse"][:, None]
    order = np.argsort(s["index"], kind="stable")
    return {"E": _sum_rows(of_word[s["part"][order]], s["index"][order], len(s["used"])), "V": h.T @ g, "b": g.sum(0), "n": np.array([len(g)])}


def sentence_targets(s: dict[str, np.ndarray], p: Parameters) -> np.ndarray:
    """A document's label holds for those of its sentences that show it at least half as much as the one that shows it most."""
    t = _forward(s, p)[2] * s["labels"][s["owner"]]
    best = np.zeros_like(s["labels"])
    np.maximum.at(best, s["owner"], t)
    return ((t > 0.5 * best[s["owner"]]) & (t > 0)).astype(np.float32)


def _map_shards(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([f(_unpack(raw))], pa.binary())], names=["no", "raw"])

    return run


def fit(docs: DataFrame, labels: DataFrame, areas: list[str], key: str = "doc_id", text: str = "text", max_labelled: int = 3000, shards: int = 6,
        dim: int = 16, steps: tuple[int, ...] = (30, 25, 25), rate: float = 0.1, seed: int = 1) -> Parameters | None:
    """Train on at most *max_labelled* labelled documents; None without any."""
    spark = docs.sparkSession
    own = labels.select(F.col(key).alias("k"), F.col("subject").cast("string").alias("s")).where("k is not null").where(F.col("s").isin([*areas, "none"]))
    own = own.groupBy("k").agg(F.collect_set("s").alias("s")).orderBy(F.xxhash64(F.lit(seed), "k"), "k").limit(max_labelled)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(own, "k").where("length(t) > 0")
    width = len(areas)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, rows_of, no = [], [], 0
        for b in batches:
            for n, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                no = n
                texts.append(t)
                rows_of.append([float(a in s) for a in areas])
        if texts:
            shard = build_shard(texts, np.array(rows_of).reshape(-1, width))
            if len(shard["word"]):
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([_pack(**shard)], pa.binary())], names=["no", "raw"])

    schema = "no int, raw binary"
    numbered = rows.select(F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("no"), "t", "s").repartition(shards, "no")
    table = written(numbered.mapInArrow(build, schema), "p9-shards")
    used = [np.frombuffer(bytes(r[1]), np.int64) for r in table.mapInArrow(_map_shards(lambda s: s["used"].astype(np.int64).tobytes()), schema).collect()]
    if not used:
        return None
    features = np.unique(np.concatenate(used))
    rng = np.random.default_rng(seed)
    p = Parameters(features, np.zeros((0, dim)), np.zeros(0), np.zeros(0))
    for stage, count in enumerate(steps):
        if stage:
            shared = spark.sparkContext.broadcast(p)
            table = written(table.mapInArrow(_map_shards(lambda s, shared=shared: _pack(**(s | {"targets": sentence_targets(s, shared.value)}))), schema), "p9-targets")
        rng = np.random.default_rng(seed)
        p = Parameters(features, rng.normal(0, 1 / dim, (len(features), dim)).astype(np.float32),
                       rng.normal(0, 0.3, (dim, width)).astype(np.float32), np.full(width, -2.0, np.float32))
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (p.E, p.V, p.b)]
        for step in range(1, count + 1):
            shared = spark.sparkContext.broadcast(p)
            # each shard's gradient: its feature numbers, then the sums
            answer = table.mapInArrow(_map_shards(lambda s, shared=shared: _pack(used=s["used"], **gradient(s, shared.value))), schema).collect()
            sums = [np.zeros_like(p.E), np.zeros_like(p.V), np.zeros_like(p.b)]
            n = 0
            for r in sorted(answer, key=lambda r: r["no"]):
                g = _unpack(bytes(r["raw"]))
                sums[0][np.searchsorted(features, g["used"])] += g["E"]
                sums[1] += g["V"]
                sums[2] += g["b"]
                n += int(g["n"][0])
            moved = []
            for x, gx, mv in zip((p.E, p.V, p.b), sums, moments):
                gx = gx * (10 / max(1, n))
                mv[0] = 0.9 * mv[0] + 0.1 * gx
                mv[1] = 0.99 * mv[1] + 0.01 * gx * gx
                moved.append((x - rate * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
            p = Parameters(features, *moved)
            shared.unpersist()
    return p


class Scorer:
    """Area shares of texts; remembers the outputs of words."""

    def __init__(self, p: Parameters, keep: int = 300_000):
        self.at = {int(f): i for i, f in enumerate(p.features)}
        self.out, self.b, self.keep = (p.E @ p.V).astype(np.float32), p.b, keep
        self.word_id: dict[str, int] = {}
        self.rows, self.filled = np.zeros((1024, len(p.b)), np.float32), 0

    def shares(self, texts: list[str | None]) -> np.ndarray:
        width = len(self.b)
        if len(self.word_id) > self.keep:
            self.word_id, self.filled = {}, 0
        word, sentence, doc = tokens(texts, self.word_id)
        if len(self.word_id) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((2 * len(self.word_id) - len(self.rows), width), np.float32)])
        for w in islice(self.word_id, self.filled, None):
            f = word_features(w)
            hit = [self.at[x] for x in f if x in self.at]
            self.rows[self.filled] = self.out[hit].sum(0) / len(f) if hit else 0.0
            self.filled += 1
        if not len(word):
            return np.zeros((len(texts), width))
        n = int(sentence[-1]) + 1
        sums = _sum_rows(self.rows[word], sentence, n)
        prob = 1 / (1 + np.exp(-np.clip(sums / np.bincount(sentence, minlength=n)[:, None] + self.b, -30, 30)))
        owner = np.zeros(n, np.int64)
        owner[sentence] = doc
        total = np.zeros((len(texts), width))
        np.add.at(total, owner, prob)
        per = total / np.maximum(1, np.bincount(owner, minlength=len(texts)))[:, None]
        return per / np.maximum(per.sum(1, keepdims=True), LEAST_TOPICAL)


def assign(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.25, **training) -> DataFrame:
    """(key, subject, share) of every area of every document."""
    areas = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, subject string, share double"
    p = fit(docs, labels, areas, key, text, **training)
    if p is None or not areas:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                got = scorer.shares(part.column(1).to_pylist())
                row, area = np.nonzero(got >= share)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row)), pa.array([areas[a] for a in area], pa.string()), pa.array(np.round(got[row, area], 6)),
                ], names=[key, "subject", "share"])

    return docs.select(key, F.col(text).cast("string").alias("t")).mapInArrow(run, schema)
