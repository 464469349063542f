"""Token budget per source, language and domain.

The language of a text is learned, not read off its script: hashed trigrams of
UTF-8 bytes, counted by language over labelled documents, score each text
(naive Bayes). The labelled sample has a documented bound; every text is scored
whole.

Defined results: spellings of a state that differ in case, blanks or
punctuation are one; null or blank slices are ``unknown``; texts without letters,
or of under three bytes of them, are ``und``, as is every text where no language has a labelled document; null
and empty texts count as documents of no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

GRAMS = 1 << 16
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unknown")


def spelled(c: Column) -> Column:
    """One spelling of a name: lower case, words parted by one blank, ``unknown`` for none."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit("")), F.lit("unknown"))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed trigram of bytes, its text, whether each text has letters); runs of anything but letters and marks are one blank."""
    words = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), r"[^\p{L}\p{M}]+", " "))
    has = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    size = np.diff(offsets)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    g = data[:-2] + (data[1:-1] << np.uint32(8)) + (data[2:] << np.uint32(16))
    g = ((g * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    inside = text[:-2] == text[2:]
    return g[inside], text[:-2][inside], has


class Languages:
    """Log probabilities of trigrams by language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        c = counts + 0.1
        self.weight = np.log(c / c.sum(1, keepdims=True)).astype(np.float32) if names else counts

    def of(self, texts: pa.Array) -> list[str]:
        """Best language of each text; ``und`` without letters."""
        g, text, has = _grams(texts)
        if not self.names:
            return ["und"] * len(has)
        scores = np.stack([np.bincount(text, self.weight[i][g], minlength=len(has)) for i in range(len(self.names))])
        sure = has & (np.bincount(text, minlength=len(has)) > 0)
        return [self.names[i] if s else "und" for i, s in zip(scores.argmax(0), sure)]


def learn_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = 5_000, seed: int = 1) -> Languages:
    """Model from *documents* labelled documents (drawn by a hash of their keys, so about as many), or all of them if they are fewer."""
    labelled = docs.select(F.lower(F.trim(F.col(lang))).alias("l"), F.col(text).cast("string").alias("t"), F.xxhash64(F.lit(seed), key).alias("h"))
    labelled = labelled.where(F.col("l").isNotNull() & ~F.col("l").isin(*NO_LANGUAGE))
    share = min(1.0, documents / max(1, labelled.count()))
    rows = labelled.where(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32))).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            g, owner, _ = _grams(b.column(1))
            labels = np.array(b.column(0).to_pylist(), object)
            for name in set(labels):
                sums[name] = sums.get(name, 0) + np.bincount(g[(labels == name)[owner]], minlength=GRAMS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["l", "at", "n"])

    # as many rows as languages have trigram buckets
    got = rows.mapInArrow(count, "l string, at long, n long").groupBy("l", "at").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got["l"].to_pylist()))
    counts = np.zeros((len(names), GRAMS))
    if names:
        counts[np.searchsorted(names, got["l"].to_numpy(zero_copy_only=False).astype(str)), got["at"].to_numpy()] = got["n"].to_numpy()
    return Languages(names, counts)


def with_language(df: DataFrame, model: Languages, text: str = "text", out: str = "language") -> DataFrame:
    """Adds the language of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def language(t: pa.Array) -> pa.Array:
        return pa.array(shared.value.of(t), pa.string())

    return df.withColumn(out, language(F.col(text)))


def roll_up(counted: DataFrame, slices: list[str], tokens: str = "tokens", chars: str = "chars") -> DataFrame:
    """slices, n_docs, n_chars, n_tokens: totals of every slice."""
    return counted.groupBy(*slices).agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(chars), F.lit(0)).alias("n_chars"), F.coalesce(F.sum(tokens), F.lit(0)).alias("n_tokens"),
    )
