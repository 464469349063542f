"""Encoding with an installed tokenizer model; the model file's path is a parameter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def sentencepiece_encoder(path: str = DEFAULT_MODEL) -> Callable[[], Callable[[list[str]], list[list[int]]]]:
    """Loader of an encoder, for :func:`corpusloom.operators.qa.encoder_udf`."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)

    return load


def sentencepiece_codec(path: str = DEFAULT_MODEL):
    """Loader of (encode, decode)."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), (lambda ids: model.decode(ids, num_threads=1))

    return load


def word_encoder():
    """An encoder without a model: a word's id is its length."""
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def character_codec():
    """A codec without a model: ids are code points."""
    return (lambda texts: [[ord(c) for c in t] for t in texts]), (lambda ids: ["".join(map(chr, x)) for x in ids])


def encoded_records(df: DataFrame, load, keep: list[str], jurisdiction: str = "jurisdiction", state: str = "state", text: str = "text") -> DataFrame:
    """keep, jurisdiction, tokens of every row with text; an empty jurisdiction is the state."""
    from .qa import encoder_udf

    x = df.withColumn("__t", T.strip(F.coalesce(text, F.lit("")))).where("__t <> ''")
    return x.select(*keep, F.coalesce(F.nullif(F.col(jurisdiction), F.lit("")), F.col(state)).alias("jurisdiction"), encoder_udf(load)(F.col("__t")).alias("tokens"))
