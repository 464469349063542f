"""Retrieval: a postings index of tf-idf weights, boosted top-k search for batches of queries, evaluation."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.numbers import let
from ..session import written

# Concepts with their phrases, terms and sections.
CONCEPTS = (
    ("valid_contract",
     ("valid contract", "essentials of a valid contract", "requirements of a contract", "makes an agreement a contract", "agreement a contract", "agreement is a contract"),
     ("valid", "contract", "agreement", "enforceable", "consideration", "competent", "consent", "free consent", "lawful consideration", "lawful object"),
     ("10",)),
    ("lawful_consideration",
     ("lawful consideration", "lawful object", "considerations and objects are lawful", "consideration and object"),
     ("consideration", "object", "lawful", "unlawful", "forbidden", "defeat", "fraud", "injury"),
     ("23",)),
    ("without_consideration",
     ("without consideration", "agreement without consideration", "agreement made without consideration"),
     ("consideration", "writing", "registered", "natural love", "affection", "compensation", "promise", "debt"),
     ("25",)),
    ("free_consent",
     ("free consent", "what is free consent", "meaning of free consent", "consent freely", "consent freely given"),
     ("consent", "free consent", "coercion", "undue influence", "fraud", "misrepresentation", "mistake"),
     ("13", "14")),
)
# The statutory phrases that dominate, and the boosts.
STATUTORY = ("agreement without consideration", "agreement made without consideration")
BOOST = {"text": 0.20, "title": 0.25, "section": 0.60, "term": 0.015, "terms": 0.12, "phrase": 0.45, "phrases": 0.90, "statutory": 1.50, "13": 0.20, "14": 0.30}
TOP_K = 5


def concept_table(spark: SparkSession, concepts: tuple = CONCEPTS) -> DataFrame:
    """Concepts as a relation: name, phrases, terms, sections. A configuration of a few rows."""
    return spark.createDataFrame([(n, list(p), list(t), list(s)) for n, p, t, s in concepts], "name string, phrases array<string>, terms array<string>, sections array<string>")


def detected(queries: DataFrame, concepts: DataFrame, query: str = "query") -> DataFrame:
    """Queries with each concept one of whose phrases they contain."""
    q = T.collapse(F.lower(F.col(query)))
    return queries.withColumn("__q", q).join(F.broadcast(concepts), F.exists("phrases", lambda p: F.contains(F.col("__q"), p))).drop("__q")


def counted_terms(t: Column) -> Column:
    """Array of (term, tf) of an array of terms: sorted, then the lengths of the runs. Nothing leaves the row."""
    starts = lambda x: F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | (F.get(x, i - 1) != F.get(x, i - 2)))
    runs = lambda x, s: F.transform(s, lambda i, k: F.struct(F.get(x, i - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(x) + 1) - i).alias("tf")))
    none = F.array().cast("array<struct<term: string, tf: int>>")
    return F.when(F.size(t) > 0, let(F.array_sort(t), lambda x: let(starts(x), lambda s: runs(x, s)))).otherwise(none)


def term_counts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, total, tf): terms of each text, with the number of all its terms."""
    x = df.select(F.col(key), T.terms(text).alias("t")).select(key, F.size("t").alias("total"), counted_terms(F.col("t")).alias("c"))
    # a plain explode infers a filter on the size, for which all of the above runs once more
    return x.select(key, "total", F.explode_outer("c").alias("c")).where("c is not null").select(key, "c.term", "total", F.col("c.tf").cast("long").alias("tf"))


def idf(counts: DataFrame, key: str, documents: int) -> DataFrame:
    """(term, df, idf): ln((1 + N) / (1 + df)) + 1."""
    return counts.groupBy("term").agg(F.count(key).alias("df")).withColumn("idf", F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)


@dataclass
class Index:
    """counts(key, term, total, tf), norms(key, norm), idf(term, df, idf). A text's weight of a term is tf / total * idf."""

    key: str
    counts: DataFrame
    norms: DataFrame
    idf: DataFrame


def build_index(df: DataFrame, key: str, text: Column) -> Index:
    """Index of texts; N counts all of them, empty ones too. Terms are counted once and written; only norms need the weights of all terms, which meet the counts by a salted join: a term may stand in every text."""
    counts = written(term_counts(df, key, text), "index-terms")
    weights = written(idf(counts, key, df.count()), "index-idf")
    weight = F.col("tf") / F.col("total") * F.col("idf")
    norms = spread_join(counts, weights, "term", "df").groupBy(key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    return Index(key, counts, written(norms, "index-norms"), weights)


#: Rows of one key that a task may get in :func:`spread_join`.
KEY_ROWS = 100_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Join with a table of one row a key, *n* being the rows of the key: keys of many rows have several copies in the table, and their rows are spread over them."""
    copies = F.greatest(F.lit(1), F.ceil(F.col(n) / KEY_ROWS)).cast("int")
    most = table.agg(F.max(copies)).first()[0] or 1
    if most == 1:
        return rows.join(table, key)
    many = table.where(copies > 1)
    few = table.where(copies == 1)
    # keys of over KEY_ROWS rows are rows / KEY_ROWS at most
    hot = many.select(key, copies.alias("__c"))
    tagged = rows.join(F.broadcast(hot) if hot.count() <= KEY_ROWS else hot, key, "left")
    salted = tagged.where("__c is not null").withColumn("__s", F.floor(F.rand(7) * F.col("__c")).cast("int"))
    spread = many.withColumn("__s", F.explode(F.sequence(F.lit(0), copies - 1)))
    return tagged.where("__c is null").drop("__c").join(few, key).unionByName(salted.drop("__c").join(spread, [key, "__s"]).drop("__s"))


def query_terms(queries: DataFrame, concepts: DataFrame, index: Index, qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, term, weight, idf, norm): weights of a query's terms and those of its concepts; unknown terms count in the total only."""
    own = queries.select(qid, F.explode_outer(T.terms(F.col(query))).alias("term")).where("term is not null")
    more = detected(queries, concepts, query).select(qid, F.explode("terms").alias("term"))
    every = own.unionAll(more)
    total = every.groupBy(qid).agg(F.count("*").alias("total"))
    x = every.groupBy(qid, "term").agg(F.count("*").alias("n")).join(total, qid).join(index.idf, "term")
    x = written(x.select(qid, "term", (F.col("n") / F.col("total") * F.col("idf")).alias("weight"), "idf"), "query-weights")
    norms = x.groupBy(qid).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return x.join(norms, qid)


def cosine(index: Index, q: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, key, base): similarity of queries and texts with a term in common. Only the queries' terms take part; AQE broadcasts small query sets."""
    counts = index.counts.withColumnRenamed("total", "all")
    hits = counts.join(q, "term").groupBy(qid, index.key, "norm").agg(F.sum(F.col("weight") * F.col("tf") / F.col("all") * F.col("idf")).alias("dot"))
    return hits.withColumnRenamed("norm", "qn").join(index.norms, index.key).select(qid, index.key, F.coalesce(F.col("dot") / F.nullif(F.col("qn") * F.col("norm"), F.lit(0.0)), F.lit(0.0)).alias("base"))


def concept_boosts(chunks: DataFrame, concepts: DataFrame, key: str) -> DataFrame:
    """(key, name, boost, late): what each concept adds to each chunk, where it adds anything. Reckoned once, however many queries ask for it; the concepts are a configuration."""
    text, title = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("section_title", F.lit("")))
    c = chunks.select(key, text.alias("__x"), title.alias("__y"), F.coalesce("section_number", F.lit("")).alias("__s"))
    x = c.join(F.broadcast(concepts))
    has = lambda p: F.contains(F.col("__x"), p) | F.contains(F.col("__y"), p)
    size = lambda a: F.size(F.filter(a, has))
    boost = (
        F.when(F.array_contains("sections", F.col("__s")), BOOST["section"]).otherwise(0.0)
        + F.least(size("terms") * F.lit(BOOST["term"]), F.lit(BOOST["terms"])) + F.least(size("phrases") * F.lit(BOOST["phrase"]), F.lit(BOOST["phrases"]))
        + F.when((F.col("sections") == F.array(F.lit("25"))) & F.exists(F.array(*map(F.lit, STATUTORY)), has), BOOST["statutory"]).otherwise(0.0)
    )
    consent = F.array_sort("sections") == F.array(F.lit("13"), F.lit("14"))
    late = F.when(consent & (F.col("__s") == "13"), BOOST["13"]).when(consent & (F.col("__s") == "14"), BOOST["14"]).otherwise(0.0)
    return x.select(key, "name", boost.alias("boost"), late.alias("late")).where("boost > 0 or late > 0")


#: Queries of a block that is broadcast and tried against every batch of texts or vectors.
QUERY_BLOCK, VECTOR_BLOCK = 100_000, 4096


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows by blocks of at most *size*, one at a time on the driver."""
    own = []
    for r in rows.toLocalIterator():
        own.append(r)
        if len(own) == size:
            yield own
            own = []
    if own:
        yield own


def quoted_boosts(queries: DataFrame, chunks: DataFrame, key: str, qid: str = "qid", block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, key, boost): of chunks that hold the whole query in text or title.

    An automaton of a block of distinct queries goes over each text a single
    time, so texts are read once a block, not once a query.
    """
    q = queries.select(qid, T.collapse(F.lower("query")).alias("q")).where("q <> ''")
    texts = chunks.select(key, F.lower(F.coalesce("text", F.lit(""))).alias("x"), F.lower(F.coalesce("section_title", F.lit(""))).alias("y"))
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, q string, in_text boolean, in_title boolean"
    found = chunks.sparkSession.createDataFrame([], schema)
    for own in _blocks(q.select("q").distinct(), block):
        shared = chunks.sparkSession.sparkContext.broadcast([r[0] for r in own])
        found = found.unionAll(texts.mapInPandas(_holding(shared, key), schema))
    return found.join(q, "q").select(qid, key, (F.when(F.col("in_text"), BOOST["text"]).otherwise(0.0) + F.when(F.col("in_title"), BOOST["title"]).otherwise(0.0)).alias("boost"))


def _holding(shared: Broadcast, key: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _automaton(shared.value)
        for f in frames:
            rows = []
            for i, x, y in zip(f[key], f["x"], f["y"]):
                a, b = held(x), held(y)
                rows += [(i, q, q in a, q in b) for q in a | b]
            yield pd.DataFrame(rows, columns=[key, "q", "in_text", "in_title"])

    return run


def _automaton(queries: list[str]) -> Callable[[str], set[str]]:
    """A function that tells which queries a text holds."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: {q for q in queries if q in text}
    machine = ahocorasick.Automaton()
    for q in queries:
        machine.add_word(q, q)
    if not queries:
        return lambda text: set()
    machine.make_automaton()
    return lambda text: {q for _, q in machine.iter(text)}


def boosts(queries: DataFrame, chunks: DataFrame, concepts: DataFrame, key: str, qid: str = "qid") -> DataFrame:
    """(qid, key, boost, late) of chunks with a boost."""
    wanted = detected(queries, concepts).select(qid, "name")
    by_concept = wanted.join(F.broadcast(concepts.select("name")), "name").join(concept_boosts(chunks, concepts, key), "name").select(qid, key, "boost", "late")
    # of two concepts that a query holds, both add to the score, but what comes late is added once
    every = by_concept.unionAll(quoted_boosts(queries, chunks, key, qid).withColumn("late", F.lit(0.0)))
    return every.groupBy(qid, key).agg(F.sum("boost").alias("boost"), F.max("late").alias("late"))


def search(queries: DataFrame, chunks: DataFrame, key: str = "chunk_id", top_k: int = TOP_K, concepts: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """qid, key, score, rank: the best *top_k* chunks of each query with a score over 0; ties go to the earlier key. A query asked more than once is sought once."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    concepts = concept_table(chunks.sparkSession) if concepts is None else concepts
    index = index or build_index(chunks, key, F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("section_title", F.lit("")), F.coalesce("section_number", F.lit(""))))
    asked = written(queries.select("query").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    base = cosine(index, query_terms(asked, concepts, index))
    both = base.join(boosts(asked, chunks, concepts, key), ["qid", key], "full")
    score = F.coalesce("base", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))
    hits = both.select("qid", key, score.alias("s"), F.coalesce("late", F.lit(0.0)).alias("late")).where("s > 0").select("qid", key, F.round(F.col("s") + F.col("late"), 9).alias("score"))
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))).where(F.col("rank") <= top_k)
    return queries.select("qid", "query").join(best.join(asked, "qid").drop("qid"), "query").select("qid", key, "score", "rank")


def hit_rates(hits: DataFrame, cases: DataFrame, sections: DataFrame, key: str = "chunk_id", at: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: share of cases an expected section of which is among the first k sections found."""
    named = hits.join(sections.select(key, F.coalesce("section_number", F.lit("None")).alias("section")), key)
    got = named.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]).alias("got"))
    x = cases.join(got, "qid", "left")
    return x.agg(F.count("*").alias("cases"), *[F.round(F.avg(F.coalesce(F.arrays_overlap(F.slice("got", 1, k), "expected_sections"), F.lit(False)).cast("int")), 6).alias(f"hit_{k}") for k in at])


def _unit(vectors: list) -> np.ndarray:
    """Rows of length 1; null and zero vectors are zero."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    m = np.array([np.zeros(width) if v is None else np.asarray(v, float) for v in vectors]).reshape(len(vectors), width)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _nearest(shared: Broadcast, key: str, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        best: list[list[tuple[float, object]]] = [[] for _ in qids]  # (less the score, key), in order
        least = np.full(len(qids), -np.inf)
        for f in frames:
            for at in range(0, len(f), 1000):
                ids, v = f["id"].to_numpy()[at : at + 1000], _unit(list(f["v"][at : at + 1000]))
                s = np.floor(q @ v.T * 1e6 + 0.5) / 1e6
                s[qids[:, None] == ids[None, :]] = -np.inf
                for i in np.flatnonzero((s >= least[:, None]).any(1)):
                    new = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
                    best[i] = heapq.nsmallest(k, best[i] + list(zip((-s[i][new]).tolist(), ids[new].tolist())))
                    least[i] = -best[i][-1][0] if len(best[i]) == k else -np.inf
        yield pd.DataFrame([(i, j, -s) for i, own in zip(qids, best) for s, j in own], columns=["qid", key, "score"])

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = TOP_K, block: int = VECTOR_BLOCK) -> DataFrame:
    """(qid, key, score, rank): nearest vectors by cosine, the query itself left out; ties go to the lesser key.

    A block of queries meets the vectors in matrix products of a thousand; a
    task passes on the best *k* of each query, and the merge ranks these.
    """
    q = queries.select(F.col(key).alias("qid"), F.col(vector).cast("array<double>").alias("q"))
    v = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = vectors.schema[key].dataType.simpleString()
    merged = vectors.sparkSession.createDataFrame([], f"qid {kind}, `{key}` {kind}, score double")
    for own in _blocks(q, block):
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["qid"] for r in own]), _unit([r["q"] for r in own])))
        merged = merged.unionAll(v.mapInPandas(_nearest(shared, key, k), merged.schema))
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
