"""Grounded answers and context blocks from search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

# Titles of index-like chunks, and the texts of answers and contexts.
INDEX_TITLES = ("interpretation", "contents", "table of contents", "index")
NOTHING = "No relevant legal provision was retrieved."
UNREADABLE = "was retrieved, but no readable provision text was available for a grounded summary."
NO_CONTEXT = "No relevant legal context was retrieved."
INSTRUCTION = ("INSTRUCTION", "Answer using the retrieved legal context.", "Do not invent legal provisions that are not present in the context.")
UNTITLED, UNKNOWN = "Untitled section", "N/A"


def index_like(title: Column) -> Column:
    """True for tables of contents and their like."""
    return F.coalesce(T.collapse(F.lower(title)).isin(*INDEX_TITLES), F.lit(False))


def best_per_section(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The best hit of each section of each query, index-like ones out, with ``place`` from 1 by score and first appearance."""
    x = hits.where(~index_like(F.col("section_title"))).withColumn("section", T.or_default(F.col("section_number"), UNKNOWN))
    rest = [c for c in x.columns if c not in ("qid", "section")]
    best = x.groupBy("qid", "section").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), F.col("rank"))).alias("b"), F.min("rank").alias("first"))
    flat = best.select("qid", "section", "first", *[F.col(f"b.{c}").alias(c) for c in rest])
    return flat.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first"))).drop("first")


def operative(text: Column, section: Column) -> Column:
    """Provision text without its number and heading."""
    t = T.clean_answer(F.coalesce(text, F.lit("")))
    number = F.concat(T.strip(F.coalesce(section, F.lit(""))), F.lit("."))
    t = F.when((F.length(number) > 1) & F.startswith(F.ltrim(t), number), F.ltrim(F.substring(F.ltrim(t), F.length(number) + 1, F.length(t)))).otherwise(t)
    dash = F.instr(t, F.lit("—"))
    return F.when(dash > 0, T.strip(F.substring(t, dash + 1, F.length(t)))).otherwise(t)


def grounded(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, question, answer, sources, grounded, retrieved_count, unique_source_count for every query. Hits are top-k, so a query's are few."""
    best = best_per_section(hits)
    source = F.struct(
        "place", F.col("section"), T.clean_answer(T.or_default(F.col("section_title"), UNTITLED)).alias("title"), F.col("page_number").alias("page"), "score",
        T.clean_answer(F.coalesce("text", F.lit(""))).alias("text"), operative(F.col("text"), F.col("section_number")).alias("fact"),
    )
    per = best.groupBy("qid").agg(F.sort_array(F.collect_list(source)).alias("s"))
    n = hits.groupBy("qid").agg(F.count("*").alias("n"))
    x = queries.select("qid", "query").join(per, "qid", "left").join(n, "qid", "left")
    first = F.element_at("s", 1)
    said = F.concat(F.lit("Section "), first["section"], F.lit(" ("), first["title"], F.lit(") "))
    return x.select(
        "qid", F.col("query").alias("question"),
        F.when(F.col("s").isNull(), NOTHING).when(first["fact"] == "", F.concat(said, F.lit(UNREADABLE))).otherwise(F.concat(said, F.lit("provides: "), first["fact"])).alias("answer"),
        F.coalesce(F.transform("s", lambda y: F.struct(y["section"], y["title"], y["page"], y["score"], y["text"])), F.array()).alias("sources"),
        F.col("s").isNotNull().alias("grounded"), F.coalesce("n", F.lit(0)).cast("int").alias("retrieved_count"),
        F.coalesce(F.size("s"), F.lit(0)).alias("unique_source_count"),
    )


def context(queries: DataFrame, hits: DataFrame, max_chunks: int = 3) -> DataFrame:
    """qid, context: question, up to *max_chunks* sources, instruction. A null or blank question is an error when the row is reached."""
    if max_chunks < 1:
        raise ValueError("max_chunks must be at least 1")
    question = T.strip(F.coalesce("query", F.lit("")))
    question = F.when(question == "", F.raise_error(F.lit("a question is blank")).cast("string")).otherwise(question)
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    block = F.concat_ws(
        "\n", F.lit(""), F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]")), line("Section", T.or_default(F.col("section_number"), UNKNOWN)),
        line("Title", T.or_default(F.col("section_title"), UNTITLED)), line("Page", F.coalesce(F.nullif(F.col("page_number"), F.lit(0)).cast("string"), F.lit(UNKNOWN))),
        line("Text", T.collapse(F.coalesce("text", F.lit("")))),
    )
    per = hits.where(F.col("rank") <= max_chunks).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda y: y["b"]), "\n").alias("body"))
    x = queries.select("qid", "query").join(per, "qid", "left")
    return x.select("qid", F.concat_ws(
        "\n", F.lit("LEGAL QUESTION"), question, F.lit(""), F.lit("RETRIEVED LEGAL CONTEXT"), F.coalesce("body", F.concat_ws("\n", F.lit(""), F.lit(NO_CONTEXT))),
        F.lit(""), *map(F.lit, INSTRUCTION),
    ).alias("context"))


# What stands around the question of an answer prompt, and the tokens of the whole prompt.
ASKED, ANSWERED, PROMPT_TOKENS = "\n\nQUESTION\n", "\n\nANSWER USING ONLY THE RETRIEVED CONTEXT:\n", 240


def answer_prompt(df: DataFrame, load, context: str = "context", query: str = "query", tokens: int = PROMPT_TOKENS) -> DataFrame:
    """Adds ``prompt``: the last tokens of the context that the budget leaves, then question and instruction. A question that leaves none is an error when the row is reached. *load* gives (encode, decode)."""
    from .qa import decoder_udf, encoder_udf

    encode = encoder_udf(lambda: load()[0])
    x = df.withColumn("__i", F.concat(F.lit(ASKED), T.strip(F.coalesce(query, F.lit(""))), F.lit(ANSWERED)))
    x = x.withColumns({"__n": F.lit(tokens) - F.size(encode(F.col("__i"))), "__c": encode(F.coalesce(context, F.lit("")))})
    room = F.when(F.col("__n") > 0, F.col("__n")).otherwise(F.raise_error(F.lit("a question leaves no room for context")).cast("int"))
    x = x.withColumn("__kept", F.slice("__c", F.greatest(F.size("__c") - room + 1, F.lit(1)), room))
    return x.withColumn("prompt", F.concat(decoder_udf(load)(F.col("__kept")), "__i")).drop("__i", "__n", "__c", "__kept")
