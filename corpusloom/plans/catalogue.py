"""Registered queries over the test tables and the SQL that gives the same rows.

SQL twins stand beside the queries whose semantics DuckDB can express; regular
expressions with lookaround or backreferences and iterative algorithms have
none and are tested against brute force.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import nested, numbers as N, text as T
from ..operators import answers, chunks, corpus, encoding, metrics, packing, qa, retrieval
from ..operators.ordering import first_wins
from ..session import table_path
from ..sources import files
from ..streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}

RAW, DOCS, PAGES = "open_india_law_legislation", "documents", "indian_contract_act_1872_chunks"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL twins of the string functions
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NWS = _WS.replace("[", "[^", 1)


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'), ' ')"


def _clean(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(coalesce({c}, ''), chr(173), ''), '{_WS}+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), ' ')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _words(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '{_NWS}+')), 0)"


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z][a-z0-9-]*'), lambda x: x NOT IN ({_STOP}))"


def _terms(c: str) -> str:
    t = _tokens(c)
    return f"list_concat({t}, list_transform(range(1, greatest(len({t}), 1)), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


# Corpus

@query(f"SELECT doc_id, {_clean('text')} AS text FROM documents")
def clean_text(spark, sf):
    return _t(spark, sf, DOCS).select("doc_id", T.clean_corpus(F.coalesce("text", F.lit(""))).alias("text"))


@query(f"SELECT record_id, length({_clean('text')}) AS chars FROM {RAW} WHERE length({_clean('text')}) >= 200")
def min_chars_filter(spark, sf):
    return corpus.cleaned(_t(spark, sf, RAW)).where(F.length("text") >= corpus.MIN_CHARS).select("record_id", F.length("text").alias("chars"))


@query(f"SELECT record_id, sha256({_clean('text')}) AS text_sha256 FROM {RAW}")
def text_fingerprint(spark, sf):
    return corpus.cleaned(_t(spark, sf, RAW)).select("record_id", "text_sha256")


@query(f"""SELECT record_id, {_strip("coalesce(act_id, '')")} AS act_id, CASE WHEN {_strip("coalesce(nullif(state, ''), source_publisher, '')")} = '' THEN '' ELSE {_strip("coalesce(nullif(state, ''), source_publisher, '')")} END AS state,
  {_strip("coalesce(text, '')")} AS text, 'v1' AS source_snapshot, 'corpus' AS source_dataset FROM {RAW}""")
def normalized_rows(spark, sf):
    return corpus.normalized(_t(spark, sf, RAW), F.col("source_publisher"), "v1", "corpus").select("record_id", "act_id", "state", "text", "source_snapshot", "source_dataset")


@query(f"SELECT min(record_id) AS record_id FROM {RAW} WHERE coalesce(text, '') <> '' GROUP BY act_id, section_number, text")
def raw_dedup_first_wins(spark, sf):
    return corpus.raw_dedup(_t(spark, sf, RAW), "record_id").select("record_id")


@query(f"SELECT min(doc_id) AS doc_id, {_clean('text')} AS text FROM documents WHERE length({_clean('text')}) >= 200 GROUP BY {_clean('text')}")
def text_dedup_first_wins(spark, sf):
    x = _t(spark, sf, DOCS).select("doc_id", T.clean_corpus(F.coalesce("text", F.lit(""))).alias("text")).where("length(text) >= 200")
    return first_wins(x, ["text"], "doc_id")


def _key(c: str) -> str:
    return _strip(f"coalesce({c}, 'None')")


# rounds: a row that is the first of both its groups is kept, those that share a key with it go
_GREEDY = f"""(WITH RECURSIVE k AS (SELECT record_id AS o, source_url, length(t) < 200 AS short, {_key("act_id")} || ':' || {_key("section_number")} AS a, sha256(t) AS b FROM (SELECT *, {_clean('text')} AS t FROM {RAW})),
r AS (SELECT a, b, min(o) AS o, 0 AS kept FROM k WHERE NOT short GROUP BY a, b
  UNION ALL SELECT a, b, o, now AS kept FROM (SELECT *, max(now) OVER (PARTITION BY a) AS na, max(now) OVER (PARTITION BY b) AS nb FROM (
    SELECT a, b, o, CASE WHEN o = min(o) OVER (PARTITION BY a) AND o = min(o) OVER (PARTITION BY b) THEN 1 ELSE 0 END AS now FROM r WHERE kept = 0)) WHERE now = 1 OR (na = 0 AND nb = 0)),
q AS (SELECT a, b, o FROM r WHERE kept = 1)
SELECT k.o AS record_id, source_url, CASE WHEN short THEN 'too_short' WHEN x.o = k.o AND y.o = k.o THEN 'kept' WHEN x.o < k.o THEN 'duplicate_id' ELSE 'duplicate_text' END AS status
FROM k LEFT JOIN q x ON x.a = k.a LEFT JOIN q y ON y.b = k.b)"""


@query(f"SELECT record_id, status FROM {_GREEDY}")
def greedy_two_key_dedup(spark, sf):
    return corpus.clean_outcomes(_t(spark, sf, RAW), "record_id").select("record_id", "status")


@query(f"""SELECT 'input' AS outcome, count(*) AS n FROM {_GREEDY} UNION ALL SELECT s, (SELECT count(*) FROM {_GREEDY} WHERE status = s) FROM (VALUES ('kept'), ('duplicate_id'), ('duplicate_text'), ('too_short')) AS v(s)
UNION ALL SELECT 'missing_source', count(*) FROM {_GREEDY} WHERE status = 'kept' AND coalesce({_strip('source_url')}, '') = ''""")
def clean_outcome_counts(spark, sf):
    return corpus.outcome_counts(corpus.clean_outcomes(_t(spark, sf, RAW), "record_id"))


@query(f"""SELECT record_id, state FROM (SELECT min(record_id) AS record_id, arg_min(coalesce(state, ''), record_id) AS state FROM {RAW} WHERE coalesce(text, '') <> '' GROUP BY act_id, section_number, text)
QUALIFY row_number() OVER (PARTITION BY state ORDER BY record_id) <= 100""")
def jurisdiction_cap(spark, sf):
    return _capped(spark, sf, 100)


@query(ORACLES["jurisdiction_cap"].replace("<= 100", f"<= {corpus.PER_JURISDICTION}"))
def jurisdiction_cap_full(spark, sf):
    return _capped(spark, sf, corpus.PER_JURISDICTION)


def _capped(spark, sf, cap):
    # repeated rows do not count
    kept = corpus.raw_dedup(_t(spark, sf, RAW).select("record_id", "act_id", "section_number", "text", F.coalesce("state", F.lit("")).alias("state")), "record_id")
    return corpus.capped(kept.select("record_id", "state"), "state", "record_id", cap)


_RANKED = "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents"


@query(f"""SELECT doc_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' WHEN r <= floor(n * 0.9) + floor(n * 0.05) THEN 'validation' ELSE 'test' END AS split FROM ({_RANKED})""")
def hash_split_90_5_5(spark, sf):
    return corpus.hash_split(_t(spark, sf, DOCS).select("doc_id"), "doc_id")


_STATS = f"""SELECT split, count(*) AS records, sum(coalesce(length(text), 0))::BIGINT AS characters, sum({_words('text')})::BIGINT AS words, min(coalesce(length(text), 0)) AS min_chars,
  max(coalesce(length(text), 0)) AS max_chars, round(avg(coalesce(length(text), 0)), 2) AS avg_chars, round_even(sum({_words('text')}) * 1.33::DOUBLE, 0)::BIGINT AS estimated_tokens,
  round(sum(coalesce(length(text), 0)) / 1e6, 2) AS size_mb, count(DISTINCT nullif(act_id, '')) AS unique_acts,
  count(DISTINCT CASE WHEN coalesce(act_id, '') <> '' OR coalesce(section_number, '') <> '' THEN coalesce(act_id, '') || ':' || coalesce(section_number, '') END) AS unique_sections
  FROM splits GROUP BY split"""


@query(_STATS)
def corpus_stats_by_split(spark, sf):
    return corpus.corpus_stats(_t(spark, sf, "splits"))


@query(f"SELECT sum(records)::BIGINT AS records, sum(characters)::BIGINT AS characters, sum(words)::BIGINT AS words, sum(estimated_tokens)::BIGINT AS estimated_tokens FROM ({_STATS})")
def corpus_stats_total(spark, sf):
    return corpus.stats_total(corpus.corpus_stats(_t(spark, sf, "splits")))


_CLEANED = f"(SELECT doc_id, lang, {_clean('text')} AS text FROM documents)"


@query(f"""SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS records, sum(length(text))::BIGINT AS characters, sum({_words('text')})::BIGINT AS words
  FROM (SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, text FROM {_CLEANED.replace("lang,", "coalesce(lang, '') AS lang,")} WHERE length(text) >= 200 GROUP BY text) GROUP BY 1""")
def corpus_pipeline_stats(spark, sf):
    x = _t(spark, sf, DOCS).select("doc_id", "lang", T.clean_corpus(F.coalesce("text", F.lit(""))).alias("text")).where(F.length("text") >= corpus.MIN_CHARS)
    kept = first_wins(x.withColumn("sha", T.sha256(F.col("text"))), ["sha"], "doc_id")
    return kept.groupBy(T.or_default(F.col("lang"), "unknown").alias("lang")).agg(
        F.count("*").alias("records"), F.sum(F.length("text")).alias("characters"), F.sum(T.word_count(F.col("text"))).cast("long").alias("words"))


@query(f"SELECT split, coalesce(nullif({_strip('state')}, ''), 'unknown') AS state, count(*) AS n FROM splits GROUP BY 1, 2")
def jurisdiction_histogram(spark, sf):
    return corpus.histogram(_t(spark, sf, "splits"), "split", "state")


@query(f"SELECT coalesce(nullif({_strip('state')}, ''), 'unknown') AS key, count(*) AS n FROM splits GROUP BY 1")
def merged_histogram(spark, sf):
    return corpus.merged_maps(corpus.histogram_map(corpus.histogram(_t(spark, sf, "splits"), "split", "state"), "split", "state"))


@query(f"SELECT lang, count(*) AS records, coalesce(sum({_words('text')}), 0)::BIGINT AS tokens, round(coalesce(sum({_words('text')}), 0) / greatest(count(*), 1), 2) AS avg_tokens FROM documents GROUP BY ROLLUP (lang)")
def stats_rollup(spark, sf):
    return packing.encoded_totals(_t(spark, sf, DOCS).select("lang", T.words(F.col("text")).alias("tokens")), "lang", "tokens")


# Retrieval

_QUERY_ROWS = (
    (1, "What are the essentials of a valid contract?", ("10",)), (2, "What makes an agreement a contract?", ("10",)),
    (3, "When are considerations and objects lawful?", ("23",)), (4, "Is an agreement without consideration valid?", ("25",)),
    (5, "What is free consent?", ("13", "14")), (6, "fee for the schedule of fees before the close of the year", ("1", "2")), (7, "order in writing by the registrar", ("3",)), (8, "", ("1",)),
)
_QUERY_SQL = "(VALUES " + ", ".join(f"({i}, '{q}', {list(s)})" for i, q, s in _QUERY_ROWS) + ") AS qs(qid, query, expected_sections)"


def _queries(spark):
    return spark.createDataFrame([(i, q, list(s)) for i, q, s in _QUERY_ROWS], "qid int, query string, expected_sections array<string>")


@query(f"SELECT doc_id, array_to_string({_tokens('coalesce(text, chr(32))')}, ' ') AS tokens FROM documents")
def regex_tokens(spark, sf):
    return _t(spark, sf, DOCS).select("doc_id", F.array_join(T.tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


_DOC_TERMS = f"(SELECT doc_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents))"


@query(f"SELECT term, count(*) AS n FROM {_DOC_TERMS} WHERE contains(term, ' ') GROUP BY term")
def bigram_counts(spark, sf):
    return _t(spark, sf, DOCS).select(F.explode(T.terms(F.col("text"))).alias("term")).where(F.contains("term", F.lit(" "))).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM {_DOC_TERMS} GROUP BY ALL")
def term_frequency(spark, sf):
    return retrieval.term_counts(_t(spark, sf, DOCS), "doc_id", F.col("text")).select("doc_id", "term", "tf")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1, 6) AS idf FROM {_DOC_TERMS} GROUP BY term")
def document_frequency_idf(spark, sf):
    d = _t(spark, sf, DOCS)
    return retrieval.idf(retrieval.term_counts(d, "doc_id", F.col("text")), "doc_id", d.count()).withColumn("idf", F.round("idf", 6))


_POSTINGS = """tf AS (SELECT k, term, count(*) AS n FROM terms GROUP BY ALL), tot AS (SELECT k, sum(n) AS total FROM tf GROUP BY k),
df AS (SELECT term, ln((1 + (SELECT n FROM docs)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
post AS (SELECT tf.k, tf.term, n / total * idf AS w FROM tf JOIN tot USING (k) JOIN df USING (term)),
norms AS (SELECT k, sqrt(sum(w * w)) AS norm FROM post GROUP BY k)"""


@query(f"WITH docs AS (SELECT count(*) AS n FROM documents), terms AS (SELECT doc_id AS k, term FROM {_DOC_TERMS}), {_POSTINGS} SELECT k AS doc_id, round(norm, 6) AS norm FROM norms")
def tfidf_norms(spark, sf):
    return retrieval.build_index(_t(spark, sf, DOCS), "doc_id", F.col("text")).norms.withColumn("norm", F.round("norm", 6))


_CHUNK_TEXT = "coalesce(text, '') || ' ' || coalesce(section_title, '') || ' ' || coalesce(section_number, '')"
_ONE = "(SELECT k, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM ({}))"
_CONCEPTS = "(VALUES " + ", ".join(f"('{n}', {list(p)}, {list(t)}, {list(s)})" for n, p, t, s in retrieval.CONCEPTS) + ") AS cs(name, phrases, terms, sections)"
_SEARCH = f"""WITH docs AS (SELECT count(*) AS n FROM {PAGES}), terms AS (SELECT * FROM {_ONE.format(f"SELECT chunk_id AS k, {_tokens(_CHUNK_TEXT)} AS t FROM {PAGES}")}), {_POSTINGS},
qs AS (SELECT * FROM {_QUERY_SQL}), qn AS (SELECT qid, {_collapse('lower(query)')} AS q FROM qs), cs AS (SELECT * FROM {_CONCEPTS}),
det AS (SELECT qid, cs.* FROM qn, cs WHERE len(list_filter(phrases, lambda p: contains(q, p))) > 0),
qt AS (SELECT k AS qid, term FROM {_ONE.format(f"SELECT qid AS k, {_tokens('query')} AS t FROM qs")} UNION ALL SELECT qid, unnest(terms) FROM det),
qtot AS (SELECT qid, count(*) AS total FROM qt GROUP BY qid),
qw AS (SELECT qid, term, count(*) / any_value(total) * any_value(idf) AS w FROM qt JOIN qtot USING (qid) JOIN df USING (term) GROUP BY qid, term),
qnorm AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY qid),
base AS (SELECT qid, k, sum(qw.w * post.w) / any_value(qnorm.norm) / any_value(norms.norm) AS base FROM qw JOIN post USING (term) JOIN qnorm USING (qid) JOIN norms USING (k) GROUP BY qid, k),
c AS (SELECT chunk_id AS k, lower(coalesce(text, '')) AS x, lower(coalesce(section_title, '')) AS y, coalesce(section_number, '') AS s FROM {PAGES}),
cb AS (SELECT qid, k, sum(CASE WHEN list_contains(sections, s) THEN 0.60::DOUBLE ELSE 0 END + least(len(list_filter(terms, lambda p: contains(x, p) OR contains(y, p))) * 0.015::DOUBLE, 0.12::DOUBLE)
  + least(len(list_filter(phrases, lambda p: contains(x, p) OR contains(y, p))) * 0.45::DOUBLE, 0.90::DOUBLE)
  + CASE WHEN sections = ['25'] AND len(list_filter({list(retrieval.STATUTORY)}, lambda p: contains(x, p) OR contains(y, p))) > 0 THEN 1.50::DOUBLE ELSE 0 END) AS b,
  max(CASE WHEN sections = ['13', '14'] AND s = '13' THEN 0.20::DOUBLE WHEN sections = ['13', '14'] AND s = '14' THEN 0.30::DOUBLE ELSE 0 END) AS late FROM det, c GROUP BY qid, k),
tb AS (SELECT qid, k, CASE WHEN contains(x, q) THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN contains(y, q) THEN 0.25::DOUBLE ELSE 0 END AS b FROM qn, c WHERE q <> '' AND (contains(x, q) OR contains(y, q))),
al AS (SELECT qid, k, base AS v, 0::DOUBLE AS late FROM base UNION ALL SELECT qid, k, b, late FROM cb UNION ALL SELECT qid, k, b, 0 FROM tb),
sc AS (SELECT qid, k AS chunk_id, round(sum(v) + max(late), 9) AS score FROM al GROUP BY qid, k HAVING sum(v) > 0),
hits AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 5)
"""


def _hits(spark, sf):
    pages = _t(spark, sf, PAGES)
    return retrieval.search(_queries(spark), pages), pages


@query(f"{_SEARCH} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM hits")
def boosted_search(spark, sf):
    return _hits(spark, sf)[0].withColumn("score", F.round("score", 6))


@query(f"""{_SEARCH.replace(f"SELECT * FROM {_QUERY_SQL}", "SELECT qa_id AS qid, coalesce(question, '') AS query FROM qa_v1 WHERE qa_id % 50 = 0")} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM hits""")
def boosted_search_questions(spark, sf):
    # the questions grow with the data
    asked = _t(spark, sf, "qa_v1").where("qa_id % 50 = 0").select(F.col("qa_id").alias("qid"), F.coalesce("question", F.lit("")).alias("query"))
    return retrieval.search(asked, _t(spark, sf, PAGES)).withColumn("score", F.round("score", 6))


@query(f"""{_SEARCH}, got AS (SELECT qid, list(coalesce(section_number, 'None') ORDER BY rank) AS got FROM hits JOIN {PAGES} USING (chunk_id) GROUP BY qid)
SELECT count(*) AS cases, {', '.join(f"round(avg(CASE WHEN list_has_any(coalesce(got, [])[1:{k}], expected_sections) THEN 1 ELSE 0 END), 6) AS hit_{k}" for k in (1, 3, 5))} FROM qs LEFT JOIN got USING (qid)""")
def hit_at_k(spark, sf):
    hits, pages = _hits(spark, sf)
    return retrieval.hit_rates(hits, _queries(spark), pages)


def _full_hits(spark, sf):
    hits, pages = _hits(spark, sf)
    return hits.join(pages.select("chunk_id", "section_number", "section_title", "page_number", "text"), "chunk_id")


@query(f"""{_SEARCH}, h AS (SELECT hits.*, coalesce(nullif(section_number, ''), 'N/A') AS section FROM hits JOIN {PAGES} USING (chunk_id)
  WHERE {_collapse("lower(coalesce(section_title, ''))")} NOT IN {answers.INDEX_TITLES}),
b AS (SELECT qid, section, arg_min(chunk_id, rank) AS chunk_id, max(score) AS score, min(rank) AS first FROM h GROUP BY qid, section)
SELECT qid, section, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS place FROM b""")
def best_chunk_per_section(spark, sf):
    return answers.best_per_section(_full_hits(spark, sf)).select("qid", "section", "chunk_id", F.round("score", 6).alias("score"), "place")


@query()
def grounded_answers(spark, sf):
    return answers.grounded(_queries(spark), _full_hits(spark, sf)).withColumn("sources", F.to_json("sources"))


@query(f"""{_SEARCH}, b AS (SELECT qid, string_agg(chr(10) || '[Source ' || rank || ']' || chr(10) || 'Section: ' || coalesce(nullif(section_number, ''), 'N/A') || chr(10) || 'Title: ' || coalesce(nullif(section_title, ''), 'Untitled section')
  || chr(10) || 'Page: ' || coalesce(nullif(page_number, 0)::BIGINT::VARCHAR, 'N/A') || chr(10) || 'Text: ' || {_collapse("coalesce(text, '')")}, chr(10) ORDER BY rank) AS body
  FROM hits JOIN {PAGES} USING (chunk_id) WHERE rank <= 3 GROUP BY qid)
SELECT qid, 'LEGAL QUESTION' || chr(10) || query || chr(10) || chr(10) || 'RETRIEVED LEGAL CONTEXT' || chr(10) || coalesce(body, chr(10) || '{answers.NO_CONTEXT}') || chr(10) || chr(10) || '{(chr(10)).join(answers.INSTRUCTION)}' AS context
FROM qs LEFT JOIN b USING (qid) WHERE query <> ''""")
def context_blocks(spark, sf):
    # a blank question is an error
    return answers.context(_queries(spark).where("query <> ''"), _full_hits(spark, sf))


@query(f"SELECT qid, right(context, 240 - length(i)) || i AS prompt FROM (SELECT *, chr(10) || chr(10) || 'QUESTION' || chr(10) || query || chr(10) || chr(10) || 'ANSWER USING ONLY THE RETRIEVED CONTEXT:' || chr(10) AS i FROM ({ORACLES['context_blocks']}) JOIN {_QUERY_SQL} USING (qid))")
def answer_prompts(spark, sf):
    # code points stand in for tokens
    x = answers.context(_queries(spark).where("query <> ''"), _full_hits(spark, sf)).join(_queries(spark), "qid")
    return answers.answer_prompt(x, encoding.character_codec).select("qid", "prompt")


@query(f"""SELECT qa_id, name FROM qa_v1, {_CONCEPTS} WHERE len(list_filter(phrases, lambda p: contains({_collapse('lower(question)')}, p))) > 0
UNION ALL SELECT qid, name FROM {_QUERY_SQL}, {_CONCEPTS} WHERE len(list_filter(phrases, lambda p: contains({_collapse('lower(query)')}, p))) > 0""")
def detected_concepts(spark, sf):
    q = _t(spark, sf, "qa_v1").select("qa_id", F.col("question").alias("query")).unionAll(_queries(spark).select(F.col("qid").cast("long"), "query"))
    return retrieval.detected(q, retrieval.concept_table(spark)).select("qa_id", "name")


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE qid <> vec_id)
SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def dense_cosine_topk(spark, sf):
    v = _t(spark, sf, "embeddings")
    return retrieval.dense_topk(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding")


# Chunks

@query(f"""SELECT doc_id, w AS window_no, {_strip('substr(text, w * 1050 + 1, 1200)')} AS chunk, length({_strip('substr(text, w * 1050 + 1, 1200)')}) AS character_count
FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1200) / 1050))::INT + 1)) AS w FROM documents WHERE length(text) > 0) WHERE {_strip('substr(text, w * 1050 + 1, 1200)')} <> ''""")
def fixed_windows(spark, sf):
    return chunks.windows(_t(spark, sf, DOCS), ["doc_id"], "text")


@query()
def section_headings(spark, sf):
    return chunks.headings(_t(spark, sf, PAGES), ["chunk_id"], "text")


@query()
def chunked_pages(spark, sf):
    return chunks.chunk_pages(_t(spark, sf, PAGES).select("source_file", "page_number", "text"))


@query(f"SELECT chunk_id, last_value(section_number IGNORE NULLS) OVER (ORDER BY source_file, chunk_id ROWS UNBOUNDED PRECEDING) AS carried FROM {PAGES}")
def section_carry_forward(spark, sf):
    # a section goes on over the end of a file
    return chunks.carried(_t(spark, sf, PAGES), "section_number", ["source_file", "chunk_id"], [], "carried").select("chunk_id", "carried")


@query(f"SELECT count(*) AS chunks, sum(character_count)::BIGINT AS characters, round(avg(character_count), 2) AS mean_characters FROM {PAGES}")
def chunk_totals(spark, sf):
    return chunks.chunk_totals(_t(spark, sf, PAGES))


@query(f"SELECT count(*) AS pages, count_if({_strip('text')} <> '') AS with_text, sum(length({_strip('text')}))::BIGINT AS characters FROM {PAGES}")
def page_totals(spark, sf):
    return chunks.page_totals(_t(spark, sf, PAGES))


# Question answering

_EXAMPLES = f"""(SELECT row_id, split, unnest(CASE WHEN lower(ttl) IN ('this provision', 'untitled section') THEN [0] ELSE [0, 1] END) AS variant, act, sec, ttl, body,
  act || ':' || sec || ':' || sha AS source_id FROM (SELECT row_id, split, {_collapse("coalesce(act_id, '')")} AS act, coalesce(nullif({_collapse("coalesce(section_number, '')")}, ''), 'N/A') AS sec,
  coalesce(nullif({_collapse("coalesce(section_title, '')")}, ''), 'this provision') AS ttl, {_collapse("coalesce(text, '')")} AS body, coalesce(text_sha256, '') AS sha FROM splits) WHERE body <> '')"""
_QUESTION = "CASE variant WHEN 0 THEN 'What does Section ' || sec || ' provide?' ELSE 'What is the legal provision regarding ' || ttl || '?' END"
_TYPE = "CASE variant WHEN 0 THEN 'section_provision' ELSE 'title_provision' END"


def _examples(spark, sf):
    return qa.provision_examples(_t(spark, sf, "splits"), ["row_id", "split"])


@query(f"""SELECT row_id, variant, {_QUESTION} AS question, 'Act: ' || act || chr(10) || 'Section: ' || sec || chr(10) || 'Title: ' || ttl || chr(10) || 'Provision: ' || body AS context, body AS answer, sec AS section, act AS act_id, source_id,
  {_TYPE} AS question_type FROM {_EXAMPLES}""")
def qa_templates(spark, sf):
    return _examples(spark, sf).drop("split")


_DEDUP = f"""(SELECT * FROM (SELECT *, {_QUESTION} AS question, {_TYPE} AS question_type, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS so FROM {_EXAMPLES})
QUALIFY row_number() OVER (PARTITION BY source_id, question_type, question ORDER BY so, row_id, variant) = 1)"""


@query(f"SELECT row_id, variant, sha256(source_id || '|' || question_type || '|' || question) AS stable_key FROM {_DEDUP}")
def qa_stable_dedup(spark, sf):
    return qa.stable_dedup(_examples(spark, sf), ["row_id", "variant"]).select("row_id", "variant", "stable_key")


_ATTACHED = f"""(SELECT d.* EXCLUDE (split), s.split FROM {_DEDUP} d JOIN (SELECT coalesce(act_id, '') || ':' || coalesce(section_number, '') || ':' || coalesce(text_sha256, '') AS source_id,
  arg_max(split, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END) AS split FROM splits GROUP BY 1) s USING (source_id))"""


def _attached(spark, sf):
    return qa.attached(qa.stable_dedup(_examples(spark, sf), ["row_id", "variant"]), _t(spark, sf, "splits"))


@query(f"SELECT row_id, variant, source_id, split FROM {_ATTACHED}")
def qa_split_attachment(spark, sf):
    return _attached(spark, sf).select("row_id", "variant", "source_id", "split")


@query(f"""WITH a AS (SELECT row_id, variant, split FROM {_ATTACHED}), c AS (SELECT count(*) AS t, count_if(split = 'train') AS n1, count_if(split = 'validation') AS n2, count_if(split = 'test') AS n3 FROM a),
r AS (SELECT *, least(n1, round_even(1000 * n1 / t, 0), 1000) AS t1 FROM c), r2 AS (SELECT *, least(n2, round_even(1000 * n2 / t, 0), 1000 - t1) AS t2 FROM r),
r3 AS (SELECT *, least(n3, round_even(1000 * n3 / t, 0), 1000 - t1 - t2) AS t3 FROM r2), l AS (SELECT *, 1000 - t1 - t2 - t3 AS f FROM r3),
k AS (SELECT t, t1 + least(f, n1 - t1) AS k1, t2 + least(f - least(f, n1 - t1), n2 - t2) AS k2, t3 + least(f - least(f, n1 - t1) - least(f - least(f, n1 - t1), n2 - t2), n3 - t3) AS k3 FROM l)
SELECT row_id, variant, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id, variant) AS n FROM a), k
WHERE t <= 1000 OR n <= CASE split WHEN 'train' THEN k1 WHEN 'validation' THEN k2 ELSE k3 END""")
def qa_proportional_cap(spark, sf):
    # as many as the least scale has many times over, so that the cap applies at every scale
    return qa.proportional_cap(_attached(spark, sf).select("row_id", "variant", "split"), ["row_id", "variant"], 1000)


@query(re.sub(r"\b1000\b", "20000", ORACLES["qa_proportional_cap"]))
def qa_proportional_cap_full(spark, sf):
    return qa.proportional_cap(_attached(spark, sf).select("row_id", "variant", "split"), ["row_id", "variant"])


@query("SELECT source_id, count(DISTINCT split) AS splits FROM splits WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf):
    return qa.leaks(_t(spark, sf, "splits"))


@query(f"""WITH q AS (SELECT *, split FROM qa_v1 JOIN (SELECT source_id, min(split) AS split FROM splits GROUP BY 1) USING (source_id))
SELECT 'blank_fields' AS check, count_if({' OR '.join(f"coalesce({_strip(c)}, '') = ''" for c in ("question", "context", "answer", "section", "act_id", "source_id", "question_type"))}) AS n FROM q
UNION ALL SELECT 'repeated_question', (SELECT count(*) FROM (SELECT 1 FROM q GROUP BY source_id, question HAVING count(*) > 1))
UNION ALL SELECT 'source_in_two_splits', (SELECT count(*) FROM (SELECT 1 FROM q GROUP BY source_id HAVING count(DISTINCT split) > 1))""")
def qa_violations(spark, sf):
    of = _t(spark, sf, "splits").where("source_id is not null").groupBy("source_id").agg(F.min("split").alias("split"))
    return qa.violations(_t(spark, sf, "qa_v1").join(of, "source_id"))


def _clauses(c: str) -> str:
    parts = f"list_filter(string_split(regexp_replace({_collapse(c)}, '([.;:)]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')"
    return f"list_filter(string_split(array_to_string(list_transform({parts}, lambda x, i: CASE WHEN i = 1 THEN x WHEN length(x) < 45 THEN ' ' || x ELSE chr(10) || x END), ''), chr(10)), lambda x: x <> '')"


@query(f"SELECT row_id, unnest(range(0, len(p))) AS part_no, unnest(p) AS part FROM (SELECT row_id, {_clauses('text')} AS p FROM splits WHERE text IS NOT NULL)")
def sentence_split(spark, sf):
    return _t(spark, sf, "splits").select("row_id", F.posexplode(T.clauses(F.col("text"))).alias("part_no", "part"))


@query()
def ocr_corruption_flags(spark, sf):
    return _t(spark, sf, "splits").select("row_id", T.ocr_corrupt(F.col("text")).alias("corrupt"))


def _marked(spark, sf):
    # three answers in four get the marker of their section, the last of the four another one or none
    x = _t(spark, sf, "qa_v1")
    front = F.when(F.col("qa_id") % 4 < 3, F.concat(F.lit("Section "), F.coalesce("section", F.lit("None")), F.lit(": "))).otherwise("")
    return x.withColumn("answer", F.concat(front, F.coalesce("answer", F.lit(""))))


_NEXT_SQL = r"\s+(?:>\s*)?(?:\*\*)?(\d+)[A-Za-z]?(?:\.)?(?:\*\*)?\.?(?:\*\*)?\s+[A-Z]"
_EXPLICIT_SQL = r"\s+Section\s*:?\s*(\d+[A-Za-z]?)\s*[:.]\s*"
_MARKED_SQL = r"\bSection\s*:?\s*' || regexp_escape(sec) || '\s*:\s*"
_BODIES = rf"""(WITH m AS (SELECT qa_id, {_collapse("CASE WHEN qa_id % 4 < 3 THEN 'Section ' || coalesce(section, 'None') || ': ' ELSE '' END || coalesce(answer, '')")} AS t, {_strip("coalesce(section, 'None')")} AS sec FROM qa_v1),
b AS (SELECT qa_id, sec, regexp_matches(t, '(?i){_MARKED_SQL}') AS ok, trim(regexp_extract(t, '(?is){_MARKED_SQL}(.*)', 1)) AS b, try_cast(nullif(regexp_extract(sec, '^(\d+)[A-Za-z]?$', 1), '') AS HUGEINT) AS own FROM m),
c AS (SELECT *, regexp_extract(b, '(?is)^(.*?){_EXPLICIT_SQL}', 1) AS x, try_cast(nullif(regexp_extract(regexp_extract(b, '(?i){_EXPLICIT_SQL}', 1), '^\d+', 0), '') AS HUGEINT) AS xn,
  regexp_split_to_array(b, '{_NEXT_SQL}') AS bt, regexp_extract_all(b, '{_NEXT_SQL}') AS hd, list_transform(regexp_extract_all(b, '{_NEXT_SQL}', 1), lambda n: try_cast(n AS HUGEINT)) AS ns FROM b),
d AS (SELECT *, CASE WHEN xn > own THEN length(x) END AS ex, list_position(list_transform(ns, lambda n: n > own), true) AS hit FROM c),
e AS (SELECT *, CASE WHEN own IS NOT NULL THEN least(ex, CASE WHEN hit > 0 THEN list_sum(list_transform(bt[1:hit], lambda z: length(z))) + coalesce(list_sum(list_transform(hd[1:hit - 1], lambda z: length(z))), 0) END) END AS cut FROM d),
f AS (SELECT *, CASE WHEN cut IS NULL THEN b ELSE trim(left(b, cut::BIGINT)) END AS body FROM e)
SELECT qa_id, CASE WHEN NOT ok THEN '{qa.MARKER_NOT_FOUND}' WHEN b = '' THEN '{qa.BODY_EMPTY}' WHEN cut IS NOT NULL AND NOT regexp_matches(body, '[.!?;:][\"''’”)}}\]]*$') THEN '{qa.INCOMPLETE}' ELSE '' END AS cleanup, body AS raw FROM f)"""


@query(f"SELECT qa_id, cleanup, CASE cleanup WHEN '' THEN raw ELSE '' END AS body FROM {_BODIES}")
def section_bodies(spark, sf):
    return qa.section_bodies(_marked(spark, sf)).select("qa_id", "cleanup", "body")


@query()
def section_answers(spark, sf):
    return qa.section_answers(_marked(spark, sf)).select("qa_id", "body", "cleanup")


@query()
def section_answer_status(spark, sf):
    return qa.status_counts(qa.section_answers(_marked(spark, sf)))


@query(f"""SELECT qa_id, 'Act: ' || coalesce(nullif({_strip("regexp_extract(coalesce(context, ''), '(?m)^Title:[ ]*([^ \n][^\n]*)$', 1)")}, ''), act_id, 'Unknown Act') || '. Section: ' || {_strip("coalesce(section, 'Unknown')")} || '. Question: ' || {_collapse("coalesce(question, '')")} AS question FROM qa_v1""")
def qa_v2_questions(spark, sf):
    return _t(spark, sf, "qa_v1").select("qa_id", qa.v2_question(None).alias("question"))


@query(f"SELECT qa_id, CASE question_type WHEN 'section_provision' THEN question || ' Give the relevant provision text.' ELSE question END AS question, sha256('CONTEXT:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'QUESTION:' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || 'ANSWER:' || chr(10) || coalesce(answer, '')) AS prompt FROM qa_v1")
def qa_prompts(spark, sf):
    return _t(spark, sf, "qa_v1").select(
        "qa_id", qa.chunked_question(F.col("question"), F.col("question_type")).alias("question"), T.sha256(qa.combined_prompt(F.col("context"), F.col("question"), F.col("answer"))).alias("prompt"))


_LEN = f"(SELECT {_words('text')} AS v FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH s AS (SELECT list(v ORDER BY v) AS a, count(*) AS n, round(avg(v), 2) AS m FROM {_LEN})
SELECT n AS count, a[1] AS min, a[n] AS max, m AS mean, {', '.join(f"a[round_even((n - 1) * {p}::DOUBLE, 0)::INT + 1] AS {k}" for k, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))} FROM s""")
def token_length_percentiles(spark, sf):
    return qa.length_summary(_t(spark, sf, DOCS).where("text is not null").select(T.word_count(F.col("text")).alias("v")), "v")


@query(f"SELECT count(*) AS records, count_if(v > 256) AS over_limit, round(100 * count_if(v > 256) / count(*), 2) AS over_percent, count_if(v >= 230) AS near_limit, round(100 * count_if(v >= 230) / count(*), 2) AS near_percent FROM {_LEN}")
def over_limit_share(spark, sf):
    return qa.limit_shares(_t(spark, sf, DOCS).where("text is not null").select(T.word_count(F.col("text")).alias("v")), "v")


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 10")
def top_keys_most_common(spark, sf):
    return qa.most_common(_t(spark, sf, DOCS), "source", "doc_id")


@query()
def bpe_encode_lengths(spark, sf):
    encode = qa.encoder_udf(encoding.sentencepiece_encoder())
    return _t(spark, sf, DOCS).select("doc_id", F.size(encode(F.coalesce("text", F.lit("")))).alias("tokens"))


@query("SELECT doc_id FROM documents")
def token_round_trip(spark, sf):
    # ids decoded and encoded again are the same ids
    load = encoding.sentencepiece_codec()
    x = _t(spark, sf, DOCS).select("doc_id", qa.encoder_udf(lambda: load()[0])(F.coalesce("text", F.lit(""))).alias("ids")).withColumn("text", qa.decoder_udf(load)(F.col("ids")))
    return x.withColumn("again", qa.encoder_udf(lambda: load()[0])(F.col("text"))).where(F.col("again") == F.col("ids")).select("doc_id")


_PREPARED = ("qa_id", "input_ids", "labels", "attention_mask", "original_context_tokens", "original_answer_tokens", "prepared_context_tokens", "prepared_sequence_tokens", "answer_tokens_used")


@query()
def qa_prepared_sequences(spark, sf):
    return qa.prepared(_t(spark, sf, "qa_v1"), encoding.sentencepiece_encoder()).select(*_PREPARED)


def _lengths(c: str) -> str:
    return f"list_transform(coalesce(regexp_extract_all({c}, '{_NWS}+'), []), lambda w: length(w)::INT)"


def _text(a: str) -> str:
    return f"array_to_string({a}, ',')"


_PREPARED_SQL = f"""(WITH e AS (SELECT qa_id, split, {_lengths("coalesce(context, '')")} AS c, {_lengths("coalesce(question, '')")} AS q, {_lengths("coalesce(answer, '')")} AS a FROM qa_v1 LEFT JOIN (SELECT source_id, min(split) AS split FROM splits WHERE source_id IS NOT NULL GROUP BY 1) USING (source_id)),
k AS (SELECT *, 255 - 3 - len(q) AS room, c[1:greatest(0, 255 - 3 - len(q) - len(a))] AS ck FROM e), z AS (SELECT *, CASE WHEN len(ck) + len(a) > room THEN a[1:greatest(1, room - len(ck))] ELSE a END AS ak FROM k),
i AS (SELECT *, list_concat([8], ck, [9], q, [7], ak, [3])[1:256] AS ids, least(3 + len(ck) + len(q), len(list_concat([8], ck, [9], q, [7], ak, [3])[1:256])) AS s FROM z)
SELECT qa_id, split, ids AS input_ids, list_transform(ids, lambda t, n: CASE WHEN n <= s THEN -100 ELSE t END) AS labels, len(ids) AS attention, len(c) AS original_context_tokens, len(a) AS original_answer_tokens,
  len(ck) AS prepared_context_tokens, len(ids) AS prepared_sequence_tokens, len(ids) - s AS answer_tokens_used FROM i)"""


@query(f"SELECT * EXCLUDE (split, input_ids, labels), {_text('input_ids')} AS input_ids, {_text('labels')} AS labels FROM {_PREPARED_SQL}")
def qa_prepared_words(spark, sf):
    # with word lengths for ids, which SQL can follow
    x = qa.prepared(_t(spark, sf, "qa_v1"), encoding.word_encoder).select(*_PREPARED)
    return x.select("qa_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "labels")], F.size("attention_mask").alias("attention"), *_PREPARED[4:])


@query(f"""SELECT k.split, count(input_ids) AS records, count_if(prepared_context_tokens < original_context_tokens) AS context_trimmed, count_if(answer_tokens_used < original_answer_tokens) AS answer_truncated, coalesce(max(prepared_sequence_tokens), 0) AS max_sequence_tokens,
  coalesce(sum(len(list_filter(labels, lambda l: l <> -100))), 0)::BIGINT AS supervised_tokens FROM (VALUES ('train'), ('validation'), ('test')) AS k(split) LEFT JOIN {_PREPARED_SQL} p USING (split) GROUP BY 1""")
def qa_prepared_summary(spark, sf):
    of = _t(spark, sf, "splits").where("source_id is not null").groupBy("source_id").agg(F.min("split").alias("split"))
    x = qa.prepared(_t(spark, sf, "qa_v1").join(of, "source_id"), encoding.word_encoder)
    return qa.summary(
        x, {"context_trimmed": F.expr("prepared_context_tokens < original_context_tokens").cast("int"), "answer_truncated": F.expr("answer_tokens_used < original_answer_tokens").cast("int"), "supervised_tokens": N.supervised(F.col("labels"))},
        {"max_sequence_tokens": F.col("prepared_sequence_tokens")})


@query()
def qa_answer_chunks(spark, sf):
    return qa.answer_chunks(_t(spark, sf, "qa_v1").select("qa_id", "answer"), ["qa_id"], "answer", encoding.sentencepiece_encoder())


# the fold over the parts of an answer: pieces of an oversized part but its last stand alone, all else is joined up to 40 words
_WORD_MOST = 40
_CHUNKS_SQL = f"""(WITH RECURSIVE p AS (SELECT qa_id, unnest(range(1, len(p) + 1)) AS part, unnest(p) AS t FROM (SELECT qa_id, {_clauses("coalesce(answer, '')")} AS p FROM qa_v1)),
w AS (SELECT qa_id, part, coalesce(regexp_extract_all(t, '{_NWS}+'), []) AS w FROM p), r AS (SELECT qa_id, part, w, unnest(range(0, (len(w) + {_WORD_MOST - 1}) // {_WORD_MOST})) AS run FROM w),
items AS (SELECT qa_id, array_to_string(w[run * {_WORD_MOST} + 1:(run + 1) * {_WORD_MOST}], ' ') AS t, CASE WHEN (run + 1) * {_WORD_MOST} >= len(w) THEN len(w) - run * {_WORD_MOST} END AS n, row_number() OVER (PARTITION BY qa_id ORDER BY part, run) AS i FROM r),
f AS (SELECT qa_id, 0::BIGINT AS i, []::VARCHAR[] AS chunks, []::VARCHAR[] AS held, 0::BIGINT AS used FROM qa_v1
  UNION ALL SELECT f.qa_id, items.i, CASE WHEN n IS NULL THEN list_append(chunks, t) WHEN len(held) > 0 AND used + n > {_WORD_MOST} THEN list_append(chunks, array_to_string(held, ' ')) ELSE chunks END,
    CASE WHEN n IS NULL THEN held WHEN len(held) > 0 AND used + n > {_WORD_MOST} THEN [t] ELSE list_append(held, t) END, CASE WHEN n IS NULL THEN used WHEN len(held) > 0 AND used + n > {_WORD_MOST} THEN n ELSE used + n END
  FROM f JOIN items ON items.qa_id = f.qa_id AND items.i = f.i + 1),
g AS (SELECT qa_id, arg_max(CASE WHEN len(held) > 0 THEN list_append(chunks, array_to_string(held, ' ')) ELSE chunks END, i) AS c FROM f GROUP BY qa_id)
SELECT * FROM (SELECT qa_id, unnest(range(0, len(c)))::INT AS chunk_index, len(c)::INT AS chunk_count, unnest(c) AS chunk FROM g) WHERE len(regexp_extract_all(chunk, '{_NWS}+')) >= 8)"""


def _word_chunks(spark, sf):
    return qa.answer_chunks(_t(spark, sf, "qa_v1").select("qa_id", "answer"), ["qa_id"], "answer", encoding.word_encoder, most=_WORD_MOST)


@query(f"SELECT * FROM {_CHUNKS_SQL}")
def qa_word_chunks(spark, sf):
    return _word_chunks(spark, sf).drop("answer_ids")


@query(f"""SELECT qa_id, chunk_index, {_text("list_concat(p, a[1:greatest(1, 255 - len(p))], [3])[1:256]")} AS input_ids, {_text("list_concat(list_transform(p, lambda x: -100), a[1:greatest(1, 255 - len(p))], [3])[1:256]")} AS labels
FROM (SELECT qa_id, chunk_index, list_concat([9], {_lengths("coalesce(question, '')")}, [7]) AS p, {_lengths("chunk")} AS a FROM {_CHUNKS_SQL} JOIN qa_v1 USING (qa_id))""")
def qa_word_chunk_sequences(spark, sf):
    x = _word_chunks(spark, sf).join(_t(spark, sf, "qa_v1").select("qa_id", "question"), "qa_id")
    x = qa.chunk_sequences(x, encoding.word_encoder, "question", "answer_ids")
    return x.select("qa_id", "chunk_index", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "labels")])


@query(f"SELECT qa_id, count(DISTINCT chunk_index) AS chunks FROM {_CHUNKS_SQL} GROUP BY qa_id HAVING min(chunk_index) <> 0 OR max(chunk_index) <> count(DISTINCT chunk_index) - 1")
def chunk_index_gaps(spark, sf):
    return qa.index_gaps(_word_chunks(spark, sf), "qa_id")


@query("SELECT unnest(['lengths_differ', 'too_long', 'prompt_supervised', 'answer_misaligned', 'no_end', 'last_supervised']) AS check, 0 AS n")
def sequence_checks(spark, sf):
    x = _word_chunks(spark, sf).join(_t(spark, sf, "qa_v1").select("qa_id", "question"), "qa_id").withColumn("question", F.coalesce("question", F.lit("")))
    x = qa.chunk_sequences(x, encoding.word_encoder, "question", "answer_ids").withColumn("prompt_length", T.word_count(F.col("question")) + 2)
    return qa.sequence_violations(x)


def _v2(spark, sf):
    x = qa.section_answers(_marked(spark, sf)).where(F.col("cleanup") == qa.EXTRACTED).withColumn("q", qa.v2_question(None))
    # the public model's unknown id is 0
    return qa.v2_sequences(x, encoding.sentencepiece_codec(), "q", "body", unk=0)


@query()
def qa_v2_sequences(spark, sf):
    return _v2(spark, sf).where("input_ids is not null").select("qa_id", "prompt_template", "prompt_length", "input_ids", "labels", "answer_tokens", "answer_truncation")


@query()
def qa_v2_outcomes(spark, sf):
    return qa.status_counts(_v2(spark, sf), "answer_truncation", (qa.WHOLE, qa.AT_SENTENCE, qa.AT_CAP, qa.NO_ROOM, qa.NO_ANSWER))


@query(r"""SELECT qa_id, i[1:100] = p AND NOT list_contains(p, 32767) AS whole_prompt, len(i) AS tokens, how FROM (SELECT qa_id, p, how, list_concat(p, a, [3]) AS i FROM (
  SELECT qa_id, p, CASE WHEN 255 - len(p) < 8 THEN 'prompt_too_long' WHEN length(t) < 8 THEN 'answer_too_short' WHEN length(t) <= m THEN 'complete' WHEN length(s) BETWEEN 8 AND m THEN 'sentence_boundary' ELSE 'hard_token_cap' END AS how,
    list_transform(string_split(CASE WHEN length(t) <= m THEN t WHEN length(s) BETWEEN 8 AND m THEN s ELSE left(t, m) END, ''), lambda c: unicode(c)) AS a
  FROM (SELECT *, trim(regexp_extract(left(t, m), '(?s)^.*[.!?]["”’'')\]]*(?:\s+|$)', 0)) AS s FROM (SELECT qa_id, t, p, greatest(0, least(160, 255 - len(p))) AS m FROM (
    SELECT qa_id, CLAUSE AS t, list_transform(string_split(left(coalesce(question, ''), 100) || ' Answer:', ''), lambda c: unicode(c)) AS p FROM qa_v1))))) WHERE how NOT LIKE '%too%'""".replace("CLAUSE", _collapse("coalesce(answer, '')")).replace("i[1:100] = p", "i[1:len(p)] = p"))
def qa_v2_characters(spark, sf):
    # code points stand in for tokens; none is unknown
    x = _t(spark, sf, "qa_v1").select("qa_id", F.left(F.coalesce("question", F.lit("")), F.lit(100)).alias("q"), T.collapse(F.coalesce("answer", F.lit(""))).alias("a"))
    x = qa.v2_sequences(x, encoding.character_codec, "q", "a", unk=32767).where("input_ids is not null")
    whole = (N.unknown_count(F.col("input_ids"), F.col("prompt_length"), 32767) == 0) & (F.col("prompt_length") == F.length("prompt_template"))
    return x.select("qa_id", whole.alias("whole_prompt"), F.size("input_ids").alias("tokens"), F.col("answer_truncation").alias("how"))


@query("SELECT qa_id, row_number() OVER (ORDER BY source_id NULLS FIRST, question_type NULLS FIRST, qa_id) AS ord FROM qa_v1")
def qa_order(spark, sf):
    return qa.ordered(_t(spark, sf, "qa_v1").select("qa_id", "source_id", "question_type"), "qa_id").select("qa_id", F.col("ord").cast("long").alias("ord"))


@query("SELECT qa_id, question FROM qa_v1 ORDER BY qa_id LIMIT 5")
def first_samples(spark, sf):
    return qa.first_rows(_t(spark, sf, "qa_v1").select("qa_id", "question"), "qa_id", 5)


@query(f"SELECT row_id, coalesce(nullif(source_publisher, ''), state) AS jurisdiction, {_text(_lengths('text'))} AS tokens FROM splits WHERE coalesce({_strip('text')}, '') <> ''")
def tokenized_records(spark, sf):
    x = encoding.encoded_records(_t(spark, sf, "splits"), encoding.word_encoder, ["row_id"], "source_publisher")
    return x.withColumn("tokens", F.array_join(F.col("tokens").cast("array<string>"), ","))


_LABELS = f"(SELECT qa_id, list_transform(coalesce(regexp_extract_all(question, '{_NWS}+'), []), lambda w: length(w)::INT) AS p, list_transform(coalesce(regexp_extract_all(answer, '{_NWS}+'), []), lambda w: length(w)::INT) AS a FROM qa_v1)"


def _parts(spark, sf):
    # stand-in ids: the lengths of words
    return _t(spark, sf, "qa_v1").select("qa_id", F.transform(T.words(F.col("question")), F.length).alias("p"), F.transform(T.words(F.col("answer")), F.length).alias("a"))


@query(f"SELECT qa_id, array_to_string(list_concat(list_transform(p, lambda x: -100), a, [3]), ',') AS labels FROM {_LABELS}")
def label_masks_v1(spark, sf):
    return _parts(spark, sf).select("qa_id", F.array_join(N.labels_aligned(F.col("p"), F.col("a")).cast("array<string>"), ",").alias("labels"))


@query(f"SELECT qa_id, array_to_string(list_concat(list_transform(p[2:], lambda x: -100), a, [3, -100]), ',') AS labels FROM {_LABELS}")
def label_masks_v2(spark, sf):
    return _parts(spark, sf).select("qa_id", F.array_join(N.labels_shifted(F.col("p"), F.col("a")).cast("array<string>"), ",").alias("labels"))


@query(f"""WITH s AS (SELECT qa_id, list_concat(p, a, [3]) AS ids, (row_number() OVER (ORDER BY qa_id) - 1) // 8 AS batch_no FROM {_LABELS}), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_no) AS w FROM s)
SELECT qa_id, batch_no, array_to_string(list_resize(ids, w, 0), ',') AS input_ids, w AS width FROM w""")
def padded_batches(spark, sf):
    x = _parts(spark, sf).select("qa_id", N.sequence(F.col("p"), F.col("a")).alias("input_ids"), N.labels_aligned(F.col("p"), F.col("a")).alias("labels"))
    return packing.padded_batches(x, ["qa_id"], 8).select("qa_id", "batch_no", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), F.size("attention_mask").alias("width"))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_concat(coalesce(regexp_extract_all(text, '{_NWS}+'), []), ['</s>'])) AS w, generate_subscripts(list_concat(coalesce(regexp_extract_all(text, '{_NWS}+'), []), ['</s>']), 1) AS i FROM documents),
g AS (SELECT w, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM t),
b AS (SELECT pos // 256 AS block_no, pos, w FROM g UNION ALL SELECT pos // 256 - 1, pos, w FROM g WHERE pos % 256 = 0 AND pos > 0),
x AS (SELECT block_no, list(w ORDER BY pos) AS a FROM b GROUP BY block_no HAVING count(*) = 257)
SELECT block_no, array_to_string(a[1:256], ' ') AS input_ids, array_to_string(a[2:257], ' ') AS targets FROM x""")
def packed_blocks(spark, sf):
    x = packing.packed(_t(spark, sf, DOCS).select("doc_id", T.words(F.col("text")).alias("tokens")), ["doc_id"], "tokens", 256, "</s>")
    return x.select("block_no", F.array_join("input_ids", " ").alias("input_ids"), F.array_join("targets", " ").alias("targets"))


# Metrics

@query("SELECT event_type, count(value) AS batches, round(avg(value / 10), 6) AS mean_loss, round(exp(least(avg(value / 10), 20)), 4) AS perplexity FROM events GROUP BY event_type")
def loss_to_perplexity(spark, sf):
    return metrics.mean_losses(_t(spark, sf, "events").withColumn("loss", F.col("value") / 10), ["event_type"])


@query("SELECT event_type, arg_min(event_id, struct_pack(v := value, e := event_id)) AS event_id, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def best_epoch(spark, sf):
    return metrics.best_step(_t(spark, sf, "events"), ["event_type"], "event_id", "value")


@query("""SELECT event_id, user_id, value, least(value, min(value) OVER w) AS best_loss, coalesce(value < min(value) OVER w, value IS NOT NULL) AS improved
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_best(spark, sf):
    return metrics.running_best(_t(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")


@query("""SELECT event_id, user_id, value, n, running_loss FROM (SELECT event_id, user_id, value, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS o,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS running_loss FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR n % 100 = 0 OR n = o""")
def progress_rows(spark, sf):
    return metrics.running_mean(_t(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")


@query("SELECT name, regexp_extract(name, 'resume_step_([0-9]+)[.]pt$', 1)::BIGINT AS step FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'best.pt' ELSE 'resume_step_' || event_id || '.pt' END AS name FROM events) WHERE name LIKE 'resume%' ORDER BY step DESC LIMIT 5")
def checkpoint_retention(spark, sf):
    names = _t(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, "best.pt").otherwise(F.concat(F.lit("resume_step_"), F.col("event_id").cast("string"), F.lit(".pt"))).alias("name"))
    return metrics.newest_checkpoints(names)


@query("SELECT i AS step, round(0.0001 * (1 + cos(pi() * i / 75)) / 2, 10) AS learning_rate FROM range(75) AS r(i)")
def learning_rate_schedule(spark, sf):
    return metrics.schedule(spark, 100, 3, 1e-4).withColumn("learning_rate", F.round("learning_rate", 10))


@query("""WITH l AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i <= 2 THEN x::DOUBLE / 0.8 / 1.2 ELSE x::DOUBLE / 0.8 END) AS x FROM embeddings), k AS (SELECT vec_id, x, list_reverse_sort(x)[8] AS t FROM l),
e AS (SELECT vec_id, list_transform(x, lambda v: CASE WHEN v >= t THEN exp(v - list_max(x)) ELSE 0 END) AS e FROM k)
SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top, len(list_filter(e, lambda v: v > 0)) AS kept FROM e""")
def softmax_topk_filter(spark, sf):
    x = metrics.generation_step(_t(spark, sf, "embeddings").withColumn("seen", F.array(F.lit(0), F.lit(1))), "embedding", "seen", 0.8, 1.2, 8)
    return x.select("vec_id", F.round(F.array_max("probs"), 6).alias("top"), F.size(F.filter("probs", lambda p: p > 0)).alias("kept"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.n_embd'), json_extract_string(props, '$.k'), '384') AS width, coalesce(json_extract_string(props, '$.block_size'), '256') AS block FROM events")
def config_aliases(spark, sf):
    p = F.col("props")
    return _t(spark, sf, "events").select("event_id", nested.resolved(p, ["n_embd", "k"], "384").alias("width"), nested.resolved(p, ["block_size"], "256").alias("block"))


@query("""SELECT unnest(map_keys(m)) AS prompt, unnest(map_values(m)) AS sample FROM (SELECT map_from_entries(list((question, a) ORDER BY o)) AS m FROM (
  SELECT question, arg_max(answer, qa_id) AS a, min(qa_id) AS o FROM (SELECT * FROM qa_v1 WHERE question IS NOT NULL ORDER BY qa_id LIMIT 5) GROUP BY question))""")
def prompt_samples(spark, sf):
    return nested.sample_map(_t(spark, sf, "qa_v1"), "question", "answer", "qa_id", 5).select(F.explode("samples").alias("prompt", "sample"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS seconds FROM events")
def instants(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return _t(spark, sf, "events").select("event_id", nested.iso_utc(ts).alias("at"), F.round(nested.elapsed(F.lit("2024-01-01 00:00:00").cast("timestamp"), ts), 6).alias("seconds"))


@query("SELECT n, array_to_string(list_transform(range(1, n + 1), lambda i: array_to_string(list_transform(range(1, n + 1), lambda j: CASE WHEN j <= i THEN 1 ELSE 0 END), '')), '/') AS mask FROM (SELECT unnest(range(1, 17)) AS n)")
def causal_masks(spark, sf):
    m = N.causal_mask(F.col("n"))
    return spark.range(1, 17).select(F.col("id").cast("int").alias("n")).select("n", F.array_join(F.transform(m, lambda r: F.array_join(F.transform(r, lambda x: x.cast("int").cast("string")), "")), "/").alias("mask"))


@query("""SELECT vec_id, round(ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[l + 1], 6) AS loss, round(list_max(list_transform(x, lambda v: (v - m) / sqrt(d + 1e-5))), 5) AS top,
  least(63, len(list_filter(range(1, 65), lambda i: list_sum(list_transform(x[1:i], lambda v: exp(v))) / list_sum(list_transform(x, lambda v: exp(v))) <= u))) AS drawn
FROM (SELECT *, list_avg(x) AS m, list_var_pop(x) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS x, vec_id % 64 AS l, (vec_id % 97) / 97.0::DOUBLE AS u FROM embeddings))""")
def position_losses(spark, sf):
    x, label = F.col("embedding").cast("array<double>"), (F.col("vec_id") % 64).cast("int")
    draw = N.drawn(N.softmax(x), (F.col("vec_id") % 97) / F.lit(97.0))
    return _t(spark, sf, "embeddings").select(
        "vec_id", F.round(N.cross_entropy(x, label), 6).alias("loss"), F.round(F.array_max(N.layer_norm(x)), 5).alias("top"), draw.cast("long").alias("drawn"))


@query(f"SELECT sum(len(list_filter(list_concat(list_transform(p, lambda x: -100), a, [3]), lambda l: l <> -100)))::BIGINT AS supervised, count(*) AS rows FROM {_LABELS}")
def supervised_tokens(spark, sf):
    x = _parts(spark, sf).select(N.labels_aligned(F.coalesce("p", F.array().cast("array<int>")), F.coalesce("a", F.array().cast("array<int>"))).alias("l"))
    return x.agg(F.sum(N.supervised(F.col("l"))).alias("supervised"), F.count("*").alias("rows"))


# Sources, sinks and streams: what is written comes back

_QA_FIELDS = ("question", "context", "answer", "section", "act_id", "source_id", "question_type")


@query(f"SELECT {', '.join(_QA_FIELDS)} FROM qa_v1")
def jsonl_round_trip(spark, sf):
    path = table_path(spark, "jsonl")
    files.write_jsonl(_t(spark, sf, "qa_v1").select(*_QA_FIELDS), path)
    return files.read_jsonl(spark, path, "qa_v1")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 50) GROUP BY 1")
def jsonl_append(spark, sf):
    path, e = table_path(spark, "append"), _t(spark, sf, "events").select("event_id", "event_type")
    files.write_jsonl(e, path)
    files.write_jsonl(_t(spark, sf, "events").where("value > 50").select("event_id", "event_type"), path, append=True)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id::INT AS epoch, count(*) AS step, round(avg(value), 6) AS train_loss FROM events WHERE user_id < 100 GROUP BY 1")
def history_document(spark, sf):
    path = table_path(spark, "history")
    h = _t(spark, sf, "events").where("user_id < 100").groupBy(F.col("user_id").cast("int").alias("epoch")).agg(F.count("*").alias("step"), F.round(F.avg("value"), 6).alias("train_loss"))
    files.write_report(h, path, "history")
    return files.read_history(spark, path).select("epoch", "step", "train_loss")


@query("SELECT split, count(*) AS n, sum(row_id)::BIGINT AS ids FROM splits GROUP BY split")
def split_files(spark, sf):
    path = table_path(spark, "splits")
    files.write_splits(_t(spark, sf, "splits").select("row_id", "split"), path, files=4)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("SELECT row_id, split AS jurisdiction, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS source_ord FROM splits")
def jurisdiction_files(spark, sf):
    root = table_path(spark, "jurisdictions")
    for s in qa.SPLITS:
        _t(spark, sf, "splits").where(F.col("split") == s).select("row_id").write.parquet(f"{root}/in_{s}_legislation.parquet")
    return files.read_jurisdictions(spark, root, list(qa.SPLITS))


def _stream(spark, df, name):
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), table_path(spark, f"{name}-out"), table_path(spark, f"{name}-checkpoint")


@query("SELECT DISTINCT source FROM documents")
def stream_dedup(spark, sf):
    stream, out, checkpoint = _stream(spark, _t(spark, sf, DOCS).select("source"), "dedup")
    jobs.write_available(jobs.deduplicated(stream, ["source"]), out, checkpoint)
    return spark.read.parquet(out)


@query(f"""WITH t AS (SELECT user_id::VARCHAR AS key, unnest([(value * 10)::INT, 3]) AS w, event_id, generate_subscripts([1, 2], 1) AS i FROM events WHERE value IS NOT NULL),
g AS (SELECT key, w, row_number() OVER (PARTITION BY key ORDER BY event_id, i) - 1 AS pos FROM t), b AS (SELECT key, pos // 8 AS block_no, pos, w FROM g UNION ALL SELECT key, pos // 8 - 1, pos, w FROM g WHERE pos % 8 = 0 AND pos > 0)
SELECT key, block_no, array_to_string(list(w ORDER BY pos)[1:8], ',') AS input_ids, array_to_string(list(w ORDER BY pos)[2:9], ',') AS targets FROM b GROUP BY key, block_no HAVING count(*) = 9""")
def stream_packing(spark, sf):
    e = _t(spark, sf, "events").where("value is not null").select("user_id", "event_id", F.array(F.bround(F.col("value") * 10).cast("int")).alias("t"))
    stream, out, checkpoint = _stream(spark, e, "packing")
    jobs.write_available(jobs.packed(stream, "user_id", "t", 8, 3, "event_id"), out, checkpoint)
    return spark.read.parquet(out).select("key", "block_no", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "targets")])


@query("SELECT event_id, event_type FROM events")
def stream_append(spark, sf):
    stream, out, checkpoint = _stream(spark, _t(spark, sf, "events").select("event_id", "event_type"), "append")
    jobs.write_available(stream, out, checkpoint)
    return spark.read.parquet(out)
