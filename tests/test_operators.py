"""Fixtures of the operators' edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import nested, numbers as N, text as T
from corpusloom.operators import answers, chunks, corpus, encoding, metrics, packing, qa, retrieval
from corpusloom.operators.ordering import first_wins, ranked


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("given, want", [
    ("a\xa0b c\x85d\x1ce\xadf", "a b c d ef"), ("  x , y ; z !  ", "x, y; z!"), ("", ""), ("　 ", ""),
])
def test_clean_corpus(spark, given, want):
    assert one(spark, given, T.clean_corpus) == want


def test_strings(spark):
    assert one(spark, "éclair 12ab rule of law", T.tokens) == ["clair", "ab", "rule", "law"]
    assert one(spark, "the rule of law", T.terms) == ["rule", "law", "rule law"]
    assert one(spark, "of", T.terms) == []
    assert one(spark, " a b\tc ", T.word_count) == 3 and one(spark, None, T.word_count) == 0
    assert one(spark, "a\tb\n\n\n\nc\xad", T.clean_page) == "a b\n\nc"
    assert one(spark, "l i mitation . i t", T.clean_answer) == "limitation. it"
    long = "x" * 50
    assert one(spark, f"{long}; (a) {long}. b. {long}", T.clauses) == [f"{long}; (a)", f"{long}. b.", long]


@pytest.mark.parametrize("text, bad", [
    ("Collecto~ of dues", True), ("the pow,, of", True), ("bro- ken", True), ("see R,qistered deed", True), ("a .. ,, .. b", True), ("x � y", True),
    ("A B C D and ab_c", True), ("ab1cd only", False), ("yes yes yes", True), ("| " * 8, True), ("<br <br <br <br", True), ("k" + "abcdefghij" * 4 + "abcdefghij" * 4, True), ("A clean sentence.", False), (None, False),
])
def test_ocr_corrupt(spark, text, bad):
    assert one(spark, text, T.ocr_corrupt) is bad


@pytest.mark.parametrize("values, p, want", [([1, 2], 0.5, 1), ([1, 2, 3, 4], 0.5, 3), ([1, 2, 3, 4, 5, 6], 0.5, 3), ([5], 0.99, 5), ([], 0.5, None)])
def test_nearest_rank(spark, values, p, want):
    # index round((n - 1) p), half to even: 0, 2, 2
    assert one(spark, values, lambda c: N.nearest_rank(c, p), "array<int>") == want


def test_length_summary_matches_rows(spark):
    values = [random.Random(4).randint(0, 60) for _ in range(501)]
    got = qa.length_summary(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    ordered = sorted(values)
    assert (got["count"], got["min"], got["max"]) == (501, min(values), max(values))
    assert [got[k] for k in ("median", "p90", "p95", "p99")] == [ordered[round(500 * p)] for p in (0.5, 0.9, 0.95, 0.99)]
    assert qa.length_summary(spark.createDataFrame([], "v int"), "v").first()["count"] == 0


def test_masks(spark):
    df = spark.createDataFrame([([7, 8, 9], [1, 2])], "p array<int>, a array<int>")
    got = df.select(N.labels_aligned(F.col("p"), F.col("a")), N.labels_shifted(F.col("p"), F.col("a")), N.sequence(F.col("p"), F.col("a"))).first()
    assert list(got) == [[-100, -100, -100, 1, 2, 3], [-100, -100, 1, 2, 3, -100], [7, 8, 9, 1, 2, 3]]


def greedy(rows):
    a, b, out = set(), set(), {}
    for o, x, y in sorted(rows):
        out[o] = "duplicate_id" if x in a else "duplicate_text" if y in b else "kept"
        if out[o] == "kept":
            a.add(x)
            b.add(y)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_dedup(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"i{r.randint(0, 8)}", f"h{r.randint(0, 8)}") for i in range(40)] if seed else [(1, "i1", "h1"), (2, "i2", "h1"), (3, "i2", "h2")]
    got = corpus.greedy_dedup(spark.createDataFrame(rows, "o int, a string, b string"), "a", "b", "o")
    assert {x["o"]: x["status"] for x in got.collect()} == greedy(rows)


def test_greedy_dedup_of_long_chains(spark):
    # neighbours share one key or the other, so each row hangs on the one before
    rows = [(i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(2000)] + [(5000 + i, "hot", f"x{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "o long, a string, b string")
    assert {x["o"]: x["status"] for x in corpus.greedy_dedup(df, "a", "b", "o").collect()} == greedy(rows)
    pairs = df.where("o < 60 or o >= 5000")
    kept = {x["o"] for x in corpus.greedy_kept(pairs, rounds=1, component_rows=20).collect()}  # components over the bound get rounds
    assert kept == {o for o, s in greedy([tuple(x) for x in pairs.collect()]).items() if s == "kept"}
    assert corpus.greedy_dedup(df.limit(0), "a", "b", "o").count() == 0


def test_ids_are_stripped_before_they_are_compared(spark):
    rows = [(1, "A ", " 1", "word " * 50), (2, "A", "1", "other " * 50), (3, "None", "1", "third " * 50), (4, None, "1 ", "fourth " * 50)]
    out = corpus.clean_outcomes(spark.createDataFrame(rows, "o int, act_id string, section_number string, text string").withColumn("source_url", F.lit("u")), "o")
    assert {r["o"]: r["status"] for r in out.collect()} == {1: "kept", 2: "duplicate_id", 3: "kept", 4: "duplicate_id"}


def test_clean_outcomes(spark):
    t = "word " * 50
    rows = [(1, "A", "1", t, "u"), (2, "A", "1", "short", "u"), (3, "A", "1", t + "x", "u"), (4, "B", "2", t, "u"), (5, "C", "", t + "y", " "), (6, "C", "", t + "z", "u"), (7, None, None, None, None)]
    out = corpus.clean_outcomes(spark.createDataFrame(rows, "o int, act_id string, section_number string, text string, source_url string"), "o")
    assert {r["o"]: r["status"] for r in out.collect()} == {1: "kept", 2: "too_short", 3: "duplicate_id", 4: "duplicate_text", 5: "kept", 6: "duplicate_id", 7: "too_short"}
    assert {r[0]: r[1] for r in corpus.outcome_counts(out).collect()} == {"input": 7, "kept": 2, "duplicate_id": 2, "duplicate_text": 1, "too_short": 2, "missing_source": 1}


def test_length_boundary(spark):
    rows = [(1, "a" * 198 + "𝒳"), (2, "a" * 199 + "𝒳")]
    df = corpus.cleaned(spark.createDataFrame(rows, "o int, text string")).where(F.length("text") >= corpus.MIN_CHARS)
    assert [r["o"] for r in df.collect()] == [2]


@pytest.mark.parametrize("n", [1, 19, 20, 39, 100])
def test_split_sizes(spark, n):
    got = {r[0]: r[1] for r in corpus.hash_split(spark.range(n), "id").groupBy("split").count().collect()}
    assert [got.get(s, 0) for s in ("train", "validation", "test")] == [int(n * 0.9), int(n * 0.05), n - int(n * 0.9) - int(n * 0.05)]


def test_ordering(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, v int")
    got = ranked(df, ["k"], "n", F.col("v"), "upto").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 51))
    assert got[-1]["upto"] == sum(range(50)) and got[0]["upto"] == got[0]["v"]
    first = first_wins(spark.createDataFrame([(2, None, "b"), (1, None, "a"), (3, "x", None)], "o int, k string, v string"), ["k"], "o")
    assert sorted((r["o"], r["v"]) for r in first.collect()) == [(1, "a"), (3, None)]


@pytest.mark.parametrize("length, n", [(1200, 1), (1201, 2), (2250, 2), (2251, 3)])
def test_window_edges(spark, length, n):
    got = chunks.windows(spark.createDataFrame([(1, "x" * length)], "id int, t string"), ["id"], "t").collect()
    assert len(got) == n and max(r["character_count"] for r in got) == 1200


def test_chunk_pages(spark):
    pages = [("f", 1, "1. First title.— Body of one."), ("f", 2, "More of one."), ("f", 3, "End of one.\n2. Second.— Body of two."), ("f", 4, "  \n"), ("f", 5, None)]
    got = chunks.chunk_pages(spark.createDataFrame(pages, "source_file string, page_number int, text string")).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["page_number"], r["section_number"]) for r in got] == [("contract_00001", 1, "1"), ("contract_00002", 2, "1"), ("contract_00003", 3, "1"), ("contract_00004", 3, "2")]


def test_a_section_goes_on_in_the_next_file(spark):
    pages = [("f", 1, "1. First\n title.— Body of one."), ("g", 1, "Text before any heading.\n2A. Second.— Body of two."), ("a", 1, "Text of no section.")]
    got = chunks.chunk_pages(spark.createDataFrame(pages, "source_file string, page_number int, text string")).orderBy("chunk_id").collect()
    assert [(r["source_file"], r["section_number"], r["section_title"]) for r in got] == [("a", None, None), ("f", "1", "First\n title."), ("g", "1", "First\n title."), ("g", "2A", "Second.")]


def test_headings_against_python(spark, sf):
    import re

    rows = spark.read.parquet(f"{sf}/indian_contract_act_1872_chunks.parquet").select("chunk_id", "text").where("text is not null").collect()
    rows = [(r[0], r[1]) for r in rows] + [("x", "1. One - body\n 2. Two\n3. Three— rest\n\n 4A.  Four\nlines – end 5. no — dash"), ("y", "7. " + "t" * 301 + "— x"), ("z", "7. " + "t" * 300 + "— x")]
    want = {(k, i, m[1], m[2].strip()) for k, t in rows for i, m in enumerate(re.finditer(chunks.HEADING, t))}
    got = chunks.headings(spark.createDataFrame(rows, "chunk_id string, text string"), ["chunk_id"], "text")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_carried_over_partitions(spark):
    rows = [(g, i, v) for g in ("a", None, "b") for i, v in enumerate([None, "x", None, None, "y", None] * 20)]
    got = chunks.carried(spark.createDataFrame(rows, "g string, i int, v string").repartition(7), "v", ["i"], ["g"], "now").collect()
    assert len(got) == len(rows)
    for r in got:
        k = r["i"] % 6
        assert r["now"] == ("y" if k == 0 and r["i"] else None if r["i"] == 0 else "x" if k < 4 else "y")


def test_search(spark):
    rows = [("c1", "10", "What agreements are contracts", "All agreements are contracts if made by free consent."), ("c2", "25", "Void", "An agreement without consideration is void."),
            ("c3", "13", "Consent", "Consent is agreeing."), ("c4", "14", "Free consent", "Consent is free when there is no fraud."), ("c5", None, None, None), ("c6", "99", "Other", "Nothing here at all.")]
    df = spark.createDataFrame(rows, "chunk_id string, section_number string, section_title string, text string")
    cases = spark.createDataFrame([(1, "Is an agreement without consideration valid?", ["25"]), (2, "What is free consent?", ["13", "14"]), (3, "zzz unknown", ["1"]), (4, "", ["1"])], "qid int, query string, expected_sections array<string>")
    hits = retrieval.search(cases, df)
    top = {r["qid"]: r["chunk_id"] for r in hits.where("rank = 1").collect()}
    assert top == {1: "c2", 2: "c4"}
    assert retrieval.hit_rates(hits, cases, df).first()["hit_1"] == 0.5
    with pytest.raises(ValueError):
        retrieval.search(cases, df, top_k=0)


def test_unknown_term_counts_in_total(spark):
    index = retrieval.build_index(spark.createDataFrame([("a", "law order")], "k string, t string"), "k", F.col("t"))
    q = spark.createDataFrame([(1, "law zebra")], "qid int, query string")
    got = {r["term"]: r["weight"] for r in retrieval.query_terms(q, retrieval.concept_table(spark), index).collect()}
    assert set(got) == {"law"} and got["law"] == pytest.approx(1 / 3)  # law, zebra and their pair count


def test_answers(spark):
    hits = [(1, "c1", 3.3605, 2, "25", "Void", 18, "25. Void.— Second."), (1, "c0", 3.4562, 1, "25", "Void", 17, "25. Void.— An  agreement ."), (1, "c2", 1.1, 3, "19", None, 12, "Plain."), (1, "c3", 5.0, 4, "1", "Index ", 1, "x")]
    h = spark.createDataFrame(hits, "qid int, chunk_id string, score double, rank int, section_number string, section_title string, page_number int, text string")
    q = spark.createDataFrame([(1, "q"), (2, "r")], "qid int, query string")
    got = {r["qid"]: r for r in answers.grounded(q, h).collect()}
    assert [s["section"] for s in got[1]["sources"]] == ["25", "19"] and got[1]["sources"][0]["score"] == 3.4562 and got[1]["unique_source_count"] == 2 and got[1]["grounded"]
    assert got[1]["answer"] == "Section 25 (Void) provides: An agreement."
    assert got[2]["answer"] == answers.NOTHING and not got[2]["grounded"] and got[2]["sources"] == []
    text = {r["qid"]: r["context"] for r in answers.context(q, h, 2).collect()}
    assert text[1].count("[Source ") == 2 and "Page: 17" in text[1] and answers.NO_CONTEXT in text[2] and text[2].endswith(answers.INSTRUCTION[2])


def test_takes():
    assert qa.takes({"train": 10, "validation": 1, "test": 1}, 100) == {"train": 10, "validation": 1, "test": 1}
    assert qa.takes({"train": 90, "validation": 5, "test": 5}, 10) == {"train": 10, "validation": 0, "test": 0}  # 9, then 0.5 twice to even, left-over to train
    assert sum(qa.takes({"train": 7, "validation": 7, "test": 7}, 10).values()) == 10


def test_examples(spark):
    rows = [(1, "train", " A ", "1", "Title", "text  here", "s1"), (2, "train", "A", "", "Untitled Section", "other", "s2"), (3, "test", "A", "2", None, None, "s3")]
    df = spark.createDataFrame(rows, "row_id int, split string, act_id string, section_number string, section_title string, text string, text_sha256 string")
    got = qa.provision_examples(df, ["row_id", "split"]).collect()
    assert sorted((r["row_id"], r["question_type"]) for r in got) == [(1, "section_provision"), (1, "title_provision"), (2, "section_provision")]
    assert {r["source_id"] for r in got} == {"A:1:s1", "A:N/A:s2"}
    assert [r["row_id"] for r in qa.attached(spark.createDataFrame(got), df.withColumn("act_id", F.trim("act_id"))).collect()] == [1, 1]  # no section, no match


def test_packing(spark):
    for size in (2, 4):
        rows = [(i, list(range(100 * i, 100 * i + n))) for i, n in enumerate((0, 1, 5, 3, 9))] + [(9, None)]
        stream = [t for _, r in rows if r is not None for t in [*r, -1]]
        want = [(b, stream[b * size : b * size + size], stream[b * size + 1 : b * size + size + 1]) for b in range((len(stream) - 1) // size)]
        got = packing.packed(spark.createDataFrame(rows, "id int, t array<int>"), ["id"], "t", size, -1)
        assert sorted((r["block_no"], r["input_ids"], r["targets"]) for r in got.collect()) == want


def test_answer_chunks_cut_oversized_parts(spark):
    # the last piece of an oversized part is joined with what stands around it; the others come first
    assert qa.filled([("a b", 2), ("c d e", None), ("f g", 2), ("h", 1)], 3) == ["c d e", "a b", "f g h"]
    assert qa.filled([], 3) == [] and qa.filled([("x", 9)], 3) == ["x"] and qa.filled([("x", None)], 3) == ["x"]
    assert qa.word_pieces([1] * 5, [1] * 5, 3) == [(0, 3), (3, 5)] and qa.word_pieces([9, 1], [9, 1], 3) == [(0, 1), (1, 2)]
    part = lambda n, c: " ".join([c * 5] * n)
    text = f"{part(9, 'a')}; {part(25, 'b')}; {part(9, 'c')}. {part(2, 'd')}"
    got = qa.answer_chunks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "few words.")], "i int, t string"), ["i"], "t", encoding.word_encoder, most=20).collect()
    assert [(r["chunk_index"], r["chunk"]) for r in got] == [(0, part(20, "b")), (1, f"{part(9, 'a')}; {part(5, 'b')};"), (2, f"{part(9, 'c')}. {part(2, 'd')}")] and {r["chunk_count"] for r in got} == {3}


@pytest.mark.parametrize("answer, status", [
    ("nothing marked", qa.MARKER_NOT_FOUND), ("Section 5:  ", qa.BODY_EMPTY), ("Section 5: cut here without end 6. Next provision", qa.INCOMPLETE),
    ("Section 5: a Collecto~ of many rupees and more words.", qa.CORRUPT), ("Section 5: short.", qa.TOO_SHORT), ("Section 5: long enough body that goes on. Section 4 : metadata", qa.RESIDUAL),
    ("Section : 5 : The officer shall keep all ofthe records. 6. Next", qa.EXTRACTED), (None, qa.MARKER_NOT_FOUND),
    ("Section 5: The officer 5. The officer shall keep all of the records.", qa.EXTRACTED),
])
def test_section_answers(spark, answer, status):
    got = qa.section_answers(spark.createDataFrame([(answer, "5")], "answer string, section string")).first()
    assert got["cleanup"] == status and (got["body"] != "") == (status == qa.EXTRACTED)
    if status == qa.EXTRACTED:
        assert got["body"] == "The officer shall keep all of the records."


def test_section_answers_up_to_the_next_provision(spark):
    rows = [(1, "Section 5: The officer shall keep **5.** A 4. An all of the records. Section 12: The officer"), (2, "Section 5: The officer shall keep **Keeping.** And all of the records: Section 60 : x **7**. Next one")]
    got = {r["i"]: r["body"] for r in qa.section_answers(spark.createDataFrame(rows, "i int, answer string").withColumn("section", F.lit("5"))).collect()}
    assert got == {1: "The officer shall keep **5.** A 4. An all of the records.", 2: "The officer shall keep And all of the records:"}


def test_section_bodies_of_odd_sections(spark):
    rows = [(1, "Section 5(a)\\E[: body of it.", "5(a)\\E["), (2, "x Section 5A : own text. 5. Not above 6B. Next", " 5A "), (3, "Section None: kept 7. Next", None), (4, "Section ५: अपना पाठ। ends. ६. Next", "५"),
            (5, f"Section 9: a. {'9' * 40}. Next", "9"), (6, "sectionS 5: no. SECTION 5: yes 𝒳𝒳. Section 6: next", "5")]
    got = {r["i"]: (r["cleanup"], r["body"]) for r in qa.section_bodies(spark.createDataFrame(rows, "i int, answer string, section string")).collect()}
    assert got == {1: ("", "body of it."), 2: ("", "own text. 5. Not above"), 3: ("", "kept 7. Next"), 4: ("", "अपना पाठ। ends."), 5: ("", "a."), 6: ("", "yes 𝒳𝒳.")} | {2: (qa.INCOMPLETE, "")}


def test_prepared_and_violations(spark):
    words = lambda n, c: " ".join([c] * n)
    rows = [(1, words(4, "qq"), words(300, "ccc"), words(20, "a")), (2, words(250, "q"), "c", words(50, "a")), (3, "q", "", ""), (4, None, None, None)]
    df = spark.createDataFrame(rows, "i int, question string, context string, answer string")
    got = qa.prepared(df, encoding.word_encoder).withColumn("prompt_length", F.col("prepared_sequence_tokens") - F.col("answer_tokens_used"))
    rows = {r["i"]: r for r in got.collect()}
    # context, question, answer; the headings are words of 8, 9 and 7 letters
    assert rows[1]["input_ids"] == [8, *[3] * 228, 9, 2, 2, 2, 2, 7, *[1] * 20, 3] and rows[1]["answer_tokens_used"] == 21 and rows[1]["prepared_context_tokens"] == 228
    assert rows[2]["input_ids"] == [8, 9, *[1] * 250, 7, 1, 1, 3] and rows[2]["labels"][253:] == [1, 1, 3] and rows[3]["input_ids"] == [8, 9, 1, 7, 3] and rows[4]["input_ids"] == [8, 9, 7, 3]
    assert all(r["n"] == 0 for r in qa.sequence_violations(got).collect())
    chunked = qa.chunk_sequences(spark.createDataFrame([("q r", [5] * 300), (None, [4])], "q string, a array<int>"), encoding.word_encoder, "q", "a").collect()
    assert chunked[0]["input_ids"] == [9, 1, 1, 7, *[5] * 251, 3] and chunked[1]["labels"] == [-100, -100, 4, 3]
    shifted = spark.createDataFrame([([1, 2, 8, 9, 3], [-100, 8, 9, 3, -100], [1] * 5, 2)], "input_ids array<int>, labels array<int>, attention_mask array<int>, prompt_length int")
    assert all(r["n"] == 0 for r in qa.sequence_violations(shifted, shifted=True).collect())


def test_v2_sequences(spark):
    end = "A sentence that ends here. And one that does not end within the cap of characters " + "x" * 200
    rows = [(1, "q", "Plain answer."), (2, "q", end), (3, "q", "y" * 300), (4, "z" * 300, "Plain answer."), (5, "q", "short"), (6, "q", None), (7, "q:", "Plain answer.")]
    df = spark.createDataFrame(rows, "i int, q string, a string")
    got = {r["i"]: r for r in qa.v2_sequences(df, encoding.character_codec, "q", "a", unk=ord(":")).collect()}
    assert {i: r["answer_truncation"] for i, r in got.items()} == {1: qa.WHOLE, 2: qa.AT_SENTENCE, 3: qa.AT_CAP, 4: qa.NO_ROOM, 5: qa.NO_ANSWER, 6: qa.NO_ANSWER, 7: qa.WHOLE}
    assert got[1]["prompt_template"] == "q Answer" and got[7]["prompt_template"] == "q: Answer:"  # the first ending without an unknown token, else the first
    assert got[2]["answer_tokens"] == 26 and got[3]["answer_tokens"] == 160 and got[4]["input_ids"] is None
    assert got[1]["labels"] == [-100] * 7 + [ord(c) for c in "Plain answer."] + [3, -100] and got[1]["prompt_length"] == 8
    with pytest.raises(Exception, match="no room"):
        qa.v2_sequences(df, encoding.character_codec, "q", "a", strict=True).collect()


def test_answer_prompt(spark):
    df = spark.createDataFrame([(1, "c" * 300 + "end", " why? "), (2, None, "why?")], "qid int, context string, query string")
    got = {r["qid"]: r["prompt"] for r in answers.answer_prompt(df, encoding.character_codec).collect()}
    tail = "\n\nQUESTION\nwhy?\n\nANSWER USING ONLY THE RETRIEVED CONTEXT:\n"
    assert len(got[1]) == 240 and got[1].endswith("cend" + tail) and got[2] == tail
    with pytest.raises(Exception, match="no room"):
        answers.answer_prompt(df, encoding.character_codec, tokens=20).collect()
    with pytest.raises(Exception, match="blank"):
        answers.context(df.withColumn("query", F.lit(" ")), spark.createDataFrame([], "qid int, rank int, section_number string, section_title string, page_number int, text string")).collect()


def test_small_functions(spark):
    assert one(spark, 3, N.causal_mask, "int") == [[True, False, False], [True, True, False], [True, True, True]] and one(spark, 0, N.causal_mask, "int") == []
    assert one(spark, [1, 1, 2, 1], lambda c: N.unknown_count(c, F.lit(3)), "array<int>") == 2
    assert one(spark, [0.0, 0.0], lambda c: N.cross_entropy(c, F.lit(1)), "array<double>") == pytest.approx(0.693147, abs=1e-5) and one(spark, [0.0], lambda c: N.cross_entropy(c, F.lit(-100)), "array<double>") is None
    assert [one(spark, [0.25, 0.5, 0.25], lambda c, u=u: N.drawn(c, F.lit(u)), "array<double>") for u in (0.0, 0.25, 0.74, 0.999)] == [0, 1, 1, 2]
    assert one(spark, '{"a": {"b": 3}, "n": 4}', lambda c: nested.resolved(c, ["x", "a.b"], 9)) == "3" and one(spark, None, lambda c: nested.resolved(c, ["x"], 9)) == "9"
    rows = spark.createDataFrame([("x", None), (None, "y")], "n string, state string").withColumns({"jurisdiction": F.col("n"), "text": F.lit(" a ")})
    assert sorted(r["jurisdiction"] for r in encoding.encoded_records(rows.withColumn("state", F.lit("s")), encoding.word_encoder, ["n"]).collect()) == ["s", "x"]
    assert "T" in spark.range(1).select(nested.now_utc().alias("t")).first()["t"]
    got = qa.summary(spark.createDataFrame([("train", 3), ("train", 5)], "split string, v int"), {"odd": F.col("v") % 2}, {"top": F.col("v")}).collect()
    assert {r["split"]: (r["records"], r["odd"], r["top"]) for r in got} == {"train": (2, 2, 5), "validation": (0, 0, 0), "test": (0, 0, 0)}


def test_counted_terms(spark):
    assert [tuple(x) for x in one(spark, ["b", "a", "b", "c", "b"], retrieval.counted_terms, "array<string>")] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(spark, [], retrieval.counted_terms, "array<string>") == [] and one(spark, None, retrieval.counted_terms, "array<string>") == []


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "KEY_ROWS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(300)], "i int, term string")
    table = rows.groupBy("term").agg(F.count("*").alias("df")).withColumn("v", F.length("term"))
    got = retrieval.spread_join(rows, table, "term", "df").collect()
    assert sorted((r["i"], r["v"]) for r in got) == [(i, 3 if i % 2 else 2) for i in range(300)]


def test_dense_topk_in_blocks(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(80)] + [(90, [0.0] * 4), (91, None)]
    v = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
    got = retrieval.dense_topk(v.where("id % 20 = 0"), v, "id", "v", 3, block=2)
    norm = lambda x: sum(y * y for y in x) ** 0.5
    want = set()
    for q, x in rows:
        if q % 20 == 0:
            s = sorted((-round(sum(a * b for a, b in zip(x, y)) / (norm(x) * norm(y) or 1), 6) if y and norm(y) * norm(x) else 0.0, i) for i, y in rows if i != q)
            want |= {(q, i, k + 1) for k, (_, i) in enumerate(s[:3])}
    assert {(x["qid"], x["id"], x["rank"]) for x in got.collect()} == want


def test_quoted_boosts_in_blocks(spark):
    texts = [("a", "The Fee is due.", "Fee"), ("b", None, "the fee is"), ("c", "no", None)]
    c = spark.createDataFrame(texts, "chunk_id string, text string, section_title string")
    q = spark.createDataFrame([(1, "the fee is"), (2, "FEE "), (3, ""), (4, "fee"), (5, None)], "qid int, query string")
    got = {(r["qid"], r["chunk_id"]): r["boost"] for r in retrieval.quoted_boosts(q, c, "chunk_id", block=1).collect()}
    assert got == {(1, "a"): 0.2, (1, "b"): 0.25, (2, "a"): 0.45, (2, "b"): 0.25, (4, "a"): 0.45, (4, "b"): 0.25}


def test_metrics(spark):
    h = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 2.5)], "step int, loss double").withColumn("run", F.lit(1))
    assert [r["improved"] for r in metrics.running_best(h, ["run"], "step", "loss").orderBy("step").collect()] == [True, True, False, False]
    assert metrics.best_step(h, ["run"], "step", "loss").first()["step"] == 2
    names = spark.createDataFrame([(f"resume_step_{i}.pt",) for i in range(50, 401, 50)] + [("best.pt",)], "name string")
    assert [r["step"] for r in metrics.newest_checkpoints(names).collect()] == [400, 350, 300, 250, 200]
    assert one(spark, 50.0, lambda c: N.perplexity(c), "double") == pytest.approx(485165195.4, rel=1e-6)
    assert metrics.parameters(10_000, 256, 384, 4, 1_536) == 11_036_928
    assert metrics.schedule(spark, 10, 2, 1.0).count() == 6


def test_softmax_keeps_ties(spark):
    kept = one(spark, [1.0, 2.0, 2.0, 0.0], lambda c: N.kept_top(c, 2), "array<double>")
    assert kept == [None, 2.0, 2.0, None]
    assert one(spark, kept, N.softmax, "array<double>") == [0.0, 0.5, 0.5, 0.0]
    assert one(spark, [-2.0, 4.0], lambda c: N.penalised(c, F.array(F.lit(0)), 2.0, 2.0), "array<double>") == [-0.5, 2.0]
