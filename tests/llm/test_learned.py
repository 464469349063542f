"""Subject areas and scanned pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import scans, subjects

WORDS = {"tax": ["levy", "duty", "refund", "assessment", "excise"], "land": ["tenancy", "survey", "holding", "plot", "lease"], "none": ["shall", "order", "notice", "board", "section", "writing"]}


def sentence(r, area):
    return " ".join(r.choice(WORDS[area]) for _ in range(3)) + " " + " ".join(r.choice(WORDS["none"]) for _ in range(4))


def document(r, areas):
    return ". ".join(sentence(r, areas[i % len(areas)]) for i in range(8)) + "."


def test_areas(spark):
    r = random.Random(1)
    kinds = [["tax"], ["land"], ["tax", "land"], ["none"]]
    docs = [(i, document(r, kinds[i % 4])) for i in range(400)] + [(900, None), (901, ""), (902, " \n"), (903, "tenancy lease plot. " * 20000)]
    labels = [(i, a) for i in range(200) for a in (kinds[i % 4])] + [(0, "tax"), (1, None), (None, "tax"), (5, "unknown"), (7777, "tax")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"t": F.lit(1), "subject": F.lit("x"), "share": F.lit(0)})
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    areas = spark.createDataFrame([("tax",), ("land",), (None,)], "subject string")
    got = {}
    for x in subjects.assign(d, lab, areas, shards=3).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    held = [i for i in range(200, 400)]
    assert np.mean([got.get(i, set()) == set(kinds[i % 4]) - {"none"} for i in held]) > 0.9
    assert not {900, 901, 902} & set(got) and got[903] == {"land"}
    assert subjects.assign(d, lab.limit(0), areas).count() == 0 and subjects.assign(d.limit(0), lab, areas, steps=(2, 1)).count() == 0


def test_gradient_is_that_of_the_loss():
    r = random.Random(2)
    shard = subjects.build_shard([document(r, ["tax"]), document(r, ["land"])], np.array([[1.0, 0.0], [0.0, 1.0]]))
    rng = np.random.default_rng(0)
    p = subjects.Parameters(shard["used"], rng.normal(0, 1, (len(shard["used"]), 3)), rng.normal(0, 1, (3, 2)), np.zeros(2))

    def loss():
        h, n = subjects._forward(shard, p)[1], 2
        share = shard["size"] / np.bincount(shard["owner"], weights=shard["size"])[shard["owner"]]
        mean = np.stack([(h * share[:, None])[shard["owner"] == i].sum(0) for i in range(n)])
        q = 1 / (1 + np.exp(-(mean @ p.V + p.b)))
        return -(shard["labels"] * np.log(q) + (1 - shard["labels"]) * np.log(1 - q)).sum()

    g = subjects.gradient(shard, p)
    for array, grad, at in ((p.E, g["E"], (3, 1)), (p.V, g["V"], (2, 0)), (p.b, g["b"], (1,))):
        array[at] += 1e-4
        up = loss()
        array[at] -= 2e-4
        down = loss()
        array[at] += 1e-4
        assert grad[at] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=1e-4)


BODY = "the registrar shall keep the register of every tenancy and the committee may examine any order in writing within thirty days subject to an appeal to the tribunal together with the notice"


def pages():
    rows, r, no = [], random.Random(3), 0
    for f in range(8):
        for page in range(1, 9):
            words = BODY.split()
            lines = [" ".join(words[k : k + 6]) for k in range(0, len(words), 6)]
            lines = [*lines, f"Closing remark {r.choice('abcdef')} ends here."]
            head = f"THE {'ABCDEFGH'[f] * 5}RIN STATUTE"
            rows.append([f"c{no:04d}", f"f{f}.pdf", page, None, "Keeping of the register", [head, f"- {page + 10} -", *lines]])
            no += 1
    rows[3][5][3] = "the reqistrar".replace("q", "9") + " shall keep"
    rows[3][5][4] = "the com-"
    rows[3][5].insert(5, "mittee may exarnine any order")
    rows[4][4] = "Keeping of thc regis-\nter"
    rows[5][5].insert(4, "127")
    return [(*x[:5], "\n".join(x[5])) for x in rows] + [("n1", None, None, None, None, None), ("n2", "f0.pdf", None, "1", "", " \n"), ("n3", "f0.pdf", 3, None, None, "word " * 50000)]


def test_scans(spark):
    df = spark.createDataFrame(pages(), "chunk_id string, source_file string, page_number int, section_number string, section_title string, text string").withColumns({"key": F.lit(1), "page": F.lit(2)})
    got = {tuple(x) for x in scans.found(df).collect()}
    own = {x[1:] for x in got if x[0] == "c0003"}
    assert {("text", 1, "header", ""), ("text", 2, "page_number", ""), ("text", 5, "broken_word", "committee"), ("text", 6, "misread", "examine")} <= own and ("text", 4, "misread", "registrar") in own
    assert {x[1:4] for x in got if x[0] == "c0004" and x[1] == "section_title"} == {("section_title", 1, "misread"), ("section_title", 1, "broken_word")}
    assert not any(x[0] == "c0005" and x[2] == 5 for x in got) and not any(x[0] in ("n1", "n2", "n3") for x in got)
    assert sum(x[3] == "header" for x in got) == 64 and sum(x[3] == "page_number" for x in got) == 64
    fixed = {x["chunk_id"]: x for x in scans.repaired(df).collect()}
    assert "committee may examine any order" in fixed["c0003"]["text"] and "STATUTE" not in fixed["c0003"]["text"]
    assert fixed["c0004"]["section_title"] == "Keeping of the register" and fixed["n1"]["text"] is None and fixed["n2"]["text"] == ""
    assert scans.found(df.limit(0)).count() == 0


def test_own_hyphens_stay():
    lex = scans.Lexicon({"co-owner": 40, "the": 900, "register": 50, "by": 90, "law": 30, "owner": 20, "of": 500, "order": 40})
    assert scans.damages([(1, "the co-"), (2, "owner of the regis¬"), (3, "ter")], lex) == {(2, "broken_word", "register")}
    assert scans.damages([(1, "by-"), (2, "law of 1956 and 12b")], lex) == set()
    assert scans.restore([(1, "the 0rder of the"), (2, "co-"), (3, "owner.")], lex) == "the order of the co-owner."


def test_paragraphs():
    lines = list(enumerate(["The first part of a paragraph goes", "on to its end.", "", "Another paragraph begins here and", "it ends."], 1))
    assert [len(p) for p in scans.paragraphs(lines)] == [2, 2] and scans.paragraphs([]) == []


def test_lexicon_counts_line_edges_and_has_no_cap(spark):
    many = " ".join(f"form{i}x" for i in range(100_050))
    lines = ["penalties are due to the registrar", "of this board and all its registrar", "penalties", "the board sends to the regis", "trar of this the com-", "HEAD", "mittee and the board", "of the fees are due"]
    text = "\n".join(lines)
    rows = [(f"c{k}", "f.pdf", None, None, None, t) for k, t in enumerate([text.replace("fees", "pena1ties"), text, text, f"a {many} b\na {many} b"])]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, page_number int, section_number string, section_title string, text string")
    counts = scans.lexicon(df).counts
    assert counts["penalties"] == 6 and counts["registrar"] == 6 and not {"regis", "trar", "com", "mittee"} & set(counts)
    assert sum(w.startswith("form") for w in counts) == 100_050
    assert ("c0", "text", 8, "misread", "penalties") in {tuple(x) for x in scans.found(df.where("chunk_id <> 'c3'")).collect()}


def test_long_paragraphs_are_not_cut():
    lines = [(i, "words of a paragraph that goes on and on, with a regis-" if i % 2 else "ter of") for i in range(1, 200)]
    assert [len(p) for p in scans.paragraphs(lines)] == [199]
    text = scans.restore(lines, scans.Lexicon({w: 500 for w in "words of a paragraph that goes on and with register".split()}))
    assert text.count("register of") == 99 and "\n\n" not in text
    assert [len(p) for p in scans.paragraphs([*lines, (200, "ends."), (201, ""), (202, "Another one.")])] == [200, 1]


def test_words_cut_more_than_once_and_run_together():
    lex = scans.Lexicon({"consideration": 80, "of": 900, "the": 900, "registrar": 300, "for": 500, "lawful": 60, "same": 200})
    assert scans.damages([(1, "the lawful con-"), (2, "sidera-"), (3, "tion of the"), (4, "regis"), (5, "trar")], lex) == {(1, "broken_word", "consideration"), (4, "broken_word", "registrar")}
    assert scans.restore([(1, "con-"), (2, "sidera-"), (3, "tion ofthesame registrar.")], lex) == "consideration of the same registrar."


def test_a_multiple_of_the_corpus_decides_alike():
    counts = {"consideration": 80, "of": 900, "the": 900, "registrar": 300, "lawful": 60, "tbe": 3, "rare": 4, "rake": 9}
    texts = ["the 1awful con-", "sideration of tbe registiar, rare rake", "regis", "trar"]
    small, large = scans.Lexicon(counts, 2), scans.Lexicon({w: 1000 * n for w, n in counts.items()}, 2000)
    lines = list(enumerate(texts, 1))
    assert scans.damages(lines, small) == scans.damages(lines, large) and (2, "misread", "the") in scans.damages(lines, small)
    assert scans.restore(lines, small) == scans.restore(lines, large)
