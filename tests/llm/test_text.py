"""Token counts, encoding, cutting, formatting duplicates, mixing."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import budget, cutting, encoding, formatting, mixing
from corpusloom.llm.bpe import DEFAULT_RANKS, ByteBpe

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = [None, "", " ", "Hello  world's end.\n\n 12'll", "<|endoftext|>", "धारा 45 के अधीन", "\0a\0", "x" * 3000, "a b " * 60000, "it's 'tis \u0085 \x1c!", "😀𝒳é½Ⅻ"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe.load()


@pytest.fixture(scope="module")
def reference(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_ids(bpe, reference):
    r = random.Random(1)
    alphabet = "ab1 \n\t'’s'll're. ,!éह्\u0085\x1cⅫ½\0😀"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    want = [reference.encode_ordinary(t) if t else [] for t in texts]
    assert bpe.encode_array(pa.array(texts)).to_pylist() == want
    assert bpe.count_array(pa.array(texts)).tolist() == [len(x) for x in want]
    assert bpe.encode_array(pa.array([], pa.string())).to_pylist() == []


def test_perfect_hash_is_minimal(bpe):
    assert sorted(set(bpe.hash.value.tolist())) == sorted(v for k, v in bpe.ranks.items() if len(k) <= 16 and b"\0" not in k) and bpe.hash.n == len(bpe.hash.value)


def test_encoding_and_counts(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"t": F.lit(1), "ids": F.lit(2), "out": F.lit(3)})
    want = {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["ids"] for r in encoding.encode(df).collect()} == want
    # chunks of long texts add up, whatever their size
    for chars in (100, 2000, 100_000):
        assert {r["doc_id"]: r["tokens"] for r in encoding.token_counts(df, "doc_id", long_chars=chars).collect()} == {i: len(x) for i, x in want.items()}
    assert encoding.encode(df.limit(0)).count() == 0 and encoding.token_counts(df.limit(0), "doc_id").count() == 0
    joined = df.where("text is not null").select(F.array_join(encoding.safe_chunks(F.col("text"), 64), "").alias("j"), "text").collect()
    assert all(r["j"] == r["text"] for r in joined)


def test_counts_keep_columns_and_repeated_keys(spark, reference):
    rows = [(1, "x", "a b " * 100), (1, "y", "it's " * 100), (2, None, None), (None, "z", "c")]
    df = spark.createDataFrame(rows, "out long, long string, text string").withColumn("__row", F.lit(1))
    got = sorted((r["out"] or 0, r["long"] or "", r["tokens"]) for r in encoding.token_counts(df, "out", long_chars=50, keep=("long",)).collect())
    assert got == sorted((k or 0, s or "", len(reference.encode_ordinary(t)) if t else 0) for k, s, t in rows)


def test_languages_of_one_script(spark):
    r = random.Random(7)
    words = {"en": "the order of court shall be given within days by which every person may appeal".split(), "de": "die verordnung des gerichts wird binnen tagen erlassen wogegen jeder berufung einlegen kann".split()}
    docs = [(i, " ".join(r.choice(words[k]) for _ in range(20)), r.choice([k, k.upper(), f" {k}"])) for i, k in enumerate(["en", "de"] * 60)] + [(500, "text", None), (501, None, "en"), (502, "12", "und")]
    labelled = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = budget.learn_languages(labelled)
    assert model.names == ["de", "en"]
    texts = [" ".join(r.choice(words[k]) for _ in range(6)) for k in ["en", "de"] * 20] + ["12 !", None, "", "a", "the order " * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("lang", F.lit(1))
    got = [x["language"] for x in budget.with_language(df, model).orderBy("row_id").collect()]
    assert got == ["en", "de"] * 20 + ["und"] * 4 + ["en"]
    none = budget.learn_languages(labelled.limit(0))
    assert none.names == [] and {x["language"] for x in budget.with_language(df, none).collect()} == {"und"}
    assert budget.with_language(df.limit(0), model).count() == 0


def test_slices(spark):
    rows = [(1, " Central ", "en", 3), (2, "CENTRAL", "hi", 4), (3, None, "ta", 5), (4, "-", "und", 1), (5, "central", None, None)]
    df = spark.createDataFrame(rows, "id int, state string, language string, tokens long").withColumn("chars", F.length("state"))
    got = budget.roll_up(df.select(budget.spelled(F.col("state")).alias("state"), "language", "tokens", "chars"), ["state", "language"])
    assert {(r["state"], r["language"]): (r["n_docs"], r["n_tokens"]) for r in got.collect()} == {("central", "en"): (1, 3), ("central", "hi"): (1, 4), ("unknown", "ta"): (1, 5), ("unknown", "und"): (1, 1), ("central", None): (1, 0)}


CUTS = [("a", "word " * 700), ("b", "x" * 5000), ("c", "Sentence one ends. " * 200), ("d", "𝒳" * 1201), ("e", "p" * 900 + "\n\n" + "q" * 900), ("f", "k" * 1200), ("g", None), ("h", ""), ("i", "é" * 1500), ("j", " " * 1300), ("k", "long " * 120000)]


def test_cut(spark):
    df = spark.createDataFrame(CUTS, "key string, text string").withColumns({"piece_no": F.lit(9), "own": F.lit(1)})
    texts, pieces = dict(CUTS), {}
    for r in cutting.cut(df, ["key"], "text").orderBy("key", "piece_no").collect():
        pieces.setdefault(r["key"], []).append(r)
    assert set(pieces) == set("abcdeijk")
    for k, own in pieces.items():
        assert [r["piece_no"] for r in own] == list(range(1, len(own) + 1)) and max(len(r["piece"]) for r in own) <= 1200
        end = 0
        for r in own:
            assert texts[k][r["start"] - 1 : r["start"] - 1 + len(r["piece"])] == r["piece"] and r["start"] - 1 + r["overlap_chars"] == end
            assert r["piece_no"] == 1 or 120 <= r["overlap_chars"] <= 150
            end = r["start"] - 1 + len(r["piece"])
        assert end == len(texts[k])
    assert pieces["e"][0]["piece"].endswith("\n\n") and all(r["piece"].endswith(". ") for r in pieces["c"]) and not any(r["piece"].startswith("́") for r in pieces["i"])
    assert cutting.cut(df, ["key"], "text", keep_short=True).where("key = 'f'").first()["piece"] == "k" * 1200
    assert cutting.cut(df.limit(0), ["key"], "text").count() == 0
    with pytest.raises(ValueError):
        cutting.cut(df, ["key"], "text", 100, 50)


FORMATS = [
    (5, "1", "Act: X | Section: 1 | State: S | Status: F | Text: The rule."), (3, " 1", "TEXT :the  RULE\nstate: s\nact:x\nSection: 1\nStatus: f"), (4, "1", "Act: S | Section: 1 | State: X | Status: F | Text: The rule."),
    (7, None, "Plain, text"), (8, "", "plain TEXT!"), (9, "2", "plain text"), (10, "1", None), (11, "1", "?! "), (12, "1", ""), (13, "-", "Plain text"), (14, None, "कि"), (15, None, "क"), (16, "", "ÉCOLE"), (17, "", "école."),
    (20, "1", "pq"), (21, "1p", "q"),
]


def test_collapse(spark):
    hot = [(1000 + i, "7", "Hot copy " + "!" * i) for i in range(300)]
    long = [(5000 + i, "9", f"{'prefix ' * 60}{i % 40}") for i in range(120)]
    df = spark.createDataFrame(FORMATS + hot + long, "record_id long, section_number string, text string").withColumns({"t": F.lit(1), "kept": F.lit(2)}).repartition(5)
    want = {(3, 5), (7, 8), (7, 13), (16, 17)} | {(1000, i) for i in range(1001, 1300)} | {(5000 + i % 40, 5000 + i) for i in range(40, 120)}
    for size, flush in ((16 << 20, 24 << 20), (4000, 3000)):  # the second forces recursion and flushes
        records, copies = formatting.collapse(df, bucket_bytes=size, flush_bytes=flush)
        got = [(r["kept_id"], r["copy_id"]) for r in copies.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        counts = {r["kept_id"]: r["n_copies"] for r in records.collect()}
        assert counts[1000] == 300 and counts[3] == 2 and counts[5000] == 3 and sum(counts.values()) == len(FORMATS) - 3 + 420
    records, copies = formatting.collapse(df.limit(0))
    assert records.count() == copies.count() == 0


def test_fields_may_be_empty():
    got = formatting.canonical_texts(pa.array(["Act:Section:1 state: s status: x text:abc", "text: ABC, Status: x; State: S. section: 1 Act:", "Text: only", None]))
    assert got.to_pylist() == ["\1".join(["", "1", "s", "x", "abc", ""])] * 2 + ["textonly", ""]


def test_trie_bursts():
    trie = formatting.BurstTrie(4)
    r = random.Random(2)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(500)]
    for i, k in enumerate(keys):
        trie.add(k, i)
    for k in set(keys):
        assert trie.add(k, 10**9, 0) == [keys.index(k), keys.count(k)]


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], [99] * 3, 7) == [3, 2, 2]
    assert mixing.sainte_lague([0.6, 0.4], [2, 99], 10) == [2, 8] and mixing.sainte_lague([1.0], [3], 10) == [3] and mixing.sainte_lague([], [], 4) == []

    def plain(w, caps, seats):
        got = [0] * len(w)
        for _ in range(seats):
            open_ = [i for i in range(len(w)) if got[i] < caps[i]]
            if open_:
                got[max(open_, key=lambda i: (w[i] / (2 * got[i] + 1), -i))] += 1
        return got

    r = random.Random(3)
    for _ in range(40):
        w, caps = [r.random() for _ in range(5)], [r.randint(0, 60) for _ in range(5)]
        assert mixing.sainte_lague(w, caps, 150) == plain(w, caps, 150)


def test_mix(spark):
    r = random.Random(4)
    docs = [(i, s, r.randint(50, 150)) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["tiny"] * 5 + ["other"] * 50)] + [(5000, None, 9), (5001, "mid", 0), (5002, "mid", None)]
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("uses", F.lit(7))
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.45, 4), ("tiny", 0.05, 2), ("absent", 0.01, 3), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(d, t, total_tokens=80_000, blocks=2000, shard_tokens=20_000)
    got = {x["source"]: x for x in report.collect()}
    cap = {"big": 1, "mid": 4, "tiny": 2}
    assert all(x["uses"] <= cap[x["source"]] for x in uses.collect()) and set(got) == {"big", "mid", "tiny", "absent"}
    assert got["tiny"]["mean_uses"] == 2 and got["absent"]["mixed_tokens"] == 0 and abs(sum(x["actual_share"] for x in got.values()) - 1) < 1e-5
    assert abs(got["big"]["mixed_tokens"] / got["mid"]["mixed_tokens"] - 0.5 / 0.45) < 0.05
    again = mixing.mix(d.repartition(7), t, total_tokens=80_000, blocks=2000, shard_tokens=20_000)[0]
    assert sorted(uses.collect()) == sorted(again.collect())
    none = mixing.mix(d.limit(0), t)
    assert none[0].count() == 0 and [x["actual_share"] for x in none[1].collect()] == [0.0] * 4
    whole = {x["source"]: x["actual_share"] for x in mixing.mix(d, t)[1].collect()}  # the absent source does not empty the mixture
    assert abs(whole["big"] - 0.5) < 0.05 and 0.4 < whole["mid"] < 0.52  # up to the shortfall more


def test_mixture_holds_at_every_size():
    for total in (10**6, 15 * 10**11, 25 * 10**12):
        sizes = [int(total * x) for x in (0.5, 0.3, 0.15, 0.05, 1e-9)]
        block = mixing.block_size(total, sizes, 100_000, 2 * 10**9)
        for repeats in (1, 2, 4):
            quota = mixing.sainte_lague([0.4, 0.3, 0.2, 0.1, 1e-6], [repeats * s // block for s in sizes], total // block)
            assert abs(sum(quota) * block / total - 1) < 0.001 and (repeats == 1 or abs(quota[0] * block / total - 0.4) < 0.001)
            shards = [sizes[0] // (k := -(-sizes[0] // (2 * 10**9)))] * k
            placed = sum(whole * n + rest for (whole, rest), n in zip(mixing.shard_quotas(shards, min(quota[0], repeats * sum(shards) // block), block, repeats), shards))
            assert abs(placed / (quota[0] * block) - 1) < 0.001


def test_blocks_larger_than_shards_are_all_placed():
    r = random.Random(8)
    for _ in range(200):
        tokens = [r.randint(1, 40) for _ in range(r.randint(1, 30))]
        block, repeats = r.randint(1, 100), r.randint(1, 4)
        quota = r.randint(0, sum(tokens) * repeats // block)
        assert sum(w * n + rest for (w, rest), n in zip(mixing.shard_quotas(tokens, quota, block, repeats), tokens)) == quota * block


def test_mix_with_shards_smaller_than_a_block(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", 100) for i in range(3000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    report = {x["source"]: x for x in mixing.mix(docs, targets, total_tokens=200_000, blocks=10, shard_tokens=2000)[1].collect()}
    assert abs(report["a"]["mixed_tokens"] - 100_000) < 5_000 and abs(report["b"]["mixed_tokens"] - 100_000) < 5_000
