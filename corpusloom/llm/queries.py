"""Queries of the training-data problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import budget, cutting, encoding, formatting, mixing, overlap, scans, splits, subjects


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    state = F.lower(F.trim("state"))
    return splits.related_records({
        "splits": (_t(spark, sf, "splits"), "row_id", {"state": state, "publisher": F.col("source_publisher")}),
        "qa_v1": (_t(spark, sf, "qa_v1"), "qa_id", {"type": F.col("question_type")}),
    })


def p1_found(spark, sf):
    return splits.tied_acts(_records(spark, sf))


def p1_groups(spark, sf):
    return splits.act_groups(_records(spark, sf)).select("act_id", F.lower(F.hex("root")).alias("root"))


def p1_assignment(spark, sf):
    return splits.assign(_records(spark, sf))


def p1_report(spark, sf):
    records = _records(spark, sf)
    return splits.share_report(splits.assign(records), records)


def _oversized(spark, sf):
    return cutting.cut_fields({
        "splits": (_t(spark, sf, "splits"), "row_id", ["text"]), "qa_v1": (_t(spark, sf, "qa_v1"), "qa_id", ["context", "answer"]),
    })


def p4_found(spark, sf):
    return _oversized(spark, sf).where("piece_no = 1").select("tab", "row_id", "field")


def p4_pieces(spark, sf):
    return _oversized(spark, sf)


def p6_found(spark, sf):
    return formatting.collapse(_t(spark, sf, "open_india_law_legislation"))[1]


def p6_records(spark, sf):
    return formatting.collapse(_t(spark, sf, "open_india_law_legislation"))[0]


def p7_ids(spark, sf):
    return encoding.encode(_t(spark, sf, "documents"))


def p2_splits(spark, sf):
    model = budget.learn_languages(_t(spark, sf, "documents"))
    rows = _t(spark, sf, "splits").select(
        "row_id", budget.spelled(F.col("source_publisher")).alias("source_publisher"), budget.spelled(F.col("state")).alias("state"), F.length("text").alias("chars"), "text",
    )
    counted = encoding.token_counts(budget.with_language(rows, model), "row_id", keep=("source_publisher", "state", "language", "chars"))
    return budget.roll_up(counted, ["source_publisher", "state", "language"])


def _mixture(spark, sf):
    return mixing.mix(encoding.token_counts(_t(spark, sf, "documents"), "doc_id", keep=("source",)), _t(spark, sf, "mix_targets"))


def p8_mixture(spark, sf):
    return _mixture(spark, sf)[0]


def p8_report(spark, sf):
    return _mixture(spark, sf)[1]


def _areas(spark, sf):
    return subjects.assign(_t(spark, sf, "documents"), _t(spark, sf, "subject_labels"), _t(spark, sf, "subjects"))


def p9_found(spark, sf):
    return _areas(spark, sf).select("doc_id", "subject")


def p9_composition(spark, sf):
    return _areas(spark, sf).groupBy("subject").agg(F.count("*").alias("n_docs"))


def p2_documents(spark, sf):
    rows = _t(spark, sf, "documents")
    areas = _areas(spark, sf).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("subject")), "+").alias("subject"))
    slices = rows.select("doc_id", budget.spelled(F.col("source")).alias("source"), budget.spelled(F.col("lang")).alias("lang"), F.length("text").alias("chars"), "text")
    counted = encoding.token_counts(slices, "doc_id", keep=("source", "lang", "chars")).join(areas, "doc_id", "left")
    return budget.roll_up(counted.withColumn("subject", F.coalesce("subject", F.lit("none"))), ["source", "lang", "subject"])


def p5_found(spark, sf):
    return overlap.overlaps(_t(spark, sf, "splits")).select("row_id_a", "row_id_b")


def p5_links(spark, sf):
    return overlap.links(_t(spark, sf, "splits"))


def p5_report(spark, sf):
    return overlap.report(_t(spark, sf, "splits"))


def p3_found(spark, sf):
    return scans.found(_t(spark, sf, "indian_contract_act_1872_chunks"))


def p3_repaired(spark, sf):
    return scans.repaired(_t(spark, sf, "indian_contract_act_1872_chunks"))


QUERIES = {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}

_FOLD = r"lower(regexp_replace({}, '[^\p{{L}}\p{{Nd}}\p{{M}}]+', '', 'g'))"


def _field(name: str) -> str:
    return _FOLD.format(rf"regexp_extract(text, '(?is)(?:^|[^\p{{L}}\p{{N}}\p{{M}}]){name}\s*:(.*?)(?:[^\p{{L}}\p{{N}}\p{{M}}](?:Act|Section|State|Status|Text)\s*:|$)', 1)")


_NAMED = " AND ".join(rf"regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}\p{{M}}]){f}\s*:')" for f in formatting.FIELDS)
_CANON = f"""
WITH c AS (SELECT record_id, {_FOLD.format("coalesce(section_number, '')")} AS s,
  CASE WHEN {_NAMED} THEN {" || chr(1) || ".join(_field(f) for f in formatting.FIELDS)} || chr(1) ELSE {_FOLD.format("text")} END AS t
  FROM open_india_law_legislation),
g AS (SELECT record_id, min(record_id) OVER (PARTITION BY s, t) AS kept_id FROM c WHERE regexp_matches(t, '[\\p{{L}}\\p{{Nd}}]'))"""
_KEY = r"regexp_replace(lower(act_id), '[^\p{L}\p{Nd}]', '', 'g')"
ORACLES = {
    "p6_found": _CANON + "SELECT kept_id, record_id AS copy_id FROM g WHERE record_id <> kept_id",
    "p6_records": _CANON + "SELECT kept_id, count(*) AS n_copies FROM g GROUP BY kept_id",
    "p1_found": rf"""
WITH RECURSIVE r AS (SELECT act_id, source_id FROM splits UNION SELECT act_id, source_id FROM qa_v1),
k AS (SELECT act_id, {_KEY} AS act, source_id FROM r WHERE {_KEY} <> ''),
f AS (SELECT source_id, min(act) AS a FROM k WHERE source_id IS NOT NULL GROUP BY source_id),
e AS (SELECT DISTINCT f.a AS x, k.act AS y FROM f JOIN k USING (source_id) WHERE f.a <> k.act),
s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
c AS (SELECT DISTINCT act AS n, act AS root FROM k UNION SELECT s.y, c.root FROM c JOIN s ON s.x = c.n),
m AS (SELECT n, min(root) AS root FROM c GROUP BY n),
i AS (SELECT DISTINCT act_id, root FROM k JOIN m ON k.act = m.n)
SELECT p.act_id AS act_id_a, q.act_id AS act_id_b FROM i p JOIN i q USING (root) WHERE p.act_id < q.act_id""",
    "p4_found": """
SELECT 'splits' AS tab, row_id, 'text' AS field FROM splits WHERE length(text) > 1200
UNION ALL SELECT 'qa_v1', qa_id, 'context' FROM qa_v1 WHERE length(context) > 1200
UNION ALL SELECT 'qa_v1', qa_id, 'answer' FROM qa_v1 WHERE length(answer) > 1200""",
}
# the same components, named by the least digest of an act
ORACLES["p1_groups"] = ORACLES["p1_found"].replace("act AS n, act AS root", "act AS n, md5('a' || act) AS root").split("SELECT p.act_id")[0] + "SELECT act_id, root FROM i"
