"""Every registered query runs on the smallest tables; those with SQL give the same rows as it."""

import pytest

from corpusloom.operators import corpus, qa
from corpusloom.plans import catalogue

from oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, sf))
    assert len(names) == len(set(names))
    if name in catalogue.ORACLES:
        assert (names, rows) == sql_rows(sf, catalogue.ORACLES[name])


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_search_asks_the_questions_of_the_data(spark, sf):
    asked = {x[0] for x in spark.read.parquet(f"{sf}/qa_v1.parquet").where("qa_id % 50 = 0 and question rlike '[a-z]'").select("qa_id").collect()}
    found = {x["qid"] for x in catalogue.QUERIES["boosted_search_questions"](spark, sf).collect()}
    assert asked and found and found <= asked


def test_full_caps(spark, sf):
    assert "20000" in catalogue.ORACLES["qa_proportional_cap_full"] and "12500" in catalogue.ORACLES["jurisdiction_cap_full"]
    every = catalogue._attached(spark, sf).count()
    assert catalogue.QUERIES["qa_proportional_cap_full"](spark, sf).count() == min(every, 20_000)
    rows = spark.createDataFrame([(i, "train" if i % 10 else "test") for i in range(100)], "i long, split string")
    got = [x["i"] for x in qa.proportional_cap(rows, ["i"], 20).collect()]
    assert len(got) == 20 and sorted(got) == sorted([0, 10] + [i for i in range(1, 20) if i % 10] )
    assert corpus.capped(rows, "split", "i", 7).count() == 14
