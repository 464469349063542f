"""Readers, writers and streams."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files
from corpusloom.streaming import jobs


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"query": "q", "expected_sections": ["1"]}\n\n{"query": "ü"}\n')
    assert [r["query"] for r in files.read_jsonl(spark, str(p), "retrieval_cases").collect()] == ["q", "ü"]
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "retrieval_cases").collect()
    df = spark.createDataFrame([("train", 1), ("test", 2)], "split string, v int")
    files.write_jsonl(df, str(tmp_path / "o"))
    files.write_jsonl(df, str(tmp_path / "o"), append=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 4
    files.write_splits(df, str(tmp_path / "s"))
    assert sorted(x.name for x in (tmp_path / "s").iterdir() if x.is_dir()) == ["split=test", "split=train"]
    files.write_report(df.limit(1), str(tmp_path / "r"))
    with pytest.raises(ValueError):
        files.require_rows(df.where("v > 5"), "rows")


def test_history(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"history": [{"epoch": 1, "train_loss": 2.5},\n {"epoch": 2}]}')
    assert [r["epoch"] for r in files.read_history(spark, str(tmp_path / "h.json")).collect()] == [1, 2]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", [1, 2]), ("a", [1, 2]), ("b", [7])], "k string, t array<int>").coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema("k string, t array<int>").parquet(str(src))
    jobs.write_available(jobs.deduplicated(read(), ["k"]), str(tmp_path / "d"), str(tmp_path / "dc"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    q = lambda: jobs.write_available(jobs.packed(read(), "k", "t", 3, 0, "k"), str(tmp_path / "p"), str(tmp_path / "pc"))
    q()
    spark.createDataFrame([("a", [9])], "k string, t array<int>").write.mode("append").parquet(str(src))
    q()
    got = spark.read.parquet(str(tmp_path / "p")).where(F.col("key") == "a").orderBy("block_no").collect()
    assert [(r["block_no"], r["input_ids"], r["targets"]) for r in got] == [(0, [1, 2, 0], [2, 0, 1]), (1, [1, 2, 0], [2, 0, 9])]


def test_tables_need_a_shared_folder_and_are_released(spark, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    from corpusloom import session

    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://host:7077") and not session.is_local("yarn")
    path = {}
    with session.scratch():
        path = urlparse(session.table_path(spark, "x")).path
        spark.range(3).write.parquet(f"file://{path}")
        assert session.written(spark.range(5), "y").count() == 5 and Path(path).exists()
    assert not Path(path).exists()


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from corpusloom import session

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))


def test_report_is_one_document(spark, tmp_path):
    files.write_report(spark.range(3), str(tmp_path / "r"), "history")
    assert files.read_document(spark, str(tmp_path / "r"), "history array<struct<id: long>>").select(F.size("history")).collect()[0][0] == 3
