"""The response log as a data source, and the ledger of finished work, with writers that break off and meet."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pairforge.sources import log
from pairforge.sources.ledger import Ledger

SCHEMA = "id string, judge string, confidence int, inference struct<temperature:double>, more map<string,string>"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(log.ResponseLog)
    return lambda path, size=200: spark.read.format("response_log").option("range_bytes", size).schema(SCHEMA).load(str(path))


def test_every_whole_line_is_read_once_however_files_are_cut(source, tmp_path):
    rng, want = random.Random(1), []
    for name in ("a/r.jsonl", "b/r.jsonl", "b/empty.jsonl"):
        lines = []
        for k in range(60 if "r." in name else 0):
            row = {"id": f"{name}{k}", "judge": "é" * rng.randint(0, 40), "confidence": k}
            lines.append(json.dumps(row, ensure_ascii=False))
            want.append(row["id"])
            lines += rng.choice([[], [""], ["{\"id\":\"torn"], ["[1]"], ["nonsense"]])
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(lines), encoding="utf-8")  # without a last line feed
    for size in (7, 64, 10**6):
        assert sorted(r.id for r in source(tmp_path, size).collect()) == sorted(want)


def test_lines_of_other_shapes(source, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"1","confidence":"high","inference":{"temperature":0.5},"other":1}\n{"id":"2","confidence":99999999999}\n{"id":"3","confidence":4,"more":{"a":"b"}}\n')
    got = {r.id: r for r in source(tmp_path).collect()}
    assert [got[k].confidence for k in "123"] == [None, None, 4] and got["1"].inference.temperature == 0.5 and got["3"].more == {"a": "b"}


def test_a_commit_counts_once_and_whole(spark, source, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("j").alias("judge")).repartition(4)
    write = lambda df, commit: df.write.format("response_log").option("commit", commit).mode("append").save(path)
    write(rows, "one")
    write(rows, "one")  # a repeated run
    assert source(path).count() == 50
    broken = rows.withColumn("judge", F.when(F.col("id") == "33", F.raise_error(F.lit("killed"))).otherwise("k"))
    with pytest.raises(Exception, match="killed"):
        write(broken, "two")
    (tmp_path / "log" / "part-left.jsonl").write_text('{"id":"half')  # what a killed task leaves
    assert source(path).count() == 50
    write(rows.limit(3), "two")
    assert source(path).count() == 53
    with pytest.raises(Exception, match="only grows"):
        rows.write.format("response_log").mode("overwrite").save(path)
    with pytest.raises(Exception, match="read_responses"):
        spark.read.format("response_log").load("s3://bucket/log").count()


def test_ledger_keeps_one_row_of_a_key(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "ledger"), lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit(a).alias("run"))
    ledger = Ledger(spark, path, ("k",))
    assert ledger.read() is None and ledger.commit(rows(0, 5)) == 5 and ledger.commit(rows(0, 5)) == 0 and ledger.commit(rows(3, 8)) == 3
    assert sorted((r.k, r.run) for r in ledger.read().collect()) == [(k, 0) for k in range(5)] + [(k, 3) for k in (5, 6, 7)]
    # A run that breaks off between its rows and its snapshot leaves nothing that counts.
    monkeypatch.setattr(Ledger, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        ledger.commit(rows(8, 20))
    monkeypatch.undo()
    assert ledger.read().count() == 8 and ledger.commit(rows(8, 10)) == 2 and ledger.read(1).count() == 5


def test_ledger_of_two_writers_that_meet(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "ledger"), lambda a, b, run: spark.range(a, b).select(F.col("id").alias("k"), F.lit(run).alias("run"))
    one, two, put = Ledger(spark, path, ("k",)), Ledger(spark, path, ("k",)), Ledger._put
    met = []

    def late(self, n, folders):
        if self is one and not met:  # the other commits between one's look and its snapshot
            met.append(two.commit(rows(4, 9, "two")))
        return put(self, n, folders)

    monkeypatch.setattr(Ledger, "_put", late)
    assert one.commit(rows(0, 6, "one")) == 4 and met == [5] and one.version() == 2
    got = sorted((r.k, r.run) for r in one.read().collect())
    assert got == [(k, "one") for k in range(4)] + [(k, "two") for k in range(4, 9)]
