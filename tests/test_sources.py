"""Readers, sinks, chunking, the verdict cascade, sampling and streaming."""

import pytest
from pyspark.sql import functions as F

from pairforge.functions import scalars as S
from pairforge.functions.verdicts import read_verdict
from pairforge.operators import ordered
from pairforge.operators import sampling as X
from pairforge.sources import readers
from pairforge.streaming.counts import start_counts


VERDICTS = [
    ("a 5", ("a", 5)), ("  D\t-2 ", ("d", 1)), ("c 99999999999999999999999", ("c", 5)), ("a  +0", ("a", 1)), ("`b 3`", ("b", 3)), ("```c 9```", ("c", 5)), ("``a 5`", None), ("<choice>a</choice><confidence>4</confidence>", ("a", 4)),
    ("<choice> b\n<confidence>2 </choice>", ("b", 2)), ("A.\nConfidence: 9", ("a", 5)), ("`a)`\nwhy\n confidence = 2 of 5", ("a", 2)), ("a\nI am sure: confidence: 4", None), ("The answer is a 5", None), ("a 3\nb 4", None), ("a 7\na 5", ("a", 5)),
    ("Thinking.\nFinal answer:\nb 2", ("b", 2)), ("Final answer\nb2", ("b", 2)), ("**Final Verdict**:\n\n c 4\n", ("c", 4)), ("final judgment\na 1\nfinal judgement:\nd5", ("d", 5)), ("Final answer:\nb 9", ("b", 5)), ("Final answer:\na 1\nb 2", None),
    ("final answer: b 2", ("b", 2)), ("Choice: c\nConfidence: 2", ("c", 2)), ("- **Choice:** **a**  - **Confidence:** **3**", ("a", 3)), ("choice = d  confidence = 1", ("d", 1)), ("choice: a\nsome words\nconfidence: 2", ("a", 2)),
    ("I think choice: b is my pick, confidence: 4 overall", None), ("choice: b is my pick\nconfidence 4 overall", ("b", 4)), ("choice: b\nchoice: a\nconfidence: 4", ("a", 4)), ("choice: b\nor\nchoice: a\nso\nconfidence: 4", None), ("choice: b\nso\nconfidence: 4\nconfidence: 9", None), ("choice: b\nconfidence: 5\nconfidence: 9", ("b", 5)),
    ("<choise>c\n<confidence>3", ("c", 3)), ("* <choice>c</choice>\nwords\n- <confidence>3</confidence>", ("c", 3)), ("so\n<choice>a</choice> <confidence>2</confidence>\nbye", ("a", 2)), ("so <choice>a</choice> <confidence>2</confidence>", None),
    ("a-3", None), ("a:5", None), ("a, 3", None), ("e 3", None), ("answer: d 1", ("d", 1)), ("Answer = D 7", ("d", 5)), ("my answer: d 1", None), ("choice: 'a'\nconfidence: 2", ("a", 2)), ("winner: a\nconfidence: 2", None), ("line one\n`a 4`\nend", ("a", 4)),
    (None, None), ("", None), (" \n ", None), ("(confidence): 3\nchoice: a", ("a", 3)), ("A 5\r\nbecause", ("a", 5)), ("b 3 4", None), ("<choice>a</choice> 4", None),
]


@pytest.mark.parametrize(("text", "want"), VERDICTS)
def test_verdicts(text, want):
    assert read_verdict(text) == want


def test_jsonl_round_trip(spark, tmp_path):
    folder = tmp_path / "results" / "judge_x"
    folder.mkdir(parents=True)
    (folder / "responses.jsonl").write_text('{"id":"1","judge":"x","condition":"forward","canonical_verdict":"tie","inference":{"temperature":0.5}}\n{"id":"2","jud\n{"id":"3","judge":"x","condition":"forward"}\n')
    got = readers.read_responses(spark, f"{tmp_path}/results/*/*.jsonl")
    assert [(r.id, r.panel_judge) for r in got.orderBy("id").collect()] == [("1", "judge_x"), ("3", "judge_x")]
    assert [r.id for r in readers.resume_keys(got).collect()] == ["1"]
    readers.pack_responses(got, f"{tmp_path}/packed")
    assert spark.read.parquet(f"{tmp_path}/packed").where("panel_judge = 'judge_x'").count() == 2


def test_results_with_infinity(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"key":["a"],"rows":[{"method":"m","lam":Infinity,"excess":NaN},{"method":"n","lam":2.0,"excess":0.5}]}\n')
    got = {r.method: (r.lam, r.is_anchor, r.excess) for r in readers.read_results(spark, f"{tmp_path}/rows.jsonl", "method:string,lam:double,excess:double").collect()}
    assert got == {"m": (None, True, None), "n": (2.0, False, 0.5)}


def test_append_is_idempotent(spark, tmp_path):
    jobs = spark.range(10).select(F.col("id").cast("string").alias("id"))
    for _ in range(2):
        done = spark.read.schema("id string").json(f"{tmp_path}/out") if (tmp_path / "out").exists() else jobs.limit(0)
        readers.append_pending(jobs, done, f"{tmp_path}/out", ["id"])
    assert spark.read.schema("id string").json(f"{tmp_path}/out").count() == 10


def test_benchmark_checks_columns(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="model_a"):
        readers.read_benchmark(spark, f"{tmp_path}/b")


def test_greedy_chunks(spark):
    rows = [("a", k, t) for k, t in enumerate([5, 5, 5, 50, 9, 1])] + [("b", 0, 3)]
    got = ordered.greedy_chunks(spark.createDataFrame(rows, "g string, o int, tokens int"), "g", "o", 2, 12).collect()
    assert sorted((r.g, r.o, r.chunk) for r in got) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, -1), ("a", 4, 2), ("a", 5, 2), ("b", 0, 0)]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id").alias("record_id"), (F.col("id") % 3).alias("k"), F.lit(1).alias("a"))
    one = {r.record_id for r in X.draw(rows, 50, "s", "record_id").collect()}
    assert one == {r.record_id for r in X.draw(rows.repartition(7), 50, "s", "record_id").collect()} and len(one) == 50
    assert {r.record_id for r in X.draw(rows, 20, "s", "record_id").collect()} < one
    assert X.split_records(rows, 0.3, "s").where("test").count() == 150


def test_softplus_does_not_overflow(spark):
    r = spark.sql("SELECT 800D AS x, -800D AS y").select(S.softplus(F.col("x")), S.softplus(F.col("y"))).first()
    assert r[0] == 800.0 and r[1] == 0.0


def test_streamed_counts(spark, tmp_path):
    rows = [(0, 0, 1, 1, 2), (0, 0, 1, 1, 0), (1, 0, 1, -1, 1)]
    spark.createDataFrame(rows, "k int, i int, j int, a int, y2 int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, i int, j int, a int, y2 int").parquet(f"{tmp_path}/in")
    q = start_counts(stream, "streamed", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("streamed").collect())) == [(0, 0, 1, 1, 2, 2), (1, 0, 1, -1, 1, 1)]


def test_every_judge_is_read_and_fitted(spark, sf):
    from pairforge.plans import catalog
    from pairforge.sources import fixture as fx

    q = catalog.queries()
    got = {r.judge: r["count"] for r in q["jsonl_scan"](spark, sf).groupBy("judge").count().collect()}
    assert got == {f"judge_{r.judge}": r["count"] for r in fx.judgments(spark, sf).where("record_id % 97 <> 0").groupBy("judge").count().collect()} and len(got) == 6
    fits = {(r.k, r.item): r.score for r in q["judge_btl"](spark, sf).collect()}
    assert {k for k, _ in fits} == {0, 1, 2, 3}


def test_sweeps_have_their_levels(spark, sf):
    from pairforge.plans import catalog

    q = catalog.queries()
    for name, levels in (("sweep_budget", {50, 100, 200, 400, 800, 1600, -1}), ("sweep_noise", {0, 1, 2, 4, 8})):
        rows = q[name](spark, sf).collect()
        assert {r.level for r in rows} == levels and len(rows) == len(levels) * 2 * 4 and not any(r.error for r in rows)


def test_bpe_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pairforge.functions.tokens import bpe_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b c", None, "", "wörter und 12 words", "word " * 30_000, " " * 1_000_000]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "text string").select(bpe_tokens(F.col("text"), path).alias("n")).collect()]
    whole = Tokenizer.from_file(path)
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got[:4] == want[:4] and all(w <= g <= 1.1 * w + 1 for g, w in zip(got[4:5], want[4:5], strict=True)) and got[5] >= want[5]
