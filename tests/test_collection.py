"""Prompts, jobs, the runner, chunks, settings and stored results."""

import json

import pytest
from pyspark.sql import functions as F

from pairforge.operators import collect as C
from pairforge.operators import ordered
from pairforge.plans import cells, collection
from pairforge.sources import config as G
from pairforge.sources import results as R
from pairforge.sources.ledger import Ledger

TEMPLATE = "$question $assistant_a_label $assistant_a_response ${assistant_b_label} $assistant_b_response for $$5"
RECORD = "id string, evaluation_session_id string, evaluation_order int, model_a string, model_b string, winner string, prompt string, response_a string, response_b string, prompts_match boolean"


def records(spark, *changes):
    base = {"id": "r", "evaluation_session_id": "s", "evaluation_order": 0, "model_a": "x", "model_b": "y", "winner": "tie", "prompt": "why $question?", "response_a": "ra", "response_b": "rb", "prompts_match": True}
    return spark.createDataFrame([tuple((base | {"id": f"r{k}"} | c).values()) for k, c in enumerate(changes)], RECORD)


def test_prompts_are_checked():
    one = C.check_prompt("p", "sys", TEMPLATE)
    assert one["fingerprint"] == C.check_prompt("p", "sys", TEMPLATE)["fingerprint"] != C.check_prompt("q", "sys", TEMPLATE)["fingerprint"] and len(one["fingerprint"]) == 64
    for odd in (("", "sys", TEMPLATE), ("p", " ", TEMPLATE), ("p", "sys", TEMPLATE + " $other"), ("p", "sys", "$question"), ("p", "sys", TEMPLATE + " $ 5")):
        with pytest.raises(ValueError):
            C.check_prompt(*odd)


def test_jobs_swap_sides_and_hash_their_messages(spark):
    prompt, judges = C.check_prompt("p", "sys \"é\"", TEMPLATE), [{"name": "j", "model": "m", "fingerprint": "f"}]
    jobs = {r.response_order_default: r for r in C.build_jobs(records(spark, {}), judges, prompt, anonymous=False).collect()}
    assert jobs[True].messages[1].content == "why $question? Assistant A (model: x) ra Assistant B (model: y) rb for $5" and jobs[True].condition == "original_named"
    assert jobs[False].messages[1].content == "why $question? Assistant A (model: y) rb Assistant B (model: x) ra for $5" and (jobs[False].side_a, jobs[False].side_b) == ("model_b", "model_a")
    want = [{"role": "system", "content": 'sys "é"'}, {"role": "user", "content": jobs[True].messages[1].content}]
    assert jobs[True].prompt_hash == __import__("hashlib").sha256(G.canonical_json(want).encode()).hexdigest() and jobs[True].request_key != jobs[False].request_key
    faults = ({"winner": "z"}, {"prompt": " "}, {"model_a": None}, {"prompts_match": False})
    assert [r.v for r in records(spark, {}, *faults[:3], {"prompts_match": None}).select(C.valid_record().alias("v"), "id").orderBy("id").collect()] == [True, False, False, False, True]
    for fault in faults:
        with pytest.raises(Exception, match="can't be judged"):
            C.build_jobs(records(spark, fault), judges, prompt).collect()


def test_runner_retries_stores_and_resumes(spark, tmp_path):
    jobs = C.build_jobs(records(spark, *[{"prompt": f"q{k}"} for k in range(12)]), [{"name": "j", "model": "m", "fingerprint": "f"}], C.check_prompt("p", "sys", TEMPLATE))
    log = tmp_path / "log"
    log.mkdir()

    def client(judge, body):
        from pathlib import Path

        text = json.loads(body)[-1]["content"]
        n = int(text.split()[0][1:])
        seen = Path(log, text.replace(" ", "_"))
        tries = len(seen.read_text()) if seen.exists() else 0
        seen.write_text("x" * (tries + 1))
        if n == 0:
            raise C.JudgeError("HTTP 401", "authentication")
        if n == 1:
            raise C.JudgeError("HTTP 503", "server")
        if n == 2 and tries == 0:
            raise C.JudgeError("reset", "network")
        return "no verdict" if n == 3 else "a 9" if n % 2 else "B.\nConfidence: 2"

    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    none = spark.createDataFrame([], "request_key string")
    assert C.run_collection(jobs, none, client, good, bad, retries=2, pause=lambda s: None) == (18, 6)
    rows = {(r.record_id, r.response_order_default): r for r in spark.read.json(good).collect()}
    assert (rows["r5", True].choice, rows["r5", True].confidence, rows["r5", True].canonical_verdict, rows["r5", True].attempts) == ("a", 5, "model_a", 1)
    assert (rows["r4", False].canonical_verdict, rows["r2", True].attempts) == ("model_a", 2)
    errors = {r.record_id: (r.error_category, r.attempts, r.stage) for r in spark.read.json(bad).collect()}
    assert errors == {"r0": ("authentication", 1, "collect"), "r1": ("server", 3, "collect"), "r3": ("invalid_response", 3, "collect")}
    again = C.run_collection(jobs, spark.read.json(good), client, good, bad, retries=0, pause=lambda s: None)
    assert again == (0, 6)


def test_chunks_by_bytes_and_oversize(spark):
    rows = spark.createDataFrame([("a", k, t, b) for k, (t, b) in enumerate([(1, 4), (1, 4), (1, 4), (1, 20), (1, 1)])], "g string, o int, tokens int, bytes int")
    got = sorted((r.o, r.chunk) for r in ordered.greedy_chunks(rows, "g", "o", 9, 9, 8).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, -1), (4, 1)]
    with pytest.raises(Exception, match="over the limit"):
        ordered.greedy_chunks(rows, "g", "o", 9, 9, 8, strict=True).collect()


def test_messages_and_replies(spark):
    part = "type string, text string, thought boolean"
    d = spark.createDataFrame([([("thinking", "hm", True), ("text", "a ", None), ("output_text", "5", False), ("text", None, None)],), ([("text", " ", None)],), ([],)], f"parts array<struct<{part.replace(' ', ':', 0)}>>".replace("type string", "type:string").replace("text string", "text:string").replace("thought boolean", "thought:boolean"))
    assert [r.t for r in d.select(C.response_text(F.col("parts")).alias("t")).collect()] == ["a 5", None, None]
    m = spark.createDataFrame([([("s1", "system"), ("u", "user"), ("s2", "system")],), ([("u", "user")],)], "m array<struct<content:string,role:string>>")
    system, talk = C.split_messages(F.col("m"))
    assert [(r.s, [x.content for x in r.t]) for r in m.select(system.alias("s"), talk.alias("t")).collect()] == [("s1\n\ns2", ["u"]), (None, ["u"])]
    batch = spark.createDataFrame([("k", 2, "later"), ("k", 1, "first"), ("l", 3, "only")], "request_key string, line int, text string")
    assert {r.request_key: r.text for r in C.first_answers(batch).collect()} == {"k": "first", "l": "only"}


def test_settings(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"a": 1, "b": {"x": 1, "x": 2}}')
    with pytest.raises(ValueError, match="repeats"):
        G.read_json(path)
    path.write_text("[1]")
    with pytest.raises(ValueError, match="object"):
        G.read_json(path)
    (tmp_path / "c.toml").write_text('[a]\nn = { x = 1, y = 2 }\n')
    assert G.per_dataset(G.read_toml(tmp_path / "c.toml")["a"]["n"], "y") == 2 and G.per_dataset(7, "y") == 7
    assert G.canonical_json({"b": 1, "a": ["é", None]}) == '{"a":["é",null],"b":1}' and G.fingerprint({"b": 1, "a": 2}) == G.fingerprint({"a": 2, "b": 1}) and len(G.fingerprint(1)) == 16
    assert G.has_secret({"x": [{"Auth-Token": "t"}]}) and G.has_secret({"api_key": 1}) and not G.has_secret({"api_key_env": "NAME", "tokens": 3})
    for bad in (0, True, 1.5, "2"):
        with pytest.raises(ValueError):
            G.positive_int(bad, "n")
    with pytest.raises(ValueError, match="unknown"):
        G.known_fields({"a": 1, "b": 2}, {"a"}, "x")
    can = {"reasoning_modes": ["disabled", "enabled"], "reasoning_efforts": ["low"], "temperature_allowed_during_reasoning": False, "seed_supported": True}
    fine = {"temperature": 0, "max_output_tokens": 9, "reasoning": {"mode": "disabled"}}
    G.check_inference(fine, can, "j")
    for change in ({"max_output_tokens": None}, {"temperature": True}, {"reasoning": {"mode": "x"}}, {"reasoning": {"mode": "disabled", "effort": "low"}}, {"reasoning": {"mode": "required"}}, {"temperature": None, "reasoning": {"mode": "enabled", "effort": "high"}}, {"reasoning": {"mode": "enabled"}}, {"other": 1}):
        with pytest.raises(ValueError):
            G.check_inference(fine | change, can, "j")
    for change in ({"reasoning_modes": []}, {"reasoning_modes": ["disabled"]}, {"seed_supported": None}, {"reasoning_efforts": ["a", "a"]}):
        with pytest.raises(ValueError):
            G.check_inference(fine, can | change, "j")
    with pytest.raises(ValueError, match="one judge"):
        G.distinct_judges({"a": {"model": "m"}, "b": {"model": "m"}})
    assert G.judge_fingerprint({"model": "m"}, "p") != G.judge_fingerprint({"model": "m"}, "q")
    meta = tmp_path / "run" / "metadata.json"
    G.guard_settings(meta, {"judge": "a"})
    G.guard_settings(meta, {"judge": "a"})
    with pytest.raises(ValueError, match="judge"):
        G.guard_settings(meta, {"judge": "b"})
    G.merge_state(tmp_path / "state.json", "b1", status="sent", n=3)
    assert G.merge_state(tmp_path / "state.json", "b1", status="done") == {"b1": {"status": "done", "n": 3}} == G.read_json(tmp_path / "state.json")
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    known = G.check_dataset(spark, str(tmp_path / "t"), 5)
    with pytest.raises(ValueError, match="digest"):
        G.check_dataset(spark, str(tmp_path / "t"), sha256="0" + known["sha256"][1:] if known["sha256"][0] != "0" else "1")


def test_stored_rows_are_summarised_and_written(spark, sf, tmp_path):
    rows = collection.stored_rows(spark, sf)
    R.write_csv(R.summary(rows), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 21
    R.write_json(R.diagnostics(rows), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().rows == 420


def test_cells_resume(spark, sf, tmp_path):
    s = cells.Study(spark, sf, ("biased",), seeds=1)
    rows = cells._levels(s.rows, 0.0, 1.0).withColumns({"kind": F.lit("none"), "rho_swap": F.col("level")})
    only, path = ("human_only", "consensus_cal"), str(tmp_path / "cells")
    one = lambda done: s.run("order", rows.where("level = 1"), only=only, done=done)
    both = lambda done: s.run("order", rows, only=only, done=done)
    assert [cells.run_cells(f, path, only) for f in (one, both, both)] == [2, 2, 0]
    stored = Ledger(spark, path, ()).read()
    assert stored.select("level", "method").distinct().count() == 4 == stored.count() and stored.where("error is not null").count() == 0
    assert cells.run_cells(lambda done: s.run("order", rows, only=("human_only", "pooled_cal"), done=done), path, ("human_only", "pooled_cal")) == 2  # one row of a key: human_only is there already


def test_runner_leaves_only_what_is_stored(spark, tmp_path):
    """Answers are stored compressed, and the table that both sinks are written from is gone."""
    from pathlib import Path

    from pairforge.operators.lineage import scratch

    jobs = C.build_jobs(records(spark, *[{"prompt": f"q{k}"} for k in range(12)]), [{"name": "j", "model": "m", "fingerprint": "f"}], C.check_prompt("p", "sys", TEMPLATE))
    top = Path(scratch(spark, "x").removeprefix("file:")).parent
    before = set(top.iterdir())
    assert C.run_collection(jobs, spark.createDataFrame([], "request_key string"), lambda *a: "a 5", str(tmp_path / "good"), str(tmp_path / "bad"))[1] == 0
    assert set(top.iterdir()) == before
    assert all(p.suffix == ".gz" for p in (tmp_path / "good").glob("part-*"))
