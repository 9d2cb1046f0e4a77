"""Collection and stored results as queries: jobs and messages, validity, a run with a stub client, and study rows that are written, read back and summarised."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import collect as C
from ..operators.lineage import scratch
from ..sources import fixture as fx
from ..sources import results as R
from .base import RECORDS, query
from .studies import GRID, results

R9 = lambda c: F.round(c, 9)  # noqa: E731  means of thousandths often lie half-way at six places
PROMPT = C.check_prompt("p1", "Judge.", "$question / ${assistant_a_label}: $assistant_a_response / $assistant_b_label: $assistant_b_response")
JUDGES = [{"name": "j1", "model": "m1", "fingerprint": "f1"}, {"name": "j2", "model": "m2", "fingerprint": "f2"}]


def benchmark(spark, sf: str) -> DataFrame:  # noqa: ANN001
    """Records with a prompt and two responses."""
    r = fx.records(spark, sf)
    text = lambda x, c: F.concat(F.lit(f"{x} says "), F.col(c))
    return r.select(F.col("record_id").cast("string").alias("id"), F.lit("s").alias("evaluation_session_id"), F.lit(0).alias("evaluation_order"), "model_a", "model_b", "winner", F.concat(F.lit("Q"), F.col("record_id").cast("string")).alias("prompt"), text("A", "model_a").alias("response_a"), text("B", "model_b").alias("response_b"), (F.col("record_id") >= 0).alias("prompts_match"))


_JOBS = RECORDS + """,
jobs AS (SELECT record_id::VARCHAR AS id, k.judge, k.model, k.f, o.d, CASE WHEN o.d THEN 'model_a' ELSE 'model_b' END AS side_a, CASE WHEN o.d THEN 'original' ELSE 'swapped' END || '_anonymous' AS condition,
  'Q' || record_id || ' / Assistant A: ' || CASE WHEN o.d THEN 'A says ' || model_a ELSE 'B says ' || model_b END || ' / Assistant B: ' || CASE WHEN o.d THEN 'B says ' || model_b ELSE 'A says ' || model_a END AS body
  FROM records, (VALUES ('j1', 'm1', 'f1'), ('j2', 'm2', 'f2')) k(judge, model, f), (VALUES (true), (false)) o(d))"""


@query("""SELECT id, judge, condition, side_a, sha256('[{"content":"Judge.","role":"system"},{"content":"' || body || '","role":"user"}]') AS prompt_hash, substr(sha256(concat_ws(chr(31), id, judge, model, f, d::VARCHAR, 'true', '0')), 1, 32) AS request_key FROM jobs""", _JOBS)
def collection_jobs(spark, sf):
    """Two judges' jobs over all records, in both display orders."""
    d = C.build_jobs(benchmark(spark, sf), JUDGES, PROMPT)
    return d.select("id", F.col("judge.name").alias("judge"), "condition", "side_a", "prompt_hash", "request_key")


@query("SELECT record_id, record_id % 8 IN (0, 7) AS valid FROM records", RECORDS)
def valid_records(spark, sf):
    """Records with one fault each, by their id: a null, a blank, an unknown winner, ...; prompts that don't match are judged apart."""
    r = benchmark(spark, sf).withColumn("at", F.col("id").cast("long") % 8)
    bad = lambda n, c, v: F.when(F.col("at") == n, v).otherwise(F.col(c))
    none = F.lit(None).cast("string")
    r = r.withColumns({"prompt": bad(1, "prompt", none), "model_a": bad(2, "model_a", F.lit(" \n")), "winner": bad(3, "winner", F.lit("nobody")), "evaluation_order": F.when(F.col("at") != 4, 0), "response_b": bad(5, "response_b", F.lit("")), "evaluation_session_id": bad(6, "evaluation_session_id", none)})
    return r.select(F.col("id").cast("long").alias("record_id"), C.valid_record().alias("valid"))


def stub_client(judge: str, body: str) -> str:
    """A reply by hash of the request: a verdict in one of several shapes, one without, or a failure."""
    u = int(hashlib.md5(f"{judge}|{json.loads(body)[-1]['content']}".encode()).hexdigest()[:7], 16)
    if u % 11 == 0:
        raise C.JudgeError("HTTP 401: no", "authentication")
    return ("a 5", "Reasons.\nFinal answer:\nb 2", "C.\nConfidence: 9", "I can't say.")[u % 4]


@query(name="collect_run")
def collect_run(spark, sf):
    """Answers of a stub client through the runner, by judge and outcome; a second run over what is stored asks only for what failed."""
    jobs = C.build_jobs(benchmark(spark, sf), JUDGES, PROMPT)
    path, errors = scratch(spark, "answers"), scratch(spark, "errors")
    none = spark.createDataFrame([], "request_key string")
    C.run_collection(jobs, none, stub_client, path, errors, pause=lambda s: None)
    stored = spark.read.schema("request_key string, judge string, choice string, canonical_verdict string, condition string").json(path)
    failed = spark.read.schema("request_key string, judge string, error_category string, condition string").json(errors)
    out = stored.groupBy("judge", "condition", F.col("canonical_verdict").alias("outcome")).agg(F.count("*").alias("n"))
    return out.union(failed.groupBy("judge", "condition", "error_category").agg(F.count("*").alias("n")))


# The rows of a study over the comparisons (studies.results), written as lines of two schemas: odd seeds in the old one. What a row says beside its measures goes by hash.
_ROWS = GRID + """,
cells AS (SELECT s.*, r.seed, m.method, r.excess AS e, r.tau AS t FROM (VALUES ('order', 'none', 0.0::DOUBLE), ('order', 'none', 1.0), ('noise', 'anti', 0.0), ('noise', 'anti', 1.0), ('noise', 'position', 1.0), ('noise', 'position', 2.0)) s(sweep, kind, level),
  (VALUES ('human_only', 'human_only'), ('consensus_cal', 'pooled'), ('joint_mu', 'weighted')) m(method, of) JOIN results r ON r.sweep = 'order' AND r.panel = 'all' AND r.level = s.level::INT AND r.method = m.of),
hashed AS (SELECT *, CAST('0x' || substr(md5(sweep || '|' || kind || '|' || level::INT || '|' || seed || '|' || method), 1, 7) AS BIGINT) AS u FROM cells),
own AS (SELECT sweep, 'all' AS panel, kind, level, -1 AS n_H_level, CAST(seed AS INT) AS seed, method, CASE WHEN u % 17 > 0 THEN e END AS excess, t AS tau, CASE u % 5 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 1 THEN 0 ELSE u % 50 END AS lam,
  CASE WHEN u % 5 > 0 THEN (u % 7)::DOUBLE END AS lam_rel, u % 13 = 0 OR (seed % 2 = 0 AND u % 19 = 0) AS failed, u % 13 = 0 AS raised, seed % 2 = 0 AND u % 19 = 0 AS dropped, CASE u % 3 WHEN 0 THEN false WHEN 1 THEN true END AS converged, u % 2 AS n_at_bound, (100 + u % 3)::DOUBLE AS n_h FROM hashed),
loaded AS (SELECT * FROM own UNION ALL SELECT * REPLACE ('position' AS kind) FROM own WHERE sweep = 'noise' AND level = 0)"""


def stored_rows(spark, sf) -> DataFrame:  # noqa: ANN001
    """Writes the lines, bare Infinity and NaN among them, and reads them back."""
    r = results(spark, sf).where("sweep = 'order' and panel = 'all'").select("seed", F.col("level").alias("at"), F.col("method").alias("of"), F.col("excess").alias("e"), F.col("tau").alias("t"))
    cells = [("order", "none", 0), ("order", "none", 1), ("noise", "anti", 0), ("noise", "anti", 1), ("noise", "position", 1), ("noise", "position", 2)]
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("sweep"), F.lit(b).alias("kind"), F.lit(c).alias("level")) for a, b, c in cells))).alias("c")
    name = F.when(F.col("of") == "pooled", "consensus_cal").when(F.col("of") == "weighted", "joint_mu").when(F.col("of") == "human_only", F.col("of"))
    d = r.select("*", at).select("seed", "at", "e", "t", "c.*", name.alias("method")).where("at = level and method is not null")
    d = d.withColumn("u", S.uniform28("sweep", "kind", F.col("level").cast("string"), F.col("seed").cast("string"), "method"))
    u, old = F.col("u"), F.col("seed") % 2 == 1
    word = lambda name, value: F.concat(F.lit(f', "{name}": '), value.cast("string"))
    lam = F.when(u % 5 == 0, "Infinity").when(u % 5 == 1, "0.0").otherwise(F.concat((u % 50).cast("string"), F.lit(".0")))
    line = F.concat(
        F.lit('{"panel": "all", "sweep": "'), F.col("sweep"), F.lit('", "kind": "'), F.col("kind"), F.lit('", "method": "'), F.col("method"), F.lit('"'), word("level", F.col("level").cast("double")), word("seed", F.col("seed")),
        word("excess", F.when(u % 17 == 0, "NaN").otherwise(F.coalesce(F.col("e").cast("string"), F.lit("NaN")))), word("ref_kendall", F.col("t")), word("lam", lam), word("lam_rel", F.when(u % 5 == 0, "Infinity").otherwise((u % 7).cast("double").cast("string"))),
        F.when(u % 13 == 0, ', "error": "x"').otherwise(""), F.when(u % 3 == 2, "").otherwise(word("converged", u % 3 == 1)), word("n_at_bound", u % 2),
        F.when(old, word("n_0", (100 + u % 3).cast("double"))).otherwise(F.concat(word("n_H", (100 + u % 3).cast("double")), F.lit(', "n_H_level": -1'), word("all_dropped", u % 19 == 0))), F.lit("}"),
    )
    path = scratch(spark, "rows")
    d.select(line.alias("value")).write.text(path)
    return R.read_rows(spark, path)


@query("SELECT sweep, panel, kind, level, n_H_level, seed, method, round(excess, 9) AS excess, lam_rel, failed, n_h AS n_H FROM loaded", _ROWS)
def study_load(spark, sf):
    return stored_rows(spark, sf).select("sweep", "panel", "kind", "level", "n_H_level", "seed", "method", R9("excess").alias("excess"), "lam_rel", "failed", "n_H")


_BY = "sweep, panel, kind, level, n_H_level, method"


@query(
    f"""SELECT {_BY}, n, round(excess_mean, 9) AS excess_mean, round(excess_se, 9) AS excess_se, round(n_H_mean, 9) AS n_H_mean, lam_rel_med, round(lam_inf_frac, 9) AS lam_inf_frac, round(lam_zero_frac, 9) AS lam_zero_frac, round(nonconv_frac, 9) AS nonconv_frac, round(sep_frac, 9) AS sep_frac,
  0.0::DOUBLE AS bsep_frac, 0.0::DOUBLE AS k_dropped_mean, 1.0::DOUBLE AS ho_exists_frac, round(d_excess_mean, 9) AS d_excess_mean, round(d_excess_se, 9) AS d_excess_se, coalesce(n_failed, 0) AS n_failed FROM
  (SELECT {_BY}, count(*) AS n, avg(excess) AS excess_mean, stddev_samp(excess) / sqrt(count(excess)) AS excess_se, avg(n_h) AS n_H_mean, median(lam_rel) AS lam_rel_med, avg(isinf(lam)::INT) AS lam_inf_frac, avg((lam = 0)::INT) AS lam_zero_frac, avg((NOT coalesce(converged, true))::INT) AS nonconv_frac, avg((n_at_bound > 0)::INT) AS sep_frac FROM loaded WHERE NOT failed GROUP BY ALL)
  LEFT JOIN (SELECT {_BY}, avg(d) AS d_excess_mean, stddev_samp(d) / sqrt(count(d)) AS d_excess_se FROM (SELECT a.* EXCLUDE (excess), a.excess - b.excess AS d FROM loaded a JOIN loaded b USING (sweep, panel, kind, level, n_H_level, seed) WHERE b.method = 'human_only' AND NOT a.failed AND NOT b.failed) GROUP BY ALL) USING ({_BY})
  LEFT JOIN (SELECT {_BY}, count(*) AS n_failed FROM loaded WHERE failed GROUP BY ALL) USING ({_BY})""",
    _ROWS,
)
def study_summary(spark, sf):
    d = R.summary(stored_rows(spark, sf))
    keep = ("excess_mean", "excess_se", "n_H_mean", "lam_inf_frac", "lam_zero_frac", "nonconv_frac", "sep_frac", "bsep_frac", "k_dropped_mean", "ho_exists_frac", "d_excess_mean", "d_excess_se")
    return d.select(*R.KEY, "method", "n", "lam_rel_med", "n_failed", *(R9(c).alias(c) for c in keep))


@query(f"SELECT {_BY}, count(*) AS seeds, round(avg(excess), 9) AS excess, round(avg(tau), 9) AS tau, round(avg(d1), 9) AS delta_first, round(stddev_samp(d1) / sqrt(count(d1)), 9) AS paired_mcse, round(avg(d2), 9) AS delta_second, round(avg(isinf(lam)::INT), 9) AS infinite_share FROM (SELECT a.*, a.excess - b.excess AS d1, a.excess - c.excess AS d2 FROM loaded a LEFT JOIN (FROM loaded WHERE method = 'joint_mu') b USING (sweep, panel, kind, level, n_H_level, seed) LEFT JOIN (FROM loaded WHERE method = 'consensus_cal') c USING (sweep, panel, kind, level, n_H_level, seed)) GROUP BY ALL", _ROWS)
def study_paired(spark, sf):
    d = R.paired_summary(stored_rows(spark, sf))
    return d.select(*R.KEY, "method", "seeds", *(R9(c).alias(c) for c in ("excess", "tau", "delta_first", "paired_mcse", "delta_second", "infinite_share")))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE raised) AS exception_rows, count(*) FILTER (WHERE NOT converged) AS nonconverged_rows, count(*) FILTER (WHERE dropped) AS all_dropped_rows FROM loaded", _ROWS)
def study_diag(spark, sf):
    return R.diagnostics(stored_rows(spark, sf))
