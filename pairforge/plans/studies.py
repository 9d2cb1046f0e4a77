"""Study designs, result tables and their summaries; cells fan out as grouped tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..kernel import solver as K
from ..operators import panel as P
from ..operators import sampling as X
from ..operators.lineage import cut, scratch
from ..sources import fixture as fx
from ..sources.readers import read_results
from .base import PANEL, query
from .estimation import TRUTH, split
from .relational import R6, human, llm

METHODS = ("human_only", "pooled", "mean", "weighted")
KEY = ["sweep", "panel", "level", "method"]
#: Weights of the judges' scores beside the humans'; none: the judges' alone.
WEIGHTS = (None, 10.0, 3.0, 1.0, 0.0)
_UNIT = "CAST('0x' || substr(md5(record_id || '|low'), 1, 7) AS BIGINT) / 268435456.0::DOUBLE"
# A study over the derived comparisons: a fold of records is held out; scores are log odds of wins, of the humans' and of the judges' rows that a level and panel leave.
GRID = (
    PANEL
    + f""",
jobs AS (SELECT s.sweep, p.panel, l.level, d.seed FROM (VALUES ('order'),('budget')) s(sweep), (VALUES ('all'),('small')) p(panel), (VALUES (0),(1),(2)) l(level), (SELECT DISTINCT record_id % 20 AS seed FROM records) d WHERE s.sweep = 'order' OR l.level > 0),
lc AS (SELECT record_id % 20 AS fold, k, a, i, j, count(*)::DOUBLE AS n, sum(y2) / 2.0::DOUBLE AS w FROM llm GROUP BY ALL),
hc AS (SELECT record_id % 20 AS fold, {_UNIT} < 0.1 AS low, i, j, count(*)::DOUBLE AS n, sum(y2) / 2.0::DOUBLE AS w FROM human GROUP BY ALL),
ls AS (SELECT sweep, panel, level, seed, item, sum(m) AS n, sum(v) AS w FROM jobs JOIN lc ON fold <> seed AND (panel = 'all' OR k <= 1) AND (sweep = 'budget' OR level = 2 OR a = 1 OR level = 1 AND fold % 4 = 0), LATERAL (VALUES (i, n, w), (j, n, n - w)) t(item, m, v) GROUP BY ALL),
hs AS (SELECT sweep, panel, level, seed, item, sum(m) AS n, sum(v) AS w FROM jobs JOIN hc ON fold <> seed AND (sweep = 'order' OR level = 2 OR low), LATERAL (VALUES (i, n, w), (j, n, n - w)) t(item, m, v) GROUP BY ALL),
odds AS (SELECT jobs.*, idx AS item, coalesce(h.n, 0) AS hn, coalesce(l.n, 0) AS ln, ln((coalesce(h.w, 0) + 0.5) / (coalesce(h.n - h.w, 0) + 0.5)) AS h, ln((coalesce(l.w, 0) + 0.5) / (coalesce(l.n - l.w, 0) + 0.5)) AS l
  FROM jobs, items LEFT JOIN hs h ON h.sweep = jobs.sweep AND h.panel = jobs.panel AND h.level = jobs.level AND h.seed = jobs.seed AND h.item = idx LEFT JOIN ls l ON l.sweep = jobs.sweep AND l.panel = jobs.panel AND l.level = jobs.level AND l.seed = jobs.seed AND l.item = idx),
scores AS (SELECT sweep, panel, level, seed, item, method, CASE method WHEN 'human_only' THEN h WHEN 'pooled' THEN l WHEN 'mean' THEN (h + l) / 2 ELSE (hn * h + ln * l) / greatest(hn + ln, 1) END AS s, hn, ln FROM odds, (VALUES ('human_only'), ('pooled'), ('mean'), ('weighted')) m(method)),
held AS (SELECT fold, i, j, sum(n) AS n, sum(w) AS w FROM hc GROUP BY ALL),
losses AS (SELECT a.sweep, a.panel, a.level, a.seed, a.method, sum(n) AS n, sum(w * ln(1 + exp(b.s - a.s)) + (n - w) * ln(1 + exp(a.s - b.s))) AS loss, sum(CASE WHEN a.s > b.s THEN w ELSE n - w END) AS hits
  FROM held JOIN scores a ON a.seed = fold AND a.item = i JOIN scores b USING (sweep, panel, level, seed, method) WHERE b.item = j GROUP BY ALL),
sizes AS (SELECT sweep, panel, level, seed, method, min(CASE WHEN method = 'human_only' THEN hn WHEN method = 'pooled' THEN ln ELSE least(hn, ln) END) AS least, sum(ln) / greatest(sum(hn), 1) AS ratio, max(abs(s)) AS far FROM scores GROUP BY ALL),
results AS (SELECT sweep, panel, level, CAST(seed AS INT) AS seed, method, CASE WHEN least > 0 THEN loss / n - ln(2) END AS excess, 2 * hits / n - 1 AS tau, CASE method WHEN 'weighted' THEN ratio WHEN 'human_only' THEN 0 END AS lam, least = 0 AS failed, far > 0.08 AS irregular FROM losses JOIN sizes USING (sweep, panel, level, seed, method))"""
)
_PATH_ROWS = GRID + """,
path AS (SELECT lam, sum(w * ln(1 + exp(b - a)) + (n - w) * ln(1 + exp(a - b))) / sum(n) AS gacv, count(DISTINCT fold) > 1 AS regular FROM (SELECT fold, n, w, lam, CASE WHEN lam IS NULL THEN x.l ELSE (x.h + lam * x.l) / (1 + lam) END AS a, CASE WHEN lam IS NULL THEN y.l ELSE (y.h + lam * y.l) / (1 + lam) END AS b
  FROM held JOIN odds x ON x.seed = fold AND x.item = i JOIN odds y ON y.seed = fold AND y.item = j AND y.sweep = x.sweep AND y.panel = x.panel AND y.level = x.level, (VALUES (NULL::DOUBLE), (10.0), (3.0), (1.0), (0.0)) t(lam) WHERE x.sweep = 'budget' AND x.panel = 'all' AND x.level = 1) GROUP BY 1)"""


def job_table(spark, sf) -> DataFrame:
    """sweep x panel x level x seed, a seed for each fold of the records; level 0 only where the sweep has a base."""
    arr = lambda *v: F.explode(F.array(*map(F.lit, v)))
    d = fx.records(spark, sf).select((F.col("record_id") % 20).cast("int").alias("seed")).distinct().select("seed", arr("order", "budget").alias("sweep")).select("*", arr("all", "small").alias("panel")).select("*", arr(0, 1, 2).alias("level"))
    return d.where((F.col("sweep") == "order") | (F.col("level") > 0)).select("sweep", "panel", "level", "seed")


_JOB = ["sweep", "panel", "level", "seed"]


def _held(spark, sf) -> DataFrame:
    """Human counts by fold, the share that a low budget has, and pair."""
    low = S.uniform(F.col("record_id").cast("string"), F.lit("low")) < 0.1
    rows = human(spark, sf).select((F.col("record_id") % 20).cast("int").alias("fold"), low.alias("low"), "i", "j", "y2")
    return rows.groupBy("fold", "low", "i", "j").agg(F.count("*").cast("double").alias("n"), (F.sum("y2") / 2.0).alias("w"))


def odds(spark, sf, people: DataFrame) -> DataFrame:
    """(job, item, hn, ln, h, l): comparisons and log odds of wins of each item, by humans and by judges, without the job's fold. Rows are counted by fold before they meet the jobs."""
    jobs = cut(job_table(spark, sf))
    judges = llm(spark, sf).select((F.col("record_id") % 20).cast("int").alias("fold"), "k", "a", "i", "j", "y2").groupBy("fold", "k", "a", "i", "j").agg(F.count("*").cast("double").alias("n"), (F.sum("y2") / 2.0).alias("w"))

    def side(counts: DataFrame, rule: Column, name: str) -> DataFrame:
        ends = F.inline(F.array(F.struct(F.col("i").alias("item"), F.col("n").alias("m"), F.col("w").alias("v")), F.struct(F.col("j").alias("item"), F.col("n").alias("m"), (F.col("n") - F.col("w")).alias("v"))))
        met = jobs.join(F.broadcast(counts), (F.col("fold") != F.col("seed")) & rule).select(*_JOB, ends)  # a row for each fold and pair of few items
        return met.groupBy(*_JOB, "item").agg(F.sum("m").alias(f"{name}n"), F.sum("v").alias(f"{name}w"))

    order, two = F.col("sweep") == "order", F.col("level") == 2
    low = side(judges, ((F.col("panel") == "all") | (F.col("k") <= 1)) & (~order | two | (F.col("a") == 1) | (F.col("level") == 1) & (F.col("fold") % 4 == 0)), "l")
    high = side(people, order | two | F.col("low"), "h")
    every = jobs.join(F.broadcast(P.item_index(fx.records(spark, sf)).select(F.col("idx").alias("item"))), F.lit(True))
    both = every.join(high, [*_JOB, "item"], "left").join(low, [*_JOB, "item"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    log_odds = lambda c: F.log((zero(F.col(f"{c}w")) + 0.5) / (zero(F.col(f"{c}n") - F.col(f"{c}w")) + 0.5))
    return both.select(*_JOB, "item", zero(F.col("hn")).alias("hn"), zero(F.col("ln")).alias("ln"), log_odds("h").alias("h"), log_odds("l").alias("l"))


def _pairs_held(people: DataFrame, scores: DataFrame, *by: str) -> DataFrame:
    """Held-out pairs of each job with both items' scores."""
    held = people.groupBy(F.col("fold").alias("seed"), "i", "j").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    of = lambda at, name: scores.select(*by, F.col("item").alias(at), F.col("s").alias(name))
    return of("i", "x").join(F.broadcast(held), ["seed", "i"]).join(of("j", "z"), [*by, "j"])


def _loss() -> Column:
    return F.sum(F.col("w") * S.softplus(F.col("z") - F.col("x")) + (F.col("n") - F.col("w")) * S.softplus(F.col("x") - F.col("z")))


def results(spark, sf) -> DataFrame:
    """Result rows of the study, one per job and method: loss above even odds and sign agreement on the held-out fold."""
    people = cut(_held(spark, sf))
    d = cut(odds(spark, sf, people))
    h, l, hn, ln = (F.col(c) for c in ("h", "l", "hn", "ln"))
    s = F.when(F.col("method") == "human_only", h).when(F.col("method") == "pooled", l).when(F.col("method") == "mean", (h + l) / 2).otherwise((hn * h + ln * l) / F.greatest(hn + ln, F.lit(1.0)))
    scores = cut(d.select("*", F.explode(F.array(*map(F.lit, METHODS))).alias("method")).withColumn("s", s))
    by = [*_JOB, "method"]
    losses = _pairs_held(people, scores, *by).groupBy(*by).agg(F.sum("n").alias("n"), _loss().alias("loss"), F.sum(F.when(F.col("x") > F.col("z"), F.col("w")).otherwise(F.col("n") - F.col("w"))).alias("hits"))
    least = F.when(F.col("method") == "human_only", hn).when(F.col("method") == "pooled", ln).otherwise(F.least(hn, ln))
    sizes = scores.groupBy(*by).agg(F.min(least).alias("least"), (F.sum("ln") / F.greatest(F.sum("hn"), F.lit(1.0))).alias("ratio"), F.max(F.abs("s")).alias("far"))
    r = losses.join(sizes, by)
    lam = F.when(F.col("method") == "weighted", F.col("ratio")).when(F.col("method") == "human_only", 0.0)
    return r.select(*KEY, "seed", F.when(F.col("least") > 0, F.col("loss") / F.col("n") - F.log(F.lit(2.0))).alias("excess"), (2 * F.col("hits") / F.col("n") - 1).alias("tau"), lam.alias("lam"), (F.col("least") == 0).alias("failed"), (F.col("far") > 0.08).alias("irregular"))


def weight_path(spark, sf) -> DataFrame:
    """(lam, gacv, regular): mean held-out loss of the humans' scores with lam times the judges' (none: the judges' alone), with few human rows."""
    people = cut(_held(spark, sf))
    d = odds(spark, sf, people).where("sweep = 'budget' and panel = 'all' and level = 1").select(*_JOB, "item", "h", "l", F.explode(F.array(*map(F.lit, WEIGHTS))).alias("lam"))
    s = F.when(F.col("lam").isNull(), F.col("l")).otherwise((F.col("h") + F.col("lam") * F.col("l")) / (1 + F.col("lam")))
    d = cut(d.withColumn("s", s).withColumn("at", F.coalesce("lam", F.lit(-1.0))))
    pairs = _pairs_held(people, d, *_JOB, "at")
    return pairs.groupBy("at").agg((_loss() / F.sum("n")).alias("gacv"), (F.count_distinct("seed") > 1).alias("regular")).select(F.when(F.col("at") >= 0, F.col("at")).alias("lam"), "gacv", "regular")


def sem(c: str):  # noqa: ANN201
    """Standard error over what isn't null; null for one value."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


@query("SELECT sweep, panel, level, CAST(seed AS INT) AS seed FROM jobs", GRID)
def jobs(spark, sf):
    return job_table(spark, sf)


@query("SELECT sweep, panel, level, method, seed, round(excess, 6) AS excess, failed FROM results", GRID)
def explode_jobs(spark, sf):
    """Keyed lines in several files, written and read back; each line's rows are flattened, NaN becomes null."""
    key = F.array("sweep", "panel", F.col("level").cast("string"), F.col("seed").cast("string")).alias("key")
    row = F.concat(F.lit('{"method": "'), F.col("method"), F.lit('", "excess": '), F.coalesce(F.col("excess").cast("string"), F.lit("NaN")), F.lit(', "failed": '), F.col("failed").cast("string"), F.lit("}"))
    lines = results(spark, sf).groupBy(key).agg(F.array_join(F.collect_list(row), ", ").alias("rows"))
    path = scratch(spark, "jobs")
    lines.select(F.concat(F.lit('{"key": '), F.to_json("key"), F.lit(', "rows": ['), F.col("rows"), F.lit("]}")).alias("value")).repartition(3).write.text(path)
    flat = read_results(spark, path, "method:string,excess:double,failed:boolean")
    return flat.select(F.col("key")[0].alias("sweep"), F.col("key")[1].alias("panel"), F.col("key")[2].cast("int").alias("level"), "method", F.col("key")[3].cast("int").alias("seed"), R6("excess").alias("excess"), "failed")


@query("SELECT sweep, panel, level, method, seed, round(excess, 6) AS excess, failed FROM results", GRID)
def load_results(spark, sf):
    """Through the stored form: one JSON line per job with its rows nested, exploded again; bare NaN is null."""
    row = F.struct("method", "excess", "failed")
    stored = results(spark, sf).groupBy("sweep", "panel", "level", "seed").agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("line"))
    parsed = F.from_json("line", "rows array<struct<method:string,excess:double,failed:boolean>>")
    flat = stored.select("sweep", "panel", "level", "seed", F.explode(parsed["rows"]).alias("r"))
    return flat.select("sweep", "panel", "level", "r.method", "seed", R6(F.when(~F.isnan("r.excess"), F.col("r.excess"))).alias("excess"), "r.failed")


@query("SELECT r.sweep, r.panel, r.level, r.method, r.seed, b.sweep IS NOT NULL AS irregular FROM results r LEFT JOIN (SELECT DISTINCT sweep, panel, level, seed FROM results WHERE irregular) b USING (sweep, panel, level, seed)", GRID)
def load_sim(spark, sf):
    r = results(spark, sf)
    key = ["sweep", "panel", "level", "seed"]
    return r.drop("irregular").join(r.where("irregular").select(*key, F.lit(True).alias("bad")).distinct(), key, "left").select(*KEY, "seed", F.coalesce("bad", F.lit(False)).alias("irregular"))


_DIFF = GRID + ", diffs AS (SELECT r.sweep, r.panel, r.level, r.method, r.seed, r.excess - h.excess AS diff FROM results r JOIN results h USING (sweep, panel, level, seed) WHERE h.method = 'human_only')"


def diffs(spark, sf) -> DataFrame:
    r = results(spark, sf)
    base = r.where("method = 'human_only'").select("sweep", "panel", "level", "seed", F.col("excess").alias("base"))
    return r.join(base, ["sweep", "panel", "level", "seed"]).select(*KEY, "seed", (F.col("excess") - F.col("base")).alias("diff"))


@query("SELECT sweep, panel, level, method, seed, round(diff, 6) AS diff FROM diffs", _DIFF)
def paired_diff(spark, sf):
    return diffs(spark, sf).withColumn("diff", R6("diff"))


_AGG = "SELECT sweep, panel, level, method, count(*) AS n, round(avg(excess), 6) AS excess, round(stddev_samp(excess) / sqrt(count(excess)), 6) AS excess_se, round(avg(tau), 6) AS tau, round(median(lam), 6) AS lam_median, round(avg((lam IS NULL)::INT), 6) AS share_anchor, count(*) FILTER (WHERE failed) AS n_failed FROM results GROUP BY ALL"


def _aggregate(r: DataFrame, *key: str) -> DataFrame:
    return r.groupBy(*key).agg(F.count("*").alias("n"), R6(F.avg("excess")).alias("excess"), R6(sem("excess")).alias("excess_se"), R6(F.avg("tau")).alias("tau"), R6(F.percentile("lam", 0.5)).alias("lam_median"), R6(F.avg(F.col("lam").isNull().cast("int"))).alias("share_anchor"), F.count_if("failed").alias("n_failed"))


@query(_AGG, GRID)
def agg_results(spark, sf):
    return _aggregate(results(spark, sf), *KEY)


@query("SELECT method, round(stddev_samp(excess) / sqrt(count(excess)), 6) AS sem FROM results GROUP BY 1", GRID)
def sem_by_method(spark, sf):
    return results(spark, sf).groupBy("method").agg(R6(sem("excess")).alias("sem"))


@query("SELECT sweep, level, round(avg((excess > 0)::INT), 6) AS reject_rate, count(*) AS n FROM results GROUP BY ALL", GRID)
def agg_spectest(spark, sf):
    return results(spark, sf).groupBy("sweep", "level").agg(R6(F.avg((F.col("excess") > 0).cast("int"))).alias("reject_rate"), F.count("*").alias("n"))


@query("SELECT sweep, level, method, count(*) FILTER (WHERE NOT irregular) AS n, count(*) FILTER (WHERE irregular) AS n_irregular, round(avg(excess) FILTER (WHERE NOT irregular), 6) AS excess FROM results GROUP BY ALL", GRID)
def agg_sim(spark, sf):
    ok = ~F.col("irregular")
    return results(spark, sf).groupBy("sweep", "level", "method").agg(F.count_if(ok).alias("n"), F.count_if("irregular").alias("n_irregular"), R6(F.avg(F.when(ok, F.col("excess")))).alias("excess"))


@query("SELECT sweep, panel, level, method, round(avg(diff), 8) AS mean_diff, round(stddev_samp(diff) / sqrt(count(diff)), 8) AS se_diff FROM diffs GROUP BY ALL", _DIFF)
def summarize(spark, sf):
    return diffs(spark, sf).groupBy(*KEY).agg(F.round(F.avg("diff"), 8).alias("mean_diff"), F.round(sem("diff"), 8).alias("se_diff"))


@query("SELECT r.sweep, r.panel, r.level, r.method, round(avg(r.excess) - any_value(c.base), 6) AS delta FROM results r LEFT JOIN (SELECT sweep, panel, level, avg(excess) AS base FROM results WHERE method = 'pooled' GROUP BY ALL) c USING (sweep, panel, level) GROUP BY ALL", GRID)
def delta_vs_cons(spark, sf):
    r = results(spark, sf)
    base = r.where("method = 'pooled'").groupBy("sweep", "panel", "level").agg(F.avg("excess").alias("base"))
    return r.groupBy(*KEY).agg(F.avg("excess").alias("excess")).join(base, ["sweep", "panel", "level"], "left").select(*KEY, R6(F.col("excess") - F.col("base")).alias("delta"))


@query("SELECT sweep, panel, level, method, round(avg(excess), 6) AS excess, count(DISTINCT seed) = (SELECT count(DISTINCT seed) FROM jobs) AND count(*) = count(DISTINCT seed) AS complete FROM results WHERE sweep = 'budget' GROUP BY ALL", GRID)
def panel_budget(spark, sf):
    r = cut(results(spark, sf))
    seeds = r.agg(F.count_distinct("seed").alias("all"))
    d = r.where("sweep = 'budget'").groupBy(*KEY).agg(R6(F.avg("excess")).alias("excess"), F.count_distinct("seed").alias("seeds"), F.count("*").alias("rows"))
    return d.crossJoin(seeds).select(*KEY, "excess", ((F.col("seeds") == F.col("all")) & (F.col("rows") == F.col("seeds"))).alias("complete"))  # one row


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE irregular) AS n_irregular, count(*) FILTER (WHERE lam IS NULL) AS n_anchor FROM results", GRID)
def run_diag(spark, sf):
    return results(spark, sf).agg(F.count("*").alias("n_rows"), F.count_if("failed").alias("n_failed"), F.count_if("irregular").alias("n_irregular"), F.count_if(F.col("lam").isNull()).alias("n_anchor"))


@query("SELECT sweep, level FROM results WHERE method = 'human_only' GROUP BY ALL HAVING bool_and(NOT failed)", GRID)
def exists_budgets(spark, sf):
    return results(spark, sf).where("method = 'human_only'").groupBy("sweep", "level").agg(F.every(~F.col("failed")).alias("ok")).where("ok").select("sweep", "level")


@query("SELECT sweep, level, round(avg(excess) FILTER (WHERE method = 'human_only'), 6) AS human_only, round(avg(excess) FILTER (WHERE method = 'weighted'), 6) AS weighted FROM results GROUP BY ALL", GRID)
def pivot_methods(spark, sf):
    return results(spark, sf).groupBy("sweep", "level").pivot("method", ["human_only", "weighted"]).agg(R6(F.avg("excess")))


@query("SELECT method, round(avg(excess), 6) AS mean, round(median(excess), 6) AS median, round(quantile_cont(excess, 0.9), 6) AS q90 FROM results GROUP BY 1", GRID)
def excess_quantiles(spark, sf):
    return results(spark, sf).groupBy("method").agg(R6(F.avg("excess")).alias("mean"), R6(F.percentile("excess", 0.5)).alias("median"), R6(F.percentile("excess", 0.9)).alias("q90"))


@query("SELECT sweep, panel, level, seed FROM results WHERE NOT failed AND method IN ('weighted', 'human_only') GROUP BY ALL HAVING count(DISTINCT method) = 2", GRID)
def done_keys(spark, sf):
    have = results(spark, sf).where(~F.col("failed")).groupBy("sweep", "panel", "level", "seed").agg(F.collect_set("method").alias("have"))
    return have.where(F.size(F.array_except(F.array(F.lit("weighted"), F.lit("human_only")), "have")) == 0).select("sweep", "panel", "level", "seed")


# -- cells -----------------------------------------------------------------------------------------------------------

_CELL = "method string, excess double, accuracy double, lam double, error string"


def run_methods(c: K.Counts, i, j, n, y, truth: np.ndarray) -> list[tuple]:  # noqa: ANN001
    """All methods on one cell; a method that fails gives a row with its error and doesn't end the cell."""
    base = K.structured(c, 1)  # shared by the methods that start from the judges

    def human_only():  # noqa: ANN202
        return K.btl(i, j, n, y, c.N, firth=not K.mle_exists(i, j, n, y, c.N))[0], 0.0

    def consensus():  # noqa: ANN202
        return K.calibrate(base["mu"][:, None], i, j, n, y)["s"], None

    def staged():  # noqa: ANN202
        return K.calibrate(np.concatenate([base["mu"][:, None], base["V"]], 1), i, j, n, y)["s"], None

    def selected():  # noqa: ANN202
        best = K.chosen(K.select(c, i, j, n, y, 1))
        return best["s"], None if np.isinf(best["lam"]) else best["lam"]

    up, out = np.triu_indices(c.N, 1), []
    d0 = truth[up[0]] - truth[up[1]]
    for name, f in (("human_only", human_only), ("consensus_cal", consensus), ("staged_w", staged), ("joint", selected)):
        try:
            s, lam = f()
            d = s[up[0]] - s[up[1]]
            risk = lambda x: float(np.mean(np.logaddexp(0, x) - K.sigmoid(d0) * x))  # noqa: B023, E731
            out.append((name, risk(d) - risk(d0), float(np.mean(np.sign(d) == np.sign(d0))), lam, None))
        except Exception as e:  # noqa: BLE001  a row, not a failed task
            out.append((name, None, None, None, f"{type(e).__name__}: {e}"[:4000]))
    return out


def sweep(spark, sf, level_rows: DataFrame, budgets: tuple[int, ...] = ()) -> DataFrame:
    """Fits every (level, seed) cell: judge rows of the level, a human draw of 300 by seed; counts only reach the tasks.

    With budgets they are the levels, each with all judge rows and a human draw of that size (-1: all). Human rows are written once and numbered once per seed: smaller draws lie in larger ones.
    """
    if budgets:
        low = P.counts(level_rows, "k", "i", "j", "a").withColumn("level", F.explode(F.array(*(F.lit(float(b)) for b in budgets))))
    else:
        low = cut(P.counts(level_rows, "level", "k", "i", "j", "a"))  # the levels are taken from it, too
        levels = low.select("level").distinct()
    low = low.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed")).withColumn("side", F.lit("L"))
    people, sizes = cut(human(spark, sf)), F.explode(F.array(*(F.lit(float(n)) for n in budgets or (300,)))).alias("level")
    h = _union([X.ranked(people, f"h{s}", ("record_id",)).select("*", F.lit(s).alias("seed"), sizes) for s in (0, 1)])
    pairs = P.counts(h.where("level < 0 or r <= level"), "level", "seed", "i", "j")
    pairs = (pairs if budgets else pairs.drop("level").crossJoin(F.broadcast(levels))).withColumns({"side": F.lit("H"), "k": F.lit(0), "a": F.lit(0)})
    both = low.unionByName(pairs.select(*low.columns))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        c, i, j, n, y = split(p)
        used = np.unique(c.k)
        c.k, c.K = np.searchsorted(used, c.k), len(used)
        out = pd.DataFrame(run_methods(c, i, j, n, y, TRUTH), columns=["method", "excess", "accuracy", "lam", "error"])
        return out.assign(level=p.level.iloc[0], seed=p.seed.iloc[0])

    return both.repartition(64, "level", "seed").groupBy("level", "seed").applyInPandas(work, _CELL + ", level double, seed int")


def _union(parts: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, parts)


@query(name="sweep_order")
def sweep_order(spark, sf):
    rows = llm(spark, sf)
    return sweep(spark, sf, _union([X.thin_order(rows, rho, "w1").withColumn("level", F.lit(rho)) for rho in (0.0, 0.05, 0.2, 1.0)]))


@query(name="sweep_noise")
def sweep_noise(spark, sf):
    rows = llm(spark, sf)
    return sweep(spark, sf, _union([(X.inject(rows, "anti", m, "w2", 4) if m else rows).withColumn("level", F.lit(float(m))) for m in (0, 1, 2, 4, 8)]))


@query(name="sweep_noise_scarce")
def sweep_noise_scarce(spark, sf):
    rows = X.draw(llm(spark, sf), 400, "w3", "record_id", "k", "a")
    return sweep(spark, sf, _union([(X.inject(rows, "position", m, "w3", 4) if m else rows).withColumn("level", F.lit(float(m))) for m in (0, 1)]))


@query(name="sweep_budget")
def sweep_budget(spark, sf):
    return sweep(spark, sf, llm(spark, sf), (50, 100, 200, 400, 800, 1600, -1))


@query(name="sweep_llm_budget")
def sweep_llm_budget(spark, sf):
    rows = llm(spark, sf)
    return sweep(spark, sf, _union([X.draw(rows, n, "w4", "record_id", "k", "a").withColumn("level", F.lit(float(n))) for n in (300, 1000)]))


@query(name="spectest")
def spectest(spark, sf):
    """Likelihood-ratio test of the judges' consensus against the human sample, by budget."""
    h = fx.human_sim(spark, sf)
    it = P.item_index(fx.records(spark, sf))
    coded = h.join(it.withColumnsRenamed({"item": "item_i", "idx": "i"}), "item_i").join(it.withColumnsRenamed({"item": "item_j", "idx": "j"}), "item_j").select("record_id", "i", "j", (2 * F.col("y")).alias("y2"))
    draws = _union([X.draw(coded, n, "w5", "record_id").withColumn("budget", F.lit(n)) for n in (100, 400)])
    counted = P.counts(draws, "budget", "i", "j")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        args = (p.i.to_numpy(int), p.j.to_numpy(int), p.n.to_numpy(float), p.y2.to_numpy(float) / 2)
        stat, df, pv = K.lr_test(TRUTH[:, None], *args)
        return pd.DataFrame({"budget": [int(p.budget.iloc[0])], "stat": [stat], "df": [df], "p_value": [pv], "reject": [pv < 0.05]})

    return counted.groupBy("budget").applyInPandas(work, "budget int, stat double, df int, p_value double, reject boolean")


@query("SELECT lam, round(gacv, 9) AS gacv FROM path WHERE regular ORDER BY gacv, lam DESC LIMIT 1", _PATH_ROWS)
def argmin_gacv(spark, sf):
    """The weight of least criterion; of equals the larger."""
    best = weight_path(spark, sf).where("regular").agg(F.min_by(F.struct("lam", "gacv"), F.struct("gacv", -F.coalesce("lam", F.lit(float("inf"))))).alias("b"))
    return best.select("b.lam", F.round("b.gacv", 9).alias("gacv"))


@query("SELECT c, CASE WHEN gap <= c / 100 THEN NULL ELSE lam END AS lam, CASE WHEN gap <= c / 100 THEN 'within_margin' ELSE 'finite_gain' END AS reason, round(gap, 6) AS gap FROM (SELECT (SELECT gacv FROM path WHERE lam IS NULL AND regular) - gacv AS gap, lam FROM path WHERE lam IS NOT NULL AND regular ORDER BY gacv, lam DESC LIMIT 1), (VALUES (0.0::DOUBLE), (0.01), (1.0), (5.0)) t(c)", _PATH_ROWS)
def margin_rule(spark, sf):
    """A finite weight is taken where it gains more than a margin over the judges alone."""
    ok = weight_path(spark, sf).where("regular")
    both = ok.agg(F.min_by(F.struct("lam", "gacv"), F.when(F.col("lam").isNotNull(), F.struct("gacv", -F.col("lam")))).alias("f"), F.max(F.when(F.col("lam").isNull(), F.col("gacv"))).alias("e"), F.count("*").alias("n"))
    gap = F.col("e") - F.col("f.gacv")
    d = both.select("*", gap.alias("gap"), F.explode(F.array(F.lit(0.0), F.lit(0.01), F.lit(1.0), F.lit(5.0))).alias("c"))
    reason = F.when(F.col("n") == 0, "all_irregular_fallback").when(F.col("f").isNull(), "only_endpoint").when(F.col("e").isNull(), "endpoint_irregular").when(F.col("gap") <= F.col("c") / 100, "within_margin").otherwise("finite_gain")
    return d.select("c", F.when(reason.isin("endpoint_irregular", "finite_gain"), F.col("f.lam")).alias("lam"), reason.alias("reason"), F.round("gap", 6).alias("gap"))
