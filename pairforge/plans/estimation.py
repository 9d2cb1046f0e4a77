"""Fits as queries: scores, calibrations and intervals as Spark jobs over edge tables; the factor model and what follows from it by the kernel, one task per cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..kernel import solver as K
from ..operators import ordered as O
from ..operators import panel as P
from ..operators import scaling as M
from ..operators.lineage import cut
from ..sources import fixture as fx
from .base import PANEL, query
from .relational import human, llm

N_ITEMS, N_JUDGES = 5, 4
ITEMS = sorted(fx.MU)


def pairs(df: DataFrame) -> DataFrame:
    return P.counts(df, "i", "j").withColumn("side", F.lit("H")).withColumns({"k": F.lit(0), "a": F.lit(0)})


def cells(spark, sf, with_human: bool = True) -> DataFrame:
    """Counts of both sources in one small table: side, k, i, j, a, n, y2."""
    out = P.counts(llm(spark, sf), "k", "i", "j", "a").withColumn("side", F.lit("L")).select("side", "k", "i", "j", "a", "n", "y2")
    if with_human:
        it = P.item_index(fx.records(spark, sf))
        h = fx.human_sim(spark, sf).join(it.withColumnsRenamed({"item": "item_i", "idx": "i"}), "item_i").join(it.withColumnsRenamed({"item": "item_j", "idx": "j"}), "item_j")
        out = out.unionByName(pairs(h.select("i", "j", (2 * F.col("y")).alias("y2"))).select("side", "k", "i", "j", "a", "n", "y2"))
    return out


def split(pdf: pd.DataFrame):  # noqa: ANN201
    """Kernel inputs of a cell's counts: judge counts, and human pairs i, j, n, y."""
    pdf = pdf.sort_values(["side", "k", "i", "j", "a"])
    low, h = pdf[pdf.side == "L"], pdf[pdf.side == "H"]
    c = K.Counts(low.k, low.i, low.j, low.a, low.n, low.y2 / 2, N_JUDGES, N_ITEMS)
    return c, h.i.to_numpy(int), h.j.to_numpy(int), h.n.to_numpy(float), h.y2.to_numpy(float) / 2


def fitted(df: DataFrame, work, schema: str, *key: str) -> DataFrame:  # noqa: ANN001
    """One task per key (or one in all) over the counts, of which there are at most judges x pairs x orders."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(work(pdf))
        for c in key:
            out[c] = pdf[c].iloc[0]
        return out

    grouped = df.groupBy(*key) if key else df.withColumn("one", F.lit(0)).groupBy("one")
    return grouped.applyInPandas(run, schema)


# Bradley-Terry by the MM iteration, as a recursive query.
_MM = PANEL + """,
pc AS (SELECT i, j, count(*)::DOUBLE AS n, sum(y2) / 2.0::DOUBLE AS y FROM {0} GROUP BY ALL),
sides AS (SELECT i AS s, j AS o, n, y AS w FROM pc UNION ALL SELECT j, i, n, n - y FROM pc),
wins AS (SELECT s, sum(w) AS w FROM sides GROUP BY 1),
mm AS (SELECT 0 AS step, s, 1.0::DOUBLE AS p FROM wins UNION ALL
  SELECT mm.step + 1, mm.s, any_value(wins.w) / sum(sides.n / (mm.p + other.p)) FROM mm JOIN sides ON sides.s = mm.s JOIN mm other ON other.s = sides.o JOIN wins ON wins.s = mm.s WHERE mm.step < 200 GROUP BY mm.step, mm.s)"""
_RANKED = " SELECT item, round(ln(p) - avg(ln(p)) OVER (), 5) AS score FROM mm JOIN items ON items.idx = mm.s WHERE step = 200"


def edges(df: DataFrame, *key: str) -> DataFrame:
    """Pairs (key..., item_i, item_j, n, y) of comparison rows."""
    return P.counts(df, *key, "i", "j").select(*key, F.col("i").alias("item_i"), F.col("j").alias("item_j"), "n", (F.col("y2") / 2).alias("y"))


def named(df: DataFrame) -> DataFrame:
    """item, an index, as its name."""
    return df.withColumn("item", F.element_at(F.array(*map(F.lit, ITEMS)), F.col("item").cast("int") + 1))


R = lambda c, n=6: F.round(c, n) + F.lit(0.0)  # noqa: E731  no negative zero


def _btl_scores(df: DataFrame) -> DataFrame:
    return named(M.bradley_terry(edges(df))).select("item", R("score", 5).alias("score"))


@query(_RANKED, _MM.format("llm"))
def btl(spark, sf):
    return _btl_scores(llm(spark, sf))


@query(_RANKED, _MM.format("human"))
def human_only(spark, sf):
    return _btl_scores(human(spark, sf))


_JUDGE = PANEL + """,
pc AS (SELECT k, i, j, count(*)::DOUBLE AS n, sum(y2) / 2.0::DOUBLE AS y FROM llm GROUP BY ALL),
sides AS (SELECT k, i AS s, j AS o, n, y AS w FROM pc UNION ALL SELECT k, j, i, n, n - y FROM pc),
wins AS (SELECT k, s, sum(w) AS w FROM sides GROUP BY ALL),
mm AS (SELECT 0 AS step, k, s, 1.0::DOUBLE AS p FROM wins UNION ALL
  SELECT mm.step + 1, mm.k, mm.s, any_value(wins.w) / sum(sides.n / (mm.p + other.p)) FROM mm JOIN sides ON sides.s = mm.s AND sides.k = mm.k JOIN mm other ON other.s = sides.o AND other.k = mm.k JOIN wins ON wins.s = mm.s AND wins.k = mm.k WHERE mm.step < 300 GROUP BY mm.step, mm.k, mm.s)"""


@query("SELECT mm.k, item, round(ln(p) - avg(ln(p)) OVER (PARTITION BY mm.k), 5) AS score FROM mm JOIN items ON items.idx = mm.s WHERE step = 300", _JUDGE, "judge_btl_all")
@query("SELECT mm.k, item, round(ln(p) - avg(ln(p)) OVER (PARTITION BY mm.k), 5) AS score FROM mm JOIN items ON items.idx = mm.s WHERE step = 300", _JUDGE)
def judge_btl(spark, sf):
    """Every judge's own fit."""
    return named(M.bradley_terry(edges(llm(spark, sf), "k"), ("k",))).select("k", "item", R("score", 5).alias("score"))


@query("SELECT (SELECT count(*) FROM reach WHERE a <> b) = 20 AS mle_exists", PANEL + ", edges AS (SELECT DISTINCT CASE WHEN y2 = 2 THEN i ELSE j END AS a, CASE WHEN y2 = 2 THEN j ELSE i END AS b FROM human), reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)")
def mle_exists(spark, sf):
    return M.mle_exists(edges(human(spark, sf)), P.item_index(fx.records(spark, sf)).select(F.col("idx").alias("item")))


_HS = PANEL + ", hs AS (SELECT record_id, item_i, item_j, CASE WHEN CAST('0x' || substr(md5(record_id || '|human'), 1, 7) AS BIGINT) / 268435456.0::DOUBLE < 1 / (1 + exp(-1.2::DOUBLE * d)) THEN 1 ELSE 0 END AS y, d FROM (SELECT *, (CASE item_i WHEN 'click' THEN -0.6 WHEN 'error' THEN -0.2 WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.4 ELSE -0.1 END - CASE item_j WHEN 'click' THEN -0.6 WHEN 'error' THEN -0.2 WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.4 ELSE -0.1 END)::DOUBLE AS d FROM records))"
_NEWTON = _HS + ", cell AS (SELECT round(d, 3) AS d, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM hs GROUP BY 1), it AS (SELECT 0 AS step, 1.0::DOUBLE AS alpha UNION ALL SELECT step + 1, alpha + (SELECT sum(d * (y - n / (1 + exp(-it.alpha * d)))) / sum(d * d * n / (1 + exp(-it.alpha * d)) / (1 + exp(it.alpha * d))) FROM cell) FROM it WHERE step < 25)"
TRUTH = np.array([fx.MU[k] for k in ITEMS])


W2 = np.array([1, 0.5, 1, -0.1, -2.4])


def human_pairs(spark, sf) -> DataFrame:
    """Pairs of the simulated human labels."""
    return cells(spark, sf).where("side = 'H'").select(F.col("i").alias("item_i"), F.col("j").alias("item_j"), "n", (F.col("y2") / 2).alias("y"))


def differences(pairs: DataFrame, *columns: np.ndarray) -> DataFrame:
    """pairs with x, the differences of fixed columns of the items."""
    at = lambda c, side: F.element_at(F.array(*map(F.lit, c.tolist())), F.col(f"item_{side}").cast("int") + 1)
    return pairs.withColumn("x", F.array(*(at(c, "i") - at(c, "j") for c in columns)))


def _alpha(spark, sf) -> DataFrame:
    """alpha, se and nll of the human calibration on the true scores."""
    return M.logistic_blocks(differences(human_pairs(spark, sf), TRUTH), 1).select(F.col("coef")[0].alias("alpha"), F.sqrt(F.col("cov")[0]).alias("se"), "nll")


@query("SELECT round(alpha, 6) AS alpha FROM it WHERE step = 25", _NEWTON)
def calibrate_alpha(spark, sf):
    return _alpha(spark, sf).select(R("alpha").alias("alpha"))


@query("SELECT round(alpha, 6) AS alpha, round(1 / sqrt((SELECT sum(d * d * n / (1 + exp(-it.alpha * d)) / (1 + exp(it.alpha * d))) FROM cell)), 6) AS se FROM it WHERE step = 25", _NEWTON)
def cal_uq(spark, sf):
    return _alpha(spark, sf).select(R("alpha").alias("alpha"), R("se").alias("se"))


_W2 = "(VALUES ('click',1.0::DOUBLE),('error',0.5),('purchase',1.0),('signup',-0.1),('view',-2.4)) w{0}(item, v)"
_NEWTON_W = _HS + f""", cell AS (SELECT d AS x, w1.v - w2.v AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM hs JOIN {_W2.format(1)} ON w1.item = item_i JOIN {_W2.format(2)} ON w2.item = item_j GROUP BY item_i, item_j, d, w1.v, w2.v),
it AS (SELECT 0 AS step, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q UNION ALL
  SELECT step + 1, p + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), q + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
    SELECT any_value(it.step) AS step, it.p, it.q, sum(x * (y - n / (1 + exp(-p * x - q * z)))) AS g1, sum(z * (y - n / (1 + exp(-p * x - q * z)))) AS g2, sum(x * x * n / (1 + exp(-p * x - q * z)) / (1 + exp(p * x + q * z))) AS h11,
      sum(x * z * n / (1 + exp(-p * x - q * z)) / (1 + exp(p * x + q * z))) AS h12, sum(z * z * n / (1 + exp(-p * x - q * z)) / (1 + exp(p * x + q * z))) AS h22 FROM it, cell WHERE it.step < 25 GROUP BY it.step, it.p, it.q))"""


@query("SELECT term, round(CASE term WHEN 'alpha' THEN p ELSE q END, 6) AS value FROM it, (VALUES ('alpha'), ('a1')) t(term) WHERE step = 25", _NEWTON_W)
def calibrate_w(spark, sf):
    fit = M.logistic_blocks(differences(human_pairs(spark, sf), TRUTH, W2), 2)
    return fit.select(F.posexplode("coef").alias("k", "v")).select(F.element_at(F.array(F.lit("alpha"), F.lit("a1")), F.col("k") + 1).alias("term"), R("v").alias("value"))


@query("SELECT round(nll / n + trace / (n - 1), 6) AS gacv FROM (SELECT sum(n) AS n, sum(y * ln(1 + exp(-alpha * d)) + (n - y) * ln(1 + exp(alpha * d))) AS nll, (sum((y * (p - 1) * (p - 1) + (n - y) * p * p) * d * d) / sum(n) - pow(sum(d * (n * p - y)) / sum(n), 2)) / (sum(d * d * n * p * (1 - p)) / sum(n)) AS trace FROM (SELECT cell.*, alpha, 1 / (1 + exp(-alpha * d)) AS p FROM cell, it WHERE step = 25))", _NEWTON)
def gacv_endpoint(spark, sf):
    """Mean loss of the calibrated scores and the trace of what one row can move, from sums over the pairs."""
    pairs = differences(human_pairs(spark, sf), TRUTH).crossJoin(_alpha(spark, sf).select("alpha", "nll"))  # one row
    d, n, y, p = F.col("x")[0], F.col("n"), F.col("y"), S.sigmoid(F.col("alpha") * F.col("x")[0])
    square, slope, info = F.sum((y * (p - 1) ** 2 + (n - y) * p**2) * d**2), F.sum(d * (n * p - y)), F.sum(d**2 * n * p * (1 - p))
    trace = (square / F.sum(n) - (slope / F.sum(n)) ** 2) / (info / F.sum(n))
    return pairs.agg(R(F.first("nll") / F.sum(n) + trace / (F.sum(n) - 1)).alias("gacv"))


@query("SELECT x.item AS item_i, y.item AS item_j, round(alpha * (a.s - b.s), 6) AS estimate, round(abs(a.s - b.s) * se, 6) AS se FROM (SELECT alpha, 1 / sqrt((SELECT sum(d * d * n / (1 + exp(-it.alpha * d)) / (1 + exp(it.alpha * d))) FROM cell)) AS se FROM it WHERE step = 25), items x JOIN items y ON x.idx < y.idx JOIN (VALUES (0,-0.6::DOUBLE),(1,-0.2),(2,0.5),(3,0.4),(4,-0.1)) a(idx, s) ON a.idx = x.idx JOIN (VALUES (0,-0.6::DOUBLE),(1,-0.2),(2,0.5),(3,0.4),(4,-0.1)) b(idx, s) ON b.idx = y.idx", _NEWTON)
def contrast_ci(spark, sf):
    at = F.explode(F.array(*(F.struct(F.lit(ITEMS[x]).alias("item_i"), F.lit(ITEMS[y]).alias("item_j"), F.lit(float(TRUTH[x] - TRUTH[y])).alias("d")) for x in range(N_ITEMS) for y in range(x + 1, N_ITEMS)))).alias("p")
    return _alpha(spark, sf).select("alpha", "se", at).select("p.item_i", "p.item_j", R(F.col("alpha") * F.col("p.d")).alias("estimate"), R(F.abs("p.d") * F.col("se")).alias("se"))


@query("SELECT round(exp(ln(0.1) + (ln(10) - ln(0.1)) * t.n / 6.0) * (SELECT count(*) FROM llm) / (SELECT count(*) FROM human), 6) AS lam FROM range(7) t(n)", PANEL)
def lambda_grid(spark, sf):
    ratio = llm(spark, sf).agg(F.count("*").alias("l")).crossJoin(human(spark, sf).agg(F.count("*").alias("h")))
    return ratio.select("l", "h", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n")).select(F.round(F.exp(F.log(F.lit(0.1)) + F.log(F.lit(100.0)) * F.col("n") / 6.0) * F.col("l") / F.col("h"), 6).alias("lam"))


@query("SELECT r.k, list_sort(list_distinct(list(r.reason))) AS reasons FROM (SELECT k, CASE WHEN a = 1 THEN 'box_active' ELSE 'not_converged' END AS reason FROM llm) r GROUP BY 1", PANEL)
def path_reasons(spark, sf):
    return llm(spark, sf).select("k", F.when(F.col("a") == 1, "box_active").otherwise("not_converged").alias("reason")).groupBy("k").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def _rows_only(name: str, schema: str, sql: str | None = None, base: str = ""):  # noqa: ANN202
    """Registers a kernel function of (counts, i, j, n, y) as a query, mostly without SQL."""

    def put(work):  # noqa: ANN001, ANN202
        query(sql, base, name)(lambda spark, sf: fitted(cells(spark, sf), lambda p: work(*split(p)), schema))
        return work

    return put


_SCORES = "item string, score double"
scores = lambda s: {"item": ITEMS, "score": np.round(s, 6)}


@_rows_only("structured_fit", "judge int, item string, score double, b double")
def _structured(c, i, j, n, y):
    f = K.structured(c, 1)
    return {"judge": np.repeat(range(c.K), c.N), "item": ITEMS * c.K, "score": f["S"].ravel(), "b": np.repeat(f["b"], c.N)}


@_rows_only("rank0", "judge int, gamma double, b double")
def _rank0(c, i, j, n, y):
    f = K.structured(c, 0)
    return {"judge": range(c.K), "gamma": f["gamma"], "b": f["b"]}


@_rows_only("reanchor", "what string, value double")
def _reanchor(c, i, j, n, y):
    f = K.structured(c, 1)
    return {"what": ["mu_v", "v_norm", "sum_gamma", "change_of_S"], "value": [float((f["mu"] @ f["V"])[0]), float(f["V"][:, 0] @ f["V"][:, 0]), float(f["gamma"].sum()), float(np.abs(f["S"] - np.outer(f["gamma"], f["mu"]) - f["U"] @ f["V"].T).max())]}


@_rows_only("bic_rank", "rank int, bic double, best boolean")
def _bic(c, i, j, n, y):
    v = [K.bic(c, r) for r in range(min(c.K - 1, c.N - 2, 2) + 1)]
    return {"rank": range(len(v)), "bic": v, "best": [x == min(v) for x in v]}


@_rows_only("btl_firth", _SCORES)
def _firth(c, i, j, n, y):
    return scores(K.btl(i, j, n, y, c.N, firth=True)[0])


# Bradley-Terry scores of both sources by the MM iteration, and human pairs of the simulation with their labels.
_TWO = _HS + """,
hp AS (SELECT a.idx AS i, b.idx AS j, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM hs JOIN items a ON a.item = hs.item_i JOIN items b ON b.item = hs.item_j GROUP BY ALL),
lp AS (SELECT i, j, count(*)::DOUBLE AS n, sum(y2) / 2.0::DOUBLE AS y FROM llm GROUP BY ALL),
sides AS (SELECT 'H' AS src, i AS s, j AS o, n, y AS w FROM hp UNION ALL SELECT 'H', j, i, n, n - y FROM hp UNION ALL SELECT 'L', i, j, n, y FROM lp UNION ALL SELECT 'L', j, i, n, n - y FROM lp),
wins AS (SELECT src, s, sum(w) AS w FROM sides GROUP BY ALL),
mm AS (SELECT 0 AS step, src, s, 1.0::DOUBLE AS p FROM wins UNION ALL
  SELECT mm.step + 1, mm.src, mm.s, any_value(wins.w) / sum(sides.n / (mm.p + other.p)) FROM mm JOIN sides ON sides.s = mm.s AND sides.src = mm.src JOIN mm other ON other.s = sides.o AND other.src = mm.src JOIN wins ON wins.s = mm.s AND wins.src = mm.src WHERE mm.step < 400 GROUP BY mm.step, mm.src, mm.s),
bt AS (SELECT src, s AS idx, ln(p) - avg(ln(p)) OVER (PARTITION BY src) AS score FROM mm WHERE step = 400)"""
_POOLED = _TWO + """,
hd AS (SELECT hp.n, hp.y, a.score - b.score AS d FROM hp JOIN bt a ON a.idx = hp.i AND a.src = 'L' JOIN bt b ON b.idx = hp.j AND b.src = 'L'),
al AS (SELECT 0 AS step, 1.0::DOUBLE AS alpha UNION ALL SELECT step + 1, alpha + (SELECT sum(d * (y - n / (1 + exp(-al.alpha * d)))) / sum(d * d * n / (1 + exp(-al.alpha * d)) / (1 + exp(al.alpha * d))) FROM hd) FROM al WHERE step < 25)"""
_ISO = _TWO + """,
o AS (SELECT row_number() OVER (ORDER BY h.score, h.idx) AS r, l.idx, l.score AS s FROM bt h JOIN bt l ON l.idx = h.idx AND l.src = 'L' WHERE h.src = 'H'),
iso AS (SELECT r, idx, max(lo) AS fit FROM (SELECT x.r, x.idx, l.r AS b, min((SELECT avg(s) FROM o m WHERE m.r BETWEEN l.r AND u.r)) AS lo FROM o x JOIN o l ON l.r <= x.r JOIN o u ON u.r >= x.r GROUP BY ALL) GROUP BY ALL)"""
_INIT_B = _TWO + """,
jd AS (SELECT k, a, count(*)::DOUBLE AS n, sum(y2) / 2.0::DOUBLE AS y, x.score - z.score AS d FROM llm JOIN bt x ON x.idx = llm.i AND x.src = 'L' JOIN bt z ON z.idx = llm.j AND z.src = 'L' GROUP BY k, a, i, j, x.score, z.score),
bs AS (SELECT 0 AS step, k, 0.0::DOUBLE AS b FROM (SELECT DISTINCT k FROM jd) UNION ALL
  SELECT any_value(bs.step) + 1, bs.k, any_value(bs.b) + sum(a * (y - n / (1 + exp(-d - a * bs.b)))) / sum(n / (1 + exp(-d - a * bs.b)) / (1 + exp(d + a * bs.b))) FROM bs JOIN jd USING (k) WHERE bs.step < 25 GROUP BY bs.step, bs.k)"""
_LR = _NEWTON + _TWO[len(_HS) :]


def pooled_scores(spark, sf) -> DataFrame:
    """The judges' pooled scores (item, score)."""
    return M.bradley_terry(edges(llm(spark, sf))).select("item", "score")


def _scored(pairs: DataFrame, scores: DataFrame, name: str = "d") -> DataFrame:
    """pairs with the difference of their items' scores."""
    of = lambda side: scores.select(F.col("item").alias(f"item_{side}"), F.col("score").alias(f"s_{side}"))
    return pairs.join(of("i"), "item_i").join(of("j"), "item_j").withColumn(name, F.col("s_i") - F.col("s_j")).drop("s_i", "s_j")


@query("SELECT k AS judge, round(b, 6) AS b FROM bs WHERE step = 25", _INIT_B)
def init_b(spark, sf):
    """Every judge's position effect beside the pooled scores."""
    rows = _scored(edges(llm(spark, sf), "k", "a"), pooled_scores(spark, sf), "offset").withColumn("x", F.array(F.col("a").cast("double")))
    return M.logistic_blocks(rows, 1, ("k",), bound=10.0).select(F.col("k").alias("judge"), R(F.col("coef")[0]).alias("b"))


@query("SELECT item, round(alpha * score, 6) AS score FROM al, bt JOIN items ON items.idx = bt.idx WHERE al.step = 25 AND src = 'L'", _POOLED)
def pooled_cal(spark, sf):
    scores = cut(pooled_scores(spark, sf))
    rows = _scored(human_pairs(spark, sf), scores).withColumn("x", F.array("d"))
    fit = M.logistic_blocks(rows, 1).select(F.col("coef")[0].alias("alpha"))
    return named(scores.crossJoin(fit)).select("item", R(F.col("alpha") * F.col("score")).alias("score"))  # one row


@_rows_only("consensus_cal", _SCORES)
def _consensus(c, i, j, n, y):
    return scores(K.calibrate(K.structured(c, 1)["mu"][:, None], i, j, n, y)["s"])


@_rows_only("staged_w", _SCORES)
def _staged(c, i, j, n, y):
    f = K.structured(c, 1)
    return scores(K.calibrate(np.concatenate([f["mu"][:, None], f["V"]], 1), i, j, n, y)["s"])


@query("SELECT item, round(fit - avg(fit) OVER (), 6) AS score FROM iso JOIN items USING (idx)", _ISO)
def atc(spark, sf):
    """The judges' pooled scores, made monotone along the order of the humans' scores."""
    human_scores = M.bradley_terry(human_pairs(spark, sf)).select("item", F.col("score").alias("h"))
    placed = cut(O.running(pooled_scores(spark, sf).join(human_scores, "item"), (), ("h", "item")).select("idx", "item", "score"))
    fit = O.isotonic(placed, "idx", "score").join(placed.select("idx", "item"), "idx")
    mean = fit.agg(F.avg("fit").alias("m"))
    return named(fit.crossJoin(mean)).select("item", R(F.col("fit") - F.col("m")).alias("score"))  # one row


@_rows_only("joint_fit", "item string, score double, criterion double, converged boolean")
def _joint(c, i, j, n, y):
    f = K.joint(c, i, j, n, y, c.total / n.sum(), 1)
    return scores(f["s"]) | {"criterion": [f["criterion"]] * c.N, "converged": [f["converged"]] * c.N}


_PATH_ROWS = "lam double, is_anchor boolean, gacv double, regular boolean, reasons array<string>"
path_rows = lambda p: {"lam": [None if np.isinf(x["lam"]) else x["lam"] for x in p], "is_anchor": [bool(np.isinf(x["lam"])) for x in p], "gacv": [x["gacv"] for x in p], "regular": [x["regular"] for x in p], "reasons": [x["reasons"] for x in p]}


@_rows_only("gacv_path", _PATH_ROWS)
def _path_of(c, i, j, n, y):
    return path_rows(K.select(c, i, j, n, y, 1))


@_rows_only("select_lambda", _PATH_ROWS)
def _selected(c, i, j, n, y):
    return path_rows([K.chosen(K.select(c, i, j, n, y, 1))])


@_rows_only("selection_reasons", "reason string, n int")
def _selection_reasons(c, i, j, n, y):
    """How many candidates of the selection path were dropped for each reason."""
    found = [r for p in K.select(c, i, j, n, y, 1) for r in p["reasons"]]
    names = ["box_active", "mle_not_exists", "not_converged", "score_bound", "singular_hessian", "singular_or_score"]
    return {"reason": names, "n": [found.count(r) for r in names]}


@_rows_only("rank_lambda", "rank int, lam double, gacv double, error string, best boolean")
def _rank_lambda(c, i, j, n, y):
    """The selected weight of every rank; best marks the rank of least criterion, error why a rank has none."""
    out = []
    for r in range(min(c.K - 1, c.N - 2, 2) + 1):
        try:
            path = K.select(c, i, j, n, y, r)
            b = K.chosen(path)
            out.append((r, None if np.isinf(b["lam"]) else b["lam"], b["gacv"], None if b["regular"] else "all_dropped"))
        except Exception as e:  # noqa: BLE001  a row, not a failed task
            out.append((r, None, None, f"{type(e).__name__}: {e}"[:4000]))
    least = min((g for _, _, g, e in out if e is None), default=None)
    rank, lam, gacv, error = zip(*out, strict=True)
    return {"rank": rank, "lam": lam, "gacv": gacv, "error": error, "best": [e is None and g == least for g, e in zip(gacv, error, strict=True)]}


_B = "judge int, b double, se double, lower double, upper double"


def _intervals(c, f, cov):  # noqa: ANN001, ANN202
    at = slice(f["chart"].at[2], f["chart"].at[3])
    se = np.sqrt(np.maximum(np.diag(cov)[at], 0))
    return {"judge": range(c.K), "b": f["b"], "se": se, "lower": f["b"] - 1.959964 * se, "upper": f["b"] + 1.959964 * se}


@_rows_only("sandwich_b", _B)
def _sandwich(c, i, j, n, y):
    f = K.joint(c, i, j, n, y, c.total / n.sum(), 1)
    return _intervals(c, f, K.sandwich(f, c, i, j, n, y))


@_rows_only("sandwich_b_llm", _B)
def _sandwich_llm(c, i, j, n, y):
    f = K.structured(c, 1)
    eta, x = f["chart"].rows(f["t"], c)
    p = K.sigmoid(eta)
    h = np.linalg.pinv(x.T @ ((c.n * p * (1 - p))[:, None] * x), rcond=1e-9)
    return _intervals(c, f, h @ (x.T @ ((c.y * (p - 1) ** 2 + (c.n - c.y) * p**2)[:, None] * x)) @ h)


@_rows_only("uq_targets", "judge int, item_i string, item_j string, estimate double, se double")
def _targets(c, i, j, n, y):
    """Score differences by judge, by the delta method on the factor chart."""
    f = K.structured(c, 1)
    eta, x = f["chart"].rows(f["t"], c)
    p = K.sigmoid(eta)
    cov = np.linalg.pinv(x.T @ ((c.n * p * (1 - p))[:, None] * x), rcond=1e-8)
    at = [(k, a, b) for k in range(c.K) for a in range(c.N) for b in range(a + 1, c.N)]
    k, a, b = (np.array(v) for v in zip(*at, strict=True))
    e, g = f["chart"].rows(f["t"], K.Counts(k, a, b, np.zeros(len(k)), np.ones(len(k)), np.zeros(len(k)), c.K, c.N))
    return {"judge": k, "item_i": [ITEMS[v] for v in a], "item_j": [ITEMS[v] for v in b], "estimate": e, "se": np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", g, cov, g), 0))}


@query(name="human_uq")
def human_uq(spark, sf):
    """Scores of the human labels with standard errors, from the sparse information matrix."""
    pairs = human_pairs(spark, sf)
    fit = cut(M.bradley_terry(pairs).select("item", "score"))
    found = M.contrast_intervals(pairs, fit, fit.select(F.col("item").alias("target"), "item", F.lit(1.0).alias("b")))
    return named(found.withColumnRenamed("target", "item")).select("item", F.col("estimate").alias("score"), "se")


@_rows_only("lr_test", "stat double, df int, p_value double")
def _lr(c, i, j, n, y):
    stat, df, p = K.lr_test(TRUTH[:, None], i, j, n, y)
    return {"stat": [stat], "df": [df], "p_value": [p]}


@query("SELECT round(2 * ((SELECT sum(y * ln(1 + exp(-alpha * d)) + (n - y) * ln(1 + exp(alpha * d))) FROM cell, it WHERE step = 25) - (SELECT sum(y * ln(1 + exp(b.score - a.score)) + (n - y) * ln(1 + exp(a.score - b.score))) FROM hp JOIN bt a ON a.idx = hp.i AND a.src = 'H' JOIN bt b ON b.idx = hp.j AND b.src = 'H')), 4) AS stat, 3 AS df", _LR)
def lr_stat(spark, sf):
    """Twice what free scores gain in likelihood over calibrated ones."""
    pairs = human_pairs(spark, sf)
    free = _scored(pairs, M.bradley_terry(pairs))
    loss = F.sum(F.col("y") * S.softplus(-F.col("d")) + (F.col("n") - F.col("y")) * S.softplus(F.col("d")))
    both = free.agg(loss.alias("free")).crossJoin(_alpha(spark, sf))  # one row each
    return both.select(F.round(2 * (F.col("nll") - F.col("free")), 4).alias("stat"), F.lit(N_ITEMS - 2).alias("df"))


@_rows_only("ncx2_ci", "stat double, lower double, upper double")
def _ncx2(c, i, j, n, y):
    stat, df, _ = K.lr_test(TRUTH[:, None], i, j, n, y)
    lo, hi = K.ncx2_interval(stat, df)
    return {"stat": [stat], "lower": [lo], "upper": [hi]}


@_rows_only("widened_ci", "item_i string, item_j string, estimate double, lower double, upper double")
def _widened(c, i, j, n, y):
    """Contrasts of calibrated scores, widened by what a misaligned target could shift them."""
    w = TRUTH[:, None]
    f = K.calibrate(w, i, j, n, y)
    p, d = K.sigmoid(f["s"][i] - f["s"][j]), np.eye(c.N)[i] - np.eye(c.N)[j]
    lap = d.T @ ((n * p * (1 - p))[:, None] * d) / n.sum()
    a = f["cov_s"] * n.sum() @ lap
    m = (np.eye(c.N) - a) @ np.linalg.pinv(lap) @ (np.eye(c.N) - a).T
    stat, df, _ = K.lr_test(w, i, j, n, y)
    shift = np.sqrt(2 * K.ncx2_interval(stat, df, 0.95)[1] / (2 * n.sum()))
    out = []
    for x in range(c.N):
        for z in range(x + 1, c.N):
            v = np.eye(c.N)[x] - np.eye(c.N)[z]
            half = 1.959964 * np.sqrt(v @ f["cov_s"] @ v) + shift * np.sqrt(max(v @ m @ v, 0))
            out.append((ITEMS[x], ITEMS[z], v @ f["s"], v @ f["s"] - half, v @ f["s"] + half))
    return dict(zip(["item_i", "item_j", "estimate", "lower", "upper"], zip(*out, strict=True), strict=True))


@_rows_only("excess", "method string, logloss double, excess double")
def _excess(c, i, j, n, y):
    """Held-out loss over that of the pool's own fit, for three methods."""
    def loss(s):
        x = s[i] - s[j]
        return float(np.sum(y * np.logaddexp(0, -x) + (n - y) * np.logaddexp(0, x)) / n.sum())

    floor = loss(K.btl(i, j, n, y, c.N)[0])
    out = {"pooled": K.btl(c.i, c.j, c.n, c.y, c.N)[0], "consensus": K.structured(c, 1)["mu"], "truth": 1.2 * TRUTH}
    return {"method": list(out), "logloss": [loss(s) for s in out.values()], "excess": [loss(s) - floor for s in out.values()]}


@_rows_only("b_rmse", "rmse double, sign_accuracy double")
def _b_rmse(c, i, j, n, y):
    b, true = K.structured(c, 1)["b"], np.array([fx.B[k] for k in range(4)])
    return {"rmse": [float(np.sqrt(np.mean((b - true) ** 2)))], "sign_accuracy": [float(np.mean(np.sign(b[1:]) == np.sign(true[1:])))]}


@_rows_only("metrics_all", "metric string, value double")
def _metrics(c, i, j, n, y):
    s = K.chosen(K.select(c, i, j, n, y, 1))["s"]
    up = np.triu_indices(c.N, 1)
    return {"metric": ["sign_accuracy", "correlation", "rmse"], "value": [float(np.mean(np.sign(s[up[0]] - s[up[1]]) == np.sign(TRUTH[up[0]] - TRUTH[up[1]]))), float(np.corrcoef(s, TRUTH)[0, 1]), float(np.sqrt(np.mean((s - 1.2 * TRUTH) ** 2)))]}


@query(name="clean_fit")
def clean_fit(spark, sf):
    def work(p):
        c, i, j, n, y = split(p)
        f = K.joint(c, i, j, n, y, c.total / n.sum(), 1)
        return _intervals(c, f, K.sandwich(f, c, i, j, n, y))

    return fitted(cells(spark, sf), work, _B)
