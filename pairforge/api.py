"""Fits, intervals and tests from DataFrame to DataFrame, for any items and judges, one for each value of optional cell keys.

Judges' comparisons are rows (keys..., judge, item_i, item_j, y[, a][, n]): y is 1 where item_i won, 0 where item_j did and a half for a tie; a is +1
where item_i was shown first, -1 where second, 0 or null where that is unknown; with n a row stands for n comparisons with y wins in all. Human comparisons are the
same without judge and a. Rows with a null among item_i, item_j, y or judge don't count; a pair may be given in either order. Names may
be of any type that orders.

Spark counts; what reaches one task is a cell's counts: at most judges x pairs of items x 3 orders x 2 sources, whatever the number of comparisons. A fit that
fails gives a row with its error for the cell and no result; it doesn't end the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernel import methods as M
from .kernel import solver as K

Z = 1.959963984540054
_SCORES = "item string, score double, lam double, is_anchor boolean, gacv double, converged boolean, at_bound boolean, error string"
_JUDGES = "parameter string, judge string, item string, factor int, value double, converged boolean, error string"
_INTERVALS = "target string, judge string, item_i string, item_j string, estimate double, se double, lower double, upper double, lower_widened double, upper_widened double, error string"


def counts(llm: DataFrame | None, human: DataFrame | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., side, judge, item_i, item_j, a, n, y): counts of both sources, pairs in order, names as text."""

    def side(df: DataFrame, name: str) -> DataFrame:
        i, j = F.col("item_i").cast("string"), F.col("item_j").cast("string")
        n = F.col("n").cast("double") if "n" in df.columns else F.lit(1.0)
        a = F.coalesce(F.col("a").cast("double"), F.lit(0.0)) if "a" in df.columns and name == "L" else F.lit(0.0)
        judge = F.col("judge").cast("string") if name == "L" else F.lit("")
        y = F.col("y").cast("double")
        turn = i > j
        rows = df.select(*keys, F.lit(name).alias("side"), judge.alias("judge"), F.least(i, j).alias("item_i"), F.greatest(i, j).alias("item_j"), F.when(turn, -a).otherwise(a).alias("a"), n.alias("n"), F.when(turn, n - y).otherwise(y).alias("y"))
        rows = rows.where("judge is not null and item_i is not null and item_j is not null and y is not null and n > 0").where("item_i <> item_j")
        return rows.groupBy(*keys, "side", "judge", "item_i", "item_j", "a").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))

    parts = [side(df, name) for df, name in ((llm, "L"), (human, "H")) if df is not None]
    if not parts:
        raise ValueError("comparisons of judges or humans are needed")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class _Data:
    """Kernel inputs of one cell, and its names."""

    def __init__(self, p: pd.DataFrame) -> None:
        p = p.sort_values(["side", "judge", "item_i", "item_j", "a"])
        self.items = sorted(set(p.item_i) | set(p.item_j))
        at = {x: k for k, x in enumerate(self.items)}
        low, h = p[p.side == "L"], p[p.side == "H"]
        self.judges = sorted(set(low.judge))
        j = {x: k for k, x in enumerate(self.judges)}
        self.c = K.Counts(low.judge.map(j), low.item_i.map(at), low.item_j.map(at), low.a, low.n, low.y, len(self.judges), len(self.items))
        self.order = bool((low.a != 0).any())
        self.pairs = (h.item_i.map(at).to_numpy(int), h.item_j.map(at).to_numpy(int), h.n.to_numpy(float), h.y.to_numpy(float))

    def rank(self, rank: int) -> int:
        if not 0 <= rank <= M.highest_rank(self.c, rank):
            raise ValueError(f"rank {rank} is out of range for {self.c.K} judges and {self.c.N} items")
        return rank


def per_cell(llm: DataFrame | None, human: DataFrame | None, work: Callable[[_Data], pd.DataFrame], schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One grouped task per cell over its counts."""
    source = llm if llm is not None else human
    columns = [f.name for f in StructType.fromDDL(schema)]
    head = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    table = counts(llm, human, keys)
    grouped = table.groupBy(*keys) if keys else table.withColumn("__one", F.lit(0)).groupBy("__one")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        try:
            out = pd.DataFrame(work(_Data(p))).reindex(columns=columns)
        except Exception as e:  # noqa: BLE001  a row, not a failed task
            out = pd.DataFrame([{"error": f"{type(e).__name__}: {e}"[:4000]}]).reindex(columns=columns)
        for k in keys:
            out[k] = p[k].iloc[0]
        # Missing columns are all NaN: as objects they turn into nulls of any type.
        out[columns] = out[columns].astype(object).where(out[columns].notna(), None)
        return out[[*keys, *columns]]

    return grouped.applyInPandas(run, ", ".join(x for x in (head, schema) if x))


def _scores(d: _Data, s: np.ndarray, lam: float | None = None, fit: dict | None = None, gacv: float | None = None) -> dict:
    n, fit = len(d.items), fit or {}
    anchor = lam is not None and np.isinf(lam)
    return {
        "item": d.items, "score": s, "lam": [None if lam is None or anchor else lam] * n, "is_anchor": [anchor] * n, "gacv": [gacv] * n,
        "converged": [bool(fit.get("converged", True))] * n, "at_bound": [bool(fit.get("boundary_any", False))] * n, "error": [None] * n,
    }


def fit_human(human: DataFrame, keys: tuple[str, ...] = (), firth: bool = False) -> DataFrame:
    """Scores from human comparisons alone; firth: a fit that is finite also where some items always win."""

    def work(d: _Data) -> dict:
        s, _, done = K.btl(*d.pairs, len(d.items), firth=firth)
        return _scores(d, s, 0.0, {"converged": done, "boundary_any": bool(np.abs(s).max() >= K.FREE_BOX - 1e-6)})

    return per_cell(None, human, work, _SCORES, keys)


def fit_pooled(llm: DataFrame, human: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores from all judges as one, without order; with human comparisons scaled to them."""
    scaled = human is not None  # a task can't hold the table itself

    def work(d: _Data) -> dict:
        s, _, done = K.btl(d.c.i, d.c.j, d.c.n, d.c.y, d.c.N)
        if not scaled:
            return _scores(d, s, fit={"converged": done})
        cal = K.calibrate(s[:, None], *d.pairs)
        return _scores(d, cal["s"], fit={"converged": done and cal["converged"]})

    return per_cell(llm, human, work, _SCORES, keys)


def fit_consensus(llm: DataFrame, human: DataFrame | None = None, rank: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """The judges' consensus; with human comparisons calibrated to them by its scale alone."""
    scaled = human is not None

    def work(d: _Data) -> dict:
        base = K.structured(d.c, d.rank(rank), d.order)
        if not scaled:
            return _scores(d, base["mu"], np.inf, base)
        fit = K.staged(base, *d.pairs, "mu")
        return _scores(d, fit["s"], np.inf, fit)

    return per_cell(llm, human, work, _SCORES, keys)


def fit_staged(llm: DataFrame, human: DataFrame, rank: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """The judges' fit first, then human comparisons on all its columns: the endpoint of infinite weight."""

    def work(d: _Data) -> dict:
        fit = K.staged(K.structured(d.c, d.rank(rank), d.order), *d.pairs, "W")
        return _scores(d, fit["s"], np.inf, fit)

    return per_cell(llm, human, work, _SCORES, keys)


def fit_isotonic(llm: DataFrame, human: DataFrame, rank: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """The judges' consensus, made monotone along the humans' order."""

    def work(d: _Data) -> dict:
        base = K.structured(d.c, d.rank(rank), d.order)
        return _scores(d, K.monotone_along(K.btl(*d.pairs, d.c.N)[0], base["mu"]), fit=base)

    return per_cell(llm, human, work, _SCORES, keys)


def fit_joint(llm: DataFrame, human: DataFrame, lam: float | None = None, rank: int = 1, align: str = "W", keys: tuple[str, ...] = ()) -> DataFrame:
    """Both sources at once, the judges' loss with weight lam (default: judges' comparisons over human ones); align W or mu."""

    def work(d: _Data) -> dict:
        fit = K.joint(d.c, *d.pairs, d.c.total / d.pairs[2].sum() if lam is None else lam, d.rank(rank), align, None, d.order)
        return _scores(d, fit["s"], fit["lam"], fit)

    return per_cell(llm, human, work, _SCORES, keys)


def fit_selected(llm: DataFrame, human: DataFrame, rank: int | None = 1, align: str = "W", margin: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The joint fit with the weight, endpoints included, of least criterion; rank None: over ranks too; margin: see kernel.solver.with_margin."""

    def work(d: _Data) -> dict:
        if rank is None:
            path = M.by_rank(d.c, d.pairs, range(M.highest_rank(d.c, M.MOST_RANK) + 1), {})[1]
        else:
            path = K.select(d.c, *d.pairs, d.rank(rank), align, order=d.order)
        best = K.chosen(path) if margin is None else K.with_margin(path, float(d.pairs[2].sum()), margin)[0]
        out = _scores(d, best["s"], best["lam"], best["fit"], best["gacv"])
        return out | {"error": ["no candidate is regular" if K.dropped(path)[1] else None] * len(d.items)}

    return per_cell(llm, human, work, _SCORES, keys)


def selection_path(llm: DataFrame, human: DataFrame, rank: int = 1, align: str = "W", keys: tuple[str, ...] = ()) -> DataFrame:
    """(lam, is_anchor, gacv, regular, reasons, selected): every candidate, and why it was dropped."""

    def work(d: _Data) -> dict:
        path = K.select(d.c, *d.pairs, d.rank(rank), align, order=d.order)
        best = K.chosen(path)
        return {"lam": [None if np.isinf(p["lam"]) else p["lam"] for p in path], "is_anchor": [bool(np.isinf(p["lam"])) for p in path], "gacv": [p["gacv"] for p in path], "regular": [p["regular"] for p in path], "reasons": [p["reasons"] for p in path], "selected": [p is best for p in path]}

    return per_cell(llm, human, work, "lam double, is_anchor boolean, gacv double, regular boolean, reasons array<string>, selected boolean, error string", keys)


def fit_judges(llm: DataFrame, rank: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Parameters of the judges' fit in long form: gamma and b by judge, mu by item, U by judge and factor, V by item and factor, S by judge and item."""

    def work(d: _Data) -> pd.DataFrame:
        f = K.structured(d.c, d.rank(rank), d.order)
        rows = [("gamma", k, None, None, f["gamma"][n]) for n, k in enumerate(d.judges)] + [("b", k, None, None, f["b"][n]) for n, k in enumerate(d.judges)]
        rows += [("mu", None, x, None, f["mu"][n]) for n, x in enumerate(d.items)]
        rows += [("U", k, None, q, f["U"][n, q]) for n, k in enumerate(d.judges) for q in range(rank)] + [("V", None, x, q, f["V"][n, q]) for n, x in enumerate(d.items) for q in range(rank)]
        rows += [("S", k, x, None, f["S"][m, n]) for m, k in enumerate(d.judges) for n, x in enumerate(d.items)]
        out = pd.DataFrame(rows, columns=["parameter", "judge", "item", "factor", "value"])
        return out.assign(factor=out.factor.astype("Int32"), converged=f["converged"])

    return per_cell(llm, None, work, _JUDGES, keys)


def rank_by_bic(llm: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(rank, bic, best)."""

    def work(d: _Data) -> dict:
        v = [K.bic(d.c, r) for r in range(M.highest_rank(d.c, d.c.N) + 1)]
        return {"rank": range(len(v)), "bic": v, "best": [x == min(v) for x in v]}

    return per_cell(llm, None, work, "rank int, bic double, best boolean, error string", keys)


def joint_intervals(llm: DataFrame, human: DataFrame, lam: float | None = None, rank: int = 1, align: str = "mu", clustered: bool = True, level: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    """Intervals of score contrasts and position effects from the joint fit's sandwich; contrasts also widened for a misaligned target.

    clustered: comparisons of one judge and pair count as one cluster. The widening takes the upper end, at `level`, of how far the humans'
    own fit lies from the span of the judges' columns.
    """

    def work(d: _Data) -> pd.DataFrame:
        c, n_h = d.c, float(d.pairs[2].sum())
        fit = K.joint(c, *d.pairs, c.total / n_h if lam is None else lam, d.rank(rank), align, None, d.order)
        sw = K.joint_sandwich(fit, c, *d.pairs, K.pair_clusters(c) if clustered else None)
        full = K.btl(*d.pairs, c.N, firth=not K.mle_exists(*d.pairs, c.N))[0]
        stat, df, _ = K.lr_test(fit["W"], *d.pairs)
        w = K.widened(fit["s"], sw, full, K.ncx2_interval(stat, df, level)[1] / (2 * n_h) if df else 0.0, *d.pairs[:3], Z)
        i, j = np.triu_indices(c.N, 1)
        out = [("contrast", None, d.items[a], d.items[b], e, h / Z, e - h, e + h, e - h - x, e + h + x) for a, b, e, h, x in zip(i, j, w["estimate"], w["half"], w["widening"], strict=True)]
        se = np.sqrt(np.maximum(np.diag(sw["cov_b"]), 0))
        out += [("position_effect", k, None, None, b, x, b - Z * x, b + Z * x, None, None) for k, b, x in zip(d.judges, fit["b"], se, strict=True)]
        return pd.DataFrame(out, columns=["target", "judge", "item_i", "item_j", "estimate", "se", "lower", "upper", "lower_widened", "upper_widened"])

    return per_cell(llm, human, work, _INTERVALS, keys)


def judge_intervals(llm: DataFrame, rank: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Delta-method intervals of the judges' fit: score_entry, score_diff, consensus_score, consensus_diff, gamma and position_effect."""

    def work(d: _Data) -> pd.DataFrame:
        f = K.structured(d.c, d.rank(rank), d.order)
        ks, ns, up = range(d.c.K), range(d.c.N), list(zip(*np.triu_indices(d.c.N, 1), strict=True))
        targets = [("score_entry", k, i) for k in ks for i in ns] + [("score_diff", k, i, j) for k in ks for i, j in up] + [("consensus_score", i) for i in ns] + [("consensus_diff", i, j) for i, j in up]
        targets += [("gamma", k) for k in ks] + [("position_effect", k) for k in ks]
        rows = []
        for t, (e, se) in zip(targets, K.delta_method(f, d.c, targets), strict=True):
            judge = d.judges[t[1]] if t[0] in ("score_entry", "score_diff", "gamma", "position_effect") else None
            items = [d.items[x] for x in t[(2 if judge is not None else 1) :]] + [None, None]
            rows.append((t[0], judge, items[0], items[1], e, se, e - Z * se, e + Z * se))
        return pd.DataFrame(rows, columns=["target", "judge", "item_i", "item_j", "estimate", "se", "lower", "upper"])

    return per_cell(llm, None, work, _INTERVALS, keys)


def calibration_test(llm: DataFrame, human: DataFrame, rank: int = 1, align: str = "mu", level: float = 0.90, keys: tuple[str, ...] = ()) -> DataFrame:
    """(stat, df, p_value, misalignment_lower, misalignment_upper, human_only_exists): whether the humans' scores lie in the span of the judges' columns, and how far off at `level`."""

    def work(d: _Data) -> dict:
        w = K.staged(K.structured(d.c, d.rank(rank), d.order), *d.pairs, align)["W"]
        stat, df, p = K.lr_test(w, *d.pairs)
        lo, hi = K.ncx2_interval(stat, df, level) if df else (np.nan, np.nan)
        n = 2 * d.pairs[2].sum()
        return {"stat": [stat], "df": [df], "p_value": [p], "misalignment_lower": [lo / n], "misalignment_upper": [hi / n], "human_only_exists": [K.mle_exists(*d.pairs, d.c.N)]}

    return per_cell(llm, human, work, "stat double, df int, p_value double, misalignment_lower double, misalignment_upper double, human_only_exists boolean, error string", keys)
