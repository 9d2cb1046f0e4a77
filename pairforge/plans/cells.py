"""The studies in full: records split for test, sweeps over designs, all methods on each cell, held-out measures.

Spark draws, splits, injects, thins and counts; a cell's counts, at most judges x pairs x orders, reach one grouped task. A sweep is one
plan over its levels: rows are copied per level and counted before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernel import methods as M
from ..kernel import solver as K
from ..operators import panel as P
from ..operators import sampling as X
from ..operators.lineage import cut
from ..sources import fixture as fx
from ..sources.ledger import Ledger
from .base import PANEL, query
from .relational import human, llm

#: Panels by their judges in order; the share of records held out; default human sample; multiples that margins try.
PANELS = {"all": (0, 1, 2, 3), "biased": (2, 1, 3)}
F_TEST, N_HUMAN, SEEDS, N_REAL_ITEMS = 0.3, 300, 2, 5
CELL = ["panel", "kind", "level", "n_h_level", "seed"]
_BASE = {"panel": "string", "kind": "string", "level": "double", "n_h_level": "int", "seed": "int", "sweep": "string", "k_real": "int", "k": "int", "k_dropped": "int", "n_l": "long", "n_h": "long", "n_test": "long", "n_train_human": "long", "rho_swap": "double", "m": "int", "first_share": "double"}
_MORE = {"floor": "double", "r": "int", "human_only_exists": "boolean", "seconds_cell": "double"}
SCHEMA = ", ".join(f"{k} {v}" for k, v in (_BASE | M.FIELDS | _MORE).items())


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows as plain objects: a column that no row has is null, of whatever type it is to be."""
    out = pd.DataFrame(rows, columns=columns).astype(object)
    return out.where(out.notna(), None)


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(rows, schema)


def splits(records: DataFrame, seeds: int, share: float = F_TEST) -> DataFrame:
    """(seed, record_id, test): for each seed the records of smallest hash are held out, and all rows of a record stay together."""
    many = records.select("record_id").distinct().select("record_id", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    n = records.agg(F.count_distinct("record_id").alias("n_records"))
    r = X.ranked(many, F.concat(F.lit("split"), F.col("seed").cast("string")), ("record_id",), "seed")
    return r.crossJoin(F.broadcast(n)).select("seed", "record_id", (F.col("r") <= F.bround(F.col("n_records") * share)).alias("test"))


def in_panels(rows: DataFrame, panels: dict[str, tuple[int, ...]]) -> DataFrame:
    """Rows once per panel that holds their judge, judges numbered in the panel's order."""
    members = [(name, k, at) for name, ks in panels.items() for at, k in enumerate(ks)]
    dims = _table(rows.sparkSession, members, "panel string, k int, at int")
    return rows.join(dims, "k").drop("k").withColumnRenamed("at", "k")


def with_noise(rows: DataFrame, kinds: tuple[str, ...], most: int, n_judges: int) -> DataFrame:
    """rows with kind null, and those of `most` injected judges for each kind, numbered from n_judges on."""
    out = rows.withColumn("kind", F.lit(None).cast("string"))
    for kind in kinds:
        made = X.inject(rows.select("record_id", "k", "i", "j", "y2", "a"), kind, most, "noise", n_judges).where(F.col("k") >= n_judges)
        out = out.unionByName(made.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return out


def fit_cells(sweep: str, low: DataFrame, cal: DataFrame, test: DataFrame, train: DataFrame, only: tuple[str, ...] = M.METHODS, done: DataFrame | None = None) -> DataFrame:
    """A row for each cell and method but those of done, see done_cells. low: (CELL, k, i, j, a, n, y2, n_real, rho_swap); cal: human counts (panel, level, n_h_level, seed, i, j, n, y2); test, train: by seed.

    Judges that have no row in a cell are dropped there and the others renumbered; a judge without rows has nothing to estimate.
    """
    low = low if done is None else low.join(done, CELL, "left_anti")
    low, cal = cut(low), cut(cal)  # counts: the cells, and all parts of them, start from these
    none = lambda df, side: df.withColumns({"side": F.lit(side), "k": F.lit(0), "a": F.lit(0), "n_real": F.lit(0), "rho_swap": F.lit(0.0)})
    cells = low.select(*CELL, "n_real", "rho_swap").distinct()
    cell_cols = [F.col(c) for c in CELL]
    columns = [*CELL, "side", "k", "i", "j", "a", "n", "y2", "n_real", "rho_swap"]
    parts = [low.withColumn("side", F.lit("L")).select(*columns)]
    keys = cells.select(*CELL)
    for side, df in (("H", cal), ("T", test), ("R", train)):
        on = [c for c in CELL if c in df.columns]
        parts.append(none(keys.join(df, on), side).select(*cell_cols, *columns[len(CELL) :]))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

    def work(p: pd.DataFrame) -> pd.DataFrame:
        side = {s: g.sort_values(["k", "i", "j", "a"]) for s, g in p.groupby("side")}
        low = side["L"]
        pairs = lambda s: tuple(np.asarray(side[s][x] if s in side else [], t) for x, t in (("i", int), ("j", int), ("n", float))) + (np.asarray(side[s].y2 if s in side else [], float) / 2,)
        used, n_real = np.unique(low.k), int(low.n_real.iloc[0])
        c = K.Counts(np.searchsorted(used, low.k), low.i, low.j, low.a, low.n, low.y2 / 2, len(used), N_REAL_ITEMS)
        real = int((used < n_real).sum())
        cal, test, train = pairs("H"), pairs("T"), pairs("R")
        head = dict(zip(CELL, p[CELL].iloc[0], strict=True))
        asked = n_real + (int(head["level"]) if sweep in ("noise", "noise_scarce") else 0)
        head |= {"sweep": sweep, "k_real": real, "k": c.K, "k_dropped": asked - c.K, "n_l": int(c.total), "n_h": int(cal[2].sum()), "n_test": int(test[2].sum()), "n_train_human": int(train[2].sum())}
        head |= {"rho_swap": float(low.rho_swap.iloc[0]), "m": asked - n_real, "first_share": float(low.n[low.a == 1].sum() / low.n.sum())}
        try:
            rows = M.Cell(c, cal, test, real).table(only)
        except Exception as e:  # noqa: BLE001  a row, not a failed task
            rows = [{"method": "cell", "error": f"{type(e).__name__}: {e}"[:4000]}]
        return _frame([head | r for r in rows], [*_BASE, *M.FIELDS, *_MORE])

    # Cells are few rows and much work: without a number of its own the exchange would be merged into one task.
    return both.repartition(max(1, keys.count()), *CELL).groupBy(*CELL).applyInPandas(work, SCHEMA)


def done_cells(rows: DataFrame, only: tuple[str, ...] = M.METHODS) -> DataFrame:
    """Cells of stored rows that have every asked method, with a result or an error."""
    have = rows.groupBy(*CELL).agg(F.collect_set("method").alias("have"))
    return have.where(F.size(F.array_except(F.array(*map(F.lit, only)), "have")) == 0).select(*CELL)


def run_cells(make, path: str, only: tuple[str, ...] = M.METHODS) -> int:  # noqa: ANN001
    """Adds to the ledger at path the rows of the cells that aren't there yet; make(done) gives them. Returns how many rows were added; run again it adds none.

    A cell and method is stored by one commit or not at all, whatever breaks off or runs at the same time.
    """
    ledger = Ledger(SparkSession.getActiveSession(), path, (*CELL, "method"))
    stored = ledger.read()
    return ledger.commit(cut(make(done_cells(stored, only) if stored is not None else None)))


class Study:
    """The rows that all sweeps start from: judges' rows of training records by panel and seed, and human rows split by seed."""

    def __init__(self, spark, sf: str, panels: tuple[str, ...], seeds: int = SEEDS) -> None:  # noqa: ANN001
        # The coded rows are worked out once for all levels.
        rows, people = cut(llm(spark, sf)), cut(human(spark, sf))
        split = cut(splits(rows.select("record_id").union(people.select("record_id")), seeds))
        self.panels = {p: PANELS[p] for p in panels}
        self.rows = in_panels(rows, self.panels).join(split.where("not test"), "record_id").drop("test")
        held = cut(people.join(split, "record_id"))
        self.test = cut(P.counts(held.where("test"), "seed", "i", "j"))
        self.train_rows = held.where("not test").select("seed", "record_id", "i", "j", "y2")
        self.train = cut(P.counts(self.train_rows, "seed", "i", "j"))

    def n_real(self) -> Column:
        out = F
        for name, ks in self.panels.items():
            out = out.when(F.col("panel") == name, len(ks))
        return out

    def calibration(self, sizes: tuple[int, ...]) -> DataFrame:
        """Human counts by seed and n_h_level, the size of the draw (below 0: all); smaller draws lie in larger ones."""
        r = X.ranked(self.train_rows, F.concat(F.lit("draw"), F.col("seed").cast("string")), ("record_id",), "seed")
        r = r.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("n_h_level")).where((F.col("n_h_level") < 0) | (F.col("r") <= F.col("n_h_level")))
        return P.counts(r, "seed", "n_h_level", "i", "j")

    def run(self, sweep: str, rows: DataFrame, sizes: tuple[int, ...] = (N_HUMAN,), rho: float = 1.0, only: tuple[str, ...] = M.METHODS, done: DataFrame | None = None) -> DataFrame:
        """rows: with level, kind and, if swaps are thinned by level, rho_swap."""
        rows = rows if "rho_swap" in rows.columns else rows.withColumn("rho_swap", F.lit(rho))
        kept = rows.where((F.col("a") == 1) | (X.unit("thin", "seed", "record_id", "k") < F.col("rho_swap")))
        low = P.counts(kept, "panel", "kind", "level", "seed", "k", "i", "j", "a", "rho_swap").withColumn("n_real", self.n_real())
        cal = self.calibration(sizes)
        if sweep == "budget":  # the draw is the level
            low = low.drop("level").select("*", F.explode(F.array(*map(F.lit, sizes))).alias("n_h_level")).withColumn("level", F.col("n_h_level").cast("double"))
        else:
            low = low.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("n_h_level"))
        return fit_cells(sweep, low, cal, self.test, self.train, only, done)


def _levels(df: DataFrame, *levels: float) -> DataFrame:
    return df.select("*", F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("level"))


_NONE = "none"


@query(name="study_order")
def study_order(spark, sf):
    """Shares of swapped displays that are kept."""
    s = Study(spark, sf, ("biased", "all"))
    return s.run("order", _levels(s.rows, 0.0, 0.05, 0.2, 1.0).withColumns({"kind": F.lit(_NONE), "rho_swap": F.col("level")}))


def _noise(s: Study, rows: DataFrame, name: str, rho: float) -> DataFrame:
    kinds, levels = ("anti", "position"), (0.0, 1.0, 2.0, 4.0, 8.0)
    n = len(PANELS["biased"])
    each = []
    for seed in range(SEEDS):  # a judge's rows are turned round, or a record is answered, within one seed's rows
        of = rows.where(F.col("seed") == seed)
        each.append(with_noise(of, kinds, int(max(levels)), n).withColumns({"seed": F.lit(seed), "panel": F.lit("biased")}))
    made = each[0]
    for x in each[1:]:
        made = made.unionByName(x)
    cells = [(k, x) for k in kinds for x in levels if x or k == kinds[0]]
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(x).alias("level")) for k, x in cells))).alias("c")
    made = made.withColumnRenamed("kind", "own").select("*", at).select("*", "c.kind", "c.level").drop("c")
    made = made.where(F.col("own").isNull() | ((F.col("own") == F.col("kind")) & (F.col("k") - n < F.col("level"))))
    return s.run(name, made, rho=rho)


@query(name="study_noise")
def study_noise(spark, sf):
    """Injected judges of two kinds under a one-sided display."""
    s = Study(spark, sf, ("biased",))
    return _noise(s, s.rows, "noise", 0.05)


@query(name="study_noise_scarce")
def study_noise_scarce(spark, sf):
    """The same when judgments are scarce: the panel's rows are drawn first, then judges are injected that answer the records left."""
    s = Study(spark, sf, ("biased",))
    few = X.ranked(s.rows, F.concat(F.lit("scarce"), F.col("seed").cast("string")), ("record_id", "k", "a"), "panel", "seed").where("r <= 400").drop("r")
    return _noise(s, few, "noise_scarce", 1.0)


@query(name="study_budget")
def study_budget(spark, sf):
    """Human samples of growing size."""
    s = Study(spark, sf, ("all", "biased"))
    return s.run("budget", _levels(s.rows, 0.0).withColumn("kind", F.lit(_NONE)), (50, 100, 200, 400, 800, 1600, -1))


@query(name="study_intermediate")
def study_intermediate(spark, sf):
    """Budgets between those of study_budget, for the methods that its curves show; run_cells adds such passes to stored cells."""
    s = Study(spark, sf, ("all", "biased"))
    only = ("human_only", "consensus_cal", "isotonic", "joint_mu")
    return s.run("budget", _levels(s.rows, 0.0).withColumn("kind", F.lit(_NONE)), (75, 150, 300, 600, 1200), only=only)


@query(name="study_llm_budget")
def study_llm_budget(spark, sf):
    """Judges' rows of growing number, at two human budgets."""
    s = Study(spark, sf, ("all", "biased"))
    r = X.ranked(s.rows, F.concat(F.lit("few"), F.col("seed").cast("string")), ("record_id", "k", "a"), "panel", "seed")
    rows = _levels(r, 500, 1000, 2000, 5000, 20000).where(F.col("r") <= F.col("level")).drop("r").withColumn("kind", F.lit(_NONE))
    return s.run("llm_budget", rows, (N_HUMAN, 1000))


@query("SELECT seed, count(*) AS n, count(*) FILTER (WHERE test) AS n_test FROM (SELECT seed, record_id, row_number() OVER (PARTITION BY seed ORDER BY md5('split' || seed || '|' || record_id), record_id) <= round_even(n * 0.3::DOUBLE, 0) AS test FROM (SELECT DISTINCT record_id FROM canon), (SELECT count(DISTINCT record_id) AS n FROM canon), (VALUES (0), (1)) s(seed)) GROUP BY 1", PANEL)
def study_splits(spark, sf):
    """How many records each seed holds out."""
    d = splits(llm(spark, sf).select("record_id").union(human(spark, sf).select("record_id")), SEEDS)
    return d.groupBy("seed").agg(F.count("*").alias("n"), F.count_if("test").alias("n_test"))


# -- specification test ----------------------------------------------------------------------------------------------

#: Whose labels are tested, and whether the judges' consensus comes from all records or from those alone.
SETTINGS = {"english_global": (True, False), "nonenglish_global": (False, False), "nonenglish_subset": (False, True)}
_SPEC = "setting string, level int, seed int, n_l long, n_h long, n_test long, stat double, df int, p_value double, reject05 boolean, human_only_exists boolean, excess_restricted double, excess_full double, tau_mu_vs_test double, error string"


@query(name="study_spectest")
def study_spectest(spark, sf):
    """Whether human scores of a subset lie along the judges' consensus, fitted to judgments of all or of the subset's records without those held out. A record's language is that of the document it asks about, in turn; none counts as not English."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("lang").eqNullSafe("en").alias("english"))
    last = docs.agg(F.max("doc_id").alias("last"))
    about = lambda df: df.crossJoin(last).join(docs, F.col("doc_id") == F.col("record_id") % (F.col("last") + 1), "left").drop("doc_id", "last").withColumn("english", F.coalesce("english", F.lit(False)))  # noqa: E731  one row
    rows, people = cut(about(llm(spark, sf))), cut(about(human(spark, sf)))
    sets = _table(spark, [(k, e, own) for k, (e, own) in SETTINGS.items()], "setting string, english boolean, own boolean")
    seeds = F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed")
    mine = people.select("*", seeds)
    placed = X.ranked(mine, F.concat(F.lit("spec"), F.col("seed").cast("string")), ("record_id",), "english", "seed")
    size = mine.groupBy("english", "seed").agg(F.count("*").alias("size"))
    split = cut(placed.join(size, ["english", "seed"]).withColumn("test", F.col("r") <= F.bround(F.col("size") * F_TEST)).drop("r", "size"))
    held = split.where("test").select("record_id", "seed", F.col("english").alias("group"))
    # Judgments of held-out records of the setting's own subset take no part.
    low = rows.withColumnRenamed("english", "own_english").select("*", seeds).join(sets, ~F.col("own") | (F.col("own_english") == F.col("english")))
    low = low.join(held.withColumnRenamed("group", "english"), ["record_id", "seed", "english"], "left_anti")
    low = cut(P.counts(low, "setting", "seed", "k", "i", "j", "a"))
    named = split.join(sets.select("setting", "english"), "english")
    cal = X.ranked(named.where("not test"), F.concat(F.lit("speccal"), F.col("seed").cast("string")), ("record_id",), "setting", "seed")
    levels = F.explode(F.array(*map(F.lit, (100, 200, 400, 800, 1600)))).alias("level")
    cal = P.counts(cal.select("*", levels).where(F.col("r") <= F.col("level")), "setting", "seed", "level", "i", "j")
    test = P.counts(named.where("test"), "setting", "seed", "i", "j")
    some = lambda df, side: df.withColumns({"side": F.lit(side), "k": F.lit(0), "a": F.lit(0)})
    columns = ["setting", "level", "seed", "side", "k", "i", "j", "a", "n", "y2"]
    both = low.select("*", levels).withColumn("side", F.lit("L")).select(*columns).unionByName(some(cal, "H").select(*columns)).unionByName(some(test.select("*", levels), "T").select(*columns))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        head = dict(zip(("setting", "level", "seed"), p[["setting", "level", "seed"]].iloc[0], strict=True))
        part = lambda s: p[p.side == s].sort_values(["k", "i", "j", "a"])
        pairs = lambda g: (g.i.to_numpy(int), g.j.to_numpy(int), g.n.to_numpy(float), g.y2.to_numpy(float) / 2)
        g, h, t = part("L"), pairs(part("H")), pairs(part("T"))
        out = {"n_l": int(g.n.sum()), "n_h": int(h[2].sum()), "n_test": int(t[2].sum())}
        try:
            used = np.unique(g.k)
            c = K.Counts(np.searchsorted(used, g.k), g.i, g.j, g.a, g.n, g.y2 / 2, len(used), N_REAL_ITEMS)
            mu = K.structured(c, M.highest_rank(c))["mu"]
            stat, df, p_value = K.lr_test(mu[:, None], *h)
            exists = K.mle_exists(*h, c.N)
            reference = K.btl(*t, c.N)[0]
            floor, loss = M.heldout(reference, *t)[0], lambda s: M.heldout(s, *t)[0]
            out |= {"stat": stat, "df": df, "p_value": p_value, "reject05": p_value < 0.05, "human_only_exists": exists, "excess_restricted": loss(K.calibrate(mu[:, None], *h)["s"]) - floor}
            out |= {"excess_full": loss(K.btl(*h, c.N, firth=not exists)[0]) - floor, "tau_mu_vs_test": M.kendall(mu, reference)}
        except Exception as e:  # noqa: BLE001  a row, not a failed task
            out["error"] = f"{type(e).__name__}: {e}"[:4000]
        return _frame([head | out], [c.split()[0] for c in _SPEC.split(", ")])

    return both.repartition(len(SETTINGS) * 5 * SEEDS, "setting", "level", "seed").groupBy("setting", "level", "seed").applyInPandas(work, _SPEC)
