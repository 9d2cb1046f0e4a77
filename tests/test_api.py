"""The public functions over tables of any names and cells, and the measures against plain loops."""

import math

import numpy as np
import pytest

import pairforge as pf
from pairforge.kernel import solver as K
from . import truths


@pytest.fixture(scope="module")
def tables(spark):
    """Two cells of known truth; pairs in either order, judges and items with names, a cell without human rows."""
    rows, people = [], []
    for cell in (1, 2):
        p = truths.draw_params(cell)
        c, (i, j, n, y) = truths.draw_counts(p, cell, 60), truths.draw_human(p, cell, 900)
        for k, a, b, o, m, w in zip(c.k, c.i, c.j, c.a, c.n, c.y, strict=True):
            rows.append((cell, f"judge {k}", f"item {a}", f"item {b}", float(w), float(o), float(m)) if (a + b) % 2 else (cell, f"judge {k}", f"item {b}", f"item {a}", float(m - w), float(-o), float(m)))
        people += [(cell, f"item {a}", f"item {b}", float(w), float(m)) for a, b, m, w in zip(i, j, n, y, strict=True) if m]
    rows += [(3, *r[1:]) for r in rows if r[0] == 1] + [(1, None, "item 0", "item 1", 1.0, 1.0, 1.0), (1, "judge 0", "item 0", None, 1.0, 1.0, 1.0)]
    llm = spark.createDataFrame(rows, "cell int, judge string, item_i string, item_j string, y double, a double, n double")
    return llm, spark.createDataFrame(people, "cell int, item_i string, item_j string, y double, n double")


def _scores(df, cell):
    return {r["item"]: r["score"] for r in df.where(f"cell = {cell}").collect()}


def test_scores_by_cell_are_those_of_the_kernel(tables):
    llm, human = tables
    p = truths.draw_params(2)
    c, pairs = truths.draw_counts(p, 2, 60), truths.draw_human(p, 2, 900)
    base = K.structured(c, 1)
    want = {
        "human": K.btl(*pairs, c.N)[0], "pooled": K.calibrate(K.btl(c.i, c.j, c.n, c.y, c.N)[0][:, None], *pairs)["s"], "consensus": K.staged(base, *pairs, "mu")["s"], "staged": K.staged(base, *pairs, "W")["s"],
        "isotonic": K.monotone_along(K.btl(*pairs, c.N)[0], base["mu"]), "joint": K.joint(c, *pairs, c.total / pairs[2].sum(), 1)["s"], "selected": K.chosen(K.select(c, *pairs, 1))["s"],
    }
    got = {
        "human": pf.fit_human(human, ("cell",)), "pooled": pf.fit_pooled(llm, human, ("cell",)), "consensus": pf.fit_consensus(llm, human, keys=("cell",)), "staged": pf.fit_staged(llm, human, keys=("cell",)),
        "isotonic": pf.fit_isotonic(llm, human, keys=("cell",)), "joint": pf.fit_joint(llm, human, keys=("cell",)), "selected": pf.fit_selected(llm, human, keys=("cell",)),
    }
    for name, s in want.items():
        found = _scores(got[name], 2)
        assert sorted(found) == [f"item {k}" for k in range(6)] and np.allclose([found[f"item {k}"] for k in range(6)], s, atol=2e-4), name


def test_a_cell_that_fails_gives_its_error(tables):
    llm, human = tables
    rows = pf.fit_joint(llm, human, keys=("cell",)).collect()
    assert all(r.error for r in rows if r.cell == 3) and not any(r.error for r in rows if r.cell != 3)
    assert pf.fit_judges(llm.where("cell = 1"), rank=9).first().error.startswith("ValueError")
    assert pf.fit_human(human.limit(0)).count() == 0 and pf.fit_judges(llm.limit(0), keys=("cell",)).count() == 0


def test_parameters_path_and_intervals(tables):
    llm, human = (t.where("cell = 1") for t in tables)
    f = pf.fit_judges(llm).toPandas()
    n = f.groupby("parameter").size().to_dict()
    assert n == {"S": 24, "U": 4, "V": 6, "b": 4, "gamma": 4, "mu": 6} and abs(f[f.parameter == "gamma"].value.sum() - 4) < 1e-6
    path = pf.selection_path(llm, human).toPandas()
    assert path.selected.sum() == 1 and path.is_anchor.sum() == 1 and len(path) == 9
    v = pf.joint_intervals(llm, human).toPandas()
    assert (v[v.target == "contrast"].lower_widened <= v[v.target == "contrast"].lower).all() and len(v) == 19 and (v.lower < v.upper).all()
    t = pf.judge_intervals(llm).toPandas()
    assert t.groupby("target").size().to_dict() == {"consensus_diff": 15, "consensus_score": 6, "gamma": 4, "position_effect": 4, "score_diff": 60, "score_entry": 24}
    one = pf.calibration_test(llm, human).first()
    assert one.df == 4 and 0 <= one.p_value <= 1 and one.misalignment_lower <= one.misalignment_upper
    assert pf.rank_by_bic(llm).where("best").first()["rank"] == 1
    assert {r.lam for r in pf.fit_selected(llm, human, margin=1e9).collect()} == {None}


def test_measures_against_loops(spark):
    rng = np.random.default_rng(3)
    true, est = {}, {}
    for cell in (1, 2):
        for k in range(7):
            true[cell, k], est[cell, k] = float(rng.integers(0, 5)), float(rng.integers(0, 5))
    frame = lambda d: spark.createDataFrame([(c, k, v) for (c, k), v in d.items()], "cell int, item int, score double")
    rows = [(cell, int(a), int(b), y) for cell in (1, 2) for a, b, y in [(*rng.choice(7, 2, replace=False), float(rng.integers(0, 2))) for _ in range(40)]] + [(1, 0, 1, 0.5), (1, 0, 1, None)]
    records = spark.createDataFrame(rows, "cell int, item_i int, item_j int, y double")
    t, e = frame(true), frame(est)
    ends = e.selectExpr("cell", "item", "score - 1 as lower", "score + 1 as upper")
    got = {r.cell: r for r in pf.evaluate_scores(t, e, ends, ("cell",), k=3).collect()}
    loss = {r.cell: r.log_loss for r in pf.log_loss(records, e, ("cell",)).collect()}
    hit = {r.cell: r.sign_accuracy for r in pf.human_sign_accuracy(e, rows=records, keys=("cell",)).collect()}
    for cell in (1, 2):
        a, b = (np.array([d[cell, k] for k in range(7)]) for d in (true, est))
        up = np.triu_indices(7, 1)
        x, y = np.sign(a[up[0]] - a[up[1]]), np.sign(b[up[0]] - b[up[1]])
        place = lambda v: np.array([(v < q).sum() + ((v == q).sum() + 1) / 2 for q in v])
        a0, b0 = a - a.mean(), b - b.mean()
        order = lambda v: sorted(range(7), key=lambda k: (-v[k], k))
        gain = {k: 2.0 ** (6 - r) - 1 for r, k in enumerate(order(a))}
        dcg = lambda v: sum(gain[k] / math.log2(r + 2) for r, k in enumerate(order(v)[:3]))
        want = (((a0 - (a0 @ b0) / (b0 @ b0) * b0) ** 2).mean(), np.corrcoef(place(a), place(b))[0, 1], dcg(b) / dcg(a), (x == y).mean(), (x * y).sum() / math.sqrt(np.abs(x).sum() * np.abs(y).sum()), (np.abs(a - b) <= 1).mean())
        assert np.allclose([got[cell][c] for c in ("mse", "spearman", "ndcg", "sign_accuracy", "kendall", "coverage")], want)
        own = [(b[i], b[j], y) for c, i, j, y in rows if c == cell and y in (0.0, 1.0)]
        assert math.isclose(loss[cell], np.mean([np.logaddexp(0, (q - p) if y else (p - q)) for p, q, y in own]))
        assert math.isclose(hit[cell], np.mean([(p > q) == (y == 1) for p, q, y in own]))
    with pytest.raises(ValueError):
        pf.human_sign_accuracy(e)
    with pytest.raises(Exception, match="all equal"):
        pf.mse(t, e.selectExpr("cell", "item", "1.0 as score"), ("cell",)).collect()
