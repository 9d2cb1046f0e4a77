"""Gradients by finite differences, identification, recovery of known truth, and table-driven rules."""

import math

import numpy as np
import pytest

from pairforge.kernel import solver as K
from pairforge.plans import studies

from . import truths


@pytest.fixture(scope="module")
def cell():
    p = truths.draw_params(3)
    return p, truths.draw_counts(p, 3, 400), truths.draw_human(p, 3, 3000)


def test_chart_derivatives(cell):
    _, c, (i, j, n, y) = cell
    chart = K.Chart(c.K, c.N, 1, True, 2)
    t = np.random.default_rng(1).normal(0, 0.3, chart.dim)
    for f in (lambda t: chart.rows(t, c), lambda t: chart.human_rows(t, i, j)):
        _, x = f(t)
        fd = np.stack([(f(t + d)[0] - f(t - d)[0]) / 2e-6 for d in 1e-6 * np.eye(chart.dim)], 1)
        assert np.allclose(x, fd, rtol=2e-5, atol=1e-7)


def test_structured_fit_finds_the_truth(cell):
    p, c, _ = cell
    f = K.structured(c, 1)
    true = np.outer(p["gamma"], p["mu"]) + np.outer(p["u"], p["v"])
    assert f["converged"] and np.abs(f["S"] - true).max() < 0.25 and np.abs(f["b"] - p["b"]).max() < 0.15
    assert abs(f["mu"].sum()) < 1e-8 and abs(f["gamma"].sum() - c.K) < 1e-6 and abs(f["mu"] @ f["V"][:, 0]) < 1e-8 and abs(f["V"][:, 0] @ f["V"][:, 0] - c.N) < 1e-8


def test_rank_by_bic(cell):
    _, c, _ = cell
    values = [K.bic(c, r) for r in range(3)]
    assert values.index(min(values)) == 1
    with pytest.raises(ValueError):
        K.structured(c, 9)


def test_reanchor_keeps_scores():
    rng = np.random.default_rng(2)
    g, u, mu, v = 1 + K.basis(4) @ rng.normal(0, 0.1, 3), K.basis(4) @ rng.normal(size=(3, 2)), K.basis(6) @ rng.normal(size=5), K.basis(6) @ rng.normal(size=(5, 2))
    g2, u2, mu2, v2 = K.reanchor(g, u, mu, v)
    assert np.allclose(np.outer(g, mu) + u @ v.T, np.outer(g2, mu2) + u2 @ v2.T) and np.allclose(v2.T @ v2, 6 * np.eye(2)) and (u2[0] > 0).all()


def test_joint_lies_between_its_ends(cell):
    p, c, (i, j, n, y) = cell
    path = K.select(c, i, j, n, y, 1)
    best = K.chosen(path)
    assert {math.inf, 0.0} <= {x["lam"] for x in path} and best["gacv"] == min(x["gacv"] for x in path if x["regular"])
    assert np.corrcoef(best["s"], p["mu"])[0, 1] > 0.97
    f = K.joint(c, i, j, n, y, c.total / n.sum(), 1)
    cov = K.sandwich(f, c, i, j, n, y)
    assert f["converged"] and np.linalg.eigvalsh((cov + cov.T) / 2).min() > -1e-10


def test_existence_and_firth():
    a = np.array
    assert K.mle_exists(a([0, 1, 0]), a([1, 2, 2]), a([1, 1, 1]), a([1, 1, 0]), 3)
    assert not K.mle_exists(a([0, 0]), a([1, 2]), a([2, 2]), a([2, 2]), 3)
    i, j = np.triu_indices(5, 1)
    n = np.full(len(i), 30.0)
    s, _, _ = K.btl(i, j, n, np.where(i == 0, 30.0, 15.0), 5, firth=True)
    assert np.isfinite(s).all() and s[0] > 3 and np.abs(s).max() < 30 and abs(s.sum()) < 1e-8


def test_isotonic_and_tails():
    assert K.isotonic(np.array([3.0, 1, 2, 4])).tolist() == [2, 2, 2, 4]
    assert abs(K.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(K.chi2_tail(18.307038, 10) - 0.05) < 1e-6
    lo, hi = K.ncx2_interval(30.0, 4, 0.95)
    assert abs(K.ncx2_tail(30.0, 4, lo) - 0.025) < 1e-6 and abs(K.ncx2_tail(30.0, 4, hi) - 0.975) < 1e-6


def test_lr_test_keeps_an_aligned_target(cell):
    p, _, (i, j, n, y) = cell
    assert K.lr_test(p["mu"][:, None], i, j, n, y)[2] > 0.01
    assert K.lr_test(p["v"][:, None], i, j, n, y)[2] < 1e-6


def test_a_failing_method_is_a_row(cell, monkeypatch):
    _, c, (i, j, n, y) = cell

    def fail(*a, **k):
        raise RuntimeError("no")

    monkeypatch.setattr(K, "select", fail)
    rows = {r[0]: r for r in studies.run_methods(c, i, j, n, y, np.zeros(c.N))}
    assert rows["joint"][-1] == "RuntimeError: no" and rows["human_only"][-1] is None


def test_selection_gives_its_reasons(monkeypatch):
    from pairforge.plans import estimation as E
    from .truths import draw_counts, draw_human, draw_params

    p = draw_params(3)
    c, (i, j, n, y) = draw_counts(p, 3, 20), draw_human(p, 3, 300)
    path = K.select(c, i, j, n, y, 1)
    assert all(x["regular"] == (not x["reasons"]) for x in path)
    won = K.select(c, i, j, n, n.copy(), 1)  # the first of each pair always wins
    assert ["mle_not_exists" in x["reasons"] for x in won if x["lam"] == 0] == [True]
    fit = K.joint(c, i, j, n, y, 1.0, 1)
    fit["t"] = fit["t"].copy()
    fit["t"][0] = K.BOX
    fit |= K.box_activity(fit["chart"], fit["t"])
    assert fit["boundary_gamma"] and not fit["boundary_b"] and fit["n_at_bound"] == 1 and fit["max_abs_coord"] == K.BOX
    assert not K.gacv_joint(fit, c, i, j, n, y)[1] and "box_active" in fit["reasons"]
    got = E._rank_lambda(c, i, j, n, y)
    assert got["rank"] == (0, 1, 2) and sum(got["best"]) == 1 and got["gacv"][got["best"].index(True)] == min(g for g, e in zip(got["gacv"], got["error"], strict=True) if e is None)
    select = K.select
    monkeypatch.setattr(K, "select", lambda *a: 1 / 0 if a[-1] == 1 else select(*a))
    assert E._rank_lambda(c, i, j, n, y)["error"][1].startswith("ZeroDivisionError")


def test_studies_select_over_all_weights(cell, monkeypatch):
    _, c, (i, j, n, y) = cell
    seen, select = [], K.select
    monkeypatch.setattr(K, "select", lambda *a, **k: seen.append(select(*a, **k)) or seen[-1])
    studies.run_methods(c, i, j, n, y, np.zeros(c.N))
    assert len([x for x in seen[0] if 0 < x["lam"] < math.inf]) == 7


def test_convergence_is_a_matter_of_the_gradient(cell):
    _, c, (i, j, n, y) = cell
    chart = K.Chart(c.K, c.N, 1)
    terms = [lambda t: (*chart.rows(t, c), c.n, c.y, 1.0 / c.total)]
    assert not K._minimise(K.start(c, 1, chart), terms, steps=1)[2] and K._minimise(K.start(c, 1, chart), terms)[2]
    x = K.contrasts(c.N) @ K.basis(c.N)
    assert not K.logistic(x, n, y, steps=1)[2] and K.logistic(x, n, y)[2]


def test_a_judge_of_position_alone_lies_at_its_bound():
    """Such a judge has no finite position effect: the fit converges with that one at the bound, and says so."""
    rng, s = np.random.default_rng(0), np.linspace(-1, 1, 6)
    cell = [(k, i, j, a) for k in range(4) for i in range(6) for j in range(i + 1, 6) for a in (-1, 1)]
    k, i, j, a = (np.array(v) for v in zip(*cell, strict=True))
    y = np.where(k == 3, np.where(a > 0, 6, 0), rng.binomial(6, K.sigmoid(s[i] - s[j] + 0.3 * a)))
    f = K.structured(K.Counts(k, i, j, a, np.full(len(k), 6), y, 4, 6), 1)
    assert f["converged"] and f["b_at_bound"] == 1 and f["boundary_b"] and f["boundary_any"]
    assert abs(f["b"][3]) >= K.BOX - 1e-6 and np.abs(f["b"][:3]).max() < 2 and np.abs(f["mu"]).max() < 5


def test_scores_made_monotone_along_the_humans_order():
    truth = np.array([-1.0, -0.5, 0.0, 0.5, 1.0])
    i, j = np.triu_indices(5, 1)
    human = K.btl(i, j, np.full(10, 200.0), 200 * K.sigmoid(truth[i] - truth[j]), 5)[0]
    s = K.monotone_along(human, np.array([0.0, 2.0, -1.0, 3.0, 1.0]))
    assert np.argsort(human).tolist() == list(range(5)) and (np.diff(s) >= -1e-12).all() and abs(s.mean()) < 1e-12
    assert np.allclose(s + 1.0, [0, 0.5, 0.5, 2, 2]) and np.allclose(K.monotone_along(human, truth), truth)


def test_non_centrality_for_any_statistic():
    """Both ends hold their tails, also where the statistic has grown with the sample; the upper end covers at its level."""
    for x, df in ((0.2, 4), (3.0, 1), (40.0, 4), (1000.0, 4), (1e5, 8), (1e6, 18)):
        lo, hi = K.ncx2_interval(x, df)
        assert 0 <= lo <= hi and (lo == 0 or abs(K.ncx2_tail(x, df, lo) - 0.05) < 1e-7) and (hi == 0 or abs(K.ncx2_tail(x, df, hi) - 0.95) < 1e-7)
    rng = np.random.default_rng(4)
    stats = rng.noncentral_chisquare(5, 12.0, 400)
    inside = [lo <= 12.0 <= hi for lo, hi in (K.ncx2_interval(float(x), 5) for x in stats)]
    assert 0.85 < np.mean(inside) < 0.95


def test_anchors_need_their_conditions():
    g, mu = np.ones(4), K.basis(6) @ np.arange(1.0, 6)
    u, v = K.basis(4)[:, :1], K.basis(6)[:, :1]
    for odd in ((g, u, 0 * mu, v), (g + 0.1, u, mu, v), (g, 0 * u, mu, v), (g + 0.1, u[:, :0], mu, v[:, :0])):
        with pytest.raises(ValueError, match="no anchor"):
            K.reanchor(*odd)


def test_nothing_regular_falls_back_to_the_judges(cell, monkeypatch):
    _, c, (i, j, n, y) = cell
    monkeypatch.setattr(K, "MOST_SELECTED", 1e-9)
    path = K.select(c, i, j, n, y, 1, "mu")
    assert K.dropped(path) == (len(path), True) and math.isinf(K.chosen(path)["lam"]) and all("score_bound" in p["reasons"] for p in path)
    assert K.with_margin(path, n.sum(), 1.0)[1] == "all_irregular_fallback"


def test_a_fit_at_the_box_starts_the_next_but_is_not_chosen(cell, monkeypatch):
    _, c, (i, j, n, y) = cell
    starts, real = [], K.joint

    def marked(*a):
        starts.append(a[8])
        f = real(*a)
        return f | {"boundary_any": True} if len(starts) == 1 else f

    monkeypatch.setattr(K, "joint", marked)
    path = K.select(c, i, j, n, y, 1, "mu")
    assert path[1]["reasons"] == ["box_active"] and not path[1]["regular"] and K.chosen(path)["lam"] != path[1]["lam"]
    assert np.array_equal(starts[1], path[1]["fit"]["t"])


def test_sandwich_targets_and_the_bias_operator(cell):
    p, c, (i, j, n, y) = cell
    truth = K.btl(i, j, n, y, c.N)[0]
    lap = K.laplacian(truth, i, j, n)
    shares = []
    for m in (0.01, 1.0, 100.0):
        f = K.joint(c, i, j, n, y, m * c.total / n.sum(), 1, "mu")
        sw = K.joint_sandwich(f, c, i, j, n, y, K.pair_clusters(c))
        a = K.bias_operator(sw, lap)
        assert np.allclose(lap @ a, (lap @ a).T, atol=1e-6) and np.linalg.eigvals(a).real.max() < 1 + 1e-6
        shares.append(np.trace(a))
        w = K.widened(f["s"], sw, truth, 0.01, i, j, n)
        assert (w["kappa"] >= 0).all() and (w["widening"] >= 0).all() and sw["cov_b"].shape == (c.K, c.K) and sw["cov_S"].shape == (c.K * c.N,) * 2
    assert shares[0] > shares[1] > shares[2]
    f = K.structured(c, 1)
    got = K.delta_method(f, c, [("score_diff", 1, 0, 2), ("score_diff", 1, 0, 2, 1.0), ("score_entry", 1, 0), ("consensus_diff", 0, 2), ("consensus_score", 0), ("gamma", 1), ("position_effect", 1)])
    assert abs(got[0][0] - (f["S"][1, 0] - f["S"][1, 2])) < 1e-12 and abs(got[1][0] - got[0][0] - f["b"][1]) < 1e-12 and all(se > 0 for _, se in got)
    iid = np.sqrt(np.diag(K.llm_sandwich(f, c))[f["chart"].at[2] : f["chart"].at[3]])
    assert abs(got[6][1] / iid[1] - 1) < 0.1
    with pytest.raises(ValueError):
        K.delta_method(f, c, [("other", 1)])
    with pytest.raises(ValueError):
        K.llm_sandwich(K.structured(c, 1, order=False), c)


def test_a_study_cell_has_all_methods(cell, monkeypatch):
    from pairforge.kernel import methods as M

    p, c, pairs = cell
    test = truths.draw_human(p, 9, 2000)
    rows = {r["method"]: r for r in M.Cell(c, pairs, test).table()}
    assert set(M.METHODS) <= set(rows) and len(rows) == 15 and not any(r["error"] for r in rows.values())
    assert all(r["excess"] > 0 for r in rows.values()) and rows["oracle_test"]["logloss"] <= rows["joint_mu"]["logloss"] and rows["joint_rank"]["r_sel"] in (0, 1, 2) and rows["consensus_cal"]["is_anchor"]
    monkeypatch.setattr(K, "isotonic", lambda *a: 1 / 0)
    rows = {r["method"]: r for r in M.Cell(c, pairs, test).table(("isotonic", "human_only"))}
    assert rows["isotonic"]["error"].startswith("ZeroDivisionError") and rows["human_only"]["error"] is None
