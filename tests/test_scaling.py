"""Fits, components and linear systems as Spark jobs, against dense results and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.kernel import solver as K
from pairforge.operators import graph as G
from pairforge.operators import scaling as M


def pairs_of(spark, rng, cells, n_items, extra=0):
    """Pairs of items of each cell, a ring and some more, with labels of known scores."""
    rows = []
    for cell in range(cells):
        s = rng.normal(0, 0.7, n_items)
        at = {(min(i, (i + 1) % n_items), max(i, (i + 1) % n_items)) for i in range(n_items)}
        while len(at) < n_items + extra:
            i, j = sorted(rng.choice(n_items, 2, replace=False).tolist())
            at.add((i, j))
        for i, j in sorted(at):
            n = int(rng.integers(8, 40))
            y = int(rng.binomial(n, 1 / (1 + np.exp(s[j] - s[i]))))
            rows.append((cell, i, j, n, min(max(y, 1), n - 1) + 0.5 * (cell % 2)))
    return spark.createDataFrame(rows, "cell int, item_i int, item_j int, n int, y double"), rows


def dense(rows, cell, size):
    i, j, n, y = (np.array(v) for v in zip(*[r[1:] for r in rows if r[0] == cell], strict=True))
    return i, j, n.astype(float), y.astype(float), K.btl(i, j, n.astype(float), y.astype(float), size)[0]


def test_scores_of_all_cells_at_once(spark):
    df, rows = pairs_of(spark, np.random.default_rng(1), 3, 9, 8)
    got = {(r.cell, r.item): r for r in M.bradley_terry(df, ("cell",)).collect()}
    assert len(got) == 27 and all(r.converged for r in got.values())
    for cell in range(3):
        np.testing.assert_allclose([got[cell, k].score for k in range(9)], dense(rows, cell, 9)[-1], atol=2e-6)


def test_scores_without_a_maximum_end_at_the_bound(spark):
    df = spark.createDataFrame([("a", "b", 4, 4), ("b", "c", 3, 1), ("b", "c", None, 1), (None, "c", 3, 1)], "item_i string, item_j string, n int, y int")
    got = {r.item: r for r in M.bradley_terry(df, most=60).collect()}
    assert set(got) == {"a", "b", "c"} and not got["a"].converged and got["a"].score - got["b"].score > 5


@pytest.mark.parametrize("cells", [1])
def test_contrasts_match_the_dense_inverse(spark, cells):
    df, rows = pairs_of(spark, np.random.default_rng(2), cells, 8, 5)
    i, j, n, y, s = dense(rows, 0, 8)
    scores = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(s)], "cell int, item int, score double")
    p, d = K.sigmoid(s[i] - s[j]), np.eye(8)[i] - np.eye(8)[j]
    inverse = np.linalg.pinv(d.T @ ((n * p * (1 - p))[:, None] * d))
    targets = [(0, f"{a}-{b}", k, v) for a, b in ((0, 3), (2, 7)) for k, v in ((a, 1.0), (b, -1.0))]
    got = {r.target: r for r in M.contrast_intervals(df, scores, spark.createDataFrame(targets, "cell int, target string, item int, b double"), ("cell",)).collect()}
    for a, b in ((0, 3), (2, 7)):
        v = np.eye(8)[a] - np.eye(8)[b]
        r = got[f"{a}-{b}"]
        assert r.estimate == pytest.approx(v @ s) and r.se == pytest.approx(np.sqrt(v @ inverse @ v), abs=1e-6) and r.lower < r.estimate < r.upper


def test_logistic_blocks_match_the_kernel(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for block in range(3):
        x, n = rng.normal(0, 1, (20, 2)), rng.integers(5, 30, 20)
        y = rng.binomial(n, 1 / (1 + np.exp(-x @ [0.8, -0.4])))
        c, value, _ = K.logistic(x, n.astype(float), y.astype(float))
        p = K.sigmoid(x @ c)
        want[block] = c, np.linalg.inv(x.T @ ((n * p * (1 - p))[:, None] * x)), value
        rows += [(block, v.tolist(), int(a), int(b)) for v, a, b in zip(x, n, y, strict=True)]
    got = M.logistic_blocks(spark.createDataFrame(rows, "block int, x array<double>, n int, y int"), 2, ("block",)).collect()
    assert len(got) == 3
    for r in got:
        c, cov, _ = want[r.block]
        np.testing.assert_allclose(r.coef, c, atol=1e-6)
        np.testing.assert_allclose(np.reshape(r.cov, (2, 2)), cov, rtol=1e-5)


def components(nodes, edges):
    to = {v: {b for a, b in edges if a == v} for v in nodes}

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            new = to[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    found = {v: reach(v) for v in nodes}
    return {v: min(w for w in found[v] if v in found[w]) for v in nodes}


def test_strong_components_of_random_graphs(spark):
    rng, nodes, edges = random.Random(5), [], []
    for g in range(25):
        n = rng.randint(1, 9)
        nodes += [g * 100 + k for k in range(n)]
        edges += [(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))]
    got = G.strongly_connected(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(v,) for v in nodes], "node long"))
    assert {r.node: r.comp for r in got.collect()} == components(nodes, edges)


def test_rings_and_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    kept = G.written
    monkeypatch.setattr(G, "written", lambda df: rounds.append(1) or kept(df))
    n = 700
    edges = [(k, k + 1) for k in range(n)] + [(1000 + k, 1000 + (k + 1) % n) for k in range(n)]
    nodes = sorted({x for e in edges for x in e})
    comp = {r.node: r.comp for r in G.strongly_connected(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(v,) for v in nodes], "node long")).collect()}
    assert {comp[1000 + k] for k in range(n)} == {1000} and all(comp[k] == k for k in range(n))
    assert len(rounds) < 60


def test_existence_by_cell(spark):
    rows = [("cycle", 0, 1, 1, 1.0), ("cycle", 1, 2, 1, 1.0), ("cycle", 0, 2, 1, 0.0), ("source", 0, 1, 2, 2.0), ("source", 1, 2, 2, 1.0), ("alone", 0, 1, 2, 1.0), ("tied", 0, 1, 1, 0.5)]
    items = [(c, k) for c, n in (("cycle", 3), ("source", 3), ("alone", 3), ("tied", 2), ("one", 1)) for k in range(n)]
    got = M.mle_exists(spark.createDataFrame(rows, "cell string, item_i int, item_j int, n int, y double"), spark.createDataFrame(items, "cell string, item int"), ("cell",))
    assert {r.cell: r.mle_exists for r in got.collect()} == {"cycle": True, "source": False, "alone": False, "tied": True, "one": True}


def test_no_step_gathers_a_cell(spark):
    df, _ = pairs_of(spark, np.random.default_rng(4), 2, 5)
    sides = M.sides(df, ("cell",))
    assert "InPandas" not in sides._jdf.queryExecution().executedPlan().toString()
    edges = M.weighted(df, M.bradley_terry(df, ("cell",)), ("cell",))
    assert edges.select(F.sum("w")).first()[0] > 0


@pytest.mark.parametrize("rows", [0, 250_000])
def test_rounds_leave_their_last_tables(spark, monkeypatch, rows):
    """Rounds delete the tables that nothing reads any more; scores are the same whether edges are dealt out or not."""
    from pathlib import Path

    from pairforge.operators.lineage import scratch

    monkeypatch.setattr(M, "ROWS", rows)
    pairs = spark.createDataFrame([(0, 1, 10, 7.0), (1, 2, 8, 5.0), (0, 2, 6, 3.0), (2, 3, 9, 2.0)], "item_i long, item_j long, n long, y double")
    top = Path(scratch(spark, "x").removeprefix("file:")).parent
    before = set(top.glob("table-*"))
    got = {r.item: r.score for r in M.bradley_terry(pairs).collect()}
    assert len(set(top.glob("table-*")) - before) == (2 if rows else 1)
    for item, wins in {0: 10.0, 1: 8.0, 2: 8.0, 3: 7.0}.items():  # at the maximum the expected wins are those seen
        fit = sum(n / (1 + np.exp(got[b] - got[a])) for i, j, n, _ in pairs.collect() for a, b in ((i, j), (j, i)) if a == item)
        assert fit == pytest.approx(wins, abs=1e-5)


@pytest.mark.parametrize("rows", [0, 250_000])
def test_iterations_leave_what_results_read(spark, monkeypatch, rows):
    """Of conjugate gradients the tables with solved targets stay, and the edges if they aren't dealt out; the solution is the same."""
    from pathlib import Path

    from pairforge.operators.lineage import scratch

    monkeypatch.setattr(M, "ROWS", rows)
    w = np.array([[0, 2, 1, 0], [2, 0, 3, 0], [1, 3, 0, 4], [0, 0, 4, 0]], float)
    edges = spark.createDataFrame([(a, b, float(w[a, b])) for a in range(4) for b in range(4) if w[a, b]], "s int, o int, w double")
    top = Path(scratch(spark, "x").removeprefix("file:")).parent
    before = set(top.glob("table-*"))
    out = M.laplacian_solve(edges, spark.createDataFrame([("t", 0, 1.0), ("t", 3, -1.0)], "target string, item int, b double"))
    got = {r.item: r.x for r in out.collect()}
    assert len(set(top.glob("table-*")) - before) == (2 if rows else 1)
    assert [got[k] for k in range(4)] == pytest.approx((np.linalg.pinv(np.diag(w.sum(0)) - w) @ [1, 0, 0, -1]).tolist(), abs=1e-8)
