"""Ranks, inversions, isotonic fits and chunks against their plain definitions."""

import random

import numpy as np
import pytest

from pairforge.kernel import solver as K
from pairforge.operators import ordered as O


def tied_rows(n, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), float(rng.randrange(n)), float(rng.randrange(6)) if rng.random() < 0.5 else rng.gauss(0, 1)) for _ in range(n)]
    return rows + [(0, 1.0, 2.0)] * (n // 3) + [(1, None, 2.0), (1, 3.0, None)]


def plain(rows):
    out = {}
    for key in {r[0] for r in rows}:
        at = [(x, y) for k, x, y in rows if k == key and x is not None and y is not None]
        up = down = tx = ty = both = 0
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                dx, dy = np.sign(at[a][0] - at[b][0]), np.sign(at[a][1] - at[b][1])
                up, down = up + (dx * dy > 0), down + (dx * dy < 0)
                tx, ty, both = tx + (dx == 0), ty + (dy == 0), both + (dx == 0 and dy == 0)
        n = len(at) * (len(at) - 1) // 2
        out[key] = n, down, (up - down) / np.sqrt((n - tx) * (n - ty)), (up + both) / n
    return out


@pytest.mark.parametrize("block", [4, 1000])
def test_inversions_and_tau(spark, block):
    rows = tied_rows(150, 1)
    df, want = spark.createDataFrame(rows, "g int, x double, y double").repartition(7), plain(rows)
    got = {r.g: r for r in O.inversions(df, "x", "y", ("g",), block).collect()}
    assert {g: (r.n, r.inversions) for g, r in got.items()} == {g: v[:2] for g, v in want.items()}
    for r in O.kendall(df, "x", "y", ("g",), block).collect():
        assert (r.kendall, r.agree) == pytest.approx(want[r.g][2:])


def test_spearman_and_ndcg(spark):
    rows = tied_rows(80, 2)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "item int, g int, x double, y double")
    whole = [(k, x, y) for k, (_, x, y) in enumerate(rows) if x is not None and y is not None]
    rank = lambda v: np.array([(np.array(v) < a).sum() + ((np.array(v) == a).sum() + 1) / 2 for a in v])
    want = np.corrcoef(rank([r[1] for r in whole]), rank([r[2] for r in whole]))[0, 1]
    assert O.spearman(df, "x", "y").first()[0] == pytest.approx(want)
    place = lambda c: {k: n for n, (_, k) in enumerate(sorted((-r[c], r[0]) for r in whole))}
    t, e = place(1), place(2)
    gain = lambda at: sum((2.0 ** (len(whole) - 1 - t[k]) - 1) / np.log2(p + 2) for k, p in at.items() if p < 10)
    assert O.ndcg(df, "x", "y", "item", k=10).first()[0] == pytest.approx(gain(e) / gain(t))


@pytest.mark.parametrize(("block", "parts"), [(3, 1), (3, 6), (40, 3), (10_000, 2)])
def test_isotonic_is_the_same_however_it_is_dealt(spark, block, parts):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(0, 1, 120), np.arange(40) * 0.2, np.arange(40, 0, -1.0), np.full(10, 2.0)])
    w = rng.integers(1, 4, len(y)).astype(float)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(y, w, strict=True))] + [(None, 1.0, 1.0), (3, None, 1.0), (4, 1.0, 0.0)], "x int, y double, w double").repartition(parts)
    got = sorted((r.x, r.fit) for r in O.isotonic(df, "x", "y", "w", block=block).collect())
    assert [x for x, _ in got] == list(range(len(y)))
    np.testing.assert_allclose([f for _, f in got], K.isotonic(y, w), atol=1e-9)


def test_isotonic_by_key_with_equal_places(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 1, 1.0), ("a", 2, 1.0), ("b", 5, 0.0)], "g string, x int, y double")
    assert {(r.g, r.x): (r.weight, r.mean, round(r.fit, 9)) for r in O.isotonic(df, "x", "y", keys=("g",)).collect()} == {("a", 1): (2.0, 2.0, round(5 / 3, 9)), ("a", 2): (1.0, 1.0, round(5 / 3, 9)), ("b", 5): (1.0, 0.0, 0.0)}


def plain_chunks(rows, most_rows, most_tokens, most_bytes):
    out, state = {}, {}
    for g, o, t, b in sorted(rows):
        if t > most_tokens or b > most_bytes:
            out[g, o] = -1
            continue
        chunk, n, tokens, size = state.get(g, (0, 0, 0, 0))
        if n and (n + 1 > most_rows or tokens + t > most_tokens or size + b > most_bytes):
            chunk, n, tokens, size = chunk + 1, 0, 0, 0
        state[g] = chunk, n + 1, tokens + t, size + b
        out[g, o] = chunk
    return out


@pytest.mark.parametrize(("most_rows", "block"), [(5, 20), (5, 100_000), (1, 8)])
def test_chunks_close_as_in_one_pass(spark, most_rows, block):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), k, rng.randint(0, 40) if rng.random() < 0.97 else 101, rng.randint(0, 9)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, tokens int, bytes int").repartition(5)
    got = {(r.g, r.o): r.chunk for r in O.greedy_chunks(df, "g", "o", most_rows, 100, 25, block=block).collect()}
    assert got == plain_chunks(rows, most_rows, 100, 25)
