"""Mergeable summaries, and that every query reads the given tables."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from pairforge.operators import summary as U
from pairforge.plans import catalog


def test_states_of_parts_merge_to_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k % 3), float(v), int(t)) for k, (v, t) in enumerate(zip(np.concatenate((rng.normal(0, 50, 400), rng.lognormal(2, 2, 400), np.zeros(20))), rng.integers(0, 50, 820), strict=True))]
    rows += [(0, None, 1), (1, float("nan"), 0), (None, 3.0, 2), (None, -3.0, 1), (4, None, 1)]
    df = spark.createDataFrame(rows, "g int, v double, t int").withColumn("part", F.col("t") % 4)
    whole = {r.g: r for r in U.finish(U.summarize(df, "v", "t", ("g",)), ("g",), (0.0, 0.5, 0.9, 1.0)).collect()}
    parts = U.summarize(df, "v", "t", ("part", "g")).drop("part")
    half = U.merge(parts.limit(7), ("g",)).unionByName(parts.join(parts.limit(7).select("g"), "g", "left_anti").limit(0))
    assert half.count() > 0
    merged = {r.g: r for r in U.finish(U.merge(parts, ("g",)), ("g",), (0.0, 0.5, 0.9, 1.0)).collect()}
    assert set(whole) == set(merged) == {0, 1, 2, 4, None}
    for g, r in whole.items():
        m = merged[g]
        v = np.sort([x for k, x, _ in rows if k == g and x is not None and x == x])
        assert (r.n, r.n_null, r.least, r.most, r.first) == (m.n, m.n_null, m.least, m.most, m.first) and r.n == len(v)
        if not len(v):
            assert (r.mean, r.sd, r.q50, r.first) == (None, None, None, None)
            continue
        assert (r.mean, m.mean) == (pytest.approx(v.mean()), pytest.approx(v.mean())) and r.sd == pytest.approx(v.std(ddof=1)) and r.se == pytest.approx(v.std(ddof=1) / np.sqrt(len(v)))
        assert r.first == min((t, x) for k, x, t in rows if k == g and x is not None and x == x)[1]
        for q, name in ((0.0, "q0"), (0.5, "q50"), (0.9, "q90"), (1.0, "q100")):
            want = v[int(np.floor(q * (len(v) - 1)))]
            assert r[name] == m[name] and abs(r[name] - want) <= U.ERROR * abs(want) + 1e-9
    assert U.finish(U.summarize(df.limit(0), "v", "t")).first().n == 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_every_query_reads_a_table(spark, name):
    with pytest.raises((AnalysisException, PySparkException), match="PATH_NOT_FOUND"):
        catalog.queries()[name](spark, "/no/such/folder").collect()
