"""The factor model by alternation reaches the kernel's likelihood."""

import numpy as np
import pytest

from pairforge.kernel import solver as K
from pairforge.operators.factors import factor_model

from . import truths


@pytest.mark.parametrize("rank", [0, 1])
def test_alternation_reaches_the_likelihood_of_the_kernel(spark, rank):
    c = truths.draw_counts(truths.draw_params(2), 2, 60)
    want = K.structured(c, rank)
    rows = list(zip(c.k.tolist(), c.i.tolist(), c.j.tolist(), c.a.astype(int).tolist(), c.n.tolist(), c.y.tolist(), strict=True)) + [(None, 0, 1, 1, 1.0, 1.0), (0, 0, 1, 1, None, 1.0)]
    judges, items, loss = factor_model(spark.createDataFrame(rows, "judge int, item_i int, item_j int, a int, n double, y double"), rank)
    assert (loss - want["nll"]) / c.total < 1e-6
    b = {r.judge: r.b for r in judges.collect()}
    assert np.allclose([b[k] for k in range(c.K)], want["b"], atol=0.01)
    score = {(j.judge, i.item): j.gamma * i.mu + sum(x * y for x, y in zip(j.u, i.v, strict=True)) for j in judges.collect() for i in items.collect()}
    assert np.allclose([[score[k, i] for i in range(c.N)] for k in range(c.K)], want["S"], atol=0.03)
