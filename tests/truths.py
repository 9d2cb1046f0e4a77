"""Comparisons drawn from known parameters, for tests of the fits."""

import numpy as np

from pairforge.kernel import solver as K


def draw_params(seed: int, n: int = 6, k: int = 4) -> dict:
    """Identified parameters: mu and V centred and orthogonal with squared norm n, U centred, gamma with mean 1, b."""
    rng = np.random.default_rng([seed, 11])
    mu, v = K.basis(n) @ rng.normal(size=n - 1), K.basis(n) @ rng.normal(size=n - 1)
    mu *= np.sqrt(n) / np.linalg.norm(mu)
    v -= mu * (mu @ v) / (mu @ mu)
    v *= np.sqrt(n) / np.linalg.norm(v)
    u, gamma = rng.normal(0, 0.4, k), 1 + rng.normal(0, 0.25, k)
    return {"mu": mu, "v": v, "u": u - u.mean(), "gamma": gamma + 1 - gamma.mean(), "b": rng.uniform(0.3, 1.2, k) * np.where(rng.random(k) < 0.8, 1, -1)}


def draw_counts(p: dict, seed: int, per_cell: int) -> K.Counts:
    rng, n, k = np.random.default_rng([seed, 12]), len(p["mu"]), len(p["b"])
    cell = [(q, i, j, a) for q in range(k) for i in range(n) for j in range(i + 1, n) for a in (-1, 1)]
    q, i, j, a = (np.array(x) for x in zip(*cell, strict=True))
    s = np.outer(p["gamma"], p["mu"]) + np.outer(p["u"], p["v"])
    return K.Counts(q, i, j, a, np.full(len(q), per_cell), rng.binomial(per_cell, K.sigmoid(s[q, i] - s[q, j] + a * p["b"][q])), k, n)


def draw_human(p: dict, seed: int, n: int):  # noqa: ANN201
    rng, size = np.random.default_rng([seed, 13]), len(p["mu"])
    i, j = np.triu_indices(size, 1)
    count = rng.multinomial(n, np.full(len(i), 1 / len(i))).astype(float)
    s = 1.2 * p["mu"]
    return i, j, count, rng.binomial(count.astype(int), K.sigmoid(s[i] - s[j])).astype(float)
