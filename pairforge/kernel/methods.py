"""All methods of a study on one cell's counts, and a row of measures for each."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import numpy as np

from . import solver as K

#: The methods of a cell by name; a margin adds a row for each of its constants.
METHODS = ("human_only", "pooled_cal", "consensus_cal", "isotonic", "joint_mu", "oracle_test", "mle_mu", "joint_nopos", "staged_w", "joint_w", "mle_w", "joint_rank")
MOST_RANK = 2
#: Measures of a row, with their types; lam and lam_rel are null for the endpoint of infinite weight, which is_anchor marks.
FIELDS = {
    "method": "string", "logloss": "double", "excess": "double", "acc": "double", "ref_kendall": "double", "max_abs": "double", "lam": "double", "lam_rel": "double", "is_anchor": "boolean",
    "alpha": "double", "gacv": "double", "converged": "boolean", "n_at_bound": "int", "b_at_bound": "int", "max_abs_s": "double", "max_gamma": "double", "all_dropped": "boolean", "n_dropped": "int",
    "selected_regular": "boolean", "r_sel": "int", "b_mean_abs": "double", "b_inj_mean_abs": "double", "gamma_inj_mean": "double", "gamma_inj_mean_abs": "double", "margin_c": "double", "margin_reason": "string",
    "endpoint_gap": "double", "error": "string",
}


def kendall(a: np.ndarray, b: np.ndarray) -> float:
    """Tau-b; nan where one side has ties only."""
    up = np.triu_indices(len(a), 1)
    x, y = np.sign(a[up[0]] - a[up[1]]), np.sign(b[up[0]] - b[up[1]])
    each = math.sqrt(float(np.abs(x).sum() * np.abs(y).sum()))
    return float((x * y).sum() / each) if each else math.nan


def heldout(s: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Mean log loss of decisive comparisons, and the share whose winner has the larger score (equal scores: j is expected)."""
    d, total = s[i] - s[j], n.sum()
    if not total:
        return math.nan, math.nan
    return float(np.sum(y * np.logaddexp(0, -d) + (n - y) * np.logaddexp(0, d)) / total), float(np.where(d > 0, y, n - y).sum() / total)


def highest_rank(c: K.Counts, cap: int = 1) -> int:
    return max(0, min(cap, c.K - 1, c.N - 2))


def by_rank(c: K.Counts, pairs: tuple, ranks: Iterator[int], known: dict[int, list[dict]]) -> tuple[int, list[dict]]:
    """The rank whose selected weight has the least criterion, and its path; ranks that fail are left out."""
    best: tuple[float, int, list[dict]] | None = None
    why = "no rank"
    for r in ranks:
        try:
            path = known[r] if r in known else K.select(c, *pairs, r)
        except (ValueError, np.linalg.LinAlgError) as e:
            why = f"{type(e).__name__}: {e}"
            continue
        value = K.chosen(path)["gacv"]
        if best is None or value < best[0]:
            best = (value, r, path)
    if best is None:
        raise RuntimeError(f"no rank could be fitted: {why}")
    return best[1], best[2]


class Cell:
    """One cell: judge counts, human pairs to calibrate on, and pairs to test on; the judges' fit is shared by its methods."""

    def __init__(self, c: K.Counts, pairs: tuple, test: tuple, n_real: int | None = None, rank: int = 1, margins: tuple[float, ...] = (0.5, 1.0, 2.0)) -> None:
        self.c, self.pairs, self.test, self.n_real, self.margins = c, pairs, test, c.K if n_real is None else n_real, margins
        self.r, self.n_h = highest_rank(c, rank), float(pairs[2].sum())
        self.reference = K.btl(*test, c.N)[0] if test[2].sum() else np.full(c.N, math.nan)
        self.floor = heldout(self.reference, *test)[0]
        self._base: dict | None = None
        self._paths: dict[str, list[dict]] = {}

    @property
    def base(self) -> dict:
        self._base = self._base or K.structured(self.c, self.r)
        return self._base

    def path(self, align: str) -> list[dict]:
        if align not in self._paths:
            self._paths[align] = K.select(self.c, *self.pairs, self.r, align, base=self.base)
        return self._paths[align]

    def row(self, method: str, s: np.ndarray, lam: float | None = None, **more) -> dict:  # noqa: ANN003
        loss, acc = heldout(s, *self.test)
        finite = lam is not None and math.isfinite(lam)
        out = {"method": method, "logloss": loss, "excess": loss - self.floor, "acc": acc, "ref_kendall": kendall(self.reference, s), "max_abs": float(np.abs(s).max())}
        return out | {"lam": lam if finite else None, "lam_rel": lam * self.n_h / self.c.total if finite else None, "is_anchor": lam is not None and math.isinf(lam)} | more

    def about(self, fit: dict) -> dict:
        """Diagnostics of a fit with judges: convergence, the box, and what it says of real and injected judges."""
        out = {"converged": bool(fit["converged"])}
        if "gamma" not in fit:
            return out
        b, g, real = fit["b"], fit["gamma"], self.n_real
        out |= {"n_at_bound": fit["n_at_bound"], "b_at_bound": fit["b_at_bound"], "max_abs_s": float(np.abs(fit["S"]).max()), "max_gamma": float(np.abs(g).max()), "b_mean_abs": float(np.abs(b[:real]).mean())}
        if len(g) > real:
            out |= {"b_inj_mean_abs": float(np.abs(b[real:]).mean()), "gamma_inj_mean": float(g[real:].mean()), "gamma_inj_mean_abs": float(np.abs(g[real:]).mean())}
        return out

    def of_path(self, method: str, path: list[dict], best: dict | None = None, **more) -> dict:  # noqa: ANN003
        best = best or K.chosen(path)
        n, all_ = K.dropped(path)
        return self.row(method, best["s"], best["lam"], gacv=best["gacv"], selected_regular=best["regular"], n_dropped=n, all_dropped=all_, **self.about(best["fit"]), **more)

    def results(self, only: tuple[str, ...] = METHODS) -> Iterator[dict]:
        """A row for each method; one that fails gives its error and doesn't end the cell."""
        c, pairs = self.c, self.pairs

        def human_only() -> Iterator[dict]:
            yield self.row("human_only", K.btl(*pairs, c.N)[0], 0.0)

        def pooled_cal() -> Iterator[dict]:
            cal = K.calibrate(K.btl(c.i, c.j, c.n, c.y, c.N)[0][:, None], *pairs)
            yield self.row("pooled_cal", cal["s"], alpha=float(cal["coef"][0]))

        def consensus_cal() -> Iterator[dict]:
            fit = K.staged(self.base, *pairs, "mu")
            yield self.row("consensus_cal", fit["s"], math.inf, alpha=float(fit["coef"][0]), **self.about(fit))

        def isotonic() -> Iterator[dict]:
            yield self.row("isotonic", K.monotone_along(K.btl(*pairs, c.N)[0], self.base["mu"]))

        def joint_mu() -> Iterator[dict]:
            path = self.path("mu")
            yield self.of_path("joint_mu", path)
            for m in self.margins:
                best, why, gap = K.with_margin(path, self.n_h, m)
                yield self.of_path(f"joint_margin_{m:g}", path, best, margin_c=m, margin_reason=why, endpoint_gap=gap)

        def oracle_test() -> Iterator[dict]:
            best = min(self.path("mu"), key=lambda p: heldout(p["s"], *self.test)[0])
            yield self.row("oracle_test", best["s"], best["lam"])

        def joint_nopos() -> Iterator[dict]:
            yield self.of_path("joint_nopos", K.select(c, *pairs, self.r, "mu", order=False))

        def staged_w() -> Iterator[dict]:
            fit = K.staged(self.base, *pairs, "W")
            yield self.row("staged_w", fit["s"], math.inf, **self.about(fit))

        def joint_w() -> Iterator[dict]:
            yield self.of_path("joint_w", self.path("W"))

        def joint_rank() -> Iterator[dict]:
            r, path = by_rank(c, pairs, range(highest_rank(c, MOST_RANK) + 1), {self.r: self._paths["W"]} if "W" in self._paths else {})
            yield self.of_path("joint_rank", path, r_sel=r)

        def mle(align: str) -> Callable[[], Iterator[dict]]:
            def run() -> Iterator[dict]:
                fit = K.joint(c, *pairs, c.total / self.n_h, self.r, align)
                yield self.row(f"mle_{align.lower()}", fit["s"], fit["lam"], **self.about(fit))

            return run

        ways = {f.__name__: f for f in (human_only, pooled_cal, consensus_cal, isotonic, joint_mu, oracle_test, joint_nopos, staged_w, joint_w, joint_rank)} | {"mle_mu": mle("mu"), "mle_w": mle("W")}
        for name in METHODS:
            if name in only:
                try:
                    yield from ways[name]()
                except Exception as e:  # noqa: BLE001  a row, not a failed task
                    yield {"method": name, "error": f"{type(e).__name__}: {e}"[:4000]}

    def table(self, only: tuple[str, ...] = METHODS) -> list[dict]:
        began = time.perf_counter()
        rows = [dict.fromkeys(FIELDS) | r for r in self.results(only)]
        took = time.perf_counter() - began
        return [r | {"floor": self.floor, "r": self.r, "human_only_exists": K.mle_exists(*self.pairs, self.c.N), "seconds_cell": took} for r in rows]
