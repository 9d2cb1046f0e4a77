"""Small dense fits in numpy; no Spark here.

Scores are S = gamma mu' + U V', a judge's logit of "i beats j" is S_ki - S_kj + a b_k. Fits minimise a smooth loss over
orthonormal zero-sum coordinates with a damped Gauss-Newton step and an exact gradient.
"""

from __future__ import annotations

import math

import numpy as np

#: Bounds of a factor fit's coordinates, of a calibration's, and of a fit of scores alone; scores over which a fit isn't regular, and isn't selected.
BOX, CAL_BOX, FREE_BOX = 10.0, 25.0, 30.0
MOST_REGULAR, MOST_SELECTED = 25.0, 10.0
#: Largest gradient a comparison, of coordinates that aren't held by their bound, at which a fit counts as converged.
CONVERGED, CALIBRATED = 1e-5, 1e-6


def basis(n: int) -> np.ndarray:
    """Orthonormal columns that sum to zero."""
    q, _ = np.linalg.qr(np.concatenate([np.eye(n - 1), -np.ones((1, n - 1))]))
    return q


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _free(t: np.ndarray, g: np.ndarray, bound: float) -> np.ndarray:
    """Which coordinates no bound holds: inside, or at a bound that the descent leads away from."""
    return (np.abs(t) < bound - 1e-6) | (t * g > 0)


def logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, firth: bool = False, bound: float = FREE_BOX, steps: int = 200) -> tuple[np.ndarray, float, bool]:
    """Coefficients of a binomial fit without intercept, its negative log-likelihood, and whether the gradient vanishes there (but at bounds)."""
    c, total = np.zeros(x.shape[1]), max(float(n.sum()), 1.0)

    def loss(c: np.ndarray) -> float:
        eta = x @ c + offset
        out = float(np.sum(y * np.logaddexp(0, -eta) + (n - y) * np.logaddexp(0, eta)))
        if firth:
            p = sigmoid(eta)
            out -= 0.5 * np.linalg.slogdet(x.T @ ((n * p * (1 - p))[:, None] * x) + 1e-12 * np.eye(len(c)))[1]
        return out

    def slope(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(x @ c + offset)
        w = n * p * (1 - p)
        h = x.T @ (w[:, None] * x)
        g = x.T @ (n * p - y)
        if firth:
            hat = w * np.einsum("ij,jk,ik->i", x, np.linalg.pinv(h, rcond=1e-10), x)
            g = g - 0.5 * x.T @ ((1 - 2 * p) * hat)
        return g, h

    now, damp = loss(c), 1e-9
    for _ in range(steps):
        g, h = slope(c)
        if np.abs(g[_free(c, g, bound)]).max(initial=0) < 1e-9 * total:
            break
        for _ in range(40):
            step = np.linalg.solve(h + damp * np.eye(len(c)) * max(np.trace(h), 1e-6), g)
            new = np.clip(c - step, -bound, bound)
            value = loss(new)
            if value <= now + 1e-12:
                break
            damp = max(damp * 10, 1e-8)
        else:
            break
        small = now - value < 1e-12 * max(1, abs(now))
        c, now, damp = new, value, max(damp / 10, 1e-12)
        if small:
            break
    g, _ = slope(c)
    return c, loss(c) if not firth else now, bool(np.abs(g[_free(c, g, bound)]).max(initial=0) <= CALIBRATED * total)


def differences(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[i] - w[j]


def btl(i: np.ndarray, j: np.ndarray, n: np.ndarray, y: np.ndarray, size: int, firth: bool = False) -> tuple[np.ndarray, float, bool]:
    """Centred Bradley-Terry scores."""
    b = basis(size)
    c, value, done = logistic(differences(i, j, b), n, y, firth=firth)
    return b @ c, value, done


def mle_exists(i: np.ndarray, j: np.ndarray, n: np.ndarray, y: np.ndarray, size: int) -> bool:
    """The graph of wins over all items is strongly connected."""
    reach = np.eye(size, dtype=bool)
    reach[i[y > 0], j[y > 0]] = True
    reach[j[y < n], i[y < n]] = True
    for _ in range(max(1, math.ceil(math.log2(max(size, 2))))):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    return bool(reach.all())


def isotonic(x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, k in zip(x, np.ones(len(x)) if w is None else w, strict=True):
        blocks.append([float(v), float(k), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, k2, n2 = blocks.pop()
            v1, k1, n1 = blocks.pop()
            blocks.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, n1 + n2])
    return np.concatenate([[v] * int(m) for v, _, m in blocks]) if blocks else np.empty(0)


class Counts:
    """Sparse judge counts: arrays k, i, j, a, n, y."""

    def __init__(self, k, i, j, a, n, y, n_judges: int, n_items: int) -> None:  # noqa: ANN001
        self.k, self.i, self.j = (np.asarray(v, int) for v in (k, i, j))
        self.a, self.n, self.y = (np.asarray(v, float) for v in (a, n, y))
        self.K, self.N = n_judges, n_items
        self.total = float(self.n.sum())


class Chart:
    """Free coordinates of (gamma, U, b, mu, V, alpha, a) in zero-sum bases."""

    def __init__(self, n_judges: int, n_items: int, rank: int, order: bool = True, human: int = 0) -> None:
        self.K, self.N, self.r, self.order, self.human = n_judges, n_items, rank, order, human
        self.BK, self.BN = (basis(n_judges) if n_judges > 1 else np.zeros((1, 0))), basis(n_items)
        sizes = [n_judges - 1, (n_judges - 1) * rank, n_judges if order else 0, n_items - 1, (n_items - 1) * rank, human]
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.dim = int(self.at[-1])

    def parts(self, t: np.ndarray):  # noqa: ANN201
        s = [t[a:b] for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        gamma, u = 1 + self.BK @ s[0], self.BK @ s[1].reshape(self.K - 1, self.r)
        return gamma, u, s[2] if self.order else np.zeros(self.K), self.BN @ s[3], self.BN @ s[4].reshape(self.N - 1, self.r), s[5]

    def rows(self, t: np.ndarray, c: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the judge cells, and their derivatives by the coordinates."""
        gamma, u, b, mu, v, _ = self.parts(t)
        dmu, dv = mu[c.i] - mu[c.j], v[c.i] - v[c.j]
        eta = gamma[c.k] * dmu + np.einsum("cr,cr->c", u[c.k], dv) + c.a * b[c.k]
        db = self.BN[c.i] - self.BN[c.j]
        x = np.zeros((len(c.k), self.dim))
        x[:, self.at[0] : self.at[1]] = self.BK[c.k] * dmu[:, None]
        x[:, self.at[1] : self.at[2]] = (self.BK[c.k][:, :, None] * dv[:, None, :]).reshape(len(c.k), -1)
        if self.order:
            x[np.arange(len(c.k)), self.at[2] + c.k] = c.a
        x[:, self.at[3] : self.at[4]] = gamma[c.k][:, None] * db
        x[:, self.at[4] : self.at[5]] = (db[:, :, None] * u[c.k][:, None, :]).reshape(len(c.k), -1)
        return eta, x

    def human_rows(self, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of human pairs under s = alpha mu + V a, and derivatives."""
        _, _, _, mu, v, h = self.parts(t)
        w = np.concatenate([mu[:, None], v], 1)[:, : self.human]
        d, db = w[i] - w[j], self.BN[i] - self.BN[j]
        x = np.zeros((len(i), self.dim))
        x[:, self.at[3] : self.at[4]] = h[0] * db
        if self.human > 1:
            x[:, self.at[4] : self.at[5]] = (db[:, :, None] * h[1:][None, None, :]).reshape(len(i), -1)
        x[:, self.at[5] : self.at[6]] = d
        return d @ h, x


def _minimise(t: np.ndarray, terms, steps: int = 300, tol: float = 1e-8) -> tuple[np.ndarray, float, bool]:  # noqa: ANN001
    """Levenberg-Marquardt on weighted binomial terms, functions t -> (eta, x, n, y, weight), in a box; converged by the gradient at the end."""

    def value(t: np.ndarray) -> float:
        return sum(w * float(np.sum(y * np.logaddexp(0, -e) + (n - y) * np.logaddexp(0, e))) for e, _, n, y, w in (f(t) for f in terms))

    def slope(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = np.zeros(len(t)), np.zeros((len(t), len(t)))
        for eta, x, n, y, w in (f(t) for f in terms):
            p = sigmoid(eta)
            g += w * x.T @ (n * p - y)
            h += w * x.T @ ((n * p * (1 - p))[:, None] * x)
        return g, h

    now, damp = value(t), 1e-3
    for _ in range(steps):
        g, h = slope(t)
        if np.abs(g[_free(t, g, BOX)]).max(initial=0) < tol:
            break
        for _ in range(30):
            new = np.clip(t - np.linalg.solve(h + damp * (np.diag(np.diag(h)) + 1e-9 * np.eye(len(t))), g), -BOX, BOX)
            v = value(new)
            if v <= now:
                break
            damp *= 4
        else:
            break
        small = now - v < 1e-14 * max(1, abs(now))
        t, now, damp = new, v, max(damp / 5, 1e-12)
        if small:
            break
    g, _ = slope(t)
    return t, now, bool(np.abs(g[_free(t, g, BOX)]).max(initial=0) <= CONVERGED)


#: Blocks of a chart, in the order of its coordinates.
BLOCKS = ("gamma", "U", "b", "mu", "V", "cal")


def box_activity(chart: Chart, t: np.ndarray, bound: float = BOX) -> dict:
    """Which blocks have a coordinate at its bound, how many there are in all and among b, and the largest coordinate."""
    at = np.abs(t) >= bound - 1e-6
    out: dict = {f"boundary_{name}": bool(at[a:b].any()) for name, a, b in zip(BLOCKS, chart.at[:-1], chart.at[1:], strict=True)}
    return out | {"boundary_any": bool(at.any()), "n_at_bound": int(at.sum()), "b_at_bound": int(at[chart.at[2] : chart.at[3]].sum()), "max_abs_coord": float(np.abs(t).max(initial=0))}


def start(c: Counts, rank: int, chart: Chart) -> np.ndarray:
    """Pooled scores for mu; residuals of each judge's own fit give U and V by their leading singular vectors."""
    mu, _, _ = btl(c.i, c.j, c.n, c.y, c.N, firth=True)
    t = np.zeros(chart.dim)
    if rank:
        res = np.stack([btl(c.i[c.k == k], c.j[c.k == k], c.n[c.k == k], c.y[c.k == k], c.N, firth=True)[0] - mu for k in range(c.K)])
        u, s, v = np.linalg.svd(res - res.mean(0), full_matrices=False)
        t[chart.at[1] : chart.at[2]] = (chart.BK.T @ (u[:, :rank] * np.sqrt(s[:rank]))).ravel()
        t[chart.at[4] : chart.at[5]] = (chart.BN.T @ (v[:rank].T * np.sqrt(s[:rank]))).ravel()
    t[chart.at[3] : chart.at[4]] = chart.BN.T @ mu
    return t


def reanchor(gamma: np.ndarray, u: np.ndarray, mu: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same S with mu'V = 0, V'V = N I and the first non-zero entry of each U column positive; parameters without such a form are an error."""
    if mu @ mu < 1e-8:
        raise ValueError("no anchor: mu is zero")
    if u.shape[1]:
        a = v.T @ mu / (mu @ mu)
        v, gamma = v - np.outer(mu, a), gamma + u @ a
    if abs(gamma.sum() - len(gamma)) > 1e-8 * len(gamma):
        raise ValueError("no anchor: the sensitivities don't sum to their number")
    if not u.shape[1]:
        return gamma, u, mu, v
    p, s, q = np.linalg.svd(u @ v.T, full_matrices=False)
    r, n = u.shape[1], len(mu)
    if len(s) < r or s[r - 1] < 1e-8:
        raise ValueError("no anchor: judges differ in fewer directions than the rank")
    u, v = p[:, :r] * s[:r] / np.sqrt(n), q[:r].T * np.sqrt(n)
    sign = np.array([np.sign(c[np.flatnonzero(np.abs(c) > 1e-12)[0]]) if np.abs(c).max() > 1e-12 else 1.0 for c in u.T])
    return gamma, u * sign, mu, v * sign


def structured(c: Counts, rank: int, order: bool = True) -> dict:
    """Judge fit of a given rank."""
    if not 0 <= rank <= min(c.K - 1, c.N - 2):
        raise ValueError("rank out of range")
    chart = Chart(c.K, c.N, rank, order)
    t, value, done = _minimise(start(c, rank, chart), [lambda t: (*chart.rows(t, c), c.n, c.y, 1.0 / c.total)], tol=1e-9)
    gamma, u, b, mu, v, _ = chart.parts(t)
    gamma, u, mu, v = reanchor(gamma, u, mu, v)
    return {"gamma": gamma, "U": u, "b": b, "mu": mu, "V": v, "S": np.outer(gamma, mu) + u @ v.T, "nll": value * c.total, "converged": done, "t": t, "chart": chart} | box_activity(chart, t)


def calibrate(w: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict:
    """Human fit on fixed columns w: coefficients, scores, covariance."""
    x = w[i] - w[j]
    c, value, done = logistic(x, n, y, bound=CAL_BOX)
    p = sigmoid(x @ c)
    cov = np.linalg.pinv(x.T @ ((n * p * (1 - p))[:, None] * x), rcond=1e-8)
    return {"coef": c, "s": w @ c, "cov": cov, "cov_s": w @ cov @ w.T, "nll": value, "converged": done}


def joint(c: Counts, i: np.ndarray, j: np.ndarray, n: np.ndarray, y: np.ndarray, lam: float, rank: int, align: str = "W", init: np.ndarray | None = None, order: bool = True) -> dict:
    """Minimises ell_H / n_H + lam * ell_L / n_L over judges, items and the human coefficients."""
    human = 1 + (rank if align == "W" else 0)
    chart, n_h = Chart(c.K, c.N, rank, order, human), float(n.sum())
    if init is None:
        base = structured(c, rank, order)
        w = np.concatenate([base["chart"].parts(base["t"])[3][:, None], base["chart"].parts(base["t"])[4]], 1)[:, :human]
        init = np.concatenate([base["t"], calibrate(w, i, j, n, y)["coef"]])
    terms = [lambda t: (*chart.rows(t, c), c.n, c.y, lam / c.total), lambda t: (*chart.human_rows(t, i, j), n, y, 1.0 / n_h)]
    t, value, done = _minimise(init, terms)
    gamma, u, b, mu, v, h = chart.parts(t)
    w = np.concatenate([mu[:, None], v], 1)[:, :human]
    eta = (w[i] - w[j]) @ h
    nll_h = float(np.sum(y * np.logaddexp(0, -eta) + (n - y) * np.logaddexp(0, eta)))
    return {"t": t, "chart": chart, "s": w @ h, "b": b, "gamma": gamma, "U": u, "mu": mu, "V": v, "coef": h, "W": w, "S": np.outer(gamma, mu) + u @ v.T, "criterion": value, "nll_H": nll_h, "converged": done, "lam": lam} | box_activity(chart, t)


def _hessian(terms, t: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """Central differences of the exact gradient."""

    def grad(t: np.ndarray) -> np.ndarray:
        return sum(w * x.T @ (n * sigmoid(e) - y) for e, x, n, y, w in (f(t) for f in terms))

    h = np.stack([(grad(t + d) - grad(t - d)) / 2e-5 for d in 1e-5 * np.eye(len(t))])
    return (h + h.T) / 2


def bernoulli(i, j, n, y):  # noqa: ANN001, ANN201
    """Pairs as single trials with weights: (i, j, z, count)."""
    return np.concatenate((i, i)), np.concatenate((j, j)), np.concatenate((np.ones(len(i)), np.zeros(len(i)))), np.concatenate((y, n - y))


def _trace(h: np.ndarray, x: np.ndarray, p: np.ndarray, z: np.ndarray, w: np.ndarray) -> float:
    g = x * (p - z)[:, None]
    n = w.sum()
    mean = (w[:, None] * g).sum(0) / n
    jj = ((g - mean).T * w) @ (g - mean) / n
    return float(np.trace(np.linalg.pinv(h, rcond=1e-8) @ jj))


def at_box(t: np.ndarray, bound: float) -> bool:
    """Whether a parameter lies at its bound."""
    return bool((np.abs(t) >= bound - 1e-6).any())


def gacv_joint(fit: dict, c: Counts, i, j, n, y) -> tuple[float, bool]:  # noqa: ANN001
    """Criterion of a joint fit, and whether it is regular; fit gets the reasons why it isn't (scores too large give none)."""
    chart, t, n_h = fit["chart"], fit["t"], float(n.sum())
    if n_h <= 1:
        raise ValueError("the criterion needs more than one human comparison")
    terms = [lambda t: (*chart.rows(t, c), c.n, c.y, fit["lam"] / c.total), lambda t: (*chart.human_rows(t, i, j), n, y, 1.0 / n_h)]
    h = _hessian(terms, t)
    bi, bj, z, w = bernoulli(i, j, n, y)
    eta, x = chart.human_rows(t, bi, bj)
    ev = np.linalg.eigvalsh(h)
    faults = {"not_converged": not fit["converged"], "box_active": fit["boundary_any"], "singular_hessian": int((ev <= 1e-8 * np.abs(ev).max()).sum()) > chart.r * (chart.r + 1)}
    fit["reasons"] = sorted(k for k, v in faults.items() if v)
    regular = not fit["reasons"] and np.abs(fit["s"]).max() < MOST_REGULAR
    return fit["nll_H"] / n_h + _trace(h, x, sigmoid(eta), z, w) / (n_h - 1), bool(regular)


def gacv_endpoint(w: np.ndarray, s: np.ndarray, i, j, n, y) -> tuple[float, bool]:  # noqa: ANN001
    """Criterion of a fit on fixed columns: w the columns, s the fitted scores."""
    n_h, x, eta = float(n.sum()), w[i] - w[j], s[i] - s[j]
    if n_h <= 1:
        raise ValueError("the criterion needs more than one human comparison")
    p = sigmoid(eta)
    h = x.T @ ((n * p * (1 - p))[:, None] * x) / n_h
    bi, bj, z, k = bernoulli(i, j, n, y)
    value = float(np.sum(y * np.logaddexp(0, -eta) + (n - y) * np.logaddexp(0, eta))) / n_h
    ev = np.linalg.eigvalsh(h)
    return value + _trace(h, w[bi] - w[bj], sigmoid(s[bi] - s[bj]), z, k) / (n_h - 1), bool(ev[0] > 1e-8 * ev[-1] and np.abs(s).max() < MOST_REGULAR)


def staged(base: dict, i, j, n, y, align: str = "W") -> dict:  # noqa: ANN001
    """The endpoint of infinite weight: a judges' fit, calibrated to the humans on its consensus (mu) or on all its columns (W)."""
    w = np.concatenate([base["mu"][:, None], base["V"]], 1)[:, : 1 + (base["V"].shape[1] if align == "W" else 0)]
    cal = calibrate(w, i, j, n, y)
    return base | {"lam": math.inf, "s": cal["s"], "coef": cal["coef"], "W": w, "cov_s": cal["cov_s"], "converged": base["converged"] and cal["converged"], "boundary_cal": at_box(cal["coef"], CAL_BOX)}


def select(c: Counts, i, j, n, y, rank: int, align: str = "W", multiples=(0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), order: bool = True, base: dict | None = None) -> list[dict]:  # noqa: ANN001
    """The path of candidates: the endpoint of infinite weight, the grid downwards with warm starts, and weight 0; base: a judges' fit to start from.

    Each has its fit and the sorted reasons that speak against it. Parameters of the judges' fit at their bounds don't drop the
    endpoint, those of its calibration do. Only a converged fit is the next one's start. Scores over MOST_SELECTED are never regular.
    """
    base = base or structured(c, rank, order)
    end = staged(base, i, j, n, y, align)
    g, ok = gacv_endpoint(end["W"], end["s"], i, j, n, y)
    path: list[dict] = []

    def put(lam: float, gacv: float, ok: bool, faults: dict, fit: dict) -> None:
        faults = faults | {"score_bound": not np.abs(fit["s"]).max() <= MOST_SELECTED}
        reasons = sorted(k for k, v in faults.items() if v)
        path.append({"lam": lam, "gacv": gacv, "regular": ok and not reasons, "reasons": reasons, "s": fit["s"], "fit": fit | {"lam": lam}})

    put(math.inf, g, ok, {"singular_or_score": not ok, "not_converged": not end["converged"], "box_active": end["boundary_cal"]}, end)
    w = np.concatenate([x[:, None] if x.ndim == 1 else x for x in base["chart"].parts(base["t"])[3:5]], 1)[:, : end["W"].shape[1]]
    init = np.concatenate([base["t"], calibrate(w, i, j, n, y)["coef"]])
    for m in sorted(multiples, reverse=True):
        lam = m * c.total / float(n.sum())
        fit = joint(c, i, j, n, y, lam, rank, align, init, order)
        g, ok = gacv_joint(fit, c, i, j, n, y)
        put(lam, g, ok, dict.fromkeys(fit["reasons"], True), fit)
        init = fit["t"] if fit["converged"] else init
    s, _, done = btl(i, j, n, y, c.N)
    exists = mle_exists(i, j, n, y, c.N)
    g, ok = gacv_endpoint(basis(c.N), s, i, j, n, y)
    put(0.0, g, ok, {"singular_or_score": not ok, "mle_not_exists": not exists}, {"s": s, "b": np.zeros(c.K), "converged": done})
    return path


def chosen(path: list[dict]) -> dict:
    """Least criterion among regular candidates, the first of equals; if there is none, the largest weight."""
    regular = [p for p in path if p["regular"] and math.isfinite(p["gacv"])]
    return min(regular, key=lambda p: p["gacv"]) if regular else max(path, key=lambda p: p["lam"])


def dropped(path: list[dict]) -> tuple[int, bool]:
    """How many candidates aren't regular, and whether none is: then the chosen one passed no guard."""
    n = sum(not p["regular"] for p in path)
    return n, n == len(path)


def with_margin(path: list[dict], n_h: float, c: float) -> tuple[dict, str, float | None]:
    """The endpoint of infinite weight unless the best finite weight improves the criterion by more than c / n_h; why, and the gap."""
    if n_h <= 0 or not 0 <= c < math.inf:
        raise ValueError("a margin needs human comparisons and a finite c that isn't negative")
    fit = [p for p in path if p["regular"] and math.isfinite(p["gacv"])]
    finite, end = [p for p in fit if math.isfinite(p["lam"])], next((p for p in fit if math.isinf(p["lam"])), None)
    if not fit:
        return chosen(path), "all_irregular_fallback", None
    if not finite:
        return end, "only_endpoint", None
    best = min(finite, key=lambda p: (p["gacv"], -p["lam"]))
    if end is None:
        return best, "endpoint_irregular", None
    gap = end["gacv"] - best["gacv"]
    return (end, "within_margin", gap) if gap <= c / n_h else (best, "finite_gain", gap)


def bic(c: Counts, rank: int) -> float:
    return 2 * structured(c, rank)["nll"] + (rank * (c.K + c.N - rank - 3) + c.K) * math.log(c.total)


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    out = d
    for k in range(1, 200_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * front


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def ncx2_tail(x: float, df: float, delta: float) -> float:
    """Poisson mixture of central tails: weights from the mixture's mode outwards, in logs, and tails by their recurrence in df."""
    m = delta / 2
    wide = 12 * math.sqrt(m + 1) + 40
    lo, hi = max(0, math.floor(m - wide)), math.ceil(m + wide)
    k = np.arange(lo, hi + 1)
    log_k = np.concatenate(([math.lgamma(lo + 1)], math.lgamma(lo + 1) + np.cumsum(np.log(np.arange(lo + 1, hi + 1)))))
    weight = np.exp(-m + (k * math.log(m) if m > 0 else np.where(k > 0, -np.inf, 0.0)) - log_k)
    # Q(a + 1, x) = Q(a, x) + x^a exp(-x) / gamma(a + 1).
    a, half = df / 2 + lo, x / 2
    if half <= 0:
        return float(weight.sum())
    log_g = math.lgamma(a + 1) + np.concatenate(([0.0], np.cumsum(np.log(a + np.arange(1, hi - lo)))) if hi > lo else np.zeros(0))
    more = np.exp((a + np.arange(hi - lo)) * math.log(half) - half - log_g)
    return float(weight @ np.minimum(gamma_tail(a, half) + np.concatenate(([0.0], np.cumsum(more))), 1.0))


def ncx2_interval(x: float, df: float, level: float = 0.90) -> tuple[float, float]:
    """Non-centralities that x doesn't reject, by bisection of both tails between bounds that are doubled until they hold them."""

    def solve(target: float) -> float:
        if ncx2_tail(x, df, 0.0) >= target:
            return 0.0
        lo, hi = 0.0, 10.0
        while ncx2_tail(x, df, hi) < target:
            lo, hi = hi, 2 * hi
        for _ in range(100):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            lo, hi = (mid, hi) if ncx2_tail(x, df, mid) < target else (lo, mid)
        return (lo + hi) / 2

    side = (1 - level) / 2
    return solve(side), solve(1 - side)


def _spread(eta: np.ndarray, x: np.ndarray, n: np.ndarray, y: np.ndarray, cluster: np.ndarray | None = None) -> np.ndarray:
    """Covariance of a comparison's score: of independent ones, or of sums over clusters of cells."""
    p, total = sigmoid(eta), n.sum()
    g = x.T @ (n * p - y) / total
    if cluster is None:
        return x.T @ ((y * (p - 1) ** 2 + (n - y) * p**2)[:, None] * x) / total - np.outer(g, g)
    _, at = np.unique(cluster, return_inverse=True)
    sums = np.zeros((at.max(initial=-1) + 1, x.shape[1]))
    np.add.at(sums, at, x * (n * p - y)[:, None] - np.outer(n, g))
    return sums.T @ sums / total


def pair_clusters(c: Counts) -> np.ndarray:
    """Cells of one judge and pair, in either order, are one cluster."""
    return (c.k * c.N + c.i) * c.N + c.j


def joint_sandwich(fit: dict, c: Counts, i, j, n, y, cluster: np.ndarray | None = None) -> dict:  # noqa: ANN001
    """Covariances of a joint fit's coordinates, scores s and S and position effects, from both samples' score variation."""
    chart, t, lam, n_h = fit["chart"], fit["t"], fit["lam"], float(n.sum())
    terms = [lambda t: (*chart.rows(t, c), c.n, c.y, lam / c.total), lambda t: (*chart.human_rows(t, i, j), n, y, 1.0 / n_h)]
    hess = _hessian(terms, t)
    h = np.linalg.pinv(hess, rcond=1e-9)
    meat = _spread(*chart.human_rows(t, i, j), n, y) + lam**2 * n_h / c.total * _spread(*chart.rows(t, c), c.n, c.y, cluster)
    cov = h @ meat @ h / n_h

    def targets(t: np.ndarray) -> np.ndarray:
        gamma, u, b, mu, v, coef = chart.parts(t)
        w = np.concatenate([mu[:, None], v], 1)[:, : chart.human]
        return np.concatenate([w @ coef, (np.outer(gamma, mu) + u @ v.T).ravel(), b])

    jac = np.stack([(targets(t + d) - targets(t - d)) / 2e-6 for d in 1e-6 * np.eye(len(t))], 1)
    whole, at = jac @ cov @ jac.T, c.N + c.K * c.N
    return {"cov": cov, "hessian": hess, "jac_s": jac[: c.N], "cov_s": whole[: c.N, : c.N], "cov_S": whole[c.N : at, c.N : at], "cov_b": whole[at:, at:], "n_H": n_h}


def sandwich(fit: dict, c: Counts, i, j, n, y) -> np.ndarray:  # noqa: ANN001
    """Covariance of the joint fit's coordinates."""
    return joint_sandwich(fit, c, i, j, n, y)["cov"]


def llm_sandwich(fit: dict, c: Counts, cluster: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the coordinates of a judges' fit, which must have position effects."""
    chart, t = fit["chart"], fit["t"]
    if not chart.order:
        raise ValueError("a fit with position effects is needed")
    h = np.linalg.pinv(_hessian([lambda t: (*chart.rows(t, c), c.n, c.y, 1.0 / c.total)], t), rcond=1e-9)
    return h @ _spread(*chart.rows(t, c), c.n, c.y, cluster) @ h / c.total


def contrasts(n: int) -> np.ndarray:
    """A row for each pair of items: +1 and -1."""
    i, j = np.triu_indices(n, 1)
    return np.eye(n)[i] - np.eye(n)[j]


def laplacian(s: np.ndarray, i, j, n) -> np.ndarray:  # noqa: ANN001
    """Comparison Laplacian a comparison, at scores s."""
    p, d = sigmoid(s[i] - s[j]), np.eye(len(s))[i] - np.eye(len(s))[j]
    return d.T @ ((n * p * (1 - p))[:, None] * d) / n.sum()


def bias_operator(sw: dict, lap: np.ndarray) -> np.ndarray:
    """What a joint fit keeps of a small shift of the true scores."""
    return sw["jac_s"] @ np.linalg.pinv(sw["hessian"], rcond=1e-9) @ sw["jac_s"].T @ lap


def sensitivity(rows: np.ndarray, operator: np.ndarray, lap: np.ndarray) -> np.ndarray:
    """Of each contrast the largest shift that a misaligned target of unit size can cause."""
    d = rows @ (np.eye(len(operator)) - operator)
    return np.sqrt(np.maximum(np.einsum("pi,ij,pj->p", d, np.linalg.pinv(lap, rcond=1e-9), d), 0))


def widened(s: np.ndarray, sw: dict, s_full: np.ndarray, delta_hi: float, i, j, n, z: float = 1.959964) -> dict:  # noqa: ANN001
    """Intervals of all contrasts, and those widened by what a misalignment of up to delta_hi a comparison could shift them."""
    d, lap = contrasts(len(s)), laplacian(s_full, i, j, n)
    half = z * np.sqrt(np.maximum(np.einsum("pi,ij,pj->p", d, sw["cov_s"], d), 0))
    kappa = sensitivity(d, bias_operator(sw, lap), lap)
    return {"estimate": d @ s, "half": half, "kappa": kappa, "widening": kappa * math.sqrt(2 * max(delta_hi, 0.0))}


def factor_design(fit: dict, c: Counts) -> np.ndarray:
    """Derivatives of the cells' logits by (gamma, mu, U, V, b) as they stand."""
    gamma, u, mu, v = fit["gamma"], fit["U"], fit["mu"], fit["V"]
    r, m, at = u.shape[1], len(c.k), np.arange(len(c.k))
    x = np.zeros((m, c.K + c.N + c.K * r + c.N * r + c.K))
    x[at, c.k] = mu[c.i] - mu[c.j]
    np.add.at(x, (at, c.K + c.i), gamma[c.k])
    np.add.at(x, (at, c.K + c.j), -gamma[c.k])
    for q in range(r):
        x[at, c.K + c.N + c.k * r + q] = v[c.i, q] - v[c.j, q]
        np.add.at(x, (at, c.K + c.N + c.K * r + c.i * r + q), u[c.k, q])
        np.add.at(x, (at, c.K + c.N + c.K * r + c.j * r + q), -u[c.k, q])
    x[at, x.shape[1] - c.K + c.k] = c.a
    return x


def delta_method(fit: dict, c: Counts, targets: list[tuple]) -> list[tuple[float, float]]:
    """Estimate and standard error of targets: (score_diff, k, i, j[, a]), (score_entry, k, i), (consensus_diff, i, j), (consensus_score, i), (gamma, k), (position_effect, k)."""
    gamma, u, mu, v, b = fit["gamma"], fit["U"], fit["mu"], fit["V"], fit["b"]
    x, r = factor_design(fit, c), u.shape[1]
    p = sigmoid(fit["S"][c.k, c.i] - fit["S"][c.k, c.j] + c.a * b[c.k])
    cov = np.linalg.pinv(x.T @ ((c.n / c.total * p * (1 - p))[:, None] * x), rcond=1e-8) / c.total
    out = []
    for kind, *at in targets:
        g = np.zeros(x.shape[1])
        if kind == "score_diff":
            k, i, j, a = (*at, 0.0)[:4]
            one = Counts([k], [i], [j], [a], [1], [0], c.K, c.N)
            g, value = factor_design(fit, one)[0], fit["S"][k, i] - fit["S"][k, j] + a * b[k]
        elif kind == "score_entry":
            k, i = at
            g[k], g[c.K + i] = mu[i], gamma[k]
            g[c.K + c.N + k * r : c.K + c.N + (k + 1) * r] = v[i]
            g[c.K + c.N + c.K * r + i * r : c.K + c.N + c.K * r + (i + 1) * r] = u[k]
            value = fit["S"][k, i]
        elif kind == "consensus_diff":
            g[c.K + at[0]], g[c.K + at[1]], value = 1.0, -1.0, mu[at[0]] - mu[at[1]]
        elif kind == "consensus_score":
            g[c.K + at[0]], value = 1.0, mu[at[0]]
        elif kind == "gamma":
            g[at[0]], value = 1.0, gamma[at[0]]
        elif kind == "position_effect":
            g[len(g) - c.K + at[0]], value = 1.0, b[at[0]]
        else:
            raise ValueError(f"no such target: {kind}")
        out.append((float(value), float(np.sqrt(max(g @ cov @ g, 0.0)))))
    return out


def monotone_along(order_by: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """mu made monotone along the order of other scores, centred."""
    order = np.argsort(order_by, kind="stable")
    s = np.empty(len(mu))
    s[order] = isotonic(mu[order])
    return s - s.mean()


def lr_test(w: np.ndarray, i, j, n, y) -> tuple[float, int, float]:  # noqa: ANN001
    """Twice the gain of free scores over scores in the span of w; degrees of freedom; p-value."""
    free = btl(i, j, n, y, len(w), firth=not mle_exists(i, j, n, y, len(w)))
    x = free[0][i] - free[0][j]
    value = float(np.sum(y * np.logaddexp(0, -x) + (n - y) * np.logaddexp(0, x)))
    stat, df = max(0.0, 2 * (calibrate(w, i, j, n, y)["nll"] - value)), len(w) - 1 - w.shape[1]
    return stat, df, chi2_tail(stat, df) if df else math.nan
