"""Fits of paired comparisons as Spark jobs: Bradley-Terry scores by message passing, existence by components, Laplacian systems by conjugate gradients, and logistic
models of few coefficients per block by normal equations.

Tables: pairs (keys..., item_i, item_j, n, y), where y of n comparisons were won by item_i (a tie is half a win). A cell is what the keys say; all cells are fitted at once,
and no step gathers a cell, or the items of a cell, in one task: a step joins scores to edges, sums by item and writes what it has. Keys may not be named like the columns here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import scalars as S
from .graph import strongly_connected
from .lineage import ROWS, cut, discard, observed, written

#: Scores are kept within this distance of their cell's mean, as the best scores of a separated cell are infinite.
BOUND = 30.0


def sides(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each pair from both sides: (keys..., s, o, n, w), w of n won by s."""
    i, j, n, y = F.col("item_i"), F.col("item_j"), F.col("n").cast("double"), F.col("y").cast("double")
    end = lambda a, b, w: F.struct(a.alias("s"), b.alias("o"), n.alias("n"), w.alias("w"))
    both = pairs.select(*keys, F.inline(F.array(end(i, j, y), end(j, i, n - y))))  # in one reading of pairs
    return both.where("n > 0 and s <> o").groupBy(*keys, "s", "o").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def _on(keys: tuple[str, ...], *more: str) -> list[str]:
    return [*keys, *more]


def bradley_terry(pairs: DataFrame, keys: tuple[str, ...] = (), tol: float = 1e-8, most: int = 200) -> DataFrame:
    """(keys..., item, score, converged): maximum-likelihood scores of each cell's items, centred on 0.

    Minorise-maximise steps, log of wins over the sum of n / (p + p') that an item's edges send it, three to a round: two give a cell's step length (SQUAREM), the third
    makes good for its overshoot. A cell has converged when no score moves by more than tol in a step. Scores of a cell without a maximum (see mle_exists) run
    off and end at +-BOUND, not converged; items that nothing compares, even indirectly, are centred all the same. Nulls: pairs with a null item or count take no part.
    """
    edges, n = written(sides(pairs.dropna(subset=[*keys, "item_i", "item_j", "n", "y"]), keys))
    wins = edges.groupBy(*keys, "s").agg(F.sum("w").alias("wins")).withColumnRenamed("s", "item")
    state, _ = written(wins.withColumns({"t": F.lit(0.0), "moved": F.lit(float("inf"))}))
    if n > ROWS:
        table, edges = edges, cut(edges.select(*keys, "s", "o", "n").repartition(*_on(keys, "o")))
        discard(table)

    def moved(now: DataFrame, at: str, to: str) -> DataFrame:
        """now with a further column: the scores after a step from column at."""
        p = lambda c, name: now.select(*keys, F.col("item").alias(c), F.exp(at).alias(name))
        # Edges lie by o; what they bring moves to s once, and is summed there.
        sent = edges.join(p("o", "po"), _on(keys, "o")).select(*keys, "s", "n", "po").join(p("s", "ps"), _on(keys, "s")).groupBy(*keys, "s").agg(F.sum(F.col("n") / (F.col("ps") + F.col("po"))).alias("d"))
        new = F.greatest(F.least(F.log(F.greatest("wins", F.lit(1e-300))) - F.log("d"), F.lit(BOUND)), F.lit(-BOUND))
        return now.join(sent.withColumnRenamed("s", "item"), _on(keys, "item")).withColumn(to, new).drop("d")

    for _ in range(max(1, most // 3)):
        two = moved(moved(state, "t", "t1"), "t1", "t2")
        two = two.withColumns({"r": F.col("t1") - F.col("t"), "v": F.col("t2") - 2 * F.col("t1") + F.col("t")})
        two, _ = written(two)
        read = two, state  # by the next state alone
        norms = two.groupBy(*keys) if keys else two.groupBy()
        length = norms.agg((F.sqrt(F.sum(F.col("r") ** 2)) / F.sqrt(F.sum(F.col("v") ** 2) + 1e-300)).alias("a"))
        length = length.withColumn("a", F.greatest(F.least(F.col("a"), F.lit(64.0)), F.lit(1.0)))
        two = two.join(length, list(keys)) if keys else two.crossJoin(length)  # one row
        far = two.select(*keys, "item", "wins", (F.col("t") + 2 * F.col("a") * F.col("r") + F.col("a") ** 2 * F.col("v")).alias("u"))
        far = far.withColumn("u", F.greatest(F.least("u", F.lit(BOUND)), F.lit(-BOUND)))
        state, seen = observed(moved(far, "u", "t").withColumn("moved", F.abs(F.col("t") - F.col("u"))).drop("u"), worst=F.max("moved"))
        discard(*read)
        if (seen["worst"] or 0.0) <= tol:
            break
    mean = (state.groupBy(*keys) if keys else state.groupBy()).agg(F.avg("t").alias("m"), (F.max("moved") <= tol).alias("converged"))
    out = state.join(mean, list(keys)) if keys else state.crossJoin(mean)  # one row
    return out.select(*keys, "item", (F.col("t") - F.col("m")).alias("score"), "converged")


def mle_exists(pairs: DataFrame, items: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., mle_exists) for each cell of items (keys..., item): whether its comparisons determine finite scores of all of them.

    They do if and only if the graph from winners to losers is strongly connected on the items; a tie counts for both. A cell of one item has scores.
    """
    nodes = cut(items.select(*keys, "item").distinct().coalesce(1)).withColumn("node", F.monotonically_increasing_id())
    won = sides(pairs, keys).where("w > 0")
    of = lambda c, name: nodes.select(*keys, F.col("item").alias(c), F.col("node").alias(name))
    edges = won.join(of("s", "a"), _on(keys, "s")).join(of("o", "b"), _on(keys, "o")).select("a", "b")
    comps = nodes.join(strongly_connected(edges, nodes.select("node")), "node")
    return (comps.groupBy(*keys) if keys else comps.groupBy()).agg((F.min("comp") == F.max("comp")).alias("mle_exists"))


def weighted(pairs: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The edges (keys..., s, o, w) of the information matrix at the scores (keys..., item, score): w = n p (1 - p), from both sides."""
    of = lambda c, name: scores.select(*keys, F.col("item").alias(c), F.col("score").alias(name))
    p = S.sigmoid(F.col("x") - F.col("z"))
    return sides(pairs, keys).join(of("s", "x"), _on(keys, "s")).join(of("o", "z"), _on(keys, "o")).select(*keys, "s", "o", (F.col("n") * p * (1 - p)).alias("w"))


def laplacian_solve(edges: DataFrame, targets: DataFrame, keys: tuple[str, ...] = (), tol: float = 1e-10, most: int = 1000) -> DataFrame:
    """(keys..., target, item, b, x): the centred solution x of L x = b for the Laplacian of edges (keys..., s, o, w), both sides given, and targets (keys..., target, item, b).

    Conjugate gradients with the diagonal as preconditioner, for all targets and cells at once. A target's b is made to sum to 0; items that it doesn't name have 0. It is
    solved when the residual is below tol of b, and stops taking part. The items of a target must be connected.
    """
    edges, n = written(edges.where("w > 0"))
    diagonal = edges.groupBy(*keys, "s").agg(F.sum("w").alias("d")).withColumnRenamed("s", "item")
    of = _on(keys, "target")
    every = targets.select(*of).distinct()
    rows = (every.join(diagonal, list(keys)) if keys else every.crossJoin(diagonal)).join(targets, _on(keys, "target", "item"), "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    mean = rows.groupBy(*of).agg(F.avg("b").alias("m"), F.sqrt(F.sum(F.col("b") ** 2)).alias("size"))
    rows = rows.join(mean, of).withColumn("b", F.col("b") - F.col("m"))
    start = rows.select(*of, "item", "d", "b", "size", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("d")).alias("p"))
    start, _ = written(start.withColumn("rz", F.col("r") ** 2 / F.col("d")))
    rz = start.groupBy(*of).agg(F.sum("rz").alias("rz"))
    state, _ = written(start.drop("rz").join(rz, of))
    discard(start)
    if n > ROWS:
        table, edges = edges, cut(edges.repartition(*_on(keys, "o")))
        discard(table)
    done, read = None, [state]  # read: tables by the next state alone
    for _ in range(most):
        sent = edges.join(state.select(*of, F.col("item").alias("o"), F.col("p").alias("po")), _on(keys, "o")).groupBy(*of, "s").agg(F.sum(F.col("w") * F.col("po")).alias("sent"))
        state = state.join(sent.withColumnRenamed("s", "item"), _on(keys, "target", "item"), "left").withColumn("q", F.col("d") * F.col("p") - F.coalesce("sent", F.lit(0.0))).drop("sent")
        if n > ROWS:  # read twice below
            state, _ = written(state)
            read.append(state)
        step = state.groupBy(*of).agg((F.first("rz") / F.sum(F.col("p") * F.col("q"))).alias("a"))
        state = state.join(step, of).withColumns({"x": F.col("x") + F.col("a") * F.col("p"), "r": F.col("r") - F.col("a") * F.col("q")}).drop("a", "q")
        if n > ROWS:
            state, _ = written(state)
            read.append(state)
        sums = state.groupBy(*of).agg(F.sum(F.col("r") ** 2 / F.col("d")).alias("new"), (F.sum(F.col("r") ** 2) <= (tol * F.first("size")) ** 2).alias("over"))
        state, seen = observed(state.join(sums, of).withColumn("p", F.col("r") / F.col("d") + F.col("new") / F.col("rz") * F.col("p")).withColumn("rz", F.col("new")).drop("new"), left=F.count_if(~F.col("over")))
        discard(*read)
        read = [state]
        if seen["left"] < seen["n"]:
            read = []  # the results are read from it
            over = state.where("over").drop("over")
            done = over if done is None else done.union(over)
        state = state.where("not over").drop("over")
        if not seen["left"]:
            break
    out = state if done is None else done.unionByName(state)
    mean = out.groupBy(*of).agg(F.avg("x").alias("m"))
    return out.join(mean, of).select(*of, "item", "b", (F.col("x") - F.col("m")).alias("x"))


def contrast_intervals(pairs: DataFrame, scores: DataFrame, contrasts: DataFrame, keys: tuple[str, ...] = (), z: float = 1.959963984540054) -> DataFrame:
    """(keys..., target, estimate, se, lower, upper) of contrasts (keys..., target, item, b): sums of b times score, with the information matrix at the scores."""
    solved = laplacian_solve(weighted(pairs, scores, keys), contrasts, keys)
    var = solved.groupBy(*keys, "target").agg(F.sum(F.col("b") * F.col("x")).alias("var"))
    value = contrasts.join(scores, _on(keys, "item")).groupBy(*keys, "target").agg(F.sum(F.col("b") * F.col("score")).alias("estimate"))
    out = value.join(var, _on(keys, "target")).withColumn("se", F.sqrt(F.greatest("var", F.lit(0.0)))).drop("var")
    return out.withColumns({"lower": F.col("estimate") - z * F.col("se"), "upper": F.col("estimate") + z * F.col("se")})


# -- logistic models of few coefficients -----------------------------------------------------------------------------------


def _sums(rows: DataFrame, by: list[str], d: int) -> DataFrame:
    """(by..., g, h): gradient and information of the log likelihood, as sums of fixed size; rows (by..., x array<double>, n, y, eta)."""
    p = S.sigmoid(F.col("eta"))
    x = [F.col("x")[k] for k in range(d)]
    w = F.col("n") * p * (1 - p)
    g = F.array(*(F.sum(v * (F.col("y") - F.col("n") * p)) for v in x))
    h = F.array(*(F.sum(a * b * w) for a in x for b in x))
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(g.alias("g"), h.alias("h"))


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(h: pd.Series, g: pd.Series) -> pd.Series:
    """The step of each block; a matrix without an inverse gives the least one."""
    return pd.Series([np.linalg.lstsq(np.reshape(a, (len(b), len(b))), np.asarray(b), rcond=1e-12)[0].tolist() for a, b in zip(h, g, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def _inverse(h: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.pinv(np.reshape(a, (round(len(a) ** 0.5),) * 2), rcond=1e-12, hermitian=True).ravel().tolist() for a in h])


def _dot(a: Column, b: Column, d: int) -> Column:
    return sum((a[k] * b[k] for k in range(1, d)), a[0] * b[0])


def logistic_blocks(rows: DataFrame, d: int, by: tuple[str, ...] = (), bound: float = BOUND, tol: float = 1e-9, most: int = 40) -> DataFrame:
    """(by..., coef, cov, nll) of each block's logistic model: rows (by..., x array<double> of d, n, y[, offset]).

    Newton steps for all blocks at once: a step sums d + d * d numbers per block and solves each block's equations; no block's rows meet in a task. Steps are
    cut to length 4 and coefficients to bound, so that blocks without a maximum end there. cov is the inverse information, row by row.
    """
    rows = rows if "offset" in rows.columns else rows.withColumn("offset", F.lit(0.0))
    rows, _ = written(rows.select(*by, "x", F.col("n").cast("double").alias("n"), F.col("y").cast("double").alias("y"), F.col("offset").cast("double").alias("offset")))
    coef, _ = written(rows.select(*by).distinct().withColumn("coef", F.array(*[F.lit(0.0)] * d))) if by else (rows.sparkSession.range(1).select(F.array(*[F.lit(0.0)] * d).alias("coef")), 1)

    def at(coef: DataFrame) -> DataFrame:
        joined = rows.join(coef, list(by)) if by else rows.crossJoin(coef)  # one row
        return joined.withColumn("eta", F.col("offset") + _dot(F.col("x"), F.col("coef"), d))

    for _ in range(most):
        sums = _sums(at(coef), list(by), d)
        length = F.sqrt(F.aggregate("step", F.lit(0.0), lambda a, v: a + v * v))
        step = sums.withColumn("step", _solve("h", "g")).withColumn("step", F.transform("step", lambda v: v / F.greatest(F.lit(1.0), length / 4.0)))
        new = F.zip_with("coef", "step", lambda a, b: F.greatest(F.least(a + b, F.lit(bound)), F.lit(-bound)))
        moved = (coef.join(step, list(by)) if by else coef.crossJoin(step)).select(*by, new.alias("new"), "coef")
        far = F.array_max(F.zip_with("new", "coef", lambda a, b: F.abs(a - b)))
        coef, seen = observed(moved.withColumn("far", far).select(*by, F.col("new").alias("coef"), "far"), worst=F.max("far"))
        coef = coef.drop("far")
        if (seen["worst"] or 0.0) <= tol:
            break
    here = at(coef)
    nll = F.sum(F.col("y") * S.softplus(-F.col("eta")) + (F.col("n") - F.col("y")) * S.softplus(F.col("eta"))).alias("nll")
    last = _sums(here, list(by), d).withColumn("cov", _inverse("h")).select(*by, "cov")
    value = (here.groupBy(*by) if by else here.groupBy()).agg(nll)
    if by:
        return coef.join(last, list(by)).join(value, list(by))
    return coef.crossJoin(last).crossJoin(value)  # one row each
