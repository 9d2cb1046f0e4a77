"""The judges' factor model by block alternation over tables: judges and items are blocks of their own, and no task sees all of either.

A judgment of judge k on items i, j shown in order a has the log odds gamma_k (mu_i - mu_j) + sum_r u_kr (v_ir - v_jr) + a b_k. Given the items, each judge's (gamma, u, b) is a
logistic model of rank + 2 coefficients; given the judges, each item's (mu, v) is one of rank + 1 beside its opponents. A round takes a step for all judges and then one for all items:
a step sums a gradient and an information matrix of fixed size per block and solves them. Items move at once, so theirs is half a step, which bounds what opponents' moves add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lineage import observed, written
from .scaling import BOUND, _solve, _sums, bradley_terry


def _terms(a: Column, b: Column, n: int) -> Column:
    return sum((a[c] * b[c] for c in range(1, n)), a[0] * b[0])


def _start(counts: DataFrame, rank: int) -> DataFrame:
    """(item, p): pooled scores, and for each factor what the judge of the next largest residual says beside them."""
    pairs = counts.groupBy("judge", "item_i", "item_j").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    pooled = bradley_terry(pairs.groupBy("item_i", "item_j").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), most=60).select("item", F.col("score").alias("mu"))
    if not rank:
        return written(pooled.select("item", F.array("mu").alias("p")))[0]
    own = bradley_terry(pairs, ("judge",), tol=1e-4, most=30).join(pooled, "item").select("judge", "item", "mu", (F.col("score") - F.col("mu")).alias("rest"))
    own, _ = written(own)
    far = own.groupBy("judge").agg(F.sum(F.col("rest") ** 2).alias("size")).orderBy(F.desc("size"), "judge").limit(rank)
    far = far.agg(F.collect_list(F.struct((-F.col("size")).alias("s"), "judge")).alias("l")).select(F.posexplode(F.array_sort("l")).alias("r", "x")).select("r", "x.judge")  # rank rows
    rest = own.join(far, "judge").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("r", "rest"))).alias("l"))
    v = lambda k: F.coalesce(F.get(F.filter("l", lambda x: x["r"] == k), F.lit(0))["rest"], F.lit(0.0))
    return written(pooled.join(rest, "item", "left").select("item", F.array("mu", *(v(k) for k in range(rank))).alias("p")))[0]


def factor_model(counts: DataFrame, rank: int = 1, tol: float = 1e-9, most: int = 200) -> tuple[DataFrame, DataFrame, float]:
    """The fit of counts (judge, item_i, item_j, a, n, y): judges (judge, gamma, u array, b), items (item, mu, v array, centred) and the negative log likelihood.

    It ends when a round lowers the mean loss by less than tol. Factors are those that the rounds lead to, not rotated to a canonical form; the scores of judge k are
    gamma_k mu + u_k . v. Coefficients stay within +-BOUND. Rows with a null take no part.
    """
    rows = counts.dropna(subset=["judge", "item_i", "item_j", "a", "n", "y"]).groupBy("judge", "item_i", "item_j", "a").agg(F.sum("n").cast("double").alias("n"), F.sum("y").cast("double").alias("y"))
    rows, seen = observed(rows, total=F.sum("n"))
    total, d = seen["total"] or 0.0, rank + 1
    items = _start(rows, rank)
    judges, _ = written(rows.select("judge").distinct().select("judge", F.array(F.lit(1.0), *[F.lit(0.0)] * (rank + 1)).alias("t")))

    def met() -> DataFrame:
        of = lambda at, name: items.select(F.col("item").alias(at), F.col("p").alias(name))
        both = rows.join(judges, "judge").join(of("item_i", "pi"), "item_i").join(of("item_j", "pj"), "item_j")
        both = both.withColumn("dx", F.array(*(F.col("pi")[c] - F.col("pj")[c] for c in range(d))))
        return both.withColumn("eta", _terms(F.col("t"), F.col("dx"), d) + F.col("a") * F.col("t")[d])

    def stepped(old: DataFrame, sums: DataFrame, key: str, name: str, share: float) -> DataFrame:
        """old with its coefficients moved by a share of the blocks' steps, no coefficient by more than 2."""
        move = sums.withColumn("step", _solve("h", "g"))
        new = F.zip_with(name, "step", lambda a, b: F.greatest(F.least(a + share * F.greatest(F.least(b, F.lit(2.0)), F.lit(-2.0)), F.lit(BOUND)), F.lit(-BOUND)))
        return old.join(move, key).select(key, new.alias(name))

    loss = F.sum(F.col("y") * S.softplus(-F.col("eta")) + (F.col("n") - F.col("y")) * S.softplus(F.col("eta")))
    before = float("inf")
    for _ in range(most):
        here = met().withColumn("x", F.concat("dx", F.array(F.col("a").cast("double"))))
        sums = _sums(here, ["judge"], d + 1).join(here.groupBy("judge").agg(loss.alias("loss")), "judge")
        sums, seen = observed(sums, loss=F.sum("loss"))
        if before - seen["loss"] <= tol * total:
            break
        before = seen["loss"]
        judges, _ = written(stepped(judges, sums, "judge", "t", 1.0))
        here = met()
        side = lambda at, sign, here=here: here.select(F.col(at).alias("item"), F.transform(F.slice("t", 1, d), lambda v: sign * v).alias("x"), "n", "y", "eta")
        items, _ = written(stepped(items, _sums(side("item_i", 1.0).union(side("item_j", -1.0)), ["item"], d), "item", "p", 0.5))
    mean = items.agg(F.array(*(F.avg(F.col("p")[c]) for c in range(d))).alias("m"))
    centred = items.crossJoin(mean).withColumn("p", F.zip_with("p", "m", lambda a, b: a - b))  # one row
    out = judges.select("judge", F.col("t")[0].alias("gamma"), F.slice("t", 2, rank).alias("u") if rank else F.array().cast("array<double>").alias("u"), F.col("t")[d].alias("b"))
    return out, centred.select("item", F.col("p")[0].alias("mu"), F.slice("p", 2, rank).alias("v") if rank else F.array().cast("array<double>").alias("v")), min(before, seen["loss"] or 0.0)
