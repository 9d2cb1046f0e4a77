"""Measures of scores against true scores or against held-out comparisons; DataFrames in, one row per key out.

Scores are (keys..., item, score), comparisons (keys..., item_i, item_j, y) with y = 1 where item_i won, 0 where item_j did, and anything
else, null included, left out. Orders of items are compared by counting inversions, not pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered


def _both(true: DataFrame, est: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return true.select(*keys, "item", F.col("score").cast("double").alias("t")).join(est.select(*keys, "item", F.col("score").cast("double").alias("e")), [*keys, "item"])


def _agg(df: DataFrame, keys: tuple[str, ...], *columns: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def sign_accuracy(true: DataFrame, est: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of item pairs that both order alike; a tie matches a tie only."""
    return ordered.kendall(_both(true, est, keys), "t", "e", keys).select(*keys, F.col("agree").alias("sign_accuracy"))


def kendall(true: DataFrame, est: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tau-b."""
    return ordered.kendall(_both(true, est, keys), "t", "e", keys).select(*keys, "kendall")


def spearman(true: DataFrame, est: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return ordered.spearman(_both(true, est, keys), "t", "e", keys)


def mse(true: DataFrame, est: DataFrame, keys: tuple[str, ...] = (), align: bool = True) -> DataFrame:
    """Mean squared error; align: of centred scores, after the scale that makes it least. Estimates that are all equal can't be scaled: an error."""
    both = _both(true, est, keys)
    if not align:
        return _agg(both, keys, F.avg(F.pow(F.col("t") - F.col("e"), F.lit(2))).alias("mse"))
    v = F.var_pop("e")
    # A condition that fails raises.
    value = F.when(v * F.count("*") > 1e-12, F.var_pop("t") - F.pow(F.covar_pop("t", "e"), F.lit(2)) / v).otherwise(F.raise_error(F.lit("estimates are all equal")).cast("double"))
    return _agg(both, keys, value.alias("mse"))


def ndcg(true: DataFrame, est: DataFrame, keys: tuple[str, ...] = (), k: int | None = None) -> DataFrame:
    """Gain 2^(items below) - 1 by the true order, discounted by the estimated place; of the first k."""
    return ordered.ndcg(_both(true, est, keys), "t", "e", "item", keys, k)


def coverage(true: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of true scores inside (keys..., item, lower, upper), ends included."""
    both = true.select(*keys, "item", "score").join(intervals.select(*keys, "item", "lower", "upper"), [*keys, "item"])
    return _agg(both, keys, F.avg(F.col("score").between(F.col("lower"), F.col("upper")).cast("int")).alias("coverage"))


def _scored(rows: DataFrame, scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    side = lambda x: scores.select(*keys, F.col("item").alias(f"item_{x}"), F.col("score").alias(f"s_{x}"))
    decisive = rows.where(F.col("y").isin(0, 1)).select(*keys, "item_i", "item_j", "y")
    return decisive.join(side("i"), [*keys, "item_i"]).join(side("j"), [*keys, "item_j"])


def record_accuracy(rows: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of decisive comparisons whose winner has the larger score (equal scores: item_j is expected); null without any."""
    hit = (F.col("s_i") > F.col("s_j")).cast("int") == F.col("y").cast("int")
    return _agg(_scored(rows, scores, keys), keys, F.avg(hit.cast("int")).alias("record_accuracy"))


def log_loss(rows: DataFrame, scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean log loss of decisive comparisons."""
    d = F.when(F.col("y") == 1, F.col("s_j") - F.col("s_i")).otherwise(F.col("s_i") - F.col("s_j"))
    return _agg(_scored(rows, scores, keys), keys, F.avg(S.softplus(d)).alias("log_loss"))


def human_sign_accuracy(est: DataFrame, true: DataFrame | None = None, rows: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Against true scores where there are any, else against comparisons."""
    if (true is None) == (rows is None):
        raise ValueError("either true scores or comparisons are needed")
    if true is not None:
        return sign_accuracy(true, est, keys)
    return record_accuracy(rows, est, keys).withColumnRenamed("record_accuracy", "sign_accuracy")


def evaluate_scores(true: DataFrame, est: DataFrame, intervals: DataFrame | None = None, keys: tuple[str, ...] = (), k: int | None = None, align: bool = True) -> DataFrame:
    """All measures of scores against true ones in one row per key; coverage is null without intervals."""
    parts = [mse(true, est, keys, align), spearman(true, est, keys), ndcg(true, est, keys, k), sign_accuracy(true, est, keys), kendall(true, est, keys)]
    parts += [coverage(true, intervals, keys)] if intervals is not None else []
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys)) if keys else out.crossJoin(p)  # one row each
    return out if intervals is not None else out.withColumn("coverage", F.lit(None).cast("double"))
