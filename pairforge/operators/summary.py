"""Summaries that merge: one row per key of counts, moments, ends, the first value by an order and a sketch of quantiles.

States of parts of a table, such as files that were added since, merge to the state of the whole, in any grouping; a state's size doesn't depend on how many rows it stands
for. The sketch counts values in bins whose ends grow by (1 + e) / (1 - e), on both sides of 0, so a quantile is off by at most the share e of its value (Masson, Rim and Lee, 2019).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative error of a quantile; keeps bins of small positive values above those of zero and of negative ones.
ERROR, APART = 0.01, 1 << 20
GAMMA = (1 + ERROR) / (1 - ERROR)


def _bin(x: Column) -> Column:
    """The bin of a number, in the order of the numbers."""
    size = F.ceil(F.log(F.abs(x)) / F.lit(math.log(GAMMA))).cast("long") + APART
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _middle(b: Column) -> Column:
    size = F.lit(2 / (GAMMA + 1)) * F.exp((F.abs(b) - APART).cast("double") * math.log(GAMMA))
    return F.when(b > 0, size).when(b < 0, -size).otherwise(0.0)


def _joined(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key on both sides."""
    if not keys:
        return a.crossJoin(b)  # one row each
    other = b.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(other, on, "left").drop(*(f"_{k}" for k in keys))


def _grouped(df: DataFrame, keys: tuple[str, ...]):  # noqa: ANN202
    return df.groupBy(*keys) if keys else df.groupBy()


_BINS = "array<struct<bin:bigint,n:bigint>>"


def _binned(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """rows (keys..., bin, c) -> (keys..., bins), added up by bin before a key's bins, of which there are a few thousand at most, meet."""
    added = rows.groupBy(*keys, "bin").agg(F.sum("c").alias("n"))
    return _grouped(added, keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))


def summarize(rows: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The state (keys..., n, n_null, total, square, least, most, first, bins) of rows; nulls and NaN count as n_null alone; first is the value of the least order, of ties the least."""
    x = F.col(value).cast("double")
    rows = rows.select(*keys, F.when(~F.isnan(x), x).alias("x"), F.col(order).alias("o"))
    first = F.min(F.when(F.col("x").isNotNull(), F.struct(F.col("o").alias("order"), F.col("x").alias("value")))).alias("first")
    sums = _grouped(rows, keys).agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("n_null"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)).alias("square"), F.min("x").alias("least"), F.max("x").alias("most"), first)
    bins = _binned(rows.where("x is not null").select(*keys, _bin(F.col("x")).alias("bin"), F.lit(1).alias("c")), keys)
    return _joined(sums, bins, keys).withColumn("bins", F.coalesce("bins", F.array().cast(_BINS)))


def merge(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One state per key of several."""
    sums = _grouped(states, keys).agg(*(F.sum(c).alias(c) for c in ("n", "n_null", "total", "square")), F.min("least").alias("least"), F.max("most").alias("most"), F.min("first").alias("first"))
    bins = _binned(states.select(*keys, F.explode("bins").alias("b")).select(*keys, F.col("b.bin").alias("bin"), F.col("b.n").alias("c")), keys)
    return _joined(sums, bins, keys).withColumn("bins", F.coalesce("bins", F.array().cast(_BINS)))


def quantile(bins: Column, n: Column, q: float) -> Column:
    """The value of the bin that holds the row at floor(q * (n - 1)), within ERROR of that row's; null without rows."""
    at = F.floor(F.lit(q) * (n - 1))
    step = lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.when(a["bin"].isNull() & (a["seen"] + b["n"] > at), b["bin"]).otherwise(a["bin"]).alias("bin"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
    return F.when(n > 0, _middle(F.aggregate(bins, start, step)["bin"]))


def finish(states: DataFrame, keys: tuple[str, ...] = (), quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(keys..., n, n_null, mean, sd, se, least, most, first, q50, q90, ...) of states."""
    n, mean = F.col("n"), F.col("total") / F.col("n")
    var = F.when(n > 1, F.greatest((F.col("square") - n * mean * mean) / (n - 1), F.lit(0.0)))
    out = [F.when(n > 0, mean).alias("mean"), F.sqrt(var).alias("sd"), F.sqrt(var / n).alias("se"), "least", "most", F.col("first.value").alias("first")]
    return states.select(*keys, "n", "n_null", *out, *(quantile(F.col("bins"), n, q).alias(f"q{round(100 * q)}") for q in quantiles))
