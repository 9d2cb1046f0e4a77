"""Splits, draws and perturbations, keyed by md5 so that they are the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _rank(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Position of each distinct key by its hash: its place among keys of the same three hash digits, and how many have smaller ones."""
    keys = df.select(key).distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("digits", F.substring("h", 1, 3))
    before = keys.groupBy("digits").agg(F.count("*").alias("own")).withColumn("before", F.sum("own").over(Window.orderBy("digits")) - F.col("own"))
    own = F.row_number().over(Window.partitionBy("digits").orderBy("h", key))
    # At most 4096 rows.
    return keys.withColumn("own_rank", own).join(F.broadcast(before.select("digits", "before")), "digits").select(key, (F.col("before") + F.col("own_rank")).alias("r"))


def split_records(df: DataFrame, share: float, seed: str, key: str = "record_id") -> DataFrame:
    """(key, test): the first round-half-even(share * n) records by hash are the test part."""
    n = df.agg(F.count_distinct(key).alias("n"))
    return _rank(df, key, seed).crossJoin(F.broadcast(n)).select(key, (F.col("r") <= F.bround(F.col("n") * share)).alias("test"))


def ranked(df: DataFrame, seed: Column | str, key: tuple[str, ...], *groups: str) -> DataFrame:
    """df with r, the place of each row by the hash of seed and key within its groups, from 1.

    Rows are numbered among those with the same three hash digits and moved up by how many have smaller digits: no group is
    sorted in one task, and what is added up are at most 4,096 counts a group.
    """
    seed = F.lit(seed) if isinstance(seed, str) else seed
    d = df.withColumn("__h", F.md5(F.concat_ws("|", seed, *(F.col(c).cast("string") for c in key)))).withColumn("__digits", F.substring("__h", 1, 3))
    along = Window.partitionBy(*groups).orderBy("__digits") if groups else Window.orderBy("__digits")
    before = d.groupBy(*groups, "__digits").agg(F.count("*").alias("__own")).withColumn("__before", F.sum("__own").over(along) - F.col("__own")).drop("__own")
    own = F.row_number().over(Window.partitionBy(*groups, "__digits").orderBy("__h", *key))
    return d.withColumn("__r", own).join(before, [*groups, "__digits"]).withColumn("r", F.col("__before") + F.col("__r")).drop("__h", "__digits", "__r", "__before")


def draw(df: DataFrame, n: int, seed: str, *key: str) -> DataFrame:
    """The n rows of smallest hash of their key (a negative n: all)."""
    return df if n < 0 else ranked(df, seed, key).where(F.col("r") <= n).drop("r")


def unit(seed: str, *parts: str) -> Column:
    return S.uniform(F.lit(seed), *(F.col(p).cast("string") for p in parts))


def thin_order(rows: DataFrame, rho: float, seed: str) -> DataFrame:
    return rows.where((F.col("a") == 1) | (unit(seed, "record_id", "k") < rho))


def inject(rows: DataFrame, kind: str, m: int, seed: str, n_judges: int, p_first: float = 0.9) -> DataFrame:
    """rows and m noise judges: anti (a real judge's verdicts turned round), position (first shown with p_first), random."""
    extra = F.explode(F.sequence(F.lit(n_judges), F.lit(n_judges + m - 1))).alias("new_k")
    if kind == "anti":
        noise = rows.select("*", extra).where(F.col("k") == (F.col("new_k") - n_judges) % n_judges).withColumn("y2", 2 - F.col("y2"))
    else:
        both = F.explode(F.array(F.lit(-1), F.lit(1))).alias("new_a")
        noise = rows.groupBy("record_id").agg(F.min("i").alias("i"), F.min("j").alias("j")).select("*", both).select("*", extra).withColumn("a", F.col("new_a"))
        u = unit(seed, "record_id", "new_k", "a")
        noise = noise.withColumn("y2", F.when(u < 0.5, 2).otherwise(0) if kind == "random" else F.when((u < p_first) == (F.col("a") == 1), 2).otherwise(0))
    return rows.select("record_id", "k", "i", "j", "y2", "a").unionByName(noise.select("record_id", F.col("new_k").alias("k"), "i", "j", "y2", "a"))


def amplify(rows: DataFrame, theta: float, seed: str) -> DataFrame:
    return rows.withColumn("y2", F.when(unit(seed, "record_id", "k", "a") < theta, F.when(F.col("a") == 1, 2).otherwise(0)).otherwise(F.col("y2")))
