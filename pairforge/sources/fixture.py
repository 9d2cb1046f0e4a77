"""Comparison tables derived from the event log: records with a human label, and judgments by six simulated judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: True item scores, judge sensitivities and position effects of the simulation.
MU = {"click": -0.6, "error": -0.2, "purchase": 0.5, "signup": 0.4, "view": -0.1}
GAMMA = {0: 0.7, 1: 1.0, 2: 1.1, 3: 1.2, 4: 1.2, 5: 1.2}
B = {0: 0.0, 1: 0.3, 2: 0.6, 3: -0.4, 4: -0.4, 5: -0.4}
ALPHA = 1.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(key: Column, values: dict) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event and the user's next one, if of another type: (record_id, model_a, model_b, item_i, item_j, swapped, winner)."""
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("int")
    pairs = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model_a"), k.alias("k1"), F.lead("event_type").over(along).alias("model_b"), F.lead(k).over(along).alias("k2")).where("model_a <> model_b")
    i, j, swapped = S.canonical_pair(F.col("model_a"), F.col("model_b"))
    winner = F.when(F.abs(F.col("k1") - F.col("k2")) <= 2, "tie").when(F.col("k1") > F.col("k2"), "model_a").otherwise("model_b")
    return pairs.select(F.col("event_id").alias("record_id"), "model_a", "model_b", i.alias("item_i"), j.alias("item_j"), swapped.alias("swapped"), winner.alias("winner"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records by judge by display order, with display_order and verdict (i, j or tie)."""
    judges = F.explode(F.array(*map(F.lit, GAMMA))).alias("judge")
    orders = F.explode(F.array(F.lit(True), F.lit(False))).alias("a_first")
    d = records(spark, sf_dir).select("*", judges).select("*", orders).where((F.col("judge") != 4) | ~F.col("a_first") & (F.col("record_id") % 3 == 0) | F.col("a_first"))
    d = d.withColumn("display_order", F.when(F.col("a_first") != F.col("swapped"), 1).otherwise(-1))
    u = S.uniform28(F.col("record_id").cast("string"), F.col("judge").cast("string"), F.when(F.col("a_first"), "1").otherwise("0"))
    d = d.withColumn("u", u)
    eta = lookup(F.col("judge"), GAMMA) * (lookup(F.col("item_i"), MU) - lookup(F.col("item_j"), MU)) + F.col("display_order") * lookup(F.col("judge"), B)
    tie = (F.col("judge") == 5) & (F.col("u") % 20 < 12) | (F.col("u") % 20 == 0)
    return d.withColumn("verdict", F.when(tie, "tie").when(F.col("u") / 2.0**28 < S.sigmoid(eta), "i").otherwise("j")).drop("u")


def human_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with a human label y (1: item_i) of known sensitivity ALPHA."""
    u = S.uniform(F.col("record_id").cast("string"), F.lit("human"))
    eta = ALPHA * (lookup(F.col("item_i"), MU) - lookup(F.col("item_j"), MU))
    return records(spark, sf_dir).select("record_id", "item_i", "item_j", F.when(u < S.sigmoid(eta), 1).otherwise(0).alias("y"))
