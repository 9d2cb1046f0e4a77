"""Stored result rows of studies: a reader for files of several schemas, summaries, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What identifies a cell but its seed; measures that are averaged; names that columns had before.
KEY = ("sweep", "panel", "kind", "level", "n_H_level")
METRICS = ("excess", "logloss", "acc", "ref_kendall", "b_mean_abs", "b_inj_mean_abs", "gamma_inj_mean_abs", "lam_rel", "r_sel", "first_share", "n_L", "n_H")
OLD = {"n_H": "n_0", "n_H_level": "n_0_level"}
NOISE = ("noise", "noise_scarce")
SCHEMA = (
    "sweep string, panel string, kind string, level double, n_H_level int, n_0_level int, seed int, method string, error string, all_dropped boolean, converged boolean, lam double, human_only_exists boolean, n_at_bound int, b_at_bound int, K int, K_dropped double, n_test int, floor double, n_0 double, "
    + ", ".join(f"{m} double" for m in METRICS)
)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of any of the schemas as one: old names filled in, missing columns null, failed marked, level 0 of noise sweeps shared by all kinds.

    failed: the method raised, or no candidate of its path passed a guard. An infinite lam stays; an infinite lam_rel is null, and so is NaN anywhere.
    """
    rows = spark.read.schema(SCHEMA).json(path)
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in rows.dtypes if t == "double"})
    rows = rows.withColumns({new: F.coalesce(new, old) for new, old in OLD.items()}).drop(*OLD.values())
    rows = rows.withColumns({"n_H_level": F.coalesce("n_H_level", F.lit(-1)), "all_dropped": F.coalesce("all_dropped", F.lit(False)), "lam_rel": F.when(F.abs("lam_rel") != float("inf"), F.col("lam_rel"))})
    rows = rows.withColumn("failed", F.col("error").isNotNull() | F.col("all_dropped"))
    zero = rows.where(F.col("sweep").isin(*NOISE) & (F.col("level") == 0))
    # Kinds are few: a row for each sweep and kind.
    kinds = rows.where(F.col("sweep").isin(*NOISE)).select("sweep", F.col("kind").alias("other")).distinct()
    has = zero.select("sweep", F.col("kind").alias("other")).distinct()
    more = zero.join(kinds.join(has, ["sweep", "other"], "left_anti"), "sweep").withColumn("kind", F.col("other")).select(*rows.columns)
    return rows.unionByName(more)


def sem(c: str | Column) -> Column:
    """Standard error over what isn't null; null for fewer than two values."""
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def summary(rows: DataFrame) -> DataFrame:
    """Per cell and method, over the seeds that didn't fail: means and standard errors of all measures, the median weight, shares, and the paired difference of excess to
    human_only on the same seed; beside them how many failed. A cell and method that always failed has no row."""
    rows = rows.where(~F.col("method").isin("spectest", "planner"))
    ok, by = rows.where(~F.col("failed")), [*KEY, "method"]
    share = lambda c: F.avg(c.cast("int"))
    agg = ok.groupBy(*by).agg(
        F.count("*").alias("n"), F.min_by("K", "seed").alias("K"), F.min_by("n_test", "seed").alias("n_test"), F.avg("floor").alias("floor"),
        *(F.avg(m).alias(f"{m}_mean") for m in METRICS), *(sem(m).alias(f"{m}_se") for m in METRICS), F.percentile("lam_rel", 0.5).alias("lam_rel_med"),
        share(F.coalesce(F.abs("lam") == float("inf"), F.lit(False))).alias("lam_inf_frac"), share(F.coalesce(F.col("lam") == 0, F.lit(False))).alias("lam_zero_frac"), share(~F.coalesce("converged", F.lit(True))).alias("nonconv_frac"),
        share(F.coalesce("n_at_bound", F.lit(0)) > 0).alias("sep_frac"), share(F.coalesce("b_at_bound", F.lit(0)) > 0).alias("bsep_frac"), F.coalesce(F.avg("K_dropped"), F.lit(0.0)).alias("k_dropped_mean"),
        share(F.coalesce("human_only_exists", F.lit(True))).alias("ho_exists_frac"),
    )
    base = ok.where("method = 'human_only'").select(*KEY, "seed", F.col("excess").alias("base"))
    paired = ok.join(base, [*KEY, "seed"]).withColumn("d", F.col("excess") - F.col("base")).groupBy(*by).agg(F.avg("d").alias("d_excess_mean"), sem("d").alias("d_excess_se"))
    failed = rows.where("failed").groupBy(*by).agg(F.count("*").alias("n_failed"))
    return agg.join(paired, by, "left").join(failed, by, "left").fillna({"n_failed": 0})


def paired_summary(rows: DataFrame, first: str = "joint_mu", second: str = "consensus_cal") -> DataFrame:
    """Per cell and method: means, and differences of excess to two methods on the same seed with the standard error of the first; the share of infinite weights."""
    key = [*KEY, "seed"]
    of = lambda m, name: rows.where(F.col("method") == m).select(*key, F.col("excess").alias(name))
    d = rows.join(of(first, "one"), key, "left").join(of(second, "two"), key, "left")
    d = d.withColumns({"d1": F.col("excess") - F.col("one"), "d2": F.col("excess") - F.col("two")})
    return d.groupBy(*KEY, "method").agg(
        F.count("*").alias("seeds"), F.avg("n_H").alias("n_H"), F.avg("n_L").alias("n_L"), F.avg("excess").alias("excess"), sem("excess").alias("excess_se"), F.avg("ref_kendall").alias("tau"), sem("ref_kendall").alias("tau_se"),
        F.avg("d1").alias("delta_first"), sem("d1").alias("paired_mcse"), F.avg("d2").alias("delta_second"), F.avg(F.coalesce(F.abs("lam") == float("inf"), F.lit(False)).cast("int")).alias("infinite_share"),
    )


def diagnostics(rows: DataFrame) -> DataFrame:
    """One row of counts; null is neither converged nor not."""
    return rows.agg(F.count("*").alias("rows"), F.count("error").alias("exception_rows"), F.count_if(~F.col("converged")).alias("nonconverged_rows"), F.count_if("all_dropped").alias("all_dropped_rows"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
