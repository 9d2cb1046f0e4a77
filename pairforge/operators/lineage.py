"""Reliable checkpoints: what several later steps read is worked out once and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() goes to the shared folder that spark.checkpoint.dir names; without one a local master gets a temporary folder, a cluster an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that lie in one partition: a table of few rows costs small jobs.
ROWS = 250_000


def observed(df: DataFrame, **seen: Column) -> tuple[DataFrame, dict]:
    """df as a table written beside the checkpoints, with its number of rows as n and the aggregates of seen, worked out as it is written.

    For rounds: a checkpoint keeps the size that the optimizer guessed for its plan, and such guesses multiply from round to round; a table's size is known.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    told = Observation()
    df.observe(told, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in seen.items())).write.parquet(path)
    got, out = told.get, spark.read.schema(df.schema).parquet(path)
    return (out if got["n"] > ROWS else out.coalesce(1)), got


def written(df: DataFrame) -> tuple[DataFrame, int]:
    """df as such a table, and its number of rows."""
    out, got = observed(df)
    return out, got["n"]


def discard(*tables: DataFrame) -> None:
    """Deletes tables of observed() that nothing reads any more."""
    for df in tables:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            if not path.getName().startswith("table-"):
                raise ValueError(f"{folder} isn't a table of observed()")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
