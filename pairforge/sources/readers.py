"""Scans and sinks: benchmark parquet, JSONL response logs, packed responses, result lines, and a resumable append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that a prepared benchmark must have, and those it may have.
REQUIRED = ("id", "evaluation_session_id", "evaluation_order", "model_a", "model_b", "winner", "prompt", "response_a", "response_b")
OPTIONAL = ("language", "is_code", "main_category", "prompts_match")
RESPONSE = "id string, judge string, condition string, choice string, canonical_verdict string, confidence int, raw_response string, inference struct<temperature:double,max_output_tokens:int,reasoning:struct<mode:string,effort:string>>, completed_at string"


def read_benchmark(spark: SparkSession, path: str, start: int = 0, most: int | None = None) -> DataFrame:
    """Required and known optional columns only, with the order of the file; raises if a required one is missing."""
    df = spark.read.parquet(path)
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"benchmark lacks {', '.join(missing)}")
    df = df.select(*REQUIRED, *(c for c in OPTIONAL if c in df.columns), F.col("_metadata.row_index").alias("file_row")).where(F.col("file_row") >= start)
    return df if most is None else df.where(F.col("file_row") < start + most)


def read_responses(spark: SparkSession, pattern: str) -> DataFrame:
    """JSONL logs of one folder per judge; lines that don't parse are dropped; the folder's name is panel_judge."""
    df = spark.read.schema(RESPONSE).option("mode", "DROPMALFORMED").json(pattern)
    return df.withColumn("panel_judge", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)).where("id is not null")


def resume_keys(responses: DataFrame) -> DataFrame:
    return responses.where("canonical_verdict is not null").select("id", "judge", "condition").distinct()


def append_pending(jobs: DataFrame, done: DataFrame, path: str, key: list[str]) -> None:
    """Appends what isn't stored yet; running it again adds nothing."""
    jobs.join(done.select(*key), key, "left_anti").write.mode("append").json(path)


def pack_responses(responses: DataFrame, path: str) -> None:
    """zstd parquet with nested fields as JSON, a folder per judge."""
    responses.withColumn("inference", F.to_json("inference")).write.option("compression", "zstd").partitionBy("panel_judge").mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Keyed JSON lines with nested rows, flattened; NaN becomes null and an infinite weight a null with a flag."""
    rows = spark.read.schema(f"key array<string>, rows array<struct<{schema}>>").json(path).select("key", F.explode("rows").alias("r")).select("key", "r.*")
    doubles = [c for c, t in rows.dtypes if t == "double"]
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    if "lam" in doubles:
        rows = rows.withColumn("is_anchor", F.coalesce(F.col("lam") == float("inf"), F.lit(False))).withColumn("lam", F.when(F.col("lam") != float("inf"), F.col("lam")))
    return rows


def read_merged_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
