"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing; each stage over all that the one before kept.

Every stage takes a table with doc_id and text, and whatever other columns there are; nulls in any of them do no harm. A row is what is judged, by its own
text: rows that repeat a doc_id with different texts, and rows without doc_id, are told apart. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import decontaminate, secrets, toxicity
from pairforge.llm.base import cut, table
from pairforge.llm.jaccard import ngram_jaccard_components
from pairforge.llm.packing import pack_documents


def _free_name(docs: DataFrame) -> str:
    name = "__row"
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a number for each row, the column's name, and whether doc_ids repeat or are missing.

    As a rule the number is the doc_id. Rows whose doc_id repeats or is missing get a hash of it and their text, so that only rows equal in both
    share one. Whether there are any is found from the ids alone.
    """
    key = _free_name(docs)
    own = F.col("doc_id").cast("long")
    odd = docs.groupBy(own.alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"))
    odd = cut(odd)
    if not odd.take(1):
        return docs.withColumn(key, own), key, False
    mark = odd.select(F.col("id").alias(f"{key}id"), F.col("none").alias(f"{key}none"), F.lit(True).alias(f"{key}odd"))
    on = (F.coalesce(own, F.lit(0)) == F.col(f"{key}id")) & (own.isNull() == F.col(f"{key}none"))
    joined = docs.join(mark, on, "left").withColumn(key, F.when(F.col(f"{key}odd"), F.xxhash64(own, F.coalesce(F.col("text").cast("string"), F.lit("")))).otherwise(own))
    return joined.drop(f"{key}id", f"{key}none", f"{key}odd"), key, True


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels whose crc32(doc_id) mod 5 is not 0, in the documents of sf_dir.

    Null and empty texts have the score of no words; rows that repeat stay or go together; without labels of both classes all stay.
    """
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return toxicity.reject_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 over five-word shingles, in whatever number of steps, the one with the smallest doc_id stays; a row without id only if all are.

    Rows with the same doc_id, or none, and the same text are one row, and the one whose columns have the least hash stays. Null, empty and blank
    texts are similar to nothing; texts with fewer than five words are compared whole.
    """
    keyed, key, odd = _keyed(docs)
    found = ngram_jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    if not odd:
        kept = found.where("component_id = doc_id").select(F.col("doc_id").alias(key))
        return keyed.join(kept, key, "left_semi").select(*docs.columns)
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").cast("long").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("first")
    kept = found.select(F.col("doc_id").alias("k"), "component_id").distinct().join(ids, "k").groupBy("component_id").agg(first).select(F.col("first.k").alias(key))
    rows = cut(keyed.join(kept, key, "left_semi"))
    again = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    # The order is that of a hash of the whole row, as maps can't be compared; rows with equal hashes are equal.
    order = F.struct(F.xxhash64(F.to_json(F.struct(*docs.columns))), F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    one = rows.join(again, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), order).alias("r")).select("r.*")
    return rows.join(again, key, "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text a window of ten words of a benchmark item, or a whole shorter item, occurs go; rows that repeat go or stay together, null texts stay."""
    keyed, key, _ = _keyed(docs)
    # Written first: a filter on n_hit would be pushed below the steps that make it, and each would be worked out again and again.
    found = cut(decontaminate.decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), window=10).select("doc_id", "n_hit"))
    return keyed.join(found.where("n_hit > 0").select(F.col("doc_id").alias(key)), key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; the secrets in its text are replaced, and n_chars, where there is such a column, follows; a null text stays null and keeps its n_chars."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of pack_documents over all rows with a doc_id: null and empty texts have their end id alone, rows that repeat are packed each."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
