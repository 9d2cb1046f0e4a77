"""From judgments to the canonical table, the panel (items, judges, coded rows) and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lineage import written


def canonical(judgments: DataFrame) -> DataFrame:
    """The engine's central relation; outcome and human_outcome are null for ties, anything not decisive is a judge tie."""
    human = S.side_to_item(F.col("winner"), F.col("model_a"), F.col("model_b"))
    outcome = F.when(F.col("verdict") == "i", F.col("item_i")).when(F.col("verdict") == "j", F.col("item_j"))
    first = F.when(F.col("display_order") == 1, F.col("item_i")).otherwise(F.col("item_j"))
    return judgments.select(
        "record_id", "judge", "item_i", "item_j", outcome.alias("outcome"), "display_order", human.alias("human_outcome"), "swapped",
        (outcome == first).alias("chose_first"), (~S.decisive(F.col("verdict"), "i", "j")).alias("judge_tie"), S.decisive(F.col("winner"), "model_a", "model_b").alias("human_decisive"),
    )


def tie_rate(canon: DataFrame) -> DataFrame:
    return canon.groupBy("judge").agg(F.avg(F.col("judge_tie").cast("double")).alias("tie_rate"))


def coverage(canon: DataFrame) -> DataFrame:
    """Share of all records that a judge has seen in both orders; both levels aggregate before they shuffle."""
    both = canon.groupBy("judge", "record_id").agg((F.min("display_order") != F.max("display_order")).cast("int").alias("both")).groupBy("judge").agg(F.sum("both").alias("n_both"))
    total = canon.agg(F.count_distinct("record_id").alias("n_records"))
    return both.crossJoin(F.broadcast(total)).select("judge", (F.col("n_both") / F.col("n_records")).alias("coverage"))


def panel_judges(canon: DataFrame, drop: tuple[int, ...] = (), most_ties: float = 0.5, least_coverage: float = 0.5) -> DataFrame:
    """(judge, k): kept judges with their index; both limits are strict. Tie rate and coverage come from one grouping.

    The table is written: by the optimizer's guess a cross join multiplies sizes, so that rows would be broadcast to meet a handful of judges.
    """
    seen = canon.groupBy("judge", "record_id").agg((F.min("display_order") != F.max("display_order")).cast("int").alias("both"), F.count("*").alias("n"), F.sum(F.col("judge_tie").cast("int")).alias("ties"))
    by = seen.groupBy("judge").agg(F.sum("both").alias("both"), (F.sum("ties") / F.sum("n")).alias("tie_rate"))
    kept = by.crossJoin(F.broadcast(canon.agg(F.count_distinct("record_id").alias("n_records"))))  # one row
    kept = kept.where((F.col("tie_rate") <= most_ties) & (F.col("both") / F.col("n_records") >= least_coverage))
    kept = kept.where(~F.col("judge").isin(*drop)) if drop else kept
    return written(kept.select("judge", (F.dense_rank().over(Window.orderBy("judge")) - 1).alias("k")))[0]


def item_index(canon: DataFrame) -> DataFrame:
    """(item, idx), written for the same reason."""
    items = canon.select(F.col("item_i").alias("item")).union(canon.select("item_j")).distinct()
    return written(items.select("item", (F.dense_rank().over(Window.orderBy("item")) - 1).alias("idx")))[0]


def llm_rows(canon: DataFrame, ties: str = "drop") -> DataFrame:
    """(record_id, k, i, j, y2, a): coded rows, y2 half-wins of i. The dimension tables hold a row per judge and item; Spark knows their sizes and broadcasts them below its threshold."""
    items = item_index(canon)
    rows = canon.where(~F.col("judge_tie")) if ties == "drop" else canon
    y2 = F.when(F.col("judge_tie"), 1).when(F.col("outcome") == F.col("item_i"), 2).otherwise(0)
    coded = rows.join(panel_judges(canon), "judge").join(items.select(F.col("item").alias("item_i"), F.col("idx").alias("i")), "item_i").join(items.select(F.col("item").alias("item_j"), F.col("idx").alias("j")), "item_j")
    return coded.select("record_id", "k", "i", "j", y2.alias("y2"), F.col("display_order").alias("a"))


def human_rows(canon: DataFrame, ties: str = "drop") -> DataFrame:
    """(record_id, i, j, y2): one row per record, the first by judge and display order."""
    one = first_rows(canon.select("record_id", "judge", "display_order", "item_i", "item_j", "human_outcome", "human_decisive"), ("record_id",), F.struct("judge", -F.col("display_order")))
    one = one.where("human_decisive") if ties == "drop" else one
    items = item_index(canon)
    y2 = F.when(~F.col("human_decisive"), 1).when(F.col("human_outcome") == F.col("item_i"), 2).otherwise(0)
    return one.join(items.select(F.col("item").alias("item_i"), F.col("idx").alias("i")), "item_i").join(items.select(F.col("item").alias("item_j"), F.col("idx").alias("j")), "item_j").select("record_id", "i", "j", y2.alias("y2"))


def first_rows(df: DataFrame, key: tuple[str, ...], order: Column) -> DataFrame:
    """Of each key the whole row that comes first in an order; aggregated before it is shuffled."""
    return df.groupBy(*key).agg(F.min_by(F.struct(*(c for c in df.columns if c not in key)), order).alias("__row")).select(*key, "__row.*")


def labelled_rows(rows: DataFrame, items: DataFrame, ties: tuple[str, ...]) -> DataFrame:
    """(record_id, i, j, y, a) of rows whose label is the preferred model's name or a tie; others are dropped."""
    known = rows.where(F.col("label").isin(*ties) | (F.col("label") == F.col("model_a")) | (F.col("label") == F.col("model_b")))
    y = F.when(F.col("label").isin(*ties), 0.5).when(F.col("label") == F.least("model_a", "model_b"), 1.0).otherwise(0.0)
    coded = known.select("record_id", F.least("model_a", "model_b").alias("item_i"), F.greatest("model_a", "model_b").alias("item_j"), y.alias("y"), F.when(F.col("model_a") > F.col("model_b"), -1).otherwise(1).alias("a"))
    return coded.join(items.withColumnsRenamed({"item": "item_i", "idx": "i"}), "item_i").join(items.withColumnsRenamed({"item": "item_j", "idx": "j"}), "item_j").select("record_id", "i", "j", "y", "a")


def counts(rows: DataFrame, *key: str) -> DataFrame:
    """Sufficient statistics: comparisons and half-wins by key."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("y2").cast("long").alias("y2"))


def contract_check(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("i") >= F.col("j")).alias("n_bad"), F.count_if(~F.col("y2").isin(0, 1, 2)).alias("n_bad_y"))


def drop_empty(rows: DataFrame) -> DataFrame:
    """Judges without rows go, the others are renumbered."""
    new, _ = written(rows.select("k").distinct().select("k", (F.dense_rank().over(Window.orderBy("k")) - 1).alias("new_k")))
    return rows.join(new, "k").drop("k").withColumnRenamed("new_k", "k")


#: Rows of a pair that are made at once.
CHUNK = 1000


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """One Bernoulli row per comparison: wins first, then losses; pairs with half-wins give one row with their share. Rows are made in chunks: no array grows with a pair."""
    wins, whole = F.col("y2") / 2, F.col("y2") % 2 == 0
    d = pairs.select("*", F.when(whole, F.col("n")).otherwise(F.lit(1)).alias("rows")).where("rows > 0")
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))).alias("at"))
    d = d.select("*", F.explode(F.sequence(F.col("at") * CHUNK, F.least((F.col("at") + 1) * CHUNK, "rows") - 1)).alias("pos"))
    return d.select("i", "j", F.col("pos").cast("int").alias("pos"), F.when(whole, (F.col("pos") < wins).cast("double")).otherwise(F.col("y2") / (2.0 * F.col("n"))).alias("z"))
