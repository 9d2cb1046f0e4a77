"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Of each window of `window` words of a document the smallest hash of its K-word grams is kept; a document's distinct minima
are its fingerprints. An item window's fingerprint is the same function of its own words, so a shared window always meets
in a join of fingerprints. Met windows are looked for in the whole document, word by word, and their words are hits.

Texts are read where they lie: fingerprints and word counts come from the scan, and only documents that met a window, picked out by their
ids, are moved to be verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut, id_text, tuned

K = 5
#: Ids of met documents that may be broadcast to pick out their texts; beyond, a join does it.
BROADCAST_IDS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, ANY_CASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased; runs of a-z, 0-9 and non-ASCII characters."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _upto(n: Column) -> Column:
    """0 .. n - 1, or none."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def _grams(h: Column, k: int) -> Column:
    return F.transform(_upto(F.size(h) - (k - 1)), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))


def _minima(g: Column, w: int) -> Column:
    return F.transform(_upto(F.size(g) - (w - 1)), lambda i: F.least(*(F.get(g, i + j) for j in range(w))) if w > 1 else F.get(g, i))


def fingerprints(df: DataFrame, window: int, short: list[int]) -> DataFrame:
    """Adds fps: the distinct minima of windows, and all grams of the short lengths, of the column words; step by step, so that nothing is worked out twice.

    Callers use explode_outer: a plain explode would push a filter on the size of fps, with all that makes it, below every step.
    """
    k = min(K, window)
    df = df.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    df = df.withColumn("g", _grams(F.col("h"), k))
    df = df.withColumn("m", _minima(F.col("g"), window - k + 1))
    return df.withColumn("fps", F.array_distinct(F.concat("m", *(_grams(F.col("h"), n) for n in short)))).drop("h", "g", "m")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(n, win, items): distinct windows of n words; an item with fewer words than `window`, but not none, is one window."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).where("item_id is not null and size(words) > 0")
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    at = F.explode(_upto(F.size("words") - F.col("n") + 1)).alias("at")
    wins = items.select("item_id", "n", "words", at).select("item_id", "n", F.slice("words", F.col("at") + 1, F.col("n")).alias("win"))
    return wins.groupBy("n", "win").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items, starts) for each row of docs with a doc_id.

    items: sorted ids of benchmark items with a window that occurs in the document; starts: (at, n) of all occurrences, n
    words from word `at`; n_hit: words inside any. Null text has no words; a document shorter than a window can only hold
    whole short items; repeated rows are judged each; other columns are ignored; with an empty benchmark nothing is hit.
    The join leaves it to Spark to broadcast the item windows, which it does below its size threshold only. The met ids are written to the
    checkpoint folder and counted before the result is returned.
    """
    tuned(docs.sparkSession)
    docs = id_text(docs).withColumn("tag", F.xxhash64("text"))
    wins = item_windows(benchmark, window)
    # At most window - 1 lengths; most benchmarks have none.
    short = sorted(r.n for r in wins.where(F.col("n") < window).select("n").distinct().collect())
    found = fingerprints(docs.select("doc_id", "tag", words(F.col("text")).alias("words")), window, short)
    found = found.select("doc_id", "tag", F.explode_outer("fps").alias("fp")).where("fp is not null")
    whole = fingerprints(wins.where(F.col("n") == window).withColumnRenamed("win", "words"), window, []).select("n", F.col("words").alias("win"), "items", F.explode_outer("fps").alias("fp"))
    keyed = whole
    for n in short:
        one = wins.where(F.col("n") == n).withColumn("h", F.transform("win", lambda x: F.xxhash64(x)))
        keyed = keyed.union(one.select("n", "win", "items", F.get(_grams(F.col("h"), n), F.lit(0)).alias("fp")))
    met = found.join(keyed, "fp").select("doc_id", "tag", F.struct("n", "win", "items", F.xxhash64("win").alias("hash")).alias("cand"))
    met = cut(met.groupBy("doc_id", "tag").agg(F.collect_set("cand").alias("cands")))

    ids = met.select("doc_id", "tag")
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    some = docs.join(ids, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"])
    out = some.join(met, ["doc_id", "tag"]).select("doc_id", "tag", words(F.col("text")).alias("words"), "cands")
    out = out.withColumn("hashes", F.transform("cands", lambda c: c["hash"]))

    def places(n: int) -> Column:
        win = lambda i: F.slice("words", i + 1, n)
        likely = F.filter(_upto(F.size("words") - (n - 1)), lambda i: F.array_contains("hashes", F.xxhash64(win(i))))
        held = F.transform(likely, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.flatten(F.transform(F.filter("cands", lambda c: c["win"] == win(i)), lambda c: c["items"])).alias("items")))
        return F.filter(held, lambda p: F.size(p["items"]) > 0)

    out = out.withColumn("places", F.concat(*(places(n) for n in [*short, window])))
    hit = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["n"] - 1)))))
    out = out.select(
        "doc_id", "tag", hit.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: p["items"])))).alias("items"),
        F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["n"].alias("n"))).alias("starts"),
    )
    own = docs.select("doc_id", "tag", F.size(F.regexp_extract_all("text", F.lit(ANY_CASE), F.lit(0))).cast("long").alias("n_words"))
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<bigint>"), "starts": F.array().cast("array<struct<at:int,n:int>>")}
    return own.join(out, ["doc_id", "tag"], "left").select("doc_id", "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def digest(out: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
