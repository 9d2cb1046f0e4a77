"""Exact top-k inner products in three phases with a uniform threshold.

The dimensions of a vector fall into LISTS equal parts; a part of the inner product is a local score, so each query has as
many score lists as parts, spread over blocks of candidates.

1. Each block sends every query's k best candidates of each list (with their whole scores) and each list's least value.
   The k-th best whole score found so far is a lower bound of the true k-th best.
2. The bound goes back to all blocks. With local scores counted from the least value of their list, a candidate whose
   local scores all lie below (bound - sum of least values) / LISTS can't reach it; all others are collected.
3. Whole scores of what was collected are worked out exactly and what falls below the bound goes.

Equal vectors are one candidate that stands for its k + 1 smallest ids, found with a limit per group before the shuffle,
and equal query vectors are one query, so copies neither fill a task nor meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, tuned

LISTS, CANDIDATES, QUERIES = 2, 16_384, 4_096
_INNER_Q, _INNER_C = 256, 4_096


def quantised(vector: Column) -> Column:
    """floor(256 * x), x as double; null unless all are finite."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vector, lambda v: F.floor(v.cast("double") * 256).cast("long")))


def _matrix(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.int64)
    # Doubles hold these sums exactly, and their products are fast; else stay with integers.
    return m.astype(np.float64) if m.size == 0 or float(np.abs(m).max()) ** 2 * m.shape[1] < 2**53 else m


def _blocks(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Local scores of slices: first query, first candidate, a matrix for each list."""
    if q.empty or c.empty:
        return
    a, b = _matrix(q["v"]), _matrix(c["v"])
    if a.dtype != b.dtype or a.dtype == np.float64 and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= 2**53:
        a, b = a.astype(np.int64), b.astype(np.int64)
    cuts = np.linspace(0, a.shape[1], LISTS + 1).astype(int)
    for i in range(0, len(a), _INNER_Q):
        for j in range(0, len(b), _INNER_C):
            yield i, j, [a[i : i + _INNER_Q, lo:hi] @ b[j : j + _INNER_C, lo:hi].T for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _gather(k: int):  # noqa: ANN202
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], c["rep"].to_numpy()
        n = len(q)
        least = np.full((n, LISTS), np.inf)
        top: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        for i, j, lists in _blocks(q, c):
            whole = sum(lists)
            for n_list, s in enumerate(lists):
                least[i : i + len(s), n_list] = np.minimum(least[i : i + len(s), n_list], s.min(1))
                best = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                for r in range(len(s)):
                    top[i + r].append((ids[j + best[r]], whole[r, best[r]]))
        for r in range(n if len(c) else 0):
            cand, score = np.concatenate([x[0] for x in top[r]]), np.concatenate([x[1] for x in top[r]])
            cand, at = np.unique(cand, return_index=True)
            keep = np.argsort(-score[at], kind="stable")[:k]
            out.append((q["rep"].iloc[r], [int(x) for x in score[at][keep]], cand[keep].tolist(), [int(x) for x in least[r]]))
        return pd.DataFrame(out, columns=["query", "scores", "reps", "least"])

    return run


def _collect(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    out, ids = [], c["rep"].to_numpy()
    if len(q) and len(c):
        bound, least = q["bound"].to_numpy(np.float64), np.stack(q["least"].to_numpy()).astype(np.float64)
        queries, exact = q["rep"].to_numpy(), q["bound"].to_numpy(np.int64)
        uniform = (bound - least.sum(1)) / LISTS
        for i, j, lists in _blocks(q, c):
            rows = slice(i, i + len(lists[0]))
            may = np.zeros(lists[0].shape, bool)
            for n_list, s in enumerate(lists):
                # One less than the threshold makes up for the division's rounding; too many entries do no harm.
                may |= s - least[rows, n_list][:, None] >= uniform[rows][:, None] - 1
            r, x = np.nonzero(may)
            score = sum(s[r, x] for s in lists)
            held = score >= exact[rows][r]
            out.append(pd.DataFrame({"query": queries[rows][r[held]], "cand": ids[j + x[held]], "score": score[held].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "cand": [], "score": []}).astype("int64")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by integer inner product.

    vectors: vec_id, embedding. Components become floor(256 * x). Ties go to the smaller vec_id; a query with fewer others
    gets all of them. Vectors that are null or hold a null or non-finite component, and rows without vec_id, take no part;
    only vectors of one length meet. Rows that repeat a vec_id with the same vector are one row; other columns are ignored.
    """
    spark = vectors.sparkSession
    tuned(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"), is_query.alias("is_query")).where("vec_id is not null and v is not null")
    rows = cut(rows.distinct())
    # The k + 1 smallest ids of each vector: enough, also if one of them is the query itself.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    cands = first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    cands = cut(cands.withColumn("dim", F.size("v")))
    asked = rows.where("is_query").groupBy("v").agg(F.min("vec_id").alias("one"))
    queries = cut(cands.join(asked, "v").select("rep", "v", "dim"))
    n_c, n_q = cands.count(), queries.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-n_c // CANDIDATES), 1)
    groups = max(1, -(-n_q // QUERIES))

    def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """Each row's own block, once for each of the other side's; fresh columns, as both sides stem from one table."""
        return df.select(*(F.col(x).alias(x) for x in df.columns)).withColumn(own, F.pmod(F.xxhash64("rep"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    placed = spread(cands.select("rep", "v", "dim"), "c", blocks, "q", groups)
    key = ["dim", "c", "q"]
    got = spread(queries, "q", groups, "c", blocks).groupBy(*key).cogroup(placed.groupBy(*key)).applyInPandas(_gather(k + 1), "query long, scores array<long>, reps array<long>, least array<long>")
    # Phase 1 at the coordinator: copies count as often as they have ids, up to k + 1.
    least = got.groupBy("query").agg(F.array(*(F.min(F.col("least")[n]) for n in range(LISTS))).alias("least"))
    entries = got.select("query", F.explode(F.arrays_zip("scores", "reps")).alias("e")).select("query", F.col("e.reps").alias("rep"), F.col("e.scores").alias("score")).distinct()
    entries = entries.join(cands.select("rep", F.size("ids").alias("n")), "rep")
    ahead = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("score"), "rep").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bound = entries.withColumn("ahead", ahead).groupBy("query").agg(F.coalesce(F.max(F.when(F.col("ahead") >= k + 1, F.col("score"))), F.lit(-(2**62))).alias("bound"))
    known = queries.join(least.join(bound, "query"), F.col("rep") == F.col("query")).select("rep", "v", "dim", "least", "bound")
    held = spread(known, "q", groups, "c", blocks).groupBy(*key).cogroup(placed.groupBy(*key)).applyInPandas(_collect, "query long, cand long, score long")
    best = held.join(cands.select(F.col("rep").alias("cand"), "ids"), "cand").select("query", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    best = best.groupBy("query").agg(F.collect_list(F.struct("n", "score", "vec_id")).alias("best"))
    # Every query row of a vector takes the list of its vector, without itself.
    mine = rows.where("is_query").select("vec_id", "v").join(cands.select("v", F.col("rep").alias("query")), "v").select(F.col("vec_id").alias("query_id"), "query")
    others = F.array_sort(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")))
    out = mine.join(best, "query").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
