"""Hard negatives of anchors by branch and bound over ball trees.

Candidates lie in blocks, each with a tree of its own; anchors come to the blocks in groups. A node knows the centre and radius of its vectors, so
query . centre - |query| * radius and query . centre + |query| * radius bound every inner product below and above; it also knows the range of its labels, as
nodes are split by label first. A search has a score window and a kth best score so far. A node is left out for the searches whose label rule its labels can't meet,
whose window lies outside its bounds, or whose current kth lies strictly above its upper bound; what is left at a leaf is scored exactly.

1. Positives: blocks of one label each; every anchor vector searches those of its own label, without a window.
2. Negatives: blocks of any labels; every anchor vector searches once for each distinct score of its positives, in the window that score opens.

Rows with equal vector and label are one candidate that stands for its k + 1 smallest ids, found with a limit per group before the shuffle; anchors with equal
vector and label are one query. Copies so neither fill a task nor meet each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, tuned
from .topk import quantised

#: Candidates of a block, searches of a group, vectors of a leaf.
CANDIDATES, SEARCHES, LEAF = 16_384, 4_096, 64


class BallTree:
    """Nodes in numbered lists; a node's vectors are order[lo:hi]. Split by label while there are several, else at the median between two far vectors."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.argsort(labels, kind="stable")
        self.vectors, self.labels = vectors[self.order].astype(np.float64), labels[self.order]
        self.lo, self.hi, self.children, centre, radius = [], [], [], [], []
        todo = [(0, len(labels), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            here = len(self.lo)
            if parent >= 0:
                self.children[parent].append(here)
            v = self.vectors[lo:hi]
            c = v.mean(0)
            far = np.sqrt(((v - c) ** 2).sum(1))
            centre.append(c)
            radius.append(far.max())
            self.lo.append(lo)
            self.hi.append(hi)
            self.children.append([])
            if hi - lo > leaf:
                todo += [(*part, here) for part in self._split(lo, hi, int(far.argmax()))]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def _split(self, lo: int, hi: int, far: int) -> list[tuple[int, int]]:
        labels = self.labels[lo:hi]
        if labels[0] != labels[-1]:
            edges = np.flatnonzero(labels[1:] != labels[:-1]) + 1
            mid = lo + int(edges[np.abs(edges - (hi - lo) // 2).argmin()])
        else:
            v = self.vectors[lo:hi]
            other = v[((v - v[far]) ** 2).sum(1).argmax()]
            mid = (lo + hi) // 2
            by = np.argpartition(v @ (other - v[far]), mid - lo)
            self.vectors[lo:hi], self.order[lo:hi] = v[by], self.order[lo:hi][by]
        return [(lo, mid), (mid, hi)]

    def bounds(self, node: int, queries: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above every inner product of the queries with the node's vectors; wider than rounding can be wrong."""
        at = queries @ self.centre[node]
        wide = norms * self.radius[node] * (1 + 1e-9) + norms * np.linalg.norm(self.centre[node]) * 1e-9 + 1
        return at - wide, at + wide


def search(tree: BallTree, exact: np.ndarray, reps: np.ndarray, queries: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates (search, candidate, score) of each search with score in [low, high] and its own label, or another; ties to smaller reps.

    exact: the candidates' vectors in their own order, in a type in which products are exact. Last comes the number of pairs that were scored.
    """
    n = len(queries)
    floats = queries.astype(np.float64)
    norms = np.linalg.norm(floats, axis=1)
    best = np.full((n, k), -np.inf)
    held = np.full((n, k), -1, np.int64)
    scored = 0
    # Nodes by the best score that any search may find there; the order changes the work, never the result.
    heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []

    def offer(node: int, who: np.ndarray) -> None:
        first, last = tree.labels[tree.lo[node]], tree.labels[tree.hi[node] - 1]
        rule = (labels[who] >= first) & (labels[who] <= last) if same else (labels[who] != first) | (first != last)
        who = who[rule]
        if len(who):
            below, above = tree.bounds(node, floats[who], norms[who])
            may = (above >= low[who]) & (below <= high[who]) & (above >= best[who, -1])
            if may.any():
                above = np.minimum(above, high[who])[may]
                heapq.heappush(heap, (-float(above.max()), node, who[may], above))

    offer(0, np.arange(n))
    while heap:
        _, node, who, above = heapq.heappop(heap)
        who = who[above >= best[who, -1]]
        if not len(who):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                offer(child, who)
            continue
        own = tree.order[tree.lo[node] : tree.hi[node]]
        score = queries[who] @ exact[own].T
        scored += score.size
        alike = labels[who][:, None] == tree.labels[tree.lo[node] : tree.hi[node]][None, :]
        fits = (alike if same else ~alike) & (score >= low[who][:, None]) & (score <= high[who][:, None]) & (score >= best[who, -1:])
        some = fits.any(1)
        who, score, fits = who[some], score[some], fits[some]
        if len(who):
            s = np.concatenate((best[who], np.where(fits, score, -np.inf)), 1)
            c = np.concatenate((held[who], np.broadcast_to(own, score.shape)), 1)
            top = np.lexsort((np.where(c < 0, 0, reps[c]), -s), axis=1)[:, :k]
            best[who], held[who] = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
    r, x = np.nonzero(best > -np.inf)
    return r, held[r, x], best[r, x], scored


def _exact(columns: list[pd.Series]) -> list[np.ndarray]:
    """The vectors as doubles where those hold every product's sum exactly, else as integers."""
    m = [np.stack(c.to_numpy()).astype(np.int64) for c in columns]
    most = [max(1.0, float(np.abs(x.astype(np.float64)).max(initial=0))) for x in m]
    return [x.astype(np.float64) for x in m] if most[0] * most[1] * m[0].shape[1] < 2**53 else m


def _searched(k: int, same: bool):  # noqa: ANN202
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"search": [], "cand": [], "score": []}).astype("int64")
        a, b = _exact([q["v"], c["v"]])
        tree = BallTree(b, c["label"].to_numpy(np.int64))
        who, cand, *_ = search(tree, b, c["rep"].to_numpy(), a, q["label"].to_numpy(np.int64), q["low"].to_numpy(np.float64), q["high"].to_numpy(np.float64), k, same)
        score = (a[who] * b[cand]).sum(1).astype(np.int64)
        return pd.DataFrame({"search": q["search"].to_numpy()[who], "cand": c["cand"].to_numpy()[cand], "score": score})

    return run


def _met(searches: DataFrame, cands: DataFrame, keys: list[str], k: int, same: bool) -> DataFrame:
    """Every search (search, v, label, low, high) meets every candidate (cand, rep, ids, v, label) of its keys in blocks: search, best: its k best (n, score, vec_id)."""

    def dealt(df: DataFrame, own: str, other: str, row: str) -> DataFrame:
        """Each row's block on its own side, once for each block of the other; fresh columns, as both sides stem from one table."""
        df = df.select(*(F.col(x).alias(x) for x in df.columns))
        df = df.withColumn(own, F.pmod(F.xxhash64(row), F.col(f"n_{own}")).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_c", "n_q")

    sizes = cands.groupBy(*keys).agg(F.ceil(F.count("*") / CANDIDATES).cast("int").alias("n_c"))
    sizes = sizes.join(searches.groupBy(*keys).agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("n_q")), keys)
    placed = lambda df, *own: dealt(df.join(sizes, keys), *own)
    q = placed(searches, "q", "c", "search").groupBy(*keys, "c", "q")
    c = placed(cands.drop("ids"), "c", "q", "cand").groupBy(*keys, "c", "q")
    found = q.cogroup(c).applyInPandas(_searched(k, same), "search long, cand long, score long")
    first = Window.partitionBy("search")
    found = found.join(cands.select("cand", "rep"), "cand").withColumn("n", F.row_number().over(first.orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k)
    ids = found.join(cands.select("cand", "ids"), "cand").select("search", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("n", F.row_number().over(first.orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k)
    return ids.groupBy("search").agg(F.array_sort(F.collect_list(F.struct("n", "score", "vec_id"))).alias("best"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, k: int = 5, k_negative: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    Components become floor(256 * x); a score is the integer inner product. An anchor's positives are its k best other rows of its label (all, if fewer). For each,
    the k_negative best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the smaller vec_id.
    Rows with a null label, a null vector or a null or non-finite component, and rows without vec_id, take no part; only vectors of one length meet. Rows
    that repeat are one row; a vec_id with several vectors or labels has a row for each, which aren't positives of each other. Other columns are ignored.
    """
    spark = vectors.sparkSession
    tuned(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("v"), is_anchor.alias("is_anchor"))
    rows = cut(rows.where("vec_id is not null and label is not null and v is not null").distinct())
    most = max(k + 1, k_negative)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))).where(F.col("n") <= most)
    cands = cut(first.groupBy("v", "label").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    cands = cands.withColumn("cand", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    asked = rows.where("is_anchor").groupBy("v", "label").agg(F.min("vec_id").alias("one"))
    queries = cut(cands.join(asked, ["v", "label"]).select(F.col("cand").alias("query"), "v", "label", "dim"))

    any_score = [F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")]
    best = cut(_met(queries.select(F.col("query").alias("search"), "v", "label", "dim", *any_score), cands, ["dim", "label"], k + 1, True).withColumnRenamed("search", "query"))
    anchors = rows.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), "v", "label").join(queries, ["v", "label"]).select("anchor_id", "query")
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("anchor_id")), 1, k)
    positives = anchors.join(best, "query").select("query", "anchor_id", F.explode(own).alias("b")).select("query", "anchor_id", F.col("b.vec_id").alias("positive_id"), F.col("b.score").alias("positive_score"))

    # 100 * score >= low * p, in whole numbers; a search has a number of its own.
    windows = best.select("query", F.explode(F.array_distinct(F.transform("best", lambda b: b["score"]))).alias("p"))
    windows = cut(windows.where(F.lit(low) * F.col("p") <= F.lit(high) * F.col("p"))).withColumn("search", F.monotonically_increasing_id())
    bound = lambda percent: F.col("p") * F.lit(percent) / F.lit(100.0)
    searches = windows.join(queries, "query").select("search", "v", "label", "dim", F.ceil(bound(low)).cast("double").alias("low"), F.floor(bound(high)).cast("double").alias("high"))
    found = _met(searches, cands, ["dim"], k_negative, False).join(windows, "search").select("query", F.col("p").alias("positive_score"), "best")
    out = positives.join(found, ["query", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.explode("best").alias("b"))
    return out.select("anchor_id", "positive_id", F.col("b.n").cast("int").alias("rank"), F.col("b.vec_id").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"))
