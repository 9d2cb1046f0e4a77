"""What depends on a global order, without one task that sees all of it: places and running sums, ranks, inversions, isotonic fits and greedy chunks.

Rows are dealt by ranges of (keys, order), sorted and written; a place is the row's place in its range after all rows of its key in earlier ranges, and a running sum
likewise. Everything else asks for places first and then works on blocks of places, which have a bounded number of rows whatever the keys hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, written

#: Rows of a block that one task works on.
BLOCK = 100_000


def running(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with idx, their place from 0 in their key by order, size, the rows of the key, and for each of sums before_<name>, its sum over earlier rows.

    Keys must not be null. Rows equal in order are placed in some order, which is fixed once.
    """
    by = [*keys, *order]
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by) if by else rows)
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    inner = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({f"_{c}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums}) if sums else placed
    spans = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *(F.sum(c).alias(f"_all_{c}") for c in sums))
    group = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    before = lambda c: F.coalesce(F.sum(c).over(group), F.lit(0))
    spans = spans.select(*keys, "_part", (before("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(*keys)).alias("size"), *(before(f"_all_{c}").alias(f"_before_{c}") for c in sums))
    out = placed.join(spans, [*keys, "_part"])
    return out.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "size", *((F.col(f"_{c}") + F.col(f"_before_{c}")).alias(f"before_{c}") for c in sums))


def _agg(df: DataFrame, keys: tuple[str, ...]):  # noqa: ANN202
    return df.groupBy(*keys) if keys else df.groupBy()


def average_ranks(rows: DataFrame, column: str, keys: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """(keys..., column, rank, count) for each distinct value: the average rank, from 1, of the rows that hold it, and how many there are; nulls are left out."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("count"))
    placed = running(counts, keys, (column,), ("count",))
    return placed.select(*keys, column, (F.col("before_count") + (F.col("count") + 1) / 2.0).alias(name), "count")


def spearman(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., spearman): the correlation of average ranks."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c, name in ((x, "_rx"), (y, "_ry")):
        rows = rows.join(average_ranks(rows, c, keys, name).drop("count"), [*keys, c])
    return _agg(rows, keys).agg(F.corr("_rx", "_ry").alias("spearman"))


def _crossed(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """The weight of pairs with x ascending and y descending, ties in either not counted: bit by bit of y's rank, ones before zeros within equal higher bits."""
    order = np.lexsort((y, x))
    rank, c = np.unique(y[order], return_inverse=True)[1], c[order].astype(np.int64)
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        high = np.argsort(rank >> (bit + 1), kind="stable")
        group, one, w = (rank >> (bit + 1))[high], ((rank >> bit) & 1)[high], c[high]
        seen = np.cumsum(w * one)
        start = np.concatenate(([True], group[1:] != group[:-1]))
        base = np.maximum.accumulate(np.where(start, seen - w * one, 0))
        total += int(((seen - base) * w * (1 - one)).sum())
    return total


def inversions(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """(keys..., n, tied_x, tied_y, tied_xy, inversions): pairs of rows in all, tied in x, in y, in both, and ordered one way by x and the other by y.

    Equal rows are counted first. Both axes are cut in blocks of at most `block` places (a value with more rows is a block of its own). Pairs that differ in both
    blocks are sums over the grid of blocks; pairs within a block of x, and pairs within a block of y that differ in that of x, are counted by merging inside that block.
    Rows with a null in x or y take no part.
    """
    cells = cut(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c")))
    most = _agg(cells, keys).agg(F.sum("_c").alias("n")).agg(F.max("n")).first()[0] or 0
    b = block or max(50_000, 10 * math.isqrt(most))
    pairs = lambda c: F.sum(c * (c - 1) / 2).cast("long")
    totals = _agg(cells, keys).agg((F.sum("_c") * (F.sum("_c") - 1) / 2).cast("long").alias("n"), pairs(F.col("_c")).alias("tied_xy"))
    for axis in ("_x", "_y"):
        values = cells.groupBy(*keys, axis).agg(F.sum("_c").alias("_c"))
        ties = _agg(values, keys).agg(pairs(F.col("_c")).alias(f"tied{axis}"))
        totals = totals.join(ties, list(keys)) if keys else totals.crossJoin(ties)  # one row
        placed = running(values, keys, (axis,), ("_c",))
        at = (F.expr(f"before__c div {b}") * 2 + (F.col("_c") >= b).cast("int")).alias(f"_b{axis[1:]}")
        cells = cells.join(placed.select(*keys, axis, at), [*keys, axis])
    cells = cut(cells)
    inside = cells.where("_bx % 2 = 0").groupBy(*keys, "_bx").applyInPandas(_counted(keys, "_x", "_y"), _inverted(cells, keys))
    across = cells.where("_by % 2 = 0").groupBy(*keys, "_by").applyInPandas(_counted(keys, "_bx", "_y"), _inverted(cells, keys))
    grid = cells.groupBy(*keys, "_bx", "_by").agg(F.sum("_c").alias("_g"))
    # Of each column of the grid all blocks of y, so that the sums to the left are there for each; their number is that of blocks, squared.
    ends = _agg(grid, keys).agg(F.array_sort(F.collect_set("_by")).alias("all"))
    full = grid.select(*keys, "_bx").distinct()
    full = (full.join(ends, list(keys)) if keys else full.crossJoin(ends)).select(*keys, "_bx", F.explode("all").alias("_by"))
    full = full.join(grid, [*keys, "_bx", "_by"], "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    left = F.coalesce(F.sum("_g").over(Window.partitionBy(*keys, "_by").orderBy("_bx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("left").over(Window.partitionBy(*keys, "_bx").orderBy(F.desc("_by")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outside = full.withColumn("left", left).withColumn("above", above).select(*keys, (F.col("_g") * F.col("above")).alias("inv"))
    found = _agg(inside.union(across).union(outside), keys).agg(F.coalesce(F.sum("inv"), F.lit(0)).alias("inversions"))
    return totals.join(found, list(keys)) if keys else totals.crossJoin(found)  # one row


def _inverted(df: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "inv long"])


def _counted(keys: tuple[str, ...], x: str, y: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"inv": [_crossed(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["_c"].to_numpy())]})

    return run


def kendall(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """(keys..., kendall, agree): tau-b, and the share of all pairs that x and y order alike, where a tie agrees with a tie only; null without pairs, or without a pair that differs."""
    d = inversions(rows, x, y, keys, block)
    same = F.col("n") - F.col("tied_x") - F.col("tied_y") + F.col("tied_xy") - F.col("inversions")
    size = F.sqrt((F.col("n") - F.col("tied_x")).cast("double") * (F.col("n") - F.col("tied_y")))
    share = F.when(F.col("n") > 0, (same + F.col("tied_xy")) / F.col("n"))
    return d.select(*keys, F.when(size > 0, (same - F.col("inversions")) / size).alias("kendall"), share.alias("agree"))


def ndcg(rows: DataFrame, true: str, estimate: str, item: str, keys: tuple[str, ...] = (), k: int | None = None) -> DataFrame:
    """(keys..., ndcg) of the first k: gain 2^(items below) - 1 by the true order, discounted by the estimated place; ties go to the smaller item.

    Gains are counted in units of the largest plus one, as they have as many bits as there are items.
    """
    down = rows.where(F.col(true).isNotNull() & F.col(estimate).isNotNull()).select(*keys, F.col(item).alias("item"), (-F.col(true).cast("double")).alias("t"), (-F.col(estimate).cast("double")).alias("e"))
    first = running(down, keys, ("t", "item")).select(*keys, "item", "e", F.col("idx").alias("rt"), F.col("size").alias("all"))
    both = running(first, keys, ("e", "item")).withColumnRenamed("idx", "re")
    gain = F.pow(F.lit(2.0), -F.col("rt")) - F.pow(F.lit(2.0), 1 - F.col("all"))
    part = lambda c: F.sum(F.when(F.col(c) < (F.col("all") if k is None else k), gain / F.log2(F.col(c) + 2)).otherwise(0.0))
    return _agg(both, keys).agg((part("re") / part("rt")).alias("ndcg"))


# -- isotonic fits ---------------------------------------------------------------------------------------------------------


def _pooled(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The fit of each point of one run, by a stack of blocks."""
    weights, totals, sizes = [], [], []
    for a, b in zip(w.tolist(), s.tolist(), strict=True):
        n = 1
        while totals and totals[-1] * a > b * weights[-1]:
            a, b, n = a + weights.pop(), b + totals.pop(), n + sizes.pop()
        weights.append(a)
        totals.append(b)
        sizes.append(n)
    return np.repeat(np.array(totals) / np.array(weights), sizes) if totals else np.empty(0)


def isotonic(points: DataFrame, x: str, y: str, weight: str | None = None, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(keys..., x, weight, mean, fit): the non-decreasing fit of y along x, of least weighted squares; equal x are one point with their mean.

    The fit is the slope of the greatest convex curve below the running sums. For any slope t the place where (sum - t * weight) is least lies on that curve, and what
    lies before and after it can be fitted apart. So runs of more than `block` points are cut at the place for their own mean, all runs in one pass, until they are
    short or, if that place is an end, one block; a short run is fitted by pooling neighbours in its task. Cuts depend on the points alone, not on how they are dealt.
    Points with a null, or without positive weight, take no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = points.select(*keys, F.col(x).alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).where("x is not null and y is not null and w > 0")
    rows = rows.groupBy(*keys, "x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    now = running(rows, keys, ("x",), ("w", "s")).select(*keys, "x", "w", "s", "idx", (F.col("before_w") + F.col("w")).alias("cw"), (F.col("before_s") + F.col("s")).alias("cs"), F.lit(0).cast("long").alias("run"))
    now, _ = written(now)
    over = None
    by = [*keys, "run"]
    while True:
        runs = now.groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("rw"), F.sum("s").alias("rs"), F.min(F.struct("idx", (F.col("cw") - F.col("w")).alias("w0"), (F.col("cs") - F.col("s")).alias("s0"))).alias("b"))
        long = runs.where(F.col("n") > block)
        if not long.take(1):
            break
        t = F.col("rs") / F.col("rw")
        cut_at = now.join(long, by).withColumn("f", (F.col("cs") - F.col("b.s0")) - t * (F.col("cw") - F.col("b.w0")))
        least = cut_at.groupBy(*by).agg(F.min_by("idx", F.struct("f", -F.col("idx"))).alias("at"), F.min("f").alias("low"), F.max(F.abs("f")).alias("scale"), F.max("idx").alias("last"), F.first(t).alias("t"))
        one = (F.col("low") >= -1e-12 * F.col("scale")) | (F.col("at") == F.col("last"))
        marked, _ = written(now.join(least.select(*by, "at", "t", one.alias("one")), by, "left"))
        done = marked.where("one").select(*keys, "x", "w", "s", F.col("t").alias("fit"))
        over = done if over is None else over.union(done)
        right = F.when(F.col("idx") > F.col("at"), F.col("at") + 1).otherwise(F.col("run"))
        now, left = written(marked.where("one is null or not one").withColumn("run", F.coalesce(right, "run")).drop("at", "t", "one"))
        if not left:
            break
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.select(*keys, "x", "w", "s").schema.fields) + ", fit double"

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pdf[[*keys, "x", "w", "s"]].assign(fit=_pooled(pdf["w"].to_numpy(), pdf["s"].to_numpy()))

    out = now.groupBy(*by).applyInPandas(fitted, kinds)
    out = out if over is None else out.union(over)
    return out.select(*keys, F.col("x").alias(x), F.col("w").alias("weight"), (F.col("s") / F.col("w")).alias("mean"), "fit")


# -- greedy chunks ---------------------------------------------------------------------------------------------------------


def _next_starts(pdf: pd.DataFrame, limits: dict[str, int], most_rows: int) -> np.ndarray:
    """Of each place of a block, and what follows it, the place (in the block) where a chunk that starts there has to close."""
    n = len(pdf)
    out = np.minimum(np.arange(n) + most_rows, n)
    for c, most in limits.items():
        start = pdf[f"before_{c}"].to_numpy(np.int64)
        out = np.minimum(out, np.searchsorted(start + pdf[c].to_numpy(np.int64), start + most, "right"))
    return out


def greedy_chunks(requests: DataFrame, group: str, order: str, most_rows: int, most_tokens: int, most_bytes: int | None = None, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """requests (tokens; bytes, if those are limited) with a chunk number: in order within each group, a chunk closes before it would pass a limit.

    Where a chunk that starts at a place closes is a search in running sums. A block of places works out, for each of its first most_rows places, where a chain of
    chunks that enters there leaves to the next block and how many chunks it has; these tables are chained by doubling, so a group of any length takes a logarithmic number
    of steps and no task holds more than a block and the most_rows places after it. A request over a limit by itself gets chunk -1, or raises if strict. Equal orders are
    taken in some order; a group must not be null.
    """
    limits = {"tokens": most_tokens} | ({"bytes": most_bytes} if most_bytes is not None else {})
    big = F.lit(False)
    for c, most in limits.items():
        big = big | (F.col(c) > most)
    names = requests.columns
    marked = cut(requests.withColumn("_big", F.coalesce(big, F.lit(False))))
    if strict and (worst := marked.where("_big").agg(*(F.max(c).alias(c) for c in limits)).first()) and worst[0] is not None:
        raise ValueError("a request is over the limit: " + ", ".join(f"{c} {worst[c]}" for c in limits))
    size = max(4 * most_rows, block)
    placed = running(marked.where("not _big").drop("_big"), (group,), (order,), tuple(limits))
    own = F.expr(f"idx div {size}")
    placed = cut(placed.withColumn("_b", own))
    needed = [group, "idx", "_b", *limits, *(f"before_{c}" for c in limits)]
    both = F.when((F.col("idx") % size < most_rows) & (F.col("_b") > 0), F.array("_b", F.col("_b") - 1)).otherwise(F.array("_b"))
    halo = placed.select(*needed, "size", F.explode(both).alias("_at"))
    kind = requests.schema[group].dataType.simpleString()

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        first, m = int(pdf["idx"].iloc[0]), int((pdf["_b"] == pdf["_at"]).sum())
        to = _next_starts(pdf, limits, most_rows).tolist()
        out, chunks = [0] * m, [0] * m
        for k in range(m - 1, -1, -1):
            t = to[k]
            out[k], chunks[k] = (out[t], chunks[t] + 1) if t < m else (t, 1)
        at = np.arange(min(m, most_rows))
        at = at[np.array(out)[at] + first < int(pdf["size"].iloc[0])]  # no block follows the last chunk
        return pd.DataFrame({group: pd.Series([pdf[group].iloc[0]] * len(at), dtype=object), "at": at + first, "to": np.array(out)[at] + first, "chunks": np.array(chunks)[at]})

    jump, _ = written(halo.groupBy(group, "_at").applyInPandas(leave, f"{group} {kind}, at long, to long, chunks long"))
    blocks = placed.agg(F.max("_b")).first()[0]
    reached, _ = written(placed.select(group).distinct().select(group, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before")))
    for _ in range(math.ceil(math.log2((blocks or 0) + 1)) if blocks else 0):
        there = reached.join(jump, [group, "at"]).select(group, F.col("to").alias("at"), (F.col("before") + F.col("chunks")).alias("before"))
        reached, _ = written(reached.union(there))
        far = jump.select(group, F.col("at").alias("to"), F.col("to").alias("far"), F.col("chunks").alias("more"))
        jump, _ = written(jump.join(far, [group, "to"]).select(group, "at", F.col("far").alias("to"), (F.col("chunks") + F.col("more")).alias("chunks")))
    entry = reached.select(group, F.expr(f"at div {size}").alias("_at"), F.col("at").alias("_entry"), F.col("before").alias("_before"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        first, m = int(pdf["idx"].iloc[0]), int((pdf["_b"] == pdf["_at"]).sum())
        to, starts, k = _next_starts(pdf, limits, most_rows).tolist(), np.zeros(len(pdf), np.int64), int(pdf["_entry"].iloc[0]) - first
        while k < m:
            starts[k], k = 1, to[k]
        # A last block without a start of its own lies in the last chunk of this one.
        n = k if first + k == int(pdf["size"].iloc[0]) else m
        return pd.DataFrame({group: pd.Series([pdf[group].iloc[0]] * n, dtype=object), "idx": np.arange(first, first + n), "chunk": int(pdf["_before"].iloc[0]) - 1 + np.cumsum(starts[:n])})

    found = halo.join(entry, [group, "_at"]).groupBy(group, "_at").applyInPandas(number, f"{group} {kind}, idx long, chunk long")
    good = placed.join(found, [group, "idx"]).select(*names, "chunk")
    return good.union(marked.where("_big").select(*names, F.lit(-1).cast("long").alias("chunk")))
