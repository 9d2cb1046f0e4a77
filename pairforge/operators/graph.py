"""Components of graphs as rounds of joins: undirected ones by stars, strongly connected ones by merging, trimming, chains and colours.

Nodes are longs. Every round ends in a written table, so the lineage of a round is bounded, and a round's joins are on node ids, which Spark can split where a
node is hot. A graph of few edges lies in few partitions (`written`), so that small graphs cost small jobs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, written

def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, comp): each node of an edge with the least node that edges lead to, whatever their direction. Rounds grow with the logarithm of the size.

    Large and small stars in turn (Kiveris and others, 2014). Nulls and loops are dropped; no edges give an empty result.
    """
    now, n = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while n:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b")
        now, n = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return pairs.union(now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp")))


class _Scc:
    """What is left of the graph (n edges between merged nodes), and where each node was merged to."""

    def __init__(self, edges: DataFrame, nodes: DataFrame) -> None:
        self.edges, self.n = written(edges.where("a <> b").select("a", "b").distinct())
        self.to = nodes.select("node", F.col("node").alias("to"))

    def merge(self, to: DataFrame) -> None:
        """to (node, comp): nodes that are one from now on."""
        to = to.select(F.col("node").alias("x"), F.col("comp").alias("y"))
        side = lambda c: F.coalesce(F.col(f"{c}y"), F.col(c)).alias(c)
        named = lambda c: to.select(F.col("x").alias(c), F.col("y").alias(f"{c}y"))
        edges = self.edges.join(named("a"), "a", "left").join(named("b"), "b", "left").select(side("a"), side("b")).where("a <> b").distinct()
        now = self.to.join(to, F.col("to") == F.col("x"), "left").select("node", F.coalesce("y", "to").alias("to"))
        self.to, _ = written(now)
        self.edges, self.n = written(edges)

    def mutual(self) -> bool:
        """Nodes with edges both ways between them are in one component."""
        back = self.edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        pairs, n = written(self.edges.join(back, ["a", "b"], "left_semi").where("a < b"))
        if n:
            self.merge(connected(pairs))
        return n > 0

    def trim(self) -> bool:
        """Edges of nodes without any in, or any out, go: such a node is a component of its own."""
        out, into = self.edges.select(F.col("a").alias("b")).distinct(), self.edges.select(F.col("b").alias("a")).distinct()
        before = self.n
        self.edges, self.n = written(self.edges.join(out, "b", "left_semi").join(into, "a", "left_semi"))
        return self.n < before

    def chains(self, a: str, b: str) -> bool:
        """Chains and rings of nodes with a single edge out (in, if a and b are exchanged).

        Following single edges by doubling, a node comes to an end, or into a ring, all of whose nodes are one component. A node on the way to an end is
        in the end's component if and only if that leads back to it or to a node before it; so edges into the chain are bent to its end, and one component of what is
        left is looked up for the nodes of the chain later (resolve).
        """
        single = self.edges.groupBy(a).agg(F.min(b).alias("next"), F.count("*").alias("n")).where("n = 1").select(F.col(a).alias("u"), "next")
        walk, n = written(single.withColumns({"least": F.col("u"), "end": F.lit(False)}))
        if not n:
            return False
        for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
            step = walk.select(F.col("u").alias("next"), F.col("next").alias("far"), F.col("least").alias("low"))
            walk, _ = written(walk.join(step, "next", "left").select("u", F.coalesce("far", "next").alias("next"), F.least("least", F.coalesce("low", "least")).alias("least"), F.col("far").isNull().alias("end")))
            if not walk.where("not end").take(1):
                break
        ring = walk.where("not end")  # still under way after as many steps as there are nodes
        if ring.take(1):
            on = ring.select(F.col("next").alias("u")).distinct()
            self.merge(ring.join(on, "u", "left_semi").select(F.col("u").alias("node"), F.col("least").alias("comp")))
            return True
        return self._bend(walk.select("u", "next"), a, b)

    def _bend(self, walk: DataFrame, a: str, b: str) -> bool:
        """Leaves the chains out of the graph and settles, for what is left, which of their nodes belong to their ends' components."""
        ends = walk.select(F.col("u").alias(b), "next")
        rest = self.edges.join(walk.select(F.col("u").alias(a)), a, "left_anti")
        bent = rest.join(ends, b, "left").select(a, F.coalesce("next", b).alias(b)).where(f"{a} <> {b}").select("a", "b").distinct()
        inner = _Scc.of(bent)
        # A node whose only way on leads back to itself (rest's loop) is entered from its own end's component.
        comp = inner.select("node", "comp")
        of = lambda c, name: comp.select(F.col("node").alias(c), F.col("comp").alias(name))
        into = rest.join(walk.select(F.col("u").alias(b), "next"), b).join(of(a, "ca"), a, "left").join(of("next", "cn"), "next", "left")
        entered = into.where(F.coalesce("ca", a) == F.coalesce("cn", "next")).select(F.col(b).alias("u"), F.lit(True).alias("in")).distinct()
        # What follows an entered node on its chain is entered too: by doubling along the single edges.
        single = self.edges.join(walk.select(F.col("u").alias(a)), a, "left_semi").select(F.col(a).alias("u"), F.col(b).alias("next"))
        flags, n = written(single.join(entered, "u", "left").select("u", "next", F.coalesce("in", F.lit(False)).alias("in")))
        for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
            push = flags.where("in").select(F.col("next").alias("u"), F.lit(True).alias("hit")).distinct()
            jump = flags.select(F.col("u").alias("next"), F.col("next").alias("far"))
            moved = flags.join(push, "u", "left").withColumn("in", F.col("in") | F.coalesce("hit", F.lit(False))).drop("hit")
            flags, _ = written(moved.join(jump, "next", "left").select("u", F.coalesce("far", "next").alias("next"), "in"))
        mine = flags.where("in").select("u").join(walk, "u").join(of("next", "cn"), "next", "left").select(F.col("u").alias("node"), F.coalesce("cn", "next").alias("comp"))
        self.merge(inner.select("node", "comp").union(mine))
        self.edges, self.n = self.edges.limit(0), 0
        return True

    def colours(self) -> None:
        """Each node takes the least node that leads to it; within a colour, what leads to its first node is one component."""
        nodes = self.edges.select(F.col("a").alias("node")).union(self.edges.select("b")).distinct()
        colour, _ = written(nodes.select("node", F.col("node").alias("c")))
        while True:
            seen = self.edges.join(colour, F.col("a") == F.col("node")).groupBy("b").agg(F.min("c").alias("m"))
            now, _ = written(colour.join(seen, F.col("node") == F.col("b"), "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            colour = now.drop("moved")
            if not now.where("moved").take(1):
                break
        of = lambda c: colour.select(F.col("node").alias(c), F.col("c").alias(f"c{c}"))
        inside, _ = written(self.edges.join(of("a"), "a").join(of("b"), "b").where("ca = cb").select("a", "b"))
        reach, n = written(colour.where("node = c"))
        while True:
            more = inside.join(reach, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "c").union(reach).distinct()
            reach, m = written(more)
            if m == n:
                break
            n = m
        self.merge(reach.select("node", F.col("c").alias("comp")))
        # Edges between colours lead to no cycle.
        left = F.coalesce(F.col("ca"), F.col("a")) == F.coalesce(F.col("cb"), F.col("b"))
        self.edges, self.n = written(self.edges.join(of("a"), "a", "left").join(of("b"), "b", "left").where(left).select("a", "b"))

    @staticmethod
    def of(edges: DataFrame) -> DataFrame:
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        return strongly_connected(edges, nodes)


def strongly_connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (a, b), nodes (node) -> (node, comp): each node with the least node of those that it leads to and that lead to it.

    Each round merges nodes with edges both ways, takes out nodes without edges in or out, and closes rings and chains of single edges by doubling, so that
    long chains and rings take a logarithmic number of rounds; what is left after a round without progress is parted by colours. Repeated edges, loops and edges of unknown nodes do no harm.
    """
    known = nodes.select(F.col("node").cast("long").alias("node")).distinct()
    edges = edges.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    s = _Scc(edges, known)
    while s.n:
        moved = s.mutual()
        moved = s.trim() or moved
        if s.n and not s.chains("a", "b") and not s.chains("b", "a") and not moved:
            s.colours()
    least = s.to.groupBy("to").agg(F.min("node").alias("comp"))
    return cut(s.to.join(least, "to").select("node", "comp"))
