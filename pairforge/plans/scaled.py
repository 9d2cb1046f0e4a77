"""Queries over whole tables through fits and orders that no task has to see whole: scores of parts and judges, contrasts, isotonic prices, ranks, chunks, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import verdicts
from ..operators import factors
from ..operators import ordered as O
from ..operators import panel as P
from ..operators import scaling as M
from ..operators import summary as U
from ..sources import fixture as fx
from .base import PANEL, RECORDS, query
from .relational import human, llm


def counted(rows: DataFrame, *key: str) -> DataFrame:
    """Pairs (key..., item_i, item_j, n, y) of comparison rows (i, j, y2)."""
    return P.counts(rows, *key, "i", "j").select(*key, F.col("i").alias("item_i"), F.col("j").alias("item_j"), "n", (F.col("y2") / 2).alias("y"))


def named(scores: DataFrame, spark, sf) -> DataFrame:
    """Scores with the items' names."""
    return scores.join(P.item_index(fx.records(spark, sf)).withColumnRenamed("item", "name"), F.col("item") == F.col("idx")).drop("item", "idx").withColumnRenamed("name", "item")


# Neighbours in an order are compared by quantity; equal ones are half a win each.
_PARTS = """
near AS (SELECT l_partkey AS a, l_quantity AS qa, lead(l_partkey) OVER w AS b, lead(l_quantity) OVER w AS qb FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
pc AS (SELECT least(a, b) AS i, greatest(a, b) AS j, count(*)::DOUBLE AS n, sum(CASE WHEN qa = qb THEN 0.5 WHEN (qa > qb) = (a < b) THEN 1 ELSE 0 END)::DOUBLE AS y FROM near WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2),
sides AS (SELECT i AS s, j AS o, n, y AS w FROM pc UNION ALL SELECT j, i, n, n - y FROM pc)"""
_PART_MM = _PARTS + """,
wins AS (SELECT s, sum(w) AS w FROM sides GROUP BY 1),
mm AS (SELECT 0 AS step, s, 1.0::DOUBLE AS p FROM wins UNION ALL
  SELECT mm.step + 1, mm.s, any_value(wins.w) / sum(sides.n / (mm.p + other.p)) FROM mm JOIN sides ON sides.s = mm.s JOIN mm other ON other.s = sides.o JOIN wins ON wins.s = mm.s WHERE mm.step < 80 GROUP BY mm.step, mm.s)"""


def part_pairs(spark, sf) -> DataFrame:
    """Parts that follow each other in an order, the one of the larger quantity won."""
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    near = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_quantity").alias("qa"), F.lead("l_partkey").over(along).alias("b"), F.lead("l_quantity").over(along).alias("qb")).where("b is not null and a <> b")
    y = F.when(F.col("qa") == F.col("qb"), 0.5).when((F.col("qa") > F.col("qb")) == (F.col("a") < F.col("b")), 1.0).otherwise(0.0)
    return near.groupBy(F.least("a", "b").alias("item_i"), F.greatest("a", "b").alias("item_j")).agg(F.count("*").alias("n"), F.sum(y).alias("y"))


@query("SELECT s AS p_partkey, round(ln(p) - avg(ln(p)) OVER (), 4) AS score FROM mm WHERE step = 80", _PART_MM)
def part_btl(spark, sf):
    """Scores of all parts."""
    return M.bradley_terry(part_pairs(spark, sf)).select(F.col("item").alias("p_partkey"), F.round("score", 4).alias("score"))


@query("SELECT count(*) AS n_items, count(*) = (SELECT count(DISTINCT node) FROM (SELECT a AS node FROM reach INTERSECT SELECT a FROM back)) AS mle_exists FROM (SELECT DISTINCT s FROM sides)", _PARTS + """,
won AS (SELECT s, o FROM sides WHERE w > 0), root AS (SELECT min(s) AS a FROM sides),
reach AS (SELECT a FROM root UNION SELECT won.o FROM reach JOIN won ON won.s = reach.a), back AS (SELECT a FROM root UNION SELECT won.s FROM back JOIN won ON won.o = back.a)""")
def part_mle_exists(spark, sf):
    pairs = part_pairs(spark, sf)
    items = pairs.select(F.col("item_i").alias("item")).union(pairs.select("item_j")).distinct()
    return items.agg(F.count("*").alias("n_items")).crossJoin(M.mle_exists(pairs, items))


@query(name="part_contrasts")
def part_contrasts(spark, sf):
    """Each brand's mean score against the mean of all parts, with intervals from the sparse information matrix."""
    pairs = part_pairs(spark, sf)
    scores = M.bradley_terry(pairs).select("item", "score")
    brands = scores.join(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("target")), "item")
    n = brands.groupBy("target").agg(F.count("*").alias("n"))
    return M.contrast_intervals(pairs, scores, brands.join(n, "target").select("target", "item", (1 / F.col("n")).alias("b")))


@query("SELECT k, (SELECT count(*) FROM reach WHERE reach.k = q.k AND a <> b) = 20 AS mle_exists FROM (SELECT DISTINCT k FROM llm) q", PANEL + ", edges AS (SELECT DISTINCT k, CASE WHEN y2 = 2 THEN i ELSE j END AS a, CASE WHEN y2 = 2 THEN j ELSE i END AS b FROM llm), reach AS (SELECT k, a, b FROM edges UNION SELECT reach.k, reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a AND reach.k = edges.k)")
def judge_mle_exists(spark, sf):
    rows = llm(spark, sf)
    items = P.item_index(fx.records(spark, sf)).select(F.col("idx").alias("item"))
    cells = rows.select("k").distinct().join(F.broadcast(items), F.lit(True))  # judges x items, both dimensions
    return M.mle_exists(counted(rows, "k"), cells, ("k",))


_PAVA = """
p AS (SELECT o_orderdate AS x, count(*)::DOUBLE AS w, sum(o_totalprice)::DOUBLE AS s FROM orders GROUP BY 1),
c AS (SELECT x, row_number() OVER (ORDER BY x) AS k, w, s, sum(w) OVER (ORDER BY x) AS cw, sum(s) OVER (ORDER BY x) AS cs FROM p),
a AS (SELECT l.k AS l, u.k AS u, (u.cs - l.cs + l.s) / (u.cw - l.cw + l.w) AS m FROM c l JOIN c u ON l.k <= u.k),
low AS (SELECT u, min(m) OVER (PARTITION BY l ORDER BY u DESC ROWS UNBOUNDED PRECEDING) AS m FROM a)"""


@query("SELECT x AS o_orderdate, w AS n_orders, round(fit, 3) AS fit FROM c JOIN (SELECT u, max(m) AS fit FROM low GROUP BY 1) ON u = k", _PAVA)
def isotonic(spark, sf):
    """Prices of orders, made non-decreasing along their dates."""
    fit = O.isotonic(fx.table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return fit.select("o_orderdate", F.col("weight").alias("n_orders"), F.round("fit", 3).alias("fit"))


# Customers by what they owe and by what they bought, parts by price and by what was sold.
_CUSTOMERS = "cu AS (SELECT c_custkey, c_mktsegment, round(c_acctbal, -2) AS x, coalesce(n, 0)::DOUBLE AS y FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"
_PART_SALES = "pa AS (SELECT p_partkey, p_retailprice AS x, coalesce(q, 0)::DOUBLE AS y FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"


def customers(spark, sf) -> DataFrame:
    bought = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n"))
    c = fx.table(spark, sf, "customer").join(bought, "c_custkey", "left")
    return c.select("c_custkey", "c_mktsegment", F.round("c_acctbal", -2).alias("x"), F.coalesce("n", F.lit(0.0)).alias("y"))


def part_sales(spark, sf) -> DataFrame:
    sold = fx.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("q"))
    return fx.table(spark, sf, "part").join(sold, "p_partkey", "left").select("p_partkey", F.col("p_retailprice").alias("x"), F.coalesce("q", F.lit(0.0)).alias("y"))


@query("SELECT c_mktsegment, round(sum(sign(dx) * sign(dy)) / sqrt(sum((dx <> 0)::INT) * sum((dy <> 0)::INT)::DOUBLE), 6) AS tau_b, round(avg((sign(dx) = sign(dy))::INT), 6) AS sign_accuracy FROM (SELECT a.c_mktsegment, a.x - b.x AS dx, a.y - b.y AS dy FROM cu a JOIN cu b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey) GROUP BY 1", _CUSTOMERS)
def customer_kendall(spark, sf):
    """Of each segment, how balances and numbers of orders go together."""
    return O.kendall(customers(spark, sf), "x", "y", ("c_mktsegment",)).select("c_mktsegment", F.round("kendall", 6).alias("tau_b"), F.round("agree", 6).alias("sign_accuracy"))


@query("SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pa)", _PART_SALES)
def part_spearman(spark, sf):
    return O.spearman(part_sales(spark, sf), "x", "y").select(F.round("spearman", 6).alias("spearman"))


@query("SELECT round(sum(CASE WHEN re < 100 THEN g / log2(re + 2) ELSE 0 END) / sum(CASE WHEN rt < 100 THEN g / log2(rt + 2) ELSE 0 END), 6) AS ndcg FROM (SELECT *, pow(2.0::DOUBLE, -rt) - pow(2.0::DOUBLE, 1 - n) AS g FROM (SELECT row_number() OVER (ORDER BY x DESC, p_partkey) - 1 AS rt, row_number() OVER (ORDER BY y DESC, p_partkey) - 1 AS re, count(*) OVER () AS n FROM pa))", _PART_SALES)
def part_ndcg(spark, sf):
    """Prices ranked by quantity sold, of the first 100."""
    return O.ndcg(part_sales(spark, sf), "x", "y", "p_partkey", k=100).select(F.round("ndcg", 6).alias("ndcg"))


_QUEUE = r"""
q AS (SELECT doc_id, lang, tokens, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM (SELECT doc_id, lang, CAST(ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0) + strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 32 AS BIGINT) AS tokens FROM documents) WHERE tokens <= 20000),
c AS (SELECT doc_id, lang, p, 0 AS chunk, 1 AS n, tokens AS total FROM q WHERE p = 1 UNION ALL
  SELECT q.doc_id, q.lang, q.p, CASE WHEN c.n = 50 OR total + tokens > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN c.n = 50 OR total + tokens > 20000 THEN 1 ELSE c.n + 1 END, CASE WHEN c.n = 50 OR total + tokens > 20000 THEN tokens ELSE total + tokens END FROM c JOIN q ON q.lang = c.lang AND q.p = c.p + 1)"""


@query("SELECT d.doc_id, d.lang, coalesce(c.chunk, -1) AS chunk FROM documents d LEFT JOIN c USING (doc_id)", _QUEUE)
def request_chunks(spark, sf):
    """Documents as requests, in chunks of at most 50 and 20,000 tokens, one queue a language."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", S.token_estimate(F.col("text")).alias("tokens"))
    return O.greedy_chunks(docs, "lang", "doc_id", 50, 20_000).select("doc_id", "lang", "chunk")


#: Replies of every kind, and what is read from them.
GRAMMAR = [
    ("a 5", "a", 5), ("  D\t-2 ", "d", 1), ("c 99999999999999999999999", "c", 5), ("a  +0", "a", 1), ("`b 3`", "b", 3), ("```c 9```", "c", 5), ("``a 5`", None, None), ("<choice>a</choice><confidence>4</confidence>", "a", 4),
    ("<choice> b\n<confidence>2 </choice>", "b", 2), ("A.\nConfidence: 9", "a", 5), ("`a)`\nwhy\n confidence = 2 of 5", "a", 2), ("a\nI am sure: confidence: 4", None, None), ("The answer is a 5", None, None), ("a 3\nb 4", None, None), ("a 7\na 5", "a", 5),
    ("Thinking.\nFinal answer:\nb 2", "b", 2), ("Final answer\nb2", "b", 2), ("**Final Verdict**:\n\n c 4\n", "c", 4), ("final judgment\na 1\nfinal judgement:\nd5", "d", 5), ("Final answer:\nb 9", "b", 5), ("Final answer:\na 1\nb 2", None, None),
    ("final answer: b 2", "b", 2), ("Choice: c\nConfidence: 2", "c", 2), ("- **Choice:** **a**  - **Confidence:** **3**", "a", 3), ("choice = d  confidence = 1", "d", 1), ("choice: a\nsome words\nconfidence: 2", "a", 2),
    ("I think choice: b is my pick, confidence: 4 overall", None, None), ("choice: b is my pick\nconfidence 4 overall", "b", 4), ("choice: b\nchoice: a\nconfidence: 4", "a", 4), ("choice: b\nor\nchoice: a\nso\nconfidence: 4", None, None),
    ("choice: b\nso\nconfidence: 4\nconfidence: 9", None, None), ("choice: b\nconfidence: 5\nconfidence: 9", "b", 5), ("<choise>c\n<confidence>3", "c", 3), ("* <choice>c</choice>\nwords\n- <confidence>3</confidence>", "c", 3),
    ("so\n<choice>a</choice> <confidence>2</confidence>\nbye", "a", 2), ("so <choice>a</choice> <confidence>2</confidence>", None, None), ("a-3", None, None), ("a:5", None, None), ("a, 3", None, None), ("e 3", None, None), ("answer: d 1", "d", 1),
    ("Answer = D 7", "d", 5), ("my answer: d 1", None, None), ("choice: 'a'\nconfidence: 2", "a", 2), ("winner: a\nconfidence: 2", None, None), ("line one\n`a 4`\nend", "a", 4), ("", None, None), (" \n ", None, None), ("(confidence): 3\nchoice: a", "a", 3),
    ("A 5\r\nbecause", "a", 5), ("b 3 4", None, None), ("<choice>a</choice> 4", None, None), ("choice: a5\nconfidence: 2", None, None), ("**Choice: B**\n**Confidence: 4**", "b", 4), ("b)\nconfidence: 3-4", "b", 3), ("final verdict:\n1. a 3", None, None),
    ("<choice>d</choice>\n<confidence>0</confidence>", "d", 1), ("Choice: a\n\nConfidence: 5/5", "a", 5), ("c", None, None), ("confidence: 4", None, None), ("FINAL ANSWER:\nB 1\nfinal answer:\nthat is all", "b", 1), ("a\t4\n\na  4", "a", 4),
]
_TOLD = ", ".join(f"({k}, {'NULL' if c is None else repr(c)}, {'NULL' if n is None else n})" for k, (_, c, n) in enumerate(GRAMMAR))


@query(f"SELECT r.record_id, v.choice, CAST(v.confidence AS INT) AS confidence FROM records r JOIN (VALUES {_TOLD}) v(id, choice, confidence) ON r.record_id % {len(GRAMMAR)} = v.id", RECORDS)
def verdict_grammar(spark, sf):
    """The full reading of replies, one of each kind in turn over all records."""
    reply = F.element_at(F.array(*(F.lit(t) for t, _, _ in GRAMMAR)), (F.col("record_id") % len(GRAMMAR) + 1).cast("int"))
    return fx.records(spark, sf).select("record_id", verdicts.full_verdict(reply).alias("v")).select("record_id", "v.choice", "v.confidence")


_U = "CAST('0x' || substr(md5(record_id || '|' || a_first || '|stub'), 1, 7) AS BIGINT)"


@query(f"SELECT choice, CAST(sure AS INT) AS confidence, count(*) AS n FROM (SELECT CASE WHEN u % 4 < 3 THEN substr('abc', CAST(u % 3 + 1 AS INT), 1) END AS choice, CASE WHEN u % 4 < 3 THEN u % 5 + 1 END AS sure FROM (SELECT {_U} AS u FROM records, (VALUES ('true'), ('false')) o(a_first))) GROUP BY 1, 2", RECORDS)
def parse_verdict_full(spark, sf):
    """What is read from the stub judge's replies to all jobs."""
    from .relational import stub_judge

    return stub_judge(spark, sf).groupBy("choice", "confidence").agg(F.count("*").alias("n"))


_BIN = "CAST(ceil(ln(o_totalprice) / ln(1.01::DOUBLE / 0.99)) AS BIGINT)"
_SPREAD = f"b AS (SELECT o_orderpriority, {_BIN} AS bin, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM b)"
_AT = "(SELECT 2 / (1.01::DOUBLE / 0.99 + 1) * exp(min(bin) * ln(1.01::DOUBLE / 0.99)) FROM c WHERE c.o_orderpriority = o.o_orderpriority AND seen > floor({0} * (total - 1)))"


@query(f"SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS most, min_by(o_totalprice, (o_orderdate, o_totalprice)) AS first, round({_AT.format(0.5)}, 4) AS q50, round({_AT.format(0.9)}, 4) AS q90 FROM orders o GROUP BY 1", _SPREAD)
def price_summary(spark, sf):
    """Prices by priority, from the states of each year's orders, merged as if each had come as a file of its own."""
    orders = fx.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    states = U.summarize(orders, "o_totalprice", "o_orderdate", ("year", "o_orderpriority"))
    d = U.finish(U.merge(states, ("o_orderpriority",)), ("o_orderpriority",))
    return d.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "least", "most", "first", F.round("q50", 4).alias("q50"), F.round("q90", 4).alias("q90"))


_PROFILE = PANEL + """,
kept AS (SELECT c.*, k FROM canon c JOIN judges USING (judge)), cell AS (SELECT count(*) AS n FROM llm GROUP BY k, i, j), rate AS (SELECT avg(judge_tie::INT) AS r FROM kept GROUP BY judge)"""


@query("""SELECT (SELECT count(*) FROM records) AS records, (SELECT count(*) FROM items) AS n_items, (SELECT count(*) FROM judges) AS n_judges, (SELECT count(DISTINCT item_i || '|' || item_j) FROM records) AS pairs_observed, (SELECT count(*) * (count(*) - 1) // 2 FROM items) AS pairs_possible,
  (SELECT count(*) FILTER (WHERE winner = 'model_a') FROM records) AS label_a, (SELECT count(*) FILTER (WHERE winner = 'model_b') FROM records) AS label_b, (SELECT count(*) FILTER (WHERE winner = 'tie') FROM records) AS label_tie, (SELECT count(*) FILTER (WHERE winner = 'both_bad') FROM records) AS label_both_bad, (SELECT count(*) FROM human) AS decisive,
  (SELECT count(*) FROM kept) AS judgments, (SELECT count(*) FILTER (WHERE judge_tie) FROM kept) AS ties, (SELECT count(*) FROM llm) AS n_l, (SELECT count(*) FILTER (WHERE a = 1) FROM llm) AS order_plus, (SELECT count(*) FILTER (WHERE a = -1) FROM llm) AS order_minus,
  (SELECT count(*) FROM cell) AS cells_observed, (SELECT count(*) FROM judges) * (SELECT count(*) * (count(*) - 1) // 2 FROM items) AS cells_possible, (SELECT min(n) FROM cell) AS cell_min, (SELECT round(avg(n), 6) FROM cell) AS cell_mean, (SELECT max(n) FROM cell) AS cell_max,
  (SELECT round(min(r), 6) FROM rate) AS tie_rate_min, (SELECT round(max(r), 6) FROM rate) AS tie_rate_max, (SELECT string_agg(item, ', ' ORDER BY item) FROM items) AS items""", _PROFILE)
def dataset_profile(spark, sf):
    """All measures of a dataset: records and judgments are counted once by judge, pair and order; the rest is worked out from those counts."""
    from .relational import canon

    r = fx.records(spark, sf).groupBy("item_i", "item_j").agg(F.count("*").alias("n"), *(F.count_if(F.col("winner") == w).alias(w) for w in ("model_a", "model_b", "tie", "both_bad")))
    r = r.agg(*(F.sum(c).alias(c) for c in ("n", "model_a", "model_b", "tie", "both_bad")), F.count("*").alias("pairs"), F.collect_set("item_i").alias("x"), F.collect_set("item_j").alias("y"))
    items = F.array_sort(F.array_union("x", "y"))
    possible = F.expr("n_items * (n_items - 1) div 2")
    r = r.withColumn("names", items).withColumn("n_items", F.size("names").cast("long"))
    c = canon(spark, sf)
    judges = P.panel_judges(c).select("judge")
    cell = c.join(judges, "judge").groupBy("judge", "item_i", "item_j").agg(F.count("*").alias("all"), F.count_if("judge_tie").alias("ties"), F.count_if(~F.col("judge_tie") & (F.col("display_order") == 1)).alias("plus"), F.count_if(~F.col("judge_tie") & (F.col("display_order") == -1)).alias("minus"))
    seen = F.when(F.col("plus") + F.col("minus") > 0, F.col("plus") + F.col("minus"))
    by_judge = cell.groupBy("judge").agg(*(F.sum(x).alias(x) for x in ("all", "ties", "plus", "minus")), F.count(seen).alias("cells"), F.min(seen).alias("low"), F.max(seen).alias("high"))
    rate = F.col("ties") / F.col("all")
    k = by_judge.agg(F.count("*").alias("n_judges"), *(F.sum(x).alias(x) for x in ("all", "ties", "plus", "minus", "cells")), F.min("low").alias("low"), F.max("high").alias("high"), F.min(rate).alias("t0"), F.max(rate).alias("t1")).withColumnsRenamed({"ties": "judge_ties"})
    return r.crossJoin(k).select(  # one row each
        F.col("n").alias("records"), "n_items", "n_judges", F.col("pairs").alias("pairs_observed"), possible.alias("pairs_possible"), F.col("model_a").alias("label_a"), F.col("model_b").alias("label_b"), F.col("tie").alias("label_tie"), F.col("both_bad").alias("label_both_bad"),
        (F.col("model_a") + F.col("model_b")).alias("decisive"), F.col("all").alias("judgments"), F.col("judge_ties").alias("ties"), (F.col("plus") + F.col("minus")).alias("n_l"), F.col("plus").alias("order_plus"), F.col("minus").alias("order_minus"), F.col("cells").alias("cells_observed"),
        (F.col("n_judges") * possible).alias("cells_possible"), F.col("low").alias("cell_min"), F.round((F.col("plus") + F.col("minus")) / F.col("cells"), 6).alias("cell_mean"), F.col("high").alias("cell_max"), F.round("t0", 6).alias("tie_rate_min"), F.round("t1", 6).alias("tie_rate_max"), F.array_join("names", ", ").alias("items"),
    )


@query(name="factor_scores")
def factor_scores(spark, sf):
    """Every judge's scores and position effect under one common factor, by alternation over judges and items."""
    rows = P.counts(llm(spark, sf), "k", "i", "j", "a").select(F.col("k").alias("judge"), F.col("i").alias("item_i"), F.col("j").alias("item_j"), "a", "n", (F.col("y2") / 2).alias("y"))
    judges, items, _ = factors.factor_model(rows, 1, tol=1e-8)
    d = judges.join(F.broadcast(items), F.lit(True))  # a score for each judge and item is what is asked for
    return named(d.select("judge", "item", (F.col("gamma") * F.col("mu") + F.col("u")[0] * F.col("v")[0]).alias("score"), "b"), spark, sf).select("judge", "item", "score", "b")
