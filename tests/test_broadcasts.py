"""What is broadcast where the optimizer guesses few rows: the judges and items, never the rows."""

import pytest
from pyspark.sql import functions as F

from pairforge.operators import panel as P
from pairforge.operators.lineage import cut
from pairforge.plans import studies

NAMES = "abcde"


@pytest.fixture(scope="module")
def canon(spark):
    """40,000 comparisons by 4 judges; what explode() makes isn't in the optimizer's guess of their size."""
    d = spark.range(500).select("id", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("c"))
    name = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), (c % 5 + 1).cast("int"))
    order = F.when(F.col("c") < 40, 1).otherwise(-1).alias("display_order")
    d = d.select((F.col("id") * 10 + F.floor(F.col("c") % 40 / 4)).alias("record_id"), (F.col("c") % 4).cast("int").alias("judge"), name(F.col("id")).alias("item_i"), name(F.col("id") + 1).alias("item_j"), order)
    return cut(d.withColumns({"outcome": F.col("item_i"), "human_outcome": F.col("item_j"), "judge_tie": F.lit(False), "human_decisive": F.lit(True)}))


def most_broadcast(df) -> int:
    """Rows of the largest broadcast of the plan that ran."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(k) for k in range(p.children().size())]
    return most


@pytest.mark.parametrize("rows", [P.llm_rows, P.human_rows, lambda c: P.drop_empty(P.llm_rows(c).where("k in (1, 3)"))])
def test_rows_meet_dimensions(canon, rows):
    assert 0 < most_broadcast(rows(canon)) <= len(NAMES)


def test_sweep_reads_people_once(spark, sf, monkeypatch):
    """A draw for each seed and budget comes from one table of human rows, not from one of its own; the draws are those of X.draw."""
    people, asked, seen = studies.human(spark, sf), [], {}
    monkeypatch.setattr(studies, "human", lambda *a: asked.append(a) or people)
    monkeypatch.setattr(studies, "run_methods", lambda c, i, j, n, y, truth: [("n", float(n.sum()), float(y.sum()), None, None)])
    for r in studies.sweep(spark, sf, studies.llm(spark, sf), (50, -1)).collect():
        seen[r.level, r.seed] = (r.excess, r.accuracy)
    assert len(asked) == 1
    for (level, seed), (n, y) in seen.items():
        drawn = studies.X.draw(people, int(level), f"h{seed}", "record_id").agg(F.count("*"), F.sum("y2") / 2).first()
        assert tuple(drawn) == (n, y)
    assert len(seen) == 4
