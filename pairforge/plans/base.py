"""Registration of queries, and the SQL that derives the comparison tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_MU = "CASE {0} WHEN 'click' THEN -0.6 WHEN 'error' THEN -0.2 WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 0.4 ELSE -0.1 END"
MU_I, MU_J = f"CAST({_MU.format('item_i')} AS DOUBLE)", f"CAST({_MU.format('item_j')} AS DOUBLE)"
MU_SQL = "(VALUES (0,'click',-0.6::DOUBLE),(1,'error',-0.2::DOUBLE),(2,'purchase',0.5::DOUBLE),(3,'signup',0.4::DOUBLE),(4,'view',-0.1::DOUBLE)) mu(idx,item,s)"

RECORDS = """
ev AS (SELECT event_id, event_type AS model_a, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) AS k1, lead(event_type) OVER w AS model_b,
  CAST(regexp_extract(lead(props) OVER w, '"k": *(-?[0-9]+)', 1) AS INT) AS k2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
records AS (SELECT event_id AS record_id, model_a, model_b, least(model_a, model_b) AS item_i, greatest(model_a, model_b) AS item_j, model_a > model_b AS swapped,
  CASE WHEN abs(k1 - k2) <= 2 THEN 'tie' WHEN k1 > k2 THEN 'model_a' ELSE 'model_b' END AS winner FROM ev WHERE model_b IS NOT NULL AND model_a <> model_b)"""
JUDGMENTS = (
    RECORDS
    + f""",
shown AS (SELECT r.*, k.judge, o.a_first, CASE WHEN o.a_first <> r.swapped THEN 1 ELSE -1 END AS display_order,
  CAST('0x' || substr(md5(r.record_id || '|' || k.judge || '|' || CASE WHEN o.a_first THEN '1' ELSE '0' END), 1, 7) AS BIGINT) AS u
  FROM records r, (VALUES (0),(1),(2),(3),(4),(5)) k(judge), (VALUES (true),(false)) o(a_first) WHERE k.judge <> 4 OR o.a_first OR r.record_id % 3 = 0),
judgments AS (SELECT *, CASE WHEN judge = 5 AND u % 20 < 12 OR u % 20 = 0 THEN 'tie'
  WHEN u / 268435456.0::DOUBLE < 1 / (1 + exp(-((CASE judge WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 WHEN 2 THEN 1.1 ELSE 1.2 END)::DOUBLE * ({MU_I} - {MU_J}) + display_order * (CASE judge WHEN 0 THEN 0.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 ELSE -0.4 END)::DOUBLE))) THEN 'i' ELSE 'j' END AS verdict FROM shown)"""
)
CANONICAL = (
    JUDGMENTS
    + """,
canon AS (SELECT record_id, judge, item_i, item_j, CASE verdict WHEN 'i' THEN item_i WHEN 'j' THEN item_j END AS outcome, display_order,
  CASE winner WHEN 'model_a' THEN model_a WHEN 'model_b' THEN model_b END AS human_outcome, swapped,
  CASE WHEN verdict = 'tie' THEN NULL ELSE (verdict = 'i') = (display_order = 1) END AS chose_first, verdict NOT IN ('i','j') AS judge_tie, winner IN ('model_a','model_b') AS human_decisive FROM judgments)"""
)
PANEL = (
    CANONICAL
    + """,
ties AS (SELECT judge, avg(judge_tie::INT) AS tie_rate FROM canon GROUP BY 1),
cover AS (SELECT judge, sum(b)::DOUBLE / (SELECT count(DISTINCT record_id) FROM canon) AS coverage FROM (SELECT judge, record_id, (count(DISTINCT display_order) = 2)::INT AS b FROM canon GROUP BY 1, 2) GROUP BY 1),
judges AS (SELECT judge, CAST(dense_rank() OVER (ORDER BY judge) - 1 AS INT) AS k FROM ties JOIN cover USING (judge) WHERE tie_rate <= 0.5 AND coverage >= 0.5),
items AS (SELECT item, CAST(dense_rank() OVER (ORDER BY item) - 1 AS INT) AS idx FROM (SELECT item_i AS item FROM canon UNION SELECT item_j FROM canon)),
llm AS (SELECT c.record_id, j.k, a.idx AS i, b.idx AS j, CASE WHEN c.outcome = c.item_i THEN 2 ELSE 0 END AS y2, c.display_order AS a
  FROM canon c JOIN judges j USING (judge) JOIN items a ON a.item = c.item_i JOIN items b ON b.item = c.item_j WHERE NOT c.judge_tie),
human AS (SELECT r.record_id, a.idx AS i, b.idx AS j, CASE WHEN (r.winner = 'model_a') = (r.model_a = r.item_i) THEN 2 ELSE 0 END AS y2
  FROM records r JOIN items a ON a.item = r.item_i JOIN items b ON b.item = r.item_j WHERE r.winner <> 'tie')"""
)


def query(sql: str | None = None, base: str = "", name: str = "") -> Callable:
    """Registers a query under its function's name; sql gives the same rows, base names the common tables it starts from."""

    def put(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = f"WITH RECURSIVE {base} {sql}" if base else sql
        return f

    return put
