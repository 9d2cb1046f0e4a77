"""Scans, projections, filters, joins, counts, samples and evaluation as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tokens, verdicts
from ..operators import collect
from ..operators import metrics, ordered
from ..operators import panel as P
from ..operators import sampling as X
from ..operators.lineage import cut, scratch
from ..sources import fixture as fx
from ..sources.readers import read_responses
from .base import CANONICAL, JUDGMENTS, MU_SQL, PANEL, RECORDS, query

R6 = lambda c: F.round(c, 6)
_cols = lambda df, *c: df.select(*c)


def canon(spark: SparkSession, sf: str) -> DataFrame:
    return P.canonical(fx.judgments(spark, sf))


def llm(spark: SparkSession, sf: str) -> DataFrame:
    """Coded rows; the canonical table, which judges, items and rows are all taken from, is written once."""
    return P.llm_rows(cut(canon(spark, sf)))


def human(spark: SparkSession, sf: str) -> DataFrame:
    return P.human_rows(cut(canon(spark, sf)))


def mu(spark: SparkSession) -> DataFrame:
    """The true scores by item index; five rows."""
    return spark.createDataFrame([(n, k, v) for n, (k, v) in enumerate(sorted(fx.MU.items()))], "idx int, item string, s double")


def scored(rows: DataFrame, spark: SparkSession) -> DataFrame:
    m = mu(spark)
    return rows.join(F.broadcast(m.select(F.col("idx").alias("i"), F.col("s").alias("s_i"))), "i").join(F.broadcast(m.select(F.col("idx").alias("j"), F.col("s").alias("s_j"))), "j")


# -- scans -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, event_id AS file_row FROM events WHERE event_id >= 100 AND event_id < 350")
def scan_slice(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", "event_type", F.col("_metadata.row_index").alias("file_row")).where("file_row >= 100 and file_row < 350")


@query("SELECT count(*) AS n_rows, count(DISTINCT event_id) AS n_ids FROM events")
def dataset_rowcount(spark, sf):
    return fx.table(spark, sf, "events").agg(F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_ids"))


@query("SELECT record_id, judge, item_i, item_j, outcome, display_order, human_outcome, swapped, chose_first, judge_tie, human_decisive FROM canon", CANONICAL)
def canonical(spark, sf):
    return canon(spark, sf)


@query("SELECT DISTINCT record_id, judge, display_order FROM canon WHERE outcome IS NOT NULL", CANONICAL)
def resume_keys(spark, sf):
    return canon(spark, sf).where("outcome is not null").select("record_id", "judge", "display_order").distinct()


@query("SELECT r.record_id, k.judge, o.a_first FROM records r, (VALUES (0),(1),(2),(3),(4),(5)) k(judge), (VALUES (true),(false)) o(a_first) WHERE NOT EXISTS (SELECT 1 FROM canon c WHERE c.record_id = r.record_id AND c.judge = k.judge AND c.outcome IS NOT NULL AND (c.display_order = 1) = (o.a_first <> r.swapped))", CANONICAL)
def resume_anti(spark, sf):
    jobs = fx.records(spark, sf).select("record_id", "swapped", F.explode(F.array(*map(F.lit, fx.GAMMA))).alias("judge")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("a_first"))
    jobs = jobs.withColumn("display_order", F.when(F.col("a_first") != F.col("swapped"), 1).otherwise(-1))
    return jobs.join(resume_keys(spark, sf), ["record_id", "judge", "display_order"], "left_anti").select("record_id", "judge", "a_first")


@query("SELECT record_id, a_first, CASE WHEN a_first THEN 'forward' ELSE 'reversed' END AS condition FROM records, (VALUES (true),(false)) o(a_first)", RECORDS)
def job_grid(spark, sf):
    both = spark.createDataFrame([(True, "forward"), (False, "reversed")], "a_first boolean, condition string")
    return fx.records(spark, sf).select("record_id").crossJoin(F.broadcast(both))


# -- projections -----------------------------------------------------------------------------------------------------


@query("SELECT record_id, item_i, item_j, swapped FROM records", RECORDS)
def canonical_pair(spark, sf):
    return fx.records(spark, sf).select("record_id", "item_i", "item_j", "swapped")


@query("SELECT record_id, judge, a_first, display_order FROM judgments", JUDGMENTS)
def display_order(spark, sf):
    return fx.judgments(spark, sf).select("record_id", "judge", "a_first", S.display_order(F.col("a_first"), F.col("swapped")).alias("display_order"))


@query("SELECT record_id, CASE winner WHEN 'model_a' THEN model_a WHEN 'model_b' THEN model_b END AS human_item FROM records", RECORDS)
def side_to_item(spark, sf):
    return fx.records(spark, sf).select("record_id", S.side_to_item(F.col("winner"), F.col("model_a"), F.col("model_b")).alias("human_item"))


@query("SELECT record_id, judge, display_order, chose_first FROM canon", CANONICAL)
def chose_first(spark, sf):
    return canon(spark, sf).select("record_id", "judge", "display_order", "chose_first")


@query("SELECT record_id, judge, display_order, judge_tie, human_decisive FROM canon", CANONICAL)
def tie_flags(spark, sf):
    return canon(spark, sf).select("record_id", "judge", "display_order", "judge_tie", "human_decisive")


@query("SELECT part.p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'thinking' END AS state, CASE p_partkey % 3 WHEN 1 THEN 'high' END AS effort FROM part")
def reasoning_state(spark, sf):
    mode = F.when(F.col("p_partkey") % 3 == 0, '{"reasoning":{"mode":"disabled"}}').when(F.col("p_partkey") % 3 == 1, '{"reasoning":{"mode":"enabled","effort":"high"}}').otherwise("{}")
    return fx.table(spark, sf, "part").select("p_partkey", S.reasoning_state(mode).alias("state"), F.get_json_object(mode, "$.reasoning.effort").alias("effort"))


@query("SELECT record_id, k, i, j, y2, a FROM llm", PANEL, "llm_rows")
@query("SELECT record_id, k, i, j, y2, a FROM llm", PANEL, "panel_llm")
def llm_rows(spark, sf):
    return llm(spark, sf)


@query("SELECT c.record_id, j.k, a.idx AS i, b.idx AS j, CASE WHEN c.judge_tie THEN 1 WHEN c.outcome = c.item_i THEN 2 ELSE 0 END AS y2, c.display_order AS a FROM canon c JOIN judges j USING (judge) JOIN items a ON a.item = c.item_i JOIN items b ON b.item = c.item_j", PANEL)
def llm_rows_half_ties(spark, sf):
    """Ties kept as half a win."""
    return P.llm_rows(canon(spark, sf), "half")


@query("SELECT record_id, i, j, y2 FROM human", PANEL, "human_rows")
@query("SELECT record_id, i, j, y2 FROM human", PANEL, "panel_human")
def human_rows(spark, sf):
    return human(spark, sf)


@query("SELECT r.record_id, a.idx AS i, b.idx AS j, CASE WHEN r.winner = 'tie' THEN 1 WHEN (r.winner = 'model_a') = (r.model_a = r.item_i) THEN 2 ELSE 0 END AS y2 FROM records r JOIN items a ON a.item = r.item_i JOIN items b ON b.item = r.item_j", PANEL)
def human_rows_half_ties(spark, sf):
    return P.human_rows(canon(spark, sf), "half")


@query("SELECT record_id, judge, display_order, verdict FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY judge DESC, display_order DESC) AS r FROM judgments) WHERE r = 1", JUDGMENTS)
def first_per_record(spark, sf):
    """Of each record the row that comes first, whole; here in descending order of judge and display."""
    d = fx.judgments(spark, sf).select("record_id", "judge", "display_order", "verdict")
    return P.first_rows(d, ("record_id",), F.struct(-F.col("judge"), -F.col("display_order")))


#: Labels of a tie in the legacy tables.
TIES = ("tie", "tie (bothbad)")


@query("SELECT record_id, a.idx AS i, b.idx AS j, CASE WHEN label IN ('tie', 'tie (bothbad)') THEN 0.5 WHEN label = item_i THEN 1.0 ELSE 0.0 END::DOUBLE AS y, CASE WHEN swapped THEN -1 ELSE 1 END AS a FROM (SELECT *, CASE record_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'none of them' WHEN 2 THEN 'tie' WHEN 3 THEN 'tie (bothbad)' WHEN 4 THEN model_b ELSE model_a END AS label FROM records) r JOIN items a ON a.item = r.item_i JOIN items b ON b.item = r.item_j WHERE label IN ('tie', 'tie (bothbad)', model_a, model_b)", PANEL)
def row_to_comparison(spark, sf):
    """The legacy rule: the label names the preferred item or a tie; rows with no or an unknown label are dropped."""
    r = fx.records(spark, sf)
    at = F.col("record_id") % 7
    label = F.when(at == 0, None).when(at == 1, "none of them").when(at == 2, "tie").when(at == 3, "tie (bothbad)").when(at == 4, F.col("model_b")).otherwise(F.col("model_a"))
    return P.labelled_rows(r.withColumn("label", label), P.item_index(r), TIES)


@query("SELECT record_id, judge, CASE WHEN verdict = 'tie' THEN 'tie' WHEN (verdict = 'i') = (display_order = 1) THEN CASE WHEN a_first THEN 'model_a' ELSE 'model_b' END ELSE CASE WHEN a_first THEN 'model_b' ELSE 'model_a' END END AS canonical_verdict, a_first FROM judgments", JUDGMENTS)
def deswap(spark, sf):
    d = fx.judgments(spark, sf)
    first = F.when(F.col("display_order") == 1, "i").otherwise("j")
    choice = F.when(F.col("verdict") == "tie", "c").when(F.col("verdict") == first, "a").otherwise("b")
    sides = F.when(F.col("a_first"), F.struct(F.lit("model_a").alias("a"), F.lit("model_b").alias("b"))).otherwise(F.struct(F.lit("model_b").alias("a"), F.lit("model_a").alias("b")))
    return d.select("record_id", "judge", S.deswap(choice, sides["a"], sides["b"]).alias("canonical_verdict"), "a_first")


#: Replies and what the strict patterns read from them.
REPLIES = [("a 5", "a", 5), ("`b 3`", "b", 3), ("```c 9```", "c", 5), ("<choice>a</choice><confidence>4</confidence>", "a", 4), ("D  -2", "d", 1), ("The answer is a 5", None, None), ("", None, None), ("e 3", None, None), ("b 3 4", None, None), ("<choice> b <confidence> 2 </choice>", "b", 2), ("a 99999999999999999999", "a", 5), ("a -99999999999999999999", "a", 1), ("c +0000000000003", "c", 3), ("a-3", None, None), ("<choice>a</choice> 4", None, None)]
_VERDICTS = ", ".join(f"({k}, {'NULL' if c is None else repr(c)}, {'NULL' if n is None else n})" for k, (_, c, n) in enumerate(REPLIES))


@query(f"SELECT r.record_id, v.choice, CAST(v.confidence AS INT) AS confidence FROM records r JOIN (VALUES {_VERDICTS}) v(id, choice, confidence) ON r.record_id % {len(REPLIES)} = v.id", RECORDS)
def parse_verdict(spark, sf):
    reply = F.element_at(F.array(*(F.lit(t) for t, _, _ in REPLIES)), (F.col("record_id") % len(REPLIES) + 1).cast("int"))
    choice, confidence = verdicts.strict_verdict(reply)
    return fx.records(spark, sf).select("record_id", choice.alias("choice"), confidence.alias("confidence"))


@query("SELECT p_partkey, p_name AS inner_text FROM part")
def strip_code_span(spark, sf):
    tick = F.element_at(F.array(F.lit(""), F.lit("`"), F.lit("```")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return fx.table(spark, sf, "part").select("p_partkey", verdicts.strip_code_span(F.concat(tick, F.col("p_name"), tick)).alias("inner_text"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE winner IN ('model_a','model_b','tie','both_bad') AND trim(model_a) <> '' AND trim(model_b) <> '') AS n_valid FROM records", RECORDS)
def validate_records(spark, sf):
    ok = F.col("winner").isin("model_a", "model_b", "tie", "both_bad") & (F.trim("model_a") != "") & (F.trim("model_b") != "")
    return fx.records(spark, sf).agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_valid"))


@query("SELECT record_id, 'Compare ' || model_a || ' with ' || model_b || '.' AS prompt, sha256('Compare ' || model_a || ' with ' || model_b || '.') AS prompt_hash FROM records", RECORDS)
def render_prompt(spark, sf):
    text = F.lit("Compare $a with $b.")
    for name in ("a", "b"):
        text = F.replace(text, F.lit(f"${name}"), F.col(f"model_{name}"))
    return fx.records(spark, sf).select("record_id", text.alias("prompt"), F.sha2(text, 256).alias("prompt_hash"))


@query("SELECT record_id, a_first, CASE WHEN a_first THEN model_a ELSE model_b END AS side_a, CASE WHEN a_first THEN model_b ELSE model_a END AS side_b FROM records, (VALUES (true),(false)) o(a_first)", RECORDS)
def build_messages(spark, sf):
    d = fx.records(spark, sf).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("a_first"))
    sides = F.when(F.col("a_first"), F.struct(F.col("model_a").alias("a"), F.col("model_b").alias("b"))).otherwise(F.struct(F.col("model_b").alias("a"), F.col("model_a").alias("b")))
    return d.select("record_id", "a_first", sides["a"].alias("side_a"), sides["b"].alias("side_b"))


@query("""SELECT n_nationkey, substr(sha256('{"name":"' || n_name || '","region":' || n_regionkey || '}'), 1, 16) AS fingerprint FROM nation""")
def fingerprint(spark, sf):
    return fx.table(spark, sf, "nation").select("n_nationkey", S.fingerprint(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))).alias("fingerprint"))


@query("""SELECT record_id, judge, a_first, substr(sha256('[' || record_id || ',' || judge || ',' || a_first || ']'), 1, 32) AS request_key FROM judgments""", JUDGMENTS)
def request_key(spark, sf):
    key = F.concat(F.lit("["), F.concat_ws(",", F.col("record_id").cast("string"), F.col("judge").cast("string"), F.col("a_first").cast("string")), F.lit("]"))
    return fx.judgments(spark, sf).select("record_id", "judge", "a_first", S.fingerprint(key, 32).alias("request_key"))


@query(r"SELECT doc_id, CAST(ceil(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / 4.0) + strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 32 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query(name="token_estimate_bpe")
def token_estimate_bpe(spark, sf):
    """Tokens of every text by a public byte-level vocabulary, beside the estimate without one."""
    import public_tokenizers

    text = F.col("text")
    return fx.table(spark, sf, "documents").select("doc_id", tokens.bpe_tokens(text, public_tokenizers.path("byte_bpe_50k.json")).alias("tokens"), S.token_estimate(text).alias("estimate"))


#: status, message, fault, category, may be tried again, ends the account
FAILURES = [
    (429, "slow down", None, "rate_limit", True, False), (429, "Daily  quota reached", None, "quota_exhausted", False, False), (401, "no", None, "authentication", False, True), (403, "no", None, "authentication", False, True),
    (503, "down", None, "server", True, False), (418, "tea", None, "invalid_request", False, False), (0, "eh", None, "unknown", False, False), (408, "late", None, "timeout", True, False), (409, "conflict", None, "timeout", True, False),
    (425, "early", None, "timeout", True, False), (400, "insufficient_quota", None, "invalid_request", False, False), (None, "reset", "network", "network", True, False), (200, "no verdict", "invalid_response", "invalid_response", True, False),
    (None, None, "timeout", "timeout", True, False), (400, "Enqueued tokens per model: 9", None, "quota_exhausted", False, False),
]
_FAILED = ", ".join(f"({k}, '{f[3]}', {str(f[4]).lower()}, {str(f[5]).lower()})" for k, f in enumerate(FAILURES))
_FAILED = f"part JOIN (VALUES {_FAILED}) v(id, category, retryable, disables) ON p_partkey % {len(FAILURES)} = v.id"


def failed(spark, sf):
    at = (F.col("p_partkey") % len(FAILURES) + 1).cast("int")
    pick = lambda n, kind: F.element_at(F.array(*(F.lit(f[n]).cast(kind) for f in FAILURES)), at)
    return fx.table(spark, sf, "part").select("p_partkey", S.error_category(pick(0, "int"), pick(1, "string"), pick(2, "string")).alias("category"))


@query(f"SELECT p_partkey, v.category FROM {_FAILED}")
def error_category(spark, sf):
    return failed(spark, sf)


@query(f"SELECT p_partkey, v.retryable, v.disables AS disables_account FROM {_FAILED}")
def retryable(spark, sf):
    """Whether a failed request may be tried again, and whether its account is of no use any more."""
    return failed(spark, sf).select("p_partkey", S.retryable(F.col("category")).alias("retryable"), S.disables_account(F.col("category")).alias("disables_account"))


#: header, message, category, seconds
WAITS = [
    ("7.5", "x", "rate_limit", 7.5), ("-3", "x", "rate_limit", 0.0), ("soon", "x", "rate_limit", 60.0), (None, "x", "server", None), (None, "quota will be replenished in 01:02:03", "quota_exhausted", 3723.0),
    (None, "Quota will be  replenished in 2.00:01:01", "quota_exhausted", 172861.0), (None, "quota will be replenished in 2 days, 00:01:01", "quota_exhausted", 172861.0), (None, "quota will be replenished in 01:02:03", "server", None),
    (None, "Please retry in 3.25s.", "rate_limit", 3.25), (None, '{"@type": "type.googleapis.com/google.rpc.RetryInfo", "retryDelay": "12.5s"}', "rate_limit", 12.5),
    (None, '{"@type": "google.rpc.RetryInfo", "retryDelay": {"seconds": 4, "nanos": 500000000}}', "rate_limit", 4.5), (None, None, "rate_limit", 60.0),
]
_WAITED = ", ".join(f"({k}, {'NULL' if w[3] is None else w[3]}::DOUBLE)" for k, w in enumerate(WAITS))


@query(f"SELECT p_partkey, v.seconds FROM part JOIN (VALUES {_WAITED}) v(id, seconds) ON p_partkey % {len(WAITS)} = v.id")
def retry_wait(spark, sf):
    """How long to wait after a failed request, by its header, message and category."""
    at = (F.col("p_partkey") % len(WAITS) + 1).cast("int")
    pick = lambda n: F.element_at(F.array(*(F.lit(w[n]).cast("string") for w in WAITS)), at)
    return fx.table(spark, sf, "part").select("p_partkey", S.retry_after(pick(0), pick(1), pick(2)).alias("seconds"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN p_partkey WHEN 1 THEN 3723 WHEN 2 THEN 2 * 86400 + 61 END AS DOUBLE) AS seconds FROM part")
def retry_after(spark, sf):
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("s"))).when(F.col("p_partkey") % 4 == 1, "01:02:03").when(F.col("p_partkey") % 4 == 2, "2 days, 00:01:01").otherwise("soon")
    return fx.table(spark, sf, "part").select("p_partkey", S.retry_seconds(text).alias("seconds"))


@query("SELECT event_id, round(greatest(value, 0) + ln(1 + exp(-abs(value))), 6) AS softplus FROM events")
def softplus(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", R6(S.softplus(F.col("value"))).alias("softplus"))


_GAMMA = "(VALUES (0,0.7::DOUBLE,0.5::DOUBLE),(1,1.0,-0.5),(2,1.1,0.3),(3,1.2,-0.3)) g(k,gamma,u)"
_V = "(VALUES (0,1.0::DOUBLE),(1,0.5),(2,1.0),(3,-0.1),(4,-2.4)) v(idx,v)"


def factors(spark):
    return spark.createDataFrame([(0, 0.7, 0.5), (1, 1.0, -0.5), (2, 1.1, 0.3), (3, 1.2, -0.3)], "k int, gamma double, u double"), spark.createDataFrame([(0, 1.0), (1, 0.5), (2, 1.0), (3, -0.1), (4, -2.4)], "idx int, v double")


@query("SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS centred FROM events")
def center(spark, sf):
    """By a mean per type that is aggregated first: no type's rows go through one task."""
    events = fx.table(spark, sf, "events").select("event_id", "event_type", "value")
    return events.join(events.groupBy("event_type").agg(F.avg("value").alias("mean")), "event_type").select("event_id", R6(F.col("value") - F.col("mean")).alias("centred"))


@query("SELECT judge, round(avg(x), 6) AS inconsistency FROM (SELECT judge, record_id, (count(DISTINCT outcome) > 1)::INT AS x FROM canon WHERE outcome IS NOT NULL GROUP BY 1, 2) GROUP BY 1", CANONICAL)
def swap_inconsistency(spark, sf):
    one = canon(spark, sf).where("outcome is not null").groupBy("judge", "record_id").agg((F.min("outcome") != F.max("outcome")).cast("int").alias("x"))
    return one.groupBy("judge").agg(R6(F.avg("x")).alias("inconsistency"))


# -- panel -----------------------------------------------------------------------------------------------------------


@query("SELECT judge, k FROM judges", PANEL)
def panel_judges(spark, sf):
    return P.panel_judges(canon(spark, sf))


@query("SELECT judge, round(tie_rate, 6) AS tie_rate FROM ties", PANEL)
def tie_rate(spark, sf):
    return P.tie_rate(canon(spark, sf)).select("judge", R6("tie_rate").alias("tie_rate"))


@query("SELECT judge, round(coverage, 6) AS coverage FROM cover", PANEL)
def coverage(spark, sf):
    return P.coverage(canon(spark, sf)).select("judge", R6("coverage").alias("coverage"))


@query("SELECT item, idx FROM items", PANEL)
def item_index(spark, sf):
    return P.item_index(canon(spark, sf))


@query("SELECT c.record_id, c.judge, a.idx AS i, b.idx AS j FROM canon c JOIN items a ON a.item = c.item_i JOIN items b ON b.item = c.item_j", PANEL)
def index_join(spark, sf):
    c = canon(spark, sf)
    it = P.item_index(c)
    return c.join(it.withColumnsRenamed({"item": "item_i", "idx": "i"}), "item_i").join(it.withColumnsRenamed({"item": "item_j", "idx": "j"}), "item_j").select("record_id", "judge", "i", "j")


@query("SELECT c.record_id, c.judge, c.display_order, r.model_a, r.winner FROM canon c JOIN records r USING (record_id)", CANONICAL)
def resp_bench(spark, sf):
    return canon(spark, sf).join(fx.records(spark, sf).select("record_id", "model_a", "winner"), "record_id").select("record_id", "judge", "display_order", "model_a", "winner")


@query("SELECT record_id, CASE k WHEN 3 THEN 0 ELSE 1 END AS k, i, j, y2, a FROM llm WHERE k IN (3, 1)", PANEL)
def restrict_panel(spark, sf):
    new = spark.createDataFrame([(3, 0), (1, 1)], "k int, new_k int")
    return llm(spark, sf).join(F.broadcast(new), "k").select("record_id", F.col("new_k").alias("k"), "i", "j", "y2", "a")


@query("SELECT record_id, CASE k WHEN 1 THEN 0 ELSE 1 END AS k, i, j, y2, a FROM llm WHERE k IN (1, 3)", PANEL)
def drop_empty(spark, sf):
    return P.drop_empty(llm(spark, sf).where("k in (1, 3)")).select("record_id", "k", "i", "j", "y2", "a")


@query("SELECT count(*) FILTER (WHERE i >= j) AS n_bad, count(*) FILTER (WHERE y2 NOT IN (0,1,2)) AS n_bad_y FROM llm", PANEL)
def contract_check(spark, sf):
    return P.contract_check(llm(spark, sf))


@query("SELECT doc_id, lang IS NOT DISTINCT FROM 'en' AS english FROM documents")
def lang_subset(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.col("lang").eqNullSafe("en").alias("english"))


@query("SELECT a.item AS item_i, b.item AS item_j FROM items a JOIN items b ON a.idx < b.idx", PANEL)
def all_pairs(spark, sf):
    it = P.item_index(canon(spark, sf))
    a, b = it.select(F.col("item").alias("item_i"), F.col("idx").alias("x")), it.select(F.col("item").alias("item_j"), F.col("idx").alias("y"))
    return a.join(b, F.col("x") < F.col("y")).select("item_i", "item_j")


# -- counts ----------------------------------------------------------------------------------------------------------


@query("SELECT k, i, j, count(*) AS n, CAST(sum(y2) AS BIGINT) AS y2 FROM llm GROUP BY ALL", PANEL, "collapse_order")
@query("SELECT k, i, j, count(*) AS n, CAST(sum(y2) AS BIGINT) AS y2 FROM llm GROUP BY ALL", PANEL)
def counts_kij(spark, sf):
    return P.counts(llm(spark, sf), "k", "i", "j")


@query("SELECT k, i, j, a, count(*) AS n, CAST(sum(y2) AS BIGINT) AS y2 FROM llm GROUP BY ALL", PANEL)
def counts_kija(spark, sf):
    return P.counts(llm(spark, sf), "k", "i", "j", "a")


@query("SELECT i, j, count(*) AS n, CAST(sum(y2) AS BIGINT) AS y2 FROM llm GROUP BY ALL", PANEL)
def pool_pairs(spark, sf):
    return P.counts(llm(spark, sf), "i", "j")


@query("SELECT i, j, count(*) AS n, CAST(sum(y2) AS BIGINT) AS y2 FROM llm WHERE k = 2 GROUP BY ALL", PANEL)
def judge_pairs(spark, sf):
    return P.counts(llm(spark, sf).where("k = 2"), "i", "j")


@query("SELECT i, j, CAST(t.pos AS INT) AS pos, CASE WHEN t.pos < y2 / 2 THEN 1.0::DOUBLE ELSE 0.0 END AS z FROM (SELECT i, j, count(*) AS n, sum(y2) AS y2 FROM human GROUP BY ALL) h, LATERAL (SELECT unnest(range(n)) AS pos) t", PANEL)
def expand_pairs(spark, sf):
    return P.expand_pairs(P.counts(human(spark, sf), "i", "j"))


@query("SELECT (SELECT count(*) FROM llm) AS n_l, (SELECT count(*) FROM human) AS n_h, (SELECT round(avg((a = 1)::INT), 6) FROM llm) AS first_share", PANEL)
def totals(spark, sf):
    a = llm(spark, sf).agg(F.count("*").alias("n_l"), R6(F.avg((F.col("a") == 1).cast("int"))).alias("first_share"))
    return a.crossJoin(human(spark, sf).agg(F.count("*").alias("n_h"))).select("n_l", "n_h", "first_share")


@query("SELECT winner, count(*) AS n FROM records GROUP BY ALL", RECORDS)
def label_hist(spark, sf):
    return fx.records(spark, sf).groupBy("winner").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_records, count(DISTINCT item_i || '|' || item_j) AS n_pairs, count(*) FILTER (WHERE winner = 'tie') AS n_ties, (SELECT count(*) FROM canon) AS n_judgments, (SELECT count(DISTINCT judge) FROM canon) AS n_judges, (SELECT min(n) FROM cells) AS min_cell, (SELECT max(n) FROM cells) AS max_cell, (SELECT round(avg(n), 6) FROM cells) AS mean_cell, (SELECT round(min(tie_rate), 6) FROM ties) AS min_tie, (SELECT round(max(tie_rate), 6) FROM ties) AS max_tie FROM records", PANEL + ", cells AS (SELECT count(*) AS n FROM canon GROUP BY judge, item_i, item_j, display_order)")
def dataset_stats(spark, sf):
    r, c = fx.records(spark, sf), canon(spark, sf)
    a = r.agg(F.count("*").alias("n_records"), F.count_distinct("item_i", "item_j").alias("n_pairs"), F.count_if(F.col("winner") == "tie").alias("n_ties"))
    cells = c.groupBy("judge", "item_i", "item_j", "display_order").agg(F.count("*").alias("n"))
    b = cells.agg(F.sum("n").alias("n_judgments"), F.count_distinct("judge").alias("n_judges"), F.min("n").alias("min_cell"), F.max("n").alias("max_cell"), R6(F.avg("n")).alias("mean_cell"))
    t = P.tie_rate(c).agg(R6(F.min("tie_rate")).alias("min_tie"), R6(F.max("tie_rate")).alias("max_tie"))
    return a.crossJoin(b).crossJoin(t)


# -- samples ---------------------------------------------------------------------------------------------------------

_RANKED = RECORDS + ", ranked AS (SELECT record_id, row_number() OVER (ORDER BY md5('s7|' || record_id), record_id) AS r, count(*) OVER () AS n FROM records)"
_U = "CAST('0x' || substr(md5({0}), 1, 7) AS BIGINT) / 268435456.0::DOUBLE"
_PRANK = PANEL + ", ranked AS (SELECT record_id, row_number() OVER (ORDER BY md5('s7|' || record_id), record_id) AS r, count(*) OVER () AS n FROM records)"


@query("SELECT record_id, r <= round_even(n * 0.3, 0) AS test FROM ranked", _RANKED, "split_rows_legacy")
@query("SELECT record_id, r <= round_even(n * 0.3, 0) AS test FROM ranked", _RANKED)
def split_records(spark, sf):
    return X.split_records(fx.records(spark, sf), 0.3, "s7")


@query("SELECT h.record_id, h.i, h.j, h.y2 FROM human h JOIN ranked USING (record_id) WHERE r <= round_even(n * 0.3, 0)", _PRANK)
def split_rows(spark, sf):
    test = X.split_records(fx.records(spark, sf), 0.3, "s7").where("test")
    return human(spark, sf).join(test, "record_id", "left_semi")


@query("SELECT record_id, i, j, y2 FROM human ORDER BY md5('d3|' || record_id), record_id LIMIT 80", PANEL, "draw_budget")
def draw_budget(spark, sf):
    return X.draw(human(spark, sf), 80, "d3", "record_id")


@query("SELECT record_id, k, i, j, y2, a FROM llm ORDER BY md5('d4|' || record_id || '|' || k || '|' || a), record_id, k, a LIMIT 400", PANEL)
def subsample(spark, sf):
    return X.draw(llm(spark, sf), 400, "d4", "record_id", "k", "a")


@query("SELECT record_id, row_number() OVER (ORDER BY md5('d5|' || record_id), record_id) > 80 AS held_out FROM human", PANEL)
def sample_holdout(spark, sf):
    h = human(spark, sf)
    return h.join(X.draw(h, 80, "d5", "record_id").select("record_id", F.lit(False).alias("out")), "record_id", "left").select("record_id", F.coalesce("out", F.lit(True)).alias("held_out"))


@query(f"SELECT record_id, k, i, j, y2, a FROM llm WHERE a = 1 OR {_U.format(chr(39) + 't1|' + chr(39) + ' || record_id || ' + chr(39) + '|' + chr(39) + ' || k')} < 0.2", PANEL)
def thin_order(spark, sf):
    return X.thin_order(llm(spark, sf), 0.2, "t1")


@query("SELECT k, a, count(*) AS n, CAST(sum(y2) AS BIGINT) AS y2 FROM (SELECT k, a, y2 FROM llm UNION ALL SELECT 4 + m, a, 2 - y2 FROM llm, (VALUES (0),(1)) t(m) WHERE k = m) GROUP BY ALL", PANEL)
def inject_anti(spark, sf):
    return P.counts(X.inject(llm(spark, sf), "anti", 2, "n1", 4), "k", "a")


_NOISE = "SELECT k, a, count(*) AS n, CAST(sum(y2) AS BIGINT) AS y2 FROM (SELECT k, a, y2 FROM llm UNION ALL SELECT k2, a2, CASE WHEN {0} THEN 2 ELSE 0 END FROM (SELECT *, " + _U.format("'n1|' || record_id || '|' || k2 || '|' || a2") + " AS u FROM (SELECT DISTINCT record_id FROM llm), (VALUES (4),(5)) t(k2), (VALUES (-1),(1)) o(a2))) GROUP BY ALL"


@query(_NOISE.format("(u < 0.9) = (a2 = 1)"), PANEL)
def inject_position(spark, sf):
    return P.counts(X.inject(llm(spark, sf), "position", 2, "n1", 4), "k", "a")


@query(_NOISE.format("u < 0.5"), PANEL)
def inject_random(spark, sf):
    return P.counts(X.inject(llm(spark, sf), "random", 2, "n1", 4), "k", "a")


@query("SELECT k, a, count(*) AS n, CAST(sum(CASE WHEN " + _U.format("'m1|' || record_id || '|' || k || '|' || a") + " < 0.25 THEN CASE WHEN a = 1 THEN 2 ELSE 0 END ELSE y2 END) AS BIGINT) AS y2 FROM llm GROUP BY ALL", PANEL)
def amplify(spark, sf):
    return P.counts(X.amplify(llm(spark, sf), 0.25, "m1"), "k", "a")


# -- evaluation ------------------------------------------------------------------------------------------------------

_SCORED = PANEL + f", mu AS (SELECT * FROM {MU_SQL}), sc AS (SELECT h.*, a.s - b.s AS d FROM human h JOIN mu a ON a.idx = h.i JOIN mu b ON b.idx = h.j), est AS (SELECT mu.idx, mu.s, w.e FROM mu JOIN (SELECT idx, sum(w)::DOUBLE AS e FROM (SELECT i AS idx, y2 - 1 AS w FROM human UNION ALL SELECT j, 1 - y2 FROM human) GROUP BY 1) w USING (idx))"


def estimate(spark, sf):
    """Net human wins by item, next to the true score."""
    h = human(spark, sf)
    net = h.select(F.col("i").alias("idx"), (F.col("y2") - 1).alias("w")).unionAll(h.select(F.col("j").alias("idx"), (1 - F.col("y2")).alias("w"))).groupBy("idx").agg(F.sum("w").cast("double").alias("e"))
    return mu(spark).join(net, "idx").select("idx", "s", "e")


@query("SELECT round(avg(((d > 0)::INT = y2 / 2)::INT), 6) AS accuracy, count(*) AS n FROM sc", _SCORED)
def score_acc(spark, sf):
    d = scored(human(spark, sf), spark)
    return d.agg(R6(F.avg(((F.col("s_i") > F.col("s_j")).cast("int") * 2 == F.col("y2")).cast("int"))).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT round(avg(CASE WHEN y2 = 2 THEN greatest(-d, 0) ELSE greatest(d, 0) END + ln(1 + exp(-abs(d)))), 6) AS logloss FROM sc", _SCORED)
def logloss(spark, sf):
    d = scored(human(spark, sf), spark)
    x = F.when(F.col("y2") == 2, F.col("s_j") - F.col("s_i")).otherwise(F.col("s_i") - F.col("s_j"))
    return d.agg(R6(F.avg(S.softplus(x))).alias("logloss"))


def item_pairs(df):
    a, b = df.select(*(F.col(c).alias(f"{c}_1") for c in df.columns)), df.select(*(F.col(c).alias(f"{c}_2") for c in df.columns))
    return a.join(b, F.col("idx_1") < F.col("idx_2"))


@query("SELECT round(avg((sign(a.s - b.s) = sign(a.e - b.e))::INT), 6) AS sign_accuracy FROM est a JOIN est b ON a.idx < b.idx", _SCORED)
def sign_acc(spark, sf):
    return ordered.kendall(estimate(spark, sf), "s", "e").select(R6("agree").alias("sign_accuracy"))


@query("SELECT round(sum(sign(a.s - b.s) * sign(a.e - b.e)) / sqrt(sum((a.s <> b.s)::INT) * sum((a.e <> b.e)::INT)), 6) AS tau_b FROM est a JOIN est b ON a.idx < b.idx", _SCORED)
def kendall(spark, sf):
    return ordered.kendall(estimate(spark, sf), "s", "e").select(R6("kendall").alias("tau_b"))


@query("SELECT round(corr(rs, re), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re FROM est)", _SCORED)
def spearman(spark, sf):
    return ordered.spearman(estimate(spark, sf), "s", "e").select(R6("spearman").alias("spearman"))


@query("SELECT round(avg((s - beta * e) * (s - beta * e)), 6) AS mse FROM (SELECT s - avg(s) OVER () AS s, e - avg(e) OVER () AS e FROM est), (SELECT covar_pop(s, e) / var_pop(e) AS beta FROM est)", _SCORED)
def mse_aligned(spark, sf):
    return estimate(spark, sf).agg(R6(F.var_pop("s") - F.pow(F.covar_pop("s", "e"), F.lit(2)) / F.var_pop("e")).alias("mse"))


@query("SELECT round(sum(CASE WHEN re < 3 THEN g / log2(re + 2) ELSE 0 END) / sum(CASE WHEN rs < 3 THEN g / log2(rs + 2) ELSE 0 END), 6) AS ndcg FROM (SELECT re, rs, pow(2, 4 - rs) - 1 AS g FROM (SELECT row_number() OVER (ORDER BY e DESC, idx) - 1 AS re, row_number() OVER (ORDER BY s DESC, idx) - 1 AS rs FROM est))", _SCORED)
def ndcg(spark, sf):
    return ordered.ndcg(estimate(spark, sf), "s", "e", "idx", k=3).select(R6("ndcg").alias("ndcg"))


@query("SELECT round(avg((abs(s - e / 1000) <= 0.5)::INT), 6) AS coverage, count(*) AS n FROM est", _SCORED)
def coverage95(spark, sf):
    e = F.col("e") / 1000
    return estimate(spark, sf).agg(R6(F.avg(F.col("s").between(e - 0.5, e + 0.5).cast("int"))).alias("coverage"), F.count("*").alias("n"))


@query(f"SELECT k, idx, round(gamma * e / 1000 + u * v, 6) AS score FROM {_GAMMA}, est JOIN {_V} USING (idx)", _SCORED)
def score_matrix(spark, sf):
    """Judges' scores of estimated items: gamma times the common score, and factors."""
    g, v = factors(spark)
    d = F.broadcast(g).join(estimate(spark, sf).join(v, "idx"), F.lit(True))  # four judges
    return d.select("k", "idx", R6(F.col("gamma") * F.col("e") / 1000 + F.aggregate(F.zip_with(F.array("u"), F.array("v"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).alias("score"))


@query(f"SELECT idx, round(1.2::DOUBLE * e / 1000 + 0.25::DOUBLE * v, 6) AS score FROM est JOIN {_V} USING (idx)", _SCORED)
def cal_score(spark, sf):
    return estimate(spark, sf).join(factors(spark)[1], "idx").select("idx", R6(1.2 * F.col("e") / 1000 + 0.25 * F.col("v")).alias("score"))


@query("SELECT round(sum(ln(1 + exp(de)) - p0 * de) - sum(ln(1 + exp(1.2 * d)) - p0 * 1.2 * d), 6) AS excess FROM (SELECT a.s - b.s AS d, (a.e - b.e) / 1000 AS de, 1 / (1 + exp(-1.2 * (a.s - b.s))) AS p0 FROM est a JOIN est b ON a.idx < b.idx)", _SCORED)
def pop_excess(spark, sf):
    """Population risk of an estimate above that of the true scores."""
    d, e = F.col("s_1") - F.col("s_2"), (F.col("e_1") - F.col("e_2")) / 1000
    p0 = S.sigmoid(1.2 * d)
    risk = lambda x: S.softplus(x) - p0 * x
    return item_pairs(estimate(spark, sf)).agg(R6(F.sum(risk(e)) - F.sum(risk(1.2 * d))).alias("excess"))


_EVALUATE = """SELECT round(mse, 6) AS mse, round(spearman, 6) AS spearman, round(ndcg, 6) AS ndcg, round(sign_accuracy, 6) AS sign_accuracy, round(kendall, 6) AS kendall, round(coverage, 6) AS coverage FROM
  (SELECT avg((s - beta * e) * (s - beta * e)) AS mse FROM (SELECT s - avg(s) OVER () AS s, e - avg(e) OVER () AS e FROM est), (SELECT covar_pop(s, e) / var_pop(e) AS beta FROM est)),
  (SELECT corr(rs, re) AS spearman FROM (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re FROM est)),
  (SELECT sum(CASE WHEN re < 3 THEN g / log2(re + 2) ELSE 0 END) / sum(CASE WHEN rs < 3 THEN g / log2(rs + 2) ELSE 0 END) AS ndcg FROM (SELECT re, rs, pow(2, 4 - rs) - 1 AS g FROM (SELECT row_number() OVER (ORDER BY e DESC, idx) - 1 AS re, row_number() OVER (ORDER BY s DESC, idx) - 1 AS rs FROM est))),
  (SELECT avg((sign(a.s - b.s) = sign(a.e - b.e))::INT) AS sign_accuracy, sum(sign(a.s - b.s) * sign(a.e - b.e)) / sqrt(sum((a.s <> b.s)::INT) * sum((a.e <> b.e)::INT)) AS kendall FROM est a JOIN est b ON a.idx < b.idx),
  (SELECT avg((abs(s - e / 1000) <= 0.5)::INT) AS coverage FROM est)"""


@query(_EVALUATE, _SCORED)
def evaluate_scores(spark, sf):
    """All measures of an estimate against the true scores."""
    e = estimate(spark, sf)
    true, est = e.select(F.col("idx").alias("item"), F.col("s").alias("score")), e.select(F.col("idx").alias("item"), F.col("e").alias("score"))
    ends = est.select("item", (F.col("score") / 1000 - 0.5).alias("lower"), (F.col("score") / 1000 + 0.5).alias("upper"))
    d = metrics.evaluate_scores(true, est, ends, k=3)
    return d.select(*(R6(c).alias(c) for c in ("mse", "spearman", "ndcg", "sign_accuracy", "kendall", "coverage")))


@query("SELECT round(avg((sign(a.s - b.s) = sign(a.e - b.e))::INT), 6) AS against_truth, (SELECT round(avg(((d > 0)::INT = y2 / 2)::INT), 6) FROM sc) AS against_records FROM est a JOIN est b ON a.idx < b.idx", _SCORED)
def human_sign_accuracy(spark, sf):
    """Of an estimate against true scores, and of the true scores against the records."""
    e = estimate(spark, sf)
    true, est = e.select(F.col("idx").alias("item"), F.col("s").alias("score")), e.select(F.col("idx").alias("item"), F.col("e").alias("score"))
    rows = human(spark, sf).select(F.col("i").alias("item_i"), F.col("j").alias("item_j"), (F.col("y2") / 2).alias("y"))
    return metrics.human_sign_accuracy(est, true).select(R6("sign_accuracy").alias("against_truth")).crossJoin(metrics.human_sign_accuracy(true, rows=rows).select(R6("sign_accuracy").alias("against_records")))


@query("SELECT r, c, round(sum(v), 6) AS value FROM (SELECT i, j, n * p * (1 - p) AS w FROM (SELECT i, j, count(*) AS n, 1 / (1 + exp(-any_value(d))) AS p FROM sc GROUP BY i, j)) q, LATERAL (VALUES (i, i, w), (j, j, w), (i, j, -w), (j, i, -w)) t(r, c, v) GROUP BY ALL", _SCORED)
def laplacian(spark, sf):
    p = S.sigmoid(F.col("s_i") - F.col("s_j"))
    cells = scored(P.counts(human(spark, sf), "i", "j"), spark).withColumn("w", F.col("n") * p * (1 - p))
    cell = lambda a, b, v: F.struct(F.col(a).alias("r"), F.col(b).alias("c"), v.alias("v"))
    w = F.col("w")
    return cells.select(F.inline(F.array(cell("i", "i", w), cell("j", "j", w), cell("i", "j", -w), cell("j", "i", -w)))).groupBy("r", "c").agg(R6(F.sum("v")).alias("value"))


@query("SELECT round(sum(CASE WHEN y2 = 2 THEN greatest(-d, 0) ELSE greatest(d, 0) END + ln(1 + exp(-abs(d)))), 4) AS nll FROM sc", _SCORED)
def btl_nll(spark, sf):
    d = scored(P.counts(human(spark, sf), "i", "j"), spark).withColumn("d", F.col("s_i") - F.col("s_j"))
    y = F.col("y2") / 2.0
    return d.agg(F.round(F.sum(y * S.softplus(-F.col("d")) + (F.col("n") - y) * S.softplus(F.col("d"))), 4).alias("nll"))


@query("SELECT round(sum(CASE WHEN y2 = 2 THEN ln(1 + exp(-eta)) ELSE ln(1 + exp(eta)) END), 4) AS nll FROM (SELECT y2, g * (x.s - y.s) + a * b AS eta FROM llm JOIN (VALUES (0, 0.7::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.3), (2, 1.1, 0.6), (3, 1.2, -0.4)) p(k, g, b) USING (k) JOIN mu x ON x.idx = llm.i JOIN mu y ON y.idx = llm.j)", _SCORED)
def nll(spark, sf):
    eta = fx.lookup(F.col("k"), {k: fx.GAMMA[k] for k in range(4)}) * (F.col("s_i") - F.col("s_j")) + F.col("a") * fx.lookup(F.col("k"), {k: fx.B[k] for k in range(4)})
    d = scored(P.counts(llm(spark, sf), "k", "i", "j", "a"), spark).withColumn("eta", eta)
    y = F.col("y2") / 2.0
    return d.agg(F.round(F.sum(y * S.softplus(-F.col("eta")) + (F.col("n") - y) * S.softplus(F.col("eta"))), 4).alias("nll"))


# -- collection ------------------------------------------------------------------------------------------------------


@query(name="stub_judge")
def stub_judge(spark, sf):
    """Jobs through the stub judge and the full reading of its replies."""
    return collect.stub_judge(build_messages(spark, sf)).withColumn("v", verdicts.full_verdict(F.col("raw_response"))).select("record_id", "a_first", "raw_response", "v.choice", "v.confidence")


@query(name="chunk_requests")
def chunk_requests(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("lang"), S.token_estimate(F.col("text")).alias("tokens"))
    return ordered.greedy_chunks(docs, "lang", "doc_id", 50, 20_000)


@query("SELECT record_id::VARCHAR AS id, 'judge_' || judge AS judge, CASE WHEN a_first THEN 'forward' ELSE 'swapped' END AS condition, verdict AS canonical_verdict, CAST(event_id % 5 + 1 AS INT) AS confidence FROM judgments JOIN events ON event_id = record_id WHERE record_id % 97 > 0", JUDGMENTS)
def jsonl_scan(spark, sf):
    """A log of all responses, written and read as files; every 97th record's lines are torn, as a killed writer leaves them."""
    rows = fx.judgments(spark, sf).select(
        F.col("record_id").cast("string").alias("id"), F.concat(F.lit("judge_"), F.col("judge").cast("string")).alias("judge"), F.when(F.col("a_first"), "forward").otherwise("swapped").alias("condition"),
        F.col("verdict").alias("canonical_verdict"), (F.col("record_id") % 5 + 1).cast("int").alias("confidence"), (F.col("record_id") % 97 == 0).alias("torn"),
    )
    line = F.to_json(F.struct("id", "judge", "condition", "canonical_verdict", "confidence"))
    path = scratch(spark, "responses")
    rows.select(F.when(F.col("torn"), F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    # Spark's own reader, as the log may lie in any store; see sources.log for logs that grow by commits.
    return read_responses(spark, path).select("id", "judge", "condition", "canonical_verdict", "confidence")
