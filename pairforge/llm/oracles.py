"""SQL for the queries that SQL can express whole. The others are tested against brute force: a tokeniser, extraction rules, trained scores and test statistics have no SQL form."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before = role THEN 10 ELSE 13 + length(role) + CASE WHEN before IS NULL THEN 0 ELSE 11 END END) + 11 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
win AS (SELECT doc_id, p, list_slice(w, p, p + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
least_doc AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM win JOIN least_doc USING (g), range(13) t(o) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, p, p + least(len(w), 4) - 1) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM edge UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, r.m), d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY 1) r ON r.x = d.doc_id"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
spot AS (SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
met AS (SELECT DISTINCT doc_id, p, n, item_id FROM spot JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM met) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
# Nodes of a tree, level by level, and the runs of its children.
_TREE = """
{0}node AS (SELECT 0 AS l, {1} AS g, p, h, n FROM {2} UNION ALL
  SELECT any_value(l) + 1, g, p // 16, sha256(string_agg(h, '' ORDER BY p)), (n + 15) // 16 FROM {0}node WHERE n > 1 GROUP BY g, p // 16, n),
{0}run AS (SELECT l, g, p // 16 AS q, list(h ORDER BY p) AS hs FROM {0}node WHERE n > 1 GROUP BY ALL)"""
_STEPS = """SELECT d.g AS own, d.p AS pos, {0} + l AS o, {{'l': array_to_string(list_slice(hs, 1, (x.p >> (4 * l)) % 16), ''), 'r': array_to_string(list_slice(hs, (x.p >> (4 * l)) % 16 + 2, 16), '')}} AS s
  FROM d JOIN {1} x ON x.{2} IS NOT DISTINCT FROM d.g {3} JOIN {4}run r ON r.g IS NOT DISTINCT FROM x.{5} AND r.q = x.p >> (4 * l + 4)"""

OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source AS g, {_LEAF.format("text")} AS h, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE h END AS seen,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),{_TREE.format("own_", "g", "d")},
sub AS (SELECT g, h, 0 AS one, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM own_node WHERE n = 1),{_TREE.format("top_", "0", "sub")},
step AS ({_STEPS.format(0, "d", "g", "AND x.p = d.p", "own_", "g")} UNION ALL {_STEPS.format(1000, "sub", "g", "", "top_", "one")}),
path AS (SELECT own, pos, list(s ORDER BY o) AS s FROM step GROUP BY ALL),
found AS (SELECT d.doc_id, d.h AS leaf, sub.h AS subroot, (SELECT h FROM top_node WHERE n = 1) AS root, seen, coalesce(path.s, []) AS s
  FROM d JOIN sub ON sub.g IS NOT DISTINCT FROM d.g LEFT JOIN path ON path.own IS NOT DISTINCT FROM d.g AND path.pos = d.p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(s, lambda x: x.l || x.r), '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': seen, 'r': ''}}, s), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root, folded_root = root AS verified FROM found"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""

OP13 = f"SELECT *, doc_id = component_id AS kept FROM ({OP5.replace('>= 85 *', '>= 80 *')})"

SQL = {"op11_merkle_manifest": OP11, "op12_hard_negatives": OP12, "op13_minhash_near_dedup": OP13, "op1_chat_formatting": OP1, "op2_exact_topk": OP2, "op4_substring_dedup": OP4, "op5_ngram_jaccard_join": OP5, "op10_decontamination": OP10}
