"""Manifest, hard negatives, signatures, and training on rare labels."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm import merkle, minhash, negatives, toxicity
from pairforge.llm.jaccard import shingle_sets

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -- 11 --------------------------------------------------------------------------------------------------------------


def manifest(df):
    return merkle.manifest(df, F.col("source"), F.col("doc_id"), [F.col(c) for c in FIELDS], {"doc_id": F.col("doc_id"), "row": F.col("row")})


def plain_manifest(rows):
    """row -> (leaf, subroot, root, siblings), level by level."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(hashes):
        paths, place = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for k, p in enumerate(place):
                run = hashes[p // 16 * 16 : p // 16 * 16 + 16]
                paths[k] += run[: p % 16] + run[p % 16 + 1 :]
            hashes, place = [H(*hashes[k : k + 16]) for k in range(0, len(hashes), 16)], [p // 16 for p in place]
        return hashes[0] if hashes else None, paths

    leaves = sorted(((r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, H(*(field(r[c]) for c in FIELDS)), r["row"]) for r in rows))
    groups = {}
    for x in leaves:
        groups.setdefault(x[:2], []).append(x)
    made = {g: tree([x[4] for x in xs]) for g, xs in groups.items()}
    root, tops = tree([made[g][0] for g in sorted(groups)])
    return {x[5]: (x[4], made[g][0], root, H(*made[g][1][k], *top)) for (g, xs), top in zip(sorted(groups.items()), tops, strict=True) for k, x in enumerate(xs)}


def documents(n, seed=3):
    rng = random.Random(seed)
    rows = [{"doc_id": k, "source": rng.choice(["hot"] * 4 + ["ä", "Z", "", None]), "lang": rng.choice(["en", None]), "n_chars": rng.choice([5, None]), "text": rng.choice([None, "", "Ab ß", "x" * 500])} for k in range(n)]
    rows += [rows[0]] * 40 + [{"doc_id": None, "source": "hot", "lang": None, "n_chars": None, "text": None}, {"doc_id": 7, "source": "alone", "lang": "de", "n_chars": 0, "text": "long " * 50_000}]
    return [r | {"row": k, "leaf": "clash", "g": "clash", "idx": 1} for k, r in enumerate(rows)]


@pytest.mark.parametrize("n", [0, 1, 17, 700])
def test_manifest_matches_its_definition(spark, n):
    rows = documents(n) if n > 1 else documents(20)[:n]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, row int, leaf string, g string, idx int").repartition(5)
    found = manifest(df)
    got = {r.row: r for r in found.select("*", merkle.proof_hash(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("folded"), merkle.fold(F.lit("0" * 64), F.col("path")).alias("broken")).collect()}
    assert len(got) == len(rows)
    want = plain_manifest(rows)
    same = lambda r: tuple(rows[r][c] for c in FIELDS)
    assert {r: (x.leaf, x.subroot, x.root) for r, x in got.items()} == {r: x[:3] for r, x in want.items()}
    assert all(x.folded == x.root and x.broken != x.root for x in got.values())
    # Equal rows share their proofs among them.
    assert sorted((same(r).__repr__(), x.proof) for r, x in got.items()) == sorted((same(r).__repr__(), x[3]) for r, x in want.items())


# -- 12 --------------------------------------------------------------------------------------------------------------


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40, (12, 8))
    v = np.floor(centres[rng.integers(0, 12, 3000)] + rng.normal(0, 2, (3000, 8)))
    labels, reps = rng.integers(0, 5, 3000), np.arange(3000)
    tree = negatives.BallTree(v, labels)
    q = v[:40]
    for node in range(len(tree.lo)):
        s = q @ tree.vectors[tree.lo[node] : tree.hi[node]].T
        low, high = tree.bounds(node, q, np.linalg.norm(q, axis=1))
        assert (low <= s.min(1)).all() and (s.max(1) <= high).all()
    for same in (True, False):
        low, high = (np.full(40, -np.inf), np.full(40, np.inf)) if same else (np.full(40, 100.0), np.full(40, 900.0))
        who, cand, score, scored = negatives.search(tree, v, reps, q, labels[:40], low, high, 5, same)
        assert scored < 0.75 * ((labels[:, None] == labels[None, :40]) == same).sum()
        for k in range(40):
            s = v @ q[k]
            ok = ((labels == labels[k]) == same) & (s >= low[k]) & (s <= high[k])
            assert sorted(zip(-score[who == k], cand[who == k], strict=True)) == sorted(zip(-s[ok], np.flatnonzero(ok), strict=True))[:5]


def plain_negatives(rows, k=5):
    ok = sorted({(i, lab, tuple(int(np.floor(256 * x)) for x in v)) for i, lab, v, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for i, lab, v in (r for r in ok if r[0] % 4 == 0):
        alike = sorted((-dot(v, w), j) for j, m, w in ok if m == lab and j != i and len(w) == len(v))[:k]
        for p, j in alike:
            others = sorted((-dot(v, w), x) for x, m, w in ok if m != lab and len(w) == len(v) and 80 * -p <= 100 * dot(v, w) <= 100 * -p)[:k]
            out += [(i, j, n + 1, x, -p, -s) for n, (s, x) in enumerate(others)]
    return sorted(out)


def test_hard_negatives_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.3, 0.3, 4).round(2)], "x", 1) for k in range(120)]
    rows += [(200 + k, k % 3, [0.5, 0.5, 0.5, 0.5], "x", 1) for k in range(60)] + [(300, 1, [1.0, 1.0], "x", 1), (304, 2, [1.0, 0.9], "x", 1), (308, 1, [1.0, 1.0], "x", 1)]
    rows += [(400, None, [1.0] * 4, "x", 1), (404, 1, None, "x", 1), (408, 1, [1.0, None, 1.0, 1.0], "x", 1), (412, 1, [float("nan"), 1.0, 1.0, 1.0], "x", 1), (416, 1, [float("inf"), 1.0, 1.0, 1.0], "x", 1), (None, 1, [1.0] * 4, "x", 1), rows[8], rows[8]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, v string, search int").repartition(3)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 4 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0


# -- 13 --------------------------------------------------------------------------------------------------------------


def test_signatures_within_the_threshold_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**16, (50, minhash.HASHES)).astype("<u2")
    b = a.copy()
    for row in b:
        gone = rng.choice(minhash.HASHES, minhash.MOST, replace=False)
        row[gone] ^= 1
    keys = lambda s: minhash.signature_keys(s)
    assert all(np.intersect1d(x, y).size for x, y in zip(keys(a), keys(b), strict=True))
    # Adversarial: two errors in every chunk but one, one there.
    c = a.copy().reshape(50, minhash.CHUNKS, minhash.CHUNK)
    c[:, 1:, :2] ^= 1
    c[:, 0, :1] ^= 1
    assert all(np.intersect1d(x, y).size for x, y in zip(keys(a), keys(c.reshape(50, -1)), strict=True))
    assert not any(np.intersect1d(x, y).size for x, y in zip(keys(a), keys(rng.integers(0, 2**16, a.shape).astype("<u2")), strict=True))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    shared, mine, other = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (4000, 500, 500))
    x, y = minhash.signature(np.concatenate((shared, mine))), minhash.signature(np.concatenate((shared, other)))
    assert 0.6 < (x == y).mean() <= 1 and np.array_equal(minhash.signature(shared), minhash.signature(shared[::-1]))


def test_minhash_components_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(12)]
    texts = {}
    for k in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts[k] = " ".join(t)
    texts |= {200: None, 201: "", 202: " \t", 203: "one two", 204: "ONE two", 205: "one", 206: "a b c d " * 40_000}
    df = spark.createDataFrame([(k, t, "x", True) for k, t in texts.items()] + [(None, "one two", "x", True)], "doc_id long, text string, bitmap string, kept boolean").repartition(4)
    got = {r.doc_id: r for r in minhash.minhash_components(df, n=4, percent=80).collect()}
    sets = dict(zip(texts, map(set, map(np.ndarray.tolist, shingle_sets([t or "" for t in texts.values()], 4))), strict=True))
    comp = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), comp[k], comp[k] == k) for k in texts}
    assert minhash.minhash_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="80"):
        minhash.minhash_components(df, percent=70)


# -- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("at", range(0, 40, 3))
def test_one_label_of_a_class_at_any_place_trains(at, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 4)
    monkeypatch.setattr(toxicity, "JUDGED", 2)
    ids, first = toxicity.word_ids([f"word{k} some text {k % 7}" for k in range(40)])
    docs = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    for one in (0, 1):
        y = np.full(40, 1 - one, np.float32)
        y[at] = one
        m = toxicity.fit(docs, y)
        assert np.isfinite(m.embed).all() and np.isfinite(m.score(m.raw(m.tables(), ids, first))).all()
        held = np.setdiff1d(np.arange(40), toxicity.fitting(y))
        assert at not in held and 0 < len(held) < 10


def test_training_on_few_labels_in_spark(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UPDATES", 4)
    monkeypatch.setattr(toxicity, "JUDGED", 2)
    docs = spark.createDataFrame([(k, f"text of words {k}", "en") for k in range(30)], "doc_id long, text string, lang string")
    for toxic in ({6}, {0, 29}, set(), set(range(30))):
        labels = spark.createDataFrame([(k, int(k in toxic)) for k in range(30)], "doc_id long, toxic int")
        assert toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).where("score between 0 and 1").count() == 30


def test_pipeline_near_duplicates_with_a_map_column(spark):
    import corpus_pipeline

    rows = [(1, "same words in both of these rows here", {"a": 1}), (1, "same words in both of these rows here", {"b": 2}), (2, "other words", None), (None, "x y", {"c": 3}), (None, "x y", {"d": 4})]
    df = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2]
    assert [r.more for r in out.collect() if r.doc_id == 1] == [r.more for r in corpus_pipeline.drop_near_duplicates(spark, df.repartition(3), "").collect() if r.doc_id == 1]


def test_toxicity_memory_of_long_texts():
    """What a task holds to judge a batch follows PIECE_CHARS, or its longest text, also where long texts lie side by side; every row is judged as it is alone."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    model, seen = toxicity.Cnn.fresh(), {}
    model.by_lang = {None: 0.5, "de": 0.0, "fr": 1.1}
    word = " ".join(f"w{k}" for k in range(20_000))
    texts = [None if k % 97 == 0 else "" if k % 89 == 0 else f"short {k}" for k in range(600)]
    texts[200:240] = [f"{k} {word}" for k in range(40)]
    rows = pa.record_batch({"doc_id": list(range(600)), "lang": [("de", "fr", None)[k % 3] for k in range(600)], "text": texts})
    frame = SimpleNamespace(columns=rows.schema.names, schema=None, sparkSession=SimpleNamespace(conf=SimpleNamespace(set=lambda *a: None)), mapInArrow=lambda f, schema: seen.setdefault("run", f))
    run = toxicity.reject_toxic(frame, model)
    list(run(iter([rows.slice(200, 1), rows.slice(0, 0)])))  # fills caches
    ids = pa.Table.from_batches(run(iter([rows])))["doc_id"].to_pylist()
    alone = {t: float(model.score(model.raw(model.tables(), *toxicity.word_ids([t])))[0]) for t in set(texts) - {None}}
    assert ids == [k for k in range(600) if k % 3 == 1 or (k % 3 == 2 and alone[texts[k] or ""] < 0.5)]
    tracemalloc.start()
    for _ in run(iter([rows])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 30, peak  # the long texts alone have 4.7 million characters
