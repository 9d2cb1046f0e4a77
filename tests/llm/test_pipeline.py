"""Each stage of the pipeline against its brute-force version, on its own input."""

import sys
from pathlib import Path

from tests.llm.test_operators import DOCS, base_spans, contaminated_brute, jaccard_brute

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages(spark, sf):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        out = stage(spark, spark.createDataFrame([tuple(r.values()) for r in before], docs.schema), sf)
        kept = [r.asDict() for r in out.collect()]
        ids = {r["doc_id"] for r in kept}
        if name == "packing":
            assert ids == {r["doc_id"] for r in before}
            continue
        assert out.columns == docs.columns
        if name == "near_duplicates":
            want = jaccard_brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert ids == {i for i, (_, c) in want.items() if i == c} and len(kept) == len(ids)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert ids == {r[0] for r in contaminated_brute([(r["doc_id"], r["text"]) for r in before], items) if not r[-1]}
        if name == "secrets":
            assert ids == {r["doc_id"] for r in before}
            assert not any(base_spans(r["text"]) for r in kept)
            assert all(r["n_chars"] == len(r["text"]) for r in kept)
        if name == "toxicity":
            assert 0.7 * len(before) < len(kept) < len(before)


def test_run(spark, sf):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and DOCS


def _hostile(spark, sf, folder):
    """Labels and benchmark of sf beside documents of their own: nulls, empty and very long texts, repeats, missing ids, clashing columns."""
    import shutil

    for name in ("labels", "benchmark"):
        src = Path(sf) / f"{name}.parquet"
        (shutil.copytree if src.is_dir() else shutil.copy)(src, folder / f"{name}.parquet")
    shutil.copytree(f"{sf}/documents.parquet", folder / "documents.parquet") if Path(f"{sf}/documents.parquet").is_dir() else shutil.copy(f"{sf}/documents.parquet", folder / "documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").first().text
    base = " ".join(f"word{k} goes" for k in range(60))
    rows = [
        (1, None, None, None, 0), (2, "", "en", "s", 0), (3, " ", "en", "s", 1), (4, base, "en", "s", 5), (5, base + " tail", "en", None, 5), (6, "x y z", "de", "s", 3), (6, "quite another text with words of its own here", None, "s", 3),
        (6, "x y z", "de", "r", 3), (7, base, "fr", "s", 5), (None, base, "en", "s", 5), (None, "a row without id and with words of its own", "en", "s", 5), (None, item, "en", "s", 5), (8, "long " + " ".join(f"w{k % 977} v{k}" for k in range(20_000)), "xx", "s", None),
        (9, f"say {item} twice", "en", "s", 2), (9, "clean words under the same id as a leaked text", "en", "s", 2), (10, "api_key = 'abcdef123456'", "en", "s", 9),
    ]
    return spark.createDataFrame([(*r, "c", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, component_id string, n_hit int, __row boolean"), str(folder)


def test_stages_hostile(spark, sf, tmp_path):
    """Each stage on hostile rows, against what its docstring says, and on an empty table."""
    import corpus_pipeline as cp

    docs, folder = _hostile(spark, sf, tmp_path)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    rows = sorted(docs.collect(), key=key)
    by = {n: f for n, f in cp.STAGES}
    for n, f in cp.STAGES[:-1]:
        assert f(spark, docs.limit(0), folder).columns == docs.columns, n
        assert f(spark, docs.limit(0), folder).count() == 0, n
    assert by["packing"](spark, docs.limit(0), folder).count() == 0

    left = sorted(by["near_duplicates"](spark, docs, folder).collect(), key=key)
    texts = [(r.doc_id, r.text) for r in left]
    assert (4, rows[3].text) in texts and not {5, 7} & {i for i, _ in texts} and sum(t == rows[3].text for _, t in texts) == 1
    assert [(r.source, r.text) for r in left if r.doc_id == 6] == [("s", "quite another text with words of its own here"), ("r", "x y z")]
    assert {1, 2, 3, 8, 9, 10} <= {i for i, _ in texts} and sum(i is None for i, _ in texts) == 1 and len(left) == 11  # the item alone is close to 9's text

    clean = by["decontamination"](spark, docs, folder).collect()
    assert [r.text for r in clean if r.doc_id == 9] == ["clean words under the same id as a leaked text"] and sum(r.doc_id is None for r in clean) == 2 and len(clean) == len(rows) - 2

    redacted = {(r.doc_id, r.source): r for r in by["secrets"](spark, docs, folder).collect()}
    assert "abcdef123456" not in redacted[10, "s"].text and redacted[10, "s"].n_chars == len(redacted[10, "s"].text) and redacted[1, None].text is None and redacted[1, None].n_chars == 0
    judged = by["toxicity"](spark, docs, folder).collect()
    assert {r.doc_id for r in judged} >= {1, 2, 3} and all(r in rows for r in judged)
    packed = by["packing"](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows} - {None}
