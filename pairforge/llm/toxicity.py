"""Convolutional text classifier in numpy: hashed word embeddings, filters of several widths, max pooling, one output.

It is fitted on the driver from a bounded sample of labelled rows and sent to the tasks as a few arrays of fixed size. The
point of score 0.5 and the thresholds by language come from all labelled rows that it isn't fitted on, counted in Spark. Both
weigh the shares, not the numbers, of toxic and of other rows that are judged wrong, as toxic rows are few. A filter's response to a window is a sum of one number per word and place, so a task looks up projections of the hashed
embeddings instead of multiplying.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .base import cut, id_text, trim, tuned

#: Bound of the training sample: labelled rows of each class, and characters of all (in an order by hash). Labelled ids that are sent to all tasks, at most.
SAMPLE_ROWS, SAMPLE_CHARS, SENT_IDS = 3_000, 64_000_000, 500_000
#: Bytes of text that a task works on at once, unless a single text is longer; numpy's arrays take many times as many.
PIECE_CHARS = 500_000
BUCKETS, DIM, FILTERS, WIDTHS, BATCH = 1 << 15, 12, 8, (1, 2, 3), 64
#: Batches that a model is fitted on, and after how many its state is judged on the rows held back.
UPDATES, JUDGED = 480, 40
#: Words of fewer documents of the sample start without a leaning.
LEAST_DOCS = 3
#: Raw scores are counted in steps of 1 / STEPS. All languages together weigh as much as PRIOR rows in a language's threshold.
STEPS, PRIOR = 100, 30
#: How much more a share of other rows judged toxic counts than a share of toxic rows missed: clean documents should stay.
CLEAN = 2.0


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words (from 1), and where each text's begin. Words: runs of letters, digits and non-ASCII, lower-cased."""
    w = tk.words(texts, "alnum")
    return (w.hash % np.uint64(BUCKETS - 1)).astype(np.int32) + 1, w.first


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of the batches in pieces cut by the sizes of their own texts, as long ones may lie side by side; each with its word_ids."""
    trim()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        for a, b in pairwise([0, *np.flatnonzero(np.diff(ends // PIECE_CHARS)) + 1, len(ends)]):
            part = batch.slice(a, b - a)
            yield part, *word_ids(part["text"].to_pylist())


def _padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with empty places (bucket 0) around them, and where their parts start.

    In front lie as many as the widest window reaches beyond its place, so that none that starts in one text's part ends in the words of
    the next; one behind, so that none is empty.
    """
    lead, n = max(WIDTHS) - 1, np.diff(first)
    starts = np.concatenate(([0], np.cumsum(n + lead + 1)))
    out = np.zeros(starts[-1], np.int32)
    out[np.repeat(starts[:-1] + lead - first[:-1], n) + np.arange(len(ids))] = ids
    return out, starts


@dataclass
class Cnn:
    embed: np.ndarray
    filters: list[np.ndarray]  # one for each width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    by_lang: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 7) -> Cnn:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        embed[0] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return Cnn(embed, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32))

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embed @ f[j] for j in range(len(f))] for f in self.filters]

    def pooled(self, tables: list[list[np.ndarray]], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        parts = []
        for table in tables:
            r = table[0][ids]
            for j in range(1, len(table)):
                r[: len(ids) - j] += table[j][ids[j:]]
            parts.append(np.maximum.reduceat(r, starts[:-1], axis=0))
        return np.maximum(np.concatenate(parts, 1) + self.bias, 0)

    def raw(self, tables: list[list[np.ndarray]], ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.empty(0, np.float32)
        padded, starts = _padded(ids, first)
        return self.pooled(tables, padded, starts) @ self.out + self.out_bias

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (raw.astype(np.float64) - self.shift), -30, 30)))


def leanings(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each bucket how far the share of class 1 among the documents that hold it lies from the overall share, in standard errors over three."""
    seen = [np.unique(d) for d in docs]
    flat, label = np.concatenate(seen), np.repeat(y, [len(s) for s in seen])
    n, n1, share = np.bincount(flat, minlength=BUCKETS + 1), np.bincount(flat, label, BUCKETS + 1), y.mean()
    z = (n1 - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    return np.where(n >= LEAST_DOCS, np.clip(z / 3, -2, 4), 0).astype(np.float32)


def _step(m: Cnn, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, drop: np.random.Generator) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss of a batch."""
    first = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    ids, starts = _padded(np.concatenate(docs), first)
    keep = drop.random(len(ids)) > 0.1  # words left out at random
    ids = np.where(keep, ids, 0)
    tables, n = m.tables(), len(docs)
    pooled, where = [], []
    for table in tables:
        r = table[0][ids]
        for j in range(1, len(table)):
            r[: len(ids) - j] += table[j][ids[j:]]
        at = np.stack([r[a:b].argmax(0) + a for a, b in zip(starts[:-1], starts[1:], strict=True)])
        where.append(at)
        pooled.append(np.take_along_axis(r, at, 0))
    z = np.concatenate(pooled, 1) + m.bias
    mask = (drop.random(z.shape) > 0.2) / 0.8
    hidden = np.maximum(z, 0) * mask
    p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.out_bias, -30, 30)))
    d = ((p - y) * weight / n).astype(np.float32)
    g = {"out": hidden.T @ d, "out_bias": d.sum()}
    dz = (d[:, None] * m.out) * mask * (z > 0)
    g["bias"] = dz.sum(0)
    g["embed"] = np.zeros_like(m.embed)
    for k, (f, at) in enumerate(zip(m.filters, where, strict=True)):
        dk = dz[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
        gf = np.zeros_like(f)
        for j in range(len(f)):
            word = ids[np.minimum(at + j, len(ids) - 1)]
            gf[j] = np.einsum("bfd,bf->df", m.embed[word], dk)
            np.add.at(g["embed"], word.ravel(), (dk[:, :, None] * f[j].T[None]).reshape(-1, DIM))
        g[f"filters{k}"] = gf
    g["embed"][0] = 0
    return g


def fitting(y: np.ndarray) -> np.ndarray:
    """Which rows the weights are fitted on: of each class all but a fifth, rounded down, so that every class that there is has some."""
    rng, keep = np.random.default_rng(7), np.ones(len(y), bool)
    for c in (0, 1):
        rows = np.flatnonzero(y == c)
        keep[rng.permutation(rows)[: len(rows) // 5]] = False
    return np.flatnonzero(keep)


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Cnn:
    """Adam on four fifths of the rows of each class (see fitting); the rest picks the epoch and the point where the score is 0.5.

    If a class has fewer than five rows the rest lacks it; then all rows pick. Without rows of both classes the model has one answer.
    """
    m, rng = Cnn.fresh(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        m.out[:] = 0
        m.out_bias = 3.0 if len(y) and y[0] else -3.0
        return m
    train = fitting(y)
    held = np.ones(len(y), bool)
    held[train] = False
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    # The first dimension starts from the words' leanings in the training part, and half of the filters look at it.
    m.embed[:, 0] = leanings([docs[k] for k in train], y[train])
    m.embed[:, 1:] *= 0.3
    for f in m.filters:
        f[:, 0, : FILTERS // 2] = 0.5
    m.out[:] = np.where(np.arange(len(m.out)) % FILTERS < FILTERS // 2, 0.4, m.out)
    m.out_bias = -1.0
    state: dict[str, list[np.ndarray]] = {}
    t, best = 0, (np.inf, None)
    check = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    flat, first = (lambda d: (np.concatenate(d), np.concatenate(([0], np.cumsum([len(x) for x in d])))))([docs[k] for k in np.flatnonzero(check)])
    yc, queue = y[check], np.empty(0, np.int64)
    while t < UPDATES:
        if not len(queue):
            queue = rng.permutation(train)
        rows, queue = queue[:BATCH], queue[BATCH:]
        t += 1
        for name, g in _step(m, [docs[r] for r in rows], y[rows], weight[rows], rng).items():
            a, b = state.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            move = 0.005 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            if name.startswith("filters"):
                m.filters[int(name[7:])] -= move
            elif name == "out_bias":
                m.out_bias -= float(move)
            else:
                getattr(m, name)[...] -= move
        if t % JUDGED:
            continue
        raw = m.raw(m.tables(), flat, first)
        loss = float(np.mean(np.logaddexp(0, raw) - yc * raw))
        rank = np.argsort(np.argsort(raw))
        auc = (rank[yc == 1].sum() - yc.sum() * (yc.sum() - 1) / 2) / (yc.sum() * (len(yc) - yc.sum()))
        if -auc + 0.01 * loss < best[0]:
            best = (-auc + 0.01 * loss, (m.embed.copy(), [f.copy() for f in m.filters], m.bias.copy(), m.out.copy(), m.out_bias))
    if best[1] is not None:  # else no state could be judged, and the last one stays
        m.embed, m.filters, m.bias, m.out, m.out_bias = best[1]
    step = step_of(m.raw(m.tables(), flat, first))
    return calibrate(m, [(None, int(c), int(k), 1) for c, k in zip(yc, step, strict=True)])


def step_of(raw: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(raw.astype(np.float64), -30, 30) * STEPS).astype(np.int64)


def calibrate(m: Cnn, counts: list[tuple[str | None, int, int, int]]) -> Cnn:
    """Sets the point of score 0.5 and the thresholds by language from counts of rows by language, class and step of the raw score.

    A cut has the least sum of the share of toxic rows below it and CLEAN times that of other rows above it: for the point of score 0.5
    and for other languages among all rows, for a language among its rows and PRIOR rows spread like all. Without rows of both classes nothing changes.
    """
    if len({t for _, t, _, _ in counts}) < 2:
        return m
    low, high = min(k for _, _, k, _ in counts), max(k for _, _, k, _ in counts)
    by: dict[str | None, np.ndarray] = {}
    for lang, t, k, n in counts:
        by.setdefault(lang, np.zeros((2, high - low + 1)))[t, k - low] += n
    whole = sum(by.values())

    def cutoff(rows: np.ndarray) -> float:
        # Cut before step k. Of equals the middle of the longest run.
        share = rows / rows.sum(1, keepdims=True)
        wrong = np.concatenate(([0], np.cumsum(share[1]))) + CLEAN * np.concatenate((np.cumsum(share[0][::-1])[::-1], [0]))
        best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        run = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
        return (low + (run[0] + run[-1]) / 2) / STEPS

    m.shift = cutoff(whole)
    mixed = {lang: rows + PRIOR / whole.sum() * whole for lang, rows in by.items()} | {None: whole}
    m.by_lang = {lang: float(m.score(np.array([cutoff(rows)]))[0]) for lang, rows in mixed.items()}
    return m


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Cnn:
    """Fits on SAMPLE_ROWS labelled rows of each class at most, chosen by a hash of their ids, and calibrates on all others.

    labels needs doc_id and toxic, docs doc_id, text and, for thresholds by language, lang; usable is a condition on doc_id. Labels that
    aren't 0 or 1, or without a document, don't count; of several labels of a doc_id the larger holds, of several texts of a
    doc_id in the sample one does. Null and empty texts count as texts without words. A class of a single row is fitted on; without rows of both classes the
    model has one answer; no labels: not toxic. Other columns are ignored.
    """
    tuned(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(usable) if usable is not None else rows
    labelled = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [labelled.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for c in (0, 1)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, first in pieces(batches):
            packed = pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([t["doc_id"], t["toxic"], packed], ["doc_id", "toxic", "ids"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    # The sample is bounded, so it may be broadcast, and one text a doc_id, within SAMPLE_CHARS, may come to the driver.
    sample = texts.join(F.broadcast(some[0].union(some[1])), "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.length("text").alias("size"), "text")).alias("t"))
    sample = cut(sample)
    before = F.sum("t.size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # a window over SAMPLE_ROWS rows of each class
    sizes = sample.select("doc_id", before.alias("all")).where(F.col("all") <= SAMPLE_CHARS).select("doc_id")
    got = sample.join(sizes, "doc_id", "left_semi").select("doc_id", "toxic", F.col("t.text").alias("text")).mapInArrow(hashed, "doc_id long, toxic int, ids binary").toPandas()
    got = got.sort_values("doc_id")
    model = fit([np.frombuffer(x, np.int32) for x in got["ids"]], got["toxic"].to_numpy(np.float32))
    fitted_on = got["doc_id"].to_numpy(np.int64)[fitting(got["toxic"].to_numpy(np.float32))]
    tables = model.tables()

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = (t.filter(pa.array(~np.isin(t["doc_id"].to_numpy(), fitted_on))) for t in batches)
        for t, ids, first in pieces(new):
            yield pa.RecordBatch.from_arrays([t["doc_id"], t["lang"], pa.array(step_of(model.raw(tables, ids, first)))], ["doc_id", "lang", "step"])

    # Only labelled texts are scored, where their ids can go to all tasks; else all are, before the join. No text is shuffled either way.
    others = (texts.where(usable) if usable is not None else texts).where("doc_id is not null")
    if labelled.count() <= SENT_IDS:
        others = others.join(F.broadcast(labelled.select("doc_id")), "doc_id", "left_semi")
    others = others.mapInArrow(binned, "doc_id long, lang string, step long").join(labelled, "doc_id")
    # At most languages x 2 x 6,001 counts.
    return calibrate(model, [tuple(r) for r in others.groupBy("lang", "toxic", "step").count().collect()])


def score_texts(df: DataFrame, model: Cnn, keep: str) -> DataFrame:
    """(the key column `keep` as given, score) for each row with a text column; only the text is read."""
    tables = model.tables()
    kind = df.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, first in pieces(batches):
            yield pa.RecordBatch.from_arrays([t[keep], pa.array(model.score(model.raw(tables, ids, first)), pa.float64())], [keep, "score"])

    return df.select(keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"{keep} {kind}, score double")


def toxicity_scores(docs: DataFrame, model: Cnn) -> DataFrame:
    """(doc_id, score) for each row of docs with a doc_id; null and empty texts get the score of no words; repeated rows one each."""
    tuned(docs.sparkSession)
    return score_texts(id_text(docs), model, "doc_id")


def reject_toxic(docs: DataFrame, model: Cnn) -> DataFrame:
    """The rows of docs, with their columns, whose score lies below the threshold of their lang (of all languages where it has none).

    Text and language alone decide; rows with a null in any column are judged like others.
    """
    tuned(docs.sparkSession)
    tables, by_lang, spoken = model.tables(), model.by_lang, "lang" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, first in pieces(batches):
            score = model.score(model.raw(tables, ids, first))
            langs = t["lang"].to_pylist() if spoken else [None] * len(score)
            limit = np.array([by_lang.get(x, by_lang.get(None, 0.5)) for x in langs])
            yield t.filter(pa.array(score < limit))

    return docs.mapInArrow(run, docs.schema)
