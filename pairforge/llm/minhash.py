"""Near duplicates by MinHash signatures, joined by a multi-index Hamming join and confirmed on the full sets.

A signature has HASHES positions of BITS bits, the least hash of a document's shingles under as many hash functions. Two sets of similarity J differ in a position
with probability 1 - J at most, so two with J >= 0.8 differ in more than MOST = 39 of 80 with probability below 1e-8; that is the method's only loss.

Positions fall into CHUNKS of 4. By the pigeonhole, signatures that differ in at most MOST = CHUNKS * (ERRORS + 1) - 1 positions have a chunk that differs in at most
ERRORS of its 4. Each chunk is therefore indexed once for each way to leave ERRORS positions out, so all pairs within MOST share a key, whatever the data. As in the
n-gram join, members of a key are tied to its least one; here only one document of each set is indexed, from the signatures alone, without its text. In a cell of
candidates signatures that differ in more than MOST positions are parted, and what stays together is compared exactly on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .base import chunks, cut, id_text, release, trim, tuned
from .jaccard import candidate_ties, classes, exact_components, representatives, shingle_sets

HASHES, BITS, CHUNK, ERRORS = 80, 16, 4, 1
CHUNKS = HASHES // CHUNK
#: Positions in which two signatures of the join may differ; keys of a document.
MOST = CHUNKS * (ERRORS + 1) - 1
LEFT_OUT = list(combinations(range(CHUNK), ERRORS))
KEYS = CHUNKS * len(LEFT_OUT)
U = np.uint64
_SEEDS = tk.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_XOR, _TIMES = _SEEDS[:HASHES, None], _SEEDS[HASHES:, None] | U(1)
#: Tokens that are hashed at once, so that a long text needs no more memory than a short one.
_STEP = 8192


def signature(u: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set of hashes that is not empty."""
    least = np.full(HASHES, ~U(0))
    for k in range(0, len(u), _STEP):
        np.minimum(least, ((u[None, k : k + _STEP] ^ _XOR) * _TIMES).min(1), out=least)
    return (tk.mix(least) & U(2**BITS - 1)).astype("<u2")


def signature_keys(signatures: np.ndarray) -> np.ndarray:
    """A row of KEYS keys for each signature."""
    parts = signatures.reshape(len(signatures), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(signatures), CHUNKS, len(LEFT_OUT)), np.uint64)
    for w, gone in enumerate(LEFT_OUT):
        key = np.zeros(parts.shape[:2], np.uint64)
        for k in range(CHUNK):
            if k not in gone:
                key = (key << U(BITS)) | parts[:, :, k]
        out[:, :, w] = tk.mix(key ^ tk.mix(np.arange(CHUNKS, dtype=np.uint64) * U(len(LEFT_OUT)) + U(w + 1))[None, :])
    return out.reshape(len(signatures), KEYS)


def near_signatures(sizes: np.ndarray, signatures: list[bytes], percent: int, comps: np.ndarray) -> np.ndarray:
    """A label for each set of a cell; sets with different labels aren't within MOST positions, or their sizes are too far apart, directly or by way of others; those of one of comps have one label."""
    order = np.argsort(sizes, kind="stable")
    n, label = sizes[order].astype(np.int64), np.unique(comps, return_inverse=True)[1][order]
    rows = np.stack([np.frombuffer(signatures[k], "<u2") for k in order])
    last = np.searchsorted(n, n * 100 // percent, "right")
    for k in range(len(n)):
        other = np.flatnonzero(label[k + 1 : last[k]] != label[k]) + k + 1
        if len(other):
            near = other[(rows[other] != rows[k]).sum(1) <= MOST]
            for x in np.unique(label[near]).tolist():
                label[label == x] = label[k]
    out = np.empty(len(n), np.int64)
    out[order] = label
    return out


def _signed(n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            sets = shingle_sets(t["text"].to_pylist(), n)
            s1 = [int(tk.mix(u).sum(dtype=np.uint64).view(np.int64)) if len(u) else 0 for u in sets]
            s2 = [int(np.bitwise_xor.reduce(tk.mix(u + U(12345))).view(np.int64)) if len(u) else 0 for u in sets]
            signs = [signature(u).tobytes() if len(u) else None for u in sets]
            arrays = [t["doc_id"].combine_chunks(), pa.array(list(map(len, sets)), pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "s1", "s2", "bitmap"])
        trim()

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    for b in batches:
        for k in range(0, b.num_rows, 5000):
            part = b.slice(k, 5000)
            signs = np.frombuffer(b"".join(part.column("bitmap").to_pylist()), "<u2").reshape(-1, HASHES)
            yield [signature_keys(signs).ravel()], [np.repeat(part.column("doc_id").to_numpy(), KEYS)]


def minhash_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs with a doc_id.

    A document's set holds its distinct n-word shingles (words: runs of anything but 0x20 and 0x09-0x0D, A-Z lower-cased); with fewer words the whole sequence;
    without words or text it is empty and linked with nothing. Documents link when 100 * intersection >= percent * union, which is confirmed on the full sets;
    percent may not be below 80, as signatures of less similar sets differ too often. component_id is the smallest doc_id that links lead to, and the
    document kept. Rows that repeat a doc_id count as one node with the links of each and keep their own n_shingles; rows without doc_id take no part; other columns are ignored;
    an empty table gives an empty result.
    """
    if percent < 80:
        raise ValueError("the signatures guarantee pairs of a similarity of 80 % or more")
    tuned(docs.sparkSession)
    docs = id_text(docs)
    classed = classes(cut(docs.mapInArrow(_signed(n), "doc_id long, n_shingles long, s1 long, s2 long, bitmap binary")))
    one = representatives(classed).select("doc_id", "bitmap")
    ties = cut(candidate_ties(one, _keyed, KEYS * one.count()).distinct())
    release(docs.sparkSession)
    found = exact_components(docs, classed, ties, percent, n, lambda sizes, signs, comps: near_signatures(sizes, signs, percent, comps))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
