"""Exact Jaccard self-join of documents over word n-grams, by segments of the token universe.

Two sets with Jaccard similarity of p % or more and sizes up to s differ in at most H = (100 - p) * 2s / (200 - (100 - p)) tokens.
The hash space of tokens (the universe) is cut into m segments. Sizes fall into bands; each band has its own H and m, and a
pair uses the band of its larger set, so that a set near the top of its band is also indexed in the next. H + 1 shares are
dealt to the segments; each way to deal them loses no pair:

* PAIRED: m = ceil((H + 1) / 2), two shares a segment, which may then differ by one token and is indexed with its
  one-deletion neighbourhood (one exact segment, if H + 1 is odd).
* SPARE, AMPLE: m = H + 1 + e, with e about H / 8 or H / 2: at least 1 + e segments of a linked pair are equal. Each set
  indexes the H + 1 segments with most tokens (ties: the later segment). The largest equal segment of a pair is indexed by
  both: a set that dropped it would have to drop the other e equal ones too.

Which way a band takes is decided by cost: a first pass over all documents counts, for each band and way, the keys and (by a
sketch of signs) the pairs of entries that would meet in them.

Keys shared by documents make candidates. Within a key all members are tied to the least one, so each candidate pair meets
in the cell of some least member. A key that many documents of one task hold is hot: there only the task's least member is
sent on, and the cell is a connected component of such ties. In each cell parity bitmaps of the sets, which bound the number
of tokens that differ from below, part what can't be linked, and what stays together is compared exactly by inverted
lists. A cell over BLOCK sets is cut in blocks that all hold its least member; only sets that then are not linked with the
cell's largest component meet the other blocks. Cells of hot keys come first; of the others only those with sets of several components
are left, and there only pairs across components are looked for. Documents with equal sets are one class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .base import EXCHANGED, chunks, cut, exchange, id_text, pack, packed_batch, release, trim, tuned, unpack
from .components import connected_components

#: Ratio of the largest to the smallest size of a band; sets that one task compares at once; members of a key in one task from which it is hot.
BAND, BLOCK, HOT = 1.25, 2000, 16
#: Ways to deal the shares of a band; sign counters of a sketch; what a meeting pair costs in keys; keys of a bucket.
PAIRED, SPARE, AMPLE = 0, 1, 2
SIGNS, PAIR_COST, BUCKET_KEYS = 32, 4.0, 400_000
#: Bits of a parity bitmap: two a token, in powers of two between these bounds.
LEAST_BITS, MOST_BITS = 64, 8192
U = np.uint64
#: Of record batches: the keys and the nodes that have them, a few texts at a time. Of a cell's sizes, bitmaps and components: labels, see may_link.
Keyed = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[list[np.ndarray], list[np.ndarray]]]]
Parting = Callable[[np.ndarray, list[bytes], np.ndarray], np.ndarray]
_TIE = ["<i8", "<i8", "<u1"]


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Of each text its distinct word n-grams as sorted hashes; with fewer words the whole sequence; without words none."""
    w = tk.words(texts)
    g = tk.grams(w.hash, n)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if hi - lo >= n:
            u = np.sort(g[lo : hi - n + 1])
            out.append(u[np.concatenate(([True], u[1:] != u[:-1]))])
        elif hi > lo:
            out.append(tk.grams(w.hash[lo:hi], hi - lo, seed=hi - lo))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def band_top(b: int) -> int:
    return math.floor(8 * BAND**b)


def band_of(size: int) -> int:
    b = 0 if size <= 8 else max(0, math.ceil(math.log(size / 8, BAND)) - 1)
    while band_top(b) < size:
        b += 1
    return b


def differ_most(top: int, percent: int) -> int:
    return (100 - percent) * 2 * top // (200 - (100 - percent))


def bands_of(size: int, percent: int) -> range:
    """The bands that a set of this size is indexed in."""
    return range(band_of(size), band_of(max(size, size * 100 // percent)) + 1)


def band_keys(u: np.ndarray, x: np.ndarray, total: np.ndarray, b: int, percent: int, way: int) -> np.ndarray:
    """Keys of a sorted set in band b; x: its mixed tokens, total: their running sum from 0."""
    h = differ_most(band_top(b), percent)
    if way == PAIRED:
        m = (h + 2) // 2
        edges = _edges(u, m)
        seg = total[edges[1:]] - total[edges[:-1]]
        salt = tk.mix(np.arange(m, dtype=np.uint64) + U(b * 1_000_003 + 7))
        full = m if (h + 1) % 2 == 0 else m - 1  # segments that may differ by one token; the last may not, if h + 1 is odd
        part = np.repeat(np.arange(m), np.diff(edges))
        part, gone = part[part < full], x[: len(part)][part < full]
        return np.concatenate((tk.mix(seg) ^ salt, tk.mix(seg[part] - gone) ^ salt[part]))
    m = h + 2 + (h // 8 if way == SPARE else h // 2)
    edges = _edges(u, m)
    seg, count = total[edges[1:]] - total[edges[:-1]], np.diff(edges)
    keep = np.argsort(count, kind="stable")[m - (h + 1) :]
    return tk.mix(seg[keep] + tk.mix(keep.astype(np.uint64) + U(b * 1_000_003 + 500_009)))


def ways_for(b: int, percent: int) -> tuple[int, ...]:
    """The ways worth counting: a neighbourhood has a key a token, so PAIRED loses wherever that is far above the H + 1 keys of the others."""
    return (PAIRED, SPARE, AMPLE) if band_top(b) <= 8 * (differ_most(band_top(b), percent) + 1) and band_top(b) <= 128 else (SPARE, AMPLE)


def keys_of(u: np.ndarray, percent: int, ways: dict[int, int]) -> np.ndarray:
    """Keys of a sorted set, for its band and, if a partner may lie there, the next ones; ways: of each band, else SPARE."""
    if not len(u):
        return u
    x = tk.mix(u)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    return np.concatenate([band_keys(u, x, total, b, percent, ways.get(b, SPARE)) for b in bands_of(len(u), percent)])


def parity(u: np.ndarray) -> bytes:
    """A bit for each residue of the tokens' hashes: whether an odd number of tokens has it."""
    bits = LEAST_BITS
    while bits < min(2 * len(u), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount((tk.mix(u + U(777)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _edges(u: np.ndarray, m: int) -> np.ndarray:
    bounds = np.array([(2**64 * k) // m for k in range(1, m)], np.uint64)
    return np.concatenate(([0], np.searchsorted(u, bounds), [len(u)]))


def _groups(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of key and node: key, node, the number of their group, and where groups start; repeated entries go."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    once = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1]))) if len(key) else np.empty(0, bool)
    key, node = key[once], node[once]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
    return key, node, np.cumsum(new) - 1, np.flatnonzero(new)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([a, b], 1), axis=0)
    return both[:, 0], both[:, 1]


def _text_keys(n: int, percent: int, ways: dict[int, int]) -> Keyed:
    """Keys of the sets of texts (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        for t in chunks(batches):
            keys, nodes, seen = [], [], {}
            for doc, u in zip(t["doc_id"].to_pylist(), shingle_sets(t["text"].to_pylist(), n), strict=True):
                same = seen.setdefault(u.tobytes(), doc)  # copies are one class anyway
                if same != doc or not len(u):
                    continue
                keys.append(keys_of(u, percent, ways))
                nodes.append(np.full(len(keys[-1]), doc, np.int64))
            yield keys, nodes

    return run


def candidate_ties(rows: DataFrame, keyed: Keyed, n_keys: int) -> DataFrame:
    """(a, b, hot): of each pair that shares a key, both are tied to a common b; through several ties, where they are hot."""
    k = max(1, math.ceil(n_keys / BUCKET_KEYS))
    few = max(1, k // 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, node, group, first = _groups(np.concatenate(keys), np.concatenate(nodes))
            hot = np.diff(np.append(first, len(key)))[group] >= HOT if len(key) else np.empty(0, bool)
            least = node[first][group] if len(key) else node
            rest = hot & (node != least)
            if rest.any():
                a, b = _pairs(node[rest], least[rest])
                yield packed_batch([(r, b"T" + v) for r, v in pack(b % few, few, [a, b, np.ones(len(a), np.uint8)])])
            one = ~rest
            if one.any():
                yield packed_batch([(r, b"K" + v) for r, v in pack((key[one] % U(k)).astype(np.int64), k, [key[one], node[one], hot[one].astype(np.uint8)])])

        for more, who in keyed(batches):
            keys += more
            nodes += who
            held += sum(map(len, more))
            if held > 1_500_000:
                yield from flush()
                keys, nodes, held = [], [], 0
        if keys:
            yield from flush()
            keys, nodes = [], []
        trim()

    def meet(values: list[bytes]) -> Iterator[pa.RecordBatch]:
        ties = [v for v in values if v[:1] == b"T"]
        out = [(r, v[1:]) for r, v in zip((int(unpack([v[1:]], _TIE)[1][0] % few) for v in ties), ties, strict=True)]
        key, node, hot = unpack([v[1:] for v in values if v[:1] == b"K"], ["<u8", "<i8", "<u1"])
        if len(key):
            flagged = np.unique(key[hot == 1])
            key, node, group, first = _groups(key, node)
            least = node[first][group]
            rest = node != least
            if rest.any():
                is_hot = np.isin(key[rest], flagged)
                for flag in (0, 1):
                    a, b = _pairs(node[rest][is_hot == flag], least[rest][is_hot == flag])
                    out += pack(b % few, few, [a, b, np.full(len(a), flag, np.uint8)])
        if out:
            yield packed_batch(out)

    def gather(values: list[bytes]) -> Iterator[pa.RecordBatch]:
        a, b, hot = unpack(values, _TIE)
        both = np.unique(np.stack([a, b, hot.astype(np.int64)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(both[:, 2] == 1)], ["a", "b", "hot"])

    return exchange(exchange(rows.mapInArrow(send, EXCHANGED), k, meet, EXCHANGED), few, gather, "a long, b long, hot boolean")


class _Parts:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k


def linked(sets: list[np.ndarray], ids: list[int], percent: int, fresh: int = 0, comps: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what is linked: a spanning forest of the exact links of sets, beside what comps says is one component.

    With `fresh`, every pair with a set from there on is looked at, and others need not be. Without, sets that already are in the first one's component are not
    compared any more: the sets that aren't are compared with all.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    parts, out = _Parts(len(sets)), []
    seen: dict[int, int] = {}
    for k, c in enumerate(comps or []):
        parts.up[parts.root(k)] = parts.root(seen.setdefault(c, k))
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(ids[0], ids[1])] if 100 * both >= percent * (size.sum() - both) else []
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    first = np.searchsorted(token[order], np.arange(token.max() + 2))
    owner_by_token, begins = owner[order], np.concatenate(([0], np.cumsum(size)))
    for k in range(fresh, len(sets)):
        if not fresh and k and parts.root(k) == parts.root(0):
            continue
        own = token[begins[k] : begins[k + 1]]
        lo, n = first[own], first[own + 1] - first[own]
        many = n > 1
        lo, n = lo[many], n[many]
        if not len(n):
            continue
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner_by_token[at], minlength=len(sets))
        both[k] = 0
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (size[k] + size - both))).tolist():
            a, b = parts.root(k), parts.root(j)
            if a != b:
                parts.up[a] = b
                out.append((ids[k], ids[j]))
    return out


def may_link(sizes: np.ndarray, bitmaps: list[bytes], percent: int, comps: np.ndarray | None = None) -> np.ndarray:
    """A label for each set; sets with different labels can't be linked, not even by way of others of these sets; those of one of comps have one label.

    Bits in which the parity bitmaps differ are at most the tokens that differ; a longer bitmap is folded to the shorter.
    """
    order = np.argsort(sizes, kind="stable")
    n, label = sizes[order].astype(np.int64), np.arange(len(sizes)) if comps is None else np.unique(comps, return_inverse=True)[1][order]
    maps = [np.frombuffer(bitmaps[k], "<u8") for k in order]
    width = np.array([len(x) for x in maps])
    folded: dict[int, np.ndarray] = {}  # the bitmaps that are no shorter than so many words, in order
    begin: dict[int, int] = {}
    for w in np.unique(width).tolist():
        begin[w] = int(np.searchsorted(width, w))
        folded[w] = np.stack([np.bitwise_xor.reduce(x.reshape(-1, w), 0) for x in maps[begin[w] :]])
    last = np.searchsorted(n, n * 100 // percent, "right")
    for k in range(len(n)):
        w, stop = int(width[k]), int(last[k])
        if stop <= k + 1 or not n[k]:
            continue
        other = np.flatnonzero(label[k + 1 : stop] != label[k]) + k + 1
        if not len(other):
            continue
        rows = folded[w]
        differ = np.bitwise_count(rows[other - begin[w]] ^ rows[k - begin[w]]).sum(1)
        near = other[differ * (100 + percent) <= (100 - percent) * (n[k] + n[other])]
        for x in np.unique(label[near]).tolist():
            label[label == x] = label[k]
    out = np.empty(len(n), np.int64)
    out[order] = label
    return out


def _part(may: Parting):  # noqa: ANN202
    """Over rows (cell, side, doc_id, comp, n_shingles, bitmap), sorted by cell: the rows that may have a link there to another comp, with the part they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> list[list[int]]:
            label = may(np.array([r[3] for r in held]), [r[4] for r in held], np.array([r[2] for r in held])).tolist()
            several = {x for x, n in Counter(x for x, _ in {(x, r[2]) for x, r in zip(label, held, strict=True)}).items() if n > 1}
            if any(r[0] for r in held):
                several &= {x for x, r in zip(label, held, strict=True) if r[0] == 1}
            stay = [k for k, x in enumerate(label) if x in several]
            return [[int(tk.mix(np.array([now], np.int64).view(np.uint64) + U(label[k]))[0] >> U(1)) for k in stay], *([held[k][c] for k in stay] for c in range(3))]

        def batch(parts: list[list[list[int]]]) -> pa.RecordBatch:
            cols = [[x for p in parts for x in p[k]] for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["cell", "side", "doc_id", "comp"])

        parts: list[list[list[int]]] = []
        for b in batches:
            for cell, *row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if cell != now:
                    if len(held) > 1:
                        parts.append(done())
                    now, held = cell, []
                held.append(row)
            yield batch(parts)
            parts = []
        yield batch([done()] if len(held) > 1 else [])

    return run


def _compare(percent: int, n: int):  # noqa: ANN202
    """Over rows (cell, side, doc_id, comp, text), sorted by cell: exact links within each cell between comps, of side 0, or of side 1 with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> list[tuple[int, int]]:
            order = sorted(range(len(ids)), key=lambda x: sides[x])
            zero = sides.count(0)
            return linked([sets[x] for x in order], [ids[x] for x in order], percent, zero if zero < len(ids) else 0, [comps[x] for x in order])

        now, ids, sides, comps, sets, found = None, [], [], [], [], []
        for t in chunks(batches):
            for cell, side, doc, comp, u in zip(t["cell"].to_pylist(), t["side"].to_pylist(), t["doc_id"].to_pylist(), t["comp"].to_pylist(), shingle_sets(t["text"].to_pylist(), n), strict=True):
                if cell != now:
                    found += done() if len(ids) > 1 else []
                    now, ids, sides, comps, sets = cell, [], [], [], []
                ids.append(doc)
                comps.append(comp)
                sides.append(side)
                sets.append(u)
        found += done() if len(ids) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def _describe(percent: int, n: int):  # noqa: ANN202
    """A row for each document: size, two hashes and the parity bitmap of its set. Per task also a row for each band and way, without doc_id:
    n_shingles is the band, s1 the way, s2 the number of keys, signs their sums under SIGNS random signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], list] = {}

        def batch(doc: pa.Array, size: list[int], s1: list[int], s2: list[int], bitmap: list[bytes | None], signs: list) -> pa.RecordBatch:
            arrays = [doc, pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bitmap, pa.binary()), pa.array(signs, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "s1", "s2", "bitmap", "signs"])

        for t in chunks(batches):
            sets = shingle_sets(t["text"].to_pylist(), n)
            mixed = [tk.mix(u) for u in sets]
            s1 = [int(x.sum(dtype=np.uint64).view(np.int64)) if len(x) else 0 for x in mixed]
            s2 = [int(np.bitwise_xor.reduce(tk.mix(u + U(12345))).view(np.int64)) if len(u) else 0 for u in sets]
            yield batch(t["doc_id"].combine_chunks(), list(map(len, sets)), s1, s2, list(map(parity, sets)), [None] * len(sets))
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            for u, x in zip(sets, mixed, strict=True):
                if len(u):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
                    for b in bands_of(len(u), percent):
                        for way in ways_for(b, percent):
                            found.setdefault((b, way), []).append(band_keys(u, x, total, b, percent, way))
            for at, keys in found.items():
                low = np.ascontiguousarray((np.concatenate(keys) >> U(16)).astype("<u4"))
                have = counts.setdefault(at, [0, np.zeros(SIGNS, np.int64)])
                have[0] += len(low)
                have[1] += 2 * np.unpackbits(low.view(np.uint8).reshape(-1, 4), axis=1).sum(0, dtype=np.int64) - len(low)
        found = {}
        trim()
        rows = sorted(counts.items())
        yield batch(pa.nulls(len(rows), pa.int64()), [b for (b, _), _ in rows], [w for (_, w), _ in rows], [c[0] for _, c in rows], [None] * len(rows), [c[1].tolist() for _, c in rows])

    return run


def cheapest_ways(facts: DataFrame) -> tuple[dict[int, int], int]:
    """The way of each band with the least cost, and the number of keys in all; a few dozen bands come to the driver."""
    sums = [F.sum(F.get("signs", F.lit(k))).alias(f"z{k}") for k in range(SIGNS)]
    rows = facts.where("doc_id is null").groupBy(F.col("n_shingles").alias("band"), F.col("s1").alias("way")).agg(F.sum("s2").alias("keys"), *sums).collect()
    cost: dict[int, list[tuple[float, int, int]]] = {}
    for r in rows:
        meet = max(0.0, sum(float(r[f"z{k}"]) ** 2 for k in range(SIGNS)) / SIGNS - r.keys) / 2
        cost.setdefault(r.band, []).append((r.keys + PAIR_COST * meet, r.way, r.keys))
    best = {b: min(c) for b, c in cost.items()}
    return {b: way for b, (_, way, _) in best.items()}, sum(keys for _, _, keys in best.values())


def _exact_links(docs: DataFrame, cells: DataFrame, comps: DataFrame, reps: DataFrame, percent: int, n: int, may: Parting) -> DataFrame:
    """cells (cell, side, doc_id) -> (a, b): a spanning forest of the links in each cell between components."""
    known = comps.select(F.col("node").alias("doc_id"), "comp")
    rows = cells.join(reps, "doc_id").join(known, "doc_id", "left").select("cell", "side", "doc_id", F.coalesce("comp", "doc_id").alias("comp"), "n_shingles", "bitmap")
    parts = cut(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_part(may), "cell long, side int, doc_id long, comp long"))
    release(docs.sparkSession)
    placed = docs.join(parts, "doc_id").select("cell", "side", "doc_id", "comp", "text")
    return cut(placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(percent, n), "a long, b long"))


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Cells for what is left of the cells that were cut in blocks: all their sets (side 0) against those that their largest component doesn't hold (side 1)."""
    m = members.where("blocks > 1").join(comps, F.col("doc_id") == F.col("node"), "left").select("cell", "block", "blocks", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    main = m.groupBy("cell", "comp").agg(F.count("*").alias("g")).groupBy("cell").agg(F.sum("g").alias("all"), F.max(F.struct("g", "comp")).alias("m"))
    left = main.where("all > m.g").select("cell", F.col("m.comp").alias("main"), F.ceil((F.col("all") - F.col("m.g")) / BLOCK).cast("int").alias("rest"))
    m = m.join(left, "cell")
    cell = F.xxhash64(F.col("cell"), F.lit("rest"), "i", "j").alias("cell")
    old = m.select("cell", "doc_id", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("i")).select(cell, F.lit(0).alias("side"), "doc_id")
    new = m.where("comp <> main").select("cell", "doc_id", F.pmod(F.xxhash64("doc_id", F.lit("rest")), F.col("rest")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    return old.union(new.select(cell, F.lit(1).alias("side"), "doc_id"))


def classes(facts: DataFrame) -> DataFrame:
    """facts (doc_id, n_shingles, s1, s2, bitmap) -> (doc_id, n_shingles, rep, bitmap): documents with equal sets share the least doc_id as rep; empty sets have none."""
    least = facts.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    return cut(facts.join(least, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", "rep", "bitmap"))


def representatives(classed: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, bitmap) of one document of each class; of two sets of one doc_id both rows stay: either may have the links."""
    return classed.where("doc_id = rep").select("doc_id", "n_shingles", "bitmap").distinct()


def exact_components(docs: DataFrame, classed: DataFrame, ties: DataFrame, percent: int, n: int, may: Parting) -> DataFrame:
    """(doc_id, n_shingles, component_id): the components of exact links among candidates, whose ties (a, b, hot) join representatives of classes."""
    spark = docs.sparkSession
    reps = representatives(classed)
    # Rows that repeat a doc_id tie their classes.
    links = classed.where("rep is not null and rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(links) if links.take(1) else links.limit(0).select(F.col("a").alias("node"), F.col("b").alias("comp"))
    hot = connected_components(ties.where("hot").select("a", "b")).select(F.col("comp").alias("at"), F.col("node").alias("doc_id"))
    stars = ties.where("not hot").select(F.col("b").alias("at"), F.explode(F.array("a", "b")).alias("doc_id"))
    for cells in (hot, stars):
        # Of each cell its members by component; a cell within one component has nothing left to find.
        cells = cells.distinct().join(comps, F.col("doc_id") == F.col("node"), "left").select(F.col("at").alias("cell"), "at", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
        sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("cell", "blocks")
        members = cut(cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("comp"))
        if not members.take(1):
            continue
        # The least member, which most others are tied to, is in every block.
        block = F.explode(F.when(F.col("doc_id") == F.col("at"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("block")
        parts = members.select("cell", "doc_id", block).select(F.xxhash64("cell", "block").alias("cell"), F.lit(0).alias("side"), "doc_id")
        links = links.union(_exact_links(docs, parts, comps, reps, percent, n, may))
        comps = connected_components(links)
        if members.where("blocks > 1").take(1):
            links = links.union(_exact_links(docs, _unsettled(members, comps), comps, reps, percent, n, may))
            comps = connected_components(links)
    release(spark)
    return classed.join(comps, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def ngram_jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs with a doc_id.

    A document's set holds its distinct n-word shingles (words: runs of anything but 0x20 and 0x09-0x0D, A-Z lower-cased);
    with fewer words the whole sequence; without words or text it is empty and linked with nothing. Documents link when
    100 * intersection >= percent * union. component_id is the smallest doc_id that links lead to. Rows that repeat a
    doc_id count as one node with the links of each and keep their own n_shingles; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    tuned(spark)
    docs = id_text(docs)
    facts = cut(docs.mapInArrow(_describe(percent, n), "doc_id long, n_shingles long, s1 long, s2 long, bitmap binary, signs array<long>"))
    ways, n_keys = cheapest_ways(facts)
    classed = classes(facts.where("doc_id is not null").drop("signs"))
    rep_of = lambda x: classed.where("rep is not null").select(F.col("doc_id").alias(x), F.col("rep").alias(f"rep_{x}")).distinct()
    ties = cut(candidate_ties(docs, _text_keys(n, percent, ways), n_keys))
    release(spark)
    ties = cut(ties.join(rep_of("a"), "a").join(rep_of("b"), "b").where("rep_a <> rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "hot").distinct())
    return exact_components(docs, classed, ties, percent, n, lambda sizes, maps, comps: may_link(sizes, maps, percent, comps))
