"""Duplicate passages between documents, by word-level suffix trees that are split by prefixes of variable length.

A suffix for each word would move a window of words per word. Suffixes are taken at anchors alone: in every window of
`window` words, the place whose prefix of PREFIX words has the smallest hash. Equal windows have equal anchors, so it is
enough to compare anchors: a suffix carries the `window` words from its anchor on, and the words before it that windows
around the anchor can hold.

1. The suffixes below each prefix are counted, and where their documents are compared: a prefix below which all suffixes lie in
   one document has no node that two documents share. Its suffixes, most of all, are never moved.
2. The other suffixes with a common prefix meet in one group; groups are dealt to buckets of bounded size. A prefix with more
   suffixes than a group should hold is grown, by more words the more there are: there the windows themselves become
   suffixes, grouped by their first words. In a bucket the suffix array with the longest common prefixes of neighbours stands for
   the tree: the suffixes below a node of depth d lie between two values under d. A second array holds the words before the
   anchors, backwards. A window is a node of the one and a node of the other whose depths add up to `window`; if such a pair has
   leaves in two documents, it is a repeat (maximal repeats are runs of them), and the smallest document keeps it. Words are
   compared, not hashes of them.
3. Words covered by a repeat that a smaller document has go.

Before anything is sent a task settles what it can: one suffix per prefix is counted for the others, and a suffix all of whose
windows a smaller document of the task has isn't sent. So a passage in a third of all documents costs a few rows per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .base import EXCHANGED, chunks, cut, exchange, id_text, pack, packed_batch, release, tuned, unpack

PREFIX = 5
#: Anchors that a task gathers before it settles them; suffixes with their words; anchors of a bucket, suffixes of one; suffixes of a prefix before it is grown.
FLUSH, FLUSH_WORDS, BUCKET, BUCKET_WORDS, GROUP = 1_000_000, 100_000, 500_000, 60_000, 20_000
#: At most so many prefixes are grown: beyond, those with most suffixes.
MOST_GROWN = 100_000
U = np.uint64
_PLACES = "doc_id long, tag long, places binary, n long"


def _starts(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)


def _rows(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row per document: its places as packed 32-bit numbers."""
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos = doc[order], tag[order], pos[order].astype("<u4")
    new = np.flatnonzero(_starts(doc) | _starts(tag))
    ends = np.append(new[1:], len(doc))
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(tag[new]), pa.array([pos[a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary()), pa.array(ends - new, pa.int64())], ["doc_id", "tag", "places", "n"])


def _by_document(packed: DataFrame, n_buckets: int) -> DataFrame:
    """A row for each document, with all its places in one value; there are as many as words at most. Values marked F pass as rows without doc_id."""

    def gather(values: list[bytes]) -> Iterator[pa.RecordBatch]:
        counted = [v[1:] for v in values if v[:1] == b"F"]
        if counted:
            key, n = unpack(counted, ["<i8", "<i8"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(key), pa.nulls(len(key), pa.binary()), pa.array(n)], ["doc_id", "tag", "places", "n"])
        if len(values) > len(counted):
            yield _rows(*unpack([v[1:] for v in values if v[:1] == b"D"], ["<i8", "<i8", "<u4"]))

    return exchange(packed, n_buckets, gather, _PLACES)


def anchor_places(w: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose prefix has the smallest hash of some window, all prefix hashes, and the first such place of each window."""
    prefix = min(PREFIX, window)
    g = tk.grams(w.hash, prefix)
    least = tk.sliding_min(g, window - prefix + 1) if len(w.hash) >= window else g[:0]
    ok = tk.within(w, window)
    chosen, own = np.zeros(len(g), bool), np.full(len(least), -1)
    for j in range(window - prefix, -1, -1):
        if len(least):
            hit = ok & (g[j : j + len(least)] == least)
            chosen[j : j + len(least)] |= hit
            own[hit] = np.flatnonzero(hit) + j
    return np.flatnonzero(chosen), g, own


def word_numbers(w: tk.Words) -> tuple[np.ndarray, list[bytes]]:
    """Equal numbers for equal words and no others, and the words by number."""
    _, first, number = np.unique(w.hash, return_index=True, return_inverse=True)
    size, data = w.end - w.start, w.data.tobytes()
    same = size[first][number]
    if np.array_equal(size, same):
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if np.array_equal(w.data[np.repeat(w.start, size) + at], w.data[np.repeat(w.start[first][number], size) + at]):
            return number.astype(np.int32), [data[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
    words: dict[bytes, int] = {}  # two words have one hash
    return np.array([words.setdefault(data[a:b], len(words)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int32), list(words)


def _array_and_lcp(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and how many words each row has in common with the one before it in that order."""
    order = np.lexsort(words.T[::-1]) if words.shape[1] else np.arange(len(words))
    rows = words[order]
    differ = rows[1:] != rows[:-1]
    return order, np.where(differ.any(1), differ.argmax(1), words.shape[1]) if words.shape[1] else np.zeros(max(len(words) - 1, 0), int)


def _node(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """The number of the node of this depth above each row."""
    out = np.empty(len(order), np.int64)
    out[order] = np.concatenate(([0], np.cumsum(lcp < depth)))
    return out


def later_windows(key: np.ndarray, doc: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """[suffix, o]: whether the window that starts o words before the suffix's anchor also lies, at a suffix given, in a smaller document.

    words: before and from the anchor, -1 where the document has none; suffixes with different keys have no common window.
    """
    before = words.shape[1] - window
    later = np.zeros((len(doc), before + 1), bool)
    if not len(doc):
        return later
    order = np.lexsort((doc, key))
    new = _starts(key[order])
    group = np.cumsum(new) - 1
    several = np.zeros(int(group[-1]) + 1, bool)
    several[group[doc[order] != doc[order][new][group]]] = True
    live = np.sort(order[several[group]])
    if not len(live):
        return later
    right, left, doc = words[live, before:], words[live, :before][:, ::-1], doc[live]
    ahead, back = _array_and_lcp(right), _array_and_lcp(left)
    for o in range(before + 1):
        whole = np.flatnonzero((right[:, window - o - 1] >= 0) & (left[:, o - 1] >= 0 if o else True)) if window > o else np.empty(0, int)
        code = (_node(*ahead, window - o) * (len(live) + 1) + (_node(*back, o) if o else 0))[whole]
        order = np.lexsort((doc[whole], code))
        new = _starts(code[order])
        least = doc[whole][order][new][np.cumsum(new) - 1] if len(order) else doc[:0]
        later[live[whole[order]], o] = doc[whole][order] != least
    return later


def _dump(arrays: list[np.ndarray], words: list[bytes]) -> bytes:
    """Arrays, byte by byte as in pack, and words, which hold no space."""
    parts = [np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()]
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return b"".join([*parts, b" ".join(words)])


def _load(value: bytes, dtypes: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
    at, out = 8 * (len(dtypes) + 1), []
    for n, t in zip(np.frombuffer(value, np.int64, len(dtypes), 8).tolist(), dtypes, strict=True):
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(value, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out, value[at:].split(b" ")


#: Of a packed value: documents and tags; of each suffix the key, its document's place there, the place of its anchor, and its words' numbers from 1, 0 for none.
_SUFFIXES = ["<i8", "<i8", "<u8", "<u4", "<u4", "<u4"]


class _Held:
    """Suffixes of a task, gathered until they are settled."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, key: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, numbers: np.ndarray, words: list[bytes]) -> None:
        known = np.array([self.words.setdefault(x, len(self.words)) for x in words] + [-1], np.int32)
        self.parts.append((key, doc, tag, pos, known[numbers]))
        self.size += len(key)

    def take(self) -> tuple[list[np.ndarray], list[bytes]]:
        out = [np.concatenate(c) for c in zip(*self.parts, strict=True)], list(self.words)
        self.__init__()
        return out


def _size_of(docs: DataFrame, window: int) -> int:
    """About how many anchors there are, from the texts' lengths: two in each run of as many words as a window has prefixes, words of six characters."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return int(chars / 6 * 2 / (window - min(PREFIX, window) + 2)) + 1


def _shared_anchors(docs: DataFrame, window: int, size: int) -> DataFrame:
    """(doc_id, tag, places, n): anchors whose prefix starts in at least two documents. Rows without doc_id: prefixes with GROUP suffixes or more (tag),
    and how many (n); tag 0 has the number of all."""
    k = max(1, math.ceil(size / BUCKET))
    few = max(1, k // 4)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, tag, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((doc, key))
            key, doc, tag, pos = key[order], doc[order], tag[order], pos[order]
            new = _starts(key)
            group = np.cumsum(new) - 1
            several = np.zeros(int(group[-1]) + 1, np.uint8)
            several[group[doc != doc[new][group]]] = 1
            # A shared prefix sends one suffix, with their number, for the other tasks to see; its own are known to be shared.
            known, count = several[group] == 1, np.diff(np.append(np.flatnonzero(new), len(key)))[group]
            count = np.where(known, count, 1).astype("<u4")
            one = ~known | new
            # Back in the documents' order, where neighbours share most bytes and so compress.
            back = np.argsort(order)
            key, doc, tag, pos, known, one, count = (x[back] for x in (key, doc, tag, pos, known, one, count))
            if known.any():
                yield packed_batch([(b, b"S" + v) for b, v in pack(doc[known] % few, few, [doc[known], tag[known], pos[known]])])
            yield packed_batch([(b, b"P" + v) for b, v in pack(((key[one] >> U(20)) % U(k)).astype(np.int64), k, [key[one], doc[one], tag[one], pos[one], count[one], known[one].astype(np.uint8)])])

        for t in chunks(batches):
            w = tk.words(t["text"].to_pylist(), lower=False)
            at, g, _ = anchor_places(w, window)
            doc = w.doc[at]
            parts.append((g[at], t["doc_id"].to_numpy()[doc], t["tag"].to_numpy()[doc], (at - w.first[doc]).astype(np.uint32)))
            held += len(at)
            if held > FLUSH:
                yield from flush()
                parts, held = [], 0
        if held:
            yield from flush()

    def meet(values: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = [(int(unpack([v[1:]], ["<i8", "<i8", "<u4"])[0][0] % few), b"D" + v[1:]) for v in values if v[:1] == b"S"]
        key, d, t, p, count, several = unpack([v[1:] for v in values if v[:1] == b"P"], ["<u8", "<i8", "<i8", "<u4", "<u4", "<u1"])
        if len(key):
            order = np.lexsort((d, key))
            key, d, t, p, count, several = key[order], d[order], t[order], p[order], count[order], several[order]
            new = _starts(key)
            group = np.cumsum(new) - 1
            shared = np.zeros(int(group[-1]) + 1, bool)
            shared[group[(d != d[new][group]) | (several == 1)]] = True
            live = shared[group] & (several == 0)
            if live.any():
                out += [(b, b"D" + v) for b, v in pack(d[live] % few, few, [d[live], t[live], p[live]])]
            total = np.bincount(group, count * shared[group], len(shared)).astype(np.int64)
            many = total >= GROUP
            out.append((0, b"F" + next(iter(pack(np.zeros(many.sum() + 1, np.int64), 1, [np.append(key[new][many].view(np.int64), 0), np.append(total[many], total.sum())])))[1]))
        if out:
            yield packed_batch(out)

    return _by_document(exchange(docs.mapInArrow(send, EXCHANGED), k, meet, EXCHANGED), few)


def _grown(anchors: DataFrame, window: int) -> tuple[dict[int, np.ndarray], int]:
    """Prefixes that are grown, by the number of words they get, and the number of all suffixes.

    Four times the suffixes ask for two more words; a group of suffixes with all words of a window in common needs no more.
    """
    rows = anchors.where("doc_id is null").select(F.col("tag").alias("key"), "n")
    total = int(rows.where("key = 0").agg(F.sum("n")).first()[0] or 0)
    found: dict[int, list[int]] = {}
    for r in rows.where("key <> 0").orderBy(F.desc("n"), "key").limit(MOST_GROWN).collect():
        words = min(window, min(PREFIX, window) + 2 * (1 + int(math.log(r.n / GROUP, 4))))
        found.setdefault(words, []).append(r.key)
    return {words: np.array(keys, np.int64).view(np.uint64) for words, keys in found.items()}, total


def _later_places(docs: DataFrame, window: int, grown: dict[int, np.ndarray], size: int) -> DataFrame:
    """(doc_id, tag, places): starts of windows that also start in a document with a smaller doc_id; docs come with the places of live anchors."""
    before = window - min(PREFIX, window)
    k = max(1, math.ceil(size / BUCKET_WORDS))
    few = max(1, k // 4)

    def settle(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, words: np.ndarray) -> tuple[list[tuple[int, bytes]], np.ndarray]:
        """Packed places of the windows that a smaller document has, and which suffixes have another one."""
        later = later_windows(key, doc, words, window)
        open_ = np.zeros(len(doc), bool)
        for o in range(before + 1):
            open_ |= (words[:, before + window - o - 1] >= 0) & (words[:, before - o] >= 0) & ~later[:, o]
        row, o = np.nonzero(later)
        places = np.unique(np.stack([doc[row], tag[row], pos[row].astype(np.int64) - o], 1), axis=0)
        return [(b, b"D" + v) for b, v in pack(places[:, 0] % few, few, [places[:, 0], places[:, 1], places[:, 2].astype("<u4")])] if len(places) else [], open_

    def suffixes(w: tk.Words, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Keys, places and the words before them that count: of live anchors, and of windows whose anchor's prefix is grown."""
        g = tk.grams(w.hash, min(PREFIX, window))
        if not grown:
            yield g[live], live, before
            return
        heavy = np.isin(g[live], np.concatenate(list(grown.values())))
        yield g[live[~heavy]], live[~heavy], before
        own = anchor_places(w, window)[2]
        there = np.zeros(len(w.hash) + 1, bool)
        there[live[heavy]] = True
        start = np.flatnonzero(there[own])  # own is -1 where no window starts, and no anchor lies at the last place
        for words, keys in grown.items():
            at = start[np.isin(g[own[start]], keys)]
            yield tk.mix(tk.grams(w.hash, words, words)[at]) if len(at) else np.empty(0, np.uint64), at, 0

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def flush() -> Iterator[pa.RecordBatch]:
            (key, doc, tag, pos, numbers), words = held.take()
            done, stay = settle(key, doc, tag, pos, numbers)
            # In the documents' order, where neighbours share most bytes and so compress.
            key, doc, tag, pos, numbers = key[stay], doc[stay], tag[stay], pos[stay], numbers[stay] + 1
            out = [(b, b"L" + v) for b, v in done]
            bucket = ((key >> U(20)) % U(k)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(k + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                rows = order[edges[b] : edges[b + 1]]
                owner, place = np.unique(np.stack([doc[rows], tag[rows]], 1), axis=0, return_inverse=True)
                used, flat = np.unique(numbers[rows], return_inverse=True)
                flat = flat.reshape(-1) + (0 if used[0] == 0 else 1)
                names = [words[x - 1] for x in used.tolist() if x]
                out.append((b, b"S" + _dump([owner[:, 0], owner[:, 1], key[rows], place.reshape(-1).astype("<u4"), pos[rows], flat.astype("<u4")], names)))
            if out:
                yield packed_batch(out)

        for t in chunks(batches):
            w = tk.words(t["text"].to_pylist(), lower=False)
            live = np.unique(np.concatenate([w.first[row] + np.frombuffer(p, "<u4").astype(np.int64) for row, p in enumerate(t["places"].to_pylist())]))
            numbers, words = word_numbers(w)
            owner = w.doc
            ids, tags = t["doc_id"].to_numpy(), t["tag"].to_numpy()
            for key, at, front in suffixes(w, live):
                for lo in range(0, len(at), FLUSH_WORDS):
                    a = at[lo : lo + FLUSH_WORDS]
                    doc = owner[a]
                    place = a[:, None] + np.arange(-before, window)
                    there = (place >= np.maximum(w.first[doc], a - front)[:, None]) & (place < w.first[doc + 1][:, None])
                    place[~there] = 0
                    number = numbers[place]
                    number[~there] = -1
                    held.add(key[lo : lo + FLUSH_WORDS], ids[doc], tags[doc], (a - w.first[doc]).astype(np.uint32), number, words)
                    if held.size >= FLUSH_WORDS:
                        yield from flush()
        if held.size:
            yield from flush()

    def meet(values: list[bytes]) -> Iterator[pa.RecordBatch]:
        out = [(int(unpack([v[2:]], ["<i8", "<i8", "<u4"])[0][0] % few), v[1:]) for v in values if v[:1] == b"L"]
        known: dict[bytes, int] = {}
        parts = []
        for v in values:
            if v[:1] == b"S":
                (docs_, tags, key, place, pos, flat), names = _load(v[1:], _SUFFIXES)
                number = np.array([-1] + [known.setdefault(x, len(known)) for x in names], np.int32)
                parts.append((key, docs_[place], tags[place], pos, number[flat].reshape(len(key), -1)))
        if parts:
            out += settle(*(np.concatenate(c) for c in zip(*parts, strict=True)))[0]
        if out:
            yield packed_batch(out)

    return _by_document(exchange(docs.mapInArrow(send, EXCHANGED), k, meet, EXCHANGED), few)


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs with a doc_id.

    Words are runs of anything but 0x20 and 0x09-0x0D, unchanged. Each word goes that a window covers whose words also
    start in a document with a smaller doc_id; windows are judged on the input. kept_text: the kept words, joined by one
    space. Null text has no words. Rows that repeat a doc_id are one document for this purpose: they don't remove each
    other's words. Other columns are ignored; texts with fewer words than a window stay; an empty table gives an empty
    result.
    """
    tuned(docs.sparkSession)
    docs = id_text(docs).withColumn("tag", F.xxhash64("text"))
    key = ["doc_id", "tag"]
    # What a step leaves is small; with it written, the step's own shuffle files can go before the next one moves texts.
    anchors = cut(_shared_anchors(docs, window, _size_of(docs, window)))
    release(docs.sparkSession)
    grown, size = _grown(anchors, window)
    gone = cut(_later_places(docs.join(anchors.where("doc_id is not null").drop("n"), key), window, grown, size))
    release(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            n_words, n_removed, kept = [], [], []
            for text, places in zip(t["text"].to_pylist(), t["places"].to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if places:
                    cover = np.zeros(len(words) + 1, np.int64)
                    p = np.unique(np.frombuffer(places, "<u4")).astype(np.int64)
                    cover[p] += 1
                    cover[p + window] -= 1
                    stay = np.cumsum(cover[:-1]) == 0
                    words = [words[x] for x in np.flatnonzero(stay).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return docs.join(gone, key, "left").select("doc_id", "text", "places").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")
