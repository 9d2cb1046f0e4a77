"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

Each task reads its documents in order and keeps `open_windows` open windows, whatever it has read. A document's tokens
are cut into full sequences; the rest goes to the open window that it fits best. If none fits, the fullest window takes
as much of it as fills it and is emitted, and the rest is placed again; so every emitted sequence is full. At its end a
task cuts its open windows into full sequences too, and one short one is left per task. Those are merged, in groups of
MERGE tasks by the same rule, until one group is left: one sequence of the whole input is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, id_text, tuned

#: Left-over sequences that one task merges.
MERGE = 512
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ALL = _OUT + ", ids binary"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
Piece = tuple[int, int, int, np.ndarray]  # doc_id, start, doc_tokens, ids


class Packer:
    """Takes pieces, gives full sequences; holds `n` windows of fewer than `length` tokens at most."""

    def __init__(self, length: int, n: int) -> None:
        self.length, self.n = length, n
        self.windows: list[tuple[int, list[Piece]]] = []  # tokens so far, pieces

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, total, ids = piece
        while len(ids) >= self.length:
            yield [(doc, start, total, ids[: self.length])]
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [k for k, (used, _) in enumerate(self.windows) if used + len(ids) <= self.length]
            if fits or len(self.windows) < self.n:
                best = max(fits, key=lambda k: self.windows[k][0], default=None)
                # A new window only if no window fits.
                used, held = self.windows.pop(best) if best is not None else (0, [])
                held.append((doc, start, total, ids))
                if (used := used + len(ids)) == self.length:
                    yield held
                else:
                    self.windows.append((used, held))
                return
            used, held = self.windows.pop(max(range(len(self.windows)), key=lambda k: self.windows[k][0]))
            room = self.length - used
            held.append((doc, start, total, ids[:room]))
            yield held
            start, ids = start + room, ids[room:]

    def close(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Full sequences from what is open, and a rest of fewer tokens than a sequence."""
        full, last, used = [], [], 0
        for _, held in sorted(self.windows, key=lambda x: -x[0]):
            for doc, start, total, ids in held:
                while used + len(ids) >= self.length:
                    room = self.length - used
                    full.append([*last, (doc, start, total, ids[:room])])
                    start, ids, last, used = start + room, ids[room:], [], 0
                if len(ids):
                    last.append((doc, start, total, ids))
                    used += len(ids)
        self.windows = []
        return full, last


class _Rows:
    def __init__(self, base: int) -> None:
        self.sequence, self.rows = base, []

    def put(self, pieces: list[Piece], with_ids: bool = False) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.sequence, at, raw if with_ids else None))
            at += len(ids)
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], [*_NAMES, "ids"])


#: White space as the split of byte-level vocabularies has it (Unicode's White_Space).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places where that split always cuts: before the one space in front of a word, and around other white space.
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Units whose ids a task remembers at once; characters of a unit from which tiktoken, whose split recurses, isn't asked.
CACHED, LONG_UNIT = 600_000, 10_000


class _Ids(dict):
    """Packed ids by unit."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        out = np.array(self.encode(unit), "<u4").tobytes()
        if len(unit) < LONG_UNIT:
            if len(self) >= CACHED:
                self.clear()
            self[unit] = out
        return out


def tokenizer(path: str) -> Callable[[str], np.ndarray]:
    """encode(text) -> the ids that the tokenizers library gives for the file at path, without special tokens added.

    If the file is a byte-level BPE with the usual split, units between its certain cuts are encoded once and remembered;
    tiktoken encodes them, with the file's own vocabulary. Very long units, texts that hold a special token, and all texts for
    other files go to the tokenizers library.
    """
    from tokenizers import Tokenizer

    spec, slow = json.loads(Path(path).read_text()), Tokenizer.from_file(path)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    whole = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or not plain.items() <= (spec["pre_tokenizer"] or {}).items():
        return whole
    import public_tokenizers
    import tiktoken

    byte_of = _byte_alphabet()
    ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ids = _Ids(lambda unit: fast(unit) if len(unit) < LONG_UNIT else slow.encode(unit, add_special_tokens=False).ids)
    return lambda text: whole(text) if any(x in text for x in special) else np.frombuffer(b"".join(map(ids.__getitem__, _UNITS.findall(text))), "<u4")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 1024, open_windows: int = 16, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (null: none) and end_id. Every id lies in one piece; offsets have no gaps; all
    sequences but one are full. Empty texts have one id. Rows that repeat a doc_id are packed each. Rows without doc_id
    are left out, other columns ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tuned(spark)
    docs = id_text(docs)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(tokenizer_path), Packer(length, open_windows)
        out = _Rows(TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                for sequence in packer.add((doc, 0, len(ids), ids)):
                    out.put(sequence)
            if len(out.rows) > 20_000:
                yield out.take()
        full, last = packer.close()
        for sequence in full:
            out.put(sequence)
        if last:
            out.put(last, with_ids=True)
        yield out.take()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merges the short sequences of a group; the group's least sequence_id and those after it are free again."""
        import itertools

        rows = (r for b in batches for r in zip(b.column("grp").to_pylist(), *(b.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "sequence_id", "ids")), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            packer, base, full = Packer(length, open_windows), None, []
            for _, doc, start, total, sequence, raw in group:
                base = sequence if base is None else base
                full += packer.add((doc, start, total, np.frombuffer(raw, "<u4")))
            more, last = packer.close()
            # Above the ids of the tasks' own sequences: bit 32 marks merged ones.
            out = _Rows(base | 1 << 32)
            for sequence in [*full, *more]:
                out.put(sequence)
            if last:
                out.put(last, with_ids=True)
            yield out.take()

    made = cut(docs.mapInArrow(first, _ALL))
    done, rest = made.where("ids is null").select(*_NAMES), made.where("ids is not null")
    n, level = max(1, docs.rdd.getNumPartitions()), 0
    while n > 1:
        level += 1
        groups = -(-n // MERGE)
        grouped = rest.withColumn("grp", F.shiftrightunsigned(F.col("sequence_id"), 33 + 9 * level))
        made = cut(grouped.repartition(groups, "grp").sortWithinPartitions("grp", "sequence_id", "offset").mapInArrow(again, _ALL))
        done = done.union(made.where("ids is null").select(*_NAMES))
        rest, n = made.where("ids is not null"), groups
    return done.union(rest.select(*_NAMES))
