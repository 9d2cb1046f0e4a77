"""JSON lines as a Spark data source, `response_log`: read by ranges of bytes, written by whole commits.

    spark.dataSource.register(ResponseLog)
    df.write.format("response_log").option("commit", "run-7").mode("append").save(path)
    spark.read.format("response_log").schema(schema).load(path)

Reading: a file is cut in ranges of `range_bytes`; a line belongs to the range that its first byte lies in. Lines that are no JSON object, as a writer that was killed leaves
them, are left out; columns that a line lacks, or has with another type, are null. Where the folder has commits, only files that they list are read; else all *.jsonl files below it.

Writing: a task writes a file of its own, which counts only when the driver's commit lists it. A commit of a name that is already there adds nothing, so a repeated run stores
nothing twice. Files of tasks that failed, or of a commit that was given up, are removed or stay unlisted.

Workers open the files themselves, so the folder must be one that all of them see as a local path; for other stores use readers.read_responses.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .readers import RESPONSE

#: Bytes of a range; lines of a batch.
RANGE_BYTES, LINES = 16_000_000, 5_000
COMMITS = "_commits"


def _local(path: str) -> Path:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is not a path that workers can open; read it with readers.read_responses")
    return Path("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)


def _files(folder: Path) -> list[Path]:
    if (folder / COMMITS).is_dir():
        listed = (json.loads(p.read_text()) for p in sorted((folder / COMMITS).glob("*.json")))
        return [folder / name for names in listed for name in names]
    return sorted(folder.rglob("*.jsonl")) if folder.is_dir() else [folder]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def lines_of(path: str, begin: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte lies in [begin, end)."""
    with open(path, "rb") as f:
        if begin:
            f.seek(begin - 1)
            f.readline()  # the rest of the line before, or nothing but its end
        while f.tell() < end and (line := f.readline()):
            yield line


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.folder = schema, _local(options["path"])
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        sizes = ((p, p.stat().st_size) for p in _files(self.folder))
        return [Range(str(p), k, min(k + self.range_bytes, n)) for p, n in sizes for k in range(0, n, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)

        def batch(rows: list[dict]) -> pa.RecordBatch:
            arrays = []
            for f in schema:
                values = [r.get(f.name) for r in rows]
                try:
                    arrays.append(pa.array(values, f.type))
                except (pa.ArrowException, TypeError, OverflowError):  # one value at a time, where some don't fit
                    arrays.append(pa.array([_fitting(v, f.type) for v in values], f.type))
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        rows: list[dict] = []
        for line in lines_of(part.path, part.begin, part.end) if part.path else ():
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict):
                rows.append(value)
            if len(rows) == LINES:
                yield batch(rows)
                rows = []
        yield batch(rows)


def _fitting(value: object, kind: pa.DataType) -> object:
    try:
        return pa.scalar(value, kind).as_py()
    except (pa.ArrowException, TypeError, OverflowError):
        return None


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("a log only grows: use mode append")
        self.folder, self.commit_name = str(_local(options["path"])), options.get("commit") or uuid.uuid4().hex
        if "/" in self.commit_name:
            raise ValueError("a commit's name is part of a file name")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, name)
        try:
            with open(path, "w", encoding="utf-8") as f:
                for b in batches:
                    for row in b.to_pylist():
                        f.write(json.dumps({k: v for k, v in row.items() if v is not None}, default=str) + "\n")
                        n += 1
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            Path(path).unlink(missing_ok=True)
            raise
        return _Written(name, n)

    def _drop(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None:
                Path(self.folder, m.name).unlink(missing_ok=True)

    def commit(self, messages: list[_Written | None]) -> None:
        commits = Path(self.folder, COMMITS)
        commits.mkdir(parents=True, exist_ok=True)
        draft, final = commits / f".{uuid.uuid4().hex}", commits / f"{self.commit_name}.json"
        names = sorted(m.name for m in messages if m is not None and m.rows)
        draft.write_text(json.dumps(names))
        try:
            os.link(draft, final)  # fails if the commit is there already
        except FileExistsError:
            self._drop(messages)
        else:
            self._drop([m for m in messages if m is not None and not m.rows])
        finally:
            draft.unlink()

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(messages)


class ResponseLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "response_log"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)
