"""Binary matrices as a data source: rows of fixed width in part files, with an index of keys, written by tasks and committed by a manifest.

    df.write.format("tidewater_matrix").mode("append").option("path", p).option("kind", "f8").save()
    spark.read.format("tidewater_matrix").option("path", p).load()

A row is (key string, values array<double>); all rows of a table have as many values. Each task writes parts of little-endian
numbers and beside it the keys, sorted, with their row numbers. A part is known to readers only by the manifest of a commit, which the
driver writes last; what failed or repeated attempts leave behind is in no manifest and never read. Files go to any store that
pyarrow.fs opens; bare paths are local or mounted ones that all machines share.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Kinds of numbers: floating point of 8 and 4 bytes, unsigned whole numbers of 4 and 2.
KINDS = ("f8", "f4", "u4", "u2")
#: Rows that a reader takes from a part at once.
ROWS_AT_ONCE = 4096
#: Rows of a part at most; a task writes as many parts as it takes, so that a part's keys fit in memory at any size of a table.
ROWS_A_PART = 1 << 18


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[dict]:
    """The parts of all commits, in the order of their names."""
    from pyarrow import fs

    store, base = _store(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("commit-")]
    out = []
    for name in sorted(found):
        with store.open_input_stream(name) as f:
            out += json.loads(f.read())
    return out


@dataclass
class _Parts(WriterCommitMessage):
    """What a task wrote: (name, kind, rows, width) of each part."""

    parts: list[dict]


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "f8"), overwrite
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")

    def write(self, iterator):
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        parts, rows = [], iter(iterator)
        for first in rows:
            parts.append(self._write_part(store, base, chain([first], islice(rows, ROWS_A_PART - 1))))
            if parts[-1]["width"] != parts[0]["width"]:
                raise ValueError(f"rows of {parts[0]['width']} and {parts[-1]['width']} values in one matrix")
        return _Parts(parts)

    def _write_part(self, store, base: str, rows) -> dict:
        name, keys, width = f"part-{uuid.uuid4().hex}", [], None
        with store.open_output_stream(f"{base}/{name}.bin") as out:
            for key, values in ((r[0], r[1]) for r in rows):
                width = len(values) if width is None else width
                if len(values) != width:
                    raise ValueError(f"rows of {width} and {len(values)} values in one matrix")
                row = np.array(values, float)
                if self.kind[0] == "u" and not (row == np.clip(np.floor(row), 0, 2 ** (8 * int(self.kind[1])) - 1)).all():
                    raise ValueError(f"{key}: values that are no {self.kind}")
                out.write(row.astype(f"<{self.kind}").tobytes())
                keys.append(key)
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or ""))
        with store.open_output_stream(f"{base}/{name}.keys") as out:
            out.write("\n".join(json.dumps([keys[i], i], ensure_ascii=False) for i in order).encode())
        return {"name": name, "kind": self.kind, "rows": len(keys), "width": width or 0}

    def commit(self, messages):
        parts = [p for m in messages if m is not None for p in m.parts]
        store, base = _store(self.path)
        if len({p["width"] for p in parts + ([] if self.overwrite else _manifests(self.path))}) > 1:
            self.abort(messages)
            raise ValueError("rows of different widths in one matrix")
        store.create_dir(base, recursive=True)
        old = [] if not self.overwrite else self._commits(store, base)
        with store.open_output_stream(f"{base}/commit-{uuid.uuid1().time:020d}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(parts).encode())
        for name in old:
            store.delete_file(name)

    @staticmethod
    def _commits(store, base: str) -> list[str]:
        from pyarrow import fs

        return [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("commit-")]

    def abort(self, messages):
        store, base = _store(self.path)
        for p in (p for m in messages if m is not None for p in m.parts):
            for end in ("bin", "keys"):
                try:
                    store.delete_file(f"{base}/{p['name']}.{end}")
                except OSError:
                    pass  # the attempt did not come so far


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [InputPartition(p) for p in _manifests(self.path)] or [InputPartition(None)]

    def read(self, partition):
        part = partition.value
        if part is None:
            return
        store, base = _store(self.path)
        with store.open_input_stream(f"{base}/{part['name']}.keys") as f:
            keys = [None] * part["rows"]
            for line in f.read().decode().split("\n"):
                key, at = json.loads(line)
                keys[at] = key
        kind = np.dtype(f"<{part['kind']}")
        with store.open_input_stream(f"{base}/{part['name']}.bin") as f:
            for start in range(0, part["rows"], ROWS_AT_ONCE):
                n = min(ROWS_AT_ONCE, part["rows"] - start)
                rows = np.frombuffer(f.read(n * part["width"] * kind.itemsize), kind).reshape(n, part["width"]).astype(float)
                for k, row in enumerate(rows.tolist()):
                    yield keys[start + k], row


class MatrixSource(DataSource):
    @classmethod
    def name(cls):
        return "tidewater_matrix"

    def schema(self):
        return "key string, values array<double>"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(MatrixSource)


def look_up(path: str, key: str) -> list[list[float]]:
    """The rows of one key: a search in each part's sorted keys, then one read at the row's offset."""
    store, base = _store(path)
    out = []
    for part in _manifests(path):
        with store.open_input_stream(f"{base}/{part['name']}.keys") as f:
            rows = [r for r in map(json.loads, f.read().decode().split("\n")) if r[0] is not None]
        kind = np.dtype(f"<{part['kind']}")
        size = part["width"] * kind.itemsize
        at = bisect_left(rows, key, key=lambda r: r[0])
        with store.open_input_file(f"{base}/{part['name']}.bin") as f:
            while at < len(rows) and rows[at][0] == key:
                out.append(np.frombuffer(f.read_at(size, rows[at][1] * size), kind).astype(float).tolist())
                at += 1
    return out


def scaled(df, columns: list[str], most: int = 65_535):
    """Columns scaled to whole numbers from 0 to most by their least and greatest value; a column of one value gives 0."""
    from pyspark.sql import functions as F

    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    ends = df.agg(*[f(quoted(c)).alias(f"{n} {i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    for i, c in enumerate(columns):
        span = F.col(f"high {i}") - F.col(f"low {i}")
        out = out.withColumn(c, F.when(span > 0, F.floor((quoted(c) - F.col(f"low {i}")) / span * most)).when(quoted(c).isNotNull(), 0).cast("long"))
    return out.drop(*ends.columns)
