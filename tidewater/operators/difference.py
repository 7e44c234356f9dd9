"""Differences of two texts as edit scripts of words or characters, for many pairs at once in Arrow batches.

The longest common subsequence comes from bit rows: one addition and a few masks of whole rows for each unit of the second text,
so a pair of n and m units costs n * m / 64 word operations at worst and next to nothing where the texts agree, since common ends are
taken off first. Rows are kept only while they are small; longer pairs are halved where a best script crosses the middle
(linear memory).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import prefix_max

#: Bytes of bit rows that are kept for one pair.
ROW_BYTES = 16 << 20
SCRIPT = "array<struct<op: string, n: long, units: string>>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows(a: list, b: list, keep: bool):
    """Bit rows of the table of common subsequences: a zero at place i of row j says that a[i] lengthens what a[:i] and b[:j] share."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    rows = [row]
    for x in b:
        common = row & where.get(x, 0)
        row = ((row + common) | (row - common)) & every
        if keep:
            rows.append(row)
    return rows if keep else row


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of b with each beginning of a."""
    row = _rows(a, b, False)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common_pairs(a: list, b: list, row_bytes: int = ROW_BYTES) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of two lists, in order."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        tail = []
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            tail.append((i_end, j_end))
        if i < i_end and j < j_end:
            x, y = a[i:i_end], b[j:j_end]
            if len(x) * len(y) // 8 <= row_bytes or len(y) == 1:
                rows, p, q = _rows(x, y, True), len(x), len(y)
                while p and q:
                    if x[p - 1] == y[q - 1]:
                        p, q = p - 1, q - 1
                        tail.append((i + p, j + q))
                    elif rows[q] >> (p - 1) & 1:
                        p -= 1
                    else:
                        q -= 1
            else:
                middle = len(y) // 2
                split = int(np.argmax(_lengths(x, y[:middle]) + _lengths(x[::-1], y[middle:][::-1])[::-1]))
                # Halves are taken in order; the common tail waits below them.
                todo.append((i_end, i_end + len(tail), j_end, j_end + len(tail)))
                todo.append((i + split, i_end, j + middle, j_end))
                todo.append((i, i + split, j, j + middle))
                continue
        found += tail[::-1]
    return found


def edit_script(a: list, b: list, row_bytes: int = ROW_BYTES) -> list[tuple[str, int, int, int]]:
    """Runs (op, from, to, n): `=` units of a from .. to that stay, `-` units of a that go, `+` units of b that come, in order."""
    out: list[tuple[str, int, int]] = []

    def add(op: str, start: int, end: int) -> None:
        if start < end:
            if out and out[-1][0] == op == "=":
                out[-1] = (op, out[-1][1], end)
            else:
                out.append((op, start, end))

    i = j = 0
    for p, q in [*common_pairs(a, b, row_bytes), (len(a), len(b))]:
        add("-", i, p)
        add("+", j, q)
        add("=", p, min(p + 1, len(a)))
        i, j = p + 1, q + 1
    return [(op, s, e, e - s) for op, s, e in out]


def text_difference(pairs: DataFrame, unit: str = "word", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(id, n_same, n_deleted, n_inserted, script) of rows (id, a, b): the fewest deletions and insertions that make b of a.

    Units are words (runs without white space) or, with unit `char`, characters. The script lists runs of equal (`=`), deleted (`-`) and
    inserted (`+`) units with their text, deletions before insertions. A null text is empty.
    """
    if unit not in ("word", "char"):
        raise ValueError("unit must be word or char")
    cut, glue = (_WORD.findall, " ") if unit == "word" else (list, "")
    id_type = pairs.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("op", pa.string()), ("n", pa.int64()), ("units", pa.string())]))

    def run(batches):
        for batch in batches:
            counts, scripts = {"=": [], "-": [], "+": []}, []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, y = cut(a or ""), cut(b or "")
                script = edit_script(x, y, row_bytes)
                for op, n in counts.items():
                    n.append(sum(r[3] for r in script if r[0] == op))
                scripts.append([{"op": op, "n": n, "units": glue.join((y if op == "+" else x)[s:e])} for op, s, e, n in script])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[op], pa.int64()) for op in "=-+"), pa.array(scripts, kind)], ["id", "n_same", "n_deleted", "n_inserted", "script"])

    return pairs.select("id", F.col("a").cast("string"), F.col("b").cast("string")).mapInArrow(run, f"id {id_type}, n_same long, n_deleted long, n_inserted long, script {SCRIPT}")


def with_previous(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(id, before, a, b): each row's text (b) and that of the row before it (a) of its key, by a whole-number order without ties.

    The row before is a running greatest value, so a key of any size is spread over tasks; texts meet by id and are never sorted.
    """
    ids = df.where(F.col(order).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("id"))
    known = prefix_max(ids, F.col("id"), ["id"], "before", False, by="key").where("before is not null").select("id", "before")
    texts = lambda i, t: df.select(F.col(order).alias(i), F.col(text).alias(t))
    return known.join(texts("before", "a"), "before").join(texts("id", "b"), "id").select("id", "before", "a", "b")
