"""Exact repeats of a fixed length over all texts, found through content-chosen anchors; shared by both substring operators.

A *window* is `length` units (bytes or words) of one text. Each window is given an anchor inside it by a rule that looks at the
window's content alone, so equal windows have equal anchors at equal offsets. Consecutive windows mostly share their anchor: an
anchor stands for the windows that chose it. The stages, whatever the unit:

1. Each scan batch names its anchors: `gram` hashes the anchor itself, `ctx` all that its windows cover. Anchors equal in
   both are one class. Copies inside a batch are decided at once and one of them is sent on, so a passage that a third of all
   texts share leaves each batch once. The rest travels as packed columns, a block for each bucket of grams.
2. Each bucket groups its anchors. A gram with one class needs no more work; where contexts differ, the first anchor of each
   class is asked for its content.
3. Their texts are read again by a join. Either every window that they ask about is hashed and meets its like as the anchors
   did, in packed columns by bucket, after copies in a task have been decided there: that spreads a gram of any size. Or, where a
   unit has `resolve` and the gram has few contexts, contents meet by gram and `resolve` compares their windows.
4. All ranges found meet their text by a join, and `finish` makes the rows.

Which of equal windows are covered: mode "all" every one that occurs twice, "later" all but the first in (id, key, place)
order, "smaller" those that a smaller id holds as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, mix, named, slices, staged, text_buffers, whole_ids

SLICE_BYTES = 1 << 20
#: Contexts of one gram beyond which its windows are dealt out by hash even where a unit could resolve them together.
HOT_CONTEXTS = 8_000
#: Anchors that a scan task gathers before it packs them; copies among them are decided on the spot.
ANCHORS_AT_ONCE = 300_000
#: Bytes of contents that are compared at once, at least a whole gram's.
RESOLVE_BYTES = 2 << 20
#: Buckets of grams to each shuffle partition.
BUCKETS_A_PARTITION = 2
NO_ID = -(1 << 63)

ANCHOR = np.dtype([("gram", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("pos", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("many", "<i4")])


@dataclass(frozen=True)
class Unit:
    """length of a window; mode; slice_bytes of text to look at at once; anchors(data, offsets) -> (row, pos, lo, hi, gram, ctx), where windows pos - lo .. pos - hi chose pos;
    windows(text, starts) -> a hash for each of the windows that begin there; if contents of one gram can be resolved together:
    contents(text, pos, lo, hi) -> bytes of what those windows cover, and resolve(anchors, contents) -> (index, first, last) runs of covered windows."""

    length: int
    mode: str
    slice_bytes: int
    anchors: Callable
    windows: Callable
    contents: Callable | None = None
    resolve: Callable | None = None
    resolve_bytes: int = RESOLVE_BYTES


def text_key(text: bytes) -> int:
    """With the id it names a text; equal rows share it."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def pack_columns(rows: np.ndarray) -> bytes:
    """Anchor rows column by column; sorted grams as differences, so they compress."""
    rows = rows[np.argsort(rows["gram"])]
    texts, which = _texts_of(rows)
    parts = [np.diff(rows["gram"], prepend=U64(0)).tobytes(), rows["ctx"].tobytes(), which.astype("<u4").tobytes(), rows["pos"].astype("<i8").tobytes(), rows["lo"].astype("<u2").tobytes(), rows["hi"].astype("<u2").tobytes(), rows["many"].astype("<u1").tobytes(), texts.astype("<i8").tobytes()]
    head = np.array([len(rows), len(texts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(_planes(p, w) for p, w in zip(parts, (8, 8, 4, 8, 2, 2, 1, 8))))


def _texts_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different texts (id, key) of the rows, and the number of each row's text among them."""
    both = np.stack([rows["doc"], rows["key"]], axis=1)
    _, at, which = np.unique(mix(rows["doc"].view(U64) ^ mix(rows["key"].view(U64))), return_index=True, return_inverse=True)
    texts = both[at]
    if np.array_equal(texts[which], both):
        return texts, which
    return np.unique(both, axis=0, return_inverse=True)  # two texts share the mixture


def _planes(column: bytes, width: int) -> bytes:
    """Byte planes: high bytes that rarely change lie together."""
    return np.frombuffer(column, np.uint8).reshape(-1, width).T.tobytes()


def unpack_columns(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw[:16], "<i8")
    at, out = 16, np.empty(n, ANCHOR)

    def column(kind, count):
        nonlocal at
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        at += count * width
        return np.ascontiguousarray(planes.T).view(kind).ravel()

    out["gram"] = np.cumsum(column("<u8", n))
    out["ctx"] = column("<u8", n)
    which = column("<u4", n)
    for name, kind in (("pos", "<i8"), ("lo", "<u2"), ("hi", "<u2"), ("many", "<u1")):
        out[name] = column(kind, n)
    texts = column("<i8", m * 2).reshape(m, 2)
    out["doc"], out["key"] = texts[which, 0], texts[which, 1]
    return out


def _by_class(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows ordered by class and, inside one, by id, key and place; the starts of the classes."""
    cls = mix(rows["gram"] ^ mix(rows["ctx"]))
    order = np.argsort(cls)
    sorted_cls = cls[order]
    met = sorted_cls[1:] == sorted_cls[:-1]
    same = met.copy()
    for name in ("gram", "ctx"):  # both digests decide; their mixture only brings equal ones together
        same[met] &= (rows[name][order[1:]] == rows[name][order[:-1]])[met]
    if not np.array_equal(same, met):
        order = np.lexsort((rows["ctx"], rows["gram"]))
        same = (rows["gram"][order[1:]] == rows["gram"][order[:-1]]) & (rows["ctx"][order[1:]] == rows["ctx"][order[:-1]])
        sorted_cls = np.concatenate([[0], np.cumsum(~same)]) if len(rows) else sorted_cls
    if same.any():
        multi = np.zeros(len(rows), bool)
        multi[1:] |= same
        multi[:-1] |= same
        at = np.nonzero(multi)[0]
        part = rows[order[at]]
        order[at] = order[at][np.lexsort((part["pos"], part["key"], part["doc"], sorted_cls[at]))]
    starts = np.concatenate([[0], np.nonzero(~same)[0] + 1]) if len(rows) else np.empty(0, np.int64)
    return rows[order], starts


def _once(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each place: where the first copy stays, rows that repeat a text are that text."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["pos"][1:] != rows["pos"][:-1]) | (rows["key"][1:] != rows["key"][:-1]) | (rows["doc"][1:] != rows["doc"][:-1])
    new[starts] = True
    return rows[new], np.cumsum(new)[starts] - 1 if len(starts) else starts


def decide(rows: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors whose windows are all covered for sure by another of their class; those that stand for their class; those classes' number of anchors (2 for more)."""
    rows, starts = _by_class(rows)
    if mode == "later":
        rows, starts = _once(rows, starts)
    sizes = np.diff(np.append(starts, len(rows)))
    total = np.add.reduceat(rows["many"].astype(np.int64), starts) if len(rows) else sizes
    first = np.zeros(len(rows), bool)
    first[starts] = True
    if mode == "all":
        covered, stands = np.repeat(total > 1, sizes), first
    elif mode == "later":
        covered, stands = ~first, first
    else:
        covered = rows["doc"] > np.repeat(rows["doc"][starts], sizes)
        stands = ~covered
    heads = rows[stands].copy()
    heads["many"] = np.minimum(np.repeat(total, sizes)[stands], 2)
    return rows[covered], heads, starts


def merge_ranges(doc, key, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching ranges of a text become one."""
    if not len(doc):
        return doc, key, start, end
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new)
    # Running maximum of the ends inside each text: ends are lifted by a step per text that exceeds any of them.
    lift = group * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new[1:] |= start[1:] > reach[:-1]
    at = np.nonzero(new)[0]
    return doc[at], key[at], start[at], np.maximum.reduceat(reach, at)


RANGES = "doc long, key long, start long, end long"
_RANGE_NAMES = ("doc", "key", "start", "end")


def _ranges_of(rows: np.ndarray, length: int):
    return merge_ranges(rows["doc"], rows["key"], rows["pos"] - rows["lo"], rows["pos"] - rows["hi"] + length)


def _doc(docs: DataFrame, id_col: str):
    """The id, or NO_ID for none; the one id that would be taken for none is an error."""
    own = whole_ids(docs, id_col)
    return F.when(own == NO_ID, F.raise_error(F.lit(f"{id_col} {NO_ID} stands for a missing id"))).otherwise(F.coalesce(own, F.lit(NO_ID))).alias("doc")


def _named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(_doc(docs, id_col), F.coalesce(named(text), F.lit("")).alias("text"))


def _anchor_blocks(unit: Unit, buckets: int):
    """(bucket, block, doc, key, start, end): a block of anchors, or a range that is covered for sure."""

    def run(batches):
        found, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, unit.slice_bytes):
                part = data[offsets[i] : offsets[j]]
                row, pos, lo, hi, gram, ctx = unit.anchors(part, offsets[i : j + 1] - offsets[i])
                raw, o = part.tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                keys = np.array([text_key(raw[a:b]) for a, b in zip(o[:-1], o[1:])], np.int64)
                out = np.empty(len(row), ANCHOR)
                out["gram"], out["ctx"], out["doc"], out["key"], out["pos"], out["lo"], out["hi"], out["many"] = gram, ctx, ids[i + row], keys[row], pos, lo, hi, 1
                if unit.mode == "smaller":
                    out = out[out["doc"] != NO_ID]  # no id is smaller than none
                found.append(out)
                held += len(out)
                if held > ANCHORS_AT_ONCE:
                    yield _packed_rows(unit, buckets, np.concatenate(found))
                    found, held = [], 0
        if held:
            yield _packed_rows(unit, buckets, np.concatenate(found))

    return run


def _packed_rows(unit: Unit, buckets: int, rows: np.ndarray) -> pa.RecordBatch:
    """The blocks of a task's anchors that stand for their class, by bucket of grams, and the ranges that are covered for sure."""
    covered, heads, _ = decide(rows, unit.mode)
    bucket = (heads["gram"] >> U64(20)) % U64(buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by radix
    cuts = np.append(0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets)))
    blocks = [(b, pack_columns(heads[order[cuts[b] : cuts[b + 1]]])) for b in range(buckets) if cuts[b + 1] > cuts[b]]
    doc, key, start, end = _ranges_of(covered, unit.length)
    n, m = len(blocks), len(doc)
    none = lambda k: [None] * k
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array([b for b, _ in blocks] + (key % buckets).tolist(), pa.int64()),
        "block": pa.array([x for _, x in blocks] + none(m), pa.binary()),
        **{name: pa.array(none(n) + column.tolist(), pa.int64()) for name, column in zip(_RANGE_NAMES, (doc, key, start, end))},
    })


FOUND = "gram long, pos long, lo int, hi int, source boolean, hot boolean, " + RANGES


def _meet(unit: Unit, hot_contexts: int | None):
    """Rows of FOUND: ranges that are covered, and anchors (start null) whose content must be compared; without a number none are asked for."""

    def bucket_rows(blobs):
        rows = np.concatenate([unpack_columns(b) for b in blobs])
        covered, heads, _ = decide(rows, unit.mode)
        heads = heads[np.argsort(heads["gram"], kind="stable")]
        ask = np.zeros(len(heads), bool)
        hot = ask.copy()
        if len(heads) and hot_contexts is not None:
            starts = np.nonzero(np.append(True, heads["gram"][1:] != heads["gram"][:-1]))[0]
            sizes = np.diff(np.append(starts, len(heads)))
            differ = np.minimum.reduceat(heads["ctx"], starts) != np.maximum.reduceat(heads["ctx"], starts)
            open_ = np.minimum.reduceat(heads["many"], starts) < 2 if unit.mode == "all" else np.ones(len(starts), bool)
            ask, hot = np.repeat(differ & open_, sizes), np.repeat(sizes > hot_contexts, sizes)
        asked, hot = heads[ask], hot[ask]
        doc, key, start, end = _ranges_of(covered, unit.length)
        n, m = len(asked), len(doc)
        none = lambda k: [None] * k
        return pa.RecordBatch.from_pydict({
            "gram": pa.array(asked["gram"].view(np.int64).tolist() + none(m), pa.int64()),
            "pos": pa.array(asked["pos"].tolist() + none(m), pa.int64()),
            "lo": pa.array(asked["lo"].tolist() + none(m), pa.int32()),
            "hi": pa.array(asked["hi"].tolist() + none(m), pa.int32()),
            "source": pa.array((asked["many"] > 1).tolist() + none(m), pa.bool_()),
            "hot": pa.array(hot.tolist() + none(m), pa.bool_()),
            "doc": pa.array(asked["doc"].tolist() + doc.tolist(), pa.int64()),
            "key": pa.array(asked["key"].tolist() + key.tolist(), pa.int64()),
            "start": pa.array(none(n) + start.tolist(), pa.int64()),
            "end": pa.array(none(n) + end.tolist(), pa.int64()),
        })

    def run(batches):
        blobs, now = [], None
        for batch in batches:
            whole = batch.filter(pc.is_valid(batch.column(2)))
            if whole.num_rows:  # ranges pass through
                n = whole.num_rows
                yield pa.RecordBatch.from_pydict({"gram": pa.nulls(n, pa.int64()), "pos": pa.nulls(n, pa.int64()), "lo": pa.nulls(n, pa.int32()), "hi": pa.nulls(n, pa.int32()), "source": pa.nulls(n, pa.bool_()), "hot": pa.nulls(n, pa.bool_()), **{x: whole.column(i + 2) for i, x in enumerate(_RANGE_NAMES)}})
            blocks = batch.filter(pc.is_valid(batch.column(1)))
            for bucket, blob in zip(blocks.column(0).to_pylist(), blocks.column(1).to_pylist()):
                if bucket != now and blobs:
                    yield bucket_rows(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield bucket_rows(blobs)

    return run


def packed_texts(docs: DataFrame, id_col: str, text: str, rest: tuple[str, ...] = ()) -> DataFrame:
    """(doc, key, packed) of every row, compressed for the shuffles to come; other columns ride along in a struct, whatever their names."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            raw, o = data.tobytes(), offsets.tolist()
            texts = [raw[a:b] for a, b in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_key(t) for t in texts], pa.int64()), pa.array([pack.compress(t) for t in texts], pa.binary()), *batch.columns[2:]], names=["doc", "key", "packed", "rest"][: 3 + bool(rest)])

    along = [F.struct(*map(named, rest)).alias("rest")] if rest else []
    texts = docs.select(_doc(docs, id_col), F.coalesce(named(text), F.lit("")).alias("text"), *along)
    kinds = T.StructType().add("doc", T.LongType()).add("key", T.LongType()).add("packed", T.BinaryType())
    return texts.mapInArrow(run, kinds.add("rest", texts.schema["rest"].dataType) if rest else kinds)


CONTENT = "gram long, doc long, key long, pos long, lo int, hi int, source boolean, content binary"


def _contents(unit: Unit):
    """Content rows of the anchors that are asked for."""
    names = [x.split()[0] for x in CONTENT.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in CONTENT.split(", ")]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            doc, key, packed, asked = (c.to_pylist() for c in batch.columns)
            rows, held = [], 0
            for d, k, p, wants in zip(doc, key, packed, asked):
                text = unpack.decompress(p)
                pos, lo, hi = (np.array([w[x] for w in wants], np.int64) for x in ("pos", "lo", "hi"))
                for w, content in zip(wants, unit.contents(text, pos, lo, hi)):
                    rows.append((w["gram"], d, k, w["pos"], w["lo"], w["hi"], w["source"], content))
                    held += len(content) + 64
                if held > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _window_blocks(unit: Unit, buckets: int):
    """Every window of the anchors that are asked for as an anchor of its own, packed like the others.

    Its gram mixes the window's hash with the anchor's gram and the place in it, which equal windows share; ctx holds 32 more bits
    of those two.
    """

    def run(batches):
        unpack, found, held = zstandard.ZstdDecompressor(), [], 0
        for batch in batches:
            wants = batch.column(3)
            columns = {f.name: c for f, c in zip(wants.type.value_type, wants.flatten().flatten())}
            gram, pos, lo, hi = (columns[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gram", "pos", "lo", "hi"))
            source = columns["source"].to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(wants.value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            for d, k, p, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), ends.tolist()):
                text, all_counts = unpack.decompress(p.as_py()), np.concatenate([[0], np.cumsum(lo[start:end] - hi[start:end] + 1)])
                for i, j in slices(all_counts, ANCHORS_AT_ONCE):
                    at = np.arange(start + i, start + j)
                    counts = lo[at] - hi[at] + 1
                    which = np.repeat(at, counts)
                    shift = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                    begin = pos[which] - lo[which] + shift
                    spot = mix(gram[which].view(U64) + (lo[which] - shift).astype(U64))
                    out = np.zeros(len(which), ANCHOR)
                    out["gram"], out["ctx"], out["doc"], out["key"], out["pos"], out["many"] = mix(unit.windows(text, begin) ^ spot), mix(spot) >> U64(32), d, k, begin, 1 + source[which]
                    found.append(out)
                    held += len(out)
                    if held > ANCHORS_AT_ONCE:
                        yield _packed_rows(unit, buckets, np.concatenate(found))
                        found, held = [], 0
                start = end
        if held:
            yield _packed_rows(unit, buckets, np.concatenate(found))

    return run


def _resolve(unit: Unit):
    def ranges(columns):
        gram, doc, key, pos, lo, hi, source, content = columns
        rows = np.empty(len(gram), ANCHOR)
        rows["gram"], rows["ctx"], rows["doc"], rows["key"], rows["pos"], rows["lo"], rows["hi"], rows["many"] = np.array(gram, np.int64).view(U64), 0, doc, key, pos, lo, hi, np.where(source, 2, 1)
        if unit.mode == "later":
            _, one = np.unique(rows[["gram", "doc", "key", "pos"]], return_index=True)
            rows, content = rows[one], [content[i] for i in one]
        at, first, last = unit.resolve(rows, content)
        place = rows["pos"][at] - rows["lo"][at]
        found = merge_ranges(rows["doc"][at], rows["key"][at], place + first, place + last + unit.length)
        return pa.RecordBatch.from_pydict({x: pa.array(c) for x, c in zip(_RANGE_NAMES, found)})

    def run(batches):
        held, size, last = [[] for _ in range(8)], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > unit.resolve_bytes and row[0] != last:
                    yield ranges(held)
                    held, size = [[] for _ in range(8)], 0
                last = row[0]
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[7])
        if held[0]:
            yield ranges(held)

    return run


def find_repeats(docs: DataFrame, unit: Unit, id_col: str = "doc_id", text: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(doc, key, spans array<struct<start, end>>) of every text with covered windows; spans may overlap. A null id is NO_ID."""
    spark = docs.sparkSession
    buckets = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _named(docs, id_col, text).mapInArrow(_anchor_blocks(unit, buckets), "bucket long, block binary, " + RANGES)
    together = unit.resolve is not None
    found = staged(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(unit, hot_contexts if together else 0), FOUND))
    asked = found.where("start is null")
    wants = asked.groupBy("doc", "key", "hot").agg(F.collect_list(F.struct("gram", "pos", "lo", "hi", "source")).alias("wants"))
    one = packed_texts(docs, id_col, text).join(wants, ["doc", "key"])  # repeated rows give equal contents, whose ranges coincide
    windows = one.where("hot").select("doc", "key", "packed", "wants").mapInArrow(_window_blocks(unit, buckets), "bucket long, block binary, " + RANGES)
    ranges = windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(unit, None), FOUND).select(*_RANGE_NAMES)
    if together:
        contents = one.where("not hot").select("doc", "key", "packed", "wants").mapInArrow(_contents(unit), CONTENT)
        ranges = ranges.unionByName(contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(_resolve(unit), RANGES))
    every = found.where("start is not null").select(*_RANGE_NAMES).unionByName(ranges)
    return staged(every.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
