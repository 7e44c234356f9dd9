"""Row-wise operators as streams, a windowed count with a watermark, and a sink that writes each batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, path: str, schema, format: str = "parquet", files_a_trigger: int = 100, glob: str = "*") -> DataFrame:
    """The files of a folder whose names fit, as they come."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", glob).load(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(window, key, n) in append mode once the watermark has passed a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose keys the stream has not met within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run all that is there, a batch at a time; the batch id lets the writer skip what it has done."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_states(events: DataFrame) -> DataFrame:
    """(key, runs, n): how many runs of one value, and how many rows, each key has had so far; events are (key, at, value), in order of `at`.

    State is a key's last value and its two counts. A batch's rows of a key are ordered; a later batch continues the open run.
    """

    def update(key, frames, state):
        last, runs, n = state.get if state.exists else (None, 0, 0)
        for value in pd.concat(list(frames)).sort_values("at")["value"]:
            runs += value != last or not n
            n += 1
            last = value
        state.update((last, int(runs), int(n)))
        yield pd.DataFrame({"key": [key[0]], "runs": [int(runs)], "n": [int(n)]})

    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").applyInPandasWithState(update, f"key {kind}, runs long, n long", "last string, runs long, n long", "update", "NoTimeout")


def told_windows(start: np.ndarray, end: np.ndarray, code: np.ndarray, names: list[str], needed: dict[str, int], width: int, stop: int, at_once: int = 1 << 14, mine: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pd.DataFrame]:
    """Frames (start, end, n, names) of the windows that begin with one of the first `stop` members, from some members at a time.

    Members are sorted; code is a member's place in names. With mine, only starts of which it is true begin a window.
    """
    low = 0
    while low < stop:
        # Members of one start stay together.
        high = int(np.searchsorted(start[:stop], start[min(low + at_once, stop) - 1], "right"))
        top = int(np.searchsorted(start, start[high - 1] + width))
        own, ends, codes = start[low:top], end[low:top], code[low:top]
        begins = np.unique(own[: high - low])
        begins = begins if mine is None else begins[mine(begins)]
        first, last = np.searchsorted(own, begins), np.searchsorted(own, begins + width)
        good = np.ones(len(begins), bool)
        for i, x in enumerate(names):
            count = np.concatenate([[0], np.cumsum(codes == i)])
            good &= count[last] - count[first] >= needed[x]
        spans = list(zip(first[good].tolist(), last[good].tolist()))
        if spans:
            yield pd.DataFrame({"start": begins[good], "end": [int(ends[a:z].max()) for a, z in spans], "n": [z - a for a, z in spans], "names": [[names[c] for c in codes[a:z]] for a, z in spans]})
        low = high


#: Positions of a stretch at least, the buckets that a chromosome's stretches are dealt to, and members that are packed at once.
STRETCH, BUCKETS, PACKED_AT_ONCE = 1 << 16, 64, 1 << 18


def _packed_members(chrom: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray, width: int, stretch: int, buckets: int) -> dict[tuple[int, int], bytes]:
    """The members of each chromosome and bucket: starts, ends and codes, 17 bytes a member.

    A member goes to the bucket of its stretch, and to that of the stretch before where windows that begin there reach it.
    """
    own, before = start // stretch, (start - (width - 1)) // stretch
    at = np.concatenate([np.arange(len(start)), np.nonzero(own != before)[0]])
    bucket = np.concatenate([own, before[own != before]]) % buckets
    group = chrom[at] * buckets + bucket
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    out = {}
    for rows in np.split(np.arange(len(at)), np.nonzero(np.diff(group))[0] + 1) if len(at) else ():
        mine = at[rows]
        out[divmod(int(group[rows[0]]), buckets)] = start[mine].tobytes() + end[mine].tobytes() + code[mine].tobytes()
    return out


def window_clusters(hits: DataFrame, needed: dict[str, int], width: int, slack: int = 0) -> DataFrame:
    """(chrom, start, end, n, names): the windows of motifs.motif_windows over a stream of hits (chrom, start, end, name), by position.

    A chromosome is cut into stretches of positions, dealt to buckets, so its windows are work for many tasks. Where they are read, hits that
    count are packed for the bucket of their stretch, and all buckets of a chromosome are told how far it has come.
    State is a bucket's members that a window may still need, of a chromosome those of one width and the slack, and how far that has come.
    A window is told once nothing that comes can begin in it: when a hit begins width + slack or more behind its start. Hits may
    come out of order within the slack; one that begins before windows already told is late and in none. A hit without a name only
    moves the position on, so that one such row far behind closes all windows at a stream's end. A bucket's members of a batch are held as
    17 bytes each, and windows are handed on some at a time.
    """

    names = list(needed)
    stretch, buckets, at_once = max(STRETCH, width), BUCKETS, PACKED_AT_ONCE
    kind = hits.schema["chrom"].dataType.simpleString()

    def deal(batches):
        places, furthest, held, count, chrom_type = {}, {}, [], 0, pa.null()

        def rows(every):
            packed = _packed_members(*(np.concatenate(c) for c in zip(*held)), width, stretch, buckets) if held else {}
            groups = [(c, b) for c in furthest for b in range(buckets)] if every else list(packed)
            own = list(places)
            columns = [pa.array([own[c] for c, _ in groups], chrom_type), pa.array([b for _, b in groups], pa.int32()), pa.array([furthest[c] for c, _ in groups], pa.int64()), pa.array([packed.get(g, b"") for g in groups], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chrom", "bucket", "furthest", "members"])

        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            chrom_type, coded = batch.schema.field(0).type, batch.column(0).dictionary_encode("encode")
            chrom = np.array([places.setdefault(c, len(places)) for c in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            start, code = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            # An end that is not known is none's greatest.
            end = batch.column(2).fill_null(np.iinfo(np.int64).min).to_numpy()
            top = np.full(len(places), np.iinfo(np.int64).min)
            np.maximum.at(top, chrom, start)
            for c in np.unique(chrom).tolist():
                furthest[c] = max(furthest.get(c, int(top[c])), int(top[c]))
            good = code >= 0
            held.append((chrom[good], start[good], end[good], code[good]))
            count += int(good.sum())
            if count >= at_once:
                yield rows(False)
                held, count = [], 0
        if furthest:
            yield rows(True)

    def update(key, frames, state):
        old, told = state.get if state.exists else ([], -1)
        parts = [(np.array([m[0] for m in old], np.int64), np.array([m[1] for m in old], np.int64), np.array([names.index(m[2]) for m in old], np.int8))]
        # The first start whose window is still open.
        reach = told
        for rows in frames:
            if not len(rows):
                continue
            reach = max(reach, int(rows["furthest"].max()) - slack - width)
            for packed in rows["members"]:
                n = len(packed) // 17
                start, end, code = np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.int64, n, 8 * n), np.frombuffer(packed, np.int8, n, 16 * n)
                good = start > told
                parts.append((start[good], end[good], code[good]))
        members = [np.concatenate(c) for c in zip(*parts)]
        parts.clear()
        order = np.lexsort((np.argsort(np.argsort(names))[members[2]], members[1], members[0])) if len(members[0]) else np.empty(0, np.int64)
        start, end, code = (m[order] for m in members)
        del members, order
        rest = int(np.searchsorted(start, reach, "right"))
        state.update(([(int(a), int(b), names[c]) for a, b, c in zip(start[rest:], end[rest:], code[rest:])], reach))
        for out in told_windows(start, end, code, names, needed, width, rest, mine=lambda s: s // stretch % buckets == key[1]):
            out.insert(0, "chrom", key[0])
            yield out

    code = F.lit(-1)
    for i, x in enumerate(names):
        code = F.when(F.col("name") == x, i).otherwise(code)
    kept = "members array<struct<start: long, end: long, name: string>>, told long"
    short = hits.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), code.cast("byte").alias("code"))
    dealt = short.mapInArrow(deal, f"chrom {kind}, bucket int, furthest long, members binary")
    return dealt.groupBy("chrom", "bucket").applyInPandasWithState(update, f"chrom {kind}, start long, end long, n long, names array<string>", kept, "append", "NoTimeout")


def only_new(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed."""
    return batch.join(done.select(key).distinct(), key, "left_anti")
