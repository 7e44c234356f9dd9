"""Grouped counts, statistics, profiles and matrices; all with map-side partial aggregation."""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .staging import dealt, written


def uniq_counts(df: DataFrame, columns: list[str], more_than: int | None = None, fewer_than: int | None = None) -> DataFrame:
    """Distinct rows of some columns with count and share of all rows; the bounds are strict."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").cast("double").alias("all rows"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("all rows")).drop("all rows")
    if more_than is not None:
        out = out.where(F.col("n") > more_than)
    return out if fewer_than is None else out.where(F.col("n") < fewer_than)


def pair_counts(lines: DataFrame, line: str, sep: str = "\t") -> DataFrame:
    """(key, n) of lines with exactly two fields."""
    fields = F.split(line, sep)
    return lines.where(F.size(fields) == 2).groupBy(fields[0].alias("key")).agg(F.count("*").alias("n"))


def group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population deviation, min and max."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def column_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of each column as a double; what is no number counts as nothing."""
    return df.agg(*[F.sum(F.col(c).cast("string").try_cast("double")).alias(c) for c in columns])


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """sum, avg, min, max and count of a column."""
    return df.agg(F.sum(column).alias("sum"), F.avg(column).alias("avg"), F.min(column).alias("min"), F.max(column).alias("max"), F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str], top: int = 3, cut: int = 40) -> DataFrame:
    """(column_name, n_distinct, is_unique, top_values): one pass over unpivoted cells; ties by value."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns]))
    counts = df.select(cells.alias("x")).groupBy("x.column_name", "x.v").agg(F.count("*").alias("n"))
    whole = counts.groupBy("column_name").agg(F.count("*").alias("n_distinct"), (F.max("n") == 1).alias("is_unique"))
    shown = F.when(F.col("v") == "", "(empty string)").when(F.length("v") > cut, F.concat(F.substring("v", 1, cut), F.lit("..."))).otherwise(F.col("v"))
    place = F.row_number().over(W.partitionBy("column_name").orderBy(F.desc("n"), "v"))
    best = counts.withColumn("place", place).where(F.col("place") <= top).groupBy("column_name")
    best = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(shown, F.lit("="), F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("top_values"))
    return whole.join(best, "column_name")


def score_vectors(df: DataFrame, key: str, label: str, score: str, labels: list[str], default: float = 0.0) -> DataFrame:
    """(key, scores): scores aligned with a bounded list of labels."""
    m = df.groupBy(key, label).agg(F.max(score).alias("s")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(label, "s"))).alias("m"))
    return m.select(key, F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.coalesce(F.element_at("m", x), F.lit(default))).alias("scores"))


def best_target(df: DataFrame, key: str, target: str, score: str, how: str = "sum") -> DataFrame:
    """(key, target, score) of the target with the highest summed, greatest or counted score; ties to the smallest target."""
    agg = {"sum": F.sum, "max": F.max, "count": F.count}[how]
    scores = df.groupBy(key, target).agg(agg(score).alias("score"))
    best = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(target).alias("t"))).alias("b"))
    return best.select(key, F.col("b.t").alias(target), (-F.col("b.s")).alias("score"))


def group_average_matrix(cells: DataFrame, row: str, group: str, value: str, groups: list) -> DataFrame:
    """Mean of a matrix's long-form cells by row and a bounded list of column groups."""
    return cells.groupBy(row).agg(*[F.avg(F.when(F.col(group) == g, F.col(value))).alias(f"group_{g}") for g in groups])


def nonzero_counts(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, n_nonzero) of array rows."""
    return df.select(key, F.size(F.filter(values, lambda x: x != 0)).cast("long").alias("n_nonzero"))


def matrix_profile(df: DataFrame, values: str) -> DataFrame:
    """Zero count and share, extremes and number of values of a matrix of array rows."""
    cells = df.select(F.explode(values).alias("v"))
    n, zeros = F.count("v"), F.count_if(F.col("v") == 0)
    return cells.agg(n.alias("n_values"), zeros.alias("n_zero"), (zeros.cast("double") / n).alias("zero_share"), F.min("v").alias("min"), F.max("v").alias("max"))


def expressed_histogram(df: DataFrame, values: str, bins: int = 10) -> DataFrame:
    """(bin, n): rows by the share of their values that is not zero, bins + 1 bins."""
    share = F.size(F.filter(values, lambda x: x != 0)).cast("double") / F.size(values)
    return df.groupBy(F.floor(share * bins).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def discretise(df: DataFrame, value: str, bins: int = 8, out: str = "bin") -> DataFrame:
    """0 .. bins by distance from the minimum, rounded half up; the extremes are one broadcast row."""
    ends = df.agg(F.min(value).alias("low v"), F.max(value).alias("high v"))
    width = (F.col("high v") - F.col("low v")).cast("double") / bins
    step = F.floor((F.col(value) - F.col("low v")) / F.nullif(width, F.lit(0e0)) + F.lit(0.5e0))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.greatest(F.lit(0), F.least(F.lit(bins), F.coalesce(step, F.lit(0)))).cast("long")).drop("low v", "high v")


def minmax_scale(df: DataFrame, value: str, top: int = 1000, out: str = "scaled") -> DataFrame:
    """Values scaled to 0 .. top."""
    ends = df.agg(F.min(value).cast("double").alias("low v"), F.max(value).cast("double").alias("high v"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.coalesce((F.col(value) - F.col("low v")) / F.nullif(F.col("high v") - F.col("low v"), F.lit(0e0)), F.lit(0e0)) * top).drop("low v", "high v")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin_start, n, density) with bins of fixed width."""
    counts = df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * F.lit(float(width))).alias("bin_start")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(value).cast("double").alias("all rows"))
    return counts.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / F.col("all rows") / F.lit(float(width))).drop("all rows")


def roll_up_small(df: DataFrame, levels: list[str], least: int, misc: str = "MISC") -> DataFrame:
    """Adds `track`: the finest prefix of levels whose group has `least` rows; smaller groups cascade up, the rest is misc."""
    out, names = df, []
    for k in range(len(levels), 0, -1):
        keys, name = levels[:k], f"n level {k}"
        names.append((name, keys))
        sizes = df.groupBy(*[F.col(c).alias(f"{c} {k}") for c in keys]).agg(F.count("*").alias(name))
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c} {k}")) for c in keys])
        out = out.join(sizes, on).drop(*[f"{c} {k}" for c in keys])
    track = F.lit(misc)
    for name, keys in reversed(names):
        track = F.when(F.col(name) >= least, F.concat_ws("_", *keys)).otherwise(track)
    return out.withColumn("track", track).drop(*[n for n, _ in names])


def doc_term(df: DataFrame, doc: str, text: str, sep: str = " ") -> DataFrame:
    """(doc, word, n) in long form; words are the parts between single separators."""
    return df.select(doc, F.explode(F.split(text, "\\Q" + sep + "\\E")).alias("word")).groupBy(doc, "word").agg(F.count("*").alias("n"))


def inverted_index(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(word, doc, positions): postings, one row a word and document, so no word gathers all its documents in one row.

    A text's words are gathered where it is read, without an exchange, and handed on 64 texts at a time; rows that share an id give a posting each.
    """
    kind = df.schema[doc].dataType.simpleString()

    def run(batches):
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            words, at, places, ends = [], [], [], [0]
            for row, t in enumerate(batch.column(1).to_pylist()):
                found = {}
                for pos, word in enumerate(t.split(" ") if t is not None else ()):
                    found.setdefault(word, []).append(pos)
                words += found
                at += [row] * len(found)
                for own in found.values():
                    places += own
                    ends.append(len(places))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), lists], names=["word", doc, "positions"])

    return df.select(doc, text).mapInArrow(run, f"word string, `{doc}` {kind}, positions array<int>")


def document_frequency(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(word, n_docs)."""
    return doc_term(df, doc, text).groupBy("word").agg(F.count("*").alias("n_docs"))


def merge_variants(df: DataFrame, info_fields: list[str], cut: int = 15) -> DataFrame:
    """Variants by (chrom, pos, ref, alt): ids joined and cut, their count AC, and the info fields' distinct values."""
    m = F.str_to_map("info", F.lit(";"), F.lit("="))
    groups = df.groupBy("chrom", "pos", "ref", "alt").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"), F.count("*").alias("ac"), *[F.array_join(F.array_sort(F.collect_set(F.element_at(m, f))), ",").alias(f"i_{f}") for f in info_fields])
    ids = F.when(F.length("ids") > cut, F.concat(F.substring("ids", 1, cut), F.lit("..."))).otherwise(F.col("ids"))
    info = F.concat_ws(";", *[F.when(F.col(f"i_{f}") != "", F.concat(F.lit(f"{f}="), F.col(f"i_{f}"))) for f in info_fields], F.concat(F.lit("AC="), F.col("ac").cast("string")))
    return groups.select("chrom", "pos", "ref", "alt", ids.alias("id"), "ac", info.alias("info"))


#: Rows and cells of a block when all pairs of rows are told, of its parts where rows are not alike, and pairs that a task works on at once.
BLOCK_ROWS, BLOCK_CELLS, PART_ROWS, PART_CELLS, PAIRS_AT_ONCE = 1 << 14, 1 << 18, 1 << 10, 1 << 16, 1 << 16
#: Pairs that two sets of columns must have, on the whole, for rows to be alike.
LEAST_ALIKE = 512


def _cells_by_column(row: np.ndarray, column: np.ndarray, *more: np.ndarray) -> dict[int, list[tuple[np.ndarray, ...]]]:
    """The cells (row, *more) of each column, by row; cells that a row has again in a column stand apart, so a row is once in each set."""
    order = np.lexsort((row, column))
    place = np.arange(len(order))
    new = np.diff(row[order], prepend=-1).astype(bool) | np.diff(column[order], prepend=-1).astype(bool)
    again = place - np.maximum.accumulate(np.where(new, place, 0))
    sets = np.lexsort((row[order], again, column[order]))
    order, again = order[sets], again[sets]
    out: dict[int, list] = {}
    for at in np.split(order, np.nonzero(np.diff(column[order]) | np.diff(again))[0] + 1):
        out.setdefault(int(column[at[0]]), []).append((row[at], *(m[at] for m in more)))
    return out


def _block_correlations(one: pa.StructArray, other: pa.StructArray | None):
    """Batches of correlation_pairs' rows of two blocks of cells (a, c, x), ordered by a, or of one block by itself.

    Columns are taken one by one: each moves the counts, means and products of all pairs that share it, as Spark's corr does row by row.
    """
    sides = [s.flatten() for s in ([one] if other is None else [one, other])]
    coded = [s[0].dictionary_encode() for s in sides]
    keys = pa.concat_arrays([c.dictionary for c in coded])
    rank = np.empty(len(keys), np.int64)
    rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    columns = pa.concat_arrays([s[1] for s in sides]).dictionary_encode().indices.to_numpy().astype(np.int64)
    told = []
    for c, s, k in zip(coded, sides, np.split(columns, [len(sides[0][0])])):
        told.append(_cells_by_column(c.indices.to_numpy().astype(np.int64), k, s[2].fill_null(0).to_numpy(), s[2].is_valid().to_numpy(zero_copy_only=False)))
    left, right = told[0], told[-1]
    n_left, n_right = len(coded[0].dictionary), len(coded[-1].dictionary)
    begin_right = 0 if other is None else n_left
    step = max(1, PAIRS_AT_ONCE // n_right)
    for low in range(0, n_left, step):
        high = min(n_left, low + step)
        count = np.zeros((high - low, n_right), np.int64)
        seen, mean_x, mean_y, var_x, var_y, both = np.zeros((6, *count.shape))
        for column, sets in left.items():
            for row, x, has_x in sets:
                part = slice(*np.searchsorted(row, [low, high]))
                for other_row, y, has_y in right.get(column, []):
                    count[np.ix_(row[part] - low, other_row)] += 1
                    rows, cols = (row[part] - low)[has_x[part]], other_row[has_y]
                    at = ... if (len(rows), len(cols)) == count.shape else np.ix_(rows, cols)
                    dx, dy = x[part][has_x[part]][:, None] - mean_x[at], y[has_y][None, :] - mean_y[at]
                    seen[at] += 1
                    mean_x[at] += dx / seen[at]
                    mean_y[at] += (off := dy / seen[at])
                    rest = dy - off
                    both[at] += dx * rest
                    var_x[at] += dx * (x[part][has_x[part]][:, None] - mean_x[at])
                    var_y[at] += dy * rest
        scale = np.sqrt(var_x * var_y)
        r = np.divide(both, scale, out=np.zeros_like(both), where=scale != 0)
        a, b = np.nonzero(count)
        if other is None:
            a, b = (x[a + low < b] for x in (a, b))
        first, second = a + low, b + begin_right
        turned = rank[first] > rank[second]
        r, known = r[a, b], ((seen > 1) & (scale != 0))[a, b]
        yield pa.RecordBatch.from_arrays([
            keys.take(pa.array(np.where(turned, second, first))), keys.take(pa.array(np.where(turned, first, second))), pa.array(r, mask=~known), pa.array(count[a, b])
        ], ["a", "b", "r", "n"])


def _alike_rows(row: np.ndarray, column: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """(rows, columns, cells by column and row) of the rows that have the same columns; None if a row has a column twice."""
    order = np.lexsort((column, row))
    row, column, x = row[order], column[order], x[order]
    new = np.diff(row, prepend=-1) != 0
    if (~new & (np.diff(column, prepend=-1) == 0)).any():
        return None
    starts = np.nonzero(new)[0]
    sets: dict[bytes, list[int]] = {}
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(row)]):
        sets.setdefault(column[a:z].tobytes(), []).append(a)
    told = [(np.array(at), np.frombuffer(columns, column.dtype)) for columns, at in sets.items()]
    return [(row[at], columns, x[at[None, :] + np.arange(len(columns))[:, None]]) for at, columns in told]


def _moved(x: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """What each column moves the products of a row's pairs by, and the row's squares, as _block_correlations has them for either side."""
    mean, squares, moved = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.empty_like(x)
    for k, own in enumerate(x):
        d = own - mean
        mean += (off := d / (k + 1))
        rest = own - mean if left else d - off
        squares += d * rest
        moved[k] = d if left else rest
    return moved, squares


def _alike_correlations(left: list, right: list | None, keys: pa.Array):
    """Batches of correlation_pairs' rows where many rows have the same columns: products of all pairs are one product of matrices.

    The sides are _alike_rows of two blocks, or of one block to be met by itself; rows are places in keys, which are sorted.
    """
    for i, (rows, columns, x) in enumerate(left):
        for j, (other_rows, other_columns, y) in enumerate(left[i:] if right is None else right):
            shared, at, other_at = np.intersect1d(columns, other_columns, assume_unique=True, return_indices=True)
            if not len(shared):
                continue
            own = right is None and j == 0
            (moves, squares), (other_moves, other_squares) = _moved(x[at], True), _moved(y[other_at], False)
            step = max(1, PAIRS_AT_ONCE // len(other_rows))
            for low in range(0, len(rows), step):
                part, rest = slice(low, low + step), slice(low if own else 0, None)
                both = moves[:, part].T @ other_moves[:, rest]
                scale = np.sqrt(squares[part, None] * other_squares[None, rest])
                first, second = np.minimum(rows[part, None], other_rows[None, rest]), np.maximum(rows[part, None], other_rows[None, rest])
                if own:
                    keep = np.arange(both.shape[1])[None, :] > np.arange(both.shape[0])[:, None]
                    both, scale, first, second = (m[keep] for m in (both, scale, first, second))
                both, scale, first, second = (m.ravel() for m in (both, scale, first, second))
                known = (scale != 0) & (len(shared) > 1)
                r = np.divide(both, scale, out=both, where=known) if not known.all() else both / scale
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(first)), keys.take(pa.array(second)), pa.array(r, mask=None if known.all() else ~known), pa.array(np.full(len(r), len(shared)))
                ], ["a", "b", "r", "n"])


def _met_blocks(one: pa.Table, other: pa.Table | None):
    """Batches of correlation_pairs' rows of two blocks of cells (a, c, x), ordered by a, or of one block by itself."""
    sides = [one] if other is None else [one, other]
    whole = pa.concat_tables(sides).combine_chunks()
    coded = whole["a"].chunk(0).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    cut = [len(one)]
    rows = np.split(rank[coded.indices.to_numpy()], cut)[: len(sides)]
    alike = None
    if not whole["x"].null_count:
        columns = np.split(whole["c"].chunk(0).dictionary_encode().indices.to_numpy(), cut)
        alike = [_alike_rows(r, c, s["x"].to_numpy()) for r, c, s in zip(rows, columns, sides)]
    if alike and None not in alike:
        n_pairs = sum(len(s[0]) for s in alike[0]) * sum(len(s[0]) for s in alike[-1])
        if len(alike[0]) * len(alike[-1]) * LEAST_ALIKE <= n_pairs:
            yield from _alike_correlations(alike[0], None if other is None else alike[1], coded.dictionary.take(order))
            return
    parts = []
    for r, s in zip(rows, sides):
        starts = np.nonzero(np.diff(r, prepend=-1))[0]
        cuts = [*starts[:: max(1, min(PART_ROWS, PART_CELLS * len(starts) // len(r)))].tolist(), len(r)]
        cells = s.combine_chunks().to_struct_array().chunk(0)
        parts.append([cells.slice(a, z - a) for a, z in zip(cuts, cuts[1:])])
    for i, left in enumerate(parts[0]):
        for j, right in enumerate(parts[-1]):
            if other is not None or i < j:
                yield from _block_correlations(left, right)
            elif i == j:
                yield from _block_correlations(left, None)


def _packed_block(key: tuple, cells: pa.Table) -> pa.Table:
    """A block's cells, ordered, as one value."""
    cells = cells.select(["a", "c", "x"]).sort_by([(c, "ascending") for c in ("a", "c", "x")]).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, cells.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(cells)
    return pa.table({"own": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def correlation_pairs(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(a, b, r, n) of all rows a < b of a matrix in long form that share a column.

    Rows are put in blocks by hash, and every two blocks meet in one task that holds no more than them and works on some pairs at a time: what
    is exchanged is a packed block as often as there are blocks, never pairs. The cells of one row stand in one block. Rows that have the same
    columns, as in a matrix without holes, are correlated as matrices, others column by column.
    """
    spark = cells.sparkSession
    whole = written(cells.select(F.col(row).alias("a"), F.col(column).alias("c"), F.col(value).cast("double").alias("x")).where("a is not null and c is not null"))
    n_rows, n_cells = whole.agg(F.count_distinct("a"), F.count("*")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # A small matrix has blocks too, so that its pairs are work for more than one task.
    blocks = max(1, min(n_rows, max(-(-n_rows // BLOCK_ROWS), -(-n_cells // BLOCK_CELLS), min(max(16, isqrt(2 * tasks)), -(-n_rows // 64)))))
    packed = whole.withColumn("own", F.pmod(F.xxhash64("a"), F.lit(blocks))).groupBy("own").applyInArrow(_packed_block, "own long, m binary")
    told = packed.select("own", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("met")).select(F.least("own", "met").alias("p"), F.greatest("own", "met").alias("q"), "own", "m")
    meetings = blocks * (blocks + 1) // 2
    tasks = max(tasks, min(meetings, 256), meetings // 8)

    def run(batches):
        held = None
        for batch in batches:
            for p, q, own, m in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                block = pa.ipc.open_stream(m.as_buffer()).read_all()
                if p == q:
                    yield from _met_blocks(block, None)
                elif own == p:
                    held = (p, q, block)
                elif held and held[:2] == (p, q):
                    yield from _met_blocks(held[2], block)

    kind = whole.schema["a"].dataType.simpleString()
    return told.repartition(tasks, "p", "q").sortWithinPartitions("p", "q", "own").mapInArrow(run, f"a {kind}, b {kind}, r double, n long")


def jaccard_pairs(df: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, n_common, jaccard) of keys that share items.

    An item's keys are put in order once, and each key is told those behind it as one list, so that a key's pairs are counted where
    the key is: what is exchanged is lists, not pairs.
    """
    items = dealt(df.select(F.col(key).alias("k"), F.col(item).alias("i")), "i").distinct()
    sizes = items.groupBy("k").agg(F.count("*").alias("n"))
    lists = items.where("k is not null and i is not null").groupBy("i").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    told = lists.select("ks", F.posexplode("ks").alias("pos", "a")).where(F.col("pos") < F.size("ks") - 1).select("a", F.slice("ks", F.col("pos") + 2, F.size("ks")).alias("bs"))
    common = dealt(told, "a").select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_common"))
    met = common.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", "n_common", (F.col("n_common").cast("double") / (F.col("na") + F.col("nb") - F.col("n_common"))).alias("jaccard"))


def significant_pairs(cells: DataFrame, row: str, column: str, value: str, most_p: float = 1e-9, both: bool = False) -> DataFrame:
    """(a, b, r, n, p) of the pairs of rows whose correlation has at most that p; all-zero rows and NaN cells are left out."""
    from ..functions.statistics import correlation_p

    good = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    live = good.groupBy(row).agg(F.max(F.abs(value)).alias("top")).where("top > 0")
    pairs = correlation_pairs(good.join(live, row, "left_semi"), row, column, value).where(F.col("r").isNotNull())
    out = pairs.withColumn("p", correlation_p("r", "n")).where(F.col("p") <= most_p)
    return out if not both else out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n", "p"))


def rank_correlation(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(a, b, r, n) of the columns (samples) by their ranks over the rows (genes) that all samples have; ties get mean ranks.

    Ranks stand in one window a sample over its values.
    """
    total = cells.select(column).distinct().agg(F.count("*").alias("all"))
    whole = cells.groupBy(row).agg(F.count_distinct(column).alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") == F.col("all")).select(row)
    own = cells.join(whole, row, "left_semi")
    w = W.partitionBy(column).orderBy(value)
    rank = F.rank().over(w) + (F.count("*").over(W.partitionBy(column, value)) - 1) / 2
    ranked = own.select(row, column, rank.cast("double").alias("rank"))
    # Samples are few and long: their pairs are partial aggregates of a self-join.
    a = ranked.select(F.col(column).alias("a"), F.col(row).alias("c"), F.col("rank").alias("x"))
    b = ranked.select(F.col(column).alias("b"), F.col(row).alias("c"), F.col("rank").alias("y"))
    return a.join(b, "c").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))


def sample_covariance(df: DataFrame, x: str, y: str) -> DataFrame:
    """(var_x, var_y, cov) with n - 1."""
    return df.agg(F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov"))


def count_combinations(spark, most: list[int]) -> DataFrame:
    """All counters (c0, c1, ...) with c_i from 0 to most_i: one range taken apart digit by digit, in parallel."""
    size = 1
    digits = []
    for i, m in enumerate(most):
        digits.append((F.floor(F.col("id") / size) % (m + 1)).cast("long").alias(f"c{i}"))
        size *= m + 1
    return spark.range(size).select(*digits)


def distinct_tokens(df: DataFrame, column: str, after: str = "=", sep: str = ",") -> DataFrame:
    """(token): the distinct parts of the lists behind a mark."""
    return df.where(F.col(column).contains(after)).select(F.explode(F.transform(F.split(F.substring_index(column, after, -1), sep), lambda x: F.trim(x))).alias("token")).where("token <> ''").distinct()


def by_match_count(hits: DataFrame, key: str, item: str) -> DataFrame:
    """(key, n, items): keys with their distinct items in order, most first."""
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ",").alias("items")).orderBy(F.desc("n"), key)


def frequent_groups(df: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """(keys, n, total) of the groups whose values of at least `least` there are; smaller values do not count."""
    return df.where(F.col(value) >= least).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def annotated_hits(df: DataFrame, column: str, foreground: list[str], special: list[str], sep: str = ",") -> DataFrame:
    """Adds n_predicted, n_foreground and the special names of a list column of ids."""
    ids = F.array_distinct(F.split(column, sep))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return df.withColumn("n_predicted", F.size(ids).cast("long")).withColumn("n_foreground", F.size(F.array_intersect(ids, lit(foreground))).cast("long")).withColumn("special", F.array_join(F.array_sort(F.array_intersect(ids, lit(special))), ","))
