"""Shared helpers of the training-data operators: shared-folder staging, Arrow text access, byte hashing, components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: The word pattern of all operators; bytes.split() without arguments cuts at exactly these six separators.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


#: Bytes of a batch between the engine and Python; the engine's own default is eight times that.
BATCH_BYTES = "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package wherever the driver was started, and keep batches small.

    Texts of very different lengths share a batch, and a worker holds several copies of it; a batch size that the session's
    owner has set stays.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (PACKAGE_ROOT, have) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session in one process gets a temporary folder; on a cluster that would split the data, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidewater/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back (survives lost executors)."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give freed memory back to the system, where its allocator can: idle workers share their executor's room with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh_name(wanted: str, taken: list[str]) -> str:
    """wanted, or wanted with underscores if a column has that name already; the engine ignores case."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def whole_ids(docs: DataFrame, id_col: str) -> Column:
    """The id column as long; ids that are no whole numbers are refused before anything runs."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"{id_col} must hold whole numbers of at most 64 bits, not {kind.simpleString()}")
    return named(id_col).cast("long")


def wide_arrow(value) -> pa.Array:
    return value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and n + 1 offsets into them; a null row is empty."""
    column = wide_arrow(column)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, skip = len(column), column.offset
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[skip : skip + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most most_bytes, or of one longer row; they bound the memory of vectorised steps."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Hashes of spans are taken modulo this prime, to a base drawn once; powers of two as modulus or base would make patterned texts meet.
_PRIME = U64((1 << 61) - 1)
_BASE = 1_634_027_095_873_290_581
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
_BYTE = np.random.RandomState(11).randint(1, (1 << 61) - 1, 256).astype(U64)
_LENGTH = U64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 15


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, in place."""
    high = x >> U64(61)
    x &= _PRIME
    x += high
    x[x >= _PRIME] -= _PRIME
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 for a, b below it, from products of half words; in blocks that stay in the cache."""
    out = np.empty(len(a), U64)
    for k in range(0, len(a), _BLOCK):
        x, y = a[k : k + _BLOCK], b[k : k + _BLOCK]
        x1, x0, y1, y0 = x >> U64(31), x & _LOW31, y >> U64(31), y & _LOW31
        middle = x0 * y1
        middle += x1 * y0
        x1 *= y1
        x1 *= U64(2)
        x1 += middle >> U64(30)
        middle &= _LOW30
        middle <<= U64(31)
        x1 += middle
        x0 *= y0
        x1 += x0
        out[k : k + _BLOCK] = _folded(x1)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), int(_PRIME)), U64))])
    return out


class Rolling:
    """Hashes of any spans of a byte buffer or a sequence of 64-bit names, from prefix sums of a polynomial modulo 2**61 - 1.

    Bytes count as random values, names as what mix() makes of them. Two given spans that differ share a hash by chance only, about
    once in 2**61 / length times; texts cannot be patterned to do so without knowing the base.
    """

    _up, _down = np.ones(1, U64), np.ones(1, U64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._up) < n + 1:
            size = max(n + 1, 1 << 20)
            Rolling._up, Rolling._down = _powers(_BASE, size), _powers(pow(_BASE, -1, int(_PRIME)), size)
        terms = times(_BYTE[data] if data.dtype == np.uint8 else _folded(mix(data)), Rolling._up[:n])
        self.sums = np.zeros(n + 1, U64)
        # Halves are summed apart, so that nothing overflows below 2**33 terms.
        high = np.cumsum(terms >> U64(31))
        terms &= _LOW31
        low = np.cumsum(terms, out=terms)
        low += high >> U64(30)
        high &= _LOW30
        high <<= U64(31)
        low += high
        self.sums[1:] = _folded(low)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] + _PRIME
        h -= self.sums[starts]
        h = times(_folded(h), Rolling._down[starts])
        h += (ends - starts).astype(U64) * _LENGTH
        return mix(h)

    def every(self, width: int) -> np.ndarray:
        """The hash of each span of that width, by its start."""
        h = self.sums[width:] + _PRIME
        h -= self.sums[: -width or None]
        h = times(_folded(h), Rolling._down[: len(h)])
        h += np.full(1, width, U64) * _LENGTH
        return mix(h)


_GRAM_BASE = 0xD1342543DE82EF95
_GRAM_BYTE = np.random.RandomState(12).randint(0, 1 << 63, 256).astype(U64) * U64(2) + np.random.RandomState(13).randint(0, 2, 256).astype(U64)
_gram_powers = [np.ones(1, U64), np.ones(1, U64)]


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each span of that width of a byte buffer, by its start; a polynomial modulo 2**64, a few cheap steps a byte.

    Texts can be patterned to share such hashes, so they may bring spans together and order them, but never prove them equal.
    """
    n = len(data)
    if len(_gram_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_GRAM_BASE, pow(_GRAM_BASE, -1, 1 << 64))):
            _gram_powers[k] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, base, U64))])
    up, down = _gram_powers
    sums = np.zeros(n + 1, U64)
    terms = np.take(_GRAM_BYTE, data)
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    h = sums[width:] - sums[: n + 1 - width]
    h *= down[: len(h)]
    h ^= h >> U64(32)
    h *= _LENGTH
    return h


def content_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each span's own bytes, independent of Rolling; data may hold bytes or 64-bit names."""
    raw, width, digest = memoryview(np.ascontiguousarray(data).view(np.uint8)), data.itemsize, xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b], 29) for a, b in zip((starts * width).tolist(), (ends * width).tolist())), U64, len(starts))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of the rows, and the row of each word; words end with their row."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.nonzero(start)[0]
    return starts, np.nonzero(end)[0] + 1, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix); any change of the input changes all output bits evenly."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting beats numpy's hashed unique on long arrays."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return values[first]


def spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask over n places that lie in any of the half-open ranges."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a-b and the smallest node reachable from each, by min-label hooking with pointer jumping."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            jump = root[root]
            if np.array_equal(jump, root):
                break
            root = jump
        if np.array_equal(before, root):
            return nodes, nodes[root]


def _contract(batches):
    """Replace the edges of a partition by stars to the smallest node of each local component, in bounded pieces."""
    held_a, held_b, held = [], [], 0

    def stars():
        nodes, roots = local_roots(np.concatenate(held_a), np.concatenate(held_b))
        keep = nodes != roots
        return pa.RecordBatch.from_pydict({"a": nodes[keep], "b": roots[keep]})

    for batch in batches:
        held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held > 1_000_000:
            yield stars()
            held_a, held_b, held = [], [], 0
    if held:
        yield stars()


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Components of an undirected graph: (id, component_id) for every node of edges (a long, b long), the smallest id standing for each.

    Partitions first contract their own edges; then rounds of large-star and small-star steps run as joins and
    min-aggregates, so a hub's neighbours are never gathered in one place. Each round is a written table. Nothing but
    one number a round reaches the driver. Null ends and self-loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    star = staged(edges.mapInArrow(_contract, "a long, b long").distinct())
    for _ in range(most_rounds):
        # a > b in every row here. Large star: each node's larger neighbours move to the smallest of its neighbourhood.
        low = star.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = star.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = large.distinct()
        # Small star: each node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = staged(small)
        heads = after.select("b").distinct().join(after.select("a").distinct(), F.col("a") == F.col("b"), "left_semi")
        doubled = after.groupBy("a").count().where("count > 1")
        settled = heads.limit(1).count() == 0 and doubled.limit(1).count() == 0
        star = after
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return star.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
