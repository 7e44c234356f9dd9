"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks for candidate pairs, Hamming distance to verify.

Equal fingerprints are one class. The 64 bits are split into BLOCKS blocks; two fingerprints within the distance agree on all but
`distance` blocks at least, so each class is keyed by every choice of that many agreeing blocks. The number of blocks is fixed:
keys grow as the classes do, and any number gives the same links. Rows stream through a task key by key; a key with very
many classes is dealt out in tiles that meet two by two, so no task compares more than two tiles. In a large group classes
that are already linked are not compared again, and only links that join parts leave a task. Components are then joined in
rounds over written tables.

similar_dedup asks for a similarity of 0.8 of five-word shingle sets, which 64 bits cannot tell: at 0.8 two fingerprints differ in 10 of
them. It takes the pairs within four bits first. Then it splits a wider fingerprint, 192 symbols of which two texts share about as
large a part as of their shingles, into 32 blocks by the same rule, verifies the distance in symbols, and at last counts the common
shingles of every link exactly.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than a shingle
make one shingle of them all; repeated rows and ties share their class; a row with a null id has a fingerprint and a null
component and links with nothing; ids must be whole numbers; an empty table gives an empty result; only the id and text columns
are read, others may have any names. Texts of any length are read whole, each by one task in memory that grows with
its length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, connected_components, distinct, local_roots, named, staged, text_buffers, whole_ids

#: Blocks of the 64 bits: at a distance of 4 each class has 35 keys of 27 bits.
BLOCKS = 7
#: Symbols of the wide fingerprint and symbols in a block of it.
SYMBOLS, SYMBOL_BLOCK = 192, 6
#: Symbols that two texts must share at least to be counted exactly; at a similarity of 0.8 all but 1 in 20,000 pairs do, and as many share a block.
SHARED_SYMBOLS = 132
_FACTORS = np.random.RandomState(5).randint(1, 2**63 - 1, SYMBOLS).astype(U64) * U64(2) + U64(1)
#: Classes that may share a key before it is dealt out in tiles, and symbol fingerprints that may.
TILE, SYMBOL_TILE = 20_000, 6_000
#: Groups up to this size are compared pair by pair; rows that are compared at once.
SMALL, ROWS_AT_ONCE = 16, 100_000


def _shingles(text: bytes, shingle: int, seed: int) -> list[int]:
    """The hashes of a text's word shingles, repeats included; A-Z are lowered."""
    words = text.lower().split()
    if not words:
        return []
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(whole, seed)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return [digest(whole[a:b], seed) for a, b in zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    n, votes = len(hashes), np.zeros(64, np.int64)
    bits = hashes.astype(">u8").view(np.uint8)
    for k in range(0, n, 1 << 16):
        votes += np.add.reduce(np.unpackbits(bits[8 * k : 8 * (k + (1 << 16))]).reshape(-1, 64), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    hashes = _shingles(text, shingle, seed)
    return _majority(np.array(hashes, U64)) if hashes else 0


def _each_text(batch: pa.RecordBatch, of):
    data, offsets = text_buffers(batch.column(1))
    raw, o = data.tobytes(), offsets.tolist()
    return [of(raw[a:b]) for a, b in zip(o[:-1], o[1:])]


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp long: the fingerprint's 64 bits as a signed integer) of every row."""

    def run(batches):
        for batch in batches:
            found = np.array(_each_text(batch, lambda t: fingerprint(t, shingle)), U64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "fp": pa.array(found)})

    return docs.select(whole_ids(docs, id_col).alias("id"), named(text).alias("text")).mapInArrow(run, "id long, fp long")


def block_masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of the 64 bits, one for each choice of blocks that agree if at most `distance` bits differ."""
    blocks = max(blocks, distance + 1)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def linking_pairs(key: np.ndarray, root: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near rows with one key (key is sorted) that join all the parts that near joins; equal roots are joined already.

    near(i, j) tells for index arrays (or one index and an array) which pairs are near. Large groups are walked from row to
    row, and a row that has been reached is compared only onwards, with rows not reached yet.
    """
    n, left, right = len(key), [], []
    starts = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    at, step = np.nonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))[0], 1
    while len(at):
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        other = at[root[at] != root[at + step]]
        other = other[near(other, other + step)]
        left.append(other)
        right.append(other + step)
        step += 1
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        rest = np.arange(start, start + size)
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                same = root[rest] == root[x]
                hit = near(x, rest) & ~same
                if hit.any():
                    _, one = np.unique(root[rest[hit]], return_index=True)  # one link to each part
                    left.append(np.full(len(one), x))
                    right.append(rest[hit][one])
                    same |= np.isin(root[rest], root[right[-1]])
                if same.any():
                    queue += rest[same].tolist()
                    rest = rest[~same]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def nearest_pairs(key: np.ndarray, root: np.ndarray, closeness) -> tuple[np.ndarray, np.ndarray]:
    """For each row the closest one with its key and another root, where closeness(i, j) is not negative."""
    n, left, right = len(key), [], []
    starts = np.nonzero(np.append(True, key[1:] != key[:-1]))[0] if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        group = np.arange(start, start + size)
        if (root[group] == root[start]).all():
            continue
        for x in group.tolist():
            others = group[root[group] != root[x]]
            close = closeness(x, others)
            best = int(close.argmax())
            if close[best] >= 0:
                left.append(x)
                right.append(int(others[best]))
    return np.array(left, np.int64), np.array(right, np.int64)


def _by_key(compare, tile: int):
    """Feeds whole keys of a partition sorted by its first column to compare(columns) -> (a, b); keys of over `tile` rows come out as they are.

    Rows out: (a, b) of links, or the row's own columns with a null.
    """

    def run(batches):
        held, names, size, hot = None, None, 0, None

        def rows_of(table):
            return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.nulls(table.num_rows, pa.int64())] * 2 + [c.combine_chunks() for c in table.columns], names=["a", "b", *names])]).to_batches()

        def links(table):
            a, b = compare([c.combine_chunks() for c in table.columns])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in table.schema)], names=["a", "b", *names])

        def done(table):
            key = table.column(0).to_numpy()
            starts = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
            sizes = np.diff(np.append(starts, len(key)))
            big = np.repeat(sizes > tile, sizes)
            if big.any():
                yield from rows_of(table.filter(pa.array(big)))
                table = table.filter(pa.array(~big))
            if table.num_rows:
                yield from links(table)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            now = pa.Table.from_batches([batch])
            if hot is not None:  # the rest of a key that has come out already
                more = now.column(0).to_numpy() == hot
                if more.any():
                    yield from rows_of(now.filter(pa.array(more)))
                if more.all():
                    continue
                now, hot = now.filter(pa.array(~more)), None
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows >= ROWS_AT_ONCE or held.nbytes > 32 << 20:
                key = held.column(0).to_numpy()
                last = int(np.searchsorted(key, key[-1]))
                if last:
                    yield from done(held.slice(0, last))
                    held = held.slice(last)
                if held.num_rows > tile:
                    yield from rows_of(held)
                    held, hot = None, key[-1]
        if held is not None and held.num_rows:
            yield from done(held)

    return run


def _meet(rows: DataFrame, compare, tile: int) -> DataFrame:
    """Links (a, b) among the rows of a key (long, the first column); rows of keys beyond `tile` meet tile by tile, each pair of tiles a key of its own."""
    kinds = ", ".join(["a long, b long", *(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)])
    first = staged(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(compare, tile), kinds))
    links, hot = first.where("a is not null").select("a", "b"), first.where("a is null").drop("a", "b")
    if not hot.limit(1).count():
        return links
    tiles = F.ceil(F.col("n") / F.lit(tile // 2)).cast("int")
    dealt = hot.join(staged(hot.groupBy("key").agg(F.count("*").alias("n"))), "key").withColumn("n", tiles).withColumn("mine", F.pmod(F.xxhash64("rep", F.lit("tile")), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
    again = dealt.select(pair.alias("key"), *[c for c in rows.columns if c != "key"]).repartition("key").sortWithinPartitions("key")
    return links.unionByName(again.mapInArrow(_by_key(compare, 1 << 62), kinds).select("a", "b"))


def near_classes(classes: DataFrame, distance: int = 4, blocks: int = BLOCKS, tile: int = TILE, direct: bool = False) -> DataFrame:
    """Edges (a, b) that connect the classes (fp, rep) as links within the distance do; not every link is listed.

    direct: every edge is itself a link; otherwise links are contracted to stars where they are found.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance, blocks)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]))

    def compare(columns):
        key, fp, rep = (c.to_numpy() for c in columns)
        prints = fp.view(U64)
        a, b = linking_pairs(key, rep, lambda i, j: np.bitwise_count(prints[i] ^ prints[j]) <= distance)
        if direct or not len(a):
            return np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
        nodes, roots = local_roots(rep[a], rep[b])
        return nodes[nodes != roots], roots[nodes != roots]

    return _meet(classes.select(keys.alias("key"), "fp", "rep"), compare, tile)


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row; the smallest id reachable stands for a component."""
    prints = staged(fingerprints(docs, shingle, id_col, text))
    classes = staged(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    groups = connected_components(near_classes(classes, distance))
    heads = classes.join(groups, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(heads, "fp", "left").select(F.col("id").alias(id_col), shown, F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_dedup(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that belong to another document's group; of repeated rows of the kept document all stay."""
    groups = simhash_components(docs, shingle, distance, id_col, text)
    drop = groups.where(F.col("component_id") != named(id_col)).select(named(id_col)).distinct()
    return docs.join(drop.hint("shuffle_hash"), id_col, "left_anti")  # hashed on the ids, so that texts are not sorted


def shingle_hashes(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; fewer words make one shingle, none make none."""
    return distinct(np.array(_shingles(text, shingle, seed), U64))


def _class_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63)


def symbols(hashes: np.ndarray) -> bytes:
    """The wide fingerprint: a byte of the least of the hashes under each of SYMBOLS random orders."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, U64)
    for k in range(0, len(hashes), 512):
        np.minimum(least, (hashes[None, k : k + 512] * _FACTORS[:, None]).min(axis=1), out=least)
    return (least >> U64(16)).astype(np.uint8).tobytes()


def _sketches(docs: DataFrame) -> DataFrame:
    """(id, rep, fp, size, symbols) of (id, text) rows: a digest of all shingles, the SimHash of the distinct ones, their number, the wide fingerprint."""

    def run(batches):
        for batch in batches:
            sets = _each_text(batch, shingle_hashes)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0),
                "rep": pa.array([_class_of(h) for h in sets], pa.int64()),
                "fp": pa.array(np.array([_majority(h) if len(h) else 0 for h in sets], U64).view(np.int64)),
                "size": pa.array([len(h) for h in sets], pa.int64()),
                "symbols": pa.array([symbols(h) for h in sets], pa.binary()),
            })

    return docs.mapInArrow(run, "id long, rep long, fp long, size long, symbols binary")


def _sets(docs: DataFrame) -> DataFrame:
    """(rep, hashes) of (id, text) rows."""

    def run(batches):
        for batch in batches:
            for hashes in _each_text(batch, shingle_hashes):
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(hashes)], pa.int64()), pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))], names=["rep", "hashes"])

    return docs.mapInArrow(run, "rep long, hashes array<long>")


def _similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more, counted exactly: 9 common >= 4 (all of a + all of b)."""
    pairs = staged(pairs.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = classes.join(ends, "rep", "left_semi").select(F.col("first").alias("id")).distinct()
    # A row whose id has several texts may give a class that is not wanted; it joins with nothing.
    sets = staged(_sets(docs.join(wanted.hint("shuffle_hash"), "id", "left_semi")).dropDuplicates(["rep"]))
    met = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    return met.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with root: the component of each by the links."""
    groups = connected_components(links).select(F.col("id").alias("rep"), F.col("component_id").alias("root"))
    return classes.join(groups, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _open_keys(batches, at_once: int = ROWS_AT_ONCE):
    """The rows of keys that hold more than one root; sorted by key in, key by key out.

    Of a key with over `at_once` rows all go on, as it is not held together: whoever compares them finds what it holds.
    """
    held, hot = None, None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if hot is not None and table.num_rows:
            more = int(np.searchsorted(table.column(0).to_numpy(), hot, side="right"))
            yield from table.slice(0, more).to_batches()
            table = table.slice(more)
        if not table.num_rows:
            continue
        hot = None
        key, root = table.column(0).to_numpy(), table.column(2).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if not last and table.num_rows > at_once:
            yield from table.to_batches()
            held, hot = None, key[-1]
            continue
        yield from _open(table.slice(0, last), key[:last], root[:last])
        held = table.slice(last)
    if held is not None:
        yield from _open(held, held.column(0).to_numpy(), held.column(2).to_numpy())


def _open(table: pa.Table, key: np.ndarray, root: np.ndarray):
    if len(key):
        starts = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
        differ = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        yield from table.filter(pa.array(np.repeat(differ, np.diff(np.append(starts, len(key)))))).to_batches()


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Symbols that agree, row by row; rows that agree in few of the first quarter count as none."""
    few = SYMBOLS // 4
    shared = np.count_nonzero(x[..., :few] == y[..., :few], axis=-1)
    may = np.nonzero(shared >= few // 2)[0]
    out = np.zeros(len(shared), np.int64)
    out[may] = shared[may] + np.count_nonzero((x if x.ndim == 1 else x[may])[..., few:] == y[may, few:], axis=-1)
    return out


def symbol_links(classes: DataFrame, nearest: bool = False, tile: int = SYMBOL_TILE) -> DataFrame:
    """Pairs (a, b) of classes (rep, root, size, symbols) that share a block and, verified, SHARED_SYMBOLS symbols, with unlike roots.

    They connect all that such pairs connect, or with nearest are the closest pair of each class and key.
    """
    blocks = [F.xxhash64(F.lit(k), F.substring("symbols", k + 1, SYMBOL_BLOCK)) for k in range(0, SYMBOLS, SYMBOL_BLOCK)]
    keyed = classes.select(F.explode(F.array(*blocks)).alias("key"), "rep", "root")
    met = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_open_keys, "key long, rep long, root long"))
    rows = met.join(classes.select("rep", "size", "symbols"), "rep").select("key", "rep", "root", "size", "symbols")

    def compare(columns):
        key, rep, root, size = (c.to_numpy() for c in columns[:4])
        order = np.lexsort((rep, key))  # the same classes lead in all groups, so their links coincide
        key, rep, root, size = key[order], rep[order], root[order], size[order]
        marks = text_buffers(columns[4])[0].reshape(-1, SYMBOLS)[order]

        def shared(i, j):
            alike = 5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])
            return np.where(alike, _shared(marks[i], marks[j]), 0)

        if nearest:
            a, b = nearest_pairs(key, root, lambda i, j: shared(i, j) - SHARED_SYMBOLS)
        else:
            a, b = linking_pairs(key, root, lambda i, j: shared(i, j) >= SHARED_SYMBOLS)
        return np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])

    return _meet(rows, compare, tile)


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of the (id, text) rows by equal shingle sets, and (rep, root): the component of each class by its similar pairs.

    Three searches, each verified: SimHashes within four bits; symbol fingerprints of what is not linked yet; and for each
    class the closest one of another component, which makes up for links that led to a pair just below 0.8.
    """
    sketches = staged(_sketches(docs))
    members = sketches.select("id", "rep")
    classes = staged(sketches.groupBy("rep").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("fp", "size", "symbols")]))
    links = staged(_similar(near_classes(classes.select("fp", "rep"), direct=True), docs, classes))
    for nearest in (False, True):
        rooted = staged(_rooted(classes, links))
        links = staged(links.unionByName(_similar(symbol_links(rooted, nearest), docs, classes)))
    return members, _rooted(classes.select("rep"), links)


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose five-word shingles are linked, at a Jaccard similarity of 0.8 or more, to a document of a lower id.

    Links are transitive; of repeated rows of the kept document all stay, and a row with a null id stays.
    """
    rows = docs.where(named(id_col).isNotNull()).select(whole_ids(docs, id_col).alias("id"), named(text).alias("text"))
    members, groups = similar_classes(rows)
    parts = members.join(groups, "rep").select("id", "root")
    drop = parts.join(parts.groupBy("root").agg(F.min("id").alias("least")), "root").where("id <> least").select(F.col("id").alias(id_col)).distinct()
    return docs.join(drop.hint("shuffle_hash"), id_col, "left_anti")  # hashed on the ids, so that texts are not sorted


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return simhash_components(read_table(spark, sf_dir, "documents"))
