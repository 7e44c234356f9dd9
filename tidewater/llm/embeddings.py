"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one representative a group.

Equal vectors are one class with a multiplicity. k-means is fitted on a bounded sample of classes; every class is then put in
its nearest cell (home) and shown to each other cell from whose border it lies at most half the threshold's angle away. Two
vectors with different homes lie on either side of the border between these, and the angle between them is at least the
sum of their distances to it; so of two vectors within the threshold one is shown to the other's home, and nothing is lost.
A pair that both homes see counts in the lower cell. A cell of any size is dealt out in blocks; a task multiplies two
blocks and returns link counts and a spanning star of the links it found, never the pairs themselves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths are never compared; a cosine that equals the threshold up to rounding is decided by the product of the rounded unit vectors;
rows with a null id link with nothing, have a null component and are kept; repeated rows are
vectors of their own; an empty table gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
from math import acos, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, local_roots, staged

#: Vectors of the k-means sample, classes aimed at in a cell, most cells, rows of a home block and of a block of shown ones.
SAMPLE, CELL_CLASSES, MOST_CELLS, BLOCK, SHOWN_BLOCKS = 20_000, 2_000, 2_048, 2_048, 8
#: Links between cells whose counting cell is worked out at once.
LINKS = 1 << 16


def unit_rows(vectors: list[bytes], size: int) -> np.ndarray:
    """Unit vectors, in double precision, from packed ones of 4 or 8 bytes a component."""
    x = np.empty((len(vectors), size))
    narrow = np.fromiter((len(v) == 4 * size for v in vectors), bool, len(vectors))
    for few, kind in ((narrow, "<f4"), (~narrow, "<f8")):
        at = np.nonzero(few)[0]
        if len(at):
            x[at] = np.frombuffer(b"".join([vectors[i] for i in at]), kind).reshape(-1, size)
    x /= np.abs(x).max(axis=1, keepdims=True)  # extreme lengths must not overflow the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(batches):
    """(id, key, size, vec): a digest, the length and the packed components of a usable vector, null for others."""
    for batch in batches:
        keys, sizes, packed = [], [], []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.empty(0)
            x = x + 0.0  # one zero
            if len(x) and np.isfinite(x).all() and x.any():
                with np.errstate(over="ignore"):
                    small = x.astype("<f4")
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                packed.append(small.tobytes() if (small == x).all() else x.astype("<f8").tobytes())
                sizes.append(len(x))
            else:
                keys.append(None), packed.append(None), sizes.append(None)
        yield pa.RecordBatch.from_pydict({"id": batch.column(0), "key": pa.array(keys, pa.binary()), "size": pa.array(sizes, pa.int32()), "vec": pa.array(packed, pa.binary())})


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of unit rows."""
    draw = np.random.RandomState(seed)
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), centres)
    return centres


def fit_cells(classes: DataFrame, n: int, seed: int = 3) -> dict[int, np.ndarray]:
    """Centres by vector length from a sample of at most SAMPLE classes; a length that it lacks is one cell."""
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    rows = classes.select("size", "vec").sample(share, seed).limit(SAMPLE).toArrow().to_pylist()
    out = {}
    for size in {r["size"] for r in rows}:
        own = unit_rows([r["vec"] for r in rows if r["size"] == size], size)
        out[size] = spherical_kmeans(own, max(1, min(MOST_CELLS, round(n * len(own) / len(rows) / CELL_CLASSES))))
    return out


def _separations(centres: np.ndarray) -> np.ndarray:
    """Distances between centres; a centre's distance to itself, or to an equal one, counts as almost none."""
    return np.maximum(np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)), 1e-9)


def _assign(centres: dict[int, np.ndarray], reach: float):
    """(rep, many, size, vec, home, cells): a cell is named by its vector length and number."""
    apart = {size: _separations(c) for size, c in centres.items()}

    def run(batches):
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            vectors = batch.column(3).to_pylist()
            homes, shown = [None] * len(vectors), [None] * len(vectors)
            for size in set(sizes.tolist()):
                at = np.nonzero(sizes == size)[0].tolist()
                for k in range(0, len(at), 1024):
                    part = at[k : k + 1024]
                    if size not in centres:
                        for i in part:
                            homes[i], shown[i] = size << 32, [size << 32]
                        continue
                    dots = unit_rows([vectors[i] for i in part], size) @ centres[size].T
                    home = np.argmax(dots, axis=1)
                    seen = (dots[np.arange(len(part)), home][:, None] - dots) / apart[size][home] <= reach
                    seen[np.arange(len(part)), home] = True
                    for row, i in enumerate(part):
                        homes[i] = (size << 32) + int(home[row])
                        shown[i] = ((size << 32) + np.nonzero(seen[row])[0]).tolist()
            yield pa.RecordBatch.from_pydict({"rep": batch.column(0), "many": batch.column(1), "size": batch.column(2), "vec": batch.column(3), "home": pa.array(homes, pa.int64()), "cells": pa.array(shown, pa.list_(pa.int64()))})

    return run


def _block_links(centres: dict[int, np.ndarray], threshold: float, reach: float):
    """Rows (a, b, n): b null gives n more links of class a; else a-b connects two classes."""
    apart = {size: _separations(c) for size, c in centres.items()}

    def links(rows):
        side = np.array([r[2] for r in rows])
        left, right = [r for r, s in zip(rows, side) if s != 1], [r for r, s in zip(rows, side) if s != 0]
        if not left or not right:
            return None
        cell, size, same = left[0][1], left[0][6], bool((side == 2).any())
        a = unit_rows([r[7] for r in left], size)
        b = a if same else unit_rows([r[7] for r in right], size)
        rep_a, rep_b = np.array([r[3] for r in left]), np.array([r[3] for r in right])
        many_a, many_b = np.array([r[4] for r in left]), np.array([r[4] for r in right])
        home_b = np.array([r[5] for r in right])
        count_a, count_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        star_a = star_b = np.empty(0, np.int64)
        # Part by part: what is held of the links found is their counts and a star for each component.
        for k in range(0, len(b), BLOCK):
            i, j = np.nonzero(a @ b[k : k + BLOCK].T >= threshold)
            j += k
            if same:
                keep = i < j
            else:
                # The other's home may see this pair as well; then the lower cell counts it.
                keep = home_b[j] >= cell
                other = np.nonzero(~keep)[0]
                for x in np.split(other, range(LINKS, len(other), LINKS)):
                    mine, theirs = cell & 0xFFFFFFFF, home_b[j[x]] & 0xFFFFFFFF
                    near = np.einsum("ij,ij->i", a[i[x]], centres[size][mine] - centres[size][theirs])
                    keep[x] = near / apart[size][mine, theirs] > reach
            i, j = i[keep], j[keep]
            if len(i):
                count_a += np.bincount(i, many_b[j], len(left)).astype(np.int64)
                count_b += np.bincount(j, many_a[i], len(right)).astype(np.int64)
                nodes, roots = local_roots(np.concatenate([star_a, rep_a[i]]), np.concatenate([star_b, rep_b[j]]))
                move = nodes != roots
                star_a, star_b = nodes[move], roots[move]
        reps = np.concatenate([rep_a, rep_b])
        counts = np.concatenate([count_a, count_b])
        hit = counts > 0
        if not hit.any():
            return None
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate([reps[hit], star_a])), "b": pa.array([None] * int(hit.sum()) + star_b.tolist(), pa.int64()), "n": pa.array(np.concatenate([counts[hit], np.zeros(len(star_a), np.int64)]))})

    def run(batches):
        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    if held and (out := links(held)) is not None:
                        yield out
                    held, now = [], row[0]
                held.append(row)
        if held and (out := links(held)) is not None:
            yield out

    return run


def embedding_links(classes: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """Link counts and connecting edges of the classes (rep, many, size, vec), as rows (a, b, n); see _block_links."""
    reach = sin(acos(threshold) / 2) + 1e-9
    centres = fit_cells(classes, classes.count())
    placed = staged(classes.select("rep", "many", "size", "vec").mapInArrow(_assign(centres, reach), "rep long, many long, size int, vec binary, home long, cells array<long>"))
    seen = placed.select("rep", "many", "size", "vec", "home", F.explode("cells").alias("cell"))
    at_home = F.col("home") == F.col("cell")
    # A row for each cell: at most MOST_CELLS for each vector length in the sample.
    sizes = seen.groupBy("cell").agg(F.ceil(F.count(F.when(at_home, 1)) / block).cast("int").alias("homes"), F.ceil(F.count(F.when(~at_home, 1)) / (SHOWN_BLOCKS * block)).cast("int").alias("guests"))
    seen = seen.join(sizes, "cell")
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    home_block, guest_block = mine(F.col("homes")), mine(F.col("guests"))
    # side 2: both sides of one home block; 0 and 1: the two sides of a pair of blocks, guests numbered behind the homes.
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    among = F.transform(upto(F.col("homes")), lambda x: pair(F.least(x, home_block), F.greatest(x, home_block), F.when(x == home_block, 2).when(home_block < x, 0).otherwise(1)))
    with_guests = F.transform(upto(F.col("guests")), lambda x: pair(home_block, F.col("homes") + x, F.lit(0)))
    as_guest = F.transform(upto(F.col("homes")), lambda x: pair(x, F.col("homes") + guest_block, F.lit(1)))
    tasks = F.when(at_home, F.concat(among, with_guests)).otherwise(as_guest)
    dealt = seen.withColumn("t", F.explode(tasks)).select(F.xxhash64("cell", "t.i", "t.j").alias("task"), "cell", "t.side", "rep", "many", "home", "size", "vec")
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_block_links(centres, threshold, reach), "a long, b long, n long")


def embedding_dedup(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    keyed = staged(table.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).mapInArrow(_keys, "id long, key binary, size int, vec binary"))
    classes = staged(keyed.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("many"), F.any_value("size").alias("size"), F.any_value("vec").alias("vec")))
    found = staged(embedding_links(classes, threshold, block))
    groups = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    heads = classes.select("key", "rep", "many").join(counts, "rep", "left").join(groups, F.col("rep") == F.col("id"), "left")
    heads = heads.select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component_id", "rep").alias("head"))
    out = keyed.select("id", "key").join(heads, (F.col("key") == F.col("k")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("head", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return embedding_dedup(read_table(spark, sf_dir, "embeddings"))
