"""Families of motifs, motifs on alignment consensus, and weight matrices with a core, over sequence and alignment tables.

An alignment is rows (block, org, seq) of equal length in a block. A block is worked on as one row that holds its aligned
sequences, so its columns need no exchange; blocks are as large as the alignment made them.
"""

from __future__ import annotations

import re
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions.sequence import COMPLEMENT_FROM, COMPLEMENT_TO
from .graph import components
from .intervals import islands
from .sequence import WeightMatrix, neighbours_within_one
from .staging import dealt

_COMPLEMENT = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)
#: The ambiguity code of each set of bases, sets in alphabetical order.
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "CT": "Y", "AG": "R", "AC": "M", "GT": "K", "CG": "S", "AT": "W", "ACT": "H", "CGT": "B", "ACG": "V", "AGT": "D", "ACGT": "N"}


def code_of(letters: Column) -> Column:
    """The ambiguity code of an array of upper-case bases; NULL where another letter is among them."""
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.try_element_at(table, F.array_join(F.array_sort(F.array_distinct(letters)), ""))


# -- families of motifs ----------------------------------------------------------------------------------------------


def motif_families(motifs: DataFrame, foreground: DataFrame, background: DataFrame) -> DataFrame:
    """(family, n_motifs, consensus, n_genes, n_foreground, score): motifs (motif, gene) joined where they differ in one place at most.

    A family is a component of those neighbours, named by its least motif; its genes are those of all its motifs. score is -log10
    of the chance to draw at least so many of the foreground's genes (gene) with the foreground's share of the background (gene).
    """
    words = motifs.where(F.col("motif").isNotNull()).select(F.upper("motif").alias("motif"), "gene").distinct()
    plain = words.select("motif").distinct()
    families = components(neighbours_within_one(plain), plain.select(F.col("motif").alias("node"))).select(F.col("node").alias("motif"), F.col("component").alias("family"))
    letters = families.select("family", F.posexplode(F.split("motif", "")).alias("pos", "base")).where("base <> ''").groupBy("family", "pos").agg(F.collect_set("base").alias("bases"))
    column = F.struct("pos", F.coalesce(code_of(F.col("bases")), F.lit("N")).alias("code"))
    consensus = letters.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x["code"]), "").alias("consensus"))
    genes = words.where(F.col("gene").isNotNull()).join(families, "motif").select("family", "gene").distinct()
    marked = genes.join(foreground.select("gene").distinct().withColumn("marked", F.lit(1)), "gene", "left")
    sets = marked.groupBy("family").agg(F.count("*").alias("n_genes"), F.count("marked").alias("n_foreground"))
    share = foreground.agg(F.count_distinct("gene").alias("some")).crossJoin(background.agg(F.count_distinct("gene").alias("all")))  # one row
    out = families.groupBy("family").agg(F.count("*").alias("n_motifs")).join(consensus, "family").join(sets, "family", "left").crossJoin(F.broadcast(share))
    n, k = F.coalesce("n_genes", F.lit(0)), F.coalesce("n_foreground", F.lit(0))
    return out.select("family", "n_motifs", "consensus", n.alias("n_genes"), k.alias("n_foreground"), st.binomial_score(k, n, F.col("some") / F.col("all")).alias("score"))


# -- alignments ------------------------------------------------------------------------------------------------------


def aligned(rows: DataFrame, ref: str) -> DataFrame:
    """(block, ref, others): the reference's sequence of each block that has one, and the other rows' (org, seq), by organism, in capitals."""
    seq = F.upper("seq")
    others = F.array_sort(F.collect_list(F.when(F.col("org") != ref, F.struct("org", seq.alias("seq")))))
    return rows.where(F.col("seq").isNotNull()).groupBy("block").agg(F.min(F.when(F.col("org") == ref, seq)).alias("ref"), others.alias("others")).where(F.col("ref").isNotNull())


def block_consensus(rows: DataFrame, ref: str) -> DataFrame:
    """(block, ref, consensus, score): ambiguity codes of the bases in each column; score counts the columns where all rows agree.

    Gaps and N of the reference stay; a gap in another row gives #, so that no motif is found across it; N in other rows says nothing;
    letters that are no bases give a dot.
    """
    table = aligned(rows, ref).select("block", "ref", F.split("ref", "").alias("r"), F.transform("others", lambda o: F.split(o["seq"], "")).alias("o"))

    def column(base, i):
        beside = F.transform("o", lambda s: F.coalesce(F.get(s, i), F.lit("-")))
        told = F.concat(F.array(base), F.filter(beside, lambda x: x != "N"))
        return F.when(base.isin("-", "N"), base).when(F.array_contains(beside, "-"), F.lit("#")).otherwise(F.coalesce(code_of(told), F.lit(".")))

    letters = F.filter("r", lambda x: x != "")
    codes = F.transform(letters, column)
    return table.select("block", "ref", codes.alias("c")).select("block", "ref", F.array_join("c", "").alias("consensus"), F.size(F.filter("c", lambda x: x.isin("A", "C", "G", "T"))).cast("long").alias("score"))


def _motif_pattern(motif: str) -> str:
    """A motif as a pattern over consensus codes: each code whose bases the motif's letter allows."""
    sets = {code: bases for bases, code in CODES.items()}
    allowed = lambda c: "".join(code for code, bases in sets.items() if set(bases) <= set(sets[c]))
    return "".join(f"[{allowed(c)}]" for c in motif.upper())


def consensus_hits(rows: DataFrame, ref: str, motifs: list[str], both_strands: bool = True) -> DataFrame:
    """(block, motif, strand, column, start, end, score): motifs on the blocks' consensus, with the place in the reference without its gaps.

    A motif's letter also meets the codes of some of its bases. column counts columns of the block from 0, start and end letters of
    the reference: one running count of letters a block maps all its hits. Overlapping hits count; minus-strand motifs are turned.
    """
    table = block_consensus(rows, ref)
    block = table.schema["block"].dataType.simpleString()
    turned = {m: "".join({"Y": "R", "R": "Y", "M": "K", "K": "M", "H": "D", "D": "H", "B": "V", "V": "B"}.get(c, c.translate(_COMPLEMENT)) for c in reversed(m.upper())) for m in motifs}
    search = [(m, s, re.compile(f"(?={_motif_pattern(x)})")) for m in motifs for s, x in [("+", m), *([("-", turned[m])] if both_strands else [])]]

    def run(batches):
        for batch in batches:
            out = []
            for block_id, seq, codes, score in zip(*(c.to_pylist() for c in batch.columns)):
                before = None
                for motif, strand, pattern in search:
                    for m in pattern.finditer(codes):
                        if before is None:
                            before = np.concatenate([[0], np.cumsum(np.frombuffer(seq.encode("ascii", "replace"), np.uint8) != ord("-"))]).tolist()
                        at = before[m.start()]
                        out.append((block_id, motif, strand, m.start(), at, at + len(motif), score))
            if out:
                kinds = (batch.schema.field(0).type, pa.string(), pa.string(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "motif", "strand", "column", "start", "end", "score"])

    return table.select("block", "ref", "consensus", "score").mapInArrow(run, f"block {block}, motif string, strand string, `column` long, start long, end long, score long")


def letter_columns(seq: str | Column) -> Column:
    """The columns of an aligned sequence's letters, so that element k is the column of letter k."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.transform(F.filter(F.transform(F.split(s, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: ~x["c"].isin("-", "")), lambda x: x["i"])


def alignment_slices(rows: DataFrame, ref: str, places: DataFrame) -> DataFrame:
    """(block, start, end, first, last, org, seq): all rows of a block between two letters of its reference, for places (block, start, end).

    start and end count the reference's letters from 0, end behind the last; first and last are the columns cut at. Places beyond
    the reference are dropped; repeated places stay.
    """
    index = rows.where(F.col("org") == ref).groupBy("block").agg(F.min("seq").alias("ref")).select("block", letter_columns("ref").alias("at"))
    met = places.join(index, "block").where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.size("at")))
    cut = met.select("block", "start", "end", F.get("at", F.col("start").cast("int")).alias("first"), (F.get("at", (F.col("end") - 1).cast("int")) + 1).alias("last"))
    return cut.join(rows.select("block", "org", "seq"), "block").select("block", "start", "end", "first", "last", "org", F.substr("seq", F.col("first") + 1, F.col("last") - F.col("first")).alias("seq"))


def ungapped_blocks(rows: DataFrame, least: int = 1) -> DataFrame:
    """(block, part, column, org, start, seq): the stretches of columns, of at least that width, where no row of the block has a gap.

    A block's rows meet once and are cut where they are; a row that ends early ends in gaps. start counts the row's own letters.
    """
    good = dealt(rows.where(F.col("seq").isNotNull() & F.col("block").isNotNull()).select("block", "org", "seq"), "block")
    table = good.groupBy("block").agg(F.collect_list(F.struct("org", "seq")).alias("rows"))
    block, org = (good.schema[c].dataType.simpleString() for c in ("block", "org"))
    full = re.compile(f" {{{max(least, 1)},}}")

    def run(batches):
        for batch in batches:
            cells = batch.column(1)
            orgs, seqs = cells.flatten().flatten()
            texts, at, out = seqs.to_pylist(), 0, []
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())

            def made():
                n, part, column, row, start, seq = (pa.array(c, t) for c, t in zip(zip(*out), kinds))
                return pa.RecordBatch.from_arrays([batch.column(0).take(n), part, column, orgs.take(row), start, seq], ["block", "part", "column", "org", "start", "seq"])

            for n, size in enumerate(pc.list_value_length(cells).to_pylist()):
                own = texts[at : at + size]
                columns = "".join(["-" if "-" in c else " " for c in zip_longest(*own, fillvalue="-")])
                for part, m in enumerate(full.finditer(columns)):
                    a, z = m.span()
                    out += [(n, part, a, at + i, a - s.count("-", 0, a), s[a:z]) for i, s in enumerate(own)]
                at += size
                if len(out) > 1 << 14:
                    yield made()
                    out.clear()
            if out:
                yield made()

    return table.mapInArrow(run, f"block {block}, part int, `column` int, org {org}, start long, seq string")


def aligned_columns(rows: DataFrame, ref: str, other: str) -> DataFrame:
    """(block, place, base, kind, aligned, other_place): each letter of the reference with what stands against it in another row.

    kind is `|` for an equal letter, `.` for another one and a space for a gap; place and other_place count letters from 0. A letter
    of the other row against a gap of the reference has no place and is in no row; a row that ends early ends in gaps.
    """
    side = lambda org, c: rows.where((F.col("org") == org) & F.col("seq").isNotNull()).select("block", F.col("seq").alias(c))
    met = side(ref, "a").join(side(other, "b"), "block")
    block = met.schema["block"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block_id, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                b = b.ljust(len(a), "-")
                x, y = (np.array(list(s[: len(a)]), "U1") for s in (a, b))
                at = np.nonzero(x != "-")[0]
                x, facing = x[at], y[at]
                there = np.cumsum(y != "-")[at] - 1
                gap = facing == "-"
                kind = np.where(gap, " ", np.where(np.char.upper(x) == np.char.upper(facing), "|", "."))
                yield pa.RecordBatch.from_arrays([
                    pa.array([block_id] * len(at), batch.schema.field(0).type), pa.array(np.arange(len(at), dtype=np.int64)), pa.array(x.tolist(), pa.string()),
                    pa.array(kind.tolist(), pa.string()), pa.array(facing.tolist(), pa.string(), mask=gap), pa.array(there.astype(np.int64), mask=gap),
                ], ["block", "place", "base", "kind", "aligned", "other_place"])

    return met.mapInArrow(run, f"block {block}, place long, base string, kind string, aligned string, other_place long")


# -- weight matrices with a core -------------------------------------------------------------------------------------


class CoreMatrix(WeightMatrix):
    """A weight matrix with a core of its most conserved positions, which decides what windows are scored at all."""

    def __init__(self, counts: list[list[float]], pseudo: float = 0.001, core: int = 5):
        super().__init__(counts, pseudo)
        self.core = sorted(np.argsort(-self.ic, kind="stable")[:core].tolist())
        self.core_low, self.core_high = (f(self.weights[self.core], axis=1).sum() for f in (np.min, np.max))
        self.padded = np.hstack([self.weights, np.full((len(self.weights), 1), np.nan)])
        self.code = np.full(256, 4)
        self.code[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2

    def codes(self, seq: str) -> np.ndarray:
        return self.code[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]

    def hits(self, x: np.ndarray, core_cutoff: float, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, core scores and scores of the windows of letter codes that reach both cutoffs; windows with other letters reach none."""
        k = len(self.weights)
        if len(x) < k:
            return (np.empty(0, int),) + (np.empty(0),) * 2
        core = sum(self.padded[i, x[i : len(x) - k + i + 1]] for i in self.core)
        core = (core - self.core_low) / max(self.core_high - self.core_low, 1e-12)
        at = np.nonzero(core >= core_cutoff)[0]
        score = (sum((self.padded[i, x[at + i]] for i in range(k)), np.zeros(len(at))) - self.low) / max(self.high - self.low, 1e-12)
        good = score >= cutoff
        return at[good], core[at[good]], score[good]

    def under(self, strand: str) -> np.ndarray:
        """The core's positions in a window of that strand, in order."""
        return np.sort(np.array([i if strand == "+" else len(self.weights) - 1 - i for i in self.core], np.int64))

    def shared_hits(self, text: str, wide: np.ndarray, sizes: np.ndarray, strand: str, core_cutoff: float, cutoff: float, least: int) -> tuple[np.ndarray, ...]:
        """Block number, start, reference's score and number of rows of the windows that so many of a block's rows share.

        text is the aligned rows one behind the other, wide their lengths, sizes the number of rows of each block, its reference first.
        Every window of letters is scored once; a row's window is looked up by its letters before the column where the reference's begins.
        """
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        k = len(self.weights)
        raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        letter = raw != ord("-")
        before = np.concatenate([[0], np.cumsum(letter)])
        codes = self.code[raw[letter]]
        if len(codes) < k:
            return none
        codes = codes if strand == "+" else np.where(codes < 4, 3 - codes, 4)
        x = np.lib.stride_tricks.sliding_window_view(codes, k)
        x = x if strand == "+" else x[:, ::-1]
        core = (self.padded[self.core, x[:, self.core]].sum(axis=1) - self.core_low) / max(self.core_high - self.core_low, 1e-12)
        whole = (self.padded[np.arange(k), x].sum(axis=1) - self.low) / max(self.high - self.low, 1e-12)
        hit = (core >= core_cutoff) & (whole >= cutoff)
        offset = np.concatenate([[0], np.cumsum(wide)])[:-1]
        first_row = np.cumsum(sizes) - sizes
        # The reference's windows of each block, and the columns where they begin.
        own = before[offset[first_row]]
        n_windows = np.maximum(before[offset[first_row] + wide[first_row]] - own - k + 1, 0)
        block = np.repeat(np.arange(len(sizes)), n_windows)
        window = np.cumsum(n_windows) - n_windows
        start = np.arange(len(block)) - window[block]
        place = own[block] + start
        column = np.nonzero(letter)[0][place] - offset[first_row][block]
        # Each row meets the windows of its block.
        of_block = np.repeat(np.arange(len(sizes)), sizes)
        met = n_windows[of_block]
        row = np.repeat(np.arange(len(wide)), met)
        asked = np.arange(len(row)) - np.repeat(np.cumsum(met) - met, met) + window[of_block[row]]
        first = before[offset[row] + np.minimum(column[asked], wide[row])]
        fits = first + k <= before[offset[row] + wide[row]]
        count = np.bincount(asked[fits], weights=hit[first[fits]], minlength=len(block)).astype(np.int64)
        good = np.nonzero(count >= least)[0]
        return block[good], start[good], whole[place[good]], count[good]


_HITS = "id string, start long, end long, core double, score double, strand string, pattern string"


def core_hits(seqs: DataFrame, matrices: dict[str, list[list[float]]], core_cutoff: float, cutoff: float) -> DataFrame:
    """(id, start, end, core, score, strand, pattern) of matrix hits on both strands of (id, seq), in two stages.

    The five most conserved positions are scored everywhere; only windows that reach core_cutoff are scored whole. Both scores run
    from 0 to 1 between the least and the greatest possible. Windows with letters other than ACGT are no hits.
    """
    scan = {n: CoreMatrix(m) for n, m in matrices.items()}

    def run(batches):
        for batch in batches:
            # A batch is scanned as one text; a line end between sequences is no letter, so no window reaches across.
            texts = [s or "" for s in batch.column(1).to_pylist()]
            begins = np.concatenate([[0], np.cumsum([len(s) + 1 for s in texts])])
            whole = "\n".join(texts)
            out = []
            for strand in "+-":
                text = whole if strand == "+" else whole.translate(_COMPLEMENT)[::-1]
                for name, m in scan.items():
                    k = len(m.weights)
                    at, core, score = m.hits(m.codes(text), core_cutoff, cutoff)
                    place = at if strand == "+" else len(whole) - at - k
                    row = np.searchsorted(begins, place, "right") - 1
                    start = place - begins[row]
                    n = len(at)
                    out.append(pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(start + k, pa.int64()), pa.array(core), pa.array(score), pa.array([strand] * n, pa.string()), pa.array([name] * n, pa.string())], ["id", "start", "end", "core", "score", "strand", "pattern"]))
            yield from out

    return dealt(seqs.select(F.col("id").cast("string"), "seq"), "id", "seq").mapInArrow(run, _HITS)


def disjoint_hits(hits: DataFrame, closed: bool = False) -> DataFrame:
    """The hits that are left when the best one is taken first and what overlaps it goes, sequence by sequence.

    Best is the highest score, then the first start, end, pattern and strand. closed: ends are inside, so neighbours that touch
    overlap. Hits that do not hang together by overlaps cannot disturb each other: each run of them is chosen from by itself.
    """
    runs = islands(hits.withColumn("chrom", F.col("id")), ties=("pattern", "strand", "score"), touching=closed).withColumn("order", F.struct((-F.col("score")).alias("s"), "start", "end", "pattern", "strand"))
    ranked = runs.groupBy("id", "island").agg(F.array_sort(F.collect_list(F.struct("order", *hits.columns))).alias("h"))
    empty = F.slice("h", 1, 0)
    clear = lambda acc, x: ~F.exists(acc, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"]) if closed else (y["start"] < x["end"]) & (x["start"] < y["end"]))
    kept = F.aggregate("h", empty, lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ranked.select(F.explode(kept).alias("k")).select(*[F.col("k")[c].alias(c) for c in hits.columns])


def conserved_hits(rows: DataFrame, ref: str, matrices: dict[str, list[list[float]]], core_cutoff: float, cutoff: float, least: int) -> DataFrame:
    """(block, pattern, strand, start, end, score, n_rows, core_at): matrix hits that at least so many rows of an alignment share.

    A window is as many letters of each row as the matrix is long, from the column where the reference's window begins, gaps
    left out; it counts if it reaches both cutoffs. score is the reference's, which need not reach them; start and end are its
    letters; core_at lists the letters under the core's positions.
    """
    scan = {n: CoreMatrix(m) for n, m in matrices.items()}
    good = dealt(rows.select("block", "org", "seq"), "block")
    table = aligned(good, ref).select("block", F.concat(F.array("ref"), F.transform("others", lambda o: o["seq"])).alias("seqs"))
    block = table.schema["block"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            texts = batch.column(1).flatten().to_pylist()
            wide = np.fromiter(map(len, texts), np.int64, len(texts))
            begins = np.concatenate([[0], np.cumsum(sizes)])
            # Blocks are taken many at a time, as one text, up to so many pairs of a window and a row.
            load = np.concatenate([[0], np.cumsum(wide[begins[:-1]] * sizes)])
            low = 0
            while low < len(sizes):
                high = max(low + 1, int(np.searchsorted(load, load[low] + (1 << 18), "right")) - 1)
                rows_of = slice(begins[low], begins[high])
                for name, m in scan.items():
                    for strand in "+-":
                        n, *found = m.shared_hits("".join(texts[rows_of]), wide[rows_of], sizes[low:high], strand, core_cutoff, cutoff, least)
                        if len(n):
                            yield _shared_rows(batch.column(0).take(pa.array(n + low)), name, strand, len(m.weights), m.under(strand), *found)
                low = high

    return table.mapInArrow(run, f"block {block}, pattern string, strand string, start long, end long, score double, n_rows long, core_at array<long>")


def _shared_rows(blocks: pa.Array, name: str, strand: str, k: int, under: np.ndarray, start: np.ndarray, score: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A batch of conserved_hits' rows."""
    n = len(start)
    core_at = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(under)), pa.array((start[:, None] + under).ravel()))
    return pa.RecordBatch.from_arrays([
        blocks, pa.array([name] * n, pa.string()), pa.array([strand] * n, pa.string()), pa.array(start), pa.array(start + k), pa.array(score, mask=np.isnan(score)), pa.array(count), core_at
    ], ["block", "pattern", "strand", "start", "end", "score", "n_rows", "core_at"])


def touching_core(hits: DataFrame, places: DataFrame) -> DataFrame:
    """conserved_hits' rows with a core letter at one of the places (block, place)."""
    at = hits.select("block", "pattern", "strand", "start", F.explode("core_at").alias("place")).join(places.select("block", "place").distinct(), ["block", "place"], "left_semi")
    return hits.join(at.select("block", "pattern", "strand", "start").distinct(), ["block", "pattern", "strand", "start"], "left_semi")


def matrix_choice(matrices: dict[str, list[list[float]]], exclude: tuple[str, ...] = (), pattern: str | None = None, least_sites: float = 0, least_bits: float = 0) -> dict[str, list[list[float]]]:
    """Matrices by name, number of sites (the greatest column sum) and information content in bits."""

    def bits(counts) -> float:
        f = WeightMatrix(counts).freq
        return float((2 + (f * np.log2(f)).sum(axis=1)).sum())

    return {n: m for n, m in matrices.items() if n not in exclude and (pattern is None or re.search(pattern, n)) and max(map(sum, m)) >= least_sites and bits(m) >= least_bits}


def motif_windows(hits: DataFrame, needed: dict[str, int], width: int) -> DataFrame:
    """(chrom, start, end, n, members): windows that begin with a hit and hold at least the needed number of each name, with their members.

    Hits that begin in [start, start + width) belong to a window; members lists them as (start, end, name). A hit is told to the two
    bins of that width where its windows may begin, an equi-join, so no task holds a chromosome; windows of one start are one row.
    """
    rows = hits.where(F.col("name").isin(*needed)).select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name")
    # A hit is told to the bins its windows may begin in: its own and the one before it.
    slot = F.floor(F.col("start") / width).cast("long")
    told = rows.withColumn("bin", F.explode(F.array(slot - 1, slot))).select("chrom", "bin", F.struct("start", "end", "name").alias("m"))
    begins = rows.select("chrom", "start", slot.alias("bin")).distinct()
    met = begins.join(told, ["chrom", "bin"]).where((F.col("m.start") >= F.col("start")) & (F.col("m.start") < F.col("start") + width))
    counts = [F.count_if(F.col("m.name") == name).alias(f"need {i}") for i, name in enumerate(needed)]
    out = met.groupBy("chrom", "start").agg(F.max("m.end").alias("end"), F.count("*").alias("n"), F.array_sort(F.collect_list("m")).alias("members"), *counts)
    for i, n in enumerate(needed.values()):
        out = out.where(F.col(f"need {i}") >= n)
    return out.select("chrom", "start", "end", "n", "members")
