"""Pattern search, alignments by column, and weight matrices over sequence tables (id, seq)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequence import COMPLEMENT_FROM, COMPLEMENT_TO, PIECE, iupac_pattern, kmers, pieces, reverse_complement
from .staging import dealt

_COMPLEMENT = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)
HITS = "id string, start long, end long, match string, strand string, pattern string"


def regex_hits(seqs: DataFrame, patterns: dict[str, str], both_strands: bool = True, ignore_case: bool = True, overlapping: bool = False, cut: int | None = None) -> DataFrame:
    """Matches of named patterns on (id, seq): half-open places on the forward strand; Arrow batches, since SQL gives no places.

    Minus-strand matches are those of the reverse complement. A match longer than cut shows its head and [cut,length].
    """
    flags = re.IGNORECASE if ignore_case else 0
    search = {n: re.compile(f"(?=({p}))" if overlapping else f"({p})", flags) for n, p in patterns.items()}

    def run(batches):
        for batch in batches:
            rows = []
            for id_, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not seq:
                    continue
                turned = seq.translate(_COMPLEMENT)[::-1] if both_strands else None
                for name, pattern in search.items():
                    for strand, text in (("+", seq), ("-", turned)):
                        for m in pattern.finditer(text) if text else ():
                            a, b = m.span(1)
                            if a == b:
                                continue
                            shown = m[1] if cut is None or b - a <= cut else f"{m[1][:cut]}[{cut},{b - a}]"
                            rows.append((id_, a, b, shown, strand, name) if strand == "+" else (id_, len(seq) - b, len(seq) - a, shown, strand, name))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["id", "start", "end", "match", "strand", "pattern"])

    return seqs.select(F.col("id").cast("string"), "seq").mapInArrow(run, HITS)


def motif_hits(seqs: DataFrame, motifs: list[str], both_strands: bool = True) -> DataFrame:
    """All places of IUPAC motifs, overlapping ones too."""
    return regex_hits(seqs, {m: iupac_pattern(m) for m in motifs}, both_strands, True, True)


def motif_totals(seqs: DataFrame, motifs: list[str]) -> DataFrame:
    """(motif, n) over all sequences, counted inside code generation (matches do not overlap)."""
    counts = F.explode(F.array(*[F.struct(F.lit(m).alias("motif"), F.regexp_count("seq", F.lit("(?i)" + iupac_pattern(m))).alias("n")) for m in motifs]))
    return seqs.select(counts.alias("x")).groupBy("x.motif").agg(F.sum("x.n").cast("long").alias("n"))


def _in_pieces(seqs: DataFrame, k: int) -> DataFrame:
    """(id, part, seq): short pieces with all k-mers of the sequences, dealt to all tasks before words are made of them."""
    return dealt(seqs.select("id", F.posexplode(pieces("seq", k)).alias("part", "seq")), "id", "part", "seq")


def kmer_counts(seqs: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(kmer, n, n_seqs); canonical ones stand for themselves and their reverse complement."""
    rows = _in_pieces(seqs, k).select("id", F.explode(kmers("seq", k)).alias("kmer"))
    if canonical:
        rows = rows.withColumn("kmer", F.least("kmer", reverse_complement("kmer")))
    per = rows.groupBy("kmer", "id").agg(F.count("*").alias("n"))
    return per.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_seqs"))


def conserved_words(seqs: DataFrame, k: int) -> DataFrame:
    """k-mers that occur in every sequence, with their count."""
    total = seqs.agg(F.count_distinct("id").alias("all"))
    return kmer_counts(seqs, k).crossJoin(F.broadcast(total)).where(F.col("n_seqs") == F.col("all")).drop("all")


def kmer_track(seqs: DataFrame, counts: DataFrame, k: int, most: int) -> DataFrame:
    """(id, pos, n): the count of each position's k-mer or of its reverse complement, at most `most`.

    Short words are few, however many places have them: their counts go to every task. Places of long ones meet them by word.
    """
    places = _in_pieces(seqs, k).select("id", "part", F.posexplode(kmers("seq", k)).alias("in part", "kmer")).select("id", (F.col("part") * PIECE + F.col("in part")).alias("pos"), F.least("kmer", reverse_complement("kmer")).alias("canon"))
    c = counts.select(F.least("kmer", reverse_complement("kmer")).alias("canon"), "n").groupBy("canon").agg(F.max("n").alias("n"))
    c = F.broadcast(c) if k <= 8 else c.hint("merge")
    return places.join(c, "canon", "left").select("id", "pos", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).alias("n"))


def enumerate_motifs(spark, k: int, alphabet: str = "ACGT") -> DataFrame:
    """All words of length k that are not greater than their reverse complement; the table is generated in parallel."""
    n = len(alphabet)
    rows = spark.range(n**k)
    word = F.concat(*[F.substring(F.lit(alphabet), (F.floor(F.col("id") / n**i) % n + 1).cast("int"), F.lit(1)) for i in range(k)])
    return rows.select(word.alias("motif")).where(F.col("motif") <= reverse_complement("motif"))


def gap_runs(seqs: DataFrame, letters: str = "Nn") -> DataFrame:
    """Runs of letters (unknown bases or gaps) as intervals."""
    return regex_hits(seqs, {"gap": f"[{re.escape(letters)}]+"}, False, False).select(F.col("id").alias("chrom"), "start", "end")


def gap_split(seqs: DataFrame, least: int = 1) -> DataFrame:
    """Stretches between runs of N: (id, part, seq)."""
    parts = seqs.select("id", F.posexplode(F.split("seq", "[Nn]+")).alias("part", "seq"))
    return parts.where(F.length("seq") >= least)


# -- alignments: rows (block, org, seq), equally long inside a block ---------------------------------------------------


def alignment_columns(rows: DataFrame) -> DataFrame:
    """(block, pos, base, n): counts of each column's characters."""
    cells = rows.select("block", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "base")).where("base <> ''")
    return cells.groupBy("block", "pos", "base").agg(F.count("*").alias("n"))


def information_content(rows: DataFrame) -> DataFrame:
    """(block, pos, ic): 2 + sum p log2 p over the bases of a column, gaps left out."""
    cells = alignment_columns(rows).where(F.col("base").isin("A", "C", "G", "T"))
    total = cells.groupBy("block", "pos").agg(F.sum("n").alias("t"))
    p = F.col("n").cast("double") / F.col("t")
    return cells.join(total, ["block", "pos"]).groupBy("block", "pos").agg((F.lit(2e0) + F.sum(p * F.log2(p))).alias("ic"))


def consensus(rows: DataFrame, threshold: float = 0.5, unsure: str = "N") -> DataFrame:
    """(block, seq): each column's most frequent character, `unsure` where its share is below the threshold; ties by character."""
    cells = alignment_columns(rows)
    best = cells.groupBy("block", "pos").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("m"), "base")).alias("b"))
    base = F.when(-F.col("b.m") >= F.col("t") * threshold, F.col("b.base")).otherwise(unsure)
    return best.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", base.alias("c")))), lambda x: x["c"]), "").alias("seq"))


def reduce_gaps(rows: DataFrame, max_share: float) -> DataFrame:
    """Alignment rows without the columns whose share of gaps reaches max_share."""
    cells = rows.select("block", "org", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    bad = cells.groupBy("block", "pos").agg(F.avg((F.col("base") == "-").cast("double")).alias("g")).where(F.col("g") >= max_share)
    kept = cells.join(bad.select("block", "pos"), ["block", "pos"], "left_anti")
    return kept.groupBy("block", "org").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))


def concat_alignments(rows: DataFrame, order: str = "block") -> DataFrame:
    """(org, seq): blocks joined end to end, gaps where an organism has none."""
    widths = rows.groupBy(order).agg(F.max(F.length("seq")).alias("w"))
    grid = rows.select("org").distinct().crossJoin(widths)  # organisms x blocks, the size of the result
    met = grid.join(rows.select(order, "org", "seq"), [order, "org"], "left").withColumn("seq", F.coalesce("seq", F.expr("repeat('-', w)")))
    return met.groupBy("org").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "seq"))), lambda x: x["seq"]), "").alias("seq"))


def percent_identity(rows: DataFrame) -> DataFrame:
    """(block, a, b, identity) of the organism pairs of a block, over columns without gaps."""
    cells = rows.select("block", "org", F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "base")).where("base not in ('', '-')")
    a, b = cells.select("block", "pos", F.col("org").alias("a"), F.col("base").alias("x")), cells.select("block", "pos", F.col("org").alias("b"), F.col("base").alias("y"))
    return a.join(b, ["block", "pos"]).where("a < b").groupBy("block", "a", "b").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("identity"))


# -- weight matrices -------------------------------------------------------------------------------------------------


class WeightMatrix:
    """A position weight matrix of counts (rows of a, c, g, t) scored as (score - min) / (max - min)."""

    def __init__(self, counts: list[list[float]], pseudo: float = 0.001):
        w = np.array(counts, float) + pseudo
        self.freq = w / w.sum(axis=1, keepdims=True)
        self.ic = (self.freq * np.log(4 * self.freq)).sum(axis=1)
        self.weights = self.freq * self.ic[:, None]
        self.low, self.high = self.weights.min(axis=1).sum(), self.weights.max(axis=1).sum()

    def consensus(self, share: float = 0.5) -> str:
        """The base of each position with at least that share, else the pair of bases with 1.5 times it, else N."""
        pairs = {frozenset("AG"): "R", frozenset("CT"): "Y", frozenset("CG"): "S", frozenset("AT"): "W", frozenset("GT"): "K", frozenset("AC"): "M"}
        out = ""
        for row in self.freq:
            order = np.argsort(-row, kind="stable")
            top = [("ACGT")[i] for i in order]
            out += top[0] if row[order[0]] >= share else pairs[frozenset(top[:2])] if row[order[:2]].sum() >= 1.5 * share else "N"
        return out

    def scan(self, seq: str) -> np.ndarray:
        """Scores of all windows; windows with other letters score NaN."""
        code = np.full(256, 4)
        code[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2
        x, k = code[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)], len(self.weights)
        if len(x) < k:
            return np.empty(0)
        w = np.hstack([self.weights, np.full((k, 1), np.nan)])
        total = sum(w[i, x[i : len(x) - k + i + 1]] for i in range(k))
        return (total - self.low) / max(self.high - self.low, 1e-12)


def matrix_hits(seqs: DataFrame, matrices: dict[str, list[list[float]]], cutoff: float) -> DataFrame:
    """(id, start, end, score, strand, pattern) of matrix matches on both strands with at least the cutoff score."""
    scan = {n: WeightMatrix(m) for n, m in matrices.items()}

    def run(batches):
        for batch in batches:
            rows = []
            for id_, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, m in scan.items() if seq else ():
                    k = len(m.weights)
                    for strand, text in (("+", seq), ("-", seq.translate(_COMPLEMENT)[::-1])):
                        scores = m.scan(text)
                        for a in np.nonzero(scores >= cutoff)[0].tolist():
                            start = a if strand == "+" else len(seq) - a - k
                            rows.append((id_, start, start + k, float(scores[a]), strand, name))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()))], names=["id", "start", "end", "score", "strand", "pattern"])

    return seqs.select(F.col("id").cast("string"), "seq").mapInArrow(run, "id string, start long, end long, score double, strand string, pattern string")


def word_windows(hits: DataFrame, needed: dict[str, int], width: int) -> DataFrame:
    """Places (chrom, start, end) that begin a window of width with at least the needed number of each name."""
    w = W.partitionBy("chrom").orderBy("start").rangeBetween(0, width - 1)
    out = hits.where(F.col("name").isin(*needed))
    for i, (name, n) in enumerate(needed.items()):
        out = out.withColumn(f"need {i}", F.count_if(F.col("name") == name).over(w) >= n)
    out = out.withColumn("end", F.max("end").over(w))
    for i in range(len(needed)):
        out = out.where(F.col(f"need {i}")).drop(f"need {i}")
    return out.select("chrom", "start", "end").distinct()


# -- models and clusters of motifs -------------------------------------------------------------------------------------


def markov_model(seqs: DataFrame, order: int) -> DataFrame:
    """(context, base, p) of a Markov chain: shares of the bases behind each context."""
    words = _in_pieces(seqs, order + 1).select(F.explode(kmers("seq", order + 1)).alias("w")).groupBy(F.substring("w", 1, order).alias("context"), F.substring("w", order + 1, 1).alias("base")).agg(F.count("*").alias("n"))
    total = words.groupBy("context").agg(F.sum("n").alias("t"))
    return words.join(total, "context").select("context", "base", (F.col("n").cast("double") / F.col("t")).alias("p"))


def markov_scores(seqs: DataFrame, model: DataFrame, order: int, floor: float = 1e-6) -> DataFrame:
    """(id, n, log_p): summed log2 probability of each sequence's transitions; unseen ones count as `floor`."""
    steps = _in_pieces(seqs, order + 1).select("id", F.explode(kmers("seq", order + 1)).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    steps = steps.select("id", "n", F.substring("w", 1, order).alias("context"), F.substring("w", order + 1, 1).alias("base"))
    met = steps.join(model, ["context", "base"], "left")
    return met.groupBy("id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2(F.coalesce("p", F.lit(floor)))).alias("log_p"))


def neighbours_within_one(motifs: DataFrame) -> DataFrame:
    """(a, b) of equally long motifs that differ in one place: an equi-join on the motif with each place masked in turn."""
    k = F.length("motif")
    masks = F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.substring(F.col("motif"), F.lit(1), i - 1), F.lit("."), F.substring(F.col("motif"), i + 1, k)))
    rows = motifs.where(k > 0).select("motif").distinct().select("motif", F.explode(masks).alias("mask"))
    b = rows.select(F.col("motif").alias("b"), "mask")
    return rows.withColumnRenamed("motif", "a").join(b, "mask").where("a < b").select("a", "b")


def shift_by_gaps(features: DataFrame, gaps: DataFrame, insert: bool = True) -> DataFrame:
    """Feature starts and ends moved by the gaps (chrom, pos, len) before them: to gapped places, or back to ungapped ones.

    gaps.pos counts ungapped places when gaps are inserted and gapped ones when they are removed. A running sum over the union of
    places, carried from chunk to chunk; equal features move alike and come out as often as they went in.
    """
    from .intervals import prefix_sum

    once = features.groupBy("chrom", "start", "end", "name").agg(F.count("*").alias("copies"))
    edges = F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("start").alias("pos")), F.struct(F.lit("e").alias("side"), F.col("end").alias("pos")))).alias("x")
    ask = once.withColumn("shift id", F.struct("chrom", "start", "end", "name", "copies")).select("chrom", "shift id", edges).select("chrom", F.col("x.pos").cast("long").alias("pos"), "x.side", "shift id", F.lit(0).cast("long").alias("len"), F.lit(1).alias("kind"))
    told = gaps.groupBy("chrom", F.col("pos").cast("long").alias("pos")).agg(F.sum("len").cast("long").alias("len")).select("chrom", "pos", F.lit(None).cast("string").alias("side"), F.lit(None).cast(ask.schema["shift id"].dataType).alias("shift id"), "len", F.lit(0).alias("kind"))
    sums = prefix_sum(told.unionByName(ask), F.col("len"), ["pos", "kind"], "gap sum", True).where("kind = 1")
    new = F.col("pos") + F.col("gap sum") * (1 if insert else -1)
    both = sums.groupBy("shift id").agg(F.max(F.when(F.col("side") == "s", new)).alias("start"), F.max(F.when(F.col("side") == "e", new)).alias("end"))
    copy = F.explode(F.array_repeat(F.lit(0), F.col("shift id.copies").cast("int")))
    return both.withColumn("copy", copy).select("shift id.chrom", "start", "end", "shift id.name")


def motif_clusters(hits: DataFrame, copies: int, width: int) -> DataFrame:
    """(id, pattern, start, end) where so many copies of a pattern begin within width of each other."""
    w = W.partitionBy("id", "pattern").orderBy("start", "end")
    last = F.lead("end", copies - 1).over(w) if copies > 1 else F.col("end")
    begin = F.lead("start", copies - 1).over(w) if copies > 1 else F.col("start")
    marked = hits.withColumn("last", last).withColumn("reach", begin - F.col("start"))
    return marked.where(F.col("reach") <= width).select("id", "pattern", "start", F.col("last").alias("end"))


# -- alignments as text, repaired and joined -------------------------------------------------------------------------


def fill_gaps(rows: DataFrame, fill_below: float, drop_from: float = 1.1) -> DataFrame:
    """Gaps take the column's most frequent base where the share of gaps is below fill_below; columns with a share of drop_from or more go."""
    cells = rows.select("block", "org", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    bases = cells.groupBy("block", "pos", "base").agg(F.count("*").alias("n"))
    gap = F.col("base") == "-"
    columns = bases.groupBy("block", "pos").agg((F.coalesce(F.sum(F.when(gap, F.col("n"))), F.lit(0)).cast("double") / F.sum("n")).alias("gaps"), F.min(F.when(~gap, F.struct((-F.col("n")).alias("m"), "base"))).alias("best"))
    met = cells.join(columns, ["block", "pos"]).where(F.col("gaps") < drop_from)
    base = F.when((F.col("base") == "-") & (F.col("gaps") < fill_below), F.coalesce("best.base", "base")).otherwise(F.col("base"))
    return met.groupBy("block", "org").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", base.alias("c")))), lambda x: x["c"]), "").alias("seq"))


def blocks_with(rows: DataFrame, species: list[str], every: bool = True) -> DataFrame:
    """The rows of blocks that hold all (or one) of the species."""
    met = rows.where(F.col("org").isin(*species)).groupBy("block").agg(F.count_distinct("org").alias("n")).where(F.col("n") >= (len(set(species)) if every else 1))
    return rows.join(met, "block", "left_semi")


def block_statistics(rows: DataFrame) -> DataFrame:
    """(block, n_rows, width, gap_share) of an alignment."""
    gaps = F.length("seq") - F.length(F.translate("seq", "-", ""))
    return rows.groupBy("block").agg(F.count("*").alias("n_rows"), F.max(F.length("seq")).cast("long").alias("width"), (F.sum(gaps).cast("double") / F.sum(F.length("seq"))).alias("gap_share"))


def join_adjacent(rows: DataFrame, base: str) -> DataFrame:
    """(chrom, start, org, seq): blocks whose base rows follow each other without a gap as one, missing species filled with gaps.

    rows: (block, org, chrom, start, size, seq); a block's place is its base row's.
    """
    from .intervals import prefix_max

    own = rows.where(F.col("org") == base).select("block", "chrom", "start", (F.col("start") + F.col("size")).alias("end"), F.length("seq").alias("width"))
    before = prefix_max(own, F.struct("start", "end"), ["start", "end"], "row before", False)
    new = F.col("row before").isNull() | (F.col("row before.end") != F.col("start"))
    runs = prefix_max(before, F.when(new, F.col("start")), ["start", "end"], "run", True).select("block", "chrom", "start", "width", "run")
    species = runs.join(rows.select("block", "org"), "block").select("chrom", "run", "org").distinct()
    grid = species.join(runs, ["chrom", "run"]).join(rows.select("block", "org", "seq"), ["block", "org"], "left")
    seq = F.coalesce("seq", F.expr("repeat('-', width)"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", seq.alias("s")))), lambda x: x["s"])
    return grid.groupBy("chrom", "run", "org").agg(F.array_join(parts, "").alias("seq")).select("chrom", F.col("run").alias("start"), "org", "seq")


def maf_text(rows: DataFrame) -> DataFrame:
    """(block, value): alignment rows (block, org, chrom, start, size, strand, src_size, seq) as blocks of lines."""
    line = F.concat_ws(" ", F.lit("s"), F.concat("org", F.lit("."), "chrom"), F.col("start").cast("string"), F.col("size").cast("string"), "strand", F.col("src_size").cast("string"), "seq")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("org", line.alias("l")))), lambda x: x["l"])
    return rows.groupBy("block").agg(F.concat(F.lit("a score=0\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("value"))


def fasta_rows_to_maf(seqs: DataFrame) -> DataFrame:
    """Alignment rows of FASTA records (block, id `org.chrom:start-end(strand)`, seq); ids that do not fit have place 0."""
    fits = r"^([^.\s]+)\.([^:\s]+):(\d+)-(\d+)(?:\(([+-])\))?$"
    part = lambda i: F.regexp_extract("id", fits, i)
    ok = F.col("id").rlike(fits)
    bare = F.length(F.translate("seq", "-", "")).cast("long")
    return seqs.select("block", F.when(ok, part(1)).otherwise(F.col("id")).alias("org"), F.when(ok, part(2)).otherwise("").alias("chrom"), F.when(ok, part(3).try_cast("long")).otherwise(0).alias("start"), bare.alias("size"), F.when(ok & (part(5) == "-"), "-").otherwise("+").alias("strand"), F.when(ok, part(4).try_cast("long")).otherwise(bare).alias("src_size"), "seq")


def read_stockholm(lines: DataFrame) -> DataFrame:
    """(id, seq) of Stockholm lines (line, pos): pieces of a name joined in order, markup left out."""
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "") & ~F.col("line").startswith("//"))
    p = F.split(F.trim("line"), r"\s+")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.translate("part", ".", "-").alias("s")))), lambda x: x["s"])
    return rows.select("pos", p[0].alias("id"), p[1].alias("part")).groupBy("id").agg(F.array_join(pieces, "").alias("seq"))


def matrix_sequences(matrices: DataFrame) -> DataFrame:
    """(id, n, seq): sequences whose columns have a matrix's counts (id, weights array<struct<a, c, g, t>>), short columns filled with n."""
    column = lambda w: F.concat(*[F.array_repeat(F.lit(b), w[b].cast("int")) for b in "acgt"])
    table = matrices.withColumn("columns", F.transform("weights", column))
    depth = F.array_max(F.transform("columns", lambda c: F.size(c)))
    rows = table.select("id", "columns", F.explode(F.sequence(F.lit(0), depth - 1)).alias("n"))
    return rows.select("id", "n", F.array_join(F.transform("columns", lambda c: F.coalesce(F.get(c, F.col("n")), F.lit("n"))), "").alias("seq"))


def matrix_records(matrices: DataFrame) -> DataFrame:
    """(id, value): matrices as records of ID, P0 and one line a position, ended by //."""
    line = lambda w, i: F.concat_ws("\t", F.format_string("%02d", i + 1), *[w[b].cast("long").cast("string") for b in "acgt"])
    lines = F.array_join(F.transform("weights", line), "\n")
    return matrices.select("id", F.concat(F.lit("ID  "), "id", F.lit("\nP0\tA\tC\tG\tT\n"), lines, F.lit("\n//\n")).alias("value"))


def rewrite_ids(seqs: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Sequence ids through a regular expression; groups are written $1."""
    return seqs.withColumn("id", F.regexp_replace("id", pattern, replacement))


def keep_letters(seqs: DataFrame, more_than: int = 9) -> DataFrame:
    """Sequences without characters other than ACGT; short ones go."""
    return seqs.withColumn("seq", F.regexp_replace("seq", "[^ACGTacgt]", "")).where(F.length("seq") > more_than)


def strip_utrs(pairs: DataFrame) -> DataFrame:
    """(id, cds): the part of a cDNA whose translation in one of the three frames holds the peptide; NULL without one."""
    from ..functions.sequence import translate_dna

    found = [F.instr(translate_dna(F.substr("cdna", F.lit(k + 1))), F.col("pep")) for k in range(3)]
    size = F.length("pep") * 3
    cds = F.coalesce(*[F.when((F.length("pep") > 0) & (at > 0), F.substr("cdna", (at - 1) * 3 + k + 1, size)) for k, at in enumerate(found)])
    return pairs.select("id", cds.alias("cds"))


def gapped_windows(rows: DataFrame, width: int, step: int = 1) -> DataFrame:
    """(block, org, start, end, seq): windows of `width` letters of each aligned row, with the gaps between them; start and end count columns."""
    letters = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: ~x["c"].isin("-", ""))
    table = rows.select("block", "org", "seq", letters.alias("l")).where(F.size("l") >= width)
    starts = table.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("l") - width, F.lit(step))))
    first, last = F.get("l", F.col("k"))["i"], F.get("l", F.col("k") + width - 1)["i"]
    return starts.select("block", "org", first.cast("long").alias("start"), (last + 1).cast("long").alias("end"), F.substr("seq", first + 1, last - first + 1).alias("seq"))


def shuffled_columns(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Alignments whose columns are in a seeded order, moved only among columns with the same gaps.

    A block is one row, so its rows are exchanged once and its columns never: those with the same gaps, by place and by a hash of it, stand
    at the same numbers of two sorted lists. Rows of one organism in a block come out as one.
    """
    good = dealt(rows.where(F.col("block").isNotNull() & (F.col("seq") != "")).select("block", "org", "seq"), "block")
    orgs = good.groupBy("block", "org").agg(F.collect_list(F.split("seq", "")).alias("s"), F.max(F.length("seq")).alias("w"))
    blocks = orgs.groupBy("block").agg(F.collect_list(F.struct("org", "s")).alias("rows"), F.max("w").alias("w"))

    def column(i):
        gaps = F.flatten(F.transform("rows", lambda r: F.transform(F.filter(r["s"], lambda s: F.get(s, i) == "-"), lambda s: r["org"])))
        return F.struct(F.array_sort(F.array_compact(gaps)).alias("gaps"), F.xxhash64(F.lit(seed), "block", i).alias("draw"), i.alias("pos"))

    def exploded(df, *keep):
        # A list is worked out once a block: an explode stands between it and the lists that read it again and again.
        return df.select("block", *keep, F.explode(F.array("made")).alias("made"))

    drawn = exploded(blocks.withColumn("made", F.array_sort(F.transform(F.sequence(F.lit(0), F.col("w") - 1), column))), "rows")
    placed = F.array_sort(F.transform("made", lambda c: F.struct(c["gaps"].alias("gaps"), c["pos"].alias("pos"))))
    moves = F.array_sort(F.zip_with("made", placed, lambda c, to: F.struct(to["pos"].alias("to"), c["pos"].alias("from"))))
    moved = exploded(drawn.select("block", "rows", moves.alias("made")), "rows").select("block", "made", F.explode("rows").alias("r"))
    letters = lambda m: F.array_sort(F.filter(F.transform("r.s", lambda s: F.coalesce(F.get(s, m["from"]), F.lit(""))), lambda c: c != ""))
    return moved.select("block", F.col("r.org").alias("org"), F.array_join(F.flatten(F.transform("made", letters)), "").alias("seq"))


def random_sequences(spark, n: int, length: int, gc: float = 0.5, seed: int = 1) -> DataFrame:
    """(id, seq): n sequences of a length with a share of G and C, letter by letter from hashes of seed, id and place."""
    chance = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 30)).cast("double") / (1 << 30)
    letter = lambda i: F.when(chance(i) < gc / 2, "G").when(chance(i) < gc, "C").when(chance(i) < gc + (1 - gc) / 2, "A").otherwise("T")
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("seq"))


def mutated(seqs: DataFrame, identity: float, seed: int = 1) -> DataFrame:
    """(id, seq) with about 1 - identity of the letters replaced by the next one in ACGT."""
    change = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 30)).cast("double") / (1 << 30) >= identity
    letter = lambda c, i: F.when(change(i), F.translate(c, "ACGTacgt", "CGTAcgta")).otherwise(c)
    return seqs.withColumn("seq", F.array_join(F.transform(F.split("seq", ""), letter), ""))


def random_substrings(seqs: DataFrame, pool: DataFrame, seed: int = 1) -> DataFrame:
    """(id, pool_id, start, seq): for each sequence a substring of its length from a pool sequence that is long enough.

    The pool row is drawn by hash among those that meet by number, so the pool is never sorted; ids with too short a draw go.
    """
    from .ranking import global_rank

    numbered = global_rank(pool.select(F.col("id").alias("pool_id"), F.col("seq").alias("pool_seq")), [F.col("pool_id")], "k")
    total = pool.agg(F.count("*").alias("n"))
    asked = seqs.select("id", F.length("seq").alias("len")).crossJoin(F.broadcast(total)).withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("n")) + 1)
    met = asked.join(numbered, "k").where(F.length("pool_seq") >= F.col("len"))
    start = F.pmod(F.xxhash64(F.lit(seed), "id", F.lit("start")), F.length("pool_seq") - F.col("len") + 1)
    return met.select("id", "pool_id", start.alias("start"), F.substr("pool_seq", (start + 1).cast("int"), F.col("len")).alias("seq"))
