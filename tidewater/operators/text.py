"""Extraction from running text: nucleotide strings, identifiers with context, numbers of words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

# Limits of the nucleotide detector.
MIN_WORD, MIN_TRAIL, MIN_LONG_WORD, MIN_CONTENT, MIN_LETTERS, CONTEXT = 3, 17, 19, 0.4, 3, 50
_WORD = re.compile(r"[A-Za-z]+")
_PURE = re.compile(r"[ACGTUNacgtun]+\Z")
_OTHER = re.compile(r"[^ACGTUNacgtun]")
STRINGS = "doc_id long, seq_no int, start int, end int, seq string, parts int, context string"


def blank_out(pattern: str, text: str) -> str:
    """Matches become as many blanks, so that places stay."""
    return re.sub(pattern, lambda m: " " * len(m[0]), text)


def blanked(docs: DataFrame, pattern: str, text: str = "text", out: str = "blanked") -> DataFrame:
    """Adds the text with the pattern's matches as blanks, places kept; a null text stays null."""
    columns = docs.columns

    def run(batches):
        at = columns.index(text)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if t is None else blank_out(pattern, t) for t in batch.column(at).to_pylist()], pa.string())], names=[*columns, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def nucleotide_strings(text: str, most: int | None = None) -> list[tuple[int, int, str, int]]:
    """(start, end, seq, parts) of nucleotide-like strings that running words spell.

    Words of nucleotide letters gather while they follow each other (short ones only behind a long enough beginning); long words
    that are mostly nucleotides join with their other letters taken out. Any other word ends a string, which counts if it is long
    and varied enough. A text with more than `most` strings gives none; there is no limit by default.
    """
    found, held = [], []

    def flush():
        seq = "".join(s for _, _, s in held)
        if len(seq) >= MIN_LONG_WORD and len(set(seq.upper()) & set("ACGTU")) >= MIN_LETTERS:
            found.append((held[0][0], held[-1][1], seq.upper().replace("U", "T"), len(held)))
        held.clear()

    for m in _WORD.finditer(text):
        word = m[0]
        if _PURE.match(word) and (len(word) >= MIN_WORD or sum(len(s) for _, _, s in held) > MIN_TRAIL):
            held.append((m.start(), m.end(), word))
        elif len(word) >= MIN_LONG_WORD and len(word) - len(_OTHER.findall(word)) >= MIN_CONTENT * len(word):
            held.append((m.start(), m.end(), _OTHER.sub("", word)))
        else:
            flush()
    flush()
    return [] if most is not None and len(found) > most else found


def extract_nucleotides(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int | None = None) -> DataFrame:
    """A row for each nucleotide-like string of each document; the fold over words has no SQL form."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b, seq, parts) in enumerate(nucleotide_strings(t or "", most)):
                    rows.append((doc, k, a, b, seq, parts, t[max(0, a - CONTEXT) : b + CONTEXT]))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in STRINGS.split(", ")])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, STRINGS)


def pattern_contexts(docs: DataFrame, pattern: str, id_col: str = "doc_id", text: str = "text", around: int = 100) -> DataFrame:
    """(doc_id, start, match, context) of a pattern's matches, context white space collapsed."""
    search = re.compile(pattern)

    def run(batches):
        for batch in batches:
            rows = [(doc, m.start(), m[0], re.sub(r"\s+", " ", t[max(0, m.start() - around) : m.end() + around])) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for m in search.finditer(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["doc_id", "start", "match", "context"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, "doc_id long, start int, match string, context string")


def dna_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", content: float = 0.4, least: int = 10) -> DataFrame:
    """(id, line_no, seq): lines that are mostly DNA letters, other characters stripped."""
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    letters = F.regexp_replace("line", "[^ACGTacgt]", "")
    return lines.where((F.length("line") > least) & (F.length(letters) > F.length("line") * content)).select(id_col, "line_no", letters.alias("seq"))


def tag_text(docs: DataFrame, html: str, out: str = "plain") -> DataFrame:
    """Markup replaced by blanks of one character, scripts and styles taken out."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return docs.withColumn(out, F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " ")))


def disambiguate_chains(hits: DataFrame, chain: str, seq: str) -> DataFrame:
    """Hits of sequences kept only on their largest chains, ties kept: aggregates and joins, no window over a hot key."""
    sizes = hits.groupBy(chain).agg(F.count("*").alias("chain size"))
    met = hits.join(sizes, chain)
    best = met.groupBy(F.col(seq).alias("best seq")).agg(F.max("chain size").alias("best size"))
    return met.join(best, (F.col(seq) == F.col("best seq")) & (F.col("chain size") == F.col("best size"))).drop("chain size", "best seq", "best size")


def best_genes(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """Genes with at least two sequences; of genes with one set of sequences the one with the highest weight."""
    sets = hits.groupBy("gene").agg(F.array_sort(F.collect_set("seq")).alias("seqs")).where(F.size("seqs") >= 2)
    met = sets.join(weights, "gene", "left").withColumn("weight", F.coalesce("weight", F.lit(0e0)))
    best = met.groupBy("seqs").agg(F.min(F.struct((-F.col("weight")).alias("w"), "gene")).alias("b"))
    return best.select("b.gene", "seqs")


def cleaned(text: str) -> Column:
    """Letters in running text: markup, formula blocks and characters that are no letters become single blanks."""
    bare = F.regexp_replace(text, r"(?s)MathType@MTEF@.*?@\w+@", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[^A-Za-z]+", " "))


def select_html(docs: DataFrame, html: str, tag: str, cls: str | None = None, out: str = "found") -> DataFrame:
    """A row for each element of a tag (and class): its inner text without markup. Elements of one tag are not nested."""
    inside = rf"(?is)<{tag}\b[^>]*class\s*=\s*[\"']?(?:[^\"'>]*\s)?{cls}(?:\s[^\"'>]*)?[\"'][^>]*>(.*?)</{tag}>" if cls else rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"
    texts = F.transform(F.regexp_extract_all(html, F.lit(inside), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")))
    return docs.withColumn(out, F.explode(texts))


def table_cells(docs: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, row_no, cells) of the rows of HTML tables, cells without markup."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    rows = docs.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r"))
    return rows.select(id_col, "row_no", F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain).alias("cells"))


def article_fields(docs: DataFrame, xml: str, fields: dict[str, str], references: str | None = None) -> DataFrame:
    """Article XML as columns by XPath; with `references` a path of citations, also the list of their texts."""
    got = [F.coalesce(F.xpath_string(xml, F.lit(p)), F.lit("")).alias(n) for n, p in fields.items()]
    return docs.select("*", *got, *([F.xpath(xml, F.lit(references)).alias("references")] if references else []))


def peptide_strings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 8) -> DataFrame:
    """(id, peptide): words of capitals of the 20 amino acids with at least six kinds of letters that are no DNA."""
    words = docs.select(id_col, F.explode(F.regexp_extract_all(text, F.lit(rf"\b([ACDEFGHIKLMNPQRSTVWY]{{{least},}})\b"), F.lit(1))).alias("peptide"))
    kinds = F.size(F.array_distinct(F.split("peptide", "")))
    return words.where((kinds >= 6) & ~F.col("peptide").rlike("^[ACGTN]+$"))


def first_text(sources: dict[str, DataFrame], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, source): each document's text from the first source, in their order, that has one."""
    from .table import coalesce_sources

    return coalesce_sources(id_col, text, *sources.items())


def report_hits(lines: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Long alignment reports as hit rows: (query, target, score, e_value, identity, length) of each `>` block of each `Query=` part.

    lines: (file, pos, line). A line's query, target and score are the last ones before it: windows over chunks of a file's lines, with
    a carry of one row a chunk, so no task holds a file.
    """
    part = lambda pattern, i: F.regexp_extract("line", f"(?Ud){pattern}", i)
    is_ = lambda pattern: F.col("line").rlike(f"(?Ud){pattern}")
    query, target, found = r"^Query=\s*(\S+)", r"^>\s*(\S+)", r"Identities\s*=\s*(\d+)/(\d+)"
    score = r"Score\s*=\s*([\d.]+).*Expect(?:\(\d+\))?\s*=\s*([\d.e+-]+)"
    kind = F.when(is_(query), 1).when(is_(target), 2).when(is_(score), 3).when(is_(found), 4)
    rows = lines.select("file", "pos", "line", kind.alias("kind"), F.floor(F.col("pos") / chunk).alias("at")).where("kind is not null")
    e = part(score, 2)
    told = {
        "q": F.when(F.col("kind") == 1, F.struct("pos", part(query, 1).alias("v"))),
        "t": F.when(F.col("kind") <= 2, F.struct("pos", F.when(F.col("kind") == 2, part(target, 1)).alias("v"))),
        "s": F.when(F.col("kind") == 3, F.struct("pos", part(score, 1).cast("double").alias("v"), F.when(e.startswith("e"), F.concat(F.lit("1"), e)).otherwise(e).cast("double").alias("e"))),
    }
    same = F.when(F.col("kind") == 4, F.struct(part(found, 1).cast("long").alias("a"), part(found, 2).cast("long").alias("b")))
    rows = rows.select("file", "pos", "at", same.alias("i"), *[v.alias(n) for n, v in told.items()])
    w = W.partitionBy("file", "at").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.select("file", "at", "i", *[F.max(n).over(w).alias(n) for n in told]).where("i is not null")
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy("file", "at").agg(*[F.max(n).alias(n) for n in told])
    carry = tops.select("file", "at", *[F.max(n).over(before).alias(f"before {n}") for n in told]).hint("merge")
    met = inside.join(carry, ["file", "at"]).select("i", *[F.greatest(n, f"before {n}").alias(n) for n in told])
    share = F.lit(100e0) * F.col("i.a") / F.col("i.b")
    return met.where("q.v is not null and t.v is not null").select(F.col("q.v").alias("query"), F.col("t.v").alias("target"), F.col("s.v").alias("score"), F.col("s.e").alias("e_value"), share.alias("identity"), F.col("i.b").alias("length"))


def element_rows(lines: DataFrame) -> DataFrame:
    """(chrom, start, end, name, score, strand) of conserved-element reports: `name chrom start end ... length score p-value` lines."""
    p = F.split(F.trim("line"), r"\s+")
    ok = F.col("line").rlike(r"^\s*\S+\s+\S+\s+\d+\s+\d+\s+.*\S+\s*$") & (F.size(p) >= 6)
    return lines.where(ok).select(p[1].alias("chrom"), p[2].cast("long").alias("start"), p[3].cast("long").alias("end"), p[0].alias("name"), F.coalesce(F.floor(F.element_at(p, -2).try_cast("double")), F.lit(0)).cast("int").alias("score"), F.lit("+").alias("strand"))


def stanza_settings(lines: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Adds `settings`: the map of a line's key=value parts, quoted values whole, only allowed keys."""
    pairs = F.regexp_extract_all(column, F.lit(r"""(\w+=(?:"[^"]*"|'[^']*'|\S+))"""), F.lit(1))
    made = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(F.regexp_replace(x, r"^\w+=", ""), r"""^["']|["']$""", ""))))
    return lines.withColumn("settings", F.map_filter(made, lambda k, v: k.isin(*allowed)))
