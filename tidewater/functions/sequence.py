"""Column functions over nucleotide strings; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes, the bases that each stands for, and complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT_FROM = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq: str | Column) -> Column:
    """Reverse complement over the whole IUPAC alphabet; other characters pass through."""
    return F.reverse(F.translate(_col(seq), COMPLEMENT_FROM, COMPLEMENT_TO))


def gc_percent(seq: str | Column) -> Column:
    """Percentage of upper-case G and C; NULL for an empty string."""
    s = _col(seq)
    n = F.length(s)
    return F.lit(100e0) * (n - F.length(F.translate(s, "GC", ""))) / F.nullif(n, F.lit(0))


def dna_content(seq: str | Column) -> Column:
    """Share of acgt letters of either case."""
    s = _col(seq)
    return (F.length(s) - F.length(F.translate(s, "ACGTacgt", ""))).cast("double") / F.nullif(F.length(s), F.lit(0))


def iupac_pattern(motif: str) -> str:
    """A motif as a regular expression of character classes."""
    return "".join(f"[{IUPAC[c]}]" if len(IUPAC[c]) > 1 else IUPAC[c] for c in motif.upper())


def hamming(a: str | Column, b: str | Column) -> Column:
    """Differing places of two strings of equal length, -1 for others."""
    a, b = _col(a), _col(b)
    places = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    n = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.when(F.length(a) == F.length(b), n.cast("long")).otherwise(F.lit(-1).cast("long"))


def identity(a: str | Column, b: str | Column) -> Column:
    """Places with equal characters, over the shorter length."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))).otherwise(0).cast("long")


def kmers(seq: str | Column, k: int) -> Column:
    """All k-mers in order, as an array."""
    s = _col(seq)
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def slice_sequence(seq: str | Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    """seq[start:end) clamped to the sequence, reverse-complemented on the minus strand."""
    s = _col(seq)
    part = F.substring(s, start + 1, F.greatest(F.least(end, F.length(s)) - start, F.lit(0)))
    return part if strand is None else F.when(strand == "-", reverse_complement(part)).otherwise(part)


# The genetic code by its rule: amino acids of the codons in TCAG order, first base slowest.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_dna(seq: str | Column) -> Column:
    """Amino acids of the codons of a sequence; unknown codons give X, a rest of under three bases goes."""
    s = F.upper(_col(seq))
    base = lambda i: F.instr(F.lit("TCAG"), F.substring(s, i, F.lit(1))) - 1

    def amino(i):
        a, b, c = base(i), base(i + 1), base(i + 2)
        return F.when((a < 0) | (b < 0) | (c < 0), "X").otherwise(F.substring(F.lit(_AMINO), a * 16 + b * 4 + c + 1, F.lit(1)))

    n = F.floor(F.length(s) / 3).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: amino(k * 3 + 1)), "")).otherwise("")


def wrap(text: str | Column, width: int = 80) -> Column:
    """Lines of at most width characters."""
    return F.rtrim(F.regexp_replace(_col(text), f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def ungapped(seq: str | Column) -> Column:
    return F.translate(_col(seq), "-", "")


def parse_range(header: str | Column) -> Column:
    """(chrom, start, end) of a `range=chrom:start-end` header."""
    h = _col(header)
    part = lambda i: F.regexp_extract(h, r"range=([^:\s]+):(\d+)-(\d+)", i)
    return F.when(h.rlike(r"range=[^:\s]+:\d+-\d+"), F.struct(part(1).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end")))


def cigar_length(cigar: str | Column, operations: str = "MDNP") -> Column:
    """Summed length of a CIGAR's operations."""
    found = F.regexp_extract_all(_col(cigar), F.lit(rf"(\d+)[{operations}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def base_n(number: str | Column, base: int, numerals: str) -> Column:
    """A non-negative integer in a base with the given numerals."""
    n = _col(number).cast("long")
    digits = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.struct(i.alias("i"), i.alias("j")))
    state = F.struct(n.alias("rest"), F.lit("").alias("out"))
    step = lambda acc, _: F.when(acc["rest"] > 0, F.struct(F.floor(acc["rest"] / base).alias("rest"), F.concat(F.substring(F.lit(numerals), (acc["rest"] % base + 1).cast("int"), F.lit(1)), acc["out"]).alias("out"))).otherwise(acc)
    text = F.aggregate(digits, state, step, lambda acc: acc["out"])
    return F.when(n == 0, F.lit(numerals[0])).otherwise(text)


def remove_accents(text: str | Column) -> Column:
    """Latin letters without their marks."""
    # Accented Latin-1 letters and their plain forms.
    return F.translate(_col(text), "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def highlight(text: str | Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """Occurrences of a string, in either case, between marks."""
    return F.regexp_replace(_col(text), "(?i)(\\Q" + query + "\\E)", before + "$1" + after)


def comma_list(values: str | Column) -> Column:
    """An array's elements as one comma-separated string."""
    return F.array_join(F.transform(_col(values), lambda x: x.cast("string")), ",")


def pack_place(chrom: str | Column, start: str | Column, end: str | Column) -> Column:
    """A chromosome's number, start and end in one binary of 9 bytes; NULL for haplotypes and unplaced pieces. X, Y and M are 23 to 25."""
    c = F.regexp_replace(_col(chrom), "^chr", "")
    number = F.when(c == "X", 23).when(c == "Y", 24).when(c == "M", 25).otherwise(c.try_cast("int"))
    hexed = F.concat(F.lpad(F.hex(number), 2, "0"), F.lpad(F.hex(_col(start).cast("long")), 8, "0"), F.lpad(F.hex(_col(end).cast("long")), 8, "0"))
    return F.when(number.isNotNull() & ~_col(chrom).rlike("_gl|hap"), F.unhex(hexed))


def unpack_place(packed: str | Column) -> Column:
    """(chrom, start, end) of pack_place's binary."""
    h = F.hex(_col(packed))
    number = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    name = F.when(number == 23, "X").when(number == 24, "Y").when(number == 25, "M").otherwise(number.cast("string"))
    return F.when(_col(packed).isNotNull(), F.struct(F.concat(F.lit("chr"), name).alias("chrom"), F.conv(F.substring(h, 3, 8), 16, 10).cast("long").alias("start"), F.conv(F.substring(h, 11, 8), 16, 10).cast("long").alias("end")))


def clean_string(text: str | Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(_col(text), r"[ \W_-]+", "")


def plain_ascii(text: str | Column) -> Column:
    """Typographic signs and accented letters as plain ones; what has none goes."""
    # Signs and their plain forms.
    signs = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " ", "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "×": "x", "µ": "u", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}
    out = remove_accents(text)
    for a, b in signs.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def browser_chrom(name: str | Column, style: str = "number") -> Column:
    """A database's chromosome name in a genome browser's spelling, by the assembly's style: number, roman, or kept as it is."""
    c = _col(name)
    if style == "kept":
        return c
    if style == "roman":
        return F.when(c.rlike("^[IVXLCDM]+$"), F.concat(F.lit("chr"), c)).when(c.isin("MtDNA", "Mito", "MT"), "chrM").otherwise(c)
    return F.when(c.rlike(r"^(\d+|[XYWZU])$"), F.concat(F.lit("chr"), c)).when(c.isin("MT", "Mt"), "chrM").otherwise(c)


def wrapped_upper(seq: str | Column, width: int = 60) -> Column:
    """A sequence without white space, in capitals, in lines of a width."""
    return wrap(F.upper(F.regexp_replace(_col(seq), r"\s+", "")), width)


#: Places of words in a piece of a sequence.
PIECE = 64


def pieces(seq: str | Column, k: int) -> Column:
    """A sequence as an array of pieces whose k-mers are its own: piece i has those that begin at PIECE * i and the places behind.

    A substring is found by counting from the start of its text, so k-mers of a long text take the square of its length, and those of pieces do not.
    """
    s = _col(seq)
    cut = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{PIECE + k - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    return F.when(F.length(s) < PIECE + k, F.array(s)).otherwise(cut)
