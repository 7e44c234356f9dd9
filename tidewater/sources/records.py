"""Flat files of multi-line records as tables: ontologies, sequence entries, tagged blocks, sparse records.

Records are split by Spark's own line separator option, so a record is one row wherever its file is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_rank


def _all(lines: str, prefix: str) -> Column:
    """Values of the lines that begin with a prefix."""
    return F.transform(F.filter(lines, lambda x: x.startswith(prefix)), lambda x: F.trim(F.substr(x, F.lit(len(prefix) + 1))))


def _one(lines: str, prefix: str) -> Column:
    found = _all(lines, prefix)
    return F.when(F.size(found) > 0, found[0])


def read_obo(spark: SparkSession, path: str, namespace: str | None = None, keep_obsolete: bool = False) -> DataFrame:
    """(term, name, namespace, parents, synonyms, obsolete) of an ontology's terms."""
    blocks = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").startswith("Term]")).select(F.split("value", "\r?\n").alias("l"))
    strip = lambda xs: F.transform(xs, lambda x: F.trim(F.substring_index(x, "!", 1)))
    quoted = F.transform(_all("l", "synonym:"), lambda x: F.regexp_extract(x, '"([^"]*)"', 1))
    out = blocks.select(_one("l", "id:").alias("term"), _one("l", "name:").alias("name"), _one("l", "namespace:").alias("namespace"), strip(_all("l", "is_a:")).alias("parents"), quoted.alias("synonyms"), F.coalesce(_one("l", "is_obsolete:") == "true", F.lit(False)).alias("obsolete"))
    out = out if keep_obsolete else out.where(~F.col("obsolete"))
    return out if namespace is None else out.where(F.col("namespace") == namespace)


def obo_edges(terms: DataFrame) -> DataFrame:
    """(child, parent)."""
    return terms.select(F.col("term").alias("child"), F.explode("parents").alias("parent"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(accession, definition, organism, taxon, length, references array<struct>, seq) of an entry file."""
    entries = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", r"\r", "").alias("v")).where(F.col("v").rlike(r"(?m)^LOCUS"))
    get = lambda p: F.regexp_replace(F.regexp_extract("v", p, 1), r"\s+", " ")
    parts = F.slice(F.split(F.regexp_extract("v", r"(?s)(\nREFERENCE.*?)(?=\n(?:COMMENT|FEATURES|ORIGIN)|\z)", 1), "\nREFERENCE"), 2, 10_000)
    field = lambda x, name: F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?s)\n\s+{name}\s+(.*?)(?=\n\s{{2,3}}[A-Z]|\z)", 1), r"\s+", " "))
    refs = F.transform(parts, lambda x: F.struct(field(x, "AUTHORS").alias("authors"), field(x, "TITLE").alias("title"), field(x, "JOURNAL").alias("journal"), field(x, "PUBMED").alias("pubmed")))
    seq = F.upper(F.regexp_replace(F.regexp_extract("v", r"(?s)\nORIGIN[^\n]*\n(.*)", 1), r"[^A-Za-z]", ""))
    return entries.select(get(r"(?m)^ACCESSION\s+(\S+)").alias("accession"), F.trim(get(r"(?s)\nDEFINITION\s+(.*?)(?=\n\S)")).alias("definition"), get(r"(?m)^\s+ORGANISM\s+(.*)$").alias("organism"), get(r'db_xref="taxon:(\d+)"').try_cast("int").alias("taxon"), get(r"(?m)^LOCUS\s+\S+\s+(\d+)").try_cast("int").alias("length"), refs.alias("references"), seq.alias("seq"))


def reference_tables(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref_id, authors, title, journal, pubmed) of the distinct references in a fixed order, and (accession, ref_id) links."""
    cited = entries.select("accession", F.explode("references").alias("r")).select("accession", "r.*")
    names = ["authors", "title", "journal", "pubmed"]
    refs = global_rank(cited.select(*names).distinct(), [F.col(c) for c in names], "ref_id")
    return refs.select("ref_id", *names), cited.join(refs, names).select("accession", "ref_id").distinct()


def map_columns(df: DataFrame, id_col: str, fields: str, most: int = 2_000, missing: str | None = None) -> DataFrame:
    """Sparse map records as a column a key, keys sorted; more than `most` keys are an error, since each is a column."""
    keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(fields)).alias("k")).distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"more than {most} distinct keys")
    return df.select(id_col, *[F.coalesce(F.element_at(fields, F.lit(k)), F.lit(missing)).alias(k) for k in keys])


def tagged_records(spark: SparkSession, path: str, start: str, tags: list[str], sep: str = "\t") -> DataFrame:
    """One row a record of `tag<sep>value` lines, a new one at each start tag; every tag is an array of its values."""
    blocks = spark.read.option("lineSep", f"\n{start}{sep}").text(path).select(F.split("value", "\r?\n").alias("l"))
    head = F.regexp_replace(F.col("l")[0], f"^{start}{sep}", "")
    return blocks.where(~F.col("l")[0].startswith("#")).select(F.array(head).alias(start), *[_all("l", t + sep).alias(t) for t in tags])


def records_matching(records: DataFrame, tag: str, pattern: str) -> DataFrame:
    """tagged_records' rows where a value of the tag matches."""
    return records.where(F.exists(tag, lambda x: x.rlike(pattern)))


def taxon_sequences(entries: DataFrame, most_seqs: int, most_length: int) -> DataFrame:
    """(accession, taxon, seq) of read_genbank's entries without whole genomes, long ones, and articles that cite most_seqs entries or more."""
    own = entries.where(~F.lower("definition").contains("complete genome") & (F.length("seq") <= most_length))
    cited = own.select("accession", F.explode("references").alias("r")).select("accession", F.col("r.pubmed").alias("pubmed")).where("pubmed <> ''").distinct()
    large = cited.groupBy("pubmed").agg(F.count("*").alias("n")).where(F.col("n") >= most_seqs)
    return own.join(cited.join(large, "pubmed", "left_semi").select("accession").distinct(), "accession", "left_anti").select("accession", "taxon", "seq")
