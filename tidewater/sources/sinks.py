"""Writers: delimited files, a file per key or chunk, FASTA, feature formats. Each writes where Spark can write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import wrap
from ..operators.ranking import global_rank


def write_tsv(df: DataFrame, path: str, mode: str = "append", header: bool = True, sep: str = "\t", missing: str = "") -> None:
    df.write.mode(mode).option("header", header).option("sep", sep).option("nullValue", missing).option("emptyValue", "").csv(path)


def write_by_value(df: DataFrame, path: str, column: str, sep: str = "\t") -> None:
    """A folder for each value of a column, which leaves the rows."""
    df.write.mode("overwrite").partitionBy(column).option("header", True).option("sep", sep).csv(path)


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds `chunk`: rows in order, `size` to a chunk, numbered without a single-task window."""
    return global_rank(df, [F.col(c) for c in order], "row number").withColumn("chunk", F.floor((F.col("row number") - 1) / size).cast("long")).drop("row number")


def write_chunks(df: DataFrame, path: str, order: list[str], size: int) -> None:
    write_by_value(chunks(df, order, size), path, "chunk")


def fasta_text(df: DataFrame, id_col: str = "id", seq: str = "seq", width: int = 80) -> DataFrame:
    """(value): a FASTA record a row; rows without sequence go."""
    return df.where(F.length(seq) > 0).select(F.concat(F.lit(">"), id_col, F.lit("\n"), wrap(seq, width)).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    fasta_text(df, width=width).write.mode("overwrite").text(path)


def distribute_fasta(df: DataFrame, field: int, sep: str = "|") -> DataFrame:
    """(id, seq, filename): one field of the id becomes the file name and leaves the id."""
    parts = F.split("id", "\\Q" + sep + "\\E")
    rest = F.concat(F.slice(parts, 1, field), F.slice(parts, field + 2, 1000))
    return df.select(F.array_join(rest, sep).alias("id"), "seq", F.get(parts, F.lit(field)).alias("filename"))


def bed_defaults(df: DataFrame, fields: dict[str, str], one_based: bool = False) -> DataFrame:
    """Named columns as bed12 with defaults: end = start + 1, score 0, strand ., one block."""
    get = lambda name, d: F.col(fields[name]) if name in fields else d
    start = F.col(fields["start"]).cast("long") - int(one_based)
    end = get("end", start + 1).cast("long")
    return df.select(get("chrom", F.lit("")).alias("chrom"), start.alias("start"), end.alias("end"), get("name", F.lit("")).alias("name"), get("score", F.lit(0)).cast("int").alias("score"), get("strand", F.lit(".")).alias("strand"), start.alias("thickStart"), end.alias("thickEnd"), F.lit("0,0,0").alias("itemRgb"), F.lit(1).alias("blockCount"), (end - start).cast("string").alias("blockSizes"), F.lit("0").alias("blockStarts"))


def bed_checks(df: DataFrame) -> DataFrame:
    """Adds `reason`: the first check that a bed row fails, NULL for good rows."""
    reason = F.when(F.col("chrom").isNull() | (F.col("chrom") == ""), "no chrom").when(F.col("start").isNull() | F.col("end").isNull(), "no place").when(F.col("start") < 0, "negative start").when(F.col("start") >= F.col("end"), "no length").when(~F.col("strand").isin("+", "-", "."), "bad strand")
    return df.withColumn("reason", reason)


def row_digest(df: DataFrame, *columns: str) -> DataFrame:
    """Adds an md5 over columns, for change detection."""
    return df.withColumn("digest", F.md5(F.concat_ws("\t", *columns)))


def bedgraph_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("score").cast("string")).alias("value"))


def arff_text(df: DataFrame, name: str, nominal: dict[str, list[str]] | None = None) -> tuple[str, DataFrame]:
    """Header text and the rows of an ARFF table; numeric unless named nominal, ? for NULL."""
    nominal = nominal or {}
    head = [f"@relation {name}"] + [f"@attribute {c} " + ("{" + ",".join(nominal[c]) + "}" if c in nominal else "numeric") for c in df.columns] + ["@data"]
    return "\n".join(head), df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns]).alias("value"))


def html_rows(df: DataFrame) -> DataFrame:
    """(value): table rows with markup characters escaped."""
    cell = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return df.select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[cell(c) for c in df.columns]), F.lit("</td></tr>")).alias("value"))


def xml_text(df: DataFrame, tag: str) -> DataFrame:
    """(value): each row as an XML element, its columns as elements inside, on one line."""
    text = F.to_xml(F.struct(*df.columns), {"rowTag": tag})
    return df.select(F.trim(F.regexp_replace(text, r"\s*\n\s*", " ")).alias("value"))
