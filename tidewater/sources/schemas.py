"""Schemas of the line formats, and the rules by which headers become column names."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Column names and types of the named file types.
FILE_TYPES = {
    "bed3": "chrom string, start long, end long",
    "bed4": "chrom string, start long, end long, name string",
    "bed6": "chrom string, start long, end long, name string, score int, strand string",
    "bed12": "chrom string, start long, end long, name string, score int, strand string, thickStart long, thickEnd long, itemRgb string, blockCount int, blockSizes string, blockStarts string",
    "psl": "matches int, misMatches int, repMatches int, nCount int, qNumInsert int, qBaseInsert int, tNumInsert int, tBaseInsert int, strand string, qName string, qSize int, qStart int, qEnd int, tName string, tSize int, tStart int, tEnd int, blockCount int, blockSizes string, qStarts string, tStarts string",
    "blastm8": "qName string, tName string, percentIdentity double, alnLength int, misMatches int, gapOpenings int, qStart int, qEnd int, tStart int, tEnd int, eVal double, alnScore double",
    "blastConvert": "pmcId int, genomeId int, seqId int, chrom string, tStart int, tEnd int, score double",
    "sam": "qName string, flag int, rName string, pos int, mapq int, cigar string, rNext string, pNext int, tLen int, seq string, qual string",
    "gff": "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string",
    "vcf": "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string",
    "keyvalue": "key string, value string",
}


def schema_of(file_type: str) -> T.StructType:
    """A registered type, or `n` columns col0 .. for numColumns:n."""
    if file_type.startswith("numColumns:"):
        return T.StructType([T.StructField(f"col{i}", T.StringType()) for i in range(int(file_type.split(":")[1]))])
    return T.StructType.fromDDL(FILE_TYPES[file_type])


def clean_headers(names: list[str], pattern: str = "[^a-zA-Z0-9_]") -> list[str]:
    """Header names as column names: other characters become _, empty ones col<i>, repeated ones get _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = re.sub(pattern, "_", name.lstrip("#") if i == 0 else name) or f"col{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out
