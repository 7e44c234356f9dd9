"""The document pipeline: quality rules, near-dedup, substring dedup, source mixing, then token ids of what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. The stages' own parameters stand in their functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.bpe import bpe_digests
from tidewater.llm.common import prepare, staged
from tidewater.llm.mixing import take_mix
from tidewater.llm.quality import quality_filter
from tidewater.llm.simhash import similar_dedup
from tidewater.llm.suffix_array import substring_dedup

#: Bytes of a string whose later copies are cut out; below the 50 words of a passage worth catching.
REPEAT_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    prepare(spark)
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    prepare(spark)
    return similar_dedup(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long strings are cut out of the texts."""
    prepare(spark)
    return substring_dedup(docs, REPEAT_BYTES)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    prepare(spark)
    return take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoded text, as digests."""
    import public_tokenizers

    prepare(spark)
    return bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", substring), ("source mixing", mixing), ("BPE encoding", encoding)]
#: Fingerprints and vocabularies are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
