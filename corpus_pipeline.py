"""The corpus pipeline: toxic documents go, boilerplate lines go, one of each near-duplicate class stays,
contaminated documents go, and what is left is mixed to target weights.

Each stage works on the documents its predecessor kept; all but the last return the columns of documents.

Near-dedup links by op4's fingerprints (``simhash_dedup``: SimHash, three bits) and, as texts of a similarity of 0.8 differ in about ten of
64 bits, by five-word shingles at that similarity too (``near_copies``): a class is a connected part of both kinds of links.

Defined cases: null and empty texts are clean, have no lines and no words, aren't contaminated and are one near-duplicate
class, of which the row of least doc_id stays (nulls last; of equal rows any, of rows that differ elsewhere the first as
JSON); they are mixed with 0 words. A null doc_id is an id like any other, a null source a source of its own. Repeated
rows are treated alike by all stages but near-dedup, which keeps one. Empty tables give no rows. Other columns
pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from lumenfold.llm.sparkkit import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By shingles alone; the pipeline's stage is drop_copies()."""
    return near_copies.keep_one(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By op4's fingerprints and by shingles."""
    return near_copies.keep_one(docs, simhash=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: doc_id, source, size, target, taken and the first training position."""
    mixed = mixing.mix(docs)
    first = F.when(F.size("passes") > 0, F.round(F.element_at(F.col("passes.position"), 1), 6))
    out = mixed.select("doc_id", "source", "size", "source_size", "target", mixing.taken().alias("taken"), first.alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The toxicity and near-dedup stages have no SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
