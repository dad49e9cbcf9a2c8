"""A corpus from raw documents to packed sequences: each stage is written as Parquet and read again as the next one's docs."""

from pyspark.sql import DataFrame, SparkSession

from rolecall.llm import mixing, ordinal, packing, simhash, toxicity
from rolecall.llm.common import stored, table
from rolecall.llm.tokens import default_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects (a score of 0.5 or more)."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def quality_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those documents whose probability of a good grade reaches one half."""
    return ordinal.selected(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of documents that SimHash links (three-word shingles, at most three bits) connect."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs, default_path())


STAGES = [
    ("toxicity", toxic_out),
    ("quality classifier", quality_in),
    ("near-dedup", near_copies_out),
    ("mixing sources", mixed),
    ("packing", packed),
]
#: Trained models and byte-pair encoding have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
