"""What the training-data operators share: reading tables, stored intermediates, labelled samples."""

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.session import scratch_path

#: Words are runs of anything but ASCII white space; `bytes.split()` cuts the same.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a given table; all of them where none is named."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or "*")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet below the shared folder and read it from there, so that lost executors repeat nothing before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of documents that no label is learnt from; a missing id counts as learnt from by nobody, too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, classes: list) -> DataFrame:
    """(doc_id, label, weight, text) of at most `per_class` labelled rows of each class that are not held out.

    Rows are picked by the order of a hash of their id; `weight` restores each class's share of all labelled documents.
    A document counts once: with the smallest of its labels and the first of its texts in order, so that runs agree.
    """
    usable = labels.select("doc_id", F.col(label).alias("label")).where(~held_out()).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in usable.where(F.col("label").isin(classes)).groupBy("label").count().collect()}
    total = sum(counts.values())
    parts = [
        usable.where(F.col("label") == F.lit(c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        .withColumn("weight", F.lit(counts.get(c, 0) / max(1, total) / min(per_class, max(1, counts.get(c, 0)))))
        for c in classes
    ]
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.union(part)
    # at most per_class * len(classes) ids are sent to the executors
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text"))


def process_memo(name: str, make):
    """A value that the Python worker keeps from task to task (a loaded tokenizer, say); nothing depends on its being kept."""
    kept = sys.modules.setdefault("_rolecall_process_memo", types.ModuleType("_rolecall_process_memo")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
