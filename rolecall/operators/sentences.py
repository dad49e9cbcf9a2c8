"""Sentence rows, their batches per posting, vectors and ordered texts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.vectors import mean_vector
from rolecall.operators.merge import replace_children, upsert

KEY = ["job_id", "type", "sentence_index"]


def numbered(items: Column, kind: str) -> Column:
    """Array of (type, sentence_index, sentence), counted from 0."""
    return F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda sentence, i: F.struct(
            F.lit(kind).alias("type"), i.alias("sentence_index"), sentence.alias("sentence")
        ),
    )


def posting_sentences(postings: DataFrame) -> DataFrame:
    """Required, preferred and title sentences of each posting (job_id, job_title and two lists)."""
    rows = F.concat(
        numbered(F.col("qualifications"), "required"),
        numbered(F.col("preferred_qualifications"), "preferred"),
        numbered(F.array("job_title"), "title"),
    )
    return postings.select("job_id", F.inline(rows))


def sentences_to_embed(sentences: DataFrame, job_info: DataFrame) -> DataFrame:
    """Sentences of active postings."""
    live = job_info.where("is_active").select(F.col("id").alias("job_id"))
    return sentences.join(live, "job_id", "left_semi")


def rows_per_job(sentences: DataFrame) -> DataFrame:
    """One batch per posting: its sentence rows in (type, index) order."""
    rows = F.array_sort(F.collect_list(F.struct("type", "sentence_index", "sentence")))
    return sentences.groupBy("job_id").agg(rows.alias("rows"))


def mean_vectors(vectors: DataFrame, key: str | list[str] | None, column: str = "embedding") -> DataFrame:
    """Element-wise mean per key, partially summed before the shuffle; missing vectors do not count."""
    present = vectors.where(F.col(column).isNotNull()).withColumn("v", array_to_vector(column))
    keys = [] if key is None else [key] if isinstance(key, str) else key
    mean = present.groupBy(*keys).agg(Summarizer.mean(F.col("v")).alias("m"))
    return mean.select(*keys, vector_to_array("m").alias(column))


def vectors_from_batches(batches: DataFrame) -> DataFrame:
    """Model batches (job_id, rows, vectors) back to one row per sentence, its vector beside it."""
    pairs = F.arrays_zip(F.col("rows"), F.col("vectors"))
    return batches.select("job_id", F.explode(pairs).alias("pair")).select(
        "job_id", "pair.rows.*", F.col("pair.vectors").alias("embedding")
    )


def store_batches(sentences: DataFrame, job_embeddings: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store the vectors of whole postings: sentence rows with their vectors, and the mean per posting.

    A batch holds all sentences of its posting, so its rows replace the old ones as they are, and the
    mean is taken inside the row: only the ids of the embedded postings take part in a join.
    """
    rows = replace_children(sentences, vectors_from_batches(batches).select(*sentences.columns), "job_id")
    means = batches.select("job_id", mean_vector(F.col("vectors")).cast("array<float>").alias("embedding"))
    return rows, upsert(job_embeddings, means, ["job_id"], ["embedding"])


def update_vectors(sentences: DataFrame, embedded: DataFrame) -> DataFrame:
    """Set the vectors of single sentences by (job, type, index); nothing is added.

    The key is not unique: all rows that share it take the one vector.
    """
    fresh = embedded.groupBy(*KEY).agg(F.first("embedding", ignorenulls=True).alias("new_embedding"))
    kind = sentences.schema["embedding"].dataType
    changed = F.coalesce("new_embedding", "embedding").cast(kind)
    return sentences.join(fresh, KEY, "left").withColumn("embedding", changed).select(*sentences.columns)


def upsert_means(job_embeddings: DataFrame, embedded: DataFrame) -> DataFrame:
    """Insert or update the mean vector of every posting among single sentence vectors."""
    kind = job_embeddings.schema["embedding"].dataType
    means = mean_vectors(embedded, "job_id").select("job_id", F.col("embedding").cast(kind).alias("embedding"))
    return upsert(job_embeddings, means, ["job_id"], ["embedding"])


def ordered_text(parts: DataFrame, key: str, seq: str, text: str, separator: str, out: str) -> DataFrame:
    """Join the pieces of each text in order; a missing piece adds nothing but keeps its place."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.coalesce(text, F.lit("")).alias("t"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), separator).alias(out))
