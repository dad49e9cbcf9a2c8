"""Mean vectors kept current: a mergeable state (sum, count) per posting instead of a new mean over all its sentences.

A batch that changes some sentences takes their old vectors away and adds the new ones. Only keys that the batch names meet
the state; the sentences that stay are not read. Sums run in double, where adding and taking away a float32 vector leaves
an error far below that of the stored vector.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ["total", "n"]


def _signed(vectors: DataFrame, key: str, vector: str, sign: int) -> DataFrame:
    present = vectors.where(F.col(vector).isNotNull())
    total = F.transform(F.col(vector), lambda x: x.cast("double") * sign)
    return present.select(key, total.alias("total"), F.lit(sign).cast("long").alias("n"))


def _added_up(parts: DataFrame, key: str) -> DataFrame:
    """One row a key; sums are partial inside each task before they move."""
    total = Summarizer.sum(F.col("v"))
    summed = parts.withColumn("v", array_to_vector("total")).groupBy(key).agg(total.alias("v"), F.sum("n").alias("n"))
    return summed.select(key, vector_to_array("v").alias("total"), "n")


def state_of(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, total, n) of rows with a vector."""
    return _added_up(_signed(vectors, key, vector, 1), key)


def changes(removed: DataFrame, added: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, total, n) of what a batch takes away and adds."""
    return _added_up(_signed(removed, key, vector, -1).union(_signed(added, key, vector, 1)), key)


def updated(state: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """The state after a change; keys without vectors leave it. Rows of other keys pass as they are."""
    touched = state.join(change.select(key), key, "left_semi")
    met = _added_up(touched.select(key, *STATE).union(change.select(key, *STATE)), key).where("n > 0")
    return state.join(change.select(key), key, "left_anti").select(key, *STATE).union(met)


def means(state: DataFrame, key: str, out: str = "embedding") -> DataFrame:
    n: Column = F.col("n")
    return state.select(key, F.transform("total", lambda x: x / n).alias(out))
