"""Cosine top-k of many query vectors over many item vectors.

The exact search brings items to the queries, each with the best that it has met (`nearest`); for few queries it bounds every
similarity by quantised vectors and takes exact products of what the bounds leave (`quantised`). For the approximate one, items are grouped into cells around centroids, and a query searches its nearest
cells only, in the same way; `graph` has an index that is kept.

Items lie by cell, a large cell over several tasks, and do not move; queries come to them in broadcast chunks with the cells
they visit. Pairs that the bounds rule out are never emitted. Of items with one and the same vector the k first are enough,
so copies make no more pairs than that. Vectors travel as stored (float32) and are compared in double.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.functions.text import computed_once
from rolecall.functions.vectors import cosine_distance
from rolecall.operators.nearest import nearest
from rolecall.operators.quantised import candidates, quantised, scored
from rolecall.session import stored

#: Queries and items of a cell that are compared at a time.
QUERY_BLOCK, ITEM_BLOCK = 512, 4096
CELL_ROWS = 65536
LEAST_CELLS = 8
TIE_DIGITS = 9
#: Where items are more than so many times the queries, queries come to the items; else items come to the queries.
FEW_QUERIES = 16


def _matrix(column) -> np.ndarray:
    """Rows of unit vectors from an Arrow list column or a pandas series of arrays."""
    if isinstance(column, pd.Series):
        rows = np.stack(column.to_numpy()).astype(np.float64)
    else:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows with a vector that has a direction."""
    non_zero = F.exists(F.col(vector), lambda x: x != 0)
    return vectors.select(id_col, F.col(vector).cast("array<float>").alias("v")).where(
        F.col(vector).isNotNull() & non_zero
    )


def centroids_of(items: DataFrame, cells: int, seed: int = 7, train_rows: int | None = None) -> np.ndarray:
    """Unit centroids, trained on all rows; `train_rows` trains on a sample of about so many. Every row is searched either way."""
    train = items if train_rows is None else items.sample(min(1.0, train_rows / max(1, items.count())), seed)
    features = train.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, maxIter=10, seed=seed, distanceMeasure="cosine").fit(features)
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _distances(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * unit @ centroids.T))


def _into_cells(items: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add (cell, gap): the nearest centroid and the distance to it."""

    @F.pandas_udf("cell int, gap double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        gaps = _distances(_matrix(v), centroids)
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "gap": gaps[np.arange(len(cell)), cell]})

    placed = items.withColumn("place", nearest("v"))
    return placed.select("*", F.col("place.cell").alias("cell"), F.col("place.gap").alias("gap")).drop("place")


def _nearest_cells(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    @F.pandas_udf("array<int>")
    def probe(v: pd.Series) -> pd.Series:
        order = np.argsort(_distances(_matrix(v), centroids), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype("int32")))

    return queries.withColumn("cells", probe("v"))


def few_of_each(items: DataFrame, item_id: str, k: int) -> DataFrame:
    """Of items (item_id, v) with the same vector the k first by id: no query has more of them among its k best."""
    place = F.row_number().over(Window.partitionBy("v").orderBy(item_id))
    return items.withColumn("place", place).where(F.col("place") <= k).drop("place")


def keep_best(found: DataFrame, query_id: str, item_id: str, k: int) -> DataFrame:
    """The k best rows per query; Spark drops the rest inside each partition before the shuffle."""
    order = Window.partitionBy(query_id).orderBy(F.round("similarity", TIE_DIGITS).desc(), F.col(item_id))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str = "resume_id",
    item_id: str = "job_id",
    vector: str = "embedding",
    cells: int | None = None,
    probes: int | None = None,
    train_rows: int | None = None,
) -> DataFrame:
    """(query_id, item_id, similarity, rank): exact, or approximate when `probes` limits the cells searched.

    Without `cells` there is one for every CELL_ROWS items, and LEAST_CELLS at least; the exact search has none.
    """
    asked, offered = usable(queries, query_id, vector), usable(items, item_id, vector)
    tasks = items.sparkSession.sparkContext.defaultParallelism
    if probes is None:
        if asked.count() * FEW_QUERIES >= offered.count():
            return keep_best(nearest(asked, offered, few_of_each(offered, item_id, k), query_id, item_id, k), query_id, item_id, k)
        codes = stored(quantised(few_of_each(offered, item_id, k).repartition(tasks, item_id), item_id), "codes")
        pairs = candidates(asked, codes, query_id, item_id, k)
        return keep_best(scored(pairs, asked, offered, query_id, item_id), query_id, item_id, k)
    if cells is None:
        n = max(1, offered.count())
        cells = min(n, max(math.ceil(n / CELL_ROWS), LEAST_CELLS))
    centroids = centroids_of(offered, cells, train_rows=train_rows)
    placed = _into_cells(few_of_each(offered, item_id, k), centroids).repartitionByRange(tasks, "cell", item_id)
    codes = stored(quantised(placed, item_id, "cell"), "codes")
    visits = _nearest_cells(asked, centroids, min(probes, len(centroids)))
    pairs = candidates(visits, codes, query_id, item_id, k, (ITEM_BLOCK, QUERY_BLOCK)).distinct()
    return keep_best(scored(pairs, asked, offered, query_id, item_id), query_id, item_id, k)


def one_query(items: DataFrame, query: DataFrame, k: int, item_id: str = "job_id", vector: str = "embedding") -> DataFrame:
    """Top-k for a single query vector (a one-row DataFrame): a scan with a bounded heap, no join."""
    beside = computed_once(items, [item_id, vector], [query.select(vector).scalar().alias("asked")])
    distance = cosine_distance(F.col(vector), F.col("asked"))
    ranked = beside.select(item_id, distance.alias("distance")).where(F.col("distance").isNotNull())
    return ranked.orderBy(F.round("distance", TIE_DIGITS), item_id).limit(k)
