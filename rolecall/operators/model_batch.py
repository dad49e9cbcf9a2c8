"""Calls to a caller-supplied model, one per row batch, with retries; failures become rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rolecall import fixed_values as fixed
from rolecall.session import materialise

#: Rows whose inputs and answers a task holds as Python values at a time.
HELD_ROWS = 64


def call_model(
    df: DataFrame,
    input_col: str,
    call: Callable,
    output: T.StructField,
    tries: int = fixed.MODEL_TRIES,
    wait_seconds: float = fixed.MODEL_WAIT_SECONDS,
    partitions: int | None = None,
) -> DataFrame:
    """Add `output` = call(value of `input_col`) and `error` (null when the call worked).

    A row whose call fails `tries` times keeps a null output and the last error; other rows go on.
    `partitions` is how many calls may run at once; small inputs would else be put into few tasks.
    """

    error = T.StructField("error", T.StringType())

    def one(value):
        for attempt in range(1, tries + 1):
            try:
                answer = call(value)
                return answer.tolist() if isinstance(answer, np.ndarray) else answer, None
            except Exception as problem:
                if attempt == tries:
                    return None, f"{type(problem).__name__}: {problem}"
                time.sleep(wait_seconds)

    kinds = [to_arrow_type(field.dataType) for field in (output, error)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # other columns stay as they came; inputs and answers are Python values a few at a time
            for first in range(0, batch.num_rows, HELD_ROWS):
                rows = batch.slice(first, HELD_ROWS)
                answers = [one(value) for value in rows.column(input_col).to_pylist()]
                added = [pa.array(list(part), kind, from_pandas=True) for part, kind in zip(zip(*answers), kinds)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], names=[*rows.schema.names, output.name, "error"])

    schema = T.StructType([*df.schema.fields, output, error])
    return (df.repartition(partitions) if partitions else df).mapInArrow(run, schema)


def split_good_failed(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and failed rows of one model run. The run is written out first: neither side, nor a lost
    executor, calls the model again."""
    stored = materialise(answers)
    return stored.where(F.col("error").isNull()).drop("error"), stored.where(F.col("error").isNotNull())


def embed_sentences(batches: DataFrame, call: Callable, **options) -> DataFrame:
    """Sentence batches (job_id, rows) -> the same with `vectors`, one per row, from one call per posting."""
    vectors = T.StructField("vectors", T.ArrayType(T.ArrayType(T.FloatType())))
    return call_model(batches, "rows", lambda rows: call([row["sentence"] for row in rows]), vectors, **options)
