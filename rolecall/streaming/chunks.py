"""Streamed answers: chunks put together by state until the end marker has come and nothing is missing.

Chunks of an answer may come late, out of order and more than once. State holds an answer's chunks until it is whole; then
it gives one row and keeps a mark that it is done, until the watermark has passed and no repeated chunk can come. An answer
that stays without an end for as long is given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rolecall.session import scratch_path

STATE = "seqs array<long>, texts array<string>, end long, done boolean"
#: How much later than others a chunk may come.
LATE_MS = 3_600_000


def assembled(chunks: DataFrame, key: str, late_ms: int = LATE_MS) -> DataFrame:
    """(key, text, chunks) of each answer of a stream (key, seq long, text string, is_end boolean, at timestamp), once, when it is whole.

    Chunks are numbered from 0; the one that ends an answer adds its text as well, if it has any.
    """

    def put_together(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, texts, end, done = state.get if state.exists else ([], [], None, False)
        held, last = dict(zip(seqs, texts)), state.getCurrentWatermarkMs()
        for part in parts:
            last = max(last, int(part["at"].max().timestamp() * 1000))
            if done:
                continue
            for seq, text, is_end in zip(part["seq"], part["text"], part["is_end"]):
                held.setdefault(int(seq), text if isinstance(text, str) else "")
                if is_end:
                    end = int(seq)
        if not done and end is not None and all(k in held for k in range(end + 1)):
            yield pd.DataFrame({key: [name[0]], "text": ["".join(held[k] for k in range(end + 1))], "chunks": [end + 1]})
            held, done = {}, True
        state.update((list(held), list(held.values()), end, done))
        state.setTimeoutTimestamp(last + late_ms + 1)

    kind = dict(chunks.dtypes)[key]
    rows = chunks.select(key, "seq", "text", "is_end", "at").withWatermark("at", f"{late_ms} milliseconds").groupBy(key)
    return rows.applyInPandasWithState(put_together, f"{key} {kind}, text string, chunks long", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def assemble_available(spark: SparkSession, landing: str, schema: str, key: str, out: str, progress: str, files_per_batch: int = 1) -> DataFrame:
    """Put together what has landed as JSON files since the last run; returns all answers that are whole by now."""
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(landing)
    whole = assembled(chunks, key)
    query = whole.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(whole.schema).parquet(out)


def land(chunks: DataFrame, files: int, shuffle_seed: int) -> str:
    """Write chunks as so many JSON files, dealt out by a hash; returns the folder."""
    folder = scratch_path(chunks.sparkSession, "chunks")
    chunks.repartition(files, F.xxhash64(F.lit(shuffle_seed), *chunks.columns)).write.json(folder)
    return folder
