"""Ingest by state: the latest row of each link, and links that have not been seen for a day.

Two streams over the same landed rows, both kept by Spark's state store and without Python. One aggregates by link: the
row of the largest `seq`, the upload date of the smallest, all alternate names; each micro-batch hands on a row for each
link that it touched, whatever came before in whatever order, so nothing is deduplicated over a whole batch again. The
other makes session windows of a day's gap by link: a session that the watermark has passed is a posting that went stale,
and a posting once switched off stays off. Their batches are merged into store versions, one stream after the other.
State lies on the executors' disks, so their memory does not grow with the links that are known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecall import fixed_values as fixed
from rolecall.plans.ingest import UPDATED, accepted
from rolecall.plans.store import Store
from rolecall.sources.tables import (
    bucket_count,
    bucket_of,
    latest_version,
    next_version,
    publish,
    read_store,
    read_table,
    table_paths,
    taken_batch,
    write_table,
)
from rolecall.streaming.incremental import LANDED, merge_batch

# A partition's state is a RocksDB, opened for as long as a task works on it; all of an executor share one bounded cache.
# What is set here holds for new streams; one that was started with another provider goes on with that.
_STATE = "spark.sql.streaming.stateStore"
STATE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.unloadOnCommit": "true",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "128",
    f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false",
}

SEEN = T.StructType([*LANDED.fields, T.StructField("seen_at", T.TimestampType())])


def landed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of staged postings with the time they were seen at."""
    reader = spark.readStream.schema(SEEN)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def latest_rows(rows: DataFrame) -> DataFrame:
    """The state of each link: its latest row, the upload date of its first one, and all its alternate names."""
    rest = [f.name for f in LANDED.fields if f.name not in ("link", "seq", "uploaded_date", "alternate_names")]
    held = accepted(rows).groupBy("link").agg(
        F.max_by(F.struct(*rest), "seq").alias("latest"), F.min_by("uploaded_date", "seq").alias("uploaded_date"),
        F.array_distinct(F.flatten(F.collect_set("alternate_names"))).alias("alternate_names"), F.max("seq").alias("seq"),
    )
    return held.select("link", *[F.col(f"latest.{c}").alias(c) for c in rest], "uploaded_date", "alternate_names", "seq")


def gone_stale(rows: DataFrame, days: int = fixed.STALE_AFTER_DAYS, late: str = "0 seconds") -> DataFrame:
    """(link, off_at) of links that were not seen for `days`; rows may come `late` by so much."""
    sessions = accepted(rows).withWatermark("seen_at", late).groupBy(F.session_window("seen_at", f"{days} days"), "link").agg(F.count("*").alias("n"))
    return sessions.select("link", F.col("session_window.end").alias("off_at"))


def switch_off(batch: DataFrame, root: str, stream: str, number: int) -> None:
    """The version after the latest, in which the postings of these links are off; their buckets alone are read and written. Without links there is none."""
    spark = batch.sparkSession
    if taken_batch(spark, root, stream, number):
        return
    before = latest_version(spark, root)
    version, paths, buckets = next_version(before), table_paths(spark, root, before), bucket_count(spark, root)
    # written once: each use of a batch reads and writes its state again
    batch.select("link").distinct().write.mode("overwrite").parquet(f"{root}/batch/stale")
    links = spark.read.schema("link string").parquet(f"{root}/batch/stale").withColumn("off", F.lit(True))
    if links.isEmpty():
        return
    touched = {r[0] for r in links.select(bucket_of(F.col("link"), buckets)).distinct().collect()}
    jobs = read_table(spark, root, "job_info", {b: p for b, p in paths.get("job_info", {}).items() if b in touched})
    off = jobs.join(links, "link", "left").withColumn("is_active", F.when(F.col("off"), F.lit(False)).otherwise(F.col("is_active")))
    paths["job_info"] = paths.get("job_info", {}) | write_table(off.select(jobs.columns), root, "job_info", version, buckets)
    publish(spark, root, version, paths, buckets, stream, number)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state by `STATE`; the session's own settings are as before afterwards."""
    before = {key: spark.conf.get(key, None) for key in STATE}
    try:
        for key, value in STATE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _run(rows: DataFrame, mode: str, progress: str, merge: Callable[[DataFrame, str, int], None]) -> None:
    """Take what is there; each micro-batch goes to `merge` with the stream's lasting id and its number."""
    started, known, adaptive = Event(), {}, "spark.sql.adaptive.enabled"
    usual = rows.sparkSession.conf.get(adaptive)

    def take(batch: DataFrame, number: int) -> None:
        started.wait()
        # a stream with state is planned without adaptive execution; the merge is not, so that large buckets are split
        session = batch.sparkSession.conf
        planned = session.get(adaptive)
        session.set(adaptive, usual)
        try:
            merge(batch, known["id"], number)
        finally:
            session.set(adaptive, planned)

    with state_on_disk(rows.sparkSession):
        query = rows.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", progress).trigger(availableNow=True).start()
    known["id"] = str(query.id)
    started.set()
    query.awaitTermination()


def ingest_available(spark: SparkSession, landing: str, store_root: str, progress: str, now: Column, files_per_batch: int | None = None) -> Store:
    """Merge what has landed since the last run, switch off what went stale, and return the store after it.

    The store folder must hold a version before the first run; `progress` keeps both streams' records and state.
    """
    rows = landed(spark, landing, files_per_batch)
    _run(latest_rows(rows), "update", f"{progress}/latest", lambda batch, stream, number: merge_batch(batch, store_root, now, stream, number, (*UPDATED, "uploaded_date")))
    _run(gone_stale(rows), "append", f"{progress}/stale", lambda batch, stream, number: switch_off(batch, store_root, stream, number))
    return read_store(spark, store_root)
