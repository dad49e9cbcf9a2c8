"""The whole run over a stored version: clear vectors, save postings, tag, switch off, embed. Each step is a version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from rolecall.plans import ingest
from rolecall.plans.store import Store
from rolecall.sources.tables import next_store, read_store


def changed(before: Store, after: Store) -> dict[str, DataFrame]:
    """The tables of `after` that are not those of `before`."""
    old = before.tables()
    return {name: df for name, df in after.tables().items() if df is not old[name]}


def run_batch(spark: SparkSession, root: str, staged: DataFrame, now: Column, call: Callable, **options) -> tuple[Store, DataFrame]:
    """Run all steps on the latest version of the store in `root`; returns the store after them and the postings that failed to embed.

    `call` takes the sentences of one posting and returns their vectors. A run that is repeated changes times only.
    """

    def step(work: Callable[[Store], Store]) -> Store:
        before = read_store(spark, root)
        next_store(spark, root, changed(before, work(before)))
        return read_store(spark, root)

    failed = []

    def embed(store: Store) -> Store:
        after, lost = ingest.embed_store(store, call, **options)
        failed.append(lost)
        return after

    step(ingest.clear_stale_vectors)
    step(lambda store: ingest.apply_batch(store, staged, now))
    step(lambda store: ingest.tag_and_deactivate(store, now))
    return step(embed), failed[0]
