"""Cosine top-k through quantised vectors: exact, or among the items of the cells that a query visits.

A unit vector is kept as a row of 16-bit codes, a scale, and the length of what rounding took away. By Cauchy-Schwarz no
similarity with a unit query is off by more than that length, so one pass over the codes (half of the vectors) bounds
every similarity from both sides. The k-th best lower bound of a query rules out all items whose upper bound is below it;
exact products are taken of the few that are left.

Queries come to the items in broadcast chunks of QUERY_BYTES and are not shuffled; the items' codes are read once a chunk and
never move. A task compares blocks of both in single precision with one bar a query, collects only what passes it, and hands
on, for each query, the items that its own k-th bound could not rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolecall.functions.vectors import cosine_similarity
from rolecall.session import stored

QUERY_BYTES = 16 << 20
#: Items and queries whose bounds a task holds at a time; candidates it holds before it hands them on.
ITEM_ROWS, QUERY_ROWS, HELD = 4096, 512, 1_000_000
#: Similarities this close count as equal where ranks are made; what single precision may take from a bar.
MARGIN, ROUNDED = 2e-9, 1e-6
#: Greatest code.
MOST = 32767


def unit_rows(column) -> np.ndarray:
    """Rows of unit vectors from an Arrow list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 1))
    rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, slack): |q . u - scale * (q . code)| <= slack for each unit vector q, float32 sums included."""
    scale = np.abs(unit).max(axis=1) / MOST
    codes = np.rint(unit / scale[:, None]).astype(np.int16)
    lost = np.linalg.norm(unit - scale[:, None] * codes, axis=1)
    return codes, scale, lost + unit.shape[1] * 2.0**-22


def quantised(items: DataFrame, item_id: str, *keep: str) -> DataFrame:
    """(item_id, code, scale, slack) of items (item_id, v), and the columns to `keep`."""
    names = [item_id, *keep, "code", "scale", "slack"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                codes, scale, slack = codes_of(unit_rows(batch.column("v")))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                kept = [batch.column(name) for name in (item_id, *keep)]
                yield pa.RecordBatch.from_arrays([*kept, packed.cast(pa.binary()), pa.array(scale), pa.array(slack)], names=names)

    kept = ", ".join(f"{name} {dict(items.dtypes)[name]}" for name in (item_id, *keep))
    return items.select(item_id, *keep, "v").mapInArrow(run, f"{kept}, code binary, scale double, slack double")


class Bounds:
    """Per query: the k-th best lower bound so far, its bar; the items that the bars leave."""

    def __init__(self, queries: np.ndarray, k: int, item_rows: int | None = None, query_rows: int | None = None):
        self.queries, self.k = queries.astype(np.float32, copy=False), k
        self.item_rows, self.query_rows = item_rows or ITEM_ROWS, query_rows or QUERY_ROWS
        self.most = max(HELD, 2 * k * len(queries))
        self.bar = np.full(len(queries), -np.inf)
        self.found: list[tuple] = []
        self.held = self.new = 0

    def offer(self, first: int, codes: np.ndarray, scale: np.ndarray, slack: np.ndarray, asked: np.ndarray | None = None) -> Iterator[None]:
        """Items from number `first` on; to the queries of the numbers `asked` only, if these are given. Halts where `left` is to be handed on."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        for lo in range(0, len(codes), self.item_rows):
            part = slice(lo, lo + self.item_rows)
            rows, worst = (codes[part] * scale[part, None].astype(np.float32)).T, slack[part].max()
            for q in range(0, len(asked), self.query_rows):
                own = asked[q : q + self.query_rows]
                near = self.queries[own] @ rows
                bar, n = self.bar[own], near.shape[1]
                if n >= self.k and np.isneginf(bar).any():
                    # the k-th best of this block, less the worst slack, is a lower bound of the k-th best
                    bar = np.maximum(bar, np.partition(near, n - self.k, axis=1)[:, n - self.k] - worst - ROUNDED)
                    self.bar[own] = bar
                hit = np.flatnonzero(near >= (bar - worst - MARGIN - ROUNDED).astype(np.float32)[:, None])
                query, item = np.divmod(hit, n)
                self.found.append((own[query].astype(np.int32), (item + first + lo).astype(np.int32), near.ravel()[hit], slack[part][item].astype(np.float32)))
                self.new += len(hit)
                if self.new > self.most:
                    self.prune()
                    if self.held > self.most:
                        yield
            if self.new > self.k * len(self.queries):
                self.prune()

    def prune(self) -> None:
        """Raise the bars to the k-th best lower bounds of what was found, and drop what they rule out."""
        query, item, near, slack = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32))
        low = near - slack
        order = np.lexsort((-low, query))
        counts = np.bincount(query, minlength=len(self.bar))
        enough = np.flatnonzero(counts >= self.k)
        kth = (np.cumsum(counts) - counts)[enough] + self.k - 1
        self.bar[enough] = np.maximum(self.bar[enough], low[order[kth]] - ROUNDED)
        stay = near + slack >= self.bar[query] - MARGIN - ROUNDED
        self.found, self.held, self.new = [(query[stay], item[stay], near[stay], slack[stay])], int(stay.sum()), 0

    def left(self) -> tuple[np.ndarray, ...]:
        """(query, item, similarity about, slack) of the items left; forgets them, but not the bars."""
        self.prune()
        out, self.found, self.held = self.found[0], [], 0
        return out


def chunks_of(asked: DataFrame, query_id: str) -> list[DataFrame]:
    """Queries (query_id, v) in chunks of about QUERY_BYTES, by hash."""
    first, n = asked.select("v").first(), asked.count()
    chunks = max(1, -(-n * 4 * len(first.v) // QUERY_BYTES)) if first else 1
    return [asked.where(F.pmod(F.xxhash64(query_id), F.lit(chunks)) == c) for c in range(chunks)] if chunks > 1 else [asked]


def _visitors(cells: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The queries that visit each cell."""
    lists = cells.combine_chunks()
    query, cell = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    return {c: query[cell == c] for c in np.unique(cell).tolist()}


def _candidates(codes: DataFrame, asked: DataFrame, query_id: str, item_id: str, k: int, blocks: tuple[int, int] | None) -> DataFrame:
    """(query_id, item_id, low, high) for the queries of one chunk and the items that no task could rule out."""
    chunk = asked.toArrow()  # QUERY_BYTES
    visitors = _visitors(chunk["cells"]) if "cells" in asked.columns else None
    shared = codes.sparkSession.sparkContext.broadcast((chunk[query_id].combine_chunks(), unit_rows(chunk["v"]).astype(np.float32), visitors))
    names = [query_id, item_id, "low", "high"]

    def run(batches):
        ids, queries, visitors = shared.value
        bounds, held, seen = Bounds(queries, k, *blocks or ()), [], 0

        def out():
            query, item, near, slack = bounds.left()
            items = pa.concat_arrays(held)
            for lo in range(0, len(query), HELD):
                part = slice(lo, lo + HELD)
                low, high = (pa.array(near[part].astype(np.float64) + sign * (slack[part].astype(np.float64) + ROUNDED)) for sign in (-1, 1))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[part])), items.take(pa.array(item[part])), low, high], names=names)

        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            rows = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int16).reshape(batch.num_rows, -1)
            scale, slack = batch.column("scale").to_numpy(), batch.column("slack").to_numpy()
            parts = [(slice(None), None)]
            if visitors is not None:
                cell = batch.column("cell").to_numpy()
                parts = [(np.flatnonzero(cell == c), visitors[c]) for c in np.unique(cell).tolist() if c in visitors]
            for own, asked_here in parts:
                held.append(batch.column(item_id) if visitors is None else batch.column(item_id).take(pa.array(own)))
                for _ in bounds.offer(seen, rows[own], scale[own], slack[own], asked_here):
                    yield from out()
                seen += len(held[-1])
        if held:
            yield from out()

    schema = f"{query_id} {dict(asked.dtypes)[query_id]}, {item_id} {dict(codes.dtypes)[item_id]}, low double, high double"
    return codes.mapInArrow(run, schema)


def candidates(asked: DataFrame, codes: DataFrame, query_id: str, item_id: str, k: int, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, item_id): what may be among the k best of each query, ties included. `asked` is (query_id, v), `codes` from `quantised`.

    If `asked` has `cells` (an array) and `codes` have `cell`, a query meets the items of its cells only. `blocks` are other
    numbers of items and queries than ITEM_ROWS and QUERY_ROWS.
    """
    found = None
    for own in chunks_of(asked, query_id):
        new = stored(_candidates(codes, own, query_id, item_id, k, blocks), "candidates")
        found = new if found is None else found.unionByName(new)
    # the k-th best lower bound over all tasks; Spark keeps k rows of a query in each task before the shuffle
    best = found.select(query_id, "low", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("low"))).alias("place")).where(F.col("place") <= k)
    bar = best.groupBy(query_id).agg(F.when(F.count("*") == k, F.min("low")).otherwise(F.lit(-2.0)).alias("bar"))
    return found.join(bar, query_id).where(F.col("high") >= F.col("bar") - MARGIN).select(query_id, item_id)


def scored(pairs: DataFrame, asked: DataFrame, offered: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """(query_id, item_id, similarity) of pairs, from the whole vectors."""
    both = pairs.join(offered.select(item_id, F.col("v").alias("offered")), item_id).join(asked.select(query_id, F.col("v").alias("asked")), query_id)
    return both.select(query_id, item_id, cosine_similarity(F.col("asked"), F.col("offered")).alias("similarity"))
