"""Join texts with the patterns they contain, exactly, without comparing all pairs.

An equi-join on hashed windows. Every pattern is represented by one window, its first `width` bytes: the whole pattern up to
EXACT bytes, two thirds of it at least above. Texts are read once: numpy hashes the window of each width at every position of
a slice of text, each width from two windows of the power of two below it, and a bitmap of the patterns' windows (at most
BITS, whatever their number) leaves the few that a pattern may start with. These go by hash to the patterns, and the whole
text decides. A text hands on a window once, however often it holds it.

Texts that lie in fewer files than there are cores are dealt out by id before they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.session import stored

#: Up to so many bytes a pattern's window is the pattern itself.
EXACT = 16
#: Bytes of text whose windows are hashed at a time; a longer text is read in pieces that overlap.
SLICE_BYTES = 32 << 10
#: Bits of the bitmap for each pattern, and all of them at least and at most (16 MB).
BITS_EACH, LEAST_BITS, BITS = 32, 1 << 16, 1 << 27
_LEFT, _RIGHT, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9
#: A window may be a pattern's if the places that these give its hash are all marked.
_PLACES = (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _width_of(length: Column) -> Column:
    """The pattern's length up to EXACT, else the greatest 2^c or 3 * 2^(c-1) that is not above it."""
    power = F.pow(F.lit(2.0), F.length(F.bin(length)) - 1).cast("int")
    wide = F.when(length * 2 >= power * 3, (power * 1.5).cast("int")).otherwise(power)
    return F.when(length <= EXACT, length).otherwise(wide).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _RIGHT
    x ^= x >> np.uint64(32)
    return x


def _window_hashes(data: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of the windows of that width at each position) in ascending order of `widths`."""
    power, half = 1, _mixed((data.astype(np.uint64) + np.uint64(1)) * _LEFT)
    for width in widths:
        if len(data) < width:
            return
        while power * 2 < width:
            half = _mixed(half[: len(data) - 2 * power + 1] * _LEFT + half[power:])
            power *= 2
        n, salt = len(data) - width + 1, np.uint64(width * _SALT & (1 << 64) - 1)
        yield width, _mixed(half + salt if width == 1 else half[:n] * _LEFT + half[width - power : width - power + n] + salt)


def _place(hashes: np.ndarray, factor: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(factor)) >> np.uint64(65 - bits.bit_length())


def _found(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be a pattern's."""
    found = np.arange(len(hashes))
    for factor in _PLACES:
        place = _place(hashes, factor, 8 * len(marks))
        hit = np.flatnonzero((marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        found, hashes = found[hit], hashes[hit]
    return found


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow column of texts or bytes without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _slices(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, from, to): rows of about SLICE_BYTES, or a piece of one row that is longer."""
    row = 0
    while row < len(offsets) - 1:
        after = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        if after > row:
            yield row, after, int(offsets[row]), int(offsets[after])
        else:
            after = row + 1
            for at in range(int(offsets[row]), int(offsets[after]), SLICE_BYTES):
                yield row, after, at, min(at + SLICE_BYTES + overlap, int(offsets[after]))
        row = after


def _text_windows(texts: DataFrame, text_id: str, text: str, widths: list[int], marks: np.ndarray) -> DataFrame:
    """(text_id, gram): the hashes of a text's windows that may be a pattern's."""
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        marks = shared.value
        for batch in batches:
            offsets, data = _buffers(batch.column(text))
            for first, after, start, end in _slices(offsets, widths[-1] - 1):
                ends = np.minimum(offsets[first + 1 : after + 1], end) - start
                rows, grams = [], []
                for width, hashes in _window_hashes(data[start:end], widths):
                    at = _found(hashes, marks)
                    row = np.searchsorted(ends, at, "right")
                    whole = at + width <= ends[row]
                    own = hashes[at[whole]]
                    order = np.lexsort((own, row[whole]))
                    row, own = row[whole][order], own[order]
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
                    rows.append(row[new])
                    grams.append(own[new])
                if rows:
                    ids = batch.column(text_id).take(pa.array(np.concatenate(rows) + first))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(grams).view(np.int64))], names=[text_id, "gram"])

    return texts.mapInArrow(run, f"{text_id} {dict(texts.dtypes)[text_id]}, gram long")


def _pattern_windows(patterns: DataFrame, pattern: str) -> DataFrame:
    """(pattern, width, gram) of patterns (pattern, width): the hash of the pattern's first window; 0 for an empty one."""
    cut = patterns.select(pattern, "width", F.substring(F.col(pattern).cast("binary"), F.lit(1), F.col("width")).alias("window"))

    def run(batches):
        for batch in batches:
            offsets, data = _buffers(batch.column("window"))
            width_of, grams = batch.column("width").to_numpy(), np.zeros(batch.num_rows, np.uint64)
            for width in np.unique(width_of[width_of > 0]):
                own = np.flatnonzero(width_of == width)
                for lo in range(0, len(own), max(1, SLICE_BYTES // int(width))):
                    part = own[lo : lo + max(1, SLICE_BYTES // int(width))]
                    windows = data[offsets[part][:, None] + np.arange(width)].reshape(-1)
                    for _, hashes in _window_hashes(windows, [int(width)]):
                        grams[part] = hashes[:: int(width)]
            yield pa.RecordBatch.from_arrays([batch.column(pattern), batch.column("width"), pa.array(grams.view(np.int64))], names=[pattern, "width", "gram"])

    return cut.mapInArrow(run, f"{pattern} string, width int, gram long")


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    """The places of all windows marked; the rows that come are words of the bitmap, however many patterns there are."""

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate([_place(batch.column("gram").to_numpy().view(np.uint64), factor, bits) for factor in _PLACES]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            one = np.uint64(1) << (at & np.uint64(63))
            held = np.bitwise_or.reduceat(one, first) if len(at) else one
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(held.view(np.int64))], names=["word", "held"])

    words = grams.select("gram").mapInArrow(run, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    marks = np.zeros(bits // 64, np.uint64)
    marks[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return marks.view(np.uint8)


def _spread(texts: DataFrame, text_id: str) -> DataFrame:
    tasks = texts.sparkSession.sparkContext.defaultParallelism
    return texts if len(texts.inputFiles()) >= tasks else texts.repartition(tasks, text_id)


def substring_join(texts: DataFrame, patterns: DataFrame, text_id: str, text: str, pattern: str) -> DataFrame:
    """(text_id, pattern) for every distinct pattern contained in a text; empty patterns match all."""
    length = F.octet_length(pattern)
    distinct = patterns.select(pattern).where(F.col(pattern).isNotNull()).distinct()
    sized = distinct.withColumn("width", F.when(length > 0, _width_of(length)).otherwise(0))
    named = stored(_pattern_windows(sized, pattern), "patterns")
    counts = {row.width: row.n for row in named.groupBy("width").agg(F.count("*").alias("n")).collect()}  # a row a width, 80 at most
    blank, widths = 0 in counts, sorted(counts.keys() - {0})
    whole = texts.select(text_id, text).where(F.col(text).isNotNull())
    in_all = whole.where(F.lit(blank)).select(text_id, F.lit("").alias(pattern))
    if not widths:
        return in_all

    grams = named.where("width > 0").select("gram", pattern)
    bits = min(BITS, max(LEAST_BITS, 1 << (BITS_EACH * sum(counts.values()) - 1).bit_length()))
    cut = _text_windows(_spread(whole, text_id), text_id, text, widths, _bitmap(grams, bits))
    # rows come together by text once: for what is distinct, and for the whole text that verifies them
    candidates = cut.join(grams, "gram").select(text_id, pattern).repartition(text_id).distinct()
    verified = candidates.join(whole, text_id).where(F.contains(text, F.col(pattern))).select(text_id, pattern)
    return verified.unionByName(in_all) if blank else verified
