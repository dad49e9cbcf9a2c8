"""Document fingerprints: invertible Bloom lookup sketches of a text's passages.

A paragraph is cut further at sentence ends and after words whose hash says so (one in four), so that short texts have
passages too and an edit changes only those it touches; in texts under 256 code points every word ends one. Each passage (with the how-many-th of its kind it is) has a
64-bit digest. A sketch of M cells keeps, per cell, how many digests fell there, their sum and the sum of their check
values; a digest falls into one cell of each of three parts of the sketch. The smallest sketch is the fingerprint.

Two versions are compared by subtracting cells and peeling: a cell with one digest left gives it away, it is taken out of its
other cells, and so on until nothing is left. If something is, both are sketched again in four times as many cells. What
has been peeled are the passages that differ, and likeness is 1 - differing / all (1 for two texts without passages).

Defined results: a null text is empty; a text without passages has the empty sketch; a next document is the one of the
next larger id (nulls first, ties by text), the first one after the last; a lone document is its own next; rows that
repeat an id are documents of their own; an empty table gives no rows; other columns are ignored.
"""

import base64
import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the fingerprint, growth on failure, cells per digest.
CELLS, GROWTH, HASHES = 24, 4, 3
#: Bytes of text that a task is planned for.
RANGE_BYTES = 8 << 20
#: Ranges of ids, at most; beyond that they grow.
RANGES = 20_000
#: Documents that are sketched at a time.
SLICE = 256
#: Texts of fewer code points are short; bytes of the pieces that long words make.
SHORT, PIECE = 256, 16
#: Words of a passage, at most.
MOST_WORDS = 8
#: Ends of passages: line ends and sentence ends.
SENTENCE = re.compile(rb"[^\n.!?]+[.!?]*")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Cuts(dict):
    """Whether a passage ends after a word; remembered up to a bound."""

    def __missing__(self, word: bytes) -> bool:
        from xxhash import xxh32_intdigest

        if len(self) > 300_000:
            self.clear()
        self[word] = cut = xxh32_intdigest(word) % 4 == 0
        return cut


def passages(sentence: bytes, cuts: Cuts, short: bool = False) -> list[bytes]:
    """Passages of a sentence in order: ended by words that say so and after MOST_WORDS words; in short texts by every word.

    Words that are long for a text are pieces of PIECE bytes (4 in short texts), each a passage.
    """
    out = []
    piece, most = (4, 4) if short else (PIECE, 4 * PIECE)
    words = sentence.split()
    a = 0
    for b, (word, cut) in enumerate(zip(words, map(cuts.__getitem__, words)), 1):
        if len(word) > most:
            out += [b" ".join(words[a : b - 1])] * (b - 1 > a)
            out += [word[k : k + piece] for k in range(0, len(word), piece)]
            a = b
        elif cut or short or b - a == MOST_WORDS:
            out.append(b" ".join(words[a:b]))
            a = b
    if a < len(words):
        out.append(b" ".join(words[a:]))
    return out


class Cut:
    """A text's passages as hashes in order, and where each sentence begins: in the text's bytes and among the passages."""

    def __init__(self, text: str, cuts: Cuts, of: "Cut | None" = None, kept: int = 0):
        """`of` is a text that begins with the same `kept` code points; what their whole sentences gave is taken from it."""
        from xxhash import xxh64_intdigest

        self.short = len(text) < SHORT
        raw = text.encode("utf-8", "surrogatepass")
        self.hashes, self.starts, self.before, begin = [], [], [], 0
        if of is not None and of.short == self.short:
            # the last sentence that begins in the kept part may go on otherwise; those before it end there
            whole = bisect_left(of.starts, len(text[:kept].encode("utf-8", "surrogatepass"))) - 1
            if whole > 0:
                begin = of.starts[whole]
                self.hashes = of.hashes[: of.before[whole]]
        for m in SENTENCE.finditer(raw, begin):
            self.starts.append(m.start())
            self.before.append(len(self.hashes))
            self.hashes += map(xxh64_intdigest, passages(m.group(), cuts, self.short))

    def digests(self) -> np.ndarray:
        """64-bit digests of the passages, all different: a repeated passage counts its repeats in."""
        raw = np.array(self.hashes, np.uint64)
        raw.sort()
        if len(raw):
            first = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]])
            repeat = np.arange(len(raw)) - np.repeat(first, np.diff(np.r_[first, len(raw)]))
            raw = mix64(raw + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return raw


def digests(text: str, cuts: Cuts) -> np.ndarray:
    return Cut(text, cuts).digests()


def cells_of(values: np.ndarray, cells: int) -> np.ndarray:
    """Places of each digest, HASHES to a row, one in each part of a sketch of `cells` cells."""
    part = cells // HASHES
    salts = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mix64(values[:, None] ^ salts) % np.uint64(part)).astype(np.int64) + part * np.arange(HASHES)


def sketches(sets: list[np.ndarray], cells: int) -> np.ndarray:
    """(set, cell, (count, sum of digests, sum of checks)) of many sets; sums wrap around 64 bits."""
    out = np.zeros((len(sets) * cells, 3), np.uint64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if len(values):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _add(out, (owner[:, None] * cells + cells_of(values, cells)).ravel(), np.repeat(values, HASHES), np.uint64(1))
    return out.reshape(len(sets), cells, 3)


def _add(table: np.ndarray, at: np.ndarray, values: np.ndarray, times) -> None:
    np.add.at(table[:, 0], at, times)
    np.add.at(table[:, 1], at, values * times)
    np.add.at(table[:, 2], at, mix64(values + np.uint64(1)) * times)


def peel(difference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many digests each difference of sketches gave away, whether nothing is left of it)."""
    n, cells, _ = difference.shape
    table, found = difference.reshape(n * cells, 3).copy(), np.zeros(n, np.int64)
    one, less = np.uint64(1), np.uint64(2**64 - 1)
    look = np.arange(n * cells)
    while len(look):
        count, value, check = table[look].T
        positive = (count == one) & (check == mix64(value + one))
        negative = (count == less) & (check * less == mix64(value * less + one))
        pure = positive | negative
        at, sign = look[pure], np.where(positive[pure], one, less)
        digest = table[at, 1] * sign
        owner = at // cells
        # a digest shows in up to HASHES cells at once; it is taken out once
        order = np.lexsort((digest, owner))
        same = (owner[order[1:]] == owner[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
        once = order[np.r_[True, ~same]] if len(order) else order
        owner, digest, sign = owner[once], digest[once], sign[once]
        found += np.bincount(owner, minlength=n)
        places = (owner[:, None] * cells + cells_of(digest, cells)).ravel()
        _add(table, places, np.repeat(digest, HASHES), np.repeat(sign * less, HASHES))
        look = np.unique(places)
    return found, ~table.reshape(n, -1).any(axis=1)


def differing(a: list[np.ndarray], b: list[np.ndarray], base_a: np.ndarray, base_b: np.ndarray) -> np.ndarray:
    """How many digests are in just one of a[i] and b[i]: by their fingerprints, or larger sketches where these fail."""
    out, todo, cells = np.zeros(len(a), np.int64), np.arange(len(a)), CELLS
    left, right = base_a, base_b
    while len(todo):
        found, done = peel(left - right)
        out[todo[done]] = found[done]
        todo = todo[~done]
        cells *= GROWTH
        if len(todo):
            left, right = sketches([a[k] for k in todo], cells), sketches([b[k] for k in todo], cells)
    return out


def likeness(a, b, base_a, base_b) -> np.ndarray:
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b)])
    return 1 - differing(a, b, base_a, base_b) / np.maximum(1, sizes)


def printed(sketch: np.ndarray) -> str:
    """A sketch as text: of each cell the count, the sum and half of the check, all of them modulo their width."""
    cells = np.empty(len(sketch), [("count", "<u2"), ("sum", "<u8"), ("check", "<u4")])
    cells["count"], cells["sum"], cells["check"] = (sketch[:, k].astype(cells.dtype[k]) for k in range(3))
    return base64.b64encode(cells.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the front of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def dealt(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(part, guest, doc_id, text): ranges of ascending ids in sorted partitions, each followed by the first document(s) of the next range as guests."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size, first, nameless = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = min(RANGES, max(1, -(-(size or 0) // range_bytes)))
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bounds = np.array(sorted({b for b in found or [] if nameless or b > first}), np.int64)
    n = len(bounds) + 1

    def deal(batches):
        for batch in batches:
            names = batch.column("doc_id")
            missing = names.is_null().to_numpy(zero_copy_only=False)
            ids = names.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(missing, 0, np.searchsorted(bounds, ids, side="right"))
            # the first of a range is a guest of the one before; the first of all, of the last one
            opens = ~missing & np.isin(ids, bounds)
            leads = missing if nameless else ids == first
            at = np.r_[np.arange(len(ids)), np.flatnonzero(opens), np.flatnonzero(leads)]
            to = np.r_[part, part[opens] - 1, np.full(leads.sum(), n - 1)]
            guest = np.arange(len(at)) >= len(ids)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(guest), rows.column("doc_id"), rows.column("text")], names=["part", "guest", "doc_id", "text"])

    return (
        docs.mapInArrow(deal, "part int, guest boolean, doc_id long, text string")
        .repartitionById(n, "part")
        .sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), "text")
    )


FIELDS = {
    "doc_id": ("long", pa.int64()), "n_chars": ("long", pa.int64()), "edited_sha256": ("string", pa.string()), "fingerprint": ("string", pa.string()),
    "edited_fingerprint": ("string", pa.string()), "near_edited": ("double", pa.float64()), "near_next": ("double", pa.float64()),
}


def versions(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): its fingerprint, that of its edited text, and the likeness of both to it and of the next document."""

    def run(batches):
        cuts, held = Cuts(), []

        def rows():
            # held: (doc_id, text) of SLICE documents and the one that follows them
            parted = [Cut(t, cuts) for _, t in held]
            sets = [c.digests() for c in parted]
            base = sketches(sets, CELLS)
            new = [edited(t, following) for (_, t), (_, following) in zip(held, held[1:])]
            new_sets = [Cut(t, cuts, own, len(old) - len(old) // 4).digests() for t, own, (_, old) in zip(new, parted, held)]
            new_base = sketches(new_sets, CELLS)
            own, own_base = sets[:-1], base[:-1]
            columns = [
                [i for i, _ in held[:-1]],
                [len(t) for _, t in held[:-1]],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
                [printed(x) for x in own_base],
                [printed(x) for x in new_base],
                likeness(own, new_sets, own_base, new_base),
                likeness(own, sets[1:], own_base, base[1:]),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS.values())], names=list(FIELDS))

        over = False
        for batch in batches:
            for guest, name, text in zip(batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                if over:
                    continue  # only the first guest follows
                held.append((name, text.as_py()))
                over = guest
                if len(held) > SLICE:
                    yield rows()
                    held[:] = held[-1:]
        if len(held) > 1:
            yield rows()

    return dealt(docs).mapInArrow(run, ", ".join(f"{n} {k}" for n, (k, _) in FIELDS.items()))
