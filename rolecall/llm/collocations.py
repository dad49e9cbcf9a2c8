"""Phrase collocations: frequent word n-grams by Misra-Gries summaries, then exact counts, scores and a ranking by language.

Texts are cut into pieces (at punctuation and line ends) and words (at blanks); phrases never leave their piece. The work
goes over the texts three times, with words found by numpy in windows of some megabytes:

1. Words and pairs go as 64-bit hashes, counted within a task, to hash partitions. Each partition merges what comes into
   one Misra-Gries summary, whose capacity exceeds the partition's mass divided by the threshold, so every n-gram that
   reaches the threshold survives. Counts are cut at the threshold first: only whether it is reached matters.
2. The same for three and four words, of which only those enter whose pairs all survived.
3. What survived is counted exactly, by its words: a task tells n-grams apart by exact numbers of their words, and
   partial counts of whole phrases meet in hash partitions.

Survivors travel as one bit of a fixed BITS (16 MB broadcast, whatever the input). Bits that meet let others pass, never
lose one; the exact count drops what stays below the threshold. So do hashes that meet.

How it is spread: hash partitions grow in number with the input, so a summary is bounded; a frequent n-gram is one row a
task. The ranking keeps a language's best in each task before they meet.

Defined results: a null text is empty; a null language is `und`, one with rows of language `und`; repeated rows count as
often as they are there; null ids count like others; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import stored

THRESHOLD, LONGEST, COVERED_PERCENT, TOP = 30, 4, 80, 2000
SCALE = 2_000_000
#: Bits that survivors are marked in; bytes of text that make a hash partition; n-grams counted before they are sent on.
BITS, PARTITION_BYTES, FLUSH = 1 << 27, 8 << 20, 6_000_000
#: Capacity of a summary beside its least, mass / threshold; the more, the fewer infrequent n-grams survive.
SLACK = 4
#: Bytes of text that numpy works on at a time (a longer piece is taken whole), phrases counted before they are sent on.
WINDOW_BYTES, HELD_PHRASES = 4 << 20, 300_000
SEED = np.uint64(0x9E3779B97F4A7C15)


def _normal() -> bytes:
    out = bytearray(range(256))
    for code in range(ord("A"), ord("Z") + 1):
        out[code] = code + 32
    for code in b".,;:!?\n\x0b\x0c\r":
        out[code] = 10
    out[9] = 32
    return bytes(out)


NORMAL = _normal()


def text_windows(texts: list[bytes], size: int):
    """Pieces of normalised texts in windows of about `size` bytes, each ending with a line end; no piece is cut."""
    whole = b"\n".join(texts).translate(NORMAL) + b"\n"
    at = 0
    while at < len(whole):
        cut = whole.rfind(b"\n", at, at + size) if at + size < len(whole) else len(whole) - 1
        if cut < 0:
            cut = whole.find(b"\n", at + size)
        yield np.frombuffer(whole, np.uint8, cut + 1 - at, at)
        at = cut + 1


class Words:
    """The words of a window: an exact number for each (an index of `names`), and whether the next word is in the same piece."""

    def __init__(self, window: np.ndarray):
        ends_piece = window == 10
        apart = ends_piece | (window == 32)
        edge = np.flatnonzero(np.diff(apart.view(np.int8), prepend=1))  # starts and ends in turn: a window ends with a line end
        starts, ends = edge[::2], edge[1::2]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        letters = window[~apart]
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.ids, self.names = column.indices.to_numpy().astype(np.int64), column.dictionary
        piece = np.cumsum(ends_piece, dtype=np.int32)[starts]
        self.joined = piece[1:] == piece[:-1]

    def hashes(self, lang: bytes) -> list[np.ndarray]:
        """Hashes of the words, pairs, triples and quadruples that begin at each word, whether or not they leave the piece."""
        from xxhash import xxh64_intdigest

        seed = xxh64_intdigest(lang)
        each = np.array([xxh64_intdigest(w, seed) for w in self.names.to_pylist()], np.uint64)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        out = [each]
        for n in range(1, LONGEST):
            longer = out[-1][:-1] * SEED + each[n:] if len(out[-1]) else out[-1]
            longer = (longer ^ (longer >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(longer ^ (longer >> np.uint64(32)))
        return out

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each one on are in one piece."""
        ok = np.ones(max(0, len(self.ids) - n + 1), bool)
        for k in range(n - 1):
            ok &= self.joined[k : len(ok) + k]
        return ok


def marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - 27)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def by_language(batch, size: int):
    """(language, window) of a batch of rows (lang, text)."""
    langs, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
    of: dict[str, list] = {}
    for lang, text in zip(langs, texts):
        of.setdefault(lang, []).append(text)
    for lang, own in of.items():
        for window in text_windows(own, size):
            yield lang, window


def counted(hashes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sum of their weights (1 each by default)."""
    if weights is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes, kind="stable")
        hashes, weights = hashes[order], weights[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(np.r_[first, len(hashes)]) if weights is None else np.add.reduceat(weights, first) if len(first) else weights


class Summary:
    """Mergeable Misra-Gries summary of weighted hashes: no count is low by more than `lost`, which stays under mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > self.capacity:
            self.merge()

    def merge(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.waiting, self.n_waiting = [], 0
        self.keys, self.counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        if len(self.keys) > self.capacity:
            # the largest count beyond the capacity is taken from all
            cut = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.lost += cut
            stay = self.counts > cut
            self.keys, self.counts = self.keys[stay], self.counts[stay] - cut

    def frequent(self, threshold: int) -> np.ndarray:
        """All hashes whose true count may reach the threshold."""
        self.merge()
        return self.keys[self.counts + self.lost >= threshold]


def sent(hashes: list[np.ndarray], shift: int, threshold: int) -> pa.RecordBatch:
    """Counts of n-grams, cut at the threshold, as a row (part, mass, keys, counts) for each hash partition."""
    keys, counts = counted(np.concatenate(hashes))
    counts = np.minimum(counts, threshold).astype("<u4")
    part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    cuts = [*starts.tolist(), len(part)]
    small = counts.astype(np.uint8) if threshold < 256 else counts
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part[starts]),
            pa.array(np.add.reduceat(counts.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)),
            pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            pa.array([small[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
        ],
        names=["part", "mass", "keys", "counts"],
    )


def survivors(texts: DataFrame, parts: int, sizes: tuple[int, ...], pairs, threshold: int, flush: int = FLUSH, window: int = WINDOW_BYTES) -> np.ndarray:
    """BITS bits, in which those n-grams of the given sizes are marked that may be frequent; `pairs` marks the pairs that longer ones may hold."""
    shift = 64 - (parts.bit_length() - 1)
    kind = np.uint8 if threshold < 256 else np.dtype("<u4")

    def send(batches):
        held, n = [], 0
        for batch in batches:
            for lang, part in by_language(batch, window):
                words = Words(part)
                hashes = words.hashes(lang.encode())
                frequent = marked(hashes[1], pairs.value) if pairs is not None else None
                for size in sizes:
                    ok = words.inside(size)
                    if frequent is not None:
                        for k in range(size - 1):
                            ok &= frequent[k : len(ok) + k]
                    held.append(hashes[size - 1][ok])
                    n += len(held[-1])
                if n >= flush:
                    yield sent(held, shift, threshold)
                    held, n = [], 0
        if n:
            yield sent(held, shift, threshold)

    def merge(batches):
        current, summary = None, None

        def done():
            bits = np.zeros(BITS // parts, np.uint8)
            bits[(summary.frequent(threshold) >> np.uint64(64 - 27)).astype(np.int64) - current * (BITS // parts)] = 1
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, total, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("part", "total", "keys", "counts")]):
                if part != current:
                    if current is not None:
                        yield done()
                    current, summary = part, Summary(SLACK * total // threshold + 1)
                summary.add(np.frombuffer(keys, "<u8"), np.frombuffer(counts, kind))
        if current is not None:
            yield done()

    rows = texts.mapInArrow(send, "part long, mass long, keys binary, counts binary")
    # the mass of a whole partition stands beside each of its rows
    massed = rows.repartition(parts, "part").withColumn("total", F.sum("mass").over(Window.partitionBy("part")))
    found = massed.select("part", "total", "keys", "counts").mapInArrow(merge, "part long, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for row in found.collect():  # 16 MB in all
        out[row.part * (BITS // parts // 8) :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, dense number of each, count) of equal ids."""
    _, first, number, counts = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    return first, number, counts


def packed(found: dict, parts: int) -> pa.RecordBatch:
    """Counts of phrases as a row (part, lang, phrases, counts) for each hash partition and language; phrases end with a line end."""
    from xxhash import xxh64_intdigest

    rows: dict[tuple, tuple] = {}
    for (lang, phrase), n in found.items():
        part = -1 if phrase is None else xxh64_intdigest(phrase, 1) % parts
        phrases, counts = rows.setdefault((part, lang), ([], []))
        phrases.append(phrase or b"")
        counts.append(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part for part, _ in rows], pa.int64()), pa.array([lang for _, lang in rows], pa.string()),
            pa.array([b"\n".join(phrases) for phrases, _ in rows.values()], pa.binary()),
            pa.array([np.array(counts, "<i8").tobytes() for _, counts in rows.values()], pa.binary()),
        ],
        names=["part", "lang", "phrases", "counts"],
    )


def exact_counts(texts: DataFrame, short, long, threshold: int, parts: int, window: int = WINDOW_BYTES, held: int = HELD_PHRASES) -> DataFrame:
    """(lang, phrase, n) of the marked phrases that reach the threshold; phrase is null in a language's count of all words."""

    def count(batches):
        found: dict[tuple, int] = {}
        for batch in batches:
            for lang, part in by_language(batch, window):
                words = Words(part)
                if not len(words.ids):
                    continue
                hashes, names = words.hashes(lang.encode()), words.names.to_pylist()
                found[lang, None] = found.get((lang, None), 0) + len(words.ids)
                numbers = words.ids  # exact numbers of the n-grams that begin at each word, where they may be frequent
                ok = np.ones(len(words.ids), bool)
                for n in range(1, LONGEST + 1):
                    if n > 1:
                        ok = ok[:-1] & words.joined[n - 2 : n + len(ok) - 3]
                    at = np.flatnonzero(ok & marked(hashes[n - 1], short.value if n < 3 else long.value))
                    exact = numbers[at] if n == 1 else numbers[at] << 32 | words.ids[at + n - 1]
                    first, dense, counts = grouped(exact)
                    for k, c in zip(at[first].tolist(), counts.tolist()):
                        key = lang, b" ".join([names[i] for i in words.ids[k : k + n].tolist()])
                        found[key] = found.get(key, 0) + c
                    # a longer n-gram is frequent only if its first words are
                    ok = np.zeros(len(ok), bool)
                    ok[at] = True
                    numbers = np.zeros(len(ok), np.int64)
                    numbers[at] = dense
                if len(found) >= held:
                    yield packed(found, parts)
                    found.clear()
        if found:
            yield packed(found, parts)

    def add_up(batches):
        current, sums = None, {}

        def done():
            kept = [(phrase, n) for phrase, n in sums.items() if n >= threshold or current[0] < 0]
            phrases = pa.array([None if current[0] < 0 else phrase for phrase, _ in kept], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([current[1]] * len(kept), pa.string()), phrases, pa.array([n for _, n in kept], pa.int64())], names=["lang", "phrase", "n"])

        for batch in batches:
            for part, lang, phrases, counts in zip(*[batch.column(c).to_pylist() for c in ("part", "lang", "phrases", "counts")]):
                if (part, lang) != current:
                    if current is not None:
                        yield done()
                    current, sums = (part, lang), {}
                for phrase, n in zip(phrases.split(b"\n"), np.frombuffer(counts, "<i8").tolist()):
                    sums[phrase] = sums.get(phrase, 0) + n
        if current is not None:
            yield done()

    rows = texts.mapInArrow(count, "part long, lang string, phrases binary, counts binary")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "lang").mapInArrow(add_up, "lang string, phrase string, n long")


def wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD, partition_bytes: int = PARTITION_BYTES, flush: int = FLUSH, window: int = WINDOW_BYTES) -> DataFrame:
    """(lang, phrase, n): exact counts of the phrases of 1 to 4 words that reach the threshold; with phrase null, of all words of a language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(1 << 20, 1 << max(0, -(-size // partition_bytes) - 1).bit_length())
    share = docs.sparkSession.sparkContext.broadcast
    short = share(survivors(texts, parts, (1, 2), None, threshold, flush, window))
    long = share(survivors(texts, parts, (3, 4), short, threshold, flush, window))
    return stored(exact_counts(texts, short, long, threshold, parts, window), "phrases")


def ranked(counts: DataFrame, covered_percent: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of several words.

    A phrase scores by its weakest cut into two: SCALE * a / (l + r), a being its count, l and r its parts'. Phrases that
    lie within a longer one with at least `covered_percent` of their count are left out.
    """
    known = counts.where("phrase IS NOT NULL")
    several = known.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words")).where(F.size("words") > 1)
    size = F.size("words")
    piece = lambda start, n: F.array_join(F.slice("words", start, n), " ")

    spans = [(start, n) for n in range(2, LONGEST) for start in range(1, LONGEST - n + 2)]
    within = F.array_compact(F.array(*[F.when((size > n) & (size >= start + n - 1), piece(start, n)) for start, n in spans]))
    longest = several.select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = several.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * wide("longer") < F.lit(covered_percent) * wide("a")))

    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, LONGEST).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # decimals, as products may pass 64 bits
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    placed = weakest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    totals = counts.where("phrase IS NULL").select("lang", "n")
    return placed.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, covered_percent: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    return ranked(phrase_counts(docs, threshold), covered_percent, top)
