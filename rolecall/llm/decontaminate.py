"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, run once over each document.

Texts are normalised to words (A-Z in lower case; runs of ASCII letters, digits and anything beyond ASCII) one space
apart. A benchmark item is the text of each given column (question and answer, say); its windows are all runs of WINDOW
words, or the whole item where it has fewer. The automaton holds each window between two spaces, so a match is a match
of whole words; a document's words inside any match are hit, and runs of hit words are mapped back to code points of the
text as it was.

How it is spread: documents stay where they are and are read once; nothing of them is shuffled. Windows are written to
the shared folder and dealt by hash into blocks of BLOCK_BYTES, so that what the driver collects, broadcasts and builds
an automaton of is bounded whatever the size of the benchmark. One block is the usual case. Further blocks each take
another pass, whose matches meet by the digest of the text.

Defined results: a null or wordless text has no words and no hits; an item without words has no windows; an item without
an id marks words and is not named; an id that several items carry counts once; one row comes out for each row that goes
in, repeated rows and null ids included; an empty benchmark leaves every document clean; other columns are ignored.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import process_memo, stored

WINDOW = 10
#: Bytes of windows in one automaton (it takes some fifty times that in a worker).
BLOCK_BYTES = 2 << 20


def _table() -> bytes:
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for low, high, shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0)):
        for code in range(low, high + 1):
            out[code] = code + shift
    return bytes(out)


NORMAL = _table()
#: The same words in a text that is not normalised yet.
ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
FOUND = "doc_id long, n_words long, n_hit long, spans array<struct<start: int, end: int>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(benchmark: DataFrame, columns=("text",), width: int = WINDOW) -> DataFrame:
    """(item, gram): the distinct windows of each item's columns."""

    def run(batches):
        for batch in batches:
            items, grams = [], []
            names = batch.column("item").to_pylist()
            for column in columns:
                for item, text in zip(names, batch.column(column).cast(pa.binary()).to_pylist()):
                    words = words_of(text or b"")
                    own = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else ()
                    items += [item] * len(own)
                    grams += own
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(grams, pa.binary()).cast(pa.string())], names=["item", "gram"])

    asked = benchmark.select(F.col("item_id").cast("string").alias("item"), *columns)
    return asked.mapInArrow(run, "item string, gram string").distinct()


class Matcher:
    """An automaton over (item, gram) pairs; `matches` gives the hit words and items of a text's words."""

    def __init__(self, pairs: list[tuple]):
        import ahocorasick

        owners: dict[str, set] = {}
        for item, gram in pairs:
            owners.setdefault(gram, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for gram, items in owners.items():
            self.automaton.add_word(f" {gram} ", (gram.count(" ") + 1, tuple(i for i in items if i is not None)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def matches(self, words: list[bytes]):
        """None, or (a boolean for each word, the items)."""
        if self.empty or not words:
            return None
        line = b" " + b" ".join(words) + b" "
        ends, lengths, items = [], [], set()
        for end, (length, owners) in self.automaton.iter(line.decode()):
            ends.append(end)
            lengths.append(length)
            items.update(owners)
        if not ends:
            return None
        # the word that ends before the j-th space (from 0) is word j - 1
        codes = np.frombuffer(line.decode().encode("utf-32-le"), "<u4")
        past = np.searchsorted(np.flatnonzero(codes == 32), ends)
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, past - np.array(lengths), 1)
        np.add.at(cover, past, -1)
        return np.cumsum(cover)[:-1] > 0, items


def matcher(key: str, pairs) -> Matcher:
    """The worker's automaton; it keeps the last one only."""
    kept = process_memo("automaton", dict)
    if key not in kept:
        kept.clear()
        kept[key] = Matcher(pairs())
    return kept[key]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code points of the text."""
    found = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    return [{"start": found[a][0], "end": found[b][1]} for a, b in runs(hit)]


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _scan(docs: DataFrame, pairs: list[tuple], keyed: bool) -> DataFrame:
    """FOUND for each document; `keyed` gives (digest, hit word runs, items) of each document with hits instead."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    key = hashlib.sha256(repr(sorted(pairs, key=repr)).encode()).hexdigest()

    def run(batches):
        known = matcher(key, lambda: shared.value)
        for batch in batches:
            rows = []
            texts = batch.column("text").cast(pa.binary())
            for at, text in enumerate(texts):
                text = text.as_py() or b""
                words = words_of(text)
                found = known.matches(words)
                if keyed:
                    if found:
                        rows.append({"digest": hashlib.md5(text).digest(), "runs": [{"start": a, "end": b} for a, b in runs(found[0])], "items": sorted(found[1])})
                    continue
                one = {"doc_id": batch.column("doc_id")[at].as_py(), "n_words": len(words), "n_hit": 0, "spans": [], "items": []}
                if found:
                    one |= {"n_hit": int(found[0].sum()), "spans": spans_of(text.decode(), found[0]), "items": sorted(found[1])}
                rows.append(one)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    items = ("items", pa.list_(pa.string()))
    arrow = pa.schema([("digest", pa.binary()), ("runs", span), items] if keyed else [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", span), items])
    return docs.select("doc_id", "text").mapInArrow(run, "digest binary, runs array<struct<start: int, end: int>>, items array<string>" if keyed else FOUND)


def _merged(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """FOUND from the matches of several blocks, which meet by the digest of the text."""
    united = hits.groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["text"] or ""
                hit = np.zeros(len(words_of(text.encode())), bool)
                for r in row["runs"] or ():
                    hit[r["start"] : r["end"] + 1] = True
                rows.append({"doc_id": row["doc_id"], "n_words": len(hit), "n_hit": int(hit.sum()), "spans": spans_of(text, hit) if hit.any() else [], "items": row["items"] or []})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
    digested = docs.select("doc_id", "text", digest_of(F.col("text")).alias("digest"))
    return digested.join(united, "digest", "left").select("doc_id", "text", "runs", "items").mapInArrow(run, FOUND)


def blocks_of(benchmark: DataFrame, columns, width: int, block_bytes: int):
    """How many blocks the benchmark's windows make, and a function that collects one (some `block_bytes`)."""
    known = stored(windows(benchmark, columns, width), "windows")
    size = known.agg(F.sum(F.octet_length("gram") + F.lit(16))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    own = F.pmod(F.xxhash64("item", "gram"), F.lit(n))
    return n, lambda k: [tuple(r) for r in (known.where(own == k) if n > 1 else known).collect()]


def texts_hit(docs: DataFrame, n: int, block) -> DataFrame:
    """(digest, runs, items) of the distinct texts that match a window of a block, a row for each block."""
    hits = None
    for k in range(n):
        new = stored(_scan(docs, block(k), keyed=True).dropDuplicates(["digest"]), "hits")
        hits = new if hits is None else hits.union(new)
    return hits


def find(docs: DataFrame, benchmark: DataFrame, columns=("text",), width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of each document: hit words, where they stand in the text, and whose windows they are."""
    n, block = blocks_of(benchmark, columns, width, block_bytes)
    return _scan(docs, block(0), keyed=False) if n == 1 else _merged(docs, texts_hit(docs, n, block))


def clean(docs: DataFrame, benchmark: DataFrame, columns=("text",), width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the rows whose text has a hit word."""
    bad = texts_hit(docs, *blocks_of(benchmark, columns, width, block_bytes)).select(F.col("digest").alias("_hit_text")).distinct()
    return docs.join(bad, digest_of(docs["text"]) == bad["_hit_text"], "left_anti")


def report(found: DataFrame) -> DataFrame:
    """The digest of `find`: ids of items, sorted as strings and comma-joined, as SHA-256."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
