"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are sorted by their rank in Gray order, where neighbours share most of their leading bits. Groups of
neighbours factor the bits that all of them share into an upper node (a mask and a pattern), groups of nodes into nodes
above. Two nodes differ in at least the bits in which their patterns differ under both masks; where these are more than
the limit, all pairs below are ruled out at once.

How the index is spread: a pair within 3 bits agrees in at least one of four 16-bit segments. Four orders, each with
another segment turned to the front, put such a pair below one top node (the nodes of the segment's 65,536 values) in
at least one of them. Top nodes go to tasks by hash, each task builds the hierarchy below its own. A task returns the
links of a spanning forest, not all pairs, so near copies of one text by the thousand give as many links as texts.
Components of the whole graph come from alternating star rounds on those links, written to the shared folder.

Defined results: a null text is empty; an empty text and one without words have fingerprint zero and are linked like
others; repeated ids share a row's component (one row per input row); null ids are never the smallest of a group unless
all are null; an empty table gives no rows; other columns are ignored, and kept by `one_of_each`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import stored

SEED, SHINGLE, BITS, SEGMENTS = 42, 3, 64, 4
LEAF = 16  # fingerprints below a lowest node, and nodes below a higher one
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Node pairs that are opened at a time.
FRONTIER = 1 << 15


def fingerprint_of(text: bytes) -> int:
    """SimHash of a text's word shingles, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)  # one shingle: its hash
    hashes = np.array([xxh64_intdigest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            values = [fingerprint_of(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bits long")


def bits_of(text: str) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t or b"") for t in column.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))

    return run(F.col(text))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest place) after joining a[i] with b[i]."""
    while len(a):
        label = roots(label)
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    return roots(label)


class GrayIndex:
    """Hierarchy over fingerprints sorted by Gray rank; `top` holds the top node of each, non-decreasing."""

    def __init__(self, codes: np.ndarray, top: np.ndarray):
        self.codes, self.top = codes, top
        starts = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(top)]
        # lowest nodes: up to LEAF neighbours, never across top nodes
        first = [np.arange(s, e, LEAF) for s, e in zip(starts, ends)] if len(starts) else []
        lo = np.concatenate(first) if first else np.zeros(0, int)
        hi = np.r_[lo[1:], len(codes)]
        self.levels = [self._nodes(lo, hi, np.bitwise_and.reduceat(codes, lo), np.bitwise_or.reduceat(codes, lo), top[lo])] if len(lo) else []
        while self.levels and len(self.levels[-1]["lo"]) > len(starts):
            below = self.levels[-1]
            own = below["top"]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)]))
            lo = np.flatnonzero(place % LEAF == 0)
            self.levels.append(self._nodes(lo, np.r_[lo[1:], len(own)], np.bitwise_and.reduceat(below["and"], lo), np.bitwise_or.reduceat(below["or"], lo), own[lo]))

    @staticmethod
    def _nodes(lo, hi, all_and, all_or, top) -> dict:
        # a bit is shared where all have it or none has it; the pattern holds its value
        return {"lo": lo, "hi": hi, "and": all_and, "or": all_or, "mask": ~(all_and ^ all_or), "top": top}

    def _opened(self, level: int, a: np.ndarray, b: np.ndarray):
        """All pairs of children of the node pairs (a, b), each once; the children of level 0 are codes."""
        nodes = self.levels[level]
        na, nb = nodes["hi"][a] - nodes["lo"][a], nodes["hi"][b] - nodes["lo"][b]
        i, j = np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij")
        i, j = i.ravel(), j.ravel()
        there = (i < na[:, None]) & (j < nb[:, None]) & ((a != b)[:, None] | (i < j if level == 0 else i <= j))
        pair, cell = np.nonzero(there)
        return nodes["lo"][a][pair] + i[cell], nodes["lo"][b][pair] + j[cell]

    def forest(self, limit: int) -> np.ndarray:
        """Component label of each code: the place of the first code that links of at most `limit` bits reach."""
        label = np.arange(len(self.codes))
        if not self.levels:
            return label
        last = len(self.levels) - 1
        every = np.arange(len(self.levels[last]["lo"]))
        todo = [(last, every[k : k + FRONTIER], every[k : k + FRONTIER]) for k in range(0, len(every), FRONTIER)]
        while todo:
            level, a, b = todo.pop()
            if len(a) > FRONTIER // LEAF:
                cut = FRONTIER // LEAF
                todo.append((level, a[cut:], b[cut:]))
                a, b = a[:cut], b[:cut]
            a, b = self._apart(level, label, a, b)
            a, b = self._opened(level, a, b)
            if level:
                below = self.levels[level - 1]
                differ = np.bitwise_count((below["and"][a] ^ below["and"][b]) & below["mask"][a] & below["mask"][b])
                near = differ <= limit
                if near.any():
                    todo.append((level - 1, a[near], b[near]))
            else:
                near = np.bitwise_count(self.codes[a] ^ self.codes[b]) <= limit
                if near.any():
                    label = unite(label, a[near], b[near])
        return label

    def _apart(self, level: int, label, a, b):
        """Without pairs of lowest nodes whose codes are all in one component by now."""
        if level:
            return a, b
        nodes = self.levels[0]
        low, high = np.minimum.reduceat(label, nodes["lo"]), np.maximum.reduceat(label, nodes["lo"])
        done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        return a[~done], b[~done]


def links(codes: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b): pairs of codes of `codes` (bits, no repeats) that connect all that chains of links connect below one top node."""
    if limit >= SEGMENTS:
        raise ValueError(f"{SEGMENTS} orders find pairs that differ in fewer bits than that")
    turned = [F.shiftleft("bits", 16 * s).bitwiseOR(F.shiftrightunsigned("bits", BITS - 16 * s)) if s else F.col("bits") for s in range(SEGMENTS)]
    orders = codes.select("bits", F.posexplode(F.array(*turned)).alias("turn", "code")).select(
        "turn", "code", F.shiftrightunsigned("code", BITS - 16).alias("top")
    )

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        kept = pa.Table.from_batches(held)
        turn, code = kept["turn"].to_numpy(), kept["code"].to_numpy().view(np.uint64)
        node = (turn.astype(np.int64) << 16) | kept["top"].to_numpy().astype(np.int64)
        del held, kept
        order = np.lexsort((gray_rank(code), node))
        turn, code, node = turn[order], code[order], node[order]
        label = GrayIndex(code, node).forest(limit)
        at = np.flatnonzero(label != np.arange(len(label)))
        back = lambda x, s: np.where(s == 0, x, (x >> (np.uint64(16) * s)) | (x << (np.uint64(64) - np.uint64(16) * s) % np.uint64(64)))
        s = turn[at].astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(back(code[label[at]], s).view(np.int64)), pa.array(back(code[at], s).view(np.int64))], names=["a", "b"])

    return orders.repartition("turn", "top").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): the smallest node of its component, by alternating large and small stars."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    while True:
        # large star: each node's larger neighbours go to the smallest of its neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        new = stored(small, "star")
        # done when every node points at a root, that is when no node that is pointed at points on
        if new.select("u").intersect(new.select(F.col("v").alias("u"))).isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = new


def classes(codes: DataFrame, limit: int) -> DataFrame:
    """codes (bits and others, no repeats) with `top`: one code of the component that links of at most `limit` bits make."""
    found = components(links(codes.select("bits"), limit))
    return codes.join(found, F.col("bits") == F.col("node"), "left").select(*codes.columns, F.coalesce("root", "bits").alias("top"))


def near_duplicates(docs: DataFrame, limit: int = 3) -> DataFrame:
    """(doc_id, bits, component_id) for each row of docs: the smallest id that links of at most `limit` bits reach."""
    marked = stored(fingerprints(docs), "fingerprints")
    codes = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "codes")
    # nodes are codes, so that those which only rows without an id have connect others, too
    rooted = stored(classes(codes, limit), "rooted")
    smallest = rooted.groupBy("top").agg(F.min("first").alias("component_id"))
    grouped = rooted.join(smallest, "top").select("bits", "component_id")
    return marked.join(grouped, "bits").select("doc_id", "bits", "component_id")


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which Spark does not hash, by their JSON."""
    columns = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema]
    return F.xxhash64(*[F.to_json(F.struct(c.alias("c"))) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, docs.schema)])


def one_of_each(docs: DataFrame, limit: int = 3) -> DataFrame:
    """One row of docs, all columns, for each component: that of the smallest id (none last); of several rows with that id, the first by `row_hash`."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    # rows are numbered as they are written, so that one of several equal rows can be told
    rows = stored(docs.select(whole.alias("row"), bits_of("text").alias("bits"), row_hash(docs).alias("hash"), F.monotonically_increasing_id().alias("at")), "fingerprinted")
    order = F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("doc_id"), "hash", "at")
    codes = stored(rows.groupBy("bits").agg(F.min(order).alias("first")), "codes")
    kept = classes(codes, limit).groupBy("top").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    return rows.join(kept, "at", "left_semi").select("row.*")
