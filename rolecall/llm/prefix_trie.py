"""Conversation prefix trie: a node for each distinct sequence of first turns, with counts of what lies below it.

A sequence of turns is known by a 128-bit digest: the sum (two lanes, modulo 2**64) of a hash of each turn's place, role
and text. Digests of longer prefixes come by adding, so a path can be summed in parts.

Node tables. Paths are cut into blocks of BLOCK turns and dealt to shards by (conversation, block). A shard enumerates its
distinct prefix digests, gives each a slot of a minimal perfect hash (a digest stands in its slot, so a lookup that meets
another one is told apart), scatters counts into flat arrays and links slots by parent. Shards' counts of a digest add up.
What is to be summed over subtrees is then owned by one shard a node, that of the node's smallest member; each shard adds
weights up its parent slots, deepest first, and the shards' sums of a digest add up again. What a conversation owns in
later blocks enters the last node of each earlier block.

How it is spread: turns are sorted by range, so neither a conversation nor a node has to fit into a task; places and
digests that go on from one range to the next take one number a range. A first turn that all conversations share is one
row a shard. Ids of conversations that end at one node are hashed from joined chunks. Only the number of a conversation's
blocks (a thousandth of its turns) comes together by conversation.

Defined results: a null role or text is empty; turns go by (turn, nulls first; then a digest of role and text), repeated
rows are turns of their own; turns without a conversation id belong to none; an empty table gives no rows; other columns
are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.llm.common import stored

BLOCK, SHARD_ROWS, CHUNK_BYTES = 1024, 20_000, 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct digests (a, b): a slot below their number for each, -1 for any other digest."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, taken, left = [], 0, np.arange(len(a))
        while len(left):
            # those that are alone at their place of this level's bits have it for good; the others go to the next level
            place = self._place(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            left = left[~alone[place]]
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        slots = self._slots(a, b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a, b, level, size):
        seed = np.uint64(level * int(LANES[0]) % 2**64)
        return (scrambled(a ^ scrambled(b + seed)) % np.uint64(size)).astype(np.int64)

    def _slots(self, a, b):
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(a[left], b[left], level, len(alone))
            here = alone[place]
            out[left[here]] = rank[place[here]]
            left = left[~here]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots = self._slots(a, b)
        at = np.maximum(slots, 0)
        known = (slots >= 0) & (self.a[at] == a) & (self.b[at] == b) if len(self.a) else np.zeros(len(a), bool)
        return np.where(known, slots, -1)


def distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of one of each digest."""
    order = np.lexsort((b, a))
    return order[np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]] if len(order) else order


def lanes(batch, *names) -> list[np.ndarray]:
    return [batch[n].to_numpy().view(np.uint64) for n in names]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def run_starts(conv: np.ndarray) -> np.ndarray:
    """For each row the first row of its run of equal ids."""
    starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    return np.repeat(starts, np.diff(np.r_[starts, len(conv)]))


def carried(df: DataFrame, carries: list[tuple], schema: str, names: list[str]) -> DataFrame:
    """df with what its range's first conversation brings from the ranges before (one row a range that has some), else zero."""
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in names]
    if not carries:
        return df.select("*", *[F.lit(0).cast("long").alias(n) for n in names])
    brought = F.broadcast(df.sparkSession.createDataFrame(carries, schema).withColumn("head", F.lit(True)))
    return df.join(brought, ["part", "head"], "left").select(*[c for c in df.columns], *zero)


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes) of each turn: its place in its conversation from 0, a digest of role and text, the text's size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))

    def number(batches):
        part, first, last, n = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = conv[0] if first is None else first
            starts = run_starts(conv)
            at = np.arange(len(conv)) - starts + np.where((starts == 0) & (conv == last if last is not None else False), n, 0)
            last, n = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("key"), batch.column("bytes"), pa.array(at), pa.array(np.full(len(conv), part)), pa.array(conv == first)],
                names=["conv_id", "key", "bytes", "at", "part", "head"],
            )

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    numbered = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, key binary, bytes long, at long, part long, head boolean")
    numbered = stored(numbered, "turns")
    ends = numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("part").collect()  # a row a range
    carries, conv, n = [], None, 0
    for row in ends:
        brought = n if row.first == conv else 0
        if brought:
            carries.append((row.part, brought))
        n = row.last.at + 1 + (brought if row.last.conv_id == row.first else 0)
        conv = row.last.conv_id
    return carried(numbered, carries, "part long, before long", ["before"]).select("conv_id", (F.col("at") + F.col("before")).alias("pos"), "key", "bytes")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, conversations): (conv_id, depth, key, bytes) of each turn, and (conv_id, length) of each conversation."""
    return turns.withColumn("depth", F.col("pos") + 1), turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("length"))


#: Rebuilt conversations begin with turns of the first of GROUP ids; fewer than HEADS turns.
GROUP, HEADS = 5, 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and conversations as in `as_they_are`, each conversation c rebuilt: the first h turns of conversation c - c % GROUP
    (all if fewer, none if absent), then c's own after its first h; h = crc32(c in decimal) % HEADS."""
    lengths = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    own = lengths.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    )
    bases = lengths.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    headed = own.join(bases, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(headed.select("conv_id", "h", "base", "n_head", (F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    heads = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "h"), "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "bytes")
    tails = turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").where("pos >= h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head") + 1).alias("depth"), "key", "bytes")
    return heads.union(tails), convs.select("conv_id", "length")


STEPS = "conv_id long, depth long, bytes long, l1 long, l2 long, f1 long, f2 long, part long, head boolean"


def digested(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, bytes, p1, p2, q1, q2): the digest of each prefix and of the one before it (zero for none)."""

    def add(batches):
        part, first, last, total = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
            first = conv[0] if first is None else first
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), "<u8").reshape(-1, 2)
            step = scrambled(key[:, ::-1] ^ scrambled(key + depth.astype(np.uint64)[:, None] * LANES))
            sums, starts = np.cumsum(step, axis=0, dtype=np.uint64), run_starts(conv)
            local = sums - (sums[starts] - step[starts])
            if last is not None and conv[0] == last:
                local[starts == 0] += total
            last, total = conv[-1], local[-1].copy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("depth"), batch.column("bytes"), *[signed(np.ascontiguousarray(x[:, k])) for x in (local, step) for k in (0, 1)],
                 pa.array(np.full(len(conv), part)), pa.array(conv == first)],
                names=["conv_id", "depth", "bytes", "l1", "l2", "f1", "f2", "part", "head"],
            )

    steps = stored(paths.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").select("conv_id", "depth", "key", "bytes").mapInArrow(add, STEPS), "steps")
    most = lambda only: F.max(F.when(only, F.struct("conv_id", "depth", "l1", "l2")))
    ends = steps.groupBy("part").agg(most(F.col("head")).alias("first"), most(F.lit(True)).alias("last")).orderBy("part").collect()  # a row a range
    carries, conv, total = [], None, (0, 0)
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for row in ends:
        brought = total if row.first.conv_id == conv else (0, 0)
        if row.first.conv_id == conv:
            carries.append((row.part, *brought))
        more = brought if row.last.conv_id == row.first.conv_id else (0, 0)
        conv, total = row.last.conv_id, (wrap(row.last.l1 + more[0]), wrap(row.last.l2 + more[1]))

    def whole(batches):
        for batch in batches:
            l1, l2, f1, f2, c1, c2 = lanes(batch, "l1", "l2", "f1", "f2", "c1", "c2")
            p1, p2 = l1 + c1, l2 + c2
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in ("conv_id", "depth", "bytes")], *map(signed, (p1, p2, p1 - f1, p2 - f2))], names=DIGESTED)

    with_carry = carried(steps, carries, "part long, c1 long, c2 long", ["c1", "c2"])
    return with_carry.mapInArrow(whole, "conv_id long, depth long, bytes long, p1 long, p2 long, q1 long, q2 long")


DIGESTED = ["conv_id", "depth", "bytes", "p1", "p2", "q1", "q2"]


def whole_shard(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def local_nodes(rows: DataFrame, shards: int) -> DataFrame:
    """The nodes of each shard: digest, digest of the parent, depth, text size, members and smallest member in the shard."""

    def count(batches):
        table = whole_shard(batches)
        if table is None:
            return
        (p1, p2), conv = lanes(table, "p1", "p2"), table["conv_id"].to_numpy()
        one = distinct(p1, p2)
        index = PerfectHash(p1[one], p2[one])
        slot = index.find(p1, p2)
        smallest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(smallest, slot, conv)
        of = np.empty(len(one), np.int64)  # a row of each slot
        of[slot[one]] = one
        fixed = [pa.array(table[n].to_numpy()[of]) for n in ("depth", "bytes", "p1", "p2", "q1", "q2", "shard")]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.bincount(slot, minlength=len(one))), pa.array(smallest)], names=[*NODE, "shard", "n", "conv"])

    return rows.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(count, "depth long, bytes long, p1 long, p2 long, q1 long, q2 long, shard long, n long, conv long")


NODE = ["depth", "bytes", "p1", "p2", "q1", "q2"]


def subtree_sums(weights: DataFrame, shards: int, block: int = BLOCK) -> DataFrame:
    """(p1, p2, leaves, saved, parent_conv) of each shard's nodes: weights of the nodes below, added up the parent slots.

    Rows without a depth only bring weight to a digest of the shard.
    """

    def add_up(batches):
        table = whole_shard(batches)
        if table is None:
            return
        depth = table["depth"].fill_null(0).to_numpy()
        node = depth > 0
        (p1, p2), (q1, q2) = lanes(table, "p1", "p2"), [table[n].fill_null(0).to_numpy().view(np.uint64)[node] for n in ("q1", "q2")]
        index = PerfectHash(p1[node], p2[node])
        slot, own = index.find(p1, p2), index.find(p1[node], p2[node])
        n = int(node.sum())
        leaves, saved, conv, parent, deep = np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        np.add.at(leaves, slot, table["leaves"].to_numpy())
        np.add.at(saved, slot, table["saved"].to_numpy())
        # what goes on into an earlier block goes by `later_blocks`, though the shard may hold that block, too
        within = (depth[node] - 1) % block > 0
        conv[own], parent[own], deep[own] = table["conv_id"].fill_null(0).to_numpy()[node], np.where(within, index.find(q1, q2), -1), depth[node]
        order = np.argsort(deep, kind="stable")[::-1]
        for level in np.split(order, np.flatnonzero(np.diff(deep[order])) + 1):
            inner = level[parent[level] >= 0]
            np.add.at(leaves, parent[inner], leaves[inner])
            np.add.at(saved, parent[inner], saved[inner])
        above = pa.array(conv[np.maximum(parent, 0)], mask=parent < 0)
        yield pa.RecordBatch.from_arrays([signed(index.a), signed(index.b), pa.array(leaves), pa.array(saved), above], names=["p1", "p2", "leaves", "saved", "parent_conv"])

    return weights.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(add_up, "p1 long, p2 long, leaves long, saved long, parent_conv long")


def end_hashes(ends: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(p1, p2, ends_sha256) of ends (p1, p2, conv_id): SHA-256 of a digest's ids in decimal, ascending and comma-joined."""

    def join(batches):
        part, held, ids, size, n = TaskContext.get().partitionId(), None, [], 0, 0
        for batch in batches:
            out = []
            for *node, conv in zip(*[batch.column(c).to_pylist() for c in ("p1", "p2", "conv_id")]):
                if ids and (node != held or size >= chunk_bytes):
                    out.append((*held, part, n, ",".join(ids)))
                    ids, size, n = [], 0, n + 1
                held = node
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(CHUNK, r)) for r in out], schema=chunk)
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(CHUNK, (*held, part, n, ",".join(ids))))], schema=chunk)

    def hashed(batches):
        held, state = None, None
        for batch in batches:
            out = []
            for p1, p2, text in zip(*[batch.column(c).to_pylist() for c in ("p1", "p2", "ids")]):
                if (p1, p2) != held:
                    if held:
                        out.append((*held, state.hexdigest()))
                    held, state = (p1, p2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(HASHED, r)) for r in out], schema=done)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(HASHED, (*held, state.hexdigest())))], schema=done)

    CHUNK, HASHED = ("p1", "p2", "part", "seq", "ids"), ("p1", "p2", "ends_sha256")
    chunk = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("ids", pa.string())])
    done = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
    keys = ["p1", "p2", "conv_id"]
    chunks = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(join, "p1 long, p2 long, part long, seq long, ids string")
    return chunks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "part", "seq").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def later_blocks(owned: DataFrame, rows: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """(shard, p1, p2, leaves, saved): what long conversations own in later blocks, at the last node of each block but the last."""
    long = lengths.where(F.col("length") > block).select("conv_id", "length")
    mine = owned.join(long, "conv_id").groupBy("conv_id", ((F.col("depth") - 1) / block).cast("long").alias("block")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    border = rows.join(long, "conv_id").where((F.col("depth") % block == 0) & (F.col("depth") < F.col("length")))
    zero = F.lit(0).cast("long")
    both = mine.select("conv_id", "block", "leaves", "saved", F.lit(None).cast("long").alias("shard"), *[F.lit(None).cast("long").alias(p) for p in ("p1", "p2")]).union(
        border.select("conv_id", (F.col("depth") / block).cast("long") - 1, zero, zero, "shard", "p1", "p2")
    )
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rangeBetween(Window.unboundedPreceding, -1)
    summed = both.select("shard", "p1", "p2", *[F.coalesce(F.sum(c).over(after), zero).alias(c) for c in ("leaves", "saved")])
    return summed.where("shard IS NOT NULL")


def trie(paths: DataFrame, conversations: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each node of the trie of `paths` (conv_id, depth, key, bytes), the root over `conversations` (conv_id, length) included:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    lengths = stored(conversations, "lengths")
    rows = digested(paths)
    place = F.struct("conv_id", ((F.col("depth") - 1) / block).cast("long"))
    shards = max(1, -(-(lengths.agg(F.sum("length")).first()[0] or 0) // shard_rows))
    rows = stored(rows.withColumn("shard", F.pmod(F.xxhash64(place), F.lit(shards))), "prefixes")
    everyone = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("length").alias("longest")).first()
    if not everyone.n:
        return lengths.where("false").select(*[F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in OUT])

    local = stored(local_nodes(rows, shards), "nodes")
    one = [F.first(c).alias(c) for c in ("depth", "bytes", "q1", "q2")]
    merged = local.groupBy("p1", "p2").agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), *one)
    merged = stored(merged, "merged")
    children = merged.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = stored(merged.join(children, ["p1", "p2"], "left").select(*merged.columns, F.coalesce("n_children", F.lit(0)).alias("n_children")), "nodes")

    own = F.col("conv") == F.col("conv_id")
    shared = nodes.select("p1", "p2", "conv_id", "n_convs", "n_children")
    weights = local.select(*NODE, "shard", "conv").join(shared, ["p1", "p2"]).select(
        *NODE, "shard", "conv_id", F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves"),
        F.when(own, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).alias("saved"), own.alias("own"),
    )
    owned = weights.where("own")
    weights = weights.drop("own")
    if everyone.longest > block:
        weights = stored(weights, "weights")
        weights = weights.unionByName(later_blocks(owned, rows, lengths, block), allowMissingColumns=True)
    sums = subtree_sums(weights, shards, block).groupBy("p1", "p2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.min("parent_conv").alias("parent_conv"))

    last = rows.join(lengths, "conv_id").where("depth = length").select("p1", "p2", "conv_id")
    zero = F.lit(0).cast("long")
    turnless = lengths.where("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id")
    hashes = stored(end_hashes(last.union(turnless)), "ends")

    full = nodes.join(sums, ["p1", "p2"]).join(hashes, ["p1", "p2"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(everyone.first)).otherwise(F.col("parent_conv"))
    if everyone.longest > block:
        # the first node of a later block has its parent in another shard
        above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
        full = full.join(above, ["q1", "q2"], "left")
        parent = F.coalesce(parent, "above")
    total = nodes.agg(F.count(F.when(F.col("depth") == 1, 1)), F.count(F.when(F.col("n_children") == 0, 1)), F.sum((F.col("n_convs") - 1) * F.col("bytes"))).first()
    root = lengths.sparkSession.createDataFrame(
        [(0, 0, everyone.first, 0, None, everyone.n, total[0], max(1, total[1]), total[2] or 0)],
        "p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long",
    )
    root = root.join(hashes, ["p1", "p2"], "left")
    sha = F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    full = full.withColumn("parent_conv_id", parent)
    return full.select(*OUT[:-1], sha).union(root.select(*OUT[:-1], sha))


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
