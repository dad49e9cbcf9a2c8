import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from rolecall.llm import prefix_trie as t

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows, rebuild=True):
    """By a dictionary from each prefix to its members."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, key(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9 if rebuild else 0
        base = conv - int(np.fmod(conv, 5))
        paths[conv] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], set()).add(conv)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    assert frame.columns == t.OUT
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def made_up(seed, n, longest=7):
    rng = random.Random(seed)
    rows = []
    for conv in range(-5, n):
        if conv % 7 == 3:
            continue
        for turn in range(rng.randrange(1, longest)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["hi", "hi", "é ☃", "", "how are you"]) if turn < 3 else f"{rng.randrange(3)}"))
    return rows


ODD = [
    (500, None, None, None), (500, None, "user", "first by null"), (500, 3, None, "x"), (500, 3, None, "x"), (500, -1, "a", "bc"), (501, 0, "ab", "c"),
    (502, 0, "a", "bc"), (None, 0, "user", "nobody's"), (503, 1, "user", "long " * 30_000), (2**62, 0, "user", "hi"),
]


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "shard_rows": 9}, {"block": 1, "shard_rows": 40}, {"block": 3, "shard_rows": 10**6}])
@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_a_plain_trie(spark, sizes, rebuild):
    rows = made_up(len(sizes), 90) + ODD
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumns({c: F.lit("x") for c in ("depth", "part", "shard", "key", "pos", "n", "p1")})
    turns = t.placed(frame)
    assert rows_of(t.trie(*(t.rebuilt if rebuild else t.as_they_are)(turns), **sizes)) == plain(rows, rebuild)


def test_long_conversations_and_many_copies(spark):
    rows = [(c, k, "user", f"turn {k}") for c in (0, 1, 2, 5) for k in range(400 if c else 150)] + [(c, k, "user", "same") for c in range(1000, 1300) for k in range(3)]
    got = t.trie(*t.as_they_are(t.placed(spark.createDataFrame(rows, SCHEMA).repartition(4))), block=64, shard_rows=200)
    assert rows_of(got) == plain(rows, False)


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    conv = next(c for c in range(1, 1000) if zlib.crc32(str(c).encode()) % 9 > 2 and c % 5)
    rows = [(conv, 0, "user", "a"), (conv, 1, "user", "b")]
    got = rows_of(t.trie(*t.rebuilt(t.placed(spark.createDataFrame(rows, SCHEMA)))))
    assert got == plain(rows) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_empty_table(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert t.trie(*t.rebuilt(t.placed(spark.createDataFrame(rows, SCHEMA)))).count() == 0


def test_ids_of_one_node_meet_in_chunks(spark):
    ends = spark.range(3000).select(F.lit(7).cast("long").alias("p1"), F.lit(8).cast("long").alias("p2"), F.col("id").alias("conv_id")).repartition(5)
    row = t.end_hashes(ends, chunk_bytes=100).first()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal_and_tells_others_apart(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 50, n).astype(np.uint64), np.arange(n, dtype=np.uint64)
    index = t.PerfectHash(a, b)
    assert sorted(index.find(a, b).tolist()) == list(range(n))
    assert (index.find(a + np.uint64(100), b) == -1).all()
