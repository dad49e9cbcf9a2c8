import random

import numpy as np
from pyspark.sql import functions as F
from rolecall.llm import simhash


def plain_components(codes, limit=3):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def planted(seed, groups, most):
    """Random codes, each with a chain of neighbours that differ from the one before in up to 4 bits."""
    rng = random.Random(seed)
    codes = []
    for _ in range(groups):
        code = rng.getrandbits(64)
        for _ in range(rng.randint(1, most)):
            codes.append(code)
            for _ in range(rng.randint(1, 4)):
                code ^= 1 << rng.randrange(64)
    return list(dict.fromkeys(codes))


def test_gray_rank_orders_gray_codes():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()
    big = np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (simhash.gray_rank(big ^ (big >> np.uint64(1))) == big).all()


def test_the_index_finds_every_link_under_a_top_node():
    for seed in range(5):
        codes = np.array(planted(seed, 60, 12), np.uint64)
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        label = simhash.GrayIndex(codes, np.zeros(len(codes), int)).forest(3)
        assert label.tolist() == plain_components([int(c) for c in codes])


def test_top_nodes_are_kept_apart():
    codes = np.array([1, 2, 1, 2], np.uint64)
    assert simhash.GrayIndex(codes, np.array([0, 0, 1, 1])).forest(3).tolist() == [0, 0, 2, 2]
    assert simhash.GrayIndex(np.zeros(0, np.uint64), np.zeros(0, int)).forest(3).tolist() == []


def test_links_over_four_orders_connect_what_all_pairs_connect(spark):
    codes = planted(9, 150, 20)
    frame = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "bits long")
    edges = simhash.links(frame)
    rows = edges.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 64 for r in rows) and len(rows) <= 4 * len(codes)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    place = {int(np.uint64(c).view(np.int64)): k for k, c in enumerate(codes)}
    want = plain_components(codes)
    groups = {}
    for code, k in place.items():
        groups.setdefault(found.get(code, code), set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (5, 4)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {k: 1 for k in range(2, 61)} | {k: 100 for k in range(101, 160)}
    assert simhash.components(edges.limit(0)).isEmpty()


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_a_plain_count():
    for text in ("", " \n", "One", "one two", "One TWO three", "a b c d e f a b c", "Ünï ÇÖDE  x y z w", "w " * 100):
        assert simhash.fingerprint_of(text.encode()) == plain_fingerprint(text)


def test_odd_rows(odd_docs, docs_of):
    rows = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()]
    groups = dict(rows)
    assert len(rows) == 12 and groups[3] == groups[4] == groups[2] == 2 and groups[7] == 6 and groups[None] is None
    kept = simhash.one_of_each(odd_docs)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == odd_docs.columns and sorted(map(str, ids)) == sorted(map(str, [1, 2, 5, 6, None, 8, 9, 10]))
    assert simhash.near_duplicates(docs_of([])).isEmpty() and simhash.one_of_each(docs_of([])).isEmpty()
    # the kept id twice, and a nameless copy of a named document
    again = docs_of([(3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (None, "a b c d")])
    assert [r.doc_id for r in simhash.one_of_each(again).collect()] == [3]
    mixed = docs_of([(1, "a b c d"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w")])
    assert sorted((str(r.doc_id), r.text) for r in simhash.one_of_each(mixed).collect()) == [("1", "a b c d"), ("None", "x y z w")]


def test_one_row_stays_whatever_the_columns(spark):
    rows = [(k % 3, "a b c d e" if k % 2 else "v w x y z", {"k": k // 6}, k) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `m` map<string,int>, `a.b` int").withColumnRenamed("m", "odd`name")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "a b c d e"), (0, "v w x y z")]
    again = [sorted(map(repr, simhash.one_of_each(docs.repartition(n)).collect())) for n in (1, 5)]
    assert again[0] == again[1]


def test_codes_that_only_nameless_rows_have_connect_others(spark, docs_of, monkeypatch):
    codes = {"first": 0, "between": 0b111, "second": 0b111111, "far": 2**40 - 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("text")).cast("long").alias("bits")))
    docs = docs_of([(4, "first"), (None, "between"), (2, "second"), (9, "far"), (None, "far")])
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [("2", 2), ("4", 2), ("9", 9), ("None", 2), ("None", 9)]
