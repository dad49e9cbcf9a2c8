"""The pipeline on a small corpus with planted documents, each stage against a plain version of it."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from rolecall.llm import mixing, ordinal, simhash, toxicity
from test_scores import BAD, WORDS


def made_up():
    """(doc_id, text, source, quality, toxic, kind)"""
    rng = random.Random(12)
    text = lambda n: [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]
    rows = []
    for k in range(420):
        words, toxic, low = text(rng.randint(80, 160)), k % 10 == 1, k % 10 == 2
        if toxic:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if low:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), f"s{k % 4}", int(not low), int(toxic), "toxic" if toxic else "low" if low else "clean"))
    base = text(900)
    for k in range(500, 512):  # near copies: a word of 900 differs
        words = list(base)
        words[rng.randrange(900)] = f"changed{k}"
        rows.append((k, " ".join(words), "s1", None, None, "near"))
    for k in range(600, 620):
        rows.append((k, "one text that is there twenty times and more than once in every source", "s2", None, None, "copy"))
    rows += [(700, None, "s0", None, None, "empty"), (701, "", None, None, None, "empty"), (None, " ".join(text(100)), "s3", None, None, "nameless")]
    rows += [(710, " ".join(text(100)), "s3", None, None, "twice")] * 2
    return rows


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = made_up()
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, q, x) for k, _, _, q, x, _ in rows if q is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_groups(texts):
    """Component number of each text by comparing all pairs of fingerprints."""
    codes = [simhash.fingerprint_of((t or "").encode()) for t in texts]
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def test_names_and_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "near-dedup", "mixing sources", "packing"]


def test_each_stage_equals_a_plain_version(spark, corpus, tmp_path):
    folder, planted = corpus
    kinds = {k: kind for k, *_, kind in planted}
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")

    def stage(n, frame):
        out = corpus_pipeline.STAGES[n][1](spark, frame, folder)
        path = str(tmp_path / str(n))
        out.write.parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    ids = lambda frame: Counter(r.doc_id for r in frame.select("doc_id").collect())
    clean = stage(0, docs)
    rejected = {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    assert clean.columns == docs.columns and ids(clean) == Counter(k for k, *_ in planted if k not in rejected)
    assert rejected == {k for k, kind in kinds.items() if kind == "toxic"}

    good = stage(1, clean)
    chosen = {r.doc_id for r in ordinal.grade(clean, labels).where("selected = 1").collect()}
    assert good.columns == docs.columns and ids(good) == Counter(k for k in ids(clean).elements() if k in chosen)
    assert not [k for k in ids(good) if kinds[k] == "low"] and all(ids(good)[k] for k, kind in kinds.items() if kind == "clean")

    single = stage(2, good)
    rows = good.select("doc_id", "text").collect()
    best = {}
    for r, group in zip(rows, plain_groups([r.text for r in rows])):
        best.setdefault(group, []).append((r.doc_id is None, r.doc_id or 0))
    assert single.columns == docs.columns
    assert ids(single) == Counter(None if min(g)[0] else min(g)[1] for g in best.values())
    left = Counter(kinds[k] for k in ids(single).elements())
    assert left["near"] <= 2 and left["copy"] <= 1 and left["twice"] <= 1 and left["clean"] == Counter(kinds.values())["clean"]

    mixed = stage(3, single)
    shares = {r.doc_id: (r.taken, r["size"]) for r in mixing.shares(single).collect()}
    assert mixed.columns == docs.columns
    taken = ids(mixed)
    assert all(taken[k] * size == words for k, (words, size) in shares.items()) and set(taken) <= set(shares)

    packed = stage(4, mixed)
    from rolecall.llm.tokens import Encoder, default_path

    encode = Encoder(default_path())
    lengths = {r.doc_id: len(encode(r.text or "")) // 4 + 1 for r in single.collect()}
    got = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("copies")).collect()
    assert {r.doc_id: (r.n, r.copies) for r in got} == {k: (n * lengths[k], n) for k, n in taken.items()}


def test_the_run_packs_what_the_stages_leave(spark, corpus):
    folder, planted = corpus
    kinds = {k: kind for k, *_, kind in planted}
    rows = corpus_pipeline.run(spark, folder).collect()
    there = {kinds[r.doc_id] for r in rows}
    assert "clean" in there and not there & {"toxic", "low"}
    once = {}
    for r in rows:  # every sequence is gapless and, unless a power of two, full
        once.setdefault(r.sequence_id, []).append(r)
    for parts in once.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    assert len({r.doc_id for r in rows if kinds[r.doc_id] == "near"}) <= 2
