import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rolecall.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, threshold=30, percent=80, top=2000):
    """By counting every n-gram of every piece."""
    counts, totals = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        several = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in several.items():
            inside = any(
                len(q) > len(p) and 100 * b >= percent * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in several.items()
            )
            if not inside:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def made_up(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "new", "a", "é", "☃", "it's", "x\x1cy", "long" * 9] + [f"w{k}" for k in range(25)]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "\x0b"]) for _ in range(rng.randrange(60)))
        if rng.random() < 0.4:
            text += rng.choice(["new york city hall is big", "once upon a time there was", "Once upon a time"])
        rows.append((k, rng.choice(["en", "en", "de", None, "und"]), text))
    return rows


ODD = [(1, "en", None), (2, None, ""), (3, None, " \t\n"), (None, "en", "new york"), (7, "en", "same same same"), (7, "en", "same same same"), (8, "", "no name")]


@pytest.mark.parametrize("threshold", [3, 8, 300])
@pytest.mark.parametrize("small", [False, True])
def test_equals_a_plain_count(spark, threshold, small):
    rows = made_up(threshold, 250) + ODD
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({x: F.lit("x") for x in ("n", "phrase", "part", "l", "words")})
    sizes = {"partition_bytes": 500, "flush": 400, "window": 256} if small else {}
    got = c.ranked(c.phrase_counts(docs, threshold, **sizes))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, threshold)


def test_best_of_each_language_and_a_long_text(spark):
    rows = made_up(1, 150) + [(999, "en", "over and over again " * 40_000)]
    got = c.ranked(c.phrase_counts(spark.createDataFrame(rows, SCHEMA), 2, window=1 << 16), top=3)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 2, top=3)


def test_arithmetic_is_exact_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_007
    counts = spark.createDataFrame([("en", "x", big), ("en", "y", big), ("en", "x y", big - 1), ("en", None, 2 * big)], "lang string, phrase string, n long")
    row = c.ranked(counts).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big)


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), max_size=30), max_size=12), st.integers(2, 20))
def test_a_summary_loses_nothing_frequent(parts, threshold):
    truth = Counter()
    for part in parts:
        for key, n in part:
            truth[key] += n
    summary = c.Summary(sum(truth.values()) // threshold + 1)
    for part in parts:
        own = Counter()
        for key, n in part:
            own[key] += n
        summary.add(np.array(sorted(own), np.uint64), np.array([own[k] for k in sorted(own)], np.int64))
    survived = set(summary.frequent(threshold).tolist())
    assert {k for k, n in truth.items() if n >= threshold} <= survived
    assert summary.lost < threshold and len(survived) <= summary.capacity


def test_a_full_summary_forgets_the_infrequent(spark):
    rng = np.random.default_rng(1)
    summary = c.Summary(200)
    for _ in range(50):
        keys, counts = c.counted(np.concatenate([rng.integers(1000, 1 << 60, 150).astype(np.uint64), np.repeat(np.arange(10, dtype=np.uint64), 5)]))
        summary.add(keys, counts)
    survived = summary.frequent(100)
    assert set(range(10)) <= set(survived.tolist()) and summary.lost > 0 and len(survived) < 60
