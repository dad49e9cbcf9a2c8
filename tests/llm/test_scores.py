"""Toxicity, quality classifier and quality rules."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from rolecall.llm import ordinal, quality_rules, toxicity
from rolecall.llm.common import labelled_sample

WORDS = [a + b + c for a in ("ba", "lo", "mi", "ter", "shu") for b in ("na", "ro", "tis", "ve") for c in ("", "l", "nd", "ra")]
BAD = ["wretchling", "gorbag", "snivelhead"]


def corpus(n, seed=3):
    """(doc_id, text, toxic, quality): a tenth with bad words, a tenth shouted."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(60, 90))]
        toxic, low = k % 10 == 1, k % 10 == 2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if low:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), int(toxic), int(not low)))
    return rows


@pytest.fixture(scope="module")
def made(docs_of, labels_of):
    rows = corpus(600)
    return docs_of([(k, t) for k, t, _, _ in rows]).cache(), labels_of([(k, q, x) for k, _, x, q in rows]), rows


def test_toxic_words_and_their_misspellings_are_found(made, docs_of):
    docs, labels, rows = made
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 80 and all(got[k].predicted == toxic for k, _, toxic, _ in held)
    model = toxicity.fit(docs, labels)
    clean = " ".join(WORDS[:70])
    texts = docs_of([(1, clean), (2, clean + " wretchlingg"), (3, clean + " gorbags,"), (4, ""), (5, None), (6, "!!! ... 77")])
    score = {r[0]: r[1] for r in texts.select("doc_id", toxicity.score("text", model)).collect()}
    assert score[2] > 0.5 and score[3] > 0.5 and score[1] < 0.5 and score[4] == score[5] == score[6] < 0.5


def test_few_labelled_rows_tell_the_classes_apart(docs_of, labels_of):
    rows = [(k, " ".join(random.Random(k).choices(WORDS, k=30) + (["gorbag", "wretchling", "snivelhead"] if k % 2 else [])), int(k % 2)) for k in range(39)]
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs_of([(k, t) for k, t, _ in rows]), labels_of([(k, 1, x) for k, _, x in rows])).collect()}
    assert got == {k: x for k, _, x in rows}


def test_a_sample_is_the_same_in_every_run(docs_of, labels_of):
    docs = docs_of([(k % 50, f"text {k} {'b' * (k % 7)}") for k in range(150)])
    labels = labels_of([(k % 50, 1, (k // 50) % 2) for k in range(150)])
    runs = [sorted(map(tuple, labelled_sample(docs.repartition(n), labels.repartition(n), "toxic", 12, [0, 1]).select("doc_id", "label", "text").collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and {r[1] for r in runs[0]} == {0} and len({r[0] for r in runs[0]}) == len(runs[0])


def test_scores_and_products_equal_plain_ones(made, docs_of):
    docs, labels, rows = made
    logit, intercept = toxicity.fit(docs, labels)
    texts = [t for _, t, _, _ in rows[:60]] + ["", "gorbag gorbag", "no known word"]
    got = {r[0]: r[1] for r in docs_of(list(enumerate(texts))).select("doc_id", toxicity.score("text", (logit, intercept))).collect()}
    for k, text in enumerate(texts):
        values = [logit[g] for word in text.lower().split() for g in toxicity.grams(word) if g in logit]
        assert abs(got[k] - 1 / (1 + np.exp(-(np.mean(values or [0.0]) + intercept)))) < 1e-9
    rng = np.random.default_rng(4)
    sizes = np.array([3, 0, 2, 4])
    at, weight = rng.integers(0, 6, 9), rng.random(9).astype(np.float32)
    bags, dense = toxicity.Bags(at, weight, sizes), np.zeros((4, 6))
    np.add.at(dense, (np.repeat(np.arange(4), sizes), at), weight)
    table, error = rng.random((6, 3)).astype(np.float32), rng.random((4, 3)).astype(np.float32)
    assert np.allclose(bags.times(table), dense @ table, atol=1e-5)
    assert np.allclose(bags.transposed_times(error), (dense.T @ error)[bags.used], atol=1e-5)


def test_toxic_documents_go_with_their_columns_kept(made):
    docs, labels, rows = made
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, _, toxic, _ in rows if not toxic}


def test_classes_that_are_missing(docs_of, labels_of, odd_docs):
    for labels in (labels_of([]), labels_of([(1, 1, 0), (6, 1, 0)])):
        assert toxicity.classify(odd_docs, labels).where("predicted = 1").isEmpty()
        assert ordinal.grade(odd_docs, labels).where("selected = 0").isEmpty()
        assert quality_rules.judged(odd_docs, labels).where("kept = base_failed").isEmpty()
    empty = docs_of([])
    assert toxicity.classify(empty, labels_of([])).isEmpty() and ordinal.grade(empty, labels_of([])).isEmpty()
    assert quality_rules.judged(empty, labels_of([])).isEmpty()


def test_odd_rows_are_scored_once_each(made, odd_docs):
    docs, labels, _ = made
    union = docs.unionByName(odd_docs.select(docs.columns))
    for scored, column in ((toxicity.classify(union, labels), "score"), (ordinal.grade(union, labels), "tail_probability"), (quality_rules.judged(union, labels), "score")):
        assert scored.count() == union.count() and scored.where(f"{column} IS NULL OR NOT {column} BETWEEN 0 AND 1").isEmpty()


def test_labels_of_the_held_out_fifth_teach_nothing(made, docs_of):
    docs, labels, _ = made
    sample = labelled_sample(docs, labels, "toxic", 20, [0, 1])
    from zlib import crc32

    ids = [r.doc_id for r in sample.collect()]
    assert ids and all(crc32(str(k).encode()) % 5 for k in ids)
    assert Counter(r.label for r in sample.collect()) == {0: 20, 1: 20}


def test_quality_is_learnt(made):
    docs, labels, rows = made
    got = {r.doc_id: r for r in ordinal.grade(docs, labels).collect()}
    assert all(got[k].selected == q for k, _, _, q in rows if got[k].held_out)
    kept = ordinal.selected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(q for *_, q in rows)
    trees = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    assert all(trees[k].kept == bool(q) for k, _, _, q in rows)


def test_thresholds_stay_in_order_and_grades_follow_the_text():
    rng = random.Random(5)
    texts, grades = [], []
    for k in range(240):
        grade = k % 4
        texts.append(" ".join(["fine" if rng.random() < grade / 3 else "poor" for _ in range(40)]))
        grades.append(grade)
    made = [ordinal.bag(t) for t in texts]
    bags = toxicity.Bags(np.concatenate([a for a, _ in made]), np.concatenate([w for _, w in made]), np.array([len(a) for a, _ in made]))
    model = ordinal.train(bags, np.array(grades), np.ones(240), [0, 1, 2, 3])
    assert (np.diff(model.thresholds) > 0).all()
    z = bags.times(model.weights[:, None])[:, 0]
    expected = sum(ordinal.sigmoid(z - b) for b in model.thresholds)
    means = [expected[np.array(grades) == g].mean() for g in range(4)]
    assert means == sorted(means) and means[0] < 0.6 and means[3] > 2.4


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_base_statistics_equal_a_plain_count():
    rng = random.Random(11)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "é", "#", "|", " ", " ", "\n", " ", "\x0b", "☃"]) for _ in range(rng.randint(0, 120)))
        assert quality_rules.statistics(text.encode())[0] == plain_statistics(text)
    assert quality_rules.statistics(b"")[0] == [0] * 5


def test_trees_honour_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(800) < 0.15)).astype(float)
    y[(x[:, 0] > 0.9)] = 1  # against the constraint
    trees = quality_rules.boost(x, y, np.ones(800), [-1, 0, 1])
    assert trees.feature.ndim == 1 and len(trees.feature) == len(trees.value) == len(trees.left)
    grid = np.linspace(0, 1, 60)
    for other in rng.random((20, 3)):
        rows = np.tile(other, (60, 1))
        rows[:, 0] = grid
        assert (np.diff(trees.score(rows)) <= 1e-12).all()
        rows = np.tile(other, (60, 1))
        rows[:, 2] = grid
        assert (np.diff(trees.score(rows)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == y).mean() > 0.75
