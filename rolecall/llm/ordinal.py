"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Each word gives hashed features: itself, its shape (letters by case, digits, the rest as it is, runs shortened), the
shape of its ends, and whether it repeats the word before it. A text is the mean over its words. One weight vector,
shared by all grades, gives a latent quality z; ordered thresholds b1 < b2 < ... cut it: P(grade > k) = sigmoid(z - bk).
The expected grade and the probability of the upper tail select documents. Grades are what the labels hold, few in number.

Defined results: null and empty texts and texts without words have z = 0; repeated rows get equal scores; with fewer than two
grades among the labelled rows every text gets the grade there is (0 without any) and tail probability 1; other columns
are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import held_out, labelled_sample
from rolecall.llm.toxicity import Adam, Bags, bags_of

BUCKETS = 1 << 16
#: Labelled rows of a grade that are learnt from, at most.
PER_GRADE = 1500
STEPS, RATE, DECAY = 150, 0.05, 1e-4
MEMO_WORDS = 200_000
#: Grades from this one on are the upper tail; a text is selected if its tail probability reaches SELECT.
TAIL_GRADE, SELECT = 1, 0.5
SCALE = 30.0


def shape(word: str) -> str:
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if len(out) < 2 or out[-1] != kind or out[-2] != kind:
            out.append(kind)
    return "".join(out[:24])


def features(word: str, again: bool) -> list[int]:
    """Buckets of a word: how it is written, itself, and whether it repeats."""
    from xxhash import xxh32_intdigest

    form = shape(word)
    parts = ["w" + word.lower(), "s" + form, "e" + form[-2:], "f" + form[:2], "a" if again else "n"]
    return [xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.array([features(w, w == v) for w, v in zip(words, ["", *words])]).ravel()
    found, counts = np.unique(at, return_counts=True)
    return found.astype(np.int32), (counts / len(words)).astype(np.float32)


@dataclass
class Model:
    """weights per bucket, thresholds between neighbouring grades."""

    grades: list[int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(bags: Bags, grade: np.ndarray, weight: np.ndarray, grades: list[int]) -> Model:
    """Maximum likelihood by Adam; steps between thresholds are exponentials, so they stay in order."""
    if len(grades) < 2:
        return Model(grades or [0])
    k = len(grades)
    level = np.searchsorted(grades, grade)
    above = (level[:, None] > np.arange(k - 1)).astype(float)
    theta = Adam(np.zeros((BUCKETS, 1), np.float32), RATE)
    steps = Adam(np.r_[-0.5, np.zeros(k - 2)], RATE)  # first threshold, logarithms of the steps up
    share = (weight / weight.sum())[:, None]
    # P(level) = F(b_k - z) - F(b_k-1 - z)
    at = np.arange(len(level))
    for _ in range(STEPS):
        b = np.cumsum(np.r_[steps.value[0], np.exp(steps.value[1:])])
        z = SCALE * bags.times(theta.value)[:, :1]
        p = np.c_[np.ones(len(z)), sigmoid(z - b), np.zeros(len(z))]
        mass = np.maximum(p[at, level] - p[at, level + 1], 1e-9)[:, None]
        slope = p * (1 - p)
        dz = -(slope[at, level] - slope[at, level + 1])[:, None] / mass * share
        theta.step(SCALE * bags.transposed_times(dz.astype(np.float32)) + DECAY * theta.value[bags.used], bags.used)
        db = ((above * (level[:, None] == np.arange(1, k)) - (level[:, None] == np.arange(k - 1))) * slope[:, 1:-1] / mass * share).sum(axis=0)
        tail = np.cumsum(db[::-1])[::-1]
        steps.step(np.r_[tail[0], tail[1:] * np.exp(steps.value[1:])])
    b = np.cumsum(np.r_[steps.value[0], np.exp(steps.value[1:])])
    return Model(grades, SCALE * theta.value[:, 0], b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_grade: int = PER_GRADE) -> Model:
    """Learn from at most `per_grade` labelled documents of each grade, outside the held-out fifth."""
    grades = sorted(r[0] for r in labels.select(label).distinct().dropna().collect())  # few by contract
    bags, grade, weight = bags_of(labelled_sample(docs, labels, label, per_grade, grades), bag) if grades else (None, np.zeros(0), None)
    return train(bags, grade, weight, sorted(set(grade.tolist())))


def latent(text: str, model: Model) -> Column:
    """z of a text column."""
    weights = model.weights

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import operator

        repeat = float(weights[features("", True)[-1]] - weights[features("", False)[-1]])

        class Memo(dict):
            def __missing__(self, word):
                if len(self) > MEMO_WORDS:
                    self.clear()
                self[word] = value = float(weights[features(word, False)].sum())
                return value

        memo = Memo()
        for column in columns:
            out = np.zeros(len(column))
            for k, text in enumerate(column):
                if words := (text.as_py() or "").split():
                    out[k] = (sum(map(memo.__getitem__, words)) + repeat * sum(map(operator.eq, words, words[1:]))) / len(words)
            yield pa.array(out)

    return run(F.col(text))


def graded(z: Column, model: Model, tail_grade: int = TAIL_GRADE) -> tuple[Column, Column]:
    """(expected grade, probability of `tail_grade` or more) from z."""
    above = [1 / (1 + F.exp(F.lit(float(b)) - z)) for b in model.thresholds]
    expected, tail = F.lit(float(model.grades[0])), F.lit(1.0)
    for k, p in enumerate(above):
        expected = expected + p * (model.grades[k + 1] - model.grades[k])
        if model.grades[k] < tail_grade:
            tail = p
    return expected, tail


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, selected) for each row of docs."""
    model = fit(docs, labels)
    z = docs.select("doc_id", "text").select("doc_id", held_out().alias("held_out"), latent("text", model).alias("z"))
    expected, tail = graded(F.col("z"), model)
    return z.select("doc_id", "held_out", expected.alias("expected_grade"), tail.alias("tail_probability"), (tail >= SELECT).cast("int").alias("selected"))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, of those rows whose tail probability reaches SELECT."""
    model = fit(docs, labels)
    return docs.where(graded(latent("text", model), model)[1] >= SELECT)
