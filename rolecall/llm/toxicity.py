"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, with its ends marked) and itself, each hashed to a bucket. The
vocabulary is the buckets that texts of label 1 hold markedly more often than others (a z-score over labelled rows), so
that a few telling words are not averaged away in a long text. A text is the mean embedding of the vocabulary's buckets
in it, all words counted, and a softmax over the mean gives the probability of the label. Embeddings and softmax are
trained together in numpy. A misspelling that was never seen shares n-grams with the word it stands for.

Defined results: null and empty texts, and texts without a bucket of the vocabulary, get the score of the intercept;
repeated rows get equal scores; where no labelled row of one class exists, all scores are the share of label 1 among
labelled rows, or 0 without any; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import held_out, labelled_sample, stored

WIDTH, GRAMS = 8, (3, 4, 5)  # of an embedding; of n-grams. Buckets are 32-bit hashes
#: Labelled rows of a class that are learnt from, at most.
PER_CLASS = 1000
#: How far apart the classes must be in a bucket of the vocabulary, in standard errors; with few labelled rows, this share of
#: the most that there can be, the square root of their number.
TELLING, TELLING_SHARE = 6.0, 0.5
STEPS, RATE = 200, 0.05
MEMO_WORDS = 200_000
#: Stripped from the ends of words.
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"


def grams(word: str) -> list[int]:
    """Buckets of a lower-case word's subwords."""
    from xxhash import xxh32_intdigest

    core = word.strip(EDGES)
    if not core:
        return []
    marked = f"<{core}>"
    parts = [marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))]
    return [xxh32_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often each) of a text."""
    found, times = np.unique([g for w in text.lower().split() for g in grams(w)], return_counts=True)
    return found.astype(np.int64), times.astype(np.float32)


class Bags:
    """Bags of many texts as one sparse matrix, with products in both directions."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, sizes: np.ndarray):
        self.at, self.weight, self.n = at, weight.astype(np.float32)[:, None], len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)
        full = sizes > 0
        self.full, self.starts = np.flatnonzero(full), (np.cumsum(sizes) - sizes)[full]
        self.turned = np.argsort(at, kind="stable")
        sorted_at = at[self.turned]
        self.first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]]) if len(at) else np.zeros(0, int)
        self.used = sorted_at[self.first]

    def times(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), np.float32)
        if len(self.at):
            out[self.full] = np.add.reduceat(table[self.at] * self.weight, self.starts)
        return out

    def transposed_times(self, rows: np.ndarray) -> np.ndarray:
        """Only of the buckets that are used, in the order of `used`."""
        return np.add.reduceat((rows[self.row] * self.weight)[self.turned], self.first) if len(self.at) else np.zeros((0, rows.shape[1]), np.float32)


class Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.v, self.t = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, gradient: np.ndarray, at=slice(None)) -> None:
        self.t += 1
        self.m[at] = 0.9 * self.m[at] + 0.1 * gradient
        self.v[at] = 0.999 * self.v[at] + 0.001 * gradient**2
        self.value[at] -= self.rate * (self.m[at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[at] / (1 - 0.999**self.t)) + 1e-8)


def vocabulary(sample: DataFrame, n1: int, n0: int, telling: float = TELLING) -> list[int]:
    """The buckets that are in more of the texts of label 1 than of the others, by `telling` standard errors (fewer with few texts); ascending.

    Counted on the executors; only these buckets come to the driver.
    """

    def run(batches):
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").cast(pa.int32())):
                found = bag(text.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), label.as_py(), np.int32))], names=["bucket", "label"])

    held = sample.select("text", "label").mapInArrow(run, "bucket long, label int").groupBy("bucket").agg(F.sum("label").alias("in1"), F.count("*").alias("n"))
    telling = min(telling, TELLING_SHARE * (n1 + n0) ** 0.5)
    p = F.col("n") / (n1 + n0)
    apart = F.col("in1") / n1 - (F.col("n") - F.col("in1")) / n0
    return sorted(r.bucket for r in held.where(apart > telling * F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) + 1e-12).select("bucket").collect())


def train(bags: Bags, label: np.ndarray, weight: np.ndarray, known: list[int]) -> tuple[dict[int, float], float]:
    """(logit of label 1 of each bucket of the vocabulary, intercept); the bags hold places in the vocabulary."""
    rng = np.random.default_rng(1)
    table = Adam(rng.normal(0, 0.1, (len(known), WIDTH)).astype(np.float32), RATE)
    soft, intercept = Adam(rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32), RATE), Adam(np.zeros(2, np.float32), RATE)
    wanted = np.stack([1 - label, label], 1).astype(np.float32)
    share = (weight / weight.sum()).astype(np.float32)[:, None]
    for _ in range(STEPS):
        hidden = bags.times(table.value)
        logits = hidden @ soft.value + intercept.value
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - wanted) * share
        table.step(bags.transposed_times(error @ soft.value.T), bags.used)
        soft.step(hidden.T @ error)
        intercept.step(error.sum(axis=0))
    raw = table.value @ (soft.value[:, 1] - soft.value[:, 0])
    return dict(zip(known, raw.tolist())), float(intercept.value[1] - intercept.value[0])


def bags_of(sample: DataFrame, make):
    """(Bags, label, weight) of a bounded sample; `make` turns texts into bags on the executors."""

    def run(batches):
        for batch in batches:
            made = [make(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), batch.column("weight"), pa.array([a for a, _ in made], pa.list_(pa.int64())), pa.array([w for _, w in made], pa.list_(pa.float32()))],
                names=["doc_id", "label", "weight", "at", "share"],
            )

    rows = sample.select("doc_id", "label", "weight", "text").mapInArrow(run, "doc_id long, label int, weight double, at array<long>, share array<float>").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()
    at, share = (pa.concat_arrays(rows[c].chunks) if rows[c].num_chunks else pa.array([], rows[c].type) for c in ("at", "share"))
    sizes = at.value_lengths().to_numpy(zero_copy_only=False).astype(int) if len(at) else np.zeros(0, int)
    return Bags(at.flatten().to_numpy(zero_copy_only=False), share.flatten().to_numpy(zero_copy_only=False), sizes), rows["label"].to_numpy(), rows["weight"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> tuple[dict[int, float], float]:
    """Learn from at most 2 * `per_class` labelled documents outside the held-out fifth."""
    sample = stored(labelled_sample(docs, labels, label, per_class, [0, 1]), "sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return {}, 50.0 if n.get(1) else -50.0
    known = vocabulary(sample, n[1], n[0])

    def known_bag(text: str):
        """(places in the vocabulary, share of each) of a text."""
        found, times = bag(text)
        held = np.isin(found, known)
        return np.searchsorted(known, found[held]), times[held] / max(1.0, times[held].sum())

    return train(*bags_of(sample, known_bag), known)


def score(text: str, model: tuple[dict[int, float], float]) -> Column:
    """Probability of label 1 for a text column."""
    table, intercept = model

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        class Memo(dict):  # of a word: the sum over its buckets in the vocabulary, and their number
            def __missing__(self, word):
                if len(self) > MEMO_WORDS:
                    self.clear()
                values = [table[g] for g in grams(word) if g in table]
                self[word] = value = (sum(values), len(values)) if values else None
                return value

        memo = Memo()
        for column in columns:
            out = np.empty(len(column))
            for k, text in enumerate(column):
                found = [v for v in map(memo.__getitem__, (text.as_py() or "").lower().split()) if v]
                out[k] = sum(v for v, _ in found) / sum(n for _, n in found) if found else 0.0
            yield pa.array(1 / (1 + np.exp(-np.clip(out + intercept, -50, 50))))

    return scores(F.col(text))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    scored = docs.select("doc_id", "text").select("doc_id", held_out().alias("held_out"), score("text", fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without rows that score 0.5 or more."""
    return docs.where(score("text", fit(docs, labels)) < 0.5)
