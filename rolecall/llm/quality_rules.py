"""Quality rules: gradient-boosted trees over document statistics.

Base statistics come from whole texts: words, their characters, symbols, repeated lines, words in repeated windows. A
base rule rejects documents of fewer than 50 words or with over half of their words in repeated windows. Boosted trees
over rates made from these and a few more statistics judge the rest: histogram splits, logistic loss, and constraints
under which a rate that speaks against a document (symbols, repeated lines, repeated windows, capitals) never raises its
score. Trees are flattened into node arrays and scored for all documents of a batch at once.

Defined results: null and empty texts have all statistics 0 and fail the base rule; repeated rows get equal verdicts;
where labelled rows hold one class or none the trees say nothing and the base rule alone decides; other columns are
ignored; an empty table gives no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import labelled_sample

WINDOW, MIN_WORDS, MAX_REPEATED = 3, 50, 50
SYMBOLS = b"#*$%&|<>"
#: Labelled rows of a class that are learnt from, at most.
PER_CLASS = 2000
TREES, DEPTH, BINS, RATE, LEAF_WEIGHT = 60, 3, 32, 0.2, 5.0
KEEP = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, each with its constraint: -1 where more never raises the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "same_word_rate": -1,
    "upper_rate": -1, "punctuation_rate": -1, "distinct_rate": 0, "line_words": 0, "stop_rate": 0,
}
UPPER, LOWER, PUNCTUATION = (bytes(x) for x in (range(65, 91), range(97, 123), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """(base statistics, features of the trees) of a text in UTF-8."""
    words = text.split()
    n = len(words)
    if not n:
        return [0, 0, _count(text, SYMBOLS), 0, 0], [0.0] * len(FEATURES)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    joined = b"".join(words)
    word_chars = len(joined.decode("utf-8", "replace"))
    symbols, dup_lines = _count(text, SYMBOLS), len(lines) - len(set(lines))
    repeated = repeat_words(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    upper = sum(map(bytes.isupper, words))
    base = [n, word_chars, symbols, dup_lines, repeated]
    return base, [
        float(np.log(n)), word_chars / n, symbols / word_chars, dup_lines / len(lines), repeated / n, same / n, upper / n,
        _count(joined, PUNCTUATION) / word_chars, len(set(words)) / n, n / len(lines), sum(len(w) < 4 for w in words) / n,
    ]


def _count(text: bytes, characters: bytes) -> int:
    return len(text) - len(text.translate(None, characters))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    at = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    pair = _numbered(at[:-1], at[1:])
    window = _numbered(pair[:-1], at[2:])
    starts = np.bincount(window)[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= starts
    return int(covered.sum())


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[i], b[i]), equal for equal pairs."""
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]


@dataclass
class Trees:
    """Nodes of all trees in flat arrays: at node i, rows with x[feature[i]] <= split[i] go to left[i], others to left[i] + 1; leaves go to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                inner = self.left[at] > 0
                right = x[rows, self.feature[at]] > self.split[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, constraints: list[int]) -> Trees:
    """Trees for the logistic loss, grown level by level on binned features.

    A split on a constrained feature is taken only if the child values are in order, and the bounds between them hold below it.
    """
    if not len(y) or len(set(y.tolist())) < 2:
        return Trees(np.zeros(0, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), np.zeros(1), 50.0)
    weight = weight / weight.mean()
    cuts = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x.T]
    binned = np.stack([np.searchsorted(c, f, side="left") for c, f in zip(cuts, x.T)])
    share = (weight * y).sum() / weight.sum()
    bias = float(np.log(share / (1 - share)))
    total = np.full(len(y), bias)
    roots, feature, split, left, value = [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0), split.append(0.0), left.append(0), value.append(v)
        return len(value) - 1

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = weight * (y - p), weight * p * (1 - p)
        root = node(0.0)
        roots.append(root)
        level = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for depth in range(DEPTH + 1):
            following = []
            for at, rows, low, high in level:
                value[at] = RATE * float(np.clip(gradient[rows].sum() / (curve[rows].sum() + LEAF_WEIGHT), low, high))
                best = _best_split(binned, cuts, gradient, curve, rows, constraints, low, high) if depth < DEPTH else None
                if best:
                    f, cut, a, b = best
                    goes = binned[f, rows] > cut
                    feature[at], split[at], left[at] = f, float(cuts[f][cut]), node(0.0)
                    node(0.0)
                    middle = (a + b) / 2
                    bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[constraints[f]]
                    following += [(left[at], rows[~goes], *bounds[0]), (left[at] + 1, rows[goes], *bounds[1])]
                else:
                    total[rows] += value[at]
            level = following
    return Trees(np.array(roots), np.array(feature), np.array(split), np.array(left), np.array(value), bias)


def _best_split(binned, cuts, gradient, curve, rows, constraints, low, high):
    """(feature, cut, left value, right value) of the largest gain, or None."""
    g, h = gradient[rows], curve[rows]
    best, found = 1e-3, None
    whole = g.sum() ** 2 / (h.sum() + LEAF_WEIGHT)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        gl = np.cumsum(np.bincount(binned[f, rows], g, len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[f, rows], h, len(c) + 1))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        a, b = (np.clip(s / (t + LEAF_WEIGHT), low, high) for s, t in ((gl, hl), (gr, hr)))
        gain = 2 * a * gl - a**2 * (hl + LEAF_WEIGHT) + 2 * b * gr - b**2 * (hr + LEAF_WEIGHT) - whole
        gain[(hl < 0.5) | (hr < 0.5) | ((b - a) * constraints[f] < 0)] = -1
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (f, k, a[k], b[k])
    return found


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Trees:
    """Learn from at most 2 * `per_class` labelled documents outside the held-out fifth."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t)[1] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), batch.column("weight"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "weight", "x"])

    rows = labelled_sample(docs, labels, label, per_class, [0, 1]).select("doc_id", "label", "weight", "text").mapInArrow(run, "doc_id long, label int, weight double, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return boost(x, rows["label"].to_numpy().astype(float), rows["weight"].to_numpy(), list(FEATURES.values()))


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base statistics, the base rule's and the trees' verdict for each row of docs."""
    trees = fit(docs, labels)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = [statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            base, x = np.array([b for b, _ in made], np.int64), np.array([v for _, v in made])
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED * base[:, 0])
            score = trees.score(x)
            columns = [batch.column("doc_id").cast(pa.int64()), *map(pa.array, base.T.copy()), pa.array(failed), pa.array(~failed & (score >= KEEP)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FIELDS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS)
