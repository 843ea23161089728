"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every text are taken in one pass and written once. A bounded sample of labelled rows trains the trees on
binned statistics; the trees are flattened into arrays, and all rows of a batch walk down together, one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import WordHashes, map_batches, shared, shingles, texts

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_length", "longest_word", "upper", "digits", "blanks", "stops", "shouts", "marks",
    "bars", "non_ascii", "entropy", "distinct_words", "distinct_lines", "distinct_runs", "words_per_line", "short_words", "caps_words",
    "marked_words",
]
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:", b"!?", b"#$%&*@^~=+<>\\/_{}[]", b"|"], 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8


def statistics(text: str, hashes: WordHashes) -> list[float]:
    """The statistics of one text; all 0 for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=9) / len(raw)
    p = counts[counts > 0] / len(raw)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    n = len(words)
    runs = shingles(hashes.of(words), 5)
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), sizes.mean(), np.log1p(sizes.max()), *share[[1, 2, 3, 4, 5, 6, 7, 8]],
        -(p * np.log(p)).sum(), len(set(words)) / n, len(set(lines)) / len(lines), len(runs) / max(1, n - 4), n / len(lines),
        (sizes <= 3).mean(), sum(map(bytes.isupper, words)) / n, sum(w[-1:] in b"#$%&*!|@^~" for w in words) / n,
    ]


@dataclass
class Trees:
    """Boosted trees as arrays: node ``i`` sends a row left to ``2i + 1`` if its bin is at most ``cut[i]``, else to ``2i + 2``."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, n_bins: int = 64, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on binned columns. ``least``: smallest sum of second derivatives in a leaf."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins)[1:-1])) if n else np.zeros(1) for k in range(m)]
    rate_1 = (y.sum() + 1) / (n + 2)
    inner = 2**depth - 1
    model = Trees(edges, float(np.log(rate_1 / (1 - rate_1))), np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, inner + 1)), depth)
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    flat = b + np.arange(m) * n_bins
    f, features, cuts, values = np.full(n, model.base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, int), np.full(inner, n_bins), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (m * n_bins) + flat).ravel()
            hist = lambda v: np.bincount(at, np.repeat(v, m), width * m * n_bins).reshape(width, m, n_bins).cumsum(2)  # noqa: E731, B023
            gl, hl = hist(g), hist(h)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(good, best // n_bins, 0)
            cut[first : first + width] = np.where(good, best % n_bins, n_bins)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        sums = lambda v: np.bincount(leaf, v, inner + 1)  # noqa: E731, B023
        value = -rate * sums(g) / (sums(h) + l2)
        f += value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    model.feature, model.cut, model.value = np.array(features), np.array(cuts), np.array(values)
    return model


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(doc_id).cast("string")) % of


def labelled(labels: DataFrame, name: str, train: Column) -> DataFrame:
    """(doc_id, y) of the rows to learn from: the mean of a document's labels, without null labels and null ids."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("double").alias("y"))
    return rows.where(train).groupBy("doc_id").agg(F.avg("y").alias("y"))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of doc_id: the same rows wherever they lie."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""

    def make():
        hashes = WordHashes()
        return lambda b: {"doc_id": b["doc_id"], "x": [np.asarray(statistics(t, hashes), np.float32) for t in b["text"]]}

    return map_batches(texts(docs), make, "doc_id long, x array<float>")


def fit(measured: DataFrame, labels: DataFrame, label: str, train: Column, most: int = 20_000) -> Trees:
    """Trees trained on at most ``most`` labelled rows, which are all that comes to the driver."""
    rows = bounded_sample(measured.join(labelled(labels, label, train), "doc_id"), most).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return boost(x, rows["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, most: int = 20_000, threshold: float = 0.7, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted for every row of ``docs``.

    Labels are learnt only from rows whose crc32(doc_id) modulo ``folds`` is not ``held``. A null or empty text has statistics
    0 and gets the score of such texts; a null doc_id stays null and is not held out; repeated rows get a row each; without
    labels, or with one kind only, all scores are the same; other columns are ignored; an empty table gives an empty table.
    """
    measured = stored(measure(docs), "quality-statistics")
    model = shared(docs.sparkSession, fit(measured, labels, "quality", remainder("doc_id", folds) != held, most))

    def make():
        return lambda b: {"doc_id": b["doc_id"], "score": model.value.score(np.array(b["x"], float).reshape(-1, len(STATISTICS)))}

    scored = map_batches(measured, make, "doc_id long, score double", rows=4096)
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
