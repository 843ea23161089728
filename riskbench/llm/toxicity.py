"""Toxicity by a factorization machine over hashed terms.

The score of a set of terms is ``bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j``: an insult and a mention of a group can weigh
together what neither weighs alone. Linear weights are learnt with an L1 penalty, so most terms of long texts weigh nothing;
only terms that keep a weight, or meet often enough with one that does, get factors.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches, shared, texts
from .quality import bounded_sample, labelled, remainder

BITS = 20
WORD = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Buckets of lower-case words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        k = zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - BITS)
        if len(self) < 400_000:
            self[word] = k
        return k

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text in order, and the value of each: 1 plus the logarithm of its count."""
        k, n = np.unique(np.fromiter(map(self.__getitem__, WORD.findall(text.lower())), np.int32), return_counts=True)
        return k, (1 + np.log2(n)).astype(np.float32)


@dataclass
class Rows:
    """Sparse rows end to end: bucket and value of every entry, and where each row begins."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray  # one more than rows

    @staticmethod
    def of(pairs: list) -> Rows:
        sizes = [len(k) for k, _ in pairs]
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0)]).astype(kind)
        return Rows(join((k for k, _ in pairs), np.int64), join((v for _, v in pairs), float), np.append(0, np.cumsum(sizes)).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def where(self, keep: np.ndarray) -> Rows:
        counts = np.bincount(self.owner[keep], minlength=len(self))
        return Rows(self.keys[keep], self.values[keep], np.append(0, np.cumsum(counts)))

    def take(self, pick: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[pick]
        starts = np.append(0, np.cumsum(sizes))
        at = np.repeat(self.starts[pick] - starts[:-1], sizes) + np.arange(starts[-1])
        return Rows(self.keys[at], self.values[at], starts)


@dataclass
class Machine:
    bias: float
    w: np.ndarray  # by bucket
    slot: np.ndarray  # by bucket: row of v, or -1
    v: np.ndarray

    def raw(self, rows: Rows) -> np.ndarray:
        owner, at = rows.owner, self.slot[rows.keys]
        total = self.bias + np.bincount(owner, self.w[rows.keys] * rows.values, len(rows))
        has = at >= 0
        v, own = self.v[at[has]] * rows.values[has][:, None], owner[has]
        for k in range(v.shape[1]):
            total += 0.5 * (np.bincount(own, v[:, k], len(rows)) ** 2 - np.bincount(own, v[:, k] ** 2, len(rows)))
        return total

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -500, 500)))


def train(rows: Rows, y: np.ndarray, factors: int = 4, epochs: int = 12, l1: float = 4.0, l2: float = 0.01, rate: float = 1.0, least: int = 8, batch: int = 128) -> Machine:
    """Follow-the-regularised-leader for bias and linear weights, then AdaGrad for the factors of the terms that count.

    Terms in fewer than ``least`` rows are left out: they could only be learnt by heart.
    """
    size, rng = 1 << BITS, np.random.default_rng(7)
    model = Machine(0.0, np.zeros(size), np.full(size, -1, np.int64), np.zeros((0, factors)))
    if not len(rows) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        model.bias = float(np.log(p / (1 - p)))
        return model
    seen = np.bincount(rows.keys, minlength=size)
    rows = rows.where(seen[rows.keys] >= least)
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last entry is the bias, without L1

    def weights(k):
        shrunk = np.sign(z[k]) * np.maximum(np.abs(z[k]) - np.where(k == size, 0, l1), 0)
        return -shrunk / ((1 + np.sqrt(n[k])) / rate + l2)

    def batches():
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            yield rows.take(order[a : a + batch]), y[order[a : a + batch]]

    for _ in range(epochs):
        for x, t in batches():
            owner = x.owner
            keys, back = np.unique(np.append(x.keys, size), return_inverse=True)
            w = weights(keys)
            g = 1 / (1 + np.exp(-(np.bincount(owner, w[back[:-1]] * x.values, len(t)) + w[-1]))) - t
            grad = np.bincount(back, np.append(g[owner] * x.values, g.sum()), len(keys))
            step = (np.sqrt(n[keys] + grad**2) - np.sqrt(n[keys])) / rate
            z[keys] += grad - step * w
            n[keys] += grad**2
    every = weights(np.arange(size + 1))
    model.w, model.bias = every[:-1], float(every[-1])
    # Terms with factors: those with a weight, and those that positive rows hold more often than by chance.
    positive = np.bincount(rows.keys[(y >= 0.5)[rows.owner]], minlength=size)
    chosen = np.flatnonzero((seen >= least) & ((model.w != 0) | (positive > 2 * seen * y.mean())))
    model.slot[chosen] = np.arange(len(chosen))
    model.v = rng.normal(0, 0.05, (len(chosen), factors))
    squares = np.full(model.v.shape, 1e-6)
    for _ in range(epochs):
        for x, t in batches():
            g = model.score(x) - t
            x = x.where(model.slot[x.keys] >= 0)
            if not len(x.keys):
                continue
            owner, at = x.owner, model.slot[x.keys]
            v = model.v[at] * x.values[:, None]
            sums = np.stack([np.bincount(owner, v[:, k], len(t)) for k in range(factors)], 1)
            per = (g[owner] * x.values)[:, None] * (sums[owner] - v)
            keys, back = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(back, per[:, k], len(keys)) for k in range(factors)], 1) + 0.05 * model.v[keys]
            squares[keys] += grad**2
            model.v[keys] -= 0.02 * grad / np.sqrt(squares[keys])
    return model


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, terms, counts): the hashed terms of every text and their values."""

    def make():
        terms = Terms()

        def step(b):
            got = [terms.of(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "terms": [k for k, _ in got], "counts": [v for _, v in got]}

        return step

    return map_batches(texts(docs), make, "doc_id long, terms array<int>, counts array<float>")


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = 20_000) -> Machine:
    """A machine trained on at most ``most`` labelled rows, chosen before their texts are read into terms."""
    chosen = bounded_sample(labelled(labels, label, allowed), most)
    rows = hashed(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(chosen, "doc_id")
    got = rows.select("doc_id", "y", "terms", "counts").toArrow()  # packed: lists of numbers take ten times the room
    flat = lambda name: got[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(got["terms"]).to_numpy(zero_copy_only=False).astype(np.int64) if len(got) else np.zeros(0, np.int64)
    sparse = Rows(flat("terms").astype(np.int64), flat("counts").astype(float), np.append(0, np.cumsum(sizes)))
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    return train(sparse.take(order), got["y"].to_numpy().astype(float)[order])


def classify(docs: DataFrame, labels: DataFrame, most: int = 20_000, threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted for every row of ``docs``.

    Labels are learnt only from rows whose crc32(doc_id) modulo ``folds`` is not ``held``. A null or empty text has no terms and
    gets the score of the bias; a null doc_id stays null and is not held out; repeated rows get a row each; without labels, or
    with one kind only, all scores are the same; other columns are ignored; an empty table gives an empty table.
    """
    model = shared(docs.sparkSession, fit(docs.select("doc_id", "text"), labels, "toxic", remainder("doc_id", folds) != held, most))

    def make():
        terms = Terms()
        return lambda b: {"doc_id": b["doc_id"], "score": model.value.score(Rows.of([terms.of(t) for t in b["text"]]))}

    scored = map_batches(texts(docs), make, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
