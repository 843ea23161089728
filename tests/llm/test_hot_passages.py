"""The n-gram join where most documents consist of a few passages that many share."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import brute_components, docs_of  # noqa: E402

from riskbench.llm import ngram_join  # noqa: E402


def shared_passages(seed, n):
    """Texts of one to three passages, cut short, with own words before, between or behind, and some edits."""
    rng = random.Random(seed)
    passages = [[f"p{p}_{k}" for k in range(size)] for p, size in enumerate((40, 40, 24, 12, 60))]
    passages.append(passages[0][:30] + passages[1][:10])  # shares most of its shingles with the first
    rows = []
    for k in range(n):
        w = []
        for p in rng.sample(range(len(passages)), rng.choice((1, 1, 1, 2, 3))) if k % 3 else [0]:
            part = passages[p][: len(passages[p]) - rng.choice((0, 0, 0, 1, 5))]
            w += part + [f"o{k}_{j}" for j in range(rng.choice((0, 0, 2, 6, 9, 12)))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            w[rng.randrange(len(w))] = f"e{rng.randrange(4)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed, many", [(0, 3), (1, 8), (2, 2)])
def test_passages_that_many_share(spark, monkeypatch, seed, many):
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "STAR_TURNS", seed)  # with fewer turns, more is left to the groups of frequent parts
    rows = shared_passages(seed, 260)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs_of(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_pairs_left_under_one_passage(spark, monkeypatch):
    """A passage in a third of all rows, each with words of its own, leaves no pairs to compare."""
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(k, passage + " " + " ".join(f"o{k}_{j}" for j in range(15))) for k in range(150)]
    rows += [(1000 + k, " ".join(f"x{k}_{j}" for j in range(65))) for k in range(300)]
    sizes, made = [], ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda docs, pairs, *rest: (sizes.append(pairs.count()), made(docs, pairs, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs_of(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows} and sum(sizes) <= 10
