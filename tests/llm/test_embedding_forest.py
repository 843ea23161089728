"""Recall of the registered forest on a loose cluster of many leaves."""

import inspect

import numpy as np

from riskbench.llm import embedding_dedup


def test_registered_forest_finds_links_of_a_big_loose_cluster():
    default = {k: p.default for k, p in inspect.signature(embedding_dedup.dedup).parameters.items()}
    rng = np.random.default_rng(1)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    x = np.concatenate([rng.normal(size=(4000, 64)), centre + rng.normal(0, 0.0396, (12000, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = embedding_dedup.Forest(x, len(x), default["trees"], default["leaf"], default["spill"], default["threshold"])
    sets = [{(t, n) for t, own in enumerate(per_tree) for n in own} for per_tree in forest.leaves(x)]
    queries = np.arange(4000, 16000, 120)
    links = x[queries] @ x.T >= default["threshold"]
    links[np.arange(len(queries)), queries] = False
    found = [not sets[q].isdisjoint(sets[o]) for q, row in zip(queries.tolist(), links) for o in np.flatnonzero(row).tolist()]
    assert len(found) > 200_000 and np.mean(found) >= 0.99


def test_forest_needs_little_memory_beside_its_sample():
    """Every query has two hundred links: their vectors are not copied, and small leaves do not fill the trees with copies."""
    import tracemalloc

    rng = np.random.default_rng(2)
    centre = rng.normal(size=(10, 64))
    x = np.repeat(centre / np.linalg.norm(centre, axis=1, keepdims=True), 300, axis=0) + rng.normal(0, 0.02, (3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    forest = embedding_dedup.Forest(x, 300 * len(x), trees=2, leaf=1000, spill=0.02)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    per_tree = np.array([[len(own) for own in per_tree] for per_tree in forest.leaves(x)]).mean(0)
    assert per_tree.max() <= embedding_dedup.COPIES + 1e-9
