"""Items at the accepted share of edits, and short items and documents."""

import inspect

import numpy as np

from riskbench.llm import decontaminate


def test_items_at_twenty_percent_edits_and_short_ones(spark):
    rng = np.random.default_rng(5)
    default = {k: p.default for k, p in inspect.signature(decontaminate.find_leaks).parameters.items()}
    word = lambda: "w%d" % rng.integers(1 << 40)
    items = [(k, " ".join(word() for _ in range(20))) for k in range(200)]
    bench = decontaminate.Benchmark(items, default["edits"], default["design"], default["recall"])
    hashes, docs = decontaminate.WordHashes(), []
    for _, text in items:
        w = text.split()
        for at in rng.choice(20, 4, replace=False):
            w[at] = word()
        docs.append(hashes.of([word() for _ in range(int(rng.integers(30)))] + w + [word() for _ in range(20)]))
    found = {(d, k) for d, k, *_ in bench.leaks(docs)}
    assert np.mean([(k, k) in found for k in range(len(items))]) >= 0.97

    table = spark.createDataFrame([(1, "one two three four five"), (2, "red green blue"), (3, "...")], "item_id long, text string")
    rows = [(10, "one two four five"), (11, "a red green blue b red green blue"), (12, "red green"), (13, None), (14, "two one three four")]
    got = {(r["doc_id"], r["item_id"], r["n_edits"], r["start"], r["end"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert got == {(10, 1, 1, 0, 17), (11, 2, 0, 2, 16)}


def test_rare_words_leave_out_no_match():
    """Whatever is found without the bound on rare words is found with it, for edited items in long texts."""
    rng = np.random.default_rng(9)
    common, rare = [f"c{k}" for k in range(40)], [f"r{k}" for k in range(400)]
    draw = lambda n, share: [str(rng.choice(rare if rng.random() < share else common)) for _ in range(n)]
    items = [(k, " ".join(draw(int(rng.integers(5, 45)), 0.4))) for k in range(60)] + [(100, "c1 c2 " * 8), (101, "c1 " * 12)]
    docs = []
    for k in range(300):
        w = items[k % len(items)][1].split()
        for _ in range(int(rng.integers(0, int(0.2 * len(w)) + 1))):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + 1] = [[], ["zz"], [w[at], "yy"]][kind]
        docs.append(" ".join(draw(int(rng.integers(0, 90)), 0.02) + w + draw(int(rng.integers(0, 90)), 0.02)))
    bench = decontaminate.Benchmark(items, 0.2, 0.2, 0.99)
    hashes = decontaminate.WordHashes()
    words = [hashes.of(d.split()) for d in docs]
    bounded = bench.leaks(words)
    kept = [(c.need, int(c.marked.sum())) for c in bench.classes]
    assert any(need for need, _ in kept) and any(not need or need < decontaminate.MARKED for need, _ in kept)
    for c in bench.classes:
        c.need = 0
    assert bounded == bench.leaks(words) and len({d for d, *_ in bounded}) > 290
