"""Mixing, fill-in-the-middle and target resampling against brute force and on awkward rows."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF  # noqa: E402

from riskbench.llm import fill_in_middle, mixing, queries, target_resampling  # noqa: E402

CLASHING = "doc_id long, text string, source string, size long, copies long, tie string, slice long, score long, rank long, form string, output string"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two "), (6, "a" * 9000), (7, " w" * 9000), (None, "one two  three"), (None, None), (8, "x y"),
    (8, "x y"), (9, "Ünï ▁ 日本語 😀 Σς\x85\x00 B2b"), (10, "has <M> inside"), (11, "< P> <P <S\t>>"), (12, "日本" * 3000 + " 語"), (13, "\x0b\x0c end\r\n"),
]


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 7, "t", 7, 7, 7, "f", "o") for i, t, s in rows], CLASHING)


def many(n, sources=("a", "b", None, "é", "😀")):
    return [(k, " ".join(["w"] * (1 + (k * k) % 97)), sources[0] if k % 3 == 0 else sources[k % len(sources)]) for k in range(n)]


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values()) * percent / 100
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("percent, most", [(150, 2), (30, 2), (199, 2), (250, 3)])
def test_mix_meets_targets(spark, monkeypatch, percent, most):
    monkeypatch.setattr(mixing, "PER_SLICE", 4)  # nearly every size is cut into slices
    rows = many(900)
    got = mixing.plan(table_of(spark, rows), percent=percent, most=most).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    source, sizes, longest = {i: s for i, _, s in rows}, Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
        longest[s] = max(longest[s], len(t.split()))
    want, taken = brute_targets(sizes, percent=percent, most=most), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-12)
        assert r["taken"] == r["copies"] * r["size"] <= most * r["size"]
        # Equal expectations: copies are the expectation rounded down or up.
        assert abs(r["copies"] - want[s] / sizes[s]) < 1
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * longest[s] for s in want)
    assert sorted(got) == sorted(mixing.plan(table_of(spark, rows[::-1]).repartition(7), percent=percent, most=most).collect())


def test_mix_prefix_sums_by_hand(spark, monkeypatch):
    """Copies are the integers that offset plus summed expectations cross, in the order of size and hash."""
    rows = many(300)
    got = {}
    for per_slice in (1, 7, 1 << 16):
        monkeypatch.setattr(mixing, "PER_SLICE", per_slice)
        got[per_slice] = sorted(mixing.plan(table_of(spark, rows)).collect())
    assert got[1] == got[7] == got[1 << 16]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    stated = {r["doc_id"]: r for r in got[7]}
    for s in {s for _, _, s in rows}:
        mine = sorted((len(t.split()), md5(f"11:{i}:{md5(t)}"), i) for i, t, x in rows if x == s)
        at = int(md5("11:offset" + ("" if s is None else f":{s}"))[:6], 16)
        for _, _, i in mine:
            r = stated[i]
            unit = math.floor(r["target"] / r["source_size"] * 2**24 + 0.5)
            assert r["copies"] == (at + unit) // 2**24 - at // 2**24
            at += unit


def test_mix_emits_rows(spark):
    rows = many(200) + [(i, t, "odd") for i, t in ODD]
    docs = table_of(spark, rows)
    copies = Counter()
    for r in mixing.plan(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +copies


def test_mix_odd_rows(spark):
    got = mixing.plan(table_of(spark, [(i, t, None) for i, t in ODD] + [(50, " ", "blank"), (51, None, "blank")])).collect()
    assert len(got) == len(ODD) + 2
    assert all(r["target"] == 0 and r["taken"] == 0 for r in got if r["doc_id"] in (50, 51))
    assert {r["size"] for r in got if r["doc_id"] == 7} == {9000}
    assert mixing.plan(table_of(spark, [])).count() == 0 and mixing.mix(table_of(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.plan(table_of(spark, [(1, None, None), (2, "", "s")])).collect()} == {0}


# Fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_middle_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    monkeypatch.setattr(fill_in_middle, "SCAN", 5 * block)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()] if block > 1 else []
    seen = Counter()
    for k, text in enumerate(texts + [t for _, t in ODD] * 6):
        digest = hashlib.sha256(f"42:{k}".encode()).hexdigest()
        hashes = tuple(int(digest[8 * j : 8 * j + 8], 16) for j in range(4))
        n, form, before, inside, output = fill_in_middle.transform_one((text or "").encode(), hashes)
        assert (n, form, before, inside, output.decode()) == brute_middle(k, text)
        seen[form] += 1
    assert set(seen) == {"plain", "spm", "psm"}


def test_fenwick(spark):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 7, 8, 9, 100):
        counts = rng.integers(0, 4, (size, 2))
        tree = fill_in_middle.Fenwick(counts)
        sums = counts.cumsum(axis=0)
        assert (tree.total() == sums[-1]).all()
        for k in range(1, int(sums[-1, 0]) + 1):
            block, before = tree.descend(k)
            assert block == int(np.argmax(sums[:, 0] >= k))
            assert (before == sums[block] - counts[block]).all()


def test_middle_of_a_table(spark):
    rows = [(i, t, "s") for i, t in ODD] + [(k, t, None) for k in range(100, 160) for t in ("a b  c d\n", "< <P< é 😀")]
    out = fill_in_middle.transform(table_of(spark, rows))
    back = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted((tuple(r)[:6] for r in back), key=key)
    assert got == sorted(((i, *brute_middle(i, t)) for i, t, _ in rows), key=key)
    assert sorted((r["doc_id"] or 0, r["back"]) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert fill_in_middle.transform(table_of(spark, [])).count() == 0


def test_middle_with_other_marks(spark):
    marks = ("[a.b]", "(+)", "{$}")
    rows = [(k, "one two (three) [four] <P> five", None) for k in range(40)]
    out = fill_in_middle.transform(table_of(spark, rows), plain=100, marks=marks)
    back = out.select("form", fill_in_middle.restored(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert {r["back"] for r in back} == {rows[0][1]} and {r["form"] for r in back} == {"psm", "spm"}


# Target resampling


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resample(docs, target, percent=10, fewest=20, longest=1, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in docs:
        n, found = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= fewest), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_resampling_of_the_smallest_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op13_target_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(got.collect()) == ordered(brute_resample(docs, target))


@pytest.mark.parametrize("longest, buckets, percent, fewest, piece", [(1, 10000, 10, 20, 1 << 20), (3, 50, 37, 0, 8), (2, 7, 100, 1, 5), (1, 3, 50, 2, 1)])
def test_resampling_odd_rows(spark, monkeypatch, longest, buckets, percent, fewest, piece):
    monkeypatch.setattr(target_resampling, "PIECE", piece)
    docs = ODD + [(k, f"Word{k % 5} b c " * (k % 11)) for k in range(100, 300)]
    target = [None, "", "word1 B word2", "日本 語"]
    got = target_resampling.resample(
        table_of(spark, [(i, t, None) for i, t in docs]), spark.createDataFrame([(t, 1) for t in target], "text string, rank long"),
        percent=percent, fewest=fewest, longest=longest, buckets=buckets,
    )
    assert ordered(got.collect()) == ordered(brute_resample(docs, target, percent, fewest, longest, buckets))


def test_resampling_without_rows(spark):
    none = table_of(spark, [])
    assert target_resampling.resample(none, none).count() == 0
    few = target_resampling.resample(table_of(spark, [(1, "a b", None), (2, None, None)]), none).collect()
    assert [r["rank"] for r in few] == [None, None]


def test_cutoff_in_hot_values(spark, small_ranges):
    """Cutoffs inside large ties, at both ends, and where the sketch's bracket has to widen."""
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(3000, int), rng.integers(-50, 50, 3000), rng.integers(-(10**12), 10**12, 3000)])
    rows = spark.createDataFrame([(int(v),) for v in values], "v long")
    for k in (1, 2, 3000, 4500, 6000, 8999, 9000):
        want = int(np.sort(values)[k - 1])
        assert target_resampling.nth_smallest(rows, "v", k, 9000) == (want, int((values < want).sum()))


def test_draw_with_equal_scores(spark, small_ranges):
    rows = spark.createDataFrame([(k if k < 950 else None, 30, 30, 5, 7 if k % 2 else 9) for k in range(1000)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = [r for r in target_resampling.drawn(rows, percent=70).collect() if r["rank"]]
    want = sorted(((-9 if k % 2 == 0 else -7, k if k < 950 else 10**9) for k in range(1000)))[:700]
    assert [(-r["score"], 10**9 if r["doc_id"] is None else r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 701))
