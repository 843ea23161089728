"""The operators against brute force, libraries and SQL, on the smallest tables and on awkward rows."""

import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF  # noqa: E402
from oracle import compare, connect  # noqa: E402

from riskbench.llm import (  # noqa: E402
    chat_format, decontaminate, embedding_dedup, licenses, ngram_join, personal_data, quality, queries, sentence_pieces, token_counts, toxicity,
)
from riskbench.llm.components import connected  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, set_key string, code string, terms string"
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (6, "a" * 3000), (7, "w " * 4000), (None, "one two three four five six"),
    (8, "one two three four five six"), (8, "one two three four five six"), (9, "Ünï ▁ 日本語 😀 <|endoftext|> 's Σς\x85\x00"), (10, "x@y.zz 1.2.3.4 +1 (555) 123-4567 4111 1111 1111 1111"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z") for i, t in rows], DOCS)


def texts_of(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF) is None


def test_token_counts_as_the_library(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = texts_of(spark) + ODD
    got = token_counts.token_counts(docs_of(spark, rows), path, limit=500).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["over_limit"] == (r["n_tokens"] > 500) for r in got)
    assert token_counts.token_counts(docs_of(spark, []), path).count() == 0


def test_pieces_as_the_library(spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    letters = list("abcthe  \n\t▁'!.,é日本ab01😀") + ["   ", "the", " the"]
    rows = texts_of(spark)[:60] + [r for r in ODD if r[0]] + [(1000 + k, "".join(rng.choice(letters) for _ in range(40))) for k in range(200)]
    coded = sentence_pieces.encode(docs_of(spark, rows), path)
    got = sorted((r["doc_id"], list(r["ids"])) for r in coded.collect())
    assert got == sorted((i, library.encode(t or "")) for i, t in rows)
    back = sorted((r["doc_id"], r["text"]) for r in sentence_pieces.decode(coded, path).collect())
    assert back == sorted((i, library.decode(library.encode(t or ""))) for i, t in rows)
    checked = sentence_pieces.check_round_trip(docs_of(spark, rows), path).collect()
    assert all(r["round_trip"] for r in checked if r["doc_id"] < 9)


def test_unigram_path_is_the_cheapest():
    m = object.__new__(sentence_pieces.Machines)
    m.unigram, m.ids, m.score = True, {"a": 0, "b": 1, "ab": 2, "aba": 3}, {"a": -1.0, "b": -1.0, "ab": -1.5, "aba": -4.0}
    m.longest, m.unknown, m.byte_ids, m.unk = 3, 20.0, {}, 9
    assert m.shortest_path("aba") == [2, 0] and m.shortest_path("axb") == [0, 9, 1]


def test_chat_blocks_merge_and_read_back(spark):
    rows = [
        (1, 0, "user", "<|im_end|>\n\\<|im_sep|>"), (1, 1, "user", ""), (1, 2, "assistant", "ok\\"), (1, 3, "assistant", "<"), (1, 4, None, None),
        (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, None, "user", "a"), (None, 0, "user", "x"),
    ]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat_format.digest(out).collect()}
    one = "user\n<|im_end|>\n\\<|im_sep|>\nuser\n\nassistant\nok\\\nassistant\n<\n\n\n"
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == hashlib.sha256(one.encode()).hexdigest()
    assert got[1]["loss_chars"] == 4 and got[1]["loss_sha256"] == hashlib.sha256(b"ok\\<").hexdigest()
    assert got[2]["n_turns"] == 3 and got[2]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    text = {r["conv_id"]: r["formatted"] for r in out.collect()}
    assert text[2].count("<|im_start|>") == 2 and got[None]["n_turns"] == 1


def test_licenses_inherit_from_the_nearest_directory(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (3, "a/b/c/x", "no words"), (4, "a/x", None),
        (5, "d/x", "no"), (6, "a/b/y", "x\nLicensed under the Apache License, Version 2.0.\n" + "word " * 50), (7, None, ""), (7, None, ""),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    by = {r["doc_id"]: (r["licence"], r["inherited_from"]) for r in got}
    assert by[3] == ("CC-BY-NC-4.0", "a/b") and by[4] == ("MIT", "a") and by[5] == (None, None) and by[6] == ("Apache-2.0", None)
    assert len(got) == 8
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def naive_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_findings_as_the_patterns(spark):
    rng = random.Random(5)
    pool = ["@", ".", "-", "+", "1", "23", "255", "0004", "a", "b@c.d", " ", "(5)", "4111111111111111", "x.y", "١"]
    rows = texts_of(spark) + ODD + [(5000 + k, "".join(rng.choice(pool) for _ in range(30))) for k in range(400)]
    got = {(r["doc_id"], r["base"]) for r in personal_data.find_base(docs_of(spark, rows)).collect()}
    assert got == {(i, ",".join(f"{k}:{a}:{b}" for k, a, b in naive_spans(t or ""))) for i, t in rows}


def test_terms_that_reveal_are_added_and_rewritten(spark):
    filler = [(100 + k, f"common words mail here number {'abcdefghij'[k % 10] * 4} alone") for k in range(40)]
    rows = [(50 + k, "common zyxware mail ann@site.org here") for k in range(4)] + filler
    rows += [(60 + k, "common bbbware cccware mail bob@site.org here") for k in range(4)]
    found = {r["doc_id"]: r for r in personal_data.find(docs_of(spark, rows)).collect()}
    assert found[50]["spans"] == "email:20:32,term:7:14" and found[50]["n_email"] == 1 and found[100]["spans"] == ""
    out = {r["doc_id"]: r for r in personal_data.sanitise(docs_of(spark, rows + ODD)).collect()}
    assert out[50]["text"] == "common  mail <email> here" and out[60]["text"] == "common   mail <email> here"
    assert "@" not in out[10]["text"] and out[1]["text"] is None and out[2]["text"] == "" and out[100]["text"] == filler[0][1]
    assert personal_data.find(docs_of(spark, [])).count() == 0


def test_decontamination_against_every_window(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([6, 12, 20, 33, 60])] + [(90, None), (91, "two words")]
    rows = []
    for k, t in items[:5]:
        for e in (0, 0.1):
            w = t.split()
            for _ in range(int(e * len(w))):
                w[rng.randrange(len(w))] = word()
            for at in (0, 13, 47):
                rows.append((len(rows), " ".join([word() for _ in range(at)] + w + [word() for _ in range(30)])))
    rows += [(900 + k, " ".join(word() for _ in range(80))) for k in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_of(spark, rows + [(None, items[2][1]), (950, None)]), bench).collect()}
    want = {(d, d // 6) for d in range(30)}
    assert (None, 2) in got and got - {(None, 2)} <= want and len(want & got) >= 0.95 * len(want)
    assert {(d, i) for d, i in want if d % 6 < 3} <= got  # exact copies
    kept = decontaminate.clean(docs_of(spark, rows), decontaminate.find_leaks(docs_of(spark, rows), bench))
    assert {r["doc_id"] for r in kept.collect()} >= {900 + k for k in range(30)}
    assert decontaminate.find_leaks(docs_of(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_edit_distance_of_the_best_stretch():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, region = rng.integers(0, 4, 6).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)

        def distance(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row, before = [i], row
                for j, y in enumerate(b, 1):
                    row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            return row[-1]

        edits, start, end = decontaminate.best_match(item, region)
        assert edits == min(distance(item, region[a:b]) for a in range(13) for b in range(a, 13)) == distance(item, region[start:end])


def brute_components(rows):
    sets, least = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                least[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("many", [3, 1000])
def test_ngram_join_against_all_pairs(spark, monkeypatch, many):
    monkeypatch.setattr(ngram_join, "MANY", many)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = list(ODD)
    for k in range(40):  # near copies of one text, a chain, and texts that share a passage
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(60)] = f"v{rng.randrange(9)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, " ".join(f"c{j}" for j in range(k, k + 30))) for k in range(0, 60, 3)]
    rows += [(300 + k, " ".join(base[:30] + [f"u{k}_{j}" for j in range(5 + k)])) for k in range(15)]
    got = ngram_join.components(docs_of(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert ngram_join.components(docs_of(spark, [])).count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (ngram_join.unpack(ngram_join.pack(x)) == x).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected(edges).collect()} == {**{k: 1 for k in range(1, 41)}, 90: 90, 100: 90}


@pytest.mark.parametrize("block", [16, 1024])
def test_embeddings_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([c + rng.normal(0, 0.12, (n, 16)) for c, n in zip(centres, (60, 30, 9, 5, 3, 2, 1, 1))] + [rng.normal(size=(60, 16))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, rows[0][1]), (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 3, 7) for i, v in rows], "vec_id long, embedding array<double>, n long, copies int")
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(table, leaf=40).collect()}
    v = np.vstack([x, x[0]])
    ids = [*range(len(x)), 1000]
    v = v / np.linalg.norm(v, axis=1)[:, None]
    links = v @ v.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i]["n_links"] for i in ids)
    assert all(got[i]["n_links"] <= n for i, n in zip(ids, links.sum(1))) and found >= 0.9 * links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(1001, 1006)) and got[None]["component_id"] is None
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    assert embedding_dedup.dedup(table.limit(0)).count() == 0


@pytest.mark.parametrize("module, label, of, held", [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_classifiers_on_held_out_rows(spark, module, label, of, held):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = module.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % of == held for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    good, bad = out[out[label] == 1]["score"], out[out[label] == 0]["score"]
    assert np.mean([a > b for a in good for b in bad]) > (0.95 if label == "quality" else 0.75)
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all() and got["score"].between(0, 1).all()


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, module, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.classify(docs_of(spark, ODD), none).collect()
    assert len(got) == len(ODD) and len({r["score"] for r in got}) == 1
    some = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (4, None, None), (6, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.classify(docs_of(spark, ODD), some).count() == len(ODD)
    assert module.classify(docs_of(spark, []), some).count() == 0


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(0)
    pairs, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        keys = np.unique(np.append(rng.integers(100, 400, 8), ([1] if a else []) + ([2] if b else [])).astype(np.int64))
        pairs.append((keys, np.ones(len(keys))))
        y.append(float(a == b))
    model = toxicity.train(toxicity.Rows.of(pairs), np.array(y), l1=1.0, epochs=30)
    score = model.score(toxicity.Rows.of(pairs))
    assert ((score > 0.5) == (np.array(y) > 0.5)).mean() > 0.9


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    model = quality.boost(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    accepted = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"] == 1}
    first = pipeline.good_quality(spark, docs, SF)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == accepted
    second = pipeline.one_of_each_group(spark, first, SF)
    want = brute_components([(i, before[i]) for i in accepted])
    assert {r["doc_id"] for r in second.collect()} == set(want.values())
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i in want.values() if any(x in " ".join(re.findall(r"\w+", before[i].lower())) for x in items)}
    third = {r["doc_id"] for r in pipeline.without_benchmark(spark, second, SF).collect()}
    assert not third & holds and len(third) >= len(set(want.values())) - len(holds) - 2
    last = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in last} == third and all(len(r["ids"]) == r["n_ids"] for r in last)
    clean = pipeline.without_personal_data(spark, docs, SF)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert not naive_spans(r["text"]) or "<" in r["text"]
