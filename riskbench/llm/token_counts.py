"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie end to end in one ragged array of symbol ids. In every round each pre-token finds the lowest rank
among its neighbouring pairs and all pairs of that rank in it merge at once; finished pre-tokens leave the array. What
survives is counted. A pair can only be learned after its parts, so merging all of one rank at once gives what merging them
one by one gives; the loader checks that property of the file.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, shared, texts

NONE = np.int64(1 << 60)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Ranks:
    """Vocabulary and merges of a byte-level tokenizer file, as arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.size = len(vocab)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if a + b in made or made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError(f"merge {rank} repeats or precedes its parts; this file needs one-by-one merging")
            made[a + b] = rank
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = "|".join(map(regex.escape, special))

    def count(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        left = sizes.copy()
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.append(starts, len(symbols)))
            hit = (rank == np.repeat(lowest, spans)) & (rank < NONE)
            # Of overlapping pairs (a a a) every second one merges, from the left.
            place = np.arange(len(hit))
            begun = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - begun) % 2 == 0
            if not hit.any():
                break
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            gone = np.append(False, hit[:-1])
            left -= np.bincount(owner[gone], minlength=len(left))
            keep = ~gone & np.repeat(lowest < NONE, spans)
            symbols, owner = symbols[keep], owner[keep]
        return left


def counter(ranks: Ranks, remember: int = 300_000):
    """A function from texts to their numbers of tokens. ``remember`` pre-tokens are kept; the rest are merged anew."""
    import unicodedata

    find = regex.compile(ranks.pattern).findall
    blank = regex.compile(r"\p{White_Space}+")
    special = regex.compile(ranks.special) if ranks.special else None
    known: dict[str, int] = {}

    def words_of(text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        text = blank.sub(" ", text) if not text.isascii() else text
        # Lower case letter by letter: the final sigma has no rule of its own.
        return find(text.replace("Σ", "σ").lower())

    def count(batch: list[str]) -> list[int]:
        per_text, extra = [], []
        for text in batch:
            parts = special.split(text) if special and "<" in text else [text]
            extra.append(len(parts) - 1)
            per_text.append([w for p in parts for w in words_of(p)] if len(parts) > 1 else words_of(parts[0]))
        fresh = list({w for words in per_text for w in words if w not in known})
        new = dict(zip(fresh, ranks.count(fresh).tolist())) if fresh else {}
        if len(known) + len(new) > remember:
            both = known | new
            known.clear()
        else:
            known.update(new)
            both = known
        return [sum(map(both.__getitem__, words)) + n for words, n in zip(per_text, extra)]

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    Special strings inside a text count as one token each. A null text is empty and has no tokens; a null doc_id stays null;
    repeated rows are counted each; other columns are ignored; an empty table gives an empty table.
    """
    ranks = shared(docs.sparkSession, Ranks(tokenizer))

    def make():
        count = counter(ranks.value)

        def step(b):
            return {"doc_id": b["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in b["text"]], "n_tokens": count(b["text"])}

        return step

    counted = map_batches(texts(docs), make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
