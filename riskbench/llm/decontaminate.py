"""Benchmark decontamination by CGK embedding and bit sampling.

Texts are word sequences. A CGK walk copies a window into a longer sequence: step j writes the word under the cursor and moves
on if a random bit of (j, word) says so. Two walks with the same bits meet again soon after an edit, so few edits give a small
Hamming distance. Bit-sampling LSH then looks at a few random steps: windows that agree there are candidates. The walk is
repeated with fresh bits until the wanted recall is reached, and each candidate is settled by its exact edit distance.

Windows are as long as items of a size class. A document starts one every ``stride`` words; an item is entered from its first
``stride`` offsets and its last ones, so one of them lies on a window wherever a passage begins. All items sit on every task,
``CHUNK`` items at a time: larger benchmarks take more passes.

Before the walks, an exact bound leaves out windows that cannot lie in a match: of an item's ``e + MARKED`` rarest distinct words,
``e`` edits remove at most ``e``, so the words around a window must hold ``MARKED`` words that are among the rarest of some item.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import U64, WordHashes, map_batches, mix, shared, texts

CHUNK = 20_000
WORD = re.compile(r"\w+")
FEWEST = 5  # items of fewer words are searched as they stand
MOST_WALKS = 1000
MARKED = 6  # rare words of an item that its edits must leave
SLICE = 2 << 20  # bytes of text that are searched together
TABLE = 1 << 20  # places of a table of rare words, by low bits


@dataclass
class Class:
    """Items of similar size: window and stride in words, walks as (seed, sampled steps), and what each sampled prefix may hold."""

    width: int
    stride: int
    walks: list[tuple[int, list[int]]] = field(default_factory=list)
    known: list[list[np.ndarray]] = field(default_factory=list)  # per walk and number of samples: sorted hashes of item windows
    owners: list[np.ndarray] = field(default_factory=list)  # per walk: (item, offset) of each full hash, in its order
    need: int = 0  # marked words around a window in a match, at least
    before: int = 0  # words that a match may begin before a window in it
    after: int = 0  # words that it may end behind the window's begin
    marked: np.ndarray = field(default=None, repr=False)  # by low bits of a word: whether it may be marked

    def possible(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Positions of the starts around which there are enough marked words for a match."""
        if not self.need:
            return np.arange(len(starts))
        upto = np.concatenate([[0], np.cumsum(self.marked[flat & U64(TABLE - 1)], dtype=np.int64)])
        here = upto[np.minimum(starts + self.after, len(flat))] - upto[np.maximum(starts - self.before, 0)]
        return np.flatnonzero(here >= self.need)


def walk(words: np.ndarray, starts: np.ndarray, seed: int, steps: list[int], known: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the sampled symbols of the CGK walks from ``starts``, and which starts they are of.

    With ``known``, walks are left as soon as no item has their samples so far. Needs room behind the last start.
    """
    at, alive, hashes, j = starts.copy(), np.arange(len(starts)), np.zeros(len(starts), U64), 0
    bits, few = None, len(starts) * 8 < len(words)  # the bits of all words at once, or of those under few cursors
    key = None
    for k, step in enumerate(steps):
        if not len(at):
            break
        while j < step:
            if key is None or j % 64 == 0:
                key = mix(np.array([seed * 1000 + j // 64], U64))
            if not few and (bits is None or j % 64 == 0):
                bits = mix(words ^ key)
            at += ((mix(words[at] ^ key) if few else bits[at]) >> U64(j % 64) & U64(1)).view(np.int64)
            j += 1
        with np.errstate(over="ignore"):
            hashes = mix(hashes * U64(31) + words[at])
        if known is not None:
            keep = present(hashes, known[k])
            at, alive, hashes = at[keep], alive[keep], hashes[keep]
    return hashes, alive


def member(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Position of each x in sorted distinct values, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def present(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Positions of the x that are among sorted distinct values. A small table of their low bits spares most searches."""
    low = np.zeros(1 << 16, bool)
    low[sorted_values & U64(0xFFFF)] = True
    some = np.flatnonzero(low[x & U64(0xFFFF)])
    return some[member(x[some], sorted_values) >= 0]


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end): the stretch of ``region`` with the smallest edit distance to ``item``, in words."""
    n = len(region)
    row, origin, ramp = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for i, w in enumerate(item, 1):
        diagonal, up = row[:-1] + (region != w), row[1:] + 1
        take = diagonal <= up
        best = np.append(i, np.where(take, diagonal, up))
        start = np.append(0, np.where(take, origin[:-1], origin[1:]))
        # Insertions along the row: the least of best[k] + (j - k) over k <= j.
        low = np.minimum.accumulate(best - ramp)
        new = np.append(True, low[1:] < low[:-1])
        source = np.maximum.accumulate(np.where(new, ramp, 0))
        row, origin = low + ramp, start[source]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


class Benchmark:
    """Items compiled into walk tables."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float, design: float, recall: float, samples: int = 4, seed: int = 1):
        hashes = WordHashes()
        rows = [(i, hashes.of(WORD.findall((t or "").lower()))) for i, t in items]
        self.items = [(i, w) for i, w in rows if len(w)]
        # Short items as they stand, and what is left of longer ones in a document of fewer than FEWEST words.
        self.short: dict[tuple[int, ...], list[int]] = {}
        self.left: dict[tuple[int, ...], list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < FEWEST:
                self.short.setdefault(tuple(w.tolist()), []).append(k)
            elif len(w) - int(edits * len(w)) < FEWEST:
                for rest in {x for n in range(len(w) - int(edits * len(w)), FEWEST) for x in combinations(w.tolist(), n)}:
                    self.left.setdefault(rest, []).append(k)
        self.lengths = sorted(set(map(len, self.short)))
        self.first_words = {x[0] for x in self.short}
        self.vocabulary = [set(w.tolist()) for _, w in self.items]
        self.held = Counter(w for v in self.vocabulary for w in v)
        self.edits, self.classes = edits, []
        self.longest = max((len(w) for _, w in self.items), default=0)
        rng, low = np.random.default_rng(seed), FEWEST
        while low <= self.longest:
            high = max(low + 1, int(low * 1.4))
            members = [k for k, (_, w) in enumerate(self.items) if low <= len(w) < high]
            # Items of few distinct words, which edits may all remove, are searched without a bound on rare words.
            for part in ([k for k in members if self._spare(k) >= MARKED], [k for k in members if self._spare(k) < MARKED]):
                if part:
                    self.classes.append(self._compile(low, part, design, recall, samples, rng))
                    self._mark(self.classes[-1], part, high)
            low = high

    def _spare(self, k: int) -> int:
        """Distinct words of an item beyond its edits."""
        return len(self.vocabulary[k]) - int(self.edits * len(self.items[k][1]))

    def _mark(self, c: Class, members: list[int], high: int) -> None:
        """The rarest words of the items of a class, by the number of items that hold them."""
        c.need = max(0, min(MARKED, *map(self._spare, members))) if len(members) > 1 else max(0, min(MARKED, self._spare(members[0])))
        most = int(self.edits * high)
        c.before, c.after = high - c.width + most + 1, high + most + 1
        c.marked = np.zeros(TABLE, bool)
        for k in members:
            rarest = sorted(self.vocabulary[k], key=lambda w: (self.held[w], w))[: int(self.edits * len(self.items[k][1])) + c.need]
            c.marked[np.array(rarest, U64) & U64(TABLE - 1)] = True

    def _compile(self, size: int, members: list[int], design: float, recall: float, samples: int, rng) -> Class:
        stride = max(1, size // 4)
        c = Class(size - stride + 1, stride)
        entries, windows = [], []
        for k in members:
            w = self.items[k][1]
            last = len(w) - c.width
            for offset in sorted({*range(min(stride, last + 1)), *range(max(0, last - stride + 1), last + 1)}):
                entries.append((k, offset))
                windows.append(w[offset : offset + c.width])
        flat = np.concatenate([np.append(w, np.zeros(c.width, U64)) for w in windows])
        starts = np.arange(len(windows)) * 2 * c.width
        missed = 1.0
        while missed > 1 - recall:
            if len(c.walks) == MOST_WALKS:
                raise ValueError(f"items of about {size} words: {MOST_WALKS} walks reach a recall of {1 - missed:.3f} at {design:.0%} edits, not {recall}")
            steps = sorted(rng.choice(int(1.5 * c.width), min(samples, c.width), replace=False).tolist())
            walk_seed = int(rng.integers(1 << 40))
            c.walks.append((walk_seed, steps))
            missed *= 1 - self._hit_rate(windows, design, walk_seed, steps, rng)
            prefix = [walk(flat, starts, walk_seed, steps[: n + 1])[0] for n in range(len(steps))]
            order = np.argsort(prefix[-1], kind="stable")
            c.known.append([*(np.unique(p) for p in prefix[:-1]), np.unique(prefix[-1])])
            full = prefix[-1][order]
            c.owners.append(np.array([(a, b, h) for (a, b), h in zip((entries[i] for i in order), full.tolist())], object))
        return c

    @staticmethod
    def _hit_rate(windows, design: float, seed: int, steps: list[int], rng, trials: int = 200) -> float:
        """How often a walk agrees for item windows and copies of them with a share ``design`` of edited words."""
        a, b, width = [], [], len(windows[0])
        for k in rng.integers(len(windows), size=trials):
            w = windows[k].tolist()
            a.append(w)
            x = list(w)
            for _ in range(max(1, round(design * width))):
                at, kind = int(rng.integers(len(x))), int(rng.integers(4))
                x[at : at + 1] = [int(rng.integers(1 << 62))] if kind < 2 else [] if kind == 2 and len(x) > 1 else [x[at], int(rng.integers(1 << 62))]
            b.append((x + rng.integers(1 << 62, size=width).tolist())[: 2 * width])
        pad = lambda rows: np.array([(r + [0] * (3 * width))[: 3 * width] for r in rows], U64).ravel()
        starts = np.arange(trials) * 3 * width
        return float((walk(pad(a), starts, seed, steps)[0] == walk(pad(b), starts, seed, steps)[0]).mean())

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int, int]]:
        """(document, item, word at which the item would begin) of all windows that agree with an item window."""
        room = np.zeros(3 * max((c.width for c in self.classes), default=1), U64)
        flat = np.concatenate([x for d in docs for x in (d, room)]) if docs else room
        begins = np.cumsum([0, *(len(d) + len(room) for d in docs)])[:-1]
        out = set()
        for c in self.classes:
            counts = [max(0, len(d) - c.width) // c.stride + 1 if len(d) >= FEWEST else 0 for d in docs]
            owner = np.repeat(np.arange(len(docs)), counts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum([0, *counts])[:-1], counts)
            starts = begins[owner] + nth * c.stride
            possible = c.possible(flat, starts)
            owner, starts = owner[possible], starts[possible]
            if not len(starts):
                continue
            for (seed, steps), known, owners in zip(c.walks, c.known, c.owners):
                hashes, alive = walk(flat, starts, seed, steps, known)
                if not len(hashes):
                    continue
                full = owners[:, 2].astype(U64)
                first, last = np.searchsorted(full, hashes, "left"), np.searchsorted(full, hashes, "right")
                for s, a, b in zip(alive.tolist(), first.tolist(), last.tolist()):
                    d = int(owner[s])
                    out.update((d, int(owners[x, 0]), int(starts[s] - begins[d]) - int(owners[x, 1])) for x in range(a, b))
        return out

    def _settle(self, docs: list[np.ndarray], best: dict, d: int, k: int, first: int, last: int) -> None:
        """Put the best match of item ``k`` in the region around begins ``first`` to ``last`` into ``best``, if it is close enough."""
        item, words = self.items[k][1], docs[d]
        most = int(self.edits * len(item))
        a, b = max(0, first - most - 1), min(len(words), last + len(item) + most + 1)
        region = words[a:b]
        # Every distinct word of the item that the region lacks costs an edit.
        if len(self.vocabulary[k].difference(region.tolist())) > most:
            return
        edits, start, end = best_match(item, region)
        if edits <= most:
            found = (edits, a + start, a + end)
            best[d, k] = min(best.get((d, k), found), found)

    def leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, first word, word after the last): the best verified match per pair."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, words in enumerate(docs):
            if len(words) < FEWEST:
                for k in self.left.get(tuple(words.tolist()), ()):
                    self._settle(docs, best, d, k, 0, 0)
            if self.short:
                own = words.tolist()
                for a in (a for a, w in enumerate(own) if w in self.first_words):
                    for n in self.lengths:
                        for k in self.short.get(tuple(own[a : a + n]), ()) if a + n <= len(own) else ():
                            best.setdefault((d, k), (0, a, a + n))
        before = None
        for d, k, begin in sorted(self.candidates(docs)):
            most = int(self.edits * len(self.items[k][1]))
            # Candidates of one item that begin close together are one region.
            if before and before[:2] == (d, k) and begin - before[3] <= most + 1:
                before = (d, k, before[2], begin)
                continue
            if before:
                self._settle(docs, best, *before)
            before = (d, k, begin, begin)
        if before:
            self._settle(docs, best, *before)
        return [(d, k, *v) for (d, k), v in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = 0.2, design: float = 0.2, recall: float = 0.99) -> DataFrame:
    """doc_id, item_id, n_edits, item_words, start and end (code points): every item that a document holds.

    An item is held if some stretch of the document is within ``edits`` times its words in edit distance; words are runs of
    letters, digits and underscores in lower case. Walks are repeated until an item with a share ``design`` of edits is found
    with probability ``recall``. Rows with null texts hold and give nothing; null ids stay null; repeated documents give a row
    each, repeated items too; items under five words are found as they stand; an item without words is none; other columns are ignored; an empty side gives no rows.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = max(1, -(-rows.count() // CHUNK))
    parts = []
    for chunk in range(chunks):
        items = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk) if chunks > 1 else rows
        compiled = Benchmark([tuple(r) for r in items.orderBy("item_id", "text").collect()], edits, design, recall)
        parts.append(_against(texts(docs), shared(spark, compiled)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _against(docs: DataFrame, compiled) -> DataFrame:
    names = ("doc_id", "item_id", "n_edits", "item_words", "start", "end")

    def make():
        bench, hashes = compiled.value, WordHashes()

        def step(b):
            words = [hashes.of(WORD.findall(t.lower())) for t in b["text"]]
            rows = []
            for d, k, edits, first, last in bench.leaks(words):
                spans = [m.span() for m in WORD.finditer(b["text"][d])] if len(b["text"][d].lower()) == len(b["text"][d]) else None
                at = (spans[first][0], spans[last - 1][1]) if spans and len(spans) == len(words[d]) and last > first else (None, None)
                rows.append((b["doc_id"][d], bench.items[k][0], edits, len(bench.items[k][1]), *at))
            return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

        return step

    return map_batches(docs, make, "doc_id long, item_id long, n_edits long, item_words long, start long, end long", letters=SLICE)


def clean(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item. Rows with a null doc_id cannot be named by leaks and stay."""
    return docs.join(leaks.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
