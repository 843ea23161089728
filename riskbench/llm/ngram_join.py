"""N-gram Jaccard join with vertical partitioning.

All shingles have one global order: those of few documents first, by hash, then the frequent ones by their number. The order
is cut into fragments, and everything that meets across documents does so inside a fragment:

1. ``frequent``: documents per shingle, counted fragment by fragment over all documents.
2. ``prefixes``: a linked pair shares ``k`` shingles among the first ``n - ceil(0.75 n) + k`` of each side, so only these are
   sent. Copies share a set and count as one from here on.
3. ``candidates``: inside a fragment, shingles of few documents give all their pairs of fitting size with the overlap counted
   there; overlaps are summed per pair, and pairs that cannot reach ``k`` go. Shingles of many documents give a star per size
   band around one of them, from the prefixes with ``k = 1``.
4. ``verify``: sets of candidates are cut at the fragments of the order, overlaps are counted per fragment and summed per pair.
5. Stars first, then whatever candidate pairs still lie in different components and whose odd sketches do not rule a link
   out. Pairs inside a component are not compared, so
   a group of near copies costs about one comparison a document.
6. A pair that shares no shingle of few within its prefixes consists of two sets whose frequent part alone reaches 75 percent
   of each (``hot`` sets), and links by this part alone: iff ``175 * overlap >= 75 * (n + m)`` for the overlap of the frequent
   parts. So hot sets with the same frequent part are one group. In it the smallest set, its anchor, links with all that link with
   any; this needs no comparison. Between groups the frequent parts of anchors meet, and those of sets too large for their own anchor, one for
   each size. A passage that a third of all documents share is one frequent part, however many they are.

Between Python tasks a fragment travels as packed sorted arrays (differences, by byte plane, compressed).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import stored
from .common import U64, WordHashes, shared, shingles, texts, tidy
from .components import connected

WIDTH, SHARE = 5, 75  # words of a shingle; percent of the union that must be shared
MANY = 8  # documents from which a shingle is frequent
MOST_FREQUENT = 1 << 20  # frequent shingles that are told apart by number; the rest stay in hash order, with the same result
FLUSH = 500_000  # shingles that a task packs at a time
PER_FRAGMENT = 500_000
SMALL = 100_000  # documents to verify up to which their ids are broadcast and the texts stay where they are
HUBS = 3  # stars of frequent shingles that a set takes part in, in the first round and ``STAR_TURNS`` more, before all pairs left
STAR_TURNS = 1
CUTS = 4  # fragments of the order in which overlaps are counted


def set_of(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of a text's shingles: A-Z in lower case, words between ASCII blanks."""
    return shingles(hashes.of(text.encode("utf-8", "surrogatepass").lower().split()), WIDTH)


def pack(values: np.ndarray) -> bytes:
    """Sorted integers as compressed differences."""
    import pyarrow as pa

    d = np.diff(values.astype(np.uint64), prepend=U64(0)).astype("<u8")
    return len(d).to_bytes(4, "little") + pa.compress(d.view(np.uint8).reshape(-1, 8).T.copy(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.cumsum(planes.reshape(8, n).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _fragments(docs: DataFrame, share: float) -> int:
    """A power of two of fragments, so that each holds about ``PER_FRAGMENT`` shingles of the share that is sent."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(24, max(3, int(np.ceil(np.log2(max(1, size * share / 6 / PER_FRAGMENT))))))


def _scan(docs: DataFrame, pack_docs, schema: str) -> DataFrame:
    """Run ``pack_docs(ids, sets, schema)``, which gives Arrow batches, over the documents of a task, some ``FLUSH`` shingles at a time."""
    struct = T.StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, hashes, ids, sets, held = to_arrow_schema(struct), WordHashes(), [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                sets.append(set_of(batch.column(1)[k].as_py(), hashes))
                held += len(sets[-1])
                if held >= FLUSH:
                    yield from pack_docs(ids, sets, kinds)
                    ids, sets, held = [], [], 0
        if ids:
            yield from pack_docs(ids, sets, kinds)
        ids = sets = hashes = batch = None
        tidy()

    return docs.mapInArrow(run, struct)


def _batch(kinds, size: int, /, **columns):
    """An Arrow batch of ``size`` rows; columns that are not given are null."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)


def frequent(docs: DataFrame) -> DataFrame:
    """(mark, n) of shingles of ``MANY`` documents or more, told apart by the upper 32 bits of their hash."""
    bits = int(np.log2(_fragments(docs, 1.0)))

    def pack_docs(ids, sets, kinds):
        marks = np.sort(np.concatenate(sets) >> U64(32))
        edges = np.searchsorted(marks, np.arange((1 << bits) + 1, dtype=np.uint64) << U64(32 - bits))
        held = np.flatnonzero(np.diff(edges))
        yield _batch(kinds, len(held), fragment=held, blob=[pack(marks[edges[k] : edges[k + 1]]) for k in held])

    def count(pdf):
        import pandas as pd

        marks = np.sort(np.concatenate([unpack(b) for b in pdf["blob"]]))
        at = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        n = np.diff(np.append(at, len(marks)))
        return pd.DataFrame({"mark": marks[at][n >= MANY].astype(np.int64), "n": n[n >= MANY]})

    return _scan(docs, pack_docs, "fragment int, blob binary").groupBy("fragment").applyInPandas(count, "mark long, n long")


def wanted(n):
    """The k of a set of n shingles."""
    return 1 + n // 20


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of 1,024 cells. Sets that differ in d shingles differ in at most d cells."""
    return np.packbits((np.bincount((s & U64(1023)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)).view(np.int64)


def close(x: str, y: str):
    """Whether sketches leave room for a link. ``p`` of the ``n`` shingles of a side are in its sketch, and these alone must
    overlap enough: all of them, or the frequent part where a link by that is asked for."""
    differ = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(16)), F.lit(0))
    both = F.col(f"{x}.p") + F.col(f"{y}.p")
    return (100 + SHARE) * (both - differ) >= 2 * SHARE * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def sketched(entries: DataFrame) -> DataFrame:
    """Entries with the size ``p`` and sketch that count under their shingle: of the whole set where it is ``late``, else of the frequent part."""
    p, sketch = (F.when(F.col("late"), F.col(c)).otherwise(F.col(h)) for c, h in (("n", "hot_n"), ("sketch", "hot_sketch")))
    return entries.withColumns({"p": p, "sketch": sketch}).drop("hot_n", "hot_sketch")


class Order:
    """Frequent shingles as arrays: the marks in order, and the place of each among the frequent ones."""

    def __init__(self, rows):
        marks, n = rows.column("mark").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
        by_mark = np.argsort(marks)
        place = np.empty(len(marks), np.int64)
        place[np.lexsort((marks, n))] = np.arange(len(marks))
        self.marks, self.place = marks[by_mark], place[by_mark]

    def among(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes many documents hold, and where the marks of all would stand."""
        if not len(self.marks):
            return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        marks = s >> U64(32)
        at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        return self.marks[at] == marks, at

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
        """Of the prefix for ``wanted``: the hashes that few documents hold, and how many of many it has. Of the prefix for
        k = 1: the hashes that many hold, and their places in the order of this set. Then all hashes that many hold."""
        n = len(s)
        first = n - (SHARE * n + 99) // 100
        length = first + wanted(n)
        many, at = self.among(s)
        few, hot = s[~many], s[many]
        ordered = hot[np.lexsort((hot, self.place[at[many]]))] if len(hot) else hot
        n_hot = min(len(hot), max(0, length - len(few)))
        ordered = ordered[: max(0, first + 1 - len(few))]
        return few[:length], ordered, len(few) + np.arange(len(ordered)), n_hot, hot


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def prefixes(docs: DataFrame, order) -> DataFrame:
    """Rows of three kinds: documents (doc_id, set_key, code, n, and how many shingles of many the prefix has, as ``place``; hot
    sets also the digest, size and sketch of their frequent part); packed prefixes of few (fragment, blob); entries of
    frequent shingles (shingle, code, n, place). ``code`` is the first half of the digest of the set."""
    bits = int(np.log2(_fragments(docs, 0.3)))

    def pack_docs(ids, sets, kinds):
        found = order.value
        digest = lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).digest()
        keys = [digest(s) if len(s) else None for s in sets]
        codes = np.array([int.from_bytes(k[:8], "little") if k else 0 for k in keys], np.uint64)
        sizes = np.array([len(s) for s in sets], np.int64)
        few, owners, hots, places, hot_owners, seen = [], [], [], [], [], {}
        for d, s in enumerate(sets):
            if not len(s) or keys[d] in seen:  # copies within what a task packs are one set
                continue
            cold, hot, at, n_hot, part = found.prefix(s)
            seen[keys[d]] = (n_hot, digest(part), len(part), odd_sketch(part)) if len(hot) else (n_hot, None, None, None)
            few.append(cold)
            owners.append(np.full(len(cold), d, np.int32))
            hots.append(hot)
            places.append(at)
            hot_owners.append(np.full(len(hot), d, np.int32))
        counts, hot_keys, hot_sizes, hot_sketches = zip(*(seen.get(k, (0, None, None, None)) for k in keys))
        yield _batch(
            kinds, len(ids), kind=["document"] * len(ids), doc_id=ids, set_key=keys, code=_signed(codes), n=sizes, place=counts,
            sketch=[odd_sketch(s) for s in sets], hot_key=hot_keys, hot_n=hot_sizes, hot_sketch=hot_sketches,
        )
        if not few:
            return
        hots, by = np.concatenate(hots), np.concatenate(hot_owners)
        if len(hots):
            yield _batch(kinds, len(hots), kind=["frequent"] * len(hots), shingle=_signed(hots), code=_signed(codes[by]), n=sizes[by], place=np.concatenate(places).astype(np.int32))
        few, owners = np.concatenate(few) >> U64(24), np.concatenate(owners)
        by = np.argsort(few, kind="stable")
        few, owners = few[by], owners[by]
        edges = np.searchsorted(few, np.arange((1 << bits) + 1, dtype=np.uint64) << U64(40 - bits))
        fragments, blobs = np.flatnonzero(np.diff(edges)), []
        for k in fragments:
            a, b = edges[k], edges[k + 1]
            docs_here, index = np.unique(owners[a:b], return_inverse=True)
            parts = [pack(few[a:b] - (U64(k) << U64(40 - bits))), index.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()]
            parts += [codes[docs_here].astype("<u8").tobytes(), sizes[docs_here].astype("<u4").tobytes()]
            blobs.append(b"".join(len(p).to_bytes(4, "little") + p for p in parts))
        yield _batch(kinds, len(blobs), kind=["few"] * len(blobs), fragment=fragments.astype(np.int32), blob=blobs)

    schema = "kind string, doc_id long, set_key binary, code long, n long, fragment int, blob binary, shingle long, place int, sketch array<long>, hot_key binary, hot_n long, hot_sketch array<long>"
    return _scan(docs, pack_docs, schema)


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "little")
        parts.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    index = np.frombuffer(parts[1], np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return unpack(parts[0]), index, np.frombuffer(parts[2], "<u8"), np.frombuffer(parts[3], "<u4").astype(np.int64)


def band(n):
    """Sizes of one band are at least ``SHARE`` percent of each other."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / SHARE) + 1e-9).astype(np.int64)


def pairs_of_few(pdf):
    """Pairs of sets that share shingles of this fragment and how many; ``star`` for pairs with the first set of a shingle and band.

    Sets under shingles that turn out to be of more than 64 sets come back as entries of frequent shingles instead.
    """
    import pandas as pd

    rest, ref, code, n, first = [], [], [], [], 0
    for blob in pdf["blob"]:
        r, index, codes, sizes = _open(blob)
        rest.append(r), ref.append((index + first).astype(np.int32)), code.append(codes), n.append(sizes)
        first += len(codes)
    rest, ref, code, n = map(np.concatenate, (rest, ref, code, n))
    by = np.argsort(rest, kind="stable")
    rest, ref = rest[by], ref[by]
    same = rest[1:] == rest[:-1]
    shared_by_some = np.append(False, same) | np.append(same, False)
    rest, code, n = rest[shared_by_some], code[ref[shared_by_some]], n[ref[shared_by_some]]
    by = np.lexsort((code, band(n), rest))
    rest, code, n = rest[by], code[by], n[by]
    new = np.append(True, (rest[1:] != rest[:-1]) | (code[1:] != code[:-1]))[: len(rest)]
    rest, code, n = rest[new], code[new], n[new]
    starts = np.flatnonzero(np.append(True, rest[1:] != rest[:-1])[: len(rest)])
    sizes = np.diff(np.append(starts, len(rest)))
    large = np.repeat(sizes > 64, sizes)
    left = np.repeat(sizes, sizes) - (np.arange(len(rest)) - np.repeat(starts, sizes)) - 1  # entries behind this one
    left[large] = 0
    bands = band(n)
    begins_band = np.append(True, (rest[1:] != rest[:-1]) | (bands[1:] != bands[:-1]))[: len(rest)]
    found = []
    for step in range(1, int(left.max(initial=0)) + 1):
        a = np.flatnonzero(left >= step)
        b = a + step
        fit = 100 * np.minimum(n[a], n[b]) >= SHARE * np.maximum(n[a], n[b])
        a, b = a[fit], b[fit]
        star = begins_band[a] & ((bands[a] == bands[b]) | begins_band[b])
        found.append((np.minimum(code[a], code[b]), np.maximum(code[a], code[b]), star))
    a, b, star = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.uint64, np.uint64, bool)))
    by = np.lexsort((b, a))
    a, b, star = a[by], b[by], star[by]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    stars = np.maximum.reduceat(star, at) if len(at) else star
    pairs = pd.DataFrame({"a": _signed(a[at]), "b": _signed(b[at]), "star": stars, "shared": np.diff(np.append(at, len(a)))}).assign(shingle=None, code=None, n=None)
    fragment = int(pdf["fragment"].iloc[0])
    del found, a, b, star, ref, left
    tidy()
    spill = pd.DataFrame({"a": None, "b": None, "star": None, "shared": None, "shingle": _signed((U64(fragment) << U64(40)) + rest[large]), "code": _signed(code[large].copy()), "n": n[large]})
    return pd.concat([pairs, spill]) if len(spill) else pairs


def candidates(sent: DataFrame, standing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, star) by code from shingles of few that share enough, with the stars of frequent ones; and the entries of
    frequent shingles. Of hot sets only those in ``standing`` (by code) take part in the latter: they stand for others."""
    few = sent.where("kind = 'few'").select("fragment", "blob").groupBy("fragment")
    few = stored(few.applyInPandas(pairs_of_few, "a long, b long, star boolean, shared long, shingle long, code long, n long"), "ngram-pairs")
    entries = sent.where("kind = 'frequent'").select("shingle", "code", "n", F.col("place").cast("long").alias("place"), F.lit(False).alias("late"))
    entries = entries.join(standing.select("code"), "code", "left_semi").select("shingle", "code", "n", "place", "late")
    late = few.where("shingle is not null").select("shingle", "code", "n", F.lit(0).cast("long").alias("place"), F.lit(True).alias("late"))
    # Shingles that no pair has counted: those of many in the prefix, and those found to be of many on the way.
    spared = sent.where("kind = 'document' and n > 0").groupBy("code").agg(F.max("place").alias("spared"), F.max("n").alias("n"))
    extra = late.groupBy("code").agg(F.count("*").alias("extra"))
    spared = spared.join(extra, "code", "left").select("code", "n", (F.col("spared") + F.coalesce("extra", F.lit(0))).alias("spared"))
    of = lambda c: spared.select(F.col("code").alias(c), F.col("n").alias(f"n_{c}"), F.col("spared").alias(f"s_{c}"))
    summed = few.where("a is not null").groupBy("a", "b").agg(F.max("star").alias("star"), F.sum("shared").alias("shared"))
    k = F.least(*[1 + F.floor(F.col(f"n_{c}") / 20) for c in "ab"])
    # One less than k: two shingles of a set may have met in one bucket.
    enough = F.col("shared") + F.least("s_a", "s_b") >= k - 1
    summed = summed.join(of("a"), "a").join(of("b"), "b").where(enough).select("a", "b", "star")
    entries = stored(entries.unionByName(late).distinct(), "ngram-entries")
    of_code = [F.first(c).alias(c) for c in ("sketch", "hot_n", "hot_sketch")]
    sketches = sent.where("kind = 'document' and n > 0").groupBy("code").agg(*of_code)
    banded = sketched(entries.join(sketches, "code").withColumn("cold", F.col("n") - F.coalesce("hot_n", F.lit(0)))).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / SHARE)) + 1e-9))
    # The hub is the set with the fewest shingles of its own: likely the text that the others were made from.
    banded = banded.withColumn("own", F.struct("cold", "code", "n", "p", "sketch"))
    hubs = banded.groupBy("shingle", "band").agg(F.min("own").alias("hub"))
    to_hub = banded.join(hubs, ["shingle", "band"]).where((F.col("hub.code") != F.col("code")) & close("own", "hub"))
    to_hub = to_hub.select(F.col("hub.code").alias("x"), F.col("code").alias("y"))
    # Stars only have to bring groups together, so each set keeps the hubs with which it shares most; pairs that stay apart
    # are all looked at later.
    met = to_hub.groupBy("y", "x").agg(F.count("*").alias("n")).groupBy("y").agg(F.sort_array(F.collect_list(F.struct("n", "x")), False).alias("hubs"))
    to_hub = met.select(F.explode(F.slice("hubs", 1, HUBS)).alias("h"), "y").select(F.col("h.x").alias("x"), "y")
    above = hubs.select("shingle", (F.col("band") + 1).alias("band"), F.col("hub").alias("under"))
    across = hubs.join(above, ["shingle", "band"]).where(fitting("hub.n", "under.n")).select(F.col("under.code").alias("x"), F.col("hub.code").alias("y"))
    stars = to_hub.unionByName(across).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(True).alias("star"))
    return summed.unionByName(stars).groupBy("a", "b").agg(F.max("star").alias("star")), entries


def stars_between(at: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of sets in different components: each set with the hubs with which it shares most. Hubs change by turn."""
    banded = at.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / SHARE)) + 1e-9))
    banded = banded.withColumn("own", F.struct("rep", "n", "p", "sketch", "component"))
    hubs = banded.groupBy("shingle", "band").agg(F.min_by("own", F.xxhash64("code", F.lit(turn))).alias("hub"))
    met = banded.join(hubs, ["shingle", "band"]).where((F.col("hub.component") != F.col("component")) & close("own", "hub"))
    met = met.groupBy("rep", F.col("hub.rep").alias("hub")).agg(F.count("*").alias("n")).groupBy("rep")
    met = met.agg(F.sort_array(F.collect_list(F.struct("n", "hub")), False).alias("hubs")).select("rep", F.explode(F.slice("hubs", 1, HUBS)).alias("h"))
    return met.select(F.least("rep", "h.hub").alias("a"), F.greatest("rep", "h.hub").alias("b")).distinct()


def fitting(x: str, y: str):
    return 100 * F.least(F.col(x), F.col(y)) >= SHARE * F.greatest(F.col(x), F.col(y))


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, only=None) -> DataFrame:
    """The pairs (a, b) of representatives whose sets overlap enough; with an ``Order`` as ``only``, whose frequent parts do.

    A document is read for up to some hundred pairs at once: its set is cut into ``CUTS`` ranges of the order and goes to the
    first of each pair; overlaps are counted range by range and summed.
    """
    # The first of many pairs gets several places, each for some of its partners.
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("places"))
    members = pairs.join(places, "a").select(F.col("b").alias("rep"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "places").cast("int").alias("place"), F.lit(False).alias("is_hub"))
    hubs = places.select(F.col("a").alias("rep"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(True).alias("is_hub"))
    # One of many partners is read several times, each time for some of them.
    turns = members.groupBy("rep").agg(F.ceil(F.count("*") / 64).cast("int").alias("turns"))
    members = members.join(turns, "rep").withColumn("turn", F.pmod(F.xxhash64("hub"), "turns").cast("int")).drop("turns")
    every = members.unionByName(hubs.withColumn("turn", -1 - F.floor(F.col("place") / 64).cast("int")))
    want = every.groupBy("rep", "turn").agg(F.collect_list(F.struct("hub", "place", "is_hub")).alias("to")).drop("turn")
    want = stored(want.join(classes.select("rep", "set_key"), "rep"), "ngram-wanted")
    side = F.broadcast(want) if want.count() <= SMALL else want
    read = docs.join(side, docs["doc_id"] == side["rep"]).select("text", "rep", "set_key", "to")
    struct = T.StructType.fromDDL("hub long, place int, cut int, rep long, is_hub boolean, n long, hashes array<long>")

    def cut(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, hashes = to_arrow_schema(struct), WordHashes()
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                text, rep, key, to = (batch.column(i)[k].as_py() for i in range(4))
                s = set_of(text, hashes)
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != key:
                    continue  # another text under the same id
                n = len(s)
                s = s if only is None else s[only.value.among(s)[0]]
                edges = np.searchsorted(s, np.arange(1, CUTS, dtype=np.uint64) << U64(62))
                parts = np.split(_signed(s), edges)
                for t in to:
                    rows += [(t["hub"], t["place"], c, rep, t["is_hub"], n, part) for c, part in enumerate(parts)]
                    held += len(s)
                    if held > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)
        hashes = batch = rows = s = parts = part = to = None
        tidy()

    # The hub's set stands first in its place and range, and meets each of the bounded number of others there.
    w = Window.partitionBy("hub", "place", "cut").orderBy(F.desc("is_hub"))
    met = read.mapInArrow(cut, struct).withColumn("hub_n", F.first("n").over(w)).withColumn("hub_hashes", F.first("hashes").over(w)).where("not is_hub")
    overlap = F.size(F.array_intersect("hashes", "hub_hashes")).cast("long")
    counted = met.select("hub", "rep", "cut", "n", "hub_n", overlap.alias("overlap"))
    # A row that stands twice in the table counts once.
    counted = counted.groupBy("hub", "rep", "cut").agg(F.max("n").alias("n"), F.max("hub_n").alias("hub_n"), F.max("overlap").alias("overlap"))
    summed = counted.groupBy("hub", "rep").agg(F.sum("overlap").alias("o"), F.max("n").alias("n"), F.max("hub_n").alias("m"))
    return summed.where(100 * F.col("o") >= SHARE * (F.col("n") + F.col("m") - F.col("o"))).select(F.col("hub").alias("a"), F.col("rep").alias("b"))


def hot_groups(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hot sets by their frequent part: (rep, anchor, linked, standing) of each set but the anchors, and (code, rep, hot_n, low, alone)
    of those that stand for others.

    The anchor is the smallest set of a group. A set either links with it by the frequent part alone, or is too large for
    any in the group; then the first of its size in the group stands for all of that size, and ``low`` is the anchor's size, below which partners must
    lie. ``alone`` tells that a set stands for itself only.
    """
    hot = classes.where("hot_key is not null").select("hot_key", "hot_n", "n", "rep", "code")
    anchors = hot.groupBy("hot_key").agg(F.min(F.struct("n", "rep", "code", "hot_n")).alias("anchor"))
    joined = hot.join(anchors, "hot_key").where("rep != anchor.rep")
    joined = joined.withColumn("linked", (100 + SHARE) * F.col("hot_n") >= SHARE * (F.col("n") + F.col("anchor.n")))
    sizes = joined.where("not linked").groupBy("hot_key", "n").agg(F.min(F.struct("rep", "code", "hot_n")).alias("first"), F.min("anchor.n").alias("low"), F.count("*").alias("sets"))
    grouped = joined.join(sizes.select("hot_key", "n", F.col("first.rep").alias("standing")), ["hot_key", "n"], "left")
    grouped = stored(grouped.select("rep", F.col("anchor.rep").alias("anchor"), "linked", "standing"), "ngram-groups")
    first = anchors.select("anchor.code", "anchor.rep", "anchor.hot_n", F.lit(None).cast("long").alias("low"), F.lit(True).alias("alone"))
    loose = sizes.select("first.code", "first.rep", "first.hot_n", "low", (F.col("sets") == 1).alias("alone"))
    return grouped, stored(first.unionByName(loose), "ngram-standing")


def apart(at: DataFrame) -> DataFrame:
    """Entries of shingles that bring different components together."""
    several = at.groupBy("shingle").agg(F.min("component").alias("low_component"), F.max("component").alias("high_component"))
    return at.join(several.where("low_component != high_component").select("shingle"), "shingle")


def pairs_left(at: DataFrame) -> DataFrame:
    """Pairs of entries under one shingle that sizes, places and sketches allow to link, in either order."""
    x, y = at.alias("x"), at.alias("y")
    room = lambda s: F.col(f"{s}.n") - F.col(f"{s}.place")  # noqa: E731  shingles from here to the end of the order
    return x.join(y, "shingle").where(
        fitting("x.n", "y.n") & ((100 + SHARE) * F.least(room("x"), room("y")) >= SHARE * (F.col("x.n") + F.col("y.n"))) & close("x", "y")
    )


def parts_left(at: DataFrame, standing: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that stand for others, still in different components, whose frequent parts are large enough for a link.

    ``a`` is an anchor; ``b`` is one too, or a set that only links with sets smaller than its own anchor. If such a set stands
    for several, their components are not known here and it counts as apart from all.
    """
    own = F.when(F.col("alone"), F.col("component")).otherwise(-1 - F.col("rep"))
    at = apart(at.join(standing.select("code", "low", "alone"), "code").withColumn("component", own))
    first = F.col("y.low").isNull() & (F.col("x.rep") < F.col("y.rep"))
    met = pairs_left(at).where(F.col("x.low").isNull() & (F.col("x.component") != F.col("y.component")) & (first | (F.col("x.n") < F.col("y.low"))))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row of ``docs``.

    Documents link if their sets of five-word shingles share 75 percent of their union; documents of fewer words have one
    shingle. A null or empty text has no set, no link, and itself as component; so has a null doc_id, which gives a null
    component; rows of one doc_id are one document, and copies share a set. Other columns are ignored; an empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    top = frequent(docs).orderBy(F.desc("n"), "mark").limit(MOST_FREQUENT).toArrow()
    order = shared(spark, Order(top))
    sent = stored(prefixes(docs, order), "ngram-prefixes")
    rows = stored(sent.where("kind = 'document'").select("doc_id", "set_key", "code", "n", "sketch", "hot_key", "hot_n", "hot_sketch"), "ngram-documents")
    named = rows.where("doc_id is not null and n > 0")
    of_set = [F.first(c).alias(c) for c in ("code", "n", "sketch", "hot_key", "hot_n", "hot_sketch")]
    classes = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *of_set), "ngram-classes")
    grouped, standing = hot_groups(classes)
    pairs, entries = candidates(sent, standing)
    of = lambda name: classes.select(F.col("code").alias(name), F.col("rep").alias(f"rep_{name}"), F.struct("n", F.col("n").alias("p"), "sketch").alias(f"of_{name}"))
    named_pairs = pairs.join(of("a"), "a").join(of("b"), "b").where((F.col("rep_a") != F.col("rep_b")) & close("of_a", "of_b"))
    known = stored(named_pairs.groupBy(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).agg(F.max("star").alias("star")), "ngram-candidates")
    linked = stored(verify(docs, known.where("star"), classes), "ngram-links")
    # Rows of one doc_id with different texts are one document.
    same = named.join(classes.select("set_key", "rep"), "set_key").where("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    repeated = named.groupBy("doc_id").agg(F.count_distinct("set_key").alias("k")).where("k > 1").select("doc_id")
    same = same.join(repeated, same["b"] == repeated["doc_id"], "left_semi").distinct()
    linked = linked.unionByName(same).unionByName(grouped.where("linked").select(F.col("anchor").alias("a"), F.col("rep").alias("b")))
    tried, at = known.where("star").select("a", "b"), None
    for turn in range(STAR_TURNS + 1):
        # What is known already comes as one edge a set.
        labels = stored(connected(linked), "ngram-labels")
        linked = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        member = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("code", "n", "rep", "sketch", "hot_n", "hot_sketch", F.coalesce("component", "rep").alias("component"))
        at = sketched(entries.select("shingle", "code", "place", "late").join(member, "code"))
        if turn == STAR_TURNS:
            break
        again = stored(stars_between(apart(at), turn).join(tried, ["a", "b"], "left_anti"), "ngram-stars")
        if again.isEmpty():
            break
        tried = tried.unionByName(again)
        linked = linked.unionByName(stored(verify(docs, again, classes), "ngram-links"))
    # What is left: candidate pairs whose sides are still apart.
    crossing = pairs_left(apart(at.where("late"))).where("x.rep < y.rep and x.component != y.component")
    crossing = crossing.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    label = lambda name: member.select(F.col("rep").alias(name), F.col("component").alias(f"c_{name}"))
    more = known.where("not star").select("a", "b").join(label("a"), "a").join(label("b"), "b").where("c_a != c_b").select("a", "b")
    left = stored(more.unionByName(crossing).distinct().join(tried, ["a", "b"], "left_anti"), "ngram-left")
    parts = stored(parts_left(at.where("not late"), standing), "ngram-parts-left")
    if not left.isEmpty():
        linked = linked.unionByName(stored(verify(docs, left, classes), "ngram-links"))
    if not parts.isEmpty():
        met = stored(verify(docs, parts, classes, order), "ngram-links")
        # A set that stands for others of its size speaks for them all: their frequent part and size are the same.
        others = grouped.where("not linked").select(F.col("standing").alias("b"), "rep")
        linked = linked.unionByName(met).unionByName(met.groupBy("b").agg(F.min("a").alias("a")).join(others, "b").select("a", F.col("rep").alias("b")))
    final = labels if left.isEmpty() and parts.isEmpty() else stored(connected(linked), "ngram-labels")
    by_set = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "set_key", "n").join(by_set, "set_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
