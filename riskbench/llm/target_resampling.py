"""Importance resampling towards a target text: documents are drawn without replacement with odds by how much likelier their
features are in the target than in the corpus.

1. Features (runs of words) fall into a fixed number of buckets by CRC. Each task counts its buckets in one array; the arrays
   are summed by bucket, so what travels does not grow with the documents.
2. The gain of each bucket is one entry of an array. A document's weight is the sum over its features, taken by indexing.
3. With a Gumbel number added to each weight, the draw is the rows of highest score. A quantile sketch gives nested brackets
   around the cutoff, exact counts below and up to each bracket tell which hold it, and only the values inside the
   narrowest such bracket are sorted. Ties at the cutoff are settled the same way by doc_id. The drawn rows are then ranked by
   counts per score, so no task holds them all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.ordering import fit_cuts, running_sums
from ..session import stored
from .common import shared, texts

BUCKETS = 10_000
LONGEST = 1  # words of a feature
SEED = 2024
FEWEST = 20  # words of a document that can be drawn
PERCENT = 10
PIECE = 1 << 20  # bytes of a text that are split into words together
WIDTHS = (0.001, 0.01, 0.1)  # shares of the rows on each side of the cutoff that the nested brackets span
ACCURACY = 10_000
#: A-Z become lower case, digits, letters and all bytes of other code points stay, the rest parts words.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_PARTS = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some ``PIECE`` bytes at a time."""
    at = 0
    while at < len(text):
        end = _PARTS.search(text, at + PIECE)  # the end of the word there
        to = end.start() if end else len(text)
        yield text[at:to].translate(_LETTERS).split()
        at = to


class Buckets(dict):
    """Bucket of a feature, remembered for up to ``most`` of them."""

    def __init__(self, buckets: int, most: int = 400_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.buckets
        if len(self) < self.most:
            self[feature] = bucket
        return bucket

    def of(self, text: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of features) piece by piece; runs of words across pieces belong to the later one."""
        last: list[bytes] = []
        for piece in words(text):
            run = last + piece
            features = list(piece)
            for k in range(2, longest + 1):
                first = max(0, len(last) - k + 1)
                features += [b" ".join(run[i : i + k]) for i in range(first, len(run) - k + 1)]
            yield len(piece), np.fromiter(map(self.__getitem__, features), np.int64, len(features))
            last = run[max(0, len(run) - longest + 1) :] if longest > 1 else last


def bucket_counts(table: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts of ``table`` by bucket."""
    struct = T.StructType.fromDDL("bucket long, n long")

    def run(batches):
        import pyarrow as pa

        found, counts = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                for _, b in found.of(text.as_py(), longest):
                    counts += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    rows = table.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, struct).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log odds of each bucket, with one added to every count."""
    k = len(corpus)
    c, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (c + k) / ((x + 1.0) * (t + k)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def gumbel(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    struct = T.StructType.fromDDL("doc_id long, n_words long, n_features long, weight long, score long")
    held = shared(docs.sparkSession, gain)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, gain = to_arrow_schema(struct), held.value
        found = Buckets(len(gain))
        for batch in batches:
            rows = []
            for text, h in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()):
                n_words, n, weight = 0, 0, 0
                for w, b in found.of(text.as_py(), longest):
                    n_words, n, weight = n_words + w, n + len(b), weight + int(gain[b].sum())
                rows.append((n_words, n, weight, weight + gumbel(h)))
            columns = [batch.column(0), *([*c] for c in zip(*rows))] if rows else [batch.column(0), [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if isinstance(c, list) else c for c, f in zip(columns, kinds)], schema=kinds)

    return texts(docs).select("doc_id", "text", h.alias("h")).mapInArrow(run, struct)


def nth_smallest(rows: DataFrame, key: str, k: int, n: int) -> tuple[int, int]:
    """The ``k``-th smallest (from 1) of the ``n`` values of an integer column, and how many rows lie below that value."""
    sides = [(max(0.0, k / n - w), min(1.0, k / n + w)) for w in WIDTHS]
    sketch, low, high = rows.agg(F.percentile_approx(key, [p for side in sides for p in side], ACCURACY), F.min(key), F.max(key)).first()
    brackets = [(sketch[2 * i], sketch[2 * i + 1]) for i in range(len(sides))] + [(low, high)]
    outside = [x for lo, hi in brackets for x in (F.sum((F.col(key) < lo).cast("long")), F.sum((F.col(key) <= hi).cast("long")))]
    exact = rows.agg(*[x.alias(f"c{i}") for i, x in enumerate(outside)]).first()
    # The narrowest bracket that holds the cutoff; the whole range always does.
    at = next(i for i in range(len(brackets)) if exact[2 * i] < k <= exact[2 * i + 1])
    (lo, hi), below = brackets[at], exact[2 * at]
    inside = rows.where(F.col(key).between(lo, hi)).groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    summed = running_sums(inside, [], "value", ["n"], cuts=fit_cuts(inside, [], "value", row_bound=exact[2 * at + 1] - below))
    cut = summed.where(F.col("cum_n") >= k - below).agg(F.min(F.struct("value", "cum_n", "n")).alias("c")).select("c.*").first()
    return cut["value"], below + cut["cum_n"] - cut["n"]


def drawn(rows: DataFrame, percent: int = PERCENT, fewest: int = FEWEST) -> DataFrame:
    """``rows`` of ``scored`` with their rank by score, then doc_id, where they are among the drawn; else null."""
    rows = rows.withColumn("able", F.col("n_words") >= fewest).withColumn("key", -F.col("score"))
    rows = rows.withColumn("tie", F.coalesce("doc_id", F.lit(2**63 - 1)))  # null last
    able = rows.where("able")
    n = able.count()
    k = percent * n // 100
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    cut, before = nth_smallest(able, "key", k, n)
    tied = able.where(F.col("key") == cut)
    last, _ = nth_smallest(tied, "tie", k - before, tied.count())
    # No row has a null here, so the negation below is safe.
    taken = F.col("able") & ((F.col("key") < cut) | ((F.col("key") == cut) & (F.col("tie") <= last)))
    chosen = rows.where(taken)
    by_score = chosen.groupBy("key").agg(F.count("*").alias("n"))
    starts = running_sums(by_score, [], "key", ["n"], cuts=fit_cuts(by_score, [], "key", row_bound=k))
    starts = starts.select("key", (F.col("cum_n") - F.col("n")).alias("start"))
    ones = chosen.withColumn("one", F.lit(1).cast("long"))
    placed = running_sums(ones, ["key"], "tie", ["one"], cuts=fit_cuts(ones, ["key"], "tie", row_bound=k))
    ranked = placed.join(starts, "key").withColumn("rank", F.col("start") + F.col("cum_one"))
    # Rows of one doc_id and score may reach over the end of the draw together.
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return rows.where(~taken).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*rows.columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, fewest: int = FEWEST, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null where a row is not drawn.

    Words are runs of ASCII letters, digits and code points beyond ASCII; features are runs of up to ``longest`` words. A null or
    empty text has none, weighs 0 and is not drawn; nor is one of under ``fewest`` words. An empty target counts no features.
    A null doc_id hashes as an empty one and ties last; rows of one doc_id are separate documents, each with its own rank.
    Other columns are ignored whatever their names. An empty table, or one with too few rows, draws none.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = stored(scored(docs, gain, longest, seed), "resample-scores")
    return drawn(rows, percent, fewest).select("doc_id", "n_features", "weight", "score", "rank")
