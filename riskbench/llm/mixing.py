"""Mixing sources to target weights by systematic sampling.

A mix asks for a share of all words (150 percent, say) and deals them to the sources by weight. No source may be repeated more
than a fixed number of times, so targets stop there and the excess goes to the others by weight, until none is above: every
target is the lesser of its stop and ``level * weight`` for one common level.

A source's documents all expect ``target / size`` copies. They are put in the order of their size (ties by a hash), the expected
copies are summed along it, one random offset is added, and a document is emitted once per integer the sum crosses in it. As
neighbours are of like size, the words taken differ from the target by no more than about the longest document.

Sums run in units of 2**-24 copies, as integers: the same on any cluster and in any order of addition. Positions inside a source
come from counts per (source, size), where a size of more than ``PER_SLICE`` rows is cut by the hash, so no task ever holds
a whole source. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PERCENT = 150  # words of the mix, of all words
MOST = 2  # times a source, and a document, is taken at most
SEED = 11
BITS = 24  # a copy is 2**BITS units
PER_SLICE = 1 << 16


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc, source, size, tie) of every row: the whole row as a struct, its words, and a hash that orders documents of one size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(text)))
    return docs.select(F.struct("*").alias("doc"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), tie.alias("tie"))


def targets(per_size: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size, n): weights go round the sources in code point order, null last.

    One row per source is sorted here; sources are collections with a name, of which there are few beside the documents.
    """
    total = per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(turn, F.lit(len(weights)))).cast("long")
    dealt = total.withColumn("weight", weight).withColumn("stop", most * F.col("source_size"))
    # In the order of stop / weight the first ones are capped and the level fits the rest. It is right for the first source
    # that it leaves under its stop, and falls from there on.
    upto = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    wanted = F.sum("source_size").over(whole).cast("double") * percent / 100
    level = (wanted - before("stop")) / (F.sum("weight").over(whole) - before("weight"))
    stated = dealt.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("stop")
    stated = stated.withColumn("level", F.max(F.when(fits, F.col("level"))).over(whole))
    # No level fits if rounding leaves even the last source capped: then all are.
    share = F.coalesce(F.col("level") * F.col("weight"), F.col("stop").cast("double"))
    return stated.select("source", "source_size", F.least(F.col("stop").cast("double"), share).alias("target"))


def _offset(seed: int) -> Column:
    """A uniform number of units below one copy, the same for a source in every run."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("offset"), F.col("source")))
    return F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("long")


def systematic(rows: DataFrame, seed: int = SEED, **mix) -> DataFrame:
    """The rows of ``sized`` with source_size, target and copies."""
    per_size = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    plan = targets(per_size, **mix)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * 2**BITS + 0.5)).otherwise(0).cast("long")
    plan = stored(plan.withColumn("expected", expected).withColumn("offset", _offset(seed)), "mix-targets")
    # Sizes of many rows, at most one per PER_SLICE rows of the table, are cut into slices of the hash.
    cut = per_size.where(F.col("n") > PER_SLICE).select("source", "size", F.ceil(F.col("n") / PER_SLICE).alias("slices"))
    named = [F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("at")]
    key = ["unnamed", "at", "size"]
    lead = F.conv(F.substring("tie", 1, 8), 16, 10).cast("double") / float(2**32)
    sliced = rows.select("doc", *named, "size", "tie").join(cut.select(*named, "size", "slices"), key, "left")
    sliced = sliced.withColumn("slice", F.coalesce(F.floor(lead * F.col("slices")), F.lit(0))).drop("slices")
    counts = sliced.groupBy(*key, "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy("unnamed", "at").orderBy("size", "slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*key, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy(*key, "slice").orderBy("tie")).cast("long")
    placed = sliced.withColumn("place", place).join(starts, [*key, "slice"])
    placed = placed.join(plan.select(*named, "source_size", "target", "expected", "offset"), key[:2])
    upto = F.col("offset") + (F.col("start") + F.col("place")) * F.col("expected")  # every document of a source expects the same
    copies = F.shiftright(upto, BITS) - F.shiftright(upto - F.col("expected"), BITS)
    return placed.select("doc", "size", "source_size", "target", copies.alias("copies"))


def plan(docs: DataFrame, seed: int = SEED, **mix) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row: how often the mix takes it, and how many words that is.

    ``mix`` may hold weights, percent and most (see ``targets``). Size counts words between ASCII blanks; a null or empty text
    has none. A null source is a source of its own, the last. Rows with a null or repeated doc_id are documents like others;
    equal rows are interchangeable. A source without words has target 0 and is not taken. Other columns are ignored whatever
    their names. An empty table gives an empty table.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    narrow = stored(sized(kept, seed).withColumn("doc", F.struct("doc.doc_id")), "mix-rows")
    out = systematic(narrow, seed, **mix)
    return out.select("doc.doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED, **mix) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as ``plan`` takes it."""
    taken = systematic(sized(docs, seed), seed, **mix).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
