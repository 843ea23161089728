"""A join that keeps hot keys out of the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_hot_apart(rows: DataFrame, hot: DataFrame, cold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``rows`` with a lookup given in two disjoint parts.

    ``hot`` holds the keys with many rows each. A key above a fixed share of the rows is hot, so there is a bounded number
    of them: they are broadcast, and their rows never meet in one task. The rest joins by shuffle, where no key is large.
    """
    keys = list(keys)
    names = F.broadcast(hot.select(*keys).distinct())
    rest = rows.join(names, keys, "left_anti").join(cold, keys)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))
