"""Near duplicates of embeddings with a forest of random-projection trees.

Each tree splits at the median of a random projection, again and again, and vectors close to a cut go to both sides. Trees are
fitted on a bounded sample, as many as its links need, and every vector is sent to its leaves in all of them. Inside a leaf, vectors are compared in double
precision, block by block: a leaf of any size is cut into blocks and each pair of blocks is a group of its own. A pair that
shares several leaves counts in the first one only, which each side can tell from the leaves the other carries. So links are
counted without listing pairs, and each block hands on a spanning forest for the union.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .common import map_batches, shared
from .components import connected

SAMPLE = 60_000  # vectors on which the trees are fitted
BLOCK = 1024  # vectors of a block
LOSE = 0.1  # share of a node's links that a cut may part
TRIES = 4  # directions tried for a cut
MOST = 40  # trees before all vectors are compared
COPIES = 4.0  # of a vector in one tree, as the mean over the vectors; a leaf that would need more stays larger
ROWS = 4096  # vectors of the sample that are copied at once


class Forest:
    """Random-projection trees: per tree, nodes as (direction, cut) or a leaf number.

    A cut that parts more than ``LOSE`` of a node's links is not made, so a loose cluster stays one leaf of any size. Trees
    are added to the first ``trees`` until the links of the sample are found with ``recall``; if ``MOST`` do not reach it,
    one leaf holds everything and all vectors are compared.
    """

    def __init__(self, x: np.ndarray, total: int, trees: int, leaf: int, spill: float, threshold: float = 0.9, recall: float = 0.99, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.spill, self.threshold, self.trees = spill, threshold, []
        # A leaf of the sample stands for more vectors of the table.
        self.least = max(8, int(leaf * len(x) / max(total, 1)))
        links = self._links(x, total, rng)
        found = np.zeros(len(links[0]), bool)
        while len(self.trees) < trees or self._recall(found, links[2]) < recall:
            if len(self.trees) >= max(trees, MOST):
                self.trees = [1]
                break
            self.trees.append(self._grow(x, rng, [0]))
            self._meet(self.trees[-1], x, links, found)

    def _links(self, x, total, rng, most: int = 200):
        """Two arrays of linked vectors by number and the query of each, and the vectors whose numbers follow those of the sample: up to
        ``most`` links of up to 2000 vectors of the sample.

        If the table is larger than the sample, small groups are hardly in it together; pairs just at the threshold stand for them.
        """
        a, b, planted = [], [], np.empty((0, x.shape[1]))
        queries = rng.permutation(len(x))[:2000]
        for k in range(0, len(queries), 64):
            near = x[queries[k : k + 64]] @ x.T >= self.threshold
            for q, row in zip(queries[k : k + 64].tolist(), near):
                row[q] = False
                own = np.flatnonzero(row)
                own = rng.choice(own, most, replace=False) if len(own) > most else own
                a.append(np.full(len(own), q, np.int32))
                b.append(own.astype(np.int32))
        of = list(a)
        if total > len(x) and x.shape[1] > 1:
            v = x[queries]
            side = rng.normal(size=v.shape)
            side -= (side * v).sum(1, keepdims=True) * v
            side /= np.linalg.norm(side, axis=1, keepdims=True)
            planted = self.threshold * v + np.sqrt(max(0.0, 1 - self.threshold**2)) * side
            a.append(queries.astype(np.int32))
            b.append((len(x) + np.arange(len(queries))).astype(np.int32))
            of.append((len(x) + queries).astype(np.int32))
        a, b, of = (np.concatenate(n) if n else np.empty(0, np.int32) for n in (a, b, of))
        return a, b, of, planted

    def _meet(self, tree, x, links, found) -> None:
        """Mark in ``found`` the links whose ends share a leaf of ``tree``: both go down it together, by number."""
        a, b, _, planted = links

        def send(node, left):
            if not len(left):
                return
            if isinstance(node, int):
                found[left] = True
                return
            direction, cut, below, above = node
            ends, at = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
            p = np.empty(len(ends))
            for k in range(0, len(ends), ROWS):
                some = ends[k : k + ROWS]
                own = some < len(x)
                p[k : k + ROWS][own], p[k : k + ROWS][~own] = x[some[own]] @ direction, planted[some[~own] - len(x)] @ direction
            low, high = p < cut + self.spill, p >= cut - self.spill
            first, second = at[: len(left)], at[len(left) :]
            send(below, left[low[first] & low[second]])
            rest = left[high[first] & high[second]]
            send(above, rest[~found[rest]])

        send(tree, np.flatnonzero(~found))

    def _recall(self, found, of) -> float:
        """The least of the share of links found and the mean share by query, of the sample's own links and of the planted ones."""
        if not len(of):
            return 1.0
        if not self.trees:
            return 0.0
        _, first, n = np.unique(of, return_inverse=True, return_counts=True)
        shares = np.bincount(first, found) / n
        single = n == 1
        least = [float(found.mean()), float(shares.mean())]
        return min(least + ([float(shares[single].mean())] if single.any() and single.sum() >= 100 else []))

    def _grow(self, x, rng, leaves, depth: int = 0, room: float = COPIES):
        if len(x) > self.least and depth < 40:
            some = rng.choice(len(x), min(len(x), 64), replace=False)
            linked = x[some] @ x.T >= self.threshold
            linked[np.arange(len(some)), some] = False
            for _ in range(TRIES):
                direction = rng.normal(size=x.shape[1])
                direction /= np.linalg.norm(direction)
                p = x @ direction
                cut = float(np.median(p))
                left, right = p < cut + self.spill, p >= cut - self.spill
                parted = ~(left[some][:, None] & left) & ~(right[some][:, None] & right)
                # A split that sends nearly everything both ways cannot part this node, and many that send much of it fill the tree with copies.
                left_n, right_n = int(left.sum()), int(right.sum())
                more = (left_n + right_n) / len(x)
                if max(left_n, right_n) < 0.95 * len(x) and more <= room and (linked & parted).sum() <= LOSE * linked.sum():
                    del p, linked, parted
                    return direction, cut, self._grow(x[left], rng, leaves, depth + 1, room / more), self._grow(x[right], rng, leaves, depth + 1, room / more)
        leaves[0] += 1
        return leaves[0]

    def leaves(self, x: np.ndarray) -> list[list[list[int]]]:
        """Per vector and tree, the leaves it lies in."""
        out = [[[] for _ in self.trees] for _ in range(len(x))]

        def send(node, rows, tree):
            if not len(rows):
                return
            if isinstance(node, int):
                for r in rows.tolist():
                    out[r][tree].append(node)
                return
            direction, cut, left, right = node
            p = x[rows] @ direction
            send(left, rows[p < cut + self.spill], tree)
            send(right, rows[p >= cut - self.spill], tree)

        for tree, root in enumerate(self.trees):
            send(root, np.arange(len(x)), tree)
        return out


def units(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision of the usable ones, and which these are: not null, not zero, all finite, ``width`` long."""
    ok = [v is not None and len(v) == width and None not in v for v in vectors]
    x = np.array([v for v, o in zip(vectors, ok) if o], float).reshape(-1, width)
    at = np.flatnonzero(ok)
    with np.errstate(all="ignore"):
        # Scaled first: the squares of very large and very small numbers leave the range.
        top = np.abs(x).max(1, initial=0)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good][:, None]
        return x / np.linalg.norm(x, axis=1, keepdims=True), at[good]


def compare(threshold: float):
    """The group function over one pair of blocks of one leaf: links per vector, and links that span its components."""

    def run(pdf):
        import pandas as pd

        tree, leaf = int(pdf["tree"].iloc[0]), int(pdf["leaf"].iloc[0])
        first, second = int(pdf["first"].iloc[0]), int(pdf["second"].iloc[0])
        x = np.array([np.frombuffer(v, "<f8") for v in pdf["vector"]])
        ids, copies = pdf["vec_id"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        earlier = [np.frombuffer(v, "<i4").reshape(-1, 2) for v in pdf["earlier"]]
        block = pdf["block"].to_numpy()
        a, b = (np.flatnonzero(block == first), np.flatnonzero(block == second)) if first != second else (np.arange(len(x)),) * 2
        links = x[a] @ x[b].T >= threshold
        if first == second:
            np.fill_diagonal(links, False)
        # Drop pairs that an earlier leaf shares: for each earlier leaf, the rows that lie in it.
        inside: dict[tuple[int, int], list[int]] = {}
        for r, pairs in enumerate(earlier):
            for key in map(tuple, pairs.tolist()):
                if key < (tree, leaf):
                    inside.setdefault(key, []).append(r)
        where_a, where_b = np.full(len(x), -1), np.full(len(x), -1)
        where_a[a], where_b[b] = np.arange(len(a)), np.arange(len(b))
        for rows in inside.values():
            rows = np.array(rows)
            ra, rb = where_a[rows], where_b[rows]
            ra, rb = ra[ra >= 0], rb[rb >= 0]
            if len(ra) and len(rb):
                links[np.ix_(ra, rb)] = False
        per_a = links @ copies[b]
        counts = np.bincount(a, per_a, len(x)).astype(np.int64)
        if first != second:
            counts += np.bincount(b, copies[a] @ links, len(x)).astype(np.int64)
        # Spanning forest by breadth-first search over the boolean matrix.
        forest_a, forest_b = _spanning(links, ids[a], ids[b], first == second)
        some = np.flatnonzero(counts)
        return pd.concat([
            pd.DataFrame({"vec_id": ids[some], "n": counts[some], "to": pd.array([None] * len(some), "Int64")}),
            pd.DataFrame({"vec_id": forest_a, "n": np.zeros(len(forest_a), np.int64), "to": pd.array(forest_b, "Int64")}),
        ])

    return run


def _spanning(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, same: bool) -> tuple[list[int], list[int]]:
    out_a, out_b = [], []
    new_a, new_b = links.any(1), links.any(0)
    while new_a.any():
        wave_a = np.array([int(new_a.argmax())])
        new_a[wave_a] = False
        if same:
            new_b[wave_a] = False
        while len(wave_a):
            hit = links[wave_a] & new_b
            b = np.flatnonzero(hit.any(0))
            if not len(b):
                break
            out_a += ids_a[wave_a[hit[:, b].argmax(0)]].tolist()
            out_b += ids_b[b].tolist()
            new_b[b] = False
            if same:
                new_a[b] = False
                wave_a = b
            else:
                hit = links[:, b] & new_a[:, None]
                wave_a = np.flatnonzero(hit.any(1))
                out_a += ids_a[wave_a].tolist()
                out_b += ids_b[b[hit[wave_a].argmax(1)]].tolist()
                new_a[wave_a] = False
    return out_a, out_b


def dedup(embeddings: DataFrame, threshold: float = 0.9, trees: int = 6, leaf: int = 1000, spill: float = 0.02) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings`` (vec_id, embedding).

    Vectors that are null, zero, hold null or non-finite parts or are not as long as most link with nothing and are their own
    component. Equal vectors are compared once and count as often as they stand in the table. A null vec_id takes part in no
    link and has a null component; rows of one vec_id are one vector if equal, and otherwise share the component and each
    have the sum of links. Other columns are ignored; an empty table gives an empty table.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    widths = rows.where("embedding is not null").groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n"))
    width = widths.orderBy(F.desc("n"), "w").first()
    if width is None or width["w"] == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width = width["w"]

    def normalise():
        def step(b):
            x, at = units(b["embedding"], width)
            vectors: list = [None] * len(b["vec_id"])
            for k, v in zip(at.tolist(), x):
                vectors[k] = v.astype("<f8").tobytes()
            return {"vec_id": b["vec_id"], "vector": vectors}

        return step

    unit = stored(map_batches(rows, normalise, "vec_id long, vector binary", rows=2048), "unit-vectors")
    usable = unit.where("vector is not null and vec_id is not null").select("vec_id", "vector").distinct()
    # One row per distinct vector, named by its smallest id.
    classes = stored(usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toArrow()
    x = np.concatenate([np.empty(0), *(np.frombuffer(v.as_py(), "<f8") for v in sample["vector"])]).reshape(-1, width)
    del sample
    forest = shared(spark, Forest(x, total, trees, leaf, spill, threshold))

    def send():
        def step(b):
            leaves = forest.value.leaves(np.array([np.frombuffer(v, "<f8") for v in b["vector"]]).reshape(-1, width))
            out: dict[str, list] = {"vec_id": [], "copies": [], "vector": [], "tree": [], "leaf": [], "earlier": []}
            for k, per_tree in enumerate(leaves):
                pairs = [(t, n) for t, own in enumerate(per_tree) for n in own]
                for t, n in pairs:
                    for name, v in zip(out, (b["rep"][k], b["copies"][k], b["vector"][k], t, n, np.array(pairs, "<i4").tobytes())):
                        out[name].append(v)
            return out

        return step

    sent = stored(map_batches(classes, send, "vec_id long, copies long, vector binary, tree int, leaf int, earlier binary", rows=2048), "leaf-vectors")
    sizes = sent.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = sent.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    # Block i meets every block j: as the first of (i, j) for j >= i, as the second of (j, i) for j < i.
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    found = met.groupBy("tree", "leaf", "first", "second").applyInPandas(compare(threshold), "vec_id long, n long, to long")
    found = stored(found, "vector-links")
    links = found.where("to is null").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n"))
    edges = found.where("to is not null").select(F.col("vec_id").alias("a"), F.col("to").alias("b"))
    # An id with several vectors is one node.
    same = usable.join(classes.select("vector", "rep"), "vector").where("rep != vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    repeated = usable.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("vec_id").alias("b"))
    labels = connected(edges.unionByName(same.join(repeated, "b", "left_semi").select("a", "b")))
    of = classes.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    # Copies of a vector are linked with each other.
    of = of.select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = unit.join(of, "vector", "left").withColumn("n_links", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)))
    out = out.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
