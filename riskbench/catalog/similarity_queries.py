"""Queries: squared-cosine similarity over the embeddings. The SQL lists all pairs; the Spark side never does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import r6
from ..operators import similarity as N
from ..sources import driver_tables as D
from .base import register

UNITS = """
WITH raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
units AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM raw)
"""


def embeddings(spark, sf_dir):
    return D.table(spark, sf_dir, "embeddings")


def _is_test(key: str):
    return F.col(key) % 5 == 0


@register(
    "similarity_row_sums",
    UNITS + """SELECT a.vec_id, a.label, b.label AS against, round(SUM(pow(list_dot_product(a.u, b.u), 2)), 6) AS similarity_sum
               FROM units a CROSS JOIN units b GROUP BY ALL""",
)
def similarity_row_sums(spark, sf_dir):
    s = N.row_sums(embeddings(spark, sf_dir), "vec_id", "embedding", "label")
    return s.withColumn("similarity_sum", r6(F.col("similarity_sum")))


@register(
    "similarity_upper_triangle",
    UNITS + """SELECT (SELECT COUNT(*) FROM units) AS n, round(AVG(pow(list_dot_product(a.u, b.u), 2)), 9) AS mean_similarity
               FROM units a JOIN units b ON a.vec_id < b.vec_id""",
)
def similarity_upper_triangle(spark, sf_dir):
    """Mean over the whole strict upper triangle."""
    t = N.total_similarity(embeddings(spark, sf_dir), "embedding")
    return t.select("n", F.round("mean_similarity", 9).alias("mean_similarity"))


@register(
    "similarity_cross_block",
    UNITS + """SELECT a.vec_id, b.label, COUNT(*) AS "rows", round(AVG(pow(list_dot_product(a.u, b.u), 2)), 6) AS mean_similarity
               FROM units a CROSS JOIN units b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 GROUP BY ALL""",
)
def similarity_cross_block(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    m = N.cross_mean(e.where(_is_test("vec_id")), e.where(~_is_test("vec_id")), "vec_id", "embedding", "label")
    return m.withColumn("mean_similarity", r6(F.col("mean_similarity")))


def _ring(spark, sf_dir):
    """Pairs asked for: each vector with its next seven ids, and the same pairs reversed."""
    ids = embeddings(spark, sf_dir).select(F.col("vec_id").alias("i"))
    ahead = ids.select("i", F.explode(F.sequence(F.col("i"), F.col("i") + 7)).alias("j"))
    return ahead.unionByName(ahead.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j")))


RING = """, ring AS (SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 1 ELSE pow(list_dot_product(a.u, b.u), 2) END AS k
             FROM units a JOIN units b ON abs(a.vec_id - b.vec_id) <= 7)"""


@register("similarity_requested_pairs", UNITS + RING + "SELECT i, j, round(k, 6) AS similarity FROM ring")
def similarity_requested_pairs(spark, sf_dir):
    p = N.pair_similarity(embeddings(spark, sf_dir), _ring(spark, sf_dir), "vec_id", "embedding")
    return p.select("i", "j", r6(F.col("similarity")).alias("similarity"))


@register(
    "similarity_slice",
    UNITS + RING + "SELECT i, j, round(k, 6) AS similarity FROM ring WHERE i % 5 = 0 AND j IN (SELECT vec_id FROM units WHERE label < 5)",
)
def similarity_slice(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    pairs = N.slice_pairs(_ring(spark, sf_dir), e.where(_is_test("vec_id")), e.where("label < 5"), "vec_id")
    p = N.pair_similarity(e, pairs, "vec_id", "embedding")
    return p.select("i", "j", r6(F.col("similarity")).alias("similarity"))


@register(
    "similarity_kernel_checks",
    UNITS + RING + """SELECT (SELECT COUNT(*) FROM units) AS "rows", TRUE AS diagonal_ok, COUNT(*) AS entries, TRUE AS symmetric FROM ring""",
)
def similarity_kernel_checks(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    c = N.kernel_checks(N.pair_similarity(e, _ring(spark, sf_dir), "vec_id", "embedding"), N.normalised(e, "embedding"))
    return c.select("rows", (F.col("diagonal_gap") < 1e-9).alias("diagonal_ok"), "entries", (F.col("symmetry_gap") < 1e-9).alias("symmetric"))


@register(
    "similarity_feature_map",
    UNITS + """SELECT a.vec_id, round(pow(list_dot_product(a.u, b.u), 2), 6) AS similarity_to_next FROM units a JOIN units b ON b.vec_id = a.vec_id + 1""",
)
def similarity_feature_map(spark, sf_dir):
    """Inner products of the explicit map of each vector and the next one."""
    e = embeddings(spark, sf_dir).select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    mine = N.pair_features(both, "embedding", ["vec_id", "next"], "mine")  # mapped after the join: only vectors are moved
    other = N.pair_features(mine, "next", ["vec_id", "mine"], "other")
    return other.select("vec_id", r6(N.dot(F.col("mine"), F.col("other"))).alias("similarity_to_next"))


@register(
    "similarity_pair_budget",
    """WITH c AS (SELECT COUNT(*) FILTER (vec_id % 5 <> 0) AS tr, COUNT(*) FILTER (vec_id % 5 = 0) AS te FROM embeddings)
       SELECT tr AS n_train, te AS n_test, CAST(tr * (tr - 1) // 2 AS BIGINT) AS train_pairs, te * tr AS test_pairs, CAST(tr * (tr - 1) // 2 + te * tr AS BIGINT) AS total_pairs,
              round((tr * (tr - 1) // 2 + te * tr) * 0.004::DOUBLE, 6) AS est_seconds FROM c""",
)
def similarity_pair_budget(spark, sf_dir):
    test = _is_test("vec_id")
    c = embeddings(spark, sf_dir).agg(F.count(F.when(~test, 1)).alias("n_train"), F.count(F.when(test, 1)).alias("n_test"))
    b = c.withColumns(N.pair_budget(F.col("n_train"), F.col("n_test")))
    return b.withColumn("est_seconds", r6(F.col("est_seconds")))


@register("similarity_cached", UNITS + RING + "SELECT i, j, round(k, 6) AS similarity FROM ring")
def similarity_cached(spark, sf_dir):
    """Requested pairs kept under a key of the data; the second write is skipped."""
    from ..session import new_path

    e = embeddings(spark, sf_dir)
    folder, name = new_path(spark, "similarity"), N.content_key(e, "vec_id", "embedding", "squared-cosine")
    for _ in range(2):
        out = N.cached(N.pair_similarity(e, _ring(spark, sf_dir), "vec_id", "embedding"), name, folder)
    return out.select("i", "j", r6(F.col("similarity")).alias("similarity"))
