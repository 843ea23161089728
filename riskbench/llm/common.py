"""What the operators share: reading tables, running batches of rows in Python, words and hashes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` of a table of documents, whatever else it holds; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def tidy() -> None:
    """Give freed memory back: the worker stays while other work fills the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = 256, letters: int | None = None) -> DataFrame:
    """Run ``make()`` once a task and what it returns on slices of ``rows`` rows, or, with ``letters``, of as many rows as hold about that
    many bytes of text.

    A slice comes as a dict of Python lists and leaves as a dict of columns (lists or arrays) of ``schema``. Texts stay in
    Arrow until their slice is reached, so memory holds one Arrow batch and one slice.
    """
    struct = T.StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, step = to_arrow_schema(struct), make()
        for batch in batches:
            starts = list(range(0, batch.num_rows, rows))
            if letters and batch.num_rows:
                upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // letters
                starts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist()]
            for k, end in zip(starts, [*starts[1:], batch.num_rows]):
                out = step(batch.slice(k, end - k).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kinds], schema=kinds)
        step = batch = out = None  # else the last ones live on beyond the tidying
        tidy()

    return df.mapInArrow(run, struct)


def shared(spark: SparkSession, value):
    """A broadcast handle that is cheap to close over. Only for model files and fitted models of a bounded size."""
    return spark.sparkContext.broadcast(value)


class WordHashes(dict):
    """64-bit hashes of words (bytes, or text as UTF-8), remembered up to ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes | str) -> int:
        h = xxhash.xxh64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        if len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for k in range(1, width):
            h = h * U64(0x9E3779B97F4A7C15) + words[k : n + k]
        return np.unique(mix(h + U64(width)))
