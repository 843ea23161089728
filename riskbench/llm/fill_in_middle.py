"""Fill-in-the-middle: a text's middle is moved behind its end, between control strings.

Cuts lie at ends of units: a unit is a word with the blanks before it, or blanks at the end of the text. A text is taken in blocks of fixed
length; a Fenwick tree over the blocks holds how many units end in each and how many code points begin there. A cut after
``k`` units is found by binary lifting: the descent leads to the block in which unit ``k`` ends, with the units and code
points before it, and only this block is looked into again. So a text costs one scan and two short searches, and memory holds
the text, its output and counts of one byte in a thousand.

Whether, how and where a text is cut follows from a hash of seed and doc_id: the same in every run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import texts

SEED = 42
PLAIN, SPM = 50, 80  # percent of texts that change at all is 100 - PLAIN; percent of these with the suffix first
MARKS = ("<P>", "<S>", "<M>")
BLOCK = 4096  # bytes
SCAN = 256 * BLOCK  # bytes looked at together
HELD = 8 << 20  # bytes of output that a task holds
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Whether a unit ends with each byte of ``data[start:stop]``."""
    part = data[start : min(stop + 1, len(data))]
    blank = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
    ends = np.empty(stop - start, bool)
    here = blank[: stop - start]
    if stop < len(data):
        np.logical_and(~here, blank[1:], out=ends)
    else:
        ends[:-1] = ~here[:-1] & here[1:]
        ends[-1] = True  # the end of the text ends a word, or the blanks after the last one
    return ends


def point_starts(part: np.ndarray) -> np.ndarray:
    return (part & 0xC0) != 0x80


class Fenwick:
    """Sums of several counts over blocks. ``tree[i]`` is the sum of the ``i & -i`` blocks up to ``i``."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.tree = np.zeros((self.size + 1, counts.shape[1]), np.int64)
        self.tree[1:] = counts
        step = 1
        while step <= self.size:  # nodes of one length at a time hand their sum to the next longer one
            nodes = np.arange(step, self.size + 1, 2 * step)
            above = nodes + step
            inside = above <= self.size
            self.tree[above[inside]] += self.tree[nodes[inside]]
            step *= 2

    def total(self) -> np.ndarray:
        out, i = np.zeros(self.tree.shape[1], np.int64), self.size
        while i:
            out += self.tree[i]
            i -= i & -i
        return out

    def descend(self, k: int) -> tuple[int, np.ndarray]:
        """The block in which the ``k``-th of the first count lies (k from 1), and the sums of the blocks before."""
        at, before = 0, np.zeros(self.tree.shape[1], np.int64)
        for bit in range(self.size.bit_length() - 1, -1, -1):
            to = at + (1 << bit)
            if to <= self.size and before[0] + self.tree[to, 0] < k:
                at, before = to, before + self.tree[to]
        return at, before


def counted(data: np.ndarray) -> Fenwick:
    """Units that end and code points that begin, by block."""
    parts = []
    for start in range(0, len(data), SCAN):
        stop = min(start + SCAN, len(data))
        edges = np.arange(0, stop - start, BLOCK)
        flags = unit_ends(data, start, stop), point_starts(data[start:stop])
        parts.append(np.stack([np.add.reduceat(f, edges, dtype=np.int64) for f in flags], axis=1))
    return Fenwick(np.concatenate(parts) if parts else np.zeros((0, 2), np.int64))


def cut(data: np.ndarray, tree: Fenwick, k: int) -> tuple[int, int]:
    """Bytes and code points before the end of unit ``k``."""
    if not k:
        return 0, 0
    block, (units, points) = tree.descend(k)
    start = block * BLOCK
    stop = min(start + BLOCK, len(data))
    end = int(np.flatnonzero(unit_ends(data, start, stop))[k - units - 1]) + 1
    return start + end, int(points) + int(point_starts(data[start : start + end]).sum())


def transform_one(text: bytes, hashes: tuple[int, int, int, int], plain: int = PLAIN, spm: int = SPM, marks=MARKS) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data, (h1, h2, h3, h4) = np.frombuffer(text, np.uint8), hashes
    tree = counted(data)
    n = int(tree.total()[0])
    p, s, m = (x.encode() for x in marks)
    if not text or h3 % 100 >= plain or any(x in text for x in (p, s, m)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, upto) = cut(data, tree, low), cut(data, tree, high)
    if h4 % 100 < spm:
        return n, "spm", before, upto - before, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", before, upto - before, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def _hashes(seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    ``plain`` is the percentage of texts that change, ``spm`` that of these which put the suffix first. A null text is empty;
    an empty text, and one that holds a control string, stays as it is (form plain, no counts). A null doc_id hashes as an empty
    one. Repeated rows give the same output each. Other columns are ignored whatever their names. An empty table gives an
    empty table.
    """
    struct = T.StructType.fromDDL(SCHEMA)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(struct)
        close = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), list(zip(*(batch.column(k).to_pylist() for k in range(2, 6))))
            data, rows, held = batch.column(1).cast(pa.large_binary()), [], 0
            for k, doc_id in enumerate(ids):
                n, form, before, inside, output = transform_one(data[k].as_py(), hashes[k], plain, spm, marks)
                rows.append((doc_id, n, form, before, inside, output.decode("utf-8", "surrogatepass")))
                held += len(output)
                if held >= HELD:
                    yield close(rows)
                    rows, held = [], 0
            if rows:
                yield close(rows)

    return texts(docs).select("doc_id", "text", *_hashes(seed)).mapInArrow(run, struct)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from output and form alone. Each control string stands once in an output that is not plain: none was in
    the text, and no end of one is the beginning of another, so none can arise where parts meet."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
