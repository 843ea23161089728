"""Personal data: base patterns, then information-theoretic sanitisation of the terms that give them away.

A term reveals an entity as far as knowing the term makes the entity likelier. With counts of documents over the whole corpus
(N all, n_e with the entity, n_t with the term, n_te with both, anywhere in the text) the entity carries ln(N / n_e) of
information and the term gives away its pointwise mutual information ln(n_te N / (n_t n_e)). Their quotient is the disclosure:
1 if the term only ever stands in documents of the entity. Terms above a threshold are generalised, above a higher one removed,
wherever they stand: in every text of the corpus, with the entity or without it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .common import WordHashes, map_batches, shared, texts, tidy

KINDS = ["email", "ip", "card", "phone"]
MARKS = 1 << 20  # bytes of a table of low bits
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered only at its start: if it fails there, it fails at every later digit of the run.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_HEAD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the pattern, leftmost and non-overlapping, in time linear in the text: each @ is looked at once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _HEAD:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        # An @ that fails ends every run before it, so the next one need not look back past it.
        end = max(end, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base findings, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if not any(map(text.__contains__, "0123456789")):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def code(value: str) -> int:
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def text_key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:16]


def _shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, counts per kind and the base spans as text, one row per document."""

    def make():
        def step(b):
            spans = [base_spans(t) for t in b["text"]]
            out = {"doc_id": b["doc_id"], "text_key": list(map(text_key, b["text"])), "base": list(map(_shown, spans))}
            return out | {f"n_{kind}": [sum(k == n for n, _, _ in s) for s in spans] for k, kind in enumerate(KINDS)}

        return step

    return map_batches(texts(docs), make, "doc_id long, text_key binary, base string, " + ", ".join(f"n_{k} long" for k in KINDS))


class Passing(dict):
    """Code of a word, or None if its low bits are not in ``marks``; remembers up to ``most`` words."""

    def __init__(self, marks: bytes, most: int = 200_000):
        super().__init__()
        self.marks, self.most = marks, most

    def __missing__(self, word: str) -> int | None:
        n = code(word.lower())
        n = n if self.marks[n & (MARKS - 1)] else None
        if len(self) < self.most:
            self[word] = n
        return n


def marks_of(codes: DataFrame, column: str):
    """A broadcast table of the low bits of a column of codes, of ``MARKS`` bytes whatever their number."""
    table = bytearray(MARKS)
    for r in codes.select(F.expr(f"{column} & {MARKS - 1}").cast("int").alias("k")).distinct().toLocalIterator():
        table[r["k"]] = 1
    return shared(codes.sparkSession, bytes(table))


def _entities(text: str) -> set[str]:
    return {KINDS[k] + ":" + text[a:e].lower() for k, a, e in base_spans(text)}


def _terms(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text))}


def _summed(docs: DataFrame, keys: list[str], make, most: int) -> DataFrame:
    """(*keys, n): sums over all documents of what ``make()`` adds to a counter for each text.

    ``make()(text, sums)`` yields where the counter may be handed on. Each task adds up in memory and hands on its sums
    whenever it holds ``most`` keys, so few rows are shuffled.
    """

    def run(batches):
        import pyarrow as pa

        def out():
            columns = list(zip(*sums)) if len(keys) > 1 else [list(sums)]
            arrays = [pa.array([code(v) if isinstance(v, str) else v for v in c], pa.int64()) for c in (*columns, sums.values())]
            return pa.RecordBatch.from_arrays(arrays, [*keys, "n"])

        sums, add = Counter(), make()
        for batch in batches:
            for k in range(batch.num_rows):
                for _ in add(batch.column(0)[k].as_py(), sums):
                    if len(sums) > most:
                        yield out()
                        sums.clear()
        if sums:
            yield out()
        sums.clear()
        add = batch = None
        tidy()

    rows = texts(docs).select("text").mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "n"]))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def document_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(term, n): how many documents hold each term, over all terms of all whole texts; the term null counts the documents."""

    def make():
        def add(text, sums):
            sums.update(_terms(text))
            sums[None] += 1
            yield

        return add

    return _summed(docs, ["term"], make, most)


def entity_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(entity, n): how many documents hold each base finding."""

    def make():
        def add(text, sums):
            sums.update(_entities(text))
            yield

        return add

    return _summed(docs, ["entity"], make, most)


def joint_counts(docs: DataFrame, marks, most: int = 200_000) -> DataFrame:
    """(entity, term, n): how many documents hold both, anywhere in the text, for the entities that ``marks`` lets pass."""

    def make():
        passing, hashes = Passing(marks.value), WordHashes()

        def add(text, sums):
            entities = [n for e in _entities(text) if (n := passing[e]) is not None]
            if entities:
                terms = [n - (1 << 64) if (n := hashes[t]) >= 1 << 63 else n for t in _terms(text)]
                for e in entities:
                    sums.update((e, t) for t in terms)
                    yield

        return add

    return _summed(docs, ["entity", "term"], make, most)


def disclosing(docs: DataFrame, generalise: float, support: int) -> DataFrame:
    """(entity, term, disclosure) of pairs that share ``support`` documents or more and reach ``generalise``."""
    # An entity in fewer documents shares fewer with any term.
    entities = stored(entity_counts(docs).where(F.col("n") >= support).withColumnRenamed("n", "n_e"), "entity-documents")
    joint = joint_counts(docs, marks_of(entities, "entity")).where(F.col("n") >= support).withColumnRenamed("n", "n_te")
    counts = stored(document_counts(docs), "term-documents")
    total = counts.where("term is null").select("n").scalar()
    known = joint.join(entities, "entity").join(counts.withColumnRenamed("n", "n_t"), "term").withColumn("n_all", total)
    pmi = F.ln(F.col("n_te") * F.col("n_all") / (F.col("n_t").cast("double") * F.col("n_e")))
    share = F.when(F.col("n_e") < F.col("n_all"), pmi / F.ln(F.col("n_all") / F.col("n_e")))
    return known.select("entity", "term", F.round(share, 9).alias("disclosure")).where(F.col("disclosure") >= generalise)


def disclosing_terms(docs: DataFrame, generalise: float = 0.8, support: int = 3) -> DataFrame:
    """(term, disclosure): each disclosing term with the highest of its disclosures."""
    return stored(disclosing(docs, generalise, support).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing-terms")


def occurrences(docs: DataFrame, marks) -> DataFrame:
    """(text_key, term, spans): where each term that ``marks`` lets pass stands in each text, outside base findings."""

    def make():
        passing = Passing(marks.value)

        def step(b):
            out: dict[str, list] = {"text_key": [], "term": [], "spans": []}
            for t in b["text"]:
                if all(passing[w] is None for w in set(_TERM.findall(t))):
                    continue
                inside, found, k = _union(base_spans(t)), {}, 0
                for m in _TERM.finditer(t):
                    x, y = m.span()
                    while k < len(inside) and inside[k][1] <= x:
                        k += 1
                    if (n := passing[m.group()]) is not None and (k == len(inside) or y <= inside[k][0]):
                        found.setdefault(n, []).append({"start": x, "end": y})
                out["text_key"] += [text_key(t)] * len(found)
                out["term"] += found.keys()
                out["spans"] += found.values()
            return out

        return step

    return map_batches(texts(docs), make, "text_key binary, term long, spans array<struct<start: int, end: int>>")


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, by start."""
    out: list[tuple[int, int]] = []
    for a, e in sorted((a, e) for _, a, e in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def term_spans(docs: DataFrame, terms: DataFrame, marks, remove: float = 0.95) -> DataFrame:
    """(text_key, terms): every occurrence of the disclosing ``terms`` in each text, with what is done to it, by start."""
    # Copies of one text are combined before they are dealt by term.
    held = occurrences(docs, marks).groupBy("text_key", "term").agg(F.first("spans").alias("spans"))
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    span = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), action.alias("action")))
    hits = held.join(terms, "term").select("text_key", span.alias("spans"))
    return hits.groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("terms"))


def find(docs: DataFrame, remove: float = 0.95, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_terms for every row of ``docs``.

    ``spans`` lists the base findings as kind:start:end by kind, then the added terms as term:start:end. A null text is empty
    and has no findings; a null doc_id stays null; repeated rows get a row each and count as documents; other columns are
    ignored; an empty table gives an empty table.
    """
    base = find_base(docs)
    found = disclosing_terms(docs, **how)
    added = base.join(term_spans(docs, found, marks_of(found, "term"), remove), "text_key", "left")
    terms = F.transform(F.coalesce("terms", F.array()), lambda s: F.concat(F.lit("term:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    parts = F.filter(F.concat(F.array("base"), terms), lambda s: s != "")
    return added.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.array_join(parts, ",").alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, remove: float = 0.95, **how) -> DataFrame:
    """``docs`` with texts rewritten: findings become ``<email>``, ``<ip>``, ``<card>`` or ``<phone>``, generalised terms
    ``<term>``, removed terms go. All columns stay; a null text stays null; ``n_chars`` follows the text where there is one.

    Only texts with findings or with a term that may disclose are joined with the added spans; the rest pass by.
    """
    found = disclosing_terms(docs, **how)
    marks = marks_of(found, "term")

    def rewrite(text: str, terms) -> str:
        spans = [(a, b, f"<{KINDS[k]}>") for k, a, b in base_spans(text)]
        spans += [(s["start"], s["end"], "" if s["action"] == "remove" else "<term>") for s in (() if terms is None else terms)]
        out, at = [], 0
        for a, b, mark in sorted(spans):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def rewritten(text, terms):
        return text.combine(terms, lambda t, s: None if t is None else rewrite(t, s))

    @F.pandas_udf("binary")
    def key(text):
        passing = Passing(marks.value)
        return text.map(lambda t: text_key(t) if t and (base_spans(t) or any(passing[w] is not None for w in set(_TERM.findall(t)))) else None)

    kept = [c for c in docs.columns]
    # Written, so that a text is keyed once: a filter on the key would run it once more in the same task, and the other side again.
    keyed = stored(docs.withColumn("__key", key("text")), "keyed-texts")
    added = term_spans(docs, found, marks, remove).select(F.col("text_key").alias("__key"), F.col("terms").alias("__terms"))
    rewritten_rows = keyed.where("__key is not null").join(added, "__key", "left").withColumn("text", rewritten("text", "__terms"))
    if "n_chars" in kept:
        rewritten_rows = rewritten_rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return keyed.where("__key is null").select(kept).unionByName(rewritten_rows.select(kept))
