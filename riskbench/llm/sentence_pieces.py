"""SentencePiece encoding and decoding.

A text is normalised by replacing spaces with their sign and adding the dummy prefix; models that ask for another normaliser
are refused. A letter outside every piece falls back to its bytes. No transducers are built: unigram models take the cheapest
path over positions, BPE models a backtracking search over positions and the piece that reached them.

For unigram models the weights alone decide. A BPE model fixes its result by merge order, not by the sum of scores, so its
search only lets pieces stand side by side if merging their joined text gives these two again; a sequence of pieces is what merging gives exactly if all its neighbours are
allowed, which leaves one allowed path per position. Pairs are tested when first met.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, shared, texts

SIGN = "▁"  # stands for a space inside pieces
REMEMBERED = 300_000  # chunks in each of two generations


class Machines:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is compiled; this model asks for another one")
        self.prefix = norm.add_dummy_prefix
        self.unigram = model.trainer_spec.model_type == 1
        self.ids, self.score, self.byte_ids, self.unk = {}, {}, {}, 0
        self.out: list[bytes] = []
        for k, p in enumerate(model.pieces):
            self.out.append(p.piece.encode())
            if p.type in (1, 4):
                self.ids[p.piece], self.score[p.piece] = k, p.score
            elif p.type == 6:
                byte = int(p.piece[1:-1], 16)
                self.byte_ids[byte] = k
                self.out[k] = bytes([byte])
            else:
                self.out[k] = b""
                self.unk = k if p.type == 2 else self.unk
        self.out[self.unk] = " ⁇ ".encode()
        self.longest = max(map(len, self.ids), default=1)
        self.letters = set("".join(self.ids))
        self.bigrams = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.reach: dict[str, int] = {}  # longest piece that begins with two letters
        for p in self.ids:
            self.reach[p[:2]] = max(self.reach.get(p[:2], 1), len(p))
        self.unknown = 10.0 - min(self.score.values(), default=0.0)
        # Pieces do not run from other letters into a space sign: texts may be cut before each run of signs, and around
        # letters that no piece holds.
        self.cuttable = not any(SIGN in p.lstrip(SIGN) for p in self.ids)
        cut = "".join(re.escape(c) for c in "\t\n\r" if c not in self.letters)
        self.chunks = re.compile(f"{SIGN}*[^{SIGN}{cut}]+|{SIGN}+" + (f"|[{cut}]" if cut else ""), re.S)
        self.allowed: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Merging by score, leftmost first: what defines the acceptor. Only run on the joined text of two pieces."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def accepts(self, a: str, b: str) -> bool:
        ok = self.allowed.get((a, b))
        if ok is None:
            if len(self.allowed) > 400_000:
                self.allowed.clear()
            ok = self.allowed[a, b] = self.merge(a + b) == [a, b]
        return ok

    def is_whole(self, piece: str) -> bool:
        ok = self.whole.get(piece)
        if ok is None:
            ok = self.whole[piece] = self.merge(piece) == [piece]
        return ok

    def fallback(self, letter: str) -> list[int]:
        return [self.byte_ids.get(b, self.unk) for b in letter.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]

    def shortest_path(self, chunk: str) -> list[int]:
        """Ids on the cheapest path through the composition of the machines with ``chunk``."""
        return self._cheapest(chunk) if self.unigram else self._finite(chunk)

    def _finite(self, chunk: str) -> list[int]:
        """BPE: every finite weight is 0, so the first complete path found depth first, longest piece first, is a shortest one.

        A position that cannot be left is dead however it was reached, as only one allowed path leads to it.
        """
        n, ids, pos, path = len(chunk), self.ids, 0, []
        reach = self.reach.get
        dead, length = bytearray(n + 1), min(reach(chunk[:2], 1), n)
        while pos < n:
            before = path[-1] if path else ""
            while length:
                piece = chunk[pos : pos + length]
                if piece in ids and not dead[pos + length] and (self.accepts(before, piece) if before in ids else self.is_whole(piece)):
                    break
                length -= 1
            if not length and chunk[pos] not in ids and not dead[pos + 1]:
                length = 1
            if length:
                path.append(chunk[pos : pos + length])
                pos += length
                length = min(reach(chunk[pos : pos + 2], 1), n - pos)
            else:
                dead[pos] = 1
                length = len(path.pop())
                pos -= length
                length -= 1
        return [k for p in path for k in ((ids[p],) if p in ids else self.fallback(p))]

    def _cheapest(self, chunk: str) -> list[int]:
        """Unigram: Viterbi over end positions, a letter outside the pieces at a weight above any of theirs."""
        n, ids = len(chunk), self.ids
        cost, last = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                piece = chunk[start:end]
                weight = -self.score[piece] if piece in ids else self.unknown if end - start == 1 else math.inf
                if cost[start] + weight < cost[end]:
                    cost[end], last[end] = cost[start] + weight, start
        path, end = [], n
        while end:
            piece = chunk[last[end] : end]
            path += (ids[piece],) if piece in ids else reversed(self.fallback(piece))
            end = last[end]
        return path[::-1]

    def parts(self, chunk: str) -> list[str]:
        """Cut where two letters meet that never meet inside a piece: no path crosses there."""
        cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.bigrams]
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]

    def normalise(self, text: str) -> str:
        return (SIGN if self.prefix and text else "") + text.replace(" ", SIGN)


class Encoder:
    """Encodes and decodes with compiled machines.

    Chunks of up to 40 letters are remembered in two generations of ``most`` each: when the young one is full, the old one is
    dropped. A worker keeps them from task to task under ``name``.
    """

    kept: dict[str, list[dict[str, bytes]]] = {}

    def __init__(self, machines: Machines, name: str = "", most: int = REMEMBERED):
        self.m, self.most = machines, most
        self.ages = Encoder.kept.setdefault(f"{name} {most}", [{}, {}]) if name else [{}, {}]

    def chunk(self, c: str) -> bytes:
        young, old = self.ages
        got = young.get(c)
        if got is None:
            got = old.get(c)
            if got is None:
                parts = self.m.parts(c)
                got = b"".join(map(self.chunk, parts)) if len(parts) > 1 else np.array(self.m.shortest_path(c), "<i4").tobytes()
            if len(c) <= 40:
                if len(young) >= self.most:
                    self.ages[:] = [{}, young]
                self.ages[0][c] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        text = self.m.normalise(text)
        chunks = self.m.chunks.findall(text) if self.m.cuttable else [text] if text else []
        return np.frombuffer(b"".join(map(self.chunk, chunks)), "<i4")

    def decode(self, ids) -> str:
        """The inverse machine: pieces to bytes, the sign back to a space, without the dummy prefix. Bytes that form no
        letter become U+FFFD."""
        raw = b"".join(map(self.m.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = raw.decode("utf-8", "replace").replace(SIGN, " ")
        return text[1:] if self.m.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids (array of piece ids), n_ids and n_bytes_ids (ids from the byte fallback) for every row.

    A null text is empty and gives no ids; a null doc_id stays null; repeated rows are encoded each; other columns are
    ignored; an empty table gives an empty table. ``remembered`` bounds the chunks that a worker keeps, in time and memory only.
    """
    return _encoded(docs, model, "doc_id long, ids array<int>, n_ids long, n_bytes_ids long", remembered)


def decode(coded: DataFrame, model: str) -> DataFrame:
    """doc_id and text for every row of doc_id and ids. Null ids give an empty text; ids outside the model an error."""
    machines = shared(coded.sparkSession, Machines(model))

    def make():
        d = Encoder(machines.value)
        return lambda b: {"doc_id": b["doc_id"], "text": [d.decode(i or []) for i in b["ids"]]}

    return map_batches(coded.select("doc_id", "ids"), make, "doc_id long, text string")


def check_round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, n_bytes_ids, ids_sha256 (of the ids as 4-byte little-endian integers), decoded_chars and round_trip:
    whether decoding gives the text again (it cannot where a text holds the space sign itself)."""
    return _encoded(docs, model, "doc_id long, n_ids long, n_bytes_ids long, ids_sha256 string, decoded_chars long, round_trip boolean")


def _encoded(docs: DataFrame, model: str, schema: str, remembered: int = REMEMBERED) -> DataFrame:
    machines = shared(docs.sparkSession, Machines(model))
    wants = {c.split(" ")[0] for c in schema.split(", ")}

    def make():
        m = machines.value
        e = Encoder(m, model, remembered)
        of_bytes = np.zeros(len(m.out), bool)
        of_bytes[list(m.byte_ids.values())] = True

        def step(b):
            ids = [e.encode(t) for t in b["text"]]
            out = {"doc_id": b["doc_id"], "n_ids": list(map(len, ids)), "n_bytes_ids": [int(of_bytes[i].sum()) for i in ids]}
            if "ids" in wants:
                out["ids"] = ids
            if "round_trip" in wants:
                back = [e.decode(i) for i in ids]
                out["ids_sha256"] = [hashlib.sha256(i.tobytes()).hexdigest() for i in ids]
                out["decoded_chars"] = list(map(len, back))
                out["round_trip"] = [x == t for x, t in zip(back, b["text"])]
            return out

        return step

    return map_batches(texts(docs), make, schema, rows=64)
