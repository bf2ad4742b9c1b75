"""SentencePiece encoding and decoding: Aho-Corasick automaton, one Viterbi pass.

All pieces go into one automaton.  It reads a text once; at each position its
output links give every piece that ends there, longest first, and each relaxes
the best score of that position (a piece's score added to the best score where
it starts).  The best path back is the segmentation with the greatest sum of
log probabilities; of equal sums the one with the longest last piece wins.  A
unigram model's scores are log probabilities.  A merge-trained (BPE) model's are
merge ranks, which do not add up: there a piece of rank r has 1/((r+1)H), Zipf's
law over the model's H = 1 + 1/2 + ... ; the result is a best-scoring
segmentation, mostly but not always that of the merges.
White space follows the model: a space becomes U+2581 and one is put before the
text; characters that no piece covers become the bytes of their UTF-8 form.

No piece has U+2581 after another character, nor any other character next to a
line feed (both are checked when the model is read), so the best path of a text
is the best paths of its words one after another, and each task keeps those of
the words it has met (up to ``CACHE`` of them, then it starts anew).

The model file is read on the driver, by a path that is a parameter, and its
pieces (a vocabulary, not data) are broadcast.

Cases: a null text has null ids; an empty one has none; any text, also with
U+2581 or code points outside the model, decodes to itself.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 300_000
MARK, HIDDEN = "▁", "\udcff"  # the second stands for a literal U+2581; no UTF-8 text holds it


class Pieces:
    """What encoding and decoding need of a model."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int], size: int):
        self.pieces, self.byte_ids, self.size = pieces, byte_ids, size
        self.least = min(s for _, s, _ in pieces) - 10.0
        for p, _, _ in pieces:
            if MARK in p.lstrip(MARK) or ("\n" in p and p != "\n"):
                raise ValueError(f"piece {p!r} crosses a word's start")

    @classmethod
    def read(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        byte_ids = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
        normal = [(m.id_to_piece(i), m.get_score(i), i) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls(log_probabilities(normal), [byte_ids[f"<0x{b:02X}>"] for b in range(256)], len(ids))


def log_probabilities(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Pieces with additive scores: whole-numbered (merge) scores by Zipf's law."""
    if any(s > 0 or s != int(s) for _, s, _ in pieces):
        return pieces
    ranks = [min(int(-s), len(pieces)) for _, s, _ in pieces]  # pieces kept out of merging come last
    total = sum(1.0 / (r + 1) for r in range(len(pieces)))
    return [(p, -math.log((r + 1) * total), i) for (p, _, i), r in zip(pieces, ranks)]


class Encoder:
    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for p, score, i in pieces.pieces:
            self.auto.add_word(p, (len(p), score, i))
        self.auto.make_automaton()
        self.single = frozenset(p for p, _, _ in pieces.pieces if len(p) == 1)
        self.least, self.byte_ids = pieces.least, pieces.byte_ids
        self.cache: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """Ids of the best path of a text with U+2581 for spaces."""
        n = len(text)
        best = [0.0] + [-1e300] * n
        back: list = [None] * (n + 1)
        if self.single.issuperset(text):
            for end, (size, score, i) in self.auto.iter(text):
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (size, i)
        else:
            ends: list[list] = [[] for _ in range(n)]
            for end, found in self.auto.iter(text):
                ends[end].append(found)
            for end in range(n):
                for size, score, i in ends[end]:
                    total = best[end + 1 - size] + score
                    if total > best[end + 1]:
                        best[end + 1], back[end + 1] = total, (size, i)
                if text[end] not in self.single and best[end] + self.least > best[end + 1]:
                    best[end + 1], back[end + 1] = best[end] + self.least, (1, -1)
        out: list[int] = []
        at = n
        while at:
            size, i = back[at]
            if i < 0:
                char = MARK if text[at - 1] == HIDDEN else text[at - 1]
                out.extend(self.byte_ids[b] for b in reversed(char.encode()))
            else:
                out.append(i)
            at -= size
        out.reverse()
        return out

    def words(self, text: str) -> list[str]:
        """Words with their leading spaces, line feeds apart; their paths join to the text's."""
        if MARK in text:
            text = text.replace(MARK, HIDDEN)
        return _WORD.findall(" " + text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        cache, words = self.cache, self.words(text)
        for w in set(words):
            if w not in cache:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = np.array(self.segment(w.replace(" ", MARK)), np.int32).tobytes()
        try:
            return b"".join(map(cache.__getitem__, words))
        except KeyError:  # the cache started anew within this text
            return b"".join(np.array(self.segment(w.replace(" ", MARK)), np.int32).tobytes() for w in words)


_WORD = re.compile(r" *[^ \n]+|\n| +")


class Decoder:
    def __init__(self, pieces: Pieces):
        self.body = [b""] * pieces.size
        for p, _, i in pieces.pieces:
            self.body[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(pieces.byte_ids):
            self.body[i] = bytes([b])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.body.__getitem__, ids))[1:]


_MADE: dict[int, tuple] = {}


def _coders(shared) -> tuple[Encoder, Decoder]:
    """One automaton per worker process and model."""
    key = id(shared.value)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = (Encoder(shared.value), Decoder(shared.value), shared.value)
    return _MADE[key][:2]


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), check: bool = True) -> DataFrame:
    """The columns keep, ids, n_tokens and (check) whether the ids decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.read(model))
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def run(batches):
        enc, dec = _coders(shared)
        for batch in batches:
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            column = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, 512):
                texts = column.slice(start, 512).to_pylist()
                coded = [enc.encode(t) if t is not None else b"" for t in texts]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                flat = np.frombuffer(b"".join(coded), np.int32)
                offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                missing = np.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(np.append(offs[:-1], offs[-1]), mask=np.append(missing, False)), pa.array(flat))
                ok = None
                if check:
                    ok = [None if t is None else dec.decode(np.frombuffer(c, np.int32).tolist()) == t.encode() for t, c in zip(texts, coded)]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(start, 512) for c in kept], ids, pa.array(sizes, mask=missing), pa.array(ok or [None] * len(texts), pa.bool_())], names=[*keep, "ids", "n_tokens", "round_trip"]
                )

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, ids_col: str = "ids", model: str = MODEL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep and the text of the ids."""
    shared = coded.sparkSession.sparkContext.broadcast(Pieces.read(model))
    rows = coded.select(*keep, F.col(ids_col).alias("__ids"))
    schema = coded.select(*keep).schema.add("text", "string")

    def run(batches):
        _, dec = _coders(shared)
        for batch in batches:
            texts = [None if i is None else dec.decode(i).decode() for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*itertools.islice(batch.columns, batch.num_columns - 1), pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(run, schema)
