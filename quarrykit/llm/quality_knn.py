"""Quality classifier: similarity-weighted nearest-neighbour vote in a latent space.

Terms of a document are its words (A-Z lower-cased), their shapes (runs of
capitals, letters, digits collapse; other characters stand for themselves), both
hashed into bins, and what repeats in it (levels of the share of words equal to
the one before, and of words that lie in five-word windows found again).  Log
frequencies times inverse document frequency of the labelled sample are reduced to ``RANK`` latent dimensions by its singular vectors and set to
length one.  The labelled vectors are broadcast, every document's cosines with
all of them are computed exactly, block by block, and the ``NEIGHBOURS`` nearest
vote with their similarity to the ``SHARPNESS``; all that tie with the last of
them vote too, so a score does not depend on the order of the sample.

Labels are learnt only from rows whose crc32 of the id is not 2 modulo 4, from a
sample of at most ``SAMPLE`` of them (the least by hash of the id); that bound
makes the model, and so the broadcast, one of fixed size (a few MB).  Label,
language, source and id are never inputs of a score.

Cases: a text without words (null, empty) has the zero vector and gets the
sample's share of label 1, as does every text where no labelled row exists (0.5
then); repeated rows score alike; a null id is carried and not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import textnp as T

SAMPLE, FEATURES, WORDS, RANK, NEIGHBOURS, SHARPNESS, BLOCK = 4096, 2048, 1024, 96, 24, 8, 256
PREDICT_FROM = 0.7
TIE = 1e-6  # cosines this close are equal: a product's last bits depend on the shape of its block
#: A repeated share of words above each level is a term; words take the last WORDS terms, shapes those between.
SAME_LEVELS, AGAIN_LEVELS = (0.1, 0.3, 0.5), (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.6)
_OWN = len(SAME_LEVELS) + len(AGAIN_LEVELS)
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 65, 97, 97, 48


def term_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense term counts and word counts of the documents of a slice."""
    docs = len(offs) - 1
    s, e, woffs = T.words(data, offs)
    out = np.zeros((docs, FEATURES), np.float32)
    if not len(s):
        return out, np.diff(woffs)
    owner = T.owners(woffs)
    kinds = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[s] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = T.Rolling(T.byte_codes()[kinds[keep]], T.BASE_BYTE).spans(at[s], at[e])
    term = (shapes % T.U64(FEATURES - WORDS - _OWN)).astype(np.int64) + _OWN
    word = (T.mix(T.word_codes(T.lower_ascii(data), s, e)) >> T.U64(20)) % T.U64(WORDS)
    both = np.concatenate([owner * FEATURES + term, owner * FEATURES + (FEATURES - WORDS) + word.astype(np.int64)])
    codes = T.word_codes(data, s, e)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    valid = np.flatnonzero(T.window_mask(woffs, 5))
    again = valid[:0]
    if len(valid):
        five = T.Rolling(codes, T.BASE_WORD).windows(5)[valid]
        order = np.lexsort((five, owner[valid]))
        sf, so = five[order], owner[valid][order]
        eq = (sf[1:] == sf[:-1]) & (so[1:] == so[:-1])
        hit = np.zeros(len(order), bool)
        hit[order[1:][eq]] = hit[order[:-1][eq]] = True
        again = valid[hit]
    n = np.diff(woffs)
    out = np.bincount(both, minlength=docs * FEATURES).reshape(docs, FEATURES).astype(np.float32)
    for i, (mask, level) in enumerate([*((same, x) for x in SAME_LEVELS), *((T.covered(again, 5, len(s)), x) for x in AGAIN_LEVELS)]):
        out[:, i] = np.where(np.bincount(owner[mask], minlength=docs) > level * n, n, 0)
    return out, n


def _log_frequencies(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log1p(100.0 * counts / np.maximum(n, 1)[:, None]).astype(np.float32)


class Model:
    def __init__(self, counts: np.ndarray, n: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(n)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
        x = _log_frequencies(counts, n) * self.idf
        _, vectors = np.linalg.eigh(x.T.astype(np.float64) @ x) if len(n) else (None, np.eye(FEATURES))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :RANK]).astype(np.float32)
        self.vectors = self._unit(x)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        size = np.linalg.norm(z, axis=1, keepdims=True)
        return np.where(size > 1e-6, z / np.maximum(size, 1e-6), 0).astype(np.float32)

    def scores(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.full(len(n), self.prior)
        if not len(self.labels):
            return out
        z = self._unit(_log_frequencies(counts, n) * self.idf)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(z), BLOCK):
            cos = z[i : i + BLOCK] @ self.vectors.T
            last = -np.partition(-cos, k - 1, axis=1)[:, k - 1]
            row, near = np.nonzero(cos >= last[:, None] - TIE)
            w = np.maximum(cos[row, near], 0).astype(np.float64) ** SHARPNESS
            total = np.bincount(row, w, len(cos))
            vote = np.bincount(row, w * self.labels[near], len(cos)) / np.maximum(total, 1e-12)
            out[i : i + BLOCK] = np.where((total > 1e-9) & (n[i : i + BLOCK] > 0), vote, self.prior)
        return np.clip(out, 0.0, 1.0)


def _parts(batch):
    """Slices of bounded bytes and of at most BLOCK rows: their term counts are dense."""
    for part in T.slices(batch, "text"):
        for i in range(0, part.num_rows, BLOCK):
            yield part.slice(i, BLOCK)


def _crc(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model of at most sample labelled rows; their term counts, not texts, go to the driver."""
    learn = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label is not null").where(_crc("id") != 2)
    learn = learn.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(learn), "id").select("id", "label", "text")

    def count(batches):
        for batch in batches:
            for part in _parts(batch):
                c, n = term_counts(*T.raw(part.column("text")))
                row, term = np.nonzero(c)
                offs = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offs), pa.array(x)) for x in (term.astype(np.int32), c[row, term])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(n.astype(np.int64)), *lists], names=["id", "label", "n", "terms", "counts"])

    # Rows that repeat an id may exceed the sample; the bound holds for rows, too.
    got = rows.mapInArrow(count, "id long, label int, n long, terms array<int>, counts array<float>").orderBy(F.xxhash64("id"), "id", "n", "label").limit(sample).collect()
    counts = np.zeros((len(got), FEATURES), np.float32)
    for i, r in enumerate(got):
        counts[i, r["terms"]] = r["counts"]
    return Model(counts, np.array([r["n"] for r in got], np.int64), np.array([r["label"] for r in got], np.float32))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(shared.value.scores(*term_counts(*T.raw(part.column("text")))))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")
    return rows.select(F.col("id").alias("doc_id"), F.coalesce(_crc("id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
