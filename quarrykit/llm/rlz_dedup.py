"""Sub-string de-duplication by relative Lempel-Ziv parsing.

Every document is parsed against the reference blocks (all documents with a
smaller id).  The blocks' phrase index holds, for each phrase of ``phrase``
words, its first occurrence: the smallest document in which it starts and the
first word at which it does.  The parse is greedy: where the phrase at a word
is indexed under a smaller id a factor opens at that occurrence, and it is
extended for as long as the next phrase is indexed at the next word of the same
document, so a factor is one contiguous copy of words of its reference.  Where
the occurrence jumps a new factor opens, and the phrases that straddle that
boundary are looked up like all others, so no phrase is lost between two
factors (neighbours overlap there).  Words in factors of at least ``phrase``
words are removed.

Two exchanges keep the index small.  A phrase has one canonical inner
``seed``-gram (the least code among its ``phrase - seed + 1``), equal phrases
have equal ones, and only phrases whose canonical seed occurs in two documents
are indexed at all.  The first exchange asks for seeds by 32-bit prints (a
false hit costs a look-up, never a wrong result); the second asks for whole
phrases by 64-bit codes plus the bits of the bucket, which an independent
second hash chooses.

Cases: a null or empty text has no words, nothing is removed and the kept text
is empty; a null id counts as larger than all others; rows that repeat an id
are parsed each for itself and never count as smaller than one another (an
occurrence in them is the first in any of them); texts under ``phrase`` words keep every word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import exchange as X
from quarrykit.llm import textnp as T

PHRASE, SEED = 13, 7
_NONE = (1 << 63) - 1


class _Parse:
    """Words and phrases of a slice of documents."""

    def __init__(self, batch, phrase: int, seed: int):
        self.data, self.offs = T.raw(batch.column("text"))
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        self.s, self.e, self.woffs = T.words(self.data, self.offs)
        self.codes = T.word_codes(self.data, self.s, self.e)
        self.phrase, self.seed = phrase, seed
        self.valid = T.window_mask(self.woffs, phrase)
        self.owner = T.owners(self.woffs)

    def seeds(self) -> np.ndarray:
        """Code of the canonical seed of each phrase (by start; 0 where there is none)."""
        n = len(self.valid)
        if not n:
            return np.zeros(0, T.U64)
        grams = T.Rolling(self.codes, T.BASE_WORD).windows(self.seed)
        return T.sliding(grams, self.phrase - self.seed + 1, np.minimum)[:n]

    def within(self, at: np.ndarray) -> np.ndarray:
        """Places in their documents of words of the slice."""
        return (at - self.woffs[self.owner[at]]).astype(np.uint32)

    def phrases(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = T.Rolling(self.codes, T.BASE_WORD).spans(at, at + self.phrase)
        b = T.Rolling(self.codes, T.BASE_WORD2).spans(at, at + self.phrase)
        return a, b


def _distinct_seeds(parts: list[tuple[np.ndarray, np.ndarray]], n: int):
    """Keys (bucket and print) in order, and whether two documents of the block have each."""
    code = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, T.U64)
    ids = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    key = (X.bucket_of(code, n).astype(np.uint64) << T.U64(32)) | (code & T.U64(0xFFFFFFFF))
    order = np.argsort(key, kind="stable")
    key, ids = key[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    shared = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(first) else np.zeros(0, bool)
    return key[first], shared


def _seed_parts(table: pa.Table, phrase: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for part in T.slices(table, "text"):
        p = _Parse(part, phrase, seed)
        code = p.seeds()
        if len(code):
            at = np.flatnonzero(p.valid)
            code, ids = code[at], p.ids[p.owner[at]]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (ids[1:] != ids[:-1])]) if len(code) else np.zeros(0, bool)
            out.append((code[new], ids[new]))
    return out


def _key_bucket(key: np.ndarray) -> np.ndarray:
    return (key >> T.U64(32)).astype(np.int32)


def _phrase_requests(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n: int):
    """Distinct phrases of the block by bucket and code, with the first occurrence (id, word) of each."""
    a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, T.U64)
    b = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, T.U64)
    ids = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
    word = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.uint32)
    bucket = X.bucket_of(b, n)
    order = np.lexsort((word, ids, a, bucket))
    a, bucket, ids, word = a[order], bucket[order], ids[order], word[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (bucket[1:] != bucket[:-1])]) if len(a) else np.zeros(0, bool)
    return bucket[first], a[first], ids[first], word[first]


def _candidates(part, phrase: int, seed: int, keys: np.ndarray, hit: np.ndarray, n: int):
    """A slice's parse and the starts of the phrases worth looking up."""
    p = _Parse(part, phrase, seed)
    code = p.seeds()
    if not len(code) or not len(keys):
        return p, np.zeros(0, np.int64)
    at = np.flatnonzero(p.valid)
    code = code[at]
    key = (X.bucket_of(code, n).astype(np.uint64) << T.U64(32)) | (code & T.U64(0xFFFFFFFF))
    pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return p, at[hit[pos] & (keys[pos] == key)]


def _kept_text(p: _Parse, keep: np.ndarray) -> pa.Array:
    """Kept words of each document joined by one space."""
    n = len(p.data)
    docs = len(p.offs) - 1
    at = np.flatnonzero(keep)
    owner = p.owner[at]
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(at) else np.zeros(0, bool)
    stop = p.e[at] + np.where(last, 0, 1)
    delta = np.bincount(p.s[at], minlength=n + 2)[: n + 2] - np.bincount(stop, minlength=n + 2)[: n + 2]
    mask = np.cumsum(delta)[:n] > 0
    body = np.where(T._SPACE[p.data], np.uint8(32), p.data)[mask]
    ends = np.concatenate([[0], np.cumsum(mask)])[p.offs]
    return pa.StringArray.from_buffers(docs, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))


def remove_repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase: int = PHRASE, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and factors (start word, words, reference id and its start word) per row."""
    n = X.block_count(docs, text_col)
    blocks = X.in_blocks(docs, id_col, text_col, n)

    def ask_seeds(table: pa.Table) -> pa.Table:
        key, shared = _distinct_seeds(_seed_parts(table, phrase, seed), n)
        return pa.Table.from_batches([X.sent(X.block_of(table), _key_bucket(key), [key.astype(np.uint32), shared.view(np.uint8)])])

    def answer_seeds(table: pa.Table) -> pa.Table:
        (code, shared), _, _, offs = X.received(table, [np.uint32, np.uint8])
        _, back, count = np.unique(code, return_inverse=True, return_counts=True)
        multi = np.bincount(back, weights=shared, minlength=len(count)) > 0
        return X.answered(table, offs, [((count > 1) | multi)[back]])

    def ask_phrases(docs_: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.Table.from_batches([], schema=X._REQUEST)
        keys, _ = _distinct_seeds(_seed_parts(docs_, phrase, seed), n)
        (hit,) = X.lined_up(hits, _key_bucket(keys), 1)
        bucket, code, ids, word = _phrase_requests(_asked(docs_, keys, hit), n)
        return pa.Table.from_batches([X.sent(X.block_of(docs_), bucket, [code, ids, word])])

    def _asked(docs_: pa.Table, keys, hit):
        parts = []
        for part in T.slices(docs_, "text"):
            p, at = _candidates(part, phrase, seed, keys, hit, n)
            if len(at):
                parts.append((*p.phrases(at), p.ids[p.owner[at]], p.within(at)))
        return parts

    def answer_phrases(table: pa.Table) -> pa.Table:
        (code, ids, word), _, _, offs = X.received(table, [np.uint64, np.int64, np.uint32])
        order = np.lexsort((word, ids, code))
        sorted_code = code[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])) if len(code) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
        chosen = np.empty(len(code), np.int64)
        chosen[order] = order[first][group] if len(code) else order
        return X.answered(table, offs, [ids[chosen], word[chosen]])

    def parse(docs_: pa.Table, hits: pa.Table, least: pa.Table) -> pa.Table:
        keys, _ = _distinct_seeds(_seed_parts(docs_, phrase, seed), n)
        (hit,) = X.lined_up(hits, _key_bucket(keys), 1)
        bucket, code, _, _ = _phrase_requests(_asked(docs_, keys, hit), n)
        ref, ref_word = np.full(len(code), _NONE, np.int64), np.zeros(len(code), np.int64)
        for b, body in zip(least.column("bucket").to_pylist(), least.column("body").to_pylist()):
            i, j = np.searchsorted(bucket, [b, b + 1])
            ref[i:j] = np.frombuffer(body, np.int64, j - i)
            ref_word[i:j] = np.frombuffer(body, np.uint32, j - i, 8 * (j - i))
        starts = np.searchsorted(bucket, np.arange(n + 1))
        out = []
        for part in T.slices(docs_, "text"):
            p, at = _candidates(part, phrase, seed, keys, hit, n)
            found, word = np.full(len(p.s), _NONE, np.int64), np.zeros(len(p.s), np.int64)
            if len(at):
                a, b = p.phrases(at)
                place = _place(bucket, code, starts, X.bucket_of(b, n), a)
                found[at], word[at] = ref[place], ref_word[place]
                found[at] = np.where(found[at] < p.ids[p.owner[at]], found[at], _NONE)
            out.append(_parsed(p, found, word, phrase))
        return pa.concat_tables([pa.Table.from_batches([b]) for b in out]) if out else pa.Table.from_batches([], schema=_OUT)

    hits = blocks.groupBy("block").applyInArrow(ask_seeds, X.REQUEST).groupBy("bucket").applyInArrow(answer_seeds, X.ANSWER)
    tagged = hits.select("block", "bucket", "body", F.lit(0).alias("round"))
    asked = blocks.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(ask_phrases, X.REQUEST)
    least = asked.groupBy("bucket").applyInArrow(answer_phrases, X.ANSWER).select("block", "bucket", "body", F.lit(1).alias("round"))

    def parse_block(docs_: pa.Table, both: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.Table.from_batches([], schema=_OUT)
        second = np.asarray(both.column("round").to_numpy(), bool) if both.num_rows else np.zeros(0, bool)
        return parse(docs_, both.filter(pa.array(~second)), both.filter(pa.array(second)))

    out = blocks.groupBy("block").cogroup(tagged.unionByName(least).groupBy("block")).applyInArrow(parse_block, _OUT_DDL)
    return out.select(F.when(F.col("id") != _NONE, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text", "factors")


_FACTOR = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("reference", pa.int64()), ("reference_start", pa.int64())]))
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("factors", _FACTOR)])
_OUT_DDL = "id long, n_words long, n_removed long, kept_text string, factors array<struct<start: long, words: long, reference: long, reference_start: long>>"


def _place(bucket, code, starts, want_bucket, want_code) -> np.ndarray:
    """Index of each wanted (bucket, code) in the block's ordered request (all are there)."""
    order = np.lexsort((want_code, want_bucket))
    wb, wc = want_bucket[order], want_code[order]
    new = np.concatenate([[True], (wb[1:] != wb[:-1]) | (wc[1:] != wc[:-1])]) if len(order) else np.zeros(0, bool)
    # Distinct wanted pairs are a sub-sequence of the request; walk bucket by bucket.
    out = np.empty(len(order), np.int64)
    pos = np.empty(int(new.sum()), np.int64)
    ub, uc = wb[new], wc[new]
    cuts = np.searchsorted(ub, np.arange(len(starts)))
    for b in np.unique(ub):
        i, j = cuts[b], cuts[b + 1]
        pos[i:j] = starts[b] + np.searchsorted(code[starts[b] : starts[b + 1]], uc[i:j])
    out[order] = pos[np.cumsum(new) - 1]
    return out


def _parsed(p: _Parse, found: np.ndarray, word: np.ndarray, phrase: int) -> pa.RecordBatch:
    """Greedy factors of each document of the slice, and what is left of it."""
    hit = np.flatnonzero(found != _NONE)
    n = len(p.s)
    delta = np.bincount(hit, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(hit + phrase, n), minlength=n + 1)[: n + 1]
    gone = np.cumsum(delta[:n]) > 0
    jump = (hit[1:] != hit[:-1] + 1) | (found[hit[1:]] != found[hit[:-1]]) | (word[hit[1:]] != word[hit[:-1]] + 1) | (p.owner[hit[1:]] != p.owner[hit[:-1]])
    new = np.concatenate([[True], jump]) if len(hit) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    f_start, f_words = hit[first], hit[last] - hit[first] + phrase if len(hit) else hit[:0]
    owner = p.owner[f_start]
    docs = len(p.offs) - 1
    list_offs = np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32)
    factor = pa.StructArray.from_arrays([pa.array(f_start - p.woffs[owner]), pa.array(f_words), pa.array(found[f_start]), pa.array(word[f_start])], ["start", "words", "reference", "reference_start"])
    removed = np.concatenate([[0], np.cumsum(gone)])
    return pa.RecordBatch.from_arrays(
        [pa.array(p.ids), pa.array(np.diff(p.woffs)), pa.array(np.diff(removed[p.woffs])), _kept_text(p, ~gone), pa.ListArray.from_arrays(pa.array(list_offs), factor)], schema=_OUT
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + {PHRASE - 1}], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {PHRASE - 2})) AS i FROM d WHERE len(w) >= {PHRASE})),
occ AS (SELECT g, doc_id AS f, min(i) AS fi FROM win GROUP BY g, doc_id QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST) = 1),
hit AS (SELECT rid, i, f, fi FROM win JOIN occ USING (g) WHERE f < doc_id),
fac AS (SELECT rid, count(*) AS n FROM (SELECT *, lag(i) OVER w AS pi, lag(f) OVER w AS pf, lag(fi) OVER w AS pfi FROM hit WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE pi IS NULL OR pi <> i - 1 OR pf <> f OR pfi <> fi - 1 GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {PHRASE})) AS p FROM hit),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid),
n AS (SELECT rid, count(*) AS c FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(fac.n, 0)::BIGINT AS n_factors
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN fac USING (rid)
"""
