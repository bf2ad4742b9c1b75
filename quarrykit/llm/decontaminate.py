"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The test items are the indexed documents and every training passage is a query.
An item's BM25 weights are scaled to sum to one, so the score of a passage is
the weighted share of the item that it contains and one threshold fits items of
any length.  Each term of a passage has a cursor in its posting list, in order of
items.  The pivot is the first item at which the greatest weights of the lists up
to it can reach the threshold; if the maxima of the lists' blocks there cannot,
the cursors skip to where a bound changes, else those behind move up to the pivot,
and an item that all of them meet is scored.  All passages of a slice take their
steps together, each at its own pivot.  The commonest terms have no cursors: an item
may lose them together and stay above nothing but ``SLACK``, and bounds add what it
(or its block) loses.  Every item at or above the threshold is retrieved, and a hit
counts if the passage has enough of the trigrams of both the item's question (its
first sentence or line) and its answer (the rest; halves where there is one sentence).

A passage is two neighbouring segments, each as long as the longest item of a class
(up to 256 words, 1,024, 4,096, ...; an index each), so any occurrence lies whole in
one passage and a long item does not widen the passages of short ones.  Documents are
never shuffled.

The index is broadcast.  The items' size is summed first; beyond ``INDEX_BYTES``
they are dealt into shards below it and the documents are scanned once a shard.
Statistics (document frequencies, mean and greatest lengths) are those of all items,
aggregated by Spark, so an item's score does not depend on the shards.

Of equal passages the first counts as an item's best one.

Cases: a null or empty text has no passage; null, empty or wordless items match
nothing; items under three words use their whole sequence as the one gram;
repeated rows give repeated hits; null ids of documents and items are carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import textnp as T
from quarrykit.storage import saved

THRESHOLD, OVERLAP, SLACK, BLOCK, SHORT = 0.6, 0.6, 0.25, 16, 256
K1, B = 1.2, 0.75
INDEX_BYTES = 32 << 20
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage", pa.int64())])
_OUT_DDL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage long"


def _coded(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return T.tokens(data, np.array([0, len(data)], np.int64))[0]


def _parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    text = text.strip()
    for i, c in enumerate(text[:-1]):
        if c == "\n" or c in ".?!" and text[i + 1].isspace():
            if text[i + 1 :].strip():
                return text[: i + 1], text[i + 1 :]
    words = text.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:]) or text


def _grams(codes: np.ndarray, k: int = 3) -> np.ndarray:
    if not len(codes):
        return codes
    roll = T.Rolling(codes, T.BASE_WORD)
    return np.unique(roll.windows(k) if len(codes) >= k else roll.spans(np.array([0]), np.array([len(codes)])))


def _class(words: int) -> int:
    """Class of an item's length: up to SHORT words, up to four times as many, and so on."""
    c = 0
    while words > SHORT << 2 * c:
        c += 1
    return c


@dataclass(frozen=True)
class Statistics:
    """Items, their mean number of words, the greatest of each class and how many items hold each term (of a shard)."""

    n: int
    mean: float
    longest: dict[int, int]
    df: dict[int, int]


def _statistics(coded: list[np.ndarray]) -> Statistics:
    longest: dict[int, int] = {}
    for c in coded:
        longest[_class(len(c))] = max(longest.get(_class(len(c)), 1), len(c))
    terms, df = np.unique(np.concatenate([np.unique(c) for c in coded]), return_counts=True) if coded else (np.zeros(0, T.U64), np.zeros(0, np.int64))
    return Statistics(len(coded), sum(map(len, coded)) / max(1, len(coded)), longest, dict(zip(terms.view(np.int64).tolist(), df.tolist())))


def indexes(items: list[tuple[int | None, str]], of_all: Statistics | None = None) -> list[Index]:
    """An index for each class of lengths. of_all: statistics of all items where these are a shard of them."""
    coded = [(i, t, c) for i, t in items if t and len(c := _coded(t))]
    of_all = of_all or _statistics([c for _, _, c in coded])
    classes = sorted({_class(len(c)) for _, _, c in coded})
    return [Index([x for x in coded if _class(len(x[2])) == k], of_all, of_all.longest[k]) for k in classes]


class Index:
    """Posting lists of the test items of a class, with their maxima by list and by block of items."""

    def __init__(self, coded: list[tuple[int | None, str, np.ndarray]], of_all: Statistics, segment: int):
        self.ids, self.segment = [i for i, _, _ in coded], segment
        n = len(coded)
        self.terms = np.unique(np.concatenate([c for _, _, c in coded]))
        counts = [np.unique(np.searchsorted(self.terms, c), return_counts=True) for _, _, c in coded]
        df = np.array([of_all.df[t] for t in self.terms.view(np.int64).tolist()], np.int64)
        idf = np.log1p((of_all.n - df + 0.5) / (df + 0.5))
        weights = []
        for (t, tf), (_, _, c) in zip(counts, coded):
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / of_all.mean))
            weights.append(w / w.sum())
        # With cursors: all terms of few items, then the heaviest of items with too much left.
        essential = df <= max(1, of_all.n // 20)
        for (t, _), w in zip(counts, weights):
            for j in np.argsort(-w):
                if w[~essential[t]].sum() <= SLACK:
                    break
                essential[t[j]] = True
        self.essential = essential
        self.item_terms, self.item_weights = [t for t, _ in counts], weights
        self.slack = np.array([w[~essential[t]].sum() for t, w in zip(self.item_terms, weights)])
        self.block_slack = np.maximum.reduceat(self.slack, np.arange(0, n, BLOCK))
        # Postings as keys (term, item) in order; block maxima as keys (term, block).
        term, item, w = np.concatenate(self.item_terms), np.repeat(np.arange(n), [len(t) for t in self.item_terms]), np.concatenate(weights)
        order = np.lexsort((item, term))
        order = order[essential[term[order]]]
        self.postings, self.weight = term[order] * n + item[order], w[order]
        self.offs = np.searchsorted(self.postings, np.arange(len(self.terms) + 1) * n)
        self.upper = np.zeros(len(self.terms))
        np.maximum.at(self.upper, term[order], self.weight)
        self.n_blocks = len(self.block_slack)
        self.blocks, first = np.unique(term[order] * self.n_blocks + item[order] // BLOCK, return_index=True)
        self.block_most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        parts = [_parts(t) for _, t, _ in coded]
        self.question = [_grams(_coded(q)) for q, _ in parts]
        self.answer = [_grams(_coded(a)) for _, a in parts]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & T.U64(0xFFFF)).astype(np.int64)] = True

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        out = np.full(len(codes), -1, np.int64)
        at = np.flatnonzero(self.maybe[(codes & T.U64(0xFFFF)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.terms, codes[at]), len(self.terms) - 1)
        good = self.terms[pos] == codes[at]
        out[at[good]] = pos[good]
        return out

    def _maxima(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Greatest weight of terms in blocks, 0 where a block has none."""
        key = term * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.blocks, key), len(self.blocks) - 1)
        return np.where(self.blocks[at] == key, self.block_most[at], 0.0)

    def candidates(self, term: np.ndarray, seg: np.ndarray, seg_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages (by first segment) and items whose postings, with the item's slack, reach the threshold."""
        reach, n, width = THRESHOLD - 1e-9, len(self.ids), len(self.terms)
        at = np.flatnonzero(term >= 0)
        at = at[self.essential[term[at]]]
        # A term counts once a passage: in the segment itself or the next of the document.
        pair = np.unique(seg[at] * width + term[at])
        before = pair[pair >= width] - width
        s = before // width
        pair = np.unique(np.concatenate([pair, before[seg_doc[s] == seg_doc[s + 1]]]))
        passage, t = pair // width, pair % width
        pos, end = self.offs[t], self.offs[t + 1]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(passage):
            item = self.postings[pos] - t * n
            order = np.lexsort((item, passage))
            passage, t, pos, end, item = passage[order], t[order], pos[order], end[order], item[order]
            new = np.concatenate([[True], passage[1:] != passage[:-1]])
            starts, owner = np.flatnonzero(new), np.cumsum(new) - 1
            upper = np.cumsum(self.upper[t])
            upper -= (upper[starts] - self.upper[t[starts]])[owner]
            enough = upper + self.slack.max() >= reach
            # Passages without a pivot are done.
            alive = np.logical_or.reduceat(enough, starts)
            keep = alive[owner]
            if not keep.all():
                passage, t, pos, end, item, enough, owner = (x[keep] for x in (passage, t, pos, end, item, enough, owner))
                if not len(passage):
                    break
                owner = (np.cumsum(alive) - 1)[owner]
                starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rows = np.arange(len(passage))
            pivot = item[np.minimum.reduceat(np.where(enough, rows, len(rows)), starts)]
            mine = pivot[owner]
            upto = item <= mine
            bound = np.add.reduceat(np.where(upto, self._maxima(t, mine // BLOCK), 0.0), starts)
            good = bound + self.block_slack[pivot // BLOCK] >= reach
            # At the pivot: scored by their postings, then one item on.
            met = good & (item[starts] == pivot)
            score = np.add.reduceat(np.where(item == mine, self.weight[pos], 0.0), starts) + self.slack[pivot]
            hit = np.flatnonzero(met & (score >= reach))
            found.append((passage[starts[hit]], pivot[hit]))
            # Below the threshold: on to the next block or the next cursor, whichever comes first.
            beyond = np.minimum.reduceat(np.where(upto, n, item), starts)
            target = np.where(met, pivot + 1, np.where(good, pivot, np.minimum((pivot // BLOCK + 1) * BLOCK, beyond)))[owner]
            move = item < target
            pos[move] = np.searchsorted(self.postings, t[move] * n + np.minimum(target[move], n))
            left = pos < end
            passage, t, pos, end = passage[left], t[left], pos[left], end[left]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        passage, item = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((item, passage))
        return passage[order], item[order]


def _search(index: Index, codes: np.ndarray, toffs: np.ndarray) -> dict[tuple[int, int], tuple]:
    """Best passage of each document and item that it holds, by their numbers."""
    hits: dict[tuple[int, int], tuple] = {}
    term = index.lookup(codes)
    doc = T.owners(toffs)
    seg_counts = -(-np.diff(toffs) // index.segment)
    seg_offs = np.concatenate([[0], np.cumsum(seg_counts)])
    seg_doc = np.repeat(np.arange(len(seg_counts)), seg_counts)
    seg = seg_offs[doc] + (np.arange(len(codes)) - toffs[doc]) // index.segment
    last, there, grams = -1, None, None
    for s, item in zip(*(x.tolist() for x in index.candidates(term, seg, seg_doc))):
        d = int(seg_doc[s])
        i = int(toffs[d] + (s - seg_offs[d]) * index.segment)
        j = int(min(toffs[d + 1], i + 2 * index.segment))
        if s != last:
            last, grams = s, None
            there = np.unique(term[i:j])
        score = float(index.item_weights[item][np.isin(index.item_terms[item], there)].sum())
        if score < THRESHOLD:
            continue
        if grams is None:
            roll = T.Rolling(codes[i:j], T.BASE_WORD)
            grams = {k: roll.windows(k) for k in (1, 2, 3)}
        q = _share(index.question[item], grams)
        a = _share(index.answer[item], grams)
        if min(q, a) >= OVERLAP and (score, q, a) > hits.get((d, item), (0.0,))[:3]:
            hits[d, item] = (score, q, a, int(s - seg_offs[d]))
    return hits


def _answers(found: list[Index], batch) -> pa.RecordBatch:
    ids = batch.column("id")
    codes, toffs = T.tokens(*T.raw(batch.column("text")))
    rows = []
    if len(codes):
        for index in found:
            rows += [(d, index.ids[i], *hit) for (d, i), hit in sorted(_search(index, codes, toffs).items())]
    docs, *cols = zip(*rows) if rows else [()] * 6
    types = [f.type for f in _OUT][1:]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(docs, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types)]], schema=_OUT)


def _share(want: np.ndarray, grams: dict[int, np.ndarray]) -> float:
    return max(float(np.isin(want, g).mean()) if len(want) else 0.0 for g in grams.values())


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """A row for each document and test item that it holds, with its best passage."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / index_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    terms, of_all = _terms(items, shards) if shards > 1 else (None, None)
    out = None
    for shard in range(shards):
        mine = items.where(F.col("shard") == shard).orderBy("item_id", "text").select("item_id", "text").collect()
        if of_all:
            of_all = replace(of_all, df={r["term"]: r["n"] for r in terms.where(F.array_contains("shards", shard)).select("term", "n").collect()})
        shared = docs.sparkSession.sparkContext.broadcast(indexes([tuple(r) for r in mine], of_all))
        found = rows.mapInArrow(_scan(shared), _OUT_DDL)
        out = found if out is None else out.unionByName(found)
    return out


def _terms(items: DataFrame, shards: int) -> tuple[DataFrame, Statistics]:
    """Items that hold each term, with the shards they are in (collected by shard only), and the rest of the statistics."""

    def code(batches):
        for batch in batches:
            coded = [_coded(t) for t in batch.column("text").to_pylist()]
            terms = [np.unique(c).view(np.int64) for c in coded]
            yield pa.RecordBatch.from_arrays([batch.column("shard").cast(pa.int64()), pa.array([len(c) for c in coded], pa.int64()), pa.array([_class(len(c)) for c in coded], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], names=["shard", "words", "class", "terms"])

    coded = saved(items.select("text", "shard").mapInArrow(code, "shard long, words long, class long, terms array<long>").where("words > 0"), "items")
    r = coded.agg(F.count("*").alias("n"), F.avg("words").alias("mean")).first()
    longest = {x["class"]: x["longest"] for x in coded.groupBy("class").agg(F.max("words").alias("longest")).collect()}
    terms = coded.select("shard", F.explode("terms").alias("term")).groupBy("term", "shard").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.collect_set("shard").alias("shards"))
    return saved(terms, "terms"), Statistics(r["n"], r["mean"] or 0.0, longest, {})


def _scan(shared):
    def scan(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                yield _answers(shared.value, part)

    return scan


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a test item (by id); all columns as they were."""
    bad = saved(leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias("__leaked")).where("__leaked is not null").distinct(), "leaked")
    return docs.join(bad, docs[id_col].cast("long") == bad["__leaked"], "left_anti")
