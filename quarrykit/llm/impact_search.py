"""Ranked lexical search: document-sharded CSR postings with integer impacts.

``build`` cuts the documents into shards of bounded bytes where they lie, without
a shuffle.  A shard holds its terms (64-bit codes, ascending), where each term's
postings start, and the postings: the document's place in the shard and the
impact, which is worked out when the index is built, as it depends only on the
frequency in the document, its length and two totals of all documents.

``search`` reads the shards once for every ``item_bytes`` of queries.  Of each
shard the query terms are looked up together; an item's terms are then added one
after another into a dense accumulator of the shard's documents, and the best
are selected by argpartition.  Shards number their documents by id, so that a
tie at the last place goes to the smaller id.  A task keeps the best of all of its
shards; a window over the tasks' answers merges them.

Terms are told apart by 64-bit codes: among v terms a given query term is
mistaken with a probability of v / 2**64.

Cases: a null or empty text, or one without terms, is not counted among the
documents, is found by nothing and, as an item, finds nothing; items that repeat
both id and text are one, those that repeat an id alone are ranked each for
itself; rows that repeat a document are ranked each; a null id of a document
counts as the largest; a very long text is a shard of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm import textnp as T
from quarrykit.storage import discard, saved

TOP, SHARD_BYTES, ITEM_BYTES = 10, 8 << 20, 32 << 20
_NONE = (1 << 63) - 1
_SHARD_DDL = "ids binary, terms binary, starts binary, docs binary, impacts binary"
_SHARD = pa.schema([(c, pa.binary()) for c in ("ids", "terms", "starts", "docs", "impacts")])
_FOUND_DDL = "query int, doc_id long, score long"
_FOUND = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


@dataclass(frozen=True)
class Index:
    """Saved shards; documents with a term, and all their terms with repeats."""

    shards: DataFrame
    documents: int
    terms: int


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term codes of the texts and n+1 offsets."""
    data = T.lower_ascii(data)
    s, e, toffs = T.words(data, offs, T.NO_TERM)
    return T.word_codes(data, s, e), toffs


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.col(text_col).cast("string").alias("text"))


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""

    def count(batches):
        for batch in batches:
            n = np.diff(T.words(*T.raw(batch.column("text")), T.NO_TERM)[2])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "terms"])

    r = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def lengths_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 90 + (90 * n * documents) div terms; in Python's integers where 64 bits don't hold the product."""
    if not terms:
        return np.full(len(n), 10, np.int64)
    fits = n <= (_NONE // (90 * documents) if documents else _NONE)
    out = np.where(fits, 90 * documents * np.where(fits, n, 0) // terms, 0)
    for i in np.flatnonzero(~fits):
        out[i] = 90 * int(n[i]) * documents // terms
    return out + 10


def _shard(batch: pa.RecordBatch, documents: int, terms: int) -> pa.RecordBatch | None:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    codes, toffs = _terms(*T.raw(batch.column("text").take(pa.array(order))))
    n = np.diff(toffs)
    if not len(codes):
        return None
    full = n > 0
    place = np.cumsum(full) - 1  # documents without terms have no place
    owner = place[T.owners(toffs)]
    by = np.argsort(codes, kind="stable")  # and by document within a term
    codes, owner = codes[by], owner[by]
    new_term = np.concatenate([[True], codes[1:] != codes[:-1]])
    new = np.flatnonzero(new_term | np.concatenate([[True], owner[1:] != owner[:-1]]))
    tf = np.diff(np.append(new, len(codes)))
    docs = owner[new]
    norm = lengths_norm(n[full], documents, terms)
    impacts = 1_000_000_000 * tf // (1000 * tf + 8 * norm[docs])
    at = np.flatnonzero(new_term)
    starts = np.append(np.searchsorted(new, at), len(new))
    columns = (ids[order][full], codes[at], starts.astype(np.uint32), docs.astype(np.uint32), impacts.astype(np.uint32))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], schema=_SHARD)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, written to the shared folder."""
    documents, terms = totals(docs, text_col)

    def shards(batches):
        for batch in batches:
            for part in T.slices(batch, "text", shard_bytes):
                row = _shard(part, documents, terms)
                if row is not None:
                    yield row

    return Index(saved(_rows(docs, id_col, text_col).mapInArrow(shards, _SHARD_DDL), "postings"), documents, terms)


def _read(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], kind) for c, kind in (("terms", T.U64), ("starts", np.uint32), ("docs", np.uint32), ("impacts", np.uint32), ("ids", np.int64)) if c in row)


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, so that one shard is unpacked at once."""
    for i in range(batch.num_rows):
        yield {name: batch.column(c)[i].as_buffer() for c, name in enumerate(batch.schema.names)}


def _lookup(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are there, and their places."""
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return terms[at] == wanted, at


def frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """Documents of the index that hold each of terms (codes, ascending)."""
    shared = index.shards.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        wanted = shared.value
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in _each(batch):
                have, starts = _read(row)
                hit, at = _lookup(have, wanted)
                df[hit] += starts[at[hit] + 1].astype(np.int64) - starts[at[hit]]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in index.shards.select("terms", "starts").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


@dataclass(frozen=True)
class Queries:
    """Distinct terms with their weights; the terms of each item as places among them."""

    terms: np.ndarray
    weights: np.ndarray
    items: list[np.ndarray]


def best(score: np.ndarray, top: int) -> np.ndarray:
    """Places of the top highest scores above 0, highest first, equal ones by place."""
    at = np.flatnonzero(score > 0)
    if len(at) > top:
        have = score[at]
        last = have[np.argpartition(have, len(at) - top)[len(at) - top]]
        above, equal = at[have > last], at[have == last]
        at = np.concatenate([above, equal[: top - len(above)]])
    return at[np.lexsort((at, -score[at]))]


def _scan(shared, top: int):
    def scan(batches):
        q: Queries = shared.value
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of an item: scores and ids, best first
        for batch in batches:
            for row in _each(batch):
                terms, starts, docs, impacts, ids = _read(row)
                hit, at = _lookup(terms, q.terms)
                lo, hi = starts[at], starts[at + 1]
                total = np.zeros(len(ids), np.int64)
                for i, mine in enumerate(q.items):
                    mine = mine[hit[mine]]
                    if not len(mine):
                        continue
                    total[:] = 0
                    for t in mine:
                        a, b = lo[t], hi[t]
                        total[docs[a:b]] += q.weights[t] * impacts[a:b].astype(np.int64)
                    have = found.get(i)
                    if have is not None and len(have[0]) == top and total.max() < have[0][-1]:
                        continue
                    new = best(total, top)
                    score, of = total[new], ids[new]
                    if have is not None:
                        score, of = np.concatenate([have[0], score]), np.concatenate([have[1], of])
                    order = np.lexsort((of, -score))[:top]
                    found[i] = score[order], of[order]
        query = np.repeat(np.array(list(found), np.int32), [len(s) for s, _ in found.values()])
        join = lambda c: np.concatenate([x[c] for x in found.values()]) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(join(1)), pa.array(join(0))], schema=_FOUND)

    return scan


def prepare(index: Index, texts: list[str]) -> Queries:
    items = [np.unique(_terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]) for t in texts]
    terms = np.unique(np.concatenate([*items, np.zeros(0, T.U64)]))
    df = frequencies(index, terms).tolist()
    weights = [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * d + 1))) for d in df]
    return Queries(terms, np.array(weights, np.int64), [np.searchsorted(terms, t) for t in items])


def search(index: Index, items: DataFrame, id_col: str = "item_id", text_col: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of every item."""
    spark = items.sparkSession
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    parts = max(1, math.ceil(size / item_bytes))
    out = []
    for part in range(parts):  # one scan of the index for each item_bytes of items
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(prepare(index, [r["text"] for r in mine]))
        found = index.shards.mapInArrow(_scan(shared, top), _FOUND_DDL)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "query int, item_id long")
        ranked = ranked.join(names, "query").select("item_id", "rank", F.when(F.col("doc_id") != _NONE, F.col("doc_id")).alias("doc_id"), "score")
        if parts > 1:
            ranked = saved(ranked, "ranked")
            shared.destroy()
        out.append(ranked)
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """build and search in one: the index lasts for one search, which is written."""
    index = build(docs, id_col, text_col)
    out = saved(search(index, items, top=top), "ranked")
    discard(index.shards)
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT rid, doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM f),
tf AS (SELECT rid, x, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS x FROM f) GROUP BY ALL),
i AS (SELECT DISTINCT item_id, text, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS x FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT x, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g WHERE x IN (SELECT x FROM i) GROUP BY x, N),
s AS (SELECT i.item_id, i.text, f.rid, f.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * f.n * g.N) // g.L))))::BIGINT AS score FROM i JOIN w USING (x) JOIN tf USING (x) JOIN f USING (rid), g GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
