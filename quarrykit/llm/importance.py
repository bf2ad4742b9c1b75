"""Target-distribution importance resampling over inverted postings by bucket.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its
bytes modulo ``BUCKETS``.  Documents are read where they lie, in blocks of bounded
bytes.  A block inverts itself: for every bucket the documents that hold it, with
counts, sorted and packed, one row for each *slice* of buckets.  The slices are
shuffled; a slice reads the bucket totals of both corpora first (a row for each
task, so few), works out its buckets' gains from them, and then streams the
postings past them, so that its memory does not depend on how many documents hold
a bucket.  What a slice adds to a block's documents goes back as one packed row and
is summed by document.  There are at most ``BUCKETS`` slices, and a bucket gets
at most one posting from a document however often it holds it.

The draw is by weight plus Gumbel noise from a hash of the id.  The highest N are
found by counting what lies between approximate quantiles, and ranked in windows
between them, never in one task.

The documents should be a written table (a scan gives the same blocks again when
a task is repeated); results of a shuffle should be saved first.

Cases: a null or empty text has no features and weight 0; rows that repeat an id
are each drawn for themselves, with the same noise; a null id has the noise of an
empty one and loses ties; a very long text is a block of its own; without a target
corpus T is 0 and gains follow from the formula.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm import textnp as T
from quarrykit.storage import saved

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
BLOCK_BYTES, SLICE_BYTES, LEAST_SLICES = 4 << 20, 64 << 20, 64
_MOST_ROWS = 65_535  # of a block: a document's place has 16 bits
_NONE = (1 << 63) - 1
# What a row of the shuffle holds, in the order in which a slice reads them.
SOURCE, TARGET, HEADER, POSTINGS = range(4)
_ROW_DDL = "slice int, kind int, block long, n int, runs int, width int, body binary"
_ROW = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("runs", pa.int32()), ("width", pa.int32()), ("body", pa.binary())])
_PART_DDL = "block long, kind int, n int, width int, body binary"
_PART = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("body", pa.binary())])
_OUT_DDL = "id long, n_words long, n_features long, weight long"
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

_ONES, _FAR = np.uint32(0xFFFFFFFF), 64


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32's step for each byte, and what n zero bytes (up to _FAR) make of each byte of the register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    ahead = np.zeros((_FAR + 1, 4, 256), np.uint32)
    ahead[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for n in range(_FAR):
        ahead[n + 1] = step[ahead[n] & np.uint32(255)] ^ (ahead[n] >> np.uint32(8))
    return step, ahead


def _ahead(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n zero bytes each."""
    _, table = _crc_tables()
    low = np.uint32(255)
    go = lambda r, k: table[k, 0, r & low] ^ table[k, 1, (r >> np.uint32(8)) & low] ^ table[k, 2, (r >> np.uint32(16)) & low] ^ table[k, 3, r >> np.uint32(24)]
    out = go(register, np.minimum(n, _FAR))
    left = n - _FAR
    while len(more := np.flatnonzero(left > 0)):
        out[more] = go(out[more], np.minimum(left[more], _FAR))
        left[more] -= _FAR
    return out


def _registers(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC register after each word, from all ones."""
    step, _ = _crc_tables()
    size = e - s
    order = np.argsort(-size, kind="stable")
    s, size = s[order], size[order]
    register = np.full(len(s), _ONES, np.uint32)
    long = int(np.searchsorted(-size, -_FAR))
    for i in range(long):
        register[i] = zlib.crc32(data[s[i] : s[i] + size[i]].tobytes()) ^ 0xFFFFFFFF
    rest = register[long:]
    s, size = s[long:], size[long:]
    for p in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -p))  # words with a byte p
        have = rest[:m]
        rest[:m] = step[(have ^ data[s[:m] + p]) & np.uint32(255)] ^ (have >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = register
    return out


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features and the documents they are of; words of each document."""
    step, _ = _crc_tables()
    data = T.lower_ascii(data)
    s, e, woffs = T.words(data, offs, T.NO_TERM)
    owner = T.owners(woffs)
    size = e - s
    alone = _registers(data, s, e)
    own = alone ^ _ahead(np.full(len(s), _ONES), size)  # the word's part, whatever stood before it
    buckets, of, run = [], [], alone
    for k in range(LONGEST):
        if k:
            run = run[:-1] if len(run) else run
            spaced = step[(run ^ np.uint32(32)) & np.uint32(255)] ^ (run >> np.uint32(8))
            run = _ahead(spaced, size[k:]) ^ own[k:]
        inside = owner[: len(run)] == owner[k:] if k else np.ones(len(run), bool)
        buckets.append(((run ^ _ONES)[inside] % np.uint32(BUCKETS)).astype(np.int64))
        of.append(owner[: len(run)][inside])
    return np.concatenate(buckets), np.concatenate(of), np.diff(woffs)


def feature_count(words: np.ndarray) -> np.ndarray:
    return sum(np.maximum(words - k, 0) for k in range(LONGEST))


def _slice_of(n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Slice of each bucket, its place in it, and places in a slice."""
    bucket = np.arange(BUCKETS)
    return bucket % n, bucket // n, -(-BUCKETS // n)


def _narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _inverted(part: pa.RecordBatch, block: int, slices: int, total: np.ndarray) -> list[tuple]:
    """Rows of a block: its header and its postings by slice; adds to the totals by slice and place."""
    of_bucket, place_of, places = _slice_of(slices)
    bucket, doc, words = features(*T.raw(part.column("text")))
    docs = part.num_rows
    key = (of_bucket[bucket] * places + place_of[bucket]) * docs + doc
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    cell, doc = np.divmod(key[new], docs)
    total += np.bincount(cell, weights=count, minlength=len(total)).astype(np.int64)
    ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    rows = [(block % slices, HEADER, block, docs, 0, 0, ids.tobytes() + words.astype(np.int64).tobytes())]
    cuts = np.searchsorted(cell, np.arange(slices + 1) * places)
    for x in np.flatnonzero(cuts[1:] > cuts[:-1]):
        i, j = cuts[x], cuts[x + 1]
        run = np.flatnonzero(np.concatenate([[True], cell[i + 1 : j] != cell[i : j - 1]]))
        mine = _narrow(count[i:j])
        body = (cell[i:j][run] - x * places).astype(np.uint16).tobytes() + np.diff(np.append(run, j - i)).astype(np.uint32).tobytes() + doc[i:j].astype(np.uint16).tobytes() + mine.tobytes()
        rows.append((int(x), POSTINGS, block, int(j - i), len(run), mine.itemsize, body))
    return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _total_rows(total: np.ndarray, slices: int, kind: int) -> pa.RecordBatch:
    return _batch([(x, kind, -1, 0, 0, 8, row.tobytes()) for x, row in enumerate(total.reshape(slices, -1)) if row.any()], _ROW)


def _blocks(batch: pa.RecordBatch):
    for part in T.slices(batch, "text", BLOCK_BYTES):
        for i in range(0, part.num_rows, _MOST_ROWS):
            yield part.slice(i, _MOST_ROWS)


def _posted(slices: int):
    def rows(batches):
        total = np.zeros(slices * _slice_of(slices)[2], np.int64)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _blocks(batch):
                yield _batch(_inverted(part, block, slices, total), _ROW)
                block += 1
        yield _total_rows(total, slices, SOURCE)

    return rows


def _counted(slices: int):
    """Totals of the target corpus alone."""

    def rows(batches):
        of_bucket, place_of, places = _slice_of(slices)
        cells = of_bucket * places + place_of
        total = np.zeros(slices * places, np.int64)
        for batch in batches:
            for part in _blocks(batch):
                np.add(total, np.bincount(cells[features(*T.raw(part.column("text")))[0]], minlength=len(total)), out=total)
        yield _total_rows(total, slices, TARGET)

    return rows


def gains(s: np.ndarray, t: np.ndarray, source: int, target: int) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target."""
    up, down = float(source + BUCKETS), float(target + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(y + 1) * up / (float(x + 1) * down))) for x, y in zip(s.tolist(), t.tolist())], np.int64)


def _contributed(source: int, target: int, places: int):
    def rows(batches):
        have, s, t, gain = -1, None, None, None
        for batch in batches:
            out = []
            for x, kind, block, n, runs, width, body in zip(*(batch.column(c).to_pylist() for c in range(6)), batch.column(6)):
                if x != have:
                    have, s, t, gain = x, np.zeros(places, np.int64), np.zeros(places, np.int64), None
                body = body.as_buffer()
                if kind in (SOURCE, TARGET):
                    total = s if kind == SOURCE else t
                    total += np.frombuffer(body, np.int64)
                elif kind == HEADER:
                    out.append((block, HEADER, n, 0, body.to_pybytes()))
                else:
                    gain = gains(s, t, source, target) if gain is None else gain
                    bucket = np.frombuffer(body, np.uint16, runs)
                    length = np.frombuffer(body, np.uint32, runs, 2 * runs)
                    doc = np.frombuffer(body, np.uint16, n, 6 * runs)
                    count = np.frombuffer(body, f"u{width}", n, 6 * runs + 2 * n).astype(np.int64)
                    docs, back = np.unique(doc, return_inverse=True)
                    add = np.zeros(len(docs), np.int64)
                    np.add.at(add, back, np.repeat(gain[bucket], length) * count)
                    size = 4 if np.abs(add).max() < 1 << 31 else 8
                    out.append((block, POSTINGS, len(docs), size, docs.tobytes() + add.astype(f"i{size}").tobytes()))
            yield _batch(out, _PART)

    return rows


def _reduced(table: pa.Table) -> pa.Table:
    """Documents of a block with the sums of what the slices gave."""
    kind = table.column("kind").to_numpy()
    at = int(np.flatnonzero(kind == HEADER)[0])
    n = table.column("n")[at].as_py()
    body = table.column("body")[at].as_buffer()
    ids, words = np.frombuffer(body, np.int64, n), np.frombuffer(body, np.int64, n, 8 * n)
    weight = np.zeros(n, np.int64)
    for i in np.flatnonzero(kind == POSTINGS):
        m, size, body = table.column("n")[i].as_py(), table.column("width")[i].as_py(), table.column("body")[i].as_buffer()
        weight[np.frombuffer(body, np.uint16, m)] += np.frombuffer(body, f"i{size}", m, 2 * m)
    return pa.Table.from_arrays([pa.array(ids), pa.array(words), pa.array(feature_count(words)), pa.array(weight)], schema=_OUT)


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.col(text_col).cast("string").alias("text"))


def feature_total(df: DataFrame, text_col: str = "text") -> int:
    def count(batches):
        for batch in batches:
            words = np.diff(T.words(*T.raw(batch.column("text")), T.NO_TERM)[2])
            yield pa.RecordBatch.from_arrays([pa.array([int(feature_count(words).sum())])], names=["n"])

    return _texts(df, text_col).mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def slice_count(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return min(BUCKETS, max(LEAST_SLICES, math.ceil(size / SLICE_BYTES)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    source_n, target_n, slices = feature_total(docs, text_col), feature_total(target, target_col), slice_count(docs, text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("id"), F.col(text_col).cast("string").alias("text"))
    posted = rows.mapInArrow(_posted(slices), _ROW_DDL).unionByName(_texts(target, target_col).mapInArrow(_counted(slices), _ROW_DDL))
    parts = posted.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(_contributed(source_n, target_n, _slice_of(slices)[2]), _PART_DDL)
    out = parts.groupBy("block").applyInArrow(_reduced, _OUT_DDL)
    return out.select(F.when(F.col("id") != _NONE, F.col("id")).alias("doc_id"), "n_words", "n_features", "weight")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the hash of an id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(unit))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score, and rank of the floor(percent * N / 100) highest of the N rows with least_words."""
    rows = saved(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    able = F.col("n_words") >= least_words
    n = rows.where(able).count()
    drawn = percent * n // 100
    if not drawn:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    # Slots between approximate quantiles of what is likely drawn, and one for all below: exact however good they are.
    steps = min(2000, max(64, drawn // 500_000))
    likely = min(1.0, 1.2 * percent / 100)
    at = [1 - likely + likely * i / steps for i in range(steps)]
    bounds = sorted(set(rows.where(able).agg(F.percentile_approx("score", at, 100_000)).first()[0]), reverse=True)
    above = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("score")))
    slotted = rows.withColumn("slot", F.when(able, F.when(F.col("score") < bounds[-1], len(bounds)).otherwise(above)))
    before, start = 0, {}
    for r in slotted.where("slot is not null").groupBy("slot").count().orderBy("slot").collect():  # at most steps + 1 rows
        if before < drawn:
            start[r["slot"]] = before
        before += r["count"]
    last = max(start)
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])[F.col("slot")]
    place = first + F.row_number().over(order)
    high = slotted.where(F.col("slot") <= last).withColumn("rank", F.when(place <= drawn, place).cast("long"))
    rest = slotted.where(F.coalesce(F.col("slot") > last, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(rest).drop("slot")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs' rows that are drawn, in all their columns; rows that repeat a drawn id follow it."""
    drawn = draw(weigh(docs, target, id_col, text_col), percent).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs[id_col].cast("long") == drawn["__drawn"], "left_semi")


# CRC-32 in SQL: the table by its rule, then one step for each byte of each distinct feature.
ORACLE = f"""
WITH RECURSIVE c AS (SELECT i AS b, i::BIGINT AS r, 0 AS k FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM c WHERE k < 8),
tab AS MATERIALIZED (SELECT list(r ORDER BY b) AS t FROM c WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
k AS (SELECT unnest([1, 2, 3]) AS k),
df AS (SELECT rid, g, count(*)::BIGINT AS n FROM (SELECT rid, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM d, k)) GROUP BY ALL),
bf AS (SELECT g, count(*)::BIGINT AS n FROM (SELECT array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM b, k)) GROUP BY ALL),
f AS MATERIALIZED (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM df UNION SELECT g FROM bf)),
crc AS MATERIALIZED (SELECT g, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda r, x: xor(r >> 8, t[(xor(r, x) & 255) + 1])), 4294967295) % {BUCKETS})::BIGINT AS bucket FROM f, tab),
p AS (SELECT rid, bucket, sum(n)::BIGINT AS n FROM df JOIN crc USING (g) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM p GROUP BY ALL), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bf JOIN crc USING (g) GROUP BY ALL),
tot AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM s) AS all_s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM t) AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (all_s + {BUCKETS}) / ((s.s + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
w AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM p JOIN gain USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, len(w) AS words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (rid)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM y WHERE words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place::BIGINT END AS rank FROM y LEFT JOIN z USING (rid)
"""
