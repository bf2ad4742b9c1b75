"""Block / bucket exchange of packed codes.

Documents live in *blocks* (a hash of the id; whole documents, bounded bytes).
A block reduces what it has to say about codes to one sorted, distinct array
and sends each *bucket* (a range of a hash of the code) its share as one packed
row.  A bucket sees at most one entry per block for any code, however hot the
code is, answers with flags in the order of the request, and the block, which
can rebuild the same array from its documents, lines the answers up again.
Spark moves the rows, groups them and replans; numpy does the per-row work.
There are as many buckets as blocks, but a block sends no empty rows: rows never
outnumber codes, so traffic grows with the input however many blocks there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.textnp import U64

BLOCK_BYTES = 8 << 20  # of the plan's estimated (compressed) input size
REQUEST = "block int, bucket int, n int, body binary"
ANSWER = "block int, bucket int, body binary"
_REQUEST = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])


def block_count(df: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks (and buckets) that keep each at about block_bytes of the input.

    The size is that of the files read; where the plan doesn't know it (rows made by
    a program) the texts are measured.  Estimates of joins are not trusted.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 55:
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, math.ceil(size / block_bytes))


def in_blocks(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id (null: the largest), text and block, by a hash of both: one id, or null, on many rows fills no block."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("block"), "id", "text"
    )


def bucket_of(code: np.ndarray, n: int) -> np.ndarray:
    """Range 0..n-1 by the high bits of a well mixed code."""
    return ((code >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def sent(block: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket present; bucket ascends, columns follow it."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(bucket))
    body = [b"".join(np.ascontiguousarray(c[i:j]).tobytes() for c in columns) for i, j in zip(cut, ends)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), block, np.int32)), pa.array(bucket[cut].astype(np.int32)), pa.array((ends - cut).astype(np.int32)), pa.array(body, pa.binary())], schema=_REQUEST)


def received(table: pa.Table, kinds: list[type]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns of all rows of a bucket's requests, row of each entry, rows' blocks and offsets."""
    pa.default_memory_pool().release_unused()  # what the group before this one held
    ns = table.column("n").to_numpy().astype(np.int64)
    bodies = table.column("body").to_pylist()
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, body in zip(ns, bodies):
        at = 0
        for c, kind in enumerate(kinds):
            out[c].append(np.frombuffer(body, kind, int(n), at))
            at += int(n) * np.dtype(kind).itemsize
    offs = np.concatenate([[0], np.cumsum(ns)])
    cols = [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)]
    return cols, np.repeat(np.arange(len(ns)), ns), table.column("block").to_numpy(), offs


def answered(table: pa.Table, offs: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Answers of one bucket, row for row in the order of the requests; booleans go as bits."""
    body = [b"".join((np.packbits(c[i:j]) if c.dtype == bool else np.ascontiguousarray(c[i:j])).tobytes() for c in columns) for i, j in zip(offs[:-1], offs[1:])]
    return pa.Table.from_arrays([table.column("block").cast(pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(body, pa.binary())], schema=_ANSWER)


def lined_up(answers: pa.Table, bucket: np.ndarray, flags: int) -> list[np.ndarray]:
    """For a block: flags bit columns in the order of its own request array."""
    out = [np.zeros(len(bucket), bool) for _ in range(flags)]
    if not answers.num_rows:
        return out
    for b, body in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()):
        i, j = np.searchsorted(bucket, [b, b + 1])
        size = (j - i + 7) // 8
        for c in range(flags):
            out[c][i:j] = np.unpackbits(np.frombuffer(body, np.uint8, size, c * size), count=j - i).astype(bool)
    return out


def block_of(table: pa.Table) -> int:
    return table.column("block")[0].as_py()
