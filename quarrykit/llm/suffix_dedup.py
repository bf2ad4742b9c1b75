"""Exact sub-string de-duplication with a logarithmic family of suffix arrays.

Removed is every byte covered by a string of ``width`` bytes that also starts
anywhere else in the corpus.  Bytes covered by such strings of ``report`` bytes
are counted, too, and stay: passages shorter than ``width`` are seen, not cut.

*Sparse suffixes.*  Of the inner strings of ``head`` bytes of a window of
``min(width, report)`` bytes one is canonical, the least by hash; equal windows
have equal ones at the same place.  Only suffixes that start at a canonical
place are indexed, one in about seventy bytes.

*Suffix arrays.*  A suffix is read in symbols of ``head`` bytes each, coded, up
to ``SYMBOLS`` of them.  An array holds suffixes in lexicographic order of
their symbols, so those with a long common prefix are neighbours, and the
longest common prefix (LCP) of a suffix with any other is the greater of those
with its two neighbours.

*Logarithmic family.*  Blocks of documents arrive in batches.  Each shard of
the index (a range of the first symbol's hash) sorts a new batch into an array,
merge-scans it against the arrays of the levels it has, and merges arrays of
equal rank, as carries in a binary counter, so that an entry is merged
O(log batches) times.  :func:`add_batch` is that step; :class:`Family` keeps the
levels as tables, so that later batches meet all earlier ones.

*Long matches.*  A window can recur only if each suffix that starts in it has
an LCP that reaches the window's end (as far as whole symbols tell, and where its
place is canonical in the window); others are ruled out.  Of those left, runs of windows with one canonical place are compared
as one string: where the whole stretch recurs, all its windows do.  Only the
other windows, near the ends of repeated passages, are compared one by one, by
64-bit codes and the bits of the bucket, which an independent hash chooses (so
the code grows with the data); of a stretch that recurs, one copy takes part.
Equal codes are taken for equal bytes: with w windows to compare, an expected
w**2 / 2**(65 + log2(buckets)) false pairs, under one for 100 TB like the tables'.

Cases: a null or empty text is zero bytes; texts shorter than ``width`` keep
every byte; a null id is carried through; equal ids and whole repeated rows are
documents like any others, so both copies of a long enough text go.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import exchange as X
from quarrykit.llm import textnp as T

WIDTH, REPORT, HEAD, SYMBOLS, BATCHES = 400, 200, 64, 3, 8
_NULL = (1 << 63) - 1
_PLACE_BITS = T.U64(28)
_ENTRY = np.dtype(f"S{4 * SYMBOLS}")


class _Level:
    """A sorted array of the distinct suffixes of 2**rank batches."""

    def __init__(self, rank: int, heads: np.ndarray):
        self.rank, self.heads = rank, heads


def merge_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entries of sorted a that sorted b has too."""
    if not len(a) or not len(b):
        return a[:0]
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return a[b[at] == a]


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct entries of two sorted arrays, in order."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs: one merge
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def add_batch(levels: list[_Level], heads: np.ndarray) -> tuple[list[_Level], list[np.ndarray]]:
    """Index a batch's sorted distinct suffixes; returns the new levels and the suffixes found in old ones."""
    found = [merge_scan(heads, level.heads) for level in levels]
    new, levels = _Level(0, heads), list(levels)
    while levels and levels[-1].rank == new.rank:
        new = _Level(new.rank + 1, merged(levels.pop().heads, new.heads))
    levels.append(new)
    return levels, found


def _symbols(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entries).view(np.uint32).reshape(-1, SYMBOLS)


def lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading symbols that entries have in common; 0 marks a text's end and equals nothing."""
    x, y = _symbols(a), _symbols(b)
    out, same = np.zeros(len(x), np.uint8), np.ones(len(x), bool)
    for k in range(SYMBOLS):
        same &= (x[:, k] == y[:, k]) & (x[:, k] != 0)
        out += same
    return out


def longest(entries: np.ndarray, level: np.ndarray) -> np.ndarray:
    """LCP of each entry with those of a sorted level other than itself."""
    out = np.zeros(len(entries), np.uint8)
    if not len(level):
        return out
    for at, there in ((np.searchsorted(level, entries, "left") - 1, lambda i: i >= 0), (np.searchsorted(level, entries, "right"), lambda i: i < len(level))):
        ok = there(at)
        out[ok] = np.maximum(out[ok], lcp(entries[ok], level[at[ok]]))
    return out


def _answers(entries: np.ndarray, levels: list[_Level], repeated: np.ndarray) -> np.ndarray:
    """LCP of each entry with any other suffix of the levels; repeated ones meet themselves."""
    distinct, back = np.unique(entries, return_inverse=True)
    out = np.zeros(len(distinct), np.uint8)
    for level in levels:
        np.maximum(out, longest(distinct, level.heads), out=out)
    own = np.isin(distinct, repeated, kind="sort") if len(repeated) else np.zeros(len(distinct), bool)
    out[own] = lcp(distinct[own], distinct[own])
    return out[back]


class _Slice:
    """Text of a slice of documents and its canonical places."""

    def __init__(self, batch):
        self.data, self.offs = T.raw(batch.column("text"))
        self.ids = batch.column("id").to_numpy(zero_copy_only=False)
        self._roll = None

    @property
    def roll(self) -> T.Rolling:
        if self._roll is None:
            self._roll = T.Rolling(T.byte_codes()[self.data], T.BASE_BYTE)
        return self._roll

    def places(self, sample: int, head: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of windows with one canonical place starts, and that place."""
        valid = T.window_mask_long(self.offs, sample)
        if not valid.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes = self.roll.windows(head)
        low = (T.U64(1) << _PLACE_BITS) - T.U64(1)
        key = (codes & ~low) | np.arange(len(codes), dtype=np.uint64)
        place = (T.sliding(key, sample - head + 1, np.minimum)[: len(valid)] & low).astype(np.int64)
        edge = np.ones(len(valid), bool)
        edge[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        start = np.flatnonzero(edge & valid)
        return start, place[start]

    def suffixes(self, place: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
        """64-bit code of each suffix's first symbol, and its entry."""
        end = self.offs[np.searchsorted(self.offs, place, "right")]
        out = np.zeros((len(place), SYMBOLS), ">u4")
        first = np.zeros(len(place), T.U64)
        for k in range(SYMBOLS):
            at = np.flatnonzero(place + (k + 1) * head <= end)
            code = self.roll.spans(place[at] + k * head, place[at] + (k + 1) * head)
            out[at, k] = np.maximum(code & T.U64(0xFFFFFFFF), T.U64(1))
            if k == 0:
                first[at] = code
        return first, np.ascontiguousarray(out).view(_ENTRY).ravel()

    def release(self) -> None:
        """Eight bytes a byte of text: kept for one slice at a time."""
        self._roll = None

    def second(self) -> T.Rolling:
        return T.Rolling(T.byte_codes(T._SEED + 1)[self.data], T.BASE_BYTE2)


class _Open:
    """Windows of one width that may recur, as stretches with one canonical place each."""

    def __init__(self, s: _Slice, start: np.ndarray, place: np.ndarray, symbols: np.ndarray, width: int, sample: int, head: int):
        self.s, self.width = s, width
        n = len(s.data)
        alive = T.window_mask_long(s.offs, width)
        # A suffix with too short an LCP rules out the windows that it would have to
        # fill, of those in which it is canonical (elsewhere its copy may not be indexed).
        end = np.minimum(np.append(start[1:], n), s.offs[np.searchsorted(s.offs, start, "right")] - sample + 1)
        lo = np.maximum(np.maximum(place + (symbols.astype(np.int64) + 1) * head - width, start - (width - sample)), 0)
        out = (symbols < SYMBOLS) & (lo < end)
        delta = np.bincount(lo[out], minlength=n + 2) - np.bincount(end[out], minlength=n + 2)
        p = np.flatnonzero(alive & (np.cumsum(delta)[: len(alive)] == 0))
        run = np.searchsorted(start, p, "right") - 1
        new = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (run[1:] != run[:-1])]) if len(p) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.first, self.last = p[first], p[np.append(first[1:], len(p)) - 1] if len(p) else p
        at = place[run[first]]
        tag = T.U64(width * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        self.code = T.mix(s.roll.spans(at, at + head) ^ tag)
        self.stretch = T.mix(s.roll.spans(self.first, self.last + width) ^ ((at - self.first).astype(T.U64) << T.U64(40)) ^ tag)

    def starts(self, at: np.ndarray) -> np.ndarray:
        count = self.last[at] - self.first[at] + 1
        begin = np.concatenate([[0], np.cumsum(count)])
        return np.repeat(self.first[at] - begin[:-1], count) + np.arange(begin[-1])

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent codes of each window of the stretches at."""
        starts = self.starts(at)
        return self.s.roll.spans(starts, starts + self.width), self.s.second().spans(starts, starts + self.width)


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _distinct_pairs(bucket: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Distinct (bucket, a, b) in order, whether each occurs twice or more, and where each row went."""
    order = np.lexsort((b, a, bucket))
    sb, sa, sc = bucket[order], a[order], b[order]
    new = np.concatenate([[True], (sb[1:] != sb[:-1]) | (sa[1:] != sa[:-1]) | (sc[1:] != sc[:-1])]) if len(sb) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return sb[first], sa[first], sc[first], np.diff(np.append(first, len(sb))) > 1, back


def _parts(table: pa.Table):
    """Slices of a block, the same ones in every stage: rows may arrive in another order each time."""
    pa.default_memory_pool().release_unused()  # what the block before this one held
    return T.slices(table.sort_by([("id", "ascending"), ("text", "ascending")]), "text")


def _suffix_requests(table: pa.Table, n: int, sample: int, head: int) -> pa.Table:
    """A block's suffix array to the shards, and its places to itself (bucket n + block)."""
    block = X.block_of(table)
    sizes, start, gap, code, entry = [], [], [], [], []
    for part in _parts(table):
        s = _Slice(part)
        a, p = s.places(sample, head)
        c, e = s.suffixes(p, head)
        for into, x in ((sizes, [len(a)]), (start, a.astype(np.int32)), (gap, (p - a).astype(np.uint32)), (code, c), (entry, e)):
            into.append(x)
    bucket, entry = X.bucket_of(_joined(code), n), _joined(entry, _ENTRY)
    key = entry.view(">u4").reshape(-1, SYMBOLS).astype(np.uint64)
    hi, lo = (bucket.astype(np.uint64) << T.U64(32)) | key[:, 0], (key[:, 1] << T.U64(32)) | key[:, 2]
    _, _, _, twice, back = _distinct_pairs(np.zeros(len(hi), np.int32), hi, lo)
    where = np.empty(len(twice), np.int64)
    where[back] = np.arange(len(back))
    sent = X.sent(block, bucket[where], [entry[where], twice.view(np.uint8)])
    digest = b"".join(x.tobytes() for x in (np.array([len(sizes)], np.int64), _joined(sizes, np.int64).astype(np.int64), _joined(start, np.int32), _joined(gap, np.uint32), back.astype(np.uint32), bucket[where]))
    own = pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n + block], pa.int32()), pa.array([len(back)], pa.int32()), pa.array([digest], pa.binary())], schema=X._REQUEST)
    return pa.Table.from_batches([sent, own])


def _places(hits: pa.Table, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Run start, place and LCP in symbols of every canonical place of a block, by slice."""
    buckets = hits.column("bucket").to_numpy()
    (body,) = hits.filter(pa.array(buckets >= n)).column("body").to_pylist()
    (slices,) = np.frombuffer(body, np.int64, 1)
    sizes = np.frombuffer(body, np.int64, slices, 8)
    total, at = int(sizes.sum()), 8 + 8 * int(slices)
    start, gap, back = (np.frombuffer(body, kind, total, at + 4 * total * i) for i, kind in enumerate((np.int32, np.uint32, np.uint32)))
    bucket = np.frombuffer(body, np.int32, -1, at + 12 * total)
    symbols = np.zeros(len(bucket), np.uint8)
    answers = hits.filter(pa.array(buckets < n))
    for b, found in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()):
        i, j = np.searchsorted(bucket, [b, b + 1])
        symbols[i:j] = np.frombuffer(found, np.uint8)
    cut = np.cumsum(sizes)[:-1]
    start = start.astype(np.int64)
    return list(zip(np.split(start, cut), np.split(start + gap, cut), np.split(symbols[back], cut)))


def _opened(docs: pa.Table, hits: pa.Table, n: int, widths: tuple[int, ...], head: int):
    """Each slice, which of its documents share a symbol with others, and their open windows by width."""
    for part, (start, place, symbols) in zip(_parts(docs), _places(hits, n)):
        _, offs = T.raw(part.column("text"))
        owner = np.searchsorted(offs, start, "right") - 1
        some = np.zeros(part.num_rows, bool)
        some[owner[symbols > 0]] = True
        if not some.any():
            yield part, some, []
            continue
        mine = some[owner]
        shift = np.concatenate([[0], np.cumsum(np.where(some, 0, np.diff(offs)))])[owner[mine]]
        s = _Slice(part.filter(pa.array(some)))
        opened = [_Open(s, start[mine] - shift, place[mine] - shift, symbols[mine], w, min(widths), head) for w in widths]
        s.release()
        yield part, some, opened


def _scan_batch(table: pa.Table, stored: pa.Table, n: int, batches: int) -> pa.Table:
    """A shard: index the request arrays batch by batch, beside the stored levels; answer LCPs."""
    if not table.num_rows:
        return pa.Table.from_batches([], schema=X._ANSWER)
    if table.column("bucket")[0].as_py() >= n:
        return table.select(["block", "bucket", "body"]).cast(X._ANSWER)
    (entries, twice), row, of_block, offs = X.received(table, [_ENTRY, np.uint8])
    batch = (of_block % batches)[row]
    old = [_Level(r, np.frombuffer(b, _ENTRY)) for r, b in sorted(zip(stored.column("rank").to_pylist(), stored.column("body").to_pylist()), reverse=True)]
    levels: list[_Level] = []
    repeated = [np.unique(entries[twice > 0])]
    for b in range(batches):
        array, count = np.unique(entries[batch == b], return_counts=True)
        repeated.append(array[count > 1])
        if len(array):
            levels, found = add_batch(levels, array)
            repeated += found + [merge_scan(array, level.heads) for level in old]
    return X.answered(table, offs, [_answers(entries, old + levels, np.unique(np.concatenate(repeated)))])


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_shared", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())])))])
_OUT_DDL = "id long, n_bytes long, n_removed long, n_spans long, n_shared long, kept binary, spans array<struct<start: long, bytes: long>>"
_LEVEL_DDL = "bucket int, rank int, body binary"


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, head: int = HEAD, batches: int = BATCHES, report: int = REPORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_shared, kept (bytes) and spans (start byte, bytes) per row."""
    n = X.block_count(docs, text_col)
    blocks = X.in_blocks(docs, id_col, text_col, n)
    sample, widths = min(width, report), (width, report)

    # 1. Suffixes: each block's sparse suffix array to the index shards, LCPs back.
    def ask_suffixes(table: pa.Table) -> pa.Table:
        return _suffix_requests(table, n, sample, head)

    nothing = pa.table({"bucket": pa.array([], pa.int32()), "rank": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})

    def index(table: pa.Table) -> pa.Table:
        return _scan_batch(table, nothing, n, batches)

    # 2. Stretches of windows that the LCPs leave open.
    def stretches(docs_: pa.Table, hits: pa.Table):
        slices = list(_opened(docs_, hits, n, widths, head))
        parts = [o for _, _, opened in slices for o in opened]
        code = _joined([o.code for o in parts])
        return slices, parts, _distinct_pairs(X.bucket_of(code, n), code, _joined([o.stretch for o in parts]))

    def ask_stretches(docs_: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.Table.from_batches([], schema=X._REQUEST)
        _, _, (bucket, code, stretch, twice, _) = stretches(docs_, hits)
        return pa.Table.from_batches([X.sent(X.block_of(docs_), bucket, [code, stretch, twice.view(np.uint8)])])

    def answer_stretches(table: pa.Table) -> pa.Table:
        """Does the stretch recur; must its windows be compared one by one.

        Of the blocks that have a recurring stretch the least one compares it,
        so that a second run of this task answers alike.
        """
        (code, stretch, twice), row, of_block, offs = X.received(table, [np.uint64, np.uint64, np.uint8])
        out_many, out_open = np.zeros(len(code), bool), np.zeros(len(code), bool)
        if len(code):
            order = np.lexsort((of_block[row], stretch, code))
            c, s = code[order], stretch[order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            many = (np.diff(np.append(first, len(c))) > 1) | (np.bincount(group, weights=twice[order], minlength=len(first)) > 0)
            head_of = np.cumsum(np.concatenate([[True], c[1:] != c[:-1]])) - 1
            single = np.bincount(head_of, weights=~many[group]) > 0
            # A head with one stretch only, once, needs no comparison: nothing else has it.
            kinds = np.bincount(head_of[first])
            out_many[order] = many[group]
            out_open[order] = (single & (kinds > 1))[head_of] & new
        return X.answered(table, offs, [out_many, out_open])

    # 3. Windows near the ends of repeated passages.
    def judged(docs_: pa.Table, hits: pa.Table, verdicts: pa.Table):
        """Slices, and of each one's open windows the stretches that recur and those to compare."""
        slices, parts, (bucket, code, _, _, back) = stretches(docs_, hits)
        many, wide = X.lined_up(verdicts, bucket, 2)
        seen, at, out = np.zeros(len(code), bool), 0, []
        for o in parts:
            mine = back[at : at + len(o.code)]
            at += len(o.code)
            # All copies of a stretch that does not recur; one of a stretch that does.
            one = np.zeros(len(mine), bool)
            one[np.unique(mine, return_index=True)[1]] = True
            ask = wide[mine] & (~many[mine] | (one & ~seen[mine]))
            seen[mine[ask]] = True
            out.append((o, np.flatnonzero(many[mine]), np.flatnonzero(ask)))
        return slices, out

    def window_requests(opened):
        codes = []
        for i, (o, _, ask) in enumerate(opened):
            if len(ask):
                codes.append(o.windows(ask))
            if i + 1 == len(opened) or opened[i + 1][0].s is not o.s:
                o.s.release()
        a, b = _joined([p[0] for p in codes]), _joined([p[1] for p in codes])
        return _distinct_pairs(X.bucket_of(b, n), a, np.zeros(len(a), np.uint8))

    def ask_windows(docs_: pa.Table, both: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.Table.from_batches([], schema=X._REQUEST)
        bucket, code, _, twice, _ = window_requests(judged(docs_, *_rounds(both, 2))[1])
        return pa.Table.from_batches([X.sent(X.block_of(docs_), bucket, [code, twice.view(np.uint8)])])

    def answer_windows(table: pa.Table) -> pa.Table:
        (code, twice), _, _, offs = X.received(table, [np.uint64, np.uint8])
        _, back, count = np.unique(code, return_inverse=True, return_counts=True)
        many = count > 1
        many |= np.bincount(back, weights=twice, minlength=len(many)) > 0
        return X.answered(table, offs, [many[back]])

    # 4. Cover and cut.
    def cut(docs_: pa.Table, all_: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.Table.from_batches([], schema=_OUT)
        hits, verdicts, windows = _rounds(all_, 3)
        slices, opened = judged(docs_, hits, verdicts)
        bucket, _, _, _, back = window_requests(opened)
        (many,) = X.lined_up(windows, bucket, 1)
        many, at, gone = many[back], 0, {}
        for o, whole, ask in opened:
            starts = o.starts(ask)
            n_bytes, mine = len(o.s.data), starts[many[at : at + len(starts)]]
            at += len(starts)
            delta = np.bincount(o.first[whole], minlength=n_bytes + 1) - np.bincount(o.last[whole] + o.width, minlength=n_bytes + 1)
            delta += np.bincount(mine, minlength=n_bytes + 1) - np.bincount(mine + o.width, minlength=n_bytes + 1)
            gone[id(o)] = np.cumsum(delta)[:n_bytes] > 0
        return pa.Table.from_batches([_cut(part, some, [gone[id(o)] for o in parts]) for part, some, parts in slices], schema=_OUT)

    tag = lambda df, k: df.select("block", "bucket", "body", F.lit(k).alias("round"))
    by_block = blocks.groupBy("block")
    hits = by_block.applyInArrow(ask_suffixes, X.REQUEST).groupBy("bucket").applyInArrow(index, X.ANSWER)
    asked = by_block.cogroup(hits.groupBy("block")).applyInArrow(ask_stretches, X.REQUEST)
    verdicts = asked.groupBy("bucket").applyInArrow(answer_stretches, X.ANSWER)
    both = tag(hits, 0).unionByName(tag(verdicts, 1))
    opened = by_block.cogroup(both.groupBy("block")).applyInArrow(ask_windows, X.REQUEST)
    windows = opened.groupBy("bucket").applyInArrow(answer_windows, X.ANSWER)
    out = by_block.cogroup(both.unionByName(tag(windows, 2)).groupBy("block")).applyInArrow(cut, _OUT_DDL)
    return out.select(F.when(F.col("id") != _NULL, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "n_shared", "kept", "spans")


def _rounds(table: pa.Table, k: int) -> list[pa.Table]:
    r = table.column("round").to_numpy() if table.num_rows else np.zeros(0, np.int32)
    return [table.filter(pa.array(r == i)) for i in range(k)]


def _cut(part, some: np.ndarray, masks: list[np.ndarray]) -> pa.RecordBatch:
    """Result rows of a slice; masks cover the bytes of the documents some: removed, shared."""
    data, offs = T.raw(part.column("text"))
    ids = part.column("id").to_numpy(zero_copy_only=False)
    docs, n, sizes = len(offs) - 1, len(data), np.diff(offs)
    gone, shared = np.zeros(n, bool), np.zeros(n, bool)
    if masks:
        at = np.repeat(some, sizes)
        gone[at], shared[at] = masks
    body = data[~gone]
    kept_offs = np.concatenate([[0], np.cumsum(~gone)])[offs]
    n_shared = np.diff(np.concatenate([[0], np.cumsum(shared | gone)])[offs])
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = gone & np.concatenate([[True], ~gone[:-1] | edge[1:n]])[:n] if n else gone
    stop = gone & np.concatenate([~gone[1:] | edge[1:n], [True]])[:n] if n else gone
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    span_offs = np.searchsorted(a, offs).astype(np.int32)
    owner = np.repeat(np.arange(docs), np.diff(span_offs))
    spans = pa.StructArray.from_arrays([pa.array(a - offs[owner]), pa.array(b - a)], ["start", "bytes"])
    kept = pa.BinaryArray.from_buffers(pa.binary(), docs, [None, pa.py_buffer(kept_offs.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(sizes), pa.array(sizes - np.diff(kept_offs)), pa.array(np.diff(span_offs).astype(np.int64)), pa.array(n_shared), kept, pa.ListArray.from_arrays(pa.array(span_offs), spans)],
        schema=_OUT,
    )


class Family:
    """Levels as tables in a shared folder: batches that come later meet all earlier ones.

    A level is a table of one array per shard; ``live`` lists those in use, by rank.
    Adding a batch writes its own arrays, or those of the levels that it completes,
    and nothing else; a failed add leaves the old levels in use.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int = 64, sample: int = REPORT, head: int = HEAD):
        self.spark, self.folder, self.shards, self.sample, self.head = spark, folder, shards, sample, head
        self.live: list[tuple[int, str]] = []

    def levels(self) -> DataFrame:
        out = self.spark.createDataFrame([], _LEVEL_DDL)
        for rank, path in self.live:
            out = out.unionByName(self.spark.read.parquet(path).select("bucket", F.lit(rank).alias("rank"), "body"))
        return out

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_bytes and longest (bytes of whole symbols that a suffix shares with any other, this batch's included)."""
        n, sample, head = self.shards, self.sample, self.head
        blocks = X.in_blocks(docs, id_col, text_col, n)
        by_block = blocks.groupBy("block")
        new = f"{self.folder}/{uuid.uuid4().hex}"
        by_block.applyInArrow(lambda t: _suffix_requests(t, n, sample, head), X.REQUEST).write.parquet(f"{new}-requests")
        requests, stored = self.spark.read.parquet(f"{new}-requests"), self.levels()
        answers = requests.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(lambda t, old: _scan_batch(t, old, n, 1), X.ANSWER)

        def report(docs_: pa.Table, hits: pa.Table) -> pa.Table:
            out = []
            for part, (start, _, symbols) in zip(_parts(docs_), _places(hits, n) if docs_.num_rows else []):
                _, offs = T.raw(part.column("text"))
                most = np.zeros(part.num_rows, np.int64)
                np.maximum.at(most, np.searchsorted(offs, start, "right") - 1, symbols.astype(np.int64) * head)
                out.append(pa.RecordBatch.from_arrays([part.column("id").combine_chunks(), pa.array(np.diff(offs)), pa.array(most)], names=["id", "n_bytes", "longest"]))
            return pa.Table.from_batches(out, schema=pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("longest", pa.int64())]))

        by_block.cogroup(answers.groupBy("block")).applyInArrow(report, "id long, n_bytes long, longest long").write.parquet(f"{new}-report")

        # The carry: the new array and the levels of equal rank become one of the next.
        rank, live, old = 0, list(self.live), self.spark.createDataFrame([], _LEVEL_DDL)
        while live and live[-1][0] == rank:
            _, path = live.pop()
            old = old.unionByName(self.spark.read.parquet(path).select("bucket", F.lit(rank).alias("rank"), "body"))
            rank += 1

        def merge(table: pa.Table, arrays: pa.Table) -> pa.Table:
            (entries, _), *_ = X.received(table, [_ENTRY, np.uint8])
            out = np.unique(entries)
            for body in arrays.column("body").to_pylist():
                out = merged(out, np.frombuffer(body, _ENTRY))
            bucket = (table if table.num_rows else arrays).column("bucket")[0].as_py()
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "rank": pa.array([rank], pa.int32()), "body": pa.array([out.tobytes()], pa.binary())})

        requests.where(F.col("bucket") < n).groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(merge, _LEVEL_DDL).write.parquet(new)
        self.live = [*live, (rank, new)]
        return self.spark.read.parquet(f"{new}-report").select(F.when(F.col("id") != _NULL, F.col("id")).alias("doc_id"), "n_bytes", "longest")


_COVER = """SELECT rid, sum(b - a)::BIGINT AS n, count(*) AS spans, list({{'a': a, 'b': b}} ORDER BY a) AS runs FROM (SELECT rid, min(i) AS a, max(i) + {w} AS b FROM (
  SELECT rid, i, sum(step) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {w} THEN 0 ELSE 1 END AS step FROM (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM (SELECT rid, i, md5(h[2 * i - 1 : 2 * (i + {w} - 1)]) AS g FROM (SELECT rid, h, unnest(range(1, (len(h) // 2) - {w} + 2)) AS i FROM d WHERE len(h) >= 2 * {w}))) WHERE c > 1))) GROUP BY rid, run) GROUP BY rid"""
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
cut AS ({_COVER.format(w=WIDTH)}),
shared AS ({_COVER.format(w=REPORT)}),
left_over AS (SELECT rid, coalesce(string_agg(CASE WHEN b > a THEN h[2 * a - 1 : 2 * b - 2] ELSE '' END, '' ORDER BY a), '') AS t FROM (
  SELECT rid, h, unnest(list_concat([1], list_transform(coalesce(runs, []), lambda r: r.b))) AS a, unnest(list_concat(list_transform(coalesce(runs, []), lambda r: r.a), [len(h) // 2 + 1])) AS b FROM d LEFT JOIN cut USING (rid)) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(cut.n, 0)::BIGINT AS n_removed, coalesce(cut.spans, 0)::BIGINT AS n_spans, coalesce(shared.n, 0)::BIGINT AS n_shared, sha256(unhex(t)) AS kept_sha256
FROM d JOIN left_over USING (rid) LEFT JOIN cut USING (rid) LEFT JOIN shared USING (rid)
"""
