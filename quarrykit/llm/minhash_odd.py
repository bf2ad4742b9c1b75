"""Near-duplicate groups: MinHash bands, odd-sketch filter, full-set confirmation.

A document's set holds its distinct shingles (``SHINGLE`` words, A-Z lower-
cased; the whole sequence where there are fewer words).  128 MinHash samples
give 32 bands of 4 (a pair at 0.75 is missed with probability 5e-6) and fold
into a 256-bit odd sketch: sample i flips the bit its value hashes to, so the
population count of the XOR of two sketches estimates high similarities
precisely.  Candidates whose sketches differ in more than ``MOST_BITS`` bits
(four deviations beyond what 0.75 gives) are dropped, all others are confirmed
on their full sets.

Hot groups: equal sets collapse to their least id first.  In a band's bucket
every member is compared with the least id only, and the confirmed links are
joined into components.  Pairs that this leaves open (members of one bucket in
different components) meet in tiles: buckets with such members join into
clusters, a cluster's members outside its largest component meet all others,
tile by tile, and a tile returns no more than a spanning forest of the links
that it confirmed.  No bucket is listed as all pairs.

Cases: a null or empty text, or one without words, has the empty set, links
with nothing and is kept; a null id has no component and is kept; rows that
repeat an id are one node; an id with several texts links through each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import textnp as T
from quarrykit.operators.graph import components
from quarrykit.storage import discard, saved

SHINGLE, PERCENT, SAMPLES, BANDS, SKETCH_WORDS, MOST_BITS, TILE, TILE_SHINGLES = 5, 75, 128, 32, 4, 84, 4096, 1_500_000
_ROWS = SAMPLES // BANDS
_KEYS = (np.random.default_rng(71).integers(1, 1 << 62, SAMPLES, dtype=np.uint64) << T.U64(1)) | T.U64(1)

_SIG_DDL = "id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
_SIG = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes, sorted in each document, and n+1 offsets."""
    data = T.lower_ascii(data)
    s, e, woffs = T.words(data, offs)
    codes = T.word_codes(data, s, e)
    docs = len(woffs) - 1
    if not len(codes):
        return codes, np.zeros(docs + 1, np.int64)
    roll = T.Rolling(codes, T.BASE_WORD)
    owner = T.owners(woffs)
    at = np.flatnonzero(T.window_mask(woffs, k))
    counts = np.diff(woffs)
    short = np.flatnonzero((counts > 0) & (counts < k))
    own = np.concatenate([owner[at], short])
    code = np.concatenate([roll.spans(at, at + k), roll.spans(woffs[short], woffs[short + 1])])
    order = np.lexsort((code, own))
    own, code = own[order], code[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (code[1:] != code[:-1])])
    return code[new], np.searchsorted(own[new], np.arange(docs + 1))


def signatures(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, odd sketches and two set codes of the documents with shingles."""
    full = np.flatnonzero(np.diff(offs) > 0)
    starts = offs[:-1][full]
    bands = np.zeros((len(full), BANDS), T.U64)
    sketch = np.zeros((len(full), SKETCH_WORDS), T.U64)
    rows = np.arange(len(full))
    for i in range(SAMPLES):
        least = np.minimum.reduceat(codes * _KEYS[i], starts) if len(full) else codes[:0]
        h = T.mix(least + T.U64(i + 1))
        bands[:, i // _ROWS] = T.mix(bands[:, i // _ROWS] * T.U64(3) + h + T.U64(i // _ROWS + 1))
        bit = (h >> T.U64(40)) % T.U64(64 * SKETCH_WORDS)
        np.bitwise_xor.at(sketch, (rows, (bit // T.U64(64)).astype(np.int64)), T.U64(1) << (bit % T.U64(64)))
    set_a = np.add.reduceat(T.mix(codes), starts) if len(full) else codes[:0]
    set_b = np.bitwise_xor.reduceat(T.mix(codes * T.U64(0x9FB21C651E98DF25)), starts) if len(full) else codes[:0]
    return bands, sketch, np.stack([set_a, set_b])


def _list(column: np.ndarray, have: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(have * (column.shape[1] if column.ndim > 1 else 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(column.reshape(-1).view(np.int64)))


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Signature of every row; no shuffle."""

    def rows(batches):
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offs = T.raw(part.column("text"))
                codes, soffs = shingle_sets(data, offs)
                bands, sketch, sets = signatures(codes, soffs)
                sizes = np.diff(soffs)
                have = (sizes > 0).astype(np.int64)
                both = np.zeros((2, len(sizes)), T.U64)
                both[:, have > 0] = sets
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), _list(bands, have), _list(sketch, have)], schema=_SIG)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, _SIG_DDL)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * common >= percent * all.

    Each text is dealt once by id, then to the pairs that need it: to the
    tiles of a, where a's own text comes first and the texts of its partners
    stream past it.
    """
    pairs = pairs.select("a", "b")
    per = pairs.groupBy("a").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(TILE // 4))).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("b"), F.col("tiles").cast("long")).cast("int")
    partners = pairs.join(per, "a").select(F.col("b").alias("id"), "a", tile.alias("tile"), F.lit(1).alias("kind"))
    heads = per.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("kind"))
    rows = texts.join(heads.unionByName(partners), "id").select("a", "tile", "kind", "id", "text")

    def check(batches):
        key, own = None, []
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offs = T.raw(part.column("text"))
                codes, soffs = shingle_sets(data, offs)
                a, t, kind, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "tile", "kind", "id"))
                out_a, out_b = [], []
                for i in range(part.num_rows):
                    mine = codes[soffs[i] : soffs[i + 1]]
                    if key != (a[i], t[i]):
                        key, own = (a[i], t[i]), []
                    if kind[i] == 0:
                        own.append(mine.copy())
                        continue
                    for other in own:
                        both = _common(other, mine)
                        if len(mine) and 100 * both >= percent * (len(mine) + len(other) - both):
                            out_a.append(a[i])
                            out_b.append(ids[i])
                            break
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.repartition("a", "tile").sortWithinPartitions("a", "tile", "kind").mapInArrow(check, "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _sketches_near(x: str, y: str):
    bits = [F.bit_count(F.element_at(x, i + 1).bitwiseXOR(F.element_at(y, i + 1))) for i in range(SKETCH_WORDS)]
    return reduce(lambda p, q: p + q, bits) <= MOST_BITS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    sig = saved(sign(docs, id_col, text_col), "signatures")
    some = sig.where("n_shingles > 0 and id is not null")

    # Equal sets collapse; their members follow the least id.
    sets = some.groupBy("set_a", "set_b").agg(F.min("id").alias("leader"))
    member = some.select("id", "set_a", "set_b").join(sets, ["set_a", "set_b"]).select("id", "leader").distinct()
    member = saved(member, "members")
    lead = some.join(member.where("id = leader").select("id"), "id", "left_semi")

    # Buckets of two or more leaders.
    banded = lead.select("id", F.explode("bands").alias("band"))
    size = banded.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("other"), F.count("*").alias("n")).where("head <> other")
    bucket = saved(banded.join(size.select("band", "head", "n"), "band").distinct(), "buckets")
    sketch = lead.select("id", "sketch")

    def close(pairs: DataFrame) -> DataFrame:
        x = sketch.select(F.col("id").alias("a"), F.col("sketch").alias("x"))
        y = sketch.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(_sketches_near("x", "y")).select("a", "b")

    star = saved(close(bucket.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()), "pairs")
    wanted = bucket.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = saved(texts.join(wanted, "id", "left_semi"), "texts")
    links = saved(confirmed(star, texts), "links")
    first = components(links)

    own = member.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    more = open_links(bucket, first, lead.select("id", "n_shingles", "sketch"), texts)
    final = components(links.unionByName(more).unionByName(own))

    discard(member, bucket, star, texts, links)
    out = sig.join(final.withColumnRenamed("component", "_component"), "id", "left")
    component = F.coalesce(F.col("_component"), F.col("id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near duplicates of a kept document (by id); all columns as they were."""
    gone = saved(near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "dropped")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


def open_links(bucket: DataFrame, component: DataFrame, sketch: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links between members of one bucket that are in different components so far.

    Buckets with such members join into clusters, so each text is sent once and
    not once a bucket.  A cluster's members outside its largest component meet
    all others in tiles of bounded size; a tile finds the near ones by sketch,
    confirms them on their sets and returns a spanning forest of the links.
    """
    rows = bucket.where("n > 2 and id <> head").join(component, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    split = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("first")).where("lo <> hi").select("band", "first")
    rows = saved(rows.join(split, "band").select("id", "component", "first").distinct(), "open")
    cluster = components(rows.select(F.col("id").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "cluster")
    # A cluster's least id is no row of components().
    rows = rows.select("id", "component").distinct().join(cluster, "id", "left").withColumn("cluster", F.coalesce("cluster", "id")).join(sketch.select("id", "n_shingles", "sketch"), "id")
    largest = rows.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rows = rows.join(largest, "cluster").withColumn("major", F.col("component") == F.col("main"))
    tiles = lambda own: F.greatest(F.lit(1), F.ceil(F.count_if(own) / F.lit(TILE)), F.ceil(F.coalesce(F.sum(F.when(own, F.col("n_shingles"))), F.lit(0)) / F.lit(TILE_SHINGLES))).cast("int")
    sizes = rows.groupBy("cluster").agg(tiles(F.col("major")).alias("majors"), tiles(~F.col("major")).alias("minors"))
    rows = rows.join(sizes, "cluster")
    tile = F.pmod(F.xxhash64("id"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors")).cast("long")).cast("int")
    key = lambda x, y, k: F.struct(x.alias("x"), y.alias("y"), F.lit(k).alias("k"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_minors = F.transform(all_of("minors"), lambda j: key(tile, j, 0))
    with_all = F.concat(F.transform(all_of("majors"), lambda i: key(i, tile, 0)), F.transform(all_of("minors"), lambda j: key(F.least(tile, j), F.greatest(tile, j), 1)))
    dealt = rows.select("id", "component", "sketch", "major", "cluster", tile.alias("tile"), F.explode(F.when(F.col("major"), with_minors).otherwise(with_all)).alias("t"))
    dealt = dealt.select("id", "component", "sketch", "major", "cluster", "tile", "t.*").join(texts, "id")
    return dealt.groupBy("cluster", "x", "y", "k").applyInArrow(lambda table: _tile_links(table, percent), "a long, b long").distinct()


def _tile_links(table: pa.Table, percent: int = PERCENT) -> pa.Table:
    """Links that join components of a tile, confirmed on full sets."""
    table = table.sort_by("id")  # one result, however the rows came
    ids, comp, major, tile = (table.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "major", "tile"))
    k, x, y = (table.column(c)[0].as_py() for c in ("k", "x", "y"))
    bits = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64)
    major = major.astype(bool)
    sets = [shingle_sets(*T.raw(part.column("text"))) for part in T.slices(table, "text")]
    sizes = np.concatenate([np.diff(o) for _, o in sets])
    codes = np.concatenate([c for c, _ in sets])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(codes, kind="stable")
    codes_sorted, owner = codes[order], np.repeat(np.arange(len(ids)), sizes)[order]
    parent = {c: c for c in set(comp.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out: list[tuple[int, int]] = []
    roots = comp.copy()
    for i in np.flatnonzero(~major):
        near = (roots != roots[i]) & (np.minimum(sizes, sizes[i]) * 100 >= percent * np.maximum(sizes, sizes[i]))
        near &= major if k == 0 else (~major & ((tile != tile[i]) if x != y else (ids > ids[i])))
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1) <= MOST_BITS]
        if not len(at):
            continue
        mine = codes[offs[i] : offs[i + 1]]
        lo, hi = np.searchsorted(codes_sorted, mine, "left"), np.searchsorted(codes_sorted, mine, "right")
        count = hi - lo
        first = np.concatenate([[0], np.cumsum(count)])
        common = np.bincount(owner[np.repeat(lo - first[:-1], count) + np.arange(first[-1])], minlength=len(ids))[at]
        for j in at[100 * common >= percent * (sizes[at] + sizes[i] - common)]:
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                roots[roots == max(p, q)] = min(p, q)
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS node FROM d UNION SELECT id, v FROM r JOIN e ON u = node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(node) AS component_id FROM r GROUP BY id) USING (doc_id)
"""
