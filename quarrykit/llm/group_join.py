"""Set-similarity self-join of documents by grouped prefixes.

Two documents link when 100 * common >= ``percent`` * all of their distinct
shingles.  Shingles have one order, rarest first (documents that hold them, counted
over all, then their code); two sets that link share a shingle of their *prefixes*,
the first n - ceil(percent * n / 100) + 1 in that order.

1. Documents lie in blocks; a block sends each of its shingles once, with how many
   of its documents hold it, and is answered with the shingle's class of frequency.
   A document then knows its prefix.  Shingles that no other document holds are part
   of the prefix but no key of the join, so most documents never enter it.
2. Equal sets are one.  Sets of one size with one prefix are a *group*; groups, not
   documents, are listed under the prefix's shingles (and under two steps of size,
   one of which any two sizes that can link share).
3. Pairs of groups are filtered by size and by what can still be common from the
   shared shingle's place on.  Under each key a group meets the least one only; pairs
   that pass are expanded to the members' sets and verified on the full shingles.
   First each group meets one partner, the one with which it shares most keys; pairs
   that are in one component after that are not verified again.
4. What is left are keys whose members are in different components.  They are cut
   into tiles of bounded size, which verify on full shingles and return a spanning
   forest.  No key is listed as all of its pairs.

Equality of shingles is that of 64-bit codes, equality of sets and prefixes that of
128-bit codes (a sum and an exclusive-or over the codes, and the size).

Cases: a null or empty text, or one without words, has the empty set and links with
nothing; with fewer words than a shingle the whole sequence is one; a null id has no
component; rows that repeat an id are one node, which links through each of its
texts; long texts are sliced, never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm import exchange as X
from quarrykit.llm import textnp as T
from quarrykit.llm.minhash_odd import confirmed, open_links, shingle_sets
from quarrykit.operators.graph import components
from quarrykit.storage import discard, saved

PERCENT, SHINGLE = 80, 5
_EXACT = 200  # frequencies up to it are told apart one by one
_NONE = (1 << 63) - 1
_DDL = "id long, n_shingles long, set_a long, set_b long, pre_a long, pre_b long, keys array<long>, places array<int>"
_SCHEMA = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in ("n_shingles", "set_a", "set_b", "pre_a", "pre_b")], ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


def frequency_class(df: np.ndarray) -> np.ndarray:
    """0..255, never falling with the frequency; exact up to _EXACT, then quarters of a doubling."""
    rough = _EXACT + 4 * np.log2(np.maximum(df, _EXACT) / _EXACT)
    return np.minimum(np.where(df <= _EXACT, df, rough), 255).astype(np.uint8)


def _block_sets(table: pa.Table, shingle: int):
    """Slices of a block with their shingle sets; the block's distinct codes, and how many of its rows hold each."""
    parts = [(part, *shingle_sets(*T.raw(part.column("text")), shingle)) for part in T.slices(table, "text")]
    code, count = np.unique(np.concatenate([c for _, c, _ in parts] or [np.zeros(0, T.U64)]), return_counts=True)
    return parts, code, count


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum and exclusive-or of the mixed values of each document (rows: documents)."""
    out = np.zeros((2, len(offs) - 1), T.U64)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        out[0, full] = np.add.reduceat(T.mix(values), offs[:-1][full])
        out[1, full] = np.bitwise_xor.reduceat(T.mix(values * T.U64(0x9FB21C651E98DF25)), offs[:-1][full])
    return out.view(np.int64)


def _profile(part: pa.RecordBatch, codes: np.ndarray, offs: np.ndarray, rank: np.ndarray, percent: int) -> pa.RecordBatch:
    """Sizes, set and prefix codes, and the prefix's keys of a slice's documents."""
    n = np.diff(offs)
    owner = T.owners(offs)
    order = np.lexsort((codes, rank, owner))
    codes_in, rank_in = codes[order], rank[order]
    place = np.arange(len(codes)) - offs[owner]
    prefix = place < (n - -(-percent * n // 100) + 1)[owner]
    pre_offs = np.searchsorted(np.flatnonzero(prefix), offs)
    pre = _sums(codes_in[prefix], pre_offs)
    key = np.flatnonzero(prefix & (rank_in > 1))
    key_offs = pa.array(np.searchsorted(key, offs).astype(np.int32))
    whole = _sums(codes, offs)
    lists = [pa.ListArray.from_arrays(key_offs, pa.array(x)) for x in (codes_in[key].view(np.int64), place[key].astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(part.column("id").to_numpy(zero_copy_only=False)), pa.array(n), *[pa.array(x) for x in (*whole, *pre)], *lists], schema=_SCHEMA)


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """id, size, set and prefix codes, and the prefix's shared shingles with their places, of every row."""
    n = X.block_count(docs, text_col)
    blocks = X.in_blocks(docs, id_col, text_col, n)

    def ask(table: pa.Table) -> pa.Table:
        _, code, count = _block_sets(table, shingle)
        return pa.Table.from_batches([X.sent(X.block_of(table), X.bucket_of(code, n), [code, np.minimum(count, 255).astype(np.uint8)])])

    def answer(table: pa.Table) -> pa.Table:
        (code, count), _, _, offs = X.received(table, [np.uint64, np.uint8])
        _, back = np.unique(code, return_inverse=True)
        return X.answered(table, offs, [frequency_class(np.bincount(back, weights=count))[back]])

    def profile(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.Table.from_batches([], schema=_SCHEMA)
        parts, code, _ = _block_sets(docs_, shingle)
        bucket, rank = X.bucket_of(code, n), np.zeros(len(code), np.uint8)
        for b, body in zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist()):
            i, j = np.searchsorted(bucket, [b, b + 1])
            rank[i:j] = np.frombuffer(body, np.uint8)
        return pa.Table.from_batches([_profile(part, codes, offs, rank[np.searchsorted(code, codes)], percent) for part, codes, offs in parts], schema=_SCHEMA)

    answers = blocks.groupBy("block").applyInArrow(ask, X.REQUEST).groupBy("bucket").applyInArrow(answer, X.ANSWER)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(profile, _DDL)


def _may_link(n, place, m, place_m, percent: int):
    """Sizes fit, and enough shingles follow the places that are shared for the sets to link."""
    left = F.least(n - place, m - place_m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links) of every row."""
    sig = saved(profiles(docs, id_col, text_col, percent, shingle), "profiles")
    some = sig.where((F.col("n_shingles") > 0) & (F.col("id") != _NONE))

    # Equal sets are one node, the least id; nodes of one size and prefix are a group under their least.
    same = ["n_shingles", "set_a", "set_b"]
    node = some.groupBy(*same).agg(F.min("id").alias("node"))
    member = saved(some.select("id", *same).join(node, same).select("id", "node").distinct(), "members")
    nodes = some.join(node.select(*same, F.col("node").alias("id")), [*same, "id"], "left_semi").dropDuplicates([*same, "id"])
    group = nodes.groupBy("n_shingles", "pre_a", "pre_b").agg(F.min("id").alias("g"), F.count("*").alias("of"))
    keyed = nodes.where(F.size("keys") > 0).join(group, ["n_shingles", "pre_a", "pre_b"])
    groups = saved(keyed.select("g", "id", F.col("n_shingles").alias("n"), "of", F.when(F.col("id") == F.col("g"), F.col("keys")).alias("keys"), F.when(F.col("id") == F.col("g"), F.col("places")).alias("places")), "groups")

    # Keys that two groups, or two sets of one group, are listed under, with the least group.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    listed = groups.where("id = g").select("g", "n", "of", step.alias("step"), F.explode(F.arrays_zip("keys", "places")).alias("k"))
    listed = listed.select("g", "n", "of", F.col("k.places").alias("place"), F.explode(F.array(F.xxhash64("k.keys", "step"), F.xxhash64("k.keys", F.col("step") + 1))).alias("key"))
    heads = listed.groupBy("key").agg(F.min(F.struct("g", "n", "place")).alias("head"), F.max("g").alias("last"), F.sum("of").alias("sets")).where("sets > 1")
    listed = saved(listed.join(heads.where("head.g <> last").drop("last"), "key"), "listed")

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = listed.select("g").distinct().unionByName(groups.where("of > 1").select("g").distinct()).distinct()
    texts = saved(texts.join(groups.join(wanted, "g", "left_semi").select("id").distinct(), "id", "left_semi"), "texts")

    # Group pairs that pass the filters, each group with the least of a key.
    pairs = listed.where((F.col("g") != F.col("head.g")) & _may_link(F.col("n"), F.col("place"), F.col("head.n"), F.col("head.place"), percent))
    pairs = saved(pairs.groupBy("g", F.col("head.g").alias("h")).agg(F.count("*").alias("shared")), "pairs")
    nearest = pairs.groupBy("g").agg(F.max(F.struct("shared", -F.col("h"))).alias("x")).select("g", (-F.col("x.col2")).alias("h"))
    inside = groups.where("id <> g").select(F.col("g").alias("a"), F.col("id").alias("b"))
    first = saved(confirmed(inside.unionByName(nearest.select(F.col("h").alias("a"), F.col("g").alias("b"))), texts, percent), "links")
    so_far = components(first)
    # The other pairs, expanded to the sets of the group, where they are not joined already.
    expanded = pairs.join(groups.select("g", F.col("id").alias("b")), "g").select(F.col("h").alias("a"), "b")
    part = lambda c: so_far.select(F.col("id").alias(c), F.col("component").alias(f"part_{c}"))
    apart = expanded.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    links = saved(first.unionByName(confirmed(apart.select("a", "b").distinct(), texts, percent)), "links")

    # Keys whose members are still in different components; the least group's first set has met all others.
    found = components(links)
    sizes = listed.groupBy("key").agg(F.max(F.col("n") - F.col("place")).alias("left"), F.min("n").alias("least"))
    able = listed.join(sizes, "key").where((100 + percent) * F.least(F.col("n") - F.col("place"), "left") >= percent * (F.col("n") + F.greatest("least", F.col("n") * percent / 100)))
    bucket = able.join(groups.select("g", "id"), "g").select(F.col("key").alias("band"), "id", F.col("head.g").alias("head"), F.col("sets").alias("n"))
    groups_only = groups.where("of > 2").select(F.col("g").alias("band"), "id", F.col("g").alias("head"), F.col("of").alias("n"))
    bucket = saved(bucket.unionByName(groups_only).distinct(), "buckets")
    blank = nodes.select("id", "n_shingles", F.array(*[F.lit(0).cast("long")] * 4).alias("sketch"))
    more = open_links(bucket, found, blank, texts, percent)
    own = member.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    final = components(links.unionByName(more).unionByName(own))

    out = saved(sig.select("id", "n_shingles").join(final.withColumnRenamed("component", "_component"), "id", "left"), "linked")
    discard(sig, member, groups, listed, texts, pairs, first, links, bucket)
    known = F.when(F.col("id") != _NONE, F.col("id"))
    return out.select(known.alias("doc_id"), "n_shingles", F.coalesce(F.col("_component"), known).alias("component_id"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS node FROM d UNION SELECT id, v FROM r JOIN e ON u = node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(node) AS component_id FROM r GROUP BY id) USING (doc_id)
"""
