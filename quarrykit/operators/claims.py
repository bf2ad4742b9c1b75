"""Claims: vocabulary tags, fuzzy duplicates, merges, profile preview and apply.

``ratio`` is the Ratcliff/Obershelp similarity of Python's difflib, which is not
symmetric; the argument order is part of each operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.functions import text
from quarrykit.operators import greedy, resemblance
from quarrykit.storage import discard, saved

THRESHOLD = 0.85
CATEGORIES = ("Identity", "Methodology", "USP", "Philosophy", "Story", "Operational")
# Patterns of a form's labels, which are no evidence; kinds of hints by where they go.
LABELS = r"등록\s*여부|등록증\s*번호|가능\s*여부|사업자\s*등록(?!증)"
PROJECT_KINDS, CERTIFICATE_KINDS = ("실적",), ("인증", "등록", "인증/등록", "자격", "특허")


def vocabulary_tags(values: Column, vocabulary: list[str]) -> Column:
    """Each value's word of the vocabulary: equal, else the first that contains it or lies in it; distinct, in order."""
    vocab = F.array(*[F.lit(v) for v in vocabulary])

    def word(v: Column) -> Column:
        near = F.filter(vocab, lambda a: F.contains(v, a) | F.contains(a, v))
        return F.when(F.array_contains(vocab, v), v).otherwise(F.get(near, F.lit(0)))

    trimmed = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
    return F.array_distinct(F.filter(F.transform(trimmed, word), lambda v: v.isNotNull()))


def valid_claims(claims: DataFrame, least: float = 0.6) -> DataFrame:
    """Claims with a statement, a known category and enough confidence."""
    return claims.where((F.trim("statement") != "") & (F.col("confidence") >= least) & F.col("category").isin(*CATEGORIES))


def similar_pairs(claims: DataFrame, threshold: float = THRESHOLD, limit: int = 50) -> DataFrame:
    """The limit most similar pairs (a before b by id) of a category, ties by a and b.

    Equal statements of a category are one; no statement is listed with more than its
    first limit + 1 ids, as further ones cannot come first.  Pairs of one statement have
    similarity 1, which no others reach, so where they are enough nothing is compared.
    Else tiles of bounded size find their best pairs: first those of one chunk each,
    whose limit-th best is the threshold of all others.
    """
    rows = claims.where("statement is not null").select("id", "category", "statement", F.coalesce(F.col("category").cast("string"), F.lit("\x00")).alias("_group"))
    first = Window.partitionBy("_group", "statement").orderBy("id")
    ids = saved(rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit + 1).drop("_n"), "ids")
    # All pairs of one statement: those of its first ids with all others listed.
    each = saved(ids.groupBy("_group", "statement").agg(F.array_sort(F.collect_list("id")).alias("ids")), "each")
    same = each.where(F.size("ids") > 1)
    same = same.select("_group", F.explode(F.slice(F.transform("ids", lambda x, i: F.struct(x.alias("a"), i.alias("i"))), F.lit(1), F.lit(limit))).alias("x"), "ids", "statement")
    same = same.select("_group", "statement", F.col("x.a").alias("a"), F.explode(F.slice("ids", F.col("x.i") + 2, F.lit(limit))).alias("b"), F.lit(1.0).alias("similarity"))
    found = _top(same.join(ids.select("_group", "statement", F.col("id").alias("a"), "category"), ["_group", "statement", "a"]), limit)
    for rounds in ("one", "two"):
        if found.count() >= limit and found.agg(F.min("similarity")).first()[0] == 1.0:
            break
        least = found.agg(F.min("similarity")).first()[0] if found.count() >= limit else None
        texts = resemblance.best_pairs(each, "_group", "statement", "ids", threshold, limit, least, rounds)
        of = lambda k, id_: ids.select("_group", F.col("statement").alias(k), F.col("id").alias(id_))
        pairs = texts.join(of("left", "a").join(ids.select("_group", F.col("id").alias("a"), "category"), ["_group", "a"]), ["_group", "left"]).join(of("right", "b"), ["_group", "right"]).where("a < b")
        found = _top(found.unionByName(pairs.select(*found.columns)), limit)
    discard(ids, each)
    return found.select("category", "a", "b", "similarity").orderBy(F.desc("similarity"), "a", "b")


def _top(pairs: DataFrame, limit: int) -> DataFrame:
    return saved(pairs.select("category", "a", "b", "similarity").orderBy(F.desc("similarity"), "a", "b").limit(limit), "pairs")


def greedy_merge(claims: DataFrame, threshold: float = THRESHOLD, order: str | list[str] = "id") -> DataFrame:
    """Greedy merging within a category, in order (which tells a category's claims apart).

    A claim joins the first representative it resembles as that stands by then;
    the representative takes the longer statement, the union of tags and
    sections, missing variants and the higher confidence (those of them that the
    claims have).  tags are an array, or a struct of arrays (domain, audience, method),
    each of which is united.  All other columns, such as the source, stay those of its
    first claim.  A null statement counts as empty.
    """
    return greedy.merge(claims, threshold, [order] if isinstance(order, str) else order)


def merged(claims: DataFrame, groups: DataFrame) -> DataFrame:
    """Claims merged by hand (groups: claim_id, primary_id): ordered union of tags, first variant of each name, summed recurrence."""
    rows = claims.join(groups, "claim_id").withColumn("_first", F.when(F.col("claim_id") == F.col("primary_id"), 0).otherwise(1))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_first", "claim_id", c))), lambda x: x[c])
    rows = rows.withColumn("_v", F.map_entries(F.coalesce("variants", F.create_map().cast("map<string,string>"))))
    variants = F.aggregate(F.transform(ordered("_v"), F.map_from_entries), F.create_map().cast("map<string,string>"), lambda a, m: F.map_concat(a, F.map_filter(m, lambda k, v: ~F.coalesce(F.map_contains_key(a, k), F.lit(False)))))
    return rows.groupBy(F.col("primary_id").alias("claim_id")).agg(
        F.array_distinct(F.flatten(ordered("tags"))).alias("tags"), variants.alias("variants"), F.sum("recurrence").alias("recurrence"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set(F.when(F.col("_first") == 1, F.col("claim_id")))).alias("merged_from"),
    )


def suspicious(value: Column) -> Column:
    """A form's label rather than evidence: short, or one of the label patterns."""
    return F.coalesce((F.length(F.trim(value)) < 6) | value.rlike(LABELS), F.lit(True))


def known_project(name: Column, existing: Column) -> Column:
    """Equal to, containing or contained in (both of six letters or more) an existing name, once normalised."""
    key = text.norm_key(name)

    def same(e: Column) -> Column:
        other = text.norm_key(e)
        long = (F.length(key) >= 6) & (F.length(other) >= 6)
        return (other != "") & ((key == other) | (long & (F.contains(other, key) | F.contains(key, other))))

    return (key != "") & F.coalesce(F.exists(existing, same), F.lit(False))


def known_lines(lines: DataFrame, existing: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """lines (key, line) with duplicate: equal or similar to a line of the key's existing text."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    new = lines.withColumns({"_key": named, "_line": text.norm_key(F.col("line"))})
    old = existing.select(named.alias("_key"), F.explode(F.split("existing", "\n")).alias("_line")).withColumn("_line", text.norm_key(F.col("_line"))).where("_line <> ''")
    hit = resemblance.resembling(new.where("_line <> ''"), old, "_key", "_line", threshold).withColumn("duplicate", F.lit(True))
    return new.join(hit, ["_key", "_line"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False))).drop("_key", "_line")


def routed(hints: DataFrame) -> DataFrame:
    """Hints with where they go: project, certificate or ignored."""
    return hints.withColumn("target", F.when(F.col("type").isin(*PROJECT_KINDS), "project").when(F.col("type").isin(*CERTIFICATE_KINDS), "certificate").otherwise("ignored"))


def preview(hints: DataFrame, projects: DataFrame, certificates: DataFrame, key: str = "source_id") -> DataFrame:
    """Routed hints with duplicate, suspicious and selected (neither of them)."""
    r = routed(hints)
    p = r.where("target = 'project'").join(projects.select(key, "names"), key, "left").withColumn("duplicate", known_project(F.col("name"), F.coalesce("names", F.array().cast("array<string>")))).drop("names")
    c = known_lines(r.where("target = 'certificate'").withColumn("line", F.col("name")), certificates, key).drop("line")
    rest = r.where("target = 'ignored'").withColumn("duplicate", F.lit(False))
    out = p.unionByName(c).unionByName(rest).withColumn("suspicious", suspicious(F.col("name")))
    return out.withColumn("selected", (F.col("target") != "ignored") & ~F.col("duplicate") & ~F.col("suspicious"))


def applied(selected: DataFrame, projects: DataFrame, key: str = "source_id", order: str = "id") -> DataFrame:
    """Project names after adding the selected ones in order, each tested against all before it."""
    rows = selected.where("target = 'project'").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "name"))), lambda x: x["name"]).alias("new"))
    start = F.coalesce("names", F.array().cast("array<string>"))
    step = lambda have, n: F.when(known_project(n, have), have).otherwise(F.array_append(have, n))
    return projects.select(key, "names").join(rows, key, "full_outer").select(key, F.aggregate(F.coalesce("new", F.array().cast("array<string>")), start, step).alias("names"))


def append_text(old: Column, new: Column, mode: str) -> Column:
    """Profile text after adding new: append_only, fill_empty (only where old is blank) or overwrite."""
    if mode == "overwrite":
        return new
    joined = F.when(F.coalesce(old, F.lit("")) == "", new).otherwise(F.concat(old, F.lit("\n"), new))
    return F.when(F.trim(F.coalesce(old, F.lit(""))) == "", new).otherwise(old) if mode == "fill_empty" else joined


def numbered(claims: DataFrame, keys: list[str], order: str) -> DataFrame:
    return claims.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def project_item(hint: Column) -> Column:
    """A hint as an item of the project history."""
    trimmed = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return F.struct(trimmed(hint["name"]).alias("name"), trimmed(hint["organization"]).alias("client"), F.lit("").alias("amount"), F.coalesce(hint["year"].cast("string"), F.lit("")).alias("period"), F.lit("").alias("role"))


def listed(claims: DataFrame, category: str | None = None, verified: int | None = None, source_id: int | None = None) -> DataFrame:
    """Claims by optional filters, an edited statement over the original, in report order."""
    if category is not None and category not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    rows = claims
    for column, value in (("category", category), ("user_verified", verified), ("source_id", source_id)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    edited = F.coalesce(F.nullif("user_edited_statement", F.lit("")), F.col("statement"))
    return rows.withColumns({"statement_original": F.col("statement"), "statement": edited}).orderBy("category", F.desc("confidence"), "id")


def verdict_counts(claims: DataFrame) -> DataFrame:
    """Claims of each category: all, pending, approved, hidden."""
    count = lambda v, name: F.count_if(F.col("user_verified") == v).alias(name)
    return claims.groupBy("category").agg(F.count("*").alias("total"), count(0, "pending"), count(1, "approved"), count(2, "hidden"))


def primary_of(a: Column, b: Column) -> Column:
    """Of a pair of structs the one with the higher confidence; the first where equal."""
    return F.when(a["confidence"] >= b["confidence"], a).otherwise(b)
