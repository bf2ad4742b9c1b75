"""Quality rules: a table of thresholds compiled into one Spark projection.

A rule is (name, measure, comparison, bound, least words it applies to).  The
table becomes boolean columns of a single projection over the measures; nothing
leaves the JVM and nothing is shuffled.  Ratios are compared as integer
products, so the engines agree to the last row.

Cases: a null or empty text has zero words, zero of everything, and fails the
base (under ten words); rows that repeat are judged alike; columns other than
the id and the text are not looked at.  Stop words count in any case of letters.
Five-word windows are compared by 64-bit hashes: in a text of m windows an
expected m**2 / 2**65 unequal pairs count as equal (under 1e-5 for 20 million).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it was for on are with as be at this by or from have not "
    "der die das und ist von zu den mit sich des auf für als auch es an werden aus er hat dass sie nach wird bei ein eine nicht im dem "
    "le la les de des et un une du que est dans pour qui sur pas plus par avec en au ce il elle ne se ou "
    "el los las y en es por con para una no lo como más pero sus al se del su"
).split()


@dataclass(frozen=True)
class Rule:
    """left * scale > bound * right fails, if the text has from_words words."""

    name: str
    left: str
    scale: int
    bound: int
    right: str
    from_words: int = 0


# A line that opens with a bullet; one that ends in an ellipsis.
BULLET, CUT = r"^[ \t\x0B\f\r]*[-*\u2022]", r"(?:\.\.\.|\u2026)[ \t\x0B\f\r]*$"
RULES = (
    Rule("symbols", "n_symbols", 100, 20, "n_words"),
    Rule("long_words", "word_chars", 1, 25, "n_words"),
    Rule("short_words", "n_words", 2, 1, "word_chars"),
    Rule("repeated_lines", "n_dup_lines", 100, 50, "n_lines", 10),
    Rule("bullet_lines", "n_bullet_lines", 100, 90, "n_lines", 10),
    Rule("cut_lines", "n_cut_lines", 100, 30, "n_lines", 10),
    Rule("no_stop_words", "n_other_words", 1000, 995, "n_words", 200),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Maximal runs outside 0x20 and 0x09-0x0D."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+"))


def _n(array: Column) -> Column:
    return F.size(array).cast("long")


def repeat_words(words: Column, k: int = 5) -> Column:
    """Words that lie in a window of k words found twice or more in the array."""
    n = F.size(words)
    codes = F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        # Windows in order of their code: those beside an equal one repeat.
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        beside = lambda p: F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.when(i > 0, F.get(p, i - 1)["h"]) == x["h"], F.lit(False)))
        starts = let(placed, lambda p: F.sort_array(F.transform(beside(p), lambda x: x["i"])))
        reach = lambda s: F.transform(s, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(s, i + 1) - x, F.lit(k))))
        return let(starts, lambda s: F.aggregate(reach(s), F.lit(0).cast("long"), lambda a, x: a + x))

    return let(codes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measures(text: Column) -> Column:
    """One struct of all measures of a text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    like = lambda a, pattern: _n(F.filter(a, lambda x: x.rlike(pattern)))
    line_counts = let(lines, lambda a: F.struct(_n(a).alias("n_lines"), (_n(a) - _n(F.array_distinct(a))).alias("n_dup_lines"), like(a, BULLET).alias("n_bullet_lines"), like(a, CUT).alias("n_cut_lines")))
    stop = list(dict.fromkeys(STOP_WORDS))
    others = lambda w: _n(F.filter(w, lambda x: ~F.lower(x).isin(stop)))
    by_words = let(words_of(text), lambda w: F.struct(_n(w).alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words"), others(w).alias("n_other_words")))
    return let(
        F.struct(by_words.alias("w"), line_counts.alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"),
            m["w"]["word_chars"].alias("word_chars"),
            (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
            m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"),
            m["l"]["n_lines"].alias("n_lines"),
            m["w"]["n_other_words"].alias("n_other_words"),
            m["l"]["n_bullet_lines"].alias("n_bullet_lines"),
            m["l"]["n_cut_lines"].alias("n_cut_lines"),
        ),
    )


def compiled(rules: tuple[Rule, ...] = RULES, of: str = "") -> dict[str, Column]:
    """The table as columns over the measures (in the struct of, if named): which rule fails, the base among them."""
    m = lambda name: F.col(f"{of}.{name}" if of else name)
    fails = {f"fails_{r.name}": (m(r.left) * r.scale > m(r.right) * r.bound) & (m("n_words") >= r.from_words) for r in rules}
    return fails | {"base_failed": (m("n_words") < 10) | (m("n_repeat_words") * 100 > m("n_words") * 20)}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, the rules that fail, base_failed and kept of every row."""
    m = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    fails = compiled(rules)
    return m.withColumns(fails).withColumn("kept", ~reduce(Column.__or__, [F.col(name) for name in fails]))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, all columns as they were."""
    m = docs.select("*", measures(F.col(text_col)).alias("__m"))
    return m.where(~reduce(Column.__or__, compiled(rules, "__m").values())).drop("__m")


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')) > 0)"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w, {_LINES} AS l FROM documents),
win AS (SELECT rid, i, w[i:i+4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: NOT list_contains([{_STOP}], lower(x))))::BIGINT AS n_other_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t\\x0B\\f\\r]*[-*\\x{{2022}}]')))::BIGINT AS n_bullet_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(?:\\.\\.\\.|\\x{{2026}})[ \\t\\x0B\\f\\r]*$')))::BIGINT AS n_cut_lines
  FROM d LEFT JOIN cov USING (rid)),
f AS (SELECT *, {", ".join(f"({r.left} * {r.scale} > {r.right} * {r.bound} AND n_words >= {r.from_words}) AS fails_{r.name}" for r in RULES)},
  (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed FROM m)
SELECT *, NOT (base_failed OR {" OR ".join(f"fails_{r.name}" for r in RULES)}) AS kept FROM f
"""
