"""URL filter: explicit rules first, else empirical-Bayes host reputation.

A page's outcome is the label with the page's number; it is *bad* if of low
quality or toxic.  Bad counts are shrunk down a hierarchy: all pages, suffix,
registered domain, host.  At each level the posterior mean of the parent is the
mean of a beta prior whose strength (its pseudo-count) is fitted to the level by
moments: the spread of the groups beyond what binomial noise gives.  A page is
blocked if its host is worse than the average page beyond doubt: if at the
``MASS`` quantile of the beta posterior of the host's bad rate the odds of a bad
page are ``ODDS`` times those of all labelled pages.  Where hosts differ by noise only, as in tables
whose labels know nothing of hosts, the fit shrinks all hosts to the average
and none is blocked.  The quantile is read off the posterior's density at
``GRID`` points that span eight deviations to each side of its mean.

Counts are partial aggregates per level, so a host with a third of all pages is
one row per task before any shuffle; only ids and urls are read.  The host table
is made once and written; a host table too big to broadcast is joined by sort and
merge, where adaptive execution splits the pages of a hot host.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is judged as the host ``''``; repeated pages are judged alike and count
once (as do pages of one id and host), of repeated labels the worst counts; a
null id has no outcome; pages or labels may be empty (then every prior is neutral and
nothing is blocked by reputation); ids without a label only receive a verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.quality_rules import let
from quarrykit.storage import saved

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Suffixes of two labels below which sites are registered.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.kr", "or.kr", "go.kr", "com.br", "example.com", "example.net", "example.org")
MASS, ODDS, GRID = 0.05, 4, 256
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict (null: none)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host."""
    last = lambda n: F.substring_index(host, ".", -n)
    wide = last(2).isin(*SUFFIXES)
    return F.when(wide, last(2)).otherwise(last(1)), F.when(wide, last(3)).otherwise(last(2))


def _strength(groups: DataFrame, level: str) -> DataFrame:
    """One row: level and its prior's strength, by moments."""
    t = groups.agg(F.sum("n").alias("t_n"), F.sum("bad").alias("t_bad"), F.sum(F.col("n") * F.col("n")).alias("t_nn"), F.count("*").alias("g"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("t_pp"))
    p = F.try_divide("t_bad", "t_n")
    spread = F.col("t_pp") - p * F.col("t_bad")
    noise = p * (1 - p)
    between = F.try_divide(spread - (F.col("g") - 1) * noise, F.col("t_n") - F.try_divide("t_nn", "t_n"))
    fit = F.when(between > 0, F.least(F.greatest((noise - between) / between, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).otherwise(F.lit(MOST_STRENGTH))
    return t.select(F.lit(level).alias("level"), F.coalesce(fit, F.lit(MOST_STRENGTH)).alias("k"))


def beta_quantile(a: Column, b: Column, mass: float = MASS) -> Column:
    """Below it lies mass of the beta distribution of a and b (0 or 1 where that is a point)."""
    mean = a / (a + b)
    reach = 8 * F.sqrt(mean * (1 - mean) / (a + b + 1))
    # As the angle whose squared sine is the rate, the density has no pole for a, b > 1/2.
    low, high = (F.asin(F.sqrt(x)) for x in (F.greatest(mean - reach, F.lit(0.0)), F.least(mean + reach, F.lit(1.0))))

    def walk(s: Column) -> Column:
        angle = lambda i: s["low"] + s["wide"] * (i + 0.5) / GRID
        logs = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: (2 * s["a"] - 1) * F.log(F.sin(angle(i))) + (2 * s["b"] - 1) * F.log(F.cos(angle(i))))
        weights = let(logs, lambda f: let(F.array_max(f), lambda top: F.transform(f, lambda y: F.exp(y - top))))

        def find(w: Column) -> Column:
            want = F.aggregate(w, F.lit(0.0), lambda t, y: t + y) * mass
            start = F.struct(F.lit(0.0).alias("below"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("at"))
            step = lambda t, y: let(want, lambda k: F.struct((t["below"] + y).alias("below"), (t["i"] + 1).alias("i"), F.coalesce(t["at"], F.when(t["below"] + y >= k, t["i"] + (k - t["below"]) / y)).alias("at")))
            return F.aggregate(w, start, step, lambda t: F.pow(F.sin(s["low"] + s["wide"] * t["at"] / GRID), 2))

        return let(weights, find)

    inner = let(F.struct(a.alias("a"), b.alias("b"), low.alias("low"), (high - low).alias("wide")), walk)
    return F.when(a <= 0, 0.0).when(b <= 0, 1.0).otherwise(inner)


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad, bad_rate (posterior mean), bound (lower) and limit of every host of pages."""
    host, _ = host_and_path(F.col("url"))
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long")
    outcome = labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.alias("bad")).where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host")).distinct()
    suffix, domain = levels(F.col("host"))
    base = hosts.join(outcome, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    base = saved(base.select("*", suffix.alias("suffix"), domain.alias("domain"), F.lit("all").alias("every")), "hosts")

    def total(key: str, *keep: str) -> DataFrame:
        return base.groupBy(key, *keep).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    strengths = reduce(DataFrame.unionByName, [_strength(total(k).where("n > 0"), k) for k in ("suffix", "domain", "host")])
    mean = total("every").select("every", F.coalesce(F.try_divide("bad", "n"), F.lit(0.0)).alias("prior"))

    def shrink(groups: DataFrame, level: str, parents: DataFrame, parent: str) -> DataFrame:
        k = strengths.where(F.col("level") == level).select(F.lit("all").alias("every"), "k")
        return groups.join(parents.withColumnRenamed("post", "prior"), parent).withColumn("every", F.lit("all")).join(F.broadcast(k), "every").withColumn("post", (F.col("bad") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k")))

    by_suffix = shrink(total("suffix", "every"), "suffix", mean, "every").select("suffix", "post")
    by_domain = shrink(total("domain", "suffix"), "domain", by_suffix, "suffix").select("domain", "suffix", "post")
    out = shrink(base.drop("every"), "host", by_domain.drop("suffix"), "domain")
    out = out.join(F.broadcast(mean.select("every", F.round(F.col("prior") * ODDS / (1 + F.col("prior") * (ODDS - 1)), 6).alias("limit"))), "every")
    size = F.col("n") + F.col("k")
    return out.select("host", "n", "bad", F.round("post", 6).alias("bad_rate"), F.round(beta_quantile(F.col("post") * size, (1 - F.col("post")) * size), 6).alias("bound"), "limit")


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bound and limit of every page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"))
    rep = saved(reputation(pages, labels).select("host", "bad_rate", "bound", "limit"), "reputation")
    verdict = F.coalesce(said, F.when(F.col("bound") > F.col("limit"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(rep, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_rate", "bound", "limit")


def _rules_sql(what: int) -> str:
    arms = ""
    for rule in sorted(RULES, key=lambda r: -len(r[0])):
        own, _, rest = rule[0].partition("/")
        arms += f" WHEN (host = '{own}' OR suffix(host, '.{own}')) AND prefix(path, '/{rest}') THEN '{rule[what]}'"
    return f"CASE{arms} END"


def _strength_sql(key: str) -> str:
    return f"""k_{key} AS (SELECT coalesce(CASE WHEN v > 0 THEN least(greatest((p * (1 - p) - v) / v, {LEAST_STRENGTH}), {MOST_STRENGTH}) ELSE {MOST_STRENGTH} END, {MOST_STRENGTH}) AS k FROM (
  SELECT p, (pp - p * tb - (g - 1) * p * (1 - p)) / nullif(tn - nn / nullif(tn, 0), 0) AS v FROM (
  SELECT sum(n)::DOUBLE AS tn, sum(bad)::DOUBLE AS tb, sum(n * n)::DOUBLE AS nn, count(*) AS g, sum(bad * bad / n::DOUBLE) AS pp, sum(bad)::DOUBLE / nullif(sum(n), 0) AS p
  FROM (SELECT {key}, sum(n) AS n, sum(bad) AS bad FROM base GROUP BY {key}) WHERE n > 0)))"""


_SUFFIX_SQL = ", ".join(f"'{s}'" for s in SUFFIXES)
_LAST = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
o AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM (SELECT DISTINCT page_id, host FROM p) JOIN o USING (page_id) GROUP BY host),
base AS (SELECT h.host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, CASE WHEN {_LAST(2)} IN ({_SUFFIX_SQL}) THEN {_LAST(2)} ELSE {_LAST(1)} END AS suffix, CASE WHEN {_LAST(2)} IN ({_SUFFIX_SQL}) THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain
  FROM (SELECT DISTINCT host FROM p) h LEFT JOIN c USING (host)),
{_strength_sql("suffix")}, {_strength_sql("domain")}, {_strength_sql("host")},
m AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0) AS prior FROM base),
s AS (SELECT suffix, (b + k * prior) / (c + k) AS post FROM (SELECT suffix, sum(n) AS c, sum(bad) AS b FROM base GROUP BY suffix), m, k_suffix),
d AS (SELECT domain, (b + k * s.post) / (c + k) AS post FROM (SELECT domain, suffix, sum(n) AS c, sum(bad) AS b FROM base GROUP BY domain, suffix) JOIN s USING (suffix), k_domain),
h AS (SELECT host, n + k AS size, (bad + k * d.post) / (n + k) AS post FROM base JOIN d USING (domain), k_host),
b AS (SELECT host, post, post * size AS a, (1 - post) * size AS b, 8 * sqrt(post * (1 - post) / (size + 1)) AS reach FROM h),
g AS (SELECT *, asin(sqrt(greatest(post - reach, 0))) AS low, asin(sqrt(least(post + reach, 1))) - asin(sqrt(greatest(post - reach, 0))) AS wide, unnest(range(0, {GRID})) AS i FROM b WHERE a > 0 AND b > 0),
y AS (SELECT *, (2 * a - 1) * ln(sin(low + wide * (i + 0.5) / {GRID})) + (2 * b - 1) * ln(cos(low + wide * (i + 0.5) / {GRID})) AS y FROM g),
w AS (SELECT *, exp(y - max(y) OVER (PARTITION BY host)) AS w FROM y),
s2 AS (SELECT *, sum(w) OVER (PARTITION BY host ORDER BY i) AS upto, {MASS} * sum(w) OVER (PARTITION BY host) AS want FROM w),
q AS (SELECT host, arg_min(pow(sin(low + wide * (i + (want - upto + w) / w) / {GRID}), 2), i) AS bound FROM s2 WHERE upto >= want GROUP BY host),
f AS (SELECT host, round(post, 6) AS bad_rate, round(coalesce(bound, CASE WHEN a <= 0 THEN 0 ELSE 1 END), 6) AS bound, round(prior * {ODDS} / (1 + prior * {ODDS - 1}), 6) AS "limit" FROM b LEFT JOIN q USING (host), m)
SELECT page_id, host, path, {_rules_sql(0)} AS rule, coalesce({_rules_sql(1)}, CASE WHEN bound > "limit" THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bound, "limit" FROM p LEFT JOIN f USING (host)
"""
