"""Queries of pages: selectors of configured sites, files by layout, and pages as markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.functions import markup, text
from quarrykit.operators import attached
from quarrykit.plans.registry import Registry, table
from quarrykit.sources import sites

REGISTRY = query = Registry()

_DECODE = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _host_sites(spark, sf_dir):
    """A site for each host: its navigation as the list, without dates."""
    host = text.host_of(F.col("url"))
    own = table(spark, sf_dir, "pages").groupBy(host.alias("source_key")).agg(F.min("url").alias("list_url"))
    named = own.where("source_key <> ''").withColumns({"name": F.col("source_key"), "list_selector": F.lit("body > nav li"), "title_selector": F.lit("a[href]:first-child"), "date_selector": F.lit("span.date"), "skip_no_date": F.lit(False)})
    return sites.with_defaults(named)


@query(rf"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(html, '<body><nav>(.*?)</nav>', 1) AS nav FROM pages),
base AS (SELECT host, min(url) AS u FROM p WHERE host <> '' GROUP BY host), l AS (SELECT page_id, host, unnest(range(len(x))) AS n, unnest(x) AS li FROM (SELECT page_id, host, regexp_extract_all(nav, '<li>.*?</li>') AS x FROM p)),
r AS (SELECT page_id, n, host, trim({_DECODE.format("regexp_extract(li, '<a href=\"[^\"]*\">(.*?)</a>', 1)")}) AS title, regexp_extract(u, '^[a-z]+://[^/?#]*') || {_DECODE.format("regexp_extract(li, '<a href=\"([^\"]*)\"', 1)")} AS url FROM l JOIN base USING (host)),
ends AS (SELECT host, min(page_id) AS stop FROM p WHERE nav IS NULL OR nav = '' GROUP BY host)
SELECT host AS source_key, 'SCR-' || host || '-' || md5(title || url)[1:10] AS bid_no, min(page_id)::BIGINT AS page, title, url
FROM r LEFT JOIN ends USING (host) WHERE title <> '' AND (stop IS NULL OR page_id < stop) GROUP BY host, title, url""")
def q_scraped_links(spark, sf_dir):
    """All pages as landed list pages of their hosts, read by selectors."""
    pages = table(spark, sf_dir, "pages").select(text.host_of(F.col("url")).alias("source_key"), F.col("page_id").alias("page"), "html")
    return sites.scraped(pages, _host_sites(spark, sf_dir), F.lit("2026-04-01")).select("source_key", "bid_no", "page", "title", "url")


@query(r"""WITH p AS (SELECT page_id, unnest(string_split(regexp_extract(html, '<body>(.*)', 1, 's'), '<p>')[2:]) AS x, unnest(range(len(string_split(regexp_extract(html, '<body>(.*)', 1, 's'), '<p>')) - 1)) AS n FROM pages),
c AS (SELECT page_id, n, regexp_replace(x, '(?s)(</p>|</body>|</article>|</section>|<(/?)(ul|ol|li|div|h[1-6]|section|footer|aside|nav|form|table|blockquote|hr|article|header)\b).*$', '') AS x FROM p),
t AS (SELECT page_id, n, array_to_string(list_filter(list_transform(string_split(regexp_replace(x, '<[^>]*>', chr(1), 'g'), chr(1)), lambda s: trim(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> ''), ' ') AS x FROM c)
SELECT page_id, md5(coalesce(string_agg(x, chr(10) || chr(10) ORDER BY n) FILTER (WHERE x <> ''), '')) AS digest FROM pages LEFT JOIN t USING (page_id) GROUP BY page_id""")
def q_page_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(markup.xhtml_to_markdown(F.col("html")).cast("binary")).alias("digest"))


_NAV = attached.Layout("a[href]", (attached.Name("own"),), "body > nav li")


@query(rf"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<body><nav>(.*?)</nav>', 1) AS nav FROM pages), l AS (SELECT page_id, url, unnest(range(len(x))) AS n, unnest(x) AS li FROM (SELECT page_id, url, regexp_extract_all(nav, '<li>.*?</li>') AS x FROM p)),
r AS (SELECT page_id, n, trim({_DECODE.format("regexp_extract(li, '<a href=\"[^\"]*\">(.*?)</a>', 1)")}) AS name, regexp_extract(url, '^[a-z]+://[^/?#]*') || {_DECODE.format("regexp_extract(li, '<a href=\"([^\"]*)\"', 1)")} AS link FROM l WHERE contains(li, '<a href="'))
SELECT page_id, arg_min(name, n) AS name, link FROM r GROUP BY page_id, link""")
def q_layout_links(spark, sf_dir):
    """Links of all pages by a layout: one link in each entry of the navigation, named by its own text."""
    return attached.by_layout(table(spark, sf_dir, "pages"), F.lit("nav"), {"nav": _NAV})


@query("""WITH f AS (SELECT l_orderkey AS notice_id, l_suppkey % 3 AS n, l_linenumber AS line, l_returnflag <> 'A' AS inside, regexp_matches('part ' || l_partkey, 'part 1|part 7') AS pri FROM lineitem),
w AS (SELECT *, bool_or(pri AND NOT inside) OVER k AS loose_pri, bool_or(NOT inside) OVER k AS loose, bool_or(pri) OVER (PARTITION BY notice_id, n, inside) AS any_pri, min(CASE WHEN inside THEN n END) OVER k AS first FROM f WINDOW k AS (PARTITION BY notice_id))
SELECT notice_id, n, line FROM w WHERE CASE WHEN inside THEN pri OR (NOT any_pri AND NOT loose AND n = first) ELSE pri OR NOT loose_pri END""")
def q_files_worth_reading(spark, sf_dir):
    """Lines of orders as the files of notices, loose or in one of three archives."""
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notice_id"), (F.col("l_suppkey") % 3).alias("n"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") != "A").alias("in_archive"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("name"))
    return attached.worth_reading(files, attached.is_priority(F.col("name"), ["part 1", "part 7"])).select("notice_id", "n", "line")
