"""Feed parsing and page extraction over documents and raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import lexicon as L
from ..session import load
from ..sources import feeds as S, pages as P
from . import sqltext as Q
from .bindings import sql_list, view, with_views
from .catalog_reports import sql_stamp, stamp
from .registry import query


def _esc(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _payloads(s, d):
    """One feed per article: RSS, Atom, RDF or an HTML page by turn."""
    a = view(s, d, "articles")
    title = _esc(F.concat(F.lit("T"), F.regexp_replace("title", r"[^\p{L}\p{N} .,]", "")))
    url = F.concat(F.lit("https://medio.example/a/"), F.col("id").cast("string"), F.lit("/?utm_source=rss"))
    rss = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>'), F.col("outlet"), F.lit("</title><item><title>"), title,
        F.lit("</title><link>"), url, F.lit("</link><description>&lt;p&gt;Resumen&lt;/p&gt; corto</description><category>uno</category><category>dos</category><pubDate>"),
        F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(' GMT</pubDate><enclosure url="https://medio.example/i.jpg" type="image/jpeg"/></item></channel></rss>'))
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>'), title, F.lit('</title><link rel="alternate" href="'), url,
        F.lit('"/><summary>Resumen corto</summary><published>'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published></entry></feed>"))
    html = F.concat(F.lit("<!DOCTYPE html><html><body>"), title, F.lit("</body></html>"))
    k = F.col("id") % 3
    return a.select("id", F.when(k == 0, rss).when(k == 1, atom).otherwise(html).alias("payload"))


@query("s1_feed_items", with_views(r"""SELECT id, 'T' || trim(regexp_replace(regexp_replace(title, '[^\p{L}\p{N} .,]', '', 'g'), '\s+', ' ', 'g')) AS title,
    'https://medio.example/a/' || id AS url, 'Resumen corto' AS summary, CASE id % 3 WHEN 0 THEN 'https://medio.example/i.jpg' END AS image_url,
    CASE id % 3 WHEN 0 THEN 2 ELSE 0 END AS categories, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at FROM articles WHERE id % 3 < 2""", "articles"))
def s1(s, d):
    items, _ = S.parse_feeds(_payloads(s, d), "payload", ["id"])
    return items.select("id", F.regexp_replace("title", "^T ", "T").alias("title"), "url", "summary", "image_url",
                        F.size("categories").alias("categories"), stamp("published_at", "published_at"))


@query("s1_rejected_feeds", with_views("SELECT id, 'HTML en lugar de XML' AS error FROM articles WHERE id % 3 = 2", "articles"))
def s1_bad(s, d):
    return S.parse_feeds(_payloads(s, d), "payload", ["id"])[1]


@query("s2_content_type", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS accepted FROM orders""")
def s2(s, d):
    kind = F.expr("CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'application/RSS+xml' WHEN 2 THEN 'text/html' ELSE 'text/plain; charset=utf-8' END")
    return load(s, d, "orders").select(F.col("o_orderkey").alias("id"), S.looks_like_xml(kind).alias("accepted"))


@query("s3_item_image", with_views("SELECT id, 'https://medio.example/i.jpg' AS image_url FROM articles WHERE id % 3 = 0", "articles"))
def s3(s, d):
    items, _ = S.parse_feeds(_payloads(s, d), "payload", ["id"])
    return items.filter("image_url IS NOT NULL").select("id", "image_url")


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_FLAT = f"trim(regexp_replace({Q.entities(_TITLE)}, '\\s+', ' ', 'g'))"


@query("s6_clean_titles", f"""SELECT page_id, list_reduce(list_prepend('', regexp_split_to_array({_FLAT}, '\\s+[|–—·-]\\s+')), lambda a, p: CASE WHEN length(p) > length(a) THEN p ELSE a END) AS title
    FROM pages WHERE {_FLAT} <> ''""")
def s6(s, d):
    t = P.clean_title(T.decode_entities(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return load(s, d, "pages").select("page_id", t.alias("title")).filter("title IS NOT NULL")


# The tag-event table of ``sources/bodies.py`` in SQL.
_QUOTED = sql_list
_CLEAN = "regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
for _raw in L.RAW_TAGS:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_raw}\\b.*?</{_raw}\\s*>', ' ', 'g')"


def _attr(name):
    return f"regexp_extract(tag, '(?is)\\s{name}\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


_FLAT_RAW = Q.trim_all("regexp_replace(raw, '\\s+', ' ', 'g')")
_SO_FAR = "(PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BODIES = f"""c AS (SELECT page_id, {_CLEAN} AS h FROM pages),
  e0 AS (SELECT page_id, unnest(range(0, len(tags))) AS i, unnest(tags) AS tag, unnest(gaps[2:]) AS text
    FROM (SELECT page_id, regexp_extract_all(h, '<[^>]*>') AS tags, string_split_regex(h, '<[^>]*>') AS gaps FROM c)),
  e1 AS (SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, NOT starts_with(tag, '</') AS opens FROM e0),
  e2 AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, name ORDER BY i) + CASE WHEN opens THEN 0 ELSE 1 END AS level FROM e1),
  e3 AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY page_id, name, level ORDER BY i), 2147483647) AS stop FROM e2),
  e4 AS (SELECT *, coalesce(max(CASE WHEN opens AND name NOT IN ({_QUOTED(L.VOID_TAGS)}) AND (name IN ({_QUOTED(L.STRIP_TAGS)})
    OR list_has_any(string_split_regex(trim({_attr('class')}), '\\s+'), [{_QUOTED(L.STRIP_CLASSES)}])) THEN stop END) OVER {_SO_FAR} > i, false) AS skipped FROM e3),
  e5 AS (SELECT *, CASE WHEN NOT skipped THEN CASE WHEN opens AND name = 'p' THEN true WHEN name = 'p' OR name IN ({_QUOTED(L.PARAGRAPH_ENDS)}) THEN false END END AS edge FROM e4),
  e AS MATERIALIZED (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER {_SO_FAR}, false) AND NOT skipped AS inside, count(*) FILTER (edge) OVER {_SO_FAR} AS pno,
    coalesce(last_value(CASE WHEN name = 'a' THEN opens END IGNORE NULLS) OVER {_SO_FAR}, false) AND NOT skipped AS linked FROM e5),
  p0 AS (SELECT page_id, min(i) AS at0, {Q.entities("string_agg(text, '' ORDER BY i)")} AS raw FROM e WHERE inside GROUP BY page_id, pno),
  p AS MATERIALIZED (SELECT page_id, at0, length({Q.trim_all('raw')}) AS size, {_FLAT_RAW} AS flat FROM p0),
  bx AS (SELECT page_id, i AS start, stop, name, lower({_attr('id')} || ' ' || {_attr('class')}) AS sig FROM e WHERE opens AND NOT skipped AND name IN ({_QUOTED(L.CONTAINERS)})),
  bo AS (SELECT bx.page_id, start, bx.stop, bx.name, sig, sum(size) AS len, count(*) AS n FROM bx JOIN p ON p.page_id = bx.page_id AND at0 > start AND at0 < stop GROUP BY 1, 2, 3, 4, 5),
  bl AS (SELECT bx.page_id, start, sum(length({Q.entities('e.text')})) AS links FROM bx JOIN e ON e.page_id = bx.page_id AND e.linked AND e.i > start AND e.i < bx.stop GROUP BY 1, 2),
  bs AS (SELECT bo.*, CASE WHEN len < 200 THEN 0 ELSE (len + len / n * 4) * CASE WHEN regexp_matches(sig, '{L.ARTICLE_HINT}') THEN 1.35 ELSE 1 END
    * CASE WHEN regexp_matches(sig, '{L.NAVIGATION_HINT}') THEN 0.25 ELSE 1 END * CASE WHEN len / n < 60 THEN 0.4 ELSE 1 END
    * CASE WHEN coalesce(links, 0) > len * 0.4 THEN 0.3 ELSE 1 END END AS score FROM bo LEFT JOIN bl USING (page_id, start)),
  bc AS (SELECT *, coalesce(max(CASE WHEN name = 'article' THEN score END) OVER (PARTITION BY page_id), 0) AS best FROM bs WHERE score > 0),
  ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, name <> 'article', start) AS r FROM bc WHERE best < 200 OR name = 'article') WHERE r = 1 AND score > 200),
  dm AS (SELECT ch.page_id, string_agg(flat, chr(10) || chr(10) ORDER BY at0) AS body FROM ch JOIN p ON p.page_id = ch.page_id AND at0 > start AND at0 < stop AND length(flat) >= 40 GROUP BY 1),
  lo AS (SELECT page_id, string_agg(flat, chr(10) || chr(10) ORDER BY at0) AS body FROM p WHERE length(flat) >= 60 GROUP BY 1 HAVING count(*) >= 2),
  bodies AS (SELECT pages.page_id, coalesce(dm.body, lo.body, '') AS body, CASE WHEN dm.body IS NOT NULL THEN 'dom' WHEN lo.body IS NOT NULL THEN 'body' ELSE 'none' END AS method
    FROM pages LEFT JOIN dm USING (page_id) LEFT JOIN lo USING (page_id))"""


@query("s5_densest_body", f"WITH {_BODIES} SELECT page_id, sha256(body) AS body_hash, method FROM bodies")
def s5(s, d):
    return P.page_bodies(load(s, d, "pages")).select("page_id", T.sha256("body").alias("body_hash"), "method")


# Every other page gets an opening of meta tags and an image; every fourth has its body as linked data.
_EXTRA = """concat(html, CASE WHEN page_id % 2 = 0 THEN concat('<meta name="description" content="Resumen ', page_id, '"><meta property="article:modified_time" content="2024-01-0', 1 + page_id % 9, 'T10:00:00Z"><meta name="author" content="Ana">',
  '<img src="/s.jpg" width="40" alt="poco"><img data-src="https://medio.example/', page_id, '.jpg" width="', 300 + page_id % 3 * 100, '" alt="foto ', page_id, '">') ELSE '' END,
  CASE WHEN page_id % 4 = 1 THEN concat('<script type="application/ld+json">{"@type":"NewsArticle","articleBody":"', repeat(concat('dato ', page_id, ' '), 20), '"}</script>') ELSE '' END)"""


@query("s4_page_articles", f"""WITH {_BODIES}, t AS (SELECT page_id, CASE WHEN {_FLAT} <> '' THEN list_reduce(list_prepend('', regexp_split_to_array({_FLAT}, '\\s+[|–—·-]\\s+')), lambda a, p: CASE WHEN length(p) > length(a) THEN p ELSE a END) END AS title FROM pages)
    SELECT page_id, title, CASE WHEN page_id % 2 = 0 THEN 'Resumen ' || page_id END AS summary, CASE WHEN page_id % 2 = 0 THEN 'Resumen ' || page_id END AS excerpt, CASE WHEN page_id % 2 = 0 THEN 'Ana' END AS author,
    CASE WHEN page_id % 2 = 0 AND page_id % 3 > 0 THEN 'https://medio.example/' || page_id || '.jpg' END AS image_url, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 3 > 0 THEN 'foto ' || page_id ELSE 'poco' END END AS image_alt,
    CASE WHEN page_id % 2 = 0 THEN '2024-01-0' || (1 + page_id % 9) || ' 10:00:00' END AS modified_at,
    CASE WHEN page_id % 4 = 1 THEN 'jsonld' ELSE method END AS method, CASE WHEN page_id % 4 = 1 THEN sha256(trim(repeat('dato ' || page_id || ' ', 20))) ELSE sha256(body) END AS body_hash,
    CASE WHEN page_id % 4 = 1 THEN length(trim(repeat('dato ' || page_id || ' ', 20))) ELSE length(body) END < 200 AS suspicious FROM bodies JOIN t USING (page_id)""")
def s4(s, d):
    e = P.extract_articles(load(s, d, "pages").withColumn("html", F.expr(_EXTRA)))
    return e.select("page_id", "title", "summary", "excerpt", "author", "image_url", "image_alt", stamp("modified_at", "modified_at"), "method",
                    T.sha256("body").alias("body_hash"), "suspicious")


@query("s7_linked_data", """SELECT page_id, 'Titular ' || page_id AS headline, CASE page_id % 4 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Luis' WHEN 2 THEN 'Eva' ELSE 'Marta' END AS author FROM pages""")
def s7(s, d):
    """Article nodes at the root, in a list, in a graph and in lists of graphs, appended to every page."""
    p = load(s, d, "pages")
    node = F.expr("""CASE page_id % 4
      WHEN 0 THEN concat('{"@type":"NewsArticle","headline":"Titular ', page_id, '","author":"Ana"}')
      WHEN 1 THEN concat('[{"@type":"Organization","name":"x"},{"@type":["Thing","Article"],"headline":"Titular ', page_id, '","author":[{"name":"no"},7," ","Luis"]}]')
      WHEN 2 THEN concat('{"@context":"x","@graph":[{"@type":"WebPage"},{"@type":"BlogPosting","headline":"Titular ', page_id, '","author":{"name":"Eva"}}]}')
      ELSE concat('[[{"@graph":[{"@type":"WebPage","headline":"no"},{"@graph":[{"@type":"Article","headline":["Titular ', page_id, '"],"author":{"@id":"Marta"}}]}]}]]') END""")
    html = F.concat("html", F.lit('<script type="application/ld+json">'), node, F.lit("</script>"))
    n = p.select("page_id", P.article_node(html).alias("n"))
    return n.select("page_id", P._ld(F.col("n"), "headline").alias("headline"), P._ld(F.col("n"), "author").alias("author"))


@query("s9_partitioned_sink", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def s9(s, d):
    """Round trip through a partitioned Parquet folder; the partition column prunes the read."""
    from ..session import step_path
    path = step_path(s, "orders")
    S.write_partitioned(load(s, d, "orders").withColumn("status", F.col("o_orderstatus")), path, ["status"])
    return s.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("s9_row_formats", "SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def s9_formats(s, d):
    """CSV and JSON round trip with explicit schemas."""
    from ..session import step_path
    base = step_path(s, "customer")
    c = load(s, d, "customer")
    c.write.option("header", True).csv(f"{base}/csv")
    s.read.schema(c.schema).option("header", True).csv(f"{base}/csv").write.json(f"{base}/json")
    return s.read.schema(c.schema).json(f"{base}/json").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_nationkey").alias("keys"))
