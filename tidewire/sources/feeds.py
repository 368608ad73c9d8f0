"""Feed payloads to items, feed image choice, content-type gate, backfill and syndication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, trim_all
from ..functions.dates import parse_source_date
from ..functions.urls import canonicalize_url
from ..operators.reports import is_public, newest, top_per_key
from ..rules import lexicon as L

_TEXT = "struct<_VALUE:string,_href:string>"
_MEDIA = "array<struct<_url:string,_type:string,_medium:string,_VALUE:string>>"
ITEM = (
    "struct<title:struct<_VALUE:string>,link:array<struct<_VALUE:string,_href:string,_rel:string>>,"
    "description:struct<_VALUE:string>,summary:struct<_VALUE:string>,content:struct<_VALUE:string>,"
    "`content:encoded`:struct<_VALUE:string>,pubDate:string,published:string,updated:string,`dc:date`:string,"
    "author:struct<_VALUE:string,name:string>,`dc:creator`:string,category:array<struct<_VALUE:string>>,"
    f"guid:struct<_VALUE:string>,id:string,enclosure:{_MEDIA},`media:content`:{_MEDIA},`media:thumbnail`:{_MEDIA},"
    "`itunes:image`:struct<_href:string,_VALUE:string>,image:struct<url:string>>"
)
_ROOTS = {
    "rss": f"struct<channel:struct<title:struct<_VALUE:string>,item:array<{ITEM}>>>",
    "feed": f"struct<title:struct<_VALUE:string>,entry:array<{ITEM}>>",
    "rdf": f"struct<item:array<{ITEM}>>",
}


def looks_like_xml(content_type) -> Column:
    """A missing content type passes; the parser decides."""
    c = col(content_type)
    return c.isNull() | (c == "") | F.lower(c).rlike("xml|rss|atom|text/plain")


def _bare(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def strip_html(c) -> Column:
    """Feed-side markup removal: tags, six entities, single blanks."""
    c = F.regexp_replace(col(c), "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return trim_all(F.regexp_replace(c, r"\s+", " "))


def pick_image(item: Column) -> Column:
    """Enclosure, media content, media thumbnail, iTunes image, nested image: first usable address."""
    def first(arr, ok):
        return F.get(F.filter(arr, ok), F.lit(0))["_url"]

    def media(m):
        kind = F.coalesce(m["_medium"], m["_type"], F.lit(""))
        return m["_url"].isNotNull() & (F.startswith(kind, F.lit("image")) | (kind == ""))

    enclosure = first(item["enclosure"], lambda e: e["_url"].isNotNull() & (
        F.startswith(F.coalesce(e["_type"], F.lit("")), F.lit("image/")) | (F.coalesce(e["_type"], F.lit("")) == "")))
    return F.coalesce(
        enclosure, first(item.getField("media:content"), media), first(item.getField("media:thumbnail"), media),
        item.getField("itunes:image")["_href"], _bare(item["image"]["url"]))


def parse_feeds(df: DataFrame, payload: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Items and rejected payloads. Roots: rss, then feed, then RDF."""
    head = F.lower(F.ltrim(F.substring(payload, 1, 300)))
    html = head.rlike(r"^(<!doctype html|<html)")
    body = F.regexp_replace(F.col(payload), r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*", "")
    root = F.lower(F.regexp_replace(F.regexp_extract(body, r"^<([A-Za-z:]+)", 1), "^.*:", ""))
    staged = df.select(*keep, body.alias("_x"), F.when(html, F.lit("html")).otherwise(root).alias("_root"))
    bad = staged.filter(~F.col("_root").isin(*_ROOTS)).select(*keep, F.when(
        F.col("_root") == "html", "HTML en lugar de XML").otherwise("no es RSS ni Atom").alias("error"))
    parts = []
    for name, path in (("rss", "_d.channel.item"), ("feed", "_d.entry"), ("rdf", "_d.item")):
        docs = staged.filter(F.col("_root") == name).withColumn(
            "_d", F.from_xml("_x", _ROOTS[name], {"mode": "PERMISSIVE"}))
        parts.append(docs.select(*keep, F.explode(path).alias("_i")))
    items = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return items.select(*keep, *_fields(F.col("_i"))).filter("url IS NOT NULL AND title IS NOT NULL"), bad


def _fields(i: Column) -> list[Column]:
    link_text = F.get(F.filter(i["link"], lambda l: _bare(l["_VALUE"]).isNotNull()), F.lit(0))["_VALUE"]
    link_href = F.get(F.filter(i["link"], lambda l: l["_href"].isNotNull() & (
        F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")), F.lit(0))["_href"]
    url = F.coalesce(_bare(link_text), _bare(link_href))
    summary = F.coalesce(*[_bare(i.getField(f)["_VALUE"]) for f in ("description", "summary", "content", "content:encoded")],
                         F.lit(""))
    date = F.coalesce(*[_bare(i.getField(f)) for f in ("pubDate", "published", "updated", "dc:date")])
    categories = F.filter(F.transform(F.coalesce(i["category"], F.array()), lambda c: _bare(c["_VALUE"])),
                          lambda c: c.isNotNull())
    return [
        strip_html(_bare(i["title"]["_VALUE"])).alias("title"), canonicalize_url(url).alias("url"),
        parse_source_date(date)["date"].alias("published_at"), strip_html(summary).alias("summary"),
        F.coalesce(_bare(i["author"]["_VALUE"]), _bare(i["author"]["name"]), _bare(i.getField("dc:creator"))).alias("author"),
        pick_image(i).alias("image_url"), categories.alias("categories"),
        F.coalesce(_bare(i["guid"]["_VALUE"]), _bare(i["id"])).alias("guid"),
    ]


def newest_per_source(items: DataFrame, cap: int = L.FEED_CAP, source: str = "source",
                      ts: str = "published_at", key: str = "id") -> DataFrame:
    """Newest items per source, dated first; undated ones rank as the epoch."""
    when = F.coalesce(F.col(ts), F.lit("1970-01-01").cast("timestamp"))
    return top_per_key(items, [source], [when.desc(), F.col(key)], cap)


def backfill(items: DataFrame, start, end, caps: DataFrame, default_cap: int, source: str = "source",
             ts: str = "published_at", key: str = "id") -> DataFrame:
    """Items of [start, end] limited per source by a cap table, newest first.

    The largest cap limits each source before the shuffle; the exact cap applies after.
    """
    inside = items.filter(F.col(ts).between(start, end))
    top = max(default_cap, caps.agg(F.max("cap")).first()[0] or 0)
    ranked = top_per_key(inside, [source], [F.col(ts).desc(), F.col(key)], top)
    limits = caps.select(F.col("source").alias("_s"), "cap")
    return ranked.join(limits, F.col(source) == F.col("_s"), "left").filter(
        F.col("rank") <= F.coalesce("cap", F.lit(default_cap))).drop("_s", "cap")


def syndication(articles: DataFrame, sources: DataFrame, images: DataFrame, limit: int = 50) -> DataFrame:
    """The newest published articles with up to three sources and one hero image. Duplicates stay in.

    The article list is cut first, so children are read only for its rows.
    """
    top = newest(articles.filter(is_public(False)), limit, by="published_at")
    ids = top.select(F.col("id").alias("article_id"))
    mine = sources.join(ids, "article_id", "left_semi")
    s = top_per_key(mine, ["article_id"], [F.col("url")], 3, "_r").groupBy("article_id").agg(
        F.sort_array(F.collect_list("url")).alias("source_urls"))
    h = top_per_key(images.join(ids, "article_id", "left_semi"), ["article_id"], [F.col("image_url")], 1, "_r").select(
        "article_id", "image_url")
    out = top.join(s, top.id == s.article_id, "left").drop("article_id")
    return out.join(h, out.id == h.article_id, "left").select(
        "id", "title", F.coalesce("excerpt", "summary").alias("description"),
        F.coalesce("published_at", "created_at").alias("date"), "source_urls", "image_url")


def escape_xml(c) -> Column:
    c = col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def feed_item(site: str, outlet: str = "Redaccion") -> Column:
    """One RSS 2.0 item of a ``syndication`` row that also has a slug."""
    url = escape_xml(F.concat(F.lit(f"{site}/noticias/"), F.col("slug")))
    image = F.when(F.col("image_url").rlike("^https?:"), F.col("image_url")).otherwise(F.concat(F.lit(site), F.col("image_url")))
    source = escape_xml(F.coalesce(F.get("source_urls", F.lit(0)), F.lit(site)))
    return F.concat(
        F.lit("    <item>\n      <title>"), escape_xml("title"), F.lit("</title>\n      <link>"), url, F.lit('</link>\n      <guid isPermaLink="true">'), url,
        F.lit("</guid>\n      <pubDate>"), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>\n      <description>"),
        escape_xml(F.coalesce("description", F.lit(""))), F.lit("</description>"),
        F.coalesce(F.concat(F.lit('\n      <enclosure url="'), escape_xml(image), F.lit('" type="image/webp" length="0"/>')), F.lit("")),
        F.lit('\n      <source url="'), source, F.lit(f'">{outlet}</source>\n    </item>'))


def write_feed(rows: DataFrame, path: str, site: str, title: str) -> None:
    """The feed as one text file, newest first. The list is the cut of ``syndication``, so one task writes it."""
    spark = rows.sparkSession
    items = rows.select(F.lit(1).alias("_part"), F.col("date").alias("_date"), F.col("id").alias("_id"), feed_item(site).alias("value"))
    ends = spark.createDataFrame([
        (0, f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n  <channel>\n    <title>{title}</title>\n    <link>{site}</link>'),
        (2, "  </channel>\n</rss>")], "_part int, value string")
    whole = items.unionByName(ends, allowMissingColumns=True).coalesce(1)
    whole.sortWithinPartitions("_part", F.desc("_date"), "_id").select("value").write.mode("errorifexists").text(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """Clustered by the partition columns plus a salt, so that one hot value writes many files."""
    df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(32))).repartition(*by, "_salt").drop(
        "_salt").write.mode("errorifexists").format(fmt).partitionBy(*by).save(path)
