"""Raw pages to articles: linked data and metadata by expression, bodies by ``bodies``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import parse_source_date
from ..functions.text import bind, col, decode_entities, html_to_text, tidy, trim_all, truncate
from ..rules import lexicon as L
from .bodies import attribute, page_bodies


def clean_title(c) -> Column:
    """Longest part of a title split at `` | – — · - ``; the first one on equal length."""
    def longest(flat):
        parts = F.split(flat, r"\s+[|–—·-]\s+")
        best = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.char_length(p) > F.char_length(a), p).otherwise(a))
        return F.when(flat != "", F.trim(best))

    return bind(trim_all(F.regexp_replace(col(c), r"\s+", " ")), longest)


def _meta(html: Column, attr: str, name: str) -> Column:
    """Content of a meta tag, attributes in either order."""
    name = re.escape(name)
    a = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{attr}=[\"']{name}[\"'][^>]*\bcontent=([\"'])(.*?)\1", 2)
    b = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\bcontent=([\"'])([^>]*?)\1[^>]*\b{attr}=[\"']{name}[\"']", 2)
    v = F.trim(F.coalesce(F.when(a != "", a), F.when(b != "", b)))
    return bind(v, lambda t: F.when(t != "", decode_entities(t)))


#: How deep nodes are looked for; a list and a graph are a level each.
DEPTH = 6


def linked_data(html) -> Column:
    """JSON-LD objects of a page, in the order of reading: roots, members of lists and graphs, nested to ``DEPTH``."""
    scripts = F.regexp_extract_all(
        col(html), F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    none = F.expr("cast(array() as array<struct<text: string, depth: int, done: boolean>>)")

    def entry(text, depth, done):
        return F.struct(F.trim(text).alias("text"), depth.alias("depth"), F.lit(done).alias("done"))

    def opened(e):
        text, depth = e["text"], e["depth"]
        is_list = F.startswith(text, F.lit("["))
        members = F.transform(F.from_json(F.when(is_list, text), "array<string>"), lambda m: entry(m, depth + 1, False))
        graph = F.get_json_object(text, "$['@graph']")
        inside = F.when(F.startswith(graph, F.lit("[")), F.array(entry(graph, depth + 1, False)))
        node = F.concat(F.array(entry(text, depth, True)), F.coalesce(inside, none))
        return F.when(e["done"], F.array(e)).when(depth > DEPTH, none).when(is_list, F.coalesce(members, none)).when(
            F.startswith(text, F.lit("{")), node).otherwise(none)

    entries = F.transform(scripts, lambda s: entry(s, F.lit(0), False))
    for _ in range(DEPTH + 1):
        entries = F.flatten(F.transform(entries, opened))
    return F.transform(F.filter(entries, lambda e: e["done"]), lambda e: e["text"])


def article_node(html) -> Column:
    """First node whose type is one of the article types, as JSON text."""
    types = "|".join(L.ARTICLE_TYPES)

    def is_article(node):
        kind = F.coalesce(F.get_json_object(node, "$['@type']"), F.lit(""))
        return kind.rlike(rf"^(?:{types})$|\"(?:{types})\"")

    return F.get(F.filter(linked_data(html), is_article), F.lit(0))


def _field(node: Column, key: str) -> Column:
    """A field of a JSON object with its type."""
    return F.try_variant_get(F.try_parse_json(node), f"$['{key}']", "variant")


def _kind(value: Column) -> Column:
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def _strings(value: Column) -> Column:
    """The texts in a list, in order; other members are passed over."""
    members = F.when(_kind(value) == "ARRAY", value).cast("array<variant>")
    return F.transform(F.filter(members, lambda m: _kind(m) == "STRING"), lambda m: m.cast("string"))


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", value).cast("string")


def _ld(node: Column, *keys: str) -> Column:
    """String value, first string of a list that is not blank, or the name of an object."""
    def shown(value):
        named = F.coalesce(*[_text(F.try_variant_get(value, f"$['{k}']", "variant")) for k in ("name", "@id")])
        v = F.coalesce(_text(value), F.get(F.filter(_strings(value), lambda t: F.trim(t) != ""), F.lit(0)),
                       F.when(_kind(value) == "OBJECT", named))
        return bind(F.trim(v), lambda t: F.when(t != "", t))
    return F.coalesce(*[bind(_field(node, k), shown) for k in keys])


def _ld_body(node: Column) -> Column:
    """Text of the first body field that is long enough; blocks of a list are joined."""
    def long_enough(value):
        blocks = F.array_join(F.filter(_strings(value), lambda t: t != ""), "\n\n")
        return bind(F.coalesce(_text(value), blocks), lambda v: F.when(F.char_length(F.trim(v)) > 80, v))
    return F.coalesce(*[bind(_field(node, k), long_enough) for k in ("articleBody", "text", "description")])


def _images(html: Column) -> tuple[Column, Column, Column]:
    """Address and description of the first large image, and the description of the first image of all."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))

    def wide(tag):
        size = lambda name: F.coalesce(attribute(tag, name).try_cast("double"), F.lit(0.0))
        return (size("width") >= 400) | (size("height") >= 300)

    def some(c):
        return F.when(c != "", c)

    large, first = F.get(F.filter(tags, wide), F.lit(0)), F.get(tags, F.lit(0))
    source = F.coalesce(*[some(attribute(large, n)) for n in ("src", "data-src", "data-lazy-src")])
    return F.when(source.rlike("^(https?:|/)"), source), some(attribute(large, "alt")), some(attribute(first, "alt"))


def extract_articles(pages: DataFrame, html: str = "html", longest: int | None = None, key: str = "page_id") -> DataFrame:
    """Article columns for every page: linked data first, then meta tags, then the document itself.

    Bodies are whole, or cut at ``longest`` characters. Only pages whose linked data has no body are read for one.
    """
    h = F.col(html)
    node = F.col("_ld")
    title_tag = F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)
    description = F.coalesce(_meta(h, "name", "description"), _meta(h, "property", "og:description"))
    published = [F.get_json_object(node, f"$.{k}") for k in ("datePublished", "dateCreated", "uploadDate")]
    published += [_meta(h, a, n) for a, n in L.PUBLISHED_META]
    published.append(F.regexp_extract(h, r"(?is)<time\b[^>]*\bdatetime=[\"']([^\"']+)", 1))
    canonical = F.regexp_extract(h, r"(?is)<link\b[^>]*\brel=[\"']canonical[\"'][^>]*\bhref=[\"']([^\"']+)", 1)
    staged = pages.withColumn("_ld", article_node(html)).withColumn("_ldt", _ld_body(node)).withColumn(
        "_title", decode_entities(title_tag)).withColumn("_image", _ld(node, "image"))
    declared = F.coalesce(
        F.get_json_object(node, "$.image[0].url"), F.get_json_object(node, "$.image.url"),
        F.get_json_object(node, "$.image.@id"), F.when(F.col("_image").rlike("(?i)^https?:"), F.col("_image")),
        _meta(h, "property", "og:image"), _meta(h, "name", "twitter:image"))
    large, large_alt, first_alt = _images(h)
    facts = staged.select(
        *pages.columns, "_ldt",
        F.coalesce(_ld(node, "headline", "name"), _meta(h, "property", "og:title"), clean_title("_title")).alias("title"),
        F.coalesce(_ld(node, "description"), description).alias("summary"), description.alias("excerpt"),
        F.coalesce(declared, large).alias("image_url"),
        F.coalesce(F.when(declared.isNull(), large_alt), first_alt).alias("image_alt"),
        F.coalesce(_ld(node, "articleSection"), _meta(h, "property", "article:section")).alias("section"),
        F.coalesce(_ld(node, "author", "creator"), _meta(h, "name", "author")).alias("author"),
        F.when(canonical != "", canonical).alias("canonical"),
        F.coalesce(*[parse_source_date(p)["date"] for p in published]).alias("published_at"),
        parse_source_date(_meta(h, "property", "article:modified_time"))["date"].alias("modified_at"))
    dom = page_bodies(staged.filter("_ldt IS NULL").select(key, html), key, html).select(key, F.col("body").alias("_dom"), F.col("method").alias("_how"))
    told = F.col("_ldt").isNotNull()
    body = F.when(told, tidy(html_to_text("_ldt"))).otherwise(F.coalesce("_dom", F.lit("")))
    out = facts.join(dom, key, "left").withColumn("_body", body).withColumn("body", truncate("_body", longest) if longest else F.col("_body"))
    out = out.withColumn("method", F.when(told, "jsonld").otherwise(F.coalesce("_how", F.lit("none"))))
    return out.withColumn("suspicious", F.char_length("body") < 200).drop("_ldt", "_dom", "_how", "_body")
