"""The body of a page: the paragraphs of its densest container.

A page becomes a table of tag events: number, name, open or close, and the text that follows. Where an element ends is the next event
of its name at its level; a container holds the paragraphs that begin between its two events. Everything else, from
skipped regions to scores, is arithmetic on that table. Events are dealt by page once, and all windows keep to that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import decode_entities, trim_all
from ..rules import lexicon as L
from ..session import materialize

TAG = "<[^>]*>"


def attribute(tag, name: str) -> Column:
    """A quoted attribute of a tag, or the empty text."""
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def tag_events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, i, tag, name, opens, text, stop (the event that ends the element), skipped, paragraph (its number, where the text
    belongs to one), linked."""
    clean = F.regexp_replace(html, "(?is)<!--.*?-->", "")
    for name in L.RAW_TAGS:
        clean = F.regexp_replace(clean, rf"(?is)<{name}\b.*?</{name}\s*>", " ")
    cut = pages.select(key, clean.alias("h")).select(
        key, F.arrays_zip(F.regexp_extract_all("h", F.lit(TAG), F.lit(0)).alias("tag"), F.slice(F.split("h", TAG), 2, 1 << 30).alias("text")).alias("e"))
    rows = cut.repartition(key).select(key, F.posexplode("e").alias("i", "e")).select(key, "i", "e.tag", F.coalesce("e.text", F.lit("")).alias("text"))
    rows = rows.withColumn("name", F.lower(F.regexp_extract("tag", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))).withColumn("opens", ~F.startswith("tag", F.lit("</")))

    page, named = Window.partitionBy(key).orderBy("i"), Window.partitionBy(key, "name").orderBy("i")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(named.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("level", opened + F.when(F.col("opens"), 0).otherwise(1))
    rows = rows.withColumn("stop", F.coalesce(F.lead("i").over(Window.partitionBy(key, "name", "level").orderBy("i")), F.lit((1 << 31) - 1)))
    classes = F.split(F.trim(attribute("tag", "class")), r"\s+")
    region = F.col("name").isin(L.STRIP_TAGS) | F.arrays_overlap(classes, F.array(*[F.lit(c) for c in L.STRIP_CLASSES]))
    void = F.col("name").isin(L.VOID_TAGS)
    until = F.max(F.when(F.col("opens") & region & ~void, F.col("stop"))).over(so_far)
    rows = rows.withColumn("skipped", F.coalesce(until > F.col("i"), F.lit(False)))
    starts = F.col("opens") & (F.col("name") == "p")
    ends = (F.col("name") == "p") | F.col("name").isin(L.PARAGRAPH_ENDS)
    edge = F.when(~F.col("skipped"), F.when(starts, True).when(ends, False))
    inside = F.coalesce(F.last(edge, ignorenulls=True).over(so_far), F.lit(False)) & ~F.col("skipped")
    number = F.sum(F.when(edge, 1).otherwise(0)).over(so_far)
    linked = F.coalesce(F.last(F.when(F.col("name") == "a", F.col("opens")), ignorenulls=True).over(so_far), F.lit(False)) & ~F.col("skipped")
    return rows.select(key, "i", "tag", "name", "opens", "text", "stop", "skipped", F.when(inside, number).alias("paragraph"), linked.alias("linked"))


def container_score(length: Column, paragraphs: Column, links: Column, signature: Column) -> Column:
    """Text, and text per paragraph, weighted by what the container calls itself and how much of it is links."""
    density = length / paragraphs
    factors = [(signature.rlike(L.ARTICLE_HINT), 1.35), (signature.rlike(L.NAVIGATION_HINT), 0.25), (density < 60, 0.4), (links > length * 0.4, 0.3)]
    score = length + density * 4
    for holds, factor in factors:
        score = score * F.when(holds, factor).otherwise(1.0)
    return F.when(length >= 200, score).otherwise(0.0)


def page_bodies(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, body, method: ``dom`` from a container, ``body`` from all paragraphs, ``none`` (an empty body). One row per page.

    The best article wins if it scores 200, else the best container of any kind. Paragraphs of 40 characters stay; without a
    container, those of 60, if there are two.
    """
    events = materialize(tag_events(pages, key, html), "events")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "")
    paragraphs = events.filter("paragraph IS NOT NULL").groupBy(key, "paragraph").agg(F.min("i").alias("at"), decode_entities(text).alias("raw"))
    paragraphs = materialize(paragraphs.select(
        key, "at", F.char_length(trim_all("raw")).alias("size"), trim_all(F.regexp_replace("raw", r"\s+", " ")).alias("flat")), "paragraphs")
    boxes = events.filter(F.col("opens") & ~F.col("skipped") & F.col("name").isin(L.CONTAINERS)).select(
        key, F.col("i").alias("start"), "stop", "name", F.lower(F.concat(attribute("tag", "id"), F.lit(" "), attribute("tag", "class"))).alias("signature"))
    links = events.filter(F.col("linked") & (F.col("text") != "")).select(key, "i", F.char_length(decode_entities(F.col("text"))).alias("size"))

    def within(rows: DataFrame, place: str, *aggs: Column) -> DataFrame:
        # A page at a time: both sides lie with their page.
        met = boxes.select(key, "start", "stop").join(rows, key).filter((F.col(place) > F.col("start")) & (F.col(place) < F.col("stop")))
        return met.groupBy(key, "start").agg(*aggs)

    own = within(paragraphs, "at", F.sum("size").alias("length"), F.count("*").alias("n"))
    scored = boxes.join(own, [key, "start"]).join(within(links, "i", F.sum("size").alias("links")), [key, "start"], "left")
    scored = scored.withColumn("score", container_score(F.col("length"), F.col("n"), F.coalesce("links", F.lit(0)), F.col("signature")))
    article = F.max(F.when(F.col("name") == "article", F.col("score"))).over(Window.partitionBy(key))
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.col("name") != "article", "start")
    chosen = scored.filter("score > 0").withColumn("_a", F.coalesce(article, F.lit(0.0))).filter((F.col("_a") < 200) | (F.col("name") == "article"))
    chosen = chosen.withColumn("_r", F.row_number().over(best)).filter("_r = 1 AND score > 200").select(key, "start", "stop")

    def joined(rows: DataFrame) -> DataFrame:
        kept = F.transform(F.array_sort(F.collect_list(F.struct("at", "flat"))), lambda x: x["flat"])
        return rows.groupBy(key).agg(F.array_join(kept, "\n\n").alias("body"), F.count("*").alias("n"))

    dom = joined(paragraphs.join(chosen, key).filter((F.col("at") > F.col("start")) & (F.col("at") < F.col("stop")) & (F.char_length("flat") >= 40)))
    loose = joined(paragraphs.filter(F.char_length("flat") >= 60)).filter("n >= 2")
    out = pages.select(key).distinct().join(dom.select(key, F.col("body").alias("_d")), key, "left").join(loose.select(key, F.col("body").alias("_l")), key, "left")
    return out.select(key, F.coalesce("_d", "_l", F.lit("")).alias("body"),
                      F.when(F.col("_d").isNotNull(), "dom").when(F.col("_l").isNotNull(), "body").otherwise("none").alias("method"))
