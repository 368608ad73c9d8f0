"""Changes to the catalog: status batches, merges, upserts, snapshots and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import slugify
from . import ordered
from .reports import top_per_key


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def split_valid(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> tuple[DataFrame, DataFrame]:
    from ..functions.quality import violations
    checked = df.withColumn(out, violations(rules))
    return checked.filter(F.size(out) == 0).drop(out), checked.filter(F.size(out) > 0)


def status_changes(articles: DataFrame, changes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Apply the last requested status per article. Returns the new catalog and the refused requests.

    Publishing a merged or archived article is refused. The publication time is kept once set;
    leaving the published state clears the featured mark.
    """
    last = top_per_key(changes, ["article_id"], [F.col("changed_at").desc(), F.col("change_id").desc()], 1, "_r")
    last = last.select(F.col("article_id").alias("_a"), F.col("new_status").alias("_new"), F.col("editor").alias("_by"))
    joined = articles.join(last, articles.id == F.col("_a"), "left")
    publish = F.col("_new") == "PUBLISHED"
    blocked = publish & (F.col("duplicate_of_id").isNotNull() | (F.col("status") == "ARCHIVED"))
    blocked = F.coalesce(blocked, F.lit(False))
    apply = F.col("_new").isNotNull() & ~blocked
    refused = joined.filter(blocked).select("id", F.col("_new").alias("requested"), F.when(
        F.col("duplicate_of_id").isNotNull(), "fusionada").otherwise("archivada").alias("reason"))
    new = joined.select(
        *[c for c in articles.columns if c not in ("status", "published_at", "is_featured")],
        F.when(apply, F.col("_new")).otherwise(F.col("status")).alias("status"),
        F.when(apply & publish, F.coalesce("published_at", as_of)).otherwise(F.col("published_at")).alias("published_at"),
        F.when(apply & ~publish, F.lit(False)).otherwise(F.col("is_featured")).alias("is_featured"),
        F.when(apply & publish, F.col("_by")).alias("reviewed_by"))
    return new, refused


def single_featured(articles: DataFrame, marks: DataFrame) -> DataFrame:
    """Only the article marked last stays featured."""
    winner = marks.agg(F.max_by("article_id", F.struct("changed_at", "article_id")).alias("_w"))
    return articles.sparkSession.sql(
        "SELECT a.* EXCEPT (is_featured), coalesce(a.id = (SELECT _w FROM {w}), a.is_featured) AS is_featured FROM {a} a",
        a=articles, w=winner)


def snapshots(df: DataFrame, key: str, fields: list[str], note: Column) -> DataFrame:
    """Append-only revision rows: the row as JSON text."""
    return df.select(F.col(key).alias("article_id"), F.to_json(F.struct(*fields)).alias("snapshot"), note.alias("note"))


def union_sources(sources: DataFrame, merges: DataFrame) -> DataFrame:
    """Sources of canonical rows plus those of merged rows whose URL the canonical lacks.

    ``merges``: duplicate_id, canonical_id. Provenance stays in ``merged_from``.
    """
    moved = sources.join(merges, sources.article_id == merges.duplicate_id).select(
        F.col("canonical_id").alias("article_id"), "url", "outlet", F.col("duplicate_id").alias("merged_from"))
    kept = moved.join(sources.select("article_id", "url"), ["article_id", "url"], "left_anti")
    one = kept.groupBy("article_id", "url").agg(F.min_by(F.struct("merged_from", "outlet"), F.struct(
        "merged_from", "outlet")).alias("_s")).select("article_id", "url", "_s.outlet", "_s.merged_from")
    own = sources.select("article_id", "url", "outlet", F.lit(None).cast(
        dict(merges.dtypes)["duplicate_id"]).alias("merged_from"))
    return own.unionByName(one)


def merge_duplicates(articles: DataFrame, merges: DataFrame) -> DataFrame:
    """Canonical rows take the largest figures; duplicates point to them, rejected and not featured."""
    figures = articles.join(merges, articles.id == merges.duplicate_id).groupBy("canonical_id").agg(
        F.max("fatalities").alias("_f"), F.max("injuries").alias("_i"))
    out = articles.join(figures, articles.id == F.col("canonical_id"), "left").drop("canonical_id")
    out = out.join(merges, articles.id == merges.duplicate_id, "left")
    dup = F.col("duplicate_id").isNotNull()
    return out.select(
        *[c for c in articles.columns
          if c not in ("fatalities", "injuries", "status", "is_featured", "duplicate_of_id")],
        F.greatest("fatalities", "_f").alias("fatalities"), F.greatest("injuries", "_i").alias("injuries"),
        F.when(dup, F.lit("REJECTED")).otherwise(F.col("status")).alias("status"),
        F.when(dup, F.lit(False)).otherwise(F.col("is_featured")).alias("is_featured"),
        F.when(dup, F.col("canonical_id")).otherwise(F.col("duplicate_of_id")).alias("duplicate_of_id"))


def upsert_plan(old: DataFrame, new: DataFrame, key: str, compare: list[str], tolerance: float = 0.0005) -> DataFrame:
    """Action per key: insert, update (a value moved beyond the tolerance), keep, or stored only."""
    o = old.select(F.col(key).alias("_ok"), *[F.col(c).alias(f"_o_{c}") for c in compare])
    j = new.join(o, F.col(key) == F.col("_ok"), "full_outer")
    moved = F.lit(False)
    for c in compare:
        moved = moved | (F.abs(F.col(c) - F.col(f"_o_{c}")) > tolerance)
    action = (F.when(F.col("_ok").isNull(), "insert").when(F.col(key).isNull(), "stored_only")
              .when(moved, "update").otherwise("keep"))
    return j.select(F.coalesce(key, "_ok").alias(key), action.alias("action"), *compare)


def rename_keys(stored: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """Stored rows under their new keys, with an action: renamed, kept (the target is there already) or same. Ids stay.

    ``renames``: old_key, new_key, seq. A target that is stored is left alone, and of several rows that want one
    target the first in ``seq`` gets it. What the stored keys are is judged before any rename.
    """
    taken = stored.select(F.col(key).alias("new_key"))
    open_ = renames.join(taken, "new_key", "left_anti").join(stored.select(F.col(key).alias("old_key")), "old_key", "left_semi")
    first = open_.groupBy("new_key").agg(F.min_by("old_key", "seq").alias("old_key"))
    wanted = renames.groupBy("old_key").agg(F.lit(True).alias("_asked"))
    j = stored.join(first, F.col(key) == F.col("old_key"), "left").drop("old_key").join(wanted, F.col(key) == F.col("old_key"), "left").drop("old_key")
    action = F.when(F.col("new_key").isNotNull(), "renamed").when(F.col("_asked"), "kept").otherwise("same")
    return j.select(*[F.coalesce("new_key", key).alias(key) if c == key else F.col(c) for c in stored.columns], action.alias("action"))


def catalog_diff(stored: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared against stored sources: create, reset health when the URL changed, or disable."""
    s = stored.select(F.col("name").alias("_n"), F.col("url").alias("_u"), F.col("enabled").alias("_e"))
    j = declared.join(s, F.col("name") == F.col("_n"), "full_outer")
    action = (
        F.when(F.col("_n").isNull(), "create").when(F.col("name").isNull(), "undeclared")
        .when(F.col("url") != F.col("_u"), F.when(F.col("force_disabled") & F.col("_e"), "reset_and_disable").otherwise("reset"))
        .when(F.col("force_disabled") & F.col("_e"), "disable").otherwise("keep"))
    return j.select(F.coalesce("name", "_n").alias("name"), action.alias("action"))


def unique_slugs(df: DataFrame, title: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """First row of a root keeps it, later ones get -2, -3 ... in order; an empty root is ``accidente``.

    Numbering is a running count, so one root may hold any share of the rows. Numbers that stored slugs of the
    root have are passed over: the j-th row takes the j-th free one, found by a second running count over the
    free numbers below each stored one.
    """
    root = slugify(title)
    rooted = df.withColumn("_root", F.when(root == "", F.lit("accidente")).otherwise(root))
    numbered = ordered.running(rooted, ["_root"], order, {"_n": ("count", F.lit(1))})
    if existing is not None:
        tail = r"-([2-9]|[1-9]\d+)$"
        number = F.regexp_extract("slug", tail, 1).try_cast("long")
        used = existing.select(F.col("slug").alias("_root"), F.lit(1).cast("long").alias("_k")).union(existing.filter(
            number.isNotNull()).select(F.regexp_replace("slug", tail, ""), number)).distinct()
        ranked = ordered.running(used, ["_root"], ["_k"], {"_i": ("count", F.lit(1))})
        stored = ranked.select("_root", (F.col("_k") - F.col("_i")).alias("_n"), F.lit(1).alias("_stored"))
        # At equal places rows come before stored numbers, which only push on what lies behind them.
        line = numbered.withColumn("_stored", F.lit(0)).unionByName(stored, allowMissingColumns=True)
        passed = ordered.running(line, ["_root"], ["_n", "_stored"], {"_past": ("sum", F.col("_stored"))})
        numbered = passed.filter("_stored = 0").withColumn("_n", F.col("_n") + F.col("_past")).drop("_stored", "_past")
    slug = F.when(F.col("_n") == 1, F.col("_root")).otherwise(
        F.concat("_root", F.lit("-"), F.col("_n").cast("string")))
    return numbered.withColumn("slug", slug).drop("_root", "_n")
