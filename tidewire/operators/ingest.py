"""The ingest of items as one plan: seen, headline, place, scope, date, verification, duplicates, redaction, outcome.

Every gate is a column, and the first that refuses an item gives the reason. Only what passes all of them is compared with
each other for duplicates, so refused items cost no signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import facts as X, quality as K, text as T
from ..rules import lexicon as L
from ..session import materialize, shuffle_width
from .dedupe import prepare, verdicts

#: Reasons in the order of the gates, with the outcome each leads to.
REASONS = {
    "vista": "skipped", "sin-titular": "skipped", "otra-isla": "rejected", "fuera-de-ambito": "rejected", "fecha": "rejected",
    "verificacion": "rejected",
}


def text_scores() -> dict[str, Column]:
    """The checks that read texts and their facts alone, for ``with_shared_facts``."""
    return {
        "_place_score": K.place_check("facts.outside", "facts.municipality")["score"],
        "_consistency_score": K.consistency_check(
            "_title", "_body", "facts.severity", "facts.fatalities", "facts.injuries", "facts.municipality")["score"],
        "_body_score": K.body_check("_body", "_title"),
    }


def verified(df: DataFrame) -> DataFrame:
    """Adds ``verification`` from the check of the date, the ``text_scores``, the relevance and the score of the source."""
    scores = {
        "date": F.col("date_check.score"), "place": F.col("_place_score"), "consistency": F.col("_consistency_score"),
        "body": F.col("_body_score"), "relevance": F.col("relevance"),
    }
    return df.withColumn("_conf", K.confidence(scores)).withColumn("verification", K.verification_status(
        F.col("date_check.reject") | F.col("facts.outside"), "_conf", "source_score"))


def gated(items: DataFrame, seen: DataFrame, as_of: Column, max_age_days: int = L.MAX_AGE_DAYS, least_title: int = 10) -> DataFrame:
    """Items (id, title, body, occurred_at, date_confidence, source_score) with their facts, ``verification`` and ``reason``
    (null where every gate lets them pass). ``seen``: the ids that are stored already."""
    known = seen.select(F.col("id").alias("_seen")).distinct()
    by_text = text_scores() | {"_local": X.scope_gate("_c", "_h")["local"]}
    df = X.with_shared_facts(items.join(known, F.col("id") == F.col("_seen"), "left"), "title", "body", also=by_text)
    df = verified(df.withColumn("date_check", K.date_check("occurred_at", "date_confidence", as_of, max_age_days)))
    refused = {
        "vista": F.col("_seen").isNotNull(), "sin-titular": F.char_length(F.trim(F.coalesce("title", F.lit("")))) < least_title,
        "otra-isla": F.col("facts.outside"), "fuera-de-ambito": ~F.col("_local"), "fecha": F.col("date_check.reject"),
        "verificacion": F.col("verification") == "REJECTED",
    }
    return df.withColumn("reason", F.coalesce(*[F.when(refused[r], F.lit(r)) for r in REASONS])).drop("_seen", "_conf", *by_text)


def outcomes(items: DataFrame, seen: DataFrame, as_of: Column, max_age_days: int = L.MAX_AGE_DAYS, least_title: int = 10,
             hours: int = L.WINDOW_HOURS) -> DataFrame:
    """One row per item: its columns, outcome (skipped, rejected, duplicate, draft), reason, canonical_id, level, clean
    (the body without personal data) and findings. A duplicate belongs to the draft that its chain ends at."""
    df = gated(items, seen, as_of, max_age_days, least_title)
    rows = materialize(df.select(*items.columns, "facts", "verification", "reason"), "gated")
    # Signatures are heavy per row: what passed is dealt evenly, however few files it lies in.
    passed = rows.filter("reason IS NULL").select("id", "title", "body", "occurred_at").repartition(shuffle_width(items.sparkSession))
    found = verdicts(prepare(passed, "id", F.col("title"), F.col("body"), F.col("occurred_at")), hours, semantic=False)
    found = materialize(found.filter("is_duplicate").select("id", "canonical_id", "level"), "duplicates")
    out = rows.join(found, "id", "left")
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    outcome = F.coalesce(F.try_element_at(table, "reason"), F.when(F.col("canonical_id").isNotNull(), "duplicate"), F.lit("draft"))
    safe = F.when(F.col("reason").isNull(), T.redact_pii("body"))
    return out.withColumn("outcome", outcome).withColumn("_safe", safe).withColumn("clean", F.col("_safe.clean")).withColumn(
        "findings", F.coalesce(F.size("_safe.findings"), F.lit(0))).drop("_safe")
