"""The whole ingest over wire items, and its outcomes per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ingest as I
from ..rules import lexicon as L
from ..session import load
from . import sqltext as Q
from .bindings import with_views
from .duplicates import _LEADERS, _VERDICT, SIG, _pairs
from .fact_columns import _CONFID, _DATE_REJ, _IN_SCOPE, _SRC, _TS, NORMED, wire_items
from .registry import query

#: Items below this headline length are no news here, so that the gate refuses some.
LEAST_TITLE, MAX_AGE = 25, 365

# Items whose order has a seventh line count as stored already.
_SEEN = "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 7"
_CLEAN, _HITS = Q.redacted("body")
_INGEST = f"""{NORMED}, gt AS (SELECT *, CASE WHEN id IN ({_SEEN}) THEN 'vista' WHEN length(trim(title)) < {LEAST_TITLE} THEN 'sin-titular' WHEN outside THEN 'otra-isla'
    WHEN NOT {_IN_SCOPE} THEN 'fuera-de-ambito' WHEN {_DATE_REJ} THEN 'fecha' END AS why, {_CLEAN} AS clean, {' + '.join(f'len({h})' for _, h in _HITS)} AS hits,
    CASE WHEN {_DATE_REJ} OR outside THEN 'REJECTED' WHEN {_CONFID} >= 0.8 AND {_SRC} >= 0.5 THEN 'VERIFIED' WHEN {_CONFID} < 0.55 THEN 'SUSPICIOUS' ELSE 'PENDING_REVIEW' END AS verification FROM f),
  articles AS MATERIALIZED (SELECT id, title, body, occurred_at AS ts, CAST(NULL AS VARCHAR) AS url FROM gt WHERE why IS NULL), {SIG}, {_pairs(L.WINDOW_HOURS)}, {_VERDICT}, {_LEADERS},
  oc AS (SELECT gt.id, gt.source, CASE WHEN why IN ('vista', 'sin-titular') THEN 'skipped' WHEN why IS NOT NULL THEN 'rejected' WHEN cand IS NOT NULL THEN 'duplicate' ELSE 'draft' END AS outcome,
    why AS reason, CASE WHEN cand IS NOT NULL THEN leader END AS canonical_id, level, verification, CASE WHEN why IS NULL THEN sha256(clean) END AS clean, CASE WHEN why IS NULL THEN hits ELSE 0 END AS findings
    FROM gt LEFT JOIN best ON best.id = gt.id AND best.r = 1 LEFT JOIN lead ON lead.id = gt.id)"""


def ingested(s, d):
    items, as_of = wire_items(s, d)
    seen = load(s, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("id"))
    return I.outcomes(items, seen, as_of, MAX_AGE, LEAST_TITLE)


@query("q13_ingest_outcomes", with_views(f"WITH RECURSIVE {_INGEST} SELECT id, outcome, reason, canonical_id, level, verification, clean, findings FROM oc", "wire"))
def ingest_outcomes(s, d):
    """Every item with what became of it and why."""
    return ingested(s, d).select("id", "outcome", "reason", "canonical_id", "level", "verification", T.sha256("clean").alias("clean"), "findings")


@query("q13_outcome_split", with_views(f"""WITH RECURSIVE {_INGEST} SELECT source, count(*) FILTER (outcome = 'draft') AS draft, count(*) FILTER (outcome = 'duplicate') AS duplicate,
    count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'skipped') AS skipped FROM oc GROUP BY 1""", "wire"))
def q13(s, d):
    counts = ingested(s, d).groupBy("source")
    return counts.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("draft", "duplicate", "rejected", "skipped")])
