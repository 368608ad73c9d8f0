"""Duplicate levels, verdicts, pairs and clusters over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K, dedupe as D
from ..operators.reports import child_counts
from ..operators.similarity import instances, similar_pairs, time_bucket
from ..functions import text as T
from ..rules import lexicon as L
from ..session import load, materialize
from . import sqltext as Q
from .bindings import spread, titled, view, with_views
from .registry import query


def signed(s, d, embeddings=False, only=D.SIGNATURES):
    a = spread(view(s, d, "articles").select("id", "title", "body", "ts", "url"))
    if embeddings:
        # Two articles in a row share a vector, as a story told twice would.
        a = a.withColumn("vec_id", F.expr("id div 2")).join(load(s, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return D.prepare(a, "id", F.col("title"), F.col("body"), F.col("ts"), F.col("url"),
                     F.col("embedding") if embeddings else None, only=only)


from .text_columns import _sql_url  # noqa: E402  (the same URL twin)

_URL = _sql_url(L.TRACKING_DEDUPE, True)
SIG = f"""{Q.tokens('tb', 'articles', "title || ' ' || body")}, {Q.tokens('tt', 'articles', 'title')}, {Q.simhash('sh', 'tb')},
  k AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM tb),
  ch AS (SELECT id, sha256(string_agg(t, ' ' ORDER BY r)) AS h FROM k GROUP BY id),
  tl AS (SELECT id, list(t ORDER BY t) AS toks FROM tt GROUP BY id),
  sig AS MATERIALIZED (SELECT a.id, a.ts, coalesce(tl.toks, []) AS toks, coalesce(ch.h, sha256('')) AS h, coalesce(sh.simhash, '0000000000000000') AS sh,
    CASE WHEN a.url IS NOT NULL THEN {_URL} END AS uk FROM articles a LEFT JOIN tl ON tl.id = a.id LEFT JOIN ch ON ch.id = a.id LEFT JOIN sh ON sh.id = a.id)"""


def _pairs(hours, both=False):
    order = "a.id <> b.id" if both else "(b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id))"
    return f"""p0 AS (SELECT a.id, b.id AS cand, b.ts AS cts, a.uk = b.uk AS su, a.h = b.h AS sc, {Q.hamming('a.sh', 'b.sh')} AS dist,
     CASE WHEN len(a.toks) > 0 AND len(b.toks) > 0 THEN len(list_intersect(a.toks, b.toks)) ELSE 0 END AS c, len(a.toks) AS la, len(b.toks) AS lb
     FROM sig a JOIN sig b ON {order} AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {hours} * 3600000000),
  p AS MATERIALIZED (SELECT *, CASE WHEN la > 0 AND lb > 0 THEN c / (la + lb - c) ELSE 0.0 END AS jac FROM p0)"""


_NEAR = "((dist <= 12 AND jac >= 0.86) OR jac >= 0.95)"
_SCORE = "((1 - dist / 64.0) * 0.6 + jac * 0.4)"


def A(sql):
    return with_views(sql, "articles")


def _key_oracle(cond):
    return A(f"""WITH {SIG}, {_pairs(L.WINDOW_HOURS)} SELECT id, arg_max(cand, (cts, cand)) AS candidate FROM p WHERE {cond} GROUP BY id""")


@query("d1_same_url", _key_oracle("su"))
def d1(s, d):
    return D.same_key(signed(s, d, only=("url_key",)), "url_key", "url", 1.0).select("id", "candidate")


@query("d2_same_content", _key_oracle("sc"))
def d2(s, d):
    return D.same_key(signed(s, d, only=("content_hash",)), "content_hash", "contenido", 0.99).select("id", "candidate")


@query("d3_near_duplicates", A(f"""WITH {SIG}, {_pairs(L.WINDOW_HOURS)}, q AS (SELECT *, {_SCORE} AS sc2, row_number() OVER (PARTITION BY id
    ORDER BY {_SCORE} DESC, cts DESC, cand DESC) AS r FROM p WHERE {_NEAR} AND NOT sc AND NOT coalesce(su, false))
    SELECT id, cand AS candidate, round(sc2, 6) AS similarity, CASE WHEN dist <= 12 THEN 'simhash' ELSE 'titulo' END AS level FROM q WHERE r = 1"""))
def d3(s, d):
    return D.near_duplicates(signed(s, d)).select("id", "candidate", F.round("similarity", 6).alias("similarity"), "level")


def _semantic_oracle(threshold):
    return A(f"""WITH {SIG}, v AS (SELECT sig.*, CAST(e.embedding AS DOUBLE[]) AS e FROM sig JOIN embeddings e ON e.vec_id = sig.id // 2),
    c AS (SELECT a.id, b.id AS cand, b.ts AS cts, round(list_cosine_similarity(a.e, b.e), 9) AS cos FROM v a JOIN v b ON (b.ts < a.ts OR (b.ts = a.ts AND b.id < a.id))
      AND epoch_us(a.ts) - epoch_us(b.ts) <= 72 * 3600000000 WHERE list_cosine_similarity(a.e, b.e) >= {threshold}), {_pairs(L.WINDOW_HOURS)},
    q AS (SELECT c.*, row_number() OVER (PARTITION BY c.id ORDER BY cos DESC, c.cts DESC, c.cand DESC) AS r FROM c JOIN p ON p.id = c.id AND p.cand = c.cand
      WHERE NOT {_NEAR} AND NOT sc AND NOT coalesce(su, false)) SELECT id, cand AS candidate, round(cos, 5) AS similarity FROM q WHERE r = 1""")


@query("d4_semantic_duplicates", _semantic_oracle(L.SEMANTIC_MIN))
def d4(s, d):
    return D.semantic_duplicates(signed(s, d, True)).select("id", "candidate", F.round("similarity", 5).alias("similarity"))


@query("d4_semantic_neighbours", _semantic_oracle(0.3))
def d4_loose(s, d):
    return D.semantic_duplicates(signed(s, d, True), threshold=0.3).select("id", "candidate", F.round("similarity", 5).alias("similarity"))


_VERDICT = f"""q AS (SELECT id, cand, cts, CASE WHEN su THEN 1.0 WHEN sc THEN 0.99 ELSE {_SCORE} END AS sim,
    CASE WHEN su THEN 'url' WHEN sc THEN 'contenido' WHEN dist <= 12 AND jac >= 0.86 THEN 'simhash' ELSE 'titulo' END AS level FROM p WHERE coalesce(su, false) OR sc OR {_NEAR}),
  best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cts DESC, cand DESC) AS r FROM q)"""
# Who is no duplicate leads its own chain; a duplicate belongs to the leader of its candidate.
_LEADERS = """lead(id, leader) AS (SELECT sig.id, sig.id FROM sig WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.id = sig.id)
    UNION ALL SELECT best.id, lead.leader FROM best JOIN lead ON best.cand = lead.id WHERE best.r = 1)"""


@query("d5_verdicts", A(f"""WITH RECURSIVE {SIG}, {_pairs(L.WINDOW_HOURS)}, {_VERDICT}, {_LEADERS} SELECT sig.id, cand IS NOT NULL AS is_duplicate,
    CASE WHEN cand IS NOT NULL THEN leader END AS canonical_id, round(coalesce(sim, 0.0), 3) AS similarity, level
    FROM sig LEFT JOIN best ON best.id = sig.id AND r = 1 JOIN lead ON lead.id = sig.id"""))
def d5(s, d):
    return D.verdicts(signed(s, d), semantic=False)


_COSINE = f"""v AS (SELECT sig.id, CAST(e.embedding AS DOUBLE[]) AS e FROM sig JOIN embeddings e ON e.vec_id = sig.id // 2),
  cs AS (SELECT p.*, round(list_cosine_similarity(x.e, y.e), 9) AS cos FROM p JOIN v x ON x.id = p.id JOIN v y ON y.id = p.cand)"""


@query("d5_four_levels", A(f"""WITH RECURSIVE {SIG}, {_pairs(L.WINDOW_HOURS)}, {_VERDICT.replace('best AS', 'best3 AS')}, {_COSINE},
    q4 AS (SELECT id, cand, cts, sim, level FROM q UNION ALL SELECT id, cand, cts, cos, 'semantico' FROM cs WHERE cos >= {L.SEMANTIC_MIN} AND NOT (coalesce(su, false) OR sc OR {_NEAR})),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cts DESC, cand DESC) AS r FROM q4), {_LEADERS}
    SELECT sig.id, cand IS NOT NULL AS is_duplicate, CASE WHEN cand IS NOT NULL THEN leader END AS canonical_id, round(coalesce(sim, 0.0), 3) AS similarity, level
    FROM sig JOIN v USING (id) LEFT JOIN best ON best.id = sig.id AND r = 1 JOIN lead ON lead.id = sig.id""").replace("FROM sig a JOIN sig b ON (b.ts", "FROM sig a JOIN sig b ON a.id // 2 IN (SELECT vec_id FROM embeddings) AND b.id // 2 IN (SELECT vec_id FROM embeddings) AND (b.ts"))
def d5_four(s, d):
    """Verdicts with the embedding level, of the articles that have a vector."""
    return D.verdicts(signed(s, d, True))


@query("w2_best_candidate", A(f"""WITH {SIG}, {_pairs(L.WINDOW_HOURS)}, {_VERDICT} SELECT level, count(*) AS n FROM best WHERE r = 1 GROUP BY 1"""))
def w2(s, d):
    """Winning level of every article that has a candidate, counted."""
    return D.verdicts(signed(s, d), semantic=False).filter("is_duplicate").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def _sets_oracle(threshold, bucket):
    b = "epoch_us(ts) // (72 * 3600000000)" if bucket else "0"
    near = "abs(a.bucket - b.bucket) <= 1 AND" if bucket else ""
    return A(f"""WITH {Q.tokens('tt', 'articles', 'title')}, tl AS (SELECT id, list(t ORDER BY t) AS toks FROM tt GROUP BY id),
    g AS MATERIALIZED (SELECT toks, {b} AS bucket, min(a.id) AS inst, count(*) AS members FROM articles a JOIN tl ON tl.id = a.id GROUP BY 1, 2)
    SELECT a.inst AS inst_a, b.inst AS inst_b, a.members AS members_a, b.members AS members_b, round(len(list_intersect(a.toks, b.toks)) /
    (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))), 6) AS jaccard FROM g a JOIN g b ON {near} a.inst < b.inst
    WHERE len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) >= {threshold}""")


def _set_pairs(s, d, threshold, bucket):
    a = titled(s, d).select("id", "ts", T.tokenize("title").alias("toks"))
    b = time_bucket(F.col("ts"), L.WINDOW_HOURS) if bucket else None
    pairs = similar_pairs(materialize(instances(a, "id", "toks", b), "sets"), threshold, bucket)
    return pairs.select("inst_a", "inst_b", "members_a", "members_b", F.round("jaccard", 6).alias("jaccard"))


@query("d6_title_pairs", _sets_oracle(0.5, True))
def d6(s, d):
    return _set_pairs(s, d, 0.5, True)


@query("j11_set_similarity_join", _sets_oracle(L.CLEANUP_TITLE, False))
def j11(s, d):
    return _set_pairs(s, d, L.CLEANUP_TITLE, False)


@query("d7_similar_items", A(f"""WITH {SIG}, {_pairs(L.WINDOW_HOURS, True)}, q AS (SELECT id, CASE WHEN sc THEN 0.99 ELSE {_SCORE} END AS sim FROM p)
    SELECT id, count(*) AS n_similar, round(max(sim), 3) AS best FROM q WHERE sim >= 0.8 GROUP BY id"""))
def d7(s, d):
    return D.similar_counts(signed(s, d))


_EDGES = f"""{_pairs(L.CLEANUP_HOURS)}, e0 AS (SELECT id AS x, cand AS y FROM p WHERE sc OR (dist <= 8 AND jac >= 0.6)),
  e AS MATERIALIZED (SELECT x, y FROM e0 UNION SELECT y, x FROM e0), r(id, c) AS (SELECT x, x FROM e UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id),
  cl AS (SELECT id, min(c) AS cluster FROM r GROUP BY id)"""


@query("d9_cleanup_clusters", A(f"WITH RECURSIVE {SIG}, {_EDGES} SELECT id, cluster FROM cl").replace("WITH articles", "WITH RECURSIVE articles").replace("RECURSIVE tb", "tb"))
def d9(s, d):
    return K.components(D.cleanup_links(signed(s, d))).select(F.col("node").alias("id"), "cluster")


@query("d10_archive_plan", A(f"""WITH RECURSIVE {SIG}, {_EDGES}, m AS (SELECT cl.id, cluster, length(a.body) % 3 AS fatalities, length(a.body) % 7 AS injuries,
    a.ts, coalesce(n.n, 0) AS n_sources FROM cl JOIN articles a ON a.id = cl.id LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) n ON n.l_orderkey = cl.id),
    kk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n_sources DESC, ts, id) AS r, count(*) OVER (PARTITION BY cluster) AS size,
    max(fatalities) OVER (PARTITION BY cluster) AS mf, max(injuries) OVER (PARTITION BY cluster) AS mi FROM m)
    SELECT id, cluster, size, CASE WHEN r = 1 THEN 'keep' ELSE 'archive' END AS action, CASE WHEN r = 1 THEN mf ELSE fatalities END AS fatalities,
    CASE WHEN r = 1 THEN mi ELSE injuries END AS injuries FROM kk WHERE size > 1""").replace("WITH articles", "WITH RECURSIVE articles").replace("RECURSIVE tb", "tb"))
def d10(s, d):
    a = view(s, d, "articles").select(
        "id", F.col("ts").alias("created_at"), (F.char_length("body") % 3).alias("fatalities"), (F.char_length("body") % 7).alias("injuries"),
        F.lit(None).cast("long").alias("duplicate_of_id"))
    a = child_counts(a, view(s, d, "sources"), "id", "article_id", "n_sources")
    clusters = K.components(D.cleanup_links(signed(s, d)))
    return K.archive_plan(a.join(clusters, a.id == clusters.node).drop("node"))


_KNOWN = """known AS (SELECT a.id, m.first AS duplicate_of_id FROM articles a JOIN (SELECT title, min(id) AS first FROM articles GROUP BY 1) m
  ON m.title = a.title WHERE m.first <> a.id)"""
_KNOWN_EDGES = _EDGES.replace("e0 AS (", f"{_KNOWN}, e0 AS (SELECT id AS x, duplicate_of_id AS y FROM known UNION ALL ")


def _known(s, d):
    """Articles marked as duplicates of the first one with their title."""
    a = materialize(titled(s, d).select("id", "title"), "titles")
    first = a.groupBy("title").agg(F.min("id").alias("duplicate_of_id"))
    return materialize(a.join(first.hint("merge"), "title").filter("id <> duplicate_of_id").select("id", "duplicate_of_id"), "known")


@query("d9_with_known_duplicates", A(f"WITH RECURSIVE {SIG}, {_KNOWN_EDGES} SELECT id, cluster FROM cl"))
def d9_known(s, d):
    return K.components(D.cleanup_links(signed(s, d), known=_known(s, d))).select(F.col("node").alias("id"), "cluster")


@query("d10_archive_marked", A(f"""WITH RECURSIVE {SIG}, {_KNOWN_EDGES}, m AS (SELECT cl.id, cluster, a.ts, coalesce(n.n, 0) AS n_sources, k.id IS NOT NULL AS marked
    FROM cl JOIN articles a ON a.id = cl.id LEFT JOIN known k ON k.id = cl.id LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) n ON n.l_orderkey = cl.id),
    kk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY marked, n_sources DESC, ts, id) AS r, count(*) OVER (PARTITION BY cluster) AS size FROM m)
    SELECT id, cluster, size, CASE WHEN r = 1 THEN 'keep' ELSE 'archive' END AS action FROM kk WHERE size > 1"""))
def d10_marked(s, d):
    """Canonical rows come before marked duplicates, whatever their sources."""
    known = _known(s, d)
    a = view(s, d, "articles").select("id", F.col("ts").alias("created_at"), F.lit(0).alias("fatalities"), F.lit(0).alias("injuries"))
    a = child_counts(a.join(known, "id", "left"), view(s, d, "sources"), "id", "article_id", "n_sources")
    clusters = K.components(D.cleanup_links(signed(s, d), known=known))
    return K.archive_plan(a.join(clusters, a.id == clusters.node).drop("node")).select("id", "cluster", "size", "action")


@query("j5_window_candidates", A("""SELECT a.id, (SELECT count(*) FROM articles b WHERE b.ts BETWEEN a.ts - INTERVAL 72 HOUR AND a.ts + INTERVAL 72 HOUR) - 1 AS candidates FROM articles a"""))
def j5(s, d):
    return D.window_counts(view(s, d, "articles").select("id", "ts"))


@query("w3_candidate_cap", A("""SELECT id, candidate, rank FROM (SELECT a.id, b.id AS candidate, row_number() OVER (PARTITION BY a.id ORDER BY b.ts DESC, b.id DESC) AS rank
    FROM articles a JOIN articles b ON a.id <> b.id AND b.ts BETWEEN a.ts - INTERVAL 72 HOUR AND a.ts + INTERVAL 72 HOUR) WHERE rank <= 60"""))
def w3(s, d):
    return D.candidate_window(view(s, d, "articles").select("id", "ts"))
