"""Duplicate search in four levels, verdicts, reports and clean-up clusters.

Articles: id (long), title_tokens, ts (timestamp), content_hash, simhash (16 hex), url_key
(normalised URL or null), embedding (array or null). A candidate of an article is any article
before it in (ts, id) order at most ``hours`` earlier; ties go to the newest candidate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..rules import lexicon as L
from ..session import materialize, small_batches
from . import blocks, ordered
from .similarity import instances, similar_pairs, time_bucket

MICROS = 3_600_000_000


SIGNATURES = ("title_tokens", "content_hash", "simhash", "url_key", "embedding")


def prepare(df: DataFrame, id_col: str, title: Column, body: Column, ts: Column,
            url: Column | None = None, embedding: Column | None = None, first_tokens: int | None = None,
            only: tuple[str, ...] = SIGNATURES) -> DataFrame:
    """Compute every signature once and store it: several levels read the result. ``only`` names those that are asked for.

    The content hash covers all tokens of a text, or the ``first_tokens``.
    """
    staged = df.select(
        F.col(id_col).cast("long").alias("id"), title.alias("_title"), body.alias("_body"), ts.alias("ts"),
        (F.lit(None).cast("string") if url is None else url).alias("_url"),
        (F.lit(None).cast("array<float>") if embedding is None else embedding).alias("embedding"))
    tokens = staged.withColumn("title_tokens", T.tokenize("_title")).withColumn(
        "_tokens", T.tokenize(F.concat_ws(" ", "_title", "_body")))
    from ..functions.urls import normalize_url
    # Distinct tokens of "title title body" equal those of "title body".
    made = {"title_tokens": F.col("title_tokens"), "content_hash": T.hash_tokens("_tokens", first_tokens), "simhash": T.simhash_tokens("_tokens"),
            "url_key": normalize_url("_url"), "embedding": F.col("embedding")}
    with small_batches(df.sparkSession):
        return materialize(tokens.select("id", "ts", *[made[n].alias(n) for n in SIGNATURES if n in only]), "signatures")


# --- levels 1 and 2: equal keys ----------------------------------------------------------

def same_key(articles: DataFrame, key: str, level: str, similarity: float, hours: int = L.WINDOW_HOURS) -> DataFrame:
    """Newest earlier article with an equal key. Only the previous row of a key matters,
    so a key shared by any number of articles stays linear and spreads over tasks."""
    rows = articles.filter(F.col(key).isNotNull()).select("id", "ts", key)
    prev = ordered.look_back(rows, [key], ["ts", "id"], 1, lambda w: {
        "_prev": F.lag(F.struct("ts", "id")).over(w)})
    close = F.unix_micros("ts") - F.unix_micros("_prev.ts") <= hours * MICROS
    return prev.filter(close).select(
        "id", F.col("_prev.id").alias("candidate"), F.lit(similarity).alias("similarity"), F.lit(level).alias("level"))


# --- level 3: SimHash and title -------------------------------------------------------------

def _title_groups(articles: DataFrame, threshold: float, hours: int, content: bool = False) -> tuple[DataFrame, DataFrame]:
    """Articles tagged with their title instance, and the instance pairs worth comparing.

    ``content`` adds instance pairs that share a content hash although their titles differ more.
    """
    bucketed = articles.withColumn("bucket", time_bucket(F.col("ts"), hours)).withColumn(
        "toks", F.array_sort("title_tokens"))
    sets = materialize(instances(bucketed, "id", "title_tokens", F.col("bucket")), "title_sets")
    cross = similar_pairs(sets, threshold).select(
        F.col("inst_a").alias("group_a"), F.col("inst_b").alias("group_b"), "jaccard")
    own = sets.filter("members > 1").select(
        F.col("inst").alias("group_a"), F.col("inst").alias("group_b"), F.lit(1.0).alias("jaccard"))
    pairs = cross.unionByName(own)
    tagged = bucketed.join(sets.select("toks", "bucket", "inst").hint("merge"), ["toks", "bucket"])
    if content:
        # Without title tokens only the content can be equal: one instance per content and bucket.
        bare = bucketed.filter(F.size("title_tokens") == 0).withColumn("inst", F.xxhash64(F.lit("no title"), "content_hash", "bucket"))
        tagged = tagged.unionByName(bare.select(tagged.columns))
        several = bare.groupBy("inst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        pairs = pairs.unionByName(several.select(
            F.col("inst").alias("group_a"), F.col("inst").alias("group_b"), F.lit(0.0).alias("jaccard")))
        held = materialize(tagged.select("content_hash", "inst", "bucket", "toks").distinct(), "content_sets")
        # A content in many buckets meets its neighbours only, and tokens meet the pairs of different sets.
        near = F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket")
        title = F.when(F.size("toks") > 0, F.xxhash64("toks"))  # equal ones are compared above
        some = held.select("content_hash", "bucket", F.col("inst").alias("group_a"), title.alias("_ha"))
        other = held.select("content_hash", near, F.col("inst").alias("group_b"), title.alias("_hb"))
        linked = some.join(other.hint("merge"), ["content_hash", "bucket"]).filter(
            (F.col("group_a") < F.col("group_b")) & ~F.coalesce(F.col("_ha") == F.col("_hb"), F.lit(False)))
        linked = linked.select("group_a", "group_b").distinct()
        for x in "ab":
            linked = linked.join(held.select(F.col("inst").alias(f"group_{x}"), F.col("toks").alias(f"_t{x}")).distinct().hint("merge"), f"group_{x}")
        linked = linked.withColumn("jaccard", F.coalesce(T.jaccard("_ta", "_tb"), F.lit(0.0))).filter(F.col("jaccard") < threshold - 1e-12)
        pairs = pairs.unionByName(linked.select("group_a", "group_b", "jaccard"))
    pairs = materialize(pairs, "title_pairs")
    needed = pairs.select(F.col("group_a").alias("inst")).union(pairs.select(F.col("group_b"))).distinct()
    return tagged.join(needed.hint("merge"), "inst", "left_semi"), pairs


def _code(c: str) -> Column:
    """16 hex digits as one long, bit by bit."""
    high, low = (F.conv(F.substring(c, s, 8), 16, 10).cast("long") for s in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _packed(rows: DataFrame, group: str, *more: Column) -> DataFrame:
    """What comparing articles reads, as numbers."""
    return rows.select(
        group, "id", F.unix_micros("ts").alias("t"), _code("simhash").alias("code"), F.xxhash64("content_hash").alias("ch"),
        F.coalesce(F.xxhash64("url_key"), F.lit(0)).alias("uh"), F.col("url_key").isNotNull().alias("has_url"), *more)


def _met_by_title(articles: DataFrame, threshold: float, hours: int, judge, schema: str, content: bool = False) -> DataFrame:
    tagged, pairs = _title_groups(articles, threshold, hours, content)
    return blocks.meet(materialize(_packed(tagged, "inst"), "titles"), "inst", pairs, judge, schema)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :])


def _same_url(a: blocks.Side, some: slice, b: blocks.Side):
    """Which pairs have the same URL; None if there are no two URLs."""
    left, right = a["has_url"][some], b["has_url"]
    if left.any() and right.any():
        return (a["uh"][some][:, None] == b["uh"][None, :]) & left[:, None] & right[None, :]


def _best_earlier(a: blocks.Side, b: blocks.Side | None, hours: int, score, refused) -> dict[str, list]:
    """For every row of ``a`` the earlier row of ``b`` (or of its own block) within the window with the highest score, the newest of
    equals. ``score(some, other)`` gives a matrix for a slice of rows, ``refused(some, other, it)`` lowers what may not be."""
    other, before = blocks.earlier(a, b)
    t, ids, partners = a["t"], a["id"], other["id"]
    since = np.searchsorted(other["t"], t - hours * MICROS)
    place = np.arange(len(other))
    out = {"id": [], "partner": [], "score": []}
    for some in blocks.slices(len(a), len(other)):
        grid = score(some, other)
        grid[(place < since[some, None]) | (place >= before[some, None])] = -1
        refused(some, other, grid)
        newest = len(other) - 1 - grid[:, ::-1].argmax(axis=1)
        top = grid[np.arange(len(newest)), newest]
        hit = top >= 0
        out["id"].append(ids[some][hit])
        out["partner"].append(partners[newest[hit]])
        out["score"].append(top[hit])
    return out


def _both_sides(a: blocks.Side, b: blocks.Side | None, one) -> dict[str, np.ndarray]:
    found = [one(a, b)] + ([] if b is None else [one(b, a)])
    return {k: np.concatenate([x for f in found for x in f[k]]) for k in found[0]}


def near_duplicates(articles: DataFrame, hours: int = L.WINDOW_HOURS) -> DataFrame:
    """Best level-3 candidate of every article: SimHash <= 12 with title >= 0.86, or title >= 0.95.

    Candidates equal in URL or content belong to the earlier levels and are left to them.
    """
    def judge(a, b, record, hours=hours):
        jac = record["jaccard"]
        most = 64 if jac >= L.TITLE_ALONE - 1e-12 else L.SIMHASH_MAX

        def one(x, y):
            # Inside a pair of titles the nearest code is the best; 64 minus the distance is its score.
            def score(some, other):
                return (64 - _distance(x["code"][some], other["code"]).astype(np.int8)).astype(np.int8)

            def refused(some, other, grid):
                grid[grid < 64 - most] = -1
                i, j = np.nonzero(grid == 64)  # equal contents have equal codes
                same = x["ch"][some][i] == other["ch"][j]
                grid[i[same], j[same]] = -1
                url = _same_url(x, some, other)
                if url is not None:
                    grid[url] = -1

            return _best_earlier(x, y, hours, score, refused)

        out = _both_sides(a, b, one)
        far = 64 - out["score"].astype(np.int64)
        out["score"] = (1 - far / 64) * 0.6 + jac * 0.4
        out["level"] = np.where(far <= L.SIMHASH_MAX, "simhash", "titulo")
        return out

    found = _met_by_title(articles, L.TITLE_WITH_SIMHASH, hours, judge, "id long, partner long, score double, level string")
    return _best(found.select("id", F.col("partner").alias("candidate"), F.col("score").alias("similarity"), "level"), articles)


def _best(found: DataFrame, articles: DataFrame) -> DataFrame:
    """Highest similarity per article, newest candidate on ties."""
    stamped = found.join(articles.select(F.col("id").alias("candidate"), F.col("ts").alias("_ct")).hint("merge"), "candidate")
    key = F.struct("similarity", "_ct", "candidate")
    return stamped.groupBy("id").agg(F.max_by(F.struct("candidate", "similarity", "level"), key).alias("_m")).select(
        "id", "_m.candidate", "_m.similarity", "_m.level")


# --- level 4: embeddings ----------------------------------------------------------------------

def semantic_duplicates(articles: DataFrame, hours: int = L.WINDOW_HOURS, threshold: float = L.SEMANTIC_MIN) -> DataFrame:
    """Best candidate by cosine >= threshold among those no earlier level matched. Exact.

    Blocks of vectors of one length, of the same or neighbouring time buckets, are multiplied as matrices.
    """
    size, kinds = F.size("embedding"), F.lit(1 << 20)  # a group is a bucket and a length
    bucketed = articles.filter(size > 0).withColumn("group", time_bucket(F.col("ts"), hours).cast("long") * kinds + size)
    rows = materialize(_packed(bucketed, "group", F.col("embedding").cast("array<float>").alias("embedding"),
                               F.transform("title_tokens", lambda t: F.xxhash64(t)).alias("tt")), "vectors")
    groups = rows.select(F.col("group").alias("group_a")).distinct()
    there = groups.select(F.col("group_a").alias("group_b"))
    pairs = groups.withColumn("group_b", F.explode(F.array(F.col("group_a"), F.col("group_a") + kinds))).join(there, "group_b", "left_semi")

    def judge(a, b, record, hours=hours, threshold=threshold):
        def one(x, y):
            def unit(side):
                m = side.matrix("embedding")
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

            left, right = unit(x), unit(x if y is None else y)
            tokens, others = x.rows("tt"), (x if y is None else y).rows("tt")

            def score(some, other):
                return np.round(left[some] @ right.T, 9)  # equal vectors score exactly one

            def refused(some, other, grid):
                grid[grid < threshold] = -1
                i, j = np.nonzero(grid >= 0)  # few pairs reach the threshold
                far = np.bitwise_count(x["code"][some][i].view(np.uint64) ^ other["code"][j].view(np.uint64))
                bad = x["ch"][some][i] == other["ch"][j]
                bad |= (x["uh"][some][i] == other["uh"][j]) & x["has_url"][some][i] & other["has_url"][j]
                for k in np.flatnonzero(~bad):
                    p, q = set(tokens[some.start + i[k]].as_py()), set(others[j[k]].as_py())
                    jac = len(p & q) / len(p | q) if p and q else 0.0
                    bad[k] = jac >= L.TITLE_ALONE or (far[k] <= L.SIMHASH_MAX and jac >= L.TITLE_WITH_SIMHASH)
                grid[i[bad], j[bad]] = -1

            return _best_earlier(x, y, hours, score, refused)

        out = _both_sides(a, b, one)
        out["level"] = np.full(len(out["id"]), "semantico")
        return out

    found = blocks.meet(rows, "group", pairs, judge, "id long, partner long, score double, level string", 1024)
    return _best(found.select("id", F.col("partner").alias("candidate"), F.col("score").alias("similarity"), "level"), articles)


# --- verdict -----------------------------------------------------------------------------------

def verdicts(articles: DataFrame, hours: int = L.WINDOW_HOURS, semantic: bool = True) -> DataFrame:
    """One row per article: is_duplicate, canonical_id, similarity, level.

    The canonical row is never itself a duplicate: where the best candidate is one, its own canonical row, or that
    row's, takes its place. Similarity and level stay those of the match.
    """
    found = same_key(articles, "url_key", "url", 1.0, hours).unionByName(
        same_key(articles, "content_hash", "contenido", 0.99, hours)).unionByName(near_duplicates(articles, hours))
    if semantic:
        found = found.unionByName(semantic_duplicates(articles, hours))
    best = roots(_best(found, articles))
    return articles.select("id").join(best.hint("merge"), "id", "left").select(
        "id", F.col("candidate").isNotNull().alias("is_duplicate"), F.col("candidate").alias("canonical_id"),
        F.round(F.coalesce("similarity", F.lit(0.0)), 3).alias("similarity"), "level")


def roots(best: DataFrame) -> DataFrame:
    """Candidates replaced by the end of their chain. Chains lead back in time, so each round of jumps halves them."""
    best = materialize(best, "best")
    jump = materialize(best.select("id", "candidate"), "jumps")
    while True:
        onward = jump.select(F.col("id").alias("candidate"), F.col("candidate").alias("_next"))
        step = materialize(jump.join(onward.hint("merge"), "candidate", "left"), "jumps")
        if step.filter("_next IS NOT NULL").limit(1).count() == 0:
            return best.drop("candidate").join(jump.hint("merge"), "id")
        jump = step.select("id", F.coalesce("_next", "candidate").alias("candidate"))


# --- reports ---------------------------------------------------------------------------------------

def similar_counts(articles: DataFrame, hours: int = L.WINDOW_HOURS, minimum: float = L.REPORT_MIN) -> DataFrame:
    """Per article the number of items within the window that score at least ``minimum``, and the best score.

    A score of 0.8 needs a title Jaccard of at least 0.5, or equal content, which scores 0.99.
    """
    def judge(a, b, record, hours=hours, minimum=minimum):
        jac = record["jaccard"]

        def one(x, y):
            other = x if y is None else y
            out = {"id": [], "n": [], "best": []}
            for some in blocks.slices(len(x), len(other)):
                d = _distance(x["code"][some], other["code"])
                score = (1 - d / 64) * 0.6 + jac * 0.4
                i, j = np.nonzero(d == 0)
                same = x["ch"][some][i] == other["ch"][j]
                score[i[same], j[same]] = 0.99
                near = (np.abs(x["t"][some][:, None] - other["t"][None, :]) <= hours * MICROS) & (x["id"][some][:, None] != other["id"][None, :])
                hit = near & (score >= minimum - 1e-12)
                n = hit.sum(axis=1)
                out["id"].append(x["id"][some][n > 0])
                out["n"].append(n[n > 0])
                out["best"].append(np.where(hit, score, 0.0).max(axis=1)[n > 0])
            return out

        return _both_sides(a, b, one)

    parts = _met_by_title(articles, 0.5, hours, judge, "id long, n long, best double", content=True)
    return parts.groupBy("id").agg(F.sum("n").alias("n_similar"), F.round(F.max("best"), 3).alias("best"))


def similar_to(articles: DataFrame, article_id: int, hours: int = L.WINDOW_HOURS, minimum: float = L.REPORT_MIN) -> DataFrame:
    """The full similar-items list of one article: a single scan against one row."""
    me = articles.filter(F.col("id") == article_id).select(
        F.col("id").alias("_i"), F.col("ts").alias("_ts"), F.col("content_hash").alias("_ch"),
        F.col("simhash").alias("_sh"), F.col("title_tokens").alias("_tt"))
    near = F.abs(F.unix_micros("ts") - F.unix_micros("_ts")) <= hours * MICROS
    j = articles.join(F.broadcast(me), near & (F.col("id") != F.col("_i")))
    sim, title = T.simhash_similarity("simhash", "_sh"), T.jaccard("title_tokens", "_tt")
    equal = F.col("content_hash") == F.col("_ch")
    return j.select(
        "id", F.when(equal, 0.99).otherwise(sim * 0.6 + title * 0.4).alias("similarity"),
        F.when(equal, "contenido").when(sim >= title, "simhash").otherwise("titulo").alias("reason"),
    ).filter(F.col("similarity") >= minimum).orderBy(F.desc("similarity"), "id")


# --- clean-up -----------------------------------------------------------------------------------------

def cleanup_links(articles: DataFrame, hours: int = L.CLEANUP_HOURS, known: DataFrame | None = None) -> DataFrame:
    """Links whose components equal those of all pairs within ``hours`` that share the content or have
    SimHash <= 8 and title >= 0.6. Each block pair contributes a spanning star, not its pairs.

    ``known`` (id, duplicate_of_id) are marks from earlier: they link whatever the texts say, at any distance in time,
    if both articles are there.
    """
    def judge(a, b, record, hours=hours):
        other = a if b is None else b
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for some in blocks.slices(len(a), len(other)):
            # Equal contents have equal codes, so the distance covers them.
            i, j = np.nonzero(_distance(a["code"][some], other["code"]) <= L.CLEANUP_SIMHASH)
            i = i + some.start
            ok = (np.abs(a["t"][i] - other["t"][j]) <= hours * MICROS) & (a["id"][i] != other["id"][j])
            link = blocks.roots_of(i[ok], j[ok], a["id"], other["id"])  # a slice is a forest, so no list of links grows
            if link is not None:
                left.append(link["node"])
                right.append(link["root"])
        return {"node": np.concatenate(left), "root": np.concatenate(right)}

    near = _met_by_title(articles, L.CLEANUP_TITLE, hours, judge, "node long, root long")
    # Equal content inside the window: linking each copy to the one before it joins them all.
    copies = same_key(articles, "content_hash", "contenido", 0.99, hours)
    found = near.unionByName(copies.select(F.col("id").alias("node"), F.col("candidate").alias("root")))
    if known is not None:
        ids = articles.select("id")
        marks = known.join(ids.hint("merge"), "id", "left_semi").join(
            ids.withColumnRenamed("id", "duplicate_of_id").hint("merge"), "duplicate_of_id", "left_semi")
        found = found.unionByName(marks.select(F.col("id").alias("node"), F.col("duplicate_of_id").alias("root")))
    return found.distinct()


def window_counts(articles: DataFrame, hours: int = L.WINDOW_HOURS, eligible: str | None = None) -> DataFrame:
    """Number of other articles within the window of every article, by counting positions on one timeline.

    ``eligible`` names a flag of the articles that count, such as those that are no duplicates.
    """
    lim = hours * MICROS
    counts = F.lit(True) if eligible is None else F.coalesce(F.col(eligible), F.lit(False))
    rows = articles.select("id", F.unix_micros("ts").alias("t"), F.lit(0).alias("g"), counts.cast("int").alias("own"))
    # At equal times: window starts, then articles, then window ends.
    ends = F.explode(F.array(
        F.struct((F.col("t") - lim).alias("t"), F.lit(0).alias("kind")), F.struct(F.col("t").alias("t"), F.lit(1).alias("kind")),
        F.struct((F.col("t") + lim).alias("t"), F.lit(2).alias("kind"))))
    line = rows.select("id", "g", "own", ends.alias("_e")).select("id", "g", "own", "_e.t", "_e.kind")
    placed = ordered.running(line, ["g"], ["t", "kind", "id"], {
        "pos": ("count", F.when((F.col("kind") == 1) & (F.col("own") == 1), F.lit(1)))})
    return placed.groupBy("id").agg((F.max(F.when(F.col("kind") == 2, F.col("pos"))) - F.max(F.when(
        F.col("kind") == 0, F.col("pos"))) - F.max("own")).alias("candidates"))


def candidate_window(articles: DataFrame, hours: int = L.WINDOW_HOURS, cap: int = L.CANDIDATE_CAP) -> DataFrame:
    """The ``cap`` newest candidates around every article (the listing shown to an editor).

    Positions in time order make it linear: the newest candidates end at the last position within
    the window, so each article joins ``cap`` consecutive positions.
    """
    lim = hours * MICROS
    rows = articles.select("id", F.unix_micros("ts").alias("t"), F.lit(0).alias("g"))
    # Article rows and window ends on one timeline; the running article count is the position.
    line = rows.select("id", "t", "g", F.lit(0).alias("kind")).unionByName(
        rows.select("id", (F.col("t") + lim).alias("t"), "g", F.lit(1).alias("kind")))
    placed = materialize(ordered.running(line, ["g"], ["t", "kind", "id"], {
        "pos": ("count", F.when(F.col("kind") == 0, F.lit(1)))}), "positions")
    ends = placed.filter("kind = 1").select("id", (F.col("t") - lim).alias("t"), F.explode(F.sequence(
        F.greatest(F.lit(1), F.col("pos") - cap), F.col("pos"))).alias("pos"), F.col("pos").alias("_end"))
    at = placed.filter("kind = 0").select(F.col("id").alias("candidate"), F.col("t").alias("_ct"), "pos")
    hits = ends.join(at, "pos").filter((F.col("candidate") != F.col("id")) & (F.col("t") - F.col("_ct") <= lim))
    # One position was the article itself or not; rank what is left. At most cap + 1 rows per article.
    from .reports import top_per_key
    return top_per_key(hits, ["id"], [F.col("pos").desc()], cap).select("id", "candidate", "rank")
