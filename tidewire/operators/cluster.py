"""Clusters over links: connected components, leader clustering, survivors and archive plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .reports import top_per_key


def components(links: DataFrame, a: str = "node", b: str = "root") -> DataFrame:
    """(node, cluster): every linked node with the smallest id of its component.

    Each round moves labels along links and then jumps to the label of the label. Minima are
    combined before the shuffle, so a hub node costs one row per task. Every round is stored.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = materialize(both.union(both.select("y", "x")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("x").alias("node")).agg(
        F.least(F.min("y"), F.first("x")).alias("cluster")), "labels")
    while True:
        offered = edges.join(labels.hint("merge"), edges.y == labels.node).groupBy(F.col("x").alias("node")).agg(
            F.min("cluster").alias("_c"))
        step = labels.join(offered.hint("merge"), "node").select("node", F.col("cluster").alias("_old"),
                                                   F.least("cluster", "_c").alias("_c"))
        jump = labels.select(F.col("node").alias("_n"), F.col("cluster").alias("_j"))
        nxt = materialize(step.join(jump.hint("merge"), step._c == jump._n, "left").select(
            "node", F.least("_c", "_j").alias("cluster"), "_old"), "labels")
        changed = nxt.filter("cluster <> _old").limit(1).count()
        labels = nxt.select("node", "cluster")
        if not changed:
            return labels


def leaders(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Greedy clustering in ``seq`` order: a node joins its earliest leader neighbour or leads itself.

    Rounds in parallel: an undecided node whose earlier neighbours are all decided and none leads
    becomes a leader; one with a leading earlier neighbour joins it once no earlier neighbour that
    precedes that leader is undecided. ``nodes``: node, seq; ``links``: node, root (unordered pairs).
    """
    both = links.select(F.col("node").alias("a"), F.col("root").alias("b"))
    both = both.union(both.select("b", "a")).distinct()
    seq = nodes.select(F.col("node").alias("_n"), F.col("seq").alias("_s"))
    earlier = both.join(seq, F.col("a") == F.col("_n")).withColumnRenamed("_s", "sa").drop("_n").join(
        seq, F.col("b") == F.col("_n")).withColumnRenamed("_s", "sb").drop("_n").filter("sb < sa")
    earlier = materialize(earlier, "earlier")
    state = materialize(nodes.select("node", "seq", F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("leader")), "leaders")
    while True:
        look = earlier.join(state.select(F.col("node").alias("b"), F.col("leader").alias("lb")), "b").groupBy(
            F.col("a").alias("node")).agg(
            F.min(F.when(F.col("lb").isNull(), F.col("sb"))).alias("open_seq"),
            F.min(F.when(F.col("lb") == F.col("b"), F.struct("sb", "b"))).alias("lead"))
        j = state.join(look, "node", "left")
        wait = F.col("open_seq").isNotNull() & (F.col("lead").isNull() | (F.col("open_seq") < F.col("lead.sb")))
        decided = F.when(F.col("leader").isNotNull(), F.col("leader")).when(wait, F.lit(None)).otherwise(
            F.coalesce("lead.b", "node"))
        state = materialize(j.select("node", "seq", decided.alias("leader")), "leaders")
        if state.filter("leader IS NULL").limit(1).count() == 0:
            return state.select("node", F.col("leader").alias("cluster"))


def survivors(members: DataFrame, cluster: str = "cluster", id_col: str = "id") -> DataFrame:
    """One row kept per cluster: canonical rows first, then most sources, then oldest."""
    order = [F.col("duplicate_of_id").isNotNull(), F.col("n_sources").desc(), F.col("created_at"), F.col(id_col)]
    return top_per_key(members, [cluster], order, 1, "_r").select(cluster, F.col(id_col).alias("survivor"))


def archive_plan(members: DataFrame, cluster: str = "cluster", id_col: str = "id") -> DataFrame:
    """Per row of a cluster of two or more: keep (with the reconciled figures) or archive."""
    stats = members.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), F.max("fatalities").alias("max_fatalities"), F.max("injuries").alias("max_injuries"))
    kept = survivors(members, cluster, id_col)
    j = members.select(cluster, id_col, "fatalities", "injuries").join(stats.filter("size > 1"), cluster).join(kept, cluster)
    keep = F.col(id_col) == F.col("survivor")
    return j.select(
        id_col, F.col(cluster).alias("cluster"), "size", F.when(keep, "keep").otherwise("archive").alias("action"),
        F.when(keep, F.col("max_fatalities")).otherwise(F.col("fatalities")).alias("fatalities"),
        F.when(keep, F.col("max_injuries")).otherwise(F.col("injuries")).alias("injuries"))
