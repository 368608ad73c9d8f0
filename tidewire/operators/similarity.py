"""Exact set-similarity join on token arrays with prefix filtering.

Works on distinct token sets: all articles with the same set in the same time bucket form one
*instance*, so copies never multiply. Tokens are ordered by ascending frequency; the longer side
probes with its Jaccard prefix, the shorter side is indexed with the tighter prefix that its
length allows, so frequent tokens hardly ever serve as join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import jaccard
from ..session import materialize


def time_bucket(ts, hours: int) -> Column:
    return F.floor(F.unix_seconds(ts) / (hours * 3600))


def instances(df: DataFrame, id_col: str, tokens: str, bucket: Column | None = None) -> DataFrame:
    """Distinct (token set, bucket): inst (smallest member id), toks, bucket, members."""
    b = F.lit(0).cast("long") if bucket is None else bucket
    return (
        df.filter(F.size(tokens) > 0)
        .groupBy(F.array_sort(tokens).alias("toks"), b.alias("bucket"))
        .agg(F.min(id_col).alias("inst"), F.count(F.lit(1)).alias("members")))


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """Per instance its size ``n``, 128 bits of which each token sets one (``low``, ``high``), and the hashes of the rarest tokens
    that a probe for ``threshold`` needs, from rare to frequent."""
    words = sets.select("inst", "bucket", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    freq = words.groupBy("tok").agg(F.count(F.lit(1)).alias("freq"))
    hashed = words.join(freq.hint("merge"), "tok").select("inst", "bucket", "n", "freq", F.xxhash64("tok").alias("h"))

    def bits(half: int) -> Column:
        return F.coalesce(F.bit_or(F.expr(f"CASE WHEN pmod(h, 128) div 64 = {half} THEN shiftleft(1L, CAST(pmod(h, 64) AS INT)) END")), F.lit(0).cast("long"))

    ranked = hashed.groupBy("inst", "bucket", "n").agg(
        F.array_sort(F.collect_list(F.struct("freq", "h"))).alias("_all"), bits(0).alias("low"), bits(1).alias("high"))
    probe = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    rarest = F.transform(F.slice("_all", F.lit(1), probe.cast("int")), lambda x: x["h"])
    return materialize(ranked.select("inst", "bucket", "n", "low", "high", rarest.alias("prefix")), "prefixes")


def similar_pairs(sets: DataFrame, threshold: float, across_buckets: bool = True) -> DataFrame:
    """Unordered pairs of instances with Jaccard >= threshold in the same or a neighbouring bucket.

    ``sets`` should be stored. Returns inst_a < inst_b, members_a, members_b, bucket_a, bucket_b, jaccard. A prefix token travels
    as its hash with a few numbers, never with the tokens of its set; those meet only the pairs that sizes, places and bits allow.
    """
    rows = _prefixes(sets, threshold)
    near = F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1) if across_buckets else F.array("bucket")
    index = F.col("n") - F.ceil(F.col("n") * F.lit(2 * threshold / (1 + threshold)) - 1e-9) + 1

    def side(name: str, buckets: Column, tokens: Column) -> DataFrame:
        numbers = [F.col(c).alias(f"{name}_{c}") for c in ("inst", "n", "low", "high")]
        keyed = rows.select(*numbers, F.explode(buckets).alias("bucket"), tokens.alias("_tokens"))
        return keyed.select(*[c for c in keyed.columns if c != "_tokens"], F.posexplode("_tokens").alias(f"{name}_place", "h"))

    # Sizes of stored steps say little of exploded rows: these sides are never broadcast.
    met = side("l", near, F.col("prefix")).join(
        side("s", F.array("bucket"), F.slice("prefix", F.lit(1), index.cast("int"))).hint("merge"), ["bucket", "h"])
    ln, sn = F.col("l_n"), F.col("s_n")
    least = (ln + sn) * F.lit(threshold / (1 + threshold)) - 1e-6  # common tokens of similar sets
    apart = F.bit_count(F.col("l_low").bitwiseXOR(F.col("s_low"))) + F.bit_count(F.col("l_high").bitwiseXOR(F.col("s_high")))
    candidates = met.filter(
        ((ln > sn) | ((ln == sn) & (F.col("l_inst") > F.col("s_inst")))) & (sn >= ln * F.lit(threshold) - 1e-9)
        # True of the first common token of similar sets, at which nothing common lies behind.
        & (F.least(ln - F.col("l_place"), sn - F.col("s_place")) >= least)
        # Every bit that differs is of a token of one set only.
        & ((ln + sn - apart) / 2 >= least))
    pairs = candidates.select(F.least("l_inst", "s_inst").alias("inst_a"), F.greatest("l_inst", "s_inst").alias("inst_b")).distinct()
    for x in "ab":
        named = sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("inst", "members", "bucket", "toks")])
        pairs = pairs.join(named.hint("merge"), f"inst_{x}")
    scored = pairs.withColumn("jaccard", jaccard("toks_a", "toks_b")).filter(F.col("jaccard") >= threshold - 1e-12)
    return scored.select(*[f"{c}_{x}" for c in ("inst", "members", "bucket") for x in "ab"], "jaccard")
