"""Ordered per-key computation that never needs one key to fit one task.

A plain window function pulls all rows of a key into one task. Here rows are range
partitioned on (key, order), so a hot key spreads over many chunks; each chunk computes
its own prefix, and a carry of at most one row per chunk boundary completes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, shuffle_width

_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
BLOCK = 50_000


def chunked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows placed in (key, order) range chunks, stored so that the placement is stable."""
    placed = df.repartitionByRange(shuffle_width(df.sparkSession), *keys, *order)
    return materialize(placed.withColumn("_chunk", F.spark_partition_id()), "chunked")


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local + carry, local, carry)
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


def running(df: DataFrame, keys: list[str], order: list[str],
            aggs: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add running ``sum count max min`` columns over each key in the given total order."""
    placed = chunked(df, keys, order)
    last = Window.currentRow if inclusive else -1
    w = Window.partitionBy("_chunk", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = placed.select("*", *[_AGG[k](e).over(w).alias(n) for n, (k, e) in aggs.items()])

    totals = placed.groupBy(*keys, "_chunk").agg(*[_AGG[k](e).alias(n) for n, (k, e) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"),
        F.count(F.lit(1)).over(before).alias("_earlier"),
        *[_AGG["sum" if k == "count" else k](n).over(before).alias(f"_carry_{n}") for n, (k, _) in aggs.items()],
    ).filter("_earlier > 0").drop("_earlier")
    # A chunk continues at most one key of an earlier chunk: no more rows than chunks.
    on = (F.col("_chunk") == F.col("_kc"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(F.broadcast(carry), on, "left")
    return joined.select(*df.columns, *[
        _combine(k, F.col(n), F.col(f"_carry_{n}")).alias(n) for n, (k, _) in aggs.items()])


def blocked(df: DataFrame, keys: list[str], order: list[str], before: int, block: int = BLOCK) -> DataFrame:
    """Split every key into position blocks, each preceded by the last ``before`` rows of the one before it.

    Adds ``_pos _block _halo``. Windows over (key, _block) ordered by ``_pos`` that look back at most
    ``before`` rows are then exact on rows where ``_halo`` is false.
    """
    block = max(block, before, 1)
    ranked = running(df, keys, order, {"_pos": ("count", F.lit(1))})
    own = F.floor((F.col("_pos") - 1) / block)
    near_end = (F.col("_pos") - 1) % block >= block - before
    spread = ranked.withColumn(
        "_home", own).withColumn(
        "_block", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    return spread.withColumn("_halo", F.col("_block") != F.col("_home")).drop("_home")


def look_back(df: DataFrame, keys: list[str], order: list[str], before: int,
              make, block: int = BLOCK) -> DataFrame:
    """Add columns computed by ``make(window)`` over the current and the ``before`` preceding rows."""
    rows = blocked(df, keys, order, before, block)
    w = Window.partitionBy(*keys, "_block").orderBy("_pos")
    out = rows.select(*df.columns, "_halo", *[e.alias(n) for n, e in make(w).items()])
    return out.filter(~F.col("_halo")).drop("_halo")


def scan(df: DataFrame, keys: list[str], order: list[str], lasts: dict[str, tuple[Column, bool]],
         aggs: dict[str, tuple[str, Column]] | None = None, counted: Column | None = None) -> DataFrame:
    """Positions and running values of each key in one range shuffle.

    Adds ``_pos`` (rows so far that are ``counted``), for each of ``lasts`` the position of the latest row that meets its
    condition, up to this row or, where the flag is false, before it, and the running ``aggs``. A last position is the sum of a
    position inside the chunk and the rows of the chunks before, so it needs no second pass over the rows.
    """
    aggs = aggs or {}
    one = F.lit(1) if counted is None else F.when(counted, F.lit(1))
    placed = chunked(df, keys, order)
    w = Window.partitionBy("_chunk", *keys).orderBy(*order)
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    base = placed.withColumn("_pos", F.count(one).over(so_far))
    mark = {n: F.when(c, F.col("_pos")) for n, (c, _) in lasts.items()}
    local = base.select("*", *[F.max(mark[n]).over(so_far if own else earlier).alias(n) for n, (_, own) in lasts.items()],
                        *[_AGG[k](e).over(so_far).alias(n) for n, (k, e) in aggs.items()])

    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*keys, "_chunk").agg(F.max("_pos").alias("_n"), *[F.max(mark[n]).alias(n) for n in lasts],
                                              *[_AGG[k](e).alias(n) for n, (k, e) in aggs.items()])
    totals = totals.withColumn("_base", F.sum("_n").over(before))
    carry = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_kc"), "_base",
        *[F.max(F.col(n) + F.coalesce("_base", F.lit(0))).over(before).alias(f"_carry_{n}") for n in lasts],
        *[_AGG["sum" if k == "count" else k](n).over(before).alias(f"_carry_{n}") for n, (k, _) in aggs.items()],
    ).filter("_base IS NOT NULL")
    # As in ``running``: no more rows than chunks.
    on = F.col("_chunk") == F.col("_kc")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(F.broadcast(carry), on, "left").withColumn("_base", F.coalesce("_base", F.lit(0)))
    return joined.select(
        *df.columns, (F.col("_pos") + F.col("_base")).alias("_pos"),
        *[F.coalesce(F.col(n) + F.col("_base"), F.col(f"_carry_{n}")).alias(n) for n in lasts],
        *[_combine(k, F.col(n), F.col(f"_carry_{n}")).alias(n) for n, (k, _) in aggs.items()])


def following(rows: DataFrame, probes: DataFrame, keys: list[str], time: str, tie: str, wanted: str) -> DataFrame:
    """Every probe with the first row of its key behind it in (time, tie) order, as the struct ``wanted`` (time, tie) or null.

    ``rows`` and ``probes`` share keys, time and tie; what else the probes have stays. Both lie on one timeline that is read
    backwards, so the first row behind is a running minimum and a hot key spreads over tasks.
    """
    rest = [c for c in probes.columns if c not in (*keys, time, tie)]
    line = rows.select(*keys, time, tie, F.lit(1).alias("_row"), F.lit(None).cast(probes.select(F.struct(*rest)).dtypes[0][1]).alias("_rest")
                       ).unionByName(probes.select(*keys, time, tie, F.lit(0).alias("_row"), F.struct(*rest).alias("_rest")))
    line = line.withColumn("_back", -F.unix_micros(time)).withColumn("_tie", -F.col(tie))
    # Backwards, a row that equals a probe comes after it and is not seen.
    found = running(line, keys, ["_back", "_tie", "_row"], {wanted: ("min", F.when(F.col("_row") == 1, F.struct(time, tie)))})
    return found.filter("_row = 0").select(*keys, time, tie, *[F.col(f"_rest.{c}").alias(c) for c in rest], wanted)
