"""Listing predicates, joins, aggregates and top-k reports over a catalog of incidents.

Column names used: id title summary body status category municipality_id zone vehicle_type
severity occurred_at published_at injuries fatalities duplicate_of_id is_featured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dates import utc_to_local, week_start, year_window
from ..rules import lexicon as L
from ..rules.places import MUNICIPALITIES


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- predicates -----------------------------------------------------------------------

def is_public(exclude_duplicates: bool = True) -> Column:
    published = F.col("status") == "PUBLISHED"
    return published & F.col("duplicate_of_id").isNull() if exclude_duplicates else published


def is_incident() -> Column:
    return is_public() & F.col("category").isin(L.INCIDENT_FAMILY)


def between(start, end, column: str = "occurred_at") -> Column:
    return (F.col(column) >= start) & (F.col(column) < end)


def within_days(first=None, last=None, column: str = "occurred_at") -> Column:
    """Inclusive day range; a missing bound is open."""
    parts = []
    if first is not None:
        parts.append(F.col(column) >= F.lit(first).cast("timestamp"))
    if last is not None:
        parts.append(F.col(column) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return all_of(parts)


def mentions(term: str, columns: tuple[str, ...]) -> Column:
    """Case-sensitive containment in any of the columns."""
    term = term.strip()
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(c), F.lit(term)), F.lit(False)) for c in columns])


def names_place(name: Column, columns: tuple[str, ...] = ("title", "summary", "body")) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [
        F.coalesce(F.contains(F.lower(F.col(c)), low), F.lit(False)) for c in columns])


def category_in(value: str | list[str]) -> Column:
    return F.col("category").isin([value] if isinstance(value, str) else list(value))


def review_queue() -> Column:
    hidden = F.col("duplicate_of_id").isNotNull() & (F.col("status") != "PUBLISHED")
    return ~F.coalesce(hidden, F.lit(False))


def fresh_items(as_of: Column, column: str = "published_at") -> Column:
    """Undated items pass; dated ones must be inside both the age limit and the look-back."""
    ts = F.col(column)
    return ts.isNull() | (
        (ts >= as_of - F.expr(f"interval {L.MAX_AGE_DAYS} days"))
        & (ts >= as_of - F.expr(f"interval {L.LOOKBACK_MINUTES} minutes")))


def parse_filters(params: dict, as_of: str | None = None) -> dict:
    """Untrusted request parameters to known-good filter values; anything unknown is dropped."""
    def one(key):
        v = params.get(key)
        return v[0] if isinstance(v, (list, tuple)) and v else v if not isinstance(v, (list, tuple)) else None

    try:
        page = max(1, int(float(one("page") or 1)))
    except (TypeError, ValueError):
        page = 1
    since = one("desde")
    towns = [m[0] for m in MUNICIPALITIES]
    return {
        "municipality": one("municipio") if one("municipio") in towns else None,
        "vehicle": one("vehicle") if one("vehicle") in L.VEHICLES else None,
        "category": one("categoria") if one("categoria") in L.CATEGORY_LABEL else None,
        "days_back": min(int(since), 3650) if since and since.isdigit() and len(since) <= 4 else None,
        "q": (one("q") or "").strip()[:120], "take": 12, "skip": (page - 1) * 12,
    }


# --- lists ------------------------------------------------------------------------------

def newest(df: DataFrame, limit: int, offset: int = 0, by: str = "occurred_at", key: str = "id") -> DataFrame:
    """Top rows by time, newest first, id breaking ties. A bounded heap per partition, no full sort."""
    ordered = df.orderBy(F.col(by).desc_nulls_last(), F.col(key))
    return ordered.limit(offset + limit).offset(offset) if offset else ordered.limit(limit)


def page(df: DataFrame, take: int = 12, skip: int = 0) -> DataFrame:
    return newest(df, min(take, 60), max(0, skip))


def page_meta(total: Column, page_no: Column, per_page: int = 12) -> list[Column]:
    pages = F.greatest(F.lit(1), F.ceil(total / per_page)).cast("long")
    first = F.greatest(F.lit(1), F.least(page_no - 2, pages - 4)).cast("long")
    return [pages.alias("total_pages"), first.alias("first_shown"),
            F.least(pages, first + 4).cast("long").alias("last_shown")]


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark limits each key before the shuffle, so a hot key
    contributes at most ``n`` rows per input partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def featured(df: DataFrame) -> DataFrame:
    return df.filter(is_incident()).orderBy(
        F.col("is_featured").desc(), F.col("occurred_at").desc(), "id").limit(1)


def related(df: DataFrame, n: int = 4) -> DataFrame:
    """For every public article its newest ``n`` others with the same municipality or vehicle.

    The newest n+1 of each municipality and of each vehicle contain every possible answer, so both
    joins meet a short list per key instead of the whole key.
    """
    rows = df.filter(is_public()).select("id", "municipality_id", "vehicle_type", "occurred_at")
    newest_first = [F.col("occurred_at").desc(), F.col("id")]

    def side(key):
        # One array of at most n+1 rows per key value.
        best = top_per_key(rows.filter(F.col(key).isNotNull()), [key], newest_first, n + 1)
        lists = best.groupBy(F.col(key).alias("_key")).agg(
            F.collect_list(F.struct("occurred_at", "id")).alias(f"_{key}"))
        return lists

    joined = rows
    for key in ("municipality_id", "vehicle_type"):
        joined = joined.join(side(key), F.col(key) == F.col("_key"), "left").drop("_key")
    both = F.array_distinct(F.concat(*[
        F.coalesce(F.col(c), F.expr("cast(array() as array<struct<occurred_at:timestamp,id:bigint>>)"))
        for c in ("_municipality_id", "_vehicle_type")]))
    others = F.filter(both, lambda o: o["id"] != F.col("id"))
    ordered = F.array_sort(others, lambda a, b: (
        F.when(a["occurred_at"] > b["occurred_at"], -1).when(a["occurred_at"] < b["occurred_at"], 1)
        .when(a["id"] < b["id"], -1).otherwise(1)))
    return joined.select("id", F.posexplode(F.slice(ordered, 1, n)).alias("_p", "_o")).select(
        "id", (F.col("_p") + 1).alias("rank"), F.col("_o.id").alias("related_id"))


def map_points(df: DataFrame, limit: int = 200) -> DataFrame:
    return newest(df.filter(is_incident()), limit).dropna(subset=["lat", "lon"])


# --- joins --------------------------------------------------------------------------------

def with_dimension(df: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Foreign-key lookup. No hint: Spark broadcasts the dimension only when its size allows."""
    return df.join(dim, df[fk] == dim[pk], "inner")


def count_on(parent: DataFrame, child: DataFrame, on: Column, key: str, child_id: str, out: str = "n") -> DataFrame:
    """Children per parent row by any condition, zeros kept.

    The inner join lets Spark broadcast the small parent and count where the children are; only counts are
    shuffled, so a parent with any share of the children is no hot key.
    """
    counts = parent.join(child, on).groupBy(key).agg(F.count(child_id).alias(out)).withColumnRenamed(key, "_key")
    joined = parent.select(key).distinct().join(counts, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, F.coalesce(out, F.lit(0)).cast("long").alias(out))


def child_counts(parent: DataFrame, child: DataFrame, pk: str, fk: str, out: str = "n") -> DataFrame:
    """Children are counted before the join, so a hot parent costs one row."""
    counts = child.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias(out))
    joined = parent.join(counts, F.col(pk) == F.col("_fk"), "left").drop("_fk")
    return joined.withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def children_top(child: DataFrame, fk: str, order: list[Column], n: int, fields: list[str], out: str) -> DataFrame:
    """One row per parent with its first ``n`` children, nested in order."""
    best = top_per_key(child, [fk], order, n, "_rank")
    packed = best.groupBy(fk).agg(F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias("_c"))
    return packed.select(fk, F.transform("_c", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(out))


def label_lookup(df: DataFrame, column: str, labels: dict[str, str], default: str, out: str) -> DataFrame:
    table = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, F.col(column)), F.lit(default)))


# --- aggregates -------------------------------------------------------------------------------

def headline_stats(df: DataFrame, as_of: Column) -> DataFrame:
    return df.filter(is_incident()).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("occurred_at") >= as_of - F.expr("interval 24 hours")).alias("last_24h"),
        F.countDistinct("municipality_id").alias("municipalities"))


def facets(df: DataFrame, label: str, place: str, month: str | None = None) -> DataFrame:
    """Totals and counts per label, place and (optionally) month in one pass of grouping sets.

    The total adds up the label rows, so it exists for an empty period too.
    """
    dims = [label, place] + ([month] if month else [])
    sets = ", ".join(f"({d})" for d in dims)
    name = "CASE " + " ".join(
        f"WHEN grouping({d}) = 0 THEN '{k}'" for d, k in zip(dims, ("label", "place", "month"))) + " END"
    value = "coalesce(" + ", ".join(f"cast({d} as string)" for d in dims) + ", '')"
    view = df.select(*dims, "injuries", "fatalities")
    per = view.sparkSession.sql(
        f"SELECT {name} AS facet, {value} AS value, count(*) AS n, coalesce(sum(injuries), 0) AS injuries, "
        f"coalesce(sum(fatalities), 0) AS fatalities FROM {{view}} GROUP BY GROUPING SETS ({sets})", view=view)
    total = per.filter("facet = 'label'").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "injuries", "fatalities")])
    return per.unionByName(total.select(F.lit("total").alias("facet"), F.lit("").alias("value"), "n", "injuries", "fatalities"))


def weekly_summary(df: DataFrame, start: Column, label: str, place: str) -> DataFrame:
    rows = df.filter(is_incident() & between(start, start + F.expr("interval 7 days")))
    return facets(rows, label, place)


def annual_summary(df: DataFrame, year: int, label: str, place: str) -> DataFrame:
    """Facet counts of a local calendar year, all twelve months present."""
    lo, hi = year_window(F.lit(year))
    rows = df.filter(is_incident() & between(lo, hi)).withColumn("_m", F.month(utc_to_local("occurred_at")))
    got = facets(rows, label, place, "_m")
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("string").alias("value"), F.lit("month").alias("facet"))
    months = months.join(got.filter("facet = 'month'"), ["facet", "value"], "left").select(
        "facet", "value", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "injuries", "fatalities")])
    return got.filter("facet <> 'month'").unionByName(months)


def ranked(per: DataFrame, facets_of: tuple[str, ...] = ("label", "place")) -> DataFrame:
    """Facet values by falling count, equal counts in Spanish order, with their place.

    Values of a facet are a dimension; their order needs one task per facet.
    """
    order = Window.partitionBy("facet").orderBy(F.desc("n"), F.expr("value COLLATE es"))
    return per.filter(F.col("facet").isin(*facets_of)).withColumn("position", F.row_number().over(order))


def weekly_list(df: DataFrame, start: Column, limit: int | None = None) -> DataFrame:
    """The incidents of a week, newest first; figures of the summary never depend on ``limit``."""
    rows = df.filter(is_incident() & between(start, start + F.expr("interval 7 days"))).orderBy(F.desc("occurred_at"), "id")
    return rows if limit is None else rows.limit(max(0, limit))


def annual_list(df: DataFrame, year: int, limit: int | None = 200) -> DataFrame:
    """The newest incidents of a local calendar year."""
    rows = df.filter(is_incident() & between(*year_window(F.lit(year)))).orderBy(F.desc("occurred_at"), "id")
    return rows if limit is None else rows.limit(max(0, limit))


def years_with_data(df: DataFrame, limit: int = 6) -> DataFrame:
    return df.filter(is_incident()).select(
        F.year(utc_to_local("occurred_at")).alias("year")).distinct().orderBy(F.desc("year")).limit(limit)


def weeks_with_data(df: DataFrame, limit: int = 12) -> DataFrame:
    return df.filter(is_incident()).select(
        week_start("occurred_at").alias("week")).distinct().orderBy(F.desc("week")).limit(limit)


def complete_counts(df: DataFrame, column: str, domain: list[str], out: str = "n") -> DataFrame:
    """Counts per domain value; absent values count zero, unknown ones are ignored."""
    dim = value_dim(df.sparkSession, domain, column)
    got = df.groupBy(column).agg(F.count(F.lit(1)).alias(out))
    return dim.join(got, column, "left").select(column, "position", F.coalesce(out, F.lit(0)).alias(out))


def value_dim(spark: SparkSession, values: list[str], column: str) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, position int")


def best_by_change(changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return top_per_key(changes, [key], order, 1, "_last").drop("_last")


def scaled_bars(df: DataFrame, n: str = "n") -> DataFrame:
    """Share of the largest facet; the divisor is at least one."""
    return df.sparkSession.sql(
        f"SELECT *, {n} / greatest(1, (SELECT max({n}) FROM {{v}})) AS bar FROM {{v}}", v=df)
