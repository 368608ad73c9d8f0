"""Filters, joins, aggregates, windows, lists and set operations over the catalog."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import dates as D
from ..functions.geo import coerce
from ..functions.text import slugify
from ..operators import catalog as C, reports as R
from ..rules import lexicon as L
from .bindings import sql_list, view, with_views
from .registry import query

INCIDENT = f"status = 'PUBLISHED' AND duplicate_of_id IS NULL AND category IN ({sql_list(L.INCIDENT_FAMILY)})"
PUBLIC = "status = 'PUBLISHED' AND duplicate_of_id IS NULL"
AS_OF = "2001-07-15 12:00:00"


def acc(spark, d):
    return view(spark, d, "accidents")


def stamp(c, name):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_stamp(c, name):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name}"


def A(sql, *more):
    return with_views(sql, "accidents", *more)


# --- filters ---------------------------------------------------------------------------------

@query("f1_public_visibility", A(f"SELECT id, title FROM accidents WHERE {PUBLIC}"))
def f1(s, d):
    return acc(s, d).filter(R.is_public()).select("id", "title")


@query("f2_incident_family", A(f"SELECT id, category FROM accidents WHERE {INCIDENT}"))
def f2(s, d):
    return acc(s, d).filter(R.is_incident()).select("id", "category")


@query("f3_half_open_range", A(
    "SELECT id FROM accidents WHERE occurred_at >= TIMESTAMP '1998-01-01' AND occurred_at < TIMESTAMP '1998-02-01'"))
def f3(s, d):
    return acc(s, d).filter(R.between(F.lit("1998-01-01").cast("timestamp"), F.lit("1998-02-01").cast("timestamp"))).select("id")


@query("f4_inclusive_days", A(
    "SELECT id FROM accidents WHERE occurred_at >= TIMESTAMP '1998-03-01' AND occurred_at < TIMESTAMP '1998-03-11'"))
def f4(s, d):
    return acc(s, d).filter(R.within_days("1998-03-01", "1998-03-10")).select("id")


@query("f5_free_text", A(
    """SELECT a.id FROM accidents a JOIN municipalities m USING (municipality_id) WHERE contains(title, 'MACH')
       OR contains(summary, 'MACH') OR contains(body, 'MACH') OR contains(location_description, 'MACH')
       OR contains(m.name, 'MACH')""", "municipalities"))
def f5(s, d):
    rows = acc(s, d).join(view(s, d, "municipalities").drop("slug"), "municipality_id")
    return rows.filter(R.mentions(" MACH ", ("title", "summary", "body", "location_description", "name"))).select("id")


@query("f6_mention_guard", A(
    """SELECT a.id FROM accidents a JOIN municipalities m USING (municipality_id)
       WHERE m.municipality_id = 3 AND (contains(lower(title), lower(m.name)) OR contains(lower(summary), lower(m.name))
         OR contains(lower(body), lower(m.name)))""", "municipalities"))
def f6(s, d):
    rows = acc(s, d).filter("municipality_id = 3").join(view(s, d, "municipalities").drop("slug"), "municipality_id")
    return rows.filter(R.names_place(F.col("name"))).select("id")


@query("f7_category_list", A("SELECT id, category FROM accidents WHERE category IN ('RESCATE', 'CULTURA')"))
def f7(s, d):
    return acc(s, d).filter(R.category_in(["RESCATE", "CULTURA"])).select("id", "category")


@query("f8_request_filters", A(
    f"""SELECT id, vehicle_type FROM accidents WHERE {PUBLIC} AND vehicle_type = 'MOTO'
        AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL '365' DAY
        ORDER BY occurred_at DESC, id LIMIT 12 OFFSET 12"""))
def f8(s, d):
    p = R.parse_filters({"municipio": "nowhere", "vehicle": "MOTO", "categoria": "zzz", "desde": "365", "page": "2"})
    since = F.lit(AS_OF).cast("timestamp") - F.expr(f"interval {p['days_back']} days")
    rows = acc(s, d).filter(R.is_public() & (F.col("vehicle_type") == p["vehicle"]) & (F.col("occurred_at") >= since))
    return R.page(rows, p["take"], p["skip"]).select("id", "vehicle_type")


@query("f9_review_queue", A(
    "SELECT id, status FROM accidents WHERE NOT (duplicate_of_id IS NOT NULL AND status <> 'PUBLISHED')"))
def f9(s, d):
    return acc(s, d).filter(R.review_queue()).select("id", "status")


@query("f10_admin_list", A(
    """SELECT id FROM accidents WHERE status = 'PENDING_REVIEW' AND origin = 'AI'
       AND (contains(title, 'BUILD') OR contains(summary, 'BUILD'))"""))
def f10(s, d):
    return acc(s, d).filter((F.col("status") == "PENDING_REVIEW") & (F.col("origin") == "AI")
                            & R.mentions("BUILD", ("title", "summary"))).select("id")


@query("f11_user_search", """SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
       AND (contains(lower(c_name), lower('77')) OR contains(c_name, '77'))""")
def f11(s, d):
    from ..session import load
    u = load(s, d, "customer").filter("c_mktsegment = 'HOUSEHOLD'")
    return u.filter(F.lower("c_name").contains("77") | F.col("c_name").contains("77")).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("f12_api_rows", A(
    f"""SELECT a.id, a.slug, a.title, {sql_stamp('a.occurred_at', 'occurred_at')}, m.slug AS town_slug, m.name AS town_name
        FROM accidents a JOIN municipalities m USING (municipality_id) WHERE {PUBLIC}""", "municipalities"))
def f12(s, d):
    m = view(s, d, "municipalities").select("municipality_id", F.struct("slug", "name").alias("municipality"))
    rows = acc(s, d).filter(R.is_public()).join(m, "municipality_id")
    return rows.select("id", "slug", "title", stamp("occurred_at", "occurred_at"),
                       F.col("municipality.slug").alias("town_slug"), F.col("municipality.name").alias("town_name"))


@query("f13_family_partition", A(
    f"""SELECT category IN ({sql_list(L.INCIDENT_FAMILY)}) AS incident, count(*) AS n FROM accidents WHERE {PUBLIC} GROUP BY 1"""))
def f13(s, d):
    return acc(s, d).filter(R.is_public()).groupBy(
        F.col("category").isin(L.INCIDENT_FAMILY).alias("incident")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_lookback", A(
    f"""SELECT id FROM accidents WHERE published_at IS NULL OR
        (published_at >= TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL '90' MINUTE)"""))
def f14(s, d):
    return acc(s, d).filter(R.fresh_items(F.lit(AS_OF).cast("timestamp"))).select("id")


# --- joins --------------------------------------------------------------------------------------

@query("j1_foreign_key", A("SELECT a.id, m.name FROM accidents a JOIN municipalities m USING (municipality_id)", "municipalities"))
def j1(s, d):
    m = view(s, d, "municipalities").select(F.col("municipality_id").alias("_m"), "name")
    return R.with_dimension(acc(s, d), m, "municipality_id", "_m").select("id", "name")


_J2 = """SELECT m.slug, count(a.id) AS n FROM municipalities m LEFT JOIN accidents a
  ON a.municipality_id = m.municipality_id AND a.status = 'PUBLISHED' {dup} AND (contains(lower(a.title), m.slug)
  OR contains(lower(a.summary), m.slug) OR contains(lower(a.body), m.slug)) GROUP BY m.slug"""


def _guarded(s, d, exclude_duplicates):
    m = view(s, d, "municipalities").withColumnRenamed("municipality_id", "_m").withColumnRenamed("slug", "town")
    a = acc(s, d)
    on = (F.col("municipality_id") == F.col("_m")) & R.is_public(exclude_duplicates) & R.names_place(F.col("name"))
    return R.count_on(m, a, on, "town", "id").withColumnRenamed("town", "slug")


@query("j2_left_join_count", A(_J2.format(dup="AND a.duplicate_of_id IS NULL"), "municipalities"))
def j2(s, d):
    return _guarded(s, d, True)


@query("j3_exists", A(
    f"SELECT municipality_id FROM municipalities m WHERE EXISTS (SELECT 1 FROM accidents a WHERE a.municipality_id = m.municipality_id AND {INCIDENT})",
    "municipalities"))
def j3(s, d):
    return view(s, d, "municipalities").join(acc(s, d).filter(R.is_incident()), "municipality_id", "left_semi").select("municipality_id")


@query("j4_never_seen", with_views(
    """SELECT DISTINCT article_id FROM sources s WHERE NOT EXISTS
       (SELECT 1 FROM orders o WHERE o.o_orderkey = s.article_id AND o.o_orderstatus = 'F')""", "sources"))
def j4(s, d):
    from ..session import load
    known = load(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("article_id"))
    return view(s, d, "sources").select("article_id").join(known, "article_id", "left_anti").distinct()


@query("j6_children_per_parent", with_views(
    """SELECT article_id, rank, url FROM (SELECT article_id, url, row_number() OVER (PARTITION BY article_id
       ORDER BY published_at DESC, line) AS rank FROM sources) WHERE rank <= 3""", "sources"))
def j6(s, d):
    nested = R.children_top(view(s, d, "sources"), "article_id", [F.col("published_at").desc(), F.col("line")], 3, ["url"], "top")
    return nested.select("article_id", F.posexplode("top").alias("_p", "_s")).select(
        "article_id", (F.col("_p") + 1).alias("rank"), F.col("_s.url").alias("url"))


@query("j7_cluster_members", A(
    """SELECT c.id AS canonical_id, x.id AS member_id, n.n AS sources FROM accidents x JOIN accidents c
       ON x.duplicate_of_id = c.id LEFT JOIN (SELECT article_id, count(*) AS n FROM sources GROUP BY 1) n
       ON n.article_id = x.id""", "sources"))
def j7(s, d):
    a = acc(s, d)
    dup = a.filter("duplicate_of_id IS NOT NULL").select(F.col("id").alias("member_id"), "duplicate_of_id")
    pairs = dup.join(a.select(F.col("id").alias("canonical_id")), F.col("duplicate_of_id") == F.col("canonical_id"))
    n = view(s, d, "sources").groupBy("article_id").agg(F.count(F.lit(1)).alias("sources"))
    return pairs.join(n, pairs.member_id == n.article_id, "left").select("canonical_id", "member_id", "sources")


@query("j8_child_counts", A(
    """SELECT a.id, coalesce(n.n, 0) AS n FROM accidents a LEFT JOIN
       (SELECT article_id, count(*) AS n FROM sources GROUP BY 1) n ON n.article_id = a.id""", "sources"))
def j8(s, d):
    return R.child_counts(acc(s, d).select("id"), view(s, d, "sources"), "id", "article_id")


@query("j13_article_outlets", A(
    """SELECT a.id, coalesce(n.o, '') AS outlets FROM accidents a LEFT JOIN (SELECT article_id,
       string_agg(outlet, ', ' ORDER BY outlet) AS o FROM sources GROUP BY 1) n ON n.article_id = a.id""", "sources"))
def j13(s, d):
    n = view(s, d, "sources").groupBy("article_id").agg(
        F.array_join(F.sort_array(F.collect_list("outlet")), ", ").alias("o"))
    return acc(s, d).select("id").join(n, F.col("id") == F.col("article_id"), "left").select(
        "id", F.coalesce("o", F.lit("")).alias("outlets"))


_LABELS = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CATEGORY_LABEL.items() if k != "CULTURA") + " ELSE 'Otro' END"


@query("j14_label_default", A(f"SELECT id, {_LABELS} AS label FROM accidents"))
def j14(s, d):
    labels = {k: v for k, v in L.CATEGORY_LABEL.items() if k != "CULTURA"}
    return R.label_lookup(acc(s, d), "category", labels, "Otro", "label").select("id", "label")


@query("j15_comment_acceptance", """SELECT conv_id, turn, trim(text) AS body FROM conversations v
    WHERE length(trim(text)) > 0 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = v.conv_id AND o.o_orderstatus = 'F')""")
def j15(s, d):
    from ..session import load
    open_ids = load(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("conv_id"))
    c = load(s, d, "conversations").withColumn("body", F.trim("text"))
    return c.filter(F.char_length("body") > 0).join(open_ids, "conv_id", "left_semi").select("conv_id", "turn", "body")


# --- aggregates ---------------------------------------------------------------------------------

@query("a1_count_by_municipality", A(_J2.format(dup=""), "municipalities"))
def a1(s, d):
    return _guarded(s, d, False).orderBy(F.desc("n"), "slug")


@query("a2_count_by_zone", A(
    f"""SELECT z.zone, count(a.id) AS n FROM (SELECT DISTINCT c_mktsegment AS zone FROM customer) z
        LEFT JOIN accidents a ON a.zone = z.zone AND {PUBLIC} GROUP BY 1"""))
def a2(s, d):
    from ..session import load
    zones = load(s, d, "customer").select(F.col("c_mktsegment").alias("zone")).distinct()
    got = acc(s, d).filter(R.is_public() & F.col("zone").isNotNull()).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    return zones.join(got, "zone", "left").select("zone", F.coalesce("n", F.lit(0)).alias("n")).orderBy(
        F.desc("n"), F.expr("zone COLLATE es"))


@query("a3_headline_stats", A(
    f"""SELECT count(*) AS total, count(*) FILTER (occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL '24' HOUR) AS last_24h,
        count(DISTINCT municipality_id) AS municipalities FROM accidents WHERE {INCIDENT}"""))
def a3(s, d):
    return R.headline_stats(acc(s, d), F.lit(AS_OF).cast("timestamp"))


def _facet_sql(where, month=""):
    part = ("SELECT '{f}' AS facet, CAST({v} AS VARCHAR) AS value, count(*) AS n, CAST(coalesce(sum(injuries), 0) AS BIGINT) AS injuries, "
            "CAST(coalesce(sum(fatalities), 0) AS BIGINT) AS fatalities FROM r {g}")
    parts = [part.format(f="label", v="category", g="GROUP BY 2"), part.format(f="place", v="name", g="GROUP BY 2"),
             part.format(f="total", v="''", g="")]
    return (f"WITH r AS (SELECT a.*, m.name{month} FROM accidents a JOIN municipalities m USING (municipality_id) "
            f"WHERE {INCIDENT} AND {where}) " + " UNION ALL ".join(parts))


def _named(s, d):
    return acc(s, d).join(view(s, d, "municipalities").drop("slug"), "municipality_id")


@query("a4_weekly_summary", A(_facet_sql(
    "occurred_at >= TIMESTAMP '1998-06-01' AND occurred_at < TIMESTAMP '1998-06-08'"), "municipalities"))
def a4(s, d):
    return R.weekly_summary(_named(s, d), D.week_start(F.lit("1998-06-03").cast("timestamp")), "category", "name")


@query("a5_annual_summary", A(_facet_sql(
    "year(timezone('Atlantic/Canary', timezone('UTC', occurred_at))) = 1998",
    ", month(timezone('Atlantic/Canary', timezone('UTC', occurred_at))) AS m") +
    """ UNION ALL SELECT 'month', CAST(k.k AS VARCHAR), count(r.id), CAST(coalesce(sum(injuries), 0) AS BIGINT),
        CAST(coalesce(sum(fatalities), 0) AS BIGINT) FROM range(1, 13) k(k) LEFT JOIN r ON r.m = k.k GROUP BY 2""", "municipalities"))
def a5(s, d):
    return R.annual_summary(_named(s, d), 1998, "category", "name")


_WEEK = "occurred_at >= TIMESTAMP '1998-06-01' AND occurred_at < TIMESTAMP '1998-06-08'"
_YEAR = "year(timezone('Atlantic/Canary', timezone('UTC', occurred_at))) = 1998"
_PLACED = "SELECT facet, value, n, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value COLLATE es) AS position FROM ({}) WHERE facet IN ('label', 'place')"


@query("a4_weekly_order", A(_PLACED.format(_facet_sql(_WEEK)), "municipalities"))
def a4_order(s, d):
    per = R.weekly_summary(_named(s, d), D.week_start(F.lit("1998-06-03").cast("timestamp")), "category", "name")
    return R.ranked(per).select("facet", "value", "n", "position")


@query("a4_weekly_list", A(f"SELECT id, {sql_stamp('occurred_at', 'occurred_at')} FROM accidents WHERE {INCIDENT} AND {_WEEK}"))
def a4_list(s, d):
    return R.weekly_list(acc(s, d), D.week_start(F.lit("1998-06-03").cast("timestamp"))).select("id", stamp("occurred_at", "occurred_at"))


@query("a5_annual_order", A(_PLACED.format(_facet_sql(_YEAR)), "municipalities"))
def a5_order(s, d):
    return R.ranked(R.annual_summary(_named(s, d), 1998, "category", "name")).select("facet", "value", "n", "position")


@query("a5_annual_list", A(f"SELECT id FROM accidents WHERE {INCIDENT} AND {_YEAR} ORDER BY occurred_at DESC, id LIMIT 200"))
def a5_list(s, d):
    return R.annual_list(acc(s, d), 1998).select("id")


@query("a6_years_with_data", A(
    f"""SELECT DISTINCT year(timezone('Atlantic/Canary', timezone('UTC', occurred_at))) AS year FROM accidents
        WHERE {INCIDENT} ORDER BY 1 DESC LIMIT 6"""))
def a6(s, d):
    return R.years_with_data(acc(s, d))


@query("a7_weeks_with_data", A(
    f"SELECT DISTINCT strftime(date_trunc('week', occurred_at), '%Y-%m-%d %H:%M:%S') AS week FROM accidents WHERE {INCIDENT} ORDER BY 1 DESC LIMIT 12"))
def a7(s, d):
    return R.weeks_with_data(acc(s, d)).select(stamp("week", "week"))


@query("a8_counts_by_status", A(
    f"""SELECT k.status, count(a.id) AS n FROM (SELECT unnest([{sql_list(L.STATUSES)}]) AS status) k
        LEFT JOIN accidents a ON a.status = k.status GROUP BY 1"""))
def a8(s, d):
    return R.complete_counts(acc(s, d), "status", L.STATUSES).select("status", "n")


@query("a9_coverage_report", A(
    """SELECT 'status' AS facet, status AS value, count(*) AS n, count(lon) AS with_pin, count(published_at) AS dated FROM accidents GROUP BY 2
       UNION ALL SELECT 'origin', origin, count(*), count(lon), count(published_at) FROM accidents GROUP BY 2"""))
def a9(s, d):
    a = acc(s, d)
    return s.sql("""SELECT CASE WHEN grouping(status) = 0 THEN 'status' ELSE 'origin' END AS facet,
        coalesce(status, origin) AS value, count(*) AS n, count(lon) AS with_pin, count(published_at) AS dated
        FROM {a} GROUP BY GROUPING SETS ((status), (origin))""", a=a)


@query("a9_image_hash_coverage", with_views(
    """SELECT outlet, count(*) AS n, count(*) FILTER (contains(coalesce(html, ''), '<img')) AS with_image, count(*) FILTER (coalesce(body, '') <> '') AS with_hash
       FROM articles LEFT JOIN pages ON page_id = id GROUP BY 1""", "articles"))
def a9_coverage(s, d):
    """Articles whose page shows an image, and articles with a text to hash, by outlet."""
    from ..session import load
    shown = load(s, d, "pages").select(F.col("page_id").alias("id"), F.contains("html", F.lit("<img")).alias("image"))
    rows = view(s, d, "articles").select("id", "outlet", "body").join(shown, "id", "left")
    return rows.groupBy("outlet").agg(F.count(F.lit(1)).alias("n"), F.count_if("image").alias("with_image"),
                                      F.count_if(F.coalesce("body", F.lit("")) != "").alias("with_hash"))


@query("a9_last_runs", with_views(f"SELECT run_id, source, ok, items, {sql_stamp('started_at', 'started_at')} FROM runs ORDER BY runs.started_at DESC, run_id DESC LIMIT 5", "runs"))
def a9_runs(s, d):
    last = view(s, d, "runs").orderBy(F.desc("started_at"), F.desc("run_id")).limit(5)
    return last.select("run_id", "source", "ok", "items", stamp("started_at", "started_at"))


@query("a10_topic_menu", A(
    f"""SELECT category, count(*) AS n FROM accidents WHERE status = 'PUBLISHED' AND category IN ({sql_list(L.TOPIC_MENU)}) GROUP BY 1"""))
def a10(s, d):
    n = acc(s, d).filter(R.is_public(False)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return R.value_dim(s, L.TOPIC_MENU, "category").join(n, "category").orderBy("position").select("category", "n")


@query("a11_user_counters", """SELECT count(*) AS total, count(*) FILTER (c_mktsegment = 'MACHINERY') AS admins,
    count(*) FILTER (c_mktsegment <> 'MACHINERY') AS guests FROM customer""")
def a11(s, d):
    from ..session import load
    admin = F.col("c_mktsegment") == "MACHINERY"
    return load(s, d, "customer").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(admin).alias("admins"), F.count_if(~admin).alias("guests"))


@query("a15_merge_reconciliation", A(
    """SELECT c.id AS canonical_id, max(greatest(c.injuries, x.injuries)) AS injuries,
       max(greatest(c.fatalities, x.fatalities)) AS fatalities, count(*) AS merged
       FROM accidents x JOIN accidents c ON x.duplicate_of_id = c.id GROUP BY 1"""))
def a15(s, d):
    a = acc(s, d)
    x = a.filter("duplicate_of_id IS NOT NULL").groupBy("duplicate_of_id").agg(
        F.max("injuries").alias("_i"), F.max("fatalities").alias("_f"), F.count(F.lit(1)).alias("merged"))
    x = x.withColumnRenamed("duplicate_of_id", "_c")
    return a.join(x, F.col("id") == F.col("_c")).select(
        F.col("id").alias("canonical_id"), F.greatest("injuries", "_i").alias("injuries"),
        F.greatest("fatalities", "_f").alias("fatalities"), "merged")


@query("a16_freshness_probe", A(
    f"""SELECT count(*) FILTER (status = 'PENDING_REVIEW') AS pending, {sql_stamp('max(created_at)', 'last_cycle')},
        date_diff('second', max(created_at), TIMESTAMP '{AS_OF}') < 300 AS fresh FROM accidents"""))
def a16(s, d):
    return acc(s, d).agg(
        F.count_if(F.col("status") == "PENDING_REVIEW").alias("pending"), F.max("created_at").alias("_m")).select(
        "pending", stamp("_m", "last_cycle"),
        (F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.unix_seconds("_m") < 300).alias("fresh"))


@query("a17_unplaced_remainder", A(
    f"""SELECT (SELECT count(*) FROM accidents WHERE status = 'PUBLISHED') - (SELECT CAST(sum(n) AS BIGINT) FROM ({_J2.format(dup='')})) AS unplaced""",
    "municipalities"))
def a17(s, d):
    placed = _guarded(s, d, False).agg(F.sum("n").alias("n"))
    total = acc(s, d).filter(R.is_public(False)).agg(F.count(F.lit(1)).alias("t"))
    return s.sql("SELECT (SELECT t FROM {t}) - (SELECT n FROM {p}) AS unplaced", t=total, p=placed)


# --- windows ------------------------------------------------------------------------------------

@query("w1_featured_fallback", A(
    f"SELECT id FROM accidents WHERE {INCIDENT} ORDER BY is_featured DESC, occurred_at DESC, id LIMIT 1"))
def w1(s, d):
    return R.featured(acc(s, d)).select("id")


@query("w6_survivor", A(
    """SELECT cluster, id AS survivor FROM (SELECT coalesce(a.duplicate_of_id, a.id) AS cluster, a.id,
       row_number() OVER (PARTITION BY coalesce(a.duplicate_of_id, a.id) ORDER BY (a.duplicate_of_id IS NOT NULL),
       coalesce(n.n, 0) DESC, a.created_at, a.id) AS r FROM accidents a LEFT JOIN
       (SELECT article_id, count(*) AS n FROM sources GROUP BY 1) n ON n.article_id = a.id) WHERE r = 1""", "sources"))
def w6(s, d):
    from ..operators.cluster import survivors
    rows = R.child_counts(acc(s, d), view(s, d, "sources"), "id", "article_id", "n_sources")
    return survivors(rows.withColumn("cluster", F.coalesce("duplicate_of_id", "id")))


@query("w7_unique_slugs", A(
    r"""SELECT id, CASE WHEN n = 1 THEN root ELSE root || '-' || n END AS slug FROM (SELECT id, root,
        row_number() OVER (PARTITION BY root ORDER BY created_at, id) AS n FROM (SELECT id, created_at,
        left(regexp_replace(regexp_replace(lower(strip_accents(title || ' ' || category)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 90) AS root
        FROM accidents))"""))
def w7(s, d):
    rows = acc(s, d).select("id", "created_at", F.concat_ws(" ", "title", "category").alias("t"))
    return C.unique_slugs(rows, "t", ["created_at", "id"]).select("id", "slug")


@query("w7_slugs_with_stored", A(
    r"""WITH r AS (SELECT id, created_at, left(regexp_replace(regexp_replace(lower(strip_accents(title || ' ' || category)), '[^a-z0-9]+', '-', 'g'),
        '^-+|-+$', '', 'g'), 90) AS root FROM accidents), n AS (SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY created_at, id) AS n FROM r)
        SELECT id, CASE WHEN k = 1 THEN root ELSE root || '-' || k END AS slug FROM (SELECT id, root, CASE WHEN n < 2 + length(root) % 5 THEN n ELSE n + 1 END AS k FROM n)"""))
def w7_stored(s, d):
    """Every root has one numbered slug in store already."""
    rows = acc(s, d).select("id", "created_at", F.concat_ws(" ", "title", "category").alias("t"))
    root = slugify("t")
    stored = rows.select(F.concat(root, F.lit("-"), (F.length(root) % 5 + 2).cast("string")).alias("slug")).distinct()
    return C.unique_slugs(rows, "t", ["created_at", "id"], stored).select("id", "slug")


@query("w8_latest_change", with_views(
    """SELECT article_id, line FROM (SELECT article_id, line, row_number() OVER (PARTITION BY article_id
       ORDER BY published_at DESC, line DESC) AS r FROM sources) WHERE r = 1""", "sources"))
def w8(s, d):
    return R.best_by_change(view(s, d, "sources"), "article_id", [F.col("published_at").desc(), F.col("line").desc()]).select(
        "article_id", "line")


@query("w9_featured_unique", A(
    """SELECT id, id = (SELECT arg_max(id, (occurred_at, id)) FROM accidents WHERE is_featured) AS is_featured FROM accidents"""))
def w9(s, d):
    a = acc(s, d)
    marks = a.filter("is_featured").select(F.col("id").alias("article_id"), F.col("occurred_at").alias("changed_at"))
    return C.single_featured(a, marks).select("id", "is_featured")


@query("w10_bar_scale", A(
    """SELECT category, n, round(n / greatest(1, max(n) OVER ()), 6) AS bar FROM
       (SELECT category, count(*) AS n FROM accidents GROUP BY 1)"""))
def w10(s, d):
    n = acc(s, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return R.scaled_bars(n).select("category", "n", F.round("bar", 6).alias("bar"))


# --- lists ---------------------------------------------------------------------------------------

@query("l1_page", A(f"SELECT id FROM accidents WHERE {PUBLIC} ORDER BY occurred_at DESC, id LIMIT 60 OFFSET 120"))
def l1(s, d):
    return R.page(acc(s, d).filter(R.is_public()), 60, 120).select("id")


@query("l2_page_meta", A(
    f"""SELECT total, CAST(greatest(1, ceil(total / 12.0)) AS BIGINT) AS total_pages,
        CAST(greatest(1, least(3 - 2, greatest(1, ceil(total / 12.0)) - 4)) AS BIGINT) AS first_shown,
        CAST(least(greatest(1, ceil(total / 12.0)), greatest(1, least(3 - 2, greatest(1, ceil(total / 12.0)) - 4)) + 4) AS BIGINT) AS last_shown
        FROM (SELECT count(*) AS total FROM accidents WHERE {PUBLIC})"""))
def l2(s, d):
    n = acc(s, d).filter(R.is_public()).agg(F.count(F.lit(1)).alias("total"))
    return n.select("total", *R.page_meta(F.col("total"), F.lit(3)))


@query("l3_zone_listing", A(
    f"SELECT id FROM accidents WHERE {PUBLIC} AND zone = 'BUILDING' ORDER BY occurred_at DESC, id LIMIT 200"))
def l3(s, d):
    return R.newest(acc(s, d).filter(R.is_public() & (F.col("zone") == "BUILDING")), max(1, min(200, 500))).select("id")


@query("l4_map_points", A(
    f"""SELECT id, round(lat, 3) AS lat, round(lon, 3) AS lon FROM (SELECT * FROM accidents WHERE {INCIDENT}
        ORDER BY occurred_at DESC, id LIMIT 200) WHERE lat IS NOT NULL AND lon IS NOT NULL"""))
def l4(s, d):
    return R.map_points(acc(s, d)).select(
        "id", F.round(F.col("lat").cast("double"), 3).alias("lat"), F.round(F.col("lon").cast("double"), 3).alias("lon"))


@query("l5_related", A(
    f"""WITH p AS (SELECT id, municipality_id, vehicle_type, occurred_at FROM accidents WHERE {PUBLIC}),
        c AS (SELECT a.id, b.id AS related_id, b.occurred_at FROM p a JOIN p b ON a.municipality_id = b.municipality_id AND a.id <> b.id
        UNION SELECT a.id, b.id, b.occurred_at FROM p a JOIN p b ON a.vehicle_type = b.vehicle_type AND a.id <> b.id)
        SELECT id, rank, related_id FROM (SELECT id, related_id, row_number() OVER (PARTITION BY id
        ORDER BY occurred_at DESC, related_id) AS rank FROM c) WHERE rank <= 4"""))
def l5(s, d):
    return R.related(acc(s, d))


@query("l6_newest_per_source", with_views(
    """SELECT source, rank, run_id FROM (SELECT source, run_id, row_number() OVER (PARTITION BY source ORDER BY
       CASE WHEN ok THEN started_at ELSE TIMESTAMP '1970-01-01' END DESC, run_id) AS rank FROM runs) WHERE rank <= 25""", "runs"))
def l6(s, d):
    from ..sources.feeds import newest_per_source
    runs = view(s, d, "runs").withColumn("dated", F.when(F.col("ok"), F.col("started_at")))
    return newest_per_source(runs, 25, "source", "dated", "run_id").select("source", "rank", "run_id")


@query("j5_open_candidates", A(f"""SELECT a.id, count(b.id) AS candidates FROM accidents a LEFT JOIN accidents b ON b.id <> a.id AND b.duplicate_of_id IS NULL
    AND b.occurred_at BETWEEN a.occurred_at - INTERVAL {L.WINDOW_HOURS} HOUR AND a.occurred_at + INTERVAL {L.WINDOW_HOURS} HOUR GROUP BY a.id"""))
def j5_open(s, d):
    """Candidates of every incident in its window that are not duplicates themselves."""
    from ..operators.dedupe import window_counts
    rows = acc(s, d).select("id", F.col("occurred_at").alias("ts"), F.col("duplicate_of_id").isNull().alias("open"))
    return window_counts(rows, eligible="open")


@query("l7_spanish_order", """SELECT n_name AS name, row_number() OVER (ORDER BY n_name COLLATE es) AS position FROM nation""")
def l7(s, d):
    from ..session import load
    # The nation dimension is small by definition; its position needs one ordered task.
    n = load(s, d, "nation").select(F.col("n_name").alias("name"))
    return n.select("name", F.row_number().over(Window.orderBy(F.expr("name COLLATE es"))).alias("position"))


@query("l8_slug_lookup", A(f"SELECT id, title FROM accidents WHERE {PUBLIC} AND slug = 'suceso-12'"))
def l8(s, d):
    return acc(s, d).filter(R.is_public() & (F.col("slug") == "suceso-12")).select("id", "title")


# --- set operations -----------------------------------------------------------------------------

_MERGES = "(SELECT id AS duplicate_id, duplicate_of_id AS canonical_id FROM accidents WHERE duplicate_of_id IS NOT NULL AND duplicate_of_id <> id)"


def _merges(a):
    return a.filter("duplicate_of_id IS NOT NULL AND duplicate_of_id <> id").select(
        F.col("id").alias("duplicate_id"), F.col("duplicate_of_id").alias("canonical_id"))


@query("u1_union_of_sources", A(
    f"""WITH own AS (SELECT DISTINCT article_id, url FROM sources), moved AS (SELECT m.canonical_id AS article_id, s.url,
        min(m.duplicate_id) AS merged_from FROM own s JOIN {_MERGES} m ON s.article_id = m.duplicate_id GROUP BY 1, 2)
        SELECT article_id, url, NULL::BIGINT AS merged_from FROM own
        UNION ALL SELECT article_id, url, merged_from FROM moved WHERE (article_id, url) NOT IN (SELECT (article_id, url) FROM own)""",
    "sources"))
def u1(s, d):
    own = view(s, d, "sources").groupBy("article_id", "url").agg(F.min("outlet").alias("outlet"))
    return C.union_sources(own, _merges(acc(s, d))).select("article_id", "url", "merged_from")


@query("u4_catalog_diff", """SELECT coalesce(s.s_name, p.p_name) AS name, CASE WHEN s.s_name IS NULL THEN 'create'
    WHEN p.p_name IS NULL THEN 'undeclared' WHEN s.url <> p.url THEN CASE WHEN p.off AND s.en THEN 'reset_and_disable' ELSE 'reset' END
    WHEN p.off AND s.en THEN 'disable' ELSE 'keep' END AS action
    FROM (SELECT s_name, 'u' || (s_nationkey % 3) AS url, s_acctbal > 0 AS en FROM supplier) s FULL OUTER JOIN
    (SELECT 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS p_name, 'u' || (c_nationkey % 3) AS url, c_acctbal < 0 AS off FROM customer) p
    ON s.s_name = p.p_name""")
def u4(s, d):
    from ..session import load
    stored = load(s, d, "supplier").select(
        F.col("s_name").alias("name"), F.concat(F.lit("u"), (F.col("s_nationkey") % 3).cast("string")).alias("url"),
        (F.col("s_acctbal") > 0).alias("enabled"))
    declared = load(s, d, "customer").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit("u"), (F.col("c_nationkey") % 3).cast("string")).alias("url"),
        (F.col("c_acctbal") < 0).alias("force_disabled"))
    return C.catalog_diff(stored, declared)


# --- changes ---------------------------------------------------------------------------------------

_CHANGES = """(SELECT article_id, line, new_status FROM (SELECT l_orderkey AS article_id, l_linenumber AS line,
  CASE l_returnflag WHEN 'A' THEN 'PUBLISHED' WHEN 'R' THEN 'REJECTED' ELSE 'ARCHIVED' END AS new_status,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1)"""


def _changes(s, d):
    from ..session import load
    flag = F.col("l_returnflag")
    return load(s, d, "lineitem").select(
        F.col("l_orderkey").alias("article_id"), F.col("l_shipdate").alias("changed_at"),
        (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("change_id"), F.lit("editor").alias("editor"),
        F.when(flag == "A", "PUBLISHED").when(flag == "R", "REJECTED").otherwise("ARCHIVED").alias("new_status"))


@query("q11_status_batch", A(
    f"""SELECT a.id, CASE WHEN c.ok THEN c.new_status ELSE a.status END AS status,
        {sql_stamp("CASE WHEN c.ok AND c.new_status = 'PUBLISHED' THEN coalesce(a.published_at, TIMESTAMP '2002-01-01') ELSE a.published_at END", 'published_at')},
        CASE WHEN c.ok AND c.new_status <> 'PUBLISHED' THEN false ELSE a.is_featured END AS is_featured
        FROM accidents a LEFT JOIN (SELECT x.id, k.new_status, NOT (k.new_status = 'PUBLISHED' AND (x.duplicate_of_id IS NOT NULL
        OR x.status = 'ARCHIVED')) AS ok FROM accidents x JOIN {_CHANGES} k ON k.article_id = x.id) c ON c.id = a.id"""))
def q11(s, d):
    new, _ = C.status_changes(acc(s, d), _changes(s, d), F.lit("2002-01-01").cast("timestamp"))
    return new.select("id", "status", stamp("published_at", "published_at"), "is_featured")


@query("q11_refused_requests", A(
    f"""SELECT x.id, 'PUBLISHED' AS requested, CASE WHEN x.duplicate_of_id IS NOT NULL THEN 'fusionada' ELSE 'archivada' END AS reason
        FROM accidents x JOIN {_CHANGES} k ON k.article_id = x.id WHERE k.new_status = 'PUBLISHED'
        AND (x.duplicate_of_id IS NOT NULL OR x.status = 'ARCHIVED')"""))
def q11_refused(s, d):
    return C.status_changes(acc(s, d), _changes(s, d), F.lit("2002-01-01").cast("timestamp"))[1]


@query("q12_revision_snapshots", A(
    """SELECT id AS article_id, '{"title":"' || title || '","status":"' || status || '","injuries":' || injuries || '}' AS snapshot,
       'alta' AS note FROM accidents"""))
def q12(s, d):
    return C.snapshots(acc(s, d), "id", ["title", "status", "injuries"], F.lit("alta"))


@query("d8_merge_into_canonical", A(
    f"""SELECT a.id, greatest(a.fatalities, g.f) AS fatalities, greatest(a.injuries, g.i) AS injuries,
        CASE WHEN m.duplicate_id IS NOT NULL THEN 'REJECTED' ELSE a.status END AS status,
        CASE WHEN m.duplicate_id IS NOT NULL THEN false ELSE a.is_featured END AS is_featured
        FROM accidents a LEFT JOIN {_MERGES} m ON m.duplicate_id = a.id LEFT JOIN (SELECT n.canonical_id, max(x.fatalities) AS f,
        max(x.injuries) AS i FROM {_MERGES} n JOIN accidents x ON x.id = n.duplicate_id GROUP BY 1) g ON g.canonical_id = a.id"""))
def d8(s, d):
    a = acc(s, d)
    return C.merge_duplicates(a, _merges(a)).select("id", "fatalities", "injuries", "status", "is_featured")


@query("d11_duplicate_panel", A(
    """SELECT a.id, coalesce(n.n, 0) AS source_count FROM accidents a LEFT JOIN (SELECT article_id, count(*) AS n FROM sources GROUP BY 1) n
       ON n.article_id = a.id WHERE a.duplicate_of_id IS NOT NULL OR n.n > 0 ORDER BY a.created_at DESC, a.id LIMIT 20""", "sources"))
def d11(s, d):
    rows = R.child_counts(acc(s, d), view(s, d, "sources"), "id", "article_id", "source_count")
    return R.newest(rows.filter("duplicate_of_id IS NOT NULL OR source_count > 0"), 20, by="created_at").select("id", "source_count")


@query("q2_repeated_keys", with_views(
    "SELECT article_id, url, count(*) AS n FROM sources GROUP BY 1, 2 HAVING count(*) > 1", "sources"))
def q2(s, d):
    return C.repeated_keys(view(s, d, "sources"), ["article_id", "url"])


@query("e27_domain_coercion", A(
    """SELECT id, CASE WHEN status IN ('PUBLISHED', 'REJECTED') THEN status ELSE 'PENDING_REVIEW' END AS status,
       CASE WHEN vehicle_type IN ('COCHE', 'MOTO') THEN vehicle_type ELSE 'OTROS' END AS vehicle FROM accidents"""))
def e27(s, d):
    return acc(s, d).select("id", coerce("status", ["PUBLISHED", "REJECTED"], "PENDING_REVIEW").alias("status"),
                            coerce("vehicle_type", ["COCHE", "MOTO"], "OTROS").alias("vehicle"))


@query("s10_syndication", A(
    f"""WITH t AS (SELECT * FROM accidents WHERE status = 'PUBLISHED' ORDER BY published_at DESC, id LIMIT 50)
        SELECT t.id, t.title, t.summary AS description, {sql_stamp('coalesce(t.published_at, t.created_at)', 'date')},
        (SELECT string_agg(url, ' ' ORDER BY url) FROM (SELECT url FROM sources s WHERE s.article_id = t.id ORDER BY url LIMIT 3)) AS urls FROM t""",
    "sources"))
def s10(s, d):
    from ..sources.feeds import syndication
    src = view(s, d, "sources")
    images = src.filter("line < 200000000").select("article_id", F.concat("url", F.lit("/hero.webp")).alias("image_url"))
    out = syndication(acc(s, d).withColumn("excerpt", F.lit(None).cast("string")), src, images)
    return out.select("id", "title", "description", stamp("date", "date"), F.array_join("source_urls", " ").alias("urls"))


@query("s10_feed_file", A(
    f"""WITH t AS (SELECT * FROM accidents WHERE status = 'PUBLISHED' ORDER BY published_at DESC, id LIMIT 50)
        SELECT 'https://medio.example/noticias/' || slug AS url, title, summary, {sql_stamp('coalesce(published_at, created_at)', 'published_at')},
        (SELECT min(url) || '/hero.webp' FROM sources s WHERE s.article_id = t.id AND line < 200000000) AS image_url FROM t""",
    "sources"))
def s10_file(s, d):
    """The feed written as a file and read back by the feed parser."""
    from ..session import step_path
    from ..sources.feeds import parse_feeds, syndication, write_feed
    src = view(s, d, "sources")
    images = src.filter("line < 200000000").select("article_id", F.concat("url", F.lit("/hero.webp")).alias("image_url"))
    a = acc(s, d).withColumn("excerpt", F.lit(None).cast("string"))
    rows = syndication(a, src, images).join(a.select("id", "slug"), "id")
    path = step_path(s, "feed")
    write_feed(rows, path, "https://medio.example", "Sucesos")
    text = s.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.lit(1).alias("feed"))
    items, _ = parse_feeds(text, "payload", ["feed"])
    return items.select("url", "title", "summary", stamp("published_at", "published_at"), "image_url")


@query("s11_slug_export", A(f"SELECT slug, {sql_stamp('occurred_at', 'occurred_at')} FROM accidents WHERE {PUBLIC}"))
def s11(s, d):
    return acc(s, d).filter(R.is_public()).orderBy(F.desc("occurred_at"), "id").select("slug", stamp("occurred_at", "occurred_at"))


@query("s8_backfill", with_views(
    """SELECT source, rank, run_id FROM (SELECT source, run_id, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, run_id) AS rank
       FROM runs WHERE started_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') r LEFT JOIN
       (SELECT s_suppkey, CAST(20 + s_nationkey AS INT) AS cap FROM supplier) c ON c.s_suppkey = r.source WHERE rank <= coalesce(cap, 30)""", "runs"))
def s8(s, d):
    from ..session import load
    from ..sources.feeds import backfill
    caps = load(s, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_nationkey") + 20).alias("cap"))
    ts = lambda v: F.lit(v).cast("timestamp")
    return backfill(view(s, d, "runs"), ts("2024-01-05"), ts("2024-01-20"), caps, 30, "source", "started_at", "run_id").select(
        "source", "rank", "run_id")


@query("s12_dimension_upsert", """SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'stored_only'
    WHEN abs(n.v - o.v) > 0.0005 THEN 'update' ELSE 'keep' END AS action FROM
    (SELECT c_custkey AS k, round(c_acctbal) AS v FROM customer) n FULL OUTER JOIN (SELECT s_suppkey AS k, round(s_acctbal) AS v FROM supplier) o ON n.k = o.k""")
def s12(s, d):
    from ..session import load
    new = load(s, d, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal").alias("v"))
    old = load(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.round("s_acctbal").alias("v"))
    return C.upsert_plan(old, new, "k", ["v"]).select("k", "action")


@query("s12_key_renames", """WITH st AS (SELECT n_nationkey AS id, lower(n_name) AS k FROM nation),
    rn AS (SELECT lower(n_name) AS o, CASE WHEN n_nationkey % 5 = 0 THEN (SELECT lower(b.n_name) FROM nation b WHERE b.n_nationkey = nation.n_nationkey + 1)
      WHEN n_nationkey % 5 = 1 THEN lower(n_name) || '-nuevo' ELSE 'comun' END AS k, n_nationkey AS seq FROM nation WHERE n_nationkey % 5 < 3),
    op AS (SELECT rn.k, arg_min(o, seq) AS o FROM rn WHERE k NOT IN (SELECT k FROM st) GROUP BY 1)
    SELECT st.id, coalesce(op.k, st.k) AS k, CASE WHEN op.k IS NOT NULL THEN 'renamed' WHEN rn.o IS NOT NULL THEN 'kept' ELSE 'same' END AS action
    FROM st LEFT JOIN op ON op.o = st.k LEFT JOIN rn ON rn.o = st.k""")
def s12_renames(s, d):
    """Some nations get a key that exists, some one of their own, some all the same."""
    from ..session import load
    n = load(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("k"))
    behind = n.select((F.col("id") - 1).alias("id"), F.col("k").alias("next"))
    new = F.when(F.col("id") % 5 == 0, F.col("next")).when(F.col("id") % 5 == 1, F.concat("k", F.lit("-nuevo"))).otherwise("comun")
    renames = n.filter("id % 5 < 3").join(behind, "id", "left").select(F.col("k").alias("old_key"), new.alias("new_key"), F.col("id").alias("seq"))
    return C.rename_keys(n, renames, "k").select("id", "k", "action")
