"""Facts, gates, dates, geography, verification and publication over derived wire text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D, facts as X, geo as G, quality as K, text as T
from ..operators.ingest import text_scores, verified
from ..rules import lexicon as L
from ..functions.wordlist import digest
from ..rules.places import MUNICIPALITIES, ZONES
from ..session import load
from . import sqltext as Q
from .bindings import spread, sql_list, view, with_views
from .catalog_reports import acc, sql_stamp, stamp
from .registry import query

AS_OF = "2001-07-15 12:00:00"

# --- SQL twins ------------------------------------------------------------------------------

_NUM = "CASE h " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.NUMBER_WORDS.items()) + " ELSE TRY_CAST(h AS INT) END"


def _counted(text, pattern):
    hits = f"regexp_extract_all({text}, {Q.lit(pattern)}, 1)"
    return f"CASE WHEN len({hits}) > 0 THEN CAST(list_sum(list_transform({hits}, lambda h: {_NUM})) AS INT) END"


_HURT = (f"CASE WHEN regexp_matches(c, {Q.lit(L.NO_INJURY)}) THEN 0 ELSE coalesce({_counted('c', L.INJURY_COUNT)}, "
         f"CASE WHEN regexp_matches(c, {Q.lit(L.INJURY_BARE)}) THEN 1 END) END")
_DEAD = f"coalesce({_counted('c', L.DEATH_COUNT)}, CASE WHEN regexp_matches(c, {Q.lit(L.DEATH_BARE)}) THEN 1 END)"


def _cat(text, rules=X.CategoryRules()):
    strong = f"regexp_matches({text}, {Q.lit(rules.strong)})"
    inc, early, topic = (Q.rule_case(text, r) for r in (rules.incident, rules.early, rules.topics))
    return f"coalesce(CASE WHEN {strong} THEN {inc} END, {early}, CASE WHEN NOT {strong} THEN {inc} END, {topic})"


def _place(text, part):
    idx = {"municipality": 1, "zone": 2, "area": 3}[part]
    whens = " ".join(
        f"WHEN {Q.has_term(text, t[0])} THEN " + ("NULL" if t[idx] is None else Q.lit(t[idx])) for t in X.place_terms())
    return f"CASE {whens} END"


def _place_of(part):
    hit = " OR ".join(Q.has_term("pt", t[0]) for t in X.place_terms())
    return f"CASE WHEN {hit} THEN {_place('pt', part)} ELSE {_place('pb', part)} END"


_WEIGHT = " + ".join(
    f"CASE WHEN {Q.has_term('pt', w)} THEN {2 * n} WHEN {Q.has_term('pb', w)} THEN {n} ELSE 0 END" for w, n in L.RELEVANCE)
_MATCHED = "list_filter([" + ", ".join(
    f"CASE WHEN {Q.has_term('pt', w)} OR {Q.has_term('pb', w)} THEN '{w}' END" for w, _ in L.RELEVANCE) + "], lambda x: x IS NOT NULL)"
_ROAD = (f"CASE WHEN len(list_filter(list_transform(regexp_extract_all(c, {Q.lit(L.ROAD)}, 1), lambda n: CAST(n AS INT)), lambda n: n BETWEEN 1 AND 999)) > 0 "
         f"THEN 'LZ-' || list_min(list_filter(list_transform(regexp_extract_all(c, {Q.lit(L.ROAD)}, 1), lambda n: CAST(n AS INT)), lambda n: n BETWEEN 1 AND 999)) END")
_SEV = (f"CASE WHEN dead > 0 THEN 'GRAVE' ELSE coalesce({Q.rule_case('c', L.SEVERITY_WORDS)}, "
        f"CASE WHEN dead = 0 OR hurt = 0 THEN 'LEVE' WHEN hurt >= 3 THEN 'MODERADO' END) END")
_CLOCK_H = f"regexp_extract(raw, {Q.lit(L.TIME_OF_DAY)}, 1)"
_CLOCK_M = f"coalesce(TRY_CAST(regexp_extract(raw, {Q.lit(L.TIME_OF_DAY)}, 2) AS INT), 0)"
_CLOCK = (f"CASE WHEN {_CLOCK_H} <> '' AND TRY_CAST({_CLOCK_H} AS INT) <= 23 AND {_CLOCK_M} <= 59 "
          f"THEN lpad({_CLOCK_H}, 2, '0') || ':' || lpad(CAST({_CLOCK_M} AS VARCHAR), 2, '0') END")
_OUT = " OR ".join(Q.has_term("pc", t) for t in L.OTHER_ISLANDS)

NORMED = f"""n0 AS (SELECT *, {Q.norm('title')} AS t, {Q.norm('body')} AS b, strip_accents(lower(title || ' ' || body)) AS raw FROM wire),
  n AS (SELECT *, t || ' ' || b AS c, ' ' || t || ' ' AS pt, ' ' || b || ' ' AS pb, ' ' || t || ' ' || b || ' ' AS pc FROM n0),
  f0 AS (SELECT *, {_HURT} AS hurt, {_DEAD} AS dead, {_WEIGHT} AS weight, {_cat('c')} AS cat FROM n),
  f1 AS (SELECT *, (weight > 0 OR cat IS NOT NULL) AS seen FROM f0),
  f AS (SELECT id, title, summary, body, occurred_at, price, flag, source, t, b, c, pt, pb, pc, raw, weight, CASE WHEN seen THEN hurt END AS injuries, CASE WHEN seen THEN dead END AS fatalities,
    cat AS category, CASE WHEN seen THEN {_SEV} END AS severity, CASE WHEN seen THEN {Q.rule_case('c', L.VEHICLE_RULES)} END AS vehicle,
    CASE WHEN seen THEN {_place_of('municipality')} END AS municipality, CASE WHEN seen THEN {_place_of('zone')} END AS zone,
    CASE WHEN seen THEN {_place_of('area')} END AS area, CASE WHEN seen THEN {_ROAD} END AS road,
    CASE WHEN seen THEN {_CLOCK} END AS time_of_day, seen AND ({_OUT}) AS outside,
    CASE WHEN seen THEN {_MATCHED} ELSE [] END AS matched FROM f1)"""


def W(select):
    return with_views(f"WITH {NORMED} {select}", "wire")


def facts(s, d):
    return X.with_shared_facts(view(s, d, "wire"), "title", "body")


@query("x1_injuries", W("SELECT id, injuries FROM f"))
def x1(s, d):
    return facts(s, d).select("id", "facts.injuries")


@query("x2_fatalities", W("SELECT id, fatalities FROM f"))
def x2(s, d):
    return facts(s, d).select("id", "facts.fatalities")


@query("x3_place", W("SELECT id, municipality, zone, area FROM f"))
def x3(s, d):
    return facts(s, d).select("id", "facts.municipality", "facts.zone", "facts.area")


@query("x4_road", W("SELECT id, road FROM f"))
def x4(s, d):
    return facts(s, d).select("id", "facts.road")


@query("x5_category", W("SELECT id, category FROM f"))
def x5(s, d):
    return facts(s, d).select("id", "facts.category")


#: Rules of another kind of text, to sort the documents themselves: abuse first, then the language of the small words.
DOCUMENT_RULES = X.CategoryRules(
    strong=r"\b(?:scum|worthless|pathetic)",
    incident=(("ABUSE", r"\b(?:idiot|stupid|clown|loser|scum|worthless|pathetic)\b"),),
    early=(("LICENSE", r"\b(?:license|licensed|copyright)\b"),),
    topics=(("DE", r"\b(?:und|das|nicht)\b"), ("FR", r"\b(?:avec|une|est)\b"), ("ES", r"\b(?:los|del|una)\b"), ("EN", r"\b(?:the|and|that)\b")))


@query("x5_category_documents", f"SELECT doc_id, {_cat('t', DOCUMENT_RULES)} AS category FROM (SELECT doc_id, {Q.norm('text')} AS t FROM documents)")
def x5_documents(s, d):
    """Whole documents under a rule table of their own."""
    t = load(s, d, "documents").select("doc_id", T.norm("text").alias("t"))
    return t.select("doc_id", X.category("t", "t", DOCUMENT_RULES).alias("category"))


@query("x6_vehicle", W("SELECT id, vehicle FROM f"))
def x6(s, d):
    return facts(s, d).select("id", "facts.vehicle")


@query("x7_severity", W("SELECT id, severity FROM f"))
def x7(s, d):
    return facts(s, d).select("id", "facts.severity")


@query("x8_time_of_day", W("SELECT id, time_of_day FROM f"))
def x8(s, d):
    return facts(s, d).select("id", "facts.time_of_day")


@query("x9_other_region", W("SELECT id, outside FROM f"))
def x9(s, d):
    return facts(s, d).select("id", "facts.outside")


@query("x10_relevance", W("SELECT id, round(least(1.0, weight / 8.0), 6) AS relevance, array_to_string(matched, ',') AS matched FROM f"))
def x10(s, d):
    return facts(s, d).select("id", F.round("relevance", 6).alias("relevance"), F.array_join("facts.matched", ",").alias("matched"))


@query("x11_fact_struct", W("""SELECT id, injuries, fatalities, category, severity, vehicle, municipality, zone, road, time_of_day, outside,
    len(matched) AS matched FROM f"""))
def x11(s, d):
    return facts(s, d).select("id", *[f"facts.{c}" for c in (
        "injuries", "fatalities", "category", "severity", "vehicle", "municipality", "zone", "road", "time_of_day", "outside")],
        F.size("facts.matched").alias("matched"))


_LOCAL = X.local_terms()
_LOCAL_HIT = "CASE " + " ".join(f"WHEN {Q.has_term('pc', t)} THEN {Q.lit(t)}" for t in _LOCAL) + " END"
_CITY_HIT = "CASE " + " ".join(f"WHEN {Q.has_term('pc', t)} THEN {Q.lit(t)}" for t in L.MAINLAND_CITIES) + " END"
_SCOPE = (f"CASE WHEN {_LOCAL_HIT} IS NOT NULL THEN 'menciona ' || {_LOCAL_HIT} WHEN regexp_matches(c, {Q.lit(L.LOCAL_ROAD)}) THEN 'menciona una carretera de la isla' "
          f"WHEN {_CITY_HIT} IS NOT NULL THEN 'menciona ' || {_CITY_HIT} || ', fuera de la isla' ELSE 'sin mencion local' END")
_IN_SCOPE = f"({_LOCAL_HIT} IS NOT NULL OR regexp_matches(c, {Q.lit(L.LOCAL_ROAD)}))"


@query("x12_scope_gate", W(f"SELECT id, {_IN_SCOPE} AS local, {_SCOPE} AS reason FROM n"))
def x12(s, d):
    w = spread(view(s, d, "wire")).select("id", F.concat_ws(" ", T.norm("title"), T.norm("body")).alias("c"))
    return w.withColumn("h", digest("c")).withColumn("g", X.scope_gate("c", "h")).select("id", "g.local", "g.reason")


def _roots(roots):
    return "[" + ", ".join(
        f"CASE WHEN regexp_matches(pc, ' {r}[a-z0-9]{{0,{L.ROOT_SLACK}}} ') THEN '{r}' END" for r in roots) + "]"


def _kept(lists):
    return f"list_filter({lists}, lambda x: x IS NOT NULL)"


_EV = f"list_concat({_kept(_roots(L.EVENT_ROOTS))}, list_filter([{sql_list(L.EVENT_PHRASES)}], lambda p: contains(pc, ' ' || p || ' ')))"
_FI = _kept(_roots(L.FIRE_ROOTS))
_VE = (f"list_concat({_kept(_roots(L.VEHICLE_ROOTS))}, list_concat(list_filter(string_split(c, ' '), lambda w: w IN ({sql_list(L.VEHICLE_WORDS)})), "
       f"CASE WHEN regexp_matches(c, {Q.lit(L.GATE_ROAD)}) THEN ['carretera-lz'] ELSE [] END))")
GATE = f"g AS (SELECT *, {_EV} AS ev, {_FI} AS fi, {_VE} AS ve FROM n)"


@query("x13_traffic_gate", with_views(f"""WITH {NORMED}, {GATE} SELECT id, (len(ev) > 0 OR len(fi) > 0) AND len(ve) > 0 AS accident,
    array_to_string(CASE WHEN len(ev) > 0 AND len(ve) > 0 THEN ev WHEN len(fi) > 0 AND len(ve) > 0 THEN list_concat(ev, fi)
    WHEN len(ev) = 0 AND len(fi) > 0 THEN fi ELSE ev END, ',') AS events, array_to_string(ve, ',') AS vehicles FROM g""", "wire"))
def x13(s, d):
    w = spread(view(s, d, "wire")).select("id", F.concat_ws(" ", T.norm("title"), T.norm("body")).alias("c"))
    return w.withColumn("h", digest("c")).withColumn("g", X.traffic_gate("c", "h")).select(
        "id", "g.accident", F.array_join("g.events", ",").alias("events"), F.array_join("g.vehicles", ",").alias("vehicles"))


_RESOLVED = f"""r0 AS (SELECT id, cat0, t || ' ' || {Q.norm("title || ' ' || summary || ' ' || body")} AS c FROM (SELECT *, NULL AS cat0 FROM n)),
    r1 AS (SELECT *, ' ' || c || ' ' AS pc FROM r0), r2 AS (SELECT *, {_EV} AS ev, {_FI} AS fi, {_VE} AS ve FROM r1)"""


@query("x14_resolved_category", with_views(f"""WITH {NORMED}, {_RESOLVED} SELECT id, coalesce({_cat('c')},
    CASE WHEN (len(ev) > 0 OR len(fi) > 0) AND len(ve) > 0 THEN 'ACCIDENTE_TRAFICO' END, 'OTRO') AS category FROM r2""", "wire"))
def x14(s, d):
    w = spread(view(s, d, "wire"))
    return X.with_resolved_category(w, F.lit(None).cast("string"), "title", "summary", "body").select("id", "category")


@query("x15_family", W(f"SELECT CASE WHEN category IN ({sql_list(L.INCIDENT_FAMILY)}) THEN 'suceso' ELSE 'informacion' END AS family, count(*) AS n FROM f GROUP BY 1"))
def x15(s, d):
    return facts(s, d).groupBy(X.family("facts.category").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("x16_reclassification", W(f"""SELECT old, outcome, count(*) AS n FROM (SELECT CASE flag WHEN 'F' THEN 'ACCIDENTE_TRAFICO' ELSE 'POLITICA' END AS old,
    CASE WHEN NOT {_IN_SCOPE} THEN 'fuera' WHEN coalesce(category, 'OTRO') <> CASE flag WHEN 'F' THEN 'ACCIDENTE_TRAFICO' ELSE 'POLITICA' END
    THEN coalesce(category, 'OTRO') ELSE 'sin cambio' END AS outcome FROM f) GROUP BY 1, 2"""))
def x16(s, d):
    old = F.when(F.col("flag") == "F", "ACCIDENTE_TRAFICO").otherwise("POLITICA")
    r = facts(s, d).withColumn("old", old).withColumn("new", F.coalesce("facts.category", F.lit("OTRO"))).withColumn("g", X.scope_gate("_c", "_h"))
    outcome = F.when(~F.col("g.local"), "fuera").when(F.col("new") != F.col("old"), F.col("new")).otherwise("sin cambio")
    return r.groupBy("old", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("j9_place_terms", with_views(f"""WITH {NORMED}, k AS (SELECT * FROM (VALUES {', '.join(
    f"({i}, {Q.lit(t[0])}, {Q.lit(t[1])})" for i, t in enumerate(X.place_terms()))}) v(rank, term, municipality))
    SELECT id, arg_min(term, rank) AS term, arg_min(municipality, rank) AS municipality FROM n JOIN k ON contains(pc, ' ' || term || ' ') GROUP BY 1""", "wire"))
def j9(s, d):
    """Theta join as an equi join: word 1- to 4-grams of the text meet the term table."""
    w = spread(view(s, d, "wire")).select("id", T.words(F.concat_ws(" ", T.norm("title"), T.norm("body"))).alias("w"))
    grams = F.flatten(F.array(*[T.ngrams("w", n) for n in (1, 2, 3, 4)]))
    terms = s.createDataFrame([(i, t[0], t[1]) for i, t in enumerate(X.place_terms())], "rank int, term string, municipality string")
    hits = w.select("id", F.explode(F.array_distinct(grams)).alias("term")).join(F.broadcast(terms), "term")
    return hits.groupBy("id").agg(F.min_by("term", "rank").alias("term"), F.min_by("municipality", "rank").alias("municipality"))


# --- dates ------------------------------------------------------------------------------------

@query("e1_date_parsing", f"""SELECT o_orderkey, {sql_stamp('CASE k WHEN 2 THEN date_trunc(\'day\', o_orderdate) WHEN 3 THEN CASE WHEN day(o_orderdate) > 12 THEN o_orderdate + INTERVAL 12 HOUR END WHEN 4 THEN NULL ELSE o_orderdate END', 'parsed')},
    CASE k WHEN 0 THEN 'certain' WHEN 1 THEN 'certain' WHEN 2 THEN 'likely' WHEN 3 THEN CASE WHEN day(o_orderdate) > 12 THEN 'certain' END WHEN 5 THEN 'likely' END AS confidence
    FROM (SELECT *, o_orderkey % 6 AS k FROM orders)""")
def e1(s, d):
    o = load(s, d, "orders")
    raw = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
        WHEN 1 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd')
        WHEN 3 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN 4 THEN 'hace poco' ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm') END""")
    p = o.select("o_orderkey", raw.alias("raw")).withColumn("p", D.parse_source_date("raw"))
    return p.select("o_orderkey", stamp("p.date", "parsed"), F.col("p.confidence").alias("confidence"))


_TS = f"TIMESTAMP '{AS_OF}'"


@query("e2_date_validation", with_views(f"""SELECT id, CASE WHEN year(occurred_at) < 2000 THEN 'imposible' WHEN occurred_at > {_TS} + INTERVAL 90 MINUTE THEN 'futura' WHEN occurred_at > {_TS} THEN NULL
    WHEN occurred_at < {_TS} - INTERVAL 30 DAY THEN 'muy-antigua' END AS problem, {sql_stamp(f"CASE WHEN occurred_at > {_TS} + INTERVAL 90 MINUTE OR occurred_at < {_TS} - INTERVAL 30 DAY THEN NULL ELSE least(occurred_at, {_TS}) END", 'corrected')} FROM accidents""", "accidents"))
def e2(s, d):
    v = acc(s, d).withColumn("v", D.validate_date("occurred_at", F.lit(AS_OF).cast("timestamp")))
    return v.select("id", "v.problem", stamp("v.corrected", "corrected"))


_CANARY = "timezone('UTC', timezone('Atlantic/Canary', {0}))"


@query("e3_occurrence_time", W(f"""SELECT id, {sql_stamp("CASE WHEN time_of_day IS NULL THEN occurred_at ELSE " + _CANARY.format("CAST(strftime(occurred_at, '%Y-%m-%d') || ' ' || time_of_day || ':00' AS TIMESTAMP)") + " END", 'resolved')} FROM f"""))
def e3(s, d):
    r = facts(s, d).withColumn("r", D.resolve_occurred("occurred_at", F.lit(None).cast("timestamp"), "facts.time_of_day", F.lit(AS_OF).cast("timestamp")))
    return r.select("id", stamp("r", "resolved"))


@query("e4_local_to_utc", with_views(f"SELECT id, {sql_stamp(_CANARY.format('occurred_at'), 'utc')} FROM accidents", "accidents"))
def e4(s, d):
    return acc(s, d).select("id", stamp(D.local_to_utc("occurred_at"), "utc"))


@query("e5_utc_to_local", with_views("""SELECT id, year(l) AS year, month(l) AS month, strftime(l, '%Y-%m-%d') AS day FROM
    (SELECT id, timezone('Atlantic/Canary', timezone('UTC', occurred_at)) AS l FROM accidents)""", "accidents"))
def e5(s, d):
    return acc(s, d).select("id", D.utc_to_local("occurred_at").alias("l")).select(
        "id", F.year("l").alias("year"), F.month("l").alias("month"), F.date_format("l", "yyyy-MM-dd").alias("day"))


@query("e6_year_window", f"""SELECT y, {sql_stamp(_CANARY.format('make_timestamp(y, 1, 1, 0, 0, 0)'), 'start')}, {sql_stamp(_CANARY.format('make_timestamp(y + 1, 1, 1, 0, 0, 0)'), 'finish')},
    {_CANARY.format('make_timestamp(y + 1, 1, 1, 0, 0, 0)')} <= {_TS} AS closed FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)""")
def e6(s, d):
    y = load(s, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    lo, hi = D.year_window("y")
    return y.select("y", stamp(lo, "start"), stamp(hi, "finish"), D.year_closed("y", F.lit(AS_OF).cast("timestamp")).alias("closed"))


@query("e7_week_start", with_views(f"SELECT id, {sql_stamp('date_trunc(\'week\', occurred_at)', 'week')} FROM accidents", "accidents"))
def e7(s, d):
    return acc(s, d).select("id", stamp(D.week_start("occurred_at"), "week"))


@query("e8_relative_time", with_views(f"""WITH m AS (SELECT id, CAST(floor(date_diff('microsecond', occurred_at, {_TS} + INTERVAL 40 DAY) / 60000000.0) AS BIGINT) AS mins FROM accidents),
    h AS (SELECT id, mins, mins // 60 AS hrs, (mins // 60) // 24 AS dy FROM m)
    SELECT id, CASE WHEN mins < 1 THEN 'ahora mismo' WHEN mins < 60 THEN 'hace ' || mins || ' min' WHEN hrs < 24 THEN 'hace ' || hrs || ' h'
    WHEN dy = 1 THEN 'ayer' WHEN dy < 30 THEN 'hace ' || dy || ' días' WHEN dy // 30 < 12 THEN 'hace ' || (dy // 30) || CASE WHEN dy // 30 = 1 THEN ' mes' ELSE ' meses' END
    ELSE 'hace ' || (dy // 365) || CASE WHEN dy // 365 = 1 THEN ' año' ELSE ' años' END END AS ago FROM h""", "accidents"))
def e8(s, d):
    now = F.lit(AS_OF).cast("timestamp") + F.expr("interval 40 days")
    return acc(s, d).select("id", D.relative_time("occurred_at", now).alias("ago"))


@query("e9_part_of_day", with_views("""SELECT part, count(*) AS n FROM (SELECT CASE WHEN h >= 6 AND h < 12 THEN 'esta mañana' WHEN h >= 12 AND h < 15 THEN 'a mediodía'
    WHEN h >= 15 AND h < 21 THEN 'esta tarde' WHEN h >= 21 THEN 'esta noche' ELSE 'de madrugada' END AS part FROM
    (SELECT hour(timezone('Atlantic/Canary', timezone('UTC', occurred_at))) AS h FROM accidents)) GROUP BY 1""", "accidents"))
def e9(s, d):
    part = D.part_of_day(F.hour(D.utc_to_local("occurred_at")))
    return acc(s, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


# --- geography ---------------------------------------------------------------------------------

_HAV = ("2 * 6371 * asin(sqrt(pow(sin((radians({3}) - radians({1})) / 2), 2) * cos(radians({0})) * cos(radians({2})) + pow(sin((radians({2}) - radians({0})) / 2), 2)))")
_MUNI = ", ".join(f"({Q.lit(a)}, {la}, {lo})" for a, _, la, lo in MUNICIPALITIES)
_ZONE = ", ".join(f"({Q.lit(z)}, {Q.lit(m)}, {la}, {lo})" for z, _, m, la, lo, _ in ZONES)
# Places and pins per order, the zone sometimes unknown or of another municipality.
_PINS = f"""pins AS (SELECT o_orderkey AS id, list_extract([{sql_list([m[0] for m in MUNICIPALITIES])}, 'otro'], CAST(o_custkey % 8 + 1 AS BIGINT)) AS municipality,
    list_extract([{sql_list([z[0] for z in ZONES])}, 'nada'], CAST(o_orderkey % {len(ZONES) + 1} + 1 AS BIGINT)) AS zone,
    CASE WHEN o_totalprice > 60000 THEN 28.85 + (o_custkey % 40) / 100.0 END AS lat, -13.85 + (o_orderkey % 40) / 100.0 AS lon FROM orders),
  mu AS (SELECT * FROM (VALUES {_MUNI}) v(m, mlat, mlon)), zo AS (SELECT * FROM (VALUES {_ZONE}) v(z, zm, zlat, zlon)),
  ref AS (SELECT p.*, coalesce(zlat, mlat) AS ref_lat, coalesce(zlon, mlon) AS ref_lon, z IS NOT NULL AS zone_ok FROM pins p
    LEFT JOIN zo ON p.zone = z AND p.municipality = zm LEFT JOIN mu ON p.municipality = m)"""


def _pins(s, d):
    o = load(s, d, "orders")
    towns = F.array(*[F.lit(m[0]) for m in MUNICIPALITIES], F.lit("otro"))
    zones = F.array(*[F.lit(z[0]) for z in ZONES], F.lit("nada"))
    pins = o.select(
        F.col("o_orderkey").alias("id"), F.get(towns, F.col("o_custkey") % 8).alias("municipality"),
        F.get(zones, F.col("o_orderkey") % (len(ZONES) + 1)).alias("zone"),
        F.when(F.col("o_totalprice") > 60000, 28.85 + (F.col("o_custkey") % 40) / 100.0).alias("lat"),
        (-13.85 + (F.col("o_orderkey") % 40) / 100.0).alias("lon"))
    return G.with_reference_point(pins)


@query("e20_haversine", f"SELECT c_custkey AS id, round({_HAV.format('28.9 + c_nationkey / 100.0', '-13.6', '29.0', '-13.5 - c_custkey % 100 / 1000.0')}, 6) AS km FROM customer")
def e20(s, d):
    c = load(s, d, "customer")
    km = G.haversine_km(28.9 + F.col("c_nationkey") / 100.0, F.lit(-13.6), F.lit(29.0), -13.5 - (F.col("c_custkey") % 100) / 1000.0)
    return c.select(F.col("c_custkey").alias("id"), F.round(km, 6).alias("km"))


@query("e21_reference_point", f"WITH {_PINS} SELECT id, CAST(ref_lat AS DOUBLE) AS ref_lat, CAST(ref_lon AS DOUBLE) AS ref_lon, zone_ok FROM ref")
def e21(s, d):
    return _pins(s, d).select("id", "ref_lat", "ref_lon", "zone_ok")


# A coarse outline for the queries; a deployment passes the real rings.
OUTLINE = [[(28.84, -13.88), (28.84, -13.70), (28.90, -13.45), (29.10, -13.42), (29.25, -13.44), (29.20, -13.52), (29.12, -13.68), (29.05, -13.80), (28.95, -13.86)]]


def _unit(salt):
    """The generator of ``geo.displaced`` in SQL."""
    m = G.MODULUS
    x1 = f"(((id % {m}) * 48271 + i * 69621 + {salt} * 16807 + 1) % {m})"
    x2 = f"(({x1} * {x1} + 11) % {m})"
    return f"((({x2} * 48271 + {x1}) % {m}) / {m}.0)"


_RING = ", ".join(f"({ay!r}::DOUBLE, {ax!r}::DOUBLE, {by!r}::DOUBLE, {bx!r}::DOUBLE)" for ring in OUTLINE
                  for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1]))


@query("e22_pin_displacement", f"""WITH {_PINS}, ed AS (SELECT * FROM (VALUES {_RING}) v(ay, ax, b_y, bx)),
  tr AS (SELECT id, CAST(ref_lat AS DOUBLE) AS lat0, CAST(ref_lon AS DOUBLE) AS lon0, i, CASE WHEN i < 60 THEN 400.0 + {_unit(1)} * 500.0 ELSE 120.0 + {_unit(1)} * 280.0 END AS radius, {_unit(2)} * 2 * pi() AS angle
    FROM ref, range(0, 121) r(i) WHERE ref_lat IS NOT NULL),
  cd AS (SELECT id, i, CASE WHEN i = 120 THEN lat0 ELSE lat0 + radius * cos(angle) / 111320 END AS lat,
    CASE WHEN i = 120 THEN lon0 ELSE lon0 + radius * sin(angle) / (111320 * cos(radians(lat0))) END AS lon FROM tr),
  px AS (SELECT id, i, lat, lon, (ay > lat) <> (b_y > lat) AND lon < (ax - bx) * (lat - b_y) / nullif(ay - b_y, 0) + bx AS crosses, (ax - lon) * 111320 * cos(radians(lat)) AS x, (ay - lat) * 111320 AS y,
    (bx - ax) * 111320 * cos(radians(lat)) AS dx, (b_y - ay) * 111320 AS dy FROM cd, ed),
  sf AS (SELECT id, i, lat, lon FROM px GROUP BY id, i, lat, lon HAVING count(*) FILTER (crosses) % 2 = 1 AND min(sqrt(
    pow(x + dx * greatest(0, least(1, -(x * dx + y * dy) / (dx * dx + dy * dy))), 2) + pow(y + dy * greatest(0, least(1, -(x * dx + y * dy) / (dx * dx + dy * dy))), 2))) >= {L.SAFE_INLAND_M})
  SELECT ref.id, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon FROM ref LEFT JOIN (SELECT id, arg_min(lat, i) AS lat, arg_min(lon, i) AS lon FROM sf GROUP BY 1) s ON s.id = ref.id""")
def e22(s, d):
    p = _pins(s, d).withColumn("p", G.displaced("id", "ref_lat", "ref_lon", OUTLINE))
    return p.select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def _edges():
    ring = OUTLINE[0]
    return ", ".join(f"({ring[i][0]}, {ring[i][1]}, {ring[(i + 1) % len(ring)][0]}, {ring[(i + 1) % len(ring)][1]})" for i in range(len(ring)))


_COAST = f"""{_PINS}, ee AS (SELECT * FROM (VALUES {_edges()}) v0(ay0, ax0, by0, bx0)), e AS (SELECT ay0::DOUBLE AS ay, ax0::DOUBLE AS ax, by0::DOUBLE AS b_y, bx0::DOUBLE AS bx FROM ee),
  co AS (SELECT id, lat, lon, (SELECT count(*) % 2 = 1 FROM e WHERE (ay > lat) <> (b_y > lat) AND lon < (ax - bx) * (lat - b_y) / (ay - b_y) + bx) AS inside,
   (SELECT min(sqrt(pow(px + dx * greatest(0, least(1, -(px * dx + py * dy) / (dx * dx + dy * dy))), 2) + pow(py + dy * greatest(0, least(1, -(px * dx + py * dy) / (dx * dx + dy * dy))), 2)))
     FROM (SELECT (ax - lon) * 111320 * cos(radians(lat)) AS px, (ay - lat) * 111320 AS py, (bx - ax) * 111320 * cos(radians(lat)) AS dx, (b_y - ay) * 111320 AS dy FROM e)) AS edge FROM pins)"""


@query("e23_point_in_polygon", f"WITH {_COAST} SELECT id, CASE WHEN lat IS NOT NULL THEN inside END AS inside FROM co")
def e23(s, d):
    return _pins(s, d).select("id", F.when(F.col("lat").isNotNull(), G.inside("lat", "lon", OUTLINE)).alias("inside"))


@query("e24_distance_to_outline", f"WITH {_COAST} SELECT id, round(edge, 3) AS metres, inside AND edge >= 200 AS safe, inside OR edge <= 150 AS land FROM co WHERE lat IS NOT NULL")
def e24(s, d):
    return _pins(s, d).filter("lat IS NOT NULL").select(
        "id", F.round(G.metres_to_edge("lat", "lon", OUTLINE), 3).alias("metres"),
        G.is_safe_site("lat", "lon", OUTLINE).alias("safe"), G.is_land("lat", "lon", OUTLINE).alias("land"))


@query("e25_pin_audit", f"""WITH {_PINS} SELECT CASE WHEN ref_lat IS NULL THEN 'quitar' WHEN lat IS NULL THEN 'ok'
    WHEN {_HAV.format('lat', 'lon', 'ref_lat', 'ref_lon')} <= 1.2 THEN 'ok' ELSE 'recolocar' END AS status, count(*) AS n FROM ref GROUP BY 1""")
def e25(s, d):
    return _pins(s, d).groupBy(G.pin_status("lat", "lon", "ref_lat", "ref_lon").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("e26_coast_audit", f"""WITH {_COAST} SELECT CASE WHEN lat IS NULL THEN 'sin pin' WHEN NOT (inside OR edge <= 150) THEN 'en el mar' WHEN edge < 50 THEN 'al borde' ELSE 'ok' END AS status,
    count(*) AS n FROM co GROUP BY 1""")
def e26(s, d):
    return _pins(s, d).groupBy(G.coast_status("lat", "lon", OUTLINE).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("e26_zone_repair", f"WITH {_PINS} SELECT id, CASE WHEN zone_ok THEN zone END AS zone FROM ref")
def e26_zone(s, d):
    return _pins(s, d).select("id", F.when(F.col("zone_ok"), F.col("zone")).alias("zone"))


# --- quality ---------------------------------------------------------------------------------------

@query("q1_constraints", with_views(f"""SELECT id, array_to_string(list_filter([CASE WHEN fatalities < 0 THEN 'fatalities' END, CASE WHEN injuries < 0 THEN 'injuries' END,
    CASE WHEN NOT confidence_score BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN NOT source_score BETWEEN 0 AND 1 THEN 'source_score' END,
    CASE WHEN status = 'PUBLISHED' AND published_at IS NULL THEN 'published_date' END], lambda x: x IS NOT NULL), ',') AS violations FROM accidents""", "accidents"))
def q1(s, d):
    return acc(s, d).select("id", F.array_join(K.violations(K.article_constraints()), ",").alias("violations"))


@query("q1_comment_constraints", """SELECT conv_id, turn, length(trim(text)) > 0 AND length(text) <= 2000 AS accepted FROM conversations""")
def q1_comments(s, d):
    c = load(s, d, "conversations").withColumn("body", F.col("text"))
    return c.select("conv_id", "turn", (F.size(K.violations(K.comment_constraints())) == 0).alias("accepted"))


@query("q1_form_constraints", with_views(f"""SELECT a.id, array_to_string(list_filter([CASE WHEN length(trim(title)) NOT BETWEEN 10 AND 200 THEN 'title' END,
    CASE WHEN length(trim(summary)) NOT BETWEEN 20 AND 500 THEN 'summary' END, CASE WHEN length(trim(body)) NOT BETWEEN 50 AND 20000 THEN 'body' END,
    CASE WHEN fatalities NOT BETWEEN 0 AND 50 THEN 'fatalities' END, CASE WHEN injuries NOT BETWEEN 0 AND 200 THEN 'injuries' END,
    CASE WHEN vehicle_type NOT IN ({sql_list(L.VEHICLES)}) THEN 'vehicle' END, CASE WHEN severity NOT IN ({sql_list(L.SEVERITIES)}) THEN 'severity' END,
    CASE WHEN coalesce(n, 0) < 1 THEN 'sources' END, CASE WHEN lat NOT BETWEEN 28.4 AND 29.2 THEN 'lat' END,
    CASE WHEN lon NOT BETWEEN -13.95 AND -13.4 THEN 'lon' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM accidents a LEFT JOIN (SELECT article_id, count(*) AS n FROM sources GROUP BY 1) s ON s.article_id = a.id""", "accidents", "sources"))
def q1_form(s, d):
    from ..operators.reports import child_counts
    rows = child_counts(acc(s, d), view(s, d, "sources"), "id", "article_id", "n_sources")
    return rows.select("id", F.array_join(K.violations(K.form_constraints()), ",").alias("violations"))


@query("q1_user_constraints", r"""SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN email <> lower(trim(email)) THEN 'email_lower' END,
    CASE WHEN NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email_shape' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE lower(c_name) END || CASE c_mktsegment WHEN 'BUILDING' THEN '.example' ELSE '@medio.example' END AS email FROM customer)""")
def q1_users(s, d):
    """Users from customers; names with capitals and addresses without a host are refused."""
    name = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.lower("c_name"))
    host = F.when(F.col("c_mktsegment") == "BUILDING", ".example").otherwise("@medio.example")
    users = load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(name, host).alias("email"),
                                          F.col("c_name").alias("name"), F.col("c_mktsegment").alias("bio"))
    return users.select("id", F.array_join(K.violations(K.user_constraints()), ",").alias("violations"))


_CONF = "CASE flag WHEN 'F' THEN 'certain' WHEN 'O' THEN 'likely' ELSE 'uncertain' END"
_AGE = f"date_diff('microsecond', occurred_at, {_TS}) / 3600000000.0"
_DATE_SCORE = f"""CASE WHEN occurred_at > {_TS} + INTERVAL 90 MINUTE OR occurred_at < {_TS} - INTERVAL 365 DAY THEN 0.0 ELSE greatest(0.0, least(1.0, 0.6 +
    CASE flag WHEN 'F' THEN 0.4 WHEN 'O' THEN 0.15 ELSE 0.0 END - CASE WHEN {_AGE} < 0.5 THEN 0.15 ELSE 0.0 END - CASE WHEN {_AGE} > 168 THEN 0.1 ELSE 0.0 END)) END"""
_DATE_REJ = f"(occurred_at > {_TS} + INTERVAL 90 MINUTE OR occurred_at < {_TS} - INTERVAL 365 DAY)"


def wire_items(s, d):
    """Wire rows as the ingest takes them, and the moment they are judged at."""
    df = view(s, d, "wire").withColumn("date_confidence", F.when(F.col("flag") == "F", "certain").when(
        F.col("flag") == "O", "likely").otherwise("uncertain"))
    df = df.withColumn("source_score", K.source_score(
        F.least(F.lit(1.0), F.col("price") / 400000.0), F.col("source") % 4, (F.col("source") % 11) / 10.0))
    return df, F.lit(AS_OF).cast("timestamp")


def checked(s, d):
    """Wire rows with every verification column. Age limit of a year, so that many rows stay in."""
    df, as_of = wire_items(s, d)
    df = X.with_shared_facts(df, "title", "body", also=text_scores())
    return df.withColumn("date_check", K.date_check("occurred_at", "date_confidence", as_of, 365)), as_of


@query("q3_date_score", W(f"SELECT id, CAST(round({_DATE_SCORE}, 4) AS DOUBLE) AS score, {_DATE_REJ} AS reject FROM f"))
def q3(s, d):
    df, _ = checked(s, d)
    return df.select("id", F.round("date_check.score", 4).alias("score"), F.col("date_check.reject").alias("reject"))


@query("q4_place_score", W("SELECT id, CAST(CASE WHEN outside THEN 0.0 WHEN municipality IS NOT NULL THEN 1.0 ELSE 0.25 END AS DOUBLE) AS score, outside AS reject FROM f"))
def q4(s, d):
    p = facts(s, d).withColumn("p", K.place_check("facts.outside", "facts.municipality"))
    return p.select("id", F.col("p.score").cast("double").alias("score"), F.col("p.reject").alias("reject"))


_DEATH_RE = r"(?i)\b(fallecid\w*|murio|murieron|muerte|muertos?|decresid\w*)\b"
_SIMPLE_RE = rf"(?i)(\d{{1,2}}|{'|'.join(L.HEADLINE_NUMBERS)})\s+(?:\w+\s+){{0,2}}herid"


def _simple(x):
    raw = f"lower(regexp_extract({x}, {Q.lit(_SIMPLE_RE)}, 1))"
    return (f"CASE {raw} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.HEADLINE_NUMBERS.items()) + f" ELSE TRY_CAST({raw} AS INT) END")


def _m(x, p):
    return f"regexp_matches({x}, {Q.lit(p)})"


_WORDS = r"len(list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> ''))"
_CONSIST = f"""greatest(0.0, 1.0 - CASE WHEN {_m('title', _DEATH_RE)} AND NOT {_m('body', _DEATH_RE)} THEN 0.45 ELSE 0.0 END
    - CASE WHEN {_m('title', '(?i)' + chr(92) + 'bherid')} AND NOT {_m('body', '(?i)' + chr(92) + 'bherid')} THEN 0.3 ELSE 0.0 END
    - CASE WHEN severity = 'GRAVE' AND fatalities = 0 AND coalesce(injuries, 0) <= 1 THEN 0.25 ELSE 0.0 END
    - CASE WHEN severity = 'GRAVE' AND fatalities = 0 AND injuries = 0 THEN 0.3 ELSE 0.0 END
    - CASE WHEN abs({_simple('title')} - {_simple('body')}) > 1 THEN 0.35 ELSE 0.0 END
    - CASE WHEN greatest({_WORDS}, 1) < 40 THEN 0.5 ELSE 0.0 END - CASE WHEN municipality IS NULL THEN 0.05 ELSE 0.0 END)"""
_BODY = f"CASE WHEN {_WORDS} = 0 THEN 0.2 WHEN {_WORDS} >= 250 THEN 1.0 WHEN {_WORDS} >= 120 THEN 0.8 WHEN {_WORDS} >= 60 THEN 0.6 WHEN {_WORDS} >= 30 THEN 0.35 ELSE 0.15 END"
_SRC = ("greatest(0.0, least(1.0, least(1.0, price / 400000.0) * 0.6 + (source % 11) / 10.0 * 0.4 - least(0.5, (source % 4) * 0.15)))")
_CONFID = (f"(({_DATE_SCORE}) * 0.2 + (CASE WHEN outside THEN 0.0 WHEN municipality IS NOT NULL THEN 1.0 ELSE 0.25 END) * 0.2 + ({_CONSIST}) * 0.25 + ({_BODY}) * 0.2 + least(1.0, weight / 8.0) * 0.15)")


@query("q5_consistency", W(f"SELECT id, CAST(round({_CONSIST}, 4) AS DOUBLE) AS score FROM f"))
def q5(s, d):
    c = facts(s, d).withColumn("c", K.consistency_check(
        "title", "body", "facts.severity", "facts.fatalities", "facts.injuries", "facts.municipality"))
    return c.select("id", F.round("c.score", 4).alias("score"))


@query("q6_body_score", W(f"SELECT id, CAST({_BODY} AS DOUBLE) AS score FROM f"))
def q6(s, d):
    return view(s, d, "wire").select("id", K.body_check("body", "title").cast("double").alias("score"))


@query("q7_source_score", W(f"SELECT id, round({_SRC}, 4) AS score FROM f"))
def q7(s, d):
    return checked(s, d)[0].select("id", F.round("source_score", 4).alias("score"))


@query("q8_verification", W(f"""SELECT id, CASE WHEN {_DATE_REJ} OR outside THEN 'REJECTED' WHEN {_CONFID} >= 0.8 AND {_SRC} >= 0.5 THEN 'VERIFIED'
    WHEN {_CONFID} < 0.55 THEN 'SUSPICIOUS' ELSE 'PENDING_REVIEW' END AS verification FROM f"""))
def q8(s, d):
    return verified(checked(s, d)[0]).select("id", "verification")


def _edited(s, d):
    df = facts(s, d)
    return df.select(
        "id", "title", "summary", "body", "occurred_at",
        F.when(F.col("flag") == "F", "ACCIDENTE_TRAFICO").otherwise("POLITICA").alias("category"),
        F.when(F.col("flag") == "P", "CULTURA").alias("detected"), F.col("facts.category").alias("reread"),
        F.col("facts.municipality").alias("municipality"), F.col("facts.municipality").isNotNull().alias("place_from_text"),
        (F.col("price") / 500000).alias("source_score"), F.col("facts.severity").alias("severity"),
        F.col("facts.vehicle").alias("vehicle_type"))


_TOWN = "CASE municipality " + " ".join(f"WHEN '{a}' THEN {Q.lit(X.plain(n))}" for a, n, _, _ in MUNICIPALITIES) + " END"


@query("q9_editorial_errors", with_views(f"""WITH {NORMED}, e0 AS (SELECT *, {Q.norm("title || ' ' || summary || ' ' || body")} AS nt FROM f),
    e1 AS (SELECT id, title, occurred_at, flag, price, municipality, severity, vehicle, category AS reread, t, nt, t || ' ' || nt AS c, ' ' || t || ' ' || nt || ' ' AS pc FROM e0),
    e2 AS (SELECT *, {_EV} AS ev, {_FI} AS fi, {_VE} AS ve FROM e1)
    SELECT id, array_to_string(list_filter([CASE WHEN flag = 'F' AND NOT ((len(ev) > 0 OR len(fi) > 0) AND len(ve) > 0) THEN 'ACCIDENTE_SIN_SENAL:grave' END,
      CASE WHEN NOT {_IN_SCOPE} THEN 'FUERA_DE_LA_ISLA:grave' END, CASE WHEN flag = 'P' AND reread IS NULL THEN 'TIPO_NO_ENCUADRA:aviso' END,
      CASE WHEN municipality IS NULL OR NOT contains(nt, {_TOWN}) THEN 'MUNICIPIO_NO_DICHO:aviso' END,
      CASE WHEN flag <> 'F' AND severity <> 'MODERADO' THEN 'GRAVEDAD_SIN_SENTIDO:aviso' END,
      CASE WHEN flag <> 'F' AND coalesce(severity, 'MODERADO') = 'MODERADO' AND vehicle <> 'OTROS' THEN 'GRAVEDAD_SIN_SENTIDO:nota' END,
      CASE WHEN price / 500000 > 0 AND price / 500000 < 0.4 THEN 'FUENTE_DEBAJO:nota' END], lambda x: x IS NOT NULL), ',') AS errors FROM e2""", "wire"))
def q9(s, d):
    e = K.editorial_errors(_edited(s, d))
    return e.select("id", F.array_join(F.transform("errors", lambda x: F.concat(x["code"], F.lit(":"), x["level"])), ",").alias("errors"))


@query("q10_publication_gate", with_views("""SELECT id, array_to_string(list_filter([CASE WHEN duplicate_of_id IS NOT NULL THEN 'duplicada' END,
    CASE WHEN origin <> 'MANUAL' THEN 'verificacion' END, CASE WHEN confidence_score < 0.3 THEN 'confianza' END, CASE WHEN source_score < 0.1 THEN 'fuente' END,
    CASE WHEN NOT is_featured AND status = 'ARCHIVED' THEN 'sin_reescribir' END, CASE WHEN length(title) < 25 THEN 'corta' END,
    CASE WHEN zone IS NULL THEN 'sin_municipio' END, CASE WHEN fatalities > 0 THEN 'graves' END, CASE WHEN injuries > 3 THEN 'avisos' END,
    CASE WHEN severity = 'LEVE' THEN 'datos_personales' END, CASE WHEN category = 'CULTURA' THEN 'antigua' END], lambda x: x IS NOT NULL), ',') AS blockers FROM accidents""", "accidents"))
def q10(s, d):
    a = acc(s, d).select(
        "id", F.col("duplicate_of_id").isNotNull().alias("is_duplicate"),
        F.when(F.col("origin") == "MANUAL", "VERIFIED").otherwise("SUSPICIOUS").alias("verification"),
        F.col("confidence_score").alias("confidence"), "source_score",
        (F.col("is_featured") | (F.col("status") != "ARCHIVED")).alias("rewritten"),
        F.char_length("title").alias("n_words"), F.col("zone").isNotNull().alias("place_known"),
        F.col("fatalities").alias("n_grave"), F.col("injuries").alias("n_aviso"),
        (F.col("severity") == "LEVE").cast("int").alias("n_pii"),
        F.when(F.col("category") == "CULTURA", 48).otherwise(1).alias("age_hours"))
    gate = K.publication_blockers(min_confidence=0.3, min_source=0.1, min_words=25, max_warnings=3)
    return a.select("id", F.array_join(gate, ",").alias("blockers"))


@query("q14_body_choice", "SELECT doc_id, CASE WHEN length(text) >= 200 THEN 'body' ELSE 'summary' END AS chosen FROM documents")
def q14(s, d):
    return load(s, d, "documents").select("doc_id", F.when(F.char_length("text") >= 200, "body").otherwise("summary").alias("chosen"))


@query("q15_draft_rows", W("""SELECT id, coalesce(municipality, 'arrecife') AS municipality, coalesce(vehicle, 'OTROS') AS vehicle_type,
    coalesce(severity, 'MODERADO') AS severity, coalesce(injuries, 0) AS injuries, coalesce(fatalities, 0) AS fatalities, 'PENDING_REVIEW' AS status,
    municipality IS NULL AS uncertain FROM f"""))
def q15(s, d):
    return draft_rows(facts(s, d)).select("id", "municipality", "vehicle_type", "severity", "injuries", "fatalities", "status", "uncertain")


def draft_rows(df):
    """Stored form of a new article: defaults only here, text cut to its column sizes."""
    c = F.col
    return df.select(
        "id", T.truncate(T.tidy("body"), 480).alias("summary"), "title", T.truncate("body", 8000).alias("original_body"),
        T.truncate("summary", 2000).alias("source_excerpt"), T.truncate("summary", 500).alias("original_summary"),
        F.coalesce("facts.municipality", F.lit("arrecife")).alias("municipality"), c("facts.municipality").isNull().alias("uncertain"),
        c("facts.zone").alias("zone"), F.coalesce("facts.vehicle", F.lit("OTROS")).alias("vehicle_type"),
        F.coalesce("facts.severity", F.lit("MODERADO")).alias("severity"), F.coalesce("facts.injuries", F.lit(0)).alias("injuries"),
        F.coalesce("facts.fatalities", F.lit(0)).alias("fatalities"), F.lit("PENDING_REVIEW").alias("status"),
        c("facts.road").alias("road"), F.lit(False).alias("is_featured"))


@query("q16_delivery_log", """SELECT event_type AS channel, count(*) AS total, count(*) FILTER (value > 20) AS sent, count(*) FILTER (value <= 20) AS failed FROM events GROUP BY 1""")
def q16(s, d):
    ok = F.col("value") > 20
    return load(s, d, "events").groupBy(F.col("event_type").alias("channel")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("sent"), F.count_if(~ok).alias("failed"))
