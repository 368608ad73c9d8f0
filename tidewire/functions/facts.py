"""Rule-driven fact extraction over normalised text. Absent facts stay null."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import lexicon as L
from ..rules.places import MUNICIPALITIES, ZONES
from ..session import shuffle_width
from .text import col, deaccent, norm
from .wordlist import digest, tree_pattern

SEAM = 80  # longer than any term


def plain(s: str) -> str:
    """Python twin of :func:`norm`, for terms known when the plan is built."""
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) < 0x370)
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in s).split())


def place_terms() -> list[tuple[str, str, str | None, str | None]]:
    """(term, municipality, zone, label): longest first, municipalities win equal terms."""
    rows = [(plain(name), slug, None, None) for slug, name, _, _ in MUNICIPALITIES]
    for slug, name, town, _, _, other in ZONES:
        rows += [(plain(t), town, slug, name) for t in (name, *other)]
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: -len(r[0])):
        if row[0] not in seen:
            seen.add(row[0])
            out.append(row)
    return out


def local_terms() -> list[str]:
    towns = [plain(n) for _, n, _, _ in MUNICIPALITIES]
    zones = [plain(t) for _, n, _, _, _, o in ZONES for t in (n, *o)]
    names = [t for t in dict.fromkeys(towns + zones) if len(t) >= 4]
    return list(dict.fromkeys(L.LOCAL_WORDS_FIRST + names + L.LOCAL_WORDS_LAST))


def has_term(padded: Column, term: str) -> Column:
    return padded.contains(f" {term} ")


def pad(text) -> Column:
    return F.concat(F.lit(" "), col(text), F.lit(" "))


def first_rule(text, rules) -> Column:
    """Name of the first rule whose pattern occurs."""
    text = col(text)
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in rules])


def first_term(padded: Column, terms) -> Column:
    return F.coalesce(*[F.when(has_term(padded, t), F.lit(t)) for t in terms])


def _number(raw: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in L.NUMBER_WORDS.items() for v in kv])
    return F.coalesce(raw.try_cast("int"), F.try_element_at(table, raw))


def _counted(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    total = F.aggregate(hits, F.lit(0), lambda s, h: s + F.coalesce(_number(h), F.lit(0)))
    return F.when(F.size(hits) > 0, total)


def injuries(text) -> Column:
    text = col(text)
    counted = F.when(text.rlike(L.NO_INJURY), F.lit(0)).otherwise(
        F.coalesce(_counted(text, L.INJURY_COUNT), F.when(text.rlike(L.INJURY_BARE), F.lit(1))))
    # Plain containment first: most texts hold none of the stems.
    return F.when(text.contains("herid") | text.contains("iles") | text.contains("lesion"), counted)


def fatalities(text) -> Column:
    text = col(text)
    counted = F.coalesce(_counted(text, L.DEATH_COUNT), F.when(text.rlike(L.DEATH_BARE), F.lit(1)))
    stems = ("fallec", "muer", "murie", "murio", "victimas")
    return F.when(functools.reduce(lambda a, b: a | b, [text.contains(w) for w in stems]), counted)


def road(text) -> Column:
    nums = F.transform(F.regexp_extract_all(col(text), F.lit(L.ROAD), F.lit(1)), lambda n: n.cast("int"))
    best = F.array_min(F.filter(nums, lambda n: n.between(1, 999)))
    return F.when(best.isNotNull(), F.concat(F.lit("LZ-"), best.cast("string")))


def place(padded, terms: list[tuple[str, str, str | None, str | None]] | None = None) -> Column:
    """Most specific place named in blank-padded text or its digest, or null.

    ``terms`` (term, municipality, zone, label) are tried in order; by default the places of the package.
    """
    padded = col(padded)
    hits = [
        F.when(has_term(padded, term), F.struct(
            F.lit(term).alias("term"), F.lit(town).alias("municipality"),
            F.lit(zone).cast("string").alias("zone"), F.lit(label).cast("string").alias("area")))
        for term, town, zone, label in (place_terms() if terms is None else terms)
    ]
    return F.coalesce(*hits)


@dataclass(frozen=True)
class CategoryRules:
    """What decides a category: (name, pattern) lists in order, and the pattern of a strong signal."""

    strong: str = L.STRONG_SIGNAL
    incident: tuple = tuple(L.INCIDENT_RULES)
    early: tuple = tuple(L.EARLY_RULES)
    topics: tuple = tuple(L.TOPIC_RULES)


def category(text, terms, rules: CategoryRules = CategoryRules()) -> Column:
    """Incident rules on a strong signal, early topics, weak incident rules, other topics.

    The strong signal is a list of word beginnings and reads the text; the word rules read its digest, or the
    text again if the rules are not the package's own.
    """
    terms = col(terms)
    is_strong = col(text).rlike(rules.strong)
    inc = first_rule(terms, rules.incident)
    found = F.coalesce(
        F.when(is_strong, inc), first_rule(terms, rules.early),
        F.when(~is_strong, inc), first_rule(terms, rules.topics))
    return F.when(terms.rlike("[a-z0-9]"), found)


def vehicle(text) -> Column:
    return first_rule(text, L.VEHICLE_RULES)


def severity(text, deaths, hurt) -> Column:
    deaths, hurt = col(deaths), col(hurt)
    return (
        F.when(deaths > 0, F.lit("GRAVE"))
        .otherwise(F.coalesce(
            first_rule(text, L.SEVERITY_WORDS),
            F.when((deaths == 0) | (hurt == 0), F.lit("LEVE")).when(hurt >= 3, F.lit("MODERADO")))))


def time_of_day(raw) -> Column:
    """HH:mm from lower-case text that still has its punctuation."""
    text = deaccent(F.lower(col(raw)))
    hh = F.regexp_extract(text, L.TIME_OF_DAY, 1)
    mm = F.regexp_extract(text, L.TIME_OF_DAY, 2)
    hour = hh.try_cast("int")
    minute = F.coalesce(mm.try_cast("int"), F.lit(0))
    ok = (hh != "") & (hour <= 23) & (minute <= 59)
    return F.when(ok, F.concat(F.lpad(hh, 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))


def other_island(padded) -> Column:
    padded = col(padded)
    expr = F.lit(False)
    for term in L.OTHER_ISLANDS:
        expr = expr | has_term(padded, term)
    return expr


def relevance_weight(title_padded, body_padded, terms=None) -> Column:
    t, b = col(title_padded), col(body_padded)
    return sum(
        (F.when(has_term(t, w), F.lit(2 * n)).when(has_term(b, w), F.lit(n)).otherwise(F.lit(0))
         for w, n in (terms or L.RELEVANCE)), F.lit(0))


def matched_terms(title_padded, body_padded, terms=None) -> Column:
    t, b = col(title_padded), col(body_padded)
    return F.array_compact(F.array(*[
        F.when(has_term(t, w) | has_term(b, w), F.lit(w)) for w, _ in (terms or L.RELEVANCE)]))


def relevance(weight) -> Column:
    return F.least(F.lit(1.0), col(weight) / F.lit(8.0))


def _seam(title: str, body: str) -> Column:
    """Whole words around the point where title and body meet."""
    t, b = F.col(title), F.col(body)
    tail = F.when(F.char_length(t) <= SEAM, t).otherwise(
        F.regexp_replace(F.substring(t, -SEAM, SEAM), "^[^ ]* ", ""))
    head = F.when(F.char_length(b) <= SEAM, b).otherwise(
        F.regexp_replace(F.substring(b, 1, SEAM), " [^ ]*$", ""))
    return F.concat_ws(" ", tail, head)


def with_facts(df: DataFrame, title: str, body: str, out: str = "facts") -> DataFrame:
    """Add the fact struct, the relevance score, the normalised text ``_t _b _c`` and the digest ``_h``."""
    df = df.withColumn("_t", norm(title)).withColumn("_b", norm(body))
    df = df.withColumn("_c", F.concat_ws(" ", "_t", "_b")).withColumn("_ht", digest("_t")).withColumn("_hb", digest("_b"))
    # Terms of the joined text: those of both parts and those that span their seam.
    df = df.withColumn("_h", F.concat("_ht", "_hb", digest(_seam("_t", "_b"))))
    df = (
        df.withColumn("_weight", relevance_weight("_ht", "_hb"))
        .withColumn("_category", category("_c", "_h"))
        .withColumn("_hurt", injuries("_c"))
        .withColumn("_dead", fatalities("_c"))
        .withColumn("_place", F.coalesce(place("_ht"), place("_hb")))
    )
    seen = (F.col("_weight") > 0) | F.col("_category").isNotNull()
    values = {
        "municipality": F.col("_place.municipality"), "zone": F.col("_place.zone"),
        "area": F.col("_place.area"), "road": road("_c"), "vehicle": vehicle("_h"),
        "category": F.col("_category"), "severity": severity("_h", "_dead", "_hurt"),
        "injuries": F.col("_hurt"), "fatalities": F.col("_dead"),
        "time_of_day": time_of_day(F.concat_ws(" ", title, body)),
    }
    fields = [F.when(seen, v).alias(k) for k, v in values.items()]
    fields.append((seen & other_island("_h")).alias("outside"))
    fields.append(F.when(seen, matched_terms("_ht", "_hb")).otherwise(
        F.array().cast("array<string>")).alias("matched"))
    return (
        df.withColumn(out, F.struct(*fields))
        .withColumn("relevance", relevance("_weight"))
        .drop("_weight", "_category", "_hurt", "_dead", "_place", "_ht", "_hb")
    )


def with_shared_facts(df: DataFrame, title: str, body: str, out: str = "facts", also: dict[str, Column] | None = None) -> DataFrame:
    """``with_facts`` computed once per distinct pair of texts: agencies' items come many times, and the rules read texts alone.

    Distinct texts are dealt evenly, as they are heavy per row; nulls are texts of their own. ``also``: more columns that follow from
    ``_title``, ``_body`` and what ``with_facts`` adds; with them, only these, the facts and the relevance go to the rows.
    """
    texts = df.select(F.col(title).alias("_title"), F.col(body).alias("_body")).distinct()
    made = with_facts(texts.repartition(shuffle_width(df.sparkSession)), "_title", "_body", out)
    if also:
        made = made.select("_title", "_body", out, "relevance", *[c.alias(name) for name, c in also.items()])
    made = made.hint("merge")
    same = F.col(title).eqNullSafe(F.col("_title")) & F.col(body).eqNullSafe(F.col("_body"))
    return df.join(made, same).drop("_title", "_body")


def scope_gate(combined, terms) -> Column:
    """struct(local, reason) for normalised title + body text and its digest."""
    text, padded = col(combined), col(terms)
    local = first_term(padded, local_terms())
    city = first_term(padded, L.MAINLAND_CITIES)
    return (
        F.when(local.isNotNull(), _verdict(True, F.concat(F.lit("menciona "), local)))
        .when(text.rlike(L.LOCAL_ROAD), _verdict(True, F.lit("menciona una carretera de la isla")))
        .when(city.isNotNull(), _verdict(False, F.concat(F.lit("menciona "), city, F.lit(", fuera de la isla"))))
        .otherwise(_verdict(False, F.lit("sin mencion local")))
    )


def _verdict(local: bool, reason: Column) -> Column:
    return F.struct(F.lit(local).alias("local"), reason.alias("reason"))


def _root_hits(padded: Column, roots: list[str]) -> Column:
    """Roots that start a word at most four characters longer, in rule order."""
    pattern = f"(?<= )(?:{tree_pattern(roots)})[a-z0-9]{{0,{L.ROOT_SLACK}}}(?= )"
    found = F.array_distinct(F.regexp_extract_all(padded, F.lit(pattern), F.lit(0)))

    def named(words):
        return F.filter(F.array(*[F.lit(r) for r in roots]), lambda r: F.exists(words, lambda w: F.startswith(w, r) & (
            F.char_length(w) <= F.char_length(r) + L.ROOT_SLACK)))

    # One-element transform: the words are collected once; texts without any skip the root list.
    none = F.array().cast("array<string>")
    return F.get(F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, named(w)).otherwise(none)), F.lit(0))


def traffic_gate(combined, terms) -> Column:
    """struct(accident, reason, events, vehicles) for normalised title + body text and its digest."""
    text, terms = col(combined), col(terms)
    padded = pad(text)
    exact = F.filter(F.split(text, " "), lambda w: w.isin(L.VEHICLE_WORDS))
    by_road = F.when(text.rlike(L.GATE_ROAD), F.array(F.lit("carretera-lz"))).otherwise(
        F.array().cast("array<string>"))
    vehicles = F.concat(_root_hits(padded, L.VEHICLE_ROOTS), exact, by_road)
    phrases = F.array_compact(F.array(*[F.when(has_term(terms, p), F.lit(p)) for p in L.EVENT_PHRASES]))
    events = F.concat(_root_hits(padded, L.EVENT_ROOTS), phrases)
    fires = _root_hits(padded, L.FIRE_ROOTS)
    parts = F.struct(events.alias("e"), fires.alias("f"), vehicles.alias("v"))

    def judge(p):
        has_e, has_f, has_v = F.size(p["e"]) > 0, F.size(p["f"]) > 0, F.size(p["v"]) > 0
        accident = (has_e | has_f) & has_v
        reason = (
            F.when(has_e & has_v, F.lit("suceso con vehiculo o via"))
            .when(has_f & has_v, F.lit("incendio de un vehiculo"))
            .when(~has_e & has_f, F.lit("fuego sin vehiculo"))
            .when(~has_e, F.lit("ningun suceso de trafico"))
            .otherwise(F.lit("suceso sin vehiculo ni via")))
        listed = (
            F.when(has_e & has_v, p["e"]).when(has_f & has_v, F.concat(p["e"], p["f"]))
            .when(~has_e & has_f, p["f"]).otherwise(p["e"]))
        return F.struct(accident.alias("accident"), reason.alias("reason"),
                        listed.alias("events"), p["v"].alias("vehicles"))

    return F.get(F.transform(F.array(parts), judge), F.lit(0))


def with_resolved_category(df: DataFrame, detected: Column, title: str, summary: str, body: str,
                           out: str = "category") -> DataFrame:
    """Detected category, else a second reading of everything, else the traffic gate, else OTRO."""
    whole = F.concat_ws(" ", norm(title), norm(F.concat_ws(" ", title, summary, body)))
    df = df.withColumn("_all", whole).withColumn("_hall", digest("_all"))
    gate = F.when(traffic_gate("_all", "_hall")["accident"], F.lit("ACCIDENTE_TRAFICO"))
    return df.withColumn(out, F.coalesce(detected, category("_all", "_hall"), gate, F.lit("OTRO"))).drop("_all", "_hall")


def family(cat) -> Column:
    return F.when(col(cat).isin(L.INCIDENT_FAMILY), F.lit("suceso")).otherwise(F.lit("informacion"))
