"""Constraint checks, verification scores, editorial errors and the publication gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import lexicon as L
from ..rules.places import MUNICIPALITIES
from .dates import validate_date
from .facts import plain, scope_gate, traffic_gate
from .text import ascii_words, col, norm, word_count
from .wordlist import digest


# --- constraints ------------------------------------------------------------------

def violations(rules: dict[str, Column]) -> Column:
    """Names of the constraints a row breaks. A null condition counts as satisfied, as in SQL CHECK."""
    return F.array_compact(F.array(*[
        F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def article_constraints() -> dict[str, Column]:
    c = F.col
    return {
        "fatalities": c("fatalities") >= 0, "injuries": c("injuries") >= 0,
        "confidence": c("confidence_score").between(0, 1), "source_score": c("source_score").between(0, 1),
        "status": c("status").isin(L.STATUSES), "origin": c("origin").isin(L.ORIGINS),
        "vehicle": c("vehicle_type").isin(L.VEHICLES), "severity": c("severity").isin(L.SEVERITIES),
        "published_date": (c("status") != "PUBLISHED") | c("published_at").isNotNull(),
    }


def comment_constraints() -> dict[str, Column]:
    body = F.col("body")
    return {"not_blank": F.char_length(F.trim(body)) > 0, "length": F.char_length(body) <= 2000}


def user_constraints() -> dict[str, Column]:
    c = F.col
    return {
        "email_lower": c("email") == F.lower(F.trim("email")),
        "email_shape": c("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "bio": F.char_length("bio") <= 1000, "name": F.char_length("name") <= 80,
    }


def form_constraints() -> dict[str, Column]:
    """Editor form ranges; text columns are measured trimmed."""
    c = F.col

    def size(name, low, high):
        return F.char_length(F.trim(c(name))).between(low, high)

    return {
        "title": size("title", 10, 200), "summary": size("summary", 20, 500),
        "body": size("body", 50, 20000), "fatalities": c("fatalities").between(0, 50),
        "injuries": c("injuries").between(0, 200), "vehicle": c("vehicle_type").isin(L.VEHICLES),
        "severity": c("severity").isin(L.SEVERITIES), "sources": c("n_sources") >= 1,
        "lat": c("lat").between(28.4, 29.2), "lon": c("lon").between(-13.95, -13.4),
    }


# --- verification -------------------------------------------------------------------

def date_check(date, confidence, as_of: Column, max_age_days: int = L.MAX_AGE_DAYS) -> Column:
    """struct(score, reject)."""
    date, confidence = col(date), col(confidence)
    verdict = validate_date(date, as_of, max_age_days)
    age = (F.unix_micros(as_of) - F.unix_micros(date)) / F.lit(3_600_000_000)
    score = (
        F.lit(0.6)
        + F.when(confidence == "certain", 0.4).when(confidence == "likely", 0.15).otherwise(0.0)
        - F.when(age < 0.5, 0.15).otherwise(0.0) - F.when(age > 168, 0.1).otherwise(0.0))

    def out(value, reject):
        return F.struct(value.cast("double").alias("score"), F.lit(reject).alias("reject"))

    return (
        F.when(date.isNull(), out(F.lit(0.1), False))
        .when(~verdict["ok"], out(F.lit(0.0), True))
        .otherwise(out(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), False)))


def place_check(outside, municipality) -> Column:
    def out(value, reject):
        return F.struct(F.lit(value).alias("score"), F.lit(reject).alias("reject"))

    return (
        F.when(col(outside), out(0.0, True))
        .when(col(municipality).isNotNull(), out(1.0, False))
        .otherwise(out(0.25, False)))


_DEATH, _HURT = ascii_words(L.DEATH_WORDS), ascii_words(L.HURT_WORDS)


def _simple_count(text: Column) -> Column:
    raw = F.lower(F.regexp_extract(text, L.HURT_COUNT, 1))
    table = F.create_map(*[F.lit(v) for kv in L.HEADLINE_NUMBERS.items() for v in kv])
    return F.when(raw != "", F.coalesce(raw.try_cast("int"), F.try_element_at(table, raw)))


def consistency_check(title, body, severity, deaths, hurt, municipality) -> Column:
    """struct(score, problems) comparing headline and body."""
    title, body, severity = col(title), col(body), col(severity)
    deaths, hurt, municipality = col(deaths), col(hurt), col(municipality)
    t_count, b_count = _simple_count(title), _simple_count(body)
    # A blank body still counts as one (empty) piece, as splitting an empty text does.
    n_words = F.greatest(word_count(body), F.lit(1))
    holds = {
        "muerte_solo_en_titular": title.rlike(_DEATH) & ~body.rlike(_DEATH),
        "heridos_solo_en_titular": title.rlike(_HURT) & ~body.rlike(_HURT),
        "grave_sin_cifras": (severity == "GRAVE") & (deaths == 0) & (F.coalesce(hurt, F.lit(0)) <= 1),
        "grave_a_cero": (deaths == 0) & (hurt == 0) & (severity == "GRAVE"),
        "cifras_distintas": F.abs(t_count - b_count) > 1,
        "cuerpo_corto": n_words < 40,
    }
    rules = [(name, cost, holds[name]) for name, cost in L.CONSISTENCY_COSTS.items()]
    score = F.lit(1.0)
    for _, cost, bad in rules:
        score = score - F.when(bad, cost).otherwise(0.0)
    score = score - F.when(municipality.isNull(), 0.05).otherwise(0.0)
    problems = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, _, bad in rules]))
    return F.struct(F.greatest(F.lit(0.0), score).alias("score"), problems.alias("problems"))


def body_check(body, title) -> Column:
    body, title = col(body), col(title)
    n = word_count(body)
    band = F.when(n >= 250, 1.0).when(n >= 120, 0.8).when(n >= 60, 0.6).when(n >= 30, 0.35).otherwise(0.15)
    flat_title = F.lower(F.trim(title))
    echo = (F.char_length(flat_title) > 25) & F.contains(F.lower(body), flat_title) & (n < 60)
    return F.when(n == 0, 0.2).when(echo, F.least(band, F.lit(0.2))).otherwise(band)


def source_score(base, streak, success_rate) -> Column:
    rate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(success_rate), F.lit(0.5))))
    penalty = F.least(F.lit(0.5), col(streak) * F.lit(0.15))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(base) * 0.6 + rate * 0.4 - penalty))


def confidence(scores: dict[str, Column]) -> Column:
    total = sum(L.CHECK_WEIGHTS.values())
    return sum((scores[k] * F.lit(w) for k, w in L.CHECK_WEIGHTS.items()), F.lit(0.0)) / F.lit(total)


def verification_status(reject, conf, source) -> Column:
    return (
        F.when(col(reject), F.lit("REJECTED"))
        .when((col(conf) >= L.GOOD_CONFIDENCE) & (col(source) >= 0.5), F.lit("VERIFIED"))
        .when(col(conf) < L.MIN_CONFIDENCE, F.lit("SUSPICIOUS"))
        .otherwise(F.lit("PENDING_REVIEW")))


def with_verification(df: DataFrame, as_of: Column, title: str = "title", body: str = "body",
                      date: str = "date", date_confidence: str = "date_confidence",
                      source: str = "source_score") -> DataFrame:
    """Add every check, the confidence and the status to rows that carry ``facts`` and ``relevance``."""
    df = (
        df.withColumn("date_check", date_check(date, date_confidence, as_of))
        .withColumn("place_check", place_check("facts.outside", "facts.municipality"))
        .withColumn("consistency_check", consistency_check(
            title, body, "facts.severity", "facts.fatalities", "facts.injuries", "facts.municipality"))
        .withColumn("body_score", body_check(body, title))
    )
    scores = {
        "date": F.col("date_check.score"), "place": F.col("place_check.score"),
        "consistency": F.col("consistency_check.score"), "body": F.col("body_score"),
        "relevance": F.col("relevance"),
    }
    return (
        df.withColumn("_conf", confidence(scores))
        .withColumn("auto_reject", F.col("date_check.reject") | F.col("place_check.reject"))
        .withColumn("verification", verification_status("auto_reject", "_conf", source))
        .withColumn("confidence", F.round("_conf", 3)).drop("_conf")
    )


# --- editorial errors ------------------------------------------------------------------

def editorial_errors(df: DataFrame, out: str = "errors") -> DataFrame:
    """Array of (code, level). Needs title summary body category detected reread municipality
    place_from_text occurred_at source_score severity vehicle_type."""
    c = F.col
    df = df.withColumn("_text", F.trim(F.concat_ws(" ", "title", "summary", "body")))
    df = df.withColumn("_n", norm("_text")).withColumn("_tn", F.concat_ws(" ", norm("title"), "_n"))
    df = df.withColumn("_h", digest("_tn"))
    df = df.withColumn("_gate", traffic_gate("_tn", "_h")).withColumn("_scope", scope_gate("_tn", "_h"))
    names = F.create_map(*[F.lit(v) for slug, name, _, _ in MUNICIPALITIES for v in (slug, plain(name))])
    town = F.try_element_at(names, c("municipality"))
    incident = F.coalesce(c("category").isin(L.INCIDENT_FAMILY), F.lit(False))
    odd_severity = c("severity").isNotNull() & (c("severity") != "MODERADO")
    odd_vehicle = c("vehicle_type").isNotNull() & (c("vehicle_type") != "OTROS")
    rules = [
        ("ACCIDENTE_SIN_SENAL", "grave", incident & ~c("_gate.accident")),
        ("FUERA_DE_LA_ISLA", "grave", ~c("_scope.local")),
        ("TIPO_NO_ENCUADRA", "aviso", c("detected").isNotNull() & c("reread").isNull() & (c("detected") != "OTRO")),
        ("MUNICIPIO_NO_DICHO", "aviso",
         ~c("place_from_text") | (town.isNotNull() & ~F.contains(c("_n"), town))),
        ("GRAVEDAD_SIN_SENTIDO", "aviso", ~incident & odd_severity),
        ("GRAVEDAD_SIN_SENTIDO", "nota", ~incident & ~odd_severity & odd_vehicle),
        ("SIN_FECHA", "aviso", c("occurred_at").isNull()),
        ("FUENTE_DEBAJO", "nota", (c("source_score") > 0) & (c("source_score") < 0.4)),
    ]
    listed = F.array_compact(F.array(*[
        F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level")))
        for code, level, bad in rules]))
    empty = F.expr("cast(array() as array<struct<code:string,level:string>>)")
    return df.withColumn(out, F.when(c("_text") != "", listed).otherwise(empty)).drop(
        "_text", "_n", "_tn", "_h", "_gate", "_scope")


def level_count(errors, level: str) -> Column:
    return F.size(F.filter(col(errors), lambda e: e["level"] == level))


# --- publication -----------------------------------------------------------------------

def publication_blockers(**limits) -> Column:
    """Reasons that stop automatic publication. An empty array means publish.

    Needs is_duplicate verification confidence source_score rewritten n_words place_known
    n_grave n_aviso n_pii age_hours.
    """
    k = {**L.PUBLISH, **limits}
    c = F.col
    return violations({
        "duplicada": ~c("is_duplicate"), "verificacion": c("verification") == "VERIFIED",
        "confianza": c("confidence") >= k["min_confidence"], "fuente": c("source_score") >= k["min_source"],
        "sin_reescribir": c("rewritten"), "corta": c("n_words") >= k["min_words"],
        "sin_municipio": c("place_known"), "graves": c("n_grave") == 0,
        "avisos": c("n_aviso") <= k["max_warnings"], "datos_personales": c("n_pii") == 0,
        "antigua": c("age_hours") <= k["max_age_hours"],
    })
