"""Date parsing with confidence, validation, and the local calendar."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules import lexicon as L
from .text import bind, col


def _try_ts(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt))


def parse_source_date(c, assume_local: bool = False) -> Column:
    """struct(date, confidence). Ambiguous or unknown spellings give null, never a guess."""
    return bind(F.trim(col(c)), lambda v: _parse(v, assume_local))


def _parse(v: Column, assume_local: bool) -> Column:
    # RFC 822: the weekday is informative only.
    rfc = F.regexp_replace(F.regexp_replace(v, r"^[A-Za-z]{3},\s+", ""), r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    rfc = F.regexp_replace(rfc, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2})(\s)", "$1:00$2")
    rfc_ts = F.coalesce(_try_ts(rfc, "d MMM yyyy HH:mm:ss Z"), _try_ts(rfc, "d MMM yyyy HH:mm:ss"))
    is_rfc = v.rlike(r"^[A-Za-z]{3},\s")
    zoned = v.rlike(r"(?i)(?:Z|[+\-]\d{2}:?\d{2})$")
    is_iso = v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    iso_ts = v.try_cast("timestamp")
    local_iso = local_to_utc(iso_ts)
    is_day = v.rlike(r"^\d{4}-\d{2}-\d{2}$")
    a = F.regexp_extract(v, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 1).try_cast("int")
    b = F.regexp_extract(v, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 2).try_cast("int")
    y = F.regexp_extract(v, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", 3).try_cast("int")
    day = F.when(a > 12, a).when(b > 12, b)
    month = F.when(a > 12, b).otherwise(a)
    slash_ts = F.format_string("%04d-%02d-%02d 12:00:00", y, month, day).try_cast("timestamp")

    def out(ts, confidence):
        return F.when(ts.isNotNull(), F.struct(ts.alias("date"), F.lit(confidence).alias("confidence")))

    plain_iso = local_iso if assume_local else iso_ts
    return (
        F.when(is_rfc, out(rfc_ts, "certain"))
        .when(is_iso & zoned, out(iso_ts, "certain"))
        .when(is_iso | is_day, out(plain_iso, "likely"))
        .when(day.isNotNull(), out(slash_ts, "certain")))


def validate_date(c, as_of: Column, max_age_days: int = L.MAX_AGE_DAYS, slack_minutes: int = 90) -> Column:
    """struct(ok, problem, corrected)."""
    ts = col(c)
    ahead = F.unix_micros(ts) - F.unix_micros(as_of)
    minute = 60_000_000

    def out(ok, problem, corrected):
        return F.struct(F.lit(ok).alias("ok"), F.lit(problem).cast("string").alias("problem"),
                        corrected.cast("timestamp").alias("corrected"))

    none = F.lit(None)
    return (
        F.when(ts.isNull(), out(False, "sin-fecha", none))
        .when((F.year(ts) < 2000) | (F.year(ts) > F.year(as_of) + 1), out(False, "imposible", none))
        .when(ahead > slack_minutes * minute, out(False, "futura", none))
        .when(ahead > 0, out(True, None, as_of))
        .when(-ahead > max_age_days * 1440 * minute, out(False, "muy-antigua", none))
        .otherwise(out(True, None, ts)))


def local_to_utc(c) -> Column:
    """Two-pass offset lookup: the repeated autumn hour means the later instant."""
    wall = F.unix_micros(col(c))

    def offset(micros):
        ts = F.timestamp_micros(micros)
        return F.unix_micros(F.from_utc_timestamp(ts, L.LOCAL_ZONE)) - micros

    return F.timestamp_micros(wall - offset(wall - offset(wall)))


def utc_to_local(c) -> Column:
    return F.from_utc_timestamp(col(c), L.LOCAL_ZONE)


def resolve_occurred(article_date, feed_date, clock, fallback) -> Column:
    """Article date, else feed date, else the fallback; a clock time in the text replaces its time."""
    base = F.coalesce(col(article_date), col(feed_date))
    clock = col(clock)
    stamped = F.concat(F.date_format(base, "yyyy-MM-dd"), F.lit(" "), clock, F.lit(":00")).try_cast("timestamp")
    return F.when(base.isNull(), col(fallback)).when(clock.isNull(), base).otherwise(
        F.coalesce(local_to_utc(stamped), base))


def year_window(year) -> tuple[Column, Column]:
    """[start, end) of a local calendar year, as UTC instants."""
    year = col(year)

    def start(y):
        return local_to_utc(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))

    return start(year), start(year + 1)


def valid_year(year) -> Column:
    return col(year).between(2000, 2100)


def year_closed(year, as_of) -> Column:
    return year_window(year)[1] <= col(as_of)


def year_countdown(year, as_of) -> Column:
    """struct(days, hours, minutes) left in the local year, null once it is over."""
    left = F.floor((F.unix_micros(year_window(year)[1]) - F.unix_micros(col(as_of))) / 60_000_000)
    return F.when(~year_closed(year, as_of), F.struct(
        F.floor(left / 1440).alias("days"), F.floor((left % 1440) / 60).alias("hours"),
        (left % 60).alias("minutes")))


def week_start(c) -> Column:
    """Monday 00:00 UTC."""
    return F.date_trunc("week", col(c))


def relative_time(c, as_of) -> Column:
    mins = F.floor((F.unix_micros(col(as_of)) - F.unix_micros(col(c))) / 60_000_000)
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)
    months, years = F.floor(days / 30), F.floor(days / 365)

    def ago(n, unit):
        return F.concat(F.lit("hace "), n.cast("string"), F.lit(" "), unit)

    return (
        F.when(mins < 1, F.lit("ahora mismo")).when(mins < 60, ago(mins, F.lit("min")))
        .when(hours < 24, ago(hours, F.lit("h"))).when(days == 1, F.lit("ayer"))
        .when(days < 30, ago(days, F.lit("días")))
        .when(months < 12, ago(months, F.when(months == 1, "mes").otherwise("meses")))
        .otherwise(ago(years, F.when(years == 1, "año").otherwise("años"))))


def part_of_day(local_hour) -> Column:
    h = col(local_hour)
    return (
        F.when((h >= 6) & (h < 12), F.lit("esta mañana")).when((h >= 12) & (h < 15), F.lit("a mediodía"))
        .when((h >= 15) & (h < 21), F.lit("esta tarde")).when((h >= 21) & (h < 24), F.lit("esta noche"))
        .when(h.isNotNull(), F.lit("de madrugada")))
