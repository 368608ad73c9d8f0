"""URL canonical forms, hashes and secret masking, built on ``try_parse_url``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules import lexicon as L
from .text import col

_ABSOLUTE = r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\s]+[^\s]*$"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def _pieces(url: Column) -> dict[str, Column]:
    """Scheme, user info, host, port, path, query of an absolute URL, empty when missing."""
    rest = r"(?i)^[a-z][a-z0-9+.-]*://"
    user = rest + r"(?:[^/?#@]*@)?"
    return {
        "scheme": F.lower(_part(url, r"(?i)^([a-z][a-z0-9+.-]*)://")),
        "user": _part(url, rest + r"([^/?#@]*@)"),
        "host": F.lower(_part(url, user + r"([^/?#:]+)")),
        "port": _part(url, user + r"[^/?#:]+(:\d+)"),
        "path": _part(url, user + r"[^/?#]*([^?#]*)"),
        "query": _part(url, r"^[^?#]*\?([^#]*)"),
    }


def _kept_query(query: Column, dropped: list[str]) -> Column:
    kept = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~F.get(F.split(kv, "="), F.lit(0)).isin(dropped))
    joined = F.array_join(kept, "&")
    return F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit(""))


def _default_port(p: dict[str, Column]) -> Column:
    default = ((p["scheme"] == "https") & (p["port"] == ":443")) | ((p["scheme"] == "http") & (p["port"] == ":80"))
    return F.when(default, F.lit("")).otherwise(p["port"])


def _trim_slash(path: Column) -> Column:
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed)


def canonicalize_url(c) -> Column:
    """Feed-side form: no tracking parameters, /amp suffix, fragment or trailing slash."""
    url = col(c)
    p = _pieces(F.trim(url))
    path = _trim_slash(F.regexp_replace(p["path"], r"/amp/?$", "/"))
    out = F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], _default_port(p), path,
                   _kept_query(p["query"], L.TRACKING_FEED))
    return F.when(F.trim(url).rlike(_ABSOLUTE), out).otherwise(url)


def normalize_url(c) -> Column:
    """Dedupe-side form: more parameters dropped, no ``www.``, lower case; the scheme stays distinct."""
    url = F.trim(col(c))
    p = _pieces(url)
    out = F.concat(p["scheme"], F.lit("://"), p["user"], F.regexp_replace(p["host"], r"^www\.", ""),
                   _default_port(p), _trim_slash(p["path"]), _kept_query(p["query"], L.TRACKING_DEDUPE))
    return F.lower(F.when(url.rlike(_ABSOLUTE), out).otherwise(url))


def url_hash(c) -> Column:
    return F.sha2(normalize_url(c), 256)


def redact_url(c) -> Column:
    """Remove user and password, mask the values of secret parameters."""
    url = col(c)
    bare = F.regexp_replace(url, r"(?i)^([a-z][a-z0-9+.-]*://)[^/?#@]*@", "$1")
    keys = "|".join(L.SECRET_PARAMS)
    masked = F.regexp_replace(bare, rf"([?&](?:{keys})=)[^&#]*", "$1REDACTED")
    return F.when(url.rlike(_ABSOLUTE), masked).otherwise(url)


# What an image address looks like.
_IMAGE_FILE = r"\.(jpg|jpeg|png|webp|avif|gif|bmp|tiff?)$"
_IMAGE_PATH = r"(/image/|/images/|photo|thumb|/media/)"
_IMAGE_HOST = r"(^|\.)images?\.(arso|cmscloud|core|press|azureedge|cloudfront|fastly)\."


def looks_like_image(c) -> Column:
    url = F.trim(col(c))
    p = _pieces(url)
    path = F.lower(p["path"])
    return url.rlike(_ABSOLUTE) & p["scheme"].isin("http", "https") & (
        path.rlike(_IMAGE_FILE) | path.rlike(_IMAGE_PATH) | p["host"].rlike(_IMAGE_HOST))
