"""SQL spellings of the text rules, used only by the oracle twins."""

from __future__ import annotations

from ..rules import lexicon as L
from .bindings import sql_list


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normtext(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), "
            f"'\\s+', ' ', 'g'))")


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def tokens(name: str, source: str, text: str, key: str = "id") -> str:
    """CTE of distinct tokens with their first position."""
    return (
        f"{name} AS (SELECT {key}, t, min(i) AS i FROM (SELECT {key}, unnest(w) AS t, generate_subscripts(w, 1) AS i "
        f"FROM (SELECT {key}, string_split({normtext(text)}, ' ') AS w FROM {source})) "
        f"WHERE length(t) >= 3 AND t NOT IN ({sql_list(sorted(set(L.STOPWORDS)))}) GROUP BY {key}, t)")


def fnv(x: str) -> str:
    units = ("flatten(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] "
             "ELSE [55296 + ((unicode(c) - 65536) >> 10)::BIGINT, 56320 + ((unicode(c) - 65536) & 1023)::BIGINT] END))").replace("{x}", x)
    return (f"list_reduce(list_prepend(2166136261::BIGINT, {units}), "
            f"lambda h, c: (xor(h, c) * 16777619) & 4294967295)")


def simhash(name: str, toks: str, key: str = "id") -> str:
    """CTEs ending in ``name(key, simhash)``: every bit voted from its own hash."""
    step = "(xor({h}, {c}) * 16777619) & 4294967295"
    h1 = step.format(h="h", c="35")
    h2 = step.format(h=f"({h1})", c="unicode(left(b::VARCHAR, 1))")
    h3 = step.format(h=f"({h2})", c="unicode(right(b::VARCHAR, 1))")
    return f"""
{name}_l AS (SELECT {key}, list(t ORDER BY i) AS l FROM {toks} GROUP BY {key}),
{name}_s AS (SELECT {key}, unnest(CASE WHEN len(l) = 1 THEN l ELSE list_concat(
    list_transform(range(1, len(l)), lambda k: array_to_string(l[k:k + 1], '_')),
    list_transform(range(1, len(l) - 1), lambda k: array_to_string(l[k:k + 2], '_'))) END) AS s FROM {name}_l),
{name}_h AS (SELECT {key}, {fnv('s')} AS h FROM {name}_s),
{name}_v AS (SELECT {key}, b, sum(CASE WHEN (CASE WHEN b < 32 THEN (h >> b) & 1 ELSE ({h3}) & 1 END) = 1 THEN 1 ELSE -1 END) AS v
    FROM {name}_h, range(0, 64) r(b) GROUP BY {key}, b),
{name}_n AS (SELECT {key}, b // 4 AS nib, CAST(sum(CASE WHEN v > 0 THEN 1 << (3 - b % 4) ELSE 0 END) AS INT) AS x FROM {name}_v GROUP BY {key}, b // 4),
{name} AS (SELECT {key}, string_agg(format('{{:x}}', x), '' ORDER BY nib) AS simhash FROM {name}_n GROUP BY {key})"""


def hamming(a: str, b: str) -> str:
    return f"bit_count(xor(('0x' || {a})::UBIGINT, ('0x' || {b})::UBIGINT))"


def trim_all(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def entities(x: str) -> str:
    for name in [n for n in L.ENTITIES if n != "amp"] + ["amp"]:
        x = f"regexp_replace({x}, '&{name};', {lit(L.ENTITIES[name])}, 'gi')"
    return x


def strip_markup(x: str) -> str:
    for tag in ("script", "style", "noscript"):
        x = f"regexp_replace({x}, '<{tag}.*?</{tag}>', ' ', 'gis')"
    x = f"regexp_replace({x}, '<br\\s*/?>', chr(10), 'gi')"
    x = f"regexp_replace({x}, '</(?:p|div|h[1-6]|li|tr)>', chr(10) || chr(10), 'gi')"
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def redacted(x: str) -> tuple[str, list[tuple[str, str]]]:
    """Redacted text and, per rule, (type, list of hits)."""
    hits = []
    for kind, pattern, mark in L.PII_RULES:
        hits.append((kind, f"regexp_extract_all({x}, {lit(pattern)})"))
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(mark)}, 'g')"
    return x, hits


def rule_case(text: str, rules, otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, {lit(p)}) THEN '{n}'" for n, p in rules)
    return f"CASE {whens} ELSE {otherwise} END"


def has_term(padded: str, term: str) -> str:
    return f"contains({padded}, {lit(' ' + term + ' ')})"
