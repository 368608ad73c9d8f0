"""Text columns against small Python models and known anchors."""

import tracemalloc
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from tidewire.functions import text as T, urls as U
from tidewire.functions.dates import local_to_utc, parse_source_date, validate_date
from tidewire.functions.wordlist import expand, tree_pattern


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


def fnv(s):
    h = 2166136261
    for i in range(0, len(s.encode("utf-16-le")), 2):
        h = ((h ^ int.from_bytes(s.encode("utf-16-le")[i:i + 2], "little")) * 16777619) & 0xFFFFFFFF
    return h


def simhash_model(tokens):
    """Every one of the 64 bits voted from its own hash."""
    if not tokens:
        return "0" * 16
    grams = ["_".join(tokens[i:i + n]) for n in (2, 3) for i in range(len(tokens) - n + 1)] or tokens
    votes = [0] * 64
    for g in grams:
        h = fnv(g)
        for b in range(64):
            bit = (h >> b) & 1 if b < 32 else fnv(f"{g}#{b}") & 1
            votes[b] += 1 if bit else -1
    return f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):016x}"


def test_simhash_equals_model(spark):
    texts = ["", "uno", "perro gato", "Choque múltiple en la LZ-2 con siete heridos graves 😀 emoji", "α β γδε ζητα θικλ " * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(
        T.tokenize("v").alias("t"), T.simhash("v").alias("h")).collect()
    for r in rows:
        assert r.h == simhash_model(r.t)


def test_tokens_keep_first_occurrence(spark):
    assert one(spark, "La Gata, la gata y el PERRO según año café", T.tokenize) == ["gata", "perro", "cafe"]


# Anchor texts whose distances are known.
SAME_1 = "Un turismo se salio de la via y volco en la carretera LZ-2 a la altura de Tias. Resultaron heridos leves."
SAME_2 = "Un turismo volco al salirse de la via en la LZ-2, en Tias. Hubo heridos leves."
OTHER = "La.sequence fibonacci recorre todos los numeros primos impares del siglo con detalle exhaustivo"


def test_distance_anchors(spark):
    r = spark.createDataFrame([(SAME_1, SAME_2, OTHER)], "a string, b string, c string").select(
        T.hamming(T.simhash("a"), T.simhash("b")).alias("near"), T.hamming(T.simhash("a"), T.simhash("c")).alias("far"),
        T.jaccard(F.array(*map(F.lit, "abcdx")), F.array(*map(F.lit, "abcdy"))).alias("j")).first()
    assert 12 < r.near < 20 and r.far > 24 and r.j > 0.6


def test_entities_and_markup(spark):
    assert one(spark, "&#233;&#x78; &Aacute;&amp;lt; &unknown; &#9999999;", T.decode_entities) == "éx á&lt; &unknown; &#9999999;"
    assert one(spark, "<p>a<br/>b</p><script>x</script> c", T.html_to_text) == "a\nb\n\n c"


def test_truncate(spark):
    assert one(spark, "uno dos tres cuatro", lambda c: T.truncate(c, 15)) == "uno dos tres…"
    assert one(spark, "unodostrescuatrocinco", lambda c: T.truncate(c, 10)) == "unodostres…"
    assert one(spark, "corto", lambda c: T.truncate(c, 10)) == "corto"


def test_pii_rules_run_in_order(spark):
    r = one(spark, "Coche 1234 ABC, tel. +34 612345678 y 612 345 678, dni 12345678-Z, é612345678, a.b@c.es", T.redact_pii)
    assert r.clean == ("Coche [matricula omitida], tel. [telefono omitido] y [telefono omitido], dni [documento omitido], "
                       "é[telefono omitido], [correo omitido]")
    assert [f.type for f in r.findings] == ["MATRICULA", "TELEFONO", "TELEFONO", "TELEFONO", "DOCUMENTO", "EMAIL"]


def test_lost_numbers(spark):
    df = spark.createDataFrame([("Hay 7 heridos y 4 fallecidos a las 14 h del lunes", "Hubo siete heridos")], "a string, b string")
    r = df.select(T.significant_numbers("a").alias("s"), T.lost_numbers("a", "b").alias("l")).first()
    assert 4 in r.l and 7 not in r.l and 7 in r.s


def test_urls(spark):
    assert one(spark, "https://www.Medio.es/Nota/?utm_source=x&id=3#f", U.normalize_url) == "https://medio.es/nota?id=3"
    assert one(spark, "http://medio.es/a", U.url_hash) != one(spark, "https://medio.es/a", U.url_hash)
    assert one(spark, "https://medio.es/nota/amp/?gclid=1", U.canonicalize_url) == "https://medio.es/nota"
    assert one(spark, " No Es Url ", U.normalize_url) == "no es url"


def test_dates(spark):
    parsed = lambda v: one(spark, v, parse_source_date)
    assert parsed("01/10/2026") is None and parsed("algo") is None and parsed(None) is None
    assert parsed("25/12/2025").date == datetime(2025, 12, 25, 12)
    assert parsed("Mon, 06 Jan 2025 10:20:30 +0100").date == datetime(2025, 1, 6, 9, 20, 30)
    assert parsed("2025-01-06T10:20:30Z").confidence == "certain" and parsed("2025-01-06").confidence == "likely"
    as_of = F.lit("2026-01-10 12:00:00").cast("timestamp")
    check = lambda v: one(spark, v, lambda c: validate_date(c.cast("timestamp"), as_of))
    assert check("2026-01-10 15:00:00").problem == "futura" and check("2025-11-01").problem == "muy-antigua"
    assert check("2026-01-10 12:30:00").corrected == datetime(2026, 1, 10, 12) and check("1999-01-01").problem == "imposible"


def test_local_time(spark):
    local = lambda v: one(spark, v, lambda c: local_to_utc(c.cast("timestamp")))
    assert local("2026-07-01 10:00:00") == datetime(2026, 7, 1, 9) and local("2026-01-01 10:00:00") == datetime(2026, 1, 1, 10)


def test_word_list_patterns():
    import re
    assert sorted(expand("rescatad[oa]s?")) == ["rescatada", "rescatadas", "rescatado", "rescatados"]
    assert re.fullmatch(tree_pattern(["bus", "busto", "ave", "aves", "a coruna"]), "busto")


def test_memory_of_simhash_does_not_follow_the_batch():
    def peak(rows):
        lists = pa.array([[f"w{i * 37 + j}" for j in range(50)] for i in range(rows)], pa.list_(pa.string()))
        tracemalloc.start()
        out = T._simhashes(lists, 1 << 10)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    few, small = peak(200)
    many, large = peak(2000)
    assert many[:200] == few and len(many) == 2000
    assert large < 2 * small
