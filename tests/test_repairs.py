"""Cases that once gave wrong or partial results."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import catalog as C, cluster as K, dedupe as D
from tidewire.session import DEFAULTS, clear_steps, exists, get_session, materialize, step_path
from tidewire.streaming import live


def test_numeric_references_of_any_length(spark):
    raw = "&#00000000233;&#x0000000000e9;&#233;&#x1F600;&#1114112;&#x110000;&#99999999999;&#0;"
    got = spark.sql(f"SELECT '{raw}' AS t").select(T.decode_entities("t")).first()[0]
    assert got == "ééé😀&#1114112;&#x110000;&#99999999999;\0"


def test_hash_over_utf16_units(spark):
    def fnv(text):
        h, raw = 2166136261, text.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i:i + 2])) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "a", "a\U00020000b", "ñ" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fnv1a("t").alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: fnv(t) for t in texts}


@pytest.mark.parametrize("stored,want", [
    (["via-12"], ["via", "via-2", "via-3"]), (["via"], ["via-2", "via-3", "via-4"]), (["via", "via-2", "via-4"], ["via-3", "via-5", "via-6"]),
    (["via-1", "via-02", "via-1000000"], ["via", "via-2", "via-3"]), (["via-2", "via-3"], ["via", "via-4", "via-5"])])
def test_free_slugs(spark, stored, want):
    rows = spark.createDataFrame([(i, "Vía") for i in range(3)], "id long, title string")
    known = spark.createDataFrame([(s,) for s in stored], "slug string")
    got = C.unique_slugs(rows, "title", ["id"], known).orderBy("id").collect()
    assert [r.slug for r in got] == want


def test_long_chains_settle(spark):
    n = 300
    links = spark.range(n).select(F.col("id").alias("node"), (F.col("id") + 1).alias("root"))
    assert {r.cluster for r in K.components(links).collect()} == {0}


def _articles(spark, rows):
    df = spark.createDataFrame(rows, "id long, title string, body string, at long")
    return D.prepare(df, "id", F.col("title"), F.col("body"), F.timestamp_seconds(F.col("at") + 1_700_000_000))


def test_equal_content_without_title_words(spark):
    body = "incendio forestal en la cumbre con varias dotaciones desplazadas durante toda la noche"
    found = D.similar_counts(_articles(spark, [(1, "de la", body, 0), (2, "el un", body, 60), (3, "", "otra cosa distinta", 90), (4, "", body, 95)]))
    assert {r.id: (r.n_similar, r.best) for r in found.collect()} == {i: (2, 0.99) for i in (1, 2, 4)}


def test_canonical_rows_are_no_duplicates(spark):
    words = "accidente grave carretera norte kilometro cuatro heridos traslado hospital general universitario".split()
    rows = [(i, " ".join(words), " ".join(words) + f" version {i}", i * 3600 * 40) for i in range(6)]
    found = materialize(D.verdicts(_articles(spark, rows), semantic=False), "verdicts")
    out = {r.id: r for r in found.collect()}
    assert {i for i in out if out[i].is_duplicate} == {1, 2, 3, 4, 5}
    assert {r.canonical_id for r in out.values() if r.is_duplicate} == {0}


def test_submit_settings_win(spark):
    given = dict(spark.sparkContext.getConf().getAll())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        again = get_session()
        assert again.conf.get("spark.sql.shuffle.partitions") == "7" and again.sparkContext.master == given["spark.master"]
        assert all(again.conf.get(k) == given.get(k, v) for k, v in DEFAULTS.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stored_steps_can_be_cleared(spark):
    materialize(spark.range(3), "gone")
    folder = step_path(spark, "x").rsplit("/", 1)[0]
    assert exists(spark, folder)
    clear_steps(spark)
    assert not exists(spark, folder)


def _page(data):
    return f'<html><script type="application/ld+json">{data}</script></html>'


@pytest.mark.parametrize("data,headline,author", [
    ('{"@type":"Article","headline":" Uno ","author":"Ana"}', "Uno", "Ana"),
    ('[[{"@graph":[{"@type":"WebPage"},{"@graph":[{"@type":["Thing","BlogPosting"],"headline":"Dos","author":[{"name":"no"},3,"Luis"]}]}]}]]', "Dos", "Luis"),
    ('{"@type":"NewsArticle","headline":["", "Tres"],"author":{"@id":"Eva"}}', "Tres", "Eva"),
    ('{"@type":"NewsArticle","headline":4,"author":[{"name":"no"}]}', None, None),
    ('[[[[[[[[{"@type":"Article","headline":"hondo"}]]]]]]]]', None, None),
    ('{"@type":"WebPage","headline":"no"}', None, None), ("not json", None, None)])
def test_linked_data_nests(spark, data, headline, author):
    from tidewire.sources import pages as P
    node = spark.createDataFrame([(_page(data),)], "html string").select(P.article_node("html").alias("n"))
    got = node.select(P._ld(F.col("n"), "headline").alias("h"), P._ld(F.col("n"), "author").alias("a")).first()
    assert (got.h, got.a) == (headline, author)


def test_bodies_in_blocks(spark):
    from tidewire.sources import pages as P
    data = '{"@type":"Article","articleBody":["' + "uno " * 15 + '",{"x":1},"' + "dos " * 15 + '"]}'
    node = spark.createDataFrame([(_page(data),)], "html string").select(P.article_node("html").alias("n"))
    assert node.select(P._ld_body(F.col("n"))).first()[0] == "uno " * 15 + "\n\n" + "dos " * 15
