"""Ordered, block and streaming operators against brute force on small skewed fixtures."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window, functions as F

from tidewire.functions import facts as X, geo as G, quality as K
from tidewire.operators import catalog as C, cluster, dedupe as D, health as H, ordered
from tidewire.operators.similarity import instances, similar_pairs
from tidewire.functions import text as T

T0 = datetime(2026, 1, 1)


def skewed_runs(spark, n=3000):
    """One source holds two thirds of all rows."""
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"s{i % 40}", i, T0 + timedelta(minutes=rnd.randrange(40000)), rnd.random() > 0.45,
             float(rnd.randrange(50)), i % 90) for i in range(n)]
    return spark.createDataFrame(rows, "source string, run_id long, started_at timestamp, ok boolean, items double, latency_ms long")


def test_running_equals_window(spark):
    runs = skewed_runs(spark)
    w = Window.partitionBy("source").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    want = runs.select("run_id", F.sum("items").over(w).alias("s"), F.max("items").over(w).alias("m")).collect()
    got = ordered.running(runs, ["source"], ["started_at", "run_id"], {"s": ("sum", F.col("items")), "m": ("max", F.col("items"))})
    assert {tuple(r) for r in got.select("run_id", "s", "m").collect()} == {tuple(r) for r in want}


def test_look_back_with_tiny_blocks(spark):
    runs = skewed_runs(spark)
    w = Window.partitionBy("source").orderBy("started_at", "run_id")
    want = runs.select("run_id", F.round(F.avg("items").over(w.rowsBetween(-4, 0)), 9), F.lag("items").over(w)).collect()
    got = ordered.look_back(runs, ["source"], ["started_at", "run_id"], 4, lambda v: {
        "a": F.round(F.avg("items").over(v.rowsBetween(-4, 0)), 9), "l": F.lag("items").over(v)}, block=7)
    assert {tuple(r) for r in got.select("run_id", "a", "l").collect()} == {tuple(r) for r in want}


def test_scan_equals_windows(spark):
    """Positions, last positions with and without the row itself, and running values, on a hot key and on counted rows only."""
    runs = skewed_runs(spark).withColumn("counted", F.col("run_id") % 3 != 0)
    w = Window.partitionBy("source").orderBy("started_at", "run_id")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    pos = F.count(F.when(F.col("counted"), 1)).over(so_far)
    want = runs.withColumn("p", pos).select("run_id", "p", F.max(F.when(F.col("ok"), F.col("p"))).over(so_far), F.max(F.when(F.col("ok"), F.col("p"))).over(before),
                                            F.max("items").over(so_far))
    got = ordered.scan(runs, ["source"], ["started_at", "run_id"], {"a": (F.col("ok"), True), "b": (F.col("ok"), False)}, {"m": ("max", F.col("items"))}, F.col("counted"))
    assert {tuple(r) for r in got.select("run_id", "_pos", "a", "b", "m").collect()} == {tuple(r) for r in want.collect()}


def test_following_equals_search(spark):
    rows = skewed_runs(spark, 400).select("source", F.date_trunc("hour", "started_at").alias("at"), "run_id")
    probes = rows.select("source", (F.col("at") + F.expr("interval 3 hours")).alias("at"), "run_id", F.col("run_id").alias("own"))
    got = {r.own: None if r.to is None else r.to.run_id for r in ordered.following(rows, probes, ["source"], "at", "run_id", "to").collect()}
    held = rows.collect()
    for p in held:
        behind = [(r["at"], r.run_id) for r in held if r.source == p.source and (r["at"], r.run_id) > (p["at"] + timedelta(hours=3), p.run_id)]
        assert got[p.run_id] == (min(behind)[1] if behind else None)


def test_streaks_and_current_health_agree(spark):
    runs = skewed_runs(spark)
    last = H.streaks(runs).groupBy("source").agg(F.max_by(F.struct("streak", "status"), F.struct("started_at", "run_id")).alias("x"))
    a = {(r.source, r.x.streak, r.x.status) for r in last.collect()}
    b = {(r.source, r.streak, r.status) for r in H.current_health(runs).collect()}
    assert a == b


def article_fixture(spark, n=400):
    """Copies, near copies and a title shared by a third of the rows."""
    rnd = random.Random(3)
    words = [f"palabra{i}" for i in range(60)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind < 2:
            title, body = "titulo comun de portada diaria", " ".join(rnd.choices(words, k=30))
        elif kind == 2:
            title, body = "copia exacta repetida siempre", "mismo cuerpo repetido varias veces igual"
        else:
            base = rnd.randrange(12)
            title = " ".join(words[base:base + 8]) + (f" extra{rnd.randrange(2)}" if kind == 5 else "")
            body = " ".join(words[base:base + 25]) + f" fin{rnd.randrange(3)}"
        rows.append((i, title, body, T0 + timedelta(hours=rnd.randrange(400)), f"https://m.es/{i % 150}" if kind == 4 else None))
    df = spark.createDataFrame(rows, "id long, title string, body string, ts timestamp, url string")
    return D.prepare(df, "id", F.col("title"), F.col("body"), F.col("ts"), F.col("url"))


def jac(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def ham(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_verdicts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D.blocks, "BLOCK", 16)
    arts = article_fixture(spark)
    rows = arts.collect()
    want = {}
    for a in rows:
        best = None
        for b in rows:
            if (b.ts, b.id) >= (a.ts, a.id) or a.ts - b.ts > timedelta(hours=72):
                continue
            j, h = jac(a.title_tokens, b.title_tokens), ham(a.simhash, b.simhash)
            if a.url_key and a.url_key == b.url_key:
                hit = (1.0, "url")
            elif a.content_hash == b.content_hash:
                hit = (0.99, "contenido")
            elif (h <= 12 and j >= 0.86) or j >= 0.95:
                hit = ((1 - h / 64) * 0.6 + j * 0.4, "simhash" if h <= 12 else "titulo")
            else:
                continue
            if best is None or (hit[0], b.ts, b.id) > best[0]:
                best = ((hit[0], b.ts, b.id), b.id, hit[1])
        want[a.id] = (best[1], best[2]) if best else (None, None)
    for a in sorted(rows, key=lambda r: (r.ts, r.id)):  # a canonical row is no duplicate itself
        to, level = want[a.id]
        want[a.id] = (want[to][0] if to is not None and want[to][0] is not None else to, level)
    got = {r.id: (r.canonical_id, r.level) for r in D.verdicts(arts, semantic=False).collect()}
    assert got == want


def test_similar_counts_equal_brute_force(spark):
    arts = article_fixture(spark, 240)
    rows = arts.collect()
    want = {}
    for a in rows:
        scores = [0.99 if a.content_hash == b.content_hash else (1 - ham(a.simhash, b.simhash) / 64) * 0.6 + jac(a.title_tokens, b.title_tokens) * 0.4
                  for b in rows if b.id != a.id and abs(a.ts - b.ts) <= timedelta(hours=72)]
        n = sum(s >= 0.8 - 1e-12 for s in scores)
        if n:
            want[a.id] = n
    assert {r.id: r.n_similar for r in D.similar_counts(arts).collect()} == want
    some = next(iter(want))
    assert D.similar_to(arts, some).count() == want[some]


def test_similar_pairs_equal_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, [f"t{x}" for x in sorted(set(rnd.choices(range(14), k=rnd.randrange(1, 8))))]) for i in range(300)]
    sets = instances(spark.createDataFrame(rows, "id long, toks array<string>"), "id", "toks")
    reps = {r.inst: r.toks for r in sets.collect()}
    for t in (0.5, 0.6, 0.86):
        want = {(a, b) for a in reps for b in reps if a < b and jac(reps[a], reps[b]) >= t - 1e-12}
        assert {(r.inst_a, r.inst_b) for r in similar_pairs(sets, t, False).collect()} == want


def test_similar_pairs_of_long_sets_stay_off_the_driver(spark):
    """Rows of a prefix token carry no token arrays, and no side that grows with the sets is broadcast."""
    sets = instances(spark.createDataFrame([(i, [f"t{x}" for x in range(i, i + 60)]) for i in range(40)], "id long, toks array<string>"), "id", "toks")
    pairs = similar_pairs(sets, 0.6, False)
    assert {(r.inst_a, r.inst_b) for r in pairs.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40) if (60 - b + a) / (60 + b - a) >= 0.6}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "posexplode" in line and "toks" in line]


def test_equal_contents_under_other_titles_in_neighbouring_buckets(spark):
    """One content in many buckets and without a title too: counted in its own and the neighbouring windows, as by brute force."""
    rows = [(i, [[], ["a", "b"], ["c", "d"]][i % 3], T0 + timedelta(hours=40 * i), "same", "00" * 8, None) for i in range(24)]
    arts = spark.createDataFrame(rows, "id long, title_tokens array<string>, ts timestamp, content_hash string, simhash string, url_key string")
    want = {a[0]: sum(a[0] != b[0] and abs(a[2] - b[2]) <= timedelta(hours=72) for b in rows) for a in rows}
    assert {r.id: r.n_similar for r in D.similar_counts(arts).collect()} == want


def test_cleanup_clusters_equal_union_find(spark):
    arts = article_fixture(spark, 300)
    rows = arts.collect()
    root = {r.id: r.id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            if a.id < b.id and abs(a.ts - b.ts) <= timedelta(hours=48) and (
                    a.content_hash == b.content_hash or (ham(a.simhash, b.simhash) <= 8 and jac(a.title_tokens, b.title_tokens) >= 0.6)):
                x, y = find(a.id), find(b.id)
                root[max(x, y)] = min(x, y)
    want = {r.id: find(r.id) for r in rows}
    linked = {i for i in want if list(want.values()).count(want[i]) > 1}
    got = {r.node: r.cluster for r in cluster.components(D.cleanup_links(arts)).collect()}
    assert got == {i: want[i] for i in linked}


def test_leaders_are_greedy(spark):
    links = [(1, 2), (2, 3), (3, 4), (5, 6), (2, 6)]
    nodes = spark.createDataFrame([(i, i) for i in range(1, 8)], "node long, seq long")
    got = {r.node: r.cluster for r in cluster.leaders(nodes, spark.createDataFrame(links, "node long, root long")).collect()}
    # 1 leads and takes 2; 3 has no earlier leader (2 follows), leads and takes 4; 5 leads and takes 6.
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}


def test_semantic_level(spark):
    rnd = random.Random(5)
    vec = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, f"noticia{i:03d} sobre asunto{i:03d}", f"cuerpo{i:03d} propio{i:03d}", T0 + timedelta(hours=i), [v + rnd.gauss(0, 0.02) for v in vec[i % 6]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, body string, ts timestamp, e array<double>")
    arts = D.prepare(df, "id", F.col("title"), F.col("body"), F.col("ts"), None, F.col("e").cast("array<float>"))
    got = {r.id: r.candidate for r in D.semantic_duplicates(arts).collect()}
    assert set(got) == set(range(6, 60)) and all(i % 6 == c % 6 and c < i for i, c in got.items())


def test_slugs_respect_existing(spark):
    df = spark.createDataFrame([(1, "Caída"), (2, "Caida"), (3, "!!!"), (4, "otra")], "id long, t string")
    old = spark.createDataFrame([("caida",), ("caida-4",)], "slug string")
    got = {r.id: r.slug for r in C.unique_slugs(df, "t", ["id"], old).collect()}
    assert got == {1: "caida-2", 2: "caida-3", 3: "accidente", 4: "otra"}


def test_facts_anchors(spark):
    rows = [
        ("Choque con 7 heridos en la LZ-2 en Tías", "Sobre las 18:30 chocaron un coche y una moto. Cuatro heridos más."),
        ("La Vuelta Ciclista reparte premios", "El ciclista ganó la carrera en Costa Teguise."),
        ("Receta de la semana", "Mezclar harina y azúcar."),
        ("Atropello en Corralejo", "Un peatón resultó ileso."),
    ]
    r = X.with_facts(spark.createDataFrame(rows, "t string, b string"), "t", "b").collect()
    assert (r[0].facts.injuries, r[0].facts.road, r[0].facts.municipality, r[0].facts.time_of_day) == (11, "LZ-2", "tias", "18:30")
    assert r[0].facts.category == "ACCIDENTE_TRAFICO" and r[0].facts.severity == "MODERADO"
    assert r[1].facts.category == "DEPORTES" and r[1].facts.zone == "costa-teguise"
    assert r[2].facts.category is None and r[2].facts.municipality is None and r[2].relevance == 0
    assert r[3].facts.outside and r[3].facts.injuries == 0 and r[3].facts.category == "ATROPELLO"


def test_shared_facts_equal_facts_per_row(spark):
    """The rules run once per distinct pair of texts, nulls included, and every row gets what it would get by itself."""
    texts = [("Choque con 7 heridos en la LZ-2 en Tías", "Sobre las 18:30 chocaron un coche y una moto."), ("Receta", None), (None, "Atropello en Yaiza"),
             (None, None), ("Receta", "")]
    df = spark.createDataFrame([(i, *texts[i % 5]) for i in range(60)], "id long, t string, b string")
    columns = ["id", "facts", "relevance", "_t", "_b", "_c", "_h"]
    want = {r.id: r for r in X.with_facts(df, "t", "b").select(*columns).collect()}
    shared = X.with_shared_facts(df, "t", "b").select(*columns)
    assert {r.id: r for r in shared.collect()} == want
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [") > plan.index("Repartition ")  # facts are made above the distinct texts


def test_publication_gate_breaks_one_by_one(spark):
    good = dict(is_duplicate=False, verification="VERIFIED", confidence=0.9, source_score=0.7, rewritten=True, n_words=200,
                place_known=True, n_grave=0, n_aviso=0, n_pii=0, age_hours=3)
    bad = dict(is_duplicate=True, verification="SUSPICIOUS", confidence=0.84, source_score=0.59, rewritten=False, n_words=119,
               place_known=False, n_grave=1, n_aviso=1, n_pii=1, age_hours=25)
    rows = [good] + [{**good, k: v} for k, v in bad.items()] + [bad]
    sizes = [len(r.b) for r in spark.createDataFrame(rows).select(K.publication_blockers().alias("b")).collect()]
    assert sizes == [0] + [1] * 11 + [11]


def test_pins(spark):
    square = [[(28.9, -13.7), (28.9, -13.5), (29.1, -13.5), (29.1, -13.7)]]
    df = spark.range(200).select("id", F.lit(29.0).alias("lat"), F.lit(-13.51).alias("lon"))
    p = df.withColumn("p", G.displaced("id", "lat", "lon", square)).select(
        "id", "p", G.haversine_km("lat", "lon", "p.lat", "p.lon").alias("km"), G.is_safe_site("p.lat", "p.lon", square).alias("safe"))
    rows = p.collect()
    assert all(r.safe and 0.1 <= r.km <= 0.91 for r in rows)
    again = {r.id: r.p for r in p.collect()}
    assert all(again[r.id] == r.p for r in rows)
    sea = spark.range(1).select(F.lit(1).alias("id"), F.lit(20.0).alias("lat"), F.lit(0.0).alias("lon"))
    assert sea.select(G.displaced("id", "lat", "lon", square).alias("p")).first().p is None


def test_displacement_tries_batches(spark):
    """Tries are made for whole batches; null keys keep their own point, nulls stay null, and each place is the first safe try."""
    square = [[(28.9, -13.8), (28.9, -13.7), (29.0, -13.7), (29.0, -13.8)]]
    rows = [(i, 28.9 + i % 50 / 490, -13.8 + i // 50 / 390) for i in range(2000)] + [(None, 28.95, -13.75), (1, None, -13.75)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double").withColumn("p", G.displaced("id", "lat", "lon", square))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    got = df.withColumn("safe", G.is_safe_site("p.lat", "p.lon", square)).collect()
    assert all(r.safe for r in got if r.p) and sum(r.p is not None for r in got) > 1900
    assert [(r.p.lat, r.p.lon) for r in got if r.id is None] == [(28.95, -13.75)] and [r.p for r in got if r.lat is None] == [None]


def test_copy_overlap(spark):
    df = spark.createDataFrame([("a b c d e f g h", "x a b c d e f y"), ("a b", "a b")], "o string, r string")
    w = df.select(T.words(T.normalize_text("o")).alias("o"), T.words(T.normalize_text("r")).alias("r"))
    assert [round(r.x, 4) for r in w.select(T.copy_overlap("o", "r").alias("x")).collect()] == [round(1 / 3, 4), 0.0]


def test_page_bodies(spark):
    from tidewire.sources.bodies import page_bodies
    para = "Una frase larga de noticia con bastante texto para contar como cuerpo. " * 3
    link = "<a>" + "enlace " * 60 + "</a>"
    html = {
        "nested": f"<body><nav><p>{para}</p></nav><div class='sidebar'><p>{para}{para}</p></div><div id='x'><div class='content'>"
                  f"<p>{para}<p>{para}<b>fin</b></p></div></div><p>corto</p></body>",
        "loose": f"<p>{para}<div></div><p>{para}<script>var a = '</p><p>no';</script></p>",
        "links": f"<div class='menu'><p>{link}</p></div><div><p>{para}{para}</p><ul><li>x</li></ul>fuera</div>",
        "article": f"<article><p>{para}</p></article><div class='content'><p>{para}</p><p>{para}</p><p>{para}</p></div>",
        "none": "<div>nada</div>", "empty": "", "null": None,
        "text": f"<p>solo {para}</p>",
    }
    df = spark.createDataFrame(list(html.items()), "page_id string, html string")
    got = {r.page_id: r for r in page_bodies(df).collect()}
    assert set(got) == set(html)
    assert got["nested"].method == "dom" and got["nested"].body.count("Una frase") == 6 and "fin" in got["nested"].body and "corto" not in got["nested"].body
    assert got["loose"].method == "body" and got["loose"].body.count("Una frase") == 6 and "var a" not in got["loose"].body
    assert got["links"].method == "dom" and "enlace" not in got["links"].body and "fuera" not in got["links"].body
    assert got["article"].method == "dom" and got["article"].body.count("Una frase") == 3  # an article of 200 goes first
    assert all((got[k].method, got[k].body) == ("none", "") for k in ("none", "empty", "null", "text"))
    assert page_bodies(df.limit(0)).count() == 0


def test_one_title_on_many_rows(spark):
    """A title that stands on every row, all bodies different: the nearest earlier code inside the window, checked on some rows."""
    n, hours = 20_000, 72
    rows = spark.range(n).select(
        "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 17).alias("ts"), F.array(*[F.lit(f"palabra{i}") for i in range(6)]).alias("title_tokens"),
        F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.substring(F.md5((F.col("id") % 19_000).cast("string")), 1, 16).alias("simhash"),
        F.lit(None).cast("string").alias("url_key"))
    got = {r.id: (r.candidate, round(r.similarity, 9)) for r in D.near_duplicates(rows, hours).collect()}
    codes = {r.id: int(r.simhash, 16) for r in rows.select("id", "simhash").collect()}
    assert len(got) == n - 1
    for i in [1, 2, 777, 5_000, 15_001, 19_000, 19_500, n - 1]:
        near = min(((bin(codes[i] ^ codes[j]).count("1"), -j) for j in range(max(0, i - hours * 3600 // 17), i)))
        assert got[i] == (-near[1], round((1 - near[0] / 64) * 0.6 + 0.4, 9))


def test_ingest_reasons_come_in_order(spark):
    from tidewire.operators import ingest as I
    at = datetime(2026, 1, 10, 12)
    good = "Choque con dos heridos en la LZ-2 en Arrecife"
    body = "La Policia Local de Arrecife confirma dos heridos tras el choque de un coche y una moto en la LZ-2. Llamar al 612 345 678. " * 4
    rows = [(1, good, body, at), (2, "corto", body, at), (3, good, body, at), (4, "Noticia sobre la cosecha de Castilla", "Sin lugar de la isla en el texto.", at),
            (5, good + " hoy", body + " viejo", datetime(2020, 1, 1)), (6, good, body, at + timedelta(hours=1)), (7, None, None, None)]
    items = spark.createDataFrame([(*r, "certain", 0.9) for r in rows], "id long, title string, body string, occurred_at timestamp, date_confidence string, source_score double")
    seen = spark.createDataFrame([(3,), (99,)], "id long")
    got = {r.id: r for r in I.outcomes(items, seen, F.lit(at + timedelta(days=1))).collect()}
    assert {i: (r.outcome, r.reason) for i, r in got.items() if i != 7} == {
        1: ("draft", None), 2: ("skipped", "sin-titular"), 3: ("skipped", "vista"), 4: ("rejected", "fuera-de-ambito"), 5: ("rejected", "fecha"), 6: ("duplicate", None)}
    assert got[6].canonical_id == 1 and got[7].outcome == "skipped"
    assert got[1].findings == 4 and "612" not in got[1].clean and got[4].clean is None and got[4].findings == 0


def test_ingest_reads_each_text_once(spark):
    """Scope, place, consistency and body are judged below the join that gives every row its texts' facts."""
    from tidewire.operators import ingest as I
    at = datetime(2026, 1, 10, 12)
    texts = [("Choque con dos heridos en la LZ-2 en Arrecife", "Un coche y una moto."), ("Receta", None), (None, "Atropello en Yaiza"), ("Pleno en Madrid", "Sin heridos.")]
    rows = [(i, *texts[i % 4], at, "certain", 0.9) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, title string, body string, occurred_at timestamp, date_confidence string, source_score double")
    gated = I.gated(items, spark.createDataFrame([(39,)], "id long"), F.lit(at + timedelta(days=1)))
    got = {r.id: (r.verification, r.reason) for r in gated.collect()}
    assert all(got[i] == got[i % 4] for i in range(39)) and got[39][1] == "vista" and len(got) == 40
    plan = gated._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join ")]
    assert "RLIKE" not in above and "regexp" not in above


def test_work_on_titles_moves_no_texts(spark):
    from tidewire.plans.bindings import titled, view
    d = "/root/testdata/sf0.001"
    a, b = (x.select("id", "title", "ts") for x in (titled(spark, d), view(spark, d, "articles")))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    below = a._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "AS text" in below


def test_comparing_groups_broadcasts_nothing(spark):
    from tidewire.operators import blocks
    rows = spark.range(40).selectExpr("id % 4 AS g", "id AS t", "id")
    pairs = spark.range(4).selectExpr("id AS group_a", "id AS group_b")
    met = blocks.meet(rows, "g", pairs, lambda a, b, record: {"id": a["id"]}, "id long")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(x.id for x in met.collect()) == list(range(40))
