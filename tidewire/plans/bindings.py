"""The driver tables seen as news tables.

Each binding is one SELECT that Spark and the oracle both run, so a query and its SQL twin start
from the same rows. Keys become phrases, places and figures; every source row gives one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import load, shuffle_width

# Catalog of incidents: orders with their customer and nation.
ACCIDENTS = """
SELECT o.o_orderkey AS id,
  concat('suceso-', o.o_orderkey) AS slug,
  concat(c.c_name, ' ', c.c_mktsegment) AS title,
  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN concat('Aviso en ', n.n_name)
       ELSE 'Sin lugar' END AS summary,
  concat('Texto de ', o.o_orderpriority, ' para ', c.c_mktsegment) AS body,
  concat('via ', c.c_nationkey) AS location_description,
  o.o_orderdate + (o.o_orderkey % 1440) * INTERVAL '1' MINUTE AS occurred_at,
  o.o_orderdate + (o.o_custkey % 1440) * INTERVAL '1' MINUTE AS created_at,
  CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate + INTERVAL '2' DAY END AS published_at,
  CASE o.o_orderstatus WHEN 'F' THEN 'PUBLISHED' WHEN 'O' THEN 'PENDING_REVIEW'
       ELSE CASE WHEN o.o_totalprice > 250000 THEN 'ARCHIVED' ELSE 'REJECTED' END END AS status,
  CASE WHEN o.o_totalprice < 100000 THEN 'AI' ELSE 'MANUAL' END AS origin,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'ACCIDENTE_TRAFICO' WHEN '2-HIGH' THEN 'INCENDIO'
       WHEN '3-MEDIUM' THEN 'RESCATE' WHEN '5-LOW' THEN 'POLITICA' ELSE 'CULTURA' END AS category,
  c.c_nationkey AS municipality_id,
  CASE WHEN c.c_acctbal >= 0 THEN c.c_mktsegment END AS zone,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'COCHE' WHEN 'MACHINERY' THEN 'CAMION'
       WHEN 'BUILDING' THEN 'MOTO' WHEN 'FURNITURE' THEN 'BICICLETA' ELSE 'OTROS' END AS vehicle_type,
  CASE WHEN o.o_totalprice > 300000 THEN 'GRAVE' WHEN o.o_totalprice > 150000 THEN 'MODERADO'
       ELSE 'LEVE' END AS severity,
  CAST(floor(o.o_totalprice / 90000) AS INT) AS injuries,
  CAST(floor(o.o_totalprice / 240000) AS INT) AS fatalities,
  CASE WHEN c.c_acctbal < -500 THEN o.o_custkey END AS duplicate_of_id,
  o.o_totalprice > 400000 AS is_featured,
  round(CAST(28.85 + (o.o_custkey % 400) / 1000.0 AS DOUBLE), 6) AS lat,
  CASE WHEN o.o_totalprice > 50000 THEN round(CAST(-13.85 + (o.o_orderkey % 400) / 1000.0 AS DOUBLE), 6) END AS lon,
  CAST(o.o_totalprice / 500000 AS DOUBLE) AS confidence_score,
  CAST(c.c_acctbal / 10000 AS DOUBLE) AS source_score
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

MUNICIPALITIES = "SELECT n_nationkey AS municipality_id, n_name AS name, lower(n_name) AS slug FROM {nation}"

SOURCES = """
SELECT l_orderkey AS article_id, concat('medio-', l_suppkey) AS outlet,
  concat('https://medio-', l_suppkey, '.example/', l_partkey) AS url, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS line,
  l_shipdate AS published_at FROM {lineitem}
"""

# Spanish wire text derived from keys.
WIRE = """
SELECT o_orderkey AS id, o_custkey AS source, o_orderdate + (o_orderkey % 1440) * INTERVAL '1' MINUTE AS occurred_at,
  o_totalprice AS price, o_orderstatus AS flag,
  concat(CASE o_orderkey % 8
    WHEN 0 THEN concat('Accidente de tráfico con ', CASE o_custkey % 4 WHEN 0 THEN 'dos' WHEN 1 THEN '3' WHEN 2 THEN 'siete' ELSE '12' END, ' heridos')
    WHEN 1 THEN concat('Atropello a un peatón deja ', o_custkey % 9, ' personas heridas')
    WHEN 2 THEN 'Incendio de un coche sin heridos'
    WHEN 3 THEN concat('Rescate en la costa: ', CASE o_custkey % 3 WHEN 0 THEN 'un' WHEN 1 THEN 'dos' ELSE '4' END, ' fallecidos')
    WHEN 4 THEN 'El pleno del ayuntamiento aprueba la obra'
    WHEN 5 THEN 'Partido de balonmano en el pabellón'
    WHEN 6 THEN 'Abre sus puertas la exposición al público'
    ELSE 'Choque múltiple grave entre una moto y un camión' END, ' en ',
    CASE o_custkey % 10 WHEN 0 THEN 'Arrecife' WHEN 1 THEN 'San Bartolomé' WHEN 2 THEN 'Tías' WHEN 3 THEN 'Yaiza'
      WHEN 4 THEN 'Tinajo' WHEN 5 THEN 'Costa Teguise' WHEN 6 THEN 'Haría' WHEN 7 THEN 'Madrid'
      WHEN 8 THEN 'Corralejo' ELSE 'la isla' END) AS title,
  concat('Aviso recibido: ', o_orderpriority) AS summary,
  CASE o_custkey % 5
    WHEN 0 THEN concat('Los bomberos y la Guardia Civil acudieron a la LZ-', o_orderkey % 40, ' sobre las ', o_orderkey % 26, ':', lpad(concat('', o_custkey % 60), 2, '0'), '. La carretera quedó cortada.')
    WHEN 1 THEN 'La ambulancia trasladó a dos heridos leves. Hubo un fallecido en Playa Blanca.'
    WHEN 2 THEN 'Sin más datos por ahora.'
    WHEN 3 THEN concat('El vehículo, con matrícula ', 1000 + o_orderkey % 9000, ' ABC, volcó. Contacto: 6', lpad(concat('', o_custkey % 100), 2, '0'), ' 345 678 o redaccion', o_custkey % 7, '@medio.example.')
    ELSE 'Vecinos de Femés y de Tahíche denuncian humo y llamas junto a la rotonda; no hay lesionados, según testigos.' END AS body
FROM {orders}
"""

# Articles: documents with their first line as title; pages lend their addresses.
ARTICLES = """
SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS body, d.source AS outlet, d.lang,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' MINUTE AS ts, p.url
FROM {documents} d LEFT JOIN {pages} p ON d.doc_id = p.page_id
"""

# Run log: events per source.
RUNS = """
SELECT user_id AS source, event_id AS run_id, ts AS started_at, event_type <> 'error' AS ok, value AS items,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms, event_type FROM {events}
"""

VIEWS = {
    "accidents": ACCIDENTS, "municipalities": MUNICIPALITIES, "sources": SOURCES, "wire": WIRE,
    "articles": ARTICLES, "runs": RUNS,
}
_TABLES = ["orders", "customer", "nation", "lineitem", "documents", "pages", "events"]


def view(spark: SparkSession, sf_dir: str, name: str, **instead: DataFrame) -> DataFrame:
    """A binding over the tables, or over what stands ``instead`` of some."""
    text = VIEWS[name]
    used = {t: instead[t] if t in instead else load(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles for work on titles: their body ends with the first line, so the join with the pages moves no texts."""
    documents = load(spark, sf_dir, "documents")
    return view(spark, sf_dir, "articles", documents=documents.withColumn("text", F.split_part("text", F.lit("\n"), F.lit(1))))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt round-robin over ``partitions``, the shuffle partitions of the session if not given.

    For work that is heavy per row, on narrow inputs: a file that Spark cannot split would keep it in one task.
    """
    return df.repartition(partitions or shuffle_width(df.sparkSession))


def with_views(body: str, *names: str) -> str:
    """Oracle text: the views as common table expressions, then the query."""
    ctes = [f"{n} AS ({VIEWS[n].format(**{t: t for t in _TABLES})})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
