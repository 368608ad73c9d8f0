"""Distances, reference points, land tests and deterministic pin displacement.

The outline is a parameter: a list of closed rings of (lat, lon). It is turned into
segments once and travels inside the plan as one array literal.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..rules import lexicon as L
from ..rules.places import MUNICIPALITIES, ZONES
from .text import col

M_PER_DEGREE = 111_320.0
Ring = list[tuple[float, float]]


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    s = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(s))


def municipality_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MUNICIPALITIES, "slug string, name string, lat double, lon double")


def zone_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ZONES, "slug string, name string, municipality string, lat double, lon double, aliases array<string>")


def with_reference_point(df: DataFrame, municipality: str = "municipality", zone: str = "zone") -> DataFrame:
    """Add ``ref_lat ref_lon zone_ok``: the zone when it belongs to the municipality, else the municipality.

    Both dimensions are constants of this package, so broadcasting them is bounded.
    """
    spark = df.sparkSession
    z = zone_dim(spark).select(
        F.col("slug").alias("_z"), F.col("municipality").alias("_zm"),
        F.col("lat").alias("_zlat"), F.col("lon").alias("_zlon"))
    m = municipality_dim(spark).select(
        F.col("slug").alias("_m"), F.col("lat").alias("_mlat"), F.col("lon").alias("_mlon"))
    out = df.join(F.broadcast(z), (F.col(zone) == F.col("_z")) & (F.col(municipality) == F.col("_zm")), "left")
    out = out.join(F.broadcast(m), F.col(municipality) == F.col("_m"), "left")
    return (
        out.withColumn("ref_lat", F.coalesce("_zlat", "_mlat"))
        .withColumn("ref_lon", F.coalesce("_zlon", "_mlon"))
        .withColumn("zone_ok", F.col(zone).isNull() | F.col("_z").isNotNull())
        .drop("_z", "_zm", "_zlat", "_zlon", "_m", "_mlat", "_mlon")
    )


def segments(rings: list[Ring]) -> Column:
    """All outline edges as one array literal of struct(ring, ay, ax, by, bx)."""
    rows = []
    for r, ring in enumerate(rings):
        for i, (ay, ax) in enumerate(ring):
            by, bx = ring[(i + 1) % len(ring)]
            rows.append(f"named_struct('r',{r},'ay',{ay!r}D,'ax',{ax!r}D,'by',{by!r}D,'bx',{bx!r}D)")
    return F.expr(f"array({','.join(rows)})")


def inside(lat, lon, rings: list[Ring]) -> Column:
    """Even-odd ray cast; a point inside any ring is inside."""
    lat, lon = col(lat), col(lon)
    expr = F.lit(False)
    for ring in rings:
        crossings = F.size(F.filter(segments([ring]), lambda s: (
            ((s["ay"] > lat) != (s["by"] > lat))
            & (lon < (s["ax"] - s["bx"]) * (lat - s["by"]) / F.nullif(s["ay"] - s["by"], F.lit(0.0)) + s["bx"]))))
        expr = expr | (crossings % 2 == 1)
    return expr


def metres_to_edge(lat, lon, rings: list[Ring]) -> Column:
    lat, lon = col(lat), col(lon)
    m_lon = F.lit(M_PER_DEGREE) * F.cos(F.radians(lat))

    def one(s):
        ax, ay = (s["ax"] - lon) * m_lon, (s["ay"] - lat) * M_PER_DEGREE
        dx, dy = (s["bx"] - s["ax"]) * m_lon, (s["by"] - s["ay"]) * M_PER_DEGREE
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length)))
        px, py = ax + dx * t, ay + dy * t
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(segments(rings), one))


def is_land(lat, lon, rings) -> Column:
    return inside(lat, lon, rings) | (metres_to_edge(lat, lon, rings) <= L.LAND_MARGIN_M)


def is_safe_site(lat, lon, rings) -> Column:
    return inside(lat, lon, rings) & (metres_to_edge(lat, lon, rings) >= L.SAFE_INLAND_M)


#: A prime below 2**31: products of two residues fit 63 bits.
MODULUS = (1 << 31) - 1


def _unit(key: np.ndarray, i: int, salt: int) -> np.ndarray:
    """A quadratic congruence in whole numbers, so that any engine finds the same places."""
    x1 = (key % MODULUS * 48271 + i * 69621 + salt * 16807 + 1) % MODULUS
    x2 = (x1 * x1 + 11) % MODULUS
    return (x2 * 48271 + x1) % MODULUS / float(MODULUS)


def _safe_sites(lat: np.ndarray, lon: np.ndarray, rings: list[Ring]) -> np.ndarray:
    """``is_safe_site`` of many points."""
    within, nearest = np.zeros(len(lat), bool), np.full(len(lat), np.inf)
    m_lon = M_PER_DEGREE * np.cos(np.radians(lat))
    for ring in rings:
        odd = np.zeros(len(lat), bool)
        for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                odd ^= ((ay > lat) != (by > lat)) & (lon < (ax - bx) * (lat - by) / (ay - by) + bx)
            x, y = (ax - lon) * m_lon, (ay - lat) * M_PER_DEGREE
            dx, dy = (bx - lon) * m_lon - x, (by - lat) * M_PER_DEGREE - y
            length = dx * dx + dy * dy
            t = np.clip(np.divide(-(x * dx + y * dy), length, out=np.zeros_like(x), where=length > 0), 0, 1)
            nearest = np.minimum(nearest, np.sqrt((x + dx * t) ** 2 + (y + dy * t) ** 2))
        within |= odd
    return within & (nearest >= L.SAFE_INLAND_M)


def _displaced(key: pa.Array, lat: pa.Array, lon: pa.Array, rings: list[Ring] | None, attempts: int) -> pa.Array:
    own = [pc.fill_null(c.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in (lat, lon)]
    at = [np.full(len(key), np.nan) for _ in own]
    there = pc.and_(lat.is_valid(), lon.is_valid()).to_numpy(zero_copy_only=False)
    keyed = there & key.is_valid().to_numpy(zero_copy_only=False)
    keys = pc.fill_null(key, 0).to_numpy(zero_copy_only=False)
    left = np.flatnonzero(keyed)
    for i in range(2 * attempts if rings else 1):
        if not len(left):
            break
        low, high = (400.0, 900.0) if i < attempts else (120.0, 400.0)
        k, y, x = keys[left], own[0][left], own[1][left]
        radius, angle = low + _unit(k, i, 1) * (high - low), _unit(k, i, 2) * (2 * math.pi)
        y, x = y + radius * np.cos(angle) / M_PER_DEGREE, x + radius * np.sin(angle) / (M_PER_DEGREE * np.cos(np.radians(y)))
        hit = _safe_sites(y, x, rings) if rings else np.ones(len(left), bool)
        at[0][left[hit]], at[1][left[hit]] = y[hit], x[hit]
        left = left[~hit]
    found = keyed.copy()
    found[left] = False
    if rings:  # the point itself comes last
        rest = np.flatnonzero(there & ~found)
        rest = rest[_safe_sites(own[0][rest], own[1][rest], rings)]
        at[0][rest], at[1][rest] = own[0][rest], own[1][rest]
        found[rest] = True
        return pa.StructArray.from_arrays([pa.array(c) for c in at], ["lat", "lon"], mask=pa.array(~found))
    none = pa.array(there & ~found)
    return pa.StructArray.from_arrays([pc.if_else(none, None, pa.array(c)) for c in at], ["lat", "lon"], mask=pa.array(~there))


def displaced(key, lat, lon, rings=None, attempts: int = 60) -> Column:
    """Privacy displacement seeded by the key: the same row always moves to the same place.

    60 tries at 400-900 m, 60 tries at 120-400 m, then the point itself, else null. Without an
    outline the first try is taken. A batch is tried at once; each round goes on with the rows that are not yet on safe land.
    """
    @F.arrow_udf("lat double, lon double")
    def tries(key: pa.Array, lat: pa.Array, lon: pa.Array) -> pa.Array:
        return _displaced(key, lat, lon, rings, attempts)

    return tries(col(key).cast("long"), col(lat).cast("double"), col(lon).cast("double"))


def pin_status(lat, lon, ref_lat, ref_lon) -> Column:
    lat, lon, ref_lat, ref_lon = (col(c) for c in (lat, lon, ref_lat, ref_lon))
    has_pin = lat.isNotNull() & lon.isNotNull()
    return (
        F.when(ref_lat.isNull() & (lat.isNotNull() | lon.isNotNull()), F.lit("quitar"))
        .when(ref_lat.isNull() | ~has_pin, F.lit("ok"))
        .when(haversine_km(lat, lon, ref_lat, ref_lon) <= L.PIN_RADIUS_KM, F.lit("ok"))
        .otherwise(F.lit("recolocar")))


def coast_status(lat, lon, rings) -> Column:
    lat, lon = col(lat), col(lon)
    return (
        F.when(lat.isNull() | lon.isNull(), F.lit("sin pin"))
        .when(~is_land(lat, lon, rings), F.lit("en el mar"))
        .when(metres_to_edge(lat, lon, rings) < L.EDGE_M, F.lit("al borde"))
        .otherwise(F.lit("ok")))


def coerce(c, domain: list[str], default: str) -> Column:
    """Unknown values of a string domain become its conservative default."""
    return F.when(col(c).isin(domain), col(c)).otherwise(F.lit(default))
