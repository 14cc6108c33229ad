"""Geodesics and map projections of places that Spark derives from the customers, and superpixels of the images, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G
from ..operators.superpixels import superpixels as labelled
from .raster_queries import PX, H, W, images

A, FLAT = G.ELLIPSOIDS["WGS84"]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lon, lat) all over the Earth, from the customers' keys and balances."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919) % 360 - 180 + 0.125).alias("lon"), (F.pmod(F.floor("c_acctbal"), F.lit(170)) - 85 + 0.25).cast("double").alias("lat"))


#: The same places, each with the one of the next id.
PLACES = """p AS MATERIALIZED (SELECT c_custkey AS id, (c_custkey * 7919) % 360 - 180 + 0.125::DOUBLE AS lon,
  ((floor(c_acctbal)::BIGINT % 170 + 170) % 170 - 85 + 0.25::DOUBLE) AS lat FROM customer),
q AS MATERIALIZED (SELECT a.id, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM p a JOIN p b ON b.id = a.id + 1)"""


def geodesics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each place to the next one: distance and azimuths."""
    p = places(spark, sf_dir)
    after = p.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    g = p.join(after, "id").select("id", G.geodesic_inverse(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("g"))
    return g.select("id", F.round("g.distance", 2).alias("distance"), F.round("g.azimuth", 5).alias("azimuth"), F.round("g.azimuth2", 5).alias("azimuth2"))


def geodesic_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one gets from each place along an azimuth and a distance of its own."""
    p = places(spark, sf_dir)
    g = p.select("id", G.geodesic_forward(F.col("lon"), F.col("lat"), (F.col("id") * 37 % 360).cast("double") + 0.5, (F.col("id") * 10007 % 9_000_000).cast("double")).alias("g"))
    return g.select("id", *(F.round(f"g.{c}", 7).alias(c) for c in ("lon", "lat", "azimuth")))


def _xy(column):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = places(spark, sf_dir).select("id", column(F.col("lon"), F.col("lat")).alias("g"))
        return g.select("id", F.round("g.x", 3).alias("x"), F.round("g.y", 3).alias("y"))

    return run


CONIC = {"lat1": 33.0, "lat2": 45.0, "lat0": 23.0, "lon0": -96.0}


def utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = places(spark, sf_dir).select("id", G.utm(F.col("lon"), F.col("lat")).alias("g"))
    return g.select("id", "g.zone", "g.north", F.round("g.x", 3).alias("x"), F.round("g.y", 3).alias("y"))


def projections_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place after every projection and its inverse, and after a geodesic there and back."""
    lon, lat = F.col("lon"), F.col("lat")
    there = {
        "utm": G._bind(G.utm(lon, lat), lambda u: G.utm_inverse(u["x"], u["y"], u["zone"], u["north"])),
        "conic": G._bind(G.lambert_conic(lon, lat, **CONIC), lambda u: G.lambert_conic_inverse(u["x"], u["y"], **CONIC)),
        "albers": G._bind(G.albers(lon, lat, **CONIC), lambda u: G.albers_inverse(u["x"], u["y"], **CONIC)),
        "polar": G._bind(G.polar_stereographic(lon, lat, true_at=71.0), lambda u: G.polar_stereographic_inverse(u["x"], u["y"], true_at=71.0)),
    }
    out = places(spark, sf_dir).select("id", "lon", "lat", *(v.alias(k) for k, v in there.items()))
    parts = [F.struct(F.lit(k).alias("projection"), F.round(f"{k}.lon", 6).alias("lon"), F.round(f"{k}.lat", 6).alias("lat")) for k in there]
    return out.select("id", F.explode(F.array(*parts)).alias("u")).select("id", "u.*")


def superpixel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each pixel with cells of 4 x 4, before the clean-up."""
    im = images(spark, sf_dir).withColumns({"width": F.lit(W), "height": F.lit(H)})
    out = labelled(im, 4, 0.2, clean=False).select("image_id", F.posexplode("labels").alias("k", "label"))
    return out.select("image_id", F.floor(F.col("k") / W).cast("int").alias("y"), (F.col("k") % W).alias("x"), "label")


def superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels of about 4 x 4 pixels: size, place and mean value of each region."""
    im = images(spark, sf_dir).withColumns({"width": F.lit(W), "height": F.lit(H)})
    px = labelled(im, 4, 0.2).select("image_id", F.posexplode(F.arrays_zip("labels", "pixels")).alias("k", "z")).select("image_id", "k", "z.labels", "z.pixels")
    stats = px.groupBy("image_id", F.col("labels").alias("label")).agg(
        F.count("*").alias("n"), F.avg(F.floor(F.col("k") / W)).alias("y"), F.avg(F.col("k") % W).alias("x"), F.avg("pixels").alias("mean")
    )
    return stats.select("image_id", "label", "n", *(F.round(c, 6).alias(c) for c in ("y", "x", "mean")))


QUERIES = {
    "geodesics": geodesics,
    "geodesic_ends": geodesic_ends,
    "utm": utm,
    "lambert_conic": _xy(lambda lon, lat: G.lambert_conic(lon, lat, **CONIC)),
    "albers": _xy(lambda lon, lat: G.albers(lon, lat, **CONIC)),
    "polar_stereographic": _xy(lambda lon, lat: G.polar_stereographic(lon, lat, true_at=71.0)),
    "projections_undone": projections_undone,
    "superpixel_labels": superpixel_labels,
    "superpixels": superpixels,
}

B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
_RAD = "0.017453292519943295::DOUBLE"
_U = f"atan({1 - FLAT!r}::DOUBLE * tan({{0}} * {_RAD}))"
_T = f"(tan(pi() / 4 - {_RAD} * lat / 2) / pow((1 - {E!r} * sin({_RAD} * lat)) / (1 + {E!r} * sin({_RAD} * lat)), {E / 2!r}))"
_SERIES = f"""u2 AS (SELECT *, cos2 * {(A * A - B * B) / (B * B)!r}::DOUBLE AS u FROM {{0}}),
ab AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM u2)"""
_ARC = "(small * sin({s}) * ({m} + small / 4 * (cos({s}) * (2 * {m} * {m} - 1) - small / 6 * {m} * (4 * sin({s}) * sin({s}) - 3) * (4 * {m} * {m} - 3))))"
_C = f"({FLAT / 16!r}::DOUBLE * cos2 * (4 + {FLAT!r}::DOUBLE * (4 - 3 * cos2)))"
_TURN = f"((1 - {_C}) * {FLAT!r}::DOUBLE * sin_a * ({{s}} + {_C} * sin({{s}}) * ({{m}} + {_C} * cos({{s}}) * (2 * {{m}} * {{m}} - 1))))"


def _wrapped(x: str) -> str:
    return f"(180 - ((180 - ({x})) % 360 + 360) % 360)"


def _transverse() -> tuple[str, str]:
    terms, scale = G._series(FLAT, "forward"), 0.9996 * G._rectifying(A, FLAT)
    x = "eta" + "".join(f" + {c!r}::DOUBLE * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, c in enumerate(terms, 1))
    y = "xi" + "".join(f" + {c!r}::DOUBLE * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, c in enumerate(terms, 1))
    return f"500000 + {scale!r}::DOUBLE * ({x})", f"CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + {scale!r}::DOUBLE * ({y})"


def _conic_sql() -> str:
    n, big, r0 = G._cone(A, FLAT, CONIC["lat0"], CONIC["lat1"], CONIC["lat2"])
    return f"""
WITH {PLACES}, r AS (SELECT id, {A * big!r}::DOUBLE * pow({_T}, {n!r}::DOUBLE) AS r, {n!r}::DOUBLE * {_RAD} * {_wrapped("lon + 96")} AS t FROM p)
SELECT id, round(r * sin(t), 3) AS x, round({r0!r}::DOUBLE - r * cos(t), 3) AS y FROM r"""


def _albers_sql() -> str:
    n, c, q0 = G._equal_area_cone(FLAT, CONIC["lat0"], CONIC["lat1"], CONIC["lat2"])
    r0 = A * math.sqrt(c - n * q0) / n
    s = f"sin({_RAD} * lat)"
    q = f"{1 - E2!r}::DOUBLE * ({s} / (1 - {E2!r} * {s} * {s}) - ln((1 - {E!r} * {s}) / (1 + {E!r} * {s})) / {2 * E!r}::DOUBLE)"
    return f"""
WITH {PLACES}, r AS (SELECT id, {A!r}::DOUBLE * sqrt(greatest(0, {c!r}::DOUBLE - {n!r}::DOUBLE * ({q}))) / {n!r}::DOUBLE AS r, {n!r}::DOUBLE * {_RAD} * {_wrapped("lon + 96")} AS t FROM p)
SELECT id, round(r * sin(t), 3) AS x, round({r0!r}::DOUBLE - r * cos(t), 3) AS y FROM r"""


def _superpixel_sql(rounds: int) -> str:
    """Clustering of 8 x 8 images into 2 x 2 cells, in which every cell is beside every other, round by round."""
    move = """,
c{n} AS MATERIALIZED (SELECT s.image_id, s.label, coalesce(m.cy, s.cy) AS cy, coalesce(m.cx, s.cx) AS cx, coalesce(m.cv, s.cv) AS cv
  FROM {before} s LEFT JOIN (SELECT l.image_id, l.label, sum(v.y) / count(*)::DOUBLE AS cy, sum(v.x) / count(*)::DOUBLE AS cx, sum(v.q) / count(*)::DOUBLE AS cv
    FROM l{n} l JOIN v ON v.image_id = l.image_id AND v.y = l.y AND v.x = l.x GROUP BY l.image_id, l.label) m
  ON m.image_id = s.image_id AND m.label = s.label),
l{m} AS MATERIALIZED (SELECT image_id, y, x, label FROM (
  SELECT v.image_id, v.y, v.x, c.label, row_number() OVER (PARTITION BY v.image_id, v.y, v.x ORDER BY
    ((v.y - c.cy) * (v.y - c.cy) + (v.x - c.cx) * (v.x - c.cx)) * {pull}::DOUBLE + (v.q - c.cv) * (v.q - c.cv), c.label) AS k
  FROM v JOIN c{n} c ON c.image_id = v.image_id) WHERE k = 1)"""
    steps = "".join(move.format(n=k, m=k + 1, before=f"c{k - 1}" if k else "z", pull=repr((0.2 * 65535 / 4) ** 2)) for k in range(rounds))
    return f"""
WITH {PX},
e AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id),
v AS MATERIALIZED (SELECT px.image_id, y, x, CASE WHEN hi > lo THEN round_even((v - lo) / (hi - lo) * 65535, 0) ELSE 0 END::BIGINT AS q FROM px JOIN e ON e.image_id = px.image_id),
z AS MATERIALIZED (SELECT image_id, label::INT AS label, 0::DOUBLE AS cy, 0::DOUBLE AS cx, 0::DOUBLE AS cv FROM e, range(4) r(label)),
l0 AS MATERIALIZED (SELECT image_id, y, x, ((y // 4) * 2 + x // 4)::INT AS label FROM v){steps}
SELECT image_id, y, x, label FROM l{rounds}"""


ORACLES = {
    "geodesics": f"""
WITH RECURSIVE {PLACES},
i AS MATERIALIZED (SELECT id, sin({_U.format("lat1")}) AS s1, cos({_U.format("lat1")}) AS c1, sin({_U.format("lat2")}) AS s2, cos({_U.format("lat2")}) AS c2, {_wrapped("lon2 - lon1")} * {_RAD} AS dl FROM q),
it(id, k, l) AS (
  SELECT id, 0, dl FROM i
  UNION ALL
  SELECT id, k + 1, dl + {_TURN.format(s="arc", m="m")} FROM (
    SELECT *, 1 - sin_a * sin_a AS cos2, CASE WHEN 1 - sin_a * sin_a > 1e-15 THEN cos_s - 2 * s1 * s2 / (1 - sin_a * sin_a) ELSE 0 END AS m FROM (
      SELECT *, CASE WHEN sin_s > 0 THEN c1 * c2 * sin(l) / sin_s ELSE 0 END AS sin_a, atan2(sin_s, cos_s) AS arc FROM (
        SELECT it.id, k, l, i.s1, i.c1, i.s2, i.c2, i.dl, sqrt(pow(c2 * sin(l), 2) + pow(c1 * s2 - s1 * c2 * cos(l), 2)) AS sin_s, s1 * s2 + c1 * c2 * cos(l) AS cos_s
        FROM it JOIN i ON i.id = it.id WHERE k < 20)))),
e AS (
  SELECT *, 1 - sin_a * sin_a AS cos2, CASE WHEN 1 - sin_a * sin_a > 1e-15 THEN cos_s - 2 * s1 * s2 / (1 - sin_a * sin_a) ELSE 0 END AS m FROM (
    SELECT *, CASE WHEN sin_s > 0 THEN c1 * c2 * sin(l) / sin_s ELSE 0 END AS sin_a, atan2(sin_s, cos_s) AS arc FROM (
      SELECT it.id, l, i.s1, i.c1, i.s2, i.c2, i.dl, sqrt(pow(c2 * sin(l), 2) + pow(c1 * s2 - s1 * c2 * cos(l), 2)) AS sin_s, s1 * s2 + c1 * c2 * cos(l) AS cos_s
      FROM it JOIN i ON i.id = it.id WHERE k = 20))),
{_SERIES.format("e")}
SELECT id, round({B!r}::DOUBLE * big * (arc - {_ARC.format(s="arc", m="m")}), 2) AS distance,
  round((degrees(atan2(c2 * sin(l), c1 * s2 - s1 * c2 * cos(l))) + 360) % 360, 5) AS azimuth,
  round((degrees(atan2(c1 * sin(l), c1 * s2 * cos(l) - s1 * c2)) + 360) % 360, 5) AS azimuth2 FROM ab
""",
    "geodesic_ends": f"""
WITH RECURSIVE {PLACES},
g AS MATERIALIZED (
  SELECT *, cu * sz AS sin_a, 1 - cu * sz * cu * sz AS cos2, atan2(su, cu * cz) AS first FROM (
    SELECT id, lon, sin({_U.format("lat")}) AS su, cos({_U.format("lat")}) AS cu, sin((id * 37 % 360 + 0.5::DOUBLE) * {_RAD}) AS sz, cos((id * 37 % 360 + 0.5::DOUBLE) * {_RAD}) AS cz, (id * 10007 % 9000000)::DOUBLE AS d FROM p)),
{_SERIES.format("g")},
it(id, k, s) AS (
  SELECT id, 0, d / ({B!r}::DOUBLE * big) FROM ab
  UNION ALL
  SELECT it.id, k + 1, d / ({B!r}::DOUBLE * big) + {_ARC.format(s="s", m="cos(2 * first + s)")} FROM it JOIN ab ON ab.id = it.id WHERE k < 20),
e AS (SELECT ab.*, s, su * sin(s) - cu * cos(s) * cz AS low FROM it JOIN ab ON ab.id = it.id WHERE k = 20)
SELECT id, round({_wrapped("lon + degrees(atan2(sin(s) * sz, cu * cos(s) - su * sin(s) * cz) - " + _TURN.format(s="s", m="cos(2 * first + s)") + ")")}, 7) AS lon,
  round(degrees(atan2(su * cos(s) + cu * sin(s) * cz, {1 - FLAT!r}::DOUBLE * sqrt(sin_a * sin_a + low * low))), 7) AS lat,
  round((degrees(atan2(sin_a, -low)) + 360) % 360, 7) AS azimuth FROM e
""",
    "utm": f"""
WITH {PLACES},
z AS (SELECT id, lon, lat, (floor(({_wrapped("lon")} + 180) / 6)::INT % 60 + 1)::INT AS zone FROM p),
s AS (SELECT *, sinh(atanh(sin({_RAD} * lat)) - {E!r}::DOUBLE * atanh({E!r}::DOUBLE * sin({_RAD} * lat))) AS tau, {_RAD} * {_wrapped("lon - (zone * 6 - 183)")} AS lam FROM z),
n AS (SELECT *, atan2(tau, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) AS eta FROM s)
SELECT id, zone, lat >= 0 AS north, round({_transverse()[0]}, 3) AS x, round({_transverse()[1]}, 3) AS y FROM n
""",
    "lambert_conic": _conic_sql(),
    "albers": _albers_sql(),
    "polar_stereographic": f"""
WITH {PLACES}, r AS (SELECT id, {G._polar_scale(A, FLAT, 71.0, 1.0)!r}::DOUBLE * {_T} AS r, {_RAD} * lon AS t FROM p)
SELECT id, round(r * sin(t), 3) AS x, round(-r * cos(t), 3) AS y FROM r
""",
    "projections_undone": f"""
WITH {PLACES}
SELECT id, projection, round(lon, 6) AS lon, round(lat, 6) AS lat FROM p, (VALUES ('utm'), ('conic'), ('albers'), ('polar')) v(projection)
""",
    "superpixel_labels": _superpixel_sql(10),
}
