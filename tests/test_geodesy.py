"""Geodesics and projections: published examples, round trips, poles, the date line and near-antipodes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pixelweave.functions import geodesy as G


def rows(spark, values, columns, *made):
    df = spark.createDataFrame(values, ", ".join(f"{c} double" for c in columns))
    return df.select(*columns, *(m.alias(f"m{k}") for k, m in enumerate(made))).collect()


def col(*names):
    return [F.col(n) for n in names]


def test_published_examples(spark):
    """Worked examples of Snyder's manual of map projections."""
    one = lambda c, lon, lat: rows(spark, [(lon, lat)], ("lon", "lat"), c(*col("lon", "lat")))[0].m0
    cone = one(lambda a, b: G.lambert_conic(a, b, 33, 45, 23, -96, ellipsoid="clrk66"), -75.0, 35.0)
    assert (round(cone.x, 1), round(cone.y, 1)) == (1894410.9, 1564649.5)
    area = one(lambda a, b: G.albers(a, b, 29.5, 45.5, 23, -96, ellipsoid="clrk66"), -75.0, 35.0)
    assert (round(area.x, 1), round(area.y, 1)) == (1885472.7, 1535925.0)
    zone = one(lambda a, b: G.transverse_mercator(a, b, -75.0, 0.9996, ellipsoid="clrk66"), -73.5, 40.5)
    assert (round(zone.x, 1), round(zone.y, 1)) == (127106.5, 4484124.4)
    polar = one(lambda a, b: G.polar_stereographic(a, b, True, -100, -71.0, ellipsoid="intl"), 150.0, -75.0)
    assert (round(polar.x, 1), round(polar.y, 1)) == (-1540033.6, -560526.4)


def test_projections_and_inverses(spark):
    rng = random.Random(1)
    values = [(rng.uniform(-180, 180), rng.uniform(-80, 80)) for _ in range(150)] + [(180.0, 0.0), (-180.0, 10.0), (0.0, 84.0), (3.0, 0.0)]
    lon, lat = col("lon", "lat")
    for ellipsoid in ("WGS84", "clrk66", "sphere"):
        k = {"ellipsoid": ellipsoid}
        cone = {"lat1": -20.0, "lat2": -60.0, "lat0": -30.0, "lon0": 25.0, "x0": 100.0, "y0": -50.0} | k
        made = (
            G._bind(G.utm(lon, lat, **k), lambda u: G.utm_inverse(u["x"], u["y"], u["zone"], u["north"], **k)),
            G._bind(G.lambert_conic(lon, lat, **cone), lambda u: G.lambert_conic_inverse(u["x"], u["y"], **cone)),
            G._bind(G.albers(lon, lat, **cone), lambda u: G.albers_inverse(u["x"], u["y"], **cone)),
            G._bind(G.polar_stereographic(lon, lat, True, 11.0, -70.0, **k), lambda u: G.polar_stereographic_inverse(u["x"], u["y"], True, 11.0, -70.0, **k)),
            G._bind(G.polar_stereographic(lon, lat, k0=0.994, **k), lambda u: G.polar_stereographic_inverse(u["x"], u["y"], k0=0.994, **k)),
        )
        for r in rows(spark, values, ("lon", "lat"), *made):
            for m in list(r)[2:]:
                assert abs(m.lat - r.lat) < 1e-9 and abs((m.lon - r.lon + 180) % 360 - 180) < 1e-9, (ellipsoid, r)


def test_equal_area_and_equal_angles(spark):
    """A small quadrangle keeps its area under Albers, and its angles under the conformal ones."""
    lon, lat = col("lon", "lat")
    d, values = 1e-4, [(-100.0, 30.0), (-90.0, 45.0), (-60.0, 60.0)]
    for name, make in (("albers", lambda a, b: G.albers(a, b, 29.5, 45.5, 23, -96)), ("conic", lambda a, b: G.lambert_conic(a, b, 33, 45, 23, -96)), ("utm", lambda a, b: G.transverse_mercator(a, b, -93.0))):
        for r in rows(spark, values, ("lon", "lat"), make(lon, lat), make(lon + d, lat), make(lon, lat + d)):
            east, north = (r.m1.x - r.m0.x, r.m1.y - r.m0.y), (r.m2.x - r.m0.x, r.m2.y - r.m0.y)
            a, f = G.ELLIPSOIDS["WGS84"]
            e2, s, c = f * (2 - f), math.sin(math.radians(r.lat)), math.cos(math.radians(r.lat))
            wide, high = math.radians(d) * a * c / math.sqrt(1 - e2 * s * s), math.radians(d) * a * (1 - e2) / (1 - e2 * s * s) ** 1.5
            if name == "albers":
                assert abs(east[0] * north[1] - east[1] * north[0]) == pytest.approx(wide * high, rel=1e-4)
            else:
                assert math.hypot(*east) / wide == pytest.approx(math.hypot(*north) / high, rel=1e-4) and abs(east[0] * north[0] + east[1] * north[1]) < 1e-3


def test_geodesic_example(spark):
    """The line from Flinders Peak to Buninyong of the Australian datum's manual."""
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    a, b = (dms(144, 25, 29.52440), dms(-37, 57, 3.72030)), (dms(143, 55, 35.38390), dms(-37, 39, 10.15610))
    r = rows(spark, [(*a, *b)], ("x1", "y1", "x2", "y2"), G.geodesic_inverse(*col("x1", "y1", "x2", "y2"), ellipsoid="GRS80"), G.geodesic_forward(*col("x1", "y1"), F.lit(dms(306, 52, 5.37)), F.lit(54972.271), ellipsoid="GRS80"))[0]
    assert r.m0.distance == pytest.approx(54972.271, abs=5e-4) and r.m0.azimuth == pytest.approx(dms(306, 52, 5.37), abs=1e-5)
    assert (r.m0.azimuth2 + 180) % 360 == pytest.approx(dms(127, 10, 25.07), abs=1e-5) and (r.m1.lon, r.m1.lat) == pytest.approx(b, abs=1e-8)


def test_geodesics_undone(spark):
    """Forward along the inverse's azimuth and distance is the other point, to a micrometre; near antipodes and poles too."""
    rng = random.Random(2)
    points = [(rng.uniform(-180, 180), rng.uniform(-89, 89), rng.uniform(-180, 180), rng.uniform(-89, 89)) for _ in range(120)]
    points += [(0.0, 0.0, 179.7, 0.3), (0.0, 10.0, 179.9, -10.2), (-30.0, -40.0, 149.6, 40.1), (12.0, 30.0, -168.3, -29.9), (0.0, 0.5, 179.5, 0.5), (5.0, 0.0, 15.0, 0.0), (5.0, 0.0, 5.0, 50.0), (170.0, 5.0, -170.0, -5.0), (0.0, 90.0, 50.0, 20.0), (10.0, -20.0, 30.0, 90.0)]
    p1, p2 = col("x1", "y1"), col("x2", "y2")
    inverse = G.geodesic_inverse(*p1, *p2)
    for r in rows(spark, points, ("x1", "y1", "x2", "y2"), inverse, G._bind(inverse, lambda g: G.geodesic_forward(*p1, g["azimuth"], g["distance"])), G.geodesic_inverse(*p2, *p1)):
        east = ((r.m1.lon - r.x2 + 180) % 360 - 180) * math.cos(math.radians(r.y2)) if abs(r.y2) < 89.99 else 0.0
        # 1e-6 m is 1e-11 degrees; the closest pairs to the antipode are given to the series' own accuracy
        close = 1e-11 if r.m0.distance < 19_800_000 else 2e-9
        assert abs(east) < close and abs(r.m1.lat - r.y2) < close, (r, east)
        assert r.m2.distance == pytest.approx(r.m0.distance, abs=1e-3)
        if abs(r.y2) < 89.99:
            assert abs((r.m1.azimuth - r.m0.azimuth2 + 180) % 360 - 180) < 1e-6


def test_geodesics_at_the_edges(spark):
    points = [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 180.0, 0.0), (0.0, 90.0, 0.0, -90.0), (40.0, 30.0, -140.0, -30.0), (None, 1.0, 2.0, 3.0)]
    got = [r.m0 for r in rows(spark, points, ("x1", "y1", "x2", "y2"), G.geodesic_inverse(*col("x1", "y1", "x2", "y2")))]
    half = 20003931.4586  # from pole to pole
    assert tuple(got[0]) == (0.0, 0.0, 0.0) and got[4] is None
    assert all(g.distance == pytest.approx(half, abs=0.01) for g in got[1:4])
    sphere = rows(spark, [(0.0, 0.0, 90.0, 0.0), (0.0, 0.0, 30.0, 40.0)], ("x1", "y1", "x2", "y2"), G.geodesic_inverse(*col("x1", "y1", "x2", "y2"), ellipsoid="sphere"))
    assert sphere[0].m0.distance == pytest.approx(6370997 * math.pi / 2) and sphere[1].m0.distance == pytest.approx(6370997 * math.acos(math.cos(math.radians(30)) * math.cos(math.radians(40))))
