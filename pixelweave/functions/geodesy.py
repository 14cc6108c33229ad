"""Geodesics and map projections on the ellipsoid, as column expressions: degrees and metres in and out, nulls for nulls.

Iterations are folds over a fixed number of steps that stand still once they have converged, so an expression has one size and
stays in the JVM. A struct that several fields need is bound once by transform over an array of one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis in metres and flattening.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 1 / 298.257223563),
    "GRS80": (6378137.0, 1 / 298.257222101),
    "clrk66": (6378206.4, 1 - 6356583.8 / 6378206.4),
    "intl": (6378388.0, 1 / 297.0),
    "bessel": (6377397.155, 1 / 299.1528128),
    "sphere": (6370997.0, 0.0),
}
STEPS, HALVINGS, CLOSE = 20, 60, 1e-13


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _fields(**columns: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def _fold(start: Column, step: Callable[[Column], Column], steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s)))


def _turn(degrees: Column) -> Column:
    """Within -180 (not) to 180."""
    return 180 - F.pmod(180 - degrees, F.lit(360.0))


def _bearing(y: Column, x: Column) -> Column:
    """Degrees from 0 to 360 (not)."""
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def _length_terms(a: float, b: float, cos2: Column) -> Column:
    """Series of a great ellipse with squared cosine cos2 of its azimuth at the equator."""
    u = cos2 * ((a * a - b * b) / (b * b))
    return _bind(u, lambda u: _fields(a=1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), b=u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))))


def _arc_change(t: Column, sin_s: Column, cos_s: Column, cos_m: Column) -> Column:
    """What the ellipsoid adds to an arc; cos_m: cosine of twice the arc from the equator to its middle."""
    square = 2 * cos_m * cos_m - 1
    return t["b"] * sin_s * (cos_m + t["b"] / 4 * (cos_s * square - t["b"] / 6 * cos_m * (4 * sin_s * sin_s - 3) * (4 * cos_m * cos_m - 3)))


def _turn_change(f: float, sin_a: Column, cos2: Column, arc: Column, sin_s: Column, cos_s: Column, cos_m: Column) -> Column:
    """By how much the longitude on the sphere exceeds that on the ellipsoid."""
    c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
    return _bind(c, lambda c: (1 - c) * f * sin_a * (arc + c * sin_s * (cos_m + c * cos_s * (2 * cos_m * cos_m - 1))))


def geodesic_forward(lon: Column, lat: Column, azimuth: Column, distance: Column, ellipsoid: str = "WGS84") -> Column:
    """struct(lon, lat, azimuth) of the point that lies distance metres along the geodesic; the azimuth goes on from there."""
    a, f = ELLIPSOIDS[ellipsoid]
    b = a * (1 - f)

    def start(i: Column) -> Column:
        su, cu, sz, cz = F.sin(i["u"]), F.cos(i["u"]), F.sin(i["z"]), F.cos(i["z"])
        sin_a = cu * sz
        return _fields(su=su, cu=cu, sz=sz, cz=cz, first=F.atan2(su, cu * cz), sin_a=sin_a, cos2=1 - sin_a * sin_a, lon=i["lon"], distance=i["distance"])

    def arc(g: Column) -> Column:
        return _bind(_length_terms(a, b, g["cos2"]), lambda t: _bind(g["distance"] / (b * t["a"]), lambda plain: _fold(_fields(s=plain, done=F.lit(False)), lambda s: _next(s, g, t, plain), STEPS)["s"]))

    def _next(s: Column, g: Column, t: Column, plain: Column) -> Column:
        new = plain + _arc_change(t, F.sin(s["s"]), F.cos(s["s"]), F.cos(2 * g["first"] + s["s"]))
        return _bind(new, lambda n: _fields(s=n, done=F.abs(n - s["s"]) < CLOSE))

    def end(g: Column, s: Column) -> Column:
        sin_s, cos_s = F.sin(s), F.cos(s)
        low = g["su"] * sin_s - g["cu"] * cos_s * g["cz"]
        phi = F.atan2(g["su"] * cos_s + g["cu"] * sin_s * g["cz"], (1 - f) * F.sqrt(g["sin_a"] * g["sin_a"] + low * low))
        turn = F.atan2(sin_s * g["sz"], g["cu"] * cos_s - g["su"] * sin_s * g["cz"])
        lam = turn - _turn_change(f, g["sin_a"], g["cos2"], s, sin_s, cos_s, F.cos(2 * g["first"] + s))
        return _fields(lon=_turn(g["lon"] + F.degrees(lam)), lat=F.degrees(phi), azimuth=_bearing(g["sin_a"], -low))

    inputs = _fields(u=F.atan((1 - f) * F.tan(F.radians(lat))), z=F.radians(azimuth), lon=lon.cast("double"), distance=distance.cast("double"))
    out = _bind(_bind(inputs, start), lambda g: _bind(arc(g), lambda s: end(g, s)))
    return F.when(lon.isNotNull() & lat.isNotNull() & azimuth.isNotNull() & distance.isNotNull(), out)


def geodesic_inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column, ellipsoid: str = "WGS84") -> Column:
    """struct(distance, azimuth, azimuth2) of the shortest geodesic from point 1 to point 2; azimuth2 goes on from point 2.

    The longitude on the sphere is iterated. Near antipodes that doesn't converge: there the azimuth at the point farther from the
    equator is halved in, as the longitude that a geodesic has reached at the other's latitude grows with it. Points that are equal
    have distance and azimuths 0; of the equal geodesics between a pair of exact antipodes one is given."""
    a, f = ELLIPSOIDS[ellipsoid]
    b = a * (1 - f)

    def arcs(i: Column, lam: Column) -> Column:
        """The arc on the sphere for a longitude on it."""
        sl, cl = F.sin(lam), F.cos(lam)
        east, north = i["c2"] * sl, i["c1"] * i["s2"] - i["s1"] * i["c2"] * cl
        return _bind(
            _fields(east=east, north=north, sin_s=F.sqrt(east * east + north * north), cos_s=i["s1"] * i["s2"] + i["c1"] * i["c2"] * cl, sl=sl, cl=cl),
            lambda w: _bind(
                F.when(w["sin_s"] > 0, i["c1"] * i["c2"] * w["sl"] / w["sin_s"]).otherwise(F.lit(0.0)),
                lambda sin_a: _fields(
                    east=w["east"], north=w["north"], sin_s=w["sin_s"], cos_s=w["cos_s"], arc=F.atan2(w["sin_s"], w["cos_s"]), sin_a=sin_a, cos2=1 - sin_a * sin_a,
                    cos_m=F.when(1 - sin_a * sin_a > 1e-15, w["cos_s"] - 2 * i["s1"] * i["s2"] / (1 - sin_a * sin_a)).otherwise(F.lit(0.0)), sl=w["sl"], cl=w["cl"],
                ),
            ),
        )

    def step(i: Column, s: Column) -> Column:
        def moved(w: Column) -> Column:
            new = i["dl"] + _turn_change(f, w["sin_a"], w["cos2"], w["arc"], w["sin_s"], w["cos_s"], w["cos_m"])
            return _bind(new, lambda n: _fields(l=n, done=F.abs(n - s["l"]) < CLOSE))

        return _bind(arcs(i, s["l"]), moved)

    def plain(i: Column, lam: Column) -> Column:
        def told(w: Column) -> Column:
            t = _length_terms(a, b, w["cos2"])
            length = _bind(t, lambda t: b * t["a"] * (w["arc"] - _arc_change(t, w["sin_s"], w["cos_s"], w["cos_m"])))
            return _fields(distance=length, azimuth=_bearing(w["east"], w["north"]), azimuth2=_bearing(i["c1"] * w["sl"], i["c1"] * i["s2"] * w["cl"] - i["s1"] * i["c2"]))

        return _bind(arcs(i, lam), told)

    def halved(i: Column) -> Column:
        """The same by halving the azimuth: the points are turned so that the first lies south and farthest from the equator, and the other
        east. A first point on the equator lies a trace below it, as Spark's atan2 knows no negative zero."""
        swap = F.abs(i["s1"]) < F.abs(i["s2"])
        p = F.when(swap, _fields(s=i["s2"], c=i["c2"], s2=i["s1"], c2=i["c1"])).otherwise(_fields(s=i["s1"], c=i["c1"], s2=i["s2"], c2=i["c2"]))
        p = _bind(p, lambda p: _fields(side=F.when(p["s"] > 0, F.lit(-1.0)).otherwise(F.lit(1.0)), s=F.least(-F.abs(p["s"]), F.lit(-1e-300)), c=p["c"], s2=F.when(p["s"] > 0, -p["s2"]).otherwise(p["s2"]), c2=p["c2"]))

        def reached(p: Column, z: Column) -> Column:
            sin_z, cos_z = F.sin(z), F.cos(z)
            sin_a = sin_z * p["c"]
            sin_2 = sin_a / p["c2"]
            cos_2 = F.sqrt(F.greatest(F.lit(0.0), cos_z * cos_z * p["c"] * p["c"] + p["c2"] * p["c2"] - p["c"] * p["c"])) / p["c2"]
            ends = _fields(
                sin_a=sin_a, sin_z=sin_z, cos_z=cos_z, sin_2=sin_2, cos_2=cos_2, s1=F.atan2(p["s"], cos_z * p["c"]), s2=F.atan2(p["s2"], cos_2 * p["c2"]),
                w1=F.atan2(sin_a * p["s"], cos_z * p["c"]), w2=F.atan2(sin_a * p["s2"], cos_2 * p["c2"]),
            )
            return _bind(
                ends,
                lambda e: _fields(
                    lam=e["w2"] - e["w1"] - _turn_change(f, e["sin_a"], 1 - e["sin_a"] * e["sin_a"], e["s2"] - e["s1"], F.sin(e["s2"] - e["s1"]), F.cos(e["s2"] - e["s1"]), F.cos(e["s1"] + e["s2"])),
                    arc=e["s2"] - e["s1"], middle=e["s1"] + e["s2"], sin_a=e["sin_a"], sin_z=e["sin_z"], cos_z=e["cos_z"], sin_2=e["sin_2"], cos_2=e["cos_2"],
                ),
            )

        def told(p: Column) -> Column:
            goal = F.abs(i["dl"])
            ends = F.aggregate(
                F.sequence(F.lit(1), F.lit(HALVINGS)),
                _fields(lo=F.lit(0.0), hi=F.lit(math.pi)),
                lambda r, _: _bind((r["lo"] + r["hi"]) / 2, lambda m: F.when(reached(p, m)["lam"] < goal, _fields(lo=m, hi=r["hi"])).otherwise(_fields(lo=r["lo"], hi=m))),
            )

            def out(g: Column) -> Column:
                t = _length_terms(a, b, 1 - g["sin_a"] * g["sin_a"])
                length = _bind(t, lambda t: b * t["a"] * (g["arc"] - _arc_change(t, F.sin(g["arc"]), F.cos(g["arc"]), F.cos(g["middle"]))))
                way, east = F.when(swap, F.lit(-1.0)).otherwise(F.lit(1.0)), F.when(i["dl"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
                pick = lambda one, two: F.when(swap, two).otherwise(one)
                return _fields(
                    distance=length,
                    azimuth=_bearing(east * pick(g["sin_z"], g["sin_2"]), way * p["side"] * pick(g["cos_z"], g["cos_2"])),
                    azimuth2=_bearing(east * pick(g["sin_2"], g["sin_z"]), way * p["side"] * pick(g["cos_2"], g["cos_z"])),
                )

            return _bind(_bind(ends, lambda r: reached(p, (r["lo"] + r["hi"]) / 2)), out)

        return _bind(p, told)

    def whole(i: Column) -> Column:
        same = (i["dl"] == 0) & (i["s1"] == i["s2"])
        found = _fold(_fields(l=i["dl"], done=F.lit(False)), lambda s: step(i, s), STEPS)
        ordinary = _bind(found, lambda s: F.when(s["done"] & (F.abs(s["l"]) <= math.pi), plain(i, s["l"])).otherwise(halved(i)))
        return F.when(same, _fields(distance=F.lit(0.0), azimuth=F.lit(0.0), azimuth2=F.lit(0.0))).otherwise(ordinary)

    u = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    inputs = _bind(_fields(u1=u(lat1), u2=u(lat2), dl=F.radians(_turn(lon2 - lon1))), lambda i: _fields(s1=F.sin(i["u1"]), c1=F.cos(i["u1"]), s2=F.sin(i["u2"]), c2=F.cos(i["u2"]), dl=i["dl"]))
    return F.when(lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull(), _bind(inputs, whole))


# Projections -------------------------------------------------------------------------------------------------------


def _eccentricity(f: float) -> float:
    return math.sqrt(f * (2 - f))


def _conformal(e: float, phi: Column) -> Column:
    """Snyder's t: the tangent of half the colatitude on the conformal sphere."""
    s = e * F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))


def _conformal_of(e: float, phi: float) -> float:
    s = e * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)


def _latitude_of(e: float, t: Column) -> Column:
    """The latitude of a t, by a fixed point."""

    def step(s: Column, t: Column) -> Column:
        x = e * F.sin(s["p"])
        return _bind(math.pi / 2 - 2 * F.atan(t * F.pow((1 - x) / (1 + x), F.lit(e / 2))), lambda p: _fields(p=p, done=F.abs(p - s["p"]) < CLOSE))

    return _bind(t, lambda t: _fold(_fields(p=math.pi / 2 - 2 * F.atan(t), done=F.lit(False)), lambda s: step(s, t), STEPS)["p"])


def _series(f: float, kind: str) -> list[float]:
    """Krueger's coefficients in the third flattening, to its sixth power."""
    n = f / (2 - f)
    rows = {
        "forward": [
            (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
            (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
            (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
            (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
            (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
            (0, 0, 0, 0, 0, 212378941 / 319334400),
        ],
        "inverse": [
            (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
            (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
            (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
            (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
            (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
            (0, 0, 0, 0, 0, 20648693 / 638668800),
        ],
    }
    return [sum(c * n ** (k + 1) for k, c in enumerate(row)) for row in rows[kind]]


def _rectifying(a: float, f: float) -> float:
    n = f / (2 - f)
    return a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def transverse_mercator(lon: Column, lat: Column, lon0: float | Column = 0.0, k0: float = 1.0, x0: float = 0.0, y0: float | Column = 0.0, ellipsoid: str = "WGS84") -> Column:
    """struct(x, y); good to well under a millimetre within 3,900 km of the central meridian."""
    a, f = ELLIPSOIDS[ellipsoid]
    e, scale, terms = _eccentricity(f), k0 * _rectifying(a, f), _series(f, "forward")
    lam, phi = F.radians(_turn(lon - lon0)), F.radians(lat)

    def sphere(i: Column) -> Column:
        tau = F.sinh(F.atanh(F.sin(i["phi"])) - (e * F.atanh(e * F.sin(i["phi"])) if e else F.lit(0.0)))
        return _bind(tau, lambda t: _fields(xi=F.atan2(t, F.cos(i["lam"])), eta=F.asinh(F.sin(i["lam"]) / F.sqrt(t * t + F.cos(i["lam"]) * F.cos(i["lam"])))))

    def plane(s: Column) -> Column:
        x, y = s["eta"], s["xi"]
        for k, c in enumerate(terms, 1):
            x = x + c * F.cos(2 * k * s["xi"]) * F.sinh(2 * k * s["eta"])
            y = y + c * F.sin(2 * k * s["xi"]) * F.cosh(2 * k * s["eta"])
        return _fields(x=x0 + scale * x, y=y0 + scale * y)

    return _bind(_bind(_fields(lam=lam, phi=phi), sphere), plane)


def transverse_mercator_inverse(x: Column, y: Column, lon0: float | Column = 0.0, k0: float = 1.0, x0: float = 0.0, y0: float | Column = 0.0, ellipsoid: str = "WGS84") -> Column:
    """struct(lon, lat)."""
    a, f = ELLIPSOIDS[ellipsoid]
    e, scale, terms = _eccentricity(f), k0 * _rectifying(a, f), _series(f, "inverse")

    def sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for k, c in enumerate(terms, 1):
            xi = xi - c * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"])
            eta = eta - c * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"])
        return _fields(xi=xi, eta=eta)

    def globe(s: Column) -> Column:
        chi = F.asin(F.sin(s["xi"]) / F.cosh(s["eta"]))
        return _fields(lon=_turn(lon0 + F.degrees(F.atan2(F.sinh(s["eta"]), F.cos(s["xi"])))), lat=F.degrees(_latitude_of(e, F.tan(math.pi / 4 - chi / 2))))

    return _bind(_bind(_fields(eta=(x - x0) / scale, xi=(y - y0) / scale), sphere), globe)


def utm_zone(lon: Column) -> Column:
    """Zones 1 to 60 by longitude alone."""
    return (F.floor((_turn(lon) + 180) / 6) % 60 + 1).cast("int")


def utm(lon: Column, lat: Column, zone: Column | None = None, ellipsoid: str = "WGS84") -> Column:
    """struct(zone, north, x, y)."""
    zone = utm_zone(lon) if zone is None else zone
    north = lat >= 0
    p = transverse_mercator(lon, lat, zone * 6.0 - 183, 0.9996, 500000.0, F.when(north, 0.0).otherwise(10000000.0), ellipsoid)
    return _bind(p, lambda p: _fields(zone=zone, north=north, x=p["x"], y=p["y"]))


def utm_inverse(x: Column, y: Column, zone: Column, north: Column, ellipsoid: str = "WGS84") -> Column:
    return transverse_mercator_inverse(x, y, zone * 6.0 - 183, 0.9996, 500000.0, F.when(north, 0.0).otherwise(10000000.0), ellipsoid)


def _cone(a: float, f: float, lat0: float, lat1: float, lat2: float) -> tuple[float, float, float]:
    """Constants n, F and the radius of the origin of a conformal cone that touches or cuts at lat1 and lat2."""
    e = _eccentricity(f)
    p0, p1, p2 = (math.radians(x) for x in (lat0, lat1, lat2))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: _conformal_of(e, p)
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    if abs(n) < 1e-10:
        raise ValueError("standard parallels may not be opposite")
    big = m(p1) / (n * t(p1) ** n)
    return n, big, a * big * t(p0) ** n


def lambert_conic(lon: Column, lat: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, x0: float = 0.0, y0: float = 0.0, ellipsoid: str = "WGS84") -> Column:
    """struct(x, y) of Lambert's conformal conic; equal parallels are one at which it touches."""
    a, f = ELLIPSOIDS[ellipsoid]
    n, big, r0 = _cone(a, f, lat0, lat1, lat2)
    r = a * big * F.pow(_conformal(_eccentricity(f), F.radians(lat)), F.lit(n))
    return _bind(_fields(r=r, t=n * F.radians(_turn(lon - lon0))), lambda p: _fields(x=x0 + p["r"] * F.sin(p["t"]), y=y0 + r0 - p["r"] * F.cos(p["t"])))


def lambert_conic_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, x0: float = 0.0, y0: float = 0.0, ellipsoid: str = "WGS84") -> Column:
    a, f = ELLIPSOIDS[ellipsoid]
    n, big, r0 = _cone(a, f, lat0, lat1, lat2)
    sign = 1.0 if n > 0 else -1.0

    def out(p: Column) -> Column:
        r = sign * F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        return _fields(lon=_turn(lon0 + F.degrees(F.atan2(sign * p["x"], sign * p["y"])) / n), lat=F.degrees(_latitude_of(_eccentricity(f), F.pow(r / (a * big), F.lit(1 / n)))))

    return _bind(_fields(x=x - x0, y=r0 - (y - y0)), out)


def _authalic(e: float, s: float) -> float:
    return (1 - e * e) * (s / (1 - (e * s) ** 2) - math.log((1 - e * s) / (1 + e * s)) / (2 * e)) if e else 2 * s


def _equal_area_cone(f: float, lat0: float, lat1: float, lat2: float) -> tuple[float, float, float]:
    """Constants n, C and the q of the origin."""
    e = _eccentricity(f)
    s0, s1, s2 = (math.sin(math.radians(x)) for x in (lat0, lat1, lat2))
    m = lambda s: (1 - s * s) / (1 - (e * s) ** 2)
    n = s1 if abs(s1 - s2) < 1e-10 else (m(s1) - m(s2)) / (_authalic(e, s2) - _authalic(e, s1))
    if abs(n) < 1e-10:
        raise ValueError("standard parallels may not be opposite")
    return n, m(s1) + n * _authalic(e, s1), _authalic(e, s0)


def albers(lon: Column, lat: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, x0: float = 0.0, y0: float = 0.0, ellipsoid: str = "WGS84") -> Column:
    """struct(x, y) of Albers' equal-area conic."""
    a, f = ELLIPSOIDS[ellipsoid]
    e = _eccentricity(f)
    n, c, q0 = _equal_area_cone(f, lat0, lat1, lat2)
    r0 = a * math.sqrt(c - n * q0) / n
    s = F.sin(F.radians(lat))
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e)) if e else 2 * s
    r = a * F.sqrt(F.greatest(F.lit(0.0), c - n * q)) / n
    return _bind(_fields(r=r, t=n * F.radians(_turn(lon - lon0))), lambda p: _fields(x=x0 + p["r"] * F.sin(p["t"]), y=y0 + r0 - p["r"] * F.cos(p["t"])))


def albers_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float = 0.0, lon0: float = 0.0, x0: float = 0.0, y0: float = 0.0, ellipsoid: str = "WGS84") -> Column:
    """struct(lon, lat); the latitude by Newton's steps on its area."""
    a, f = ELLIPSOIDS[ellipsoid]
    e = _eccentricity(f)
    n, c, q0 = _equal_area_cone(f, lat0, lat1, lat2)
    r0, pole, sign = a * math.sqrt(c - n * q0) / n, _authalic(e, 1.0), 1.0 if n > 0 else -1.0

    def latitude(q: Column) -> Column:
        if not e:
            return F.asin(q / 2)

        def step(s: Column) -> Column:
            v, w = F.sin(s["p"]), F.cos(s["p"])
            d = 1 - e * e * v * v
            new = s["p"] + d * d / (2 * w) * (q / (1 - e * e) - v / d + F.log((1 - e * v) / (1 + e * v)) / (2 * e))
            return _bind(new, lambda p: _fields(p=p, done=F.abs(p - s["p"]) < CLOSE))

        found = _fold(_fields(p=F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / pole))), done=F.lit(False)), step, STEPS)["p"]
        return F.when(F.abs(q) >= pole - 1e-14, F.signum(q) * (math.pi / 2)).otherwise(found)

    def out(p: Column) -> Column:
        q = (c - (p["x"] * p["x"] + p["y"] * p["y"]) * (n * n / (a * a))) / n
        return _fields(lon=_turn(lon0 + F.degrees(F.atan2(sign * p["x"], sign * p["y"])) / n), lat=F.degrees(_bind(q, latitude)))

    return _bind(_fields(x=x - x0, y=r0 - (y - y0)), out)


def _polar_scale(a: float, f: float, true_at: float | None, k0: float) -> float:
    """Radius for t = 1: by the parallel of true scale, or the scale at the pole."""
    e = _eccentricity(f)
    if true_at is None or abs(abs(true_at) - 90) < 1e-10:
        return 2 * a * k0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    p = math.radians(abs(true_at))
    return a * math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) / _conformal_of(e, p)


def polar_stereographic(lon: Column, lat: Column, south: bool = False, lon0: float = 0.0, true_at: float | None = None, k0: float = 1.0, x0: float = 0.0, y0: float = 0.0, ellipsoid: str = "WGS84") -> Column:
    """struct(x, y) around a pole."""
    a, f = ELLIPSOIDS[ellipsoid]
    sign, e = -1.0 if south else 1.0, _eccentricity(f)
    r = _polar_scale(a, f, true_at, k0) * _conformal(e, sign * F.radians(lat))
    return _bind(_fields(r=r, t=F.radians(_turn(lon - lon0))), lambda p: _fields(x=x0 + p["r"] * F.sin(p["t"]), y=y0 - sign * p["r"] * F.cos(p["t"])))


def polar_stereographic_inverse(x: Column, y: Column, south: bool = False, lon0: float = 0.0, true_at: float | None = None, k0: float = 1.0, x0: float = 0.0, y0: float = 0.0, ellipsoid: str = "WGS84") -> Column:
    a, f = ELLIPSOIDS[ellipsoid]
    sign, e, scale = -1.0 if south else 1.0, _eccentricity(f), _polar_scale(a, f, true_at, k0)

    def out(p: Column) -> Column:
        t = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]) / scale
        return _fields(lon=_turn(lon0 + F.degrees(F.atan2(p["x"], -sign * p["y"]))), lat=sign * F.degrees(_latitude_of(e, t)))

    return _bind(_fields(x=x - x0, y=y - y0), out)
