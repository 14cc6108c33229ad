"""Places of pixels on the Earth from the tags of GeoTIFF files, by the published specification, as expressions over the tag maps
that readers.tiff_pages gives (numbers as comma lists): the map from pixels to coordinates by scale and tie point, by matrix, or by three
tie points, the keys of the directory, and longitude and latitude through functions.geodesy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geodesy

#: Tags and keys.
SCALE, TIES, MATRIX, KEYS, DOUBLES, TEXTS = 33550, 33922, 34264, 34735, 34736, 34737
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
POINT = 2


def _numbers(tags: Column, tag: int, kind: str = "double") -> Column:
    return F.transform(F.split(tags[tag], ","), lambda x: x.try_cast(kind))


def geo_keys(tags: Column) -> Column:
    """Keys of the directory as a map from number to text; numbers and texts that lie in tags of their own are looked up there.
    Null without a directory; an entry beyond the directory's end, or beyond the tag that it names, has a null value."""
    codes, doubles, letters = _numbers(tags, KEYS, "int"), _numbers(tags, DOUBLES), _numbers(tags, TEXTS, "int")

    def value(at: Column) -> Column:
        place, n, v = F.get(codes, at + 1), F.get(codes, at + 2), F.get(codes, at + 3)
        text = F.array_join(F.transform(F.slice(letters, v + 1, n), lambda c: F.chr(c)), "")
        several = F.array_join(F.transform(F.slice(doubles, v + 1, n), lambda d: d.cast("string")), ",")
        return F.when(place == 0, v.cast("string")).when(place == TEXTS, F.rtrim(text, F.lit("|"))).when(place == DOUBLES, several)

    entries = F.transform(F.sequence(F.lit(4), F.get(codes, F.lit(3)) * 4, F.lit(4)), lambda at: F.struct(F.get(codes, at).alias("key"), value(at).alias("value")))
    entries = F.filter(entries, lambda e: e["key"].isNotNull())
    return F.when(F.get(codes, F.lit(3)) > 0, F.map_from_entries(F.array_distinct(entries)))


def _affine(a, b, c, d, e, f) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip((a, b, c, d, e, f), "abcdef", strict=True)))


def transform_of(tags: Column) -> Column:
    """struct(a, b, c, d, e, f) with x = a * column + b * row + c and y = d * column + e * row + f; null if the tags don't tell."""
    m, s, t = _numbers(tags, MATRIX), _numbers(tags, SCALE), _numbers(tags, TIES)
    at = lambda v, k: F.get(v, F.lit(k))
    by_matrix = _affine(at(m, 0), at(m, 1), at(m, 3), at(m, 4), at(m, 5), at(m, 7))
    zero = F.lit(0.0)
    by_scale = _affine(at(s, 0), zero, at(t, 3) - at(t, 0) * at(s, 0), zero, -at(s, 1), at(t, 4) + at(t, 1) * at(s, 1))
    # three tie points (column, row, -, x, y, -): two differences of pixels and of coordinates
    u1, v1, u2, v2 = at(t, 6) - at(t, 0), at(t, 7) - at(t, 1), at(t, 12) - at(t, 0), at(t, 13) - at(t, 1)
    det = u1 * v2 - u2 * v1

    def solved(k: int) -> tuple[Column, Column, Column]:
        p, q = at(t, 6 + k) - at(t, k), at(t, 12 + k) - at(t, k)
        a, b = (p * v2 - q * v1) / det, (q * u1 - p * u2) / det
        return a, b, at(t, k) - a * at(t, 0) - b * at(t, 1)

    by_ties = F.when(det != 0, _affine(*solved(3), *solved(4)))
    return F.when(F.size(m) >= 16, by_matrix).when((F.size(s) >= 2) & (F.size(t) >= 6), by_scale).when(F.size(t) >= 18, by_ties)


def map_place(transform: Column, keys: Column, column: Column, row: Column) -> Column:
    """struct(x, y) of a pixel's centre: half a pixel in where pixels are areas, which they are unless the keys say points."""
    half = F.when(keys[RASTER_TYPE] == str(POINT), 0.0).otherwise(0.5)
    u, v = column + half, row + half
    xy = lambda t: F.struct((t["a"] * u + t["b"] * v + t["c"]).alias("x"), (t["d"] * u + t["e"] * v + t["f"]).alias("y"))
    return F.when(transform.isNotNull(), xy(transform))


def lon_lat(place: Column, keys: Column) -> Column:
    """struct(lon, lat): of geographic coordinates themselves, of UTM zones on WGS 84 and NAD 83 by projection; null for others."""
    code = keys[PROJECTED].try_cast("int")
    zone = F.when(code.between(32601, 32660), code - 32600).when(code.between(32701, 32760), code - 32700).when(code.between(26901, 26923), code - 26900)
    by_zone = lambda ellipsoid: geodesy.utm_inverse(place["x"], place["y"], zone, ~code.between(32701, 32760), ellipsoid)
    plain = F.struct(place["x"].alias("lon"), place["y"].alias("lat"))
    return F.when(code.between(26901, 26923), by_zone("GRS80")).when(zone.isNotNull(), by_zone("WGS84")).when(code.isNull() & keys[GEOGRAPHIC].isNotNull(), plain)
