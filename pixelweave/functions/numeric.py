"""Rounding, bytes and bits, vectors, geodesy and time bases as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def iround(x: Column, digits: int = 0) -> Column:
    """Halves upwards, also below zero: floor(x + 0.5)."""
    if not digits:
        return F.floor(x + 0.5)
    return F.floor(x * 10**digits + 0.5) / 10**digits


def byte(data: Column, i: Column) -> Column:
    """The byte at position i from 0 as an integer."""
    return F.conv(F.hex(F.substr(data, i + 1, F.lit(1))), 16, 10).cast("int")


def swap(data: Column) -> Column:
    """The bytes of one value in the other order."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))), ""))


def _each(width: Column, f) -> Column:
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), f)).otherwise(F.array().cast("array<int>"))


def unpack1(data: Column, width: Column) -> Column:
    """Bits, the highest first."""
    return _each(width, lambda i: F.floor(byte(data, F.floor(i / 8).cast("int")) / F.pow(F.lit(2), 7 - i % 8)).cast("int") % 2)


def unpack4(data: Column, width: Column) -> Column:
    """Half bytes, the high one first."""
    return _each(width, lambda i: F.when(i % 2 == 0, F.floor(byte(data, F.floor(i / 2).cast("int")) / 16).cast("int")).otherwise(byte(data, F.floor(i / 2).cast("int")) % 16))


def _twelve(data: Column, width: Column, even, odd) -> Column:
    def at(i):
        first = (F.floor(i / 2) * 3).cast("int")
        a, b, c = byte(data, first), byte(data, first + 1), byte(data, first + 2)
        return F.when(i % 2 == 0, even(a, b)).otherwise(odd(b, c))

    return _each(width, at)


def unpack12_ref(data: Column, width: Column) -> Column:
    """Two 12-bit values in three bytes, the published variant: eight bits * 256 + four bits."""
    return _twelve(data, width, lambda a, b: a * 256 + F.floor(b / 16).cast("int"), lambda b, c: (b % 16 * 16 + F.floor(c / 16).cast("int")) * 256 + c % 16)


def unpack12(data: Column, width: Column) -> Column:
    """Two 12-bit values in three bytes, the usual packing."""
    return _twelve(data, width, lambda a, b: a * 16 + F.floor(b / 16).cast("int"), lambda b, c: b % 16 * 256 + c)


def i16_to_u16(v: Column) -> Column:
    return F.pmod(v.cast("int") + 32767, F.lit(65536))


def fourcc(s: Column) -> Column:
    """Four letters as a number, the first the lowest byte."""
    return sum((F.ascii(F.substr(s, F.lit(i + 1), F.lit(1))).cast("long") * 256**i for i in range(1, 4)), F.ascii(F.substr(s, F.lit(1), F.lit(1))).cast("long"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def divide(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def cross(a: Column, b: Column) -> Column:
    return F.array(*(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))))


def rescale(v: Column, slope: float, intercept: float) -> Column:
    return v * slope + intercept


def rescale_inverse(v: Column, slope: float, intercept: float) -> Column:
    return (v - intercept) / slope


def time_rescale(a: Column, num: int, den: int, to_num: int, to_den: int) -> Column:
    """a * (num / den) / (to_num / to_den) to the nearest whole, halves away from zero, without overflow."""
    wide = a.cast("decimal(20,0)") * F.lit(num * to_den).cast("decimal(18,0)")
    return F.round(wide.cast("decimal(38,0)") / F.lit(den * to_num).cast("decimal(18,0)"), 0).cast("long")


#: Semi-major axis and flattening of WGS 84.
WGS84 = (6378137.0, 1 / 298.257223563)


def mercator(lon: Column, lat: Column, ellipsoid: bool = True, lon0: float = 0.0) -> Column:
    """Forward Mercator from degrees to metres."""
    a, f = WGS84
    e = math.sqrt(2 * f - f * f) if ellipsoid else 0.0
    phi = F.radians(lat)
    shape = F.log(F.tan(F.lit(math.pi / 4) + phi / 2)) + (F.lit(e / 2) * F.log((1 - e * F.sin(phi)) / (1 + e * F.sin(phi))))
    return F.struct((a * F.radians(lon - lon0)).alias("x"), (a * shape).alias("y"))


def mercator_inverse(x: Column, y: Column, ellipsoid: bool = True, lon0: float = 0.0) -> Column:
    a, f = WGS84
    e = math.sqrt(2 * f - f * f) if ellipsoid else 0.0
    t = F.exp(-y / a)
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(6 if ellipsoid else 0):
        phi = F.transform(F.array(phi), lambda p: math.pi / 2 - 2 * F.atan(t * F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))))[0]
    return F.struct((F.degrees(x / a) + lon0).alias("lon"), F.degrees(phi).alias("lat"))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Distance on the sphere by half angles."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def extent(a: Column, b: Column) -> Column:
    """Width of an inclusive range given by two corners in any order."""
    return F.greatest(a, b) - F.least(a, b) + 1


def visible(z: Column, t: Column, at_z: float, at_t: float) -> Column:
    """Whether a vertex is drawn at (z, t): a missing coordinate is everywhere."""
    return F.coalesce(F.abs(z - at_z) < 0.5, F.lit(True)) & F.coalesce(F.abs(t - at_t) < 0.5, F.lit(True))


def all_less(a: Column, b: Column, fields: tuple[str, ...] = ("x", "y", "z", "t", "c")) -> Column:
    """Every component less: a partial order."""
    out = F.lit(True)
    for f in fields:
        out = out & (a[f] < b[f])
    return out
