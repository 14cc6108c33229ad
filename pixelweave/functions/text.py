"""String, tag and date functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def after_last_insert(s: Column, mark: str, add: str) -> Column:
    """add put behind the last mark; s as it is where there is none."""
    tail = F.substring_index(s, mark, -1)
    head = F.substr(s, F.lit(1), F.length(s) - F.length(tail))
    return F.when(F.contains(s, F.lit(mark)), F.concat(head, F.lit(add), tail)).otherwise(s)


def strip(s: Column, chars: str = " ") -> Column:
    return F.btrim(s, F.lit(chars))


def lstrip(s: Column, chars: str = " ") -> Column:
    return F.ltrim(s, F.lit(chars))


def rstrip(s: Column, chars: str = " ") -> Column:
    return F.rtrim(s, F.lit(chars))


def erase_zeros(s: Column) -> Column:
    """Without NUL characters."""
    return F.replace(s, F.lit("\0"), F.lit(""))


def to_bool(s: Column, default: bool = False) -> Column:
    low = F.lower(F.btrim(s))
    return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False).otherwise(default)


def to_int(s: Column, default: int = 0) -> Column:
    return F.coalesce(s.try_cast("int"), F.lit(default))


def to_double(s: Column, default: float = 0.0) -> Column:
    return F.coalesce(s.try_cast("double"), F.lit(default))


def split(s: Column, sep: str, ignore_empty: bool = True) -> Column:
    parts = F.split(s, re.escape(sep), -1)
    return F.filter(parts, lambda x: x != "") if ignore_empty else parts


def split_ints(s: Column, sep: str, default: int = 0) -> Column:
    return F.transform(split(s, sep), lambda x: to_int(x, default))


def split_doubles(s: Column, sep: str, default: float = 0.0) -> Column:
    return F.transform(split(s, sep), lambda x: to_double(x, default))


def join(values: Column, sep: str) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep)


def left_of(s: Column, mark: str) -> Column:
    """What is before the first mark; all where there is none."""
    return F.substring_index(s, mark, 1)


def right_of(s: Column, mark: str) -> Column:
    """What is behind the first mark; nothing where there is none."""
    at = F.instr(s, mark)
    return F.when(at > 0, F.substr(s, at + F.lit(len(mark)))).otherwise("")


def section(s: Column, start: str, end: str) -> Column:
    return left_of(right_of(s, start), end)


def template(text: Column, values: Column) -> Column:
    """{name} replaced by the map's value."""
    return F.reduce(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def parse_ini(text: Column, sep: str = "=", prefix: str = "") -> Column:
    """Lines 'key<sep>value' as a map; [sections] come before the key, with a slash. Of equal keys the last counts."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.btrim(x)), lambda x: x != "")
    zero = F.struct(F.lit("").alias("section"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("found"))

    def step(acc, line):
        header = F.regexp_extract(line, r"^\[(.*)\]$", 1)
        at = F.instr(line, sep)
        key = F.concat(F.lit(prefix), F.when(acc["section"] != "", F.concat(acc["section"], F.lit("/"))).otherwise(F.lit("")), F.btrim(F.substr(line, F.lit(1), at - 1)))
        kept = F.map_filter(acc["found"], lambda k, _: k != key)
        added = F.map_concat(kept, F.create_map(key, F.btrim(F.substr(line, at + F.lit(len(sep))))))
        return F.struct(F.when(header != "", header).otherwise(acc["section"]).alias("section"), F.when((header == "") & (at > 0), added).otherwise(acc["found"]).alias("found"))

    return F.aggregate(lines, zero, step, lambda acc: acc["found"])


def objective(s: Column) -> Column:
    """Magnification and numerical aperture in a lens name such as 'Plan-Apochromat 63x/1.4 Oil'."""
    return F.struct(F.regexp_extract(s, r"([0-9]+(?:\.[0-9]+)?)\s*[xX]", 1).try_cast("double").alias("magnification"), F.regexp_extract(s, r"[xX]\s*/?\s*([0-9]*\.[0-9]+)", 1).try_cast("double").alias("aperture"))


def point_xml(name: Column, x: Column, y: Column) -> Column:
    return F.format_string("<gobject type='point' name='%d'><vertex x='%.6f' y='%.6f'/></gobject>", name.cast("int"), x.cast("double"), y.cast("double"))


def folder(path: Column) -> Column:
    """Slashes only, one at the end."""
    s = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.endswith(s, F.lit("/")), s).otherwise(F.concat(s, F.lit("/")))


def summary(width: Column, height: Column, samples: Column, depth: Column, pages: Column) -> Column:
    return F.concat_ws("", F.lit("pages: "), pages.cast("string"), F.lit(", size: "), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(", channels: "), samples.cast("string"), F.lit(", bits: "), depth.cast("string"))


#: Abbreviations of the months, in order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month(s: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), F.left(s, F.lit(3))), F.lit(0)).cast("int")


def _number(s: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(s, pattern, group).try_cast("int"), F.lit(0))


def _stamp(*parts: Column) -> Column:
    return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *parts)


def ibw_date(note: Column) -> Column:
    """'Date: Tue, Sep 20, 2005' and 'Time: 10:58:49 AM' as a time; AM and PM are ignored, missing parts are 0."""
    d, t = r"Date:\s*\w+,\s*(\w+)\s+(\d+),\s*(\d+)", r"Time:\s*(\d+):(\d+):(\d+)"
    return _stamp(_number(note, d, 3), month(F.regexp_extract(note, d, 1)), _number(note, d, 2), *(_number(note, t, i) for i in (1, 2, 3)))


def nanoscope_date(header: Column) -> Column:
    """'Date: 10:58:49 AM Tue Sep 20 2005' as a time; null without a Date."""
    d = r"Date:\s*(\d+):(\d+):(\d+)\s+\w+\s+\w+\s+(\w+)\s+(\d+)\s+(\d+)"
    return F.when(F.contains(header, F.lit("Date:")), _stamp(_number(header, d, 6), month(F.regexp_extract(header, d, 4)), _number(header, d, 5), *(_number(header, d, i) for i in (1, 2, 3))))


def fluoview_date(text: Column) -> Column:
    """'Date=MM-DD-YYYY' and 'Time=H:M:S' as 'DD-MM-YYYY HH:MM:SS'."""
    d, t = r"Date=(\d+)-(\d+)-(\d+)", r"Time=(\d+):(\d+):(\d+)"
    return F.format_string("%02d-%02d-%04d %02d:%02d:%02d", _number(text, d, 2), _number(text, d, 1), _number(text, d, 3), *(_number(text, t, i) for i in (1, 2, 3)))


def resolution(text: Column) -> Column:
    """'Resolution<tab>x<tab>y' as pixel sizes."""
    p = r"Resolution\t([0-9.eE+-]+)\t([0-9.eE+-]+)"
    return F.struct(F.regexp_extract(text, p, 1).try_cast("double").alias("x"), F.regexp_extract(text, p, 2).try_cast("double").alias("y"))


def tag(tags: Column, key: str, kind: str, default) -> Column:
    """A tag in a type, or the default: absent values are never null."""
    return F.coalesce(F.element_at(tags, key).try_cast(kind), F.lit(default))


def natural_key(name: Column) -> Column:
    """Blocks of digits and of other characters, the last first: numbers by value, before text."""
    blocks = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    keyed = F.transform(blocks, lambda b: F.struct(F.when(b.rlike("^[0-9]"), 0).otherwise(1).alias("kind"), F.coalesce(b.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"), b.alias("text")))
    return F.reverse(keyed)


#: Colour-space signatures of profiles and the modes they stand for; anything else is multichannel.
COLOUR_SPACES = {
    "XYZ ": "XYZ", "Lab ": "LAB", "Luv ": "LUV", "YCbr": "YCbCr", "RGB ": "RGB", "GRAY": "GRAYSCALE", "HSV ": "HSV", "HLS ": "HSL", "CMYK": "CMYK", "CMY ": "CMY",
}


def colour_mode(signature: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in COLOUR_SPACES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, signature), F.lit("MULTI"))


def icc_tags(profile: Column) -> Column:
    """Version, colour space and size in the header of an ICC profile (binary); an empty map for anything shorter."""
    byte = lambda i: F.conv(F.hex(F.substring(profile, i + 1, 1)), 16, 10).cast("int")
    version = F.concat_ws(".", byte(8).cast("string"), F.floor(byte(9) / 16).cast("string"))
    tags = F.create_map(F.lit("icc/version"), version, F.lit("icc/color_space"), colour_mode(F.decode(F.substring(profile, 17, 4), "UTF-8")), F.lit("icc/size"), F.octet_length(profile).cast("string"))
    return F.when(F.octet_length(profile) >= 128, tags).otherwise(F.create_map().cast("map<string,string>"))


#: Private tags of TIFF dialects.
TIFF_TAGS = {
    33628: "stk", 33629: "stk", 33630: "stk", 33631: "stk", 50432: "psia", 50433: "psia", 50434: "psia", 50435: "psia", 50436: "psia", 50437: "psia", 34665: "exif",
    34361: "fluoview", 34362: "fluoview", 34386: "fluoview", 34412: "lsm", 51123: "micro-manager", 33550: "geotiff", 33920: "geotiff", 33922: "geotiff", 34264: "geotiff",
    34735: "geotiff", 34736: "geotiff", 34737: "geotiff",
}


def tiff_dialect(number: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TIFF_TAGS.items() for x in kv)), number)
