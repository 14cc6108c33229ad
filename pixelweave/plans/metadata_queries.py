"""Queries of text, numeric and series functions over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import series as S
from .raster_queries import images


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    name = F.col("c_name")
    return c.select(
        "c_custkey",
        T.after_last_insert(name, "#", "no. ").alias("inserted"),
        T.strip(F.concat(F.lit("..x"), name, F.lit("y..")), ".xy").alias("stripped"),
        T.left_of(name, "#").alias("left_part"),
        T.right_of(name, "#").alias("right_part"),
        T.section(F.concat(name, F.lit("]tail")), "#", "]").alias("section"),
        T.to_int(T.right_of(name, "#"), -1).alias("as_int"),
        T.to_int(name, -1).alias("as_default"),
        F.round(T.to_double(F.concat(F.lit("1."), T.right_of(name, "#"))), 6).alias("as_double"),
        T.to_bool(F.when(F.col("c_custkey") % 2 == 0, "TRUE").otherwise("0"), True).alias("as_bool"),
        F.upper(name).alias("up"),
        F.startswith(name, F.lit("Cust")).alias("starts"),
        F.contains(name, F.lit("#0")).alias("has"),
        T.folder(F.concat(F.lit("a\\b\\"), name)).alias("path"),
        T.point_xml(F.col("c_custkey") % 100, F.col("c_acctbal"), F.lit(2)).alias("xml"),
        T.erase_zeros(F.concat(F.lit("a\0"), name)).alias("no_zeros"),
        F.format_string("%05d", "c_custkey").alias("printed"),
    )


def split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    words = T.split(F.replace("p_name", F.lit(" "), F.lit("..")), ".")
    return p.select("p_partkey", T.join(words, "|").alias("joined"), F.size(words).alias("n"), T.join(T.split_ints(F.concat_ws(",", F.col("p_size").cast("string"), F.lit("x"), F.lit("7")), ","), ";").alias("ints"))


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return c.select("c_custkey", T.template(F.lit("{name}: {segment} {other} {name}"), values).alias("text"))


def ini_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    text = F.concat(F.lit("top = 1\n[Lens]\nname = "), F.col("c_name"), F.lit("\nbad line\nmag=63\n[Stage]\nmag = "), F.col("c_custkey").cast("string"), F.lit("\n"))
    tags = c.select("c_custkey", T.parse_ini(text, "=", "raw/").alias("tags"))
    entries = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return tags.select("c_custkey", F.array_join(F.array_sort(entries), ";").alias("tags"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    ts = F.col("ts")
    mon = F.date_format(ts, "MMM")
    note = F.concat(F.lit("Date: Tue, "), mon, F.lit(" "), F.dayofmonth(ts).cast("string"), F.lit(", "), F.year(ts).cast("string"), F.lit("\rTime: "), F.date_format(ts, "H:m:s"), F.lit(" AM"))
    nano = F.concat(F.lit("\\Date: "), F.date_format(ts, "HH:mm:ss"), F.lit(" AM Tue "), mon, F.lit(" "), F.dayofmonth(ts).cast("string"), F.lit(" "), F.year(ts).cast("string"))
    fluo = F.concat(F.lit("Date="), F.date_format(ts, "MM-dd-yyyy"), F.lit("\nTime="), F.date_format(ts, "HH:mm:ss"))
    return e.select("event_id", T.ibw_date(note).alias("ibw"), T.nanoscope_date(nano).alias("nanoscope"), T.nanoscope_date(F.lit("none")).alias("missing"), T.fluoview_date(fluo).alias("fluoview"), T.month(mon).alias("month"), T.month(F.lit("Foo")).alias("no_month"))


def lens_and_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    lens = T.objective(F.concat(F.lit("Plan "), F.col("p_size").cast("string"), F.lit("x/1.4 Oil")))
    res = T.resolution(F.concat(F.lit("a\nResolution\t"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("\t0.5\n")))
    return p.select("p_partkey", lens["magnification"].alias("magnification"), lens["aperture"].alias("aperture"), res["x"].alias("x"), res["y"].alias("y"))


def tag_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    tags = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"))
    return e.select("event_id", T.tag(tags, "k", "int", 0).alias("k"), T.tag(tags, "kind", "double", -1.0).alias("not_a_number"), T.tag(tags, "pixel_size", "double", 0.0).alias("absent"))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("img_"), (F.col("s_suppkey") % 7).cast("string"), F.lit("_"), (F.col("s_suppkey") * 37 % 101).cast("string"), F.lit(".tif")).alias("name"), "s_nationkey", "s_suppkey")
    w = Window.partitionBy("s_nationkey").orderBy(T.natural_key(F.col("name")), "s_suppkey")
    return n.select("s_nationkey", "s_suppkey", "name", F.row_number().over(w).alias("rank"))


def colour_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = images(spark, sf_dir).select("image_id", F.element_at(F.array(*map(F.lit, ("RGB ", "GRAY", "CMYK", "Lab ", "HLS ", "nCLR", "XYZ ", "YCbr", "HSV ", "CMY "))), F.col("label") + 1).alias("signature"))
    return e.select("image_id", T.colour_mode(F.col("signature")).alias("mode"))


def tiff_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", T.tiff_dialect((F.col("o_orderkey") % 20000 + 33000).cast("int")).alias("dialect"))


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return c.select("c_custkey", N.iround(F.col("c_acctbal") / 2).alias("whole"), N.iround(F.col("c_acctbal"), 1).alias("tenth"))


def unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.lpad(F.hex(F.col("o_orderkey") * 2654435761 % 16777216), 6, "0"))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", data.alias("d"))
    at = lambda c, s: F.array_join(F.transform(c, lambda v: v.cast("string")), s)
    n = lambda k: F.lit(k)
    return o.select("o_orderkey", at(N.unpack1(F.col("d"), n(20)), "").alias("bits"), at(N.unpack4(F.col("d"), n(5)), ",").alias("nibbles"), at(N.unpack12(F.col("d"), n(2)), ",").alias("twelve"), at(N.unpack12_ref(F.col("d"), n(2)), ",").alias("twelve_ref"), F.hex(N.swap(F.col("d"))).alias("swapped"))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    v = (F.col("o_orderkey") * 7919 % 65536 - 32768).cast("int")
    return o.select("o_orderkey", N.i16_to_u16(v).alias("u16"), N.fourcc(F.lit("XVID")).alias("fourcc"), F.round(N.rescale(v, 0.5, -3.0), 6).alias("scaled"), F.round(N.rescale_inverse(N.rescale(v, 0.5, -3.0), 0.5, -3.0), 6).alias("back"), N.time_rescale(F.col("o_orderkey") * 1000003, 1, 90000, 1, 1000).alias("ticks"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = images(spark, sf_dir)
    a, b = F.slice("pixels", 1, 3), F.slice("pixels", 4, 3)
    c = N.cross(a, b)
    return im.select("image_id", F.round(N.dot(a, b), 6).alias("dot"), F.round(N.length(a), 6).alias("length"), F.round(N.length(N.minus(a, b)), 6).alias("distance"), *(F.round(c[i], 6).alias(f"cross_{n}") for i, n in enumerate("xyz")), F.round(N.absolute(a)[0], 6).alias("absolute"))


def mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    lon, lat = F.col("c_custkey") % 360 - 180.0, F.col("c_custkey") % 160 - 80.0
    m = N.mercator(lon, lat)
    back = N.mercator_inverse(m["x"], m["y"])
    return c.select("c_custkey", F.round(m["x"], 3).alias("x"), (F.round(m["y"], 3) + 0.0).alias("y"), F.round(back["lon"], 6).alias("lon"), (F.round(back["lat"], 6) + 0.0).alias("lat"), F.round(N.great_circle(lon, lat, F.lit(0.0), F.lit(0.0)), 2).alias("metres"))


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", N.extent(F.col("l_quantity").cast("int"), F.col("l_linenumber")).alias("width"), N.visible(F.when(F.col("l_linenumber") > 2, F.col("l_tax") * 10), F.col("l_discount") * 10, 0.25, 0.25).alias("visible"))


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    plain = S.cursor(e, "user_id", "event_id", "value")
    loop = S.cursor(e, "user_id", "event_id", "value", loop=True).select("event_id", F.col("next").alias("next_loop"), F.col("previous").alias("previous_loop"))
    return plain.join(loop, "event_id").drop("value")


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("z"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return S.fill_gaps(e, "user_id", "z", "v").select("user_id", "z", F.round("filled", 6).alias("filled"))


def combine_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("series"), F.col("s_suppkey").alias("file"))
    return S.combine(files, 3, "file").select("series", "file", "z", "t", "num_t")


def merge_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a customer; the channels are all customers' balances and the totals of all orders."""
    balance = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.col("c_acctbal").cast("double").alias("v"))
    total = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.round(F.sum("o_totalprice").cast("double"), 2).alias("v"))
    return S.merge_channels([balance, total])


def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return S.palette(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_nationkey").select("c_custkey", "n_name")


def not_yet_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.not_yet(_read(spark, sf_dir, "documents").select("doc_id", "source"), _read(spark, sf_dir, "labels"), "doc_id")


def restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    c = F.col
    return S.restrict(p, [(c("p_size"), ">=", 10), (c("p_size"), "<", 40), (c("p_brand"), "!=", "Brand#11"), (c("p_retailprice"), ">", 950.0)]).select("p_partkey", "p_size")


def metadata_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return S.metadata_query(o, "patient", "series", {"o_orderstatus": "F"}).select("o_orderkey")


def slice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return S.sort_positions(li, "l_orderkey", F.col("l_quantity")).select("l_orderkey", "at", "rank")


def slice_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spacing(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", F.round("spacing", 6).alias("spacing"))


def series_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("files"))
    return o.select("o_custkey", F.size("files").alias("n"), F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


def mask_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    pt = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    x, y, z = d("p_size") % 30, d("p_partkey") % 20, (F.col("p_partkey") % 4).cast("double")
    vertices = F.array(pt(x, y, z), pt(x + 6, y, z), pt(x + 6, y + 5, z), pt(x, y + 5, z))
    shapes = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("gobject_id"), F.lit("polygon").alias("type"), vertices.alias("vertices"))
    return S.render_masks(shapes, 32, 24, 3)


def mask_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stack for each brand: boxes of the parts in every second of five planes, the others blended."""
    d = lambda c: F.col(c).cast("double")
    pt = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    x, y, z = d("p_size") % 30, d("p_partkey") % 20, (F.col("p_partkey") % 3 * 2).cast("double")
    vertices = F.array(pt(x, y, z), pt(x + 6, y, z), pt(x + 6, y + 5, z), pt(x, y + 5, z))
    shapes = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("stack"), F.col("p_partkey").alias("gobject_id"), F.lit("polygon").alias("type"), vertices.alias("vertices"))
    return S.mask_stacks(shapes, 48, 36, 5, "mask-mode,interpolate-empty")


def point_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of a series as one text, in order."""
    s = _read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", T.point_xml(F.col("s_suppkey") % 1000, F.col("s_acctbal"), F.lit(1)).alias("p"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", "p"))), lambda r: r["p"]), "\n")
    return s.groupBy("s_nationkey").agg(text.alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        string_functions, split_join, template, ini_tags, dates, lens_and_resolution, tag_defaults, natural_sort, colour_modes, tiff_dialects, rounding, unpack_bits, offsets, vectors, mercator, geometry,
        cursors, gap_fill, combine_series, merge_channels, palette_lookup, not_yet_converted, restricted, metadata_query, slice_order, slice_spacing, series_groups, mask_render, mask_stacks, point_file,
    )
}

_XML = "'<gobject type=''point'' name=''' || {n} || '''><vertex x=''' || printf('%.6f', {x}::DOUBLE) || ''' y=''' || printf('%.6f', {y}::DOUBLE) || '''/></gobject>'"
_HEX = "lpad(upper(to_hex(o_orderkey * 2654435761 % 16777216)), 6, '0')"

ORACLES = {
    "string_functions": f"""SELECT c_custkey, replace(c_name, '#', '#no. ') AS inserted, c_name AS stripped, split_part(c_name, '#', 1) AS left_part, split_part(c_name, '#', 2) AS right_part, split_part(c_name, '#', 2) AS section,
split_part(c_name, '#', 2)::INT AS as_int, -1 AS as_default, round(('1.' || split_part(c_name, '#', 2))::DOUBLE, 6) AS as_double, c_custkey % 2 = 0 AS as_bool, upper(c_name) AS up, TRUE AS starts, contains(c_name, '#0') AS has,
'a/b/' || c_name || '/' AS path, {_XML.format(n='(c_custkey % 100)', x='c_acctbal', y='2')} AS xml, 'a' || c_name AS no_zeros, printf('%05d', c_custkey) AS printed FROM customer""",
    "split_join": "SELECT p_partkey, replace(p_name, ' ', '|') AS joined, len(string_split(p_name, ' '))::INT AS n, p_size || ';0;7' AS ints FROM part",
    "template": "SELECT c_custkey, c_name || ': ' || c_mktsegment || ' {other} ' || c_name AS text FROM customer",
    "ini_tags": "SELECT c_custkey, 'raw/Lens/mag=63;raw/Lens/name=' || c_name || ';raw/Stage/mag=' || c_custkey || ';raw/top=1' AS tags FROM customer",
    "dates": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ibw, strftime(ts, '%Y-%m-%d %H:%M:%S') AS nanoscope, NULL::VARCHAR AS missing, strftime(ts, '%d-%m-%Y %H:%M:%S') AS fluoview,
month(ts)::INT AS month, 0 AS no_month FROM events""",
    "lens_and_resolution": "SELECT p_partkey, p_size::DOUBLE AS magnification, 1.4::DOUBLE AS aperture, p_retailprice::DECIMAL(12, 2)::DOUBLE AS x, 0.5::DOUBLE AS y FROM part",
    "tag_defaults": "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k, -1.0::DOUBLE AS not_a_number, 0.0::DOUBLE AS absent FROM events",
    "natural_sort": """WITH n AS (SELECT s_nationkey, s_suppkey, s_suppkey % 7 AS a, s_suppkey * 37 % 101 AS b FROM supplier)
SELECT s_nationkey, s_suppkey, 'img_' || a || '_' || b || '.tif' AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY b, a, s_suppkey)::INT AS rank FROM n""",
    "colour_modes": "SELECT vec_id AS image_id, ['RGB', 'GRAYSCALE', 'CMYK', 'LAB', 'HSL', 'MULTI', 'XYZ', 'YCbCr', 'HSV', 'CMY'][label + 1] AS mode FROM embeddings",
    "tiff_dialects": """WITH t AS (SELECT o_orderkey, o_orderkey % 20000 + 33000 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n BETWEEN 33628 AND 33631 THEN 'stk' WHEN n BETWEEN 50432 AND 50437 THEN 'psia' WHEN n = 34665 THEN 'exif' WHEN n IN (34361, 34362, 34386) THEN 'fluoview' WHEN n = 34412 THEN 'lsm'
WHEN n = 51123 THEN 'micro-manager' WHEN n IN (33550, 33920, 33922, 34264, 34735, 34736, 34737) THEN 'geotiff' END AS dialect FROM t""",
    "rounding": "SELECT c_custkey, floor(c_acctbal / 2 + 0.5)::BIGINT AS whole, floor(c_acctbal * 10 + 0.5) / 10 AS tenth FROM customer",
    "unpack_bits": f"""WITH h AS (SELECT o_orderkey, {_HEX} AS x, o_orderkey * 2654435761 % 16777216 AS n FROM orders),
b AS (SELECT *, n // 65536 AS a, n // 256 % 256 AS b, n % 256 AS c FROM h)
SELECT o_orderkey, lpad(bin(n), 24, '0')[1:20] AS bits, a // 16 || ',' || a % 16 || ',' || b // 16 || ',' || b % 16 || ',' || c // 16 AS nibbles, n // 4096 || ',' || n % 4096 AS twelve,
a * 256 + b // 16 || ',' || (b % 16 * 16 + c // 16) * 256 + c % 16 AS twelve_ref, x[5:6] || x[3:4] || x[1:2] AS swapped FROM b""",
    "offsets": """WITH t AS (SELECT o_orderkey, (o_orderkey * 7919 % 65536 - 32768)::INT AS v FROM orders)
SELECT o_orderkey, (v + 32767 + 65536) % 65536 AS u16, 1145656920::BIGINT AS fourcc, round(v * 0.5::DOUBLE - 3, 6) AS scaled, v::DOUBLE AS back, round(o_orderkey * 1000003::DECIMAL(20, 0) * 1000 / 90000, 0)::BIGINT AS ticks FROM t""",
    "vectors": """WITH t AS (SELECT vec_id AS image_id, list_transform(embedding[1:6], lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT image_id, round(e[1] * e[4] + e[2] * e[5] + e[3] * e[6], 6) AS dot, round(sqrt(e[1] ** 2 + e[2] ** 2 + e[3] ** 2), 6) AS length, round(sqrt((e[1] - e[4]) ** 2 + (e[2] - e[5]) ** 2 + (e[3] - e[6]) ** 2), 6) AS distance,
round(e[2] * e[6] - e[3] * e[5], 6) AS cross_x, round(e[3] * e[4] - e[1] * e[6], 6) AS cross_y, round(e[1] * e[5] - e[2] * e[4], 6) AS cross_z, round(abs(e[1]), 6) AS absolute FROM t""",
    "mercator": """WITH t AS (SELECT c_custkey, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 160 - 80)::DOUBLE AS lat, sqrt(2 / 298.257223563::DOUBLE - 1 / 298.257223563::DOUBLE ** 2) AS e FROM customer)
SELECT c_custkey, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * (ln(tan(pi() / 4 + radians(lat) / 2)) + e / 2 * ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))))), 3) + 0.0 AS y, lon, lat,
round(2 * 6371008.8::DOUBLE * asin(least(1, sqrt(sin(radians(lat) / 2) ** 2 + cos(radians(lat)) * sin(radians(lon) / 2) ** 2))), 2) AS metres FROM t""",
    "geometry": """SELECT l_orderkey, l_linenumber, (greatest(l_quantity::INT, l_linenumber) - least(l_quantity::INT, l_linenumber) + 1)::INT AS width,
coalesce(abs(CASE WHEN l_linenumber > 2 THEN l_tax * 10 END - 0.25) < 0.5, TRUE) AND abs(l_discount * 10 - 0.25) < 0.5 AS visible FROM lineitem""",
    "cursors": """SELECT event_id, user_id, lead(value) OVER w AS next, lag(value) OVER w AS previous, first(value) OVER a AS first, last(value) OVER a AS last,
coalesce(lead(value) OVER w, first(value) OVER a) AS next_loop, coalesce(lag(value) OVER w, last(value) OVER a) AS previous_loop FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "gap_fill": """WITH e AS (SELECT user_id, event_id AS z, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
p AS (SELECT *, (SELECT max(z) FROM e b WHERE b.user_id = e.user_id AND b.z <= e.z AND b.v IS NOT NULL) AS lo, (SELECT min(z) FROM e b WHERE b.user_id = e.user_id AND b.z >= e.z AND b.v IS NOT NULL) AS hi, (SELECT max(z) FROM e b WHERE b.user_id = e.user_id) AS top FROM e),
q AS (SELECT p.*, l.v AS lv, coalesce(h.v, 0) AS hv, coalesce(p.hi, p.top) AS hz FROM p LEFT JOIN e l ON l.user_id = p.user_id AND l.z = p.lo LEFT JOIN e h ON h.user_id = p.user_id AND h.z = p.hi)
SELECT user_id, z, round(coalesce(v, lv + (hv - lv) * CASE WHEN hz > lo THEN (z - lo) / (hz - lo)::DOUBLE ELSE 0 END), 6) AS filled FROM q""",
    "combine_series": """WITH n AS (SELECT s_nationkey AS series, s_suppkey AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n, count(*) OVER (PARTITION BY s_nationkey) // 3 AS num_t FROM supplier)
SELECT series, file, (n % 3)::INT AS z, (n // 3)::INT AS t, num_t::INT AS num_t FROM n WHERE n // 3 < num_t""",
    "merge_channels": """WITH o AS (SELECT o_custkey AS page, round(sum(o_totalprice)::DOUBLE, 2) AS v FROM orders GROUP BY ALL)
SELECT page, v, 1 AS c FROM o WHERE page IN (SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, c_acctbal::DOUBLE, 0 FROM customer WHERE c_custkey IN (SELECT page FROM o)""",
    "palette_lookup": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "not_yet_converted": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "restricted": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 40 AND p_brand <> 'Brand#11' AND p_retailprice > 950",
    "metadata_query": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "slice_order": """WITH k AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_quantity))
SELECT l_orderkey, l_quantity AS at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity)::INT AS rank FROM lineitem JOIN k USING (l_orderkey)""",
    "slice_spacing": """WITH g AS (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM lineitem)
SELECT l_orderkey, round(CASE WHEN max(gap) - min(gap) <= 1e-6 THEN avg(gap) ELSE 0 END, 6) AS spacing FROM g GROUP BY ALL""",
    "series_groups": "SELECT o_custkey, count(*)::INT AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS files FROM orders GROUP BY ALL",
    "mask_render": """WITH s AS (SELECT p_partkey AS id, p_size % 30 AS x0, p_partkey % 20 AS y0, p_partkey % 4 AS z FROM part)
SELECT z::INT AS z, y::INT AS y, x::INT AS x, count(*) AS n FROM s, range(32) a(x), range(24) b(y) WHERE z < 3 AND x >= x0 AND x < x0 + 6 AND y >= y0 AND y < y0 + 5 GROUP BY ALL""",
    "mask_stacks": """WITH s AS (SELECT p_brand AS stack, p_size % 30 AS x0, p_partkey % 20 AS y0, p_partkey % 3 * 2 AS z FROM part),
d AS (SELECT DISTINCT stack, z, y, x FROM s, range(48) a(x), range(36) b(y) WHERE x >= x0 AND x < x0 + 6 AND y >= y0 AND y < y0 + 5),
f AS (SELECT DISTINCT stack, z FROM d), g AS (SELECT DISTINCT stack, y, x FROM d),
c AS (SELECT g.stack, t.z, g.y, g.x, CASE WHEN f.z IS NOT NULL THEN CASE WHEN d.z IS NOT NULL THEN 255 ELSE 0 END END AS v FROM g CROSS JOIN range(5) t(z)
  LEFT JOIN f ON f.stack = g.stack AND f.z = t.z LEFT JOIN d ON d.stack = g.stack AND d.z = t.z AND d.y = g.y AND d.x = g.x),
n AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN z END) OVER b AS lz, min(CASE WHEN v IS NOT NULL THEN z END) OVER a AS hz FROM c
  WINDOW b AS (PARTITION BY stack, y, x ORDER BY z ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY stack, y, x ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT n.stack, n.z, n.y, n.x, coalesce(n.v, l.v + (coalesce(h.v, 0) - l.v) * CASE WHEN coalesce(hz, 4) > lz THEN (n.z - lz) / (coalesce(hz, 4) - lz)::DOUBLE ELSE 0 END, 0) AS v
  FROM n LEFT JOIN c l ON l.stack = n.stack AND l.y = n.y AND l.x = n.x AND l.z = n.lz LEFT JOIN c h ON h.stack = n.stack AND h.y = n.y AND h.x = n.x AND h.z = n.hz)
SELECT stack, z::INT AS z, y::INT AS y, x::INT AS x, floor(v + 0.5)::INT AS v FROM o WHERE floor(v + 0.5) > 0""",
    "point_file": f"SELECT s_nationkey, string_agg({_XML.format(n='(s_suppkey % 1000)', x='s_acctbal', y='1')}, chr(10) ORDER BY s_suppkey) AS text FROM supplier GROUP BY ALL",
}
#: The same query under the name that it had beside a sample of it.
QUERIES["merge_channels_all"], ORACLES["merge_channels_all"] = merge_channels, ORACLES["merge_channels"]
