"""Queries of the raster operators over embeddings as 8x8 images, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as R

W = H = 8


def P():  # noqa: N802
    """The pixels of an image; made when a query runs, as columns need a session."""
    return F.col("pixels")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("image_id"), "label", F.col("embedding").cast("array<double>").alias("pixels"))


def _pixels(column, w: int = W, whole: bool = False):
    """A query that gives an array expression of each image as one row a pixel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = images(spark, sf_dir).select("image_id", F.posexplode(column()).alias("k", "v"))
        return out.select("image_id", F.floor(F.col("k") / w).cast("int").alias("y"), (F.col("k") % w).alias("x"), (F.col("v").cast("long") if whole else F.round("v", 6)).alias("v"))

    return run


def _scalars(columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return images(spark, sf_dir).select("image_id", *(c.alias(n) for n, c in columns().items()))

    return run


#: Pixels of all images, one row each.
PX = """px AS (SELECT vec_id AS image_id, label, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS v
  FROM embeddings, range(1, 65) t(i))"""
#: The same by position in the list, which needs no join of pixels.
AT = """spots AS (SELECT vec_id AS image_id, embedding AS e, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x,
    CASE WHEN (i - 1) % 8 = 0 THEN 1 ELSE (i - 1) % 8 - 1 END AS hx, CASE WHEN (i - 1) // 8 = 0 THEN 1 ELSE (i - 1) // 8 - 1 END AS hy FROM embeddings, range(1, 65) t(i))"""


def _v(y: str, x: str) -> str:
    """The value at a place in the list of spots; hx and hy are the column and row beside x and y inside the image."""
    return f"e[(({y}) * 8 + ({x}) + 1)::INT]::DOUBLE"


SMOOTH = f"""{AT}, sm AS (SELECT image_id, y, x,
    CASE WHEN x IN (0, 7) AND y IN (0, 7) THEN ({_v("y", "x")} + {_v("y", "hx")} + {_v("hy", "x")} + {_v("hy", "hx")}) / 4
      WHEN x IN (0, 7) THEN ({_v("y", "x")} + {_v("y - 1", "x")} + {_v("y + 1", "x")} + {_v("y", "hx")}) / 4
      WHEN y IN (0, 7) THEN ({_v("y", "x")} + {_v("y", "x - 1")} + {_v("y", "x + 1")} + {_v("hy", "x")}) / 4
      ELSE ({_v("y - 1", "x")} + {_v("y + 1", "x")} + {_v("y", "x - 1")} + {_v("y", "x + 1")} + 4 * {_v("y", "x")}) / 8 END AS v FROM spots)"""
STATS = "st AS (SELECT image_id, avg(v) AS m, stddev_samp(v) AS s, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id)"


def pyramid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = images(spark, sf_dir).select("image_id", R.halve(R.smooth(P(), W, H), W, H).alias("pixels"))
    return half.select("image_id", F.round(F.array_min(P()), 6).alias("least"), F.round(F.array_max(P()), 6).alias("most"), F.round(R.mean(P()), 6).alias("mean"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("v"))
    return R.histogram(items, "channel")


def histogram_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(spark, sf_dir).groupBy("channel").agg(F.min("v").alias("first_bin"), F.max("v").alias("last_bin"), F.count("*").alias("n_unique"))


def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = R.pyramid(images(spark, sf_dir), W, H, least=1)
    return levels.select("image_id", "level", "width", "height", F.round(R.mean(P()), 6).alias("mean"))


def channel_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image's rows as channels; channel 9 is clamped to the last."""
    out = images(spark, sf_dir).select("image_id", R.crop(P(), W, H, 0, min(9, H - 1), W, 1).alias("pixels"))
    return out.select("image_id", F.round(R.total(P()), 6).alias("total"))


def memory_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = images(spark, sf_dir).select("label", R.memory(F.col("label") + 5, F.lit(H), F.lit(3), F.lit(12)).alias("bytes"))
    return sizes.groupBy("label").agg(F.sum("bytes").alias("bytes"))


def colour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = R.long_form(images(spark, sf_dir).withColumn("pixels", R.to_u8(P())), W)
    return px.groupBy("image_id").agg(F.count_distinct("v").alias("colours"))


def rgba_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three rows of the image that follow each other as channels of 8 pixels, blended by weights."""
    rows = images(spark, sf_dir).select("image_id", "pixels", F.explode(F.sequence(F.lit(0), F.lit(H - 3))).alias("y"))
    planes = [F.slice(P(), 8 * (F.col("y") + c) + 1, F.lit(8)) for c in range(3)]
    fused = R.fuse(planes, [(1.0, 0.0, 0.5), (0.0, 1.0, 0.5), (0.25, 0.25, 0.0)])
    out = rows.select("image_id", "y", F.posexplode(fused).alias("k", "c"))
    return out.select("image_id", "y", "k", *(F.round(f"c.{n}", 6).alias(n) for n in "rgb"))


def rgba_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour that each pixel is shown in, with every row as the first channel of one, two and three."""
    rows = images(spark, sf_dir).select("image_id", "pixels", F.explode(F.sequence(F.lit(0), F.lit(H - 3))).alias("y"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("channels"))
    planes = [F.slice(P(), 8 * (F.col("y") + c) + 1, F.lit(8)) for c in range(3)]
    shown = F.when(F.col("channels") == 1, R.rgba(planes[:1], F.col("x"))).when(F.col("channels") == 2, R.rgba(planes[:2], F.col("x"))).otherwise(R.rgba(planes, F.col("x")))
    out = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(W - 1)))).withColumn("c", shown)
    return out.select("image_id", "channels", "y", "x", *(F.round(f"c.{n}", 6).alias(n) for n in "rgb"), "c.a")


def paste_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = R.crop(P(), W, H, 0, 0, 3, 2)
    return _pixels(lambda: R.paste(P(), W, H, tile, 4, 5, 3, 2))(spark, sf_dir)


def normal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine normal equations from pixel positions and values: sums only."""
    px = R.long_form(images(spark, sf_dir), W)
    t = {"xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y"), "x1": F.col("x"), "y1": F.col("y"), "n": F.lit(1)}
    return px.groupBy("image_id").agg(*(F.sum(c).alias(n) for n, c in t.items()), *(F.round(F.sum(F.col(a) * F.col("v")), 6).alias(f"{a}v") for a in "xy"))


QUERIES = {
    "pyramid_summary": pyramid_summary,
    "rotate_right": _pixels(lambda: R.rotate_right(P(), W, H)),
    "rotate_left": _pixels(lambda: R.rotate_left(P(), W, H)),
    "flip_vertical": _pixels(lambda: R.flip(P(), W, H)),
    "mirror_horizontal": _pixels(lambda: R.mirror(P(), W, H)),
    "roi_crop": _pixels(lambda: R.crop(P(), W, H, 3, 5, 8, 8), 5),
    "roi_paste": paste_tile,
    "interleave": _pixels(lambda: R.interleave(F.slice(P(), 1, 32), F.slice(P(), 33, 32))),
    "deinterleave": _pixels(lambda: R.deinterleave(P(), 1, 4)),
    "resize_pad": _pixels(lambda: R.resize_pad(P(), W, H, 10, 9), 10),
    "hard_threshold": _pixels(lambda: R.threshold(P(), 0.1)),
    "guarded_read": _scalars(lambda: dict(inside=F.round(R.read_at(P(), W, H, F.lit(7), F.lit(0)), 6), outside=R.read_at(P(), W, H, F.lit(8), F.lit(0)))),
    "smooth": _pixels(lambda: R.smooth(P(), W, H)),
    "gradient_x": _pixels(lambda: R.gradient(P(), W, H, "x")),
    "gradient_y": _pixels(lambda: R.gradient(P(), W, H, "y")),
    "corner_response": _pixels(lambda: R.structure(P(), W, H)),
    "laplacian_weight": _pixels(lambda: R.laplacian_weight(P(), W, H)),
    "pyramid_levels": pyramid_levels,
    "array_statistics": _scalars(lambda: dict(mean=F.round(R.mean(P()), 6), part_mean=F.round(R.mean(P(), 3, 10), 6), std=F.round(R.std(P()), 6), norm=F.round(R.norm(P()), 6), least=F.array_min(P()), most=F.array_max(P()))),
    "std_of_one": _scalars(lambda: dict(std=R.std(F.slice(P(), 1, 1)))),
    "standardise": _pixels(lambda: R.standardise(P())),
    "argsort": _pixels(lambda: R.argsort(P()), whole=True),
    "histogram": histogram,
    "histogram_ends": histogram_ends,
    "to_u8": _pixels(lambda: R.to_u8(P()), whole=True),
    "u16_to_u8_lut": _pixels(lambda: R.to_u8_lut(F.transform(P(), lambda v: F.floor(F.abs(v) * 65535))), whole=True),
    "to_depth": _pixels(lambda: R.to_depth(P(), 12), whole=True),
    "channel_extract": channel_extract,
    "memory_footprint": memory_footprint,
    "colour_count": colour_count,
    "rgba_fusion": rgba_fusion,
    "rgba_pixels": rgba_pixels,
    "normal_matrix": normal_matrix,
}


def _moved(x: str, y: str, where: str = "") -> str:
    return f"WITH {PX} SELECT image_id, ({y})::INT AS y, ({x})::INT AS x, round(v, 6) AS v FROM px {where}"


_U8 = "least(greatest(trunc((v - lo) / CASE WHEN hi = lo THEN 256.0 ELSE (hi - lo) / 256 END)::INT, 0), 255)"

ORACLES = {
    "pyramid_summary": f"""WITH {PX}, {SMOOTH}, half AS (SELECT image_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM sm GROUP BY ALL)
SELECT image_id, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM half GROUP BY image_id""",
    "rotate_right": _moved("7 - y", "x"),
    "rotate_left": _moved("y", "7 - x"),
    "flip_vertical": _moved("x", "7 - y"),
    "mirror_horizontal": _moved("7 - x", "y"),
    "roi_crop": _moved("x - 3", "y - 5", "WHERE x >= 3 AND y >= 5"),
    "roi_paste": f"WITH {AT} SELECT image_id, y, x, round(CASE WHEN x BETWEEN 4 AND 6 AND y BETWEEN 5 AND 6 THEN {_v('y - 5', 'x - 4')} ELSE {_v('y', 'x')} END, 6) AS v FROM spots",
    "interleave": _moved("((y * 8 + x) % 32 * 2 + (y * 8 + x) // 32) % 8", "((y * 8 + x) % 32 * 2 + (y * 8 + x) // 32) // 8"),
    "deinterleave": _moved("(y * 8 + x) // 4 % 8", "(y * 8 + x) // 4 // 8", "WHERE (y * 8 + x) % 4 = 1"),
    "resize_pad": f"""WITH {PX}, g AS (SELECT image_id, yy::INT AS y, xx::INT AS x FROM (SELECT DISTINCT image_id FROM px), range(9) a(yy), range(10) b(xx))
SELECT g.image_id, g.y, g.x, round(coalesce(px.v, 0), 6) AS v FROM g LEFT JOIN px ON g.image_id = px.image_id AND g.y = px.y AND g.x = px.x""",
    "hard_threshold": f"WITH {PX} SELECT image_id, y, x, round(CASE WHEN abs(v) < 0.1 THEN 0 ELSE v END, 6) AS v FROM px",
    "guarded_read": "SELECT vec_id AS image_id, round(embedding[8]::DOUBLE, 6) AS inside, NULL::DOUBLE AS outside FROM embeddings",
    "smooth": f"WITH {PX}, {SMOOTH} SELECT image_id, y, x, round(v, 6) AS v FROM sm",
    "gradient_x": f"WITH {AT} SELECT image_id, y, x, round(CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN 0 ELSE ({_v('y', 'x + 1')} - {_v('y', 'x - 1')}) / 2 END, 6) AS v FROM spots",
    "gradient_y": f"WITH {AT} SELECT image_id, y, x, round(CASE WHEN x IN (0, 7) OR y IN (0, 7) THEN 0 ELSE ({_v('y + 1', 'x')} - {_v('y - 1', 'x')}) / 2 END, 6) AS v FROM spots",
    "corner_response": f"""WITH {PX}, {SMOOTH},
g AS (SELECT a.image_id, a.y, a.x, CASE WHEN a.x IN (0, 7) OR a.y IN (0, 7) THEN 0 ELSE (d.v - u.v) / 2 END AS gx, CASE WHEN a.x IN (0, 7) OR a.y IN (0, 7) THEN 0 ELSE (r.v - l.v) / 2 END AS gy FROM sm a
  LEFT JOIN sm l ON l.image_id = a.image_id AND l.y = a.y AND l.x = a.x - 1 LEFT JOIN sm r ON r.image_id = a.image_id AND r.y = a.y AND r.x = a.x + 1
  LEFT JOIN sm u ON u.image_id = a.image_id AND u.x = a.x AND u.y = a.y - 1 LEFT JOIN sm d ON d.image_id = a.image_id AND d.x = a.x AND d.y = a.y + 1),
t AS (SELECT a.image_id, a.y, a.x, coalesce(sum(greatest(0, a.gx * b.gx + a.gy * b.gy) * b.gx * b.gx), 0) AS xx,
    coalesce(sum(greatest(0, a.gx * b.gx + a.gy * b.gy) * b.gx * b.gy), 0) AS xy, coalesce(sum(greatest(0, a.gx * b.gx + a.gy * b.gy) * b.gy * b.gy), 0) AS yy
  FROM g a LEFT JOIN g b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY ALL)
SELECT image_id, y, x, round(abs(xx * yy - xy * xy) / (2.2204e-16 + sqrt(xx * xx + yy * yy + 2 * xy * xy)) / sqrt(2.2204e-16 + xx + yy), 6) AS v FROM t""",
    "laplacian_weight": f"WITH {PX}, {SMOOTH}, {STATS} SELECT px.image_id, px.y, px.x, round(abs((px.v - m) / s - sm.v) + 0.01, 6) AS v FROM px JOIN st USING (image_id) JOIN sm ON px.image_id = sm.image_id AND px.y = sm.y AND px.x = sm.x",
    "pyramid_levels": f"""WITH {PX}, l AS (SELECT image_id, level::INT AS level, y // (1 << level)::INT AS y, x // (1 << level)::INT AS x, avg(v) AS v FROM px, range(4) t(level) GROUP BY ALL)
SELECT image_id, level, (8 >> level)::INT AS width, (8 >> level)::INT AS height, round(avg(v), 6) AS mean FROM l GROUP BY ALL""",
    "array_statistics": f"""WITH {PX} SELECT image_id, round(avg(v), 6) AS mean, round(avg(v) FILTER (y * 8 + x BETWEEN 2 AND 9), 6) AS part_mean,
round(stddev_samp(v), 6) AS std, round(sqrt(sum(v * v)), 6) AS norm, min(v) AS least, max(v) AS most FROM px GROUP BY image_id""",
    "std_of_one": "SELECT vec_id AS image_id, 0.0::DOUBLE AS std FROM embeddings",
    "standardise": f"WITH {PX}, {STATS} SELECT image_id, y, x, round((v - m) / (s + 2.2204e-16), 6) AS v FROM px JOIN st USING (image_id)",
    "argsort": f"""WITH {PX}, r AS (SELECT image_id, y * 8 + x + 1 AS k, row_number() OVER (PARTITION BY image_id ORDER BY v, y, x) - 1 AS n FROM px)
SELECT image_id, (n // 8)::INT AS y, (n % 8)::INT AS x, k::BIGINT AS v FROM r""",
    "histogram": "SELECT l_returnflag AS channel, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL",
    "histogram_ends": "SELECT l_returnflag AS channel, min(l_quantity) AS first_bin, max(l_quantity) AS last_bin, count(DISTINCT l_quantity) AS n_unique FROM lineitem GROUP BY ALL",
    "to_u8": f"WITH {PX}, {STATS} SELECT image_id, y, x, {_U8}::BIGINT AS v FROM px JOIN st USING (image_id)",
    "u16_to_u8_lut": f"""WITH {PX}, q AS (SELECT image_id, y, x, floor(abs(v) * 65535) AS v FROM px), s AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM q GROUP BY ALL)
SELECT image_id, y, x, least(greatest(trunc((v - lo) / greatest(1, trunc((hi - lo) / 256)))::INT, 0), 255)::BIGINT AS v FROM q JOIN s USING (image_id)""",
    "to_depth": f"WITH {PX}, {STATS} SELECT image_id, y, x, CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / (hi - lo) * 4095 + 0.5) END::BIGINT AS v FROM px JOIN st USING (image_id)",
    "channel_extract": f"WITH {PX} SELECT image_id, round(sum(v), 6) AS total FROM px WHERE y = least(9, 7) GROUP BY ALL",
    "memory_footprint": "SELECT label, sum(ceil((label + 5) * 12 / 8.0) * 24)::BIGINT AS bytes FROM embeddings GROUP BY ALL",
    "colour_count": f"WITH {PX}, {STATS} SELECT image_id, count(DISTINCT {_U8}) AS colours FROM px JOIN st USING (image_id) GROUP BY ALL",
    "rgba_fusion": f"""WITH {AT} SELECT image_id, y, x AS k, round({_v("y", "x")} + 0.25 * {_v("y + 2", "x")}, 6) AS r, round({_v("y + 1", "x")} + 0.25 * {_v("y + 2", "x")}, 6) AS g,
round(0.5 * {_v("y", "x")} + 0.5 * {_v("y + 1", "x")}, 6) AS b FROM spots WHERE y < 6""",
    "rgba_pixels": f"""WITH {AT} SELECT image_id, channels::INT AS channels, y, x, round({_v("y", "x")}, 6) AS r, round(CASE WHEN channels = 1 THEN {_v("y", "x")} ELSE {_v("y + 1", "x")} END, 6) AS g,
round(CASE channels WHEN 1 THEN {_v("y", "x")} WHEN 2 THEN 0 ELSE {_v("y + 2", "x")} END, 6) AS b, 255 AS a FROM spots, range(1, 4) t(channels) WHERE y < 6""",
    "normal_matrix": f"""WITH {PX} SELECT image_id, sum(x * x)::BIGINT AS xx, sum(x * y)::BIGINT AS xy, sum(y * y)::BIGINT AS yy, sum(x)::BIGINT AS x1, sum(y)::BIGINT AS y1, count(*)::BIGINT AS n,
round(sum(x * v), 6) AS xv, round(sum(y * v), 6) AS yv FROM px GROUP BY ALL""",
}
