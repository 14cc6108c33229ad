"""Queries of tiles, features and transforms over embeddings as 8x8 images, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import planes as PL
from ..operators import raster as R
from ..operators import registration as RG
from ..operators import tiles as TI
from ..operators import transforms as TR
from ..operators import wavelets as WV
from .raster_queries import ORACLES as RO
from .raster_queries import PX, H, P, W, images

TILE = 4


def _long(spark, sf_dir):
    return R.long_form(images(spark, sf_dir), W)


def tile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TI.cut_planes(images(spark, sf_dir), W, H, TILE)
    return t.select("image_id", "level", "ty", "tx", F.round(R.total(P()), 6).alias("total"), F.size(P()).cast("long").alias("n"))


def edge_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 3 x 3 of images of 8 x 8: those at the right and lower edge are smaller."""
    t = TI.cut_planes(images(spark, sf_dir), W, H, 3)
    return t.select("image_id", "ty", "tx", F.round(R.total(P()), 6).alias("total"), F.size(P()).cast("long").alias("n"))


def read_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TI.read_tile(TI.cut_planes(images(spark, sf_dir), W, H, TILE), 1, 0, 0)
    return t.select("image_id", F.posexplode("pixels").alias("k", "v")).select("image_id", "k", F.round("v", 6).alias("v"))


def read_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = images(spark, sf_dir)
    r = lambda n, x1, y1, x2, y2, level=0: F.struct(*(F.lit(v).alias(c) for c, v in zip(("region_id", "level", "x1", "y1", "x2", "y2"), (n, level, x1, y1, x2, y2), strict=True)))
    regions = im.select("image_id", F.explode(F.array(r(0, 2, 3, 4, 6), r(1, 4, 0, 7, 3), r(2, 6, 6, 20, 20), r(3, 0, 0, 1, 1, 5))).alias("r")).select("image_id", "r.*")
    out = TI.read_region(TI.cut_planes(im, W, H, TILE), regions, TILE, W, H)
    return out.select("region_id", "image_id", "y", "x", F.round("v", 6).alias("v"))


def resolve_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = images(spark, sf_dir).select("image_id", F.when(F.col("label") < 5, "1.0,0.5,0.25").otherwise("1.0, 0.501,x,0.0625").alias("scales"))
    return tags.select("image_id", *(TI.level_of(F.col("scales"), k).alias(f"level_{k}") for k in (0, 1, 2, 3, 4)))


def closest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(w).alias("width"), F.lit(h).alias("height")) for i, (w, h) in enumerate(TI.level_sizes(640, 480, 20))))
    levels = images(spark, sf_dir).select("image_id", F.explode(sizes).alias("l")).select("image_id", "l.*")
    above = TI.closest_level_above(levels, 100, 100).withColumnRenamed("level", "above")
    return above.join(TI.closest_level_below(levels, 100, 100).withColumnRenamed("level", "below"), "image_id")


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("page"))
    return e.select("page", TI.page_to_ctz(F.col("page") % 24, "XYCZT", 2, 4, 3).alias("p")).select("page", "p.*")


def _neighbours(spark, sf_dir):
    """Distances of every image's points (its rows of pixels) to those of the image with the next id: W x H of a pair."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(H - 1)), lambda y: F.slice(P(), y * W + 1, F.lit(W)))
    f = images(spark, sf_dir).select(F.col("image_id").alias("pair_id"), F.posexplode(rows).alias("idx", "f"))
    return FE.distances(f, f.withColumn("pair_id", F.col("pair_id") - 1), ["pair_id"])


def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.mutual_nearest(_neighbours(spark, sf_dir), ["pair_id"], 10).select("pair_id", "l", "r", "d", "rank")


def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.matches(_neighbours(spark, sf_dir), ["pair_id"], 10)


def l1_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir)


def _points(spark, sf_dir):
    """Tie points: each image's pixel positions, mapped with its label and a value as noise."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    px = R.long_form(images(spark, sf_dir), W).join(images(spark, sf_dir).select("image_id", "label"), "image_id")
    return px.select(F.col("image_id").alias("pair_id"), (F.col("y") * W + F.col("x")).alias("idx"), x.alias("x1"), y.alias("y1"), (2 * x - 0.5 * y + F.col("label")).alias("x2"), (0.25 * x + 3 * y - 1 + F.col("v")).alias("y2"))


def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    a, b = p.select("pair_id", "idx", F.col("x1").alias("x"), F.col("y1").alias("y")), p.select("pair_id", "idx", F.col("x2").alias("x"), F.col("y2").alias("y"))
    out = FE.positional_match(a, b, ["pair_id", "idx"])
    return out.groupBy("pair_id").agg(F.count("*").alias("matches"), F.sum("x1").alias("sum_x1"))


def grid_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.grid_maxima(_long(spark, sf_dir), W, H, 4).withColumn("v", F.round("v", 6))


def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _long(spark, sf_dir)
    u, v = FE.affine_point(F.col("x").cast("double"), F.col("y").cast("double"), (0.5, 0.25, 1.25, -0.25, 0.75, 0.5))
    at = px.select("image_id", (F.col("y") * W + F.col("x")).alias("pid"), u.alias("px"), v.alias("py"))
    return FE.bilinear(px, at, W, H).select("image_id", "pid", F.round("v", 6).alias("v"))


def normal_equations_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = FE.normal_equations(_points(spark, sf_dir), "affine")
    return n.select("pair_id", "n_points", *(F.round(c, 4).alias(c) for c in ("a0_0", "a0_1", "a0_2", "a3_4", "b0", "b1", "b2", "b3", "b4", "b5")))


def _fit(kind):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = FE.fit(_points(spark, sf_dir), kind)
        return out.select("pair_id", "n_points", F.posexplode("params").alias("k", "p")).select("pair_id", "n_points", "k", F.round("p", 4).alias("p"))

    return run


def fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _long(spark, sf_dir)
    g = px.select("image_id", "y", "x", F.col("v").alias("g"))
    gg = px.select("image_id", "y", (F.col("x") - 1).alias("x"), F.col("v").alias("gg"))
    pairs = g.join(gg, ["image_id", "y", "x"], "left").select(F.col("image_id").alias("pair_id"), "g", "gg", F.lit(0.01).alias("d"), F.lit(0.02).alias("dd"))
    return FE.fit_score(pairs).select("pair_id", F.round("fit", 4).alias("fit"), F.round("overlap", 6).alias("overlap"))


def oriented_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = images(spark, sf_dir)
    points = FE.grid_maxima(R.long_form(im, W), W, H, 4).select("image_id", (F.col("cy") * 8 + F.col("cx")).alias("idx"), "y", "x")
    f = FE.patches(im, points, W, H, 2)
    return f.select("image_id", "idx", F.size("f").alias("n"), F.round(R.norm(F.slice("f", 1, 25)), 4).alias("norm"), F.round(R.norm(F.slice("f", 26, 2)), 4).alias("turn"))


def chebyshev_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of every row of the images."""
    rows = images(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(H - 1))).alias("y"), "pixels")
    c = rows.select("image_id", "y", F.posexplode(TR.chebyshev_1d(F.slice(P(), F.col("y") * W + 1, F.lit(W)), 5, W)).alias("j", "c"))
    return c.select("image_id", "y", "j", (F.round("c", 6) + 0.0).alias("c"))


def chebyshev_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.chebyshev_2d(_long(spark, sf_dir), 4, W, H).select("image_id", "jx", "jy", F.round("c", 6).alias("c"))


def radon(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = TR.radon(_long(spark, sf_dir), [0.0, 30.0, 45.0, 90.0], W, H, 4, 4, -12, 27)
    return out.select("image_id", "angle", "r", F.round("v", 6).alias("v"))


def radon_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures' order for every twelve values, the last twelve overlapping those before."""
    blocks = images(spark, sf_dir).select("image_id", F.explode(F.array(*map(F.lit, (0, 12, 24, 36, 48, 52)))).alias("first"), "pixels")
    out = blocks.select("image_id", "first", F.posexplode(TR.radon_texture(F.slice(P(), F.col("first") + 1, F.lit(12)))).alias("k", "v"))
    return out.select("image_id", "first", "k", F.round("v", 6).alias("v"))


def _dwt(bank, mode, high=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        band = TR.dwt(P(), 64, bank, mode)[high]
        return images(spark, sf_dir).select("image_id", F.posexplode(band).alias("k", "v")).select("image_id", "k", F.round("v", 6).alias("v"))

    return run


def dwt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = images(spark, sf_dir).select("image_id", "pixels", *(c.alias(n) for c, n in zip(TR.dwt(P(), 64, "sym5"), ("low", "high"), strict=True)))
    back = TR.synthesise(F.col("low"), F.col("high"), TR.dwt_length(64, 10), "sym5")
    return coded.select("image_id", F.posexplode(back).alias("k", "v")).select("image_id", "k", (F.round("v", 5) + 0.0).alias("v"))


def dwt_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = TR.dwt_2d(P(), W, H, "bior3.1", "periodic")
    return images(spark, sf_dir).select("image_id", *(F.round(R.norm(c), 5).alias(n.lower()) for n, c in bands.items()))


def fft_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coefficient; rounded zeros have one sign."""
    out = TR.fft_2d(images(spark, sf_dir), W, H)
    return out.select("image_id", "ky", "kx", *((F.round(c, 5) + 0.0).alias(c) for c in ("re", "im")))


def _sized(spark, sf_dir, w, h, first=1):
    """w x h values of each image, from the first on, as an image of that size."""
    return images(spark, sf_dir).select("image_id", F.lit(w).alias("width"), F.lit(h).alias("height"), F.slice("pixels", first, w * h).alias("pixels"))


def halve_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 7 x 9 of all values but the last, and of 9 x 7 of all but the first."""
    both = _sized(spark, sf_dir, 7, 9).withColumn("first", F.lit(1)).unionByName(_sized(spark, sf_dir, 9, 7, 2).withColumn("first", F.lit(2)))
    out = PL.mapped(both, PL.halve)
    return out.select("image_id", "first", F.posexplode("pixels").alias("k", "v")).select("image_id", "first", "k", F.round("v", 6).alias("v"))


def _planewise(function):
    """A query that gives a function of whole planes of each image as one row a pixel."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = PL.mapped(_sized(spark, sf_dir, W, H), function)
        out = out.select("image_id", F.posexplode("pixels").alias("k", "v"))
        return out.select("image_id", F.floor(F.col("k") / W).cast("int").alias("y"), (F.col("k") % W).alias("x"), F.round("v", 6).alias("v"))

    return run


def registered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from every image to the one with the next id."""
    im = images(spark, sf_dir)
    left, right = im.select(F.col("image_id").alias("pair_id"), "pixels"), im.select((F.col("image_id") - 1).alias("pair_id"), "pixels")
    out = RG.register(left, right, W, H, 16, 1)
    return out.select("pair_id", "kind", "n_points", F.posexplode("params").alias("k", "p"), "fit").select("pair_id", "kind", "n_points", "k", F.round("p", 4).alias("p"), F.round("fit", 4).alias("fit"))


def rst_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, turn and shift of each pair's fit."""
    out = FE.fit(_points(spark, sf_dir), "rst").select("pair_id", FE.rst_of(F.col("params")).alias("t"))
    return out.select("pair_id", *(F.round(f"t.{c}", 4).alias(c) for c in ("r", "c", "s", "dx", "dy")))


def wavelet_denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 16 x 4 without their small wavelet coefficients."""
    out = WV.denoised(_sized(spark, sf_dir, 16, 4), "bior3.1", 0.1, 1)
    return out.select("image_id", F.posexplode("pixels").alias("k", "v")).select("image_id", "k", (F.round("v", 6) + 0.0).alias("v"))


def fast_chebyshev(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = images(spark, sf_dir)
    back = TR.fast_chebyshev_2d(TR.fast_chebyshev_2d(im, W, H), W, H, inverse=True)
    return back.select("image_id", F.posexplode("pixels").alias("k", "v")).select("image_id", "k", (F.round("v", 5) + 0.0).alias("v"))


QUERIES = {
    "tile_table": tile_table, "edge_tiles": edge_tiles, "read_tile": read_tile, "read_region": read_region, "resolve_level": resolve_level, "closest_levels": closest_levels, "page_order": page_order,
    "l1_distances": l1_distances, "mutual_nearest": mutual_nearest, "l1_distances_all": l1_distances, "mutual_nearest_all": mutual_nearest, "match_features": match_features, "positional_match": positional_match, "grid_maxima": grid_maxima, "bilinear_sample": bilinear_sample,
    "normal_equations_affine": normal_equations_affine, "fit_affine": _fit("affine"), "fit_projective": _fit("projective"), "fit_rst": _fit("rst"), "fit_st": _fit("st"), "fit_score": fit_score,
    "oriented_patches": oriented_patches, "chebyshev_1d": chebyshev_1d, "chebyshev_2d": chebyshev_2d, "radon": radon, "radon_texture": radon_texture,
    "dwt_low_zeropad": _dwt("sym5", "zeropad"), "dwt_high_zeropad": _dwt("sym5", "zeropad", True), "dwt_low_symmetric": _dwt("bior3.1", "symmetric"), "dwt_high_periodic": _dwt("bior5.5", "periodic", True),
    "dwt_low_constant_edge": _dwt("sym5", "constant edge"), "dwt_round_trip": dwt_round_trip, "dwt_2d": dwt_2d, "fft_2d": fft_2d, "fft_2d_all": fft_2d, "halve_odd": halve_odd, "wavelet_denoised": wavelet_denoised, "fast_chebyshev": fast_chebyshev,
    "plane_smooth": _planewise(PL.smooth), "plane_gradient_x": _planewise(lambda g: PL.gradient(g, "x")), "plane_gradient_y": _planewise(lambda g: PL.gradient(g, "y")), "plane_corner_response": _planewise(PL.structure),
    "registered_pairs": registered_pairs, "rst_parameters": rst_parameters,
}


def _sql_dwt(taps, index: str, inside: str = "TRUE") -> str:
    f = ", ".join(f"({k}, {float(t)!r}::DOUBLE)" for k, t in enumerate(taps))
    n = TR.dwt_length(64, len(taps))
    return f"""WITH f(k, c) AS (VALUES {f}), o AS (SELECT vec_id, embedding, oo AS o, k, c, 2 * oo + 1 - k AS i FROM embeddings, range({n}) t(oo), f)
SELECT vec_id AS image_id, o::INT AS k, round(sum(CASE WHEN {inside} THEN c * embedding[({index})::INT + 1]::DOUBLE ELSE 0 END), 6) AS v FROM o GROUP BY ALL"""


_BASIS = "CASE WHEN j = 0 THEN 1 ELSE cos(j * acos(2.0::DOUBLE * ({a} + 1) / 8 - 1)) END * CASE WHEN j = 0 THEN 1 ELSE 2 END / 8.0::DOUBLE / 2"
_TIES = f"""{PX}, p AS (SELECT image_id AS pair_id, y * 8 + x AS idx, x::DOUBLE AS x1, y::DOUBLE AS y1, 2 * x - 0.5::DOUBLE * y + label AS x2, 0.25::DOUBLE * x + 3 * y - 1 + v AS y2 FROM px)"""


_NEXT = """d AS (SELECT a.vec_id AS pair_id, l::INT AS l, r::INT AS r, round(list_sum(list_transform(range(1, 9), lambda i: abs(a.embedding[l * 8 + i]::DOUBLE - b.embedding[r * 8 + i]::DOUBLE))), 6) AS d
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(8) t(l), range(8) u(r))"""

#: Means of the tie points and sums of products about them.
_CENTRED = """m AS (SELECT pair_id, avg(x1) AS mx, avg(y1) AS my, avg(x2) AS mu, avg(y2) AS mv, count(*) AS n_points FROM p GROUP BY pair_id),
c AS (SELECT pair_id, n_points, mx, my, mu, mv, sum((x1 - mx) * (x1 - mx)) AS xx, sum((x1 - mx) * (y1 - my)) AS xy, sum((y1 - my) * (y1 - my)) AS yy, sum((x1 - mx) * (x2 - mu)) AS xu,
  sum((y1 - my) * (x2 - mu)) AS yu, sum((x1 - mx) * (y2 - mv)) AS xv, sum((y1 - my) * (y2 - mv)) AS yv FROM p JOIN m USING (pair_id) GROUP BY ALL)"""


ORACLES = {
    "tile_table": f"WITH {PX} SELECT image_id, 0 AS level, y // 4 AS ty, x // 4 AS tx, round(sum(v), 6) AS total, count(*) AS n FROM px GROUP BY ALL",
    "read_tile": f"WITH {PX} SELECT image_id, (y * 4 + x - 4)::INT AS k, round(v, 6) AS v FROM px WHERE x >= 4 AND y < 4",
    "read_region": f"""WITH {PX}, r(region_id, x1, y1, x2, y2) AS (VALUES (0, 2, 3, 4, 6), (1, 4, 0, 7, 3), (2, 6, 6, 20, 20))
SELECT region_id, image_id, (y - y1)::INT AS y, (x - x1)::INT AS x, round(v, 6) AS v FROM px, r WHERE x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2""",
    "resolve_level": "SELECT vec_id AS image_id, 0 AS level_0, 1 AS level_1, CASE WHEN label < 5 THEN 2 ELSE -1 END AS level_2, -1 AS level_3, CASE WHEN label < 5 THEN -1 ELSE 3 END AS level_4 FROM embeddings",
    "closest_levels": """WITH l(level, w, h) AS (VALUES (0, 640, 480), (1, 320, 240), (2, 160, 120), (3, 80, 60), (4, 40, 30), (5, 20, 15)),
a AS (SELECT coalesce(max(level) FILTER (level > 0 AND (w >= 100 OR h >= 100)), 0) AS above, coalesce(max(level) FILTER (level < 5 AND (w > 100 OR h > 100)), -1) + 1 AS below FROM l)
SELECT vec_id AS image_id, above, below FROM embeddings, a""",
    "page_order": "SELECT event_id AS page, event_id % 24 % 2 AS c, event_id % 24 // 6 % 4 AS t, event_id % 24 // 2 % 3 AS z FROM events",
    "l1_distances": f"WITH {_NEXT} SELECT pair_id, l, r, d FROM d",
    "mutual_nearest": f"""WITH {_NEXT}, n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, l ORDER BY d, r) AS a, row_number() OVER (PARTITION BY pair_id, r ORDER BY d, l) AS b FROM d)
SELECT pair_id, l, r, d, row_number() OVER (PARTITION BY pair_id ORDER BY d, l)::INT AS rank FROM n WHERE a = 1 AND b = 1""",
    "positional_match": f"WITH {_TIES} SELECT pair_id, count(*) AS matches, sum(x1) AS sum_x1 FROM p WHERE abs(x1 - x2) + abs(y1 - y2) < 5 GROUP BY ALL",
    "grid_maxima": f"""WITH {PX}, c AS (SELECT *, y // 2 AS cy, x // 2 AS cx, row_number() OVER (PARTITION BY image_id, y // 2, x // 2 ORDER BY v DESC, y, x) AS n FROM px)
SELECT image_id, cy, cx, y, x, round(v, 6) AS v FROM c WHERE n = 1 AND cx BETWEEN 1 AND 2 AND cy BETWEEN 1 AND 2""",
    "bilinear_sample": f"""WITH {PX}, q AS (SELECT image_id, y * 8 + x AS pid, 0.5::DOUBLE * x + 0.25::DOUBLE * y + 1.25::DOUBLE AS u, -0.25::DOUBLE * x + 0.75::DOUBLE * y + 0.5::DOUBLE AS w FROM px)
SELECT q.image_id, pid, round(sum(v * (1 - abs(u - px.x)) * (1 - abs(w - px.y))), 6) AS v FROM q JOIN px ON q.image_id = px.image_id AND px.x - floor(u) IN (0, 1) AND px.y - floor(w) IN (0, 1)
WHERE floor(u) BETWEEN 0 AND 6 AND floor(w) BETWEEN 0 AND 6 GROUP BY ALL""",
    "normal_equations_affine": f"""WITH {_TIES} SELECT pair_id, count(*) AS n_points, round(sum(x1 * x1), 4) AS a0_0, round(sum(x1 * y1), 4) AS a0_1, round(sum(x1), 4) AS a0_2, round(sum(x1 * y1), 4) AS a3_4,
round(sum(x1 * x2), 4) AS b0, round(sum(y1 * x2), 4) AS b1, round(sum(x2), 4) AS b2, round(sum(x1 * y2), 4) AS b3, round(sum(y1 * y2), 4) AS b4, round(sum(y2), 4) AS b5 FROM p GROUP BY ALL""",
    "fit_score": f"""WITH {PX}, q AS (SELECT a.image_id AS pair_id, a.v AS g, b.v AS gg FROM px a LEFT JOIN px b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x - 1),
s AS (SELECT pair_id, avg(g) FILTER (gg IS NOT NULL) AS m, stddev_samp(g) FILTER (gg IS NOT NULL) AS s, avg(gg) AS mm, stddev_samp(gg) AS ss FROM q GROUP BY ALL)
SELECT pair_id, round(2 * avg(abs((g - m) / s - (gg - mm) / ss) / 0.03::DOUBLE), 4) AS fit, round(count(gg) / count(*), 6) AS overlap FROM q JOIN s USING (pair_id) GROUP BY ALL""",
    "chebyshev_1d": f"""WITH {PX} SELECT image_id, y, j::INT AS j, round(sum(v * {_BASIS.format(a='x')}), 6) + 0 AS c FROM px, range(5) t(j) GROUP BY ALL""",
    "chebyshev_2d": f"""WITH {PX}, r AS (SELECT image_id, y, j AS jx, sum(v * {_BASIS.format(a='x')}) AS v FROM px, range(4) t(j) GROUP BY ALL)
SELECT image_id, jx::INT AS jx, j::INT AS jy, round(sum(v * {_BASIS.format(a='y')}), 6) AS c FROM r, range(4) t(j) GROUP BY ALL""",
    "radon": f"""WITH {PX}, a(angle) AS (VALUES (0.0::DOUBLE), (30.0::DOUBLE), (45.0::DOUBLE), (90.0::DOUBLE)),
q AS (SELECT image_id, angle, v * 0.25::DOUBLE AS m, (-4.25::DOUBLE + 0.5::DOUBLE * (2 * x + sx)) * cos(radians(angle)) + 12 + (-4.25::DOUBLE + 0.5::DOUBLE * (15 - (2 * y + sy))) * sin(radians(angle)) AS pos FROM px, a, range(2) t(sx), range(2) u(sy) WHERE v <> 0),
b AS (SELECT image_id, angle, trunc(pos)::INT AS r, m * (1 - pos + trunc(pos)) AS v FROM q UNION ALL SELECT image_id, angle, trunc(pos)::INT + 1, m - m * (1 - pos + trunc(pos)) FROM q)
SELECT image_id, angle, r, round(sum(v), 6) AS v FROM b WHERE r BETWEEN 0 AND 26 GROUP BY ALL""",
    "radon_texture": """SELECT vec_id AS image_id, first, (k - 1)::INT AS k, round(embedding[first + [1, 2, 3, 10, 11, 12, 4, 5, 6, 7, 8, 9][k]]::DOUBLE, 6) AS v
FROM embeddings, range(1, 13) t(k), (VALUES (0), (12), (24), (36), (48), (52)) f(first)""",
    "dwt_low_zeropad": _sql_dwt(TR.BANKS["sym5"][0], "greatest(0, least(63, i))", "i BETWEEN 0 AND 63"),
    "dwt_high_zeropad": _sql_dwt(TR.BANKS["sym5"][1], "greatest(0, least(63, i))", "i BETWEEN 0 AND 63"),
    "dwt_low_symmetric": _sql_dwt(TR.BANKS["bior3.1"][0], "CASE WHEN i < 0 THEN -1 - i WHEN i > 63 THEN 127 - i ELSE i END"),
    "dwt_high_periodic": _sql_dwt(TR.BANKS["bior5.5"][1], "(i + 64) % 64"),
    "dwt_low_constant_edge": _sql_dwt(TR.BANKS["sym5"][0], "greatest(0, least(63, i))"),
    "dwt_round_trip": "SELECT vec_id AS image_id, (k - 1)::INT AS k, round(embedding[k]::DOUBLE, 5) + 0.0 AS v FROM embeddings, range(1, 65) t(k)",
    "fft_2d": f"""WITH {PX}, f AS (SELECT i::INT AS ky, j::INT AS kx FROM range(8) a(i), range(8) b(j))
SELECT image_id, ky, kx, round(sum(v * cos(-2 * pi() * ((ky * y + kx * x) % 8) / 8)), 5) + 0 AS re, round(sum(v * sin(-2 * pi() * ((ky * y + kx * x) % 8) / 8)), 5) + 0 AS im FROM px, f GROUP BY ALL""",
    "edge_tiles": f"WITH {PX} SELECT image_id, y // 3 AS ty, x // 3 AS tx, round(sum(v), 6) AS total, count(*) AS n FROM px GROUP BY ALL",
    "halve_odd": """WITH p AS (SELECT vec_id AS image_id, first, w, ((i - 1) // w)::INT AS y, ((i - 1) % w)::INT AS x, embedding[i + first - 1]::DOUBLE AS v
  FROM embeddings, range(1, 64) t(i), (VALUES (1, 7), (2, 9)) f(first, w))
SELECT image_id, first, (y // 2 * ((w + 1) // 2) + x // 2)::INT AS k, round(avg(v), 6) AS v FROM p GROUP BY image_id, first, w, y // 2, x // 2""",
    "plane_smooth": RO["smooth"], "plane_gradient_x": RO["gradient_x"], "plane_gradient_y": RO["gradient_y"], "plane_corner_response": RO["corner_response"],
    "fit_affine": f"""WITH {_TIES}, {_CENTRED}, s AS (SELECT *, xx * yy - xy * xy AS det FROM c),
r AS (SELECT pair_id, n_points, (xu * yy - yu * xy) / det AS a, (yu * xx - xu * xy) / det AS b, (xv * yy - yv * xy) / det AS d, (yv * xx - xv * xy) / det AS e, mx, my, mu, mv FROM s)
SELECT pair_id, n_points, k::INT AS k, round([a, b, mu - a * mx - b * my, d, e, mv - d * mx - e * my][k + 1], 4) AS p FROM r, range(6) t(k)""",
    "fit_rst": f"""WITH {_TIES}, {_CENTRED}, r AS (SELECT *, (xu + yv) / (xx + yy) AS a, (yu - xv) / (xx + yy) AS b FROM c)
SELECT pair_id, n_points, k::INT AS k, round([a, b, mu - a * mx - b * my, mv + b * mx - a * my][k + 1], 4) AS p FROM r, range(4) t(k)""",
    "rst_parameters": f"""WITH {_TIES}, {_CENTRED}, r AS (SELECT *, (xu + yv) / (xx + yy) AS a, (yu - xv) / (xx + yy) AS b FROM c)
SELECT pair_id, round(sqrt(a * a + b * b), 4) AS r, round(a / sqrt(a * a + b * b), 4) AS c, round(b / sqrt(a * a + b * b), 4) AS s, round(mu - a * mx - b * my, 4) AS dx, round(mv + b * mx - a * my, 4) AS dy FROM r""",
    "fit_st": f"""WITH {_TIES}, {_CENTRED}, r AS (SELECT *, (xu + yv) / (xx + yy) AS a FROM c)
SELECT pair_id, n_points, k::INT AS k, round([a, mu - a * mx, mv - a * my][k + 1], 4) AS p FROM r, range(3) t(k)""",
    "match_features": f"""WITH {_NEXT}, n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, l ORDER BY d, r) AS a, row_number() OVER (PARTITION BY pair_id, r ORDER BY d, l) AS b FROM d),
s AS (SELECT pair_id, l, r, d, b = 1 AS mutual, sum((b = 1)::INT) OVER (PARTITION BY pair_id) < 4 AS relaxed FROM n WHERE a = 1)
SELECT pair_id, l, r, d, row_number() OVER (PARTITION BY pair_id ORDER BY d, l)::INT AS rank, relaxed FROM s WHERE mutual OR relaxed""",
    "dwt_2d": f"""WITH {PX}, f(k, l, h) AS (VALUES {", ".join(f"({k}, {float(a)!r}::DOUBLE, {float(b)!r}::DOUBLE)" for k, (a, b) in enumerate(zip(*TR.BANKS["bior3.1"][:2], strict=True)))}),
g AS (SELECT o, l, h, (2 * o + 9 - k) % 8 AS i FROM range({TR.dwt_length(8, 4)}) t(o), f),
r AS (SELECT image_id, y, o, sum(l * v) AS l, sum(h * v) AS h FROM px JOIN g ON px.x = g.i GROUP BY ALL),
c AS (SELECT image_id, r.o AS x, g.o AS y, sum(g.l * r.l) AS ll, sum(g.h * r.l) AS lh, sum(g.l * r.h) AS hl, sum(g.h * r.h) AS hh FROM r JOIN g ON r.y = g.i GROUP BY ALL)
SELECT image_id, {", ".join(f"round(sqrt(sum({b} * {b})), 5) AS {b}" for b in ("ll", "lh", "hl", "hh"))} FROM c GROUP BY image_id""",
    "fast_chebyshev": "SELECT vec_id AS image_id, (k - 1)::INT AS k, round(embedding[k]::DOUBLE, 5) + 0.0 AS v FROM embeddings, range(1, 65) t(k)",
}
#: The same queries under the names that they had beside samples of them.
ORACLES |= {f"{k}_all": ORACLES[k] for k in ("l1_distances", "mutual_nearest", "fft_2d")}
