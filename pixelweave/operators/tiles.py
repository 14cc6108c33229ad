"""Tiles, levels and region reads over a table of tiles: (image_id, level, ty, tx, pixels).

A region is read by the tiles that cover it: the cover's tile numbers are exploded and joined by equality, so a range
predicate becomes a hash join and, on a table partitioned by level, ty and tx, prunes files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_of(scales: Column, level) -> Column:
    """Index of the scale 2^-level in a comma list (within 0.01), -1 if there is none."""
    near = F.transform(F.split(scales, ","), lambda x: F.coalesce(F.abs(F.btrim(x).try_cast("double") - F.pow(F.lit(2.0), -F.lit(level))) < 0.01, F.lit(False)))
    return F.coalesce(F.array_position(near, True), F.lit(0)).cast("int") - 1


def tile_bounds(xid: int, yid: int, tile: int) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2 of a tile, inclusive."""
    return xid * tile, yid * tile, xid * tile + tile - 1, yid * tile + tile - 1


def cut_tiles(pixels: DataFrame, tile: int, level: int = 0) -> DataFrame:
    """Long-form pixels (image_id, y, x, v) as tiles of rows (image_id, level, ty, tx, pixels by row)."""
    keyed = pixels.withColumn("ty", F.floor(F.col("y") / tile).cast("int")).withColumn("tx", F.floor(F.col("x") / tile).cast("int"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"])
    return keyed.groupBy("image_id", "ty", "tx").agg(values.alias("pixels")).withColumn("level", F.lit(level))


def cut_planes(images: DataFrame, width: int, height: int, tile: int, level: int = 0) -> DataFrame:
    """Images (image_id, pixels by row) as tiles (image_id, level, ty, tx, pixels by row), those at the right and lower edge as
    large as what is left: slices of the row's own array, so nothing is shuffled."""
    ys, xs = (F.sequence(F.lit(0), F.lit((n - 1) // tile)) for n in (height, width))
    at = images.select("image_id", "pixels", F.explode(ys).alias("ty")).select("*", F.explode(xs).alias("tx"))
    wide, high = F.least(F.lit(tile), F.lit(width) - F.col("tx") * tile), F.least(F.lit(tile), F.lit(height) - F.col("ty") * tile)
    rows = F.transform(F.sequence(F.lit(0), high - 1), lambda y: F.slice("pixels", (F.col("ty") * tile + y) * width + F.col("tx") * tile + 1, wide))
    return at.select("image_id", F.lit(level).alias("level"), "ty", "tx", F.flatten(rows).alias("pixels"))


def read_tile(tiles: DataFrame, xid: int, yid: int, level: int) -> DataFrame:
    return tiles.where((F.col("level") == level) & (F.col("tx") == xid) & (F.col("ty") == yid))


def read_region(tiles: DataFrame, regions: DataFrame, tile: int, width: int, height: int) -> DataFrame:
    """regions (region_id, image_id, level, x1, y1, x2, y2, inclusive) as pixels (region_id, image_id, y, x, v) from the
    region's corner; cut to the level's bounds, empty for a level that isn't there. Tiles at the right and lower edge are as
    large as what is left of width and height."""
    bounded = regions.withColumn("x2", F.least("x2", F.lit(width - 1))).withColumn("y2", F.least("y2", F.lit(height - 1)))
    bounded = bounded.withColumn("x1", F.greatest("x1", F.lit(0))).withColumn("y1", F.greatest("y1", F.lit(0))).where("x1 <= x2 and y1 <= y2")
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int")))
    wanted = bounded.withColumn("tx", cover("x1", "x2")).withColumn("ty", cover("y1", "y2"))
    found = wanted.join(tiles, ["image_id", "level", "tx", "ty"]).select("*", F.posexplode("pixels").alias("k", "v"))
    wide = F.least(F.lit(tile), F.lit(width) - F.col("tx") * tile)
    y, x = F.col("ty") * tile + F.floor(F.col("k") / wide).cast("int"), F.col("tx") * tile + F.col("k") % wide
    inside = found.withColumn("gy", y).withColumn("gx", x).where("gx between x1 and x2 and gy between y1 and y2")
    return inside.select("region_id", "image_id", (F.col("gy") - F.col("y1")).alias("y"), (F.col("gx") - F.col("x1")).alias("x"), "v")


def level_sizes(width: int, height: int, least: int = 1) -> list[tuple[int, int]]:
    out = [(width, height)]
    while max(out[-1]) > least:
        out.append((math.ceil(out[-1][0] / 2), math.ceil(out[-1][1] / 2)))
    return out


def closest_level_above(levels: DataFrame, w: int, h: int) -> DataFrame:
    """By image: the largest level but 0 that is still as wide or as high as asked, else 0. levels: image_id, level, width, height."""
    fits = (F.col("level") > 0) & ((F.col("width") >= w) | (F.col("height") >= h))
    return levels.groupBy("image_id").agg(F.coalesce(F.max(F.when(fits, F.col("level"))), F.lit(0)).alias("level"))


def closest_level_below(levels: DataFrame, w: int, h: int) -> DataFrame:
    """By image: one more than the last level but the smallest that is wider or higher than asked, else 0."""
    last = levels.groupBy("image_id").agg(F.max("level").alias("last"))
    fits = (F.col("level") < F.col("last")) & ((F.col("width") > w) | (F.col("height") > h))
    return levels.join(last, "image_id").groupBy("image_id").agg((F.coalesce(F.max(F.when(fits, F.col("level"))), F.lit(-1)) + 1).alias("level"))


def page_to_ctz(page: Column, order: str, c: int, t: int, z: int) -> Column:
    """Channel, time and depth of a page under a dimension order such as XYCZT."""
    sizes, rest, out = {"C": c, "T": t, "Z": z}, page, {}
    for axis in order[2:]:
        out[axis] = (rest % sizes[axis]).alias(axis.lower())
        rest = F.floor(rest / sizes[axis]).cast("long")
    return F.struct(out["C"], out["T"], out["Z"])
