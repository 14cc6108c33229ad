"""Series of images: cursors, gaps, combining, metadata filters and series order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cursor(frames: DataFrame, key: str, order: str, value: str, loop: bool = False) -> DataFrame:
    """frames with next, previous, first and last value along each series; a loop goes on at the other end."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    after, before = F.lead(value).over(w), F.lag(value).over(w)
    if loop:
        after, before = F.coalesce(after, first), F.coalesce(before, last)
    return frames.withColumns({"next": after, "previous": before, "first": first, "last": last})


def fill_gaps(slices: DataFrame, key: str, z: str, value: str) -> DataFrame:
    """Empty slices (null) between filled ones become their linear blend; a run at the end is blended towards an empty
    (zero) last slice; a run at the start stays empty."""
    w = Window.partitionBy(key).orderBy(z)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    z_if = F.when(F.col(value).isNotNull(), F.col(z))
    whole = Window.partitionBy(key)
    low_v, low_z = F.last(value, True).over(back), F.last(z_if, True).over(back)
    high_v, high_z = F.coalesce(F.first(value, True).over(ahead), F.lit(0.0)), F.coalesce(F.first(z_if, True).over(ahead), F.max(z).over(whole))
    part = F.when(high_z > low_z, (F.col(z) - low_z) / (high_z - low_z)).otherwise(0.0)
    blend = low_v + (high_v - low_v) * part
    return slices.withColumn("filled", F.coalesce(F.col(value), blend))


def combine(files: DataFrame, nz: int, *order: str) -> DataFrame:
    """files numbered in order as z and t of a series of nz slices; files beyond the last whole time point are left out."""
    n = F.row_number().over(Window.partitionBy("series").orderBy(*order)) - 1
    times = F.floor(F.count("*").over(Window.partitionBy("series")) / nz)
    out = files.withColumn("n", n).withColumn("num_t", times.cast("int"))
    return out.withColumn("z", F.col("n") % nz).withColumn("t", F.floor(F.col("n") / nz).cast("int")).where("t < num_t").drop("n")


def merge_channels(channels: list[DataFrame], page: str = "page") -> DataFrame:
    """Pages that all channels have, with the channel's number."""
    pages = reduce(lambda a, b: a.join(b, page, "left_semi"), (c.select(page) for c in channels))
    numbered = [c.join(pages, page, "left_semi").withColumn("c", F.lit(i)) for i, c in enumerate(channels)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def palette(pixels: DataFrame, table: DataFrame, value: str, key: str) -> DataFrame:
    """Indexed colours looked up in a table; Spark broadcasts it if it is small."""
    return pixels.join(table, F.col(value) == F.col(key), "left")


def not_yet(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return files.join(done.select(key).distinct(), key, "left_anti")


#: Restrictions on tags, by name of the comparison.
COMPARISONS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def restrict(files: DataFrame, restrictions: list[tuple[Column, str, object]]) -> DataFrame:
    for column, op, value in restrictions:
        files = files.where(COMPARISONS[op](column, F.lit(value)))
    return files


#: Levels that may be asked for under each root of a metadata query.
LEVELS = {"patient": ("patient", "study", "series", "image"), "study": ("study", "series", "image")}


def metadata_query(files: DataFrame, root: str, level: str, keys: dict[str, object]) -> DataFrame | None:
    """Rows of a level by keys; None for a combination of root and level that isn't valid; unknown keys are an error."""
    if level not in LEVELS.get(root, ()):
        return None
    unknown = set(keys) - set(files.columns)
    if unknown:
        raise ValueError(f"no such keys: {sorted(unknown)}")
    return restrict(files, [(F.col(k), "=", v) for k, v in keys.items()])


def sort_positions(slices: DataFrame, key: str, position: Column, drop_duplicates: bool = False) -> DataFrame:
    """slices ranked along the normal; with duplicate positions a series is left out, or its duplicates are dropped."""
    at = slices.withColumn("at", position)
    counts = at.groupBy(key).agg((F.count("at") > F.count_distinct("at")).alias("doubled"))
    kept = at.dropDuplicates([key, "at"]) if drop_duplicates else at.join(counts.where("not doubled").select(key), key)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at")))


def spacing(slices: DataFrame, key: str, position: str, tolerance: float = 1e-6) -> DataFrame:
    """The distance between neighbours, 0 where it isn't the same throughout."""
    gaps = slices.withColumn("gap", F.col(position) - F.lag(position).over(Window.partitionBy(key).orderBy(position)))
    even = F.max("gap") - F.min("gap") <= tolerance
    return gaps.groupBy(key).agg(F.when(even, F.avg("gap")).otherwise(0.0).alias("spacing"))


def point_in_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Even-odd rule over an array of (x, y)."""
    n = F.size(corners)
    crossed = F.filter(
        F.transform(corners, lambda a, i: F.struct(a.alias("a"), F.get(corners, (i + 1) % n).alias("b"))),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def _pixels(shapes: DataFrame, w: int, h: int, depth: int, keep: list[str]) -> DataFrame:
    """(keep, z, y, x) of the pixels of every row of shapes, each once a row."""
    v = F.col("vertices")
    first_z = F.get(v, F.lit(0))["z"]
    zs = F.filter(F.sequence(F.lit(0), F.lit(depth - 1)), lambda z: F.coalesce(F.abs(first_z - z) < 0.5, F.lit(True)))
    drawn = shapes.select(*keep, "type", "vertices", F.explode(zs).alias("z"))
    low = lambda f, top: F.greatest(F.lit(0), F.floor(F.array_min(F.transform(v, lambda p: p[f]))).cast("int"))
    high = lambda f, top: F.least(F.lit(top - 1), F.ceil(F.array_max(F.transform(v, lambda p: p[f]))).cast("int"))
    grid = lambda f, top: F.when(low(f, top) <= high(f, top), F.sequence(low(f, top), high(f, top)))
    polygon = drawn.where("type = 'polygon'").withColumn("y", F.explode(grid("y", h))).withColumn("x", F.explode(grid("x", w)))
    polygon = polygon.where(point_in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, v)).select(*keep, "z", "y", "x")
    spot = lambda y, x: F.struct(F.floor(y).alias("y"), F.floor(x).alias("x"))
    inside = lambda spots: F.transform(F.filter(spots, lambda p: p["y"].between(0, h - 1) & p["x"].between(0, w - 1)), lambda p: p["y"] * w + p["x"])

    def walk(i: Column) -> Column:
        a, b = F.get(v, i - 1), F.get(v, i)
        steps = F.greatest(F.lit(1), F.ceil(2 * F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]))).cast("int"))
        return inside(F.transform(F.sequence(F.lit(0), steps), lambda k: spot(a["y"] + (b["y"] - a["y"]) * (k / steps), a["x"] + (b["x"] - a["x"]) * (k / steps))))

    lines = F.when((F.col("type") == "polyline") & (F.size(v) > 1), F.flatten(F.transform(F.sequence(F.lit(1), F.size(v) - 1), walk)))
    places = F.when(F.col("type") == "point", inside(F.transform(v, lambda p: spot(p["y"], p["x"])))).otherwise(lines)
    others = drawn.where("type in ('point', 'polyline')").select(*keep, "z", F.explode(F.array_distinct(places)).alias("k"))
    others = others.select(*keep, "z", F.floor(F.col("k") / w).cast("int").alias("y"), (F.col("k") % w).cast("int").alias("x"))
    return polygon.unionByName(others)


def render_masks(shapes: DataFrame, w: int, h: int, depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """shapes (gobject_id, type, vertices of x, y, z, t) as mask pixels (z, y, x, n: shapes that cover it), apart by keys.

    Points cover their pixel, polylines the pixels along them in half-pixel steps, polygons the pixel centres inside. Only a
    shape's bounding box is looked at; a shape is drawn in the slices where its first vertex is visible. Rows of one
    gobject_id are one shape. Shapes of a single row are drawn once for all that look the same and counted as many times;
    only pixels of the others are told apart by id.
    """
    own = [*keys, "gobject_id"]
    several = shapes.groupBy(*own).agg(F.count("*").alias("rows")).where("rows > 1").select(*(F.col(c).alias(f"_{c}") for c in own))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own))
    alike = shapes.join(several, same, "left_anti").groupBy(*keys, "type", "vertices").agg(F.count("*").alias("n"))
    joined = _pixels(shapes.join(several, same, "left_semi"), w, h, depth, own).distinct()
    covered = _pixels(alike, w, h, depth, [*keys, "n"]).unionByName(joined.select(*keys, "z", "y", "x", F.lit(1).cast("long").alias("n")))
    return covered.groupBy(*keys, "z", "y", "x").agg(F.sum("n").alias("n"))


def mask_stacks(shapes: DataFrame, w: int, h: int, depth: int, options: str = "", key: str = "stack") -> DataFrame:
    """(key, z, y, x, v) of the mask pixels above 0 of each stack's shapes (key, gobject_id, type, vertices).

    options is searched for two words. With mask-mode a covered pixel is 255, else the number of shapes on it, at most 255. With
    interpolate-empty, planes of one value throughout are empty, and take the linear blend of the filled planes beside them; a run
    at the end is blended towards nothing, and one at the start stays. A stack without any covered pixel has no rows.
    """
    drawn = render_masks(shapes, w, h, depth, (key,))
    value = F.lit(255) if "mask-mode" in options else F.least(F.col("n"), F.lit(255))
    drawn = drawn.select(key, "z", "y", "x", value.cast("double").alias("v"))
    if "interpolate-empty" in options:
        planes = drawn.groupBy(key, "z").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        filled = planes.where((F.col("n") < w * h) | (F.col("low") < F.col("high"))).select(key, "z", F.lit(True).alias("filled"))
        spots = drawn.select(key, "y", "x").distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
        known = spots.join(filled, [key, "z"], "left").join(drawn, [key, "z", "y", "x"], "left")
        known = known.withColumn("own", F.coalesce("v", F.lit(0.0))).withColumn("v", F.when(F.col("filled"), F.col("own"))).drop("filled")
        blended = fill_gaps(known.withColumn("spot", F.struct(key, "y", "x")), "spot", "z", "v")
        drawn = blended.select(key, "z", "y", "x", F.coalesce("filled", "own").alias("v"))
    return drawn.select(key, "z", "y", "x", F.floor(F.col("v") + 0.5).cast("int").alias("v")).where("v > 0")


def mask_planes(masks: DataFrame, w: int, h: int, depth: int, key: str = "stack") -> DataFrame:
    """(image_id, page, channel, width, height, pixels): all planes of the stacks of mask pixels, such as readers.tiff_files writes."""
    at = F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("k"), F.col("v").cast("double").alias("v"))))
    held = masks.groupBy(key, "z").agg(at.alias("at"))
    every = masks.select(key).distinct().withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).join(held, [key, "z"], "left")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda k: F.coalesce(F.try_element_at("at", k), F.lit(0.0)))
    return every.select(F.col(key).alias("image_id"), F.col("z").alias("page"), F.lit(0).alias("channel"), F.lit(w).alias("width"), F.lit(h).alias("height"), pixels.alias("pixels"))


def apply_steps(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """(function, arguments) pairs from left to right."""
    for function, *args in steps:
        df = df.transform(function, *args)
    return df


def steps_left(steps: list[tuple], name: str) -> list[tuple]:
    names = [s[0] for s in steps]
    return steps[: names.index(name)] if name in names else []


def steps_right(steps: list[tuple], name: str) -> list[tuple]:
    names = [s[0] for s in steps]
    return steps[names.index(name) + 1 :] if name in names else []


def order_slices(slices: DataFrame, key: str, tags: str = "tags", name: str = "path") -> DataFrame:
    """slices of each series with distance and slice, their number along the normal of the first two directions that their tags give
    (position (0020,0032), orientation (0020,0037)). Equal distances go by name; slices without a position come last, by name."""
    numbers = lambda tag: F.transform(F.split(F.col(tags)[tag], r"\\"), lambda x: F.trim(x).try_cast("double"))
    p, o = numbers("(0020,0032)"), numbers("(0020,0037)")
    at = lambda v, k: F.get(v, F.lit(k))
    cross = lambda i, j: at(o, i) * at(o, 3 + j) - at(o, j) * at(o, 3 + i)
    distance = at(p, 0) * cross(1, 2) + at(p, 1) * cross(2, 0) + at(p, 2) * cross(0, 1)
    w = Window.partitionBy(key).orderBy(F.col("distance").asc_nulls_last(), name)
    return slices.withColumn("distance", F.round(distance, 6)).withColumn("slice", F.row_number().over(w) - 1)
