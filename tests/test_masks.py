"""Mask stacks against a version that draws and blends plane by plane, their files, and small helpers of series and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import features, series
from pixelweave.sources import readers, tiff
from pixelweave.streaming import frames

W, H, D = 9, 7, 8


def boxes():
    """(stack, id, x0, y0, x1, y1, z): filled planes 1, 2 and 5 of stack 1; all of stack 2's plane 0 and half of its plane 3; none of 3."""
    return [(1, 1, 0, 0, 4, 3, 1), (1, 2, 2, 2, 6, 6, 1), (1, 3, 3, 1, 5, 4, 2), (1, 4, 0, 3, 9, 5, 5), (2, 5, 0, 0, 9, 7, 0), (2, 6, 0, 0, 5, 7, 3), (3, 7, 20, 20, 25, 25, 2)]


def slow(options):
    out = {}
    for stack in (1, 2, 3):
        v = np.zeros((D, H, W))
        for s, _, x0, y0, x1, y1, z in boxes():
            if s == stack:
                v[z, max(0, y0) : y1, max(0, x0) : x1] += 1
        if "mask-mode" in options:
            v[v > 0] = 255
        if "interpolate-empty" in options:
            full = [z for z in range(D) if len(np.unique(v[z])) > 1]
            for z in range(D):
                below, above = [k for k in full if k <= z], [k for k in full if k >= z]
                if z not in full and below:
                    a, b = below[-1], above[0] if above else D - 1
                    end = v[b] if above else np.zeros((H, W))
                    v[z] = np.where(b > a, v[a] + (end - v[a]) * (z - a) / max(1, b - a), v[a])
        for z, y, x in zip(*np.nonzero(np.floor(v + 0.5)), strict=True):
            out[stack, z, y, x] = int(np.floor(v[z, y, x] + 0.5))
    return out


@pytest.mark.parametrize("options", ["", "mask-mode", "interpolate-empty", "mask-mode;interpolate-empty"])
def test_mask_stacks(spark, options):
    rows = [(s, i, "polygon", [(float(x0), float(y0), float(z)), (float(x1), float(y0), float(z)), (float(x1), float(y1), float(z)), (float(x0), float(y1), float(z))]) for s, i, x0, y0, x1, y1, z in boxes()]
    shapes = spark.createDataFrame(rows, "stack long, gobject_id int, type string, vertices array<struct<x:double,y:double,z:double>>")
    masks = series.mask_stacks(shapes, W, H, D, options)
    want = slow(options)
    assert {(r.stack, r.z, r.y, r.x): r.v for r in masks.collect()} == want
    if options == "mask-mode;interpolate-empty":
        files = {r.image_id: bytes(r.content) for r in readers.tiff_files(series.mask_planes(masks, W, H, D)).collect()}
        assert sorted(files) == [1, 2]
        for p in tiff.read_tiff(files[1]):
            plane = p.pixels.reshape(H, W)
            assert all(plane[y, x] == want.get((1, p.page, y, x), 0) for y in range(H) for x in range(W))
        assert len(list(tiff.directories(files[2]))) == D
        assert series.mask_stacks(shapes.limit(0), W, H, D, options).count() == 0


def shuffled_rows(spark) -> int:
    """Rows that all stages of the session have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = spark._jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_masks_of_shapes_that_look_alike(spark):
    """Shapes that look alike are drawn once and counted all, so what moves are shapes and not their pixels; rows of one id, null too, are one shape."""
    box = lambda x0, y0, x1, y1: [(x0, y0, 1.0), (x1, y0, 1.0), (x1, y1, 1.0), (x0, y1, 1.0)]
    rows = [(i, "polygon", box(0.0, 0.0, 6.0, 5.0)) for i in range(3000)]
    rows += [(3000, "polygon", box(1.0, 1.0, 3.0, 3.0)), (3000, "polygon", box(2.0, 2.0, 4.0, 4.0)), (None, "polygon", box(7.0, 5.0, 8.0, 6.0)), (None, "polygon", box(7.0, 5.0, 9.0, 6.0))]
    rows += [(3001 + i, "point", [(8.5, 0.2, 1.0), (8.9, 0.9, 1.0), (-1.0, 0.0, 1.0), (None, 1.0, 1.0)]) for i in range(5)] + [(4000, "polyline", [(0.0, 6.0, 1.0), (4.0, 6.0, 1.0), (2.0, 6.0, 1.0)]), (4001, "polyline", [(1.0, 6.0, 1.0)])]
    shapes = spark.createDataFrame(rows, "gobject_id int, type string, vertices array<struct<x:double,y:double,z:double>>")
    before = shuffled_rows(spark)
    got = {(r.z, r.y, r.x): r.n for r in series.render_masks(shapes, W, H, D).collect()}
    want = {(1, y, x): 3000 + ((1 <= y < 3 and 1 <= x < 3) or (2 <= y < 4 and 2 <= x < 4)) for y in range(5) for x in range(6)}
    want |= {(1, 5, 7): 1, (1, 5, 8): 1, (1, 0, 8): 5} | {(1, 6, x): 1 for x in range(5)}
    assert got == want
    assert shuffled_rows(spark) - before < 5 * len(rows)


def generated_rows(plan) -> int:
    """Rows that the plan's explodes have given."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return generated_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return generated_rows(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if name == "GenerateExec" else 0
    return own + sum(generated_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_stacks_of_shapes_that_look_alike(spark):
    """Of shapes in a stack that look alike one is drawn."""
    box = [(1.0, 1.0, 2.0), (7.0, 1.0, 2.0), (7.0, 6.0, 2.0), (1.0, 6.0, 2.0)]
    rows = [(i % 2, i, "polygon", box) for i in range(4000)]
    shapes = spark.createDataFrame(rows, "stack long, gobject_id int, type string, vertices array<struct<x:double,y:double,z:double>>")
    masks = series.mask_stacks(shapes, W, H, 3, "mask-mode,interpolate-empty")
    assert {(r.stack, r.z, r.y, r.x): r.v for r in masks.collect()} == {(s, 2, y, x): 255 for s in (0, 1) for y in range(1, 6) for x in range(1, 7)}
    assert 0 < generated_rows(masks._jdf.queryExecution().executedPlan()) < len(rows)


def test_strides_better_fits_and_steps(spark):
    assert [features.sampling_stride(n) for n in (2000, 513, 512, 257, 200, 100, 65, 64, 1)] == [16, 16, 8, 8, 4, 2, 2, 1, 1]
    fit = lambda *rows: spark.createDataFrame(rows, "pair_id int, params array<double>, fit double")
    got = features.keep_better(fit((1, [1.0], 0.5), (2, [2.0], 0.5), (3, [3.0], 0.5)), fit((1, [9.0], 0.4), (2, [9.0], 0.5), (3, [9.0], 0.6)))
    assert sorted((r.pair_id, r.params[0]) for r in got.collect()) == [(1, 9.0), (2, 2.0), (3, 3.0)]
    steps = [(lambda df, n: df.withColumn("a", F.col("a") + n), 2), (lambda df: df.withColumn("a", F.col("a") * 10),)]
    assert series.apply_steps(spark.createDataFrame([(1,)], "a int"), steps).first().a == 30
    named = [("crop", 1), ("rotate",), ("scale", 2)]
    assert series.steps_left(named, "rotate") == [("crop", 1)] and series.steps_right(named, "rotate") == [("scale", 2)] and series.steps_left(named, "flip") == []


def test_progress_listener(spark, tmp_path):
    """Rows so far are told batch by batch, and a callback that answers false stops the stream."""
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    listener = frames.Progress(lambda batch, rows: told.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = source.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert [rows for _, rows in told][-1] == 40 and [b for b, _ in told] == sorted(b for b, _ in told)
