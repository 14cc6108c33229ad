import struct

import numpy as np
from pyspark.sql import functions as F

from pixelweave.sources import codecs, readers
from pixelweave.streaming import frames


def test_bitmaps(spark, tmp_path):
    rng = np.random.default_rng(0)
    planes = [rng.integers(0, 256, 15).tolist() for _ in range(3)]
    data = codecs.write_bmp(planes, 5, 3)
    (tmp_path / "a.bmp").write_bytes(data)
    (tmp_path / "broken.bmp").write_bytes(b"BM12")
    got = readers.read_images(spark, str(tmp_path), glob="*.bmp").orderBy("channel").collect()
    assert [r.pixels for r in got] == planes and (got[0].width, got[0].height, got[0].depth) == (5, 3, 8)
    assert [r.path.endswith("broken.bmp") for r in readers.bad_images(spark, str(tmp_path), glob="*.bmp").collect()] == [True]
    photo = readers.read_photos(spark, str(tmp_path / "a.bmp")).orderBy("channel").collect()
    assert [r.pixels for r in photo] == planes


def test_palette_and_runs():
    head = lambda bits, coding, size: struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + 4 * (1 << bits)) + struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, bits, coding, size, 0, 0, 0, 0)
    table = b"".join(bytes([i, i, i, 0]) for i in range(256))
    rle = bytes([3, 7, 1, 9, 0, 0, 0, 3, 1, 2, 3, 0, 1, 4, 0, 1])
    (p,) = codecs.read_bmp(head(8, 1, len(rle)) + table + rle)
    assert p.pixels.tolist() == [1, 2, 3, 4, 7, 7, 7, 9]
    one_bit = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, 1, 0, 8, 0, 0, 2, 0) + bytes([0, 0, 0, 0, 255, 255, 255, 0]) + bytes([0b10100000, 0, 0, 0, 0b01010000, 0, 0, 0])
    (p,) = codecs.read_bmp(one_bit)
    assert p.pixels.tolist() == [0, 255, 0, 255, 255, 0, 255, 0]


def test_microscope_formats():
    pic = bytearray(76)
    struct.pack_into("<HHHhhih", pic, 0, 3, 2, 2, 0, 0, 0, 0)
    struct.pack_into("<H", pic, 54, 12345)
    values = np.arange(12, dtype="<u2")
    assert [p.pixels.tolist() for p in codecs.read_biorad(bytes(pic) + values.tobytes())] == [list(range(6)), list(range(6, 12))]
    assert codecs.sniff(bytes(pic)) == "pic"
    for order in "<>":
        ibw = bytearray(384)
        struct.pack_into(order + "h", ibw, 0, 5)
        struct.pack_into(order + "h", ibw, 80, 2)
        struct.pack_into(order + "4i", ibw, 132, 3, 2, 0, 0)
        (p,) = codecs.read_ibw(bytes(ibw) + np.arange(6, dtype=order + "f4").tobytes())
        assert (p.width, p.height, p.pixel_format, p.pixels.tolist()) == (3, 2, "float", [0, 1, 2, 3, 4, 5])
    head = b"\\*File list\r\n\\Date: x\r\n\\*Ciao image list\r\n\\Data offset: 128\r\n\\Samps/line: 2\r\n\\Number of lines: 2\r\n\x1a"
    nano = head.ljust(128, b"\0") + np.array([-32767, 0, 1, 2], "<i2").tobytes()
    (p,) = codecs.read_nanoscope(nano)
    assert p.pixels.tolist() == [32768, 32769, 0, 32767]


def test_data_source(spark, tmp_path):
    readers.register(spark)
    values = np.arange(24, dtype=">i2")
    (tmp_path / "x.raw").write_bytes(b"##" + values.tobytes())
    raw = spark.read.format("pixelweave").options(path=str(tmp_path / "x.raw"), width=3, height=4, pages=2, type="i16", offset=2, bigEndian="true").load()
    assert [r.pixels for r in raw.orderBy("page").collect()] == [list(range(12)), list(range(12, 24))]
    out = spark.createDataFrame([("p", 2, 1, [[1.0, 255.0]])], "name string, width int, height int, planes array<array<double>>")
    out.write.format("pixelweave").option("path", str(tmp_path / "out")).mode("append").save()
    assert [p.pixels.tolist() for p in codecs.read_bmp((tmp_path / "out" / "p.bmp").read_bytes())] == [[1, 255]] * 3


def test_xml_and_pyramid(spark, tmp_path):
    xml = "<OME><Image ID='0' Name='n'><Pixels DimensionOrder='XYCZT' SizeX='4' SizeY='3' SizeZ='2' SizeC='1' SizeT='5' PhysicalSizeX='0.5' Type='uint8'/></Image></OME>"
    r = readers.read_ome_xml(spark.createDataFrame([(xml,)], "value string")).first()
    assert (r.name, r.dim_order, r.width, r.t, r.size_x) == ("n", "XYCZT", 4, 5, 0.5)
    levels = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], "image_id long, level int, pixels array<double>")
    readers.write_pyramid(levels, str(tmp_path / "p"))
    readers.write_pyramid(levels, str(tmp_path / "p"), spark.read.parquet(str(tmp_path / "p")))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a", n) for n in (1, 2, 5, 6, 9)], "series string, frame long").coalesce(1).write.parquet(src)
    stream = frames.frame_stream(spark, src, "series string, frame long")
    q = frames.missing_frames(stream).writeStream.format("memory").queryName("missing").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.first_missing, r.last_missing) for r in spark.table("missing").collect()) == [(3, 4), (7, 8)]
    frames.write_frames(stream, str(tmp_path / "good"), str(tmp_path / "c2"), str(tmp_path / "bad"), F.col("frame") > 5).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    cursor = frames.FrameCursor(spark.read.parquet(src))
    assert cursor.seek(1).count() == 1 and cursor.next().first()["frame"] == 2 and cursor.step(3).first()["frame"] == 5


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "e")
    events.repartition(3).write.parquet(src)
    stat = frames.frame_statistics(frames.frame_stream(spark, src, events.schema), late="60 days")
    q = stat.writeStream.format("memory").queryName("stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = frames.frame_statistics(events)
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r["mean"], 6)) for r in df.collect())
    assert key(spark.table("stats")) == key(batch)
