import pytest
from pyspark.sql import functions as F

from pixelweave.functions import numeric, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "data", "width", "expected"),
    [
        (numeric.unpack1, b"\xa5", 8, [1, 0, 1, 0, 0, 1, 0, 1]),
        (numeric.unpack4, b"\xa5\x30", 3, [10, 5, 3]),
        (numeric.unpack12_ref, b"\xab\xcd\xef", 2, [43788, 56847]),
        (numeric.unpack12, b"\xab\xcd\xef", 2, [2748, 3567]),
        (numeric.unpack1, b"", 0, []),
    ],
)
def test_unpack(spark, f, data, width, expected):
    df = spark.createDataFrame([(data, width)], "d binary, w int")
    assert df.select(f(F.col("d"), F.col("w")).alias("v")).first()["v"] == expected


def test_numbers(spark):
    assert [one(spark, numeric.iround(F.lit(v))) for v in (-2.5, 2.5)] == [-2, 3]
    assert [one(spark, numeric.i16_to_u16(F.lit(v))) for v in (-32768, -32767, 0, 32767)] == [65535, 0, 32767, 65534]
    assert one(spark, numeric.fourcc(F.lit("XVID"))) == 0x44495658
    assert one(spark, numeric.extent(F.lit(5), F.lit(2))) == 4
    assert one(spark, numeric.time_rescale(F.lit(10**15), 1, 90000, 1, 1000)) == round(10**15 / 90)
    for z, seen in ((3.4, True), (3.5, False)):
        assert one(spark, numeric.visible(F.lit(z), F.lit(None).cast("double"), 3, 0)) is seen


def test_texts(spark):
    assert one(spark, text.point_xml(F.lit(0), F.lit(1), F.lit(2))) == "<gobject type='point' name='0'><vertex x='1.000000' y='2.000000'/></gobject>"
    assert one(spark, text.ibw_date(F.lit("Date: Tue, Sep 20, 2005\rTime: 10:58:49 AM"))) == "2005-09-20 10:58:49"
    assert one(spark, text.ibw_date(F.lit(""))) == "0000-00-00 00:00:00"
    assert one(spark, text.nanoscope_date(F.lit("\\Date: 10:58:49 AM Tue Sep 20 2005"))) == "2005-09-20 10:58:49"
    assert one(spark, text.fluoview_date(F.lit("Date=02-17-2004\nTime=11:54:50"))) == "17-02-2004 11:54:50"
    assert one(spark, text.split(F.lit("a,,b"), ",")) == ["a", "b"]
    assert one(spark, text.colour_mode(F.lit("nope"))) == "MULTI"
    assert one(spark, text.parse_ini(F.lit("[A]\nx: 1\nx: 2\n"), ":", "p/")) == {"p/A/x": "2"}


def test_icc(spark):
    profile = bytearray(128)
    profile[8:10], profile[16:20] = b"\x04\x20", b"RGB "
    df = spark.createDataFrame([(bytes(profile),), (b"short",)], "d binary")
    got = [r.v for r in df.select(text.icc_tags(F.col("d")).alias("v")).collect()]
    assert got == [{"icc/version": "4.2", "icc/color_space": "RGB", "icc/size": "128"}, {}]


def test_natural_order(spark):
    names = ["a_10", "a_9", "a_010b", "b_9"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(text.natural_key(F.col("n")), "n")
    assert [r.n for r in df.collect()] == ["a_9", "b_9", "a_10", "a_010b"]
