"""DICOM, compound files, NIfTI, EXIF and TIFF pyramids: files written here byte by byte, and read by Spark."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import geotiff
from pixelweave.operators import planes
from pixelweave.sources import codecs, compound, dicom, exif, nifti, readers, tiff

# DICOM -------------------------------------------------------------------------------------------------------------


def element(order, explicit, tag, kind, value):
    value += b"" if len(value) % 2 == 0 else b"\0" if kind in ("UI", "OB") else b" "
    head = struct.pack(order + "HH", *tag)
    if not explicit:
        return head + struct.pack(order + "I", len(value)) + value
    if kind.encode() in dicom.LONG:
        return head + kind.encode() + b"\0\0" + struct.pack(order + "I", len(value)) + value
    return head + kind.encode() + struct.pack(order + "H", len(value)) + value


def dicom_file(values, syntax=dicom.EXPLICIT, samples=1, planar=0, signed=0, stored=None, extra=(), photometric=b"MONOCHROME2", raw=None):
    """A file of frames (frame, sample, row, column), or with raw of coded pixels."""
    order, explicit = ">" if syntax == dicom.BIG else "<", syntax != dicom.IMPLICIT
    frames, _, h, w = values.shape
    bits = values.dtype.itemsize * 8
    us = lambda n: struct.pack(order + "H", n)
    rows = [
        ((0x0008, 0x0060), "CS", b"MR"), ((0x0010, 0x0010), "PN", b"Doe^Jo"), ((0x0020, 0x0032), "DS", b"1.5\\-2\\30"), ((0x0028, 0x0002), "US", us(samples)), ((0x0028, 0x0004), "CS", photometric),
        ((0x0028, 0x0006), "US", us(planar)), ((0x0028, 0x0008), "IS", str(frames).encode()), ((0x0028, 0x0010), "US", us(h)), ((0x0028, 0x0011), "US", us(w)), ((0x0028, 0x0100), "US", us(bits)),
        ((0x0028, 0x0101), "US", us(stored or bits)), ((0x0028, 0x0102), "US", us((stored or bits) - 1)), ((0x0028, 0x0103), "US", us(signed)), *extra,
    ]
    body = b"".join(x if isinstance(x, bytes) else element(order, explicit, *x) for x in sorted(rows, key=lambda r: struct.unpack(order + "HH", r[:4]) if isinstance(r, bytes) else r[0]))
    if raw is None:
        v = values if planar else values.transpose(0, 2, 3, 1)
        body += element(order, explicit, (0x7FE0, 0x0010), "OW" if bits > 8 else "OB", np.ascontiguousarray(v, values.dtype.newbyteorder(order)).tobytes())
    else:
        body += raw
    if syntax == dicom.DEFLATED:
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    return bytes(128) + b"DICM" + element("<", True, (2, 0x10), "UI", syntax.encode()) + body


def sequence(order, explicit, open_):
    """An open or closed sequence of two items, the second with a sequence of its own."""
    inner = element(order, explicit, (0x0008, 0x1150), "UI", b"1.2.3")
    deep_item = element(order, explicit, (0x0008, 0x1155), "UI", b"9.8")
    item = lambda x: struct.pack(order + "HHI", *dicom.ITEM, 0xFFFFFFFF if open_ else len(x)) + x + (struct.pack(order + "HHI", *dicom.ITEM_END, 0) if open_ else b"")

    def seq(tag, items):
        body = b"".join(map(item, items)) + (struct.pack(order + "HHI", *dicom.SEQUENCE_END, 0) if open_ else b"")
        return struct.pack(order + "HH", *tag) + (b"SQ\0\0" if explicit else b"") + struct.pack(order + "I", 0xFFFFFFFF if open_ else len(body)) + body

    return seq((0x0008, 0x1140), [inner, inner + seq((0x0008, 0x1199), [deep_item])])


VALUES = np.random.default_rng(3).integers(0, 4096, (2, 1, 5, 6)).astype("u2")


@pytest.mark.parametrize("open_", [True, False])
@pytest.mark.parametrize("syntax", [dicom.IMPLICIT, dicom.EXPLICIT, dicom.BIG, dicom.DEFLATED])
def test_dicom_tags_and_planes(syntax, open_):
    order, explicit = ">" if syntax == dicom.BIG else "<", syntax != dicom.IMPLICIT
    data = dicom_file(VALUES, syntax, stored=12, extra=[sequence(order, explicit, open_)])
    got = list(dicom.read_dicom(data))
    assert [(p.page, p.channel, p.width, p.height, p.depth, p.pixel_format) for p in got] == [(0, 0, 6, 5, 12, "unsigned"), (1, 0, 6, 5, 12, "unsigned")]
    assert np.array_equal(np.stack([p.pixels.reshape(5, 6) for p in got]), VALUES[:, 0])
    t = dicom.tags(data)
    assert t["(0010,0010)"] == "Doe^Jo" and t["(0020,0032)"] == "1.5\\-2\\30" and t["(0028,0010)"] == "5" and t["(7fe0,0010)"] == "120 bytes"
    assert t["(0008,1140)[0].(0008,1150)"].rstrip("\0") == "1.2.3" and t["(0008,1140)[1].(0008,1199)[0].(0008,1155)"].rstrip("\0 ") == "9.8"


def test_dicom_samples():
    rgb = np.random.default_rng(1).integers(0, 256, (2, 3, 4, 5)).astype("u1")
    for planar in (0, 1):
        data = dicom_file(rgb, samples=3, planar=planar, photometric=b"RGB")
        assert np.array_equal(np.stack([p.pixels.reshape(4, 5) for p in dicom.read_dicom(data, pages={1})]), rgb[1])
        part = list(dicom.read_dicom(data, region=(1, 2, 9, 3)))
        assert len(part) == 6 and np.array_equal(part[4].pixels.reshape(2, 4), rgb[1, 1, 2:4, 1:5])
        assert list(dicom.read_dicom(data, region=(7, 0, 9, 3))) == []
    signed = np.array([[[[-5, 7], [0, -2048]]]], "i2")
    scale = [((0x0028, 0x1052), "DS", b"-10"), ((0x0028, 0x1053), "DS", b"0.5")]
    got = next(dicom.read_dicom(dicom_file(signed & 0x0FFF, signed=1, stored=12, extra=scale)))
    assert got.pixel_format == "float" and got.pixels.tolist() == [-12.5, -6.5, -10.0, -1034.0]
    assert next(dicom.read_dicom(dicom_file(signed & 0x0FFF, signed=1, stored=12, extra=scale), rescale=False)).pixels.tolist() == [-5, 7, 0, -2048]
    table = [((0x0028, 0x1101 + k), "US", struct.pack("<HHH", 3, 1, 16)) for k in range(3)] + [((0x0028, 0x1201 + k), "OW", struct.pack("<3H", 10 + k, 20 + k, 30 + k)) for k in range(3)]
    got = list(dicom.read_dicom(dicom_file(np.array([[[[0, 1, 2, 3, 9]]]], "u1"), extra=table, photometric=b"PALETTE COLOR")))
    assert [p.pixels.tolist() for p in got] == [[10 + k, 10 + k, 20 + k, 30 + k, 30 + k] for k in range(3)]


def rle(segment):
    """Each byte as a run of one or as literals."""
    out, i = b"", 0
    while i < len(segment):
        n = 1
        while i + n < len(segment) and segment[i + n] == segment[i] and n < 128:
            n += 1
        out += bytes([257 - n, segment[i]]) if n > 1 else bytes([0, segment[i]])
        i += n
    return out + b"\0" * (len(out) % 2)


def test_dicom_runs():
    fragments = [b""]
    for frame in VALUES[:, 0]:
        parts = [rle((frame >> 8).astype("u1").tobytes()), rle((frame & 255).astype("u1").tobytes())]
        fragments.append(struct.pack("<16I", 2, 64, 64 + len(parts[0]), *[0] * 13) + b"".join(parts))
    raw = struct.pack("<HH", 0x7FE0, 0x10) + b"OB\0\0" + struct.pack("<I", 0xFFFFFFFF) + b"".join(struct.pack("<HHI", *dicom.ITEM, len(x)) + x for x in fragments) + struct.pack("<HHI", *dicom.SEQUENCE_END, 0)
    got = list(dicom.read_dicom(dicom_file(VALUES, dicom.RUNS, raw=raw)))
    assert np.array_equal(np.stack([p.pixels.reshape(5, 6) for p in got]), VALUES[:, 0])
    with pytest.raises(ValueError, match="pixels coded by"):
        list(dicom.read_dicom(dicom_file(VALUES, "1.2.840.10008.1.2.4.50", raw=raw)))


def test_dicom_files_in_spark(spark, tmp_path):
    good = dicom_file(VALUES, stored=12)
    (tmp_path / "a.dcm").write_bytes(good)
    (tmp_path / "cut.dcm").write_bytes(good[:-40])
    (tmp_path / "other.dcm").write_bytes(b"no such thing" * 50)
    got = readers.read_images(spark, str(tmp_path)).orderBy("page").collect()
    assert [r.page for r in got] == [0, 1] and got[1].pixels == VALUES[1, 0].ravel().tolist()
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.bad_images(spark, str(tmp_path)).collect()) == ["cut.dcm", "other.dcm"]
    tags = {r.path.rsplit("/", 1)[1]: r for r in readers.read_tags(spark, str(tmp_path)).collect()}
    assert tags["a.dcm"].tags["(0008,0060)"] == "MR" and tags["other.dcm"].tags is None and "cut off" in tags["cut.dcm"].error


def test_slice_order(spark):
    """Slices given in the order 1, 3, 2, 0 along a tilted normal, and a series with equal places."""
    from pixelweave.operators import series

    rows = [(1, f"{i}.dcm", {"(0020,0032)": f"{i * 0.6}\\0\\{i * 0.8}", "(0020,0037)": "0.8\\0\\-0.6\\0\\1\\0"}) for i in (1, 3, 2, 0)]
    rows += [(2, n, {"(0020,0032)": "0\\0\\5", "(0020,0037)": "1\\0\\0\\0\\1\\0"}) for n in ("b", "a")] + [(2, "c", {})]
    df = spark.createDataFrame(rows, "series_id int, path string, tags map<string,string>")
    got = [(r.series_id, r.path, r.slice) for r in series.order_slices(df, "series_id").orderBy("series_id", "slice").collect()]
    assert got == [(1, f"{i}.dcm", i) for i in range(4)] + [(2, "a", 0), (2, "b", 1), (2, "c", 2)]


# Compound files ----------------------------------------------------------------------------------------------------


def compound_file(streams, wrong_link=None, wide=False):
    """streams: path of at most one storage to bytes. Small ones go to the mini stream; all chains are scattered by two."""
    size = 4096 if wide else 512
    sectors, table = [], []

    def add(raw):
        """Every part of raw to a sector with an empty one behind it."""
        if not raw:
            return 0xFFFFFFFE
        first = len(sectors)
        parts = [raw[i : i + size].ljust(size, b"\0") for i in range(0, len(raw), size)]
        for k, part in enumerate(parts):
            sectors.extend([part, b"\xee" * size])
            table.extend([first + 2 * k + 2 if k < len(parts) - 1 else 0xFFFFFFFE, 0xFFFFFFFF])
        return first

    mini, links, placed = b"", [], {}
    for path, raw in streams.items():
        if len(raw) >= 4096:
            placed[path] = add(raw)
        elif raw:
            first, n = len(mini) // 64, -(-len(raw) // 64)
            links += [first + k + 1 if k < n - 1 else 0xFFFFFFFE for k in range(n)]
            mini += raw.ljust(n * 64, b"\0")
            placed[path] = first
        else:
            placed[path] = 0xFFFFFFFE
    none, entries = 0xFFFFFFFF, []

    def entry(name, kind, first=0, length=0, left=none, right=none, child=none):
        raw = name.encode("utf-16-le")
        entries.append([raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1), left, right, child, bytes(36), first, length])
        return len(entries) - 1

    root = entry("Root Entry", 5)
    storages = {p.split("/")[0]: None for p in streams if "/" in p}
    top = []
    for s in storages:
        kids = [entry(p.split("/")[1], 2, placed[p], len(r)) for p, r in streams.items() if p.startswith(s + "/")]
        for a, b in zip(kids, kids[1:], strict=False):
            entries[a][2] = b
        top.append(entry(s, 1, child=kids[0]))
    top += [entry(p, 2, placed[p], len(r)) for p, r in streams.items() if "/" not in p]
    middle = len(top) // 2
    for a, b in zip(top[middle:], top[middle + 1 :], strict=False):
        entries[a][2] = b
    for a, b in zip(top[middle:0:-1], top[middle - 1 :: -1], strict=False):
        entries[a][1] = b
    entries[root][3] = top[middle]
    entries[root][5], entries[root][6] = add(mini), len(mini)
    first_small = add(struct.pack(f"<{len(links)}I", *links).ljust(-(-4 * len(links) // size) * size, b"\xff"))
    raw = b"".join(e[0] + struct.pack("<III", *e[1:4]) + e[4] + struct.pack("<IQ", e[5], e[6]) for e in entries)
    directory = add(raw)
    if wrong_link:
        table[wrong_link[0]] = wrong_link[1]
    tables = -(-(len(table) + 4) // (size // 4))
    table += [0xFFFFFFFD] * tables
    table += [0xFFFFFFFF] * (tables * size // 4 - len(table))
    where = list(range(len(sectors), len(sectors) + tables))
    sectors += [struct.pack(f"<{size // 4}I", *table[k * size // 4 : (k + 1) * size // 4]) for k in range(tables)]
    head = compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 4 if wide else 3, 0xFFFE, 12 if wide else 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIIII", 0, tables, directory, 0, 4096, first_small, 1, 0xFFFFFFFE, 0, 0)[: 40 - 4]
    head += struct.pack("<109I", *where, *[0xFFFFFFFF] * (109 - tables))
    return head.ljust(size, b"\0") + b"".join(sectors)


PLANES = np.random.default_rng(2).integers(0, 255, (4, 6, 5, 1)).astype("u1")


def oib_file(**more):
    names = [(1, 1), (1, 2), (2, 1), (2, 2)]
    info = "[OibSaveInfo]\r\nName=x\r\n" + "".join(f"Stream{k:05d}=s_C{c:03d}Z{z:03d}.tif\r\n" for k, (c, z) in enumerate(names, 1)) + "Stream00009=main.oif\r\n"
    oif = "[Axis 0 Parameters Common]\r\nAxisCode=\"X\"\r\nMaxSize=5\r\n[Axis 3 Parameters Common]\r\nAxisCode=\"Z\"\r\nMaxSize=2\r\n"
    streams = {f"Storage00001/Stream{k:05d}": tiff.write_tiff([PLANES[k - 1]]) for k in range(1, 5)}
    streams |= {"Stream00009": b"\xff\xfe" + oif.encode("utf-16-le"), "OibInfo.txt": b"\xff\xfe" + info.encode("utf-16-le"), "empty": b"", "large": bytes(range(256)) * 40}
    return compound_file(streams, **more), streams


@pytest.mark.parametrize("wide", [False, True])
def test_compound_streams(wide):
    data, streams = oib_file(wide=wide)
    c = compound.Compound(data)
    assert c.streams() == sorted((p, len(r)) for p, r in streams.items())
    assert all(c.read(p) == r for p, r in streams.items())
    with pytest.raises(KeyError):
        c.read("Storage00001")


def test_compound_cycles_and_cuts():
    data, _ = oib_file(wrong_link=(0, 0))
    with pytest.raises(ValueError, match="comes twice in a chain"):
        c = compound.Compound(data)
        [c.read(p) for p, _ in c.streams()]
    data, _ = oib_file()
    with pytest.raises((ValueError, struct.error)):
        compound.Compound(data[: len(data) // 2])
    with pytest.raises(ValueError, match="no compound file"):
        compound.Compound(b"x" * 600)


def test_oib_in_spark(spark, tmp_path):
    data, streams = oib_file()
    (tmp_path / "a.oib").write_bytes(data)
    (tmp_path / "bad.oib").write_bytes(data[: len(data) // 2])
    got = {(r.page, r.channel): r for r in readers.read_images(spark, str(tmp_path), glob="a.oib").collect()}
    assert sorted(got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    for k, (c, z) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]):
        assert got[z, c].pixels == PLANES[k].ravel().tolist()
    assert [r.path.rsplit("/", 1)[1] for r in readers.bad_images(spark, str(tmp_path)).collect()] == ["bad.oib"]
    rows = readers.compound_streams(spark, str(tmp_path), contents=True).collect()
    assert {r.stream: bytes(r.content) for r in rows if r.path.endswith("a.oib")} == streams
    tags = {r.path.rsplit("/", 1)[1]: r for r in readers.read_tags(spark, str(tmp_path)).collect()}
    assert tags["a.oib"].tags["Axis 3 Parameters Common/MaxSize"] == "2" and tags["a.oib"].tags["OibSaveInfo/Stream00001"] == "s_C001Z001.tif"


# NIfTI -------------------------------------------------------------------------------------------------------------


def nifti_file(values, order="<", two=False, slope=0.0, shift=0.0, qform=0, sform=0, quaternion=(0.0,) * 6, rows=(0.0,) * 12, spacing=(1.0, 2.0, 3.0, 4.0, 1.0, 1.0, 1.0, 1.0), kind=None):
    """values: axes from the slowest to x."""
    kind = kind or next(k for k, v in nifti.TYPES.items() if np.dtype(v) == values.dtype)
    dims = [values.ndim, *values.shape[::-1], *[1] * (7 - values.ndim)]
    if two:
        h = bytearray(540)
        struct.pack_into(order + "i", h, 0, 540)
        h[4:8] = b"n+2\0"
        struct.pack_into(order + "hh", h, 12, kind, 0)
        struct.pack_into(order + "8q", h, 16, *dims)
        struct.pack_into(order + "8d", h, 104, *spacing)
        struct.pack_into(order + "q", h, 168, 544)
        struct.pack_into(order + "2d", h, 176, slope, shift)
        struct.pack_into(order + "2i", h, 344, qform, sform)
        struct.pack_into(order + "18d", h, 352, *quaternion, *rows)
        struct.pack_into(order + "2i", h, 500, 10, 0)
    else:
        h = bytearray(348)
        struct.pack_into(order + "i", h, 0, 348)
        struct.pack_into(order + "8h", h, 40, *dims)
        struct.pack_into(order + "hhh", h, 68, 2, kind, 0)
        struct.pack_into(order + "8f", h, 76, *spacing)
        struct.pack_into(order + "3f", h, 108, 352, slope, shift)
        h[123] = 10
        h[148:153] = b"notes"
        struct.pack_into(order + "2h", h, 252, qform, sform)
        struct.pack_into(order + "18f", h, 256, *quaternion, *rows)
        h[344:348] = b"n+1\0"
    return bytes(h) + bytes(4) + np.ascontiguousarray(values, values.dtype.newbyteorder(order)).tobytes()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("two", [False, True])
def test_nifti_planes(order, two):
    rng = np.random.default_rng(4)
    for shape in ((3,), (4, 3), (2, 4, 3), (2, 3, 4, 5), (2, 2, 3, 4, 5), (2, 1, 2, 2, 3, 4, 5)):
        v = rng.integers(-300, 300, shape).astype("i2")
        got = list(nifti.read_nifti(gzip.compress(nifti_file(v, order, two)) if two else nifti_file(v, order, two)))
        full = v.reshape((1,) * (7 - v.ndim) + v.shape)
        channels = full.reshape(-1, *full.shape[3:])
        nt, nz = channels.shape[1:3]
        assert len(got) == len(channels) * nt * nz
        for p in got:
            assert np.array_equal(p.pixels.reshape(p.height, p.width), channels[p.channel, p.page // nz, p.page % nz])
    scaled = list(nifti.read_nifti(nifti_file(np.array([[1, 2]], "u1"), order, two, slope=0.5, shift=-1.0)))[0]
    assert scaled.pixels.tolist() == [-0.5, 0.0] and scaled.pixel_format == "float"
    with pytest.raises(ValueError, match="cut off"):
        list(nifti.read_nifti(nifti_file(np.zeros((4, 4)), order, two)[:-1]))


def test_nifti_affine():
    v = np.zeros((2, 2, 2), "u1")
    rows = tuple(float(x) for x in range(12))
    assert np.allclose(nifti.affine(nifti.header(nifti_file(v, sform=1, qform=1, rows=rows)))[:3].ravel(), rows)
    assert np.allclose(nifti.affine(nifti.header(nifti_file(v))), np.diag([2, 3, 4, 1]))
    turn = np.deg2rad(50)
    b, c, d = np.sin(turn / 2) * np.array([1, 2, 2]) / 3
    got = nifti.affine(nifti.header(nifti_file(v, two=True, qform=1, quaternion=(b, c, d, 5.0, 6.0, 7.0), spacing=(-1.0, 2.0, 3.0, 4.0, 1.0, 1.0, 1.0, 1.0))))
    k = np.array([[0, -2, 2], [2, 0, -1], [-2, 1, 0]]) / 3  # turning around (1, 2, 2) / 3
    want = (np.eye(3) + np.sin(turn) * k + (1 - np.cos(turn)) * k @ k) * np.array([2, 3, -4])
    assert np.allclose(got[:3, :3], want) and got[:3, 3].tolist() == [5, 6, 7]
    half = nifti.affine(nifti.header(nifti_file(v, qform=1, quaternion=(0.0, 0.0, 1.0, 0.0, 0.0, 0.0))))
    assert np.allclose(half, np.diag([-2, -3, 4, 1]))


def test_nifti_in_spark(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(2, 3, 4)).astype("f4")
    (tmp_path / "a.nii").write_bytes(nifti_file(v, qform=2))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti_file(np.arange(24, dtype="u1").reshape(1, 2, 12), kind=128)[:-12] + bytes(12 + 48)))
    (tmp_path / "c.nii.gz").write_bytes(b"\x1f\x8bnothing")
    rows = readers.read_images(spark, str(tmp_path), glob="a.nii").orderBy("page").collect()
    assert np.array_equal(np.array([r.pixels for r in rows], "f4").reshape(2, 3, 4), v)
    assert readers.read_images(spark, str(tmp_path), glob="b*").where("channel = 2").count() == 1
    tags = {r.path.rsplit("/", 1)[1]: r for r in readers.read_tags(spark, str(tmp_path)).collect()}
    assert tags["a.nii"].tags["space"] == "aligned" and tags["a.nii"].tags["units"] == "mm" and tags["a.nii"].tags["time_units"] == "s" and tags["c.nii.gz"].error


# EXIF --------------------------------------------------------------------------------------------------------------

JPEG = b"\xff\xd8" + b"\xff\xe0\0\x07JFIF\0" + b"\xff\xdb\0\x04ab" + b"\xff\xda\0\x02coded bytes\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif_read_write_read(order):
    tags = [
        exif.Tag("image", 0x010F, 2, (b"A maker of cameras\0",)), exif.Tag("image", 0x0112, 3, (6,)), exif.Tag("image", 0x011A, 5, ((72, 1),)), exif.Tag("photo", 0x829D, 5, ((28, 10),)),
        exif.Tag("photo", 0x9204, 10, ((-1, 3),)), exif.Tag("photo", 0x9286, 7, (b"ASCII\0\0\0hello",)), *exif.gps_tags(-33.8567844, 151.2152967, -12.5), exif.Tag("interop", 1, 2, (b"R98\0",)),
    ]
    assert exif.read_exif(JPEG) == []
    data = exif.write_exif(JPEG, tags, order)
    assert sorted(exif.read_exif(data)) == sorted(tags)
    changed = [t._replace(values=(b"Another maker of much larger cameras\0",)) if t.tag == 0x010F and t.group == "image" else t for t in exif.read_exif(data)]
    again = exif.write_exif(data, changed, order)
    assert sorted(exif.read_exif(again)) == sorted(changed) and exif.write_exif(again, exif.read_exif(again), order) == again
    assert again.endswith(b"coded bytes\xff\xd9") and again.count(exif.MAGIC) == 1 and again[2:4] == b"\xff\xe0"
    named = exif.named(exif.read_exif(again))
    assert named["image/Make"].startswith("Another") and named["photo/FNumber"] == "2.8" and named["altitude"] == "-12.5"
    assert abs(float(named["latitude"]) + 33.8567844) < 1e-7 and abs(float(named["longitude"]) - 151.2152967) < 1e-7


def test_exif_in_spark(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(exif.write_exif(JPEG, exif.gps_tags(48.5, -3.25)))
    (tmp_path / "none.jpg").write_bytes(JPEG)
    cut = exif.write_exif(JPEG, exif.gps_tags(48.5, -3.25))
    (tmp_path / "bad.jpg").write_bytes(cut[:60])
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_tags(spark, str(tmp_path)).collect()}
    assert (got["a.jpg"].tags["latitude"], got["a.jpg"].tags["longitude"]) == ("48.5", "-3.25") and got["none.jpg"].tags == {} and got["bad.jpg"].error


# TIFF --------------------------------------------------------------------------------------------------------------


def test_lzw_round_trip():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"a" * 10000, bytes(rng.integers(0, 256, 30000, dtype=np.uint8)), bytes(rng.integers(0, 3, 50000, dtype=np.uint8)), bytes(range(256)) * 64):
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    codes = "".join(f"{b:08b}" for b in tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])))
    # the specification's example: Clear, 7, 258, 8, 8, 258, 6, 6, End
    assert [int(codes[i : i + 9], 2) for i in range(0, 81, 9)] == [256, 7, 258, 8, 8, 258, 6, 6, 257]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_sub_directories(order, big):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 255, (70, 45, 3)).astype("u1"), rng.integers(0, 60000, (33, 64, 1)).astype("u2")]
    levels = [tiff.pyramid(p, 16) for p in pages]
    data = tiff.write_tiff(pages, 16, order=order, big=big, compression=tiff.LZW, levels=levels, tags=[[(270, 2, tuple(b"note\0"))], []])
    listed = list(tiff.directories(data))
    assert [(d.number, d.level) for d in listed] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2)] and listed[0].description == "note"
    for k, page in enumerate(pages):
        for level, want in enumerate([page, *levels[k]]):
            got = np.stack([p.pixels.reshape(p.height, p.width) for p in tiff.read_tiff(data, {k}, level)], -1)
            assert np.array_equal(got, want)
    assert np.array_equal(levels[1][0][:, :, 0], np.floor(planes.halve(pages[1][:, :, 0].astype(float)) + 0.5))


def test_pyramid_job(spark, tmp_path):
    rng = np.random.default_rng(6)
    large, small = rng.integers(0, 255, (90, 130, 3)).astype("u1"), rng.integers(0, 255, (9, 8, 1)).astype("u1")
    (tmp_path / "a b.tif").write_bytes(tiff.write_tiff([large, large[:40, :20]]))
    (tmp_path / "small.tif").write_bytes(tiff.write_tiff([small]))
    (tmp_path / "bad.tif").write_bytes(tiff.write_tiff([large])[:3000])
    before = (tmp_path / "bad.tif").read_bytes()
    rows = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in readers.pyramid_tiffs(spark, str(tmp_path), tile=32).collect()}
    assert sorted(rows) == ["a b.tif", "bad.tif"] and rows["a b.tif"].levels == 3 and rows["bad.tif"].error
    assert (tmp_path / "bad.tif").read_bytes() == before and sorted(p.name for p in tmp_path.iterdir()) == ["a b.tif", "bad.tif", "small.tif"]
    data = (tmp_path / "a b.tif").read_bytes()
    assert np.array_equal(np.stack([p.pixels.reshape(90, 130) for p in tiff.read_tiff(data, {0})], -1), large)
    assert [(p.width, p.height) for p in tiff.read_tiff(data, {0}, 3)] == [(17, 12)] * 3
    assert [r.path.rsplit("/", 1)[1] for r in readers.pyramid_tiffs(spark, str(tmp_path), tile=32).collect()] == ["bad.tif"]
    assert (tmp_path / "a b.tif").read_bytes() == data


def test_all_values_of_a_tag_and_damaged_directories(spark, tmp_path):
    page = np.zeros((400, 3, 1), "u1")
    (tmp_path / "a.tif").write_bytes(tiff.write_tiff([page], tags=[[(65000, 3, tuple(range(300)))]]))
    (tmp_path / "b.tif").write_bytes(tiff.write_tiff([page])[:-60] + struct.pack("<H", 1) + struct.pack("<HHII", 65000, 4, 999, 10**6) + bytes(46))
    rows = readers.tiff_pages(spark, str(tmp_path)).collect()
    assert [r.tags[65000] for r in rows if r.path.endswith("a.tif")] == [",".join(map(str, range(300)))]


# GeoTIFF -----------------------------------------------------------------------------------------------------------


def test_three_ways_to_the_same_place(spark, tmp_path):
    """A raster of 30 m pixels from (500000, 4500000) in zone 33 north: by scale and tie, by matrix, by three ties; and degrees."""
    keys = lambda code, tag=3072, raster=1: (34735, 3, (1, 1, 0, 4, 1024, 0, 1, 1, 1025, 0, 1, raster, tag, 0, 1, code, 1026, 34737, 6, 0))
    text = (34737, 2, tuple(b"place|\0"))
    x0, y0, s = 500000.0, 4500000.0, 30.0
    files = {
        "scale": [(33550, 12, (s, s, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)), keys(32633), text],
        "matrix": [(34264, 12, (s, 0.0, 0.0, x0, 0.0, -s, 0.0, y0, *[0.0] * 7, 1.0)), keys(32633), text],
        "ties": [(33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0, 10.0, 0.0, 0.0, x0 + 10 * s, y0, 0.0, 0.0, 10.0, 0.0, x0, y0 - 10 * s, 0.0)), keys(32633), text],
        "points": [(33550, 12, (s, s, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0 + s / 2, y0 - s / 2, 0.0)), keys(32633, raster=2), text],
        "south": [(33550, 12, (s, s, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, 10000000.0 - 300, 0.0)), keys(32733), text],
        "degrees": [(33550, 12, (0.5, 0.25, 0.0)), (33922, 12, (0.0, 0.0, 0.0, -10.0, 60.0, 0.0)), keys(4326, 2048), text],
        "none": [],
    }
    for n, more in files.items():
        (tmp_path / f"{n}.tif").write_bytes(tiff.write_tiff([np.zeros((4, 5, 1), "u1")], tags=[more]))
    t = readers.tiff_pages(spark, str(tmp_path)).select("path", geotiff.geo_keys(F.col("tags")).alias("k"), geotiff.transform_of(F.col("tags")).alias("t"))
    t = t.withColumn("at", geotiff.map_place(F.col("t"), F.col("k"), F.lit(2), F.lit(1))).withColumn("ll", geotiff.lon_lat(F.col("at"), F.col("k")))
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in t.collect()}
    for n in ("scale", "matrix", "ties", "points"):
        assert (got[n]["at"].x, got[n]["at"].y) == pytest.approx((x0 + 2.5 * s, y0 - 1.5 * s)), n
        assert (got[n].ll.lon, got[n].ll.lat) == pytest.approx((got["scale"].ll.lon, got["scale"].ll.lat), abs=1e-12)
        assert got[n].k[1026] == "place"
    assert 15.0008 < got["scale"].ll.lon < 15.001 and 40.64 < got["scale"].ll.lat < 40.66
    assert -0.004 < got["south"].ll.lat < 0 and (got["degrees"].ll.lon, got["degrees"].ll.lat) == (-8.75, 59.625)
    assert got["none"].k is None and got["none"].t is None and got["none"].ll is None


# Microscopes' dialects ---------------------------------------------------------------------------------------------


def stk_file(planes_, steps, seconds=0):
    """One directory for all planes: the first by it, the others behind it."""
    n, h, w = planes_.shape
    rows = b"".join(struct.pack("<6I", *s, 2_450_000, k * seconds * 1000, 0, 0) for k, s in enumerate(steps))
    raw = planes_.astype("<u2").tobytes()
    at = 8 + len(raw) + len(rows)
    fields = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 2, at + 200), (277, 3, 1, 1), (278, 4, 1, (h + 1) // 2), (279, 4, 2, at + 208), (33629, 5, n, 8 + len(raw))]
    half = (h + 1) // 2
    extra = struct.pack("<4I", 8, 8 + half * w * 2, half * w * 2, (h - half) * w * 2)
    body = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + bytes(4)
    return b"II*\0" + struct.pack("<I", at) + raw + rows + body.ljust(200, b"\0") + extra


def fluoview_head(dims):
    head = struct.pack("<hB", 1456, 0) + b"a stack".ljust(256, b"\0") + bytes(25)
    for name, n, step in dims:
        head += name.encode().ljust(16, b"\0") + struct.pack("<Idd", n, 0.0, step) + b"um".ljust(64, b"\0")
    return tuple(head.ljust(1456, b"\0"))


def test_microscope_dialects(spark, tmp_path):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 60000, (6, 5, 4)).astype("u2")
    (tmp_path / "z.stk").write_bytes(stk_file(v, [(3, 2)] * 6))
    (tmp_path / "t.stk").write_bytes(stk_file(v, [(0, 1)] * 6, seconds=2))
    two = rng.integers(0, 255, (6, 5, 4, 2)).astype("u1")
    small = [(tiff.SUBFILE, 4, (1,))]
    info = struct.pack("<Iiiiiiiiii", 0x00400494C, 500, 4, 5, 3, 2, 2, 1, 1, 1) + struct.pack("<3d", 2e-7, 3e-7, 1e-6)
    pages = [x for p in two for x in (p, p[:1, :1])]
    (tmp_path / "a.lsm").write_bytes(tiff.write_tiff(pages, tags=[[(34412, 1, tuple(info))] if k == 0 else small if k % 2 else [] for k in range(12)]))
    head = fluoview_head([("X", 4, 0.2), ("Y", 5, 0.3), ("Ch", 2, 0.0), ("Z", 3, 1.5)])
    (tmp_path / "f.tif").write_bytes(tiff.write_tiff([p[:, :, :1] for p in two], tags=[[(34361, 1, head)], *[[]] * 5]))
    psia = bytearray(580)
    struct.pack_into("<ii", psia, 100, 4, 5)
    struct.pack_into("<dd", psia, 140, 8.0, 5.0)
    struct.pack_into("<dd", psia, 220, 0.5, 2.0)
    psia[4:14] = "Topog".encode("utf-16-le")
    signed = rng.integers(-3000, 3000, (5, 4)).astype("<i2")
    (tmp_path / "p.tif").write_bytes(tiff.write_tiff([two[0]], tags=[[(50434, 1, tuple(signed.tobytes())), (50435, 1, tuple(psia))]]))
    (tmp_path / "cut.stk").write_bytes(stk_file(v, [(3, 2)] * 6).replace(struct.pack("<HHI", 33629, 5, 6), struct.pack("<HHI", 33629, 5, 60)))
    (tmp_path / "plain.tif").write_bytes(tiff.write_tiff([two[0], two[1]]))
    got = {}
    for r in readers.read_images(spark, str(tmp_path), kind="microscope").collect():
        got[r.path.rsplit("/", 1)[1], r.page, r.channel] = np.array(r.pixels).reshape(r.height, r.width)
    for k in range(6):
        assert np.array_equal(got["z.stk", k, 0], v[k]) and np.array_equal(got["t.stk", k, 0], v[k])
        assert all(np.array_equal(got["a.lsm", k, c], two[k, :, :, c]) for c in (0, 1))
        assert np.array_equal(got["f.tif", k // 2, k % 2], two[k, :, :, 0])
    assert np.array_equal(got["p.tif", 0, 0], signed[::-1].astype(float)) and sorted(n for n, *_ in got if n == "plain.tif") == ["plain.tif"] * 4
    assert len(got) == 6 + 6 + 12 + 6 + 1 + 4
    tags = {r.path.rsplit("/", 1)[1]: r for r in readers.read_tags(spark, str(tmp_path)).collect()}
    of = lambda n, *keys: tuple(tags[n].tags[k] for k in keys)
    assert of("z.stk", "dialect", "num_z", "num_t", "resolution_z") == ("stk", "6", "1", "1.5") and of("t.stk", "num_z", "num_t", "resolution_t") == ("1", "6", "2")
    assert of("a.lsm", "num_z", "num_t", "num_c", "resolution_y") == ("3", "2", "2", "0.3") and of("f.tif", "order", "num_c", "resolution_z", "name") == ("cz", "2", "1.5", "a stack")
    assert of("p.tif", "dialect", "source", "resolution_x") == ("psia", "Topog", "2") and tags["cut.stk"].error and of("plain.tif", "dialect", "num_z") == ("tiff", "2")
