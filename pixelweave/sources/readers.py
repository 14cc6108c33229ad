"""Images as DataFrames: files read by Spark and decoded in place, and a Python data source for them."""

from __future__ import annotations

import configparser
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .codecs import CAPABILITIES, READERS, sniff, write_bmp

#: What decoders raise on files that are damaged or of another kind.
BAD = (KeyError, ValueError, IndexError, OverflowError, MemoryError, EOFError, OSError, configparser.Error, struct.error, zlib.error)
SCHEMA = "path string, page int, channel int, width int, height int, depth int, pixel_format string, pixels array<double>"


def read_images(spark: SparkSession, path: str, kind: str | None = None, glob: str | None = None, **options) -> DataFrame:
    """All planes of the image files under a path that Spark can read; the format by name, or by each file's first bytes.
    A file that can't be decoded is left out of read_images and listed by bad_images."""
    return _decoded(spark, path, kind, glob, options, bad=False)


def bad_images(spark: SparkSession, path: str, kind: str | None = None, glob: str | None = None, **options) -> DataFrame:
    """(path, error) of the files that can't be decoded."""
    return _decoded(spark, path, kind, glob, options, bad=True)


def _decoded(spark: SparkSession, path: str, kind: str | None, glob: str | None, options: dict, bad: bool) -> DataFrame:
    files = spark.read.format("binaryFile")
    files = files.option("pathGlobFilter", glob) if glob else files
    names = ["path", "error"] if bad else [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    reader = READERS[kind or sniff(content[:512]) or ""][0]
                    rows = [(p, *x[:6], x.pixels.tolist()) for x in reader(content, **options)]
                    error = None
                except BAD as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
                if bad:
                    rows = [] if error is None else [(p, error)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.load(path).select("path", "content").mapInPandas(run, "path string, error string" if bad else SCHEMA)


TIFF_PAGES = "path string, page int, level int, width int, height int, channels int, depth int, description string, tags map<int,string>"


def tiff_pages(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Directories of the TIFF files under a path, a row for each page and level, without decoding any pixel. Tags are comma
    lists of all their values. A damaged file is left out, and listed by bad_images."""
    from .tiff import BITS, HEIGHT, SAMPLES, WIDTH, directories, is_tiff

    files = spark.read.format("binaryFile")
    files = files.option("pathGlobFilter", glob) if glob else files

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                if is_tiff(content):
                    try:
                        rows = [
                            (p, d.number, d.level, d.one(WIDTH, 0), d.one(HEIGHT, 0), d.one(SAMPLES, 1), d.one(BITS, 1), d.description, {t: ",".join(map(str, v)) for t, v in d.tags.items()})
                            for d in directories(content)
                        ]
                    except BAD:
                        continue
                    yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TIFF_PAGES.replace("map<int,string>", "map").split(", ")])

    return files.load(path).select("path", "content").mapInPandas(run, TIFF_PAGES)


def _tag_readers() -> dict[str, Callable[[bytes], dict[str, str]]]:
    from . import compound, dialects, dicom, exif, nifti

    return {"tiff": dialects.tags, "dicom": dicom.tags, "nifti": nifti.tags, "oib": compound.oib_tags, "jpeg": lambda data: exif.named(exif.read_exif(data))}


def read_tags(spark: SparkSession, path: str, kind: str | None = None, glob: str | None = None) -> DataFrame:
    """(path, kind, tags, error) of DICOM, NIfTI, OIB, TIFF (microscopes' dialects) and JPEG (EXIF, GPS) files under a path, without decoding pixels; the kind by name
    or by each file's first bytes. A file that can't be read has null tags and an error."""
    files = spark.read.format("binaryFile")
    files = files.option("pathGlobFilter", glob) if glob else files

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        functions = _tag_readers()
        for f in frames:
            rows = []
            for p, content in zip(f["path"], f["content"], strict=True):
                k = kind or ("jpeg" if content[:3] == b"\xff\xd8\xff" else sniff(content[:512]))
                try:
                    rows.append((p, k, functions[k](content), None))
                except BAD as e:
                    rows.append((p, k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "tags", "error"])

    return files.load(path).select("path", "content").mapInPandas(run, "path string, kind string, tags map<string,string>, error string")


def compound_streams(spark: SparkSession, path: str, glob: str | None = None, contents: bool = False) -> DataFrame:
    """(path, stream, size, content, error) of the streams in compound files; content is null unless asked for. A damaged file has one
    row with its error."""
    from .compound import Compound

    files = spark.read.format("binaryFile")
    files = files.option("pathGlobFilter", glob) if glob else files

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    c = Compound(content)
                    rows = [(p, s, n, c.read(s) if contents else None, None) for s, n in c.streams()]
                except BAD as e:
                    rows = [(p, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "stream", "size", "content", "error"]).astype({"size": "Int64"})

    return files.load(path).select("path", "content").mapInPandas(run, "path string, stream string, size long, content binary, error string")


def pyramid_tiffs(spark: SparkSession, path: str, glob: str = "*.tif", tile: int = 512) -> DataFrame:
    """Converts the TIFF files under a path into pyramids in place: LZW, tiles, levels as sub-directories of each page. A row for each
    file that has none yet: (path, levels, error). A file is replaced only when its new form has been written whole, so the job can
    be stopped, or a task run twice, at any time, and a second run finds nothing to do. Nothing happens until the result is read; the
    folder must be one that all executors share."""
    from .tiff import LZW, directories, is_tiff, pixels, pyramid, write_tiff

    def converted(data: bytes) -> tuple[bytes, int]:
        pages = [p for p in directories(data) if p.level == 0]
        arrays = [pixels(data, p)[0] for p in pages]
        levels = [pyramid(a, tile) for a in arrays]
        notes = [[(270, 2, tuple((p.description + "\0").encode()))] if p.description else [] for p in pages]
        big = sum(a.nbytes for a in arrays) > 1 << 31
        return write_tiff(arrays, tile, compression=LZW, levels=levels, tags=notes, big=big), max(map(len, levels), default=0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                try:
                    if not is_tiff(content) or any(d.level or SUBDIRS_TAG in d.tags for d in directories(content)) or not _above(content, tile):
                        continue
                    target = unquote(urlsplit(p).path)
                    data, n = converted(content)
                    with open(f"{target}.{os.getpid()}.part", "wb") as out:
                        out.write(data)
                    os.replace(out.name, target)
                    row = (p, n, None)
                except BAD as e:
                    row = (p, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["path", "levels", "error"]).astype({"levels": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, levels int, error string")


SUBDIRS_TAG = 330


def _above(data: bytes, tile: int) -> bool:
    """Whether a page is larger than a tile, so that it gets levels."""
    from .tiff import HEIGHT, WIDTH, directories

    return any(max(d.one(WIDTH, 0), d.one(HEIGHT, 0)) > tile for d in directories(data))


def tiff_files(planes: DataFrame, tile: int | None = None) -> DataFrame:
    """(image_id, content) from planes (image_id, page, channel, width, height, pixels of 0..255): one TIFF an image, its pages
    in order, as bytes for any sink that Spark has."""
    from .tiff import write_tiff

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pages = []
        for _, page in group.sort_values(["page", "channel"]).groupby("page"):
            w, h = int(page["width"].iloc[0]), int(page["height"].iloc[0])
            pages.append(np.stack([np.asarray(p, float).reshape(h, w) for p in page["pixels"]], -1).round().clip(0, 255).astype(np.uint8))
        return pd.DataFrame({"image_id": [group["image_id"].iloc[0]], "content": [write_tiff(pages, tile)]})

    return planes.groupBy("image_id").applyInPandas(run, "image_id long, content binary")


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """PNG, JPEG and other photos by Spark's own image source, as planes from the top; its channels are blue first."""
    im = spark.read.format("image").load(path).select("image.*")
    channel = F.explode(F.sequence(F.lit(0), F.col("nChannels") - 1))
    planes = im.withColumn("channel", channel)
    at = F.when(F.col("nChannels") >= 3, F.when(F.col("channel") < 3, 2 - F.col("channel")).otherwise(F.col("channel"))).otherwise(F.col("channel"))
    byte = lambda i: F.conv(F.hex(F.substr("data", i * F.col("nChannels") + at + 1, F.lit(1))), 16, 10).cast("double")
    pixels = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), byte)
    return planes.select(F.col("origin").alias("path"), F.lit(0).alias("page"), "channel", "width", "height", F.lit(8).alias("depth"), F.lit("unsigned").alias("pixel_format"), pixels.alias("pixels"))


class RangePartition(InputPartition):
    def __init__(self, page: int):
        self.page = page


class RasterReader(DataSourceReader):
    """Pages of one raw file, a partition each: only the page's bytes are read."""

    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [RangePartition(p) for p in range(int(self.o.get("pages", 1)))]

    def read(self, partition: RangePartition) -> Iterator[tuple]:
        from .codecs import RAW_TYPES, read_raw

        w, h, c, kind = int(self.o["width"]), int(self.o["height"]), int(self.o.get("channels", 1)), self.o.get("type", "u8")
        size = w * h * c * int(RAW_TYPES[kind][1])
        with open(self.o["path"], "rb") as f:
            f.seek(int(self.o.get("offset", 0)) + size * partition.page)
            data = f.read(size)
        for x in read_raw(data, w, h, c, 1, kind, 0, self.o.get("bigendian", "false") == "true", self.o.get("interleaved", "false") == "true"):
            yield (self.o["path"], partition.page, *x[1:6], x.pixels.tolist())


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class BitmapWriter(DataSourceWriter):
    """One bitmap for each row (name, width, height, planes) into a folder that all executors share."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"]

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for r in rows:
            target = os.path.join(self.folder, f"{r['name']}.bmp")
            with open(f"{target}.part", "wb") as f:
                f.write(write_bmp(r["planes"], r["width"], r["height"]))
            os.replace(f"{target}.part", target)  # a task that runs again leaves whole files
            files.append(target)
        return Written(files)


class RasterSource(DataSource):
    """spark.read.format('pixelweave').option('width', ...) for raw files; df.write.format('pixelweave') for bitmaps."""

    @classmethod
    def name(cls) -> str:
        return "pixelweave"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> BitmapWriter:
        return BitmapWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)


def can_write_pages(kind: str) -> bool:
    return CAPABILITIES.get(kind, {}).get("write", False) and CAPABILITIES[kind]["pages"]


def write_texts(df: DataFrame, path: str, column: str) -> None:
    """A text file of one column, such as a list of files or of points."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_pyramid(levels: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Levels as Parquet by level, without the images that are there already: running it again adds nothing."""
    new = levels if done is None else levels.join(done.select("image_id").distinct(), "image_id", "left_anti")
    new.write.mode("append").partitionBy("level").parquet(path)


def read_ome_xml(texts: DataFrame, column: str = "value") -> DataFrame:
    """Dimension order, sizes and pixel sizes of OME-XML texts."""
    kind = "_ID string, _Name string, Pixels struct<_DimensionOrder:string,_SizeX:int,_SizeY:int,_SizeZ:int,_SizeC:int,_SizeT:int,_PhysicalSizeX:double,_PhysicalSizeY:double,_PhysicalSizeZ:double,_Type:string>"
    image = F.regexp_extract(F.col(column), r"(?s)(<Image[ >].*?</Image>)", 1)
    p = texts.select("*", F.from_xml(image, kind).alias("im"))
    names = {"DimensionOrder": "dim_order", "SizeX": "width", "SizeY": "height", "SizeZ": "z", "SizeC": "c", "SizeT": "t", "PhysicalSizeX": "size_x", "PhysicalSizeY": "size_y", "PhysicalSizeZ": "size_z", "Type": "pixel_type"}
    return p.select(F.col("im._Name").alias("name"), *(F.col(f"im.Pixels._{k}").alias(v) for k, v in names.items()))
