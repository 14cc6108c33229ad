"""What the operators share: cutting lineage, Arrow batch sizes and byte-level word rules."""

from __future__ import annotations

import functools
import gc
import tempfile
import threading
import time
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in bytes; bytes.split() splits at exactly these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names. On a local master, where all share one
    disk, a new one serves if it names none; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark, "_pixelweave_folder"):
        spark._pixelweave_folder = tempfile.mkdtemp(prefix="pixelweave-")
    return spark._pixelweave_folder


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends here and lost executors cost no rerun.
    The files stay as long as any plan reads them (see sweep)."""
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    # every plan that reads the files, however derived, holds this one listing of them
    listing = out._jdf.queryExecution().analyzed().relation().location()
    with _lock:
        _cuts(spark).append((path, spark._jvm.java.lang.ref.WeakReference(listing)))
    return out


_lock = threading.Lock()
_of_jvm: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _cuts(spark: SparkSession) -> list:
    """What cut() has written: (path, weak reference to the files' listing). Kept with the JVM that the references are in."""
    return _of_jvm.setdefault(spark.sparkContext._gateway, [])


def sweep(spark: SparkSession, collect: bool = False) -> None:
    """Delete what cut() wrote and no plan reads any more. A DataFrame that somebody still holds, or one made from it, keeps its
    files whatever else runs in the session. collect: let Python and the JVM first find out what nobody holds."""
    for _ in range(4 if collect and _cuts(spark) else 0):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.25)  # the JVM's own threads let go of what has just run a little later
    with _lock:
        listed = _cuts(spark)
        gone = [x for x in listed if x[1].refersTo(None)]
        listed[:] = [x for x in listed if x not in gone]
    for path, _ in gone:
        delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete what cut() wrote, when nothing lazy reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        delete(df.sparkSession, path)
        with _lock:
            listed = _cuts(df.sparkSession)
            listed[:] = [x for x in listed if x[0] != path]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage of a chain whose every result is written before the next stage is called: it first deletes what earlier ones left
    in the shared folder, as far as nobody can read it any more."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, collect=True)
        return function(spark, docs, sf_dir)

    return run


#: Bytes of an Arrow batch, about; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows and bytes of the session's Arrow batches, unless it asks for smaller ones. Spark reads both settings when
    a query runs, which is after this package has returned it, so they stay set."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def quoted(name: str) -> str:
    """A column's name as SQL text has it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """name, or with as many underscores before it as make it no column of df."""
    while name in df.columns:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, tag: str, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """df with a number of each row, and that column's name. The id serves where it is whole and none is null or repeats; else df is
    written once with numbers of its own."""
    name = free_name(df, "_row")
    if dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") and df.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty():
        return df.withColumn(name, F.col(id_col).cast("long")), name
    return cut(df.withColumn(name, F.monotonically_increasing_id()), tag), name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Words between the separators, natively: every word with the separators around it becomes one letter."""
    body = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(body)).otherwise(F.lit(0)).cast("long")
