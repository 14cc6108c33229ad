"""Mixing sources to target weights by capped water-filling, natively.

A source's share of the budget follows its weight, but no source is read more than max_epochs times: sources
above that are clamped, and what they leave is shared again among the others by weight, until none is above.
The mix then takes every document of a source floor(epochs) times, and the fraction that is left from the front
of the source's seeded order: a document is in it if more than half of its words lie before the quota, so a
source misses its target by half a document at most.

The order of a source is that of md5(seed:doc_id), and among rows of one doc_id that of a hash of the row's number, so
rows that share an id are told apart. Its front ends at one boundary, found from the coarse to the fine: by groups of
buckets of the order, buckets, keys, buckets of the rows of one key, and rows; each step sums pre-aggregated parts of the
one that holds the boundary, so no source and no id, however large, is sorted or summed in one task. Each document is then
compared with its source's boundary. Rows of the boundary table are one a source.

Rows are numbered by writing them once. A file-backed table in the same files gives the same numbers in every run.

Cases: null text has size 0; a null source is a source of its own, the last; a null doc_id takes the seed alone
as its key; repeated ids and whole rows are rows like others, of which as many are taken as fit; an empty table gives an
empty result; columns of the input whose names clash with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, n_words

ADDED = ("size", "source_size", "target", "copies", "taken")
#: Documents in a bucket of a source's order, about.
BUCKET = 2000


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources with rank from 0 by code point, null last: by ranges, whose row counts are summed."""
    ranged = cut(
        sources.repartitionByRange(16, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    return ranged.withColumn("rank", rank).join(before.select("part", "before"), "part").withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("part", "before")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with target. Each round is one sum over the sources; clamped ones only grow."""
    capped = F.lit(float(max_epochs)) * F.col("source_size")
    level, clamped = None, F.lit(False)
    while True:
        left, free = sources.agg(
            F.sum(F.when(clamped, capped).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight").cast("double")))
        ).first()
        now = (budget - (left or 0.0)) / free if free else float("inf")
        if now == level or now == float("inf"):
            level = now
            break
        level = now
        clamped = capped < F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.least(capped, F.lit(level) * F.col("weight")))


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _deeper(rows: DataFrame, edge: DataFrame, path: list[str], at: Column, name: str) -> DataFrame:
    """edge (source, quota, start, n, path...), one row a source, with one more step: the last part, of those that `at` makes of
    the rows on the path, that starts before the quota; start and n are then that part's, outer the n before."""
    inside = _inside(rows, edge, path).withColumn(name, at)
    keys = ["source", "_quota", "_start", "_n", *path, name]
    sums = inside.groupBy(*keys).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    start = F.col("_start") + F.sum("words").over(Window.partitionBy("source").orderBy(name)) - F.col("words")
    last = sums.withColumn("start", start).where(F.col("start") < F.col("_quota")).groupBy("source").agg(F.max_by(F.struct(*keys[1:], "start", "n"), name).alias("m"))
    return last.select("source", F.col("m._quota").alias("quota"), "m.start", "m.n", F.col("m._n").alias("outer"), *(f"m.{c}" for c in (*path, name)))


def _inside(rows: DataFrame, edge: DataFrame, path: list[str]) -> DataFrame:
    """The rows on the path of their source's boundary, with its _quota, _start and _n."""
    own = edge.select(F.col("source").alias("_s"), *(F.col(c).alias(f"_{c}") for c in ("quota", "start", "n", *path)))
    same = F.col("source").eqNullSafe(F.col("_s"))
    for c in path:
        same &= F.col(c) == F.col(f"_{c}")
    return rows.join(own, same).drop("_s", *(f"_{c}" for c in path))


def mix(docs: DataFrame, weight_of_rank: Column, share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, copies and taken. weight_of_rank: a column of rank, the sources' order.

    docs needs doc_id, source and either size or text.
    """
    size = n_words(F.col("text")) if "text" in docs.columns else F.col("size")
    # The columns wait under names of no meaning, so theirs may be any; those of ADDED make way.
    others = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ADDED}
    docs = cut(docs.select("doc_id", "source", size.alias("size"), *(F.col(c).alias(n) for c, n in others.items()), F.monotonically_increasing_id().alias("_row")), "sized")
    sums = ranked_sources(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    sums = cut(sums.withColumn("weight", weight_of_rank), "weights")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(sums, share * total, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("whole", F.least("whole", F.lit(int(max_epochs))).cast("long"))
    plan = plan.withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n_docs") / BUCKET))
    plan = cut(plan.withColumn("grouped", F.ceil(F.sqrt("buckets"))), "targets")
    # The boundary, from the coarse to the fine. A row's place in its source's order is the same wherever it is looked at.
    placed = docs.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(2.0**32))
    placed = placed.withColumn("_key", key).withColumn("_bucket", bucket).withColumn("_group", F.floor(F.col("_bucket") / F.col("grouped"))).withColumn("_tie", F.xxhash64("_row", F.lit(seed)))
    rows = placed.select("source", "size", "_row", *(F.col(f"_{c}").alias(c) for c in ("group", "bucket", "key", "tie")))
    edge, path = plan.select("source", "quota", F.lit(0).cast("long").alias("start"), F.col("n_docs").alias("n")), []
    of_key = F.pmod("tie", F.ceil(F.col("_n") / BUCKET))
    for name, at in (("group", F.col("group")), ("bucket", F.col("bucket")), ("key", F.col("key")), ("part", of_key)):
        edge = _deeper(rows, edge, path, at, name)
        path.append(name)
        if name == "key":
            edge = cut(edge, "keys")
            rows = _inside(rows, edge, path).withColumn("part", of_key).drop("_quota", "_start", "_n")
    order = F.struct("tie", "_row")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("tie", "_row").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("_start") + running - F.col("size") / F.lit(2.0)
    taken = _inside(rows, edge, path).withColumn("middle", middle).where(F.col("middle") < F.col("_quota")).groupBy("source").agg(F.max(order).alias("row"))
    edge = edge.join(taken.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")), "left")
    edge = cut(edge.select(F.col("source").alias("_e"), F.struct("group", "bucket", "key").alias("_edge"), F.ceil(F.col("outer") / BUCKET).alias("_parts"), F.col("part").alias("_part"), F.col("row").alias("_last")), "edges")
    # Every document against its source's boundary.
    out = placed.join(edge, F.col("source").eqNullSafe(F.col("_e")), "left")
    own, part = F.struct(F.col("_group").alias("group"), F.col("_bucket").alias("bucket"), F.col("_key").alias("key")), F.pmod("_tie", "_parts")
    last = F.struct(F.col("_tie").alias("tie"), "_row")
    front = (own < F.col("_edge")) | ((own == F.col("_edge")) & ((part < F.col("_part")) | ((part == F.col("_part")) & (last <= F.col("_last")))))
    copies = F.col("whole") + F.coalesce(front, F.lit(False)).cast("long")
    return out.withColumn("copies", F.least(copies, F.lit(int(max_epochs)))).withColumn("taken", F.col("copies") * F.col("size")).select(*(F.col(n).alias(c) for c, n in others.items()), *ADDED)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    turn = free_name(mixed, "_turn")
    return mixed.where("copies > 0").withColumn(turn, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
