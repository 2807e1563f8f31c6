"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """For the registered queries and the pipeline, which own their session: Arrow batches bounded by rows and bytes, to fit beside the heap.

    The operators themselves change no setting that outlives them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; it is deleted when the application ends.

    Where ``spark.checkpoint.dir`` is unset a local run, as in tests, gets a folder of its own; a cluster must name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="scorewright-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _file_system(df.sparkSession, path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` set to ``value`` for what is executed inside."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a plain reference inside a lambda is evaluated at each use."""
    return F.transform(F.array(value), body)[0]


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, group: list[str], order: list[Column], block: Column, name: str) -> DataFrame:
    """``name``: the gapless place from 0 in ``group`` by (``block``, ``order``).

    No task holds a whole group: rows are numbered inside a block, and the blocks' counts are
    summed on a table with one row per block. ``block`` must be monotonic in the wanted order.
    """
    cols = [*group, "_block"]
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*cols).orderBy(*order)
    left = rows.withColumn("_in", F.row_number().over(inside) - 1).alias("l")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols]
    keep = [F.col(f"l.{c}") for c in df.columns]
    return left.join(starts.alias("r"), on, "left").select(*keep, (F.col("_start") + F.col("_in")).cast("long").alias(name))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (u, v longs) as (node, comp): alternating large-star and small-star.

    Each half round only takes minima by key (combined before the shuffle) and joins them back,
    so a hub with many neighbours is spread over tasks by the skew join. Nothing is collected
    but a count and a checksum.
    """
    spark = edges.sparkSession
    e = kept = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("x"))
        e = e.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        before, old = kept, mark
        e = kept = materialise(e, name)
        mark = _mark(e)
        discard(before)
        if mark == old:
            break
    if not mark[0]:
        return spark.createDataFrame([], "node long, comp long")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _mark(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return int(r[0]), int(r[1])
