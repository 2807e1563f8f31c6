"""The data set on disk: tables partitioned by project, which are the checkpoints of a run, and one JSON document for others to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage
from ..plans.dataset import Dataset

_MM = "map<string,map<string,double>>"
SCHEMA = f"""schema_version int, decompilers array<string>, metrics array<string>, perfect_values map<string,double>,
groups array<struct<project:string,opt_level:string,binary:string,labels:array<string>,functions:array<struct<function:string,
values:{_MM},distances:{_MM},perfects:map<string,map<string,boolean>>,decompiled:map<string,boolean>,compiles:map<string,boolean>,
labels:array<string>,datasets:array<string>,size:int>>>>"""


def read(spark: SparkSession, path: str, sample_only: tuple[str, ...] = ()) -> Dataset:
    """The document as tables. Absent keys have no row; NaN, Infinity and null values have one."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    g = doc.select(F.posexplode("groups").alias("gp", "g"))
    f = g.select("gp", "g.project", "g.opt_level", F.col("g.binary").alias("binary_name"), F.posexplode("g.functions").alias("fp", "f"))
    f = f.withColumn("fn_id", F.col("gp").cast("long") * (1 << 32) + F.col("fp"))
    empty = F.array().cast("array<string>")
    functions = f.select("fn_id", "project", "opt_level", "binary_name", F.col("f.function").alias("function_name"), "f.size", F.coalesce("f.labels", empty).alias("labels"), F.coalesce("f.datasets", empty).alias("datasets"))
    cells = f.select("fn_id", "f.perfects", "f.distances", F.explode("f.values").alias("dec", "m")).select("fn_id", "dec", "perfects", "distances", F.explode("m").alias("metric", "value"))
    at = lambda c: F.try_element_at(F.try_element_at(c, F.col("dec")), F.col("metric"))
    obs = cells.select("fn_id", "dec", "metric", "value", F.coalesce(at(F.col("perfects")), F.lit(False)).alias("perfect"), at(F.col("distances")).alias("distance"))
    attempts = f.select("fn_id", "f.compiles", F.explode("f.decompiled").alias("dec", "decompiled")).select("fn_id", "dec", "decompiled", F.try_element_at("compiles", F.col("dec")).alias("compiles"))
    decs = doc.select(F.posexplode("decompilers").alias("pos", "dec")).select("dec", "pos", F.col("dec").isin(*sample_only).alias("sample_only"))
    metrics = doc.select("perfect_values", F.posexplode("metrics").alias("pos", "metric"))
    perfect = F.coalesce(F.try_element_at("perfect_values", F.col("metric")), F.lit(0.0))
    metrics = metrics.select("metric", "pos", (perfect == 0).alias("lower_is_better"), perfect.alias("perfect_value"))
    return Dataset(functions, obs, attempts, decs, metrics)


def groups(spark: SparkSession, path: str) -> DataFrame:
    """All groups with their labels, those without functions too."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return doc.select(F.inline("groups")).select("project", "opt_level", F.col("binary").alias("binary_name"), "labels")


def _sorted(rows, *by: str):
    """An array of structs that hold maps, sorted by some fields."""
    key = lambda x: F.struct(*[x[c] for c in by])
    return F.array_sort(rows, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def nested(data: Dataset, schema_version: int = 2) -> DataFrame:
    """One row in the document's form. Functions are grouped by binary; the document itself is one row, as its format asks."""
    entry = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    per = data.obs.groupBy("fn_id", "dec").agg(entry("metric", "value").alias("v"), F.map_from_entries(F.collect_list(F.struct("metric", "perfect"))).alias("p"), F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("metric", "distance"))))).alias("d"))
    cells = per.groupBy("fn_id").agg(entry("dec", "v").alias("values"), entry("dec", "d").alias("distances"), entry("dec", "p").alias("perfects"))
    tries = data.attempts.groupBy("fn_id").agg(entry("dec", "decompiled").alias("decompiled"), F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("compiles").isNotNull(), F.struct("dec", "compiles"))))).alias("compiles"))
    rows = data.functions.join(cells, "fn_id", "left").join(tries, "fn_id", "left")
    fn = F.struct("fn_id", F.col("function_name").alias("function"), "values", "distances", "perfects", "decompiled", "compiles", "labels", "datasets", "size")
    by = rows.groupBy("project", "opt_level", "binary_name").agg(_sorted(F.collect_list(fn), "fn_id").alias("fns"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    group = F.struct("project", "opt_level", F.col("binary_name").alias("binary"), "labels", F.transform("fns", lambda x: x.dropFields("fn_id")).alias("functions"))
    doc = by.agg(_sorted(F.collect_list(group), "project", "opt_level", "binary").alias("groups"))
    names = data.decs.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dec"))), lambda x: x["dec"]).alias("decompilers"))
    metrics = data.metrics.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "metric"))), lambda x: x["metric"]).alias("metrics"), entry("metric", "perfect_value").alias("perfect_values"))
    return doc.crossJoin(names).crossJoin(metrics).select(F.lit(schema_version).alias("schema_version"), "decompilers", "metrics", "perfect_values", "groups")  # one row each


#: Tables of a data set that have a row for each function, and those that have a few rows for all.
LARGE, SMALL = ("functions", "obs", "attempts"), ("decs", "metrics")


def save(data: Dataset, path: str) -> None:
    """Write the tables, large ones partitioned by project; of a folder that is there only the projects in ``data`` are replaced."""
    project = data.functions.select("fn_id", "project")
    for name in LARGE:
        rows = data.functions if name == "functions" else getattr(data, name).join(project, "fn_id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{path}/{name}")
    for name in SMALL:
        getattr(data, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> Dataset:
    """The data set of the checkpoints under ``path`` without excluded projects, whose files aren't read; unreadable files are skipped."""
    # a schema of its own would drop the partition column, so it is read with the files
    read = lambda name: spark.read.option("ignoreCorruptFiles", True).parquet(f"{path}/{name}")
    wanted = ~F.col("project").isin(*exclude) if exclude else F.lit(True)
    large = {name: read(name).where(wanted) for name in LARGE}
    return Dataset(**{n: df if n == "functions" else df.drop("project") for n, df in large.items()}, **{n: read(n) for n in SMALL})


def present_decs(data: Dataset) -> DataFrame:
    """(project, dec) that a checkpoint already has: a resumed run passes them over."""
    return data.attempts.join(data.functions.select("fn_id", "project"), "fn_id").select("project", "dec").distinct()


def write(data: Dataset, path: str) -> None:
    nested(data).write.mode("overwrite").json(path)


def write_guarded(data: Dataset, path: str, allowed_projects=(), allowed_decs=(), allow_drops: bool = False) -> None:
    """Write the document unless it covers less than the one that is there; the old one is kept beside it.

    The new document is complete before any name changes, through Hadoop's file system.
    """
    spark = data.functions.sparkSession
    jvm = spark._jvm
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        coverage.guard(coverage.coverage_counts(read(spark, path)), coverage.coverage_counts(data), allowed_projects, allowed_decs, allow_drops)
    staged, previous = jvm.org.apache.hadoop.fs.Path(path + ".tmp"), jvm.org.apache.hadoop.fs.Path(path + ".prev")
    write(data, path + ".tmp")
    if fs.exists(here):
        fs.delete(previous, True)
        fs.rename(here, previous)
    if not fs.rename(staged, here) and fs.exists(previous):
        fs.rename(previous, here)
        raise OSError(f"{path} could not be replaced")


def write_json(df: DataFrame, path: str, numbers: list[str]) -> None:
    """Write rows as JSON; non-finite numbers in ``numbers`` fail the write instead of being written as text."""
    for c in numbers:
        ok = F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        df = df.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit(f"non-finite number in {c}")).cast("double")))
    df.write.mode("overwrite").json(path)
