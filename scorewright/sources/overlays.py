"""Overlay files of recomputed scores, and frozen manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlays import SLICE, slices

_ENTRY = "struct<value:double,perfect:boolean,compilable:boolean,dist:double>"


def _present(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, perfect, compilable, dist) of a map of entries."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{_ENTRY}>")).alias("key", "e"))
    return raw.select("key", "e.*")


def ged(spark: SparkSession, root: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(entries, covered slices): covered are the entries', the sidecar's, and those whose checkpoint file exists."""
    if not _present(spark, f"{root}/ged_new.json"):
        return None, None
    rows = entries(spark, f"{root}/ged_new.json")
    covered = slices(rows.select("key"))
    if _present(spark, f"{root}/ged_new.slices.json"):
        listed = spark.read.text(f"{root}/ged_new.slices.json", wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("key"))
        covered = covered.unionByName(slices(listed))
    if _present(spark, f"{root}/reeval_ged/*.json"):
        files = spark.read.format("binaryFile").load(f"{root}/reeval_ged/*.json").select(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.json$", "").alias("key"))
        covered = covered.unionByName(slices(files.select(F.replace("key", F.lit("__"), F.lit("::")).alias("key"))))
    return rows, covered.select(*SLICE).distinct()


def byte_match(spark: SparkSession, root: str) -> DataFrame | None:
    return entries(spark, f"{root}/byte_match_new.json") if _present(spark, f"{root}/byte_match_new.json") else None


def type_match(spark: SparkSession, root: str) -> DataFrame | None:
    """(dec, key, value, dist); an entry is a number or {value, dist}."""
    path = f"{root}/type_match_new.json"
    if not _present(spark, path):
        return None
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("dec", "m")).select("dec", F.explode("m").alias("key", "v"))
    bare = F.col("v").try_cast("double")
    e = F.from_json("v", "struct<value:double,dist:double>")
    return raw.select("dec", "key", F.coalesce(bare, e["value"]).alias("value"), e["dist"].alias("dist"))


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """Keys of the frozen sample, or None without one."""
    path = f"{root}/sample_set_manifest.json"
    if not _present(spark, path):
        return None
    rows = spark.read.schema("functions array<struct<project:string,opt:string,binary:string,function:string>>").option("multiLine", True).json(path)
    return rows.select(F.inline("functions")).select("project", F.col("opt").alias("opt_level"), F.col("binary").alias("binary_name"), F.col("function").alias("function_name")).distinct()


def write_manifest(keys: DataFrame, path: str) -> None:
    """Sorted keys as one small document."""
    row = F.struct("project", F.col("opt_level").alias("opt"), F.col("binary_name").alias("binary"), F.col("function_name").alias("function"))
    keys.agg(F.array_sort(F.collect_list(row)).alias("functions")).write.mode("overwrite").json(path)
