"""A store of captured binaries by content, with manifests."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts

MANIFEST = "name string, project string, opt string, stem string, sha256 string, size bigint, binary_relpath string, source_relpaths array<string>"


def save(spark: SparkSession, tree: str, name: str, store: str) -> DataFrame:
    """Capture a tree's binaries and the preprocessed sources beside them; returns the manifest. Executors copy the files; they see the tree and the store."""
    if not Path(tree).is_dir():
        raise FileNotFoundError(tree)
    found = artifacts.binaries(spark, tree).select("project", F.col("opt_level").alias("opt"), F.col("file").alias("stem"), "sha256", "size")
    home = F.concat_ws("/", "opt", "project")
    sources = {}
    for src in sorted(Path(tree).glob("*/*/compiled/*.i")):
        sources.setdefault(f"{src.parts[-4]}/{src.parts[-3]}", []).append(src.name)
    table = spark.createDataFrame([(k, v) for k, v in sources.items()], "home string, files array<string>")
    rows = found.withColumn("home", home).join(F.broadcast(table), "home", "left")
    paths = F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.concat(F.col("home"), F.lit("/"), f))
    manifest = rows.select(F.lit(name).alias("name"), "project", "opt", "stem", "sha256", "size", F.concat_ws("/", "home", "stem").alias("binary_relpath"), paths.alias("source_relpaths"))
    _copy_all(manifest, F.concat(F.lit(f"{tree}/"), "opt", F.lit("/"), "project", F.lit("/compiled/"), "file"), F.concat(F.lit(f"{store}/{name}/"), "rel"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{store}/{name}/manifest")
    return load(spark, name, store)


def load(spark: SparkSession, name: str, store: str) -> DataFrame:
    if not Path(store, name, "manifest").is_dir():
        raise FileNotFoundError(f"no data set {name!r} in {store}")
    return spark.read.schema(MANIFEST).json(f"{store}/{name}/manifest")


def listing(spark: SparkSession, store: str) -> DataFrame:
    """(name, binaries, compile_sets): distinct pairs of project and level."""
    if not any(Path(store).glob("*/manifest")):
        return spark.createDataFrame([], "name string, binaries long, compile_sets long")
    rows = spark.read.schema(MANIFEST).json(f"{store}/*/manifest")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("binaries"), F.countDistinct("project", "opt").alias("compile_sets")).orderBy("name")


def materialise(spark: SparkSession, name: str, dest: str, store: str) -> DataFrame:
    """Lay a stored set out as a results tree."""
    manifest = load(spark, name, store)
    _copy_all(manifest, F.concat(F.lit(f"{store}/{name}/"), "rel"), F.concat(F.lit(f"{dest}/"), "opt", F.lit("/"), "project", F.lit("/compiled/"), "file"))
    return manifest


def _copy_all(manifest: DataFrame, source, target) -> None:
    """Copy a manifest's files, dealt over tasks. source, target: paths by rel, opt, project and file."""
    rel = F.explode(F.concat(F.array("binary_relpath"), "source_relpaths"))
    files = manifest.select(rel.alias("rel")).distinct()
    parts = F.split("rel", "/")
    files = files.select("rel", parts[0].alias("opt"), parts[1].alias("project"), parts[2].alias("file")).select(source.alias("a"), target.alias("b"))

    def copy(rows) -> None:
        for r in rows:
            Path(r["b"]).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(r["a"], r["b"])

    files.foreachPartition(copy)
