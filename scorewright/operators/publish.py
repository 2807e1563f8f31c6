"""Manifests and reconciliation of a published data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["project", "opt_level", "binary_name"]


def select_groups(functions: DataFrame, configs: list[str], most: int | None = None) -> DataFrame:
    """Groups with a function in any of the configurations (``full``: all groups), the first ``most`` by key."""
    rows = functions if "full" in configs else functions.where(F.arrays_overlap("datasets", F.array(*[F.lit(c) for c in configs])))
    rows = rows.select(*GROUP).distinct().orderBy(*GROUP)
    return rows.limit(most) if most else rows


def manifest(functions: DataFrame, config: str) -> DataFrame:
    """Per group the sorted functions of one configuration."""
    rows = functions if config == "full" else functions.where(F.array_contains("datasets", config))
    return rows.groupBy(*GROUP).agg(F.array_sort(F.collect_list("function_name")).alias("functions"), F.count(F.lit(1)).alias("n"))


def index_counts(functions: DataFrame) -> DataFrame:
    """Per configuration: projects, binaries, functions; ``full`` is all."""
    rows = functions.select(*GROUP, F.explode(F.array_append("datasets", F.lit("full"))).alias("config"))
    return rows.groupBy("config").agg(F.countDistinct("project").alias("projects"), F.countDistinct(*GROUP).alias("binaries"), F.count(F.lit(1)).alias("functions"))


def content_dedup(units: DataFrame) -> DataFrame:
    """units: project, stem, content. One file for each distinct content of a project; a stem that was taken gets the first eight digits of its hash."""
    rows = units.withColumn("sha", F.sha2(F.col("content").cast("binary"), 256))
    first = rows.groupBy("project", "sha").agg(F.min("stem").alias("stem"))
    nth = F.row_number().over(Window.partitionBy("project", "stem").orderBy("sha"))
    name = F.when(nth == 1, F.concat("stem", F.lit(".c"))).otherwise(F.concat("stem", F.lit("."), F.substring("sha", 1, 8), F.lit(".c")))
    return first.select("project", "sha", name.alias("file"))


def orphans(tracked: DataFrame, expected: DataFrame, keep: list[str]) -> DataFrame:
    """Tracked paths that aren't expected and under none of the kept prefixes."""
    rows = tracked.join(expected.select("path").distinct(), "path", "left_anti")
    for prefix in keep:
        rows = rows.where(~F.col("path").startswith(prefix))
    return rows


def orphan_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy(F.substring_index("path", "/", 2).alias("top")).agg(F.count(F.lit(1)).alias("n"))


def best_source(cfgs: DataFrame) -> DataFrame:
    """Per function name the best source graph: not degenerate before degenerate, then more nodes, then the first unit. cfgs: unit, name, nodes, all_nop."""
    degenerate = (F.col("nodes") == 0) | (F.col("nodes") == 1) & F.col("all_nop")
    rows = cfgs.withColumn("good", ~degenerate)
    w = Window.partitionBy("name").orderBy(F.desc("good"), F.desc("nodes"), "unit")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def resolve_source(wanted: DataFrame, cfgs: DataFrame) -> DataFrame:
    """wanted: binary stem, name. The graph of its own unit if that is not degenerate, else the best by name."""
    own = cfgs.withColumn("good", ~((F.col("nodes") == 0) | (F.col("nodes") == 1) & F.col("all_nop"))).where("good")
    own = own.select(F.col("unit").alias("stem"), "name", F.col("unit").alias("own"), F.col("nodes").alias("own_nodes"))
    best = best_source(cfgs).select("name", F.col("unit").alias("best"), F.col("nodes").alias("best_nodes"))
    rows = wanted.join(own, ["stem", "name"], "left").join(best, "name", "left")
    return rows.select("stem", "name", F.coalesce("own", "best").alias("unit"), F.coalesce("own_nodes", "best_nodes").alias("nodes"))
