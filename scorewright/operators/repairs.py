"""Repairs and comparisons of recorded runs, and joins of results with registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import base_name

GROUP = ["project", "opt_level", "binary_name"]
KEY = [*GROUP, "function_name"]


def fix_flags(attempts: DataFrame, markers: DataFrame, agents: list[str], attempted: DataFrame) -> DataFrame:
    """attempts (key, dec, decompiled) with flags raised where the artifact holds the function; agents only for functions they were given."""
    held = markers.select(*KEY, "dec").distinct().withColumn("_held", F.lit(True))
    asked = attempted.select(*KEY).distinct().withColumn("_asked", F.lit(True))
    rows = attempts.join(held, [*KEY, "dec"], "left").join(asked, KEY, "left")
    no = F.lit(False)
    up = F.coalesce("_held", no) & (~F.col("dec").isin(*agents) | F.coalesce("_asked", no))
    return rows.select(*KEY, "dec", (F.coalesce("decompiled", no) | up).alias("decompiled"))


def prune_off_slice(rows: DataFrame, agents: list[str], attempted: DataFrame) -> DataFrame:
    """rows (key, dec, value) with ``fate``: kept; retained (an agent on its slice); anomaly (scored off its slice, kept); pruned."""
    asked = attempted.select(*KEY).distinct().withColumn("_asked", F.lit(True))
    out = rows.join(asked, KEY, "left")
    fate = F.when(~F.col("dec").isin(*agents), "kept").when(F.col("_asked"), "retained").when(F.col("value").isNotNull(), "anomaly").otherwise("pruned")
    return out.select(*rows.columns, fate.alias("fate"))


def compare_scores(old: DataFrame, new: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per tool: common functions, both means, how many improved or got worse beyond the tolerance. old, new: fn_id, dec, value."""
    rows = old.join(new.select("fn_id", "dec", F.col("value").alias("new_value")), ["fn_id", "dec"])
    gain = F.col("new_value") - F.col("value")
    return rows.groupBy("dec").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("old_mean"), F.avg("new_value").alias("new_mean"), F.count_if(gain > tolerance).alias("improved"), F.count_if(gain < -tolerance).alias("worse"))


def with_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (dec) with the registry's columns: the exact id's entry, else the base name's. registry: id, ..."""
    names = [c for c in registry.columns if c != "id"]
    exact = F.broadcast(registry.select(F.col("id").alias("_e"), F.struct(*names).alias("_x")))  # the registry of tools
    base = F.broadcast(registry.select(F.col("id").alias("_b"), F.struct(*names).alias("_y")))
    out = rows.join(exact, rows["dec"] == F.col("_e"), "left").join(base, base_name(rows["dec"]) == F.col("_b"), "left")
    return out.withColumn("_z", F.coalesce("_x", "_y")).select(*rows.columns, *[F.col(f"_z.{n}").alias(n) for n in names])


def locate(cases: DataFrame, blocks: DataFrame, base: str, target: str) -> DataFrame:
    """cases (key) with the address of the function: from the base tool's artifact, then the target's, then any other's. blocks: key, dec, addr."""
    order = F.when(F.col("dec") == base, 0).when(F.col("dec") == target, 1).otherwise(2)
    best = blocks.groupBy(*KEY).agg(F.min_by("addr", F.struct(order, "dec")).alias("addr"))
    return cases.join(best, KEY, "left")


def scored_pairs(source: DataFrame, decompiled: DataFrame, markers: DataFrame) -> DataFrame:
    """Source and decompiled graphs of one function that the artifact really holds."""
    own = source.select(*KEY, F.col("graph").alias("source_graph"))
    other = decompiled.select(*KEY, "dec", F.col("graph").alias("decompiled_graph"))
    return own.join(other, KEY).join(markers.select(*KEY, "dec").distinct(), [*KEY, "dec"], "left_semi")


def merged_graphs(graphs: DataFrame) -> DataFrame:
    """Per level and name the last file's graph. graphs: opt_level, pos, name, graph."""
    return graphs.groupBy("opt_level", "name").agg(F.max_by("graph", "pos").alias("graph"))


def relabelled(graphs: DataFrame) -> DataFrame:
    """Graphs (nodes array<int>, edges array<struct<u, v>>) with nodes 0 .. n-1 in their order."""
    old = graphs.withColumnRenamed("nodes", "_nodes")
    place = lambda x: (F.array_position("_nodes", x) - 1).cast("int")
    edges = F.transform("edges", lambda e: F.struct(place(e["u"]).alias("u"), place(e["v"]).alias("v")))
    return old.withColumns({"edges": edges, "nodes": F.transform("_nodes", lambda x, i: i)}).select(*graphs.columns)


def source_names(functions: DataFrame, stems: DataFrame) -> DataFrame:
    """Functions (stem, addr, name) of binaries whose stem is a wanted one or ends in ``-stem`` or ``_stem``. stems: project, wanted."""
    cut = F.transform(F.filter(F.sequence(F.lit(1), F.length("stem")), lambda i: F.substring("stem", i, F.lit(1)).isin("-", "_")), lambda i: F.substring("stem", i + 1, F.length("stem")))
    keys = functions.withColumn("_k", F.explode(F.array_distinct(F.concat(F.array("stem"), cut))))
    return keys.join(stems.withColumnRenamed("wanted", "_k"), "_k").groupBy("project", "stem", "addr").agg(F.min("name").alias("name"))


def compile_report(builds: DataFrame) -> DataFrame:
    """Per project the binaries at each level and whether all, some or no level built. builds: project, opt_level, n."""
    levels = ["O0", "O2", "O2-noinline"]
    rows = builds.groupBy("project").pivot("opt_level", levels).agg(F.sum("n")).fillna(0)
    built = sum((F.col(f"`{c}`") > 0).cast("int") for c in levels)
    state = F.when(built == len(levels), "ok").when(built > 0, "partial").otherwise("broken")
    return rows.withColumn("state", state)


def shallowest(files: DataFrame) -> DataFrame:
    """Per project and file name the file of the shallowest path. files: project, path."""
    rows = files.withColumns({"name": F.substring_index("path", "/", -1), "depth": F.size(F.split("path", "/"))})
    w = Window.partitionBy("project", "name").orderBy("depth", "path")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("project", "name", "path")


def lines_of_code(lines: DataFrame, skip: tuple[str, ...] = ("conftest.c",)) -> DataFrame:
    """Lines per project. lines: project, file (one row for each line)."""
    return lines.where(~F.col("file").isin(*skip) & ~F.startswith("file", F.lit("a-conftest"))).groupBy("project").agg(F.count(F.lit(1)).alias("loc"))


def memo_key(*parts: str) -> Column:
    """A stable hash of an evaluation's inputs and version."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p).cast("string"), F.lit("\0")) for p in parts])), 256)


def memo_misses(wanted: DataFrame, memo: DataFrame) -> DataFrame:
    """Rows (key, ...) whose result the memo lacks."""
    return wanted.join(memo.select("key"), "key", "left_anti")
