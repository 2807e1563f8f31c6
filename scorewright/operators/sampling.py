"""Even sampling: few functions from many projects and binaries, by ranks instead of a greedy loop.

A binary belongs to one project, so visiting projects in turn and taking each one's first allowed
candidate picks the same rows as ordering candidates by (their rank in the project, the project's
place): first those that are their binary's first, then, if these are too few, the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["project", "opt_level", "binary_name"]
KEY = [*GROUP, "function_name"]


def hash_order() -> Column:
    """An order of functions that any engine can reproduce."""
    return F.md5(F.concat_ws("::", *KEY))


def sample_even(candidates: DataFrame, quota: int, order: Column | None = None, used: DataFrame | None = None) -> DataFrame:
    """Up to ``quota`` rows of ``candidates`` (key columns).

    ``used`` (group columns): binaries of which the first pass takes nothing. Candidates must not
    hold functions that were already chosen, or that have no score.
    """
    rows = candidates.select(*KEY).distinct().withColumn("o", hash_order() if order is None else order).withColumn("p", F.md5("project"))
    if used is None:
        rows = rows.withColumn("taken", F.lit(False))
    else:
        rows = rows.join(used.select(*GROUP).distinct().withColumn("taken", F.lit(True)), GROUP, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    binary = Window.partitionBy(*GROUP).orderBy("o", *KEY)
    rows = rows.withColumn("lead", (F.row_number().over(binary) == 1) & ~F.col("taken"))
    in_project = Window.partitionBy("project").orderBy("o", *KEY)
    lead = rows.where("lead").withColumn("r", F.row_number().over(in_project))
    one = lead.orderBy("r", "p", *KEY).limit(quota).select(*KEY, F.lit(0).alias("phase"), F.lit(0).alias("r"), "p")
    rest = rows.join(one.select(*KEY), KEY, "left_anti").withColumn("r", F.row_number().over(in_project))
    both = one.unionByName(rest.select(*KEY, F.lit(1).alias("phase"), "r", "p"))
    return both.orderBy("phase", "r", "p", *KEY).limit(quota).select(*KEY)


def sample_buckets(bucketed: DataFrame, total: int, names: list[str]) -> DataFrame:
    """All buckets in their order, each with the same quota; chosen functions and used binaries carry over.

    bucketed: key columns and ``bucket``. Each bucket's pick is a few rows, which are written to the
    driver's plan as literals, so the plan doesn't grow with the buckets before it.
    """
    spark = bucketed.sparkSession
    quota, chosen = max(1, total // len(names)), []
    schema = ", ".join(f"{c} string" for c in [*KEY, "bucket"])
    for name in names:
        taken = spark.createDataFrame(chosen, schema)
        pool = bucketed.where(F.col("bucket") == name).select(*KEY).join(F.broadcast(taken.select(*KEY)), KEY, "left_anti")
        picked = sample_even(pool, quota, used=taken.select(*GROUP)).collect()  # at most ``quota`` rows
        chosen += [(*r, name) for r in picked]
    return spark.createDataFrame(chosen, schema)


def top_up(bucketed: DataFrame, members: DataFrame, excluded: list[str], names: list[str]) -> DataFrame:
    """Members outside the excluded projects, and for each that goes a new one from the first bucket that had it."""
    spark = bucketed.sparkSession
    gone = F.col("project").isin(*excluded)
    kept = members.where(~gone).select(*KEY)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("bucket"))
    owner = bucketed.join(members.where(gone).select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min_by("bucket", place).alias("bucket"))
    need = {r["bucket"]: r["count"] for r in owner.groupBy("bucket").count().collect()}  # a row for each bucket
    schema = ", ".join(f"{c} string" for c in KEY)
    new: list[tuple] = []
    for name in names:
        if need.get(name):
            taken = kept.unionByName(spark.createDataFrame(new, schema))
            pool = bucketed.where((F.col("bucket") == name) & ~gone).select(*KEY).join(taken, KEY, "left_anti")
            new += [tuple(r) for r in sample_even(pool, need[name], used=taken.select(*GROUP)).collect()]
    return kept.unionByName(spark.createDataFrame(new, schema))


def file_sample(files: DataFrame, k: int) -> DataFrame:
    """From each project's sorted files those at places floor(i n / k), i < k."""
    w = Window.partitionBy("project")
    rows = files.withColumn("r", F.row_number().over(w.orderBy("path")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    hit = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("n") / k) == F.col("r"))
    return rows.where(hit).select(*files.columns)
