"""Comparisons of tools and picks of functions: improvements, hardest, difficulty tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import strictly_finite

KEY = ["project", "opt_level", "binary_name", "function_name"]


def improvements(data, base: str, target: str, metric: str, perfect_only: bool = False, target_missing: bool = False) -> DataFrame:
    """Functions where ``base`` beats ``target``; a missing or non-finite target has an infinite margin.

    One pass over the metric's scores by function: both tools' cells come from a conditional
    aggregate, not a self-join.
    """
    known = {r["metric"]: r["lower_is_better"] for r in data.metrics.collect()}  # the registry of metrics
    tools = {r["dec"] for r in data.decs.collect()}
    if base == target or base not in tools or target not in tools or metric not in known:
        raise ValueError(f"can't compare {base!r} with {target!r} on {metric!r}")
    cells = data.obs.where((F.col("metric") == metric) & F.col("dec").isin(base, target))
    pick = lambda d, c: F.max(F.when((F.col("dec") == d) & strictly_finite(F.col("value")) & F.col("value").isNotNull(), F.col(c)))
    rows = cells.groupBy("fn_id").agg(pick(base, "value").alias("base_value"), pick(base, "perfect").alias("base_perfect"), pick(target, "value").alias("target_value"))
    rows = rows.where("base_value is not null")
    if perfect_only:
        rows = rows.where("base_perfect")
    gap = F.col("target_value") - F.col("base_value")
    gap = gap if known[metric] else -gap
    rows = rows.withColumn("margin", F.coalesce(gap, F.lit(float("inf")))).where("margin > 0")
    if not target_missing:
        rows = rows.where("target_value is not null")
    rows = rows.join(data.functions.select("fn_id", *KEY), "fn_id")
    return rows.select(*KEY, "base_value", "target_value", "base_perfect", "margin").orderBy(F.desc("margin"), *KEY)


def hardest(data, code: DataFrame, k: int = 15, excluded_projects: DataFrame | None = None) -> DataFrame:
    """The k worst of each (metric, dec): farthest from perfect, then by value, among functions with code.

    Excluded projects go before the cut. Spark limits each partition's groups before the shuffle.
    """
    rows = data.obs.join(F.broadcast(data.metrics.select("metric", "perfect_value")), "metric")
    rows = rows.withColumn("gap", F.abs(F.col("value") - F.col("perfect_value"))).where((F.col("gap") > 0) & strictly_finite(F.col("value")))
    rows = rows.join(code.select("fn_id", "dec").distinct(), ["fn_id", "dec"], "left_semi").join(data.functions.select("fn_id", *KEY), "fn_id")
    if excluded_projects is not None:
        rows = rows.join(excluded_projects.select("project").distinct(), "project", "left_anti")
    w = Window.partitionBy("metric", "dec").orderBy(F.desc("gap"), F.desc("value"), *KEY)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("metric", "dec", "rank", *KEY, "value", "gap")


def tiers(data) -> DataFrame:
    """(fn_id, key, present, perfect, mean, tier) by graph distance: under two scores none; none perfect hard; most perfect easy."""
    ged = data.obs.where("metric = 'ged'").groupBy("fn_id").agg(F.count(F.lit(1)).alias("present"), F.count_if("perfect").alias("good"), F.avg(F.coalesce("distance", "value")).alias("mean"))
    most = F.greatest(F.lit(2), F.floor((F.col("present") + 1) / 2))
    tier = F.when(F.col("good") == 0, "hard").when(F.col("good") >= most, "easy").otherwise("medium")
    rows = ged.where("present >= 2").join(data.functions.select("fn_id", *KEY), "fn_id")
    return rows.select("fn_id", *KEY, "present", "good", "mean", tier.alias("tier"))


def hard_capped(tiered: DataFrame, limit: int, per_project: int = 10) -> DataFrame:
    """The worst of the hard tier, at most ``per_project`` of a project; room that is left is filled from the rest."""
    hard = tiered.where("tier = 'hard'")
    own = Window.partitionBy("project").orderBy(F.desc("mean"), *KEY)
    rows = hard.withColumn("over", (F.row_number().over(own) > per_project).cast("int"))
    return rows.orderBy("over", F.desc("mean"), *KEY).limit(limit).select(*KEY, "mean", "over")
