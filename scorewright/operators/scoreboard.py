"""Scoreboards and flat aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import percent, strictly_finite
from .facts import combo_counts, per_metric, union


def _all_functions(facts: DataFrame) -> DataFrame:
    return combo_counts(facts, presets=False).where("normalize = 0")


def scoreboard_metric(data, facts: DataFrame) -> DataFrame:
    """Per tool and metric over the whole corpus: shared denominators, mean and true median of measured values, rank.

    Ranks go by percentage; ties keep the order of tools.
    """
    counts = per_metric(_all_functions(facts), data.decs).drop("preset", "normalize")
    values = data.obs.where(strictly_finite(F.col("value")) & F.col("value").isNotNull()).groupBy("dec", "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))
    rows = counts.join(values, ["dec", "metric"], "left").join(F.broadcast(data.decs.select("dec", "pos")), "dec")
    rows = rows.withColumn("pct", percent(F.col("num"), F.col("den")))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("pct"), "pos"))
    zero = F.lit(0.0)
    return rows.select("dec", "metric", "num", "den", "pct", F.coalesce("mean", zero).alias("mean"), F.coalesce("median", zero).alias("median"), rank.alias("rank"))


def scoreboard_overall(data, facts: DataFrame) -> DataFrame:
    rows = union(_all_functions(facts), data.decs).drop("preset", "normalize").join(F.broadcast(data.decs.select("dec", "pos")), "dec")
    rows = rows.withColumn("pct", percent(F.col("num"), F.col("den")))
    return rows.select("dec", "num", "den", "pct", F.row_number().over(Window.orderBy(F.desc("pct"), "pos")).alias("rank"))  # a row for each tool


def flat_aggregates(obs: DataFrame, perfect_values: DataFrame) -> DataFrame:
    """total, mean, true median, extremes, perfect and all counts per (dec, metric). Perfect: equal to the metric's perfect value (unknown: 0)."""
    rows = obs.join(F.broadcast(perfect_values.select("metric", "perfect_value")), "metric", "left")
    good = F.col("value") == F.coalesce("perfect_value", F.lit(0.0))
    return rows.groupBy("dec", "metric").agg(
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.count_if(good).alias("perfect_count"),
        F.count("value").alias("total_count"),
    )


def flat_totals(functions: DataFrame) -> DataFrame:
    """Distinct function keys and groups."""
    return functions.agg(F.countDistinct("project", "opt_level", "binary_name", "function_name").alias("functions"), F.countDistinct("project", "opt_level", "binary_name").alias("binaries"))


def legacy_scoreboard(obs: DataFrame, perfect_values: DataFrame) -> DataFrame:
    """Denominators by tool: only functions for which it has a result. ``overall``: perfect on any metric."""
    flat = flat_aggregates(obs, perfect_values).select("dec", "metric", F.col("perfect_count").alias("num"), F.col("total_count").alias("den"))
    rows = obs.join(F.broadcast(perfect_values.select("metric", "perfect_value")), "metric", "left")
    each = rows.groupBy("dec", "fn_id").agg(F.max(F.col("value") == F.coalesce("perfect_value", F.lit(0.0))).alias("any"))
    total = each.groupBy("dec").agg(F.count_if("any").alias("num"), F.count(F.lit(1)).alias("den")).withColumn("metric", F.lit("overall"))
    out = flat.unionByName(total)
    return out.withColumn("pct", percent(F.col("num"), F.col("den")))


def binary_aggregates(data) -> DataFrame:
    """Per binary, tool and metric: total, mean, true median, perfect count and share."""
    rows = data.obs.join(data.functions.select("fn_id", "project", "opt_level", "binary_name"), "fn_id").join(F.broadcast(data.metrics.select("metric", "perfect_value")), "metric")
    out = rows.groupBy("project", "opt_level", "binary_name", "dec", "metric").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.count_if(F.col("value") == F.col("perfect_value")).alias("perfect_count"), F.count("value").alias("n"))
    return out.withColumn("pct", percent(F.col("perfect_count"), F.col("n")))
