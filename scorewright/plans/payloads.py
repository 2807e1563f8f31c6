"""Tables as they are shown: ranked, pivoted and formatted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import percent


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of a table of one row per tool or project, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def leader_lines(leaders: DataFrame, k: int) -> DataFrame:
    """The first ``k`` tools as text."""
    rows = leaders.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pct"), "dec"))).where(F.col("rank") <= k)
    return rows.select("rank", "dec", "pct", F.format_string("%d. %s %.1f%%", "rank", "dec", "pct").alias("line"))


def leaderboard(union: DataFrame, decs: DataFrame, preset: str, normalize: int) -> DataFrame:
    """Tools by union percentage with places; tools of the sample only are shown on the sample set alone."""
    rows = union.where((F.col("preset") == preset) & (F.col("normalize") == normalize)).join(F.broadcast(decs), "dec")
    if preset != "sample-set":
        rows = rows.where(~F.col("sample_only"))
    rows = rows.select("dec", percent(F.col("num"), F.col("den")).alias("pct"), "pos")
    return placed(rows, [F.desc("pct"), F.col("pos")]).drop("pos")


def metrics_table(counts: DataFrame, preset: str, normalize: int, metrics: list[str]) -> DataFrame:
    """One row per tool, a column for each metric's percentage."""
    rows = counts.where((F.col("preset") == preset) & (F.col("normalize") == normalize)).withColumn("pct", F.round(percent(F.col("num"), F.col("den")), 6))
    return rows.groupBy("dec").pivot("metric", metrics).agg(F.first("pct"))


def distance_table(stats: DataFrame, decs: DataFrame, preset: str, normalize: int) -> DataFrame:
    """Mean distances with a mark at the best of the main tools, per metric."""
    rows = stats.where((F.col("preset") == preset) & (F.col("normalize") == normalize)).join(F.broadcast(decs), "dec")
    best = F.min(F.when(~F.col("sample_only"), F.col("mean"))).over(Window.partitionBy("metric"))
    return rows.select("dec", "metric", "mean", (~F.col("sample_only") & (F.col("mean") <= best + 1e-9)).alias("best"))
