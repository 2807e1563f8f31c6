"""Scores of a tool's versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import base_name, version_key


def history_points(scores: DataFrame, overall: DataFrame, base: str) -> DataFrame:
    """(dec, version, metric, pct, overall) of ``base@version`` ids, in the order of version numbers."""
    rows = scores.where(F.startswith(F.col("dec"), F.lit(base + "@"))).select("dec", "metric", "pct")
    rows = rows.join(overall.select("dec", F.col("pct").alias("overall")), "dec")
    version = F.substring_index("dec", "@", -1)
    return rows.select(base_name(F.col("dec")).alias("dec"), version.alias("version"), "metric", "pct", "overall").orderBy(version_key(F.col("version")), "metric")


def coerce_points(raw: DataFrame) -> DataFrame:
    """Points of loose input (dec, version, date, metric, pct as text); rows without a number or a name are skipped."""
    rows = raw.withColumn("pct", F.col("pct").try_cast("double"))
    return rows.where("pct is not null and dec is not null and version is not null").select("dec", "version", "date", "metric", "pct")
