"""Hiding tools and withholding code of malware."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import hidden


def strip(data, names: list[str]):
    """The data set without some tools, in every table; exact ids only."""
    out = lambda df: df.where(~F.col("dec").isin(*names))
    return data.having(obs=out(data.obs), attempts=out(data.attempts), decs=out(data.decs))


def hide(data, names: list[str]):
    """The data set without tools whose id or base name is hidden: no scores and no decompiled flags; compile flags stay in the records."""
    shown = ~hidden(F.col("dec"), names)
    attempts = data.attempts.withColumn("decompiled", F.when(shown, F.col("decompiled"))).where(shown | F.col("compiles").isNotNull())
    return data.having(obs=data.obs.where(shown), attempts=attempts, decs=data.decs.where(shown))


def hide_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows by tool (scoreboard, hardest cases, history) without hidden tools."""
    return rows.where(~hidden(F.col("dec"), names))


def hide_samples(samples: DataFrame, names: list[str]) -> DataFrame:
    """``samples`` without hidden tools' code (a map ``code`` by tool, and other maps by tool); those left without any code go."""
    shown = lambda k, _: ~hidden(k, names)
    by_tool = [f.name for f in samples.schema.fields if f.dataType.typeName() == "map"]
    return samples.withColumns({c: F.map_filter(c, shown) for c in by_tool}).where(F.size("code") > 0)


def malware_projects(functions: DataFrame, registered: DataFrame) -> DataFrame:
    """Projects with a group labelled malware, or registered as malware (project, is_malware)."""
    labelled = functions.where(F.array_contains("labels", "malware")).select("project")
    return labelled.unionByName(registered.where("is_malware").select("project")).distinct()


def drop_malware(entries: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of other projects, dropped counts by project). Only code is withheld; scores still count."""
    gone = entries.join(projects, "project", "left_semi").groupBy("project").agg(F.count(F.lit(1)).alias("dropped"))
    return entries.join(projects, "project", "left_anti"), gone
