"""What was benchmarked: projects, categories, totals, and the health of the source front end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import decompiled_by


def project_rollup(functions: DataFrame, groups: DataFrame) -> DataFrame:
    """Per project its labels, distinct binaries, builds, functions and presets.

    groups: project, opt_level, binary_name, labels; groups without functions count. Groups and
    functions are summed apart, so neither multiplies the other.
    """
    g = groups.groupBy("project").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), F.countDistinct("binary_name").alias("binaries"), F.count(F.lit(1)).alias("builds"))
    f = functions.groupBy("project").agg(F.count(F.lit(1)).alias("functions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("datasets")))).alias("presets"))
    return g.join(f, "project", "left").select("project", "labels", "binaries", "builds", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("presets", F.array().cast("array<string>")).alias("presets"))


def category_counts(rollup: DataFrame, categories: DataFrame) -> DataFrame:
    """Projects of each category: any of its labels on any of the project's binaries. categories: pos, name, labels."""
    rows = rollup.select("project", F.explode("labels").alias("label")).join(F.broadcast(categories.select("name", F.explode("labels").alias("label"))), "label")
    n = rows.groupBy("name").agg(F.countDistinct("project").alias("n"))
    return categories.join(n, "name", "left").select("pos", "name", F.coalesce("n", F.lit(0)).alias("n"))


def summary(rollup: DataFrame) -> DataFrame:
    """One row of totals. Binaries are distinct within a project, not over projects."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rollup.agg(F.count(F.lit(1)).alias("projects"), s("binaries").alias("unique_binaries"), s("builds").alias("builds"), s("functions").alias("functions"))


def source_loss(facts: DataFrame, decs: list[str]) -> DataFrame:
    """(lost, total): functions that some tool decompiled, and those of them whose source has no graph."""
    tried = F.lit(False)
    for d in decs:
        tried = tried | decompiled_by(d)
    parsed = F.array_contains("measurable", "ged")
    return facts.where(tried).agg(F.count_if(~parsed).alias("lost"), F.count(F.lit(1)).alias("total"))


def output_failures(facts: DataFrame, decs: list[str]) -> DataFrame:
    """(dec, failed, scope): of functions with a source graph that the tool decompiled, those without its graph distance."""
    rows = facts.where(F.array_contains("measurable", "ged"))
    flags = F.array(*[F.struct(F.lit(d).alias("dec"), decompiled_by(d).alias("tried")) for d in decs])
    rows = rows.select("obs", F.inline(flags)).where("tried")
    has = F.exists("obs", lambda o: (o["dec"] == F.col("dec")) & (o["metric"] == "ged"))
    return rows.groupBy("dec").agg(F.count_if(~has).alias("failed"), F.count(F.lit(1)).alias("scope"))


def by_size(rollup: DataFrame, loc: DataFrame) -> DataFrame:
    """Projects by lines of code, largest first, then by name."""
    rows = rollup.join(loc, "project", "left").withColumn("loc", F.coalesce("loc", F.lit(0)))
    return rows.orderBy(F.desc("loc"), "project")


def sampled_tiers(samples: DataFrame, tier: str | None, text: str) -> DataFrame:
    """Samples of a tier whose function, binary or project contains ``text``, whatever its case, with how many the tier has."""
    of = samples if tier is None else samples.where(F.col("tier") == tier)
    total = of.count()
    like = F.lit(False)
    for c in ("function_name", "binary_name", "project"):
        like = like | F.contains(F.lower(c), F.lit(text.lower()))
    return of.where(like).withColumn("tier_total", F.lit(total).cast("long"))
