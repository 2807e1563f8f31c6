"""Coverage counters, the guard against shrinking, and the audit of slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import base_name, strictly_finite

GROUP = ["project", "opt_level", "binary_name"]
SLICE = [*GROUP, "dec"]


def coverage_counts(data) -> DataFrame:
    """(group, counter, n): functions; finite values by ``dec::metric``; decompiled flags by ``dec::decompiled``. Perfect flags don't count."""
    group = F.concat_ws("::", *GROUP).alias("group_key")
    fn = data.functions.select("fn_id", group)
    scored = data.obs.where(strictly_finite(F.col("value")) & F.col("value").isNotNull()).select("fn_id", F.concat_ws("::", "dec", "metric").alias("counter"))
    flagged = data.attempts.where("decompiled").select("fn_id", F.concat(F.col("dec"), F.lit("::decompiled")).alias("counter"))
    rows = fn.join(scored.unionByName(flagged), "fn_id").unionByName(fn.withColumn("counter", F.lit("functions")), allowMissingColumns=True)
    return rows.groupBy("group_key", "counter").agg(F.count(F.lit(1)).alias("n"))


def regressions(old: DataFrame, new: DataFrame, allowed_projects: list[str] = (), allowed_decs: list[str] = ()) -> DataFrame:
    """Counters that shrank, but for allowed projects and tools."""
    rows = old.join(new.withColumnRenamed("n", "new_n"), ["group_key", "counter"], "left").withColumn("new_n", F.coalesce("new_n", F.lit(0)))
    rows = rows.where((F.col("new_n") < F.col("n")) & ~F.substring_index("group_key", "::", 1).isin(*allowed_projects))
    rows = rows.where(~(F.contains(F.col("counter"), F.lit("::")) & F.substring_index("counter", "::", 1).isin(*allowed_decs)))
    return rows.select("group_key", "counter", F.col("n").alias("old_n"), "new_n")


def regression_report(shrunk: DataFrame, cap: int = 100) -> DataFrame:
    """Regressions by group and tool, largest loss first."""
    rows = shrunk.groupBy("group_key", F.substring_index("counter", "::", 1).alias("dec")).agg(F.sum("old_n").alias("old_n"), F.sum("new_n").alias("new_n"), F.count(F.lit(1)).alias("counters"))
    return rows.orderBy(F.desc(F.col("old_n") - F.col("new_n")), "group_key", "dec").limit(cap)


class CoverageError(RuntimeError):
    """A write would drop coverage."""


def guard(old: DataFrame, new: DataFrame, allowed_projects=(), allowed_decs=(), allow_drops: bool = False) -> None:
    """Raise if any counter of ``old`` shrinks in ``new``."""
    shrunk = regressions(old, new, allowed_projects, allowed_decs)
    worst = regression_report(shrunk, 10).collect()
    if worst and not allow_drops:
        raise CoverageError("; ".join(f"{r.group_key} {r.dec}: {r.old_n} -> {r.new_n}" for r in worst))


def audit(checkpoint: DataFrame, artifacts: DataFrame, overlay: DataFrame, published: DataFrame, published_rows: DataFrame, agents: list[str] = (), manifest: DataFrame | None = None) -> DataFrame:
    """Slices whose layers disagree, with the first kind that fits.

    checkpoint, artifacts: (slice, function_name), plus slices with a null name for none at all;
    overlay, published: (slice, function_name) with values; published_rows: all rows (group, function_name).
    Agents are only looked at on the manifest's slices.
    """
    rows = published_rows.select(*GROUP, "function_name").distinct()
    groups = rows.select(*GROUP).distinct().withColumn("has_group", F.lit(True))
    here = rows.withColumn("known", F.lit(True))

    def layer(df: DataFrame, name: str) -> DataFrame:
        named = df.select(*SLICE, "function_name").distinct().join(here, [*GROUP, "function_name"], "left")
        return named.groupBy(*SLICE).agg(F.count("function_name").alias(f"all_{name}"), F.count_if(F.coalesce("known", F.lit(False))).alias(name))

    base = layer(checkpoint, "ckpt").withColumn("opt", F.col("opt_level"))
    sibling = Window.partitionBy("project", "binary_name", "dec")
    base = base.withColumn("sibling_ok", F.sum((F.col("all_ckpt") > 0).cast("int")).over(sibling) - (F.col("all_ckpt") > 0).cast("int") > 0)
    count = lambda df, n: df.groupBy(*SLICE).agg(F.count("function_name").alias(n))
    out = base.join(layer(artifacts, "art"), SLICE, "left").join(count(overlay, "ov"), SLICE, "left").join(count(published, "pub"), SLICE, "left").join(groups, GROUP, "left")
    out = out.fillna(0, ["all_art", "art", "ov", "pub"])
    decs = published.select("dec").distinct()
    exact, base = decs.withColumn("_exact", F.lit(True)), decs.select(F.col("dec").alias("_name"), F.lit(True).alias("_base"))
    out = out.join(exact, "dec", "left").withColumn("_name", base_name(F.col("dec"))).join(base, "_name", "left").where("_exact or _base")
    if agents:
        on = manifest.select(*GROUP).distinct() if manifest is not None else groups.select(*GROUP).limit(0)
        out = out.join(on.withColumn("on_slice", F.lit(True)), GROUP, "left").where(~base_name(F.col("dec")).isin(*agents) | F.col("on_slice"))
    least = F.when((F.col("ckpt") > 0) & (F.col("art") > 0), F.least("ckpt", "art")).otherwise(F.greatest("ckpt", "art"))
    kind = (
        F.when(F.col("has_group").isNull(), F.when((F.col("all_ckpt") > 0) | (F.col("all_art") > 0), "SILENT-DROP"))
        .when((F.col("pub") == 0) & (F.col("ov") > 0), "SILENT-DROP")
        .when((F.col("all_ckpt") == 0) & (F.col("all_art") == 0) & F.col("sibling_ok"), "DECOMPILE-FAILURE")
        .when((F.col("ov") == 0) & (F.col("ckpt") > 0) & (F.col("art") > 0), "OVERLAY-GAP")
        .when((F.col("pub") > 0) & (F.col("pub") < 0.5 * least), "PARTIAL")
    )
    found = F.when(F.col("has_group").isNull(), F.col("all_ckpt")).otherwise(F.col("ckpt"))
    marked = F.when(F.col("has_group").isNull(), F.col("all_art")).otherwise(F.col("art"))
    return out.select(kind.alias("kind"), *SLICE, found.alias("ckpt"), marked.alias("art"), "ov", "pub").where("kind is not null")
