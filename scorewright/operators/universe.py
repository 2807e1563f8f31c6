"""The function universe: which functions exist, who decompiled them, their sizes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import placeholder

GROUP = ["project", "opt_level", "binary_name"]
KEY = [*GROUP, "function_name"]


def universe(scored: DataFrame, decompiled: DataFrame, failed: DataFrame) -> DataFrame:
    """Names with a score, with output, or that explicitly failed; placeholders only with a score.

    scored, decompiled, failed: (key, dec). A failed name ``all`` names no function.
    """
    tried = decompiled.select(*KEY).unionByName(failed.where("function_name <> 'all'").select(*KEY)).where(~placeholder(F.col("function_name")))
    return scored.select(*KEY).unionByName(tried).distinct()


def attempts(names: DataFrame, runs: DataFrame, scored: DataFrame, decompiled: DataFrame, failed: DataFrame) -> DataFrame:
    """(key, dec, decompiled) for every function and tool that ran on its binary.

    runs: (group, dec, slice_scoped). A tool that failed on ``all`` produced nothing; a score implies
    output. A slice-scoped tool that never tried a function has no flag at all.
    """
    flag = lambda df, n: df.select(*KEY, "dec").distinct().withColumn(n, F.lit(True))
    broken = failed.where("function_name = 'all'").select(*GROUP, "dec").distinct().withColumn("broken", F.lit(True))
    rows = names.join(runs.select(*GROUP, "dec", "slice_scoped"), GROUP)
    rows = rows.join(flag(scored, "has_score"), [*KEY, "dec"], "left").join(flag(decompiled, "has_code"), [*KEY, "dec"], "left")
    rows = rows.join(flag(failed.where("function_name <> 'all'"), "tried"), [*KEY, "dec"], "left").join(broken, [*GROUP, "dec"], "left")
    no = F.lit(False)
    ok = F.coalesce("has_code", no) & ~F.coalesce("broken", no)
    score = F.coalesce("has_score", no)
    never = F.col("slice_scoped") & ~ok & ~score & ~F.coalesce("tried", no)
    return rows.where(~never).select(*KEY, "dec", (ok | score).alias("decompiled"))


def representative_size(lines: DataFrame) -> DataFrame:
    """(key, size): line count of the first tool, in the run's order, that has the function. lines: key, pos, line_count."""
    return lines.groupBy(*KEY).agg(F.min_by("line_count", "pos").alias("size"))


def with_unevaluated(evaluated: DataFrame, decompiled: DataFrame) -> DataFrame:
    """Groups that were evaluated or decompiled, with which of the two."""
    e = evaluated.select(*GROUP).distinct().withColumn("evaluated", F.lit(True))
    d = decompiled.select(*GROUP).distinct().withColumn("decompiled", F.lit(True))
    no = F.lit(False)
    return e.join(d, GROUP, "full").select(*GROUP, F.coalesce("evaluated", no).alias("evaluated"), F.coalesce("decompiled", no).alias("decompiled"))
