"""Samples of functions with their code, for a report: by difficulty, of the sample set, and what is withheld."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import finite


def with_code(functions: DataFrame, code: DataFrame) -> DataFrame:
    """``functions`` (fn_id, ...) that some tool has code for, with a map ``code`` by tool. code: fn_id, dec, text."""
    maps = code.where("text is not null").groupBy("fn_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dec", "text")))).alias("code"))  # a row for each tool
    return functions.join(maps, "fn_id")


def tiered(candidates: DataFrame, code: DataFrame, per_tier: int) -> DataFrame:
    """The first ``per_tier`` candidates (fn_id, tier, place) of each tier that have code, with it."""
    rows = with_code(candidates, code)
    first = F.row_number().over(Window.partitionBy("tier").orderBy("place", "fn_id"))
    return rows.withColumn("r", first).where(F.col("r") <= per_tier).drop("r")


def sample_set(functions: DataFrame, code: DataFrame, source: DataFrame) -> DataFrame:
    """Every function of the sample set with code, beside its source (fn_id, source, status) or why there is none."""
    rows = with_code(functions.where(F.array_contains("datasets", "sample-set")), code)
    return rows.join(source, "fn_id", "left").withColumn("status", F.coalesce("status", F.lit("binary_not_found")))


def finite_values(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows of samples without values that no document of JSON can hold."""
    return rows.where(finite(F.col(value)))


def head(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; all of them where ``n`` is 0."""
    if not n:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def seeded(rows: DataFrame, group: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group as a hash of ``seed`` and ``key`` deals them: the same ones on every run."""
    deal = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return head(rows, group, [deal, F.col(key)], n)


def allowed(rows: DataFrame, manifest: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose function the manifest names."""
    return rows.join(manifest.select(*by, "function_name").distinct(), [*by, "function_name"], "left_semi")
