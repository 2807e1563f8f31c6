"""Merging of freshly computed scores into a data set, by the slices that a recomputation covered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import strictly_finite

SLICE = ["opt_level", "project", "binary_name", "dec"]


def slices(keys: DataFrame) -> DataFrame:
    """Distinct slices of keys ``opt::project::binary::dec::function``; function names may hold ``::``."""
    part = F.split("key", "::", 5)
    return keys.select(*[part[i].alias(c) for i, c in enumerate(SLICE)]).distinct()


def keyed(overlay: DataFrame) -> DataFrame:
    """Overlay rows (key, ...) with the key's parts as columns."""
    part = F.split("key", "::", 5)
    return overlay.select(*[part[i].alias(c) for i, c in enumerate([*SLICE, "function_name"])], *[c for c in overlay.columns if c != "key"])


def _with_keys(data, rows: DataFrame) -> DataFrame:
    return rows.join(data.functions.select("fn_id", "project", "opt_level", "binary_name", "function_name"), "fn_id")


def overlay_ged(data, new: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Scores with graph distances replaced. new: key, value, perfect (null: value = 0).

    Covered slices are cleared, then rewritten, so an evaluated slice without entries loses its
    stale values. Others keep their finite ones.
    """
    new = keyed(new)
    covered = (new if covered is None else covered).select(*SLICE).distinct()
    old = _with_keys(data, data.obs.where("metric = 'ged'"))
    kept = old.join(covered, SLICE, "left_anti").where(strictly_finite(F.col("value"))).select(*data.obs.columns)
    keys = ["project", "opt_level", "binary_name", "function_name"]
    fresh = new.join(data.functions.select("fn_id", *keys), keys).join(F.broadcast(data.decs.select("dec")), "dec")
    fresh = fresh.select("fn_id", "dec", F.lit("ged").alias("metric"), F.col("value").cast("double").alias("value"), F.coalesce("perfect", F.col("value") == 0).alias("perfect"), F.col("value").cast("double").alias("distance"))
    rest = data.obs.where("metric <> 'ged'")
    has_other = kept.join(fresh.select("fn_id", "dec"), ["fn_id", "dec"], "left_anti")
    return rest.unionByName(has_other).unionByName(fresh)


def overlay_byte_match(data, new: DataFrame, add_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, attempts) with byte matches set where new, dropped in covered slices where not, else kept.

    new: key, value, compilable, dist. Only (function, tool) pairs with some score are touched. An
    entry without a distance clears the old one.
    """
    new = keyed(new)
    pairs = _with_keys(data, data.obs.select("fn_id", "dec").distinct())
    old = data.obs.where("metric = 'byte_match'")
    covered = new.select(*SLICE).distinct().withColumn("in_slice", F.lit(True))
    fresh = new.select(*SLICE, "function_name", F.col("value").cast("double").alias("v"), F.coalesce("compilable", F.lit(False)).alias("comp"), F.col("dist").cast("double").alias("d"))
    rows = pairs.join(fresh, [*SLICE, "function_name"], "left").join(covered, SLICE, "left")
    drop = F.col("v").isNull() & F.coalesce("in_slice", F.lit(False)) & F.lit(not add_only)
    state = rows.select("fn_id", "dec", "v", "d", "comp", drop.alias("drop"))
    both = state.join(old.select("fn_id", "dec", F.col("value").alias("ov"), F.col("perfect").alias("op"), F.col("distance").alias("od")), ["fn_id", "dec"], "left")
    merged = both.where(~F.col("drop") & (F.col("v").isNotNull() | F.col("ov").isNotNull()))
    is_new = F.col("v").isNotNull()
    merged = merged.select(
        "fn_id",
        "dec",
        F.lit("byte_match").alias("metric"),
        F.coalesce("v", "ov").alias("value"),
        F.when(is_new, F.col("v") >= 1).otherwise(F.col("op")).alias("perfect"),
        F.when(is_new, F.col("d")).otherwise(F.col("od")).alias("distance"),
    )
    flags = data.attempts.join(state.select("fn_id", "dec", "v", "comp", "drop"), ["fn_id", "dec"], "left")
    compiled = F.when(F.col("v").isNotNull(), F.col("comp")).when(F.col("drop"), F.lit(None)).otherwise(F.col("compiles"))
    attempts = flags.select("fn_id", "dec", "decompiled", compiled.alias("compiles"))
    return data.obs.where("metric <> 'byte_match'").unionByName(merged), attempts


def compile_tally(data, new: DataFrame) -> DataFrame:
    """Per tool how many merged entries compiled, of how many; tools without entries have zeros."""
    pairs = _with_keys(data, data.obs.select("fn_id", "dec").distinct())
    rows = pairs.join(keyed(new), [*SLICE, "function_name"]).groupBy("dec").agg(F.count_if(F.coalesce("compilable", F.lit(False))).alias("comp"), F.count(F.lit(1)).alias("tot"))
    return data.decs.select("dec").join(rows, "dec", "left").select("dec", F.coalesce("comp", F.lit(0)).cast("long").alias("comp"), F.coalesce("tot", F.lit(0)).cast("long").alias("tot"))


def overlay_type_match(data, new: DataFrame) -> DataFrame:
    """Scores with type matches upserted, never cleared. new: dec, key ``project::opt::binary::function``, value, dist."""
    part = F.split("key", "::", 4)
    keys = ["project", "opt_level", "binary_name", "function_name"]
    fresh = new.select("dec", *[part[i].alias(c) for i, c in enumerate(keys)], F.col("value").cast("double").alias("v"), F.col("dist").cast("double").alias("d"))
    fresh = fresh.join(data.functions.select("fn_id", *keys), keys).join(F.broadcast(data.decs.select("dec")), "dec").select("fn_id", "dec", "v", "d")
    old = data.obs.where("metric = 'type_match'")
    rows = old.join(fresh, ["fn_id", "dec"], "full").select(
        "fn_id", "dec", F.lit("type_match").alias("metric"), F.coalesce("v", "value").alias("value"), F.when(F.col("v").isNotNull(), F.col("v") >= 1).otherwise(F.col("perfect")).alias("perfect"), F.coalesce("d", "distance").alias("distance")
    )
    return data.obs.where("metric <> 'type_match'").unionByName(rows)


def merge_overlays(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Entries (dec, key, value, dist) of both; fresh ones win."""
    f = fresh.select("dec", "key", F.struct("value", "dist").alias("f"))
    e = existing.select("dec", "key", F.struct("value", "dist").alias("e"))
    return e.join(f, ["dec", "key"], "full").select("dec", "key", F.coalesce("f", "e").alias("x")).select("dec", "key", "x.value", "x.dist")
