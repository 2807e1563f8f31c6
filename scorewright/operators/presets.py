"""Preset membership, size distribution, large subset and manifests of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_arm

KEY = ["project", "opt_level", "binary_name", "function_name"]
SAMPLE_SET = "sample-set"


def large_threshold(functions: DataFrame, k: float = 1.0) -> DataFrame:
    """One row, ``cut``: mean plus k population deviations of all known sizes; null if none is known."""
    return functions.agg((F.avg("size") + k * F.stddev_pop("size")).alias("cut"))


def tag_presets(functions: DataFrame, sample: Column | None = None, k: float = 1.0) -> DataFrame:
    """Add ``datasets``: the presets by rule of optimisation level and size, and the pinned sample.

    Where a size or the threshold is missing, the label ``large`` decides.
    """
    rows = functions.crossJoin(F.broadcast(large_threshold(functions, k)))  # one row
    big = F.coalesce(F.col("size") >= F.col("cut"), F.array_contains("labels", "large"), F.lit(False))
    opt = F.col("opt_level")
    tags = F.array(
        F.when(opt == "O0", "unoptimized").when(opt == "O2", "inlined").when(opt == "O2-noinline", "optimized"),
        F.when((opt == "O2-noinline") & big, "large"),
        F.when(sample, SAMPLE_SET) if sample is not None else F.lit(None).cast("string"),
    )
    return rows.withColumn("datasets", F.array_compact(tags)).drop("cut")


def pin_sample(functions: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions with the manifest's members tagged, manifest keys that match no function)."""
    keys = manifest.select(*KEY).distinct()
    flagged = functions.join(keys.withColumn("_in", F.lit(True)), KEY, "left")
    without = F.array_remove("datasets", SAMPLE_SET)
    tagged = flagged.withColumn("datasets", F.when(F.col("_in"), F.array_append(without, F.lit(SAMPLE_SET))).otherwise(without)).drop("_in")
    return tagged.select(*functions.columns), keys.join(functions.select(*KEY), KEY, "left_anti")


def preset_counts(functions: DataFrame) -> DataFrame:
    rows = functions.select("project", "opt_level", "binary_name", F.explode("datasets").alias("preset"))
    return rows.groupBy("preset").agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("project", "opt_level", "binary_name").alias("binaries"))


def size_distribution(functions: DataFrame) -> DataFrame:
    """One row: count, mean, population deviation, extremes and exact linear percentiles; zeros if there are no sizes."""
    s = F.col("size").cast("double")
    p = lambda q: F.percentile(s, F.lit(q))
    stats = {"count": F.count("size"), "mean": F.avg(s), "std": F.stddev_pop(s), "min": F.min(s), "max": F.max(s)}
    stats |= {f"p{int(q * 100)}": p(q) for q in (0.5, 0.75, 0.9, 0.95, 0.99)}
    return functions.agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in stats.items()])


def large_subset(functions: DataFrame, method: str = "std", k: float = 1.0) -> DataFrame:
    """Functions of at least the threshold: mean and deviations, or the k-th percentile."""
    if method == "std":
        cut = large_threshold(functions, k)
    elif method == "percentile":
        cut = functions.agg(F.percentile(F.col("size").cast("double"), F.lit(k / 100)).alias("cut"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return functions.crossJoin(F.broadcast(cut)).where("size >= cut").drop("cut")  # one row


def restrict(functions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Only the manifest's functions; groups that lose all of theirs go with them."""
    return functions.join(manifest.select(*KEY).distinct(), KEY, "left_semi")


def diff_manifests(new: DataFrame, base: DataFrame, exclude: DataFrame) -> DataFrame:
    """Each key's fate: kept, dropped (excluded), missing (in the base only), added."""
    n, b, x = (d.select(*KEY).distinct().withColumn(f, F.lit(True)) for d, f in ((new, "_n"), (base, "_b"), (exclude, "_x")))
    rows = b.join(n, KEY, "full").join(x, KEY, "left")
    fate = F.when(F.col("_b") & F.col("_x"), "dropped").when(F.col("_b") & F.col("_n"), "kept").when(F.col("_b"), "missing").otherwise("added")
    return rows.select(*KEY, fate.alias("fate"))


def buckets(functions: DataFrame) -> DataFrame:
    """The sampler's overlapping buckets, in the order in which they draw."""
    arm = F.array_contains("datasets", "unoptimized") & is_arm(F.col("labels"))
    names = F.array(*[F.when(F.array_contains("datasets", b), b) for b in ("unoptimized", "optimized", "inlined", "large")], F.when(arm, "unoptimized-arm"))
    return functions.select("*", F.posexplode(names).alias("bucket_pos", "bucket")).where("bucket is not null")
