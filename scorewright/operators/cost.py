"""Time and token costs of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decompile_times(runs: DataFrame) -> DataFrame:
    """runs: dec, total_time, function_count. Amortised mean is all time over all functions; the median is that of each binary's rate."""
    ok = runs.where("total_time > 0 and function_count > 0")
    rate = F.col("total_time") / F.col("function_count")
    total, n = F.sum("total_time"), F.sum("function_count")
    return ok.groupBy("dec").agg(total.alias("total_s"), n.alias("functions"), F.count(F.lit(1)).alias("binaries"), (total / n).alias("per_fn_mean_s"), F.median(rate).alias("per_fn_median_s"))


def assistant_tokens(records: DataFrame) -> DataFrame:
    """Token sums of sessions whose every assistant record has its own usage.

    records: session, type, input, cached_input, cache_write, cache_write_parts. The total of cache writes wins; its parts are only summed without it.
    """
    zero = F.lit(0)
    parts = F.aggregate(F.coalesce("cache_write_parts", F.array().cast("array<bigint>")), zero.cast("bigint"), lambda a, x: a + F.coalesce(x, zero))
    s = lambda c, n: F.sum(F.coalesce(c, zero)).alias(n)
    return records.where("type = 'assistant'").groupBy("session").agg(s("input", "input"), s("cached_input", "cached_input"), F.sum(F.coalesce(F.col("cache_write"), parts)).alias("cache_write"), s("output", "output"))


def running_tokens(records: DataFrame) -> DataFrame:
    """Tokens of sessions with running totals: the last record. records: session, line, input, cached_input, output. Cached input is part of the input."""
    last = records.groupBy("session").agg(F.max_by(F.struct("input", "cached_input", "output"), "line").alias("x"))
    return last.select("session", F.greatest(F.col("x.input") - F.col("x.cached_input"), F.lit(0)).alias("input"), "x.cached_input", F.lit(0).cast("bigint").alias("cache_write"), "x.output")


def llm_costs(calls: DataFrame) -> DataFrame:
    """calls: dec, model, status, elapsed_s, input, cached_input, cache_write, output (null tokens: not recorded). Elapsed statistics and token sums by tool."""
    tokens = [F.sum(c).alias(c) for c in ("input", "cached_input", "cache_write", "output")]
    return calls.groupBy("dec").agg(
        F.max("model").alias("model"),
        F.count(F.lit(1)).alias("functions"),
        F.count_if(F.col("status") != "ok").alias("failed"),
        F.avg("elapsed_s").alias("mean_s"),
        F.median("elapsed_s").alias("median_s"),
        F.sum("elapsed_s").alias("total_s"),
        *tokens,
        F.count("input").alias("sessions"),
    )


def dollars(costs: DataFrame, prices: DataFrame) -> DataFrame:
    """Estimated price of the tokens: null for an unknown or unpriced model, or without tokens. prices: per million tokens."""
    p = ("input", "cached_input", "cache_write", "output")
    card = prices.select(F.col("model").alias("p_model"), *[F.col(c).alias(f"p_{c}") for c in p])
    rows = costs.join(F.broadcast(card), costs["model"] == F.col("p_model"), "left")
    priced = F.greatest(*[F.col(f"p_{c}") for c in p]) > 0
    total = sum((F.coalesce(F.col(c), F.lit(0)) * F.col(f"p_{c}") for c in p), F.lit(0.0)) / 1e6
    total = F.when(priced & (F.col("sessions") > 0), total)
    per = F.when(F.col("functions") > 0, total / F.col("functions")).when(total.isNotNull(), F.lit(0.0))
    return rows.select(costs["dec"], costs["model"], total.alias("total"), per.alias("per_function"))


def cost_block(batch: DataFrame, llm: DataFrame, decs: DataFrame) -> DataFrame:
    """One row for each visible tool with cost facts; per-function timing of an agent wins over batch timing."""
    b = batch.select("dec", F.struct(F.col("per_fn_mean_s").alias("mean_s"), F.col("per_fn_median_s").alias("median_s"), F.col("functions").cast("long").alias("n_functions"), F.col("binaries").cast("long").alias("n_binaries"), F.lit("batch").alias("basis")).alias("b"))
    a = llm.select("dec", F.struct("mean_s", "median_s", F.col("functions").cast("long").alias("n_functions"), F.lit(None).cast("long").alias("n_binaries"), F.lit("per-function").alias("basis")).alias("a"))
    rows = b.join(a, "dec", "full").join(F.broadcast(decs.select("dec")), "dec", "left_semi")
    return rows.select("dec", F.coalesce("a", "b").alias("x")).select("dec", "x.*")
