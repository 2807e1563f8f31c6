"""Facts of each function that no preset changes, and the counts of every preset and gate in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import finite, percent
from .presets import SAMPLE_SET

GROUP = ["project", "opt_level", "binary_name"]


def measurable(obs: DataFrame) -> DataFrame:
    """(fn_id, metric) of what some tool has a finite value for. What nobody can measure leaves everyone's denominator."""
    return obs.where(finite(F.col("value"))).select("fn_id", "metric").distinct()


def function_facts(data) -> DataFrame:
    """One row per function: its group and presets, its scores and attempts as arrays, the measurable metrics and the two gates.

    Scores and attempts are grouped by function once; all tables below read the arrays.
    """
    cells = data.obs.groupBy("fn_id").agg(F.collect_list(F.struct("dec", "metric", "value", "perfect", "distance")).alias("obs"))
    tries = data.attempts.groupBy("fn_id").agg(F.collect_list(F.struct("dec", "decompiled", "compiles")).alias("attempts"))
    rows = data.functions.join(cells, "fn_id", "left").join(tries, "fn_id", "left")
    rows = rows.withColumn("obs", F.coalesce("obs", F.array().cast(cells.schema["obs"].dataType)))
    rows = rows.withColumn("attempts", F.coalesce("attempts", F.array().cast(tries.schema["attempts"].dataType)))
    seen = F.transform(F.filter("obs", lambda o: finite(o["value"])), lambda o: o["metric"])
    rows = rows.withColumn("measurable", F.array_distinct(seen))
    every = [r["dec"] for r in data.decs.orderBy("pos").collect()]  # the registry of tools
    full = [r["dec"] for r in data.decs.where(~F.col("sample_only")).collect()]
    return rows.withColumn("gate_all", _all_decompiled(every)).withColumn("gate_full", _all_decompiled(full))


def decompiled_by(dec: str) -> Column:
    """The attempt's flag; without one, whether the tool has any score."""
    flag = F.get(F.filter("attempts", lambda a: a["dec"] == dec), F.lit(0))["decompiled"]
    return F.coalesce(flag, F.exists("obs", lambda o: o["dec"] == dec))


def _all_decompiled(decs: list[str]) -> Column:
    out = F.lit(True)
    for d in decs:
        out = out & decompiled_by(d)
    return out


def active(facts: DataFrame, presets: bool = True) -> DataFrame:
    """``facts`` once for each (preset, normalize) that it is active under.

    normalize = 1 asks that every tool whose row the preset shows decompiled the function: all of
    them on the sample set, elsewhere those that cover everything. Without presets: ``__all__``.
    """
    names = F.col("datasets") if presets else F.array(F.lit("__all__"))
    rows = facts.withColumn("preset", F.explode(names))
    gate = F.when(F.col("preset") == SAMPLE_SET, F.col("gate_all")).otherwise(F.col("gate_full"))
    return rows.withColumn("normalize", F.explode(F.when(gate, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def _event(kind: str, dec: Column | None = None, metric: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if dec is None else dec).alias("dec"), (none if metric is None else metric).alias("metric"))


def combo_counts(facts: DataFrame, presets: bool = True) -> DataFrame:
    """(preset, normalize, kind, dec, metric, n): all counts of all tables, from one grouped pass.

    Kinds: function; measurable (metric); perfect (dec, metric); any (some metric is measurable);
    union (dec: perfect on a measurable metric); scope and errored (dec); compile and compiled (dec).
    Denominators that all tools share are counted once, not once a tool.
    """
    good = F.filter("obs", lambda o: o["perfect"] & F.array_contains("measurable", o["metric"]))
    scored = F.filter("obs", lambda o: (o["metric"] == "byte_match") & o["value"].isNotNull())
    built = lambda d: F.exists("attempts", lambda a: (a["dec"] == d) & F.coalesce(a["compiles"], F.lit(False)))
    events = F.concat(
        F.array(_event("function")),
        F.transform("measurable", lambda m: _event("measurable", metric=m)),
        F.transform(good, lambda o: _event("perfect", o["dec"], o["metric"])),
        F.when(F.size("measurable") > 0, F.array(_event("any"))).otherwise(F.array().cast("array<struct<kind:string,dec:string,metric:string>>")),
        F.transform(F.array_distinct(F.transform(good, lambda o: o["dec"])), lambda d: _event("union", d)),
        F.transform(F.filter("attempts", lambda a: a["decompiled"].isNotNull()), lambda a: _event("scope", a["dec"])),
        F.transform(F.filter("attempts", lambda a: ~a["decompiled"]), lambda a: _event("errored", a["dec"])),
        F.transform(scored, lambda o: _event("compile", o["dec"])),
        F.transform(F.filter(scored, lambda o: built(o["dec"])), lambda o: _event("compiled", o["dec"])),
    )
    rows = active(facts, presets).select("preset", "normalize", F.inline(events))
    return rows.groupBy("preset", "normalize", "kind", "dec", "metric").agg(F.count(F.lit(1)).alias("n"))


def _pair(counts: DataFrame, decs: DataFrame, over: str, part: str, by: list[str], shared: bool) -> DataFrame:
    """num and den by combo: den from kind ``over`` (shared by all tools, or by tool), num from ``part``."""
    combo = ["preset", "normalize"]
    den = counts.where(F.col("kind") == over).select(*combo, *(c for c in by if c != "dec" or not shared), F.col("n").alias("den"))
    if shared:
        den = den.crossJoin(F.broadcast(decs.select("dec")))  # a row for each combo times a row for each tool
    num = counts.where(F.col("kind") == part).select(*combo, *by, F.col("n").alias("num"))
    return den.join(num, [*combo, *by], "left").select(*combo, *by, F.coalesce("num", F.lit(0)).cast("long").alias("num"), "den")


def per_metric(counts: DataFrame, decs: DataFrame) -> DataFrame:
    return _pair(counts, decs, "measurable", "perfect", ["dec", "metric"], shared=True)


def union(counts: DataFrame, decs: DataFrame) -> DataFrame:
    """Share of functions perfect on at least one measurable metric."""
    return _pair(counts, decs, "any", "union", ["dec"], shared=True)


def errors(counts: DataFrame, decs: DataFrame) -> DataFrame:
    """Errored over attempted: only functions for which the tool has a flag."""
    return _pair(counts, decs, "scope", "errored", ["dec"], shared=False)


def compiles(counts: DataFrame, decs: DataFrame) -> DataFrame:
    """Recompiled over measured for recompilation, by tool."""
    return _pair(counts, decs, "compile", "compiled", ["dec"], shared=False)


def combo_sizes(facts: DataFrame, presets: bool = True) -> DataFrame:
    """Functions and binaries with an active function."""
    return active(facts, presets).groupBy("preset", "normalize").agg(F.count(F.lit(1)).alias("functions"), F.countDistinct(*GROUP).alias("binaries"))


def distance_stats(facts: DataFrame, presets: bool = True) -> DataFrame:
    """mean, upper-middle median, n and at0 of each tool's own finite distances. No denominator is shared.

    The median is the element at n div 2 of the sorted distances. It is found from counts by value,
    not from lists of all distances.
    """
    ok = F.filter("obs", lambda o: o["distance"].isNotNull() & finite(o["distance"]))
    rows = active(facts, presets).select("preset", "normalize", F.inline(ok)).select("preset", "normalize", "dec", "metric", "distance")
    by = ["preset", "normalize", "dec", "metric"]
    valued = rows.groupBy(*by, "distance").agg(F.count(F.lit(1)).alias("k"))
    every = Window.partitionBy(*by)
    valued = valued.withColumns({"n": F.sum("k").over(every), "upto": F.sum("k").over(every.orderBy("distance"))})
    middle = F.floor(F.col("n") / 2)
    at = F.when((F.col("upto") - F.col("k") <= middle) & (middle < F.col("upto")), F.col("distance"))
    return valued.groupBy(*by).agg(
        (F.sum(F.col("distance") * F.col("k")) / F.sum("k")).alias("mean"),
        F.max(at).alias("median"),
        F.sum("k").alias("n"),
        F.sum(F.when(F.col("distance") == 0, F.col("k")).otherwise(0)).alias("at0"),
    )


def union_leaders(counts: DataFrame, decs: DataFrame, preset: str, drop_sample_only: bool) -> DataFrame:
    """Tools by union percentage; ties by id. Tools with nothing measurable are left out."""
    rows = union(counts, decs).where((F.col("preset") == preset) & (F.col("normalize") == 0) & (F.col("den") > 0))
    rows = rows.join(F.broadcast(decs), "dec")
    if drop_sample_only:
        rows = rows.where(~F.col("sample_only"))
    return rows.select("dec", percent(F.col("num"), F.col("den")).alias("pct")).orderBy(F.desc("pct"), "dec")
