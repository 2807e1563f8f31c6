"""Relational parts of acquisition: which functions of a binary are decompiled, and under which names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Functions of the C runtime that are never scored, and prefixes of import stubs.
RUNTIME = (
    "_start", "__libc_start_main", "__libc_csu_init", "__libc_csu_fini", "_init", "_fini", "__do_global_dtors_aux", "register_tm_clones", "deregister_tm_clones",
    "frame_dummy", "__libc_start_call_main", "_dl_relocate_static_pie", "__gmon_start__", "__stack_chk_fail",
)
STUBS = ("thunk_", "j_", "__imp_", ".plt", "_dl_")


def in_text(addr: Column, lo: Column, hi: Column) -> Column:
    """Inside the code section; true where it isn't known."""
    return F.coalesce((addr >= lo) & (addr < hi), F.lit(True))


def skipped(name: Column, addr: Column, lo: Column, hi: Column) -> Column:
    """Nameless and runtime functions; outside the code section; by prefix only where the section isn't known."""
    stub = F.lit(False)
    for p in STUBS:
        stub = stub | name.startswith(p)
    return name.isNull() | (name == "") | name.isin(*RUNTIME) | F.when(lo.isNotNull(), ~in_text(addr, lo, hi)).otherwise(stub)


def narrow_to_source(found: DataFrame, targets: DataFrame) -> DataFrame:
    """found: binary, name, addr. Only functions at a target address, but for a Thumb bit; all of a binary if none is."""
    keys = targets.select("binary", F.shiftright("addr", 1).alias("_a")).distinct().withColumn("_hit", F.lit(True))
    rows = found.withColumn("_a", F.shiftright("addr", 1)).join(keys, ["binary", "_a"], "left")
    some = F.max(F.coalesce("_hit", F.lit(False))).over(Window.partitionBy("binary"))
    return rows.withColumn("_some", some).where(~F.col("_some") | F.col("_hit")).select(*found.columns)


def missing_targets(found: DataFrame, targets: DataFrame) -> DataFrame:
    """targets: binary, addr, lo, hi. Those that analysis did not find, in the code section and not 0."""
    seen = found.select("binary", F.shiftright("addr", 1).alias("_a")).distinct()
    rows = targets.where((F.col("addr") != 0) & in_text(F.col("addr"), F.col("lo"), F.col("hi"))).withColumn("_a", F.shiftright("addr", 1))
    return rows.join(seen, ["binary", "_a"], "left_anti").select("binary", "addr").distinct().orderBy("binary", "addr")


def relabel(found: DataFrame, names: DataFrame, base: int = 0) -> DataFrame:
    """found: binary, name, addr, code; names: binary, addr, true_name. Names by address: as it is, without Thumb bit, moved by ``base``; of two with one name the longer code stays."""
    tries = F.array(F.col("addr"), F.col("addr").bitwiseAND(F.lit(~1)), F.col("addr") + base, (F.col("addr") + base).bitwiseAND(F.lit(~1)))
    rows = found.withColumn("_id", F.struct("binary", "addr", "name")).select("*", F.posexplode(tries).alias("_p", "_t"))
    named = rows.join(names.select("binary", F.col("addr").alias("_t"), "true_name"), ["binary", "_t"], "left")
    best = named.groupBy("_id", "binary", "name", "addr", "code").agg(F.min_by("true_name", F.when(F.col("true_name").isNotNull(), F.col("_p"))).alias("true_name"))
    best = best.withColumn("name", F.coalesce("true_name", "name"))
    w = Window.partitionBy("binary", "name").orderBy(F.desc(F.length("code")), F.desc("addr"))
    return best.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("binary", "name", "addr", "code")


def agent_targets(explicit: DataFrame, by_address: DataFrame, symbols: DataFrame, cap: int | None = None) -> DataFrame:
    """(binary, name, addr): explicit targets of a binary, else those by address, else its symbols; the first ``cap`` by address."""
    rows = explicit.withColumn("p", F.lit(0)).unionByName(by_address.withColumn("p", F.lit(1))).unionByName(symbols.withColumn("p", F.lit(2)))
    rows = rows.withColumn("_m", F.min("p").over(Window.partitionBy("binary"))).where("p = _m")
    if cap:
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("binary").orderBy("addr", "name"))).where(F.col("_r") <= cap)
    return rows.select("binary", "name", "addr")


def status_counts(runs: DataFrame) -> DataFrame:
    """Binaries by outcome of their decompilation."""
    return runs.groupBy("dec", "status").agg(F.count(F.lit(1)).alias("n"))


def line_addresses(rows: DataFrame) -> DataFrame:
    """(function_name, line, sorted distinct addresses)."""
    return rows.groupBy("function_name", "line").agg(F.array_sort(F.collect_set("addr")).alias("addrs"))


def shard(rows: DataFrame, parts: int) -> DataFrame:
    """Addresses dealt in turn to ``parts`` workers, per binary."""
    return rows.withColumn("part", (F.row_number().over(Window.partitionBy("binary").orderBy("addr")) - 1) % parts)
