"""What a site shows around the scores: registries, presets, orders and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import base_name, percent

#: Place of what no registry orders: after everything that one does.
LAST = 1_000_000_000


def combo_key(preset: Column, normalize: Column) -> Column:
    return F.concat_ws("|", preset, normalize.cast("string"))


def preset_texts(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, title, description, pos): the registry's text wins, else the stored one, else the name. Both: name, title, description."""
    r = registry.select("name", F.col("title").alias("r_title"), F.col("description").alias("r_description"))
    rows = stored.join(r, "name", "left")
    return rows.select("name", F.coalesce("r_title", "title", "name").alias("title"), F.coalesce("r_description", "description", F.lit("")).alias("description"), "pos")


def default_preset(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """One row (name): the first preset of the run that the registry flags as default, else the run's first."""
    flagged = registry.where("is_default").select("name", F.lit(True).alias("flagged"))
    rows = stored.join(flagged, "name", "left").withColumn("order", F.when(F.col("flagged"), F.col("pos")).otherwise(F.col("pos") + LAST))
    return rows.agg(F.min_by("name", "order").alias("name"))


def ordered_metrics(run: DataFrame, registry: DataFrame) -> DataFrame:
    """(metric, place): by the registry's order, those it doesn't know after them in the run's order. run: metric, pos; registry: metric, order."""
    rows = run.join(registry.select("metric", "order"), "metric", "left")
    place = F.row_number().over(Window.orderBy(F.coalesce("order", F.lit(LAST)), "pos"))  # a row for each metric
    return rows.select("metric", place.alias("place"))


def tool_cards(decs: DataFrame, registry: DataFrame, versions: DataFrame) -> DataFrame:
    """(dec, display, license, version): the card of a tool by its id, else by its base name; its version as the registry words it.

    registry: id, display, license, versions (a map of raw to worded versions); versions: dec, raw.
    """
    own = registry.select(F.col("id").alias("dec"), F.struct("display", "license", "versions").alias("own"))
    base = registry.select(F.col("id").alias("base"), F.struct("display", "license", "versions").alias("shared"))
    rows = decs.select("dec", base_name(F.col("dec")).alias("base")).join(own, "dec", "left").join(base, "base", "left").join(versions, "dec", "left")
    card = F.coalesce("own", "shared")
    worded = F.coalesce(F.try_element_at(card["versions"], F.col("raw")), F.col("raw"))
    return rows.select("dec", F.coalesce(card["display"], F.col("dec")).alias("display"), card["license"].alias("license"), worded.alias("version"))


def compile_rates(attempts: DataFrame) -> DataFrame:
    """(dec, compiled, total, pct): recompiled over attempts that say whether they were; best first."""
    rows = attempts.where("compiles is not null").groupBy("dec").agg(F.count_if("compiles").alias("compiled"), F.count(F.lit(1)).alias("total"))
    return rows.select("dec", "compiled", "total", percent(F.col("compiled"), F.col("total")).alias("pct"))


def compile_table(rates: DataFrame, decs: DataFrame) -> DataFrame:
    """``rates`` with places: by percentage, then in the run's order."""
    rows = rates.join(F.broadcast(decs.select("dec", "pos")), "dec")  # the registry of tools
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("pct"), "pos"))).drop("pos")


def cost_table(costs: DataFrame, decs: DataFrame) -> DataFrame:
    """``costs`` (dec, median) with places among main tools and among those of the sample only: cheapest first, unknown last."""
    rows = costs.join(F.broadcast(decs.select("dec", "pos", "sample_only")), "dec")  # the registry of tools
    place = F.row_number().over(Window.partitionBy("sample_only").orderBy(F.col("median").asc_nulls_last(), "pos"))
    return rows.withColumn("place", place).drop("pos")


def preferred_costs(structured: DataFrame, traced: DataFrame) -> DataFrame:
    """Of each tool the structured record if there is one, else what its traces say. Both: dec, total, median."""
    s = structured.select("dec", F.struct("total", "median").alias("s"))
    t = traced.select("dec", F.struct("total", "median").alias("t"))
    rows = s.join(t, "dec", "full").withColumn("x", F.coalesce("s", "t"))
    return rows.select("dec", "x.total", "x.median", F.when(F.col("s").isNotNull(), "structured").otherwise("trace").alias("origin"))


def scoreboard_lines(board: DataFrame) -> DataFrame:
    """(metric, rank, line): a scoreboard's rows as text. board: dec, metric, num, den, pct, rank."""
    return board.select("metric", "rank", F.format_string("%2d. %-20s %6.2f%% (%d/%d)", "rank", "dec", "pct", "num", "den").alias("line"))


def improvement_lines(cases: DataFrame) -> DataFrame:
    """(place, line) of improvements in their order. cases: place, project, opt_level, binary_name, function_name, base_value, target_value (null: missing)."""
    where = F.concat_ws("/", "project", "opt_level", "binary_name", "function_name")
    worse = F.when(F.col("target_value").isNull(), F.lit("missing")).otherwise(F.format_string("%.3f", "target_value"))
    return cases.select("place", F.concat(where, F.lit(": "), F.format_string("%.3f", "base_value"), F.lit(" vs "), worse).alias("line"))


def orphan_checkpoints(checkpoints: DataFrame, projects: DataFrame) -> DataFrame:
    """Checkpoints of projects that are no longer known. They are kept and noted, never deleted."""
    return checkpoints.join(projects.select("project"), "project", "left_anti")


def group_records(functions: DataFrame, files: DataFrame, graphs: DataFrame) -> DataFrame:
    """A row for each group with a binary file: its path, functions, lists of functions by preset, and its graph's path if that exists.

    files, graphs: project, opt_level, binary_name, path. Groups without a file are unresolved (path null).
    """
    by = ["project", "opt_level", "binary_name"]
    listed = functions.select(*by, "function_name", F.explode("datasets").alias("preset")).groupBy(*by, "preset").agg(F.array_sort(F.collect_list("function_name")).alias("names"))  # of one binary
    presets = listed.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("preset", "names")))).alias("presets"))
    rows = functions.groupBy(*by).agg(F.count(F.lit(1)).alias("functions")).join(presets, by, "left")
    rows = rows.join(files.select(*by, "path"), by, "left").join(graphs.select(*by, F.col("path").alias("graph")), by, "left")
    return rows.select(*by, "functions", "presets", "path", "graph")
