"""Rebuilding the data set of a results tree: overlays, presets, pinned sample, hidden tools, scoreboard, guarded write."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import facts, overlays, presets, scoreboard, visibility
from ..sources import function_data
from ..sources import overlays as files
from .dataset import Dataset


def apply_overlays(spark: SparkSession, data: Dataset, root: str) -> Dataset:
    """Graph distances, then type matches, then byte matches, as far as the tree has them."""
    new, covered = files.ged(spark, root)
    if new is not None:
        data = data.having(obs=overlays.overlay_ged(data, new, covered))
    types = files.type_match(spark, root)
    if types is not None:
        data = data.having(obs=overlays.overlay_type_match(data, types))
    built = files.byte_match(spark, root)
    if built is not None:
        obs, attempts = overlays.overlay_byte_match(data, built)
        data = data.having(obs=obs, attempts=attempts)
    return data


def finalize(spark: SparkSession, data: Dataset, root: str, exclude: tuple[str, ...] = (), allowed_projects: tuple[str, ...] = (), allow_drops: bool = False):
    """(data set, scoreboard by metric, overall scoreboard), after the guarded write to ``root``/function_results.json."""
    data = apply_overlays(spark, data, root)
    functions = presets.tag_presets(data.functions.drop("datasets"))
    pinned = files.manifest(spark, root)
    if pinned is not None:
        functions, _ = presets.pin_sample(functions, pinned)
    data = data.having(functions=functions)
    if exclude:
        data = visibility.strip(data, list(exclude))
    function_data.write_guarded(data, f"{root}/function_results.json", allowed_projects, exclude, allow_drops)
    data = function_data.read(spark, f"{root}/function_results.json")
    f = facts.function_facts(data)
    return data, scoreboard.scoreboard_metric(data, f), scoreboard.scoreboard_overall(data, f)
