"""What a report attaches to a data set, and all of its tables in one bundle."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparison, facts, history, presets, sampling, samples, scoreboard, site
from .dataset import KEY, Dataset

#: The sample's seed where neither an argument nor the environment gives one, and its size.
SEED, SAMPLE = 1337, 250
SEED_VARIABLE = "SCOREWRIGHT_SAMPLE_SEED"


def seed_of(seed: int | None = None) -> int:
    """The argument, else the environment's, else ``SEED``."""
    return int(os.environ.get(SEED_VARIABLE, SEED)) if seed is None else seed


def assign_presets(data: Dataset, manifest: DataFrame | None = None, total: int = SAMPLE, seed: int | None = None) -> Dataset:
    """The data set with presets by rule and the sample: the manifest's members, or a draw that a seed repeats.

    Drawn are ``total`` scored functions, evenly over projects and binaries.
    """
    functions = presets.tag_presets(data.functions.drop("datasets"))
    if manifest is None:
        order = F.md5(F.concat_ws("::", F.lit(str(seed_of(seed))), *KEY))
        scored = functions.join(data.obs.select("fn_id").distinct(), "fn_id", "left_semi")
        manifest = sampling.sample_even(scored, total, order)
    return data.having(functions=presets.pin_sample(functions, manifest)[0])


def extras(data: Dataset, code: DataFrame, source: DataFrame, withheld: DataFrame, per_tier: int = 100, k: int = 15) -> dict[str, DataFrame]:
    """Hardest cases, samples by difficulty and of the sample set, compile rates. code: fn_id, dec, text; withheld: projects whose code stays out."""
    shown = code.join(data.functions.join(withheld, "project", "left_anti").select("fn_id"), "fn_id", "left_semi")
    tiers = comparison.tiers(data).where("tier is not null").select("fn_id", "tier", F.coalesce(-F.col("mean"), F.lit(0.0)).alias("place"))
    return {
        "hardest": comparison.hardest(data, shown.select("fn_id", "dec"), k, withheld),
        "samples": samples.tiered(tiers, shown, per_tier),
        "sample_set": samples.sample_set(data.functions, shown, source),
        "compile_rates": site.compile_table(site.compile_rates(data.attempts), data.decs),
    }


def bundle(data: Dataset, attached: dict[str, DataFrame], texts: DataFrame, stored: DataFrame, orders: DataFrame, cards: DataFrame, versions: DataFrame) -> dict[str, DataFrame]:
    """All tables of a report by name: scores by combo, scoreboards, the registries' part and what ``extras`` attached.

    The facts of the functions are computed once and kept for the tables.
    """
    kept = facts.function_facts(data).persist()
    counts = facts.combo_counts(kept).persist()
    overall = scoreboard.scoreboard_overall(data, kept)
    return attached | {
        "combos": facts.combo_sizes(kept),
        "per_metric": facts.per_metric(counts, data.decs),
        "union": facts.union(counts, data.decs),
        "errors": facts.errors(counts, data.decs),
        "compiles": facts.compiles(counts, data.decs),
        "distances": facts.distance_stats(kept),
        "scoreboard": scoreboard.scoreboard_metric(data, kept),
        "overall": overall,
        "presets": site.preset_texts(stored, texts),
        "default_preset": site.default_preset(stored, texts),
        "metrics": site.ordered_metrics(data.metrics.select("metric", "pos"), orders),
        "tools": site.tool_cards(data.decs, cards, versions),
    }


def points(data: Dataset, board: DataFrame, overall: DataFrame, bases: list[str]) -> dict[str, DataFrame]:
    """History by tool: the scores of each of its versions."""
    return {base: history.history_points(board, overall, base) for base in bases}
