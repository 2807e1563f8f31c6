"""Predicates and small scalar rules of the scoring domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of placeholder names that tools give to functions they can't name.
PLACEHOLDERS = ("sub", "FUN", "fcn", "loc", "nullsub", "unk", "off", "byte", "word", "dword", "j")
#: Labels of ARM targets.
ARM_LABELS = ("cps", "arm", "armv7", "aarch64", "arm64", "bare-metal", "embedded-linux")


def finite(value: Column) -> Column:
    """Finite or an explicit null: a present null counts as measured. Absent keys have no row at all."""
    return value.isNull() | strictly_finite(value)


def strictly_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def base_name(dec: Column) -> Column:
    """The name before ``@`` of a versioned id."""
    return F.substring_index(dec, "@", 1)


def hidden(dec: Column, names: list[str]) -> Column:
    return dec.isin(*names) | base_name(dec).isin(*names)


def placeholder(name: Column) -> Column:
    return name.rlike(f"^({'|'.join(PLACEHOLDERS)})_[0-9a-fA-F]+$")


def is_arm(labels: Column) -> Column:
    return F.exists(labels, lambda x: x.isin(*ARM_LABELS) | x.startswith("cortex-"))


def opt_labels(opt: Column) -> Column:
    """The level, whether it is optimised, and whether inlining is off."""
    kind = F.when(opt == "O0", F.lit("unoptimized")).otherwise(F.lit("optimized"))
    return F.array_compact(F.array(opt, kind, F.when(opt.endswith("noinline"), F.lit("noinline"))))


def binary_labels(opt: Column, project_labels: Column, own: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(opt_labels(opt), F.coalesce(project_labels, empty), F.coalesce(own, empty)))


def function_labels(labels: Column, lines: Column, threshold: int = 100) -> Column:
    large = F.when(F.coalesce(lines >= threshold, F.lit(False)), F.array(F.lit("large"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(labels, large))


def percent(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num * 100.0 / den)


def percent_band(p: Column) -> Column:
    return F.when(p >= 50, "high").when(p >= 20, "mid").otherwise("low")


def error_band(p: Column) -> Column:
    return F.when(p < 2, "high").when(p < 10, "mid").otherwise("low")


def bar(p: Column, width: int = 20) -> Column:
    """A text bar: the share of ``width`` that is full, halves rounded up."""
    full = F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(100.0)) / 100.0 * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, for ordering."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def direction(metric: Column, perfect_value: Column) -> Column:
    """Whether lower is better: known metrics by name, others if their perfect value is 0."""
    return F.when(metric == "ged", True).when(metric.isin("type_match", "byte_match"), False).otherwise(perfect_value == 0)


def distance_of(metric: Column, value: Column, fp: Column, fn: Column, changed_lines: Column) -> Column:
    """Raw edits to perfect, or null where they aren't known."""
    ged = F.when((metric == "ged") & value.isNotNull() & strictly_finite(value), value)
    types = F.when(metric == "type_match", (fp + fn).cast("double"))
    return F.coalesce(ged, types, F.when(metric == "byte_match", changed_lines.cast("double")))


#: Units of sizes.
UNITS = ("B", "KiB", "MiB", "GiB")


def human_bytes(size: Column) -> Column:
    """A size with one decimal in the largest unit of which it has at least one; bytes without decimals. Halves go to the even digit."""
    out = F.format_string("%d B", size.cast("long"))
    for k, unit in enumerate(UNITS[1:], 1):
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(size / 1024**k, 1))).otherwise(out)
    return out


def opt_flags(opt_level: Column) -> Column:
    """Compiler flags of an optimisation level such as ``O2-noinline``."""
    parts = F.split(opt_level, "-")
    return F.concat(F.lit("-"), parts[0], F.when(F.array_contains(parts, "noinline"), F.lit(" -fno-inline")).otherwise(F.lit("")))


def line_of(text: Column, position: Column) -> Column:
    """The line, from 1, of a place (from 0) in a text."""
    before = F.substring(text, F.lit(1), position.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
