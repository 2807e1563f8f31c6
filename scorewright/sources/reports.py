"""Small documents of results: scoreboards as TOML, markdown and text; cases as JSON rows; appended lines. All are a row per tool or case shown."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(x: object) -> str:
    return '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'


def write_scoreboard(metric: DataFrame, overall: DataFrame, path: str, name: str = "scoreboard") -> None:
    """A scoreboard (a row per tool and metric) as TOML."""
    lines = [f"name = {_quoted(name)}"]
    for r in overall.orderBy("rank").collect():
        lines += ["", f"[overall.{_quoted(r['dec'])}]", f"num = {r['num']}", f"den = {r['den']}", f"pct = {float(r['pct'])!r}", f"rank = {r['rank']}"]
    for r in metric.orderBy("metric", "rank").collect():
        lines += ["", f"[metric.{_quoted(r['metric'])}.{_quoted(r['dec'])}]"]
        lines += [f"{k} = {r[k]}" for k in ("num", "den", "rank")] + [f"{k} = {float(r[k])!r}" for k in ("pct", "mean", "median")]
    Path(path).write_text("\n".join(lines) + "\n")


def read_scoreboard(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(by metric, overall) of what ``write_scoreboard`` wrote."""
    doc = tomllib.loads(Path(path).read_text())
    by = [(d, m, x["num"], x["den"], x["pct"], x["mean"], x["median"], x["rank"]) for m, ds in doc.get("metric", {}).items() for d, x in ds.items()]
    total = [(d, x["num"], x["den"], x["pct"], x["rank"]) for d, x in doc.get("overall", {}).items()]
    return (
        spark.createDataFrame(by, "dec string, metric string, num long, den long, pct double, mean double, median double, rank int"),
        spark.createDataFrame(total, "dec string, num long, den long, pct double, rank int"),
    )


def markdown(metric: DataFrame, overall: DataFrame) -> str:
    """The scoreboard as a markdown table, best first."""
    metrics = sorted({r["metric"] for r in metric.select("metric").distinct().collect()})
    cells = {(r["dec"], r["metric"]): r["pct"] for r in metric.collect()}
    out = ["| # | Tool | Union | " + " | ".join(metrics) + " |", "|" + "---|" * (3 + len(metrics))]
    for r in overall.orderBy("rank").collect():
        own = [f"{cells[r['dec'], m]:.1f} %" if (r["dec"], m) in cells else "n/a" for m in metrics]
        out.append(f"| {r['rank']} | {r['dec']} | {r['pct']:.1f} % | " + " | ".join(own) + " |")
    return "\n".join(out) + "\n"


def case_rows(cases: DataFrame) -> DataFrame:
    """Improvement cases for JSON: an infinite margin is null, an address is hexadecimal."""
    finite = F.abs("margin") < F.lit(float("inf"))
    out = cases.withColumn("margin", F.when(finite, F.col("margin")))
    return out.withColumn("addr", F.concat(F.lit("0x"), F.lower(F.hex("addr")))) if "addr" in cases.columns else out


def binary_sections(aggregates: DataFrame) -> DataFrame:
    """(path, text): each binary's metrics as flat TOML keys ``<tool>.<metric>.<statistic>``; one file a binary, written by the tasks."""
    stats = ["total", "mean", "median", "perfect_count", "n", "pct"]
    pairs = F.concat_ws("\n", *[F.concat(F.lit('"'), F.col("dec"), F.lit('".'), F.col("metric"), F.lit(f".{s} = "), F.col(s).cast("string")) for s in stats])
    rows = aggregates.groupBy("project", "opt_level", "binary_name").agg(F.array_join(F.array_sort(F.collect_list(pairs)), "\n").alias("text"))
    return rows.select(F.concat_ws("/", "opt_level", "project", F.lit("evaluated"), F.concat("binary_name", F.lit(".toml"))).alias("path"), "text")


def append_missing(path: str, lines: list[str]) -> list[str]:
    """Append the lines that a file lacks; returns them. Doing so again changes nothing."""
    file = Path(path)
    have = file.read_text().splitlines() if file.exists() else []
    new = [x for x in dict.fromkeys(lines) if x not in have]
    if new:
        file.write_text("\n".join([*have, *new]) + "\n")
    return new
