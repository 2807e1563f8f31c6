"""Queries over the driver's tables and the same in DuckDB's SQL.

Each query is the library's operator on the data set that the tables stand for (``plans.dataset``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions import text as X
from .operators import comparison, cost, coverage, dataset_page, facts, history, overlays, presets, publish, repairs, sampling, scoreboard, universe, visibility
from .plans import kernel_tables, payloads
from .plans.dataset import DECS, SQL, Dataset, from_tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TOOLS = [d for d, *_ in DECS]
KEY = ["project", "opt_level", "binary_name", "function_name"]
GROUP = KEY[:3]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _data(name: str, sql: str | None = None, raw: bool = False):
    """Register a query of the data set; ``sql`` follows the shared table expressions."""

    def add(f: Callable[[Dataset], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(from_tables(spark, sf_dir))
        if sql:
            _SQL[name] = sql if raw else f"WITH {SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def _tables(name: str, sql: str | None = None):
    """Register a query of the tables themselves."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- facts, combos and leaderboards -------------------------------------------------------------

#: Functions by combo with their facts, in SQL.
_COMBO = """, meas AS (
  SELECT DISTINCT fn_id, metric FROM obs WHERE isfinite(value)
), tried AS (
  SELECT f.fn_id, d.dec, d.sample_only, coalesce(o.decompiled, false) AS decompiled FROM v_fn f CROSS JOIN decs d LEFT JOIN v_obs o ON o.fn_id = f.fn_id AND o.dec = d.dec
), gate AS (
  SELECT fn_id, bool_and(decompiled) AS gate_all, bool_and(decompiled OR sample_only) AS gate_full FROM tried GROUP BY fn_id
), combo AS (
  SELECT f.fn_id, f.project, f.opt_level, f.binary_name, p.preset, n.normalize FROM fn f, gate g, (SELECT fn_id AS pid, unnest(datasets) AS preset FROM fn) p, (VALUES (0), (1)) n(normalize)
  WHERE f.fn_id = g.fn_id AND f.fn_id = p.pid AND (n.normalize = 0 OR CASE WHEN p.preset = 'sample-set' THEN gate_all ELSE gate_full END)
) """
_NUM = "CAST(count(*) FILTER (WHERE %s) AS BIGINT)"


@_data("leaderboard_per_metric", _COMBO + f"SELECT preset, normalize, d.dec, m.metric, {_NUM % 'coalesce(o.perfect, false)'} AS num, CAST(count(*) AS BIGINT) AS den FROM combo c JOIN meas m USING (fn_id) CROSS JOIN decs d LEFT JOIN obs o ON o.fn_id = c.fn_id AND o.dec = d.dec AND o.metric = m.metric GROUP BY ALL")
def _(d):
    return facts.per_metric(facts.combo_counts(facts.function_facts(d)), d.decs)


@_data("leaderboard_union", _COMBO + f", one AS (SELECT DISTINCT fn_id FROM meas), good AS (SELECT DISTINCT o.fn_id, dec FROM obs o JOIN meas USING (fn_id, metric) WHERE perfect) SELECT preset, normalize, d.dec, {_NUM % 'g.dec IS NOT NULL'} AS num, CAST(count(*) AS BIGINT) AS den FROM combo c JOIN one USING (fn_id) CROSS JOIN decs d LEFT JOIN good g ON g.fn_id = c.fn_id AND g.dec = d.dec GROUP BY ALL")
def _(d):
    return facts.union(facts.combo_counts(facts.function_facts(d)), d.decs)


@_data("leaderboard_errors", _COMBO + f"SELECT preset, normalize, dec, {_NUM % 'NOT decompiled'} AS num, CAST(count(*) AS BIGINT) AS den FROM combo JOIN v_obs USING (fn_id) GROUP BY ALL")
def _(d):
    return facts.errors(facts.combo_counts(facts.function_facts(d)), d.decs)


@_data("leaderboard_compile", _COMBO + f"SELECT preset, normalize, dec, {_NUM % 'byte_match >= 0.5'} AS num, CAST(count(*) AS BIGINT) AS den FROM combo JOIN v_obs USING (fn_id) WHERE byte_match IS NOT NULL GROUP BY ALL")
def _(d):
    return facts.compiles(facts.combo_counts(facts.function_facts(d)), d.decs)


@_data("combo_counts", _COMBO + "SELECT preset, normalize, CAST(count(*) AS BIGINT) AS functions, CAST(count(DISTINCT (project, opt_level, binary_name)) AS BIGINT) AS binaries FROM combo GROUP BY ALL")
def _(d):
    return facts.combo_sizes(facts.function_facts(d))


@_data("distance_stats", _COMBO + "SELECT preset, normalize, dec, metric, round(avg(distance), 6) AS mean, list_sort(list(distance))[CAST(count(distance) // 2 AS INT) + 1] AS median, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE distance = 0) AS BIGINT) AS at0 FROM combo JOIN obs USING (fn_id) GROUP BY ALL")
def _(d):
    return facts.distance_stats(facts.function_facts(d)).withColumn("mean", F.round("mean", 6))


@_data("metric_measurability", "SELECT metric, CAST(count(DISTINCT fn_id) AS BIGINT) AS functions FROM obs WHERE isfinite(value) GROUP BY metric")
def _(d):
    return facts.measurable(d.obs).groupBy("metric").agg(F.count(F.lit(1)).alias("functions"))


@_data("normalize_gate", _COMBO + f"SELECT {_NUM % 'gate_all'} AS gate_all, {_NUM % 'gate_full'} AS gate_full, CAST(count(*) AS BIGINT) AS functions FROM gate")
def _(d):
    return facts.function_facts(d).agg(F.count_if("gate_all").alias("gate_all"), F.count_if("gate_full").alias("gate_full"), F.count(F.lit(1)).alias("functions"))


@_data("union_leaders_top3", _COMBO + """, one AS (SELECT DISTINCT fn_id FROM meas), good AS (SELECT DISTINCT o.fn_id, dec FROM obs o JOIN meas USING (fn_id, metric) WHERE perfect), r AS (
  SELECT d.dec, count(g.dec) * 100.0 / count(*) AS pct FROM combo c JOIN one USING (fn_id) CROSS JOIN decs d LEFT JOIN good g ON g.fn_id = c.fn_id AND g.dec = d.dec WHERE preset = 'optimized' AND normalize = 0 AND NOT sample_only GROUP BY d.dec
), t AS (SELECT dec, pct, row_number() OVER (ORDER BY pct DESC, dec) AS rank FROM r)
SELECT CAST(rank AS INT) AS rank, dec, round(pct, 6) AS pct, concat(rank, '. ', dec, ' ', printf('%.1f', pct), '%') AS line FROM t WHERE rank <= 3""")
def _(d):
    top = facts.union_leaders(facts.combo_counts(facts.function_facts(d)), d.decs, "optimized", drop_sample_only=True)
    return payloads.leader_lines(top, 3).withColumn("pct", F.round("pct", 6))


# --- scoreboards ---------------------------------------------------------------------------------


@_data("a6_scoreboard_metric", """, meas AS (SELECT DISTINCT fn_id, metric FROM obs WHERE isfinite(value)), den AS (SELECT metric, count(*) AS den FROM meas GROUP BY metric), s AS (
  SELECT d.dec, m.metric, d.pos, CAST(coalesce(sum(CASE WHEN o.perfect THEN 1 ELSE 0 END), 0) AS BIGINT) AS num, any_value(m.den) AS den, coalesce(avg(o.value), 0) AS mean, coalesce(median(o.value), 0) AS median
  FROM decs d CROSS JOIN den m LEFT JOIN obs o ON o.dec = d.dec AND o.metric = m.metric GROUP BY d.dec, m.metric, d.pos
) SELECT dec, metric, num, CAST(den AS BIGINT) AS den, round(num * 100.0 / den, 6) AS pct, round(mean, 6) AS mean, median, CAST(row_number() OVER (PARTITION BY metric ORDER BY num * 100.0 / den DESC, pos) AS INT) AS rank FROM s""")
def _(d):
    return scoreboard.scoreboard_metric(d, facts.function_facts(d)).withColumns({"pct": F.round("pct", 6), "mean": F.round("mean", 6)})


@_data("a6_scoreboard_overall", """, one AS (SELECT DISTINCT fn_id FROM obs WHERE isfinite(value)), good AS (SELECT dec, count(DISTINCT fn_id) AS num FROM obs WHERE perfect GROUP BY dec), s AS (
  SELECT d.dec, pos, CAST(coalesce(num, 0) AS BIGINT) AS num, CAST((SELECT count(*) FROM one) AS BIGINT) AS den FROM decs d LEFT JOIN good USING (dec)
) SELECT dec, num, den, round(num * 100.0 / den, 6) AS pct, CAST(row_number() OVER (ORDER BY num * 100.0 / den DESC, pos) AS INT) AS rank FROM s""")
def _(d):
    return scoreboard.scoreboard_overall(d, facts.function_facts(d)).withColumn("pct", F.round("pct", 6))


@_data("legacy_scoreboard", """, v AS (SELECT o.*, value = perfect_value AS good FROM obs o JOIN metrics USING (metric)), s AS (
  SELECT dec, metric, count(*) FILTER (WHERE good) AS num, count(*) AS den FROM v GROUP BY ALL
  UNION ALL SELECT dec, 'overall', count(*) FILTER (WHERE hit), count(*) FROM (SELECT dec, fn_id, bool_or(good) AS hit FROM v GROUP BY ALL) GROUP BY dec
) SELECT dec, metric, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, round(num * 100.0 / den, 6) AS pct FROM s""")
def _(d):
    return scoreboard.legacy_scoreboard(d.obs, d.metrics).withColumn("pct", F.round("pct", 6))


@_data("flat_aggregates", "SELECT dec, metric, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, median(value) AS median, min(value) AS minimum, max(value) AS maximum, CAST(count(*) FILTER (WHERE value = perfect_value) AS BIGINT) AS perfect_count, CAST(count(*) AS BIGINT) AS total_count FROM obs JOIN metrics USING (metric) GROUP BY ALL")
def _(d):
    return scoreboard.flat_aggregates(d.obs, d.metrics).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@_data("flat_totals", "SELECT CAST(count(DISTINCT (project, opt_level, binary_name, function_name)) AS BIGINT) AS functions, CAST(count(DISTINCT (project, opt_level, binary_name)) AS BIGINT) AS binaries FROM v_fn")
def _(d):
    return scoreboard.flat_totals(d.functions)


@_data("binary_aggregates", "SELECT project, opt_level, binary_name, dec, metric, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, median(value) AS median, CAST(count(*) FILTER (WHERE value = perfect_value) AS BIGINT) AS perfect_count, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (WHERE value = perfect_value) * 100.0 / count(*), 6) AS pct FROM obs JOIN v_fn USING (fn_id) JOIN metrics USING (metric) GROUP BY ALL")
def _(d):
    return scoreboard.binary_aggregates(d).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "pct": F.round("pct", 6)})


# --- sizes, presets, labels, samples -------------------------------------------------------------


@_data("size_distribution", "SELECT CAST(count(size) AS BIGINT) AS count, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS std, CAST(min(size) AS DOUBLE) AS min, CAST(max(size) AS DOUBLE) AS max, " + ", ".join(f"quantile_cont(CAST(size AS DOUBLE), {q}) AS p{int(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM v_fn")
def _(d):
    return presets.size_distribution(d.functions).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_PLAIN = "SELECT fn_id, project, opt_level, binary_name, function_name, size FROM "


@_data("large_subset_std", _PLAIN + "v_fn, thr WHERE size >= cut")
def _(d):
    return presets.large_subset(d.functions, "std", 1.0).select("fn_id", *KEY, "size")


@_data("large_subset_percentile", _PLAIN + "v_fn, (SELECT quantile_cont(CAST(size AS DOUBLE), 0.9) AS p FROM v_fn) WHERE size >= p")
def _(d):
    return presets.large_subset(d.functions, "percentile", 90.0).select("fn_id", *KEY, "size")


@_data("filter_to_subset", "SELECT project, opt_level, binary_name, CAST(count(*) AS BIGINT) AS n FROM v_fn, thr WHERE size >= cut GROUP BY ALL")
def _(d):
    return presets.restrict(d.functions, presets.large_subset(d.functions)).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))


@_data("preset_membership", "SELECT fn_id, unnest(datasets) AS preset FROM fn")
def _(d):
    return d.functions.select("fn_id", F.explode("datasets").alias("preset"))


@_data("preset_counts", "SELECT preset, CAST(count(*) AS BIGINT) AS functions, CAST(count(DISTINCT (project, opt_level, binary_name)) AS BIGINT) AS binaries FROM (SELECT *, unnest(datasets) AS preset FROM fn) GROUP BY preset")
def _(d):
    return presets.preset_counts(d.functions)


@_data("pinned_sample", "SELECT 'tagged' AS fate, CAST(count(*) AS BIGINT) AS n FROM v_fn WHERE fn_id % 13 = 0 UNION ALL SELECT 'unmatched', 1")
def _(d):
    spark = d.functions.sparkSession
    manifest = d.functions.where("fn_id % 13 = 0").select(*KEY).unionByName(spark.createDataFrame([("gone", "O0", "b", "f")], ", ".join(f"{k} string" for k in KEY)))
    tagged, missing = presets.pin_sample(d.functions, manifest)
    a = tagged.where(F.array_contains("datasets", "sample-set")).agg(F.lit("tagged").alias("fate"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(missing.agg(F.lit("unmatched").alias("fate"), F.count(F.lit(1)).alias("n")))


@_data("manifest_diff", "SELECT fate, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN fn_id % 13 = 0 AND project = 'proj_03' THEN 'dropped' WHEN fn_id % 13 = 0 AND fn_id % 2 = 0 THEN 'kept' WHEN fn_id % 13 = 0 THEN 'missing' ELSE 'added' END AS fate FROM v_fn WHERE fn_id % 13 = 0 OR fn_id % 2 = 0) GROUP BY fate")
def _(d):
    f = d.functions
    return presets.diff_manifests(f.where("fn_id % 2 = 0"), f.where("fn_id % 13 = 0"), f.where("project = 'proj_03'")).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@_data("opt_labels", "SELECT opt_level, CASE opt_level WHEN 'O0' THEN 'O0,unoptimized' WHEN 'O2' THEN 'O2,optimized' ELSE 'O2-noinline,optimized,noinline' END AS labels, CAST(count(*) AS BIGINT) AS n FROM v_fn GROUP BY ALL")
def _(d):
    return d.functions.groupBy("opt_level", F.array_join(P.opt_labels(F.col("opt_level")), ",").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@_data("function_labels", "SELECT fn_id, concat_ws(',', CASE opt_level WHEN 'O0' THEN 'O0,unoptimized' WHEN 'O2' THEN 'O2,optimized' ELSE 'O2-noinline,optimized,noinline' END, CASE WHEN project = 'proj_01' THEN 'cps,cortex-m4' END, CASE WHEN size >= 100 THEN 'large' END) AS labels FROM v_fn")
def _(d):
    own = F.when(F.col("project") == "proj_01", F.array(F.lit("cps"), F.lit("cortex-m4"), F.col("opt_level")))
    labels = P.function_labels(P.binary_labels(F.col("opt_level"), own, F.lit(None).cast("array<string>")), F.col("size"))
    return d.functions.select("fn_id", F.array_join(labels, ",").alias("labels"))


_EVEN = """, ok AS (SELECT DISTINCT f.project, f.opt_level, f.binary_name, f.function_name, md5(concat_ws('::', f.project, f.opt_level, f.binary_name, f.function_name)) AS o, md5(f.project) AS p FROM v_fn f JOIN obs USING (fn_id) WHERE opt_level = 'O0'),
lead AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY o) AS r FROM (SELECT *, row_number() OVER (PARTITION BY project, opt_level, binary_name ORDER BY o) AS b FROM ok) WHERE b = 1),
one AS (SELECT * FROM lead ORDER BY r, p LIMIT %d),
rest AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY o) AS r FROM ok WHERE o NOT IN (SELECT o FROM one)),
both_ AS (SELECT project, opt_level, binary_name, function_name, 0 AS phase, 0 AS r, p FROM one UNION ALL SELECT project, opt_level, binary_name, function_name, 1, r, p FROM rest)
SELECT project, opt_level, binary_name, function_name FROM both_ ORDER BY phase, r, p LIMIT %d"""


@_data("sample_even_hash", _EVEN % (100, 100))
def _(d):
    scored = d.functions.where("opt_level = 'O0'").join(d.obs.select("fn_id").distinct(), "fn_id", "left_semi")
    return sampling.sample_even(scored, 100)


@_data("sample_even_relaxed", _EVEN % (700, 700))
def _(d):
    scored = d.functions.where("opt_level = 'O0'").join(d.obs.select("fn_id").distinct(), "fn_id", "left_semi")
    return sampling.sample_even(scored, 700)


@_data("sample_buckets")
def _(d):
    scored = d.functions.join(d.obs.select("fn_id").distinct(), "fn_id", "left_semi")
    return sampling.sample_buckets(presets.buckets(scored), 50, ["unoptimized", "optimized", "inlined", "large", "unoptimized-arm"])


# --- comparisons and picks -----------------------------------------------------------------------

_IMPROVE = """, w AS (SELECT b.fn_id, b.value AS base_value, t.value AS target_value, b.perfect AS base_perfect FROM obs b LEFT JOIN obs t ON t.fn_id = b.fn_id AND t.metric = b.metric AND t.dec = 'tool_c' WHERE b.dec = 'tool_a' AND b.metric = '%s')
SELECT project, opt_level, binary_name, function_name, base_value, target_value, base_perfect, round(%s, 6) AS margin FROM w JOIN v_fn USING (fn_id) WHERE %s"""


@_data("improvements_lower", _IMPROVE % ("ged", "target_value - base_value", "target_value > base_value"))
def _(d):
    return comparison.improvements(d, "tool_a", "tool_c", "ged").withColumn("margin", F.round("margin", 6))


@_data("improvements_higher", _IMPROVE % ("type_match", "base_value - target_value", "target_value < base_value"))
def _(d):
    return comparison.improvements(d, "tool_a", "tool_c", "type_match").withColumn("margin", F.round("margin", 6))


@_data("improvements_missing", _IMPROVE % ("ged", "coalesce(target_value - base_value, CAST('Infinity' AS DOUBLE))", "(target_value IS NULL OR target_value > base_value) AND base_perfect"))
def _(d):
    return comparison.improvements(d, "tool_a", "tool_c", "ged", perfect_only=True, target_missing=True).withColumn("margin", F.round("margin", 6))


_GAP = "abs(value - perfect_value)"


@_data("hardest_topk", f""", h AS (SELECT metric, dec, project, opt_level, binary_name, function_name, value, {_GAP} AS gap, row_number() OVER (PARTITION BY metric, dec ORDER BY {_GAP} DESC, value DESC, project, opt_level, binary_name, function_name) AS rank
FROM obs JOIN metrics USING (metric) JOIN v_obs USING (fn_id, dec) JOIN v_fn USING (fn_id) WHERE {_GAP} > 0 AND decompiled AND project <> 'proj_05') SELECT metric, dec, CAST(rank AS INT) AS rank, project, opt_level, binary_name, function_name, value, round(gap, 6) AS gap FROM h WHERE rank <= 15""")
def _(d):
    bad = d.functions.where("project = 'proj_05'").select("project")
    return comparison.hardest(d, d.attempts.where("decompiled"), 15, bad).withColumn("gap", F.round("gap", 6))


_TIER = """, g AS (SELECT fn_id, count(*) AS present, count(*) FILTER (WHERE perfect) AS good, avg(coalesce(distance, value)) AS mean FROM obs WHERE metric = 'ged' GROUP BY fn_id),
t AS (SELECT g.*, project, opt_level, binary_name, function_name, CASE WHEN good = 0 THEN 'hard' WHEN good >= greatest(2, (present + 1) // 2) THEN 'easy' ELSE 'medium' END AS tier FROM g JOIN v_fn USING (fn_id) WHERE present >= 2) """


@_data("difficulty_tiers", _TIER + "SELECT fn_id, project, opt_level, binary_name, function_name, CAST(present AS BIGINT) AS present, CAST(good AS BIGINT) AS good, round(mean, 6) AS mean, tier FROM t")
def _(d):
    return comparison.tiers(d).withColumn("mean", F.round("mean", 6))


@_data("hard_tier_capped", _TIER + ", o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY project ORDER BY mean DESC, opt_level, binary_name, function_name) > 10 THEN 1 ELSE 0 END AS over FROM t WHERE tier = 'hard') SELECT project, opt_level, binary_name, function_name, round(mean, 6) AS mean, over FROM o ORDER BY over, t_mean(mean) LIMIT 150".replace("t_mean(mean)", "mean DESC, project, opt_level, binary_name, function_name"))
def _(d):
    return comparison.hard_capped(comparison.tiers(d), 150).withColumn("mean", F.round("mean", 6))


# --- the dataset page ----------------------------------------------------------------------------


def _groups(d: Dataset) -> DataFrame:
    return d.functions.groupBy(*GROUP).agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("labels"))


_ROLL = ", roll AS (SELECT project, CAST(count(DISTINCT binary_name) AS BIGINT) AS binaries, CAST(count(DISTINCT (opt_level, binary_name)) AS BIGINT) AS builds, CAST(count(*) AS BIGINT) AS functions FROM v_fn GROUP BY project) "


@_data("project_rollup", _ROLL + "SELECT roll.*, (SELECT string_agg(DISTINCT opt_level, ',' ORDER BY opt_level) FROM v_fn f WHERE f.project = roll.project) AS labels FROM roll")
def _(d):
    return dataset_page.project_rollup(d.functions, _groups(d)).select("project", "binaries", "builds", "functions", F.array_join("labels", ",").alias("labels"))


@_data("dataset_summary", _ROLL + "SELECT CAST(count(*) AS BIGINT) AS projects, CAST(sum(binaries) AS BIGINT) AS unique_binaries, CAST(sum(builds) AS BIGINT) AS builds, CAST(sum(functions) AS BIGINT) AS functions FROM roll")
def _(d):
    return dataset_page.summary(dataset_page.project_rollup(d.functions, _groups(d)))


@_data("category_counts", "SELECT 0 AS pos, 'plain' AS name, CAST(count(DISTINCT project) FILTER (WHERE opt_level = 'O0') AS BIGINT) AS n FROM v_fn UNION ALL SELECT 1, 'fast', CAST(count(DISTINCT project) FILTER (WHERE opt_level IN ('O2', 'O3')) AS BIGINT) FROM v_fn UNION ALL SELECT 2, 'none', CAST(0 AS BIGINT)")
def _(d):
    cats = d.functions.sparkSession.createDataFrame([(0, "plain", ["O0"]), (1, "fast", ["O2", "O3"]), (2, "none", ["x"])], "pos int, name string, labels array<string>")
    return dataset_page.category_counts(dataset_page.project_rollup(d.functions, _groups(d)), cats)


_DEC = ", meas AS (SELECT DISTINCT fn_id FROM obs WHERE metric = 'ged' AND isfinite(value)) "


@_data("source_loss", _DEC + ", any_ AS (SELECT fn_id FROM v_obs GROUP BY fn_id HAVING bool_or(decompiled)) SELECT CAST(count(*) FILTER (WHERE fn_id NOT IN (SELECT fn_id FROM meas)) AS BIGINT) AS lost, CAST(count(*) AS BIGINT) AS total FROM any_")
def _(d):
    return dataset_page.source_loss(facts.function_facts(d), TOOLS)


@_data("output_failures", _DEC + "SELECT dec, CAST(count(*) FILTER (WHERE ged IS NULL) AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS scope FROM v_obs JOIN meas USING (fn_id) WHERE decompiled GROUP BY dec")
def _(d):
    return dataset_page.output_failures(facts.function_facts(d), TOOLS)


@_data("projects_by_loc", _ROLL + "SELECT project, CAST(loc AS BIGINT) AS loc, CAST(row_number() OVER (ORDER BY loc DESC, project) AS INT) AS place FROM (SELECT project, sum(size) AS loc FROM v_fn GROUP BY project)")
def _(d):
    loc = d.functions.groupBy("project").agg(F.sum("size").alias("loc"))
    rows = dataset_page.by_size(dataset_page.project_rollup(d.functions, _groups(d)), loc)
    return payloads.placed(rows.select("project", "loc"), [F.desc("loc"), F.col("project")])


@_data("sample_browser", _TIER + "SELECT project, binary_name, function_name, CAST((SELECT count(*) FROM t WHERE tier = 'hard') AS BIGINT) AS tier_total FROM t WHERE tier = 'hard' AND (contains(lower(function_name), 'fn_1') OR contains(lower(binary_name), 'fn_1') OR contains(lower(project), 'fn_1'))")
def _(d):
    return dataset_page.sampled_tiers(comparison.tiers(d), "hard", "FN_1").select("project", "binary_name", "function_name", "tier_total")


# --- overlays, coverage, audit -------------------------------------------------------------------


def _overlay_keys(d: Dataset, metric: str, where: str) -> DataFrame:
    rows = d.obs.where(f"metric = '{metric}' and {where}").join(d.functions, "fn_id")
    key = F.concat_ws("::", "opt_level", "project", "binary_name", "dec", "function_name")
    return rows.select(key.alias("key"), "value", "fn_id")


#: The new overlay: all imperfect scores, but for one project, whose slices it doesn't cover.
_SLICES = ", new AS (SELECT o.*, project, opt_level, binary_name FROM obs o JOIN v_fn USING (fn_id) WHERE metric = '%s' AND NOT perfect AND project <> 'proj_02'), covered AS (SELECT DISTINCT project, opt_level, binary_name, dec FROM new) "


@_data("overlay_ged", _SLICES % "ged" + "SELECT fn_id, dec, value + 1 AS value, value + 1 = 0 AS perfect FROM new UNION ALL SELECT fn_id, dec, value, perfect FROM obs JOIN v_fn f USING (fn_id) WHERE metric = 'ged' AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.project = f.project AND c.opt_level = f.opt_level AND c.binary_name = f.binary_name AND c.dec = obs.dec)")
def _(d):
    new = _overlay_keys(d, "ged", "not perfect").where("split(key, '::')[1] <> 'proj_02'").select("key", (F.col("value") + 1).alias("value"), F.lit(None).cast("boolean").alias("perfect"))
    return overlays.overlay_ged(d, new).where("metric = 'ged'").select("fn_id", "dec", "value", "perfect")


@_data("overlay_byte_match", _SLICES % "byte_match" + "SELECT fn_id, dec, 1.0 AS value, true AS perfect, CASE WHEN fn_id % 2 = 0 THEN 0.0 END AS distance FROM new UNION ALL SELECT fn_id, dec, value, perfect, distance FROM obs JOIN v_fn f USING (fn_id) WHERE metric = 'byte_match' AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.project = f.project AND c.opt_level = f.opt_level AND c.binary_name = f.binary_name AND c.dec = obs.dec)")
def _(d):
    return overlays.overlay_byte_match(d, _byte_new(d))[0].where("metric = 'byte_match'").select("fn_id", "dec", "value", "perfect", "distance")


def _byte_new(d: Dataset) -> DataFrame:
    rows = _overlay_keys(d, "byte_match", "not perfect").where("split(key, '::')[1] <> 'proj_02'")
    return rows.select("key", F.lit(1.0).alias("value"), (F.col("fn_id") % 3 == 0).alias("compilable"), F.when(F.col("fn_id") % 2 == 0, F.lit(0.0)).alias("dist"))


@_data("compile_tally", _SLICES % "byte_match" + "SELECT dec, CAST(count(*) FILTER (WHERE fn_id % 3 = 0) AS BIGINT) AS comp, CAST(count(fn_id) AS BIGINT) AS tot FROM decs LEFT JOIN new USING (dec) GROUP BY dec")
def _(d):
    return overlays.compile_tally(d, _byte_new(d))


@_data("overlay_type_match", "SELECT fn_id, dec, CASE WHEN fn_id % 7 = 0 THEN 1.0 ELSE value END AS value, CASE WHEN fn_id % 7 = 0 THEN true ELSE perfect END AS perfect, CASE WHEN fn_id % 14 = 0 THEN 0.0 ELSE distance END AS distance FROM obs WHERE metric = 'type_match'")
def _(d):
    rows = d.obs.where("metric = 'type_match' and fn_id % 7 = 0").join(d.functions, "fn_id")
    new = rows.select("dec", F.concat_ws("::", *KEY).alias("key"), F.lit(1.0).alias("value"), F.when(F.col("fn_id") % 2 == 0, F.lit(0.0)).alias("dist"))
    return overlays.overlay_type_match(d, new).where("metric = 'type_match'").select("fn_id", "dec", "value", "perfect", "distance")


@_data("overlay_merge", "SELECT dec, CAST(fn_id AS VARCHAR) AS key, CASE WHEN fn_id % 3 = 0 THEN 0.5 ELSE value END AS value FROM obs WHERE metric = 'type_match' AND (fn_id % 2 = 0 OR fn_id % 3 = 0)")
def _(d):
    rows = d.obs.where("metric = 'type_match'").select("dec", F.col("fn_id").cast("string").alias("key"), "value", F.col("distance").alias("dist"), "fn_id")
    old, new = rows.where("fn_id % 2 = 0").drop("fn_id"), rows.where("fn_id % 3 = 0").withColumn("value", F.lit(0.5)).drop("fn_id")
    return overlays.merge_overlays(old, new).select("dec", "key", "value")


_COVER = """, c AS (SELECT concat_ws('::', project, opt_level, binary_name) AS group_key, counter, fn_id, dec FROM v_fn JOIN (
  SELECT fn_id, dec, concat(dec, '::', metric) AS counter FROM obs WHERE isfinite(value) UNION ALL SELECT fn_id, dec, concat(dec, '::decompiled') FROM v_obs WHERE decompiled UNION ALL SELECT fn_id, NULL, 'functions' FROM v_fn) USING (fn_id)) """


@_data("coverage_counts", _COVER + "SELECT group_key, counter, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL")
def _(d):
    return coverage.coverage_counts(d)


_SHRUNK = _COVER + ", o AS (SELECT group_key, counter, count(*) AS old_n, count(*) FILTER (WHERE dec IS NULL OR dec <> 'tool_a' OR fn_id % 3 <> 0) AS new_n FROM c GROUP BY ALL), s AS (SELECT * FROM o WHERE new_n < old_n AND NOT starts_with(group_key, 'proj_04::')) "


def _shrunk(d: Dataset) -> DataFrame:
    kept = "dec <> 'tool_a' or fn_id % 3 <> 0"
    less = d.having(obs=d.obs.where(kept), attempts=d.attempts.where(kept))
    return coverage.regressions(coverage.coverage_counts(d), coverage.coverage_counts(less), ["proj_04"], ["tool_c"])


@_data("coverage_regressions", _SHRUNK + "SELECT group_key, counter, CAST(old_n AS BIGINT) AS old_n, CAST(new_n AS BIGINT) AS new_n FROM s")
def _(d):
    return _shrunk(d)


@_data("regression_report", _SHRUNK + "SELECT group_key, split_part(counter, '::', 1) AS dec, CAST(sum(old_n) AS BIGINT) AS old_n, CAST(sum(new_n) AS BIGINT) AS new_n, CAST(count(*) AS BIGINT) AS counters FROM s GROUP BY ALL ORDER BY sum(old_n) - sum(new_n) DESC, group_key, dec LIMIT 100")
def _(d):
    return coverage.regression_report(_shrunk(d))


@_data("slice_audit", """, pub AS (SELECT f.project, f.opt_level, f.binary_name, dec, count(DISTINCT fn_id) AS pub FROM v_fn f JOIN obs USING (fn_id) WHERE fn_id % 4 = 0 OR project <> 'proj_06' GROUP BY ALL),
rows_ AS (SELECT DISTINCT project, opt_level, binary_name FROM v_fn WHERE project <> 'proj_07'),
base AS (SELECT f.project, f.opt_level, f.binary_name, dec, count(*) FILTER (WHERE decompiled AND (project <> 'proj_08' OR opt_level <> 'O0')) AS ck, count(*) FILTER (WHERE decompiled AND (project <> 'proj_08' OR opt_level <> 'O0')) AS art, count(*) FILTER (WHERE ged IS NOT NULL AND project <> 'proj_09') AS ov FROM v_fn f JOIN v_obs USING (fn_id) GROUP BY ALL),
x AS (SELECT b.*, sum(CASE WHEN ck > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY b.project, b.binary_name, b.dec) - CASE WHEN ck > 0 THEN 1 ELSE 0 END > 0 AS sib, r.project IS NOT NULL AS has, CASE WHEN b.project = 'proj_07' THEN 0 ELSE coalesce(p.pub, 0) END AS pub
  FROM base b LEFT JOIN rows_ r USING (project, opt_level, binary_name) LEFT JOIN pub p USING (project, opt_level, binary_name, dec)),
y AS (SELECT CASE WHEN NOT has THEN CASE WHEN ck > 0 OR art > 0 THEN 'SILENT-DROP' END WHEN pub = 0 AND ov > 0 THEN 'SILENT-DROP' WHEN ck = 0 AND art = 0 AND sib THEN 'DECOMPILE-FAILURE' WHEN ov = 0 AND ck > 0 AND art > 0 THEN 'OVERLAY-GAP'
  WHEN pub > 0 AND pub < 0.5 * CASE WHEN ck > 0 AND art > 0 THEN least(ck, art) ELSE greatest(ck, art) END THEN 'PARTIAL' END AS kind, * FROM x)
SELECT kind, project, opt_level, binary_name, dec, CAST(ck AS BIGINT) AS ckpt, CAST(art AS BIGINT) AS art, CAST(ov AS BIGINT) AS ov, CAST(pub AS BIGINT) AS pub FROM y WHERE kind IS NOT NULL""")
def _(d):
    keyed = lambda df: df.join(d.functions, "fn_id")
    made = keyed(d.attempts)
    lost = F.col("decompiled") & ((F.col("project") != "proj_08") | (F.col("opt_level") != "O0"))
    layer = made.select(*GROUP, "dec", F.when(lost, F.col("function_name")).alias("function_name"))
    ged = keyed(d.obs.where("metric = 'ged'")).where("project <> 'proj_09'").select(*GROUP, "dec", "function_name")
    pub = keyed(d.obs).where("(fn_id % 4 = 0 or project <> 'proj_06') and project <> 'proj_07'").select(*GROUP, "dec", "function_name").distinct()
    return coverage.audit(layer, layer, ged, pub, d.functions.where("project <> 'proj_07'"))


# --- universe, visibility ------------------------------------------------------------------------


def _named(d: Dataset) -> DataFrame:
    """Functions of which every eleventh has a placeholder name."""
    name = F.when(F.col("fn_id") % 11 == 0, F.concat(F.lit("sub_"), F.lower(F.hex("fn_id")))).otherwise(F.col("function_name"))
    return d.functions.withColumn("function_name", name)


@_data("function_universe", ", n AS (SELECT fn_id, project, opt_level, binary_name, CASE WHEN fn_id % 11 = 0 THEN concat('sub_', lower(printf('%x', fn_id))) ELSE function_name END AS function_name FROM v_fn) SELECT DISTINCT project, opt_level, binary_name, function_name FROM n WHERE fn_id IN (SELECT fn_id FROM obs) OR (fn_id % 11 <> 0 AND fn_id IN (SELECT fn_id FROM v_obs))")
def _(d):
    named = _named(d)
    rows = lambda df: df.select("fn_id", "dec").join(named, "fn_id").select(*KEY, "dec")
    return universe.universe(rows(d.obs), rows(d.attempts.where("decompiled")), rows(d.attempts.where("not decompiled")))


@_data("universe_attempts", ", r AS (SELECT DISTINCT project, opt_level, binary_name, dec FROM v_fn JOIN v_obs USING (fn_id)) SELECT f.project, f.opt_level, f.binary_name, f.function_name, r.dec, coalesce(o.decompiled, false) OR coalesce(o.ged IS NOT NULL OR type_match IS NOT NULL OR byte_match IS NOT NULL, false) AS decompiled FROM v_fn f JOIN r USING (project, opt_level, binary_name) LEFT JOIN v_obs o ON o.fn_id = f.fn_id AND o.dec = r.dec WHERE f.fn_id IN (SELECT fn_id FROM v_obs) AND (r.dec <> 'agent_x' OR o.fn_id IS NOT NULL)")
def _(d):
    rows = lambda df: df.select("fn_id", "dec").join(d.functions, "fn_id").select(*KEY, "dec")
    scored, made, failed = rows(d.obs), rows(d.attempts.where("decompiled")), rows(d.attempts.where("not decompiled"))
    runs = rows(d.attempts).select(*GROUP, "dec").distinct().withColumn("slice_scoped", F.col("dec") == "agent_x")
    return universe.attempts(universe.universe(scored, made, failed), runs, scored, made, failed)


@_data("representative_size", ", l AS (SELECT fn_id, pos, l_count FROM (SELECT fn_id, dec, fn_id % 97 + pos AS l_count, pos FROM v_obs JOIN decs USING (dec) WHERE decompiled)) SELECT project, opt_level, binary_name, function_name, CAST(arg_min(l_count, pos) AS BIGINT) AS size FROM l JOIN v_fn USING (fn_id) GROUP BY ALL")
def _(d):
    rows = d.attempts.where("decompiled").join(d.decs, "dec").join(d.functions.drop("size"), "fn_id")
    return universe.representative_size(rows.select(*KEY, "pos", (F.col("fn_id") % 97 + F.col("pos")).alias("line_count")))


@_data("unevaluated_groups", "SELECT project, opt_level, binary_name, bool_or(ged IS NOT NULL) AS evaluated, bool_or(decompiled) AS decompiled FROM v_fn JOIN v_obs USING (fn_id) GROUP BY ALL HAVING bool_or(ged IS NOT NULL) OR bool_or(decompiled)")
def _(d):
    rows = lambda df: df.join(d.functions, "fn_id")
    return universe.with_unevaluated(rows(d.obs.where("metric = 'ged'")), rows(d.attempts.where("decompiled")))


@_data("strip_decompilers", "SELECT dec, metric, CAST(count(*) AS BIGINT) AS n FROM obs WHERE dec NOT IN ('tool_a', 'tool_b') GROUP BY ALL")
def _(d):
    return visibility.strip(d, ["tool_a", "tool_b"]).obs.groupBy("dec", "metric").agg(F.count(F.lit(1)).alias("n"))


@_data("hide_by_base_name", "SELECT dec, CAST(sum(obs) AS BIGINT) AS obs, CAST(sum(flags) AS BIGINT) AS flags, CAST(sum(builds) AS BIGINT) AS builds FROM (SELECT dec, 1 AS obs, 0 AS flags, 0 AS builds FROM obs WHERE split_part(dec, '@', 1) <> 'tool_b' UNION ALL SELECT dec, 0, CASE WHEN split_part(dec, '@', 1) <> 'tool_b' THEN 1 ELSE 0 END, CASE WHEN byte_match IS NOT NULL THEN 1 ELSE 0 END FROM v_obs WHERE split_part(dec, '@', 1) <> 'tool_b' OR byte_match IS NOT NULL) GROUP BY dec")
def _(d):
    out = visibility.hide(d, ["tool_b"])
    one, none = F.lit(1), F.lit(0)
    rows = out.obs.select("dec", one.alias("obs"), none.alias("flags"), none.alias("builds"))
    tries = out.attempts.select("dec", none.alias("obs"), F.col("decompiled").isNotNull().cast("int").alias("flags"), F.col("compiles").isNotNull().cast("int").alias("builds"))
    return rows.unionByName(tries).groupBy("dec").agg(*[F.sum(c).alias(c) for c in ("obs", "flags", "builds")])


@_data("hidden_errors", _COMBO + f"SELECT preset, normalize, dec, {_NUM % 'NOT decompiled'} AS num, CAST(count(*) AS BIGINT) AS den FROM combo JOIN v_obs USING (fn_id) WHERE normalize = 0 AND dec <> 'tool_b@2.0' GROUP BY ALL")
def _(d):
    hidden = visibility.hide(d, ["tool_b"])
    return facts.errors(facts.combo_counts(facts.function_facts(hidden)), hidden.decs).where("normalize = 0")


@_data("malware_exclusion", "SELECT project, CAST(count(*) AS BIGINT) AS dropped FROM v_fn WHERE project IN ('proj_05', 'proj_06') GROUP BY project")
def _(d):
    bad = d.functions.withColumn("labels", F.when(F.col("project") == "proj_05", F.array(F.lit("malware"))).otherwise(F.array().cast("array<string>")))
    listed = d.functions.sparkSession.createDataFrame([("proj_06", True), ("proj_07", False)], "project string, is_malware boolean")
    return visibility.drop_malware(d.functions, visibility.malware_projects(bad, listed))[1]


# --- costs and history ---------------------------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("string").alias("dec"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).otherwise(0.0).alias("total_time"), (F.col("l_linenumber") - 1).alias("function_count"))


@_tables("decompile_time_stats", "SELECT CAST(l_suppkey % 4 AS VARCHAR) AS dec, sum(l_quantity) AS total_s, CAST(sum(l_linenumber - 1) AS BIGINT) AS functions, CAST(count(*) AS BIGINT) AS binaries, round(sum(l_quantity) / sum(l_linenumber - 1), 6) AS per_fn_mean_s, round(median(l_quantity / (l_linenumber - 1)), 6) AS per_fn_median_s FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6 GROUP BY 1")
def _(spark, sf_dir):
    return cost.decompile_times(_runs(spark, sf_dir)).withColumns({"per_fn_mean_s": F.round("per_fn_mean_s", 6), "per_fn_median_s": F.round("per_fn_median_s", 6)})


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("user_id").alias("session"), F.when(F.col("event_type") == "click", "assistant").otherwise("user").alias("type"), F.col("event_id").alias("line"), k.alias("input"), F.floor(k / 2).cast("bigint").alias("cached_input"), F.when(F.col("event_id") % 2 == 0, k * 3).alias("cache_write"), F.array(k, F.lit(1).cast("bigint")).alias("cache_write_parts"), (k % 7).alias("output"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@_tables("token_sums_assistant", f"SELECT user_id AS session, CAST(sum({_K}) AS BIGINT) AS input, CAST(sum({_K} // 2) AS BIGINT) AS cached_input, CAST(sum(CASE WHEN event_id % 2 = 0 THEN {_K} * 3 ELSE {_K} + 1 END) AS BIGINT) AS cache_write, CAST(sum({_K} % 7) AS BIGINT) AS output FROM events WHERE event_type = 'click' GROUP BY user_id")
def _(spark, sf_dir):
    return cost.assistant_tokens(_usage(spark, sf_dir))


@_tables("token_last_running_total", f"SELECT user_id AS session, CAST(greatest(k - k // 2, 0) AS BIGINT) AS input, CAST(k // 2 AS BIGINT) AS cached_input, CAST(0 AS BIGINT) AS cache_write, CAST(k % 7 AS BIGINT) AS output FROM (SELECT user_id, arg_max({_K}, event_id) AS k FROM events GROUP BY user_id)")
def _(spark, sf_dir):
    return cost.running_tokens(_usage(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = _usage(spark, sf_dir), _read(spark, sf_dir, "events")
    rows = u.join(e.select(F.col("event_id").alias("line"), "event_type", "value"), "line")
    return rows.select(F.concat(F.lit("agent_"), F.col("event_type")).alias("dec"), F.when(F.col("event_type") == "view", "free").when(F.col("event_type") != "error", "big").alias("model"), F.when(F.col("line") % 9 == 0, "FAILED").otherwise("ok").alias("status"), F.floor(F.col("value")).cast("double").alias("elapsed_s"), "input", "cached_input", F.col("output").alias("cache_write"), "output")


_CALLS = f"c AS (SELECT concat('agent_', event_type) AS dec, CASE WHEN event_type = 'view' THEN 'free' WHEN event_type <> 'error' THEN 'big' END AS model, event_id % 9 = 0 AS failed, CAST(floor(value) AS DOUBLE) AS s, {_K} AS k FROM events)"


@_tables("llm_costs", f"WITH {_CALLS} SELECT dec, max(model) AS model, CAST(count(*) AS BIGINT) AS functions, CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS failed, round(avg(s), 6) AS mean_s, median(s) AS median_s, sum(s) AS total_s, CAST(sum(k) AS BIGINT) AS input, CAST(sum(k // 2) AS BIGINT) AS cached_input, CAST(sum(k % 7) AS BIGINT) AS cache_write, CAST(sum(k % 7) AS BIGINT) AS output, CAST(count(k) AS BIGINT) AS sessions FROM c GROUP BY dec")
def _(spark, sf_dir):
    return cost.llm_costs(_calls(spark, sf_dir)).withColumn("mean_s", F.round("mean_s", 6))


@_tables("cost_dollars", f"WITH {_CALLS} SELECT dec, max(model) AS model, CASE WHEN max(model) = 'big' THEN round((sum(k) * 10 + sum(k // 2) * 1 + sum(k % 7) * 12.5 + sum(k % 7) * 40) / 1e6, 9) END AS total, CASE WHEN max(model) = 'big' THEN round((sum(k) * 10 + sum(k // 2) * 1 + sum(k % 7) * 12.5 + sum(k % 7) * 40) / 1e6 / count(*), 12) END AS per_function FROM c GROUP BY dec")
def _(spark, sf_dir):
    prices = spark.createDataFrame([("big", 10.0, 1.0, 12.5, 40.0), ("free", 0.0, 0.0, 0.0, 0.0)], "model string, input double, cached_input double, cache_write double, output double")
    return cost.dollars(cost.llm_costs(_calls(spark, sf_dir)), prices).withColumns({"total": F.round("total", 9), "per_function": F.round("per_function", 12)})


@_tables("cost_block", f"WITH {_CALLS}, b AS (SELECT CASE l_suppkey % 4 WHEN 0 THEN 'agent_view' ELSE CAST(l_suppkey % 4 AS VARCHAR) END AS dec, sum(l_quantity) / sum(l_linenumber - 1) AS m, median(l_quantity / (l_linenumber - 1)) AS d, sum(l_linenumber - 1) AS f, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 6 GROUP BY 1), a AS (SELECT dec, avg(s) AS m, median(s) AS d, count(*) AS f FROM c GROUP BY dec)\nSELECT dec, round(coalesce(a.m, b.m), 6) AS mean_s, round(coalesce(a.d, b.d), 6) AS median_s, CAST(coalesce(a.f, b.f) AS BIGINT) AS n_functions, CAST(CASE WHEN a.m IS NULL THEN b.n END AS BIGINT) AS n_binaries, CASE WHEN a.m IS NULL THEN 'batch' ELSE 'per-function' END AS basis FROM a FULL JOIN b USING (dec) WHERE dec IN ('agent_view', 'agent_click', '1', '2')")
def _(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("dec", F.when(F.col("dec") == "0", "agent_view").otherwise(F.col("dec")))
    shown = spark.createDataFrame([("agent_view",), ("agent_click",), ("1",), ("2",)], "dec string")
    return cost.cost_block(cost.decompile_times(runs), cost.llm_costs(_calls(spark, sf_dir)), shown).withColumns({"mean_s": F.round("mean_s", 6), "median_s": F.round("median_s", 6)})


@_data("history_points", """, meas AS (SELECT DISTINCT fn_id, metric FROM obs), den AS (SELECT metric, count(*) AS den FROM meas GROUP BY metric), o AS (SELECT count(DISTINCT fn_id) FILTER (WHERE perfect AND dec = 'tool_b@2.0') * 100.0 / count(DISTINCT fn_id) AS overall FROM obs)
SELECT 'tool_b' AS dec, '2.0' AS version, metric, round(count(*) FILTER (WHERE perfect AND dec = 'tool_b@2.0') * 100.0 / any_value(den), 6) AS pct, round(any_value(overall), 6) AS overall FROM obs JOIN den USING (metric), o GROUP BY metric""")
def _(d):
    f = facts.function_facts(d)
    rows = history.history_points(scoreboard.scoreboard_metric(d, f), scoreboard.scoreboard_overall(d, f), "tool_b")
    return rows.withColumns({"pct": F.round("pct", 6), "overall": F.round("overall", 6)})


# --- publishing ----------------------------------------------------------------------------------


@_data("publish_manifest", "SELECT project, opt_level, binary_name, string_agg(function_name, ',' ORDER BY function_name) AS functions, CAST(count(*) AS BIGINT) AS n FROM fn WHERE list_contains(datasets, 'large') GROUP BY ALL")
def _(d):
    return publish.manifest(d.functions, "large").withColumn("functions", F.array_join("functions", ","))


@_data("dataset_index", "SELECT config, CAST(count(DISTINCT project) AS BIGINT) AS projects, CAST(count(DISTINCT (project, opt_level, binary_name)) AS BIGINT) AS binaries, CAST(count(*) AS BIGINT) AS functions FROM (SELECT *, unnest(list_append(datasets, 'full')) AS config FROM fn) GROUP BY config")
def _(d):
    return publish.index_counts(d.functions)


@_data("select_groups", "SELECT DISTINCT project, opt_level, binary_name FROM fn WHERE list_has_any(datasets, ['large', 'sample-set']) ORDER BY ALL LIMIT 50")
def _(d):
    return publish.select_groups(d.functions, ["large", "sample-set"], 50)


@_tables("content_dedup", "WITH u AS (SELECT source AS project, concat('u', n_chars % 5) AS stem, sha256(text) AS sha FROM documents), f AS (SELECT project, sha, min(stem) AS stem FROM u GROUP BY ALL) SELECT project, sha, CASE WHEN row_number() OVER (PARTITION BY project, stem ORDER BY sha) = 1 THEN stem || '.c' ELSE stem || '.' || left(sha, 8) || '.c' END AS file FROM f")
def _(spark, sf_dir):
    return publish.content_dedup(_read(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.concat(F.lit("u"), F.col("n_chars") % 5).alias("stem"), F.col("text").alias("content")))


_TRACKED = "p AS (SELECT concat(project, '/', opt_level, '/', binary_name) AS path, fn_id FROM v_fn)"


@_data("orphan_paths", f", {_TRACKED} SELECT concat_ws('/', split_part(path, '/', 1), split_part(path, '/', 2)) AS top, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT path FROM p WHERE path NOT IN (SELECT path FROM p WHERE fn_id % 50 = 0) AND NOT starts_with(path, 'proj_00/')) GROUP BY top")
def _(d):
    paths = d.functions.select(F.concat_ws("/", *GROUP).alias("path"), "fn_id")
    lost = publish.orphans(paths.select("path").distinct(), paths.where("fn_id % 50 = 0"), ["proj_00/"])
    return publish.orphan_counts(lost)


def _cfgs(d: Dataset) -> DataFrame:
    return d.functions.select(F.col("binary_name").alias("unit"), F.concat(F.lit("f"), (F.col("fn_id") % 500).cast("string")).alias("name"), (F.coalesce("size", F.lit(0)) % 5).alias("nodes"), (F.col("fn_id") % 3 == 0).alias("all_nop")).groupBy("unit", "name").agg(F.max("nodes").alias("nodes"), F.min("all_nop").alias("all_nop"))


_CFG = ", c AS (SELECT binary_name AS unit, concat('f', fn_id % 500) AS name, max(coalesce(size, 0) % 5) AS nodes, bool_and(fn_id % 3 = 0) AS all_nop FROM v_fn GROUP BY 1, 2), q AS (SELECT *, NOT (nodes = 0 OR (nodes = 1 AND all_nop)) AS good FROM c), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY good DESC, nodes DESC, unit) AS r FROM q) WHERE r = 1) "


@_data("best_source_by_name", _CFG + "SELECT unit, name, nodes, all_nop, good FROM best")
def _(d):
    return publish.best_source(_cfgs(d))


@_data("resolve_source", _CFG + "SELECT c.unit AS stem, c.name, CASE WHEN q.good THEN q.unit ELSE best.unit END AS unit, CASE WHEN q.good THEN q.nodes ELSE best.nodes END AS nodes FROM c JOIN q ON q.unit = c.unit AND q.name = c.name JOIN best ON best.name = c.name")
def _(d):
    c = _cfgs(d)
    return publish.resolve_source(c.select(F.col("unit").alias("stem"), "name"), c)


# --- text, formatting, kernels -------------------------------------------------------------------


@_tables("code_metrics", "SELECT doc_id, CAST(len(string_split(code, 'goto ')) - 1 AS BIGINT) AS gotos, CAST(len(string_split(code, ' && ')) + len(string_split(code, ' || ')) - 2 AS BIGINT) AS bools FROM (SELECT doc_id, replace(replace(replace(text, 'the ', 'goto '), ' of ', ' && '), ' in ', ' || ') AS code FROM documents)")
def _(spark, sf_dir):
    code = F.col("text")
    for word, to in (("the ", "goto "), (" of ", " && "), (" in ", " || ")):
        code = F.replace(code, F.lit(word), F.lit(to))
    gotos, bools = X.code_metrics(code)
    return _read(spark, sf_dir, "documents").select("doc_id", gotos.alias("gotos"), bools.alias("bools"))


@_tables("operand_normalise", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN page_id % 3 = 1 THEN concat('0x', page_id) ELSE 'X' END WHEN 1 THEN 'rax, [rip+X]'
  WHEN 2 THEN CASE WHEN page_id % 3 = 2 THEN '[rax + X]' ELSE concat('[rax + ', page_id, ']') END ELSE CASE WHEN page_id % 3 = 1 THEN concat('x0, #', page_id) ELSE 'xX, X' END END AS normal FROM pages""")
def _(spark, sf_dir):
    i = F.col("page_id")
    mnemonic = F.when(i % 3 == 0, "call").when(i % 3 == 1, "mov").otherwise("adrp")
    operands = F.when(i % 4 == 0, F.concat(F.lit("0x"), i)).when(i % 4 == 1, F.concat(F.lit("rax, [rip + 0x"), i, F.lit("]"))).when(i % 4 == 2, F.concat(F.lit("[rax + "), i, F.lit("]"))).otherwise(F.concat(F.lit("x0, #"), i))
    return _read(spark, sf_dir, "pages").select("page_id", X.normalize_operands(mnemonic, operands).alias("normal"))


#: The text cut at each @; where a register's name follows, it goes with the blanks before the @.
@_tables("sanitize_c", """WITH p AS (SELECT doc_id, string_split(text, '@') AS parts FROM documents), q AS (SELECT doc_id, parts, list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN 0 ELSE length(regexp_extract(x, '^\\s*[a-z]\\w+')) END) AS cut FROM p)
SELECT doc_id, array_to_string(list_transform(parts, lambda x, i: concat(CASE WHEN i > 1 AND cut[i] = 0 THEN '@' ELSE '' END, CASE WHEN coalesce(cut[i + 1], 0) > 0 THEN rtrim(substr(x, cut[i] + 1), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE substr(x, cut[i] + 1) END)), '') AS code FROM q""")
def _(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", X.sanitize_c(F.col("text")).alias("code"))


@_tables("asm_jaccard_set", """WITH s AS (SELECT conv_id, list_distinct(list(role || length(text) % 7) FILTER (WHERE turn % 2 = 0)) AS a, list_distinct(list(role || length(text) % 5) FILTER (WHERE turn % 2 = 1)) AS b FROM conversations GROUP BY conv_id), t AS (SELECT conv_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
SELECT conv_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS alike, CAST(len(list_distinct(list_concat(a, b))) - len(list_intersect(a, b)) AS INT) AS changed FROM t""")
def _(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    side = lambda r, k: F.array_distinct(F.array_compact(F.collect_list(F.when(F.col("turn") % 2 == r, F.concat("role", (F.length("text") % k).cast("string"))))))
    rows = c.groupBy("conv_id").agg(side(0, 7).alias("a"), side(1, 5).alias("b"))
    like, changed = X.set_jaccard(F.col("a"), F.col("b"))
    return rows.select("conv_id", F.round(like, 6).alias("alike"), changed.cast("int").alias("changed"))


@_data("ratio_bands", "SELECT fn_id, round(p, 6) AS pct, CASE WHEN p >= 50 THEN 'high' WHEN p >= 20 THEN 'mid' ELSE 'low' END AS band, CASE WHEN p < 2 THEN 'high' WHEN p < 10 THEN 'mid' ELSE 'low' END AS error_band, concat(repeat('#', CAST(floor(p / 100 * 20 + 0.5) AS INT)), repeat('.', 20 - CAST(floor(p / 100 * 20 + 0.5) AS INT))) AS bar FROM (SELECT fn_id, coalesce(size % 101, 0) * 100.0 / 128 AS p FROM v_fn)")
def _(d):
    p = P.percent(F.coalesce(F.col("size") % 101, F.lit(0)), F.lit(128))
    return d.functions.select("fn_id", F.round(p, 6).alias("pct"), P.percent_band(p).alias("band"), P.error_band(p).alias("error_band"), P.bar(p).alias("bar"))


@_data("metrics_table", _COMBO + "SELECT d.dec, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE m.metric = '{m}' AND o.perfect) / greatest(1, count(*) FILTER (WHERE m.metric = '{m}')), 6) AS {m}" for m in ("byte_match", "ged", "type_match")) + " FROM combo c JOIN meas m USING (fn_id) CROSS JOIN decs d LEFT JOIN obs o ON o.fn_id = c.fn_id AND o.dec = d.dec AND o.metric = m.metric WHERE preset = 'optimized' AND normalize = 0 GROUP BY d.dec")
def _(d):
    return payloads.metrics_table(facts.per_metric(facts.combo_counts(facts.function_facts(d)), d.decs), "optimized", 0, ["byte_match", "ged", "type_match"])


@_data("distance_table", _COMBO + ", s AS (SELECT dec, metric, avg(distance) AS mean FROM combo JOIN obs USING (fn_id) WHERE preset = 'optimized' AND normalize = 0 GROUP BY ALL) SELECT s.dec, metric, round(mean, 6) AS mean, NOT sample_only AND mean <= min(mean) FILTER (WHERE NOT sample_only) OVER (PARTITION BY metric) + 1e-9 AS best FROM s JOIN decs USING (dec)")
def _(d):
    return payloads.distance_table(facts.distance_stats(facts.function_facts(d)), d.decs, "optimized", 0).withColumn("mean", F.round("mean", 6))


@_data("shift_election", kernel_tables.SHIFT_SQL)
def _(d):
    return kernel_tables.elected(d)


@_data("name_offsets", "SELECT fn_id, CASE WHEN fn_id % 3 = 0 THEN CAST(fn_id % 100 AS BIGINT) WHEN fn_id % 3 = 1 THEN -CAST(fn_id % 100 AS BIGINT) END AS slot FROM v_fn")
def _(d):
    name = F.when(F.col("fn_id") % 3 == 1, F.concat(F.lit("local_"), F.lower(F.hex(F.col("fn_id") % 100)))).otherwise(F.lit("v"))
    given = F.when(F.col("fn_id") % 3 == 0, (F.col("fn_id") % 100).cast("bigint"))
    return d.functions.select("fn_id", X.name_offset(name, given).alias("slot"))


@_data("graph_stats", kernel_tables.GRAPH_SQL)
def _(d):
    return kernel_tables.graph_rows(d)


#: Closed forms: a graph against itself or without one edge; slots that all meet; listings of which one is part of the other.
@_data("ged_exact", ", g AS (SELECT fn_id, coalesce(size, 0) % 9 AS n FROM v_fn) SELECT fn_id, CASE WHEN n = 0 THEN CAST('infinity' AS DOUBLE) WHEN fn_id % 2 = 1 OR n < 2 THEN 0.0 ELSE 1.0 END AS distance FROM g")
def _(d):
    return kernel_tables.graph_distances(d)


@_data("type_match_score", "SELECT fn_id, CAST(1 AS DOUBLE) AS value, CAST(coalesce(size, 3) % 4 + 1 AS INT) AS tp, 0 AS fp, 0 AS fn, CAST(substr(project, 6, 2) AS INT) - 6 AS shift, 0 AS by_arg, CAST(coalesce(size, 3) % 4 + 1 AS INT) AS by_offset, 0 AS by_name FROM v_fn")
def _(d):
    return kernel_tables.type_scores(d)


@_data("asm_line_diff", ", l AS (SELECT fn_id, coalesce(size, 0) % 40 + 1 AS n FROM v_fn), k AS (SELECT fn_id, n, len(list_filter(range(0, CAST(n AS BIGINT)), lambda i: (i + fn_id) % 3 <> 0)) AS m FROM l) SELECT fn_id, CAST(m AS DOUBLE) / n AS like, CAST(n - m AS INT) AS changed FROM k".replace("AS like", 'AS "like"'))
def _(d):
    return kernel_tables.line_diffs(d)


# --- repairs and registries ----------------------------------------------------------------------


def _keyed_attempts(d: Dataset) -> DataFrame:
    return d.attempts.join(d.functions, "fn_id")


@_data("fix_flags", "SELECT dec, CAST(count(*) FILTER (WHERE decompiled OR (fn_id % 3 = 0 AND (dec <> 'agent_x' OR fn_id % 2 = 0))) AS BIGINT) AS n FROM v_obs GROUP BY dec")
def _(d):
    rows = _keyed_attempts(d)
    out = repairs.fix_flags(rows.select(*KEY, "dec", "decompiled"), rows.where("fn_id % 3 = 0"), ["agent_x"], d.functions.where("fn_id % 2 = 0"))
    return out.groupBy("dec").agg(F.count_if("decompiled").alias("n"))


@_data("prune_off_slice", "SELECT dec, CASE WHEN dec <> 'agent_x' THEN 'kept' WHEN fn_id % 2 = 0 THEN 'retained' WHEN ged IS NOT NULL THEN 'anomaly' ELSE 'pruned' END AS fate, CAST(count(*) AS BIGINT) AS n FROM v_obs GROUP BY ALL")
def _(d):
    ged = d.obs.where("metric = 'ged'").select("fn_id", "dec", "value")
    rows = _keyed_attempts(d).join(ged, ["fn_id", "dec"], "left").select(*KEY, "dec", "value")
    return repairs.prune_off_slice(rows, ["agent_x"], d.functions.where("fn_id % 2 = 0")).groupBy("dec", "fate").agg(F.count(F.lit(1)).alias("n"))


@_data("overlay_comparison", "SELECT dec, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS old_mean, round(avg(CASE WHEN fn_id % 4 = 0 THEN 1.0 ELSE value END), 6) AS new_mean, CAST(count(*) FILTER (WHERE fn_id % 4 = 0 AND value < 1) AS BIGINT) AS improved, CAST(0 AS BIGINT) AS worse FROM obs WHERE metric = 'type_match' AND fn_id % 2 = 0 GROUP BY dec")
def _(d):
    old = d.obs.where("metric = 'type_match'").select("fn_id", "dec", "value")
    new = old.where("fn_id % 2 = 0").withColumn("value", F.when(F.col("fn_id") % 4 == 0, 1.0).otherwise(F.col("value")))
    return repairs.compare_scores(old, new).withColumns({"old_mean": F.round("old_mean", 6), "new_mean": F.round("new_mean", 6)})


@_data("registry_lookup", "SELECT dec, CASE dec WHEN 'tool_a' THEN 'Tool A' WHEN 'tool_b@2.0' THEN 'Tool B' END AS display FROM decs")
def _(d):
    known = d.functions.sparkSession.createDataFrame([("tool_a", "Tool A"), ("tool_b", "Tool B"), ("other", "Other")], "id string, display string")
    return repairs.with_registry(d.decs.select("dec"), known)


@_data("compile_report", "SELECT project, CAST(count(*) FILTER (WHERE opt_level = 'O0') AS BIGINT) AS \"O0\", CAST(count(*) FILTER (WHERE opt_level = 'O2' AND project <> 'proj_03') AS BIGINT) AS \"O2\", CAST(count(*) FILTER (WHERE opt_level = 'O2-noinline') AS BIGINT) AS \"O2-noinline\", CASE WHEN project = 'proj_03' THEN 'partial' ELSE 'ok' END AS state FROM (SELECT DISTINCT project, opt_level, binary_name FROM v_fn) GROUP BY project")
def _(d):
    built = d.functions.where("project <> 'proj_03' or opt_level <> 'O2'").groupBy("project", "opt_level").agg(F.countDistinct("binary_name").alias("n"))
    return repairs.compile_report(built)


@_tables("lines_of_code", "SELECT source AS project, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS loc FROM documents WHERE n_chars % 7 <> 0 GROUP BY source")
def _(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("project"), F.when(F.col("n_chars") % 7 == 0, "conftest.c").otherwise("a.c").alias("file"), F.explode(F.split("text", "\n")))
    return repairs.lines_of_code(lines)


from . import registry_site  # noqa: E402, F401  registers the rest with the decorators above
