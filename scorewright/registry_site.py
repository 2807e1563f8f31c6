"""More queries with their SQL: samples, sources, the site's tables, acquisition and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import c_text, kernels
from .functions import predicates as P
from .operators import acquisition, facts, repairs, samples, sampling, scoreboard, site, source_lookup
from .plans import payloads
from .plans.dataset import Dataset
from .registry import _COMBO, GROUP, KEY, _data, _read, _tables

# --- samples --------------------------------------------------------------------------------------


def _code(d: Dataset) -> DataFrame:
    """Code of each tool that decompiled a function: its name and the tool's."""
    rows = d.attempts.where("decompiled").join(d.functions.select("fn_id", "function_name"), "fn_id")
    return rows.select("fn_id", "dec", F.concat_ws(":", "function_name", "dec").alias("text"))


def _joined(code: str = "code") -> F.Column:
    return F.array_join(F.transform(F.map_entries(code), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


_CODED = ", coded AS (SELECT fn_id, string_agg(concat(o.dec, '=', function_name, ':', o.dec), ';' ORDER BY o.dec) AS code FROM v_obs o JOIN v_fn USING (fn_id) WHERE decompiled GROUP BY fn_id)"


@_data("tier_samples", _CODED + " SELECT fn_id, tier, code FROM (SELECT fn_id, CASE fn_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS tier, code, row_number() OVER (PARTITION BY fn_id % 3 ORDER BY size DESC NULLS LAST, fn_id) AS r FROM v_fn JOIN coded USING (fn_id)) WHERE r <= 40")
def _(d):
    tier = F.when(F.col("fn_id") % 3 == 0, "easy").when(F.col("fn_id") % 3 == 1, "medium").otherwise("hard")
    candidates = d.functions.select("fn_id", tier.alias("tier"), F.coalesce(-F.col("size"), F.lit(1)).alias("place"))
    return samples.tiered(candidates, _code(d), 40).select("fn_id", "tier", _joined().alias("code"))


@_data("sample_set_samples", _CODED + " SELECT fn_id, code, CASE WHEN fn_id % 5 = 0 THEN concat('src ', fn_id) END AS source, CASE WHEN fn_id % 5 = 0 THEN '' WHEN fn_id % 5 = 1 THEN 'extract_failed' ELSE 'binary_not_found' END AS status FROM fn JOIN coded USING (fn_id) WHERE list_contains(datasets, 'sample-set')")
def _(d):
    source = d.functions.where("fn_id % 5 < 2").select("fn_id", F.when(F.col("fn_id") % 5 == 0, F.concat(F.lit("src "), "fn_id")).alias("source"), F.when(F.col("fn_id") % 5 == 0, "").otherwise("extract_failed").alias("status"))
    return samples.sample_set(d.functions, _code(d), source).select("fn_id", _joined().alias("code"), "source", "status")


@_data("finite_sample_values", "SELECT metric, CAST(count(*) AS BIGINT) AS n FROM obs WHERE fn_id % 7 > 1 GROUP BY metric")
def _(d):
    odd = F.when(F.col("fn_id") % 7 == 0, F.lit(float("inf"))).when(F.col("fn_id") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return samples.finite_values(d.obs.withColumn("value", odd)).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@_data("binary_limit", "SELECT project, opt_level, binary_name FROM (SELECT *, row_number() OVER (PARTITION BY project, opt_level ORDER BY binary_name) AS r FROM (SELECT DISTINCT project, opt_level, binary_name FROM v_fn)) WHERE r <= 3")
def _(d):
    return samples.head(d.functions.select(*GROUP).distinct(), GROUP[:2], [F.col("binary_name")], 3)


@_data("seeded_binaries", "SELECT project, opt_level, binary_name FROM (SELECT *, row_number() OVER (PARTITION BY project, opt_level ORDER BY md5(concat('42:', binary_name)), binary_name) AS r FROM (SELECT DISTINCT project, opt_level, binary_name FROM v_fn)) WHERE r <= 2")
def _(d):
    return samples.seeded(d.functions.select(*GROUP).distinct(), GROUP[:2], "binary_name", 2, 42)


@_data("manifest_gate", "SELECT project, CAST(count(*) AS BIGINT) AS n FROM v_fn WHERE fn_id % 17 = 0 GROUP BY project")
def _(d):
    manifest = d.functions.where("fn_id % 17 = 0").select(*KEY)
    return samples.allowed(d.functions, manifest.unionByName(manifest), GROUP).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@_data("improvements_limited", ", c AS (SELECT fn_id, a.value AS base_value, b.value AS target_value FROM obs a JOIN obs b USING (fn_id) WHERE a.metric = 'ged' AND b.metric = 'ged' AND a.dec = 'tool_a' AND b.dec = 'tool_c' AND a.value < b.value) SELECT CAST(row_number() OVER (ORDER BY target_value - base_value DESC, project, opt_level, binary_name, function_name) AS INT) AS place, concat(project, '/', opt_level, '/', binary_name, '/', function_name, ': ', printf('%.3f', base_value), ' vs ', printf('%.3f', target_value)) AS line FROM c JOIN v_fn USING (fn_id) QUALIFY place <= 25")
def _(d):
    ged = d.obs.where("metric = 'ged'")
    base = ged.where("dec = 'tool_a'").select("fn_id", F.col("value").alias("base_value"))
    rows = base.join(ged.where("dec = 'tool_c'").select("fn_id", F.col("value").alias("target_value")), "fn_id").where("base_value < target_value").join(d.functions, "fn_id")
    order = [F.desc(F.col("target_value") - F.col("base_value")), *KEY]
    top = samples.head(rows.withColumn("all", F.lit(1)), ["all"], [F.desc(F.col("target_value") - F.col("base_value")), *[F.col(k) for k in KEY]], 25)
    return site.improvement_lines(payloads.placed(top, order))


# --- sources --------------------------------------------------------------------------------------


@_tables("function_source_status", """WITH w AS (SELECT doc_id, concat('bin', doc_id % 6) AS bin, concat('f', doc_id) AS function_name FROM documents)
SELECT bin, function_name, CASE doc_id % 6 WHEN 0 THEN concat('int f', doc_id, '(void) { return ', doc_id, '; }') WHEN 1 THEN concat('int f', doc_id, '(a) int a; { return a; }') END AS source,
  CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'preprocessed' WHEN 2 THEN 'extract_failed' WHEN 3 THEN 'func_not_in_sources' WHEN 4 THEN 'no_source_files' ELSE 'binary_not_found' END AS status FROM w""")
def _(spark, sf_dir):
    i = F.col("doc_id")
    ids = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("bin"), i % 6).alias("binary"), F.concat(F.lit("f"), i).alias("function_name"))
    wanted = ids.select("binary", "function_name", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("file"))
    name = F.col("function_name")
    plain = F.concat(F.lit("int other(void) { return "), name, F.lit("(); }\nint "), name, F.lit("(void) { return "), i, F.lit("; }\n"))
    old = F.concat(F.lit("int "), name, F.lit("(a) int a; { return a; }\n"))
    only = F.concat(F.lit("int "), name, F.lit("(int x);\n"))
    text = F.when(i % 6 == 0, plain).when(i % 6 == 1, old).when(i % 6 == 2, only).otherwise(F.concat(F.lit("int x"), name, F.lit("(void) { }")))
    files = ids.where(i % 6 < 4).select(F.concat("binary", F.lit("-"), i).alias("binary"), F.concat(F.lit("m"), i, F.when(i % 6 == 1, ".i").otherwise(".c")).alias("path"), text.alias("text"))
    wanted = wanted.withColumn("binary", F.concat("binary", F.lit("-"), F.substring("function_name", 2, 20)))
    known = wanted.where(~F.startswith("binary", F.lit("bin5"))).select("binary")
    out = source_lookup.function_sources(wanted, known, files)
    return out.select(F.substring_index("binary", "-", 1).alias("bin"), "function_name", "source", "status")


@_tables("renamed_definitions", "SELECT doc_id, concat('int target(int a) { return target(a) + f', doc_id, 'x; }') AS code, concat('char s[] = \"\"; /', '/ ') AS plain FROM documents")
def _(spark, sf_dir):
    name = F.concat(F.lit("f"), "doc_id")
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("int "), name, F.lit("(int a) { return "), name, F.lit("(a) + "), name, F.lit("x; }")).alias("code"))
    bare = c_text.without_literals_udf()(F.concat(F.lit('char s[] = "'), "code", F.lit('"; /* '), "code", F.lit(" */")))
    return docs.select("doc_id", c_text.renamed_udf()("code", F.lit("target")).alias("code"), F.concat(F.rtrim(bare), F.lit(" // ")).alias("plain"))


@_tables("repaired_tokens", "SELECT doc_id, concat('int g', doc_id, '(int a) { return stderr_', doc_id, ' >> 2 + 3; puts(\"std::x __cdecl\"); }') AS code FROM documents")
def _(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    code = F.concat(F.lit("int __cdecl g"), i, F.lit("(int a @ rax) { return GLIBC_2.2.5::stderr_"), i, F.lit(' u>> 2 + 3f; puts("std::x __cdecl"); }'))
    return _read(spark, sf_dir, "documents").select("doc_id", c_text.sanitize_tokens_udf()(code).alias("code"))


@_tables("c_variables", "SELECT doc_id, concat('fp:FILE *:arg:0,c', doc_id, ':int:arg:1,v:unsigned long:stack:') AS vars FROM documents")
def _(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    code = F.concat(F.lit("int f(FILE *fp, int c"), i, F.lit(")\n{\n  unsigned long v = f(2);\n  int c"), i, F.lit(";\n  return v;\n}"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", c_text.variables_udf()(code, F.lit("f")).alias("v"))
    one = lambda v: F.concat_ws(":", v["name"], v["type"], v["kind"], F.coalesce(v["arg_index"].cast("string"), F.lit("")))
    return rows.select("doc_id", F.array_join(F.transform("v", one), ",").alias("vars"))


@_tables("line_of_position", "SELECT doc_id, CAST(len(string_split(substr(text, 1, CAST(n_chars // 2 AS BIGINT)), chr(10))) AS INT) AS line FROM documents")
def _(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", P.line_of(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line"))


@_tables("human_sizes", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN concat(n_chars, ' B') WHEN n_chars < 1048576 THEN printf('%.1f KiB', n_chars / 1024) ELSE printf('%.1f MiB', n_chars / 1048576) END AS size FROM documents")
def _(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", P.human_bytes(F.col("n_chars")).alias("size"))


# --- the site's tables ----------------------------------------------------------------------------


def _presets(d: Dataset) -> DataFrame:
    stored = [("unoptimized", "Stored U", None, 0), ("optimized", None, "kept", 1), ("inlined", None, None, 2)]
    return d.functions.sparkSession.createDataFrame(stored, "name string, title string, description string, pos int")


def _texts(d: Dataset) -> DataFrame:
    known = [("optimized", "Optimised code", None, True), ("unoptimized", "Plain code", "without", False), ("gone", "Gone", "x", True)]
    return d.functions.sparkSession.createDataFrame(known, "name string, title string, description string, is_default boolean")


@_data("preset_texts", "SELECT * FROM (VALUES ('unoptimized', 'Plain code', 'without', 0), ('optimized', 'Optimised code', 'kept', 1), ('inlined', 'inlined', '', 2)) t(name, title, description, pos)", raw=True)
def _(d):
    return site.preset_texts(_presets(d), _texts(d))


@_data("default_preset", "SELECT 'optimized' AS name", raw=True)
def _(d):
    return site.default_preset(_presets(d), _texts(d))


@_data("ordered_metrics", "SELECT metric, CAST(row_number() OVER (ORDER BY CASE metric WHEN 'type_match' THEN 0 WHEN 'ged' THEN 1 ELSE 2 END, pos) AS INT) AS place FROM metrics")
def _(d):
    known = d.functions.sparkSession.createDataFrame([("type_match", 1), ("ged", 2), ("other", 0)], "metric string, order int")
    return site.ordered_metrics(d.metrics, known)


@_data("tool_cards", "SELECT dec, CASE split_part(dec, '@', 1) WHEN 'tool_a' THEN 'Tool A' WHEN 'tool_b' THEN 'Tool B' ELSE dec END AS display, CASE split_part(dec, '@', 1) WHEN 'tool_a' THEN 'MIT' END AS license, CASE WHEN dec = 'tool_b@2.0' THEN '2 (final)' WHEN dec = 'tool_a' THEN '1.x' END AS version FROM decs")
def _(d):
    new = d.functions.sparkSession.createDataFrame
    known = new([("tool_a", "Tool A", "MIT", {"x": "y"}), ("tool_b", "Tool B", None, {"2.0": "2 (final)"})], "id string, display string, license string, versions map<string,string>")
    return site.tool_cards(d.decs, known, new([("tool_a", "1.x"), ("tool_b@2.0", "2.0")], "dec string, raw string"))


@_data("compile_rates", ", r AS (SELECT dec, CAST(count(*) FILTER (WHERE byte_match >= 0.5) AS BIGINT) AS compiled, CAST(count(*) AS BIGINT) AS total FROM v_obs WHERE byte_match IS NOT NULL GROUP BY dec) SELECT dec, compiled, total, round(compiled * 100.0 / total, 6) AS pct, CAST(row_number() OVER (ORDER BY compiled * 100.0 / total DESC, pos) AS INT) AS place FROM r JOIN decs USING (dec)")
def _(d):
    return site.compile_table(site.compile_rates(d.attempts), d.decs).withColumn("pct", F.round("pct", 6))


@_data("cost_table", "SELECT dec, median, sample_only, CAST(row_number() OVER (PARTITION BY sample_only ORDER BY median NULLS LAST, pos) AS INT) AS place FROM (SELECT dec, sample_only, pos, CASE WHEN dec <> 'tool_a' THEN (SELECT median(size) FROM v_fn JOIN v_obs o USING (fn_id) WHERE o.dec = d.dec) END AS median FROM decs d)")
def _(d):
    rows = d.attempts.join(d.functions.select("fn_id", "size"), "fn_id").groupBy("dec").agg(F.median("size").alias("median"))
    return site.cost_table(rows.withColumn("median", F.when(F.col("dec") != "tool_a", F.col("median"))), d.decs)


@_data("preferred_costs", ", n AS (SELECT dec, CAST(count(*) AS DOUBLE) AS total FROM v_obs GROUP BY dec) SELECT dec, CASE WHEN dec IN ('tool_a', 'tool_c') THEN total ELSE total + 1 END AS total, CASE WHEN dec IN ('tool_a', 'tool_c') THEN 1.0 ELSE 2.0 END AS median, CASE WHEN dec IN ('tool_a', 'tool_c') THEN 'structured' ELSE 'trace' END AS origin FROM n WHERE dec <> 'agent_x'")
def _(d):
    n = d.attempts.groupBy("dec").agg(F.count(F.lit(1)).cast("double").alias("total"))
    structured = n.where("dec in ('tool_a', 'tool_c')").withColumn("median", F.lit(1.0))
    traced = n.where("dec in ('tool_a', 'tool_b@2.0')").select("dec", (F.col("total") + 1).alias("total"), F.lit(2.0).alias("median"))
    return site.preferred_costs(structured, traced)


@_data("leaderboard_table", _COMBO + """, one AS (SELECT DISTINCT fn_id FROM meas), good AS (SELECT DISTINCT o.fn_id, dec FROM obs o JOIN meas USING (fn_id, metric) WHERE perfect), r AS (
  SELECT d.dec, any_value(pos) AS pos, count(g.dec) * 100.0 / count(*) AS pct FROM combo c JOIN one USING (fn_id) CROSS JOIN decs d LEFT JOIN good g ON g.fn_id = c.fn_id AND g.dec = d.dec WHERE preset = 'sample-set' AND normalize = 0 GROUP BY d.dec
) SELECT dec, round(pct, 6) AS pct, CAST(row_number() OVER (ORDER BY pct DESC, pos) AS INT) AS place FROM r""")
def _(d):
    return payloads.leaderboard(facts.union(facts.combo_counts(facts.function_facts(d)), d.decs), d.decs, "sample-set", 0).withColumn("pct", F.round("pct", 6))


@_data("combo_keys", _COMBO + "SELECT DISTINCT concat(preset, '|', normalize) AS combo FROM combo")
def _(d):
    return facts.combo_sizes(facts.function_facts(d)).select(site.combo_key(F.col("preset"), F.col("normalize")).alias("combo"))


@_data("scoreboard_text", """, one AS (SELECT DISTINCT fn_id FROM obs WHERE isfinite(value)), good AS (SELECT dec, count(DISTINCT fn_id) AS num FROM obs WHERE perfect GROUP BY dec), s AS (
  SELECT d.dec, pos, CAST(coalesce(num, 0) AS BIGINT) AS num, CAST((SELECT count(*) FROM one) AS BIGINT) AS den FROM decs d LEFT JOIN good USING (dec)), r AS (SELECT *, row_number() OVER (ORDER BY num * 100.0 / den DESC, pos) AS rank FROM s)
SELECT 'overall' AS metric, CAST(rank AS INT) AS rank, concat(lpad(CAST(rank AS VARCHAR), 2, ' '), '. ', rpad(dec, 20, ' '), ' ', lpad(printf('%.2f', num * 100.0 / den), 6, ' '), '% (', num, '/', den, ')') AS line FROM r""")
def _(d):
    return site.scoreboard_lines(scoreboard.scoreboard_overall(d, facts.function_facts(d)).withColumn("metric", F.lit("overall")))


# --- trees, publishing, acquisition ---------------------------------------------------------------


@_data("tree_projects", "SELECT DISTINCT project, opt_level FROM v_fn")
def _(d):
    return d.functions.select("project", "opt_level").distinct()


@_data("orphan_checkpoints", "SELECT DISTINCT project FROM v_fn WHERE project >= 'proj_07'")
def _(d):
    every = d.functions.select("project").distinct()
    return site.orphan_checkpoints(every, every.where("project < 'proj_07'"))


@_data("group_records", ", l AS (SELECT project, opt_level, binary_name, preset, count(*) AS n FROM (SELECT *, unnest(datasets) AS preset FROM fn) GROUP BY ALL), p AS (SELECT project, opt_level, binary_name, string_agg(concat(preset, ':', n), ',' ORDER BY preset) AS presets FROM l GROUP BY ALL) SELECT project, opt_level, binary_name, CAST(count(*) AS BIGINT) AS functions, any_value(presets) AS presets, CASE WHEN binary_name <> 'bin_03' THEN concat(project, '/', binary_name) END AS path, CASE WHEN opt_level = 'O0' THEN concat(binary_name, '.json') END AS graph FROM v_fn LEFT JOIN p USING (project, opt_level, binary_name) GROUP BY project, opt_level, binary_name")
def _(d):
    groups = d.functions.select(*GROUP).distinct()
    files = groups.where("binary_name <> 'bin_03'").withColumn("path", F.concat_ws("/", "project", "binary_name"))
    graphs = groups.where("opt_level = 'O0'").withColumn("path", F.concat("binary_name", F.lit(".json")))
    out = site.group_records(d.functions, files, graphs)
    sizes = F.transform(F.map_entries("presets"), lambda e: F.concat_ws(":", e["key"], F.size(e["value"]).cast("string")))
    return out.withColumn("presets", F.array_join(sizes, ","))


def _found(d: Dataset) -> DataFrame:
    return d.functions.select(F.concat_ws("/", *GROUP).alias("binary"), F.col("function_name").alias("name"), F.col("fn_id").alias("addr"))


@_data("skipped_functions", "SELECT CASE WHEN fn_id % 10 = 0 THEN '_start' WHEN fn_id % 10 = 1 THEN concat('thunk_', fn_id) ELSE function_name END AS name, fn_id FROM v_fn WHERE NOT (fn_id % 10 = 0 OR (fn_id % 2 = 1 AND fn_id % 10 = 1) OR (fn_id % 2 = 0 AND (fn_id < 1000 OR fn_id >= 20000)))")
def _(d):
    i = F.col("fn_id")
    name = F.when(i % 10 == 0, "_start").when(i % 10 == 1, F.concat(F.lit("thunk_"), i)).otherwise(F.col("function_name"))
    lo, hi = F.when(i % 2 == 0, F.lit(1000)), F.when(i % 2 == 0, F.lit(20000))
    return d.functions.select(name.alias("name"), "fn_id").where(~acquisition.skipped(name, i, lo, hi))


@_data("narrowed_to_source", ", f AS (SELECT concat_ws('/', project, opt_level, binary_name) AS bin, fn_id AS addr FROM v_fn), t AS (SELECT DISTINCT bin, addr // 2 AS a FROM f WHERE addr % 11 = 0), s AS (SELECT DISTINCT bin FROM f JOIN t USING (bin) WHERE addr // 2 = a) SELECT f.bin AS binary, CAST(count(*) AS BIGINT) AS n FROM f LEFT JOIN s USING (bin) LEFT JOIN t ON t.bin = f.bin AND t.a = f.addr // 2 WHERE s.bin IS NULL OR t.a IS NOT NULL GROUP BY f.bin")
def _(d):
    found = _found(d)
    return acquisition.narrow_to_source(found, found.where("addr % 11 = 0").select("binary", "addr")).groupBy("binary").agg(F.count(F.lit(1)).alias("n"))


@_data("missing_targets", ", f AS (SELECT concat_ws('/', project, opt_level, binary_name) AS bin, fn_id AS addr FROM v_fn) SELECT DISTINCT bin AS binary, addr + 2 AS addr FROM f a WHERE addr + 2 < 30000 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.bin = a.bin AND b.addr // 2 = (a.addr + 2) // 2)")
def _(d):
    found = _found(d)
    targets = found.select("binary", (F.col("addr") + 2).alias("addr"), F.lit(0).alias("lo"), F.lit(30000).alias("hi"))
    return acquisition.missing_targets(found, targets)


@_data("agent_targets", ", f AS (SELECT concat_ws('/', project, opt_level, binary_name) AS bin, function_name AS name, fn_id AS addr FROM v_fn), e AS (SELECT *, CASE WHEN addr % 9 = 0 THEN 0 WHEN addr % 4 = 0 THEN 1 ELSE 2 END AS p FROM f), m AS (SELECT bin, min(p) AS p FROM e GROUP BY bin) SELECT bin AS binary, name, addr FROM (SELECT e.bin, name, addr, row_number() OVER (PARTITION BY e.bin ORDER BY addr, name) AS r FROM e JOIN m USING (bin, p)) WHERE r <= 2")
def _(d):
    f = _found(d)
    return acquisition.agent_targets(f.where("addr % 9 = 0"), f.where("addr % 9 <> 0 and addr % 4 = 0"), f.where("addr % 9 <> 0 and addr % 4 <> 0"), 2)


@_data("sharded_addresses", "SELECT CAST(part AS INT) AS part, CAST(count(*) AS BIGINT) AS n FROM (SELECT (row_number() OVER (PARTITION BY project, opt_level, binary_name ORDER BY fn_id) - 1) % 4 AS part FROM v_fn) GROUP BY part")
def _(d):
    return acquisition.shard(_found(d), 4).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@_data("located_cases", ", t AS (SELECT fn_id, (array_agg(fn_id * 10 + pos ORDER BY CASE dec WHEN 'tool_c' THEN 0 WHEN 'tool_a' THEN 1 ELSE 2 END, dec))[1] AS addr FROM v_obs JOIN decs USING (dec) WHERE decompiled GROUP BY fn_id) SELECT v_fn.fn_id, CAST(addr AS BIGINT) AS addr FROM v_fn LEFT JOIN t USING (fn_id)")
def _(d):
    blocks = d.attempts.where("decompiled").join(d.functions, "fn_id").join(F.broadcast(d.decs), "dec")  # the registry of tools
    blocks = blocks.select(*KEY, "dec", (F.col("fn_id") * 10 + F.col("pos")).alias("addr"))
    return repairs.locate(d.functions.select("fn_id", *KEY), blocks, "tool_c", "tool_a").select("fn_id", "addr")


@_data("scored_pairs", "SELECT dec, CAST(count(*) AS BIGINT) AS n FROM obs WHERE metric = 'ged' AND fn_id % 3 = 0 AND fn_id % 2 = 0 GROUP BY dec")
def _(d):
    graphs = d.obs.where("metric = 'ged'").join(d.functions, "fn_id").select(*KEY, "dec", F.col("fn_id").alias("graph"))
    source = d.functions.where("fn_id % 3 = 0").withColumn("graph", F.col("fn_id"))
    return repairs.scored_pairs(source, graphs, graphs.where("graph % 2 = 0")).groupBy("dec").agg(F.count(F.lit(1)).alias("n"))


@_data("merged_graphs", "SELECT opt_level, concat('f', fn_id % 300) AS name, max(fn_id) AS graph FROM v_fn GROUP BY ALL")
def _(d):
    rows = d.functions.select("opt_level", F.col("fn_id").alias("pos"), F.concat(F.lit("f"), (F.col("fn_id") % 300).cast("string")).alias("name"), F.col("fn_id").alias("graph"))
    return repairs.merged_graphs(rows)


@_data("file_sample", ", f AS (SELECT DISTINCT project, concat(opt_level, '/', binary_name) AS path FROM v_fn), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) - 1 AS r, count(*) OVER (PARTITION BY project) AS n FROM f) SELECT DISTINCT project, path FROM r, range(5) k(i) WHERE r = i * n // 5")
def _(d):
    return sampling.file_sample(d.functions.select("project", F.concat_ws("/", "opt_level", "binary_name").alias("path")).distinct(), 5)


@_data("arm_functions", "SELECT fn_id FROM v_fn WHERE project = 'proj_01' OR fn_id % 13 = 2")
def _(d):
    labels = F.when(F.col("project") == "proj_01", F.array(F.lit("cps"))).when(F.col("fn_id") % 13 == 2, F.array(F.lit("x"), F.lit("cortex-m4"))).otherwise(F.array(F.lit("cortex")))
    return d.functions.where(P.is_arm(labels)).select("fn_id")


@_data("opt_flags", "SELECT DISTINCT opt_level, CASE opt_level WHEN 'O2-noinline' THEN '-O2 -fno-inline' ELSE concat('-', opt_level) END AS flags FROM v_fn")
def _(d):
    return d.functions.select("opt_level").distinct().select("opt_level", P.opt_flags(F.col("opt_level")).alias("flags"))


@_data("type_forms_agree", "SELECT fn_id, CAST(CASE fn_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS BOOLEAN) AS agree FROM v_fn")
def _(d):
    """Pairs of spellings that mean the same, or don't."""
    pairs = [("unsigned long", "undefined8"), ("uint32_t", "int"), ("const char *", "char*"), ("short", "int"), ("_Bool", "bool"), ("float", "int")]
    i = F.col("fn_id") % 6
    pick = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in pairs]), (i + 1).cast("int"))

    @F.pandas_udf("boolean")
    def agree(a, b):
        return a.combine(b, lambda x, y: bool(kernels.type_forms(x) & kernels.type_forms(y)))

    return d.functions.select("fn_id", agree(pick(0), pick(1)).alias("agree"))
