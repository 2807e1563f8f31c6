"""Rules that the tables' queries don't reach: fixtures of a few functions each."""

import math

import pytest
from pyspark.sql import functions as F

from scorewright.functions import predicates as P
from scorewright.operators import acquisition, comparison, cost, coverage, facts, history, overlays, presets, publish, sampling, scoreboard, universe, visibility
from scorewright.plans.dataset import Dataset

INF, NAN = math.inf, math.nan


def dataset(spark, cells, tries, functions=None, decs=(("alpha", False), ("beta", False)), metrics=("byte_match", "ged", "type_match")):
    """cells: (fn, dec, metric, value, perfect, distance); tries: (fn, dec, decompiled, compiles)."""
    ids = sorted({c[0] for c in cells} | {t[0] for t in tries})
    functions = functions or [(i, "proj", "O0", "bin", f"f{i}", 10, [], ["full"]) for i in ids]
    fn = spark.createDataFrame(functions, "fn_id long, project string, opt_level string, binary_name string, function_name string, size int, labels array<string>, datasets array<string>")
    obs = spark.createDataFrame(cells, "fn_id long, dec string, metric string, value double, perfect boolean, distance double")
    att = spark.createDataFrame(tries, "fn_id long, dec string, decompiled boolean, compiles boolean")
    d = spark.createDataFrame([(n, i, s) for i, (n, s) in enumerate(decs)], "dec string, pos int, sample_only boolean")
    m = spark.createDataFrame([(n, i, n == "ged", 0.0 if n == "ged" else 1.0) for i, n in enumerate(metrics)], "metric string, pos int, lower_is_better boolean, perfect_value double")
    return Dataset(fn, obs, att, d, m)


def pairs(df, *by):
    return {tuple(r[b] for b in by): (r["num"], r["den"]) for r in df.collect() if r["normalize"] == 0}


def test_shared_denominator_and_union(spark):
    """A miss stays in the denominator; what nobody can measure leaves it; a stray flag doesn't count."""
    cells = [(1, "alpha", "ged", 0.0, True, 0.0), (1, "beta", "ged", 3.0, False, 3.0), (2, "alpha", "ged", 1.0, False, 1.0), (3, "alpha", "ged", INF, True, None), (3, "beta", "type_match", 1.0, True, 0.0)]
    d = dataset(spark, cells, [(i, x, True, None) for i in (1, 2, 3) for x in ("alpha", "beta")])
    counts = facts.combo_counts(facts.function_facts(d))
    per = pairs(facts.per_metric(counts, d.decs), "dec", "metric")
    assert per["alpha", "ged"] == (1, 2) and per["beta", "ged"] == (0, 2) and per["alpha", "type_match"] == (0, 1)
    assert ("alpha", "byte_match") not in per
    assert pairs(facts.union(counts, d.decs), "dec") == {("alpha",): (1, 3), ("beta",): (1, 3)}


def test_present_null_is_measurable(spark):
    d = dataset(spark, [(1, "alpha", "byte_match", None, False, None)], [(1, "alpha", True, None), (1, "beta", False, None)])
    counts = facts.combo_counts(facts.function_facts(d))
    assert pairs(facts.per_metric(counts, d.decs), "dec", "metric")["beta", "byte_match"] == (0, 1)
    assert facts.compiles(counts, d.decs).count() == 0  # a null value isn't measured for recompilation


def test_errors_need_a_flag_but_the_gate_falls_back(spark):
    d = dataset(spark, [(1, "alpha", "ged", 0.0, True, 0.0), (1, "beta", "ged", 0.0, True, 0.0)], [(2, "alpha", False, None)])
    f = facts.function_facts(d)
    assert pairs(facts.errors(facts.combo_counts(f), d.decs), "dec") == {("alpha",): (1, 1)}
    assert {r.fn_id: r.gate_all for r in f.collect()} == {1: True, 2: False}


def test_normalize_gate_ignores_sample_only_tools_but_on_the_sample(spark):
    rows = [(1, "p", "O0", "b", "f1", 1, [], ["full", "sample-set"])]
    d = dataset(spark, [], [(1, "alpha", True, None), (1, "beta", True, None), (1, "agent", False, None)], rows, (("alpha", False), ("beta", False), ("agent", True)))
    combos = {(r.preset, r.normalize) for r in facts.combo_sizes(facts.function_facts(d)).collect()}
    assert combos == {("full", 0), ("full", 1), ("sample-set", 0)}


def test_upper_middle_median_and_own_n(spark):
    cells = [(i, "alpha", "ged", float(i), False, float(i)) for i in (1, 2, 3, 4)] + [(5, "alpha", "ged", 0.0, False, INF), (6, "alpha", "byte_match", 1.0, False, 0.0)]
    out = {r.metric: r for r in facts.distance_stats(facts.function_facts(dataset(spark, cells, []))).where("normalize = 0").collect()}
    assert (out["ged"]["mean"], out["ged"]["median"], out["ged"]["n"], out["ged"]["at0"]) == (2.5, 3.0, 4, 0)
    assert out["byte_match"]["at0"] == 1  # though it isn't perfect


def test_presetless_run(spark):
    rows = [(1, "p", "O0", "b", "f", 1, [], [])]
    d = dataset(spark, [(1, "alpha", "ged", 0.0, True, 0.0)], [], rows)
    f = facts.function_facts(d)
    assert facts.combo_counts(f).count() == 0
    assert {r.preset for r in facts.combo_counts(f, presets=False).collect()} == {"__all__"}


def test_rank_ties_keep_tool_order(spark):
    cells = [(1, x, "ged", 0.0, True, 0.0) for x in ("beta", "alpha")]
    d = dataset(spark, cells, [], decs=(("beta", False), ("alpha", False)))
    f = facts.function_facts(d)
    assert {r.dec: r["rank"] for r in scoreboard.scoreboard_metric(d, f).collect()} == {"beta": 1, "alpha": 2}
    leaders = facts.union_leaders(facts.combo_counts(f), d.decs, "full", False).collect()
    assert [r.dec for r in leaders] == ["alpha", "beta"]  # here ties go by id


def test_presets(spark):
    rows = [(i, "p", o, "b", f"f{i}", s, lab, []) for i, (o, s, lab) in enumerate([("O0", 5, []), ("O2", 8, []), ("O2-noinline", 12, []), ("O2-noinline", 220, []), ("O2-noinline", None, ["large"]), ("Os", 150, [])])]
    d = dataset(spark, [], [(0, "alpha", True, None)], rows)
    out = {r.fn_id: r.datasets for r in presets.tag_presets(d.functions.drop("datasets")).collect()}
    assert out == {0: ["unoptimized"], 1: ["inlined"], 2: ["optimized"], 3: ["optimized", "large"], 4: ["optimized", "large"], 5: []}
    with pytest.raises(ValueError):
        presets.large_subset(d.functions, "odd")
    empty = presets.size_distribution(d.functions.limit(0)).first()
    assert empty["count"] == 0 and empty["mean"] == 0 and empty["p99"] == 0


def test_arm_bucket(spark):
    rows = [(1, "p", "O0", "b", "f", 1, ["cortex-m4"], ["unoptimized"]), (2, "p", "O0", "c", "f", 1, ["cps"], ["unoptimized"]), (3, "p", "O0", "d", "f", 1, ["x86"], ["unoptimized"])]
    out = presets.buckets(dataset(spark, [], [(1, "alpha", True, None)], rows).functions).where("bucket = 'unoptimized-arm'").collect()
    assert {r.fn_id for r in out} == {1, 2}


def greedy(rows, quota, chosen, used):
    """The loop that the ranks stand for, with hashes as order."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = {}
    for r in sorted(rows, key=lambda r: md5("::".join(r))):
        if r not in chosen:
            by.setdefault(r[0], []).append(r)
    order, out = sorted(by, key=md5), []
    for strict in (True, False):
        moved = True
        while moved and len(out) < quota:
            moved = False
            for p in order:
                ok = [r for r in by[p] if r not in chosen and not (strict and r[:3] in used)]
                if ok and len(out) < quota:
                    out.append(ok[0])
                    chosen.add(ok[0])
                    used.add(ok[0][:3])
                    moved = True
    return out


def test_sampler_matches_the_greedy_loop(spark):
    import random

    r = random.Random(5)
    keys = "project string, opt_level string, binary_name string, function_name string"
    for quota in (1, 7, 30, 200):
        rows = [(f"p{r.randrange(4)}", "O0", f"b{i % 9}", f"f{i}") for i in range(80)]
        rows = [(p, o, f"{p}{b}", f) for p, o, b, f in rows]
        used = {rows[0][:3], rows[1][:3]}
        want = greedy(rows, quota, set(), set(used))
        got = sampling.sample_even(spark.createDataFrame(rows, keys), quota, used=spark.createDataFrame([u + ("",) for u in used], keys))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    both = [(*x, b) for b in ("one", "two") for x in rows if b == "one" or x[2] < "p2"]
    chosen, taken = set(), set()
    want = [w for b in ("one", "two") for w in greedy([x[:4] for x in both if x[4] == b], 10, chosen, taken)]
    got = sampling.sample_buckets(spark.createDataFrame(both, keys + ", bucket string"), 20, ["one", "two"])
    assert sorted(tuple(x)[:4] for x in got.collect()) == sorted(want)
    topped = sampling.top_up(spark.createDataFrame(both, keys + ", bucket string"), got.select("project", "opt_level", "binary_name", "function_name"), ["p1"], ["one", "two"]).collect()
    assert len(topped) == 20 and not any(x.project == "p1" for x in topped)
    assert {tuple(x)[:4] for x in got.collect() if x.project != "p1"} <= {tuple(x) for x in topped}


def test_file_sample(spark):
    df = spark.createDataFrame([("p", f"{i:02}") for i in range(10)] + [("q", "x")], "project string, path string")
    assert sorted(r.path for r in sampling.file_sample(df, 4).collect()) == ["00", "02", "05", "07", "x"]


def test_improvements(spark):
    cells = [(1, "alpha", "ged", 1.0, False, 1.0), (1, "beta", "ged", 4.0, False, 4.0), (2, "alpha", "ged", 0.0, True, 0.0), (2, "beta", "ged", INF, False, None), (3, "alpha", "ged", NAN, False, None), (3, "beta", "ged", 1.0, False, 1.0), (4, "alpha", "ged", 2.0, False, 2.0), (4, "beta", "ged", 2.0, False, 2.0)]
    d = dataset(spark, cells, [])
    names = lambda df: [r.function_name for r in df.collect()]
    assert names(comparison.improvements(d, "alpha", "beta", "ged")) == ["f1"]
    assert names(comparison.improvements(d, "alpha", "beta", "ged", target_missing=True)) == ["f2", "f1"]
    assert names(comparison.improvements(d, "alpha", "beta", "ged", perfect_only=True, target_missing=True)) == ["f2"]
    assert names(comparison.improvements(d, "beta", "alpha", "ged")) == []
    for bad in (("alpha", "alpha", "ged"), ("alpha", "nobody", "ged"), ("alpha", "beta", "odd")):
        with pytest.raises(ValueError):
            comparison.improvements(d, *bad)


def two_slices(spark):
    rows = [(1, "projA", "O0", "binA", "f1", 1, [], []), (2, "projA", "O2-noinline", "binA", "f1", 1, [], [])]
    cells = [(1, "kuna", "ged", 3.0, False, 3.0), (2, "kuna", "ged", 5.0, False, 5.0), (1, "angr", "ged", 1.0, False, 1.0), (2, "angr", "ged", INF, False, None)]
    return dataset(spark, cells, [(i, t, True, None) for i in (1, 2) for t in ("kuna", "angr")], rows, (("angr", False), ("kuna", False)))


def test_ged_overlay_is_scoped_by_slice(spark):
    d = two_slices(spark)
    new = spark.createDataFrame([("O0::projA::binA::kuna::f1", 0.0, None)], "key string, value double, perfect boolean")
    got = {(r.fn_id, r.dec): (r.value, r.perfect) for r in overlays.overlay_ged(d, new).collect()}
    assert got == {(1, "kuna"): (0.0, True), (2, "kuna"): (5.0, False), (1, "angr"): (1.0, False)}
    covered = spark.createDataFrame([("O0", "projA", "binA", "angr")], "opt_level string, project string, binary_name string, dec string")
    assert (1, "angr") not in {(r.fn_id, r.dec) for r in overlays.overlay_ged(d, new, covered.unionByName(overlays.slices(new.select("key")))).collect()}


def test_byte_match_overlay(spark):
    d = two_slices(spark)
    d = d.having(obs=d.obs.unionByName(spark.createDataFrame([(1, "kuna", "byte_match", 0.5, False, 4.0), (2, "kuna", "byte_match", 0.5, False, 4.0)], d.obs.schema)))
    new = spark.createDataFrame([("O0::projA::binA::kuna::other::x", 1.0, True, 0.0)], "key string, value double, compilable boolean, dist double")
    got = {r.fn_id for r in overlays.overlay_byte_match(d, new)[0].where("metric = 'byte_match'").collect()}
    assert got == {2}  # covered without a fresh value: dropped
    assert overlays.overlay_byte_match(d, new, add_only=True)[0].where("metric = 'byte_match'").count() == 2
    assert overlays.slices(new.select("key")).first().dec == "kuna"


def test_guard(spark):
    d = two_slices(spark)
    less = d.having(obs=d.obs.where("dec <> 'kuna'"))
    old, new = coverage.coverage_counts(d), coverage.coverage_counts(less)
    assert coverage.regressions(old, old).count() == 0
    with pytest.raises(coverage.CoverageError):
        coverage.guard(old, new)
    coverage.guard(old, new, allowed_decs=["kuna"])
    coverage.guard(old, new, allowed_projects=["projA"])
    coverage.guard(old, new, allow_drops=True)
    assert {r.counter: r.n for r in old.where("group_key like '%O2-%'").collect()} == {"functions": 1, "kuna::ged": 1, "kuna::decompiled": 1, "angr::decompiled": 1}


def test_audit_skips_agents_off_their_slices(spark):
    cols = "project string, opt_level string, binary_name string, dec string, function_name string"
    f = lambda rows: spark.createDataFrame(rows, cols)
    ckpt = f([("p", "O0", "b", "agent@1", "f"), ("p", "O0", "b", "tool", "f"), ("p", "O0", "b", "gone", "f"), ("p", "O2", "b", "tool", None)])
    pub = f([("p", "O0", "b", "agent", "f"), ("p", "O0", "b", "tool", "f")])
    rows = spark.createDataFrame([("p", "O0", "b", "f"), ("p", "O2", "b", "f")], "project string, opt_level string, binary_name string, function_name string")
    out = coverage.audit(ckpt, ckpt, f([]), pub, rows, agents=["agent"]).collect()
    assert {(r.kind, r.opt_level, r.dec) for r in out} == {("OVERLAY-GAP", "O0", "tool"), ("DECOMPILE-FAILURE", "O2", "tool")}


def test_universe(spark):
    cols = "project string, opt_level string, binary_name string, function_name string, dec string"
    row = lambda f, d: ("p", "O0", "b", f, d)
    scored = spark.createDataFrame([row("sub_1f", "a")], cols)
    made = spark.createDataFrame([row("main", "a"), row("sub_2f", "a"), row("sub_1f", "a")], cols)
    failed = spark.createDataFrame([row("all", "b"), row("main", "agent")], cols)
    names = universe.universe(scored, made, failed)
    assert {r.function_name for r in names.collect()} == {"main", "sub_1f"}
    runs = spark.createDataFrame([("p", "O0", "b", t, t.startswith("agent")) for t in ("a", "b", "agent")], "project string, opt_level string, binary_name string, dec string, slice_scoped boolean")
    got = {(r.function_name, r.dec): r.decompiled for r in universe.attempts(names, runs, scored, made, failed).collect()}
    assert got == {("main", "a"): True, ("main", "b"): False, ("main", "agent"): False, ("sub_1f", "a"): True, ("sub_1f", "b"): False}


def test_hiding(spark):
    d = dataset(spark, [(1, t, "ged", 0.0, True, 0.0) for t in ("ghidra@12.1", "ghidra", "angr")], [(1, "ghidra", True, True)], decs=(("ghidra@12.1", False), ("ghidra", False), ("angr", False)))
    assert {r.dec for r in visibility.hide(d, ["ghidra"]).obs.collect()} == {"angr"}
    assert {r.dec for r in visibility.strip(d, ["ghidra"]).obs.collect()} == {"angr", "ghidra@12.1"}
    assert visibility.hide(d, ["ghidra"]).attempts.count() == 1 and visibility.strip(d, ["ghidra"]).attempts.count() == 0


def test_costs(spark):
    runs = spark.createDataFrame([("t", 10.0, 10), ("t", 20.0, 10), ("t", 60.0, 10), ("t", 0.0, 5), ("t", 5.0, 0)], "dec string, total_time double, function_count int")
    r = cost.decompile_times(runs).first()
    assert (r.total_s, r.functions, r.binaries, r.per_fn_mean_s, r.per_fn_median_s) == (90.0, 30, 3, 3.0, 2.0)
    use = "session string, type string, input long, cached_input long, cache_write long, cache_write_parts array<long>, output long"
    rows = [("s", "assistant", 2, 5000, None, [10, 13990], 100), ("s", "assistant", 3, 15000, 6000, [7000], 50), ("s", "user", 9, 9, 9, None, 9)]
    t = cost.assistant_tokens(spark.createDataFrame(rows, use)).first()
    assert (t.input, t.cached_input, t.cache_write, t.output) == (5, 20000, 20000, 150)
    last = spark.createDataFrame([("s", 1, 10, 5, 1), ("s", 2, 553000, 487000, 6500)], "session string, line int, input long, cached_input long, output long")
    t = cost.running_tokens(last).first()
    assert (t.input, t.cached_input, t.cache_write, t.output) == (66000, 487000, 0, 6500)
    calls = spark.createDataFrame([("a", "m", "ok", 1.0, 1_000_000, 2_000_000, 400_000, 100_000)] + [("a", "m", "FAILED", 3.0, None, None, None, None)] * 9, "dec string, model string, status string, elapsed_s double, input long, cached_input long, cache_write long, output long")
    prices = spark.createDataFrame([("m", 10.0, 1.0, 12.5, 40.0), ("z", 0.0, 0.0, 0.0, 0.0)], "model string, input double, cached_input double, cache_write double, output double")
    c = cost.llm_costs(calls)
    assert (c.first().failed, c.first().functions, c.first().sessions) == (9, 10, 1)
    p = cost.dollars(c, prices).first()
    assert (p.total, p.per_function) == (21.0, 2.1)
    assert cost.dollars(c.withColumn("model", F.lit("z")), prices).first().total is None and cost.dollars(c.withColumn("model", F.lit("q")), prices).first().total is None


def test_history_order(spark):
    s = spark.createDataFrame([(f"t@{v}", "ged", 1.0) for v in ("9.2", "10.1", "9.10")] + [("tt@1", "ged", 1.0), ("t", "ged", 1.0)], "dec string, metric string, pct double")
    out = history.history_points(s, s.drop("metric"), "t").collect()
    assert [r.version for r in out] == ["9.2", "9.10", "10.1"]
    raw = spark.createDataFrame([("t", "1", None, "ged", "5"), ("t", "1", None, "ged", "x"), (None, "1", None, "ged", "5")], "dec string, version string, date string, metric string, pct string")
    assert history.coerce_points(raw).count() == 1


def test_publish(spark):
    u = spark.createDataFrame([("p", "a", "one"), ("p", "b", "one"), ("p", "a", "two"), ("q", "a", "one")], "project string, stem string, content string")
    files = {(r.project, r.file) for r in publish.content_dedup(u).collect()}
    assert len(files) == 3 and ("q", "a.c") in files and sum(f == "a.c" for p, f in files if p == "p") == 1
    cfg = spark.createDataFrame([("u1", "f", 0, True), ("u2", "f", 1, True), ("u3", "f", 1, False), ("u4", "f", 1, False)], "unit string, name string, nodes int, all_nop boolean")
    assert publish.best_source(cfg).first().unit == "u3"
    want = spark.createDataFrame([("u2", "f"), ("u4", "f"), ("zz", "f"), ("zz", "g")], "stem string, name string")
    assert {(r.stem, r.name): r.unit for r in publish.resolve_source(want, cfg).collect()} == {("u2", "f"): "u3", ("u4", "f"): "u4", ("zz", "f"): "u3", ("zz", "g"): None}


def test_acquisition(spark):
    found = spark.createDataFrame([("b", "f", 0x101), ("b", "g", 0x200), ("c", "h", 0x300)], "binary string, name string, addr long")
    targets = spark.createDataFrame([("b", 0x100), ("c", 0x999)], "binary string, addr long")
    assert {r.name for r in acquisition.narrow_to_source(found, targets).collect()} == {"f", "h"}  # nothing of c matches: all of it stays
    wanted = spark.createDataFrame([("b", 0x100, 0, 0x1000), ("b", 0x400, 0, 0x1000), ("b", 0, 0, 0x1000), ("b", 0x2000, 0, 0x1000), ("c", 0x500, None, None)], "binary string, addr long, lo long, hi long")
    assert [(r.binary, r.addr) for r in acquisition.missing_targets(found, wanted).collect()] == [("b", 0x400), ("c", 0x500)]
    skip = spark.createDataFrame([("_start", 5, 0, 9), ("j_x", 5, 0, 9), ("j_x", 5, None, None), ("f", 20, 0, 9), ("", 5, 0, 9)], "n string, a long, lo long, hi long")
    assert [r[0] for r in skip.select(acquisition.skipped(F.col("n"), F.col("a"), F.col("lo"), F.col("hi"))).collect()] == [True, False, True, True, True]
    code = spark.createDataFrame([("b", "sub_1", 0x101, "xx"), ("b", "sub_2", 0x90, "xxxx"), ("b", "sub_3", 0x7, "x")], "binary string, name string, addr long, code string")
    names = spark.createDataFrame([("b", 0x100, "main"), ("b", 0x1090, "main")], "binary string, addr long, true_name string")
    assert {(r.name, r.code) for r in acquisition.relabel(code, names, 0x1000).collect()} == {("main", "xxxx"), ("sub_3", "x")}
    empty = found.limit(0)
    assert acquisition.agent_targets(empty, empty, found, 1).count() == 2
    assert {r.part for r in acquisition.shard(found, 2).where("binary = 'b'").collect()} == {0, 1}


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(P.percent(F.lit(1), F.lit(0))) == 0.0 and val(P.bar(F.lit(52.5), 10)) == "#####....."
    assert val(P.bar(F.lit(55.0), 10)) == "######...." and val(P.bar(F.lit(999.0), 4)) == "####"
    assert val(P.opt_labels(F.lit("O2-noinline"))) == ["O2-noinline", "optimized", "noinline"]
    assert val(P.placeholder(F.lit("FUN_00ff"))) and not val(P.placeholder(F.lit("sub_xyz")))
    assert val(P.distance_of(F.lit("type_match"), F.lit(0.5), F.lit(2), F.lit(None).cast("int"), F.lit(None).cast("int"))) is None
    assert val(P.distance_of(F.lit("type_match"), F.lit(0.5), F.lit(2), F.lit(3), F.lit(None).cast("int"))) == 5.0


def test_hidden_tools_everywhere(spark):
    from scorewright.operators import visibility
    from scorewright.plans.dataset import Dataset

    new = spark.createDataFrame
    obs = new([(1, d, "ged", 0.0, True, 0.0) for d in ("angr", "hid@9.2", "ghidra")], "fn_id long, dec string, metric string, value double, perfect boolean, distance double")
    attempts = new([(1, "angr", True, None), (1, "hid@9.2", True, True), (2, "hid@9.2", False, None)], "fn_id long, dec string, decompiled boolean, compiles boolean")
    decs = new([("angr", 0, False), ("hid@9.2", 1, False), ("ghidra", 2, False)], "dec string, pos int, sample_only boolean")
    out = visibility.hide(Dataset(None, obs, attempts, decs, None), ["hid"])
    assert {r.dec for r in out.obs.collect()} == {r.dec for r in out.decs.collect()} == {"angr", "ghidra"}
    assert {tuple(r) for r in out.attempts.collect()} == {(1, "angr", True, None), (1, "hid@9.2", None, True)}
    history = new([("hid@9.2", "9.2"), ("ghidra@12.1", "12.1")], "dec string, version string")
    assert [r.dec for r in visibility.hide_rows(history, ["hid"]).collect()] == ["ghidra@12.1"]
    samples = new([(1, {"angr": "A", "hid": "H"}, {"hid": 1.0}), (2, {"hid@9.2": "H"}, {})], "fn_id long, code map<string,string>, values map<string,double>")
    got = visibility.hide_samples(samples, ["hid"]).collect()
    assert [(r.fn_id, r.code, r["values"]) for r in got] == [(1, {"angr": "A"}, {})]


def test_sources_of_functions(spark):
    from scorewright.operators import source_lookup

    new = spark.createDataFrame
    wanted = new([("a", "f", None, None), ("b", "f", None, None), ("c", "f", None, None), ("gone", "f", None, None), ("a", "missing", None, None), ("e", "f", None, "two.c"), ("bare", "f", None, None)], "binary string, function_name string, line int, file string")
    files = new([("a", "mod.c", "int f(int x){return x + 1;}\n"), ("a", "mod.i", "int f(int x){return x + 999;}\n"), ("b", "mod.i", "# 1 \"mod.c\"\nstatic int f(int x){return x + 1;}\n"), ("c", "mod.c", "int f(int x);\n"), ("e", "x/one.c", "int f(void) { return 1; }"), ("e", "x/two.c", "int f(void) { return 2; }")], "binary string, path string, text string")
    out = {(r.binary, r.function_name): (r.source, r.status) for r in source_lookup.function_sources(wanted, new([(b,) for b in ("a", "c", "e", "bare")], "binary string"), files).collect()}
    assert out["a", "f"] == ("int f(int x){return x + 1;}", "") and out["b", "f"][1] == "preprocessed" and "static" in out["b", "f"][0]
    assert out["c", "f"] == (None, "extract_failed") and out["gone", "f"] == (None, "binary_not_found") and out["bare", "f"] == (None, "no_source_files")
    assert out["a", "missing"] == (None, "func_not_in_sources") and out["e", "f"] == ("int f(void) { return 2; }", "")
