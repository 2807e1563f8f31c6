import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from scorewright.functions import registry as plugins
from scorewright.operators import cost, coverage, facts
from scorewright.plans import finalize
from scorewright.plans.dataset import Dataset
from scorewright.sources import artifacts, function_data, overlays, store, traces
from scorewright.streaming import slices


def document(ged=3.0):
    fn = lambda name, values, dec, size=4: {"function": name, "values": values, "perfects": {d: {m: v == 0 for m, v in x.items()} for d, x in values.items()}, "distances": {d: dict(x) for d, x in values.items()}, "decompiled": dec, "compiles": {}, "labels": ["O0"], "datasets": ["unoptimized"], "size": size}
    groups = [
        {"project": "projA", "opt_level": "O0", "binary": "binA", "labels": ["O0"], "functions": [fn("f1", {"kuna": {"ged": ged}, "angr": {"ged": math.inf}}, {"kuna": True, "angr": True}), fn("f2", {}, {"kuna": False}, None)]},
        {"project": "projA", "opt_level": "O2", "binary": "binA", "labels": [], "functions": []},
    ]
    return {"schema_version": 2, "decompilers": ["angr", "kuna"], "metrics": ["ged"], "perfect_values": {"ged": 0.0}, "groups": groups}


def test_document_round_trip(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(document(), indent=2))
    d = function_data.read(spark, str(path))
    assert {(r.dec, r.value) for r in d.obs.collect()} == {("kuna", 3.0), ("angr", math.inf)}
    assert function_data.groups(spark, str(path)).count() == 2 and d.functions.count() == 2
    function_data.write(d, str(tmp_path / "out"))
    e = function_data.read(spark, str(tmp_path / "out"))
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    for t, cols in (("obs", ("dec", "metric", "value", "perfect", "distance")), ("attempts", ("dec", "decompiled", "compiles")), ("functions", ("project", "function_name", "size", "labels", "datasets")), ("metrics", ("metric", "lower_is_better", "perfect_value"))):
        assert rows(getattr(d, t), *cols) == rows(getattr(e, t), *cols), t


def test_guarded_write(spark, tmp_path):
    src, out = tmp_path / "d.json", str(tmp_path / "results")
    src.write_text(json.dumps(document()))
    d = function_data.read(spark, str(src))
    function_data.write_guarded(d, out)
    less = d.having(obs=d.obs.where("dec <> 'kuna'"))
    with pytest.raises(coverage.CoverageError):
        function_data.write_guarded(less, out)
    assert function_data.read(spark, out).obs.count() == 2  # the old document is untouched
    function_data.write_guarded(less, out, allowed_decs=["kuna"])
    assert function_data.read(spark, out).obs.count() == 1 and function_data.read(spark, out + ".prev").obs.count() == 2


def test_json_sink_refuses_non_finite(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (math.inf,)], "v double")
    with pytest.raises(Exception, match="non-finite"):
        function_data.write_json(df, str(tmp_path / "x"), ["v"])
    function_data.write_json(df.where("v = 1"), str(tmp_path / "y"), ["v"])


def test_finalize_applies_overlays_and_pins_the_sample(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "ged_new.json").write_text(json.dumps({"O0::projA::binA::kuna::f1": {"value": 0.0, "perfect": True}}))
    (root / "type_match_new.json").write_text(json.dumps({"kuna": {"projA::O0::binA::f1": {"value": 0.5, "dist": 2}}, "angr": {"projA::O0::binA::f1": 1.0}}))
    (root / "byte_match_new.json").write_text(json.dumps({"O0::projA::binA::kuna::f1": {"value": 1.0, "compilable": True, "dist": 0}}))
    (root / "sample_set_manifest.json").write_text(json.dumps({"functions": [{"project": "projA", "opt": "O0", "binary": "binA", "function": "f1"}]}))
    (root / "ged_new.slices.json").write_text(json.dumps(["O2::projA::binA::angr"]))
    (root / "reeval_ged").mkdir()
    (root / "reeval_ged" / "O0__projA__binA__angr.json").write_text("{}")
    assert overlays.ged(spark, str(root))[1].count() == 3
    src = tmp_path / "d.json"
    src.write_text(json.dumps(document()))
    data, board, overall = finalize.finalize(spark, function_data.read(spark, str(src)), str(root))
    got = {(r.dec, r.metric): r.value for r in data.obs.collect()}
    assert got == {("kuna", "ged"): 0.0, ("kuna", "type_match"): 0.5, ("angr", "type_match"): 1.0, ("kuna", "byte_match"): 1.0}
    assert data.functions.where("array_contains(datasets, 'sample-set')").count() == 1
    assert {r.dec: r.pct for r in overall.collect()}["kuna"] == 100.0
    with pytest.raises(coverage.CoverageError):
        function_data.write_guarded(data.having(functions=data.functions.limit(0)), f"{root}/function_results.json")


def elf(machine):
    return b"\x7fELF" + bytes(12) + struct.pack("<HH", 2, machine) + bytes(60)


def test_results_tree(spark, tmp_path):
    t = tmp_path / "tree"
    dec, comp = t / "O0" / "alpha" / "decompiled", t / "O0" / "alpha" / "compiled"
    dec.mkdir(parents=True)
    comp.mkdir()
    (dec / "my_tool_bin.c").write_text("// Function: main @ 0x401000\nint main()\n{\n}\n// Function: helper @ 0x401080\nh\n")
    (dec / "my_tool_bin.toml").write_text('binary = "b"\ntotal_time = 12.5\nfunction_count = 2\ntimeout = true\n[functions.main]\ntotal_time = 99\n')
    (comp / "bin.elf").write_bytes(elf(0x3E))
    (comp / "fw").write_bytes(elf(0x28))
    (comp / "note").write_bytes(b"text")
    pe = bytearray(200)
    pe[:2], pe[0x3C:0x40], pe[0x80:0x86] = b"MZ", struct.pack("<I", 0x80), b"PE\0\0" + struct.pack("<H", 0x14C)
    (comp / "w.exe").write_bytes(bytes(pe))
    (comp / "bin.i").write_text('# 1 "a.c"\nint x;\n')
    rows = artifacts.decompiled(spark, str(t), ["my", "my_tool"]).collect()
    assert {(r.dec, r.stem, r.function_name, r.addr, r.line_count) for r in rows} == {("my_tool", "bin", "main", 0x401000, 3), ("my_tool", "bin", "helper", 0x401080, 1)}
    assert {r.stem for r in artifacts.decompiled(spark, str(t)).collect()} == {"tool_bin"}
    h = artifacts.toml_headers(spark, str(t), ["my_tool"]).first()
    assert (h.dec, h.total_time, h.function_count, h.timeout) == ("my_tool", 12.5, 2, True)
    assert cost.decompile_times(artifacts.toml_headers(spark, str(t), ["my_tool"])).first().per_fn_mean_s == 6.25
    found = artifacts.binaries(spark, str(t))
    assert {(r.file, *r["info"]) for r in found.collect()} == {("bin.elf", "elf", "x86-64", 64), ("fw", "elf", "arm", 32), ("w.exe", "pe", "x86", 32)}
    tools = {r.file: r.c for r in found.select("file", artifacts.recompiler(F.col("info.fmt"), F.col("info.arch")).alias("c")).collect()}
    assert tools["bin.elf"] == "gcc" and tools["w.exe"] == "i686-w64-mingw32-gcc"
    want = spark.createDataFrame([("O0", "alpha", "bin"), ("O0", "alpha", "fw"), ("O0", "alpha", "none")], "opt_level string, project string, stem string")
    paths = {r.stem: r.path for r in artifacts.resolve_binaries(want, found).collect()}
    assert paths["bin"].endswith("bin.elf") and paths["fw"].endswith("/fw") and paths["none"] is None
    unit = artifacts.units(spark, f"{t}/*/*/compiled/*.i").first()
    assert (unit.project, unit.stem, unit.content) == ("alpha", "bin", "int x;\n")
    m = store.save(spark, str(t), "set1", str(tmp_path / "store"))
    assert m.count() == 3 and store.listing(spark, str(tmp_path / "store")).first().compile_sets == 1
    store.materialise(spark, "set1", str(tmp_path / "again"), str(tmp_path / "store"))
    again = artifacts.binaries(spark, str(tmp_path / "again"))
    assert sorted(r.sha256 for r in again.collect()) == sorted(r.sha256 for r in found.collect())
    with pytest.raises(FileNotFoundError):
        store.load(spark, "none", str(tmp_path / "store"))


def test_projects(spark, tmp_path):
    (tmp_path / "b.toml").write_text('name = "b"\nlabels = ["sailr"]\napply_patch = "p.diff"\n[compilation]\noptimization_levels = ["O0", "O2"]\n')
    (tmp_path / "a.toml").write_text('name = "a"\nis_malware = true\n')
    (tmp_path / "c.toml").write_text("name = ")
    rows = artifacts.projects(spark, [f"{tmp_path}/*.toml"]).collect()
    assert [r["name"] for r in rows] == ["a", "b"] and rows[0].is_malware and not rows[1].is_malware
    assert rows[1].apply_patch.endswith("/p.diff") and rows[1].apply_patch != "p.diff" and rows[1].compilation.optimization_levels == ["O0", "O2"]


def test_source_graphs(spark, tmp_path):
    g = {"opt": "O0", "project": "p", "binary": "u", "functions": {"f": {"nodes": [0, 1], "edges": [[0, 1]], "labels": {}, "entry": [0], "exit": [1]}}}
    (tmp_path / "u.json").write_text(json.dumps(g, indent=1))
    r = artifacts.source_graphs(spark, f"{tmp_path}/*.json").first()
    assert (r.unit, r.name, r.nodes, [tuple(e) for e in r.edges]) == ("u", "f", [0, 1], [(0, 1)])


def test_sessions_and_traces(spark, tmp_path):
    d = tmp_path / "traces" / "agent"
    d.mkdir(parents=True)
    a = [{"type": "assistant", "message": {"usage": {"input_tokens": 2, "cache_read_input_tokens": 5000, "cache_creation_input_tokens": 5000, "cache_creation": {"x": 4000, "y": 1000}, "output_tokens": 100}}}, {"type": "user"}, {"type": "assistant", "message": {"usage": {"input_tokens": 3, "cache_creation": {"x": 100, "y": 100}, "output_tokens": 50}}}]
    b = [{"payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": n // 2, "output_tokens": 7}}}} for n in (10, 100)]
    (d / "one.session.jsonl").write_text("\n".join(map(json.dumps, a)) + "\n{broken\n")
    (d / "two.session.jsonl").write_text("\n".join(map(json.dumps, b)))
    (d / "three.session.jsonl").write_text('{"other": 1}\n')
    (d / "one.md").write_text("# t\n- model: m1\n- status: ok\n- elapsed: 10.5s\n")
    (d / "two.md").write_text("- model: m1\n- status: TIMEOUT\n- elapsed: 20s\n")
    got = {r.session.rsplit("/", 1)[1]: tuple(r)[1:] for r in traces.sessions(spark, f"{d}/*.session.jsonl").collect()}
    assert got == {"one.session.jsonl": (5, 5000, 5200, 150), "two.session.jsonl": (50, 50, 0, 7)}
    c = cost.llm_costs(traces.traces(spark, str(tmp_path / "traces"))).first()
    assert (c.dec, c.model, c.functions, c.failed, c.mean_s, c.total_s, c.input, c.sessions) == ("agent", "m1", 2, 1, 15.25, 30.5, 55, 2)


def test_plug_ins(spark):
    @plugins.register_tool("echo")
    def echo(path, version):
        if "bad" in path:
            raise RuntimeError("no")
        return [("main", 1, f"{path}:{version}")]

    out = {r.path: r for r in plugins.decompile(spark.createDataFrame([("x",), ("bad",)], "path string"), "echo@2").collect()}
    assert out["x"].code == "x:2" and out["x"].dec == "echo@2" and out["bad"].status.startswith("error") and out["bad"].addr is None
    assert plugins.metrics() == ["byte_match", "ged", "type_match"] and plugins.metric("ged").lower_is_better
    with pytest.raises(ValueError):
        plugins.register_metric(plugins.metric("ged"))
    with pytest.raises(KeyError):
        plugins.tool("nobody")


def test_stream_of_slices(spark, tmp_path):
    src, dst, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()
    (src / "a.json").write_text('{"key": "O0::p::b::t::f", "value": 1.0, "perfect": false}\n')
    slices.follow(spark, str(src), dst, chk).awaitTermination()
    (src / "b.json").write_text('{"key": "O0::p::b::t::f", "value": 0.0, "perfect": true}\n{"key": "O0::p::b::t::g", "value": 2.0, "perfect": false}\n')
    slices.follow(spark, str(src), dst, chk).awaitTermination()
    assert {r.key[-1]: r.value for r in slices.state(spark, dst).collect()} == {"f": 0.0, "g": 2.0}
    whole = slices.compact(spark, dst, str(tmp_path / "whole"))
    assert {r.key[-1]: r.value for r in whole.collect()} == {"f": 0.0, "g": 2.0}
    assert facts is not None


def test_checkpoints_by_project(spark, tmp_path):
    new = spark.createDataFrame
    functions = new([(1, "p", "O0", "b", "f", 3), (2, "q", "O0", "b", "g", 4)], "fn_id long, project string, opt_level string, binary_name string, function_name string, size int")
    obs = new([(1, "t", "ged", 1.0), (2, "t", "ged", 2.0)], "fn_id long, dec string, metric string, value double")
    attempts = new([(1, "t", True), (2, "u", False)], "fn_id long, dec string, decompiled boolean")
    data = Dataset(functions, obs, attempts, new([("t", 0)], "dec string, pos int"), new([("ged", 0)], "metric string, pos int"))
    path = str(tmp_path / "run")
    function_data.save(data, path)
    later = data.having(functions=functions.where("project = 'q'"), obs=new([(2, "t", "ged", 5.0)], obs.schema))
    function_data.save(later, path)  # replaces the one project
    got = function_data.load(spark, path)
    assert {r.fn_id: r.value for r in got.obs.collect()} == {1: 1.0, 2: 5.0} and "project" not in got.obs.columns
    assert {tuple(r) for r in function_data.present_decs(got).collect()} == {("p", "t"), ("q", "u")}
    part = function_data.load(spark, path, exclude=("p",))
    assert [r.project for r in part.functions.collect()] == ["q"] and part.obs.count() == 1
    bad = next((tmp_path / "run" / "obs" / "project=q").glob("*.parquet"))
    bad.write_bytes(b"broken")
    (bad.parent / f".{bad.name}.crc").unlink(missing_ok=True)
    assert {r.fn_id for r in function_data.load(spark, path).obs.collect()} == {1}
