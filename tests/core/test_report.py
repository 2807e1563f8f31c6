import pytest
from pyspark.sql import functions as F

from scorewright.operators.presets import SAMPLE_SET
from scorewright.plans import report
from scorewright.plans.dataset import from_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    return from_tables(spark, SF)


def test_seed(monkeypatch):
    monkeypatch.delenv(report.SEED_VARIABLE, raising=False)
    assert report.seed_of(5) == 5 and report.seed_of() == report.SEED
    monkeypatch.setenv(report.SEED_VARIABLE, "7")
    assert report.seed_of() == 7 and report.seed_of(5) == 5


def sampled(d):
    return {r.fn_id for r in d.functions.where(F.array_contains("datasets", SAMPLE_SET)).collect()}


def test_draw_repeats_and_manifest_pins(spark, data):
    one, again, other = (sampled(report.assign_presets(data, total=40, seed=s)) for s in (1, 1, 2))
    assert len(one) == 40 and one == again and one != other
    manifest = data.functions.where("fn_id % 50 = 0")
    pinned = report.assign_presets(data, manifest)
    assert sampled(pinned) == {r.fn_id for r in manifest.collect()} == sampled(report.assign_presets(pinned, manifest))


def test_bundle(spark, data):
    new = spark.createDataFrame
    code = data.attempts.where("decompiled").select("fn_id", "dec", F.lit("int f;").alias("text"))
    source = new([], "fn_id long, source string, status string")
    withheld = new([("proj_05",)], "project string")
    attached = report.extras(data, code, source, withheld, per_tier=5)
    texts = new([("optimized", "O", None, True)], "name string, title string, description string, is_default boolean")
    stored = new([("unoptimized", None, None, 0), ("optimized", None, None, 1)], "name string, title string, description string, pos int")
    orders, cards = new([("ged", 1)], "metric string, order int"), new([("tool_a", "A", "MIT", {"x": "y"})], "id string, display string, license string, versions map<string,string>")
    out = report.bundle(data, attached, texts, stored, orders, cards, new([], "dec string, raw string"))
    got = {name: df.collect() for name, df in out.items()}
    assert all(got.values()) and got["default_preset"][0].name == "optimized" and [r.metric for r in sorted(got["metrics"], key=lambda r: r.place)][0] == "ged"
    hidden = {r.fn_id for r in data.functions.where("project = 'proj_05'").collect()}
    assert not hidden & {r.fn_id for r in got["samples"]} and not hidden & {r.fn_id for r in got["sample_set"]}
    assert all(r.code and r.status == "binary_not_found" for r in got["sample_set"])
