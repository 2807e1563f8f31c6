import math
import tomllib

from scorewright.sources import reports


def test_scoreboard_documents(spark, tmp_path):
    m = spark.createDataFrame([('t"x@1', "ged", 1, 3, 100 / 3, 0.5, 0.0, 1), ("b", "ged", 0, 3, 0.0, 2.0, 2.0, 2)], "dec string, metric string, num long, den long, pct double, mean double, median double, rank int")
    o = spark.createDataFrame([('t"x@1', 1, 3, 100 / 3, 1), ("b", 0, 3, 0.0, 2)], "dec string, num long, den long, pct double, rank int")
    path = str(tmp_path / "s.toml")
    reports.write_scoreboard(m, o, path)
    m2, o2 = reports.read_scoreboard(spark, path)
    assert sorted(m2.collect()) == sorted(m.collect()) and sorted(o2.collect()) == sorted(o.collect())
    assert reports.markdown(m, o).splitlines()[2] == '| 1 | t"x@1 | 33.3 % | 33.3 % |'


def test_case_rows(spark):
    df = spark.createDataFrame([("f", math.inf, 4096), ("g", 2.0, None)], "function_name string, margin double, addr long")
    assert [tuple(r) for r in reports.case_rows(df).collect()] == [("f", None, "0x1000"), ("g", 2.0, None)]


def test_sections_are_toml(spark):
    df = spark.createDataFrame([("p", "O0", "b", "t@2", m, 10.0, 5.0, 5.0, 1, 2, 50.0) for m in ("ged", "type_match")], "project string, opt_level string, binary_name string, dec string, metric string, total double, mean double, median double, perfect_count long, n long, pct double")
    r = reports.binary_sections(df).first()
    assert r.path == "O0/p/evaluated/b.toml" and tomllib.loads(r.text)["t@2"]["ged"]["perfect_count"] == 1


def test_append_missing(tmp_path):
    path = str(tmp_path / "a")
    assert reports.append_missing(path, ["x", "y", "x"]) == ["x", "y"] and reports.append_missing(path, ["y", "z"]) == ["z"]
    assert (tmp_path / "a").read_text() == "x\ny\nz\n"
