"""The data model: function records, their scores and attempts, as normalised tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.presets import tag_presets

#: Identity of a function, and of a group of functions.
KEY = ["project", "opt_level", "binary_name", "function_name"]
GROUP = KEY[:3]


@dataclass(frozen=True)
class Dataset:
    """functions: fn_id, the four key columns, size, labels, datasets
    obs: fn_id, dec, metric, value, perfect, distance (a row for each present key)
    attempts: fn_id, dec, decompiled, compiles
    decs: dec, pos, sample_only;  metrics: metric, pos, lower_is_better, perfect_value
    """

    functions: DataFrame
    obs: DataFrame
    attempts: DataFrame
    decs: DataFrame
    metrics: DataFrame

    def having(self, **tables: DataFrame) -> Dataset:
        return replace(self, **tables)


#: The derived views over the driver's tables, word for word the same for Spark and DuckDB.
V_FN = """
SELECT o_orderkey AS fn_id,
       concat('proj_', lpad(CAST(o_custkey % 13 AS varchar(8)), 2, '0')) AS project,
       CASE o_orderkey % 3 WHEN 0 THEN 'O0' WHEN 1 THEN 'O2' ELSE 'O2-noinline' END AS opt_level,
       concat('bin_', lpad(CAST(o_custkey % 40 AS varchar(8)), 2, '0')) AS binary_name,
       concat('fn_', CAST(o_orderkey AS varchar(20))) AS function_name,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS int) END AS size
FROM {orders}"""
V_OBS = """
SELECT l_orderkey AS fn_id,
       CASE l_suppkey % 4 WHEN 0 THEN 'tool_a' WHEN 1 THEN 'tool_b@2.0' WHEN 2 THEN 'tool_c' ELSE 'agent_x' END AS dec,
       max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) = 1 AS decompiled,
       CAST(min(CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'F' THEN floor((l_quantity - 1) / 8) END) AS double) AS ged,
       max(CASE WHEN l_returnflag <> 'R' AND l_linenumber <= 5 THEN (10 - round(l_discount * 100)) / 10 END) AS type_match,
       max(CASE WHEN l_returnflag <> 'R' AND l_linenumber >= 2 THEN (8 - round(l_tax * 100)) / 8 END) AS byte_match
FROM {lineitem} GROUP BY 1, 2"""
DECS = [("tool_a", 0, False), ("tool_b@2.0", 1, False), ("tool_c", 2, False), ("agent_x", 3, True)]
METRICS = [("byte_match", 0, False, 1.0), ("ged", 1, True, 0.0), ("type_match", 2, False, 1.0)]


def obs_long(wide: DataFrame) -> DataFrame:
    """One row for each present metric of a (function, tool) row."""
    cells = F.array(
        F.struct(F.lit("ged").alias("metric"), F.col("ged").alias("value"), (F.col("ged") == 0).alias("perfect"), F.col("ged").alias("distance")),
        F.struct(F.lit("type_match").alias("metric"), F.col("type_match").alias("value"), (F.col("type_match") == 1).alias("perfect"), F.round((1 - F.col("type_match")) * 10).alias("distance")),
        F.struct(F.lit("byte_match").alias("metric"), F.col("byte_match").alias("value"), (F.col("byte_match") == 1).alias("perfect"), F.round((1 - F.col("byte_match")) * 8).alias("distance")),
    )
    return wide.select("fn_id", "dec", F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


def from_tables(spark: SparkSession, sf_dir: str) -> Dataset:
    """The data set that the driver's tables stand for."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    functions = spark.sql(V_FN, orders=read("orders")).withColumn("labels", F.array("opt_level"))
    wide = spark.sql(V_OBS, lineitem=read("lineitem"))
    attempts = wide.select("fn_id", "dec", "decompiled", F.when(F.col("byte_match").isNotNull(), F.col("byte_match") >= 0.5).alias("compiles"))
    functions = tag_presets(functions, sample=F.col("fn_id") % 17 == 0)
    decs = spark.createDataFrame(DECS, "dec string, pos int, sample_only boolean")
    metrics = spark.createDataFrame(METRICS, "metric string, pos int, lower_is_better boolean, perfect_value double")
    return Dataset(functions, obs_long(wide), attempts, decs, metrics)


#: The same tables as common table expressions for DuckDB.
SQL = (
    "v_fn AS ("
    + V_FN.format(orders="orders")
    + "), v_obs AS ("
    + V_OBS.format(lineitem="lineitem")
    + """), obs AS (
  SELECT fn_id, dec, 'ged' AS metric, ged AS value, ged = 0 AS perfect, ged AS distance FROM v_obs WHERE ged IS NOT NULL
  UNION ALL SELECT fn_id, dec, 'type_match', type_match, type_match = 1, round((1 - type_match) * 10) FROM v_obs WHERE type_match IS NOT NULL
  UNION ALL SELECT fn_id, dec, 'byte_match', byte_match, byte_match = 1, round((1 - byte_match) * 8) FROM v_obs WHERE byte_match IS NOT NULL
), decs(dec, pos, sample_only) AS (
  VALUES ('tool_a', 0, false), ('tool_b@2.0', 1, false), ('tool_c', 2, false), ('agent_x', 3, true)
), metrics(metric, pos, lower_is_better, perfect_value) AS (
  VALUES ('byte_match', 0, false, 1.0), ('ged', 1, true, 0.0), ('type_match', 2, false, 1.0)
), thr AS (
  SELECT avg(size) + stddev_pop(size) AS cut FROM v_fn
), fn AS (
  SELECT f.*, list_filter([CASE opt_level WHEN 'O0' THEN 'unoptimized' WHEN 'O2' THEN 'inlined' WHEN 'O2-noinline' THEN 'optimized' END,
    CASE WHEN opt_level = 'O2-noinline' AND size >= cut THEN 'large' END, CASE WHEN fn_id % 17 = 0 THEN 'sample-set' END], lambda x: x IS NOT NULL) AS datasets
  FROM v_fn f, thr
)"""
)
