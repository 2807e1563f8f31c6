"""Traces and session logs of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cost

_USAGE = "struct<input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_creation:map<string,bigint>>"
_TOTAL = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>"
_LINE = f"struct<type:string,message:struct<usage:{_USAGE}>,payload:struct<type:string,info:struct<total_token_usage:{_TOTAL}>>>"


def sessions(spark: SparkSession, glob: str) -> DataFrame:
    """(session, input, cached_input, cache_write, output): a log with usage in its assistant records, else one with running totals; broken lines are skipped."""
    text = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("session"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    rows = text.select("session", "line", F.from_json("raw", _LINE).alias("r")).where("r is not null")
    u, t = F.col("r.message.usage"), F.col("r.payload.info.total_token_usage")
    own = rows.where((F.col("r.type") == "assistant") & u.isNotNull()).select("session", F.col("r.type").alias("type"), u["input_tokens"].alias("input"), u["cache_read_input_tokens"].alias("cached_input"), u["cache_creation_input_tokens"].alias("cache_write"), F.map_values(u["cache_creation"]).alias("cache_write_parts"), u["output_tokens"].alias("output"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    total = rows.where((F.col("r.payload.type") == "token_count") & t.isNotNull()).select("session", "line", zero(t["input_tokens"], "input"), zero(t["cached_input_tokens"], "cached_input"), zero(t["output_tokens"], "output"))
    a, b = cost.assistant_tokens(own), cost.running_tokens(total)
    return a.unionByName(b.join(a.select("session"), "session", "left_anti"))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of ``<folder>/<tool>/*.md``, with the tokens of the session log of the same name, as ``cost.llm_costs`` takes them."""
    md = spark.read.text(f"{folder}/*/*.md", wholetext=True).select(F.input_file_name().alias("path"), "value")
    field = lambda k, p: F.regexp_extract("value", rf"(?m)^- {k}: *({p})", 1)
    status = field("status", r"\w+")
    name = F.regexp_replace(F.col("path"), r"\.md$", "")
    rows = md.select(name.alias("name"), F.element_at(F.split("path", "/"), -2).alias("dec"), F.nullif(field("model", r"\S+"), F.lit("")).alias("model"), F.when(status.isin("FAILED", "TIMEOUT"), status).otherwise("ok").alias("status"), field("elapsed", r"[0-9.]+").try_cast("double").alias("elapsed_s"))
    logs = sessions(spark, f"{folder}/*/*.session.jsonl").withColumn("name", F.regexp_replace("session", r"\.session\.jsonl$", "")).drop("session")
    return rows.join(logs, "name", "left").drop("name")
