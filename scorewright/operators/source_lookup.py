"""Finding a function's source among a binary's source files, with the reason where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.c_text import definition_udf

#: Statuses. Empty: found in a C file.
FOUND, PREPROCESSED, NO_BINARY, NO_FILES, NOT_IN_FILES, FAILED = "", "preprocessed", "binary_not_found", "no_source_files", "func_not_in_sources", "extract_failed"


def function_sources(wanted: DataFrame, binaries: DataFrame, files: DataFrame) -> DataFrame:
    """(binary, function_name, source, status) of each wanted function.

    wanted: binary, function_name, line and file (both may be null: what debug information says).
    binaries: binary. files: binary, path, text. A file that debug information names comes first, then C
    files before preprocessed ones, then by path. A file counts if it has the name as a word; its
    definition is the one nearest to the line.
    """
    know = binaries.select("binary").distinct().withColumn("known", F.lit(True))
    have = files.groupBy("binary").agg(F.count(F.lit(1)).alias("files"))
    word = F.concat(F.lit(r"(?<!\w)"), F.col("function_name"), F.lit(r"(?!\w)"))
    pairs = wanted.join(files, "binary").where(F.expr("instr(text, function_name) > 0")).where(F.regexp_like("text", word))
    pairs = pairs.withColumn("source", definition_udf()("text", "function_name", "line"))
    c = F.col("path").endswith(".c")
    named = F.coalesce(F.col("path").endswith(F.concat(F.lit("/"), F.col("file"))) | (F.col("path") == F.col("file")), F.lit(False))
    best = Window.partitionBy("binary", "function_name").orderBy(F.col("source").isNull(), ~named, ~c, "path")
    first = pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("binary", "function_name", "source", c.alias("plain"), F.lit(True).alias("seen"))
    out = wanted.select("binary", "function_name").distinct().join(know, "binary", "left").join(have, "binary", "left").join(first, ["binary", "function_name"], "left")
    status = (
        F.when(F.col("source").isNotNull(), F.when(F.col("plain"), FOUND).otherwise(PREPROCESSED))
        .when(F.col("known").isNull() & F.col("files").isNull(), NO_BINARY)
        .when(F.col("files").isNull(), NO_FILES)
        .when(F.col("seen").isNull(), NOT_IN_FILES)
        .otherwise(FAILED)
    )
    return out.select("binary", "function_name", "source", status.alias("status"))
