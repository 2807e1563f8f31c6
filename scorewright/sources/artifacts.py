"""Files of a results tree: decompiled code and its headers, source graphs, binaries, project settings."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Machine numbers of ELF and PE headers.
ELF_MACHINES = {0x28: "arm", 0xB7: "aarch64", 0x3E: "x86-64", 0x03: "x86", 0xF3: "riscv"}
PE_MACHINES = {0x14C: "x86", 0x8664: "x86-64", 0xAA64: "aarch64", 0x1C0: "arm"}
#: Compilers that build for a format and architecture.
RECOMPILERS = {
    ("elf", "x86-64"): "gcc",
    ("elf", "x86"): "gcc",
    ("elf", "arm"): "arm-none-eabi-gcc",
    ("elf", "aarch64"): "aarch64-linux-gnu-gcc",
    ("pe", "x86"): "i686-w64-mingw32-gcc",
    ("pe", "x86-64"): "x86_64-w64-mingw32-gcc",
}


def _parts(path: Column) -> list[Column]:
    """(opt_level, project, file name) of ``.../<opt>/<project>/<folder>/<file>``."""
    p = F.split(path, "/")
    return [F.element_at(p, -4).alias("opt_level"), F.element_at(p, -3).alias("project"), F.element_at(p, -1).alias("file")]


def split_artifact(file: Column, decs: list[str] | None) -> tuple[Column, Column]:
    """(dec, stem) of ``<dec>_<stem>.<ext>``: the longest known tool that fits, else what stands before the first ``_``."""
    base = F.regexp_replace(file, r"\.[^.]*$", "")
    if decs:
        dec = F.coalesce(*[F.when(base.startswith(d + "_"), F.lit(d)) for d in sorted(decs, key=len, reverse=True)])
    else:
        dec = F.when(F.contains(base, F.lit("_")), F.substring_index(base, "_", 1))
    return dec, F.substring(base, F.length(dec) + 2, F.length(base))


def decompiled(spark: SparkSession, tree: str, decs: list[str] | None = None, opts: list[str] | None = None, projects: list[str] | None = None) -> DataFrame:
    """(opt_level, project, dec, stem, function_name, addr, code, line_count) of all ``decompiled/*.c`` of a tree."""
    rows = spark.read.text(f"{tree}/*/*/decompiled/*.c", wholetext=True).select("value", *_parts(F.input_file_name()))
    dec, stem = split_artifact(F.col("file"), decs)
    rows = rows.select("opt_level", "project", dec.alias("dec"), stem.alias("stem"), F.inline(X.function_blocks(F.col("value")))).where("dec is not null")
    for column, wanted in (("opt_level", opts), ("project", projects)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(*wanted))
    lines = F.when(F.col("code") == "", 0).otherwise(F.size(F.split("code", r"\r\n|\r|\n")))
    return rows.select("opt_level", "project", "dec", "stem", F.col("name").alias("function_name"), "addr", "code", lines.alias("line_count"))


def marker_names(spark: SparkSession, tree: str, decs: list[str] | None = None) -> DataFrame:
    return decompiled(spark, tree, decs).select("opt_level", "project", F.col("stem").alias("binary_name"), "dec", "function_name")


def toml_headers(spark: SparkSession, tree: str, decs: list[str] | None = None) -> DataFrame:
    """(opt_level, project, dec, stem, total_time, function_count, timeout): only what stands before the first table."""
    rows = spark.read.text(f"{tree}/*/*/decompiled/*.toml", wholetext=True).select("value", *_parts(F.input_file_name()))
    dec, stem = split_artifact(F.col("file"), decs)
    head = F.split(F.col("value"), r"(?m)^\[", 2)[0]
    key = lambda k, p: F.regexp_extract(head, rf"(?m)^{k}\s*=\s*({p})", 1)
    number = r"[-+]?[0-9_]*\.?[0-9_]+(?:[eE][-+]?[0-9]+)?"
    return rows.select("opt_level", "project", dec.alias("dec"), stem.alias("stem"), key("total_time", number).try_cast("double").alias("total_time"), key("function_count", r"\d+").try_cast("int").alias("function_count"), (key("timeout", r"\w+") == "true").alias("timeout"))


def toml_documents(spark: SparkSession, glob: str) -> DataFrame:
    """(path, json): TOML files as JSON text; broken ones have null. Python has the only parser of the format here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def parsed(raw: bytes) -> str | None:
            try:
                return json.dumps(tomllib.loads(bytes(raw).decode("utf-8")), default=str)
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                return None

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "json": [parsed(c) for c in b["content"]]})

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, "path string, json string")


PROJECT = "struct<name:string,version:string,source_remote:string,remote_type:string,labels:array<string>,binary_labels:map<string,array<string>>,is_malware:boolean,apply_patch:string,compilation:struct<optimization_levels:array<string>,base_flags:array<string>,c_compiler:string>>"


def projects(spark: SparkSession, globs: list[str]) -> DataFrame:
    """Project settings, in the order of file names; a relative patch is resolved beside its file."""
    rows = toml_documents(spark, ",".join(globs)) if len(globs) == 1 else toml_documents(spark, "{" + ",".join(globs) + "}")
    rows = rows.where("json is not null").select("path", F.from_json("json", PROJECT).alias("p")).select("path", "p.*")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    patch = F.when(~F.col("apply_patch").startswith("/"), F.concat(folder, F.lit("/"), "apply_patch")).otherwise(F.col("apply_patch"))
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.toml$", "")
    return rows.withColumns({"apply_patch": patch, "is_malware": F.coalesce("is_malware", F.lit(False))}).orderBy(stem)


def source_graphs(spark: SparkSession, glob: str) -> DataFrame:
    """(opt_level, project, unit, name, nodes, edges, entry, exit) of serialised source graphs."""
    schema = "opt string, project string, binary string, functions map<string,struct<nodes:array<int>,edges:array<array<int>>,entry:array<int>,exit:array<int>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    rows = rows.select(F.col("opt").alias("opt_level"), "project", F.col("binary").alias("unit"), F.explode("functions").alias("name", "g"))
    edges = F.transform("g.edges", lambda e: F.struct(e[0].alias("u"), e[1].alias("v")))
    return rows.select("opt_level", "project", "unit", "name", "g.nodes", edges.alias("edges"), "g.entry", "g.exit")


def units(spark: SparkSession, glob: str) -> DataFrame:
    """(project, stem, content, sha) of preprocessed files without system headers."""
    rows = spark.read.text(glob, wholetext=True).select("value", *_parts(F.input_file_name()))
    body = X.strip_system_headers(F.col("value"))
    return rows.select("project", F.regexp_replace("file", r"\.[^.]*$", "").alias("stem"), body.alias("content")).withColumn("sha", F.sha2(F.trim("content"), 256))


def _u16(content: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda k: F.conv(F.hex(F.substring(content, at + k, F.lit(1))), 16, 10).cast("int")
    return byte(1) + byte(2) * 256


def _u32(content: Column, at: int) -> Column:
    return _u16(content, at) + _u16(content, at + 2) * 65536


def sniff(content: Column) -> Column:
    """struct<fmt, arch, bits> of a linked ELF or PE file's content; null for others."""
    known = lambda table, m: F.coalesce(*[F.when(m == k, F.lit(v)) for k, v in table.items()], F.lit("other"))
    head = lambda n: F.hex(F.substring(content, F.lit(1), F.lit(n)))
    elf = F.when((head(4) == "7F454C46") & (F.length(content) >= 20), known(ELF_MACHINES, _u16(content, 18)))
    at = _u32(content, 0x3C)
    pe = F.when((head(2) == "4D5A") & (F.length(content) >= 64) & (F.hex(F.substring(content, at + 1, F.lit(4))) == "50450000"), known(PE_MACHINES, _u16(content, at + 4)))
    info = lambda fmt, arch: F.struct(F.lit(fmt).alias("fmt"), arch.alias("arch"), F.when(arch.isin("x86-64", "aarch64"), 64).otherwise(32).alias("bits"))
    return F.when(elf.isNotNull(), info("elf", elf)).when(pe.isNotNull(), info("pe", pe))


def recompiler(fmt: Column, arch: Column) -> Column:
    """The compiler for a format and architecture; null: byte matches abstain."""
    return F.coalesce(*[F.when((fmt == f) & (arch == a), F.lit(c)) for (f, a), c in RECOMPILERS.items()])


def binaries(spark: SparkSession, tree: str) -> DataFrame:
    """(opt_level, project, file, path, size, sha256, info) of the linked binaries of a tree."""
    rows = spark.read.format("binaryFile").load(f"{tree}/*/*/compiled/*")
    rows = rows.withColumn("info", sniff(F.col("content"))).where("info is not null")
    return rows.select(*_parts(F.col("path")), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "info")


def resolve_binaries(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (opt_level, project, stem) with the binary's path: the exact name, else the first of the same stem."""
    f = found.select("opt_level", "project", "file", "path").withColumn("fstem", F.regexp_replace("file", r"(?<=.)\.[^.]*$", ""))
    on = (wanted["opt_level"] == f["opt_level"]) & (wanted["project"] == f["project"]) & ((wanted["stem"] == f["fstem"]) | (wanted["stem"] == f["file"]))
    rank = F.struct((F.col("stem") != F.col("file")).cast("int"), "file")
    rows = wanted.join(f, on, "left").select(wanted["opt_level"], wanted["project"], "stem", "file", "path")
    return rows.groupBy("opt_level", "project", "stem").agg(F.min_by("path", rank).alias("path"))
