"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Documents
link when their fingerprints differ in at most ``DISTANCE`` bits. The 64 bits are cut into three
segments, fewer than the distance, so that in some segment two linked fingerprints differ by at
most one bit. Every fingerprint is indexed under 64 variants: one segment with one of its bits as
a wildcard. Two segments at most one bit apart share a variant, so an equality join on variants
finds every link, and a bit count verifies it.

Groups of copies never become all pairs. Equal fingerprints are one row before the join. In each
variant, all members are first compared with one pivot, the fingerprint of most documents, which
joins a group of near copies in one step. A second, exact pass then compares only members of
different components, and only those outside the pivot's component with the rest. Fingerprints of
texts of few shingles aren't uniform, so some variants are crowded: beyond ``CROWD`` members a variant
is split by its other bits. They are cut into six parts, of which four differing bits leave at least two
equal, so members are dealt out by all fifteen pairs of parts; no link is lost.

Null and empty texts have fingerprint zero and link like any other; very long texts are summed in
pieces. Repeated rows come back as often as they came. Null ids get a component, but never name it
unless no member has an id. ``keep_one`` leaves one row of each component: of the smallest id (null ids
last), then of the least text hash, and one of rows equal in both. Extra columns are ignored by
``fingerprints`` and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialise, small_batches, table, text_of

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: First bit and width of each segment: 3 segments for a distance of 4.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members from which a variant is split by pairs of parts of the bits outside its segment. Up to
#: there a variant takes some four million comparisons of bits, less than fifteen rows a member.
CROWD, PARTS = 2048, 6


def simhash(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    ones = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    for part in np.array_split(hashes, 1 + n // 65536):  # 64 bytes a shingle at a time
        ones += np.unpackbits(part.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint_udf(width: int):
    """Column function: the fingerprint of a text as a signed long."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, width) for t in text], np.uint64).view(np.int64))

    return fp


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint as a signed long."""
    return docs.select("doc_id", fingerprint_udf(width)(docs["text"].cast("string")).alias("fp"))


def variants(fps: DataFrame) -> DataFrame:
    """64 rows for each row of ``fps``, with the variant's ``key``: wildcard bit and the rest of its segment."""
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows of few bytes become many
    masks = [((1 << w) - 1) << s for s, w in SEGMENTS]
    seg = [next(i for i, (s, w) in enumerate(SEGMENTS) if s <= p < s + w) for p in range(64)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    keep = F.array(*[F.lit(signed(masks[seg[p]] & ~(1 << p))) for p in range(64)])
    shift = F.array(*[F.lit(SEGMENTS[seg[p]][0]) for p in range(64)])
    out = fps.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    part = F.expr("shiftrightunsigned(_kept, _by)")
    out = out.withColumn("_kept", F.col("fp").bitwiseAND(keep[F.col("p")])).withColumn("_by", shift[F.col("p")])
    return out.withColumn("key", part * 64 + F.col("p")).drop("p", "_kept", "_by")


def _split(rows: DataFrame) -> DataFrame:
    """``rows`` (key, fp, m) with ``sub``: null, or for members of a crowded variant fifteen rows, one for each pair of equal parts.

    Only members of crowded variants are exploded; all others stay the one row that they are.
    """
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    masks = []
    for start, width in SEGMENTS:
        others = [b for b in range(64) if not start <= b < start + width]
        parts = [sum(1 << b for b in others[k::PARTS]) for k in range(PARTS)]
        masks.append([signed(parts[i] | parts[j]) for i in range(PARTS) for j in range(i)])
    segment = F.array(*[F.lit(next(i for i, (s, w) in enumerate(SEGMENTS) if s <= p < s + w)) for p in range(64)])
    own = F.get(F.array(*[F.array(*map(F.lit, m)) for m in masks]), segment[F.pmod("key", F.lit(64)).cast("int")])
    subs = F.transform(own, lambda m, i: F.xxhash64(i, F.col("fp").bitwiseAND(m)))
    whole = rows.where(F.col("m") <= CROWD).withColumn("sub", F.lit(None).cast("long"))
    return whole.unionByName(rows.where(F.col("m") > CROWD).withColumn("sub", F.explode(subs)))


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _linkable(distance: int):
    """Variants of more than two members, or of two that link; two others can't."""
    return (F.col("m") > 2) | (F.col("m") == 2) & _near("a", "b", distance)


def link(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, comp, component_id) for each distinct fingerprint of ``fps`` (doc_id, fp)."""
    if distance // len(SEGMENTS) > 1 or distance > PARTS - 2:
        raise ValueError("a segment could differ by more than one bit, or too few parts be equal")
    own = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    key = Window.partitionBy("key")
    least, most, m = (f("fp").over(key) for f in (F.min, F.max, F.count))
    crowd = variants(own.select("fp", "n")).withColumns({"m": m, "a": least, "b": most, "pivot": F.max_by("fp", "n").over(key)}).where(_linkable(distance))
    stars = crowd.where((F.col("fp") != F.col("pivot")) & _near("fp", "pivot", distance)).select(F.col("fp").alias("u"), F.col("pivot").alias("v"))
    stars = materialise(stars.distinct(), "simhash-stars")
    comp = materialise(components(stars, "simhash-cc"), "simhash-comp")
    named = own.join(comp.select(F.col("node").alias("fp"), "comp"), "fp", "left").select("fp", "n", F.coalesce("comp", "fp").alias("comp"))
    mixed = variants(named).withColumns({"m": m, "a": least, "b": most, "c0": F.min("comp").over(key), "c1": F.max("comp").over(key), "pc": F.max_by("comp", "n").over(key)})
    rest = materialise(mixed.where(_linkable(distance) & (F.col("c0") != F.col("c1"))).select("key", "fp", "m", "comp", "pc"), "simhash-mixed")
    few = _split(rest.where("comp <> pc")).select("key", "sub", F.col("fp").alias("u"), F.col("comp").alias("cu"))
    every = _split(rest).select("key", "sub", F.col("fp").alias("v"), F.col("comp").alias("cv"))
    more = few.join(every, (few["key"] == every["key"]) & few["sub"].eqNullSafe(every["sub"]) & (F.col("cu") != F.col("cv")) & _near("u", "v", distance))
    joined = more.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    above = materialise(components(joined, "simhash-cc2"), "simhash-comp2")
    top = comp.join(above.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    top = top.select("node", F.coalesce("top", "comp").alias("comp"))
    lone = above.select("node", "comp").join(comp.select("node"), "node", "left_anti")  # in no star, but linked
    top = top.unionByName(lone)
    full = own.join(top.select(F.col("node").alias("fp"), "comp"), "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    full = materialise(full, "simhash-full")
    least = full.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return full.join(least, "comp").select("fp", "comp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document."""
    fps = materialise(fingerprints(docs, width), "simhash-fps")
    out = fps.join(link(fps, distance).select("fp", "component_id"), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates, with the columns of ``docs``."""
    text = text_of(docs)
    marks = [F.xxhash64(docs["doc_id"], text).alias("_k1"), F.xxhash64(text, F.lit(1)).alias("_k2")]  # of a row's id and text
    own = [f"d_{c}" for c in docs.columns]
    fp = fingerprint_udf(SHINGLE)
    fps = materialise(docs.select("doc_id", fp(docs["text"].cast("string")).alias("fp"), *marks), "simhash-fps")
    rows = fps.join(link(fps.select("doc_id", "fp")).select("fp", "comp"), "fp")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k2", "_k1")).alias("w"))
    kept = materialise(first.select("w._k1", "w._k2"), "simhash-kept")
    # one of equal rows, of which a task sends on one at most; then those rows stay that are kept
    one = Window.partitionBy("_k1", "_k2").orderBy(F.lit(0))
    all_rows = docs.select(*[docs[c].alias(d) for c, d in zip(docs.columns, own, strict=True)], *marks)
    all_rows = all_rows.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    return all_rows.join(kept, ["_k1", "_k2"], "left_semi").select(*[F.col(d).alias(c) for c, d in zip(docs.columns, own, strict=True)])


def query(spark, sf_dir):
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
