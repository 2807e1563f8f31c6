"""Quality: a document classifier's evidence combined with host and path posteriors by hierarchical empirical Bayes.

The classifier is a hashed logistic regression on words and on token shapes (letters, digits and
signs in their order). Its probabilities are the observations of a two-level normal model:
documents in paths, paths in hosts, hosts around a global mean. Variances between hosts, between
paths and inside paths are estimated from grouped sums by the method of moments. A path's posterior
shrinks its mean towards its host's, a host's towards the global mean, the more the fewer documents
it has; a document's own evidence is left out of what it is compared with. The document's log odds
are for the global rate of good documents; the posterior for its own path's rate has them shifted by how
far the path's log odds are from the global ones.

In the table of documents the source is the host, and source and language are the path. Groups are
summed before the shuffle, so a source with a third of all rows costs no task more than others.
Null sources and languages are sites of their own. Null and empty texts have the bias's evidence.
Very long texts are read whole. Repeated rows are each scored. Without labels all evidence is 0.5 and everything is kept. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import materialise, small_batches, table

KEEP = 0.5
LEAST_VARIANCE = 1e-6
_SHAPE = bytes(0x61 if b >= 0x80 or chr(b).isalpha() else 0x30 if chr(b).isdigit() else b for b in range(256))
_RUNS = re.compile(rb"a+|0+")


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    shapes = _RUNS.sub(lambda m: m[0][:1], raw.translate(_SHAPE)).split()
    a = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    s = np.fromiter(map(zlib.crc32, shapes), np.uint64, len(shapes)) + np.uint64(1 << 40)
    pairs = s[:-1] * np.uint64(0xD6E8FEB86659FD93) + s[1:] * np.uint64(0xA0761D6478BD642F) if len(s) > 1 else s[:0]
    return ftrl.bucket(np.concatenate([a, s, pairs]))


def evidence(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, host, path, p): the classifier's probability of good quality."""
    model = ftrl.train(ftrl.labelled(docs, labels, "quality"), features)
    p = ftrl.scorer(docs.sparkSession, model, features)(docs["text"].cast("string")) if len(model[0]) else F.lit(0.5)
    return docs.select("doc_id", F.col("source").cast("string").alias("host"), F.col("lang").cast("string").alias("path"), p.alias("p"))


def _logit(c):
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    return F.log(c / (1 - c))


def posteriors(seen: DataFrame) -> DataFrame:
    """``seen`` (doc_id, host, path, p) with host_score, path_score, score and keep."""
    paths = materialise(seen.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("hss"), F.sum(F.col("n") * F.col("n")).alias("hnn"), F.count("n").alias("hk"))
    t = hosts.agg(F.sum("hn"), F.sum("hs"), F.sum("hss"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")), F.sum(F.col("hn") * F.col("hn")), F.count("hn"), F.sum("hk"), F.sum(F.col("hnn") / F.col("hn"))).first()
    total, squares = int(t[0] or 0), float(paths.agg(F.sum("q")).first()[0] or 0.0)
    if not total:
        mean = inner = between_p = between_h = 0.5
    else:
        mean, k_h, k_p = t[1] / total, t[5], t[6]
        inner = max(LEAST_VARIANCE, (squares - t[2]) / max(1, total - k_p))
        between_p = max(LEAST_VARIANCE, (t[2] - t[3] - (k_p - k_h) * inner) / max(1.0, total - t[7]))
        between_h = max(LEAST_VARIANCE, (t[3] - total * mean * mean - (k_h - 1) * inner) / max(1.0, total - t[4] / total))
    f = F.col
    site = paths.alias("p").join(hosts.alias("h"), f("p.host").eqNullSafe(f("h.host"))).select(f("p.host").alias("s_host"), f("p.path").alias("s_path"), "n", "s", "hn", "hs")
    rows = seen.join(site, seen["host"].eqNullSafe(f("s_host")) & seen["path"].eqNullSafe(f("s_path")))
    hn, pn = f("hn") - 1, f("n") - 1
    rows = rows.withColumn("host_score", (F.lit(between_h) * (f("hs") - f("p")) + F.lit(inner) * mean) / (F.lit(between_h) * hn + inner))
    rows = rows.withColumn("path_score", (F.lit(between_p) * (f("s") - f("p")) + F.lit(inner) * f("host_score")) / (F.lit(between_p) * pn + inner))
    odds = _logit(f("p")) + _logit(f("path_score")) - _logit(F.lit(mean))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-odds)))
    return rows.select("doc_id", f("p").alias("doc_score"), "host_score", "path_score", "score", (f("score") >= KEEP).alias("keep"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, doc_score, host_score, path_score, score, keep."""
    return posteriors(materialise(evidence(docs, labels), "quality-evidence"))


def query(spark, sf_dir):
    small_batches(spark)
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
