"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of words, word pairs, and pairs with one or two words between.
Only the text is an input of a score. Labels of rows whose crc32 of the id is divisible by 5 are
never learnt. Scores are calibrated out of fold as if toxic and clean documents were equally frequent: toxic
ones are few, and a half then weighs missing one like rejecting as large a share of the clean ones.

Null and empty texts have no features and get the score of the bias. Repeated rows are scored as
often as they come, null ids as any others (they are held out: no label can name them). Repeated
labels of one id: the higher counts. Very long texts are read whole, one at a time. Without any label every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import small_batches, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Odd multipliers for the first and second word of pairs at distance 1, 2 and 3.
PAIRS = ((1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3), (3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))


def features(text: str) -> np.ndarray:
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    a = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts = [a] + [a[:-d] * np.uint64(p) + a[d:] * np.uint64(q) for d, p, q in PAIRS if len(a) > d]
    return ftrl.bucket(np.concatenate(parts))


def train(docs: DataFrame, labels: DataFrame):
    return ftrl.train(ftrl.labelled(docs, labels, "toxic"), features, balanced=True)


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` with a column ``toxic_score``."""
    return docs.withColumn("toxic_score", ftrl.scorer(docs.sparkSession, model, features)(docs["text"].cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.coalesce(ftrl.held_out("doc_id"), F.lit(True)).alias("held_out")
    return out.select("doc_id", held, F.col("toxic_score").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score under a half, with the columns of ``docs``."""
    score = ftrl.scorer(docs.sparkSession, train(docs, labels), features)
    return docs.where(score(docs["text"].cast("string")) < 0.5)


def query(spark, sf_dir):
    small_batches(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
