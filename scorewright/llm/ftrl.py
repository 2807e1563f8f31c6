"""FTRL-proximal logistic regression on hashed binary features, with a calibration that is fitted out of fold.

Labelled rows, at most about ``MOST_LABELLED``, are dealt into ``FOLDS`` folds by a hash of the id. One
model learns from all of them and one more without each fold; each of these few models is a task that
streams over the rows ``ROUNDS`` times, so memory is bounded by the model. In-sample scores are
saturated, so the scale and intercept of the scores are fitted on every row's score by the model that
hasn't seen its fold (Platt's smoothed logistic fit), and folded into the weights. L1 leaves few weights
other than zero; those are all that leaves a model's task. The driver sees them, and a label and a score
for each training row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, setting

DIMS = 1 << 18
FOLDS = 3
ROUNDS = 3
#: Chosen by cross-validation on training rows of sf0.1.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
#: Labelled rows that training takes at most (in expectation: a threshold on a hash of the id).
MOST_LABELLED = 20_000
BIAS = DIMS

Features = Callable[[str], np.ndarray]
Model = tuple[np.ndarray, np.ndarray]


def bucket(keys: np.ndarray) -> np.ndarray:
    """Feature numbers below ``DIMS`` of unsigned 64-bit keys."""
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int32)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def pass_over(rows: Iterator[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal; changes ``z`` and ``n``."""
    for idx, y in rows:
        idx = np.append(idx, BIAS)
        zi, ni = z[idx], n[idx]
        w = weights(zi, ni)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[idx] = zi + g - step * w
        n[idx] = ni + g * g


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, y) of training rows: label 0 or 1, crc32 of the id not divisible by 5, at most about ``most``."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.where(~held_out("doc_id"))
    share = most / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # bounded by ``most``


def held_out(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model's weights other than zero, after all of its rows as often as they come."""
    model, z, n = None, np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for b in batches:  # of one model
        if len(b):
            model = int(b["model"].iat[0])
            pass_over(zip(b["x"], b["y"], strict=True), z, n)
    if model is not None:
        w = weights(z, n)
        some = np.flatnonzero(w).astype(np.int32)
        yield pd.DataFrame({"model": [model], "i": [some.tobytes()], "w": [w[some].tobytes()]})


def _dense(model: Model) -> np.ndarray:
    w = np.zeros(DIMS + 1)
    w[model[0]] = model[1]
    return w


def _out_of_fold(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [_dense(m) for m in sent.value]
        for b in batches:
            scores = [float(models[k][x].sum() + models[k][BIAS]) for x, k in zip(b["x"], b["fold"], strict=True)]
            yield pd.DataFrame({"s": scores, "y": b["y"]})

    return run


def calibration(s: np.ndarray, y: np.ndarray, balanced: bool) -> tuple[float, float]:
    """Scale and intercept that make scores ``s`` the log odds of label 1. balanced: as if both labels were equally frequent.

    A damped Newton fit to Platt's targets, which keeps the scale finite where scores part the labels.
    (1, 0), scores as they are, where a label is missing or scores don't rise with the label.
    """
    ones, zeros = float(y.sum()), float((1 - y).sum())
    if not ones or not zeros or not np.ptp(s):
        return 1.0, 0.0
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    share = np.where(y == 1, 0.5 / ones, 0.5 / zeros) if balanced else np.full(len(y), 1 / len(y))
    ab, x = np.array([1.0, 0.0]), np.stack([s, np.ones(len(s))])

    def loss(ab: np.ndarray) -> float:
        m = ab @ x
        return float((share * (np.logaddexp(0, m) - target * m)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -35, 35)))
        step = np.linalg.solve((x * (share * p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (share * (p - target)))
        while loss(ab - step) > loss(ab) and abs(step).max() > 1e-9:
            step = step / 2
        ab = ab - step
        if abs(step).max() <= 1e-9:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def train(rows: DataFrame, features: Features, balanced: bool = False) -> Model:
    """(feature numbers, weights) other than zero; the bias is feature ``BIAS``. Empty if there are no rows."""
    spark = rows.sparkSession

    @F.pandas_udf("array<int>")
    def hashed(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(features(t or "")) for t in text])

    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(FOLDS)).cast("int").alias("fold")
    path = scratch_path(spark, "ftrl")  # a folder for each fold: a model's task reads those of its own
    rows.select("y", hashed("text").alias("x"), fold).write.partitionBy("fold").parquet(path)
    data = spark.read.schema("y int, x array<int>, fold int").parquet(path)
    if data.isEmpty():
        return np.zeros(0, np.int32), np.zeros(0)
    # model ``FOLDS`` has all rows, the others lack their fold; each in one task, which reads them once for each round
    models = [(np.zeros(0, np.int32), np.zeros(0)) for _ in range(FOLDS + 1)]
    own = [data.where(F.col("fold") != k).select(F.lit(k).alias("model"), "x", "y") for k in range(FOLDS + 1)]
    dealt = reduce(DataFrame.union, [reduce(DataFrame.union, [rounds] * ROUNDS).coalesce(1) for rounds in own])
    with setting(spark, "spark.sql.unionOutputPartitioning", "false"):  # else the models' single partitions become one
        learnt = dealt.mapInPandas(_learn, "model int, i binary, w binary").collect()  # a row for each model: few of DIMS + 1 weights
    for r in learnt:
        models[r["model"]] = np.frombuffer(r["i"], np.int32), np.frombuffer(r["w"])
    sent = spark.sparkContext.broadcast(models[:FOLDS])
    seen = data.mapInPandas(_out_of_fold(sent), "s double, y int").toArrow()  # a row for each training row
    sent.destroy()
    scale, shift = calibration(seen["s"].to_numpy(), seen["y"].to_numpy().astype(float), balanced)
    w = scale * _dense(models[FOLDS])
    w[BIAS] += shift
    some = np.flatnonzero(w).astype(np.int32)
    return some, w[some]


def scorer(spark, model: Model, features: Features):
    """Column function: probability of label 1; 0 for every text where nothing was learnt."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        some, _ = sent.value
        dense = _dense(sent.value)
        live = dense != 0
        for texts in batches:
            out = np.zeros(len(texts))
            if len(some):
                for i, t in enumerate(texts):
                    x = features(t or "")
                    out[i] = dense[np.unique(x[live[x]])].sum() + dense[BIAS]
                out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pd.Series(out)

    return score
