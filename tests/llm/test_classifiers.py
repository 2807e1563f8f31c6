import os
import pickle
import random
import zlib

import numpy as np
import pytest

from scorewright.llm import ftrl, quality, toxicity

SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string, source string, lang string, score double", "doc_id long, toxic int, quality int, text string"


def corpus(n=1500, seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    bad = ["grobian", "vermaledeit", "lump"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        toxic, good = r.random() < 0.25, r.random() < 0.8
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        if not good:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), f"src{i % 7 if i % 3 else 0}", "en" if i % 2 else "fr", 0.1))
        if i % 5:
            labels.append((i, int(toxic), int(good), "x"))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_held_out_accuracy(tables):
    docs, labels = tables
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    right = [out[i].predicted == y for i, y in known.items() if held(i)]
    assert len(right) > 150 and np.mean(right) > 0.93


def test_held_out_labels_are_not_learnt(spark, tables):
    docs, labels = tables
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.toxic if held(r.doc_id) else r.toxic, r.quality, "x") for r in labels.collect()], LABELS)
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", None, "en", 1.0), (7, "", None, "en", 1.0), (8, "lump " * 50_000, "s", None, 0.0)], DOCS)
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.toxic_score for r in toxicity.score(odd, model).collect()}
    assert scores[None] == scores[7] and scores[8] > scores[7]
    assert toxicity.toxicity(odd, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.0
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns
    assert len(quality.quality(odd, labels.limit(0)).collect()) == 4 and quality.quality(docs.limit(0), labels).collect() == []
    assert len(toxicity.toxicity(odd, labels.union(spark.createDataFrame([(7, None, 3, "x"), (7, 1, 1, "x"), (7, 1, 1, "x"), (None, 1, 1, "x")], LABELS))).collect()) == 4


def test_calibration():
    """Scale and intercept against a search on a grid; a half parts scores where both labels are as likely."""
    r = np.random.default_rng(3)
    y = (r.random(4000) < 0.1).astype(float)
    s = r.normal(np.where(y == 1, -1.0, -4.0), 1.0)
    a, b = ftrl.calibration(s, y, balanced=True)
    cut = -b / a
    assert abs(cut + 2.5) < 0.25 and abs((s[y == 1] < cut).mean() - (s[y == 0] > cut).mean()) < 0.05
    plain = ftrl.calibration(s, y, balanced=False)
    p = 1 / (1 + np.exp(-(plain[0] * s + plain[1])))
    assert abs(p.sum() - y.sum()) < 2  # calibrated on the whole
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda k, m: np.mean(np.logaddexp(0, k * s + m) - t * (k * s + m))
    assert loss(*plain) <= min(loss(k, m) for k in np.linspace(0.2, 6, 40) for m in np.linspace(-5, 15, 60)) + 1e-9
    parted = np.array([-2.0, -1.0, 1.0, 2.0])
    assert 0 < ftrl.calibration(parted, np.array([0.0, 0, 1, 1]), False)[0] < 1e3
    assert ftrl.calibration(s, np.zeros(4000), True) == (1.0, 0.0) and ftrl.calibration(np.zeros(3), np.array([0.0, 1, 1]), True) == (1.0, 0.0)
    assert ftrl.calibration(-parted, np.array([0.0, 0, 1, 1]), True) == (1.0, 0.0)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_held_out_recall_and_specificity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    caught = np.mean([r.predicted for r in out if r.toxic == 1])
    left = np.mean([1 - r.predicted for r in out if r.toxic == 0])
    assert caught >= 0.85 and left >= 0.93


def test_bounded_sample(tables):
    docs, labels = tables
    rows = ftrl.labelled(docs, labels, "toxic", most=200).count()
    assert 120 <= rows <= 300 and ftrl.labelled(docs, labels, "toxic").count() == sum(not held(r.doc_id) for r in labels.collect())


def test_pass_matches_plain_loops():
    r = np.random.default_rng(1)
    rows = [(np.unique(r.integers(0, 50, 6)).astype(np.int32), int(r.random() < 0.4)) for _ in range(200)]
    z, n = np.zeros(ftrl.DIMS + 1), np.zeros(ftrl.DIMS + 1)
    ftrl.pass_over(rows, z, n)
    zz, nn = {}, {}
    for x, y in rows:
        idx = [*x.tolist(), ftrl.BIAS]
        w = {}
        for i in idx:
            a = zz.get(i, 0.0)
            w[i] = 0.0 if abs(a) <= ftrl.L1 else -(a - np.sign(a) * ftrl.L1) / ((ftrl.BETA + nn.get(i, 0.0) ** 0.5) / ftrl.ALPHA + ftrl.L2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in idx:
            s = ((nn.get(i, 0.0) + g * g) ** 0.5 - nn.get(i, 0.0) ** 0.5) / ftrl.ALPHA
            zz[i], nn[i] = zz.get(i, 0.0) + g - s * w[i], nn.get(i, 0.0) + g * g
    assert all(np.isclose(z[i], v) for i, v in zz.items()) and all(np.isclose(n[i], v) for i, v in nn.items())


def test_rounds_match_passes_over_all_rows(spark):
    """Equal rows, so that their order is the same in any case; of one label, so that nothing is calibrated."""
    learnt = [i for i in range(40) if not held(i)]
    docs = spark.createDataFrame([(i, "a lump of coal", "s", "en", 0.0) for i in range(40)], DOCS).repartition(3)
    some, w = toxicity.train(docs, spark.createDataFrame([(i, 1, 1, "x") for i in range(40)], LABELS))
    z, n = np.zeros(ftrl.DIMS + 1), np.zeros(ftrl.DIMS + 1)
    ftrl.pass_over([(np.unique(toxicity.features("a lump of coal")), 1)] * len(learnt) * ftrl.ROUNDS, z, n)
    want = ftrl.weights(z, n)
    assert some.tolist() == np.flatnonzero(want).tolist() != [] and np.allclose(w, want[some])


def test_models_states_stay_off_the_driver(spark, tables, monkeypatch):
    """A model's state has megabytes; only weights other than zero come to the driver and go from it."""
    context, sent = type(spark.sparkContext), []
    plain = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or plain(self, value))
    docs, labels = tables
    some, _ = toxicity.train(docs, labels)
    assert len(some) and sent and max(sent) < 100_000


def test_quality(tables):
    docs, labels = tables
    out = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    right = [out[i].keep == bool(y) for i, y in known.items() if held(i)]
    assert len(out) == docs.count() and np.mean(right) > 0.93


def test_posteriors_match_plain_loops(spark):
    r = random.Random(4)
    rows = [(i, h, p, min(0.99, max(0.01, r.gauss(0.3 + 0.1 * "abc".index(h) + 0.05 * (p == "x"), 0.1)))) for i in range(90) for h, p in [(r.choice("abc"), r.choice("xy"))]]
    rows += [(100, None, None, 0.9), (101, "lone", "x", 0.2)]
    out = {x.doc_id: x for x in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, p double")).collect()}
    hosts, paths = {}, {}
    for _, h, p, v in rows:
        hosts.setdefault(h, []).append(v)
        paths.setdefault((h, p), []).append(v)
    n, mean = len(rows), np.mean([x[3] for x in rows])
    within = sum(sum((v - np.mean(x)) ** 2 for v in x) for x in paths.values())
    inner = max(1e-6, within / (n - len(paths)))
    mid = sum(len(x) * (np.mean(x) - np.mean(hosts[k[0]])) ** 2 for k, x in paths.items())
    top = sum(len(x) * (np.mean(x) - mean) ** 2 for x in hosts.values())
    nested = sum(sum(len(x) ** 2 for k, x in paths.items() if k[0] == h) / len(v) for h, v in hosts.items())
    between_p = max(1e-6, (mid - (len(paths) - len(hosts)) * inner) / (n - nested))
    between_h = max(1e-6, (top - (len(hosts) - 1) * inner) / (n - sum(len(x) ** 2 for x in hosts.values()) / n))
    for i, h, p, v in rows:
        hs, ps = hosts[h], paths[h, p]
        host = (between_h * (sum(hs) - v) + inner * mean) / (between_h * (len(hs) - 1) + inner)
        path = (between_p * (sum(ps) - v) + inner * host) / (between_p * (len(ps) - 1) + inner)
        logit = lambda c: np.log(min(1 - 1e-6, max(1e-6, c)) / (1 - min(1 - 1e-6, max(1e-6, c))))
        assert np.isclose(out[i].host_score, host) and np.isclose(out[i].path_score, path)
        assert np.isclose(out[i].score, 1 / (1 + np.exp(-(logit(v) + logit(path) - logit(mean)))))
