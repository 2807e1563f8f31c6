import random

import pytest
import xxhash

from scorewright.llm import simhash_dedup as op

SCHEMA = "doc_id long, text string, lang string"


def slow_simhash(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").replace("\t", " ").split(" ") if x]
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows):
    fp = [slow_simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{fp[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=1):
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6)))
    for g in range(12):
        base = [word() for _ in range(r.choice([3, 40, 400]))]
        for _ in range(r.choice([1, 3, 25])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) * 3 + 5, (" \n" if g % 2 else " ").join(w).title()))
    return rows + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One"), (9005, "one two  three"), (9006, "x" * 50_000)]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    assert sorted(map(tuple, op.near_duplicates(df).collect())) == brute(rows)


def test_chain_of_fingerprints(spark):
    """Links are transitive: ends of the chain differ in 40 bits."""
    fps = [(i, (1 << 4 * i) - 1) for i in range(11)] + [(100, -1)]
    out = {r.fp: r.component_id for r in op.link(spark.createDataFrame(fps, "doc_id long, fp long")).collect()}
    assert {out[f] for _, f in fps[:11]} == {0} and out[-1] == 100


def test_random_fingerprints_lose_no_link(spark):
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randint(1, 6)):
                g ^= 1 << b
            fps.append(g)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    out = {x.fp: x.component_id for x in op.link(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert [out[f] for _, f in rows] == comp


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op.near_duplicates(empty).collect() == []
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (None, "zz yy xx", None)]
    out = op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 4 and sorted(str(r.component_id) for r in out) == ["1", "1", "1", "None"]
    kept = op.keep_one(spark.createDataFrame([(3, "a b c d e", "x"), (2, "A b c d e", "y"), (None, "q", "z")], SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_distance_needs_enough_segments(spark):
    with pytest.raises(ValueError):
        op.link(spark.createDataFrame([(1, 1)], "doc_id long, fp long"), distance=6)


def test_crowded_variants_lose_no_link(spark, monkeypatch):
    """Fingerprints with few bits set crowd some variants, which are split."""
    r = random.Random(6)
    fps = sorted({sum(1 << b for b in range(63) if r.random() < 0.12) for _ in range(400)} | {1 << b for b in range(63)})
    frame = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    for crowd in (2, 64):
        monkeypatch.setattr(op, "CROWD", crowd)
        out = {x.fp: x.component_id for x in op.link(frame).collect()}
        assert [out[f] for f in fps] == comp


def test_keep_one_of_repeated_rows(spark):
    text = "a b c d e f g h"
    rows = [(5, text, "x"), (5, text, "y"), (5, "zz yy", "x"), (None, text, "x"), (None, "zz yy", "n"), (None, "qq", "x"), (None, "qq", "x"), (7, None, "x"), (7, "", "y")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"fp": op.F.lit(1), "component_id": op.F.lit("c"), "_k1": op.F.lit(2)})
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), (r.text or "")) for r in kept.collect()) == [("5", text), ("5", "zz yy"), ("7", ""), ("None", "qq")]
    assert op.keep_one(df.limit(0)).collect() == []


def test_only_crowded_variants_are_exploded(spark):
    rows = spark.createDataFrame([(64 * i, i, 3 if i else op.CROWD + 1) for i in range(5)], "key long, fp long, m long")
    out = op._split(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate") :]
    assert f"> {op.CROWD})" in below and sorted(r.fp for r in out.collect()) == [0] * 15 + [1, 2, 3, 4]
