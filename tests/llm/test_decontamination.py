import hashlib
import random
import re

from scorewright.llm import decontamination as op

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, h string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k, s in items:
            v = words(s)
            n = min(10, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add("" if k is None else str(k))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "x") for x in docs], DOCS)
    b = spark.createDataFrame([(*x, "x") for x in items], ITEMS)
    return sorted(map(tuple, op.contamination(d, b).collect()), key=str)


def test_matches_brute_force(spark):
    r = random.Random(5)
    vocab = ["the", "of", "Café", "x1", "ÉA", "on", "in"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 4, 7, 10, 11, 30]))) for i in range(25)] + [(99, "the of the of the of the of the of the of"), (98, "on on on on")]
    docs = [(i, text(r.randint(0, 60)) + (items[r.randrange(27)][1].upper() if i % 3 else "") + text(r.randint(0, 30))) for i in range(60)]
    docs += [(200, "on " * 4000 + text(30_000)), (201, None), (202, "")]
    assert run(spark, docs, items) == brute(docs, items)


def test_without_broadcast(spark, monkeypatch):
    """Past the bound only positions are shuffled; a passage that many documents share doesn't matter."""
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(n))
    items = [(i, text(r.choice([2, 4, 9, 12, 20]))) for i in range(12)]
    docs = [(i, text(40) + " " + items[3][1] * (i % 2)) for i in range(60)] + [(7, None), (None, items[3][1]), (1, items[3][1]), (1, items[3][1])]
    monkeypatch.setattr(op, "MOST_BROADCAST", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run(spark, docs, items) == brute(docs, items)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges(spark):
    one = "a b c d e f g h i j k"
    docs = [(1, one), (1, one), (None, one), (2, "a b c d e f g h i"), (1, "other words")]
    items = [(None, one), (7, one), (7, one), (8, None), (9, "")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, []) and run(spark, [], items) == []


def test_drop(spark):
    d = spark.createDataFrame([(1, "z a b c d e f g h i j q", "x"), (2, "clean", "y"), (None, None, None)], DOCS)
    b = spark.createDataFrame([(1, "a b c d e f g h i j", "x")], ITEMS)
    out = op.drop_contaminated(d, b)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {2, None}
