import hashlib
import random
import re

from pyspark.sql import functions as F

from scorewright.llm import iblt as op

SCHEMA = "doc_id long, text string, edited string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    return out


def test_edits_match_brute_force(spark):
    r = random.Random(0)
    rows = [(i * i * 7 - 1000, "".join(r.choice("aé😀 .\n") for _ in range(r.choice([0, 1, 2, 9, 200])))) for i in range(150)] + [(None, "last one"), (10**15, None)]
    for buckets in (1, 4, 40):
        out = {x.doc_id: x.edited_sha256 for x in op.edited(frame(spark, rows)).select("doc_id", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")).collect()} if buckets == 4 else {x.doc_id: hashlib.sha256(brute(x).encode()).hexdigest() for x in op.with_next(frame(spark, rows), buckets).collect()}
        assert out == brute_edits(rows), buckets


def brute(x):
    half = len(x.text) // 2
    return x.text[: len(x.text) - half] + x.next_text[:half]


def digests(df, *names):
    return df.withColumns({n: F.sort_array(F.transform(n, lambda x: op.digest(x))) for n in names})


def test_difference_recovers_digests(spark):
    r = random.Random(1)
    rows = []
    for i in range(120):
        pool = [r.getrandbits(62) for _ in range(r.choice([0, 1, 5, 40, 300]))]
        rows.append((i, sorted(x for x in pool if r.random() < 0.9), sorted({*(x for x in pool if r.random() < 0.9), *(r.getrandbits(62) for _ in range(r.choice([0, 2, 60])))})))
    df = digests(spark.createDataFrame(rows, "i int, a array<long>, b array<long>"), "a", "b")
    sizes = set()
    for x in df.select("i", "a", "b", op.difference(F.col("a"), F.col("b")).alias("d")).collect():
        assert x.d.ok and set(x.d.plus) == set(x.a) - set(x.b) and set(x.d.minus) == set(x.b) - set(x.a), x.i
        assert len(x.d.plus) + len(x.d.minus) == len(set(x.a) ^ set(x.b)) and x.d.left == 0
        sizes.add(x.d.cells)
    assert len(sizes) > 1


def test_retries_larger_until_it_succeeds(spark):
    """The smaller text's size is too small for what only the larger one has."""
    rows = [(i, list(range(k)), list(range(10**6, 10**6 + n))) for i, (k, n) in enumerate([(0, 0), (1, 11), (12, 12), (12, 40), (12, 180), (100, 700)])]
    df = digests(spark.createDataFrame(rows, "i int, a array<long>, b array<long>"), "a", "b")
    out = df.select("i", F.size("a").alias("n"), F.size("b").alias("m"), op.size_of(F.col("a")).alias("own"), op.difference(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert all(x.d.ok and (len(x.d.plus), len(x.d.minus)) == (x.n, x.m) for x in out)
    assert out[4].d.cells > out[4].own == 48 and out[5].d.cells > out[5].own
    few = df.where("i = 5").select(op.peel(op.subtract(F.col("a"), F.col("b"), 48), 48).alias("p")).first().p
    assert few.cells  # 48 cells don't hold 800 elements


def test_sketches_fold_and_subtract(spark):
    """A smaller sketch is a larger one folded, a difference's that of the two sketches, and a fingerprint peels by itself."""
    df = digests(spark.createDataFrame([([5 * i for i in range(90)], [7 * i for i in range(60)])], "a array<long>, b array<long>"), "a", "b")
    r = df.select("a", "b", *[op.sketch(F.col(k), m).alias(f"{k}{m}") for k in "ab" for m in (48, 192, 768)], op.subtract(F.col("a"), F.col("b"), 192).alias("d"), op.peel(op.sketch(F.col("a"), 768), 768).alias("p"), op.printed(F.col("a")).alias("s")).first()
    plain = lambda cells: {c.cell: (c.n, c.key) for c in cells}

    def folded(cells, third):
        out = {}
        for c in cells:
            at = c.cell % third // 4 + c.cell // third * (third // 4)
            n, key = out.get(at, (0, 0))
            out[at] = (n + c.n, key ^ c.key)
        return {k: v for k, v in out.items() if v != (0, 0)}

    assert folded(r.a768, 256) == plain(r.a192) and folded(r.a192, 64) == plain(r.a48)
    a, b = plain(r.a192), plain(r.b192)
    both = {k: (a.get(k, (0, 0))[0] - b.get(k, (0, 0))[0], a.get(k, (0, 0))[1] ^ b.get(k, (0, 0))[1]) for k in a | b}
    assert {k: v for k, v in both.items() if v != (0, 0)} == plain(r.d)
    assert not r.p.cells and sorted(r.p.plus) == r.a and not r.p.minus
    assert r.s == "90:768:[" + ",".join(f"{{{c.cell},{c.n},{c.key}}}" for c in r.a768) + "]"


def slow_likeness(a, b):
    """Jaccard likeness of the multisets of sentences and lines, by plain sets."""
    def parts(t):
        out = set()
        for p in re.split(r"(?<=[.!?])[ \t\r\f\x0b\n]+|\n", t):
            if p.strip(" "):
                k = 1
                while (p.strip(" "), k) in out:
                    k += 1
                out.add((p.strip(" "), k))
        return out

    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_query_matches_plain_sets(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcé") for _ in range(2))
    text = lambda: "".join(r.choice([f"{word()} {word()}. ", f"{word()}! ", f"{word()}\n", "aa?  ", "\n"]) for _ in range(r.choice([0, 1, 5, 40, 200])))
    rows = [(i, text()) for i in range(80)] + [(None, "x. y."), (500, None), (501, "no end"), (502, "no end.")]
    rows[10:13] = [(10, rows[9][1]), (11, rows[9][1] + "more."), (12, rows[9][1][:-3])]
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = {x.doc_id: x for x in op.fingerprints(frame(spark, rows)).collect()}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        ed = t[: len(t) - half] + nxt[:half]
        assert abs(out[d].near_next - slow_likeness(t, nxt)) < 1e-9 and abs(out[d].near_edited - slow_likeness(t, ed)) < 1e-9, d
    assert out[501].fingerprint != out[502].fingerprint


def test_sketch_matches_plain_cells(spark):
    text = "one two.\nthree\n\nthree\nfour! five? six"
    row = spark.createDataFrame([(text,)], "t string").select(op.elements(F.col("t")).alias("k")).select("k", op.sketch(F.col("k")).alias("s")).first()
    assert len(row.k) == 6 and sum(c.n for c in row.s) == 18
    xor = 0
    for c in row.s:
        xor ^= c.key
    want = 0
    for k in row.k:
        want ^= k  # thrice
    assert xor == want


def test_fingerprints(spark):
    base = [f"Sentence number {i} of the text." for i in range(30)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, "Nothing. In common. Here."), (4, ""), (5, None), (6, "x\n" * 5000), (7, "\n".join(f"line {i}" for i in range(3000)))]
    out = {r.doc_id: r for r in op.fingerprints(frame(spark, rows)).collect()}
    assert out[1].fingerprint == out[2].fingerprint != out[3].fingerprint and out[4].fingerprint == out[5].fingerprint
    assert out[1].near_next == 0.0 and out[2].near_next == 1.0 and out[3].near_next == 0.0
    assert 0.25 < out[2].near_edited < 0.4  # half of the sentences, twice
    assert out[5].near_next == 1.0 and out[5].n_chars == 0 and out[6].near_edited == 0.5
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())


def test_edges(spark):
    assert op.fingerprints(frame(spark, [])).collect() == []
    one = op.fingerprints(frame(spark, [(5, "abc. def")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abc.abc.").hexdigest() and one[0].near_next == 1.0
    twice = op.fingerprints(frame(spark, [(5, "abc. def"), (5, "abc. def"), (None, None), (None, "z")])).collect()
    assert len(twice) == 4


def test_elements_of_a_document_are_taken_once(spark):
    df = spark.createDataFrame([(i, f"One {i}. Two. Three {i % 3}.\nFour. Two.") for i in range(9)] + [(4, "again. again."), (None, None)], "doc_id long, text string")
    plan = op.fingerprints(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # its own and the edited text's; the next one's come along
    rows = op.with_next(df, 3, {"a": op.elements(op.F.col("text"))}).select("a", "next_a", op.elements(op.F.col("text")).alias("t"), op.elements(op.F.col("next_text")).alias("n")).collect()
    assert len(rows) == 11 and all(r.a == r.t and r.next_a == r.n for r in rows)
    none = op.with_next(df.limit(0), None, {"a": op.elements(op.F.col("text"))})
    assert none.columns == ["doc_id", "text", "a", "next_text", "next_a"] and none.collect() == []
