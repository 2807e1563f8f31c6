import hashlib
import math
import re
from collections import Counter, defaultdict

from scorewright.llm import pii as op

SCHEMA = "doc_id long, text string, th string, n_chars long"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def brute(rows):
    """Base spans and the method's spans of each row, by plain loops."""
    word = re.compile(r"(?<![^\W_])[^\W\d_]{4,}(?!\d)")
    spans = [base(t) for _, t in rows]
    joint, tf, ef, around = Counter(), Counter(), Counter(), []
    for (_, t), found in zip(rows, spans, strict=True):
        t, own, seen = t or "", [], set()
        tf.update({m[0].lower() for m in word.finditer(t)})
        for kind, s, e, v in found:
            who = kind + ":" + (re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower())
            seen.add(who)
            for m in word.finditer(t):
                if m.start() >= s - 48 and m.end() <= e + 48 and not any(m.start() < y and m.end() > x for _, x, y, _ in found):
                    own.append((who, m[0].lower(), m.start(), m.end()))
        joint.update({x[:2] for x in own})
        ef.update(seen)
        around.append(own)
    n = len(rows)
    share = {k: (math.log2(j / tf[k[1]]) - math.log2(ef[k[0]] / n)) / -math.log2(ef[k[0]] / n) for k, j in joint.items() if j >= 3 and ef[k[0]] < n}
    return spans, [sorted({x[2:] for x in own if share.get(x[:2], 0) >= 0.9}) for own in around]


ROWS = [
    "mail a.b+c@x-y.co.uk, then q@w.e_r@t.y..z@m.n and a@@b.c a@b no@tld é😀 z@9.8.7.6",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255 99999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111--4111 1111 1111 1111 5",
    "+1 (555) 123-4567. +44 20 7946 0958 +1-2 +123456789012345678 ++49 89 1234567",
    None,
    "",
    "x" * 60_000 + "@" + "y" * 10,
    "1" * 30_000 + " " + "1-" * 15_000 + "+" + "1 " * 20_000,
    "a@b" + ".c" * 20_000,
    "+1 555 000 1234 " * 700,
]


def test_base_spans(spark):
    rows = list(enumerate(ROWS))
    out = {r.doc_id: r for r in op.spans(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    for i, t in rows:
        want = [f"{k}:{s}:{e}" for k, s, e, _ in base(t)]
        got = [x for x in out[i].spans.split(",") if x and not x.startswith("term")]
        assert got == want, i
        assert out[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        count = Counter(x.split(":")[0] for x in want)
        assert [out[i][f"n_{k}"] for k in op.KINDS] == [count[k] for k in op.KINDS]


def corpus():
    rows = [(i, f"ordinary words number {'abcdefgh'[i % 8] * 5} without anything private here") for i in range(60)]
    for i in range(100, 108):
        rows.append((i, f"The famous Zanzibar {'abcdefgh'[i % 8] * 5} explorer writes from Joe.Doe@mail.example about ordinary words"))
    rows += [(200, "Zanzibar is an island"), (201, "call +49 89 1234567 now"), (202, None)]
    return rows + [rows[62], (None, rows[63][1])]


def test_terms_match_brute_force(spark):
    rows = corpus()
    found, terms = brute(rows)
    want = sorted((str(d), ",".join([f"{k}:{s}:{e}" for k, s, e, _ in b] + [f"term:{s}:{e}" for s, e in t])) for (d, _), b, t in zip(rows, found, terms, strict=True))
    out = op.spans(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.spans) for r in out) == want
    assert any("term" in s for _, s in want)


def test_sanitise(spark):
    df = spark.createDataFrame([(*r, "x", len(r[1] or "")) for r in corpus()], SCHEMA)
    out = defaultdict(list)
    for r in op.sanitise(df).collect():
        out[r.doc_id].append(r)
    assert op.sanitise(df).columns == df.columns and sum(map(len, out.values())) == len(corpus())
    assert "@" not in out[100][0].text and "<EMAIL>" in out[100][0].text and "explorer" not in out[100][0].text
    assert out[100][0].n_chars == len(out[100][0].text)
    assert out[200][0].text == "Zanzibar is an island" and out[202][0].text is None
    assert out[201][0].text == "call <PHONE> now"
    assert len(out[102]) == 2 and len(out[None]) == 1 and "<EMAIL>" in out[None][0].text
    for i in range(60):
        assert out[i][0].text == corpus()[i][1]


def test_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "z@9.8.7.6 +4111 1111 1111 1111 end", "x", 0)], SCHEMA)
    text = op.sanitise(df).first().text
    assert not re.search("[0-9]", text) and text.endswith(" end")


def test_empty(spark):
    assert op.spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_terms_far_from_mentions(spark):
    filler = "plain filler text " * 40
    rows = [(i, f"Quetzal {filler} mail joe@mail.example {filler} Axolotl {i}") for i in range(5)] + [(i, filler) for i in range(10, 60)]
    out = {r.doc_id: r.spans for r in op.spans(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    for i, t in rows[:5]:
        want = [f"term:{t.index(w)}:{t.index(w) + 7}" for w in ("Quetzal", "Axolotl")]
        assert set(want) <= set(out[i].split(",")), i
    assert all(out[i] == "" for i, _ in rows[5:])


def test_words_outside_base_spans(spark):
    texts = ["éééé.word@mail.example-éabcd éeeabcd@mail.example", "abcd+49 89 1234567efgh (word) z@9.8.7.6ijkl mnop", "😀word a@b.c 4111 1111 1111 1111 1.2.3.4 ünïcode"]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    for r in op.detect(rows).collect():
        t = texts[r.doc_id]
        found = base(t)
        free = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"(?<![^\W_])[^\W\d_]{4,}(?!\d)", t) if not any(m.start() < e and m.end() > s for _, s, e, _ in found)]
        assert [tuple(w) for w in r.words] == free, t


def test_disclosed_terms_in_all_documents(spark):
    rows = [(i, f"Quetzal writes Quetzal from joe@mail.example {'plain filler ' * 40} Quetzal") for i in range(12)]
    rows += [(50, "the Quetzal flies, a quetzal"), (51, "Quetzals fly"), (None, None), (52, "the Quetzal flies, a quetzal")] + [(i, "plain filler words") for i in range(100, 400)]
    df = spark.createDataFrame([(*r, "x", len(r[1] or "")) for r in rows], SCHEMA)
    out = {r.doc_id: r for r in op.spans(df, everywhere=True).collect()}
    assert [out[i].spans for i in (50, 52)] == ["term:4:11,term:21:28"] * 2
    assert {f"term:{m.start()}:{m.end()}" for m in re.finditer("Quetzal", rows[0][1])} <= set(out[0].spans.split(","))
    assert all(out[i].spans == "" for i in (51, None, 100))
    clean = {r.doc_id: r.text for r in op.sanitise(df, everywhere=True).collect()}
    assert clean[50] == clean[52] == "the Xxxxxxx flies, a xxxxxxx" and clean[51] == "Quetzals fly" and clean[None] is None
    assert all("Quetzal" not in clean[i] and "<EMAIL>" in clean[i] for i in range(12))


def test_plans_agree(spark, monkeypatch):
    """Terms sent to all tasks or joined by a shuffle, compared one by one or joined: the same spans."""
    rows = [(i, "Quetzal writes Axolotl from joe@mail.example plain filler") for i in range(12)]
    rows += [(50, "the Quetzal flies, a quetzal and an Axolotl"), (51, "Quetzals fly")] + [(i, "plain filler words") for i in range(100, 400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = sorted(map(tuple, op.spans(df, everywhere=True).collect()))
    monkeypatch.setattr(op, "MOST_BROADCAST", -1)
    monkeypatch.setattr(op, "FEW", 0)
    assert sorted(map(tuple, op.spans(df, everywhere=True).collect())) == want
    assert next(r[6] for r in want if r[0] == 50) == "term:4:11,term:21:28,term:36:43"


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a joe@mail.example", "x", 18), (None, None, "y", 0)], SCHEMA)
    df = df.selectExpr("*", "1 as x_id", "2 as x_th", "3 as x_cuts", "4 as d_text", "5 as terms", "6 as base")
    out = op.sanitise(df, everywhere=True)
    assert out.columns == df.columns and sorted((str(r.doc_id), r.text, r.x_cuts) for r in out.collect()) == [("1", "a <EMAIL>", 3), ("None", None, 3)]


def test_terms_of_rare_entities(spark):
    rows = [(0, "Axolotl keeper joe@mail.example plain words"), (1, "Quetzal ann@mail.example plain words"), (2, "Quetzal ann@mail.example"), (3, "Quetzal plain"), (4, "a Quetzal")]
    rows += [(i, "keeper of plain words") for i in range(10, 3000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = {r.doc_id: r.spans for r in op.spans(df).collect()}
    n = len(rows)
    for joint, tf, ef, word in [(1, 1, 1, "Axolotl"), (2, 4, 2, "Quetzal")]:
        share = math.log2((joint + ef / n) / (tf + 1) / (ef / n)) / -math.log2(ef / n)
        assert (share >= 0.9) == (word == "Axolotl")
    assert out[0] == "email:15:31,term:0:7"
    assert [out[i] for i in (1, 2, 3, 4, 10)] == ["email:8:24", "email:8:24", "", "", ""]


def test_words_elsewhere_are_found_once(spark):
    df = spark.createDataFrame([(1, "the Quetzal flies, a quetzal", "x", 1), (2, "Quetzals fly", "x", 1)], SCHEMA)
    texts = spark.createDataFrame([], "th long")
    for small in (False, True):
        out = op._elsewhere(df, texts, spark.createDataFrame([("quetzal",)], "term string"), small)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1
        assert sorted((r.term, r.start, r.end) for r in out.collect()) == [("quetzal", 4, 11), ("quetzal", 21, 28)]


def test_matches_kept(spark):
    text = " ".join(f"word{'abcdefgh'[i % 8] * 3}" if i % 5 else "Keep" for i in range(1000))
    df = spark.createDataFrame([(text,)], "t string")
    want = [("keep", m.start(), m.end()) for m in re.finditer("Keep", text)]
    assert [tuple(w) for w in df.select(op._words(op.F.col("t"), lambda v: op.F.lower(v) == "keep").alias("w")).first().w] == want
