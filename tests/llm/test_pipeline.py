"""The five stages on a small corpus against brute-force versions of each on what the stage before kept."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from scorewright.llm import toxicity

from .test_decontamination import words as item_words
from .test_pii import base
from .test_simhash_dedup import brute as components

BAD = ["grobian", "vermaledeit", "lump"]
WORD = re.compile(r"(?<![^\W_])[^\W\d_]{4,}(?!\d)")


def corpus():
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    passage = " ".join(r.choice(vocab) for _ in range(30))
    for i in range(700):
        w = [r.choice(vocab) for _ in range(r.randint(20, 90))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        elif i % 23 == 0:
            w += passage.split()[5:17] + w[:3]
        elif i % 19 == 0:
            w[4:4] = [f"Quetzal{'abc'[i % 3]}", f"joe{i % 4}@mail.example"]
        docs.append((i, " ".join(w)))
        if i % 6:
            labels.append((i, int(toxic)))
    for i in range(60):  # exact and near copies
        d, t = docs[i * 7]
        docs.append((1000 + i, t if i % 2 else t.title() + " "))
    return docs + [(2000, None), (2001, ""), (2002, passage)], labels, [(1, passage), (2, "")]


def sanitised(rows):
    """Base spans masked; terms that disclose an entity generalised or, if nothing else has them, removed; in all texts."""
    spans = {d: base(t) for d, t in rows}
    outside = {d: [(m[0], m.start(), m.end()) for m in WORD.finditer(t or "") if not any(m.start() < e and m.end() > s for _, s, e, _ in spans[d])] for d, t in rows}
    tf, ef, joint, n = Counter(), Counter(), Counter(), len(rows)
    for d, t in rows:
        tf.update({m[0].lower() for m in WORD.finditer(t or "")})
        who = {(k, v.lower()) for k, _, _, v in spans[d]}
        ef.update(who)
        joint.update((e, w) for e in who for w in {x[0].lower() for x in outside[d]})
    share = defaultdict(float)
    for (e, w), j in joint.items():
        rate = ef[e] / n
        if math.log2((j + rate) / (tf[w] + 1) / rate) / -math.log2(rate) >= 0.9:
            share[w] = max(share[w], 1.0 if j == tf[w] else math.log2(j / tf[w] / rate) / -math.log2(rate))
    out = {}
    for d, t in rows:
        cuts = [(s, e, f"<{k.upper()}>") for k, s, e, _ in spans[d]]
        shape = lambda x: re.sub("[^X]", "x", re.sub(r"[A-ZÀ-ÖØ-Þ]", "X", x))
        cuts += [(s, e, "" if share[x.lower()] >= 1 else shape(x)) for x, s, e in outside[d] if x.lower() in share]
        for s, e, to in sorted(cuts, reverse=True):
            t = t[:s] + to + t[e:]
        out[d] = t
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, items = corpus()
    path = str(tmp_path_factory.mktemp("pipeline"))
    full = [(d, t, "en" if d % 2 else None, f"s{d % 5}", len(t or "")) for d, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_brute_force(spark, folder):
    docs, labels, items = corpus()
    table = spark.read.parquet(f"{folder}/documents.parquet")
    text, kept, now = dict(docs), [d for d, _ in docs], table
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_dedup", "decontamination", "pii", "best_fit_packing"]

    def step(name):
        out = corpus_pipeline.materialise(stages[name](spark, now, folder), name)
        assert name == "best_fit_packing" or out.columns == table.columns
        return out

    now = step("toxicity")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(table, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    kept = [d for d in kept if scores[d] < 0.5]
    assert sorted(r.doc_id for r in now.collect()) == sorted(kept)
    bad = {d for d, t in docs if t and any(x in t.lower().split() for x in BAD)}
    assert len(bad - set(kept)) >= 0.95 * len(bad) and len(set(kept) - bad) >= 0.95 * (len(docs) - len(bad))

    now = step("simhash_dedup")
    kept = [d for d, _, c in components([(d, text[d]) for d in kept]) if c == d]
    assert sorted(r.doc_id for r in now.collect()) == kept

    now = step("decontamination")
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [item_words(t)] for i in range(len(w) - 9)}
    hit = {d for d in kept for w in [item_words(text[d])] if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))}
    kept = [d for d in kept if d not in hit]
    assert hit and sorted(r.doc_id for r in now.collect()) == kept

    now = step("pii")
    want = sanitised([(d, text[d]) for d in kept])
    got = {r.doc_id: r for r in now.collect()}
    assert {d: r.text for d, r in got.items()} == want and any(want[d] != text[d] for d in kept)
    assert all(r.n_chars == len(r.text or "") for r in got.values())

    now = step("best_fit_packing")
    check_packed(now.collect(), want)


def check_packed(pieces, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    by_doc, by_sequence = defaultdict(int), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id] += p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert dict(by_doc) == {d: len(encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_run(spark, folder):
    """run() applies the stages one after the other: nobody that a stage rejects comes back."""
    out = corpus_pipeline.run(spark, folder).collect()
    ids = {p.doc_id for p in out}
    assert 2000 in ids and 2002 not in ids and len(ids) < 700 and corpus_pipeline.ORACLE_SQL is None
