import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from scorewright.llm import best_fit_packing as op

SCHEMA = "doc_id long, text string, offset string"
TEXTS = [
    "Hello  World's 123 café É́ x",
    "<|endoftext|> a<|startoftext|>b\x1cc d ΣΑΣ",
    None,
    "",
    "   \n ",
    "word " * 9000,
    "日本語 テキスト, don't we'll!!! __ $$$%%% 😀",
    "a" * 500,
    " ".join(chr(c) + "x" + chr(c) for c in range(0xC0, 0x180)) + " Ñandú, ÉCOLE. straße ÿ İx I\u0307x",
    "word. Word, wOrd. word.. word, 1. 1, é. ., , . It's we'll a'b x_y_ z### é%%% e\u0301. e\u0301 <|x|> Word's... ¡no! ª º Ö. µ.",
]


def test_ids_are_the_tokenizers(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(op.VOCABULARY))
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    out = op.pack(spark.createDataFrame(rows, SCHEMA).coalesce(2)).collect()
    by = defaultdict(dict)
    for r in out:
        by[r.doc_id][r.piece] = r
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert len(by[i]) == -(-len(ids) // 4096)
        for k, r in by[i].items():
            part = ids[k * 4096 : (k + 1) * 4096]
            assert (r.start, r.length, r.ids_crc32) == (k * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))


def test_memo_generations():
    """Ids stay the same when the memo overflows again and again."""
    path = public_tokenizers.path(op.VOCABULARY)
    tok, encode = Tokenizer.from_file(path), op.Encoder(path)
    most, op.MEMO = op.MEMO, 20
    try:
        r = np.random.default_rng(1)
        for _ in range(30):
            texts = [" ".join(r.choice(["Ab", "cd,", "é.", "xyz", "Q!", "zzz9"]) * int(k) for k in r.integers(1, 9, 40)) for _ in range(5)]
            for t, raw in zip(texts, map(encode, texts), strict=True):
                assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids + [1]
    finally:
        op.MEMO = most


def check_layout(out):
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    return len(seqs)


def test_layout_and_few_sequences(spark):
    rows = [(i, "the cat sat " * (1 + i * 37 % 700), "x") for i in range(800)]
    out = op.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert check_layout(out) <= 1.03 * sum(r.length for r in out) / 4096 + 1


def test_bounded_bins_match_brute_force():
    r, packer, closed, bins = np.random.default_rng(0), op.Packer(100, 4, 0), set(), {}
    for n in r.integers(1, 101, 3000).tolist():
        seq, offset = packer.add(n)
        fit = [f for s, f in bins.items() if s not in closed and f >= n]
        if fit:
            assert bins[seq] == min(fit)
        else:
            assert seq not in bins
            live = {s: f for s, f in bins.items() if s not in closed and f > 0}
            if len(live) >= 4 and n < 100:
                fullest = min(live.values())
                gone = [s for s in live if live[s] == fullest and s not in {x for v in packer.by_free.values() for x in v}]
                assert len(gone) == 1
                closed.add(gone[0])
            bins[seq] = 100
        assert offset == 100 - bins[seq]
        bins[seq] -= n


def test_edges(spark):
    assert op.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a", "x"), (2**60 + 1, "a", None), (2**60 + 1, "a", None), (5, None, None)]
    out = op.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(["None", str(2**60 + 1), str(2**60 + 1), "5"])
    check_layout(out)
