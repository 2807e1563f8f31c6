"""Best-fit packing of whole documents into training sequences.

Bounded-space online best-fit: each task has a fixed number of open bins. A bitset has bit f set
while some open bin has f free tokens, so the tightest bin that takes a piece is the lowest set bit
at or above its length. When all bins are open and none fits, the fullest closes first. Only
documents longer than a sequence are cut. A task packs the documents of its input split in their
order, with nothing shuffled, so a task that is run again gives the same sequences.

Null and empty texts have one token, the end mark. Repeated rows are packed as often as they come.
Null ids stay null. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches, table

CAPACITY = 4096
OPEN_BINS = 512
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Space that every part of the tokenizer takes as space; it never has a token across it.
SPACE = re.compile("[ \t\n\r]+")
#: What only Python takes as space.
ODD = re.compile("[\x1c-\x1f]")
#: Words that normalising leaves alone but for the first letter's case, and that are one piece before the
#: merges, so that they go straight to the model; then marks, which are a piece of their own.
PLAIN = re.compile(r"([A-Z]?)([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Bytes of such words that aren't printable, as the byte-level alphabet spells them: in order from U+0100.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}
#: Entries of each of a worker's two memos of space-delimited chunks, and the longest chunk they hold.
MEMO, MEMO_CHARS = 300_000, 40

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Memo(dict):
    """Ids of chunks between spaces, as little-endian unsigned 32-bit numbers; a missing chunk is encoded.

    A chunk has the same ids alone as in the text, and so have a word and the marks at its end.
    """

    def __init__(self, tokenizer, old: dict):
        super().__init__()
        self.encode, self.tokenize, self.old, self.marks = tokenizer.encode, tokenizer.model.tokenize, old, {"": b""}

    def plainly(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            parts = PLAIN.fullmatch(chunk)
            if parts is None:
                ids = self.plainly(chunk)
            else:
                first, rest, tail = parts.groups()
                word = first.lower() + rest if first else rest
                ids = None if word == chunk else self.get(word)
                if ids is None:
                    spelt = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
                    ids = array("I", [t.id for t in self.tokenize(spelt)]).tobytes()
                    if len(word) <= MEMO_CHARS:
                        self[word] = ids
                if tail:
                    marks = self.marks.get(tail)
                    if marks is None:
                        marks = self.plainly(tail)
                        if len(tail) <= 3:
                            self.marks[tail] = marks
                    ids += marks
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of whole texts. The memo has two generations, so that frequent chunks outlive a full one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(self.tokenizer, {})

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if len(self.memo) > MEMO:
            self.memo.old = {}
            self.memo = Memo(self.tokenizer, dict(self.memo))
        chunks = SPACE.split(text.strip(" \t\n\r")) if ODD.search(text) else text.split()
        return b"".join(map(self.memo.__getitem__, chunks)) + END.to_bytes(4, "little")


class Packer:
    """Open bins by their free space."""

    def __init__(self, capacity: int, open_bins: int, first: int):
        self.capacity, self.most, self.next = capacity, open_bins, first
        self.bits, self.open, self.by_free = 0, 0, {}

    def _put(self, free: int, seq: int) -> None:
        self.bits |= 1 << free
        self.by_free.setdefault(free, []).append(seq)
        self.open += 1

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        seq = bins.pop()
        self.open -= 1
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return seq

    def add(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of at most ``capacity`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            seq = self._take(free)
        else:
            if self.open >= self.most and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, seq, self.next = self.capacity, self.next, self.next + 1
        if free > length:
            self._put(free - length, seq)
        return seq, self.capacity - free


def placed(batch: pd.DataFrame, encode: Encoder, packer: Packer, capacity: int) -> pd.DataFrame:
    rows: list[tuple] = []
    for doc_id, ids in zip(batch["doc_id"], map(encode, batch["text"]), strict=True):
        own = None if doc_id is None or doc_id != doc_id else int(doc_id)  # text: pandas makes longs with nulls floats
        for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[start : start + 4 * capacity]
            seq, offset = packer.add(len(part) // 4)
            rows.append((own, piece, start // 4, len(part) // 4, zlib.crc32(part), seq, offset))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="Int64") for i, n in enumerate(names)})


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece of each document of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        import public_tokenizers
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        packer = Packer(capacity, open_bins, TaskContext.get().partitionId() << 36)
        collects = gc.isenabled()
        gc.disable()  # the memos are large and hold no cycles
        try:
            for batch in batches:
                yield placed(batch, encode, packer, capacity)
        finally:  # the worker goes on to other tasks
            if collects:
                gc.enable()

    return docs.select(docs["doc_id"].cast("string").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInPandas(run, SCHEMA)


def query(spark, sf_dir):
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"))
