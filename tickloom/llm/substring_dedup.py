"""Substring dedup by level-wise doubling of word windows.

All windows of a short base length are compared first.  A window that occurs
only once in the corpus can't be part of a longer repeat, so the windows of
twice the length whose two halves are both repeated are the only ones looked at
next, and so on until the asked length is reached or no window survives.  The
levels before the last exchange 32-bit keys, whose false matches only cost a
look at the next level; the last one compares 96 bits and the document ids, and
tells each pack which of its windows start earlier elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as c

#: Bytes that part words: [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

class PackWords:
    """Words of a pack's texts, end to end, and hashes of runs of them that stay in one document."""

    def __init__(self, texts: list[bytes]):
        lens = np.array([len(t) + 1 for t in texts], np.int64)
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inner = ~_SPACE[self.buf]
        edge = np.diff(np.r_[False, inner, False].astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(np.cumsum(lens), self.start, side="right")
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        self.n = len(self.start)

    def hashes(self, seed: int, base: int) -> np.ndarray:
        """One 64-bit hash for each word."""
        return c.run_hashes(seed, base, self.buf, self.start, self.end)

    def windows(self, words: np.ndarray, size: int, base: int) -> np.ndarray:
        """Hash of the size words from each word on; meaningless where inside() is false."""
        m = self.n - size + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        roll = c.rolling(base, self.n)
        at = np.arange(m)
        return c.mix(roll.runs(roll.prefix(words), at, at + size))

    def inside(self, size: int) -> np.ndarray:
        m = self.n - size + 1
        return self.doc[:m] == self.doc[size - 1 :] if m > 0 else np.zeros(0, bool)


_WORD, _WINDOW = ((11, 0x9E3779B97F4A7C15), (12, 0xD1342543DE82EF95)), (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _levels(window: int, base: int) -> list[int]:
    """Lengths from the base on, each twice the one before; the last one is the window."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= base:
        out.insert(0, out[0] // 2)
    return out


class _Pack:
    """What a pack knows at each level; made anew in every pass from its text and the replies."""

    def __init__(self, texts: list[bytes], levels: list[int], bits: int, replies: list):
        self.words = PackWords(texts)
        self.hash = self.words.hashes(*_WORD[0])
        self.repeated = None
        for size, reply in zip(levels, replies, strict=False):
            keys, alive, inverse = self.entries(size, self.repeated)
            counts = np.bincount(inverse, minlength=len(keys))
            again = (counts > 1) | c.join_masks(reply)
            out = np.zeros(len(alive), bool)
            out[alive] = again[inverse]
            self.repeated = out

    def entries(self, size: int, halves: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the candidate windows, which windows are candidates, and the key of each."""
        alive = self.words.inside(size)
        m = len(alive)
        if halves is not None and m:
            h = size // 2
            alive = alive & halves[:m] & halves[h : h + m]
        keys, inverse = np.unique(self.words.windows(self.hash, size, _WINDOW[0])[alive], return_inverse=True)
        return keys, alive, inverse

    def second(self, size: int, alive: np.ndarray) -> np.ndarray:
        words = self.words.hashes(*_WORD[1])
        return (self.words.windows(words, size, _WINDOW[1])[alive] >> np.uint64(32)).astype(np.uint32)


def _last_level(pack: _Pack, size: int) -> tuple:
    """Distinct 96-bit keys in order, the candidates, the key of each and the first window of each key."""
    alive = pack.entries(size, pack.repeated)[1]
    hi = pack.words.windows(pack.hash, size, _WINDOW[0])[alive]
    lo = pack.second(size, alive)
    order = np.lexsort((np.arange(len(hi)), lo, hi))
    new = np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])] if len(hi) else np.zeros(0, bool)
    inverse = np.empty(len(hi), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return hi[order][new], lo[order][new], alive, inverse, order[new]


def repeated_words(spark: SparkSession, docs: DataFrame, window: int = 20, base: int = 5) -> tuple[DataFrame, dict[str, DataFrame], dict]:
    """Packs, the replies of each level, and what is needed to read them (levels, bits)."""
    ws = c.Workspace(spark)
    packs = c.pack_documents(ws, docs)
    n_words = packs.agg(F.sum("n_words")).first()[0] or 0
    bits, levels = c.bucket_bits(n_words), _levels(window, base)
    replies: dict[str, DataFrame] = {}
    for k, size in enumerate(levels):
        last = k == len(levels) - 1

        def send(batches: Iterator[pa.RecordBatch], k=k, size=size, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    table = c.open_pack(row["pack"])
                    pack = _Pack(c.texts_of(table), levels[:k], bits, [row[f"level_{x}"] for x in levels[:k]])
                    if last:
                        keys, low, alive, _, first = _last_level(pack, size)
                        ids = c.ids_of(table)[pack.words.doc[: len(alive)][alive][first]]
                    else:
                        keys = pack.entries(size, pack.repeated)[0]
                    tops, at = c.split_sorted(keys, bits)
                    if last:
                        blobs = [c.write_ranked(keys[i:j], low[i:j], ids[i:j]) for i, j in zip(at, at[1:], strict=False)]
                    else:
                        short = c.short_keys(keys, bits)
                        blobs = [short[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(tops, pa.int64()), pa.array([row["pack_id"]] * len(tops), pa.int64()), pa.array(blobs, pa.binary())], schema=c.ENTRY_ARROW)

        entries = c.with_replies(packs, {f"level_{x}": replies[f"level_{x}"] for x in levels[:k]}).mapInArrow(c.tidied(send), c.ENTRY_SCHEMA)
        found = c.earlier_elsewhere(entries) if last else c.seen_elsewhere(entries)
        replies[f"level_{size}"] = ws.table(found, f"level_{size}")
        if not last and replies[f"level_{size}"].isEmpty():
            # nothing of this length anywhere, so nothing longer either
            for x in levels[k + 1 :]:
                replies[f"level_{x}"] = replies[f"level_{size}"]
            break
    return packs, replies, {"levels": levels, "bits": bits}


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def substring_dedup(spark: SparkSession, docs: DataFrame, window: int = 20, base: int = 5, with_text: bool = True) -> DataFrame:
    """Each document without the words that a window repeated from earlier covers.

    docs needs doc_id and text; other columns are left out, whatever their names.
    Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r.  A word goes
    if it is covered by `window` consecutive words of its document whose sequence
    also starts earlier: in a document of smaller doc_id, or earlier in its own.

    Null text counts as empty: no words, the digest of the empty string.  A null
    doc_id stands after all others.  Rows that share a doc_id are separate
    documents, taken in the order of their packs.  Texts shorter than the window
    are kept whole.  An empty table gives no rows.  `window` is halved while even
    and at least 2 * base, so 20 with base 5 goes by 5, 10 and 20.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text (the
    kept words, joined by one space).
    """
    packs, replies, about = repeated_words(spark, docs, window, base)
    levels, bits = about["levels"], about["bits"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = c.open_pack(row["pack"])
                texts = c.texts_of(table)
                pack = _Pack(texts, levels[:-1], bits, [row[f"level_{x}"] for x in levels[:-1]])
                keys, _, alive, inverse, first = _last_level(pack, window)
                later = c.join_masks(row[f"level_{window}"])
                later = later if len(later) else np.zeros(len(keys), bool)
                remove = np.ones(len(inverse), bool)
                remove[first] = later
                step = np.zeros(pack.words.n + 1, np.int32)
                hit = np.flatnonzero(alive)[remove]
                np.add.at(step, hit, 1)
                np.add.at(step, hit + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                n_removed = np.bincount(pack.words.doc[gone], minlength=len(texts))
                ends = np.cumsum(pack.words.n_words)
                kept = []
                for k, text in enumerate(texts):
                    words = text.split()
                    if n_removed[k]:
                        words = [w for w, out in zip(words, gone[ends[k] - len(words) : ends[k]].tolist(), strict=True) if not out]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(pack.words.n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode() for x in kept] if with_text else [None] * len(kept), pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = c.with_replies(packs, replies).mapInArrow(c.tidied(cut), RESULT)
    return out if with_text else out.drop("kept_text")
