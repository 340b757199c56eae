"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A text is cut as the vocabulary's own pre-tokenizer does.  In each piece the
encoder takes the longest token that an Aho-Corasick automaton finds next; it
may stand beside the token before it only if merging would not have crossed the
border between the two, which a pair table tells.  If no token fits, the last
one is taken back and a shorter one tried; a position found hopeless is never
tried again, so the work stays linear in the piece.  The result is the token
sequence that applying the merges in order gives.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as c

#: Fixed value: how byte-level vocabularies of this kind cut texts before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids, and pairs whose fit, a worker remembers within a task; the memory is emptied when it is full.
REMEMBERED = 200_000
_NO_LIMIT = 1 << 62


def _byte_alphabet() -> dict[str, int]:
    """Character by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary, read from a tokenizer's JSON file; small, so it can be broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, to_byte = data["model"], _byte_alphabet()
        if model["type"] != "BPE" or (data["pre_tokenizer"] or {}).get("type") != "ByteLevel" or data["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        if data["pre_tokenizer"]["add_prefix_space"] or not data["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"{path} cuts texts in a way that isn't supported")
        raw = lambda token: bytes(to_byte[x] for x in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # ranks: single bytes first, then tokens in the order of their merges
        singles = sorted((raw(t) for t in model["vocab"] if len(t) == 1), key=lambda x: x[0])
        self.tokens: list[bytes] = list(singles)
        rank = {t: k for k, t in enumerate(self.tokens)}
        self.split: list[tuple[int, int]] = [(k, k) for k in range(len(singles))]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            a, b = rank[raw(left)], rank[raw(right)]
            token = self.tokens[a] + self.tokens[b]
            if token not in rank:
                rank[token] = len(self.tokens)
                self.tokens.append(token)
                self.split.append((a, b))
            self.merged.setdefault((a, b), rank[token])
        by_bytes = {raw(t): k for t, k in model["vocab"].items() if all(x in to_byte for x in t)}
        self.ids = [by_bytes[t] for t in self.tokens]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        # offset table for decoding, by id
        spelled = dict(zip(self.ids, self.tokens, strict=True)) | {k: t.encode() for t, k in self.special.items()}
        size = max(spelled) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(spelled.get(k, b"")) for k in range(size)])
        self.letters = np.frombuffer(b"".join(spelled.get(k, b"") for k in range(size)), np.uint8)


class Encoder:
    """What a worker builds from a vocabulary: the automaton, the prefix table and its memory of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.v = vocabulary
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        self.parts = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        self.machine = ahocorasick.Automaton()
        rank = {}
        for k, token in enumerate(vocabulary.tokens):
            rank[token] = k
            self.machine.add_word(token.decode("latin-1"), k)
        self.machine.make_automaton()
        self.length = [len(t) for t in vocabulary.tokens]
        self.shorter = [next((rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank), -1) for t in vocabulary.tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens side by side: no merge across the border comes first."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        split, merged, limit = self.v.split, self.v.merged, _NO_LIMIT
        while True:
            if (both := merged.get((left, right))) is not None and both < limit:
                out = False
                break
            # the part that was merged last comes apart first
            if left > right:
                limit, left = left, split[left][1]
                stuck = left == limit
                if stuck:
                    limit, right = right + 1, split[right][0]
                    stuck = right + 1 == limit
            else:
                limit, right = right + 1, split[right][0]
                stuck = right + 1 == limit
                if stuck:
                    limit, left = left, split[left][1]
                    stuck = left == limit
            if stuck:
                out = True
                break
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[key] = out
        return out

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers."""
        text = piece.encode().decode("latin-1")
        length, shorter, longest, n = self.length, self.shorter, self.machine.iter_long, len(text)
        tokens: list[int] = []
        hopeless: set[int] = set()
        pos, token = 0, next(longest(text))[1]
        while token >= 0:
            last = tokens[-1] if tokens else -1
            while True:
                end = pos + length[token]
                if end not in hopeless and (last < 0 or self.compatible(last, token)):
                    tokens.append(token)
                    pos = end
                    token = next(longest(text, end))[1] if end < n else -1
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                hopeless.add(pos)
                tokens.pop()
                pos -= length[last]
                token = last
                break
        ids = self.v.ids
        return array("I", [ids[t] for t in tokens]).tobytes()

    def forget(self) -> None:
        """Give back what was remembered; the worker may go on with other work."""
        self.known.clear()
        self.fits.clear()

    def plain(self, text: str) -> bytes:
        known, out = self.known, []
        for piece in self.pattern.findall(text):
            got = known.get(piece)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = self.piece(piece)
                if len(piece) <= 64:
                    known[piece] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.parts is None:
            return self.plain(text)
        special = self.v.special
        return b"".join(array("I", [special[x]]).tobytes() if x in special else self.plain(x) for x in self.parts.split(text) if x)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> bytes:
    """Bytes of a sequence of ids: one gather through the offset table."""
    start = vocabulary.offsets[ids]
    lens = vocabulary.offsets[ids + 1] - start
    ends = np.cumsum(lens)
    if not len(ids) or not ends[-1]:
        return b""
    return vocabulary.letters[np.arange(ends[-1]) + np.repeat(start - (ends - lens), lens)].tobytes()


_ENCODERS: dict[int, Encoder] = {}


def bpe_encode(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """Token ids of every whole text.

    docs needs doc_id and text; other columns are left out, whatever their names.
    Returns doc_id and ids, the ids as little-endian unsigned 32-bit integers, and if
    asked `decoded`, what bpe_decode() makes of them, without a second Python process.
    Special tokens of the vocabulary that occur in a text are their own ids; none
    is added.  Null and empty text give no ids; a null doc_id and repeated rows
    stay as they are; an empty table gives no rows.  Narrow: rows stay where they are.
    """
    c.ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    key = shared.id if hasattr(shared, "id") else id(shared)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        worker = _ENCODERS[key]
        for batch in c.bounded_batches(batches, c.text_sizes(1)):
            ids = [worker.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary())}
            if decoded:
                out["decoded"] = pa.array([_decoded(worker.v, x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])
        worker.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(c.tidied(encode), "doc_id long, ids binary" + ", decoded string" * decoded)


def _decoded(vocabulary: Vocabulary, ids: bytes) -> str:
    return decode_ids(vocabulary, np.frombuffer(ids, "<u4").astype(np.int64)).decode(errors="replace")


def bpe_id_lists(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids as array<int>, and the SHA-256 of the text that they decode to; cases as for bpe_encode().

    Numbers take a few bits each in Parquet and small pages, where binary ids would make large ones.
    """
    c.ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    key = shared.id if hasattr(shared, "id") else id(shared)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(shared.value)
        worker = _ENCODERS[key]
        for batch in c.bounded_batches(batches, c.text_sizes(1), 1 << 19):
            ids = [np.frombuffer(worker.encode(t) if t else b"", "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            sums = [hashlib.sha256(decode_ids(worker.v, x.astype(np.int64)).decode(errors="replace").encode()).hexdigest() for x in ids]
            ends = np.cumsum([0, *(len(x) for x in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(sums)], names=["doc_id", "n_tokens", "ids", "text_sha256"])
        worker.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(c.tidied(encode), "doc_id long, n_tokens long, ids array<int>, text_sha256 string")


def bpe_decode(spark: SparkSession, encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The texts that ids stand for: adds `decoded` to doc_id and ids.

    Special tokens are spelled out.  Bytes that aren't UTF-8 become U+FFFD, as
    they may for ids that no encoder made.  Null ids count as none.
    """
    c.ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in c.bounded_batches(batches, c.text_sizes(1)):
            texts = [_decoded(shared.value, x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(c.tidied(decode), "doc_id long, ids binary, decoded string")
