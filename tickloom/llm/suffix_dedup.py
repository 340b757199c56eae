"""Suffix-array dedup: repeated byte strings found by sorting suffixes in shards.

A string of LENGTH bytes can be repeated only if the anchors in it are: the GRAM
bytes of smallest and of largest hash that it holds.  Packs exchange the hashes of
their anchors, and only strings with both anchors repeated go on.  Runs of such
strings that share the smaller anchor are a piece; equal strings lie in pieces of
one anchor, at one distance from it, so pieces can be dealt to shards by its hash
and cut into symbols of 8 bytes counted from it.  Of equal pieces only the first
is sent.  A shard sorts the suffixes of these symbols by Lyndon grouping; suffixes
with CORE symbols in common, and the same bytes before and after, are equal strings.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as c
from .suffix_sort import suffix_array

LENGTH, GRAM, SYMBOL = 100, 32, 8
#: Whole symbols in any string of LENGTH bytes, however it stands to the anchor, and the bytes left over.
CORE = (LENGTH - SYMBOL + 1) // SYMBOL
REST = LENGTH - CORE * SYMBOL

_BASE, _SEED, _LARGEST = 0xCA5A826395121157, 31, np.uint64(0x8CB92BA72F3D8DD7)
_PIECE = ((32, 0x9FB21C651E98DF25), (33, 0xA24BAED4963EE407))
#: Bytes hashed at once, and the bits of a place among them.
_SPAN, _PLACE = 1 << 19, np.uint64(20)
#: Text bytes of the corpus for each shard, and the symbols that are sorted at once.
SHARD_BYTES, SORTED = 1 << 18, 1 << 16


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling."""
    out, size, base = c.byte_values(_SEED)[data], 1, _BASE
    while size < GRAM:
        out = out[:-size] * np.uint64(base) + out[size:]
        base = base * base % (1 << 64)
        size *= 2
    return _finish(out)


def _gram_hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The same, at some places only."""
    power = c.powers(_BASE, GRAM)[::-1]
    out = np.zeros(len(places), np.uint64)
    values = c.byte_values(_SEED)
    for k in range(GRAM):
        out += values[data[places + k]] * power[k]
    return _finish(out)


def _least_place(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, the first place of its least (to the bits that places leave)."""
    low = (values >> _PLACE << _PLACE) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    return (low & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)


class Span(NamedTuple):
    """Strings of a span by their starts; at `least_new` and `most_new` (among these) an anchor changes."""

    starts: np.ndarray
    least_new: np.ndarray
    least_place: np.ndarray
    least: np.ndarray
    most_new: np.ndarray
    most: np.ndarray


def _spans(data: np.ndarray, sizes: np.ndarray) -> Iterator[Span]:
    """All strings of LENGTH bytes that lie in one of the documents that data holds end to end."""
    inside = np.zeros(len(data), np.int8)
    ends = np.cumsum(sizes)
    long = sizes >= LENGTH
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, (ends - sizes)[long], 1)
    np.add.at(edge, (ends - LENGTH + 1)[long], -1)
    inside = np.cumsum(edge[:-1]) > 0
    width = LENGTH - GRAM + 1
    for at in range(0, len(data), _SPAN):
        part = data[at : at + _SPAN + LENGTH - 1]
        if len(part) < LENGTH:
            continue
        good = np.flatnonzero(inside[at : at + len(part) - LENGTH + 1])
        if not len(good):
            continue
        value = _gram_hashes(part)
        least, most = _least_place(value, width)[good], _least_place(~value, width)[good]
        change = lambda x: np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        a, b = change(least), change(most)
        yield Span(at + good, a, at + least[a], value[least[a]], b, value[most[b]] ^ _LARGEST)


def _pack_data(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    texts = c.texts_of(table)
    return texts, np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def _anchor_keys(spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes, and whether the pack has each at more than one place."""
    if not spans:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys = []
    last = -1
    for s in spans:
        # an anchor that spans two spans has its place in the first of them
        fresh = s.least_place != last
        keys += [s.least[fresh], s.most]
        last = int(s.least_place[-1])
    distinct, counts = np.unique(np.concatenate(keys), return_counts=True)
    return distinct, counts > 1


class Pieces(NamedTuple):
    """Runs of strings that start at start..start+count-1 and share the anchor at start+anchor."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray

    @classmethod
    def of(cls, spans: list[Span], keys: np.ndarray, repeated: np.ndarray) -> Pieces:
        out = [], [], []
        hit = lambda x: repeated[np.searchsorted(keys, x)]
        for s in spans:
            n = len(s.starts)
            run = lambda new: np.diff(np.r_[new, n])
            good = np.repeat(hit(s.least), run(s.least_new)) & np.repeat(hit(s.most), run(s.most_new))
            first = np.zeros(n, bool)
            first[s.least_new] = True
            first[1:] |= (np.diff(s.starts) != 1) | ~good[:-1]
            first &= good
            at = np.flatnonzero(first)
            which = np.cumsum(first)[good] - 1
            out[0].append(s.starts[at])
            out[1].append(np.bincount(which, minlength=len(at)))
            out[2].append(s.least_place[np.searchsorted(s.least_new, at, side="right") - 1] - s.starts[at])
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(*map(join, out))

    def dump(self) -> bytes:
        return len(self.start).to_bytes(8, "little") + c.squeeze(np.diff(self.start, prepend=0).tobytes() + self.count.astype(np.uint8).tobytes() + self.anchor.astype(np.uint8).tobytes())

    @classmethod
    def load(cls, raw: bytes) -> Pieces:
        n, rest = int.from_bytes(raw[:8], "little"), c.unsqueeze(raw[8:])
        return cls(np.cumsum(np.frombuffer(rest, np.int64, n)), np.frombuffer(rest, np.uint8, n, 8 * n).astype(np.int64), np.frombuffer(rest, np.uint8, n, 9 * n).astype(np.int64))

    def classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 96-bit hashes in order, the class of each piece and the first piece of each class."""
        end = self.start + self.count + LENGTH - 1
        found = [c.run_hashes(seed, base, data, self.start, end) for seed, base in _PIECE]
        hi, lo = found[0], (found[1] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((np.arange(len(hi)), lo, hi))
        new = np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])] if len(hi) else np.zeros(0, bool)
        inverse = np.empty(len(hi), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return hi[order][new], lo[order][new], inverse, order[new]


def _doc_ids(table: pa.Table, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return c.ids_of(table)[np.searchsorted(np.cumsum(sizes), places, side="right")]


def _holders(row: dict, pieces: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which pieces this pack speaks for, which are the first of their class, the holders in the
    order of their anchors' hashes, and these hashes."""
    raw = [x["mask"] for x in row["firsts"]]
    first = np.unpackbits(np.frombuffer(c.unsqueeze(raw[0]), np.uint8), count=len(pieces.start)).astype(bool) if raw else np.zeros(0, bool)
    hold = first.copy()
    at = np.flatnonzero(first)
    # replies stand by class, so firsts are told apart by the order of their classes
    order = np.frombuffer(c.unsqueeze(row["firsts"][1]["mask"]), np.int32)
    hold[at[order]] = ~c.join_masks(row["later"])
    held = np.flatnonzero(hold)
    key = _gram_hashes_at(data, pieces.start[held] + pieces.anchor[held])
    turn = np.argsort(key, kind="stable")
    return hold, first, held[turn], key[turn]


def _send_pieces(row: dict, bits: int) -> pa.RecordBatch:
    table = c.open_pack(row["pack"])
    _, data, sizes = _pack_data(table)
    pieces = Pieces.load(row["pieces"][0]["mask"])
    _, _, held, key = _holders(row, pieces, data)
    tops, at = c.split_sorted(key, bits)
    ids, blobs = _doc_ids(table, sizes, pieces.start[held]), []
    raw = data.tobytes()
    for i, j in zip(at, at[1:], strict=False):
        own = held[i:j]
        start, count = pieces.start[own], pieces.count[own]
        body = b"".join(raw[s:e] for s, e in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True))
        head = np.stack([ids[i:j], start, count, pieces.anchor[own]]).astype(np.int64).tobytes()
        blobs.append(len(own).to_bytes(8, "little") + key[i:j].tobytes() + c.squeeze(head + body))
    return pa.RecordBatch.from_arrays([pa.array(tops, pa.int64()), pa.array([row["pack_id"]] * len(tops), pa.int64()), pa.array(blobs, pa.binary())], schema=c.ENTRY_ARROW)


def _earlier_strings(doc: np.ndarray, pack: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each string of the pieces (of data from at on), whether an equal one starts earlier."""
    shift = anchor % SYMBOL  # bytes before the first symbol
    size = count + LENGTH - 1
    n_symbols = (size - shift) // SYMBOL
    # symbols of all pieces, each piece followed by a 0 that no symbol equals
    ends = np.cumsum(n_symbols + 1)
    piece_of = np.repeat(np.arange(len(start)), n_symbols)
    index = np.arange(len(piece_of)) - np.repeat(np.cumsum(n_symbols) - n_symbols, n_symbols)
    byte_at = (at + shift)[piece_of] + SYMBOL * index
    words = _eight(data, byte_at)
    text = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    text[(ends - n_symbols - 1)[piece_of] + index] = np.unique(words, return_inverse=True)[1] + 1
    order = np.array(suffix_array(text.tolist()), np.int64)
    padded = np.r_[text, np.zeros(CORE, np.int64)]
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(CORE):
        row = padded[order + k]
        same &= row[1:] == row[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.r_[0, np.cumsum(~same)] if len(order) else 0
    # strings: the symbols from the first whole one on, and REST bytes before and after them
    of = np.repeat(np.arange(len(start)), count)
    begin = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    before = (shift[of] - begin) % SYMBOL
    core = group[(ends - n_symbols - 1)[of] + (begin + before - shift[of]) // SYMBOL]
    byte = at[of] + begin
    left = _eight(data, byte) >> (8 * (SYMBOL - before)).astype(np.uint64) << (8 * (SYMBOL - before)).astype(np.uint64)
    left[before == 0] = 0
    after = byte + before + CORE * SYMBOL  # REST - before bytes follow: 8 overlapping ones at each end
    tail = _tail(data, after, REST - before)
    sort = np.lexsort((start[of] + begin, pack[of], doc[of], tail[1], tail[0], left, before, core))
    equal = np.ones(max(0, len(sort) - 1), bool)
    for x in (core, before, left, tail[0], tail[1]):
        y = x[sort]
        equal &= y[1:] == y[:-1]
    out = np.zeros(len(of), bool)
    out[sort[1:]] = equal
    return out


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as big-endian numbers; 0 beyond the end."""
    padded = np.r_[data, np.zeros(16, np.uint8)]
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[at + k]
    return out


def _tail(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n (5 to 12) bytes from each place on: the first up to 8 of them, and the rest."""
    keep = lambda x, n: np.where(n > 0, x >> (8 * (8 - np.maximum(n, 1))).astype(np.uint64), np.uint64(0))
    return keep(_eight(data, at), np.minimum(n, 8)), keep(_eight(data, at + 8), np.maximum(n - 8, 0))


def _sort_shard(table: pa.Table) -> pa.Table:
    heads, keys, packs, bodies, lens = [], [], [], [], []
    for raw, pack in zip(table.column("blob"), table.column("pack_id").to_pylist(), strict=True):
        raw = raw.as_py()
        n = int.from_bytes(raw[:8], "little")
        rest = c.unsqueeze(raw[8 + 8 * n :])
        heads.append(np.frombuffer(rest, np.int64, 4 * n).reshape(4, n))
        keys.append(np.frombuffer(raw, np.uint64, n, 8))
        packs.append(np.full(n, pack, np.int64))
        bodies.append(rest[32 * n :])
        lens.append(n)
    doc, start, count, anchor = np.concatenate(heads, axis=1)
    key, pack, data = np.concatenate(keys), np.concatenate(packs), np.frombuffer(b"".join(bodies), np.uint8)
    size = count + LENGTH - 1
    at = np.cumsum(size) - size
    string_at = np.cumsum(count) - count
    later = np.zeros(int(count.sum()), bool)
    # pieces of one anchor together; anchors with one piece have nothing to compare
    order = np.argsort(key, kind="stable")
    edges = np.r_[np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]), len(order)]
    todo, symbols = [], 0

    def work() -> None:
        nonlocal todo, symbols
        if todo:
            own = np.concatenate(todo)
            found = _earlier_strings(doc[own], pack[own], start[own], count[own], anchor[own], at[own], data)
            places = np.repeat(string_at[own] - (np.cumsum(count[own]) - count[own]), count[own]) + np.arange(len(found))
            later[places] = found
        todo, symbols = [], 0

    for i, j in zip(edges, edges[1:], strict=False):
        if j - i > 1:
            todo.append(order[i:j])
            symbols += int(size[order[i:j]].sum()) // SYMBOL
            if symbols > SORTED:
                work()
    work()
    ends = np.cumsum([int(h[2].sum()) for h in heads])
    masks = [c.mask_bytes(x) for x in np.split(later, ends[:-1])]
    return pa.table({"bucket": table.column("bucket").combine_chunks(), "pack_id": table.column("pack_id").combine_chunks(), "mask": pa.array(masks, pa.binary())}, schema=c.REPLY_ARROW)


def _per_pack(f):
    """mapInArrow function that calls f with each row and yields what it yields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from f(row)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>, kept binary"


def suffix_dedup(spark: SparkSession, docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Each document without the bytes that a string of 100 bytes repeated from earlier covers.

    docs needs doc_id and text; other columns are left out, whatever their names.
    Texts are taken as UTF-8.  A byte goes if it lies in 100 consecutive bytes of its
    document that also start earlier: in a document of smaller doc_id, or earlier in
    its own (overlaps count).  Strings are judged on the input.

    Null text counts as empty.  A null doc_id stands after all others; rows that share
    a doc_id are separate documents in the order of their packs.  Texts under 100
    bytes are kept whole.  An empty table gives no rows.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    removed (the runs, as bytes start to stop) and, with_text, kept: the remaining
    bytes, which need not be UTF-8.
    """
    ws = c.Workspace(spark)
    packs = c.pack_documents(ws, docs)
    out = c.with_replies(packs, _repeats(ws, packs)).mapInArrow(c.tidied(_per_pack(lambda row: _cut(row, with_text))), RESULT)
    return out if with_text else out.drop("kept")


def cut_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the bytes that suffix_dedup() removes cut out of text, all other columns as they are.

    A character of which only some bytes are to go stays whole, so the text stays
    UTF-8.  Rows all stay, if with empty text; null text stays null.
    """
    ws = c.Workspace(spark)
    packs = c.pack_documents(ws, docs, keep=c.others(docs))
    names = docs.columns

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        table = c.open_pack(row["pack"])
        texts, sizes, remove = _removed(row, table)
        ends, out = np.cumsum(sizes), []
        for k, text in enumerate(texts):
            mine = remove[ends[k] - sizes[k] : ends[k]]
            if mine.any():
                data = np.frombuffer(text, np.uint8)
                first = np.flatnonzero(data & 0xC0 != 0x80)
                whole = np.minimum.reduceat(mine.astype(np.uint8), first)
                text = data[np.repeat(whole, np.diff(np.r_[first, len(data)])) == 0].tobytes()
            out.append(text.decode())
        text = pc.if_else(pc.is_valid(table.column("text")), pa.chunked_array([pa.array(out, pa.string())]), pa.scalar(None, pa.string()))
        table = table.set_column(table.column_names.index("text"), "text", text)
        yield from table.select(names).combine_chunks().to_batches()

    schema = docs.select(*[F.col(x).cast({"doc_id": "long", "text": "string"}[x]) if x in ("doc_id", "text") else F.col(x) for x in names]).schema
    return c.with_replies(packs, _repeats(ws, packs)).mapInArrow(c.tidied(_per_pack(cut)), schema)


def _repeats(ws: c.Workspace, packs: DataFrame) -> dict[str, DataFrame]:
    """What packs need to know to tell which of their bytes are repeats: replies by name."""
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    anchor_bits = c.bucket_bits(total // ((LENGTH - GRAM) // 4))  # two anchors in about half as many bytes as a string has grams
    shard_bits = max(c.LEAST_BUCKET_BITS, math.ceil(math.log2(max(1, total / SHARD_BYTES))))

    def blobs(keys: np.ndarray, pack_id: int, bits: int, make) -> pa.RecordBatch:
        tops, at = c.split_sorted(keys, bits)
        return pa.RecordBatch.from_arrays([pa.array(tops, pa.int64()), pa.array([pack_id] * len(tops), pa.int64()), pa.array([make(i, j) for i, j in zip(at, at[1:], strict=False)], pa.binary())], schema=c.ENTRY_ARROW)

    def send_anchors(row: dict) -> Iterator[pa.RecordBatch]:
        _, data, sizes = _pack_data(c.open_pack(row["pack"]))
        keys, _ = _anchor_keys(list(_spans(data, sizes)))
        short = c.short_keys(keys, anchor_bits)
        yield blobs(keys, row["pack_id"], anchor_bits, lambda i, j: short[i:j].tobytes())

    anchors = ws.table(c.seen_elsewhere(packs.select("pack_id", "pack").mapInArrow(c.tidied(_per_pack(send_anchors)), c.ENTRY_SCHEMA)), "anchors")

    def find_pieces(row: dict) -> Iterator[pa.RecordBatch]:
        table = c.open_pack(row["pack"])
        _, data, sizes = _pack_data(table)
        spans = list(_spans(data, sizes))
        keys, twice = _anchor_keys(spans)
        pieces = Pieces.of(spans, keys, twice | c.join_masks(row["anchors"]) if len(keys) else twice)
        del spans
        hi, lo, _, first = pieces.classes(data)
        ids = _doc_ids(table, sizes, pieces.start[first])
        yield blobs(hi, row["pack_id"], anchor_bits, lambda i, j: c.write_ranked(hi[i:j], lo[i:j], ids[i:j]))
        # what later passes need of the pieces stays with the pack: buckets -3 to -1
        is_first = np.zeros(len(pieces.start), bool)
        is_first[first] = True
        own = [pieces.dump(), c.squeeze(np.packbits(is_first).tobytes()), c.squeeze(np.searchsorted(np.flatnonzero(is_first), first).astype(np.int32).tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array([-3, -2, -1], pa.int64()), pa.array([row["pack_id"]] * 3, pa.int64()), pa.array(own, pa.binary())], schema=c.ENTRY_ARROW)

    found = ws.table(c.with_replies(packs, {"anchors": anchors}).mapInArrow(c.tidied(_per_pack(find_pieces)), c.ENTRY_SCHEMA), "pieces")
    kept = found.withColumnRenamed("blob", "mask")
    own = {"pieces": kept.filter("bucket = -3"), "firsts": kept.filter("bucket in (-2, -1)")}
    own["later"] = ws.table(c.earlier_elsewhere(found.filter("bucket >= 0")), "later")

    def send_pieces(row: dict) -> Iterator[pa.RecordBatch]:
        yield _send_pieces(row, shard_bits)

    own["strings"] = ws.table(c.with_replies(packs, own).mapInArrow(c.tidied(_per_pack(send_pieces)), c.ENTRY_SCHEMA).groupBy("bucket").applyInArrow(c.tidied_groups(_sort_shard), c.REPLY_SCHEMA), "strings")

    return own


def _removed(row: dict, table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of a pack, their sizes, and which of their bytes are repeats."""
    texts, data, sizes = _pack_data(table)
    pieces = Pieces.load(row["pieces"][0]["mask"])
    hold, _, held, _ = _holders(row, pieces, data)
    step = np.zeros(len(data) + 1, np.int32)
    # copies of pieces that stand earlier go whole, others string by string
    gone = ~hold
    np.add.at(step, pieces.start[gone], 1)
    np.add.at(step, (pieces.start + pieces.count + LENGTH - 1)[gone], -1)
    count = pieces.count[held]
    starts = np.repeat(pieces.start[held] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    hit = starts[c.join_masks(row["strings"])]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + LENGTH, -1)
    return texts, sizes, np.cumsum(step[:-1]) > 0


def _cut(row: dict, with_text: bool) -> Iterator[pa.RecordBatch]:
    table = c.open_pack(row["pack"])
    texts, sizes, remove = _removed(row, table)
    ends = np.cumsum(sizes)
    n_removed, runs, kept = [], [], []
    for k, text in enumerate(texts):
        mine = remove[ends[k] - sizes[k] : ends[k]]
        edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8))).reshape(-1, 2)
        runs.append([{"start": int(a), "stop": int(b)} for a, b in edges])
        n_removed.append(int((edges[:, 1] - edges[:, 0]).sum()))
        kept.append(np.frombuffer(text, np.uint8)[~mine].tobytes() if len(edges) else text)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(sizes), pa.array(n_removed, pa.int64()), pa.array([len(x) for x in runs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(runs, spans), pa.array(kept if with_text else [None] * len(kept), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])
