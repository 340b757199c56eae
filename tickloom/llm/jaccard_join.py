"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents, columns word shingles.  Documents of equal
sets are one row.  The document frequency of every column comes from one packed
exchange; columns with a single document can't add to any overlap, so a row whose
other columns are fewer than its size asks for has no partner and drops out.

What is left is ordered by rising frequency.  Rows that reach the threshold
must share a column among the first few of both (the prefix), and how late in
either row that column stands bounds the overlap.  Within a column, the rows are
first multiplied with the column's first row only; rows that come out linked are
one component, and only rows of different components are multiplied after that,
so a large group of near copies costs one product for each, not one for each pair.
Products go in blocks of rows and of columns: overlap counts are added up column
block by column block, and a pair is discarded as soon as what is left of the
columns can't lift it to its bound.  Where few pairs of a block are wanted, only
these are counted.  Columns that many unlinked rows share (templates) never become
pairs: their rows are cut into blocks by size, and whole blocks are multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as c
from .components import connected
from .substring_dedup import PackWords

_WORD, _WINDOW, _SHORT = (21, 0xD6E8FEB86659FD93), 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: Rows of a block, entries of the rows that one task multiplies, and parts in which columns are counted.
BLOCK_ROWS, BLOCK_ENTRIES, BLOCK_COLUMNS = 1024, 1 << 21, 8
#: Rows still apart in a column from which on it goes by whole blocks; columns counted at once there.
HOT_ROWS, DENSE_COLUMNS = 2048, 1024
#: Turns in which a column's rows are multiplied with one of them before all that is left is.
LEADER_TURNS = 2


class Shingles:
    """Distinct shingles of each text of a pack: doc and hash, by doc and then hash."""

    def __init__(self, texts: list[bytes], size: int, keep: np.ndarray | None = None):
        texts = [t.lower() if keep is None or keep[k] else b"" for k, t in enumerate(texts)]
        words = PackWords(texts)
        hashes = words.hashes(*_WORD)
        at = np.flatnonzero(words.inside(size))
        doc, value = words.doc[at], words.windows(hashes, size, _WINDOW)[at]
        short = np.flatnonzero((words.n_words > 0) & (words.n_words < size))
        if len(short):
            roll = c.rolling(_WINDOW, words.n)
            end = np.cumsum(words.n_words)[short]
            whole = roll.runs(roll.prefix(hashes), end - words.n_words[short], end)
            value = np.r_[value, c.mix(whole ^ (np.uint64(_SHORT) * words.n_words[short].astype(np.uint64)))]
            doc = np.r_[doc, short]
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
        self.doc, self.value = doc[new], value[new]
        self.sizes = np.bincount(self.doc, minlength=len(texts))

    def keys(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct exchange keys (the leading bits that are sent), and the key of each shingle."""
        return np.unique(self.value >> np.uint64(32 - bits) << np.uint64(32 - bits), return_inverse=True)


def _needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any partner: percent of the own size, rounded up."""
    return -(-percent * sizes // 100)


def _signatures(packs: DataFrame, size: int) -> DataFrame:
    """uid, pack_id, row, doc_id, n, sig_a, sig_b of each document; equal sets have equal signatures."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = c.open_pack(row["pack"])
                s = Shingles(c.texts_of(table), size)
                ends = np.cumsum(s.sizes)

                def total(values: np.ndarray, ends: np.ndarray = ends, sizes: np.ndarray = s.sizes) -> np.ndarray:
                    run = np.r_[np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]
                    return (run[ends] - run[ends - sizes]).view(np.int64)

                n = table.num_rows
                yield pa.RecordBatch.from_arrays([pa.array((row["pack_id"] << 16) + np.arange(n)), pa.array([row["pack_id"]] * n, pa.int64()), pa.array(np.arange(n)), table.column("doc_id").combine_chunks(), pa.array(s.sizes, pa.int64()), pa.array(total(s.value)), pa.array(total(c.mix(s.value ^ np.uint64(_SHORT))))], names=["uid", "pack_id", "row", "doc_id", "n", "sig_a", "sig_b"])

    return packs.select("pack_id", "pack").mapInArrow(c.tidied(sign), "uid long, pack_id long, row long, doc_id long, n long, sig_a long, sig_b long")


def _kept_rows(row: dict, n: int) -> np.ndarray:
    keep = np.zeros(n, bool)
    keep[c.chosen_rows(row["rows"])] = True
    return keep


def _candidates(packs: DataFrame, kept: DataFrame, size: int, percent: int, ws: c.Workspace, bits: int) -> DataFrame:
    """Rows of the matrix that may have a partner: uid, n, columns (of two or more documents, by
    frequency), places (their positions among all columns of the row) and n_prefix (how many of
    them stand in the prefix)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = c.texts_of(c.open_pack(row["pack"]))
                keys, inverse = Shingles(texts, size, _kept_rows(row, len(texts))).keys(bits)
                counts = np.minimum(255, np.bincount(inverse, minlength=len(keys))).astype(np.uint8)
                tops, at = c.split_sorted(keys, bits)
                short = c.short_keys(keys, bits)
                blobs = [short[i:j].tobytes() + counts[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(tops, pa.int64()), pa.array([row["pack_id"]] * len(tops), pa.int64()), pa.array(blobs, pa.binary())], schema=c.ENTRY_ARROW)

    counts = ws.table(c.count_everywhere(c.with_replies(packs, {"rows": kept}).mapInArrow(c.tidied(send), c.ENTRY_SCHEMA)), "frequencies")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = c.texts_of(c.open_pack(row["pack"]))
                s = Shingles(texts, size, _kept_rows(row, len(texts)))
                _, inverse = s.keys(bits)
                df = c.join_counts(row["counts"])[inverse]
                order = np.lexsort((s.value, df, s.doc))  # s.doc is in order already, so rows stay together
                value, df, ends = s.value[order], df[order], np.cumsum(s.sizes)
                need = _needed(s.sizes, percent)
                shared = np.bincount(s.doc[df > 1], minlength=len(texts))
                out: dict[str, list] = {"uid": [], "n": [], "columns": [], "places": [], "n_prefix": []}
                for k in np.flatnonzero((s.sizes > 0) & (shared >= need)):
                    n, own = s.sizes[k], shared[k]
                    in_prefix = (n - need[k] + 1) - (n - own)  # single-document columns come first
                    if in_prefix > 0:
                        out["uid"].append((row["pack_id"] << 16) + int(k))
                        out["n"].append(int(n))
                        out["columns"].append(value[ends[k] - own : ends[k]].view(np.int64))
                        out["places"].append(int(n - own))
                        out["n_prefix"].append(int(in_prefix))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("columns", pa.list_(pa.int64())), ("places", pa.int64()), ("n_prefix", pa.int64())]))

    return ws.table(c.with_replies(packs, {"rows": kept, "counts": counts}).mapInArrow(c.tidied(choose), "uid long, n long, columns array<long>, places long, n_prefix long"), "candidates")


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """overlap >= percent of the union, as a bound on the overlap of rows of n and m columns."""
    return -(-percent * (n + m) // (100 + percent))


def _entries_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's columns start (and the last ends), and the columns end to end."""
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    starts = flat.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], flat.values.to_numpy()[starts[0] : starts[-1]]


def _wanted_overlaps(starts: np.ndarray, values: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (i, j) of rows link."""
    kinds, ids = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(n)), np.diff(starts))
    key = np.sort(row * np.int64(len(kinds)) + ids)
    ids = key - row * np.int64(len(kinds))  # each row's, rising
    size = np.diff(starts)
    i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    overlap, alive, least = np.zeros(len(i), np.int64), np.arange(len(i)), _least_overlap(n[i], n[j], percent)
    cuts = np.linspace(0, len(kinds), BLOCK_COLUMNS + 1).astype(np.int64)
    edge = [np.searchsorted(key, np.arange(len(n)) * np.int64(len(kinds)) + x) for x in cuts]
    for k in range(BLOCK_COLUMNS):
        # the shorter row's columns of this block, looked up in the longer row
        a, many = edge[k][i[alive]], (edge[k + 1] - edge[k])[i[alive]]
        pair = np.repeat(np.arange(len(alive)), many)
        at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(len(pair))
        ask = j[alive][pair] * np.int64(len(kinds)) + ids[at]
        found = np.minimum(np.searchsorted(key, ask), len(key) - 1)
        overlap[alive] += np.bincount(pair[key[found] == ask], minlength=len(alive))
        left = np.minimum(starts[i + 1] - edge[k + 1][i], starts[j + 1] - edge[k + 1][j])[alive]
        alive = alive[overlap[alive] + left >= least[alive]]
    out = np.zeros(len(i), bool)
    out[alive] = overlap[alive] >= least[alive]
    return out


def _all_overlaps(starts: np.ndarray, values: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Which rows x link with which rows y, of those apart: a matrix of whole blocks, by dense products of some columns at a time."""
    size = np.diff(starts)
    rows = np.r_[x, y]
    at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(rows)), size[rows])
    kinds, ids = np.unique(values[at], return_inverse=True)
    upper = which < len(x)
    p, q = np.bincount(ids[upper], minlength=len(kinds)), np.bincount(ids[~upper], minlength=len(kinds))
    # columns of both blocks, those of most products first
    order = np.argsort(-(p * q), kind="stable")[: int(np.count_nonzero(p * q))]
    place = np.full(len(kinds), -1)
    place[order] = np.arange(len(order))
    spot = place[ids]
    which, spot = which[spot >= 0], spot[spot >= 0]
    turn = np.argsort(spot, kind="stable")
    which, spot = which[turn], spot[turn]
    overlap = np.zeros((len(x), len(y)), np.float32)
    left = np.bincount(which, minlength=len(rows)).astype(np.int64)
    least = _least_overlap(n[x][:, None], n[y][None, :], percent)
    alive = apart & (np.minimum(left[: len(x)][:, None], left[len(x) :][None, :]) >= least)
    for low in range(0, len(order), DENSE_COLUMNS):
        if not alive.any():
            break
        a, b = np.searchsorted(spot, [low, low + DENSE_COLUMNS])
        block = np.zeros((len(rows), min(DENSE_COLUMNS, len(order) - low)), np.float32)
        block[which[a:b], spot[a:b] - low] = 1
        overlap += block[: len(x)] @ block[len(x) :].T
        left -= np.bincount(which[a:b], minlength=len(rows))
        alive &= overlap + np.minimum(left[: len(x)][:, None], left[len(x) :][None, :]) >= least
    return alive & (overlap >= least)


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of links that connect what all of them connect, fewer than n."""
    parent, out = list(range(n)), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for place, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            out.append(place)
    return out


LINKS = "a long, b long"


def _multiply(ws: c.Workspace, rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (a, b, entries: the columns of both rows), as products of blocks of rows a with the rows b they meet.

    A block of rows has about BLOCK_ENTRIES columns to look at; rows with more partners
    than that are in several blocks.
    """
    total = pairs.agg(F.sum("entries")).first()[0] or 0
    blocks = -(-total // BLOCK_ENTRIES) or 1
    wide = pairs.groupBy("a").agg(F.sum("entries").alias("all")).filter(F.col("all") > BLOCK_ENTRIES).select("a", F.ceil(F.col("all") / BLOCK_ENTRIES).alias("parts"))
    cut = pairs.join(wide, "a", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))
    cut = ws.table(cut, "cut")
    ends = cut.select("block", "part", F.col("a").alias("uid")).union(cut.select("block", "part", F.col("b").alias("uid"))).distinct()
    filled = ends.join(rows.select("uid", "n", "columns"), "uid").select(F.col("block").alias("_block"), F.col("part").alias("_part"), "uid", "n", "columns")

    def product(key, wanted: pa.Table, table: pa.Table) -> pa.Table:
        uid = table.column("uid").to_numpy()
        turn = np.argsort(uid)
        place = lambda x: turn[np.searchsorted(uid[turn], wanted.column(x).to_numpy())]
        i, j = place("a"), place("b")
        linked = _wanted_overlaps(*_entries_of(table.column("columns")), table.column("n").to_numpy(), i, j, percent)
        return pa.table({"a": uid[i[linked]], "b": uid[j[linked]]})

    return ws.table(cut.groupBy("block", "part").cogroup(filled.groupBy("_block", "_part")).applyInArrow(c.tidied_cogroups(product), LINKS), "links")


def _multiply_blocks(ws: c.Workspace, rows: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Links that connect whatever rows connect that share one of cells' columns (uid, n, col, label), as products of whole blocks.

    Rows of one size band (no link goes further than to the next band) are dealt to blocks
    of BLOCK_ROWS.  Blocks that share a column meet, once, however many columns they share.
    A task holds two blocks; only links that connect something new leave it.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("long")
    hot = ws.table(cells.select("uid", "label", "n", band.alias("band")).distinct(), "hot")
    counts = hot.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    placed = ws.table(hot.join(counts, "band").select("uid", "label", "band", F.pmod(F.xxhash64("uid"), F.col("blocks")).alias("block")), "placed")
    where = ws.table(cells.select("uid", "col").join(placed, "uid").select("col", "band", "block").distinct(), "where")
    x, y = where.alias("x"), where.alias("y")
    up = (F.col("y.band") == F.col("x.band") + 1) | ((F.col("y.band") == F.col("x.band")) & (F.col("y.block") >= F.col("x.block")))
    meet = ws.table(x.join(y, "col").filter(up).select(*(F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in "xy" for k in ("band", "block"))).distinct(), "meet")
    full = placed.join(rows.select("uid", "n", "columns"), "uid")
    key = ["x_band", "x_block", "y_band", "y_block"]
    sides = [meet.join(full.withColumnsRenamed({"band": f"{s}_band", "block": f"{s}_block"}), [f"{s}_band", f"{s}_block"]).select(*key, F.lit(s == "x").alias("upper"), "uid", "label", "n", "columns") for s in "xy"]

    def product(table: pa.Table) -> pa.Table:
        uid, label, upper = (table.column(k).to_numpy() for k in ("uid", "label", "upper"))
        x, y = np.flatnonzero(upper), np.flatnonzero(~upper)
        apart = label[x][:, None] != label[y][None, :]
        i, j = np.nonzero(_all_overlaps(*_entries_of(table.column("columns")), table.column("n").to_numpy(), x, y, apart, percent))
        a, b = uid[x[i]], uid[y[j]]
        ends, at = np.unique(np.r_[a, b], return_inverse=True)
        few = _spanning(len(ends), at[: len(a)], at[len(a) :])
        return pa.table({"a": a[few], "b": b[few]})

    return ws.table(sides[0].union(sides[1]).groupBy(*key).applyInArrow(c.tidied_groups(product), LINKS), "block_links")


def _links(ws: c.Workspace, rows: DataFrame, percent: int) -> DataFrame:
    """Links that connect whatever rows at or above the threshold connect, and no others."""
    cells = ws.table(rows.select("uid", "n", F.posexplode(F.slice("columns", F.lit(1), F.col("n_prefix").cast("int"))).alias("k", "col"), "places").select("uid", "n", "col", (F.col("places") + F.col("k")).alias("place")), "cells")
    fits = lambda x, y: (F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place")) * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent)
    found, apart = None, cells.withColumn("label", F.col("uid"))
    for turn in range(LEADER_TURNS):
        # in the first turn the row whose column stands earliest, which is the least edited one; then any
        rank = F.col("place") if turn == 0 else F.xxhash64("uid", F.lit(turn))
        leader = apart.groupBy("col").agg(F.min(F.struct(rank.alias("rank"), "uid", "n", "place", "label")).alias("x")).select("col", "x.*")
        pairs = leader.alias("x").join(apart.alias("y"), "col").filter((F.col("x.label") != F.col("y.label")) & fits("x", "y"))
        more = _multiply(ws, rows, ws.table(pairs.select(F.least("x.uid", "y.uid").alias("a"), F.greatest("x.uid", "y.uid").alias("b"), (F.col("x.n") + F.col("y.n")).alias("entries")).distinct(), "pairs"), percent)
        found = more if found is None else found.union(more)
        told = cells.join(connected(ws, found), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
        # columns whose rows aren't all of one component yet
        mixed = told.groupBy("col").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("col")
        apart = ws.table(told.join(mixed, "col"), "apart")
    # whatever is still apart, each with each, makes the result exact: pairs where few rows share a column, else blocks
    many = ws.table(apart.groupBy("col").agg(F.count("*").alias("rows")).filter(F.col("rows") > HOT_ROWS).select("col"), "many")
    few = apart.join(many, "col", "left_anti")
    pairs = few.alias("x").join(few.alias("y"), "col").filter((F.col("x.label") < F.col("y.label")) & fits("x", "y")).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b"), (F.col("x.n") + F.col("y.n")).alias("entries")).distinct()
    found = found.union(_multiply(ws, rows, ws.table(pairs, "pairs"), percent))
    return found if many.isEmpty() else found.union(_multiply_blocks(ws, rows, apart.join(many, "col", "left_semi"), percent))


def jaccard_join(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """n_shingles and component_id of every document.

    docs needs doc_id and text; other columns are left out, whatever their names.
    A-Z are lower-cased; words are runs of bytes other than space, \\t, \\n, \\v, \\f and
    \\r; a document's set holds its distinct shingles of `size` words, or its whole
    sequence as one if it has fewer.  Null and empty texts and texts without words
    have an empty set and are linked with nothing.  Two documents link when
    100 * intersection >= percent * union.

    component_id is the smallest doc_id that links reach, the own one included; null
    ids count as larger than any and stay null if nothing else is there.  Repeated
    rows are documents of equal sets.  An empty table gives no rows.  Shingles are
    compared by 64-bit hashes.
    """
    ws = c.Workspace(spark)
    return _classes(ws, c.pack_documents(ws, docs), size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs that are the first of their component under jaccard_join(), all columns of them.

    Documents with an empty set all stay.  First is the smallest doc_id, nulls last;
    among rows of one doc_id, the one packed first.
    """
    ws = c.Workspace(spark)
    packs = c.pack_documents(ws, docs, keep=c.others(docs))
    classes = _classes(ws, packs, size, percent)
    first = classes.filter("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "pack_id", "row")).alias("x")).select("x.pack_id", "x.row")
    stay = first.union(classes.filter("n = 0").select("pack_id", "row"))
    return c.emit_rows(packs, ws.table(c.rows_by_pack(stay), "stay"), docs)


def _classes(ws: c.Workspace, packs: DataFrame, size: int, percent: int) -> DataFrame:
    """uid, pack_id, row, doc_id, n, label and component_id of every document."""
    signed = ws.table(_signatures(packs, size), "signed")
    set_of = ["n", "sig_a", "sig_b"]
    sets = ws.table(signed.filter("n > 0").groupBy(*set_of).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "pack_id", "row")).alias("first")).select(*set_of, "first.doc_id", "first.uid", "first.pack_id", "first.row"), "sets")

    total = sets.agg(F.sum("n")).first()[0] or 0
    kept = ws.table(c.rows_by_pack(sets), "kept")
    rows = _candidates(packs, kept, size, percent, ws, c.bucket_bits(total))
    labels = connected(ws, _links(ws, rows, percent))

    found = sets.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    lowest = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    whole = ws.table(found.join(lowest, "label").select(*set_of, "label", "component_id"), "classes")
    out = signed.join(whole, set_of, "left")
    return out.withColumns({"label": F.coalesce("label", "uid"), "component_id": F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))})
