"""Shared ground: the shared working folder, packed documents, packed exchanges.

Documents are read once and kept as *packs*: compressed Arrow batches of 2 MB of text
or more, in a table bucketed by pack id.  Later passes join small replies to the packs
without moving the text again.  What packs exchange goes as blobs of sorted hashes,
one row for each (pack, bucket), so that Spark moves few rows and numpy does the
comparing.  Packs and buckets both grow with the root of the corpus, up to a bound,
so the rows of an exchange grow in proportion to the corpus and don't shrink to
single entries.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.shipping import ship

#: Text of a pack, at least and at most; it grows with the root of the corpus beyond so many bytes of input.
PACK_BYTES, LARGEST_PACK, ROOT_FROM, PACK_ROWS = 2 << 20, 64 << 20, 2 << 30, 1 << 16
#: Entries of an exchange that one bucket should get: at least, and at most; between them by the root of their number.
BUCKET_ENTRIES, LARGEST_BUCKET, ENTRIES_FROM = 1 << 17, 1 << 24, 1 << 28
LEAST_BUCKET_BITS = 10
#: Buckets of the table of packs that one task writes to, so that its packs share so many files.
TASK_BUCKETS = 4
#: Seconds between two times that a worker on groups gives unused memory back.
TIDY_SECONDS = 0.5
#: Stands for a null id where ids are compared: after all others.
LAST_ID = np.iinfo(np.int64).max

_OPEN: list[tuple[SparkSession, str, list[str]]] = []


class Workspace:
    """Folder for the tables of one query, below the cluster's shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tickloom-")
            spark.sparkContext.setCheckpointDir(base)
            base = spark.sparkContext.getCheckpointDir()
        self.path = f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        _OPEN.append((spark, self.path, self.tables))
        # bounds what a Python worker is handed at once, and the buffers for it on both sides
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
        # the tables of large rows are ORC, whose reader then holds few of them at once
        spark.conf.set("spark.sql.orc.columnarReaderBatchSize", "8")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written as Parquet and read back; cuts the lineage."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(self, df: DataFrame, name: str, *key: str, gather: bool = False) -> DataFrame:
        """df as a table bucketed by key, with as many buckets as shuffle partitions.

        gather: rows are shuffled once, so that a bucket is one file; else each task writes its own.
        """
        table = f"tickloom_{name}_{uuid.uuid4().hex}"
        n = self.buckets()
        df = df.repartition(n, *key) if gather else df
        df.write.format("orc").bucketBy(n, *key).option("compression", "none").option("path", f"{self.path}/{table}").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)


def _remove(spark: SparkSession, path: str, tables: list[str]) -> None:
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released() -> Iterator[None]:
    """Workspaces opened inside are removed at the end, so results must be written by then; others stay until the process ends."""
    first = len(_OPEN)
    yield
    while len(_OPEN) > first:
        _remove(*_OPEN.pop())


@atexit.register
def _remove_workspaces() -> None:
    for opened in _OPEN:
        try:
            _remove(*opened)
        except Exception:  # the session may be gone; its folder then stays  # noqa: BLE001
            return


_tidied_at = [0.0]


def _give_back() -> None:
    """Pages that Arrow and the C library hold without use go back; a worker that stands by would keep them for good."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
    finally:
        _tidied_at[0] = time.monotonic()


def _give_back_at_times() -> None:
    if time.monotonic() - _tidied_at[0] > TIDY_SECONDS:
        _give_back()


def tidied(f):
    """f for mapInArrow; the worker gives back unused memory at the end of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _give_back()

    return run


def tidied_groups(f):
    """f for applyInArrow on groups; the worker gives back unused memory at times."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        _give_back_at_times()
        return out

    return run


def tidied_cogroups(f):
    """f for applyInArrow on cogroups with their key; the worker gives back unused memory at times."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(key, left, right)
        _give_back_at_times()
        return out

    return run


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def bounded_batches(batches: Iterator[pa.RecordBatch], sizes, limit: int = PACK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in slices of about limit bytes; sizes(batch) gives the bytes of each row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sizes(batch))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = min(at + PACK_ROWS, max(at + 1, int(np.searchsorted(ends, done + limit, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def text_sizes(column: int):
    def sizes(batch: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)

    return sizes


PACK_SCHEMA = "pack_id long, n_docs long, n_bytes long, n_words long, pack binary"


def pack_bytes(docs: DataFrame) -> int:
    """Text that a pack should hold, by the planner's estimate of the size of docs."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return int(min(LARGEST_PACK, PACK_BYTES * max(1.0, (size / ROOT_FROM) ** 0.5)))


def _table_bucket(number: int, buckets: int) -> int:
    """The bucket that Spark puts a long into: Murmur3 of it, seed 42."""
    word = 0xFFFFFFFF
    h = 42
    for k in (number & word, number >> 32 & word):
        k = k * 0xCC9E2D51 & word
        k = ((k << 15 | k >> 17) & word) * 0x1B873593 & word
        h ^= k
        h = ((h << 13 | h >> 19) & word) * 5 + 0xE6546B64 & word
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & word
    h = (h ^ h >> 13) * 0xC2B2AE35 & word
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % buckets


def _pack_ids(partition: int, buckets: int) -> Iterator[int]:
    """Ids for the packs of a task, in turn in TASK_BUCKETS buckets of the table."""
    number = [partition << 24] * TASK_BUCKETS
    k = 0
    while True:
        turn = k % TASK_BUCKETS
        wanted = (partition * TASK_BUCKETS + turn) % buckets
        at = number[turn]
        while at % TASK_BUCKETS != turn or _table_bucket(at, buckets) != wanted:
            at += 1
        number[turn], k = at + 1, k + 1
        yield at


def pack_documents(ws: Workspace, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Table of packs of (doc_id, text, *keep); rows stand by doc_id in a pack, null ids last."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    limit, buckets = pack_bytes(chosen), ws.buckets()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _pack_ids(TaskContext.get().partitionId(), buckets)
        codec = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        held: list[pa.RecordBatch] = []
        held_bytes = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, held_bytes
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=codec) as out:
                out.write_table(table)
            words = sum(len(x.split()) for x in (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in table.column("text")))
            row = pa.RecordBatch.from_pydict({"pack_id": [next(ids)], "n_docs": [table.num_rows], "n_bytes": [held_bytes], "n_words": [words], "pack": [sink.getvalue().to_pybytes()]}, schema=pa.schema([("pack_id", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("pack", pa.binary())]))
            held, held_bytes = [], 0
            return row

        size = text_sizes(1)
        for part in bounded_batches(batches, size, PACK_BYTES):
            more = int(size(part).sum())
            if held and (held_bytes + more > limit or sum(x.num_rows for x in held) + part.num_rows > PACK_ROWS):
                yield flush()
            held.append(part)
            held_bytes += more
        if held:
            yield flush()

    return ws.bucketed(chosen.mapInArrow(tidied(pack), PACK_SCHEMA), "packs", "pack_id")


def open_pack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all().combine_chunks()


def texts_of(table: pa.Table) -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def ids_of(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("doc_id"), int(LAST_ID)).to_numpy().astype(np.int64)


def bucket_bits(entries: int) -> int:
    """So many leading hash bits make the bucket that a bucket stays small at any input size."""
    each = min(LARGEST_BUCKET, BUCKET_ENTRIES * max(1.0, (entries / ENTRIES_FROM) ** 0.5))
    return max(LEAST_BUCKET_BITS, math.ceil(math.log2(entries / each)) if entries > each else 0)


def split_sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur among sorted 64-bit keys, and where each one starts (and the last ends)."""
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]]) if len(tops) else np.zeros(0, np.int64)
    return tops[at], np.r_[at, len(tops)]


def short_keys(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


REPLY_SCHEMA = "bucket long, pack_id long, mask binary"


def replies_by_pack(replies: DataFrame, name: str) -> DataFrame:
    return replies.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask"))).alias(name))


def with_replies(packs: DataFrame, replies: dict[str, DataFrame]) -> DataFrame:
    """packs with, for each name, the replies it got: array<struct<bucket, mask>>, by bucket.

    The packs aren't moved: their table is bucketed, and the replies, a few bits
    for each entry, are hashed to its buckets.
    """
    out = packs.select("pack_id", "pack")
    for name, df in replies.items():
        out = out.join(replies_by_pack(df, name).hint("shuffle_hash"), "pack_id", "left")
    return out


def join_masks(reply) -> np.ndarray:
    """Bits of all buckets in a row; each mask starts with its length as 4 bytes."""
    parts = []
    for item in reply or ():
        raw = item["mask"]
        n = int.from_bytes(raw[:4], "little")
        parts.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=4), count=n))
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def mask_bytes(mask: np.ndarray) -> bytes:
    return len(mask).to_bytes(4, "little") + np.packbits(mask).tobytes()


def row_places(packs: DataFrame, more: str = "", make=None) -> DataFrame:
    """pack_id, row and doc_id of every document, and the columns that make(table) gives under the schema `more`."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = open_pack(row["pack"])
                n = table.num_rows
                own = make(table) if make else {}
                yield pa.RecordBatch.from_arrays([pa.array([row["pack_id"]] * n, pa.int64()), pa.array(np.arange(n)), table.column("doc_id").combine_chunks(), *own.values()], names=["pack_id", "row", "doc_id", *own])

    return packs.select("pack_id", "pack").mapInArrow(tidied(index), "pack_id long, row long, doc_id long" + (f", {more}" if more else ""))


def rows_by_pack(places: DataFrame) -> DataFrame:
    """Replies that tell each pack its rows among places (pack_id, row), as often as they occur there."""

    def pick(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": [0], "pack_id": [table.column("pack_id")[0].as_py()], "mask": pa.array([np.sort(table.column("row").to_numpy()).tobytes()], pa.binary())}, schema=REPLY_ARROW)

    return places.select("pack_id", "row").groupBy("pack_id").applyInArrow(tidied_groups(pick), REPLY_SCHEMA)


def chosen_rows(reply) -> np.ndarray:
    return np.concatenate([np.frombuffer(x["mask"], np.int64) for x in reply]) if reply else np.zeros(0, np.int64)


def emit_rows(packs: DataFrame, rows: DataFrame, like: DataFrame) -> DataFrame:
    """The documents among rows (replies of rows_by_pack), with the columns of like, all of which the packs keep."""
    names = like.columns

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = chosen_rows(row["rows"])
                if len(at):
                    yield from open_pack(row["pack"]).select(names).take(at).combine_chunks().to_batches()

    return with_replies(packs, {"rows": rows}).mapInArrow(tidied(emit), like.select(*[F.col(x).cast({"doc_id": "long", "text": "string"}[x]) if x in ("doc_id", "text") else F.col(x) for x in names]).schema)


def others(docs: DataFrame) -> tuple[str, ...]:
    """Columns of docs besides doc_id and text."""
    return tuple(x for x in docs.columns if x not in ("doc_id", "text"))


ENTRY_SCHEMA = "bucket long, pack_id long, blob binary"
ENTRY_ARROW = pa.schema([("bucket", pa.int64()), ("pack_id", pa.int64()), ("blob", pa.binary())])
REPLY_ARROW = pa.schema([("bucket", pa.int64()), ("pack_id", pa.int64()), ("mask", pa.binary())])


def seen_elsewhere(entries: DataFrame) -> DataFrame:
    """For entries of sorted, distinct 32-bit keys: which keys occur in other packs too."""

    def reduce(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("blob")]
        if not blobs:
            return REPLY_ARROW.empty_table()
        keys = np.concatenate(blobs)
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        at = np.searchsorted(twice, keys)
        again = np.zeros(len(keys), bool) if not len(twice) else twice[np.minimum(at, len(twice) - 1)] == keys
        parts = np.split(again, np.cumsum([len(b) for b in blobs])[:-1])
        return pa.table({"bucket": table.column("bucket").combine_chunks(), "pack_id": table.column("pack_id").combine_chunks(), "mask": pa.array([mask_bytes(p) for p in parts], pa.binary())}, schema=REPLY_ARROW)

    return entries.groupBy("bucket").applyInArrow(tidied_groups(reduce), REPLY_SCHEMA)


def earlier_elsewhere(entries: DataFrame) -> DataFrame:
    """For entries of sorted, distinct 96-bit keys with the smallest doc_id each has in its pack:
    which keys another pack holds with a smaller doc_id (the same doc_id: a smaller pack_id)."""

    def reduce(table: pa.Table) -> pa.Table:
        high, low, ids, lens = [], [], [], []
        for x in table.column("blob"):
            a, b, c = read_ranked(x.as_py())
            high.append(a)
            low.append(b)
            ids.append(c)
            lens.append(len(a))
        if not lens:
            return REPLY_ARROW.empty_table()
        hi, lo, doc = np.concatenate(high), np.concatenate(low), np.concatenate(ids)
        pack = np.repeat(table.column("pack_id").to_numpy(), lens)
        order = np.lexsort((pack, doc, lo, hi))
        same = (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])
        later = np.zeros(len(hi), bool)
        later[order[1:]] = same  # all but the first of each key
        parts = np.split(later, np.cumsum(lens)[:-1])
        return pa.table({"bucket": table.column("bucket").combine_chunks(), "pack_id": table.column("pack_id").combine_chunks(), "mask": pa.array([mask_bytes(p) for p in parts], pa.binary())}, schema=REPLY_ARROW)

    return entries.groupBy("bucket").applyInArrow(tidied_groups(reduce), REPLY_SCHEMA)


def count_everywhere(entries: DataFrame) -> DataFrame:
    """For entries of sorted, distinct 32-bit keys and their counts up to 255: the sum over all packs, up to 255."""

    def reduce(table: pa.Table) -> pa.Table:
        keys, counts, lens = [], [], []
        for x in table.column("blob"):
            raw = x.as_py()
            n = len(raw) // 5
            keys.append(np.frombuffer(raw, np.uint32, n))
            counts.append(np.frombuffer(raw, np.uint8, n, 4 * n))
            lens.append(n)
        if not lens:
            return REPLY_ARROW.empty_table()
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.minimum(255, np.bincount(inverse, np.concatenate(counts)))[inverse].astype(np.uint8)
        parts = np.split(total, np.cumsum(lens)[:-1])
        return pa.table({"bucket": table.column("bucket").combine_chunks(), "pack_id": table.column("pack_id").combine_chunks(), "mask": pa.array([squeeze(p.tobytes()) for p in parts], pa.binary())}, schema=REPLY_ARROW)

    return entries.groupBy("bucket").applyInArrow(tidied_groups(reduce), REPLY_SCHEMA)


def join_counts(reply) -> np.ndarray:
    parts = [np.frombuffer(unsqueeze(x["mask"]), np.uint8) for x in reply or ()]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def write_ranked(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray) -> bytes:
    return len(hi).to_bytes(4, "little") + hi.tobytes() + lo.tobytes() + squeeze(ids.tobytes())


def read_ranked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, np.uint64, n, 4), np.frombuffer(raw, np.uint32, n, 4 + 8 * n), np.frombuffer(unsqueeze(raw[4 + 12 * n :]), np.int64)


# --- hashing, in numpy, modulo 2**64 ---------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all input bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


class Rolling:
    """Polynomial hash of any run of an array of 64-bit values, from prefix sums."""

    def __init__(self, base: int, n: int):
        self.up = powers(base, n + 1)
        self.down = powers(pow(base, -1, 1 << 64), n + 1)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


_ROLLING: dict[int, Rolling] = {}
#: Values that are summed at once where runs of bytes are hashed.
_AT_ONCE = 1 << 18


def rolling(base: int, n: int) -> Rolling:
    """A Rolling for at least n values, kept by the worker; long ones aren't kept."""
    if n > 1 << 21:
        return Rolling(base, n)
    if base not in _ROLLING or len(_ROLLING[base].up) <= n:
        _ROLLING[base] = Rolling(base, max(n, 1 << 16))
    return _ROLLING[base]


def run_hashes(seed: int, base: int, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start to end for each run; starts must rise.  Works in spans, so memory stays small."""
    table, out, i = byte_values(seed), np.empty(len(start), np.uint64), 0
    while i < len(start):
        low = start[i]
        j = int(np.searchsorted(start, low + _AT_ONCE))
        high = int(end[i:j].max())
        roll = rolling(base, high - low)
        out[i:j] = roll.runs(roll.prefix(table[data[low:high]]), start[i:j] - low, end[i:j] - low)
        i = j
    return mix(out + (end - start).astype(np.uint64))


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
