"""Nearest vectors by inner product: exact over kd-trees, and approximate over projections.

Vectors are dealt to shards of bounded size by where they lie: median splits of a
sample cut space into leaves, and a leaf of too many vectors is cut again by a hash.
Each shard is one tree, and the box around it stands in a small table.  Queries go in
blocks of neighbours: a block first searches a shard of its own leaf, and the worst
score it has then for each query decides which boxes can hold anything better; only
there the query goes.  Results come together in a tree of merges.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as c
from .kdtree import KdTree

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 4096, 512, 128
#: In the projected trees; their points are cheap to look at, and a step has its price.
FLAT_LEAF_ROWS = 512
#: Vectors (about) whose medians split space; vectors of the sample that a leaf must have.
SAMPLE_ROWS, SAMPLE_A_LEAF = 1 << 14, 16
#: Boxes that are looked at together, and results that are merged together.
PAGE_BOXES, MERGED = 1024, 64
RESULT = "query_id long, rank int, vec_id long, score {score}"


def usable(vector: Column, allow_zero: bool) -> Column:
    """Whether a vector takes part: neither null nor empty, all components finite (and not all zero)."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    out = F.coalesce((F.size(vector) > 0) & good, F.lit(False))
    return out if allow_zero else out & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as rows."""
    flat = pa.concat_arrays([x.flatten() for x in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(raw), allow_pickle=False))


class Top:
    """The k best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, floor: float = -math.inf):
        self.k, self.floor = k, floor
        self.score, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def kth(self) -> float:
        """A score below this can't enter."""
        return max(self.floor, self.score[-1]) if len(self.score) == self.k else self.floor

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.kth()
        if not good.any():
            return
        score, ids = np.r_[self.score, score[good]], np.r_[self.ids, ids[good]]
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[best], ids[best]


class Method(NamedTuple):
    """How vectors are indexed and searched."""

    #: flat(vectors): where they lie in the space of the trees
    flat: Callable[[np.ndarray], np.ndarray]
    #: build(vectors, ids): a tree with what search needs
    build: Callable[[np.ndarray, np.ndarray], bytes]
    #: search(tree, its data, queries, their ids, scores so far, k): a Top for each query
    search: Callable[[KdTree, dict, np.ndarray, np.ndarray, np.ndarray, int], list[Top]]
    #: beats(queries, scores so far, low and high corners of boxes): which boxes (columns) may improve which queries (rows)
    beats: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Splits:
    """Median splits of a sample, as a complete binary tree in heap order."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        own = {1: points}
        for k in range(1, 1 << depth):
            x = own.pop(k)
            self.axis[k] = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
            along = x[:, self.axis[k]]
            self.cut[k] = np.median(along) if len(x) else 0.0
            own[2 * k], own[2 * k + 1] = x[along <= self.cut[k]], x[along > self.cut[k]]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - (1 << self.depth)


#: A leaf's or block's number stands above these bits, the part of it below.
_PART = 20
_FOUND = "dim int, block long, shard long, found binary"


def _found_row(dim: int, block: int, shard: int, of: np.ndarray, tops: list[Top]) -> dict:
    n = [len(t.score) for t in tops]
    blob = _pack(of=np.repeat(of, n), score=np.concatenate([t.score for t in tops]), ids=np.concatenate([t.ids for t in tops])) if tops else _pack(of=np.zeros(0, np.int64), score=np.zeros(0), ids=np.zeros(0, np.int64))
    return {"dim": [dim], "block": [block], "shard": [shard], "found": [blob]}


def _tops(column: pa.ChunkedArray, k: int) -> dict[int, Top]:
    out: dict[int, Top] = {}
    for raw in column:
        f = _unpack(raw.as_py())
        order = np.argsort(f["of"], kind="stable")
        kinds, at = np.unique(f["of"][order], return_index=True)
        for of, own in zip(kinds.tolist(), np.split(order, at[1:]), strict=True) if len(kinds) else ():
            out.setdefault(of, Top(k)).offer(f["score"][own], f["ids"][own])
    return out


def _search_all(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int, method_of: Callable[[int], Method], kind: str) -> DataFrame:
    """vectors: vec_id, vector (array<double>, usable).  Returns query_id, rank, vec_id, score."""
    ws = c.Workspace(spark)
    rows = ws.table(vectors.select("vec_id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    counts = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).collect()}
    counts = {d: x for d, x in counts.items() if x[1]}  # vectors of a length that no query has can't be compared
    if not counts:
        return spark.createDataFrame([], RESULT.format(score=kind))
    used = rows.filter(F.col("dim").isin(*counts))

    def per_dim(values: dict[int, int]) -> Column:
        out = F.lit(1)
        for d, v in values.items():
            out = F.when(F.col("dim") == d, F.lit(v)).otherwise(out)
        return out

    # the sample shapes the shards and decides nothing else
    depth = {d: max(0, min(math.ceil(math.log2(n / SHARD_ROWS)), int(math.log2(SAMPLE_ROWS / SAMPLE_A_LEAF)))) for d, (n, _) in counts.items()}
    points: dict[int, list] = {d: [] for d in counts}
    if any(depth.values()):
        every = per_dim({d: math.ceil(n / SAMPLE_ROWS) for d, (n, _) in counts.items()})
        some = used.filter(F.col("dim").isin(*[d for d in depth if depth[d]])).filter(F.pmod(F.xxhash64("vector"), every) == 0).select("dim", "vector").limit(2 * SAMPLE_ROWS)
        for r in some.collect():
            points[r["dim"]].append(r["vector"])
    splits = {d: Splits(method_of(d).flat(np.array(points[d], float).reshape(-1, d)), depth[d]) for d in counts}
    # leaves that make a block: as many as have BLOCK_ROWS queries among them
    shift = {d: max(0, min(depth[d], round(math.log2(BLOCK_ROWS * (1 << depth[d]) / q)))) for d, (_, q) in counts.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, leaf = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                leaf[own] = splits[d].leaf(method_of(int(d)).flat(_matrix(pa.chunked_array([batch.column("vector").take(pa.array(own))]))))
            yield batch.append_column("leaf", pa.array(leaf))

    placed = ws.table(used.mapInArrow(c.tidied(place), "vec_id long, vector array<double>, dim int, asks boolean, leaf long"), "placed")
    placed = placed.withColumn("region", F.expr("CASE dim " + " ".join(f"WHEN {d} THEN shiftright(leaf, {x})" for d, x in shift.items()) + " END"))

    def cut(df: DataFrame, by: str, most: int, name: str) -> DataFrame:
        """df with name: its `by`, cut by a hash where more than `most` rows have it."""
        sizes = df.groupBy("dim", by).agg(F.ceil(F.count("*") / most).alias("_parts"))
        part = F.pmod(F.xxhash64("vec_id", "vector"), F.col("_parts"))
        return df.join(sizes, ["dim", by]).withColumn(name, F.shiftleft(by, _PART) + part).drop("_parts")

    def plant(table: pa.Table) -> pa.Table:
        ids = c.pc.fill_null(table.column("vec_id"), int(c.LAST_ID)).to_numpy()
        dim, raw = table.column("dim")[0].as_py(), method_of(table.column("dim")[0].as_py()).build(_matrix(table.column("vector")), ids)
        tree, _ = KdTree.load(raw)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": [table.column("shard")[0].as_py()], "region": [table.column("region")[0].as_py()], "box": [_pack(low=tree.low[0], high=tree.high[0])], "tree": pa.array([raw], pa.binary())})

    trees = ws.table(cut(placed, "leaf", SHARD_ROWS, "shard").groupBy("dim", "shard").applyInArrow(c.tidied_groups(plant), "dim int, shard long, region long, box binary, tree binary"), "trees")
    shards = {r["dim"]: r["n"] for r in trees.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    def gather(table: pa.Table) -> pa.Table:
        ids, matrix = table.column("vec_id").to_numpy(), _matrix(table.column("vector"))
        order = np.lexsort((*matrix.T[::-1], ids))
        raw = _pack(of=np.arange(len(ids)), ids=ids[order], queries=matrix[order], floor=np.full(len(ids), -math.inf))
        return pa.table({"dim": pa.array([table.column("dim")[0].as_py()], pa.int32()), "block": [table.column("block")[0].as_py()], "region": [table.column("region")[0].as_py()], "queries": pa.array([raw], pa.binary())})

    asked = cut(placed.filter("asks"), "region", BLOCK_ROWS, "block").groupBy("dim", "block").applyInArrow(c.tidied_groups(gather), "dim int, block long, region long, queries binary")
    home = trees.groupBy("dim", "region").agg(F.min("shard").alias("shard"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = _unpack(row["queries"])
                tops = method_of(row["dim"]).search(*KdTree.load(row["tree"]), q["queries"], q["ids"], q["floor"], k)
                q["floor"] = np.array([t.kth() for t in tops])
                yield pa.RecordBatch.from_pydict(_found_row(row["dim"], row["block"], row["shard"], q["of"], tops) | {"queries": [_pack(**q)]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("found", pa.binary()), ("queries", pa.binary())]))

    one = asked.join(home, ["dim", "region"]).join(trees.drop("region", "box"), ["dim", "shard"])
    start = ws.table(one.mapInArrow(c.tidied(first), f"{_FOUND}, queries binary"), "first")

    def page(table: pa.Table) -> pa.Table:
        boxes = [_unpack(x.as_py()) for x in table.column("box")]
        raw = _pack(shard=table.column("shard").to_numpy(), low=np.array([b["low"] for b in boxes]), high=np.array([b["high"] for b in boxes]))
        return pa.table({"dim": pa.array([table.column("dim")[0].as_py()], pa.int32()), "boxes": pa.array([raw], pa.binary())})

    pages = trees.select("dim", "shard", "box").withColumn("page", F.pmod(F.xxhash64("shard"), per_dim({d: math.ceil(n / PAGE_BOXES) for d, n in shards.items()})))
    pages = pages.groupBy("dim", "page").applyInArrow(c.tidied_groups(page), "dim int, boxes binary")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block and page of boxes: the shards to search, with the queries they may improve."""
        for batch in batches:
            for row in batch.to_pylist():
                q, boxes = _unpack(row["queries"]), _unpack(row["boxes"])
                better = method_of(row["dim"]).beats(q["queries"], q["floor"], boxes["low"], boxes["high"])
                for at in np.flatnonzero(better.any(axis=0) & (boxes["shard"] != row["shard"])):
                    some = {name: x[better[:, at]] for name, x in q.items()}
                    yield pa.RecordBatch.from_pydict({"dim": [row["dim"]], "block": [row["block"]], "shard": [int(boxes["shard"][at])], "queries": [_pack(**some)]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("queries", pa.binary())]))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = _unpack(row["queries"])
                tops = method_of(row["dim"]).search(*KdTree.load(row["tree"]), q["queries"], q["ids"], q["floor"], k)
                yield pa.RecordBatch.from_pydict(_found_row(row["dim"], row["block"], row["shard"], q["of"], tops), schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("found", pa.binary())]))

    # every block meets every page of boxes, which are few
    routed = start.select("dim", "block", "shard", "queries").join(pages, "dim").mapInArrow(c.tidied(route), "dim int, block long, shard long, queries binary")
    ended = ws.table(routed.join(trees.drop("region", "box"), ["dim", "shard"]).mapInArrow(c.tidied(rest), _FOUND), "rest")
    found = start.select("dim", "block", "shard", "found").unionByName(ended)

    def merge(table: pa.Table) -> pa.Table:
        tops = _tops(table.column("found"), k)
        dim, block, part = (table.column(x)[0].as_py() for x in ("dim", "block", "part"))
        row = _found_row(dim, block, part, np.array(list(tops), np.int64), list(tops.values()))
        return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("found", pa.binary())]))

    parts = math.ceil(max(shards.values()) / MERGED)
    while parts > 1:
        found = ws.table(found.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts))).groupBy("dim", "block", "part").applyInArrow(c.tidied_groups(merge), _FOUND), "merged")
        parts = math.ceil(parts / MERGED)

    def finish(key, table: pa.Table, asks: pa.Table) -> pa.Table:
        ids = _unpack(asks.column("queries")[0].as_py())["ids"]
        out: dict[str, list] = {"query_id": [], "rank": [], "vec_id": [], "score": []}
        for of, top in sorted(_tops(table.column("found"), k).items()):
            out["query_id"] += [int(ids[of])] * len(top.ids)
            out["rank"] += range(1, len(top.ids) + 1)
            out["vec_id"] += [None if x == c.LAST_ID else int(x) for x in top.ids]
            out["score"] += [int(x) for x in top.score] if kind == "long" else top.score.tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64() if kind == "long" else pa.float64())]))

    told = start.select(F.col("dim").alias("_dim"), F.col("block").alias("_block"), "queries")
    return found.groupBy("dim", "block").cogroup(told.groupBy("_dim", "_block")).applyInArrow(c.tidied_cogroups(finish), RESULT.format(score=kind))


def exact_top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The k vectors of largest integer inner product for each query, exactly.

    vectors needs vec_id and vector; other columns are left out, whatever their names.
    Components become floor(scale * x).  Rows whose is_query holds are the queries; a
    query's candidates are all rows of another vec_id and the same length.  Vectors
    that are null or empty or hold a null or non-finite component take no part.  Ties
    go to the smaller vec_id, null last; repeated rows are candidates and queries of
    their own, but a vec_id stands for one vector, so rows of the query's own vec_id are
    no candidates; with fewer than k candidates all are given; an empty table, and one
    without queries, gives no rows.  Fails if a squared length reaches 2 ** 53, beyond
    which scores in double precision would not be exact integers.

    Box bounds prune only where the kth score beats a whole box; a box whose bound
    equals it is still searched, for ties.
    """

    def build(matrix: np.ndarray, ids: np.ndarray) -> bytes:
        tree = KdTree.build(matrix, LEAF_ROWS)
        return tree.dump(ids=ids[tree.order])

    def search(tree: KdTree, data: dict, queries: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> list[Top]:
        reach, out = tree.inner_bounds(queries), []
        for n, query in enumerate(queries):
            top = Top(k, floor[n])
            for bound, a, b in tree.best_first(reach[n]):
                if bound < top.kth():
                    break
                own = data["ids"][a:b]
                score = tree.points[a:b] @ query
                other = own != ids[n]
                top.offer(score[other], own[other])
            out.append(top)
        return out

    def beats(queries: np.ndarray, floor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T >= floor[:, None]

    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").filter(usable(F.col("vector"), True))
    whole = good.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    squares = whole.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    if squares >= 2**53:
        raise ValueError("vectors are too long: an inner product may reach 2 ** 53, where doubles are no longer exact")
    return _search_all(spark, whole, is_query, k, lambda _: Method(lambda x: x, build, search, beats), "long")


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number m of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for j in range(1, m // 2):
        term *= half / j
        total += term
    return 1.0 - math.exp(-half) * total


def approximate_top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 20, dims: int = 8, sure: float = 0.95, seed: int = 9) -> DataFrame:
    """About the k vectors of largest inner product for each query.

    vectors as for exact_top_k; all-zero vectors take no part either.  A coordinate
    is added that gives all vectors one norm, which turns the largest inner product
    into the least distance; the result is projected to `dims` (even) numbers by a
    Gaussian, hence 2-stable, matrix and indexed by a kd-tree.  The squared projected
    distance over the squared true one is chi-square with `dims` degrees of freedom.
    Points are verified on the original vectors by growing projected distance, until
    a point nearer than the kth found would have come up with probability `sure`.  No
    cap on the points verified.

    score is the inner product of the original vectors in double precision.  Ties,
    repeated rows and few candidates as for exact_top_k.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).filter(usable(F.col("vector"), False))
    largest = good.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0

    def method(d: int) -> Method:
        matrix = np.random.default_rng([seed, d]).standard_normal((d + 1, dims))

        def flat(vectors: np.ndarray) -> np.ndarray:
            return np.c_[vectors, np.sqrt(np.maximum(0, largest - (vectors * vectors).sum(axis=1)))] @ matrix

        def asked(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Queries, which get 0 as their added coordinate, in the projected space, and their squared lengths."""
            return np.c_[queries, np.zeros(len(queries))] @ matrix, (queries * queries).sum(axis=1)

        def build(vectors: np.ndarray, ids: np.ndarray) -> bytes:
            tree = KdTree.build(flat(vectors), FLAT_LEAF_ROWS)
            return tree.dump(ids=ids[tree.order], vectors=vectors[tree.order])

        def enough(near: float, kth: float, norm: float) -> bool:
            """Whether a point nearer than the kth would have come up before this squared projected distance."""
            return kth > -math.inf and chi_square_cdf(near / max(largest + norm - 2 * kth, 1e-300), dims) >= sure

        def beats(queries: np.ndarray, floor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            at, norm = asked(queries)
            out = np.zeros((len(queries), len(low)), bool)
            for n in range(len(queries)):
                gap = np.maximum(0, np.maximum(low - at[n], at[n] - high))
                # the test gives way at one distance, found by halving
                near = (gap * gap).sum(axis=1)
                order = np.argsort(near)
                a, b = 0, len(order)
                while a < b:
                    middle = (a + b) // 2
                    a, b = (a, middle) if enough(near[order[middle]], floor[n], norm[n]) else (middle + 1, b)
                out[n, order[:a]] = True
            return out

        def search(tree: KdTree, data: dict, queries: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> list[Top]:
            at, norm = asked(queries)
            out = []
            for n, query in enumerate(queries):
                top = Top(k, floor[n])
                held_far, held_row = np.zeros(0), np.zeros(0, np.int64)
                for reach, a, b in tree.best_first(-tree.distance_bounds(at[n])):
                    # all points nearer than this box have come up; verify them before asking whether to stop
                    ready = held_far < -reach
                    if ready.any():
                        _verify(top, data, held_row[ready], query, ids[n])
                        held_far, held_row = held_far[~ready], held_row[~ready]
                    if enough(-reach, top.kth(), norm[n]):
                        held_row = held_row[:0]
                        break
                    gap = tree.points[a:b] - at[n]
                    held_far, held_row = np.r_[held_far, (gap * gap).sum(axis=1)], np.r_[held_row, np.arange(a, b)]
                _verify(top, data, held_row, query, ids[n])
                out.append(top)
            return out

        return Method(flat, build, search, beats)

    return _search_all(spark, good, is_query, k, method, "double")


def _verify(top: Top, data: dict, rows: np.ndarray, query: np.ndarray, own: int) -> None:
    vectors = data["vectors"][rows]
    rough, kth = vectors @ query, top.kth()
    near = (rough >= kth - 1e-9 * max(1.0, abs(kth)) if kth > -math.inf else np.ones(len(rows), bool)) & (data["ids"][rows] != own)
    if not near.any():
        return
    rows, vectors = rows[near], vectors[near]
    # summed row by row, so that equal vectors get equal scores wherever they stand
    top.offer((vectors * query).sum(axis=1), data["ids"][rows])
