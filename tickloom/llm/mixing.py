"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources.  Documents of the same set of sources
form a pattern; patterns are few, so their sizes go to the driver, and a flow
from patterns to sources is found there.  Taking a pattern's words once is free,
each further time costs one more than the time before, so nothing is repeated
while fresh words are left.  What flows out of a pattern is then laid along its
documents in a seeded order: the copies that it covers are taken.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from . import common as c

Source = str | None
Pattern = tuple[Source, ...]

#: Documents that one bucket of a pattern's seeded order should get.
BUCKET_DOCS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[Source, int], weights: Sequence[float], share: float, most: float) -> dict[Source, float]:
    """Words wanted of each source: share of all sizes, dealt by weight, at most `most` times its size.

    Sources stand by code point, null last, and take the weights in turn.  What a
    source can't take is dealt to the others again, until none is above its bound.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in above:
            out[s] = most * float(sizes[s])
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return {s: out[s] for s in names}


def route(sizes: dict[Pattern, int], quotas: dict[Source, float], repeats: int) -> dict[tuple[Pattern, Source], int]:
    """Min-cost flow from patterns to sources.

    Pattern p offers its size `repeats` times, the k-th time at cost k - 1 a word;
    source s wants quotas[s], rounded to whole words.  All rooms are whole numbers, so
    the flow is exact and the least source is served as the largest is.  Successive shortest paths with Dijkstra over reduced
    costs; each path saturates an edge, so there are few.
    """
    patterns, sources = list(sizes), list(quotas)
    start, end = 0, 1 + len(patterns) + len(sources)
    place = {s: 1 + len(patterns) + k for k, s in enumerate(sources)}
    edges: list[list[float]] = []  # to, room, cost, and the edge back is the next or the one before
    at: list[list[int]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, room: float, cost: float) -> None:
        at[a].append(len(edges))
        edges.append([b, room, cost])
        at[b].append(len(edges))
        edges.append([a, 0, -cost])

    for k, p in enumerate(patterns):
        for time in range(repeats):
            edge(start, 1 + k, sizes[p], float(time))
        for s in p:
            if s in place:
                edge(1 + k, place[s], math.inf, 0.0)
    for s in sources:
        edge(place[s], end, round(quotas[s]), 0.0)
    height = [0.0] * (end + 1)
    while True:
        far, by, queue = [math.inf] * (end + 1), [-1] * (end + 1), [(0.0, start)]
        far[start] = 0.0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in at[a]:
                b, room, cost = int(edges[e][0]), edges[e][1], edges[e][2]
                step = d + cost + height[a] - height[b]
                if room > 0 and step < far[b] - 1e-12:
                    far[b], by[b] = step, e
                    heapq.heappush(queue, (step, b))
        if far[end] == math.inf:
            break
        height = [h + f if f < math.inf else h for h, f in zip(height, far, strict=True)]
        path, b = [], end
        while b != start:
            path.append(by[b])
            b = int(edges[by[b] ^ 1][0])
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    out: dict[tuple[Pattern, Source], int] = {}
    back = {v: s for s, v in place.items()}
    for k, p in enumerate(patterns):
        for e in at[1 + k]:
            if e % 2 == 0 and int(edges[e][0]) in back and edges[e ^ 1][1] > 0:
                out[p, back[int(edges[e][0])]] = edges[e ^ 1][1]
    return out


def mix(spark: SparkSession, docs: DataFrame, sources: Column, size: Column, weights: Sequence[float], share: float = 1.5, repeats: int = 2, seed: int = 0, cut: bool = True) -> DataFrame:
    """What a mix takes of each document.

    docs needs doc_id; `sources` gives the array of a document's sources (null and
    empty: the one source null) and `size` its words.  Other columns of docs stay,
    unless they are called like an added one, which then takes their place.  The size of
    a source is that of all documents that belong to it; targets() says what is wanted
    of each.

    Adds pattern, size, taken (words taken, repeats counted) and taken_by (array of
    struct<source, words>, what each source gets of the document) and about (array of
    struct<source, size, target>, its sources in order).  With cut, the last
    document of a share is taken in part, so sources meet their targets to a word if
    the flow does; without, documents are taken whole, whichever is nearer.  No
    document is taken more than `repeats` times.  The seeded order is by a hash of
    seed and doc_id, then doc_id and size: reruns agree, and rows that tie in all of
    these are alike.  Documents of size 0 are never taken; an empty table gives no
    rows.

    A pattern's order is cut into buckets by the leading bits of the hash, so a
    source that holds most rows is summed and ordered in many tasks.
    """
    ws = c.Workspace(spark)
    named = F.when(F.size(F.coalesce(sources, F.array())) > 0, F.array_sort(F.array_distinct(sources))).otherwise(F.array(F.lit(None).cast("string")))
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_doc"), F.col("doc_id"), F.to_json(named).alias("pattern"), size.cast("long").alias("size"), named.alias("_members"))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id"))
    n = rows.count()
    bits = max(8, math.ceil(math.log2(max(1, n / BUCKET_DOCS))))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_order", 64 - bits))
    buckets = ws.table(rows.groupBy("pattern", "_members", "_bucket").agg(F.sum("size").alias("words")), "buckets")

    found = buckets.groupBy("pattern", "_members").agg(F.sum("words").alias("words")).collect()  # one row a pattern
    key = {tuple(r["_members"]): r["pattern"] for r in found}
    sizes: dict[Pattern, int] = {tuple(r["_members"]): r["words"] for r in found}
    by_source: dict[Source, int] = {}
    for p, words in sizes.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + words
    wanted = targets(by_source, weights, share, repeats)
    flow = route(sizes, wanted, repeats)

    shares = []
    for p in sizes:
        at, parts = 0, []
        for s in p:
            if (p, s) in flow:
                parts.append((s, at, at + flow[p, s]))
                at += flow[p, s]
        members = [(s, by_source[s], wanted[s]) for s in p]
        shares.append((key[p], sizes[p], at, parts, members))
    schema = "pattern string, pattern_size long, flow long, parts array<struct<source:string,start:long,stop:long>>, about array<struct<source:string,size:long,target:double>>"
    table = spark.createDataFrame(shares, schema) if shares else spark.createDataFrame([], schema)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = ws.table(buckets.withColumn("_before", before).select("pattern", "_bucket", "_before").join(table, "pattern"), "places")

    inside = F.coalesce(F.sum("size").over(Window.partitionBy("pattern", "_bucket").orderBy("_order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_inside", inside).join(places, ["pattern", "_bucket"])
    rows = rows.withColumn("_at", F.col("_before") + F.col("_inside"))
    zero = F.lit(0).cast("long")

    def overlap(start: Column, stop: Column) -> Column:
        """Words between start and stop of the line on which the pattern's documents stand, one round after another."""
        out = zero
        for time in range(repeats):
            begin = F.col("_at") + F.col("pattern_size") * time
            if cut:
                out = out + F.greatest(zero, F.least(stop, begin + F.col("size")) - F.greatest(start, begin))
            else:
                middle = begin * 2 + F.col("size")
                out = out + F.when((middle > start * 2) & (middle <= stop * 2), F.col("size")).otherwise(zero)
        return out

    # in whole documents, the middle decides, so that parts that adjoin never share one
    by = F.filter(F.transform("parts", lambda p: F.struct(p["source"].alias("source"), overlap(p["start"], p["stop"]).alias("words"))), lambda p: p["words"] > 0)
    rows = rows.withColumns({"taken": overlap(zero, F.col("flow")), "taken_by": by})
    added = ["pattern", "size", "taken", "taken_by", "about"]
    return rows.select(*[F.col(f"_doc.`{x}`") for x in docs.columns if x not in added], *added)


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: Sequence[float], share: float = 1.5, repeats: int = 2, seed: int = 0) -> DataFrame:
    """The rows of docs that mix() takes, whole and as often as it takes them; needs source besides doc_id and text.

    Sizes are numbers of words.  Text isn't moved for it.
    """
    ws = c.Workspace(spark)
    packs = c.pack_documents(ws, docs, keep=c.others(docs))

    def sizes(table: pa.Table) -> dict[str, pa.Array]:
        return {"source": table.column("source").combine_chunks(), "words": pa.array([len(t.split()) for t in c.texts_of(table)], pa.int64())}

    rows = ws.table(c.row_places(packs, "source string, words long", sizes), "sizes")
    mixed = mix(spark, rows, F.array("source"), F.col("words"), weights, share, repeats, seed, cut=False)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    chosen = mixed.select("pack_id", "row", F.explode(F.array_repeat(F.lit(0), times)))
    return c.emit_rows(packs, ws.table(c.rows_by_pack(chosen), "chosen"), docs)
