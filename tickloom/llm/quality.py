"""Quality classifier: an interpolated modified Kneser-Ney model over byte n-grams.

The model is counted on trusted documents, one for each language.  Packs send
the n-grams that they hold, with their trusted counts, to buckets; the distinct
n-grams of the corpus and their counts come out of that.  Discounts come from the
counts of counts of each order, continuation counts and contexts from grouping
the n-grams, and the probabilities of all orders from joins, lowest order first.
The packs get back the log-probability of each of their n-grams and give every
document its perplexity.  The threshold of a language is a quantile of the perplexities
of its trusted documents that were kept out of the counts; each language has its own
level of the quantile, which its rejected documents choose.

No group holds more than PART_PACKS packs' n-grams of a bucket: the packs of a bucket
are merged part by part, level by level, and answered part by part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from . import common as c

ORDER = 5
#: Stands before the first byte of a text; does not occur in UTF-8.
_START = 0xFF
#: Log-probabilities travel as steps of this size.
_STEP = 1.0 / 512
#: Buckets are 2 ** this at least; from ROOT_FROM bytes of text on they grow with its root.
LEAST_BITS, ROOT_FROM = 8, 1 << 29
#: Packs whose n-grams of a bucket meet in one group.
PART_PACKS = 512
#: Bytes of median text by which perplexities are steadied; accuracy of the quantiles.
USUAL_BYTES, _EXACT = 64, 100_000
#: Levels of the quantile that is a language's threshold.
LEVELS = tuple(x / 1000 for x in range(980, 1000, 5))
#: Kept-out documents that must lie above a quantile for it to count.
BEYOND = 2
#: Kept-out documents whose spread alone isn't trusted if they are fewer.
FEW = 20

_ENTRY = "bucket long, part long, pack_id long, lang string, codes binary, counts binary"
_ENTRY_ARROW = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("pack_id", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("counts", pa.binary())])


_normal = NormalDist().inv_cdf


def bucket_bits(n_bytes: int) -> int:
    return LEAST_BITS + max(0, math.ceil(math.log2(max(1, n_bytes) / ROOT_FROM) / 2))


def _codes(text: bytes) -> np.ndarray:
    """The n-gram that ends at each byte, as a number."""
    data = np.frombuffer(bytes([_START]) * (ORDER - 1) + text, np.uint8).astype(np.int64)
    out = np.zeros(len(text), np.int64)
    for k in range(ORDER):
        out = out << 8 | data[k : k + len(text)]
    return out


def _by_language(table: pa.Table) -> Iterator[tuple[str | None, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, rows, codes of all their texts and the place in rows of each code."""
    texts = c.texts_of(table)
    langs = table.column("lang").to_pylist()
    for lang in sorted(set(langs), key=lambda x: (x is None, x or "")):
        rows = [k for k, x in enumerate(langs) if x == lang]
        codes = [_codes(texts[k]) for k in rows]
        yield lang, np.array(rows), np.concatenate(codes), np.repeat(np.arange(len(rows)), [len(x) for x in codes])


def _bucket_of(codes: np.ndarray, bits: int) -> np.ndarray:
    """By all but the last two bytes, so that the codes of a context stay together."""
    return (c.mix((codes >> 16).astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: first all lowest bytes, then the next."""
    width = values.dtype.itemsize
    return c.squeeze(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes())


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(c.unsqueeze(raw), np.uint8).reshape(width, -1).T.copy().view(kind).reshape(-1)


def _code_bytes(codes: np.ndarray) -> bytes:
    """Rising codes compressed: each context (all but the last two bytes) once, with how many codes it has, then the last two bytes of each.

    The bytes stand as they are, in planes: letters are fewer than differences.
    """
    top = codes >> 16
    first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]][: len(top)])
    more = np.diff(np.r_[first, len(codes)]) - 1  # 65,535 at most
    heads = (top[first] | more << 24).astype(np.int64)
    planes = lambda x, n: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()
    return c.squeeze(len(first).to_bytes(4, "little") + planes(heads, 5) + planes(codes, 2))


def _read_codes(raw: bytes) -> np.ndarray:
    raw = c.unsqueeze(raw)
    n = int.from_bytes(raw[:4], "little")
    heads = np.zeros((n, 8), np.uint8)
    heads[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 4).reshape(5, n).T
    heads = heads.view(np.int64).reshape(-1)
    last = np.frombuffer(raw, np.uint8, offset=4 + 5 * n).reshape(2, -1).astype(np.int64)
    return np.repeat(heads & 0xFFFFFF, (heads >> 24) + 1) << 16 | last[1] << 8 | last[0]


def _in_buckets(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sorted codes by bucket, the buckets, and where each starts."""
    bucket = _bucket_of(codes, bits)
    order = np.argsort(bucket, kind="stable")
    buckets, at = np.unique(bucket[order], return_index=True)
    return order, buckets, np.r_[at, len(codes)]


def _trusted_rows(row: dict, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[c.chosen_rows(row["trusted"])] = True
    return out


def _entry_rows(buckets: np.ndarray, at: np.ndarray, pack_id: int, part: int, lang: str | None, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of codes that stand by bucket, rising in each, from at[k] to at[k + 1]."""
    spans, n = list(zip(at, at[1:], strict=False)), len(buckets)
    blobs = [pa.array([_code_bytes(codes[i:j]) for i, j in spans], pa.binary()), pa.array([_planes(counts[i:j]) for i, j in spans], pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([pack_id] * n, pa.int64()), pa.array([lang] * n, pa.string()), *blobs], schema=_ENTRY_ARROW)


def _entries(packs: DataFrame, trusted: DataFrame, bits: int, parts: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = c.open_pack(row["pack"])
                learn = _trusted_rows(row, table.num_rows)
                for lang, rows, codes, place in _by_language(table):
                    distinct, inverse = np.unique(codes, return_inverse=True)
                    counts = np.bincount(inverse, learn[rows][place], minlength=len(distinct)).astype(np.uint32)
                    order, buckets, at = _in_buckets(distinct, bits)
                    yield _entry_rows(buckets, at, row["pack_id"], row["pack_id"] % parts, lang, distinct[order], counts[order])

    return c.with_replies(packs, {"trusted": trusted}).mapInArrow(c.tidied(send), _ENTRY)


def _merged(table: pa.Table) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """Language, distinct codes and their counts of a group of entries."""
    langs = table.column("lang").to_pylist()
    for lang in sorted(set(langs), key=lambda x: (x is None, x or "")):
        own = table.filter(pa.array([x == lang for x in langs]))
        codes = np.concatenate([_read_codes(x.as_py()) for x in own.column("codes")])
        counts = np.concatenate([_from_planes(x.as_py(), np.uint32) for x in own.column("counts")])
        distinct, inverse = np.unique(codes, return_inverse=True)
        yield lang, distinct, np.bincount(inverse, counts, minlength=len(distinct)).astype(np.int64)


def _distinct(ws: c.Workspace, entries: DataFrame, parts: int) -> DataFrame:
    """lang, bucket, gram and trusted count of every n-gram of the corpus.

    While a bucket has several parts, each is merged to one entry for each language, and
    PART_PACKS of these are the next level's part.
    """
    most = np.iinfo(np.uint32).max

    def merge(table: pa.Table) -> pa.Table:
        bucket, part = (table.column(x)[0].as_py() for x in ("bucket", "part"))
        rows = [_entry_rows(np.array([bucket]), np.array([0, len(codes)]), part, part // PART_PACKS, lang, codes, np.minimum(n, most).astype(np.uint32)) for lang, codes, n in _merged(table)]
        return pa.Table.from_batches(rows, schema=_ENTRY_ARROW)

    while parts > 1:
        entries = ws.table(entries.groupBy("bucket", "part").applyInArrow(c.tidied_groups(merge), _ENTRY), "merged")
        parts = -(-parts // PART_PACKS)

    def reduce(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out = [pa.table({"lang": pa.array([lang] * len(codes), pa.string()), "bucket": np.full(len(codes), bucket), "gram": codes, "n": n}) for lang, codes, n in _merged(table)]
        return pa.concat_tables(out)

    # one part is left; entries stand by bucket and part, so this moves nothing where there is no more than one
    return entries.groupBy("bucket", "part").applyInArrow(c.tidied_groups(reduce), "lang string, bucket long, gram long, n long")


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the modified Kneser-Ney discounts from the counts of counts."""
    of = [F.sum((F.col("n") == k).cast("double")).alias(f"c{k}") for k in (1, 2, 3, 4)]
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    # a count of counts may be 0 in small data; the discount then is what keeps it in bounds
    bounded = lambda k: F.greatest(F.lit(0.05), F.least(F.lit(float(k)), F.coalesce(F.when(F.col(f"c{k}") > 0, k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")), F.lit(0.5 * k))))
    return counts.filter("n > 0").groupBy("lang").agg(*of).select("lang", *(bounded(k).alias(f"d{k}") for k in (1, 2, 3)))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _probabilities(ws: c.Workspace, grams: DataFrame) -> DataFrame:
    """lang, bucket, gram and step (of minus the log-probability of the last byte after the others) of every n-gram of the corpus.

    Orders from 1 on: p(w | h) = (n(hw) - D(n)) / n(h) + g(h) p(w | h'), where n
    counts occurrences for the highest order and, below it, the bytes seen before.
    """
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        counts[k] = ws.table(counts[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n")), f"counts_{k}")
    below: DataFrame | None = None
    for k in range(1, ORDER + 1):
        kept = ["bucket"] if k == ORDER else []
        own = counts[k].select("lang", "gram", "n", *kept).withColumn("context", F.shiftright("gram", 8))
        own = own.join(F.broadcast(_discounts(counts[k]).withColumnRenamed("lang", "_lang")), _same("lang", "_lang"), "left").drop("_lang")  # a row for each language
        taken = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).when(F.col("n") == 1, F.col("d1")).otherwise(0.0)
        contexts = own.groupBy(F.col("lang").alias("_lang"), F.col("context").alias("_context")).agg(F.sum("n").alias("all"), F.sum(taken).alias("freed"))
        own = own.withColumn("taken", taken).join(contexts, _same("lang", "_lang") & (F.col("context") == F.col("_context"))).drop("_lang", "_context")
        if below is None:
            own = own.withColumn("low", F.lit(1.0 / 256))
        else:
            last = below.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("low"))
            own = own.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(last, _same("lang", "_lang") & (F.col("short") == F.col("_gram"))).drop("_lang", "_gram", "short")
        p = F.when(F.col("all") > 0, (F.col("n") - F.col("taken")) / F.col("all") + F.col("freed") / F.col("all") * F.col("low")).otherwise(F.col("low"))
        # what leaves the highest order is what the packs will be told
        told = p.alias("p") if k < ORDER else F.least(F.lit(65535.0), F.round(-F.log(p) / _STEP)).cast("int").alias("step")
        below = ws.table(own.select("lang", "gram", told, *kept), f"model_{k}")
    return below


def _perplexities(packs: DataFrame, entries: DataFrame, model: DataFrame, bits: int, parts: int) -> DataFrame:
    """pack_id, row, doc_id, lang, n_bytes, perplexity of every document."""

    def told(table: pa.Table) -> pa.Table:
        """The model of a bucket, a row for each language: its n-grams in order, and their steps."""
        langs, grams = table.column("lang").to_pylist(), table.column("gram").to_numpy()
        steps = table.column("step").to_numpy().astype(np.uint16)
        out: dict[str, list] = {"lang": [], "grams": [], "steps": []}
        for lang in set(langs):
            own = np.flatnonzero(np.array([x == lang for x in langs]))
            own = own[np.argsort(grams[own])]
            for name, value in (("lang", lang), ("grams", _code_bytes(grams[own])), ("steps", _planes(steps[own]))):
                out[name].append(value)
        return pa.table({"bucket": [table.column("bucket")[0].as_py()] * len(out["lang"]), **out}, schema=pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("grams", pa.binary()), ("steps", pa.binary())]))

    def answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        of = {row["lang"]: (_read_codes(row["grams"]), _from_planes(row["steps"], np.uint16)) for row in known.to_pylist()}
        masks = []
        for raw, lang in zip(asked.column("codes"), asked.column("lang").to_pylist(), strict=True):
            have, step = of[lang]
            masks.append(_planes(step[np.searchsorted(have, _read_codes(raw.as_py()))]))
        return pa.table({"bucket": asked.column("bucket"), "pack_id": asked.column("pack_id"), "lang": asked.column("lang"), "mask": pa.array(masks, pa.binary())})

    cells = model.select("lang", "bucket", "gram", "step").groupBy("bucket").applyInArrow(c.tidied_groups(told), "bucket long, lang string, grams binary, steps binary")
    # every part of a bucket meets the bucket's model
    cells = cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    replies = entries.select("bucket", "part", "pack_id", "lang", "codes").groupBy("bucket", "part").cogroup(cells.groupBy("bucket", "part")).applyInArrow(c.tidied_cogroups(answer), "bucket long, pack_id long, lang string, mask binary")
    by_pack = replies.groupBy("pack_id").agg(F.collect_list(F.struct("lang", "bucket", "mask")).alias("steps"))
    asked = packs.select("pack_id", "pack").join(by_pack.hint("shuffle_hash"), "pack_id", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = c.open_pack(row["pack"])
                n_bytes, total = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows)
                steps = {(x["lang"], x["bucket"]): x["mask"] for x in row["steps"] or ()}
                for lang, rows, codes, place in _by_language(table):
                    distinct, inverse = np.unique(codes, return_inverse=True)
                    order, buckets, _ = _in_buckets(distinct, bits)
                    value = np.empty(len(distinct))
                    if len(distinct):
                        value[order] = np.concatenate([_from_planes(steps[lang, b], np.uint16) for b in buckets.tolist()])
                    total[rows] = np.bincount(place, value[inverse], minlength=len(rows)) * _STEP
                    n_bytes[rows] = np.bincount(place, minlength=len(rows))
                with np.errstate(divide="ignore", invalid="ignore"):
                    perplexity = np.exp(total / n_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([row["pack_id"]] * table.num_rows, pa.int64()), pa.array(np.arange(table.num_rows)), table.column("doc_id").combine_chunks(), table.column("lang").combine_chunks(), pa.array(n_bytes), pa.array(perplexity, mask=n_bytes == 0)], names=["pack_id", "row", "doc_id", "lang", "n_bytes", "perplexity"])

    return asked.mapInArrow(c.tidied(score), "pack_id long, row long, doc_id long, lang string, n_bytes long, perplexity double")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """Perplexity of every document under the trusted text of its language, and whether it passes.

    docs needs doc_id, text and lang; labels doc_id, quality and toxic; other columns
    are left out, whatever their names.  Trusted are the documents that all their
    labels call quality 1 and none toxic.  One in `held_out` of them, by a hash of
    doc_id, isn't counted; the threshold of its language is a quantile of the steadied
    perplexities of these.  Of LEVELS that one is the language's where the share of
    kept-out documents above it and the share of rejected documents (quality 0 or toxic
    by some label) up to it add up to least, the highest of equal ones; a document as
    perplexing as the threshold passes.  Steadied: as if USUAL_BYTES of median text stood
    beside the document's own.  A quantile above which fewer than BEYOND kept-out
    documents lie would be the worst of them; it is estimated instead from the 0.5 and
    0.9 quantiles, as if the losses were normal, with the spread of all languages
    together, if that is larger, where fewer than FEW documents are kept out.

    In a language of whose trusted documents the hash keeps out none, or all, every
    second one is kept out.  Only a language with a single trusted document, or none, has
    no threshold, and all its documents pass; so have all languages if there are fewer
    than `held_out` trusted documents altogether.

    Null lang is a language of its own.  Null and empty texts have null
    perplexity and don't pass.  Rows that share a doc_id share its labels; labels
    without a document and null doc_ids in labels count for nothing; an empty table
    gives no rows.  Without any trusted text every probability is 1 / 256.

    Returns pack_id, row (where the document is kept), doc_id, lang, n_bytes,
    perplexity, steady, threshold, level, passes.
    """
    ws = c.Workspace(spark)
    return _scores(ws, c.pack_documents(ws, docs, keep=("lang",)), labels, held_out)


def quality_filter(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """The rows of docs that pass quality_scores(), all columns of them.  Text isn't moved for it."""
    ws = c.Workspace(spark)
    packs = c.pack_documents(ws, docs, keep=c.others(docs))
    passing = _scores(ws, packs, labels, held_out).filter("passes")
    return c.emit_rows(packs, ws.table(c.rows_by_pack(passing), "passing"), docs)


def _scores(ws: c.Workspace, packs: DataFrame, labels: DataFrame, held_out: int) -> DataFrame:
    judged = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    trusted = (F.col("quality") == 1) & (F.col("toxic") == 0)
    marked = judged.select("doc_id", F.when(trusted, F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(held_out)) == 0).alias("held"), ((F.col("quality") == 0) | (F.col("toxic") > 0)).alias("rejected"))
    lang = lambda t: {"lang": t.column("lang").combine_chunks()}
    places = ws.table(_some_held(ws.table(c.row_places(packs, "lang string", lang).join(marked.filter("held is not null or rejected"), "doc_id"), "labelled"), held_out), "places")
    learn = ws.table(c.rows_by_pack(places.filter("not held")), "learn")

    size = packs.agg(F.count("*").alias("packs"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    bits, parts = bucket_bits(size["bytes"]), max(1, -(-size["packs"] // PART_PACKS))
    entries = ws.bucketed(_entries(packs, learn, bits, parts), "ngrams", "bucket", "part", gather=True)
    grams = ws.table(_distinct(ws, entries, parts), "grams")
    model = _probabilities(ws, grams)
    scores = ws.table(_perplexities(packs, entries, model, bits, parts), "scores")
    # short texts say little: so many bytes of a usual text are added to each
    judges = ws.table(scores.filter("n_bytes > 0").join(places.filter("held or rejected").select("pack_id", "row", F.col("held").isNull().alias("rejected")), ["pack_id", "row"]).select("lang", "n_bytes", F.log("perplexity").alias("loss"), "rejected"), "judges")
    cut = _thresholds(ws, judges)
    out = scores.join(F.broadcast(cut), _same("lang", "_lang"), "left").withColumn("_loss", _steady(F.log("perplexity")))
    return out.withColumns({"steady": F.exp("_loss"), "threshold": F.exp("most"), "passes": F.coalesce(F.col("_loss") <= F.col("most"), F.col("n_bytes") > 0)}).drop("_lang", "usual", "most", "_loss")


def _steady(loss: Column) -> Column:
    return F.round((loss * F.col("n_bytes") + F.col("usual") * USUAL_BYTES) / (F.col("n_bytes") + USUAL_BYTES), 12)


def _thresholds(ws: c.Workspace, judges: DataFrame) -> DataFrame:
    """_lang, usual, level and most: the median loss of kept-out documents, the level of the quantile and the
    quantile itself; a row for each language, from judges (lang, n_bytes, loss, rejected)."""
    usual = judges.filter("not rejected").groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("loss", 0.5, _EXACT).alias("usual"))
    told = judges.join(F.broadcast(usual), _same("lang", "_lang")).withColumn("steady", _steady(F.col("loss")))  # a row for each language
    kept_out = told.filter("not rejected")
    own = kept_out.groupBy("_lang").agg(F.first("usual").alias("usual"), F.count("*").alias("n"), F.percentile_approx("steady", [0.5, 0.9, *LEVELS], _EXACT).alias("q"))
    # one row: how far all languages' kept-out documents lie from their medians
    together = kept_out.agg(F.percentile_approx(F.col("steady") - F.col("usual"), [0.5, 0.9], _EXACT).alias("all_q"))
    spread = lambda q: (F.col(q)[1] - F.col(q)[0]) / _normal(0.9)
    wide = F.when(F.col("n") < FEW, F.greatest(spread("q"), spread("all_q"))).otherwise(spread("q"))
    at = [F.when(F.col("n") * (1 - x) >= BEYOND - 1e-9, F.col("q")[k + 2]).otherwise(F.col("q")[0] + wide * _normal(x)) for k, x in enumerate(LEVELS)]
    places = ws.table(own.join(F.broadcast(together)).select("_lang", "usual", F.array(*at).alias("places")), "places")
    share = lambda wrong, of: F.coalesce(F.sum((wrong & of).cast("double")) / F.nullif(F.sum(of.cast("double")), F.lit(0.0)), F.lit(0.0))
    bad, most = F.col("rejected"), lambda k: F.col("places")[k]
    wrong = [(share(F.col("steady") > most(k), ~bad) + share(F.col("steady") <= most(k), bad)).alias(f"w{k}") for k in range(len(LEVELS))]
    shares = told.drop("usual").withColumnRenamed("_lang", "_own").join(F.broadcast(places), _same("_own", "_lang")).groupBy("_lang", "usual", "places").agg(*wrong)
    best = F.array_min(F.array(*(F.struct(F.round(F.col(f"w{k}"), 9).alias("w"), F.lit(-level).alias("level"), most(k).alias("most")) for k, level in enumerate(LEVELS))))
    return shares.select("_lang", "usual", (-best["level"]).alias("level"), best["most"].alias("most"))


def _some_held(labelled: DataFrame, held_out: int) -> DataFrame:
    """labelled with every second trusted document held in languages of whose trusted documents none or all are.

    Such languages have few of them, so one task orders a language.
    """
    trusted = labelled.filter("held is not null")
    enough = trusted.agg((F.count("*") >= held_out).alias("enough"))  # one row
    alike = trusted.groupBy(F.col("lang").alias("_lang")).agg(F.min("held").alias("a"), F.max("held").alias("b")).filter("a = b").crossJoin(F.broadcast(enough)).filter("enough").select("_lang")
    rank = F.dense_rank().over(Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id"))
    anew = trusted.join(F.broadcast(alike), _same("lang", "_lang")).select("pack_id", "row", (rank % 2 == 0).alias("_held"))
    return labelled.join(anew, ["pack_id", "row"], "left").withColumn("held", F.coalesce("_held", "held")).drop("_held", "lang")
