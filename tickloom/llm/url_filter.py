"""URL filter: rules first, then a ratio of two character models, in DataFrame functions only.

Accepted and rejected URLs are those that the rules decide.  For each of the two
a variable-order Markov model over the characters is counted (contexts of two
characters, one and none, interpolated after Witten and Bell, so that a context
seen in few ways gives more weight to the shorter one).  A URL that no rule
fits is judged by the mean difference of its log-likelihoods over its characters,
against a threshold set on URLs kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as c


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that the models tell apart: letters, one for all digits, URL signs, one for the rest, start and end.
LETTERS = _LOWER + "0" + "./:?=&_#%-" + "*" + "^$"
ALPHABET = len(LETTERS)
#: A character's number travels as the character so many places on from this one.
_ZERO = 48
#: Of 16 parts of the decided URLs, by the first hexadecimal digit of their MD5, those kept out for the threshold.
HELD_OUT = ("d", "e", "f")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _codes(url: Column) -> Column:
    """The numbers of the URL's characters in the models' alphabet, between two start signs and an end sign."""
    low = F.regexp_replace(F.translate(url, _UPPER, _LOWER), "[0-9]", "0")
    known = F.concat(F.lit("^^"), F.regexp_replace(low, r"[^a-z0./:?=&_#%\-]", "*"), F.lit("$"))
    numbered = F.translate(known, LETTERS, "".join(chr(_ZERO + k) for k in range(ALPHABET)))
    return F.transform(F.split(numbered, ""), lambda x: F.ascii(x) - _ZERO)


def _gram(codes: Column, i: Column) -> Column:
    """The number of the trigram at place i (from 0); the last character counts least."""
    return (F.get(codes, i) * ALPHABET + F.get(codes, i + 1)) * ALPHABET + F.get(codes, i + 2)


def _places(codes: Column) -> Column:
    return F.sequence(F.lit(0), F.size(codes) - 3)


def _models(counts: DataFrame) -> DataFrame:
    """gram and gain of each trigram: log-likelihood of its last character as accepted minus as rejected."""

    def lower(df: DataFrame, n: int) -> DataFrame:
        return df.groupBy((F.col("gram") % ALPHABET**n).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))

    grams = {3: counts, 2: lower(counts, 2)}
    grams[1] = lower(grams[2], 1)
    out = None
    for n in (1, 2, 3):
        head = F.floor(F.col("gram") / ALPHABET)
        own = grams[n]
        context = own.groupBy(head.alias("context")).agg(*(f(F.col(k)).alias(f"{k}_{w}") for k in ("allow", "block") for w, f in (("n", F.sum), ("t", lambda x: F.sum((x > 0).cast("long"))))))
        own = own.withColumn("context", head).join(context, "context")
        if out is None:
            own = own.withColumns({"allow_low": F.lit(1.0 / ALPHABET), "block_low": F.lit(1.0 / ALPHABET)})
        else:
            own = own.withColumn("short", F.col("gram") % ALPHABET ** (n - 1)).join(out.select(F.col("gram").alias("short"), F.col("allow_p").alias("allow_low"), F.col("block_p").alias("block_low")), "short")
        p = lambda k: F.when(F.col(f"{k}_n") > 0, (F.col(k) + F.col(f"{k}_t") * F.col(f"{k}_low")) / (F.col(f"{k}_n") + F.col(f"{k}_t"))).otherwise(F.col(f"{k}_low"))
        out = own.select("gram", p("allow").alias("allow_p"), p("block").alias("block_p"))
    return out.select("gram", (F.log("allow_p") - F.log("block_p")).alias("gain"))


def url_filter(spark: SparkSession, pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """host, path, rule and verdict for each page.

    pages needs page_id and url; other columns are left out, whatever their names.
    Null and empty URLs and those without "://" have empty host and path, so that no
    rule with a host fits.  A URL without any character can't be scored and is
    blocked; so is one that scores as much as the threshold or less.  If the rules
    accept or reject nothing, there is nothing to compare, and what no rule decides is
    allowed.  Repeated rows stay and count as often as they stand; page_id may be null
    or repeated.

    Returns page_id, host, path, rule, verdict and score (null where a rule or nothing
    decides).  Pages aren't shuffled: trigrams are counted before they are exchanged,
    and the model, ALPHABET ** 3 gains at most, goes to the tasks as one array, over
    which each URL is summed in its row.  The work is linear in a URL's length.
    """
    ws = c.Workspace(spark)
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    pages = pages.withColumns({"rule": rule, "decided": verdict, "held": F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)})
    some = F.coalesce(F.length("url"), F.lit(0)) > 0

    # trigrams that occur only in URLs still to be judged count 0 in both models, and get their gain from shorter contexts
    grams = pages.filter(some).withColumn("codes", _codes(F.col("url"))).select("decided", "held", F.explode(F.transform(_places(F.col("codes")), lambda i: _gram(F.col("codes"), i))).alias("gram"))
    learn = lambda k: F.sum(((F.col("decided") == k) & ~F.col("held")).cast("long"))
    counts = ws.table(grams.groupBy("gram").agg(F.coalesce(learn("allow"), F.lit(0)).alias("allow"), F.coalesce(learn("block"), F.lit(0)).alias("block")), "grams")
    model = ws.table(_models(counts), "model")
    cells = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(ALPHABET**3 - 1))).alias("gram"))
    # one row: the gain of every trigram, 0 for those that don't occur
    table = ws.table(cells.join(F.broadcast(model), "gram", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("gram", F.coalesce("gain", F.lit(0.0)).alias("gain")))), lambda x: x["gain"]).alias("gains")), "gains").scalar()

    score = F.round(F.aggregate(_places(F.col("codes")), F.lit(0.0), lambda a, i: a + F.get(F.col("gains"), _gram(F.col("codes"), i))) / (F.size("codes") - 2), 9)
    scored = lambda df: df.withColumns({"codes": _codes(F.col("url")), "gains": table}).withColumn("score", score).drop("codes", "gains")
    threshold = ws.table(_threshold(scored(pages.filter(some & F.col("held") & F.col("decided").isNotNull()))), "threshold").scalar()
    judged = F.when(~some, "block").when(F.col("threshold").isNull(), "allow").when(F.col("score") > F.col("threshold"), "allow").otherwise("block")
    out = scored(pages).withColumn("score", F.when(some & F.col("decided").isNull(), F.col("score"))).withColumn("threshold", threshold)
    return out.select("page_id", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"), "score")


def _threshold(scored: DataFrame) -> DataFrame:
    """One row, where both kinds of kept-out URLs lie equally many standard deviations away; null if one kind is missing."""
    own = lambda k: F.when(F.col("decided") == k, F.col("score"))
    sides = scored.agg(*(f(own(k)).alias(f"{k}_{n}") for k in ("allow", "block") for n, f in (("mean", F.avg), ("square", lambda x: F.avg(x * x)))))
    sd = lambda k: F.sqrt(F.greatest(F.col(f"{k}_square") - F.col(f"{k}_mean") * F.col(f"{k}_mean"), F.lit(1e-12)))
    cut = (F.col("allow_mean") * sd("block") + F.col("block_mean") * sd("allow")) / (sd("allow") + sd("block"))
    return sides.select(F.round(F.when(F.col("allow_mean").isNotNull() & F.col("block_mean").isNotNull(), cut), 6).alias("threshold"))
