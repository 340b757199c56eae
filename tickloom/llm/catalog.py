"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import Vocabulary, bpe_encode
from .chat_format import chat_format, read_loss, read_turns, text_part
from .jaccard_join import jaccard_join
from .mixing import mix, word_count
from .quality import quality_scores
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .url_filter import ALPHABET, Rule, url_filter
from .vector_search import approximate_top_k, exact_top_k


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, read(spark, sf_dir, "documents"), window=20, base=5, with_text=False)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    decoded = bpe_encode(spark, read(spark, sf_dir, "documents"), vocabulary, decoded=True)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM documents)),
k AS (SELECT doc_id, j, CASE WHEN count(*) OVER f = 20 THEN string_agg(word, ' ') OVER f END AS k FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, j FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, j) AS n FROM k WHERE k IS NOT NULL) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(j, j + 20)) AS j, true AS gone FROM r),
t AS (SELECT doc_id, count(*) AS n_words, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone IS NULL) AS kept FROM w LEFT JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mix(spark, docs, F.array("source"), F.col("words"), weights=(3, 1, 2), share=1.5, repeats=2, seed=2)
    about = F.element_at("about", 1)
    return mixed.select("doc_id", "size", about["size"].alias("source_size"), about["target"].alias("target"), "taken", "source")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark, read(spark, sf_dir, "documents"), with_text=False).drop("removed")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scores.select("doc_id", "lang", "n_bytes", F.round("perplexity", 4).alias("perplexity"), F.round("steady", 4).alias("steady"), F.round("threshold", 4).alias("threshold"), "level", "passes")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, read(spark, sf_dir, "documents"), size=5, percent=75)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS j, len(l) AS m FROM (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents)),
k AS (SELECT doc_id, j, m, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM w),
s AS (SELECT DISTINCT doc_id, k FROM k WHERE j <= greatest(m - 4, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM b JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""


#: Turns that the formatting query adds: texts that look like the template's control strings.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    rows = rows.unionByName(odd)
    done = chat_format(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    back = done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|MEDIA:)', '\1\\\2', 'g') AS r,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|MEDIA:)', '\1\\\2', 'g') AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST]' || r || '[/INST]' || t || '</s>')) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id
"""

#: The rules of the query.
URL_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, read(spark, sf_dir, "pages"), URL_RULES)


_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FITS = {r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in sorted(URL_RULES, key=lambda r: -len(r.name))}


def _lower_sql(name: str, longer: str, n: int) -> str:
    return f"{name} AS (SELECT substr(gram, 2, {n}) AS gram, sum(allow) AS allow, sum(block) AS block FROM {longer} GROUP BY 1)"


def _model_sql(n: int) -> str:
    """The models of n characters from counts c<n> and, above one, the models of one less."""
    low = {k: f"s.{k}" if n > 1 else f"1.0 / {ALPHABET}" for k in ("a", "b")}
    p = lambda k, x: f"CASE WHEN x.{x}_n > 0 THEN (c.{x} + x.{x}_t * {low[k]}) / CAST(x.{x}_n + x.{x}_t AS DOUBLE) ELSE {low[k]} END AS {k}"
    below = f"JOIN m{n - 1} s ON s.gram = substr(c.gram, 2, {n - 1})" if n > 1 else ""
    return f"""x{n} AS (SELECT substr(gram, 1, {n - 1}) AS context, sum(allow) AS allow_n, count(*) FILTER (allow > 0) AS allow_t, sum(block) AS block_n, count(*) FILTER (block > 0) AS block_t FROM c{n} GROUP BY 1),
m{n} AS (SELECT c.gram, {p("a", "allow")}, {p("b", "block")} FROM c{n} c JOIN x{n} x ON x.context = substr(c.gram, 1, {n - 1}) {below})"""


OP7_SQL = f"""
WITH rests AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raws AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM rests),
hosts AS (SELECT page_id, url, coalesce(translate(raw, {_LOW}), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1), '') AS path FROM raws),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {x} THEN '{r.name}'" for r, x in _FITS.items())} END AS rule, CASE {" ".join(f"WHEN {x} THEN '{r.verdict}'" for r, x in _FITS.items())} END AS decided FROM hosts),
urls AS (SELECT url, any_value(decided) AS decided, count(*) AS n, substr(md5(url), 1, 1) IN ('d', 'e', 'f') AS held,
  '^^' || regexp_replace(regexp_replace(translate(url, {_LOW}), '[0-9]', '0', 'g'), '[^a-z0./:?=&_#%\\-]', '*', 'g') || '$' AS s FROM ruled WHERE length(url) > 0 GROUP BY url),
places AS (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM urls),
grams AS (SELECT url, decided, n, held, substr(s, i, 3) AS gram FROM places),
c3 AS (SELECT gram, sum(CASE WHEN decided = 'allow' AND NOT held THEN n ELSE 0 END) AS allow, sum(CASE WHEN decided = 'block' AND NOT held THEN n ELSE 0 END) AS block FROM grams GROUP BY gram),
{_lower_sql("c2", "c3", 2)}, {_lower_sql("c1", "c2", 1)},
{_model_sql(1)}, {_model_sql(2)}, {_model_sql(3)},
scores AS (SELECT url, decided, n, round(avg(ln(a) - ln(b)), 9) AS score FROM grams JOIN m3 USING (gram) WHERE held OR decided IS NULL GROUP BY url, decided, n),
sides AS (SELECT decided, sum(score * n) / sum(n) AS mean, sum(score * score * n) / sum(n) AS square FROM scores WHERE decided IS NOT NULL GROUP BY decided),
spreads AS (SELECT decided, mean, sqrt(greatest(square - mean * mean, 1e-12)) AS sd FROM sides),
cut AS (SELECT round((g.mean * b.sd + b.mean * g.sd) / (g.sd + b.sd), 6) AS threshold FROM spreads g JOIN spreads b ON g.decided = 'allow' AND b.decided = 'block')
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.decided, CASE WHEN coalesce(length(r.url), 0) = 0 THEN 'block' WHEN (SELECT threshold FROM cut) IS NULL THEN 'allow' WHEN s.score > (SELECT threshold FROM cut) THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN r.decided IS NULL THEN s.score END AS score
FROM ruled r LEFT JOIN scores s ON s.url = r.url AND s.decided IS NULL
"""


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return exact_top_k(spark, vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op9_approximate_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return approximate_top_k(spark, vectors, F.col("vec_id") % 20 == 0, k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_mixing": op2_mixing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality": op4_quality,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_chat_format": op6_chat_format,
        "op7_url_filter": op7_url_filter,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_approximate_top_k": op9_approximate_top_k,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op5_jaccard_join": OP5_SQL,
        "op6_chat_format": OP6_SQL,
        "op7_url_filter": OP7_SQL,
        "op8_exact_top_k": OP8_SQL,
    }
