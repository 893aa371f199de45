"""Registered queries of the corpus operators, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplake.llm.decontaminate import contamination
from steplake.llm.hard_negatives import mine_hard_negatives
from steplake.llm.jaccard_join import jaccard_components
from steplake.llm.language_id import identify, learn
from steplake.llm.mix_sources import Mix
from steplake.llm.periodic_runs import find_runs
from steplake.llm.pseudonyms import replace_values
from steplake.llm.quality import grade
from steplake.llm.suffix_dedup import remove_repeats
from steplake.llm.top_k import top_inner_products
from steplake.llm.toxicity import score_toxicity
from steplake.llm.url_filter import filter_urls, host_of
from steplake.llm.window_doubling import remove_repeated_windows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A-Z as a-z and nothing else
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE unnest_gram END AS gram
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) < 3 THEN [''] ELSE
          list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS unnest_gram
        FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  WHERE 10 * p.n >= 9 * q.n AND 10 * q.n >= 9 * p.n
  GROUP BY a.doc_id, b.doc_id, p.n, q.n
  HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT w.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN reach r ON r.doc_id = w.doc_id
GROUP BY w.doc_id
"""


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Sites whose hosts the block list names.
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

URL_SQL = rf"""
WITH parts AS (
  SELECT page_id, {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_matches(host, '(^|\.)({"|".join(LISTED_SITES)})\.') AS listed
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""


@query("op3_url_filter", URL_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    listed = hosts.where(F.col("key").rlike(rf"(^|\.)({'|'.join(LISTED_SITES)})\."))
    return filter_urls(pages, URL_RULES, listed)


DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lengths AS (SELECT DISTINCT least(13, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT doc_id, item_id, i, g.m AS m FROM grams g JOIN windows x ON g.gram = x.gram AND g.m = x.m),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""


@query("op5_decontamination", DECONTAMINATE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).summary()


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""


@query("op9_exact_top_k", TOP_K_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# In hex, a byte is two characters. A window's first place is its smallest (doc_id, start).
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS w1, hash('x' || substr(h, 2 * i + 1, 200)) AS w2
         FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM wins QUALIFY row_number() OVER (PARTITION BY w1, w2 ORDER BY doc_id, i) > 1),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM steps),
spans AS (SELECT doc_id, s, min(i) AS first, max(i) + 100 AS last FROM numbered GROUP BY doc_id, s),
cuts AS (SELECT doc_id, first, last, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY first) AS before FROM spans),
parts AS (
  SELECT c.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (first - before)), '' ORDER BY first) AS head,
         max(last) AS tail, sum(last - first) AS n_removed, count(*) AS n_spans
  FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts p ON p.doc_id = d.doc_id
"""


@query("op10_suffix_dedup", SUFFIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def held_out(divisor: int, remainder: int):
    """Whether a document is kept from learning: by the checksum of its doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn(documents.where(~held_out(4, 2)))
    return identify(documents, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(~held_out(5, 0))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # grades: 0 low quality, 1 good but toxic, 2 good
    rating = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    ratings = label_rows(spark, sf_dir).select("doc_id", rating.alias("y"))
    graded = grade(table(spark, sf_dir, "documents"), ratings, 3)
    return graded.select("doc_id", held_out(5, 0).alias("held_out"), "expected_grade", "p_grade_1", "p_grade_2", (F.col("p_grade_1") >= 0.5).alias("keep"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_rows(spark, sf_dir).select("doc_id", F.col("toxic").alias("y"))
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


PSEUDONYM_KEY = b"steplake example key"  # a deployment hands over its own secret


@query("op8_pseudonyms")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_values(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "n_values", "text")


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


DOUBLING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, hash(g) AS a, hash('x' || g) AS b FROM wins) QUALIFY count(*) OVER (PARTITION BY a, b) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS text, count(*) AS n
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op12_window_doubling", DOUBLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# crc32 by its table, byte by byte of the decimal doc_id; words that agree a period apart make islands, and equal islands keep their smallest period.
RUNS_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS b, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT b, c FROM bits WHERE k = 8),
crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS t, 1 AS i, 4294967295::BIGINT AS c FROM documents
  UNION ALL
  SELECT r.doc_id, t, i + 1, xor(r.c >> 8, x.c) FROM crc r JOIN crc_table x ON x.b = xor(r.c & 255, ascii(t[i])) WHERE i <= length(t)),
hashes AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE i = length(t) + 1),
raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
planned AS (SELECT r.doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw r JOIN hashes h ON h.doc_id = r.doc_id),
d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
    ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w FROM planned),
words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
found AS (SELECT doc_id, min(i) AS s, q, count(*) + q AS l FROM islands GROUP BY doc_id, q, g HAVING count(*) >= greatest(24 - q, 2 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM found GROUP BY doc_id, s, l),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
beaten AS (SELECT DISTINCT x.doc_id, x.s, x.q FROM runs x JOIN runs y ON x.doc_id = y.doc_id
  AND (y.l * x.q > x.l * y.q OR (y.l * x.q = x.l * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q))))),
best AS (SELECT x.* FROM runs x ANTI JOIN beaten b ON b.doc_id = x.doc_id AND b.s = x.s AND b.q = x.q),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Every tenth text, by the checksum of its doc_id, repeats a stretch of itself from some word on; a NULL doc_id has none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    marked = documents.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_w", F.when(F.col("_g").isNotNull(), w))
    n, g = F.size("_w"), F.col("_g")
    a = F.pmod(g, n)
    p = F.floor((n - a) / (3 + g % 8)) + 1
    again = F.transform("_w", lambda x, i: F.when(i < a, x).otherwise(F.element_at("_w", (a + (i - a) % p + 1).cast("int"))))
    return marked.withColumn("text", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text"))).select("doc_id", "text")


@query("op13_periodic_runs", RUNS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    # runs come by start and period, so of equal exponents the first stays
    best = F.reduce("runs", F.element_at("runs", 1), lambda top, r: F.when(
        r["length"].cast("bigint") * top["period"] > top["length"].cast("bigint") * r["period"], r).otherwise(top))
    found = found.withColumn("_best", F.when(F.size("runs") > 0, best))
    top = {c: F.col("_best")[c].cast("bigint") for c in ("start", "length", "period")}
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[x.alias(c) for c, x in top.items()],
                        F.expr("(1000L * _best.length) div _best.period").alias("exponent_milli"),
                        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
