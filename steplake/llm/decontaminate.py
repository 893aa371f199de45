"""Benchmark decontamination: find the test n-grams of a benchmark in documents and take them out.

All on DataFrame functions. Every n-gram window of an item has an anchor, its longest word. A
document's words are looked up in the hash set of anchors; where one is found, the window
around it is compared word by word with the item's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
MAX_BROADCAST_WINDOWS = 1_000_000  # more windows than this are joined by a shuffle instead of being sent to every task
MAX_LISTED_ANCHORS = 100_000  # more anchors than this do not go into the plan as a set


def words_of(text: Column) -> Column:
    """Words of a text, A-Z as a-z; none for NULL."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(win, anchor, lead, items): the distinct windows of benchmark(item_id, text), their longest word,
    how many words stand before it, and the items that have the window.

    An item with fewer words, but not none, is one window; items without words have none.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    wins = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("win"))
    wins = wins.groupBy("win").agg(F.collect_set("item").alias("items"))
    longest = F.array_max(F.transform("win", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"))))
    return wins.withColumn("lead", -longest["at"]).withColumn("anchor", F.element_at("win", F.col("lead") + 1))


def find_windows(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of documents(key..., w) once per occurrence of a window, with win_start (from 1), win_words and items;
    a row without occurrences comes once, with NULLs."""
    n_windows = windows.count()
    anchors = windows.select("anchor").distinct()
    small = n_windows <= MAX_BROADCAST_WINDOWS
    listed = [r["anchor"] for r in anchors.limit(MAX_LISTED_ANCHORS + 1).collect()]
    others = [c for c in documents.columns if c != "w"]
    if len(listed) <= MAX_LISTED_ANCHORS:
        # positions of anchors, found in the hash set without taking the array apart
        marked = F.transform("w", lambda x, i: F.when(x.isin(listed), i)) if listed else F.array().cast("array<int>")
        spots = documents.withColumn("spot", F.explode_outer(F.array_compact(marked)))
    else:
        spots = documents.withColumn("spot", F.explode_outer(F.sequence(F.lit(0), F.size("w") - 1)))
    spots = spots.withColumn("anchor", F.when(F.col("spot").isNotNull(), F.element_at("w", F.col("spot") + 1)))
    wins = F.broadcast(windows) if small else windows
    start = F.col("spot") - F.col("lead")
    met = spots.join(wins, "anchor", "left")
    same = (start >= 0) & (F.slice(F.col("w"), F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win"))
    return met.select(*others, F.when(same, start + 1).alias("win_start"), F.when(same, F.size("win")).alias("win_words"),
                      F.when(same, F.col("items")).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of documents(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    A word is hit inside any occurrence of a window of benchmark(item_id, text); hit_spans holds the
    hit words as spans (first word from 1, words). contaminated: 20 * n_hit >= n_words and n_hit > 0.
    NULL and empty texts have no words and no hits. Rows that repeat doc_id and text are one document;
    rows that repeat doc_id with other texts stay apart. Other columns are ignored; an empty
    benchmark hits nothing, an empty table gives no rows.
    """
    return _contaminated(documents, benchmark, window).drop("text_hash")


def _contaminated(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    texts = documents.select("doc_id", words_of(F.col("text").cast("string")).alias("w"))
    texts = texts.select("doc_id", F.xxhash64("w").alias("text_hash"), F.size("w").cast("bigint").alias("n_words"), "w")
    found = find_windows(texts, item_windows(benchmark, window))
    spans = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("win_start").isNotNull(), F.struct("win_start", "win_words")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # spans in order: one that starts within the last is joined to it
    joined = F.aggregate("spans", F.array().cast("array<struct<first:int,words:int>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (s["win_start"] <= F.element_at(done, -1)["first"] + F.element_at(done, -1)["words"]),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"),
            F.greatest(F.element_at(done, -1)["words"], s["win_start"] + s["win_words"] - F.element_at(done, -1)["first"]).alias("words")))))
        .otherwise(F.concat(done, F.array(F.struct(s["win_start"].alias("first"), s["win_words"].alias("words"))))))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
    return spans.withColumn("hit_spans", joined).withColumn("n_hit", n_hit).select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hit_spans")


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with hit words cut out of their texts, each with what follows it up to the next word;
    texts without hits stay as they are. All other columns stay, whatever their names. Each row is cut by the spans of its own doc_id
    and text, so NULL and repeated doc_ids are no trouble and every row comes once.
    """
    at = {c: f"_steplake_{c}" for c in ("id", "hash", "here", "spans", "words", "gaps")}  # names of helper columns
    found = _contaminated(documents, benchmark, window).where("n_hit > 0").select(
        F.col("doc_id").alias(at["id"]), F.col("text_hash").alias(at["hash"]), F.col("hit_spans").alias(at["spans"]))
    marked = documents.withColumn(at["here"], F.xxhash64(words_of(F.col("text").cast("string"))))
    joined = marked.join(found, F.col("doc_id").eqNullSafe(F.col(at["id"])) & (F.col(at["here"]) == F.col(at["hash"])), "left")
    word = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    joined = joined.withColumns({at["words"]: F.expr(f"regexp_extract_all(text, '{word}', 0)"), at["gaps"]: F.expr(f"split(text, '{word}', -1)")})
    cut = F.array_join(F.transform(at["words"], lambda x, i: F.when(
        F.exists(at["spans"], lambda s: (s["first"] <= i + 1) & (i + 1 < s["first"] + s["words"])), F.lit(""))
        .otherwise(F.concat(x, F.element_at(at["gaps"], i + 2)))), "")
    text = F.when(F.col(at["spans"]).isNull(), F.col("text")).otherwise(F.concat(F.element_at(at["gaps"], 1), cut))
    return joined.withColumn("text", text).select(*[f"`{c}`" for c in documents.columns])
