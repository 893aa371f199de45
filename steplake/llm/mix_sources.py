"""Mixing sources to target weights, block by block.

The words of a source, document after document, are cut into blocks of fixed length. Output
shards draw from a multinomial how many of their slots each source fills. A source's slots are
numbered through all shards; slot number and a keyed permutation of the source's block numbers,
a new one each time all blocks have been used, name the block that fills the slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steplake.llm.shared import written
from steplake.llm.words import mix

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # of the sources in order, repeating
SHARE = 1.5  # of all words
MOST = 2  # times a source's words
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
MAX_SOURCES = 100_000  # sources are listed on the driver and sent to every task
_U = np.uint64
_TURNS = [_U(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(1, 5)]  # rounds of the permutation


@dataclass
class Source:
    name: str | None
    words: int
    rows: int
    target: float = 0.0

    @property
    def blocks(self) -> int:
        return -(-self.words // BLOCK_WORDS)


def set_targets(sources: list[Source], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> None:
    """Share the words out by weight; what a source has above ``most`` times its words goes to the others by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sources))]
    free, rest = set(range(len(sources))), share * sum(s.words for s in sources)
    while free:
        total = sum(weight[i] for i in free)
        over = {i for i in free if rest * weight[i] / total > most * sources[i].words}
        if not over:
            for i in free:
                sources[i].target = rest * weight[i] / total
            return
        for i in over:
            sources[i].target = float(most * sources[i].words)
        rest -= sum(sources[i].target for i in over)
        free -= over


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Keyed permutations of 0..size-1, elementwise: a Feistel network over the next even number of bits,
    walked until it lands inside."""
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.int64) // 2)).astype(_U)
    mask = (_U(1) << half) - _U(1)
    out, todo = index.astype(_U), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in reversed(_TURNS) if inverse else _TURNS:
            if inverse:
                left, right = right ^ (mix(left + k + turn) & m), left
            else:
                left, right = right, left ^ (mix(right + k + turn) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(_U)]
    return out.astype(np.int64)


def _keys(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return mix(mix(source.astype(_U) + _U(seed)) + epoch.astype(_U))


def _slots(sources: list[Source], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many slots each source fills, and the words of its last one: together the target, rounded down."""
    slots, last = [], []
    for i, s in enumerate(sources):
        if not s.words:
            slots.append(0)
            last.append(0)
            continue
        full, rest = divmod(int(s.target), s.words)
        short = s.words - (s.blocks - 1) * BLOCK_WORDS
        one = np.array([i])
        at = int(permuted(np.array([s.blocks - 1]), np.array([s.blocks]), _keys(seed, one, np.array([full])), inverse=True)[0])
        words = lambda m: m * BLOCK_WORDS - (BLOCK_WORDS - short) * (at < m)  # noqa: E731 of the first m blocks in order
        m = -(-rest // BLOCK_WORDS)
        m += words(m) < rest
        slots.append(full * s.blocks + m)
        if m:
            last.append(rest - words(m - 1))
        else:  # the last slot of a full round
            before = int(permuted(np.array([s.blocks - 1]), np.array([s.blocks]), _keys(seed, one, np.array([full - 1])), inverse=True)[0]) if full else 0
            last.append(short if before == s.blocks - 1 else BLOCK_WORDS)
    return np.array(slots, np.int64), np.array(last, np.int64)


def _before(frame: DataFrame, key: str, chunk: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key, in order of chunk and ``order``: first over
    whole chunks, then within each, so no task needs all rows of a key."""
    whole = frame.groupBy(key, chunk).agg(F.sum(value).alias("chunk_sum"))
    ahead = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(key, chunk, F.coalesce(F.sum("chunk_sum").over(ahead), F.lit(0)).alias("chunk_start"))
    inner = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = frame.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return inside.join(whole, [key, chunk]).withColumn(name, F.col(name) + F.col("chunk_start")).drop("chunk_start")


def _draws(chances: np.ndarray, slots: int, seed: int):
    def run(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                size = min(SHARD_SLOTS, slots - shard * SHARD_SLOTS)
                counts = np.random.default_rng([seed, shard]).multinomial(size, chances)
                used = np.flatnonzero(counts)
                yield pa.record_batch({"shard": pa.array(np.full(len(used), shard), pa.int64()), "source_no": pa.array(used, pa.int32()),
                                       "slots": pa.array(counts[used], pa.int64())})
    return run


def _filled(sources: list[Source], slots: np.ndarray, last: np.ndarray, seed: int):
    """The block of every slot and how many of its words are used."""
    blocks, words = np.array([s.blocks for s in sources]), np.array([s.words for s in sources])

    def run(batches):
        for batch in batches:
            source, slot = np.asarray(batch.column("source_no")).astype(np.int64), np.asarray(batch.column("slot"))
            n = blocks[source]
            block = permuted(slot % n, n, _keys(seed, source, slot // n))
            used = np.where(block == n - 1, words[source] - block * BLOCK_WORDS, BLOCK_WORDS)
            used = np.where(slot == slots[source] - 1, last[source], used)
            yield pa.record_batch({"shard": batch.column("shard"), "source_no": batch.column("source_no"), "slot": batch.column("slot"),
                                   "block": pa.array(block, pa.int64()), "words": pa.array(used, pa.int64())})
    return run


class Mix:
    """A mix of documents(doc_id, source, text).

    ``laid``: doc_id, source_no, size and begin, the words of the source before the document.
    ``slots``: shard, source_no, slot, block and words: the first ``words`` of that block fill the slot.
    Sizes count runs without blanks; NULL texts have none and take no part, and neither do
    sources without words. NULL is a source of its own, the last one. Repeated rows are documents of
    their own. Other columns are ignored; an empty table gives an empty mix.
    """

    def __init__(self, documents: DataFrame, seed: int = 20_240_607):
        spark = documents.sparkSession
        sized = written(documents.select("doc_id", F.col("source").cast("string").alias("source"),
                                         F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size")), "mix-sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.sources = [Source(r["source"], r["words"], r["rows"]) for r in found]
        set_targets(self.sources)
        chunks = [max(1, r.rows // max(2000, int(r.rows ** 0.5))) for r in self.sources]
        named = spark.createDataFrame([(i, s.name, c) for i, (s, c) in enumerate(zip(self.sources, chunks))], "source_no int, name string, chunks int")
        rows = sized.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")))
        rows = rows.select("doc_id", "source_no", "size", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"))
        self.laid = written(_before(rows, "source_no", "chunk", ["doc_id", "size"], "size", "begin").drop("chunk"), "mix-laid")

        slots, last = _slots(self.sources, seed)
        total = int(slots.sum())
        n_shards = -(-total // SHARD_SLOTS)
        chances = slots / max(total, 1)
        width = max(64, int(n_shards ** 0.5))
        draws = spark.range(n_shards).mapInArrow(_draws(chances, total, seed), "shard bigint, source_no int, slots bigint")
        draws = written(_before(draws.withColumn("chunk", F.floor(F.col("shard") / width)), "source_no", "chunk", ["shard"], "slots", "first").drop("chunk"), "mix-draws")
        drawn = {r["source_no"]: r["n"] for r in draws.groupBy("source_no").agg(F.sum("slots").alias("n")).collect()}
        # sources with too few draws get the slots that those with too many leave empty
        late = [(n_shards, i, int(slots[i]) - drawn.get(i, 0), drawn.get(i, 0)) for i in range(len(slots)) if slots[i] > drawn.get(i, 0)]
        quota = spark.createDataFrame([(i, int(n)) for i, n in enumerate(slots)], "source_no int, quota bigint")
        draws = draws.select("shard", "source_no", "slots", "first").unionByName(spark.createDataFrame(late, "shard bigint, source_no int, slots bigint, first bigint"))
        each = draws.join(F.broadcast(quota), "source_no").withColumn("end", F.least(F.col("first") + F.col("slots"), F.col("quota")))
        each = each.where("first < end").select("shard", "source_no", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("slot"))
        self.slots = each.mapInArrow(_filled(self.sources, slots, last, seed), "shard bigint, source_no int, slot bigint, block bigint, words bigint")

    def pieces(self) -> DataFrame:
        """Per document with words and block it reaches into: doc_id, source_no, size, begin, block, and the piece's place in the block."""
        start, end = F.col("begin"), F.col("begin") + F.col("size")
        reach = F.sequence(F.floor(start / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))
        base = F.col("block") * BLOCK_WORDS
        return (self.laid.where("size > 0").withColumn("block", F.explode(reach))
                .withColumn("piece_start", F.greatest(start - base, F.lit(0))).withColumn("piece_end", F.least(end - base, F.lit(BLOCK_WORDS))))

    def mixed(self) -> DataFrame:
        """The mix itself: shard, slot, and the doc_id and words (from, until) that stand there."""
        taken = self.slots.join(self.pieces(), ["source_no", "block"]).where("piece_start < words")
        first = F.col("block") * BLOCK_WORDS + F.col("piece_start") - F.col("begin")
        return taken.select("shard", "source_no", "slot", "doc_id", first.alias("from_word"),
                            (first + F.least("piece_end", "words") - F.col("piece_start")).alias("until_word"))

    def summary(self) -> DataFrame:
        """Per document: doc_id, source, size, source_size, target, taken."""
        spark = self.laid.sparkSession
        # words used of a block -> how often; nearly always one or two rows a block
        uses = self.slots.groupBy("source_no", "block", "words").agg(F.count("*").alias("times"))
        used = F.greatest(F.least(F.col("piece_end"), F.col("words")) - F.col("piece_start"), F.lit(0)) * F.col("times")
        taken = (self.pieces().join(uses, ["source_no", "block"], "left").groupBy("source_no", "begin", "doc_id", "size")
                 .agg(F.sum(F.coalesce(used, F.lit(0))).alias("taken")))
        empty = self.laid.where("size = 0").select("source_no", "begin", "doc_id", "size", F.lit(0).cast("bigint").alias("taken"))
        named = spark.createDataFrame([(i, s.name, s.words, s.target) for i, s in enumerate(self.sources)],
                                      "source_no int, source string, source_size bigint, target double")
        return taken.unionByName(empty).join(F.broadcast(named), "source_no").select("doc_id", "source", "size", "source_size", "target", "taken")
