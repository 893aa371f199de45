"""URL filters: rules on host and path, and exact membership of hosts through a Bloom filter cascade.

The cascade's first level encodes the listed keys. Level by level the next filter encodes those
keys of the corpus that the level before lets through by mistake, until none is left: over the
keys it was built for the cascade is exact, and asking it needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steplake.llm.shared import written

WORD_BITS = 32_768  # bits of one word of bitmap_construct_agg
MAX_BITS = 1 << 24  # a level goes to every task, 2 MB at most; longer lists are joined instead
MAX_LEVELS = 64
FIRST_BITS = 10  # bits per listed key in the first level; the others halve the mistakes


def _positions(key: Column, level: int, n_hashes: int, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(n_bits).cast("bigint")) for i in range(n_hashes)]


class Cascade:
    """Levels of Bloom filters; ``contains`` is exact for every key of the universe it was built over."""

    def __init__(self, levels: list[tuple[int, int, bytes]]):
        self.levels = levels  # (hashes, bits, bitmap)

    def contains(self, key: Column) -> Column:
        """Whether the key is listed. A level that lacks the key decides: the listed keys are in all even levels."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self._in(key, level), F.lit(level % 2 == 1)).otherwise(answer)
        return answer

    def _in(self, key: Column, level: int) -> Column:
        n_hashes, n_bits, bitmap = self.levels[level]
        found = F.lit(True)
        for position in _positions(key, level, n_hashes, n_bits):
            byte = F.conv(F.hex(F.substring(F.lit(bitmap), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found = found & (F.getbit(byte, (position % 8).cast("int")) == 1)
        return found


def _level(keys: DataFrame, level: int, n_hashes: int, n_bits: int) -> bytes:
    """The bitmap of the keys' positions, gathered word by word."""
    marked = keys.select(F.explode(F.array(*_positions(F.col("key"), level, n_hashes, n_bits))).alias("p"))
    # bitmap_bit_position counts from 0 in words of WORD_BITS, bitmap_bucket_number from 1
    words = (marked.select((F.col("p") + 1).alias("p"))
             .groupBy(F.bitmap_bucket_number("p").alias("word")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    size = -(-n_bits // WORD_BITS)
    out = bytearray(size * WORD_BITS // 8)
    for row in words:
        at = (row["word"] - 1) * WORD_BITS // 8
        out[at:at + WORD_BITS // 8] = row["bits"]
    return bytes(out[:-(-n_bits // 8)])


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """A cascade that tells the keys of ``listed`` from all other keys of ``universe``; both have one column, key.

    None if a level would need more than MAX_BITS.
    NULL keys are listed nowhere; repeated keys count once; with nothing listed every answer is no.
    Keys of ``listed`` that ``universe`` lacks are part of the universe too.
    """
    inside = written(listed.select("key").where("key is not null").distinct(), "cascade-listed")
    outside = written(universe.select("key").where("key is not null").distinct().join(inside, "key", "left_anti"), "cascade-others")
    levels: list[tuple[int, int, bytes]] = []
    encode, other = inside, outside
    while (n := encode.count()) and len(levels) < MAX_LEVELS:
        per_key, n_hashes = (FIRST_BITS, 7) if not levels else (2, 1)
        n_bits = max(64, n * per_key)
        if n_bits > MAX_BITS:
            return None
        levels.append((n_hashes, n_bits, _level(encode, len(levels), n_hashes, n_bits)))
        mistaken = other.where(Cascade(levels)._in(F.col("key"), len(levels) - 1))
        encode, other = written(mistaken, "cascade-mistakes"), encode
    if n:
        raise RuntimeError(f"{MAX_LEVELS} levels do not part the keys")
    return Cascade(levels)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z as a-z; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (verdict, host, path) that fits, as ``host`` + ``path``, and its verdict; else NULL."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decided, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url): page_id, host, path, rule, verdict, listed.

    ``listed`` has one column, key: hosts to block. The verdict is the longest fitting rule's; without one
    it is block for a listed host and allow otherwise. A NULL url, or one without ://, has an
    empty host and path, fits no rule and is allowed unless '' is listed. Repeated rows stay;
    other columns are ignored; an empty table gives none.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cascade = build_cascade(listed, parts.select(F.col("host").alias("key")))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    if cascade:
        parts = parts.withColumn("listed", cascade.contains(F.col("host")))
    else:
        blocked = listed.select(F.col("key").alias("host"), F.lit(True).alias("listed")).distinct()
        parts = parts.join(blocked, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return parts.select("page_id", "host", "path", name.alias("rule"),
                        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
