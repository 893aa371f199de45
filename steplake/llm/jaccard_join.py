"""N-gram Jaccard self-join by vertical partitioning.

The global n-gram order is the order of the n-grams' hashes. For a class of set sizes it is
cut into equal fragments, more than two linked sets can differ in, so linked sets agree on at
least one whole fragment. Documents that share a fragment are candidates; the overlap of a
candidate pair is counted over both whole sets.

Steps, all on Spark's partitions:

1. Every text becomes a set; equal sets are one class from here on, named by a fingerprint.
2. Every class sends a key per fragment. A task first groups its own keys and sends one row
   per key, so a key is at most as frequent as there are tasks. Keys of one class go away, and
   keys shared by the same classes are one key: it is named by them.
3. Classes left get a bit per fine fragment: whether its count is odd. The differing bits bound the
   overlap from above, so most pairs fall without their sets.
4. First each class is compared with the first, the last and one middle class of its most
   shared keys, then with the one closest class of another component. What links is
   one component, so a large group of copies costs a few comparisons a copy; only then are
   all pairs compared that share a key and are still unconnected. A pair comes under the first
   key it shares. The largest component of a key meets the others only, never itself.
5. Pairs that pass the bound are counted exactly: both whole sets meet in one row. Partial overlaps,
   summed per pair, would send one row for each pair and fragment that both have n-grams in.
   Only classes of such pairs have their whole sets written, made from their texts again for each step 4.

Tables between the steps are removed as soon as the next one is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplake.llm.components import components
from steplake.llm.shared import bucket_count, bucket_of, group_bounds, packed, release, text_bytes, unpacked, written
from steplake.llm.shingles import shingle_sets
from steplake.llm.words import chunks, mix
from steplake.session import scratch_path
from steplake.sources import storage

_U = np.uint64
FINE = 2048  # fragments of the bound
BLOCK = 256  # rows of a frequent key that are compared with each other at once
FIRST = 16  # smallest keys of a class, by which pairs seen under an earlier key are known
PART = 1 << 15  # rows of blocks a task takes at once, about
_NO_KEY = (1 << 63) - 1
CHUNK = 1 << 18  # bytes of texts whose sets are made at a time
BATCH = 2 << 20  # bytes of rows a Python worker is handed at a time
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Cut:
    """How sets are cut for links of ``percent`` or more of the union.

    Sets a and b with |a| <= |b| link only if |b| <= |a| * 100 / percent, and then differ in at most
    |a| * (100 - percent) / percent n-grams. A class of sizes holds the smaller sets of such
    pairs; a larger one whose size still fits the class before takes part there too.
    """

    def __init__(self, percent: int, ratio: float = 1.4, largest: int = 1 << 40):
        self.percent = percent
        lows = [-(-percent // (100 - percent))] if percent < 100 else [largest]
        while lows[-1] < largest:
            lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * max(ratio, 100 / percent)))))
        self.low = np.array(lows, np.int64)
        self.high = np.append(self.low[1:], largest * 2) - 1
        self.differ = self.high * (100 - percent) // percent
        self.spare = self._room(2 + self.differ // 16)
        self.fragments = self.differ + 1 + self.spare

    def _room(self, spare: np.ndarray) -> np.ndarray:
        """Spare fragments, so many more that the smallest sets of a class rarely have more empty ones: those
        are keys of nearly any such set. At 90 percent nothing is added."""
        while True:
            fragments = self.differ + 1 + spare
            load = self.low / fragments
            full = fragments * -np.expm1(-load)
            spread = np.sqrt(np.maximum(fragments * (np.exp(-load) - (1 + load) * np.exp(-2 * load)), 0))
            crowded = (full - 3 * spread < self.differ) & (fragments < self.low)
            if not crowded.any():
                return spare
            spare = spare + crowded * (1 + spare // 16)

    def keys(self, hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and row of every fragment. Sets below the first class link with equal sets only."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        before = np.where((own > 0) & (sizes * self.percent <= 100 * self.high[own - 1]), own - 1, -1)
        found = [self._keys(hashes, owner, c) for c in (own, before)]
        return np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])

    def _keys(self, hashes, owner, of_row):
        use = of_row[owner] >= 0
        hashes, owner = hashes[use], owner[use]
        size_class = of_row[owner]
        fragment = ((hashes >> _U(32)) * self.fragments[size_class].astype(_U)) >> _U(32)
        cut = group_bounds(owner, fragment)
        first = cut[:-1]
        if not len(first):
            return np.zeros(0, _U), np.zeros(0, np.int64)
        owner, fragment, size_class = owner[first], fragment[first], size_class[first]
        parts = np.add.reduceat(mix(hashes), first)
        keys = mix(parts + fragment * _U(0x9E3779B97F4A7C15) + size_class.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        # A pair may agree on empty fragments only, if both have more of them than the spare ones.
        full = np.bincount(owner, minlength=len(of_row))
        extra_keys, extra_rows = [], []
        for r in np.flatnonzero((of_row >= 0) & (self.fragments[of_row] - full > self.spare[of_row])):
            empty = np.setdiff1d(np.arange(self.fragments[of_row[r]], dtype=_U), fragment[owner == r])
            extra_keys.append(mix(empty * _U(0xA24BAED4963EE407) + _U(of_row[r] + 1)))
            extra_rows.append(np.full(len(empty), r))
        return np.concatenate([keys, *extra_keys]), np.concatenate([owner, *extra_rows]).astype(np.int64)


def fine_bits(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` rows a bit per fine fragment, set if it has an odd number of n-grams there; as many bits as differ, two sets differ in."""
    where = (hashes >> _U(53)).astype(np.int64)
    out = np.zeros(n * FINE // 8, np.uint8)
    np.bitwise_xor.at(out, owner * (FINE // 8) + (where >> 3), (1 << (where & 7)).astype(np.uint8))
    return out.reshape(n, FINE // 8)


def _bits(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return unpacked(column, _U).reshape(-1, FINE // 64)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def may_link(n_a, n_b, difference, percent: int):
    """Whether sets with these sizes, and at least this difference, can link: |a&b| <= (n_a+n_b-difference)/2."""
    overlap = (n_a + n_b - difference) // 2
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _fingerprints(hashes, owner, n):
    out = np.zeros(n, _U)
    np.add.at(out, owner, mix(hashes ^ _U(0x5851F42D4C957F2D)))
    return mix(out + np.bincount(owner, minlength=n).astype(_U))


def _rows(batch: pa.RecordBatch, size: int):
    """(rows, hashes, owner, sizes, fingerprints) of the documents of a batch, bit by bit."""
    for rows, raw, starts in chunks(batch.column("text"), CHUNK):
        hashes, owner = shingle_sets(raw, starts, size)
        yield rows, hashes, owner, np.bincount(owner, minlength=len(rows)), _fingerprints(hashes, owner, len(rows))


SWEPT = "kind tinyint, doc_id bigint, n bigint, class bigint, bucket int, x binary, y binary"
_SWEPT = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()),
                    ("bucket", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])
_DOCUMENT, _KEYS, _SHARED = 0, 1, 2


def _swept(cut: Cut, size: int, buckets: int, flush: int = 500_000):
    """Per document its class; per task and bucket one row per key, and all rows of keys shared within the task."""
    def grouped(keys, classes):
        order = np.lexsort((classes, keys))
        keys, classes = keys[order], classes[order]
        first = group_bounds(keys, classes)[:-1]
        keys, classes = keys[first], classes[first]
        bounds = group_bounds(keys)
        shared = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        first = bounds[:-1]
        rows = [(_KEYS, *p) for p in packed(bucket_of(keys[first], buckets), keys[first].astype(np.uint32), classes[first])]
        rows += [(_SHARED, *p) for p in packed(bucket_of(keys[shared], buckets), keys[shared].astype(np.uint32), classes[shared])]
        kind, bucket, x, y = zip(*rows) if rows else ((), (), (), ())
        none = pa.nulls(len(rows), pa.int64())
        return pa.record_batch([pa.array(kind, pa.int8()), none, none, none, pa.array(bucket, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], schema=_SWEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [], 0, set()
        for batch in batches:
            for rows, hashes, owner, sizes, prints in _rows(batch, size):
                n = len(rows)
                blank = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.record_batch([pa.array(np.zeros(n, np.int8)), batch.column("doc_id").slice(rows.start, n), pa.array(sizes, pa.int64()),
                                       pa.array(prints.view(np.int64), pa.int64(), mask=sizes == 0), *blank], schema=_SWEPT)
                new = np.array([x not in seen for x in prints.tolist()], bool) & (sizes > 0)
                seen.update(prints.tolist())
                use = new[owner]
                keys, row = cut.keys(hashes[use], owner[use], np.where(new, sizes, 0))
                held.append((keys, prints[row]))
                n_held += len(keys)
                if n_held > flush:
                    yield grouped(*map(np.concatenate, zip(*held)))
                    held, n_held, seen = [], 0, set()
            pa.default_memory_pool().release_unused()
        if n_held:
            yield grouped(*map(np.concatenate, zip(*held)))
    return run


def _shared_keys(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Every key of a bucket with more than one class, named by its classes, with each of them; weight counts the keys of a name."""
    low, classes = unpacked(table.column("x").combine_chunks(), np.uint32), unpacked(table.column("y").combine_chunks(), _U)
    order = np.lexsort((classes, low))
    low, classes = low[order], classes[order]
    first = group_bounds(low, classes)[:-1]
    low, classes = low[first], classes[first]
    bounds = group_bounds(low)
    rows = np.diff(bounds)
    shared = np.repeat(rows > 1, rows)
    # Were two names to meet, their classes would be compared in vain, and none be lost.
    names = mix(np.add.reduceat(mix(classes ^ _U(0x94D049BB133111EB)), bounds[:-1]) + rows.astype(_U)) if len(low) else np.zeros(0, _U)
    names, classes = np.repeat(names, rows)[shared], classes[shared]
    order = np.lexsort((classes, names))
    names, classes = names[order], classes[order]
    bounds = group_bounds(names, classes)
    return pa.table({"key": names[bounds[:-1]].view(np.int64), "class": classes[bounds[:-1]].view(np.int64), "weight": np.diff(bounds)})


def _sets(size: int, whole: bool):
    """Classes with their whole sets, or with sizes and fine bits. Rows that repeat a doc_id follow each other, and of equal sets one comes."""
    def run(batches):
        last, seen = None, set()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for rows, hashes, owner, sizes, prints in _rows(batch, size):
                new = []
                for i, c in enumerate(prints.tolist()):
                    if ids[rows.start + i] != last:
                        last, seen = ids[rows.start + i], set()
                    if c not in seen:
                        new.append(i)
                    seen.add(c)
                if whole:
                    bounds = np.append(0, np.cumsum(sizes))
                    columns = {"grams": pa.array([hashes[bounds[i]:bounds[i + 1]].tobytes() for i in new], pa.binary())}
                else:
                    bits = fine_bits(hashes, owner, len(rows))
                    columns = {"n": pa.array(sizes[new], pa.int64()), "bits": pa.array([bits[i].tobytes() for i in new], pa.binary())}
                yield pa.record_batch({"class": prints.view(np.int64)[new], **columns})
            pa.default_memory_pool().release_unused()
    return run


def _bounded(percent: int):
    """Pairs (a, b) whose fine bits allow a link."""
    def run(batches):
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(f"n_{s}")) for s in "ab")
            keep = may_link(n_a, n_b, _apart(_bits(batch.column("bits_a")), _bits(batch.column("bits_b"))), percent)
            yield pa.record_batch([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])
    return run


def _crossing(percent: int, closest: bool):
    """Pairs (class, other) of different components under the keys of some blocks of rows, if their bits allow a link:
    all of them, or only the closest other of each class outside its key's largest component. Pairs known to share an earlier key are left to it."""
    def run(part: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks = np.asarray(table.column("own"))
        order = np.argsort(blocks, kind="stable")
        table = table.take(pa.array(order))
        bounds = group_bounds(blocks[order])
        bits = _bits(table.column("bits").combine_chunks())
        firsts = np.asarray(table.column("firsts").combine_chunks().flatten()).reshape(-1, FIRST)
        key, n, label, classes, side, most = (np.asarray(table.column(c)) for c in ("key", "n", "label", "class", "side", "most"))
        found = {}
        for low, high in zip(bounds[:-1], bounds[1:]):
            rows = np.arange(low, high)
            for i in rows[label[low:high] != most[low:high]] if closest else rows[side[low:high] != 1]:
                if side[i]:  # a block against another one: each row meets the other side
                    others = rows[side[low:high] == 3 - side[i]]
                else:
                    others = rows if closest else rows[i - low + 1:]
                others = others[label[others] != label[i]]
                others = others[may_link(n[i], n[others], np.abs(n[others] - n[i]), percent)]
                apart = _apart(bits[others], bits[i])
                near = may_link(n[i], n[others], apart, percent)
                others, apart = others[near], apart[near]
                earlier = firsts[i][firsts[i] < key[i]]
                if len(others) and len(earlier):
                    new = ~np.isin(firsts[others], earlier).any(axis=1)
                    others, apart = others[new], apart[new]
                if not len(others):
                    continue
                if closest:
                    best = (int(apart.min()), int(classes[others[apart.argmin()]]))
                    found[int(classes[i])] = min(best, found.get(int(classes[i]), best))
                else:
                    found.update(((int(classes[i]), int(c)), (0, int(c))) for c in classes[others])
        ends = [x if closest else x[0] for x in found]
        return pa.table({"class": pa.array(ends, pa.int64()), "other": pa.array([c for _, c in found.values()], pa.int64()),
                         "apart": pa.array([x for x, _ in found.values()], pa.int64())})
    return run


def _linked(percent: int):
    """Pairs whose sets link, the overlap counted over both whole sets."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    return run


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


@contextmanager
def _small_batches(spark: SparkSession):
    """Python workers are handed BATCH bytes at a time, not 10,000 rows of any length."""
    before = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES) if before is None else spark.conf.set(_BATCH_BYTES, before)


class _Tables:
    """The tables of a join in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def write(self, frame: DataFrame, name: str, *partitions: str) -> DataFrame:
        """The frame, written and read again; the shuffles it needed can go."""
        path = scratch_path(self.spark, f"jaccard-{name}")
        with _small_batches(self.spark):
            (frame.write.partitionBy(*partitions) if partitions else frame.write).parquet(path)
        self.paths.setdefault(name, []).append(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        del frame
        release(self.spark)
        return out

    def remove(self, *names: str) -> None:
        for path in (path for name in names for path in self.paths.pop(name, [])):
            storage.remove(self.spark, path)


class _Classes:
    """What is known of the classes that share keys: keys (key, class, weight), sets (class, n, bits, firsts), and the texts to make whole sets from."""

    def __init__(self, tables: _Tables, texts: DataFrame, firsts: DataFrame, keys: DataFrame, size: int, percent: int):
        self.tables, self.texts, self.firsts, self.keys, self.size, self.percent = tables, texts, firsts, keys, size, percent
        few = F.slice(F.concat(F.sort_array(F.collect_list("key")), F.array_repeat(F.lit(_NO_KEY), FIRST)), 1, FIRST)
        sets = self._made(keys, False, "class bigint, n bigint, bits binary")
        self.sets = tables.write(sets.join(keys.groupBy("class").agg(few.alias("firsts")), "class"), "sets")

    def _made(self, classes: DataFrame, whole: bool, schema: str) -> DataFrame:
        members = self.firsts.join(classes.select("class").distinct(), "class", "left_semi").select(F.col("first").alias("doc_id"))
        return self.texts.join(members, "doc_id", "left_semi").mapInArrow(_sets(self.size, whole), schema)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. Each step is written, so that its shuffles can go before the next."""
        pairs = self.tables.write(pairs, "pairs")
        near = self.tables.write(_both(pairs, self.sets, "n", "bits").mapInArrow(_bounded(self.percent), "a bigint, b bigint").distinct(), "near")
        ends = near.select(F.explode(F.array("a", "b")).alias("class"))
        grams = self.tables.write(self._made(ends, True, "class bigint, grams binary"), "grams")
        linked = self.tables.write(_both(near, grams, "grams").mapInArrow(_linked(self.percent), "a bigint, b bigint").distinct(), "linked")
        self.tables.remove("pairs", "near", "grams")
        return linked

    def crossing_pairs(self, labels: DataFrame, closest: bool) -> DataFrame:
        """Pairs (a, b) of classes that share a key, have different labels (class, label) and may link."""
        held = self.keys.select("key", "class").join(labels, "class")
        # of a key's rows those of its most frequent label need not meet each other
        spread = (held.groupBy("key", "label").agg(F.count("*").alias("rows")).groupBy("key")
                  .agg(F.max_by("label", F.struct("rows", "label")).alias("most"), F.max("rows").alias("many"), (F.sum("rows") - F.max("rows")).alias("few"))
                  .where("few > 0").withColumn("large", F.ceil(F.col("many") / BLOCK)).withColumn("small", F.ceil(F.col("few") / BLOCK)))
        spread = self.tables.write(spread, "spread")
        sent = spread.agg(F.sum(F.expr("many * small + few * (large + small)")).alias("n")).first()["n"] or 0
        held = held.join(spread, "key").withColumn("block", F.when(F.col("label") == F.col("most"), F.pmod(F.xxhash64("class", F.lit(7)), "large"))
                                                   .otherwise(F.col("large") + F.pmod(F.xxhash64("class", F.lit(7)), "small")))
        # a row meets its own block (side 0) and, as side 1 or 2, each other block of its key
        start = F.when(F.col("label") == F.col("most"), F.col("large")).otherwise(0)
        held = held.withColumn("other", F.explode(F.sequence(start, F.col("large") + F.col("small") - 1)))
        own = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        held = held.select(own.alias("own"), "key", "class", "label", "most", side.alias("side")).join(self.sets, "class")
        parts = max(8 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), sent // PART + 1)
        found = held.withColumn("part", F.pmod("own", F.lit(parts))).groupBy("part").applyInArrow(_crossing(self.percent, closest), "class bigint, other bigint, apart bigint")
        if closest:
            found = found.groupBy("class").agg(F.min(F.struct("apart", "other"))["other"].alias("other"))
        return found.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def _merged(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """labels (class, label) with the labels that links (a, b) connect made one, the smallest; each two labels are one link."""
    label_of = {side: labels.select(F.col("class").alias(side), F.col("label").alias(f"label_{side}")) for side in "ab"}
    links = linked.join(label_of["a"], "a").join(label_of["b"], "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    low = components(links).select(F.col("node").alias("label"), F.col("label").alias("low"))
    return written(labels.join(low, "label", "left").select("class", F.coalesce("low", "label").alias("label")), "labels")


def _prepared(documents: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, _Classes]:
    """The rows with their classes, the classes' smallest doc_id, and the classes that share keys."""
    spark = documents.sparkSession
    cut, tables = Cut(percent), _Tables(spark)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = bucket_count(spark, text_bytes(texts))
    swept = tables.write(texts.mapInArrow(_swept(cut, size, buckets), SWEPT), "swept", "kind")
    rows = swept.where(F.col("kind") == _DOCUMENT).select("doc_id", "n", "class")
    classes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    keys = tables.write(swept.where(F.col("kind") > _DOCUMENT).select("bucket", "x", "y")
                        .groupBy("bucket").applyInArrow(_shared_keys, "key bigint, class bigint, weight bigint")
                        .groupBy("key", "class").agg(F.sum("weight").alias("weight")), "keys")
    for kind in (_KEYS, _SHARED):  # what keys were made from
        storage.remove(spark, f"{tables.paths['swept'][0]}/kind={kind}")
    return rows, classes, _Classes(tables, texts, classes, keys, size, percent)


def jaccard_components(documents: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when their sets of distinct ``size``-word shingles overlap in at least ``percent``
    of the union; component_id is the smallest doc_id that links lead to, the own one included.
    Texts of fewer words are one shingle; NULL texts and texts without words have size 0 and no
    links. Repeated rows stay and are copies of each other. A row with a NULL doc_id belongs to the
    component of an equal text that has one; without such a text its component_id is NULL, and it links
    nothing. Other columns are ignored; an empty table gives no rows.
    """
    rows, classes, shared = _prepared(documents, size, percent)
    keys = shared.keys
    mixed = F.xxhash64("class")
    hubs = keys.groupBy("key").agg(F.min("class").alias("h0"), F.max("class").alias("h1"), F.min(F.struct(mixed, "class"))["class"].alias("h2"))
    seen = keys.join(hubs, "key")
    first = None
    for hub in ("h0", "h1", "h2"):
        tried = (seen.where(F.col("class") != F.col(hub)).groupBy("class", hub).agg(F.sum("weight").alias("weight"))
                 .groupBy("class").agg(F.max_by(hub, "weight").alias("hub"))
                 .select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")))
        first = tried if first is None else first.unionByName(tried)
    # Classes start with their smallest doc_id, so the label is the component's; rows that repeat a doc_id are one node.
    ids = classes.where("first is not null")
    labels = written(keys.select("class").distinct().join(ids, "class").select("class", F.col("first").alias("label")), "labels")
    labels = _merged(labels, shared.links(first.distinct()))
    for closest in (True, False):
        labels = _merged(labels, shared.links(shared.crossing_pairs(labels, closest)))
    shared.tables.remove("keys", "sets", "spread", "linked")

    lower = labels.join(ids, "class").where("label < first").select("first", "label").distinct()
    named = classes.join(lower, "first", "left").select("class", F.coalesce("label", "first").alias("component_id"))
    return (rows.join(named, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def jaccard_links(documents: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links, between classes of equal sets: members (doc_id, n_shingles, class) and links (a, b) of classes, a < b.

    Two documents link if they are of one class or their classes link; a document without words has no class, and a
    class whose doc_ids are all NULL has no links. Every pair that shares a key is looked at, so
    a large group of near copies costs the square of its different texts; ``jaccard_components`` is the cheaper form.
    """
    rows, _, shared = _prepared(documents, size, percent)
    apart = shared.keys.select("class").distinct().withColumn("label", F.col("class"))
    links = shared.links(shared.crossing_pairs(apart, False))
    shared.tables.remove("keys", "sets", "spread")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "class"), links
