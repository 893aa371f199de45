"""Hard-negative mining over lists that the anchors of a cluster share.

Anchors are clustered by direction. For each cluster all rows are sorted once by an upper bound of their inner product with any of
its anchors: the length of the row's vector times the cosine of its angle to the cluster's centre, less the widest angle
of an anchor to that centre. An anchor walks its cluster's list until its own length times the next bound stays below what it has found, so
what it has is certified. It walks twice: for its positives, then for the negatives of each.

A list is cut into segments, each twice as long as the one before, and those into blocks; one segment of all lists is a Spark job, and only anchors
that are not certified yet go on to the next.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplake.llm.shared import group_bounds, packed, written
from steplake.llm.top_k import _matrix

CLUSTERS = 16  # at most: each has a list of all rows
MEMBERS = 1024  # anchors that walk a block together
FIRST = 16_384  # rows of a list's first segment, and of a block
STEP = 512  # rows between two looks at what is certified
SAMPLE_ANCHORS, SAMPLE_ROWS = 4096, 8192  # what centres and the segments' limits are taken from; all rows are clustered, listed and searched

_U = np.uint64
_LOWEST, _HIGHEST = -(1 << 62), 1 << 62
_BLOCK = "cluster int, segment int, block int, bound binary, ids binary, labels binary, vectors binary"


def centres_of(vectors: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Unit vectors around which directions gather (spherical k-means, always the same for the same vectors)."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    points = (vectors / np.maximum(length, 1e-300))[length[:, 0] > 0]
    if not len(points):
        return np.eye(1, vectors.shape[1])
    centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)]
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        for i in np.unique(near):
            total = points[near == i].sum(axis=0)
            if np.linalg.norm(total) > 1e-9:
                centres[i] = total / np.linalg.norm(total)
    return centres


def angles(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and angles to every centre; a vector without length lies at every centre."""
    norm = np.linalg.norm(vectors, axis=1)
    cosine = np.where(norm[:, None] > 0, (vectors @ centres.T) / np.maximum(norm, 1e-300)[:, None], 1.0)
    return norm, np.arccos(np.clip(cosine, -1, 1))


def _assigned(width: int, centres: np.ndarray):
    def run(batches):
        for batch in batches:
            norm, angle = angles(_matrix(batch.column("v"), width).astype(float), centres)
            near = angle.argmin(axis=1)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": batch.column("v"), "cluster": pa.array(near, pa.int32()),
                                   "norm": norm, "angle": angle[np.arange(len(near)), near]})
    return run


def _bounds(batch, width: int, centres: np.ndarray, cones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vectors = _matrix(batch.column("v"), width)
    norm, angle = angles(vectors.astype(float), centres)
    return vectors, norm[:, None] * np.cos(np.maximum(angle - cones - 1e-7, 0))


def _segment(bound: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Segment by falling bound: behind as many limits as the bound does not pass."""
    return (bound[:, None] <= limits).sum(axis=1)


def _tallied(width, centres, cones, limits):
    def run(batches):
        total = np.zeros((len(centres), limits.shape[1] + 1), np.int64)
        for batch in batches:
            bound = _bounds(batch, width, centres, cones)[1]
            for g in range(len(centres)):
                total[g] += np.bincount(_segment(bound[:, g], limits[g]), minlength=total.shape[1])
        g, s = np.indices(total.shape)
        yield pa.record_batch({"cluster": pa.array(g.ravel(), pa.int32()), "segment": pa.array(s.ravel(), pa.int32()), "n": total.ravel()})
    return run


def _listed(width, centres, cones, limits, blocks, kind):
    """Rows packed for each cluster by segment and block."""
    def run(batches):
        for batch in batches:
            vectors, bound = _bounds(batch, width, centres, cones)
            ids, labels = np.asarray(batch.column("vec_id")), np.asarray(batch.column("label"))
            out = []
            for g in range(len(centres)):
                segment = _segment(bound[:, g], limits[g])
                block = (ids.astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(33)).astype(np.int64) % blocks[g][segment]
                for key, *data in packed(segment << 32 | block, bound[:, g], ids, labels, vectors.astype(kind)):
                    out.append((g, key >> 32, key & 0xFFFFFFFF, *data))
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(),) * 3 + (pa.binary(),) * 4)],
                                  names=["cluster", "segment", "block", "bound", "ids", "labels", "vectors"])
    return run


def _sorted(width, kind):
    """One block of a list, highest bound first, equal ones by vec_id."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bound, ids, labels, vectors = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in table.column(c)])
                                       for c, k in (("bound", float), ("ids", np.int64), ("labels", np.int64), ("vectors", kind)))
        order = np.lexsort((ids, -bound))
        out = (bound[order], ids[order], labels[order], vectors.reshape(len(ids), width)[order])
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([x.tobytes()], pa.binary()) for x in out],
                        names=["cluster", "segment", "block", "bound", "ids", "labels", "vectors"])
    return run


def _first_of_each(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of every owner's k best: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, owner))
    bounds = group_bounds(owner[order])
    rank = np.arange(len(order)) - np.repeat(bounds[:-1], np.diff(bounds))
    return order[rank < k]


def _walk(width, kind, k, same):
    """Members go down a block together. A member has slots; a slot takes the k first rows of its label (``same``) or of others whose
    score lies from low to high, and of those only what comes before (score, vec_id) of its k-th row so far."""
    def run(key: tuple[pa.Scalar, ...], members: pa.Table, blocks: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4]
        if members.num_rows and blocks.num_rows:
            keys, ids, labels, norm = (np.asarray(members.column(c)) for c in ("key", "vec_id", "label", "norm"))
            asks = _matrix(members.column("v").combine_chunks(), width)
            slots = members.column("slots").combine_chunks()
            owner = np.repeat(np.arange(len(ids)), np.asarray(slots.value_lengths()))
            number, low, high, least, last = (np.asarray(slots.flatten().field(c)) for c in ("slot", "low", "high", "least", "last"))
            for b in blocks.to_pylist():
                found.extend(down(b, asks, ids, labels, norm, keys, owner, number, low, high, least.copy(), last.copy()))
        key_, slot, vec, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"key": key_, "slot": pa.array(slot, pa.int32()), "vec_id": vec, "score": score})

    def down(b, asks, ids, labels, norm, keys, owner, number, low, high, least, last):
        bound, other, label = np.frombuffer(b["bound"]), np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
        vectors = np.frombuffer(b["vectors"], kind).reshape(len(other), width).astype(np.int64)
        small = max(int(np.abs(asks).max(initial=0)), 1) * max(int(np.abs(vectors).max(initial=0)), 1) * width < 2 ** 53
        left, right = (asks.astype(float), vectors.astype(float)) if small else (asks, vectors)
        kept = (np.zeros(0, np.int64),) * 3  # slot's place, vec_id, score
        for at in range(0, len(other), STEP):
            reach = norm[owner] * bound[at] * (1 + 1e-9) + 1e-6
            active = np.flatnonzero((reach >= low) & (reach >= least))
            if not len(active):
                break
            who = np.unique(owner[active])
            scores = np.zeros((len(ids), min(STEP, len(other) - at)), np.int64)
            scores[who] = left[who] @ right[at:at + STEP].T
            fits = (labels[:, None] == label[at:at + STEP]) == same
            fits &= ids[:, None] != other[at:at + STEP]
            for part in np.array_split(active, -(-len(active) // 1024)):
                s = scores[owner[part]]
                ok = fits[owner[part]] & (s >= np.maximum(low, least)[part, None]) & (s <= high[part, None])
                ok &= (s > least[part, None]) | (other[at:at + STEP] < last[part, None])
                i, j = np.nonzero(ok)
                kept = tuple(np.concatenate(x) for x in zip(kept, (part[i], other[at + j], s[i, j])))
            best = _first_of_each(*kept, k)
            kept = tuple(x[best] for x in kept)
            bounds = group_bounds(kept[0])
            full = bounds[1:][np.diff(bounds) == k] - 1
            least[kept[0][full]], last[kept[0][full]] = kept[2][full], kept[1][full]
        return [(keys[owner[kept[0]]], number[kept[0]], kept[1], kept[2])]
    return run


class _Lists:
    """The clusters' lists, and the anchors with their clusters."""

    def __init__(self, rows: DataFrame, is_anchor: Column, facts, clusters: int):
        self.width = max(1, facts["width"])
        self.kind = next(k for k in (np.int16, np.int32, np.int64) if facts["largest"] <= np.iinfo(k).max)
        anchors = rows.where(is_anchor).dropDuplicates(["vec_id", "label", "v"])
        sample = self._sample(anchors, SAMPLE_ANCHORS)
        self.centres = centres_of(sample, clusters)
        marked = anchors.mapInArrow(_assigned(self.width, self.centres), "vec_id bigint, label bigint, v array<bigint>, cluster int, norm double, angle double")
        marked = written(marked.withColumn("key", F.xxhash64("vec_id", "label", "v")), "negatives-anchors")
        n = len(self.centres)
        self.cones, self.members = np.zeros(n), np.zeros(n, np.int64)
        for r in marked.groupBy("cluster").agg(F.max("angle").alias("cone"), F.count("*").alias("n")).collect():
            self.cones[r["cluster"]], self.members[r["cluster"]] = r["cone"], r["n"]
        parts = [max(1, -(-int(m) // MEMBERS)) for m in self.members]
        self.anchors = marked.withColumn("crowd", F.pmod(F.col("key"), self._by_cluster(parts)).cast("int"))
        # limits of the segments, from the bounds of sampled rows
        norm, angle = angles(self._sample(rows, SAMPLE_ROWS), self.centres)
        bound = np.sort(norm[:, None] * np.cos(np.maximum(angle - self.cones - 1e-7, 0)), axis=0)[::-1]
        shares, at = [], FIRST
        while at < facts["n"]:
            shares.append(at / facts["n"])
            at = at * 2 + FIRST
        spots = [min(int(s * len(bound)), len(bound) - 1) for s in shares]
        self.limits = bound[spots].T.copy() if spots else np.zeros((n, 0))
        tally = rows.mapInArrow(_tallied(self.width, self.centres, self.cones, self.limits), "cluster int, segment int, n bigint")
        blocks = np.ones((n, len(shares) + 1), np.int64)
        for r in tally.groupBy("cluster", "segment").agg(F.sum("n").alias("n")).collect():
            blocks[r["cluster"], r["segment"]] = max(1, -(-r["n"] // FIRST))
        listed = rows.mapInArrow(_listed(self.width, self.centres, self.cones, self.limits, blocks, self.kind), _BLOCK)
        self.blocks = written(listed.groupBy("cluster", "segment", "block").applyInArrow(_sorted(self.width, self.kind), _BLOCK), "negatives-lists", "segment")
        self.segments, self.parts, self.counts = len(shares) + 1, parts, blocks

    def _sample(self, rows: DataFrame, n: int) -> np.ndarray:
        found = rows.select("v", F.xxhash64("vec_id", "v").alias("mark")).orderBy("mark", "v").limit(n).select("v").toArrow()
        return _matrix(found.column("v").combine_chunks(), self.width).astype(float)

    def _by_cluster(self, values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    def walk(self, slots: DataFrame, k: int, same: bool) -> DataFrame:
        """slots(key, slot, low, high) -> key, slot, vec_id, score, rank of the k first rows of each."""
        best = None
        order = Window.partitionBy("key", "slot").orderBy(F.col("score").desc(), "vec_id")
        state = slots.withColumns({"least": F.lit(_LOWEST), "last": F.lit(_HIGHEST)})
        for segment in range(self.segments):
            members = self.anchors.join(state.groupBy("key").agg(F.collect_list(F.struct("slot", "low", "high", "least", "last")).alias("slots")), "key")
            blocks = self.blocks.where(F.col("segment") == segment)
            crowds = blocks.withColumn("crowd", F.explode(F.sequence(F.lit(0), self._by_cluster(self.parts) - 1)))
            # every block of the segment meets every crowd of its cluster
            sent = members.withColumn("block", F.explode(F.sequence(F.lit(0), self._by_cluster(self.counts[:, segment].tolist()) - 1)))
            found = sent.groupBy("cluster", "crowd", "block").cogroup(crowds.groupBy("cluster", "crowd", "block")).applyInArrow(
                _walk(self.width, self.kind, k, same), "key bigint, slot int, vec_id bigint, score bigint")
            found = found if best is None else best.select("key", "slot", "vec_id", "score").unionByName(found)
            best = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "negatives-found")
            if segment + 1 < self.segments:
                kth = best.where(F.col("rank") == k).select("key", "slot", F.col("score").alias("least"), F.col("vec_id").alias("last"))
                ahead = self.anchors.select("key", (F.col("norm") * self._by_cluster(self.limits[:, segment].tolist()) * (1 + 1e-9) + 1e-6).alias("reach"))
                state = (slots.join(kth, ["key", "slot"], "left").fillna({"least": _LOWEST, "last": _HIGHEST}).join(ahead, "key")
                         .where("reach >= low and reach >= least").drop("reach"))
                if state.isEmpty():
                    break
        return best


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                        scale: int = 256, clusters: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among vectors(vec_id, embedding, label).

    Components are floor(scale * x), a score is the inner product with the anchor; higher scores come first, equal ones by the smaller
    vec_id. An anchor's positives are its first other rows of the same label; a positive's negatives the first rows of
    another label whose score lies between ``low`` and ``high`` percent of the positive's. All are exact; fewer rows give all of them, a positive without negatives none.
    Rows with a NULL vec_id, label or vector, or with NULL or non-finite components, take no part; shorter vectors end in
    zeros, a vector of zeros scores 0 with all. A row's own vec_id is never its result; repeated rows of other ids are results of their own, repeated anchor rows
    ask once. Scores have to fit 61 bits. Other columns are ignored; an empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label")
    if vectors.schema["label"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        label = F.xxhash64(label)
    rows = (vectors.where("vec_id is not null and embedding is not null and label is not null").where(~bad)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
                    F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")))
    rows = written(rows, "negatives-rows")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n"), F.coalesce(largest, F.lit(0)).alias("largest"),
                     F.count_if(is_anchor).alias("anchors")).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], out)
    lists = _Lists(rows, is_anchor, facts, clusters or min(CLUSTERS, -(-facts["anchors"] // 128), isqrt(facts["n"]) + 1))
    every = lists.anchors.select("key", F.lit(1).alias("slot"), F.lit(_LOWEST).alias("low"), F.lit(_HIGHEST).alias("high"))
    near = lists.walk(every, positives, True).select("key", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"),
                                                     F.col("score").alias("positive_score"))

    def hundredths(of: str) -> Column:  # rounded down
        return F.expr(f"({of} - pmod({of}, 100)) div 100")

    asked = near.select("key", "slot", (-hundredths(f"-{low} * positive_score")).alias("low"), hundredths(f"{high} * positive_score").alias("high"))
    far = lists.walk(asked.where("low <= high"), negatives, False)
    return (far.join(near, ["key", "slot"]).join(lists.anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
