"""Exact top-k inner products: vectors by descending length, partial sums in a rotated basis, residual bounds.

Candidates are packed into blocks by descending length, so a block's first vector bounds all
its inner products. The rotation, from the singular vectors of all candidates, puts most of a
vector's length into its first coordinates: a sum over those plus the Cauchy-Schwarz bound of
the rest leaves few candidates whose whole integer inner product has to be taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplake.llm.shared import written

BLOCK = 4096  # candidates of a block
QUERY_BLOCK = 512
GROUP = 16  # query blocks that meet a candidate block in one task
LEADING = 0.25  # of the rotated coordinates are summed before pruning

_PACKED = "block bigint, norm double, ids binary, vectors binary, least binary, last binary"
_LAST = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * component) of vectors without NULL or non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers; shorter ones end in zeros."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    return out


def _gram(width: int):
    """Rows of the sum of v v' over a task's vectors."""
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width).astype(float)
            total += m.T @ m
        yield pa.record_batch({"i": pa.array(range(width), pa.int32()), "row": pa.array([r.tobytes() for r in total], pa.binary())})
    return run


def _add_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(x.as_buffer()) for x in table.column("row")]
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Singular vectors by falling singular value; width * width numbers reach the driver."""
    rows = vectors.mapInArrow(_gram(width), "i int, row binary").groupBy("i").applyInArrow(_add_rows, "i int, row binary").collect()
    gram = np.zeros((width, width))
    for r in rows:
        gram[r["i"]] = np.frombuffer(bytes(r["row"]))
    return np.linalg.eigh(gram)[1][:, ::-1]


def _packed(width: int, size: int):
    """Blocks of up to ``size`` vectors, longest first; a block's number holds its partition's."""
    def run(batches):
        from pyspark import TaskContext

        ids, rows, least, last = [], [], [], []
        for batch in batches:
            ids.append(np.asarray(batch.column("vec_id")))
            rows.append(_matrix(batch.column("v"), width))
            least.append(np.asarray(batch.column("least")))
            last.append(np.asarray(batch.column("last")))
        if not ids:
            return
        ids, rows, least, last = (np.concatenate(x) for x in (ids, rows, least, last))
        norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        order = np.lexsort((ids, -norms))
        first = TaskContext.get().partitionId() << 20
        for i, at in enumerate(range(0, len(order), size)):
            part = order[at:at + size]
            yield pa.record_batch({"block": pa.array([first + i], pa.int64()), "norm": [float(norms[part[0]])],
                                   "ids": pa.array([ids[part].tobytes()], pa.binary()), "vectors": pa.array([rows[part].tobytes()], pa.binary()),
                                   "least": pa.array([least[part].tobytes()], pa.binary()), "last": pa.array([last[part].tobytes()], pa.binary())})
    return run


def _search(width: int, k: int, rotation: np.ndarray):
    """The best k candidates of a block for every query of the query blocks, none that is surely too low: behind (least, last),
    the score and vec_id of a query's k-th row so far."""
    lead = max(1, int(width * LEADING))

    def best(queries, ids_q, least, last, vectors, ids, found):
        small = max(int(np.abs(queries).max(initial=0)), int(np.abs(vectors).max(initial=0))) ** 2 * width < 2 ** 53
        exact = vectors.astype(float) if small else vectors
        turned_q, turned = queries @ rotation, vectors @ rotation
        norms, norms_q = np.sqrt((turned ** 2).sum(axis=1)), np.sqrt((turned_q ** 2).sum(axis=1))
        rest, rest_q = np.sqrt((turned[:, lead:] ** 2).sum(axis=1)), np.sqrt((turned_q[:, lead:] ** 2).sum(axis=1))
        for i, query in enumerate(exact_rows(queries, small)):
            slack = 1e-9 * norms_q[i] * norms[:1].max(initial=0) + 1e-6
            low = least[i] - slack
            # longest first: behind the first vector that is too short all are
            reach = len(norms) if low <= 0 or not norms_q[i] else int(np.searchsorted(-norms, -low / norms_q[i], "right"))
            if not reach:
                continue
            bound = turned[:reach, :lead] @ turned_q[i, :lead] + rest[:reach] * rest_q[i]
            left = np.flatnonzero((bound >= low) & (ids[:reach] != ids_q[i]))
            scores = (exact[left] @ query).astype(np.int64)
            # beyond 2**53 a float tells neighbouring scores apart no more, so nothing equal is dropped
            before = (scores > least[i]) | ((scores == least[i]) & ((ids[left] < last[i]) | (abs(least[i]) >= 2 ** 53)))
            left, scores = left[before], scores[before]
            if len(left) > k:
                kth = np.partition(scores, len(left) - k)[len(left) - k]
                left, scores = left[scores >= kth], scores[scores >= kth]
            order = np.lexsort((ids[left], -scores))[:k]
            if len(order) == k:  # the task's next blocks need only what comes before
                least[i], last[i] = scores[order[-1]], ids[left[order[-1]]]
            found.append((np.full(len(order), ids_q[i]), ids[left[order]], scores[order]))

    def exact_rows(queries, small):
        return queries.astype(float) if small else queries

    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        asked = [(q, np.frombuffer(q["ids"], np.int64), np.frombuffer(q["least"], float).copy(), np.frombuffer(q["last"], np.int64).copy())
                 for q in queries.to_pylist()]
        for c in sorted(blocks.to_pylist(), key=lambda c: -c["norm"]):
            ids = np.frombuffer(c["ids"], np.int64)
            vectors = np.frombuffer(c["vectors"], np.int64).reshape(len(ids), width)
            for q, ids_q, least, last in asked:
                best(np.frombuffer(q["vectors"], np.int64).reshape(len(ids_q), width), ids_q, least, last, vectors, ids, found)
        a, b, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": a, "vec_id": b, "score": s})
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query row with all other rows of vectors(vec_id, embedding).

    Components are floor(scale * x), and inner products have to fit 64 bits; equal scores go to the smaller vec_id. Rows with a NULL vec_id or vector, or
    with NULL or non-finite components, take no part; shorter vectors end in zeros. A query's own
    vec_id is never its result, repeated rows of other ids are results of their own. Fewer than k
    candidates give all of them. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(whole_numbers(vectors, scale), "topk-rows")
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(1, facts["width"])
    rotation = _rotation(rows, width)
    squares = F.aggregate("v", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double"))
    slices = -(-facts["n"] // (4 * BLOCK))
    none, behind = F.lit(float("-inf")), F.lit(_LAST)
    candidates = written(rows.withColumns({"least": none, "last": behind}).repartitionByRange(slices, squares.desc(), F.col("vec_id"))
                         .mapInArrow(_packed(width, BLOCK), _PACKED), "topk-blocks")
    asked = rows.where(is_query)
    n_queries = asked.count()
    n_groups, n_sets = -(-n_queries // (GROUP * QUERY_BLOCK)) or 1, -(-facts["n"] // BLOCK)
    search, out = _search(width, k, rotation), "query_id bigint, vec_id bigint, score bigint"

    def query_blocks(queries: DataFrame) -> DataFrame:
        return queries.repartitionByRange(n_groups, "vec_id").mapInArrow(_packed(width, QUERY_BLOCK), _PACKED).withColumn("g", _part("block", n_groups))

    def searched(queries: DataFrame, blocks: DataFrame, sets: int) -> DataFrame:
        """Every query block meets every candidate block, as many at a time as one group holds."""
        queries = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
        blocks = blocks.withColumn("c", _part("block", sets)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        return queries.groupBy("c", "g").cogroup(blocks.groupBy("c", "g")).applyInArrow(search, out)

    # the longest vectors first: they give each query a score to reach
    longest = candidates.orderBy(F.col("norm").desc(), "block").select("block").first()["block"]
    first = written(searched(query_blocks(asked.withColumns({"least": none, "last": behind})), candidates.where(F.col("block") == longest), 1), "topk-first")
    least = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"), F.col("vec_id").alias("last"))
    # then all other blocks, in which only what may reach that score is multiplied out
    aimed = asked.join(least, "vec_id", "left").withColumns({"least": F.coalesce("least", none), "last": F.coalesce("last", behind)})
    second = searched(query_blocks(aimed), candidates.where(F.col("block") != longest), n_sets)
    return _ranked(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def _part(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
