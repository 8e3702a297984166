"""Vector functions on arrays, and distances of stated queries to all vectors in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and vectors of a block: their distances take 8 MB.
QUERIES, VECTORS = 256, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double; null for a zero vector."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """rows (id, group, v) in blocks of about `size`, a row each; how many there are follows from the count."""
    many = max(1, -(-rows.count() // size))
    block = F.pmod(F.xxhash64("id"), F.lit(many))
    return rows.groupBy(block.alias(f"{prefix}_block")).agg(F.collect_list(F.struct("id", "group", "v")).alias(prefix))


def _matrix(items: pa.ListScalar, field: str = "v") -> np.ndarray:
    lists = items.values.field(field)
    width = len(lists[0])
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(1))[:, None]


def by_blocks(queries: DataFrame, vectors: DataFrame, each: Callable[[dict, dict, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What `each` makes of every block of queries with every block of vectors: it is called with both blocks' columns (id, group and what else the
    queries carry) and the cosine distances, 9 places, NaN where a vector is zero.

    queries, vectors: id long, group, v array<double> of one width, not null. Blocks meet, rows don't: a stated query set against all vectors is so many
    products of small matrices, of which each holds a block's share and no more. A vector isn't its own neighbour; `each` sees that.
    """
    extra = [c for c in queries.columns if c not in ("id", "group", "v")]
    many = max(1, -(-queries.count() // QUERIES))
    q = queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(many)).alias("q_block")).agg(F.collect_list(F.struct("id", "group", "v", *extra)).alias("q"))
    met = q.crossJoin(_blocks(vectors, VECTORS, "x")).select("q", "x")

    def run(batches):
        for rb in batches:
            for q, x in zip(rb.column("q"), rb.column("x"), strict=True):
                cols = [{c: b.values.field(c).to_numpy(zero_copy_only=False) for c in names} for b, names in ((q, ("id", "group", *extra)), (x, ("id", "group")))]
                near = np.round(1 - _unit(_matrix(q)) @ _unit(_matrix(x)).T, 9)
                yield each(*cols, np.where(cols[0]["id"][:, None] == cols[1]["id"][None, :], np.nan, near))

    return met.mapInArrow(run, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, id, distance): the `k` nearest of each query, by distance and id. A block gives k at most for each query, of which the k least stay."""

    def least(q, x, d):
        order = np.lexsort((np.broadcast_to(x["id"], d.shape), d), axis=1)[:, :k]
        at = np.take_along_axis(d, order, 1)
        some = ~np.isnan(at)
        who = np.broadcast_to(q["id"][:, None], at.shape)
        return pa.record_batch({"query": pa.array(who[some], pa.int64()), "id": pa.array(x["id"][order][some], pa.int64()), "distance": pa.array(at[some], pa.float64())})

    found = by_blocks(queries, vectors, least, "query long, id long, distance double")
    # pairs of a query are merged in two steps, so that one of very many blocks is in no one task
    top = lambda rows, by: rows.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("top")).select("query", F.inline("top"))
    part = found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    return top(top(part, ["query", "part"]), ["query"]).select("query", "id", "distance")


def first_relevant(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, rank): how many vectors come before a query's nearest one of the same group, plus one, by distance and id. Queries without any have no row.

    Nothing is sorted: the nearest of the group is a least value over blocks, and those before it are counted in a second pass.
    """

    def relevant(q, x, d):
        same = np.where(q["group"][:, None] == x["group"][None, :], d, np.nan)
        at = np.lexsort((np.broadcast_to(x["id"], d.shape), same), axis=1)[:, 0]
        best = same[np.arange(len(at)), at]
        some = ~np.isnan(best)
        return pa.record_batch({"query": pa.array(q["id"][some], pa.int64()), "id": pa.array(x["id"][at][some], pa.int64()), "distance": pa.array(best[some], pa.float64())})

    best = by_blocks(queries, vectors, relevant, "query long, id long, distance double").groupBy("query").agg(F.min(F.struct("distance", "id")).alias("best"))
    told = queries.join(best.select(F.col("query").alias("id"), F.col("best.distance").alias("best"), F.col("best.id").alias("best_id")), "id")

    def before(q, x, d):
        n = ((d < q["best"][:, None]) | ((d == q["best"][:, None]) & (x["id"][None, :] < q["best_id"][:, None]))).sum(1)
        return pa.record_batch({"query": pa.array(q["id"], pa.int64()), "n": pa.array(n, pa.int64())})

    counted = by_blocks(told, vectors, before, "query long, n long")
    return counted.groupBy("query").agg((F.sum("n") + 1).alias("rank"))
