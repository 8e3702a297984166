"""What several operators of this subpackage share: scratch tables, runs of equal keys, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.scratch import scratch_dir


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.scratch_path = path
    return read


def drop(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_runs(batches: Iterator[pa.RecordBatch], key: str, fn: Callable[[pa.Table], pa.RecordBatch], least: int = 1) -> Iterator[pa.RecordBatch]:
    """Calls `fn` on whole runs of equal `key` (long) of a partition sorted by it, `least` rows or more at once; holds these, one batch and one run at most."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for rb in batches:
        if not rb.num_rows:
            continue
        k = rb.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1])) if k[0] != k[-1] else 0
        if rows + cut >= least and (cut or (held and k[0] != last)):
            yield fn(pa.Table.from_batches([*held, rb.slice(0, cut)]))
            held, rows = [], -cut
        held.append(rb.slice(-rows if rows < 0 else 0))
        rows += rb.num_rows
        last = k[-1]
    if held:
        yield fn(pa.Table.from_batches(held))


def _stars(e: DataFrame) -> bool:
    """Whether every node of `e` (u, v) points at one root, and roots at none."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out + root > 1 AND out > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long) by alternating large and small stars, until all are stars.

    Returns (node, root), root < node; nodes that are their own root have no row. A hub is never
    gathered: its minimum is a partial aggregate, and the join back is one that AQE can split.
    """
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = table(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(e, large)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
