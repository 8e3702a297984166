"""Embedding near-dedup by sorted projection passes.

In each pass vectors are ordered, within a label, by the concatenated signs of random projections of
what sets them apart from the label's mean, and every vector is compared with its next neighbours in that
order. Only the signs travel: neighbours whose signs differ little are candidates, and vectors are
fetched for these and compared in double precision. Verified pairs of all passes are united. Within a
group so found every pair is then compared, in tiles, so that links are counted whole.

How many passes a vector takes follows from the number of vectors of its label and from how close it lies
to their mean, so that a pair at the threshold is missed with a stated probability only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import by_runs, components, drop, table

#: Vectors of a group in one tile, and rows of a tile multiplied at once.
TILE, STRIP = 4096, 512
#: Signs of a vector: 63 that order, two words more that only compare.
BITS = 191
#: Numbers in all means at most that are broadcast: 16 MB.
MEANS = 2_000_000


@dataclass(frozen=True)
class Rule:
    """least: the cosine that links. window: neighbours compared. miss: how likely a pair at `least` may be missed.

    most: passes at most; reached by vectors of labels of some 10^9 rows, or of those very close to a label's mean.
    """

    least: float = 0.93
    window: int = 256
    miss: float = 0.01
    most: int = 64


def _unit(column: pa.ListArray, dim: int) -> np.ndarray:
    v = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_dim(rb: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = rb.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), rb.filter(pa.array(dims == dim))


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, low, n, dim): the distinct vectors that can link, with smallest vec_id and number of rows."""
    v = vectors.select("vec_id", "label", "embedding")
    e = F.col("embedding")
    real = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("label").isNotNull() & e.isNotNull() & real & F.exists(e, lambda x: x != 0))
    v = v.withColumn("embedding", F.transform(e, lambda x: x + F.lit(0.0).cast(x_type(vectors))))  # -0.0 is 0.0
    return v.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding"))


def x_type(vectors: DataFrame) -> str:
    return vectors.schema["embedding"].dataType.elementType.simpleString()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(space, dim, embedding) -> (space, n, total): a row for each space of a batch, the sum of its unit vectors."""
    for rb in batches:
        for dim, some in _by_dim(rb):
            unit, space = _unit(some.column("embedding"), dim), some.column("space").to_numpy()
            o = np.argsort(space, kind="stable")
            first = np.flatnonzero(np.append(True, space[o][1:] != space[o][:-1]))
            total = np.add.reduceat(unit[o], first, axis=0)
            n = np.diff(np.append(first, len(o)))
            yield pa.RecordBatch.from_arrays([pa.array(space[o][first]), pa.array(n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["space", "n", "total"])


def means(rows: DataFrame) -> DataFrame:
    """(space, many, mean): vectors of a label and length, and the mean of their unit vectors."""
    sums = rows.select("space", "dim", "embedding").mapInArrow(_sums, "space long, n long, total array<double>")
    at = sums.select("space", "n", F.posexplode("total")).groupBy("space", "pos").agg(F.sum("col").alias("x"), F.sum("n").alias("n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("x") / F.col("n")).alias("x")))), lambda s: s.x)
    return at.groupBy("space").agg(F.max("n").alias("many"), mean.alias("mean"))


@lru_cache(64)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(1000).standard_normal((dim, BITS))


@lru_cache(256)
def _turn(p: int) -> np.ndarray:
    """The order of signs in a pass."""
    return np.random.default_rng(2000 + p).permutation(BITS)


def _plan(spread: np.ndarray, many: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(passes, reach) of vectors whose squared distance from the mean is `spread`, among `many`.

    Two of them at the threshold agree in a sign with probability p. They meet in a pass if they agree in the
    log2(many / window) signs that cut a label down to a window. reach: signs in which they may differ, 4.5 deviations above the mean.
    """
    cosine = np.clip(1 - (1 - rule.least) / np.maximum(spread, 1e-12), 0, 1)
    p = 1 - np.arccos(cosine) / np.pi
    meet = p ** np.maximum(0, np.log2(many / rule.window))
    passes = np.ceil(np.log(rule.miss) / np.log1p(-np.minimum(meet, 1 - rule.miss)))
    reach = np.ceil(BITS * (1 - p) + 4.5 * np.sqrt(BITS * p * (1 - p)))
    return np.clip(passes, 1, rule.most).astype(np.int64), np.minimum(reach, BITS).astype(np.int32)


def _signed(rule: Rule, only: int | None):
    """(cid, dim, space, embedding, many, mean, part) -> a row for each pass of a vector; `only`: so many passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pass", "space", "order", "x", "y", "reach", "cid", "part"]
        for rb in batches:
            for dim, some in _by_dim(rb):
                v = _unit(some.column("embedding"), dim) - np.asarray(some.column("mean").flatten(), np.float64).reshape(-1, dim)
                passes, reach = _plan((v * v).sum(axis=1), some.column("many").to_numpy(), rule)
                if only:
                    passes = np.minimum(passes, only)
                signs = v @ _planes(dim) > 0
                space, cid, part = (some.column(x) for x in ("space", "cid", "part"))
                for p in range(int(passes.max())):
                    on = passes > p
                    bits = np.zeros((int(on.sum()), BITS + 1), bool)
                    bits[:, 1:] = signs[on][:, _turn(p)]
                    words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
                    pick = pa.array(on)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), p, np.int32)), space.filter(pick), *(pa.array(words[:, k].copy()) for k in range(3)), pa.array(reach[on]), cid.filter(pick), part.filter(pick)], names)

    return run


def _pairs(c: dict[str, np.ndarray], window: int, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among rows in order, each with the next `window` of its pass and space, of unlike part.

    spanning: only as many as hold together what would link if all were verified.
    """
    n = len(c["cid"])
    key = np.cumsum(np.append(0, (c["pass"][1:] != c["pass"][:-1]) | (c["space"][1:] != c["space"][:-1]))) if n else np.zeros(0, np.int64)
    group = np.unique(c["part"], return_inverse=True)[1] if n else np.zeros(0, np.int64)
    low = np.arange(int(group.max(initial=-1)) + 1)
    words = [np.ascontiguousarray(c[k]).view(np.uint64) for k in ("order", "x", "y")]
    a, b = [], []
    for step in range(1, min(window, n - 1) + 1):
        near = sum(np.bitwise_count(w[step:] ^ w[:-step]).astype(np.int32) for w in words)
        i = np.flatnonzero((near <= np.maximum(c["reach"][step:], c["reach"][:-step])) & (key[step:] == key[:-step]) & (group[step:] != group[:-step]))
        if spanning and len(i):
            i = i[low[group[i]] != low[group[i + step]]]
            u, v = low[group[i]], low[group[i + step]]
            least = np.minimum(u, v)
            np.minimum.at(low, u, least)
            np.minimum.at(low, v, least)
            for _ in range(3):
                low = low[low]
        a.append(c["cid"][i])
        b.append(c["cid"][i + step])
    return (np.concatenate(a), np.concatenate(b)) if a else (c["cid"][:0], c["cid"][:0])


def _all_pairs(c: dict[str, np.ndarray], window: int, spanning: bool) -> pa.RecordBatch:
    """`_pairs` of rows in order, and of the ends of their runs of one part, which so take no room in a window."""
    a, b = _pairs(c, window, spanning)
    new = (c["part"][1:] != c["part"][:-1]) | (c["pass"][1:] != c["pass"][:-1]) if len(c["cid"]) else np.zeros(0, bool)
    ends = np.flatnonzero(np.append(True, new) | np.append(new, True)) if len(c["cid"]) else np.zeros(0, np.int64)
    if len(ends) < len(c["cid"]):
        x, y = _pairs({k: v[ends] for k, v in c.items()}, window, spanning)
        a, b = np.append(a, x), np.append(b, y)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy(), pa.int64()), pa.array(both[:, 1].copy(), pa.int64())], ["a", "b"])


_COLUMNS = ["pass", "space", "order", "x", "y", "reach", "cid", "part"]
_ROW = "pass int, space long, `order` long, x long, y long, reach int, cid long, part long"


def _arrays(rb: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {k: rb.column(k).to_numpy(zero_copy_only=False) if isinstance(rb, pa.RecordBatch) else rb.column(k).to_numpy() for k in _COLUMNS}


def _windows(window: int, spanning: bool):
    """A sorted partition -> candidates (a, b), and the rows (its first and last `window`) that stand near its borders, with `task` and `nth`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, seen = TaskContext.get().partitionId(), 0
        tail: pa.RecordBatch | None = None
        late: list[tuple[int, pa.RecordBatch]] = []
        for rb in batches:
            if not rb.num_rows:
                continue
            held = rb if tail is None else pa.Table.from_batches([tail, rb]).combine_chunks().to_batches()[0]
            yield _wide(_all_pairs(_arrays(held), window, spanning))
            if seen < window:
                yield _ends(rb.slice(0, window - seen), me, seen)
            tail = held.slice(max(0, held.num_rows - window))
            seen += rb.num_rows
            late = [(seen - tail.num_rows, tail)]
        for at, rows in late:  # those that aren't out yet as first rows
            skip = max(0, window - at)
            if skip < rows.num_rows:
                yield _ends(rows.slice(skip), me, at + skip)

    return run


_OUT = f"a long, b long, task int, nth long, {_ROW}"


def _wide(pairs: pa.RecordBatch) -> pa.RecordBatch:
    n = pairs.num_rows
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([*pairs.columns, *(pa.nulls(n, k) for k in kinds)], ["a", "b", "task", "nth", *_COLUMNS])


def _ends(rows: pa.RecordBatch, me: int, at: int) -> pa.RecordBatch:
    n = rows.num_rows
    null = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([null, null, pa.array(np.full(n, me, np.int32)), pa.array(np.arange(at, at + n)), *(rows.column(k) for k in _COLUMNS)], ["a", "b", "task", "nth", *_COLUMNS])


def _borders(window: int, spanning: bool):
    return lambda batches: by_runs(batches, "edge", lambda t: _all_pairs(_arrays(t), window, spanning))


def _edges(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """(task, edge, from, to): which rows of a task stand within `window` of which border; borders nearer than that to each other are one.

    sizes: (task, rows) of tasks that have rows, in order.
    """
    out, end, edge, begins = [], 0, -1, []
    for _, n in sizes:
        begins.append(end)
        end += n
    spans: list[list[int]] = []
    for b in begins[1:]:
        if spans and b - spans[-1][1] < window:
            spans[-1][1] = b
        else:
            spans.append([b, b])
    at = 0
    for edge, (x, y) in enumerate(spans):
        low, high = x - window, y + window
        while at and begins[at] > low:
            at -= 1
        while begins[at] + sizes[at][1] <= low:
            at += 1
        k = at
        while k < len(sizes) and begins[k] < high:
            out.append((sizes[k][0], edge, low - begins[k], high - begins[k]))
            k += 1
    return out


def candidates(rows: DataFrame, rule: Rule, spanning: bool, only: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of unlike part that stand within a window in some pass and whose signs differ little; and the scratch table they come from."""
    spark = rows.sparkSession
    signed = rows.select("cid", "dim", "space", "embedding", "many", "mean", "part").mapInArrow(_signed(rule, only), _ROW)
    order = ["pass", "space", "order", "cid"]
    out = table(signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_windows(rule.window, spanning), _OUT), "windows")
    ends = out.where("task IS NOT NULL")
    sizes = [(r.task, r.n) for r in ends.groupBy("task").agg((F.max("nth") + 1).alias("n")).orderBy("task").collect()]  # a row for each task
    found = out.where("task IS NULL").select("a", "b")
    if len(sizes) > 1:
        near = spark.createDataFrame(_edges(sizes, rule.window), "at_task int, edge long, low long, high long")
        near = ends.join(F.broadcast(near), (F.col("task") == F.col("at_task")) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
        across = near.select("edge", "nth", *[F.col(c) for c in _COLUMNS], "task").repartition("edge").sortWithinPartitions("edge", "task", "nth")
        found = found.unionByName(across.mapInArrow(_borders(rule.window, spanning), "a long, b long"))
    return found.distinct(), out


def _cosines(least: float):
    """(a, b, of_a, of_b, dim) -> the (a, b) whose cosine is `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for dim, some in _by_dim(rb):
                keep = np.einsum("ij,ij->i", _unit(some.column("of_a"), dim), _unit(some.column("of_b"), dim)) >= least
                yield some.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified(pairs: DataFrame, c: DataFrame, least: float) -> DataFrame:
    of = lambda side: c.select(F.col("cid").alias(side), F.col("label").alias(f"label_{side}"), F.col("dim").alias(f"dim_{side}"), F.col("embedding").alias(f"of_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where("label_a = label_b AND dim_a = dim_b")
    return both.select("a", "b", "of_a", "of_b", F.col("dim_a").alias("dim")).mapInArrow(_cosines(least), "a long, b long")


def found_links(c: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Verified links (a, b) between classes that hold the groups together.

    A first pass gives as few candidates as its windows need; what they link, once verified, is one part. All passes then
    compare what is of unlike parts, so that a large group isn't paired with itself again and again.
    """
    rows = c.withColumn("space", F.xxhash64("label", "dim"))
    m = table(means(rows), "means")
    small = (m.agg(F.sum(F.size("mean"))).first()[0] or 0) <= MEANS
    rows = rows.join(F.broadcast(m) if small else m, "space")

    def linked(parted: DataFrame, spanning: bool, only: int | None) -> DataFrame:
        pairs, windows = candidates(parted, rule, spanning, only)
        out = table(verified(pairs, c, rule.least), "links")
        drop(windows)
        return out

    first = linked(rows.withColumn("part", F.col("cid")), True, 1)
    parted = rows.join(components(first).withColumnRenamed("node", "cid"), "cid", "left").withColumn("part", F.coalesce("root", "cid"))
    return first.unionByName(linked(parted, False, None))


def _counts(least: float):
    """Whole tiles (key, root, low, high, side, cid, n, dim, embedding) -> (cid, links): links of each row with rows of the other side, copies counted."""

    def fn(t: pa.Table) -> pa.RecordBatch:
        cid, n, side, dim = (t.column(x).to_numpy() for x in ("cid", "n", "side", "dim"))
        tile = np.stack([t.column(x).to_numpy() for x in ("root", "low", "high")])
        key, out = t.column("key").to_numpy(), np.zeros(len(cid), np.int64)
        cut = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(axis=0)))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True):
            v = _unit(t.column("embedding").slice(a, b - a).combine_chunks(), int(dim[a]))
            s = side[a:b]
            across = bool(s.any())
            for at in range(0, b - a, STRIP):
                hit = v[at : at + STRIP] @ v.T >= least
                hit &= s[at : at + STRIP, None] != s[None, :] if across else cid[a + at : min(b, a + at + STRIP), None] != cid[None, a:b]
                out[a + at : min(b, a + at + STRIP)] = hit @ n[a:b]
        return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(out)], ["cid", "links"])

    return lambda batches: by_runs(batches, "key", fn)


def dedup(vectors: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """vec_id, n_links, component_id, kept, a row for each row of `vectors`.

    Vectors of different labels or lengths are never compared. A row without label, and a vector that is
    null, empty or zero or has a null, NaN or infinite component, links with nothing. Equal vectors link.
    A row without vec_id has a component_id if its group has one. Other columns of `vectors` aren't looked at.
    """
    c = table(classes(vectors).withColumn("cid", F.monotonically_increasing_id()), "vectors")  # written: the numbers stay
    roots = components(found_links(c, rule))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    member = table(c.join(member, c.cid == member.node).select("cid", "root", "n", "low", "dim", "embedding"), "members")
    size = member.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"), F.min("low").alias("low"))
    tiles = member.drop("low").join(size.drop("low"), "root").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("tiles")))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiles = tiles.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    tiles = tiles.select(F.xxhash64("root", "low", "high").alias("key"), "root", "low", "high", "side", "cid", "n", "dim", "embedding")
    tiles = tiles.repartition("key").sortWithinPartitions("key", "root", "low", "high").mapInArrow(_counts(rule.least), "cid long, links long")
    counted = tiles.groupBy("cid").agg(F.sum("links").alias("links"))
    known = member.select("cid", "root").join(size.select("root", F.col("low").alias("component")), "root").join(counted, "cid").select("cid", "component", "links")
    known = c.join(known, "cid", "left").select("label", "embedding", "n", F.coalesce("component", "low").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0.0).cast(x_type(vectors))).alias("embedding"))
    out = rows.join(known, ["label", "embedding"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: For the threshold 0.93: all pairs, and what they reach.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS root, vec_id AS node FROM embeddings UNION SELECT root, b FROM r JOIN l ON node = a),
c AS (SELECT node AS vec_id, min(root) AS component_id FROM r GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
