"""SimHash near-dedup with pivot distance tables.

Every text gets a fingerprint: a bit is set if it is set in over half of the hashes of its word
shingles. Fingerprints that share chosen bits meet in a block. There their Hamming distances to many
reference fingerprints are tabled; a pair whose distances to any reference differ by more than the
allowed bits is discarded, the rest are verified. Blocks give spanning links only, never all pairs of a
group.

Two choices of bits: `pigeonhole` cuts 64 bits into blocks so that no pair within the allowed bits is
missed; `sampled` takes random sets of bits of longer fingerprints, for larger distances.

`keep_one` goes by the Jaccard similarity of shingle sets instead: sets that can have it share one of their
rarest shingles and meet in its block, fingerprints discard what is far apart, the sets of the rest are compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import by_runs, components, drop, table

#: Shingles hashed at once, so that a very long text takes little memory.
STEP = 1 << 16
#: A block of more rows than this is dealt out as pairs of tiles.
TILE = 4096


@dataclass(frozen=True)
class Rule:
    """words: in a shingle. bits: of a fingerprint, a multiple of 64. max_diff: differing bits that still link.

    blocks, same: for 64 bits, `same` of `blocks` blocks must be equal; blocks - same >= max_diff misses nothing.
    tables, band: else so many random sets of `band` bits must be equal.
    references: reference fingerprints tabled in a block.
    """

    words: int = 3
    bits: int = 64
    max_diff: int = 3
    blocks: int = 6
    same: int = 3
    tables: int = 0
    band: int = 0
    references: int = 16

    def masks(self) -> np.ndarray:
        """(sets of bits, words of 64 bits)."""
        if self.tables:
            rng = np.random.default_rng(7)
            out = np.zeros((self.tables, self.bits), np.uint8)
            for row in out:
                row[rng.choice(self.bits, self.band, replace=False)] = 1
            return np.packbits(out, axis=1, bitorder="little").view(np.uint64)
        if self.bits != 64 or self.blocks - self.same < self.max_diff:
            raise ValueError("these blocks could miss a pair")
        cut = [64 * i // self.blocks for i in range(self.blocks + 1)]
        block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cut)]
        return np.array([[sum(x)] for x in itertools.combinations(block, self.same)], np.uint64)


#: Shingles of five words. Two sets of Jaccard similarity 0.8 lie at a cosine of 8/9 or more, where 39 of 256 bits differ,
#: give or take 6. The limit only spares work: it lies 7 deviations above, and what passes is verified exactly.
NEAR = Rule(words=5, bits=256, max_diff=80)
#: Differing bits of pairs verified first: most are near copies, and the groups that they make need no more pairs.
SURE = 40
#: Cells of the table of counts, which every task gets: a byte each. It is made in SLICES slices.
CELLS, SLICES = 1 << 22, 1 << 16
#: Shingles counted at once within a task; of a cell that these fill so often or oftener the multiples of WEIGHT travel apart.
COUNTED, WEIGHT = 1 << 22, 64
#: A block of near copies of more rows than this is dealt out as pairs of tiles.
NEAR_TILE = 2048
#: Sets are verified in so many places that they fill each with some 40 times this at most, as a set has about as many keys.
PLACE_BYTES = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of a text in turn, STEP at most at once; none of a text without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size)
    n = max(1, len(w) - words + 1)
    begin, end = (end - size)[:n].tolist(), (end[min(words, len(w)) - 1 :] - 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        yield np.array([digest(line[a:b], 42) for a, b in zip(begin[at : at + STEP], end[at : at + STEP], strict=True)], np.uint64)


def _majority(steps: Iterable[np.ndarray], bits: int) -> bytes:
    """The bits set in over half of the hashes, little-endian; the first 64 are those of the hashes, the next of mixes of them."""
    total, n = np.zeros(bits, np.int64), 0
    for h in steps:
        n += len(h)
        for part in range(bits // 64):
            x = h if not part else _mix(h + np.uint64(0x9E3779B97F4A7C15 * part % (1 << 64)))
            total[64 * part : 64 * part + 64] += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int32)
    return np.packbits(total * 2 > n, bitorder="little").tobytes()


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> bytes:
    """Of all shingles of a text, repeats counted; zero for one without words."""
    return _majority(_hashes(text, words), bits)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of a text's shingles: their hashes, ascending."""
    steps = list(_hashes(text, words))
    return np.unique(np.concatenate(steps)) if steps else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, fp) for each row of `docs`; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").cast(pa.int64()), pa.array([fingerprint(t.as_py(), rule.words, rule.bits) for t in rb.column("text")], pa.binary())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp binary")


def _apart(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def pivots(fp: np.ndarray, references: int) -> np.ndarray:
    """The pivot table's rows: Hamming distances of fingerprints (n, words) to the reference fingerprints, 255 at most (that widens no difference)."""
    at = np.random.default_rng(11).integers(0, 1 << 63, (references, fp.shape[1]), np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([np.minimum(_apart(fp ^ r), 255) for r in at], axis=1).astype(np.uint8) if len(fp) else np.zeros((0, references), np.uint8)


def _far(far: np.ndarray, x: np.ndarray, y: np.ndarray, max_diff: int) -> np.ndarray:
    """Which of the pairs x, y no reference tells apart: no coordinate differs by more than max_diff."""
    return (np.maximum(far[x], far[y]) - np.minimum(far[x], far[y])).max(axis=1, initial=0) <= max_diff


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype)


def _tabled(rule: Rule):
    """Adds to rows with `fp` the column `far`, their rows of the pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            far = pivots(_matrix(rb.column("fp"), np.uint64), rule.references)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([x.tobytes() for x in far], pa.binary())], [*rb.schema.names, "far"])

    return run


def _blocks(rule: Rule):
    """(node, fp, far) -> (key, node, fp, far): a row for each set of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = rule.masks()
        for rb in batches:
            if not rb.num_rows:
                continue
            fp = np.frombuffer(b"".join(rb.column("fp").to_pylist()), np.uint64).reshape(rb.num_rows, -1)
            for t, mask in enumerate(masks):
                key = np.full(len(fp), t + 1, np.uint64)
                for x in (fp & mask).T:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ x)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(rb.column(x) for x in ("node", "fp", "far"))], ["key", "node", "fp", "far"])

    return run


def _links(rule: Rule):
    """Whole blocks (key, node, fp, far) -> (a, b): enough links to hold each block's groups together."""

    def fn(t: pa.Table) -> pa.RecordBatch:
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        many = np.append(False, key[1:] == key[:-1]) | np.append(key[1:] == key[:-1], False)
        key, node, fp, far = key[many], node[many], _matrix(t.column("fp"), np.uint64)[many], _matrix(t.column("far"), np.uint8)[many]
        a, b = [], []
        if len(key):
            o = np.lexsort((far[:, 0], key))
            key, node, fp, far = key[o], node[o], fp[o], far[o]
            first = far[:, 0].astype(np.int16)
            group = np.arange(len(key))
            i, step = np.arange(len(key)), 0
            while True:
                step += 1
                i = i[i + step < len(key)]
                i = i[(key[i + step] == key[i]) & (first[i + step] - first[i] <= rule.max_diff)]  # sorted: further ones are no nearer
                if not len(i):
                    break
                x = i[group[i] != group[i + step]]
                x = x[_far(far, x, x + step, rule.max_diff)]
                x = x[_apart(fp[x] ^ fp[x + step]) <= rule.max_diff]
                if len(x):
                    a.append(node[x])
                    b.append(node[x + step])
                    low = np.minimum(group[x], group[x + step])
                    np.minimum.at(group, group[x].copy(), low)
                    np.minimum.at(group, group[x + step].copy(), low)
                    for _ in range(3):
                        group = group[group]
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])

    return lambda batches: by_runs(batches, "key", fn)


def links(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that join what lies within rule.max_diff, from (node, fp), fps distinct."""
    tabled = nodes.select("node", "fp").mapInArrow(_tabled(rule), "node long, fp binary, far binary")
    rows = tabled.mapInArrow(_blocks(rule), "key long, node long, fp binary, far binary")
    large = table(rows.groupBy("key").count().where(F.col("count") > TILE).select(F.col("key").alias("hot"), F.ceil(F.col("count") / TILE).alias("tiles")), "large-blocks")
    if large.isEmpty():
        return _dealt(rows, rule)
    rows = rows.join(large, F.col("key") == F.col("hot"), "left")
    cold = rows.where("hot IS NULL").select("key", "node", "fp", "far")
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    tiled = rows.where("hot IS NOT NULL").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tiled = tiled.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "fp", "far")
    return _dealt(cold.unionByName(tiled), rule)


def _dealt(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links(rule), "a long, b long").distinct()


def groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`: component_id is the smallest doc_id that links reach.

    Equal fingerprints, those of empty texts too, link. Rows without doc_id link as others do; a group
    of only such rows has a null component_id.
    """
    fp = table(fingerprints(docs, rule), "fingerprints")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id())
    nodes = table(nodes, "nodes")  # written: the numbers stay
    roots = components(links(nodes, rule))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    return fp.join(nodes.join(low, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    number = F.concat(*[F.substring("fp", i, 1) for i in range(8, 0, -1)])
    return groups(docs).select("doc_id", F.lower(F.hex(number)).alias("fingerprint"), "component_id")


def _sliced(rule: Rule):
    """(text) -> (slice, weight, cells): the shingles of whole sets as cells of SLICES slices, COUNTED at once; a cell that COUNTED rows hold often stands there by WEIGHT."""

    def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        h, n = np.unique((h >> np.uint32(6) << np.uint32(16)) | (h & np.uint32(63)) << np.uint32(10) | h >> np.uint32(22), return_counts=True)  # slice, its cell of the table, the rest
        n = n.astype(np.int32)
        for weight, times in ((1, n % WEIGHT), (WEIGHT, n // WEIGHT)):
            x = np.repeat(h, times)
            if len(x):
                slices, at = np.unique(x >> np.uint32(16), return_index=True)
                cells = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((2 * np.append(at, len(x))).astype(np.int32)), pa.py_buffer(x.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int64)), pa.array(np.full(len(at), weight, np.int64)), cells], ["slice", "weight", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for rb in batches:
            for t in rb.column("text"):
                held.append(shingles(t.as_py(), rule.words).astype(np.uint32))  # the lower half
                many += len(held[-1])
                if many >= COUNTED:
                    yield from rows(held)
                    held, many = [], 0
        if held:
            yield from rows(held)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, weight, cells), whole slices one behind another -> (slice, codes): for each of the slice's cells of the table the greatest count of a cell of 32 bits, as a code; 0 up to 2."""

    def codes(counts: np.ndarray) -> bytes:
        most = counts.reshape(64, 1024).max(axis=1)
        return np.where(most > 2, np.minimum(np.round(4 * np.log2(np.maximum(most, 1))), 127), 0).astype(np.uint8).tobytes()

    last, counts = None, np.zeros(1 << 16, np.int64)
    for rb in batches:
        done, out = [], []
        for slice_, weight, cells in zip(rb.column("slice").to_pylist(), rb.column("weight").to_pylist(), rb.column("cells"), strict=True):
            if slice_ != last:
                if last is not None:
                    done.append(last)
                    out.append(codes(counts))
                last = slice_
                counts[:] = 0
            np.add.at(counts, np.frombuffer(cells.as_buffer(), np.uint16), weight)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(out, pa.binary())], ["slice", "codes"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([codes(counts)], pa.binary())], ["slice", "codes"])


def _common(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How common shingles are in all of `docs`, by cells of their hashes: the greatest count of a cell's shingles, on a scale of logarithms.

    Every shingle of every document is counted, by 32 bits of its hash: it travels as two bytes. The table of CELLS cells doesn't grow, they are shared the more;
    but a common shingle never looks rare for it: the error is to the other side, and a set has its rarest shingles in cells without a common one.
    """
    sliced = docs.select("text").mapInArrow(_sliced(rule), "slice long, weight long, cells binary")
    got = sliced.repartition("slice").sortWithinPartitions("slice").mapInArrow(_counted, "slice long, codes binary").toArrow()  # CELLS bytes
    out = np.zeros((SLICES, CELLS // SLICES), np.uint8)
    out[got.column("slice").to_numpy()] = _matrix(got.column("codes"), np.uint8) if len(got) else 0
    del got
    pa.default_memory_pool().release_unused()
    # a slice's 64 cells lie side by side: slice and place are the upper and lower bits of the cell
    return out.ravel()


def _prefix(x: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """Members of a set, rarest first, of which two sets of the similarity share one.

    They share at least similarity * len(x) members; if none of the others but fewer than that many is shared, one of these is.
    """
    rank = common[x & np.uint64(len(common) - 1)]
    least = int(np.ceil(similarity * len(x) - 1e-9))
    return x[np.lexsort((x, rank))[: len(x) - least + 1]]


def _profiles(rule: Rule, similarity: float, common: np.ndarray):
    """(text, low) -> (of, low, fp, n, keys, far): 128 bits that stand for the shingle set, the fingerprint of its members, each once, its size, its prefix and its row of the pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for t in rb.column("text"):
                x = shingles(t.as_py(), rule.words)
                rows.append((xxhash.xxh3_128_digest(x.tobytes()), _majority([x], rule.bits), len(x), _prefix(x, common, similarity).tobytes()))
            of, fp, n, keys = zip(*rows, strict=True) if rows else ((), (), (), ())
            far = pivots(_matrix(pa.array(fp, pa.binary()), np.uint64), rule.references)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), rb.column("low"), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in far], pa.binary())], ["of", "low", "fp", "n", "keys", "far"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, keys) -> (key, node, place): place is the key's in the set, rarest first."""
    for rb in batches:
        keys = rb.column("keys").to_pylist()
        many = np.array([len(x) // 8 for x in keys], np.int64)
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), pa.array(np.repeat(rb.column("node").to_numpy(), many)), pa.array(place.astype(np.int32))], ["key", "node", "place"])


def _sets(rule: Rule):
    """(node, text) -> (node, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            sets = [shingles(t.as_py(), rule.words).tobytes() for t in rb.column("text")]
            yield pa.RecordBatch.from_arrays([rb.column("node"), pa.array(sets, pa.binary())], ["node", "members"])

    return run


def _candidates(max_diff: int, similarity: float, spanning: bool):
    """Whole blocks (key, side, node, fp, far, n, part, place) -> (key, a, b): pairs of unlike `part` within max_diff, of sizes and with the key at places that allow the similarity.

    Sets of the similarity share some number of members at least, and all of these stand at or behind the first one they share, in both.
    side: -1, or which of two tiles; then only pairs across count. `spanning`: only enough pairs to hold together what would link if all were verified.
    """

    def fn(t: pa.Table) -> pa.RecordBatch:
        key, side, node, n, part, place = (t.column(x).to_numpy() for x in ("key", "side", "node", "n", "part", "place"))
        o = np.lexsort((n, key))
        fp, far = _matrix(t.column("fp"), np.uint64)[o], _matrix(t.column("far"), np.uint8)[o]
        key, side, node, n, part, left = key[o], side[o], node[o], n[o], part[o], n[o] - place[o]
        group = np.unique(np.stack([key, part], axis=1), axis=0, return_inverse=True)[1].ravel()
        low = np.arange(int(group.max(initial=-1)) + 1)
        at, a, b = [], [], []
        i, step = np.arange(len(key)), 0
        while True:
            step += 1
            i = i[i + step < len(key)]
            i = i[(key[i + step] == key[i]) & (n[i] >= similarity * n[i + step] - 1e-9)]  # sorted by size: further ones are no nearer
            if not len(i):
                break
            x = i[(side[i] < 0) | (side[i] != side[i + step])]
            x = x[np.minimum(left[x], left[x + step]) >= similarity / (1 + similarity) * (n[x] + n[x + step]) - 1e-9]
            x = x[low[group[x]] != low[group[x + step]]]
            x = x[_far(far, x, x + step, max_diff)]
            x = x[_apart(fp[x] ^ fp[x + step]) <= max_diff]
            if len(x):
                at.append(key[x])
                a.append(np.minimum(node[x], node[x + step]))
                b.append(np.maximum(node[x], node[x + step]))
                if spanning:
                    u, v = low[group[x]], low[group[x + step]]
                    least = np.minimum(u, v)
                    np.minimum.at(low, u, least)
                    np.minimum.at(low, v, least)
                    for _ in range(3):
                        low = low[low]
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(at), cat(a), cat(b)], ["key", "a", "b"])

    return lambda batches: by_runs(batches, "key", fn)


def _similar(similarity: float):
    """Pairs (a, b) and the sets (node, members) of all of them -> the (a, b) whose sets have at least this Jaccard similarity."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        of = {k: np.frombuffer(x.as_buffer(), np.uint64) for k, x in zip(sets.column("node").to_pylist(), sets.column("members").combine_chunks(), strict=True)}
        keep = []
        for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            x, y = of[x], of[y]
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocked(nodes: DataFrame) -> DataFrame:
    """(key, node, place, tiles): the shingles in whose blocks nodes meet, of two nodes or more."""
    rows = nodes.select("node", "keys").mapInArrow(_keyed, "key long, node long, place int")
    large = rows.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / NEAR_TILE).alias("tiles"))
    return table(rows.join(large, "key"), "near-blocks")


def near_links(docs: DataFrame, nodes: DataFrame, rule: Rule, similarity: float) -> DataFrame:
    """Verified links (a, b) between `nodes` (node, low, fp, far, n, keys) that hold all groups of the similarity together; docs: (low, text).

    First come pairs that are most likely near copies, as few as a block needs. What these join is then one part,
    and all other pairs of a block, those between parts, are verified.
    """
    blocks = _blocked(nodes)

    def verified(part: DataFrame, max_diff: int, spanning: bool) -> DataFrame:
        rows = blocks.join(part.select("node", "fp", "far", "n", "part"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).cast("long")
        tiles = rows.select(F.when(F.col("tiles") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), side.alias("side"), "node", "fp", "far", "n", "part", "place")
        pairs = tiles.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates(max_diff, similarity, spanning), "key long, a long, b long")
        pairs = table(pairs.groupBy("a", "b").agg(F.min("key").alias("key")), "near-pairs")
        ends = lambda g: pairs.select(*g, F.col("a").alias("node")).union(pairs.select(*g, F.col("b").alias("node"))).distinct()
        named = nodes.select("node", "low").join(ends([]), "node")
        sets = docs.join(named, "low").select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets(rule), "node long, members binary")
        sets = table(sets, "near-sets")
        # pairs of one block are verified in one place, so that a set goes to each block's place once and not with each of its pairs
        size = sets.agg(F.coalesce(F.sum(F.length("members")), F.lit(0)).alias("n")).first().n
        places = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PLACE_BYTES))
        place = F.pmod(F.xxhash64("key"), F.lit(places)).alias("place")
        there = ends([place]).join(sets, "node").groupBy("place")
        out = pairs.select(place, "a", "b").groupBy("place").cogroup(there).applyInArrow(_similar(similarity), "a long, b long")
        out = table(out, "near-links")
        drop(pairs, sets)
        return out

    first = verified(nodes.withColumn("part", F.col("node")), SURE, True)
    part = nodes.join(components(first), "node", "left").withColumn("part", F.coalesce("root", "node"))
    rest = verified(part, rule.max_diff, False)
    drop(blocks)
    return first.unionByName(rest)


def keep_one(docs: DataFrame, rule: Rule = NEAR, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` of which one stands for each group of near copies.

    Documents link if the sets of their shingles have at least this Jaccard similarity; sets without a member are alike.
    Of a group the row of the smallest doc_id stays, of several texts of that doc_id the one of the smallest MD5 (a null text counts as
    an empty one), of rows equal in both the one whose JSON is smallest. Rows of one doc_id that aren't near copies all
    stay, as do rows without doc_id. Columns of `docs` may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    low = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text"))
    known = docs.where("doc_id IS NOT NULL").select(low.alias("low"), "text", row.alias("row"))
    common = _common(known, rule)
    kinds = "of binary, low struct<doc_id:bigint,text:string>, fp binary, n long, keys binary, far binary"
    profiles = known.select("text", "low").mapInArrow(_profiles(rule, similarity, common), kinds)
    nodes = profiles.groupBy("of").agg(F.min("low").alias("low"), *[F.first(x).alias(x) for x in ("fp", "n", "keys", "far")]).drop("of")
    nodes = table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written: the numbers stay
    roots = components(near_links(known.select("low", "text"), nodes, rule, similarity))
    grouped = nodes.select("node", "low").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "low")
    found = grouped.groupBy("root").agg(F.min("low").alias("low")).select("low")
    rows = known.select("low", "row").join(found, "low", "left_semi")
    same = known.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low")
    once, again = rows.join(same, "low", "left_anti"), rows.join(same, "low", "left_semi")
    again = again.groupBy("low").agg(F.min_by("row", F.to_json("row")).alias("row"))
    kept = once.unionByName(again).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id IS NULL"))
