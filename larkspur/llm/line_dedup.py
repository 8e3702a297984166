"""Line dedup by two Bloom filters: only lines that the second one takes for repeats travel to be confirmed.

1. Each document's lines are hashed to 64 bits. Hashes, not lines, are dealt to slices, each of which streams them through two Bloom filters of its
   own: a hash goes into the filter of those seen once, and if it is there already, into that of those seen twice. The second filters of all slices
   are broadcast as one.
2. The documents are read again. A line that isn't in the filter is in no other document, and stays. Of the suspected ones, SHA-256 digests travel:
   the least doc_id of each is a partial aggregate, so that a line of a third of all documents is one row of each task.
3. Documents that lose lines meet their lists by doc_id; all others are never shuffled.

A Bloom filter misses no repeat, and what it suspects wrongly is cleared by the digests, so the result doesn't depend on its size. The broadcast
filter has two bits a line, up to `Setup.filter_bits`; beyond that more is suspected, at worst all: a digest of 32 bytes a line then travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larkspur.llm.shared import drop, table


@dataclass(frozen=True)
class Setup:
    """least: code points of a key that counts. slice_lines: lines of a slice. filter_bits: the broadcast filter's bits at most (64 MB)."""

    least: int = 10
    slice_lines: int = 1 << 20
    filter_bits: int = 1 << 29


#: Bits that a hash sets in a filter.
BITS = 4


def keys(raw: bytes, least: int) -> list[bytes | None]:
    """Of each line its key, None if that has fewer than `least` code points: stripped and lower-cased, in ASCII only."""
    out: list[bytes | None] = []
    for line in raw.split(b"\n"):
        key = line.strip().lower()  # bytes: both know ASCII only
        n = len(key)
        out.append(key if n >= least and (n >= 4 * least or len(key.decode()) >= least) else None)
    return out


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """Of each hash the BITS places of a filter of `bits` (a power of two) bits, by double hashing."""
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17) | np.uint64(1)
    return (h[:, None] + step[:, None] * np.arange(1, BITS + 1, dtype=np.uint64)) & np.uint64(bits - 1)


class Bloom:
    """Bits in bytes."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(bits // 8, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = places(h, self.bits)
        return ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)

    def add(self, h: np.ndarray) -> None:
        at = places(h, self.bits).ravel()
        np.bitwise_or.at(self.data, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _texts(rb: pa.RecordBatch) -> Iterator[bytes]:
    for t in rb.column("text").cast(pa.binary()):
        yield t.as_py() or b""


def _hashes(least: int) -> Callable:
    """(h, twice): the hashes of a batch, once each; twice: in two documents of the batch."""

    def run(batches):
        for rb in batches:
            each = [np.unique(np.array([xxhash.xxh3_64_intdigest(k) for k in keys(raw, least) if k is not None], np.uint64)) for raw in _texts(rb)]
            h, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, int))
            yield pa.record_batch({"h": h.view(np.int64), "twice": n > 1})

    return run


def _slice(h: np.ndarray, slices: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(slices)


def _build(once_bits: int, twice_bits: int) -> Callable:
    """(slice, bits): the filter of what was seen twice, of each slice in the partition; two filters a slice are held."""

    def run(batches):
        pair: dict[int, tuple[Bloom, Bloom]] = {}
        for rb in batches:
            if not rb.num_rows:
                continue
            of = rb.column("slice").to_numpy()
            h, twice = rb.column("h").to_numpy().view(np.uint64), rb.column("twice").to_numpy(zero_copy_only=False)
            for s in np.unique(of):
                once, again = pair.setdefault(int(s), (Bloom(once_bits), Bloom(twice_bits)))
                mine = of == s
                u, at, n = np.unique(h[mine], return_inverse=True, return_counts=True)
                more = (n > 1) | (np.bincount(at, twice[mine], len(u)) > 0)
                again.add(u[more | once.has(u)])
                once.add(u)
        if pair:
            yield pa.record_batch({"slice": pa.array(list(pair), pa.int32()), "bits": pa.array([b.data.tobytes() for _, b in pair.values()], pa.binary())})

    return run


def repeats_filter(docs: DataFrame, setup: Setup = Setup()) -> tuple[dict[int, bytes], int, int]:
    """(slice to its filter of lines seen twice, slices, bits of a slice). What comes to the driver has `setup.filter_bits` bits at most."""
    hashes = table(docs.select("text").mapInArrow(_hashes(setup.least), "h long, twice boolean"), "line-hashes")
    lines = hashes.count()
    slices = max(1, -(-lines // setup.slice_lines))
    twice_bits = 1 << int(np.log2(max(512, min(2 * setup.slice_lines, setup.filter_bits // slices))))
    slices = min(slices, setup.filter_bits // 512)
    once_bits = 1 << int(np.ceil(np.log2(max(512, 8 * min(setup.slice_lines, max(lines, 1)), 8 * lines // slices))))
    of = F.expr(f"cast(shiftrightunsigned(h, 32) % {slices} as int)")
    built = hashes.withColumn("slice", of).repartition(slices, "slice").mapInArrow(_build(once_bits, twice_bits), "slice int, bits binary")
    out = {r["slice"]: bytes(r["bits"]) for r in built.collect()}
    drop(hashes)
    return out, slices, twice_bits


class Repeats:
    """Tells in a task which hashes the broadcast filter takes for repeats."""

    def __init__(self, shared, slices: int, bits: int):
        self.shared, self.slices, self.bits = shared, slices, bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out, of = np.zeros(len(h), bool), _slice(h, self.slices)
        for s in np.unique(of):
            data = self.shared.value.get(int(s))
            if data is not None:
                mine = of == s
                out[mine] = Bloom(self.bits, data).has(h[mine])
        return out


def _suspects(repeats: Repeats, least: int) -> Callable:
    """(key, who): digests of suspected lines, and which documents of the batch hold them; a document without doc_id goes by its text."""

    def run(batches):
        for rb in batches:
            who: dict[bytes, list] = {}
            ids = rb.column("doc_id").to_pylist()
            marks = rb.column("mark").to_pylist()
            found = [{k for k in keys(raw, least) if k is not None} for raw in _texts(rb)]
            h = np.array([xxhash.xxh3_64_intdigest(k) for ks in found for k in ks], np.uint64)
            seen = repeats(h)
            at = 0
            for doc, mark, ks in zip(ids, marks, found, strict=True):
                for i, k in enumerate(ks, at):
                    if seen[i]:
                        who.setdefault(k, []).append({"doc": doc, "mark": mark})
                at += len(ks)
            digests = pa.array([sha256(k).digest() for k in who], pa.binary())
            yield pa.record_batch({"key": digests, "who": pa.array(list(who.values()), pa.list_(pa.struct([("doc", pa.int64()), ("mark", pa.int64())])))})

    return run


def _split(repeats: Repeats, least: int, suspected: bool) -> Callable:
    """Rows whose texts hold suspected lines, or those that hold none."""

    def run(batches):
        for rb in batches:
            each = [[xxhash.xxh3_64_intdigest(k) for k in keys(raw, least) if k is not None] for raw in _texts(rb)]
            seen = repeats(np.array([h for hs in each for h in hs], np.uint64))
            at = np.cumsum([0, *map(len, each)])
            keep = [bool(seen[a:b].any()) == suspected for a, b in zip(at[:-1], at[1:], strict=True)]
            yield rb.filter(pa.array(keep, pa.bool_()))

    return run


def _cut(least: int) -> Callable:
    """(row, text, n_lines, n_dropped): without the lines whose digests `gone` lists."""

    def run(batches):
        for rb in batches:
            texts, n_lines, n_dropped = [], [], []
            for raw, gone in zip(_texts(rb), rb.column("gone").to_pylist(), strict=True):
                gone = set(gone or ())
                lines = raw.split(b"\n")
                stay = [line for line, k in zip(lines, keys(raw, least), strict=True) if k is None or sha256(k).digest() not in gone] if gone else lines
                texts.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch({"row": rb.column("row"), "text": kept, "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    return run


def _mark() -> Column:
    """Documents without doc_id are told apart by their texts, so that their lists aren't one group."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit(""))))


def dedup(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """The columns of `docs`, the text without its repeated lines, and n_lines (before), n_dropped.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of at least `setup.least` code points is dropped from all documents
    but that of the least doc_id that holds it, there all its lines stay. Lines are told apart by SHA-256.

    A null text counts as empty, one empty line, and becomes empty. Rows of equal doc_id are one document: a line stays in all of them or in
    none. Rows without doc_id come after all others: they lose what any of those holds, and nothing to each other. Columns of `docs` named
    n_lines or n_dropped are replaced. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    filters, slices, bits = repeats_filter(docs, setup)
    repeats = Repeats(docs.sparkSession.sparkContext.broadcast(filters), slices, bits)
    # the row is one struct from here on, so that no column's name can clash with these
    rows = docs.select("doc_id", _mark().alias("mark"), "text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"))

    suspects = table(rows.select("doc_id", "mark", "text").mapInArrow(_suspects(repeats, setup.least), "key binary, who array<struct<doc:long,mark:long>>"), "suspects")
    first = suspects.groupBy("key").agg(F.min(F.array_min(F.transform("who", lambda w: w.doc))).alias("first")).where("first IS NOT NULL")
    # a key has a row for each batch of documents, which AQE splits where one key has a great many
    later = suspects.join(first, "key").select("key", F.explode(F.filter("who", lambda w: w.doc.isNull() | (w.doc > F.col("first")))).alias("w"))
    gone = later.groupBy(F.col("w.doc").alias("of_doc"), F.col("w.mark").alias("of_mark")).agg(F.collect_set("key").alias("gone"))  # a document's lines at most

    clean = rows.mapInArrow(_split(repeats, setup.least, False), rows.schema)
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    clean = clean.withColumn("text", F.coalesce("text", F.lit(""))).select("row", "text", (breaks + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    hit = rows.mapInArrow(_split(repeats, setup.least, True), rows.schema)
    hit = hit.join(gone, F.col("doc_id").eqNullSafe(F.col("of_doc")) & F.col("mark").eqNullSafe(F.col("of_mark")), "left").select("row", "text", "gone")
    counts = [StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
    hit = hit.mapInArrow(_cut(setup.least), StructType([StructField("row", rows.schema["row"].dataType), StructField("text", StringType()), *counts]))
    return clean.unionByName(hit).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names], "n_lines", "n_dropped")


def digest(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """What `dedup` does to each document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup(docs.select("doc_id", "text"), setup).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: It groups all keys and knows no filter.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
