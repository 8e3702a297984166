"""Suffix-array dedup: bytes covered by a span that also starts in a document with a smaller doc_id.

Which strings can match is found first, without missing any. A window of `span` bytes is keyed by the
least hash of the GRAM-byte strings in it, which depends on the window alone; consecutive windows of
one key make one string. Keys that lie in one text only are dropped, exact copies of a text are
represented by the smallest doc_id. Each part sends the distinct strings of shared keys, with the least and
greatest doc_id that it has them in; those of one key meet in one task, where suffix arrays
(`suffix_groups`) bring equal windows together, each with the smallest doc_id it starts in. That goes back to
the parts, which find their strings again and cut.

So a passage that a third of all texts share is one row of each part. A key with very many distinct strings (a short passage
in very many surroundings) is cut into keys of longer strings, where fewer windows meet.

Texts are dealt out once, compressed, into parts of about CHUNK_BYTES by doc_id; all that is found out
about them is sent to their parts, where Spark reads the same shuffle again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm.shared import by_runs, table
from larkspur.llm.suffix_groups import arrays

GRAM = 24
#: Windows in one string at most: a text that repeats itself gives one key for long.
RUN = 64
#: Text in a chunk, and in the keys that one bucket gathers.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Text whose keys are made at once.
STEP_BYTES = 1 << 20
#: A block of more bytes than this is cut into blocks of longer strings before it is sorted, as blocks are sorted in step with the longest.
LONG_BLOCK = 1000
#: Rows whose blocks are sorted together, at least.
TOGETHER = 20_000
#: Distinct strings of a key, summed over parts, beyond which its windows become keys of their own (some 100 bytes each: 6 MB).
KEY_STRINGS = 50_000
#: Runs of windows that are compared at once.
STEP_RUNS = 1 << 20
LOW, HOT = np.uint64((1 << 32) - 1), np.uint64(1 << 62)
#: With a part's number of strings of a key: that they are of two texts or more.
TEXTS = np.uint32(1 << 31)


@dataclass
class Strings:
    """Keyed strings of texts: text number, begin in the text, number of windows, and 128 bits that stand for the bytes."""

    key: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    windows: np.ndarray
    s1: np.ndarray
    s2: np.ndarray

    def __getitem__(self, pick: np.ndarray) -> Strings:
        return Strings(*(getattr(self, f.name)[pick] for f in fields(self)))

    @staticmethod
    def joined(some: list[Strings]) -> Strings:
        return Strings(*(np.concatenate([getattr(x, f.name) for x in some]) for f in fields(Strings)))


def _strings(texts: list[bytes], span: int, gram: int = GRAM, wanted: np.ndarray | None = None, buckets: int = 0, hot: np.ndarray | None = None) -> Strings:
    """Of texts of at least `span` bytes; with `buckets` keys are cut to what is kept of them.

    wanted: only of these keys, ascending. hot: strings of these keys are cut into their windows, each a key of its own.
    """
    out, at = [], 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (total < STEP_BYTES or end == at):
            total += len(texts[end])
            end += 1
        x = _step(texts[at:end], span, gram, wanted, buckets, hot)
        x.owner = x.owner + at
        out.append(x)
        at = end
    return Strings.joined(out)


def _within(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are among `some`, ascending."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _step(texts: list[bytes], span: int, gram: int, wanted: np.ndarray | None, buckets: int, hot: np.ndarray | None) -> Strings:
    every = b"".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(every + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    n = len(every) - gram + 1
    h = np.zeros(n, np.uint64)
    for at in sorted({min(at, gram - 8) for at in range(0, gram, 8)}):
        h ^= eight[at : at + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    width, grams = 1, span - gram + 1
    while width * 2 <= grams:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if grams > width:
        h = np.minimum(h[: width - grams], h[grams - width :])
    doc = np.repeat(np.arange(len(texts)), size)[: len(h)]
    end = np.cumsum(size)
    begin = end - size
    new = np.append(True, h[1:] != h[:-1])
    new[begin] = True
    stop = np.zeros(len(h) + 1, bool)  # the first place without a window in its text
    stop[end[:-1] - span + 1] = True
    new |= stop[:-1]
    cut = np.flatnonzero(new)
    windows = np.diff(np.append(cut, len(h)))
    if (windows > RUN).any():
        parts = -(-windows // RUN)
        first = np.cumsum(parts) - parts
        nth = np.arange(int(parts.sum())) - np.repeat(first, parts)
        cut = np.repeat(cut, parts) + nth * RUN
        windows = np.minimum(RUN, np.repeat(windows, parts) - nth * RUN)
    owner = doc[cut]
    keep = cut - begin[owner] + span <= size[owner]
    key = h[cut]
    if buckets:
        key = _bucketed(key, buckets)
    if wanted is not None:
        keep &= _within(key, wanted)
    key, cut, windows, owner = key[keep], cut[keep], windows[keep], owner[keep]
    if hot is not None and len(hot) and (split := _within(key, hot)).any():
        many = windows[split]
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        single = np.repeat(cut[split], many) + nth
        cut, windows = np.append(cut[~split], single), np.append(windows[~split], np.ones(len(single), np.int64))
        owner = np.append(owner[~split], np.repeat(owner[split], many))
        key = np.append(key[~split], np.zeros(len(single), np.uint64))
        alone = np.arange(len(cut)) >= len(cut) - len(single)
    else:
        alone = None
    length = windows + span - 1
    s1, s2 = length.astype(np.uint64), length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for at in range(0, int(length.max(initial=0)), 8):
        some = slice(None) if at < span - 8 else np.flatnonzero(length > at)  # in words, the last one ending with the string
        word = eight[cut[some] + np.minimum(at, length[some] - 8)]
        for s, c in ((s1, 0x9E3779B97F4A7C15), (s2, 0xC2B2AE3D27D4EB4F)):
            x = (s[some] ^ word) * np.uint64(c)
            s[some] = x ^ (x >> np.uint64(31 if s is s1 else 27))
    if alone is not None:
        key[alone] = s1[alone] & ~HOT
    return Strings(key, owner, cut - begin[owner], windows, s1, s2)


def _representatives(texts: pa.Table, known: pa.Table) -> tuple[list[int], list[bytes]]:
    """(doc, text) of the rows of a part that represent their text, each once."""
    known = known.filter(pa.compute.equal(known.column("kind"), 0))
    own = set(zip(known.column("doc").to_pylist(), known.column("text_key").to_pylist(), strict=True))
    unzip, docs, out = zstandard.ZstdDecompressor(), [], []
    for d, k, z in zip(*(texts.column(x).to_pylist() for x in ("doc", "text_key", "z")), strict=True):
        if (d, k) in own:
            own.remove((d, k))
            docs.append(d)
            out.append(unzip.decompress(z))
    return docs, out


def _bucketed(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a key above 32 of its other bits: all of it that is kept."""
    return (key >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | key & LOW


def _sketch(buckets: int, span: int):
    """A part -> (bucket, part, keys): the distinct keys of its texts, 4 bytes each, then how many distinct strings have each, 4 bytes too, with TEXTS where several texts have it."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        names = ["bucket", "part", "keys"]
        _, some = _representatives(texts, known)
        if not some:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.binary())], names)
        x = _strings(some, span, buckets=buckets)
        x = x[np.lexsort((x.owner, x.s1, x.key))]
        key, again = x.key, np.append(False, (x.key[1:] == x.key[:-1]) & (x.s1[1:] == x.s1[:-1]))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        strings = np.add.reduceat(~again, first, dtype=np.int64)
        several = np.minimum.reduceat(x.owner, first) < np.maximum.reduceat(x.owner, first)
        many = np.minimum(strings, int(TEXTS) - 1).astype(np.uint32) | np.where(several, TEXTS, np.uint32(0))
        key = key[first]
        bucket = (key >> np.uint64(32)).astype(np.int32)
        cut = _runs(bucket)
        packed = key.astype(np.uint32)
        part = known.column("part")[0].as_py()
        return pa.table([pa.array([bucket[a] for a, _ in cut], pa.int32()), pa.array([part] * len(cut), pa.int64()), pa.array([packed[a:b].tobytes() + many[a:b].tobytes() for a, b in cut], pa.binary())], names)

    return run


def _shared(key_strings: int):
    """Whole buckets, sorted -> (part, keys): the keys that two texts have; those of more than `key_strings` strings in all parts are marked."""

    def fn(t: pa.Table) -> pa.RecordBatch:
        parts, keys = [], []
        bucket = t.column("bucket").to_numpy()
        for a, b in _runs(bucket):
            rows = t.slice(a, b - a)
            cells = rows.column("keys").to_pylist()
            key = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 8) for x in cells]).astype(np.uint64)
            many = np.concatenate([np.frombuffer(x, np.uint32, -1, len(x) // 2) for x in cells])
            row = np.repeat(np.arange(len(cells)), [len(x) // 8 for x in cells])
            o = np.argsort(key, kind="stable")
            k = key[o]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            total = lambda x: np.repeat(np.add.reduceat(x[o], first, dtype=np.int64), np.diff(np.append(first, len(k))))
            n, strings = total(1 + (many >= TEXTS)), total(many & ~TEXTS)
            k = k | np.uint64(int(bucket[a]) << 32) | np.where(strings > key_strings, HOT, np.uint64(0))
            k, row = k[n > 1], row[o][n > 1]
            part = rows.column("part").to_numpy()
            o = np.argsort(row, kind="stable")
            k, row = k[o], row[o]
            for c, d in _runs(row):
                parts.append(int(part[row[c]]))
                keys.append(k[c:d].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(keys, pa.binary())], ["part", "keys"])

    return lambda batches: by_runs(batches, "bucket", fn)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return list(zip(cut.tolist(), np.append(cut[1:], len(x)).tolist(), strict=True))


def _keys(known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(shared keys, those of them that are cut into windows), ascending."""
    told = [np.frombuffer(x, np.uint64) for x in known.column("keys").to_pylist() if x is not None]
    every = np.unique(np.concatenate(told)) if told else np.zeros(0, np.uint64)
    return np.sort(every & ~HOT), every[every & HOT > 0] & ~HOT


def _select(buckets: int, span: int):
    """A part -> (key, s1, s2, part, low, top, string), a row for each distinct string of a shared key, with the least and greatest doc that has it."""
    names = ["key", "s1", "s2", "part", "low", "top", "string"]
    kinds = [pa.int64()] * 6 + [pa.binary()]

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        wanted, hot = _keys(known)
        docs, some = _representatives(texts, known) if len(wanted) else ([], [])
        if not some:
            return pa.table([pa.array([], k) for k in kinds], names)
        x = _strings(some, span, GRAM, wanted, buckets, hot)
        x = x[np.lexsort((x.s2, x.s1, x.key))]
        first = np.flatnonzero(np.append(True, (x.key[1:] != x.key[:-1]) | (x.s1[1:] != x.s1[:-1]) | (x.s2[1:] != x.s2[:-1]))) if len(x.key) else np.zeros(0, np.int64)
        if not len(first):
            return pa.table([pa.array([], k) for k in kinds], names)
        doc = np.array(docs, np.int64)[x.owner]
        low, top = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        x = x[first]
        string = [some[k][a:b] for k, a, b in zip(x.owner.tolist(), x.begin.tolist(), (x.begin + x.windows + span - 1).tolist(), strict=True)]
        part = np.full(len(first), known.column("part")[0].as_py(), np.int64)
        return pa.table([pa.array(v, k) for v, k in zip((x.key.view(np.int64), x.s1.view(np.int64), x.s2.view(np.int64), part, low, top, string), kinds, strict=True)], names)

    return run


def _least(strings: list[bytes], block: np.ndarray, doc: np.ndarray, span: int, gram: int = GRAM) -> np.ndarray:
    """For each window of each string in turn: the smallest doc of an equal window in a string of the same block (blocks ascend)."""
    size = np.array([len(x) for x in strings], np.int64)
    change = block[1:] != block[:-1]
    count = size - span + 1
    out = np.repeat(doc, count)
    alone = np.append(True, change) & np.append(change, True)  # with one string in a block there is nothing to sort
    heads = np.flatnonzero(np.append(True, change))
    long = np.repeat(np.add.reduceat(size + 1, heads) > LONG_BLOCK, np.diff(np.append(heads, len(size)))) & ~alone if gram < span else np.zeros(len(size), bool)
    for pick, way in ((~alone & ~long, _sorted), (long, _finer)):
        if pick.any():
            out[np.repeat(pick, count)] = way([strings[i] for i in np.flatnonzero(pick)], block[pick], doc[pick], span, gram)
    return out


def _finer(strings: list[bytes], block: np.ndarray, doc: np.ndarray, span: int, gram: int) -> np.ndarray:
    """`_least` of blocks that are long, by strings with a longer key in common, at last by equal windows."""
    gram = min(span, gram + 13)
    x = _strings(strings, span, gram)
    places = np.cumsum([0] + [len(t) - span + 1 for t in strings])[:-1]
    o = np.lexsort((x.s2, x.s1, x.key, block[x.owner]))
    x, of = x[o], block[x.owner[o]]
    new = np.append(True, (of[1:] != of[:-1]) | (x.key[1:] != x.key[:-1]))
    first = np.flatnonzero(new | np.append(True, (x.s1[1:] != x.s1[:-1]) | (x.s2[1:] != x.s2[:-1])))
    low = np.minimum.reduceat(doc[x.owner], first)
    some = [strings[k][a : a + w + span - 1] for k, a, w in zip(x.owner[first].tolist(), x.begin[first].tolist(), x.windows[first].tolist(), strict=True)]
    got = _least(some, np.cumsum(new)[first], low, span, gram)
    begins = np.cumsum(x.windows[first]) - x.windows[first]
    string = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x.key))))
    off = np.cumsum(x.windows) - x.windows
    nth = np.arange(int(x.windows.sum())) - np.repeat(off, x.windows)
    out = np.empty(int(sum(len(t) - span + 1 for t in strings)), np.int64)
    out[np.repeat(places[x.owner] + x.begin, x.windows) + nth] = got[np.repeat(begins[string], x.windows) + nth]
    return out


def _sorted(strings: list[bytes], block: np.ndarray, doc: np.ndarray, span: int, gram: int) -> np.ndarray:
    """`_least` by suffix arrays."""
    size = np.array([len(x) for x in strings], np.int64)
    joined = b"".join(x + b"\0" for x in strings)
    ends = np.cumsum(size + 1) - 1
    s = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    s[ends] = 1
    final = np.append(block[1:] != block[:-1], True)
    s[ends[final]] = 0  # the last of a block is its end
    sa = arrays(s, (ends - size)[np.append(True, block[1:] != block[:-1])])
    owner = np.repeat(np.arange(len(strings)), size + 1)
    left = ends[owner[sa]] - sa
    sa = sa[left >= span]
    raw = np.frombuffer(joined + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    same = block[owner[sa[1:]]] == block[owner[sa[:-1]]]
    for at in (*range(0, span - 7, 8), span - 8):
        x = np.ascontiguousarray(eight[sa + at]).view(np.uint64).ravel()
        same &= x[1:] == x[:-1]
    first = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(doc[owner[sa]], first)
    out = np.zeros(len(s), np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(first, len(sa))))
    return out[np.arange(len(s)) + span <= ends[owner]]


def _cover(span: int):
    """Whole keys, sorted -> (part, s1, s2, at, windows, least): of each part's strings the runs of windows that also start in a smaller doc than the greatest it has them in."""

    def fn(t: pa.Table) -> pa.RecordBatch:
        key, s1, s2, part, low, top = (t.column(x).to_numpy() for x in ("key", "s1", "s2", "part", "low", "top"))
        o = np.lexsort((s2, s1, key))
        first = np.flatnonzero(np.append(True, (key[o][1:] != key[o][:-1]) | (s1[o][1:] != s1[o][:-1]) | (s2[o][1:] != s2[o][:-1])))
        many = np.diff(np.append(first, len(o)))
        strings = t.column("string").take(pa.array(o[first])).to_pylist()
        least = _least(strings, key[o[first]], np.minimum.reduceat(low[o], first), span)
        count = np.array([len(x) for x in strings], np.int64) - span + 1
        of = np.repeat(np.arange(len(strings)), count)
        cut = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1])))  # runs of windows with one least doc
        begin = cut - (np.cumsum(count) - count)[of[cut]]
        windows, value = np.diff(np.append(cut, len(least))), least[cut]
        runs = np.bincount(of[cut], minlength=len(strings))
        begins = np.cumsum(runs) - runs
        string = np.repeat(np.arange(len(strings)), many)  # of each row in order
        found, x, ends = [], 0, np.cumsum(runs[string])
        while x < len(o):
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + STEP_RUNS, "right")))
            total = runs[string[x:y]]
            run = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total) + np.repeat(begins[string[x:y]], total)
            row = np.repeat(o[x:y], total)
            hit = value[run] < top[row]
            found.append((row[hit], run[hit]))
            x = y
        row, run = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (part[row], s1[row], s2[row], begin[run], windows[run], value[run])], ["part", "s1", "s2", "at", "windows", "least"])

    return lambda batches: by_runs(batches, "key", fn, TOGETHER)


def _gaps(begin: np.ndarray, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [from, to) of a text."""
    o = np.argsort(begin, kind="stable")
    b, e = begin[o], np.maximum.accumulate((begin + windows + span - 1)[o])
    new = np.flatnonzero(np.append(True, b[1:] > e[:-1]))
    return b[new], e[np.append(new[1:] - 1, len(e) - 1)]


def _runs_of(docs: list[int], some: list[bytes], known: pa.Table, buckets: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, begin, windows) of what is covered in the texts, by text, from what `_cover` says of their strings."""
    told = known.filter(pa.compute.equal(known.column("kind"), 2))
    none = np.zeros(0, np.int64)
    if not some or not told.num_rows:
        return none, none, none
    s1, s2 = (told.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("s1", "s2"))
    at, windows, least = (told.column(c).to_numpy().astype(np.int64) for c in ("at", "windows", "least"))
    o = np.lexsort((s2, s1))
    s1, s2, at, windows, least = s1[o], s2[o], at[o], windows[o], least[o]
    head = np.flatnonzero(np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))
    runs = np.diff(np.append(head, len(s1)))
    wanted, hot = _keys(known)
    x = _strings(some, span, GRAM, wanted, buckets, hot)
    nth = np.searchsorted(s1[head], x.s1)
    while len(nth) and (again := (nth < len(head)) & (s1[head[np.minimum(nth, len(head) - 1)]] == x.s1) & (s2[head[np.minimum(nth, len(head) - 1)]] < x.s2)).any():
        nth[again] += 1
    nth = np.minimum(nth, len(head) - 1)
    hit = (s1[head[nth]] == x.s1) & (s2[head[nth]] == x.s2)
    x, nth = x[hit], nth[hit]
    total = runs[nth]
    run = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total) + np.repeat(head[nth], total)
    row = np.repeat(np.arange(len(nth)), total)
    hit = least[run] < np.array(docs, np.int64)[x.owner[row]]
    run, row = run[hit], row[hit]
    o = np.argsort(x.owner[row], kind="stable")
    return x.owner[row][o], (x.begin[row] + at[run])[o], windows[run][o]


def _cut(buckets: int, span: int, schema: pa.Schema):
    """A part -> each of its rows with n_bytes, n_removed, n_spans, kept_sha256 and kept."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        docs, some = _representatives(texts, known)
        owner, begin, windows = _runs_of(docs, some, known, buckets, span)
        first = np.searchsorted(owner, np.arange(len(some) + 1))
        own = {(d, x): i for i, (d, x) in enumerate(zip(docs, some, strict=True))}
        unzip, rows = zstandard.ZstdDecompressor(), []
        for d, z in zip(*(texts.column(x).to_pylist() for x in ("doc", "z")), strict=True):
            raw = unzip.decompress(z) if z is not None else b""
            n, rest = 0, raw
            if d is None or len(raw) < span:
                pass
            elif (i := own.get((d, raw))) is None:
                n, rest = 1, b""
            elif first[i] < first[i + 1]:
                a, b = _gaps(begin[first[i] : first[i + 1]], windows[first[i] : first[i + 1]], span)
                n, rest = len(a), b"".join(raw[p:q] for p, q in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            rows.append((len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table([texts.column("row"), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(cols))], schema=schema)

    return run


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for rb in batches:
        zipped = pa.array([None if x is None else z.compress(x.encode()) for x in rb.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(rb.column(x) for x in ("row", "doc", "text_key", "part")), zipped], ["row", "doc", "text_key", "part", "z"])


def covered(docs: DataFrame, row: list[str], span: int = 50) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of `docs`; row: its columns of these names, in a struct.

    Rows without a doc_id have no smaller or greater one: they lose nothing, and nothing is lost to them.
    """
    if span < GRAM + 8:
        raise ValueError(f"span must be at least {GRAM + 8}")
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(text))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), F.col("doc_id").cast("long").alias("doc"), key.alias("text_key"), F.octet_length(text).alias("n"), "text")
    size = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets, chunks = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // CHUNK_BYTES))
    part = F.pmod(F.coalesce(F.xxhash64("doc"), F.xxhash64("text_key")), F.lit(chunks))
    texts = d.withColumn("part", part).select("row", "doc", "text_key", "part", "text")
    texts = texts.mapInArrow(_zip, T.StructType([*texts.select("row", "doc", "text_key", "part").schema.fields, T.StructField("z", T.BinaryType())])).groupBy("part")
    low = d.where((F.col("n") >= span) & F.col("doc").isNotNull()).groupBy("text_key").agg(F.min("doc").alias("doc"))
    known = table(low.select(part.alias("part"), F.lit(0).alias("kind"), "doc", "text_key"), "texts")
    sketch = texts.cogroup(known.groupBy("part")).applyInArrow(_sketch(buckets, span), "bucket int, part long, keys binary")
    shared = sketch.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(KEY_STRINGS), "part long, keys binary")
    shared = table(shared.withColumn("kind", F.lit(1)), "keys")
    told = known.unionByName(shared, allowMissingColumns=True)
    strings = texts.cogroup(told.groupBy("part")).applyInArrow(_select(buckets, span), "key long, s1 long, s2 long, part long, low long, top long, string binary")
    runs = strings.repartition("key").sortWithinPartitions("key").mapInArrow(_cover(span), "part long, s1 long, s2 long, at long, windows long, least long")
    told = told.unionByName(runs.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    out = T.StructType([T.StructField("row", d.schema["row"].dataType), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])
    return texts.cogroup(told.groupBy("part")).applyInArrow(_cut(buckets, span, to_arrow_schema(out)), out)


def digest(docs: DataFrame, span: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row of `docs`.

    A null text is empty. Texts shorter than `span` lose nothing. A copy of a text with a smaller doc_id
    loses all. Rows of equal doc_id don't touch each other; a row without doc_id loses nothing.
    """
    return covered(docs, ["doc_id"], span).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cut(docs: DataFrame, span: int = 50) -> DataFrame:
    """The rows and columns of `docs`, the covered bytes cut out of `text`; letters cut in half go too, and n_chars follows.

    A text of which nothing is left is empty; a null text stays null. Columns of other names are kept as they are.
    """
    rest = [c for c in docs.columns if c != "text"]
    flag = next(c for c in (f"no_text_{i}" for i in range(len(rest) + 1)) if c not in {x.lower() for x in rest})
    got = covered(docs.withColumn(flag, F.col("text").isNull()), [*rest, flag], span)
    empty = F.col(f"row.`{flag}`")
    text = F.when(empty, F.lit(None)).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    new = {c: F.col(f"row.`{c}`") for c in rest} | {"text": F.when(F.col("n_removed") > 0, text).when(~empty, F.col("kept").cast("string"))}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return got.select(*[new[c].alias(c) for c in docs.columns])
