"""Packing documents into sequences by online sum of squares.

Each task packs the documents of its input split as they come. A level array holds how many open
windows are filled to each level; a document's rest goes where the sum of squares of that array
grows least. At the end of a split the emptiest open windows are cut up to fill the fullest, and
the last one is split into powers of two, so that nothing is padded.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Outside of these characters two implementations of the same vocabulary could differ in Unicode version.
_RARE = re.compile("[^\t\n\r -~ -ɏ]")


@lru_cache(2)
def _encoder(tokenizer: str):
    """text -> ids as the tokenizer file gives them. Ordinary texts take the faster library, if its vocabulary lies beside."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    exact = Tokenizer.from_file(tokenizer)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    slow = lambda x: np.asarray(exact.encode(x, add_special_tokens=False).ids, np.uint32)
    ranks = re.sub(r"\.json$", ".tiktoken", tokenizer)
    if ranks == tokenizer or not os.path.exists(ranks):
        return slow
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda x: slow(x) if _RARE.search(x) or any(s in x for s in special) else np.asarray(fast.encode_ordinary(x), np.uint32)


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens) into windows of `size`; rows come out as windows are closed."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.twice = np.zeros(size + 1, np.int64)  # twice the open windows at each level
        self.twice[size] = -1  # a full window leaves the array
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        size, total, start = self.size, len(ids), 0
        while total - start >= size:
            self._close([(doc, start, ids[start : start + size], total)])
            start += size
        s = total - start
        if not s:
            return
        a = self.twice
        level, best = 0, a[s] + 1  # a new window
        grow = a[s + 1 : size + 1] - a[1 : size - s + 1] + 2
        grow[a[1 : size - s + 1] == 0] = 1 << 60
        if len(grow):
            h = len(grow) - 1 - int(grow[::-1].argmin())  # of equals the fullest
            if grow[h] <= best:
                level = h + 1
        window = self.open[level].pop() if level else []
        if level:
            a[level] -= 2
        window.append((doc, start, ids[start:], total))
        if level + s == size:
            self._close(window)
        else:
            self.open[level + s].append(window)
            a[level + s] += 2

    def finish(self) -> None:
        left = [w for level in reversed(self.open) for w in level]  # fullest first
        self.open = [[] for _ in range(self.size + 1)]
        full, end = 0, len(left)
        fill = [sum(len(p[2]) for p in w) for w in left]
        while full < end - 1:
            gap, donor = self.size - fill[full], left[end - 1]
            doc, start, ids, total = donor.pop()
            take = min(gap, len(ids))
            left[full].append((doc, start, ids[:take], total))
            fill[full] += take
            fill[end - 1] -= take
            if take < len(ids):
                donor.append((doc, start + take, ids[take:], total))
            if fill[full] == self.size:
                self._close(left[full])
                full += 1
            if not donor:
                end -= 1
        if full < end and fill[full]:
            rest, need = left[full], fill[full]
            while need:
                room = 1 << (need.bit_length() - 1)
                need -= room
                window = []
                while room:
                    doc, start, ids, total = rest.pop(0)
                    window.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        rest.insert(0, (doc, start + room, ids[room:], total))
                    room -= len(window[-1][2])
                self._close(window)

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids followed by `end_id`; a null text is empty and so a document of one id. Rows
    of equal or null doc_id are documents of their own. No rows, no pieces. Windows never span input
    splits, so nothing is shuffled and a task that is run again gives the same windows; a task holds its
    open windows only. sequence_id is the split's number times 2^33 plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(tokenizer), Packer(size, TaskContext.get().partitionId() << 33)
        for rb in batches:
            for doc, text in zip(rb.column("doc_id").to_pylist(), rb.column("text"), strict=True):
                packer.add(doc, np.append(encode(text.as_py() or ""), np.uint32(end_id)))
                if len(packer.rows) >= 20_000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
