"""Token counts by a linear longest-match automaton.

A trie of the vocabulary carries, at each node, the number of pieces to pop when the next byte
has no edge, and the node of what is left then. One pass over a word's bytes gives the number of
its greedy longest-match pieces; the pieces themselves are never built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Counts of words that one Python worker remembers, and the longest word it remembers.
MEMO, MEMO_BYTES = 400_000, 48


class Automaton:
    """Counts pieces of a word; a word that the vocabulary can't spell counts as one unknown piece."""

    def __init__(self, vocabulary: list[bytes]):
        edge: dict[int, int] = {}
        nodes, whole = 1, {0: False}
        for piece in vocabulary:
            u = 0
            for b in piece:
                v = edge.get(u << 8 | b)
                if v is None:
                    v = edge[u << 8 | b] = nodes
                    whole[v] = False
                    nodes += 1
                u = v
            whole[u] = u > 0
        link, pops = [-1] * nodes, [0] * nodes
        below: list[list[tuple[int, int]]] = [[] for _ in range(nodes)]
        for key, v in edge.items():
            below[key >> 8].append((key & 255, v))
        level = [0]
        while level:  # by depth: links lead to lesser depths
            nxt = []
            for u in level:
                for b, v in below[u]:
                    nxt.append(v)
                    if whole[v]:
                        link[v], pops[v] = 0, 1
                        continue
                    n, w = pops[u], link[u]
                    while w >= 0 and w << 8 | b not in edge:
                        n, w = n + pops[w], link[w]
                    if w >= 0:
                        link[v], pops[v] = edge[w << 8 | b], n
            level = nxt
        self.edge, self.link, self.pops = edge, link, pops

    def count(self, word: bytes) -> int:
        edge, link, pops = self.edge, self.link, self.pops
        u = n = 0
        for b in word:
            v = edge.get(u << 8 | b)
            while v is None:
                n += pops[u]
                u = link[u]
                if u < 0:
                    return 1
                v = edge.get(u << 8 | b)
            u = v
        while u > 0:
            n += pops[u]
            u = link[u]
        return n if u == 0 else 1


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a vocabulary file of lines: base64 of a piece, a space, its id."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@lru_cache(2)
def _automaton(path: str) -> Automaton:
    return Automaton(read_ranks(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens), a row for each row of `docs`.

    Words are runs of bytes other than ASCII white space; each is spelled with one space before it, as
    byte-level vocabularies spell words. Null and empty texts have 0 words. Repeated rows count each.
    `vocabulary` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, memo = _automaton(vocabulary), {}
        get, count = memo.get, auto.count
        for rb in batches:
            n_bytes, n_words, n_tokens = [], [], []
            for text in rb.column("text"):
                raw = (text.as_py() or "").encode()
                words = raw.split()
                total = 0
                for w in words:
                    n = get(w)
                    if n is None:
                        n = count(b" " + w)
                        if len(w) <= MEMO_BYTES:
                            if len(memo) >= MEMO:
                                memo.clear()
                            memo[w] = n
                    total += n
                n_bytes.append(len(raw))
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens))], ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
