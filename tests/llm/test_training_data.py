"""Each operator against brute force, on small fixtures with nulls, empty texts, ties, repeated rows and clashing columns."""

import copy
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import (
    embedding_dedup,
    filter_audit,
    licenses,
    line_dedup,
    media,
    mixing,
    packing,
    simhash,
    suffix_dedup,
    suffix_groups,
    token_counts,
    toxicity,
    url_filter,
    variants,
)
from larkspur.llm.queries import tokenizer
from larkspur.llm.shared import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part string"
WORDS = "the of and ratio thing ève straße año reads all rights reserved notice under license cc by general public".split()


def corpus(n=160, seed=1):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "ing"]) for _ in range(k))
    common = text(14)
    rows = [(i, text(rng.randint(0, 60)), "en", f"s{rng.randint(0, 3)}", 0) for i in range(n)]
    for i in range(0, n, 5):
        j = rng.randrange(n)
        rows[i] = (i, rows[j][1] if i % 2 else text(8) + common + text(9), "de", "s0", 0)
    for i in range(3, n, 17):  # near copies
        w = rows[i - 1][1].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        rows[i] = (i, " ".join(w), None, None, None)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, "ab" * 200, "en", "s1", 0), (n + 3, "ab" * 90, "en", "s1", 0)]
    rows += [(7, rows[7][1], "en", "s1", 0), (7, "another text of the same id, and long enough to be looked at by all", "en", "s1", 0), (None, rows[9][1], "en", "s1", 0)]
    rows.append((n + 9, " ".join(r[1] or "" for r in rows[:80]) * 3, "fr", "s2", 0))
    return [(*r, "k", "p") for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_suffix_arrays(blocks):
    blocks = [[*b, 0] for b in blocks]
    begin = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    got = suffix_groups.arrays(np.array(sum(blocks, [])), begin)
    for b, at in zip(blocks, begin, strict=True):
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert [x - at for x in got[at : at + len(b)]] == want


def brute_spans(rows, span=50):
    where = {}
    for d, t, *_ in rows:
        if d is not None:
            raw = (t or "").encode()
            for i in range(len(raw) - span + 1):
                w = raw[i : i + span]
                where[w] = min(where.get(w, d), d)
    out = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - span + 1):
            if d is not None and where[raw[i : i + span]] < d:
                gone[i : i + span] = [True] * span
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("long_block", "key_strings"), [(6000, 50_000), (0, 50_000), (500, 3), (6000, 0)])
def test_suffix_dedup(docs, rows, none, long_block, key_strings, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONG_BLOCK", long_block)
    monkeypatch.setattr(suffix_dedup, "KEY_STRINGS", key_strings)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    got = sorted((tuple(r) for r in suffix_dedup.digest(docs).collect()), key=str)
    assert got == brute_spans(rows)
    assert suffix_dedup.digest(none).count() == 0


@pytest.mark.parametrize(("long_block", "gram"), [(0, 24), (300, 24), (300, 37), (6000, 24)])
def test_least_of_windows(long_block, gram, monkeypatch):
    """Blocks of strings cut finer and finer give what comparing all windows gives."""
    monkeypatch.setattr(suffix_dedup, "LONG_BLOCK", long_block)
    rng = random.Random(3)
    letters = lambda k: "".join(rng.choice("ab") for _ in range(k)).encode()
    common = letters(70)
    strings, block = [], []
    for b in range(4):
        for _ in range(rng.randint(1, 40)):
            at = rng.randrange(20)
            strings.append(rng.choice([letters(rng.randint(50, 113)), letters(rng.randint(0, 20)) + common[at : at + 50] + letters(rng.randint(0, 20)), b"a" * rng.randint(50, 113)]))
            block.append(b)
    doc = np.array([rng.randrange(1000) for _ in strings])
    want = {}
    for x, b, d in zip(strings, block, doc, strict=True):
        for i in range(len(x) - 49):
            want[b, x[i : i + 50]] = min(want.get((b, x[i : i + 50]), d), d)
    got = suffix_dedup._least(strings, np.array(block), doc, 50, gram)
    assert got.tolist() == [want[b, x[i : i + 50]] for x, b in zip(strings, block, strict=True) for i in range(len(x) - 49)]


@pytest.mark.parametrize(("texts", "times", "short", "hot"), [(1200, 1, False, False), (1200, 1, True, True), (2, 700, False, False), (1, 1400, True, None)])
def test_suffix_keys_of_many_strings(texts, times, short, hot):
    """A passage that all share is one string however often it stands; a short one in many surroundings is many. None of one text is kept."""
    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    line = text(30 if short else 150)
    some = ["".join(text(60) + line for _ in range(times)) for _ in range(texts)]
    z = [zstandard.compress(x.encode()) for x in some]
    ids = [str(i).encode() for i in range(texts)]
    every = pa.table({"doc": range(texts), "text_key": pa.array(ids, pa.binary()), "z": pa.array(z, pa.binary())})
    known = pa.table({"part": [0] * texts, "kind": [0] * texts, "doc": range(texts), "text_key": pa.array(ids, pa.binary())})
    sketch = suffix_dedup._sketch(1, 50)(every, known)
    got = [np.frombuffer(x, np.uint64) for rb in suffix_dedup._shared(50)(iter(sketch.to_batches())) for x in rb.column("keys").to_pylist()]
    if hot is None:
        assert not got
    else:
        marked = np.concatenate(got) & suffix_dedup.HOT > 0
        assert marked.any() if hot else (~marked).sum() > 1  # at a passage's ends surroundings differ too


@pytest.mark.parametrize("step", [1, 50])
def test_suffix_runs_in_steps(docs, rows, none, step, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_RUNS", step)
    assert sorted((tuple(r) for r in suffix_dedup.digest(docs).collect()), key=str) == brute_spans(rows)


def test_suffix_cut(docs, rows, none):
    want = {}
    for d, n, gone, _, sha in brute_spans(rows):
        want.setdefault(d, []).append((gone, sha))
    got = suffix_dedup.cut(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (r.text or "").encode()
        if d := want.get(r.doc_id):
            if len(d) == 1 and "é" not in (r.text or "") and all(ord(c) < 128 for c in r.text or ""):
                whole = next(t for i, t, *_ in rows if i == r.doc_id) or ""
                if all(ord(c) < 128 for c in whole):
                    assert hashlib.sha256(raw).hexdigest() == d[0][1]
    assert suffix_dedup.cut(none).count() == 0
    odd = docs.withColumns({"a.b": F.lit(1), "no_text_0": F.lit(2), "row": F.lit(3), "doc": F.lit(4), "part": F.lit(5)})
    assert suffix_dedup.cut(odd).columns == odd.columns and {tuple(r) for r in suffix_dedup.cut(odd).select("`a.b`", "no_text_0", "row", "doc", "part").collect()} == {(1, 2, 3, 4, 5)}


def brute_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    low = list(ids)
    change = True
    while change:
        change = False
        for i, j in linked:
            m = min(low[i], low[j])
            change |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return low


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash(docs, rows, none, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    fp = [brute_fingerprint(r[1]) for r in rows]
    ids = [10**9 if r[0] is None else r[0] for r in rows]
    low = brute_components(ids, [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    got = sorted((tuple(r) for r in simhash.digest(docs).collect()), key=str)
    assert got == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fp, low, strict=True)), key=str)
    assert simhash.digest(none).count() == 0


def test_simhash_links_random_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)})
    nodes = spark.createDataFrame([(i, f.to_bytes(8, "little")) for i, f in enumerate(fps)], "node long, fp binary")
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = {r.node: r.root for r in components(simhash.links(nodes, simhash.Rule())).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(range(len(fps)), pairs)


def test_near_copies_keep_one(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, group = [], []
    for g in range(60):
        base = words(220)
        for k in range(4):
            w = list(base)
            for _ in range(3 * (k > 0)):
                w[rng.randrange(len(w))] = "other"
            rows.append((len(rows), " ".join(w)))
            group.append(g)
    clean = [(len(rows) + i, " ".join(words(100))) for i in range(100)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert {i for i, _ in clean} <= kept
    assert sum(i in kept for i, _ in rows) <= 60 + 0.05 * 180 and {group[i] for i, _ in rows if i in kept} == set(range(60))


def test_near_copies_are_verified(spark):
    """A line repeated often, or much in common but less than 0.8, makes no near copy."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = words(10), []
    for _ in range(2):
        texts.append(words(200) + line * 20)
    for _ in range(30):  # Jaccard 0.74
        base = words(404)
        texts += [base, base[:344] + words(60)]
    texts += [words(3), [], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == list(range(len(rows) - 1))  # of the empty ones one goes


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_copies_miss_nothing(spark, tile, monkeypatch):
    """Lone pairs of a Jaccard similarity just above 0.8, short and long, and a family whose members all meet."""
    monkeypatch.setattr(simhash, "NEAR_TILE", tile)
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(150):
        n = (9, 13, 40, 224)[k % 4]
        base = words(n)
        texts += [base, base[: 4 + -(-(n - 4) * 8 // 9)] + words((n - 4) // 9)]
    base = words(100)
    texts += [base[: 100 - k] + words(k) for k in range(0, 30, 2)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert len(pairs) > 150
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect())
    assert kept == sorted(set(brute_components(range(len(sets)), pairs)))


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 16))
    rows = []
    for i, b in enumerate(base):
        for k in range(1 + i % 4):
            rows.append((len(rows), (b + 0.12 * k * rng.standard_normal(16)).astype(np.float32).tolist(), int(i % 3)))
    rows += [(900 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(950 + i, (np.array(rows[6][1]) + 0.01 * rng.standard_normal(16)).astype(np.float32).tolist(), rows[6][2]) for i in range(40)]
    rows += [(990, None, 1), (991, [0.0] * 16, 1), (992, [float("nan")] + [1.0] * 15, 1), (993, [None] + [1.0] * 15, 1), (994, rows[5][1], None), (995, [float("inf")] * 16, 1), (996, [], 1), (997, [1.0, 0.0], 1), (5, rows[5][1], rows[5][2])]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and y is not None for _, v, y in rows]
    unit = [np.array(v) / np.linalg.norm(v) if k else None for (_, v, _), k in zip(rows, ok, strict=True)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    low = brute_components([r[0] for r in rows], pairs)
    n = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for tile in (512, 7):
        embedding_dedup.TILE = tile
        got = sorted((tuple(r) for r in embedding_dedup.dedup(df).collect()), key=str)
        assert got == sorted(((r[0], int(k), c, r[0] == c) for r, k, c in zip(rows, n, low, strict=True)), key=str)
    embedding_dedup.TILE = 512
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def planted(n, pairs, dim, mean, seed, cosines=(0.931, 0.96)):
    """n unit vectors around a common mean (the cosine of two of them is about mean^2), and twins of the first ones."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base = mean * np.eye(dim)[0] + np.sqrt(1 - mean**2) * base
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.standard_normal((pairs, dim))
    turn -= (turn * base[:pairs]).sum(1, keepdims=True) * base[:pairs]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cos = rng.uniform(*cosines, (pairs, 1))
    return np.concatenate([base, cos * base[:pairs] + np.sqrt(1 - cos**2) * turn])


@pytest.mark.parametrize("mean", [0.0, 0.7])
def test_embedding_recall(spark, mean):
    """Pairs that stand alone, near the threshold, among many others, in a label of its own kind."""
    v = planted(6000, 300, 32, mean, 4)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dedup.dedup(df, embedding_dedup.Rule(window=64)).collect()}
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * want.sum()


@pytest.mark.parametrize("sizes", [[5, 5, 5, 5], [100, 3, 100], [40], [9, 30, 2, 2, 2, 30], []])
def test_embedding_borders(sizes):
    """Whatever the partitions' sizes, every two rows within a window stand together, in a partition or at a border."""
    window, at, rows = 8, 0, []
    for task, n in enumerate(sizes):
        rows += [(task, k) for k in range(n)]
    together = {(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if x[0] == y[0]}
    at = {x: i for i, x in enumerate(rows)}
    edges = {}
    for task, edge, low, high in embedding_dedup._edges(list(enumerate(sizes)), window):
        for k in range(max(0, low), min(high, sizes[task])):
            assert k < window or k >= sizes[task] - window  # only those rows are sent
            edges.setdefault(edge, []).append(at[task, k])
    for members in edges.values():
        members.sort()
        assert members == list(range(members[0], members[-1] + 1))
        together |= {(i, j) for i in members for j in members}
    assert all((i, j) in together for i in range(len(rows)) for j in range(i, min(len(rows), i + window + 1)))


def greedy(word, vocabulary):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not k:
            return 1
        word, n = word[k:], n + 1
    return n


@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton(vocabulary, texts):
    auto = token_counts.Automaton(sorted(vocabulary))
    for w in texts:
        assert auto.count(w) == greedy(w, vocabulary)


def test_token_counts(docs, rows, none):
    path = tokenizer("byte_bpe_50k.tiktoken")
    vocabulary = set(token_counts.read_ranks(path))
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, path).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), len((r[1] or "").encode().split()), sum(greedy(b" " + w, vocabulary) for w in (r[1] or "").encode().split())) for r in rows]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(none, path).count() == 0


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(spark, docs, rows, none, size):
    from tokenizers import Tokenizer

    odd = spark.createDataFrame([(5000, "special <|endoftext|> here\x85\x1c ​ 漢字 \U0001f600", "en", "s", 0, "", "")], SCHEMA)
    got = packing.pack(docs.unionByName(odd), tokenizer("byte_bpe_50k.json"), size).collect()
    exact = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    texts = {}
    for r in [*rows, *odd.collect()]:
        texts.setdefault(r[0], []).append([*exact.encode(r[1] or "", add_special_tokens=False).ids, 1])
    docs_of, seqs = {}, {}
    for p in got:
        docs_of.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert set(docs_of) == set(texts)
    for d, pieces in docs_of.items():
        assert sum(p.length for p in pieces) == sum(map(len, texts[d]))
        if len(texts[d]) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                ids = texts[d][0][p.start : p.start + p.length]
                assert (p.start, p.length, p.doc_tokens) == (at, len(ids), len(texts[d][0]))
                assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += p.length
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    assert packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def brute_licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark, docs, rows, none):
    lines = ["All rights reserved.", "ALL-Rights  reserved! cc by cc by", "al rights reserved", "Licenced under the Apache Lisense, Version 2.0", "permission is hearby granted, free of charge", "nothing to see", "ccby", "Ärights all rights reservedé"]
    more = spark.createDataFrame([(3000 + i, x, "en", "s", 0, "", "") for i, x in enumerate(lines)], SCHEMA)
    got = licenses.scan(docs.unionByName(more)).collect()
    want = [(r[0], *brute_licenses(r[1])) for r in [*rows, *more.collect()]]
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(want, key=str)
    by = {r.doc_id: r for r in got}
    assert by[3002].labels == "reserved" and by[3002].n_base == 0 and 0.9 < by[3002].score < 1
    assert by[3003].labels == "apache" and by[3004].labels == "mit" and by[3005].labels == "" and by[3005].score == 0
    assert by[3003].spans.startswith("apache:0-5:")
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.scan(none).count() == 0


def test_licenses_miss_nothing():
    """Every notice with as many random edits as it may have is found, as the whole-text search finds it."""
    rng = random.Random(8)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.LETTERS_PER_ERROR)
    for notice, label in licenses.NOTICES.items():
        for _ in range(30):
            x = list(notice)
            for _ in range(len(notice) // licenses.LETTERS_PER_ERROR):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["q", "", "z"])
            line = f" some words {''.join(x)} and more ".encode()
            assert label in {f[3] for f in scanner.fuzzy(line)}


def test_media(spark, docs, rows, none):
    got = media.digest(docs).collect()
    want = []
    for r in rows:
        raw = (r[1] or "").encode()
        pad = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        want.append((r[0], len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    files = {r.doc_id: r.media for r in media.encode(docs.where("doc_id > 20")).collect()}
    table = media.packets(media.encode(docs.where("doc_id > 20"))).collect()
    for d, file in files.items():
        mine = sorted((p for p in table if p.doc_id == d), key=lambda p: p.nth)
        assert b"".join(file[p.offset : p.offset + p.size] for p in mine) == media.payload_of(next(r[1] for r in rows if r[0] == d))
        assert [p.ns for p in mine] == [k * 72_000_000 for k in range(len(mine))] and {p.track for p in mine} == {1}
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"\x1a\x45\xdf\xa3\x81"), (4, files[30][:-700])], "doc_id long, media binary")
    assert all(r.error and r.size is None for r in media.packets(broken).collect())
    assert media.digest(none).count() == 0


def test_media_lacing_and_groups():
    """Xiph, EBML and no lacing, block groups, unknown sizes, cues: written by hand."""
    el, head = media._el, lambda t, f: b"\x81" + t.to_bytes(2, "big", signed=True) + bytes([f])
    frames = [b"a" * 300, b"b" * 10, b"c" * 700]
    xiph = head(5, 0x82) + bytes([2, 255, 45, 10]) + b"".join(frames)
    ebml = head(-2, 0x06) + bytes([2]) + (300 | 0x4000).to_bytes(2, "big") + (10 - 300 + (1 << 13) - 1 | 0x4000).to_bytes(2, "big") + b"".join(frames)
    plain = head(9, 0) + b"zz"
    cluster = el(media.TIME, 100) + el(media.SIMPLE_BLOCK, xiph) + el(media.BLOCK_GROUP, el(media.BLOCK, ebml)) + el(media.BLOCK_GROUP, el(media.BLOCK, plain) + el(0xFB, 1))
    track = el(media.TRACKS, el(media.TRACK, el(media.NUMBER, 1) + el(0x86, "X")))
    for unknown in (False, True):
        c = media._id(media.CLUSTER) + b"\x01" + b"\xff" * 7 + cluster if unknown else el(media.CLUSTER, cluster)
        body = el(media.INFO, el(media.SCALE, 1000)) + track + c
        body += el(media.CUES, el(media.CUE_POINT, el(media.CUE_TIME, 100) + el(media.CUE_PLACE, el(media.CUE_TRACK, 1) + el(media.CUE_CLUSTER, len(body) - len(c)))))
        file = media._HEAD + el(media.SEGMENT, body)
        got = media.demux(file)
        assert [file[p[2] : p[2] + p[3]] for p in got.packets] == [*frames, *frames, b"zz"]
        assert [p[1] for p in got.packets] == [105_000] * 3 + [98_000] * 3 + [109_000]
        assert [p[4] for p in got.packets] == [True] * 6 + [False]
        assert file[got.cues[0][2] : got.cues[0][2] + 4] == media._id(media.CLUSTER)


def test_toxicity(spark, none):
    rng = random.Random(1)
    fill = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(fill) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["vilename", "rudeword", "badthing"])
        rows.append((i, " ".join(w), ["en", "fr", None][i % 3], "s", 0, "", ""))
        labels.append((i, 0, int(bad)))
    rows += [(2000, None, None, None, None, None, None), (2001, "", "en", "s", 0, "", ""), (None, "rudeword", "en", "s", 0, "", ""), (5, rows[5][1], "en", "s", 0, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    y = spark.createDataFrame([*labels, (3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    setup = toxicity.Setup(max_rows=800, buckets=4096, epochs=3)
    got = toxicity.digest(docs, y, setup).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 100 and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by[2000].score == by[2001].score
    kept = toxicity.reject(docs, y, setup)
    assert kept.columns == docs.columns and 600 <= kept.count() <= 720
    assert toxicity.digest(none, y.limit(0), setup).count() == 0
    assert {r.score for r in toxicity.digest(docs, y.limit(0), setup).collect()} == {0.0}


def test_long_text_scores_as_a_whole():
    rng = np.random.default_rng(0)
    setup = toxicity.Setup(buckets=512, epochs=1)
    model = toxicity.fit([(toxicity.hashed(" ".join(f"w{x}" for x in rng.integers(0, 50, 30)) + " bad" * (i % 2), setup), i % 2, "en") for i in range(60)], setup)
    text = " ".join(f"w{x}" for x in rng.integers(0, 50, 500))
    whole = toxicity.Scorer(model).logit(text)
    step, toxicity.STEP = toxicity.STEP, 37
    try:
        assert toxicity.Scorer(model).logit(text) == pytest.approx(whole, abs=1e-4)
    finally:
        toxicity.STEP = step


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_filter(spark):
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y#z", "http://example.com", "http://www.example.com/en/", "https://a.example.com/en", "x://b.net/es/1", "x://net/fr/", "x://b.net?/es/", "a://b://c.com/", "http://é.com/\n/x", "http://notexample.com/en/", "http://x.com/" + "a" * 5000]
    urls += [f"http://{rng.choice(['a', 'b', 'www'])}.{rng.choice(['example', 'w'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randrange(999)}" for _ in range(300)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id long, url string, host string, features string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path, best = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1])
        assert got[i].verdict in ("allow", "block") and (not best or got[i].verdict == best[0])
    assert len(got) == len(urls) + 1
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df.where("url LIKE '%.org/%'")).collect()} == {"allow"}


def test_url_features(spark):
    df = spark.createDataFrame([("http://a-b.c.org/x/y1?q=1&r=2#f",)], "url string")
    host, path = url_filter.parts(df.url)
    r = url_filter.lexical(df.withColumn("host", host).withColumn("path", path)).first()
    u = r.url
    want = -sum(u.count(c) / len(u) * np.log2(u.count(c) / len(u)) for c in set(u))
    assert (r.length, r.depth, r.labels, r.parameters, r.suffix) == (len(u), 2, 3, 2, "org")
    assert r.entropy == pytest.approx(want) and r.digits == pytest.approx(3 / len(u)) and r.hyphens == pytest.approx(1 / len(u))


def test_url_trees_learn(spark):
    rows = [(f"http://site{i}.org/" + ("a/b/c/d/12345" if i % 2 else "page"), float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, blocked double")
    host, path = url_filter.parts(df.url)
    x = url_filter.lexical(df.withColumn("host", host).withColumn("path", path))
    judged = url_filter.train(x.where("length(url) % 3 > 0"), url_filter.Setup(trees=4)).judge(x)
    assert judged.where("(score >= 0.5) = (blocked = 1)").count() >= 295


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "mix_copy", "mix_key"] and mixing.mix(none).count() == 0
    rng = random.Random(2)
    many = spark.createDataFrame([(i, "x" * rng.randint(50, 150), "en", ["hot", "hot", "hot", "a", "b", None][i % 6], 0, "", "") for i in range(6000)], SCHEMA)
    weights = {"hot": 1.0, "a": 1.0, "b": 2.0}
    mixed = mixing.mix(many, weights, epochs=3).groupBy("source").agg({"n_chars": "count", "text": "count"}).collect()
    n = {r.source: r["count(text)"] for r in mixed}
    assert None not in n and n["a"] == pytest.approx(n["hot"], rel=0.1) and n["b"] == pytest.approx(2 * n["hot"], rel=0.1)
    assert sum(n.values()) == pytest.approx(18000, rel=0.05)
    copies = [r["count"] for r in mixing.mix(many.where("source = 'a'"), {"a": 1.0}, epochs=20).groupBy("doc_id").count().collect()]
    assert np.mean(copies) == pytest.approx(20, rel=0.03) and np.var(copies) == pytest.approx(20, rel=0.2)  # rate over PART
    a, b = (sorted(map(str, mixing.mix(many.repartition(k)).collect())) for k in (1, 6))
    assert a == b


def test_mixing_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.sql(mixing.SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in mixing.mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()), key=str)
    assert got == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, "/root/testdata/sf0.001").cache()
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() > 0
        at = out
    assert sorted(map(str, corpus_pipeline.run(spark, "/root/testdata/sf0.001").drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted(map(str, at.select("doc_id", "doc_tokens").distinct().collect()))


def test_mixing_keeps_clashing_columns(spark):
    names = ["mix_cdf", "mix_parts", "mix_n", "mix_source", "of", "cdf", "row", "key", "copy", "a.b"]
    df = spark.createDataFrame([(i, "some text", "s", *["v"] * len(names)) for i in range(50)], ["doc_id", "text", "source", *names])
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "mix_copy", "mix_key"]
    rows = got.collect()
    assert rows and all(list(r)[3 : 3 + len(names)] == ["v"] * len(names) for r in rows)


def test_license_places_in_a_long_text(spark):
    """Places of very many phrases: as brute force finds them, in time that follows the text."""
    import time

    text = "All rights reserved, filler CC-BY; " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    licenses.scan(df.limit(0)).count()
    began = time.perf_counter()
    r = licenses.scan(df).first()
    assert time.perf_counter() - began < 60
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (120_000, 40_000, 0, 119_998, "cc-by,reserved")


def test_license_spans_by_brute_force():
    """The spans that seeds lead to, against the regex library's search over the whole text."""
    import regex

    rng = random.Random(12)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.LETTERS_PER_ERROR)
    for _ in range(60):
        words = [rng.choice(["some", "text", "of", "no", "note"]) for _ in range(12)]
        notice, label = rng.choice(list(licenses.NOTICES.items()))
        x = list(notice)
        for _ in range(rng.randint(0, len(notice) // licenses.LETTERS_PER_ERROR)):
            x[rng.randrange(len(x))] = "q"
        line = f" {' '.join(words)} {''.join(x)} {' '.join(words)} ".encode()
        mine = {f[:3] for f in scanner.fuzzy(line) if f[3] == label}
        k = len(notice) // licenses.LETTERS_PER_ERROR
        m = regex.search(rb"(?b)(?:" + regex.escape(notice).encode() + b"){e<=%d}" % k, line)
        assert m and any(abs(a - m.start()) <= k and abs(b - m.end()) <= k and e == sum(m.fuzzy_counts) for a, b, e in mine)


def test_near_copies_lose_no_row(spark):
    """Rows of one doc_id with unlike texts all stay, whatever the other columns are called."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, text("a"), "x", 1), (1, text("b"), "x", 1), (1, text("a"), "y", 1), (1, text("a"), "y", 1), (2, text("a"), "z", 2), (3, text("b") + " more", "z", 3), (None, text("a"), "n", 4), (None, None, "n", 4), (5, None, "e", 5), (4, "", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, `a.b` int").withColumns({c: F.lit(c) for c in ("low", "row", "node", "of", "root")})
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text, r.kept_id) for r in got.collect()), key=str)
    assert kept == sorted([(1, text("a"), "x"), (1, text("b"), "x"), (None, text("a"), "n"), (None, None, "n"), (4, "", "e")], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 9), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_runs_are_whole(keys, size, least):
    from larkspur.llm.shared import by_runs

    keys = sorted(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.int64())], ["key"]) for i in range(0, len(keys), size)]
    seen = []
    for t in by_runs(iter(batches), "key", lambda t: t, least):
        got = t.column("key").to_pylist()
        assert got and (not seen or got[0] != seen[-1])
        seen += got
    assert seen == keys


def small_net(seed=0):
    rng = np.random.default_rng(seed)
    setup = toxicity.Setup(buckets=40, dims=3, filters=2)
    model = toxicity.Model(setup, rng.standard_normal((41, 3)), [rng.standard_normal((w, 3, 2)) for w in toxicity.WIDTHS], [rng.standard_normal(2) for _ in toxicity.WIDTHS], rng.standard_normal(6), 0.3)
    model.embed[-1] = 0
    texts = ["one two three four two", "", "x", "alpha beta", "The the THE one's two-three", "é " * 9]
    return model, texts, toxicity.Words.of([toxicity.hashed(t, setup) for t in texts], 40)


def plain_logit(model, text):
    """The net by loops: sums of embeddings, filters at every place, maxima, logistic layer."""
    v = [sum(model.embed[i] for i in toxicity._ids(w, model.setup.buckets)) for w in toxicity.words(text)]
    zero = np.zeros(model.setup.dims)
    acts = []
    for w, width in enumerate(toxicity.WIDTHS):
        for f in range(model.setup.filters):
            at = [sum((v[i + k] if i + k < len(v) else zero) @ model.conv[w][k][:, f] for k in range(width)) for i in range(max(1, len(v)))]
            acts.append(max(0.0, max(at) + model.bias[w][f]))
    return float(np.array(acts) @ model.out + model.const)


def test_toxicity_net_by_loops():
    model, texts, of = small_net()
    want = [plain_logit(model, t) for t in texts]
    got, _ = toxicity.gradients(model, of, np.arange(len(texts)), np.zeros(len(texts)))
    assert got == pytest.approx(want, abs=1e-9)
    assert [toxicity.Scorer(model).logit(t) for t in texts] == pytest.approx(want, abs=1e-4)


def test_toxicity_gradients():
    """Against differences of the loss."""
    model, texts, of = small_net(3)
    y, every = np.array([1, 0, 1, 0, 1, 0]), np.arange(len(texts))

    def loss():
        z, _ = toxicity.gradients(model, of, every, y)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    _, g = toxicity.gradients(model, of, every, y)
    embed = np.zeros_like(model.embed)
    embed[g["embed"][0]] = g["embed"][1]
    pairs = [(model.out, g["out"]), *zip(model.bias, g["bias"], strict=True), *zip(model.conv, g["conv"], strict=True), (model.embed[:-1], embed[:-1])]
    for x, dx in pairs:
        for i in range(0, x.size, max(1, x.size // 25)):
            old = x.flat[i]
            x.flat[i] = old + 1e-6
            up = loss()
            x.flat[i] = old - 1e-6
            down = loss()
            x.flat[i] = old
            assert dx.flat[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_url_trees_on_unseen_urls(spark):
    """Suffixes that stand once say nothing, and so don't hide what the letters say; repeated rows and a very long URL change nothing."""
    rng = random.Random(7)
    url = lambda i, bad: f"http://h{i}.s{i}/" + ("/".join(str(rng.randrange(10**6)) for _ in range(rng.randint(3, 5))) if bad else "/".join(rng.choice(["news", "about"]) for _ in range(rng.randint(1, 3))))
    rows = [(url(i, i % 2), float(i % 2)) for i in range(800)]
    rows += [rows[3]] * 300 + [("http://long.s/" + "a/" * 50_000, 0.0)]
    df = spark.createDataFrame(rows, "url string, blocked double")
    host, path = url_filter.parts(F.col("url"))
    lexical = lambda d: url_filter.lexical(d.withColumn("host", host).withColumn("path", path))
    trained = url_filter.train(lexical(df), url_filter.Setup(trees=5))
    fresh = spark.createDataFrame([(url(10_000 + i, i % 2), float(i % 2)) for i in range(300)], "url string, blocked double")
    assert trained.judge(lexical(fresh)).where("(score >= 0.5) = (blocked = 1)").count() >= 290


def test_url_rules_in_sql(spark):
    """Host, path and rule of whole pages, by DuckDB."""
    import duckdb

    want = sorted(duckdb.sql(url_filter.SQL.replace("FROM pages", "FROM '/root/testdata/sf0.001/pages.parquet'")).fetchall(), key=str)
    got = url_filter.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).select("page_id", "host", "path", "rule")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_embedding_sql(spark):
    import duckdb

    want = sorted(duckdb.sql(embedding_dedup.SQL.replace("FROM embeddings", "FROM '/root/testdata/sf0.001/embeddings.parquet'")).fetchall())
    got = embedding_dedup.dedup(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and sorted(map(tuple, got.collect())) == want


# --- filter audit, line dedup, spelling variants ---

AUDIT_SCHEMA = "doc_id long, text string, lang string, part string, mask int, good int"


def audit_rows():
    rng = random.Random(4)
    words = ["plain", "Words", "of", "A", "TEXT", "x$", "ünd", "a|b", "row\tB", "ÀÉ", " ", "𝔘"]
    text = lambda k: " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(k))
    rows = [(i, text(rng.choice([0, 3, 99, 100, 101, 140])), rng.choice(["en", "de", None, ""]), "p", 1, 2) for i in range(60)]
    rows += [(60 + i, rows[rng.randrange(40)][1], rng.choice(["en", "de"]), None, None, None) for i in range(30)]
    rows += [(90, None, "en", "p", 0, 0), (91, "", None, "p", 0, 0), (5, rows[5][1], "fr", "p", 0, 0), (5, "another", "en", "p", 0, 0), (None, rows[7][1], "en", "p", 0, 0), (None, "alone", None, "p", 0, 0)]
    rows.append((99, "long " * 50_000, "en", "p", 0, 0))
    return rows


def brute_audit(rows, labels):
    from itertools import permutations

    blank = re.compile(r"[^\x20\x09-\x0D]+")
    failing = []
    for d, t, lang, *_ in rows:
        t = t or ""
        w = blank.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and any(o is not None and o < d and (u or "") == t for o, u, *_ in rows) else set()
        failing.append((lang or "", fails, any(q == 1 for i, q, _ in labels if i == d and d is not None), any(x == 1 for i, _, x in labels if i == d and d is not None)))
    out, removed_at = [], {}
    for part in {p for p, *_ in failing}:
        mine = [f for f in failing if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                removed_at[part, f] = removed_at.get((part, f), 0) + len(gone)
                redundant = sum(f in m[1] for m in mine) - len(gone)
                out.append((part, order, step, len(left), len(gone), redundant, sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)))
    return sorted((*r, removed_at[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, None), (5, 1, 0)]
    docs = spark.createDataFrame(rows, AUDIT_SCHEMA).repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, marked).collect())
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marked).count() == 0
    assert sorted(tuple(r) for r in filter_audit.audit(docs, marked.limit(0)).collect()) == brute_audit(rows, [])
    two = {"L": lambda text, words: F.length(text) > 20, "N": lambda text, words: F.size(words) == 0}
    assert {(r["filter_order"], r["step"]) for r in filter_audit.audit(docs, marked, filters=two).collect()} == {("LN", 1), ("LN", 2), ("NL", 1), ("NL", 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, marked, filters=dict.fromkeys("ABCDEFG"))


def line_rows():
    rng = random.Random(6)
    line = lambda: rng.choice(["", " ", "short", "Ünï çödé ", "exactly10!", "nine char"]) + rng.choice(["", "\t a line that repeats ", "A Line that Repeats", f"line number {rng.randint(0, 400)}"])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 12))), "k", "g", 3) for i in range(80)]
    rows += [(80, None, "k", None, None), (81, "", None, "g", 1), (82, "\n", "k", "g", 1), (83, "\n".join(["same line here"] * 40), "k", "g", 1), (84, "ÄÖÜÄÖÜÄÖÜÄ\r\n" * 3, "k", "g", 1), (85, "ÄÖÜÄÖÜÄÖÜÄ", "k", "g", 1)]
    rows += [(7, rows[7][1] + "\na line of a second row", "k", "g", 1), (9, "a line of a second row", "k", "g", 1), (None, rows[3][1], "k", "g", 1), (None, "only without an id\nsame line here", "k", "g", 1), (None, "only without an id", "k", "g", 1)]
    rows.append((99, "\n".join(f"line number {i}" for i in range(30_000)), "k", "g", 1))
    rows.append((100, "x" * 200_000 + "\nexactly10!" + "\n" + "y" * 100_000, "k", "g", 1))
    return rows


def brute_lines(rows):
    key = lambda line: line.encode().strip(b" \t\n\v\f\r").lower().decode()
    first = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in first or (d is not None and first[key(x)] == d)]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("setup", [line_dedup.Setup(), line_dedup.Setup(slice_lines=700, filter_bits=1 << 13), line_dedup.Setup(slice_lines=64, filter_bits=512)])
def test_line_dedup(spark, setup):
    """Also with filters so small that nearly all lines are suspected."""
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, gone string, n_lines int").repartition(4)
    assert sorted((tuple(r) for r in line_dedup.digest(docs, setup).collect()), key=str) == brute_lines(rows)
    out = line_dedup.dedup(docs, setup)
    assert out.columns == ["doc_id", "text", "key", "gone", "n_lines", "n_dropped"]
    assert out.where("doc_id = 85").first()["text"] == "" and out.where("doc_id = 80").first()["gone"] is None
    assert line_dedup.dedup(docs.limit(0), setup).count() == 0


def test_bloom_filter():
    h = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = line_dedup.Bloom(1 << 15)
    b.add(h[:2000])
    assert b.has(h[:2000]).all() and b.has(h[2000:]).mean() < 0.05


def brute_variants(rows, setup):
    import functools
    from collections import Counter

    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if setup.noise and h % setup.noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= setup.least_length and c >= setup.least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {w: min(x, key=lambda y: (-n[y], y)) if x and max(n[y] for y in x) >= setup.times * n[w] else None for w, x in links.items()}
    root = functools.cache(lambda w: root(form[w]) if form[w] else w)
    return sorted((w, form[w] or "", root(w), n[w], len(links[w]), n[form[w]] if form[w] else 0) for w in n)


@pytest.mark.parametrize("setup", [variants.Setup(), variants.Setup(q=2, noise=3, least_n=2, times=2), variants.Setup(tile=3, noise=5, least_n=2, times=3), variants.Setup(q=1, least_length=2, noise=0, least_n=1, tile=20)])
def test_spelling_variants(spark, setup):
    rng = random.Random(8)
    stems = ["banana", "bananas", "banane", "straße", "aaaaaa", "aaaaaaa", "aabaaa", "Publication", "publications", "années", "×÷abcd", "abcabcabc"]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxé") + w[i:], w[:i] + rng.choice("abxÉ") + w[i + 1 :]])

    words = [w for s in stems for w in [s] * rng.randint(1, 60)] + [typo(rng.choice(stems)) for _ in range(300)]
    words += [typo(typo(s)) for s in stems for _ in range(6)]
    rows = [(i, " 1".join(rng.choices(words, k=60)), "w", 1, None) for i in range(40)] + [(5, "banana " * 9, "w", 1, None), (None, "banana straße " * 5, None, 1, None), (41, None, "w", 1, None), (42, "", "w", 1, None)]
    rows.append((43, "q" * 3000 + " " + "q" * 3001 + " Bananas" * 20_000 + " " + "q" * 3000, "w", 1, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long, form string").repartition(3)
    got = variants.group(docs, setup)
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in got.collect()) == brute_variants(rows, setup)
    assert variants.group(docs.limit(0), setup).count() == 0


@given(st.lists(st.lists(st.integers(0, 30), max_size=20), max_size=8), st.integers(1, 4), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_merged_postings(lists, least, start):
    lists = [sorted(set(x)) for x in lists]
    assert list(variants.merged(lists, least, start)) == [i for i in range(start, 31) if sum(i in x for x in lists) >= least]


def test_toxicity_learns_beside_a_long_text(spark):
    """A text longer than all that is learnt from, wherever its hash puts it, doesn't end the sample."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["calm", "lamp", "tree", "road"] + (["vilefoe", "hateslur"] if i % 2 else [])) for _ in range(12)), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    setup = toxicity.Setup(max_words=2000)
    for longs in ((), range(0, 300, 7)):
        docs = spark.createDataFrame([(i, t + " tree" * 3000 * (i in longs), lang) for i, t, lang in rows], "doc_id long, text string, lang string")
        got = {r.doc_id: (r.score, r.predicted) for r in toxicity.digest(docs, labels, setup).collect()}
        assert len({s for s, _ in got.values()}) > 10
        assert sum(got[i][1] == i % 2 for i in range(300) if i not in longs) > 250


def test_shingles_of_all_documents_are_counted(spark, monkeypatch):
    """Not of a share of them: the table has the counts of all sets."""
    monkeypatch.setattr(simhash, "COUNTED", 5000)
    rule = simhash.NEAR
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('a very common line stands here', if(id % 1000 = 7, concat(' with ', id % 3000, ' behind'), '')) AS text").repartition(5)
    counts = {}
    for text in [None, "", *(r.text for r in docs.collect())]:
        for h in simhash.shingles(text, rule.words).tolist():
            counts[h] = counts.get(h, 0) + 1
    got = simhash._common(docs.unionByName(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")), rule)
    want = np.zeros(simhash.CELLS, np.uint8)
    for h, n in counts.items():
        if n > 2:
            at = h % simhash.CELLS
            want[at] = max(want[at], min(127, round(4 * np.log2(n))))
    assert len(counts) > 5 and want.max() == 59 and (got == want).all()
    assert not simhash._common(docs.limit(0), rule).any()


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the model, not the sample."""
    real = toxicity.fit

    def fit(rows, setup):
        model = real(rows, setup)
        model.thresholds["process"] = os.getpid()
        return model

    monkeypatch.setattr(toxicity, "fit", fit)
    docs = spark.createDataFrame([(i, "calm lamp" + " vilefoe" * (i % 2), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.Setup(buckets=512, epochs=1))
    assert model.constant is None and model.thresholds["process"] != os.getpid()


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Not from a sample, nor from short texts alone: each rude word stands in a few rows, one in long texts only."""
    rng = random.Random(12)
    rude = [f"rude{chr(97 + i)}word" for i in range(24)]
    calm = lambda n: [rng.choice(["calm", "lamp", "tree", "road", "été"]) for _ in range(n)]
    rows = [(i, " ".join(calm(8) + [rude[i % 24]] * (i // 24 % 2)), ["en", "fr"][i % 2]) for i in range(1440)]
    rows += [(5000 + i, " ".join(calm(400) + ["onlylong"] * (i % 2)), "en") for i in range(80)]
    labels = [(d, int(any(w in t for w in ("rude", "onlylong")))) for d, t, _ in rows]
    unseen = [(9000 + i, " ".join([*calm(9), w]), None) for i, w in enumerate([*rude, "onlylong", *["lamp"] * 20])]
    schema = "doc_id long, text string, lang string"
    docs, marked = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    setup = toxicity.Setup(max_rows=200, max_words=4000, buckets=4096)
    for most in (0, toxicity.BROADCAST):
        monkeypatch.setattr(toxicity, "BROADCAST", most)
        model = toxicity.train(docs, marked, setup)
        got = {r.doc_id: r.toxicity_score >= 0.5 for r in toxicity.score(spark.createDataFrame(unseen, schema), model).collect()}
        assert [got[9000 + i] for i in range(45)] == [True] * 25 + [False] * 20
        assert set(model.thresholds) == {"en", "fr"}


def test_toxicity_hashes_side_by_side():
    some = [b"", b"a", b"abc", b"word", b"sevenxx", b"it's", b"x" * 32, b"y" * 33, "été".encode(), "ßßßßßßß".encode(), *(b"w%d" % i for i in range(300))]
    assert toxicity._ids_of(some[1:], 4096).tolist() == [toxicity._ids(w, 4096) for w in some[1:]]
    assert toxicity._ids_of([], 4096).shape == (0, 5) and toxicity._ids_of(some[-1:], 4096).tolist() == [toxicity._ids(some[-1], 4096)]


def test_toxicity_blocks_and_pieces(monkeypatch):
    """Blocks are whole and within their bounds; long texts go through the net in pieces."""
    model, texts, of = small_net(5)
    texts = texts * 3 + ["long " * 50]
    rb = pa.RecordBatch.from_pydict({"text": texts, "toxic": [i % 2 for i in range(len(texts))]})
    setup = toxicity.Setup(buckets=40, dims=3, filters=2, max_rows=4, max_words=12)
    got = list(toxicity.blocks(iter([rb.slice(0, 5), rb.slice(5)]), setup))
    assert [y for _, ys in got for y in ys] == [i % 2 for i in range(len(texts))]
    assert all(len(ys) == 1 or len(ys) <= 4 and sum(np.count_nonzero(t) for t in w.texts) <= 12 for w, ys in got) and len(got) > 4
    monkeypatch.setattr(toxicity, "STEP", 7)
    z = np.concatenate([toxicity.gradients(model, w, np.arange(len(ys)), ys)[0] for w, ys in got])
    assert z == pytest.approx([plain_logit(model, t) for t in texts], abs=1e-9)
    assert list(toxicity.Scorer(model).logits(texts)) == pytest.approx(z, abs=1e-4)


def test_toxicity_tasks_are_averaged():
    """An embedding by those that met it, all other numbers by all; squares too."""
    setup = toxicity.Setup(buckets=100, dims=4, filters=2, rate=0.5)
    start = toxicity.Learner(setup, np.random.default_rng(1))
    sums, own = {}, []
    for k, texts in enumerate((["bad a", "good b"], ["bad c", "good b"])):
        rb = pa.RecordBatch.from_pydict({"text": texts * 9, "toxic": [1, 0] * 9})
        mine = copy.deepcopy(start)
        for of, y in toxicity.blocks(iter([rb]), setup):
            mine.learn(of, y, np.arange(len(y)), 2, np.random.default_rng(k))
        own.append(mine)
        for piece, x in mine.change(start):
            x = x.copy()
            if piece >= 0:
                x[:, setup.dims : -1] **= 2
            sums[piece] = sums.get(piece, 0) + x
    got = start.changed(sums)
    met = np.array([(o.embed != start.embed).any(axis=1) for o in own])
    assert met.any(axis=0).sum() > 5 and (met[0] != met[1]).any()
    for a, b, of in ((got.model.embed, start.model.embed, [o.model.embed for o in own]), (got.embed, start.embed, [o.embed for o in own])):
        want = b + sum(np.where(m[:, None], x - b, 0) for m, x in zip(met, of, strict=True)) / np.maximum(met.sum(axis=0), 1)[:, None]
        assert a == pytest.approx(want, abs=1e-5)
    assert got._small() == pytest.approx((own[0]._small() + own[1]._small()) / 2, abs=1e-5)


def test_toxicity_is_calibrated_on_all_held_rows(spark):
    """In steps of the logits, by all rows."""
    rng = random.Random(3)
    model = small_net(7)[0]
    rows = [(" ".join(rng.choice(["alpha", "beta", "one", "two", "three"]) for _ in range(rng.randint(0, 9))), rng.choice([0, 0, 1]), ["en", "xx"][i < 20]) for i in range(900)]
    x = np.array([plain_logit(model, t) for t, _, _ in rows])
    rows = [(t, int(y or z > np.median(x)), lang) for (t, y, lang), z in zip(rows, x, strict=True)]
    y, n = np.array([float(r[1]) for r in rows]), np.ones(len(rows))
    want = copy.deepcopy(model)
    toxicity._calibrate(want, x, y, n)
    got = toxicity._calibrated(spark.createDataFrame(rows, "text string, toxic int, lang string").repartition(3), copy.deepcopy(model))
    assert (got.scale, got.shift) == pytest.approx((want.scale, want.shift), rel=0.02, abs=0.02) and set(got.thresholds) == {"en"}
    mine = np.array([r[2] == "en" for r in rows])
    wrong = lambda cut: ((toxicity._scores(got, x[mine]) >= cut) != (y[mine] == 1)).sum()
    assert wrong(got.thresholds["en"]) <= wrong(toxicity._threshold(toxicity._scores(want, x[mine]), y[mine], n[mine])) + 5
