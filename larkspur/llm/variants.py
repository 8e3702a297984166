"""Spelling variants: words within one edit, found through a positional q-gram inverted index with a count filter.

One edit spoils at most q of a word's q-grams, so two words within one edit, the longer of length l, share at least l - q + 1 - q of them, at
positions that differ by no more than the lengths do. With its grams in order of rarity, two such words share one of the first q + 1 of each.

1. Words are counted over all documents (summed in the tasks first).
2. A word is posted under each of its q + 1 rarest grams with position and length, and visits the postings of words one letter longer: some dozen
   rows a word, whatever the size. Places with very many words are cut into tiles.
3. At a place, the words that live there are indexed by gram and position. Each word that lives there or visits heap-merges the postings of its
   grams, at its own positions or one later, skipping what can't reach the bound; what reaches it is verified letter by letter.
4. A word's form is its commonest near word, if that is common enough; roots follow by doubling the steps.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import by_runs, drop, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


@dataclass(frozen=True)
class Setup:
    """q: letters of a gram; words have 2q at least, so that one edit leaves a gram. least_n: occurrences of a word. times: how many times commoner a form is.

    noise: of so many (document, word) pairs one gives a misspelling made on purpose; 0: none. tile: words of a place that are compared in one task.
    """

    q: int = 3
    least_length: int = 6
    least_n: int = 5
    times: int = 5
    noise: int = 199
    tile: int = 4096


#: Distinct words that a task holds before it sends its counts on.
HELD = 300_000


def _counts(setup: Setup) -> Callable:
    """(word, n) of a partition, each word mostly once."""

    def out(total: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    def run(batches):
        total: Counter = Counter()
        for rb in batches:
            for doc, raw in zip(rb.column("doc_id").to_pylist(), rb.column("text").cast(pa.binary()), strict=True):
                # bytes.lower knows ASCII only
                found = Counter(RUN.findall((raw.as_py() or b"").lower().decode()))
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in found.items():
                    if setup.noise:
                        h = zlib.crc32(w.encode(), head)
                        if h % setup.noise == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                    if len(w) >= setup.least_length:
                        total[w] += n
                if len(total) > HELD:
                    yield out(total)
                    total = Counter()
        yield out(total)

    return run


def count_words(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(word, n): runs of Latin letters of all texts, A-Z lower-cased, of `setup.least_length` letters and `setup.least_n` occurrences or more.

    Null and empty texts have none. A null doc_id counts as ''. Rows of equal doc_id count each.
    """
    counted = docs.select("doc_id", "text").mapInArrow(_counts(setup), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= setup.least_n)


def grams(word: str, q: int) -> list[str]:
    return [word[i : i + q] for i in range(len(word) - q + 1)]


def _key(gram: str, at: int, length: int) -> int:
    h = xxhash.xxh3_64_intdigest(f"{at} {length} {gram}")
    return h - (1 << 64) if h >> 63 else h


def _posts(shared, q: int) -> Callable:
    """(key, word, n, lives): where a word lives and which places it visits."""

    def run(batches):
        rank = shared.value
        for rb in batches:
            rows = {"key": [], "word": [], "n": [], "lives": []}
            for w, n in zip(rb.column("word").to_pylist(), rb.column("n").to_pylist(), strict=True):
                home, away = _places(w, q, rank)
                for keys, lives in ((home, True), (away, False)):
                    for k in keys:
                        rows["key"].append(k)
                        rows["word"].append(w)
                        rows["n"].append(n)
                        rows["lives"].append(lives)
            yield pa.record_batch({"key": pa.array(rows["key"], pa.int64()), "word": pa.array(rows["word"], pa.string()), "n": pa.array(rows["n"], pa.int64()), "lives": pa.array(rows["lives"], pa.bool_())})

    return run


def _places(word: str, q: int, rank: dict[str, int]) -> tuple[set[int], set[int]]:
    """Where a word lives, and where those one letter longer live that it may be near."""
    rarest = sorted((rank.get(g, 0), g, i) for i, g in enumerate(grams(word, q)))[: q + 1]
    home = {_key(g, i, len(word)) for _, g, i in rarest}
    away = {_key(g, i + d, len(word) + 1) for _, g, i in rarest for d in (0, 1)}
    return home, away


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced; `a` is no longer than `b`."""
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def merged(lists: list[list[int]], least: int, start: int = 0) -> Iterator[int]:
    """Numbers from `start` that stand in `least` of the sorted lists or more, by a heap; what too few lists hold is skipped."""
    heap = [(x[i], j, i) for j, x in enumerate(lists) if (i := bisect_left(x, start)) < len(x)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            to = max(heap[0][0], top + 1)
        for _, j, i in popped:
            i = bisect_left(lists[j], to, i)
            if i < len(lists[j]):
                heapq.heappush(heap, (lists[j][i], j, i))


def near_in(lives: set[str], visits: set[str], q: int) -> Iterator[tuple[str, str]]:
    """Pairs within one edit of a word that visits and one that lives here, the shorter or lesser first. All that live here are of one length, visitors of that or one less."""
    here = sorted(lives)
    if not here or len(lives | visits) < 2:
        return
    length = len(here[0])
    postings: dict[tuple[str, int], list[int]] = defaultdict(list)
    for j, w in enumerate(here):
        for i, g in enumerate(grams(w, q)):
            postings[g, i].append(j)
    none: list[int] = []
    for w in visits:
        shorter = len(w) < length
        start = 0 if shorter else bisect_right(here, w)
        lists, least = [], length - q + 1 - q
        for i, g in enumerate(grams(w, q)):
            same, later = postings.get((g, i), none), postings.get((g, i + 1), none) if shorter else none
            both = sorted({*same, *later}) if same and later else same or later
            if len(both) == len(here):  # such as the gram of the place: one for each, so that the rest need one less
                least -= 1
            elif both:
                lists.append(both)
        for j in merged(lists, least, start) if least > 0 else range(start, len(here)):
            if one_edit(w, here[j]):
                yield w, here[j]


def _pairs(shared, q: int) -> Callable:
    """(a, a_n, b, b_n) of a partition sorted by place; a pair that meets at several places is told at the least of them."""

    def at_places(t: pa.Table) -> pa.RecordBatch:
        rank = shared.value
        found: list[tuple[str, int, str, int]] = []
        places: dict[tuple, tuple[dict[int, set], dict[int, set]]] = {}
        count: dict[str, int] = {}
        where: dict[str, tuple[set[int], set[int]]] = {}
        cols = [t.column(c).to_pylist() for c in ("place", "key", "word", "n", "lives", "visits")]
        for place, key, w, n, lives, visits in zip(*cols, strict=True):
            count[w] = n
            residents, visitors = places.setdefault((place, key), (defaultdict(set), defaultdict(set)))
            if lives:
                residents[len(w)].add(w)
            if visits:
                visitors[len(w)].add(w)
        for (_, key), (residents, visitors) in places.items():
            for length, lives in residents.items():
                for a, b in near_in(lives, visitors[length - 1] | visitors[length], q):
                    for w in (a, b):
                        if w not in where:
                            where[w] = _places(w, q, rank)
                    if min(where[a][len(a) < len(b)] & where[b][0]) == key:
                        found.append((a, count[a], b, count[b]))
        a, an, b, bn = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.record_batch({"a": pa.array(a, pa.string()), "a_n": pa.array(an, pa.int64()), "b": pa.array(b, pa.string()), "b_n": pa.array(bn, pa.int64())})

    return lambda batches: by_runs(batches, "place", at_places, 2000)


def near_words(words: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(a, a_n, b, b_n): each pair of `words` (word, n; each word once, of 2q letters or more) that one letter inserted, deleted or replaced tells apart, once."""
    sc = words.sparkSession.sparkContext
    spelled = words.select(F.explode(F.expr(f"transform(sequence(1, length(word) - {setup.q - 1}), i -> substring(word, i, {setup.q}))")).alias("gram"))
    # an alphabet to the power of q at most: of Latin letters 90^3 = 729,000
    by_rarity = [r["gram"] for r in spelled.groupBy("gram").count().orderBy("count", "gram").select("gram").collect()]
    rank = sc.broadcast({g: i for i, g in enumerate(by_rarity)})
    posts = table(words.select("word", "n").mapInArrow(_posts(rank, setup.q), "key long, word string, n long, lives boolean"), "posts")

    # a place of more words is cut into tiles of two parts, one living there and one visiting; what lives there visits too
    large = posts.groupBy("key").count().where(F.col("count") > setup.tile).select("key", F.ceil(F.col("count") / setup.tile).cast("int").alias("parts"))
    cut = posts.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    at_home = F.expr("filter(transform(sequence(0, parts - 1), i -> struct(mine * parts + i AS tile, lives AS lives, i = mine AS visits)), x -> x.lives)")
    as_guest = F.expr("transform(sequence(0, parts - 1), i -> struct(i * parts + mine AS tile, lives AND i = mine AS lives, true AS visits))")
    dealt = cut.withColumn("mine", mine).select("key", "word", "n", F.inline(F.array_union(at_home, as_guest)))
    dealt = dealt.withColumn("place", F.xxhash64("key", "tile")).select("place", "key", "word", "n", "lives", "visits")
    return dealt.repartition("place").sortWithinPartitions("place").mapInArrow(_pairs(rank, setup.q), "a string, a_n long, b string, b_n long")


def group(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """A row for each word of `docs` (see `count_words`): word, form, root, n, n_near, form_n.

    n_near: words within one edit. form: of these the commonest (the lesser of equals, by code points), if it is `setup.times` times as common; form_n: its
    n. root: where forms lead to, the word itself if it has none. Forms get commoner from step to step, so they never turn in a circle.

    A table without such words gives an empty one; other columns of `docs` don't matter.
    """
    if setup.least_length < 2 * setup.q or setup.times < 2:
        raise ValueError("words must have 2q letters at least, and forms be twice as common")
    words = table(count_words(docs, setup), "words")
    pairs = table(near_words(words, setup), "pairs")
    # a word of length l over an alphabet of s letters has (2l + 1)s near words at most, so that none of these groups is large
    ends = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("near"))
    ends = ends.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word")).alias("near")))
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    form = F.when(-F.col("best.less") >= setup.times * F.col("n"), F.col("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("best"))
    known = table(known.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n")), "forms")
    drop(words, pairs)

    roots = table(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    moved = True
    while moved:  # twice as far each time: n grows `times`-fold a step, so some five rounds do for any corpus
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = table(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not further.where("moved").isEmpty()
        drop(roots)
        roots = further
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: It makes CRCs from their polynomial, finds near words by what is left when a letter is deleted, and walks from form to form.
SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
u AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM u GROUP BY ALL),
b AS (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS h FROM b, t),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT DISTINCT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
s AS (SELECT word, count(*) AS n_near, min((-near_n, encode(near), near)) AS best FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[3] END AS form, CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END AS form_n
  FROM w LEFT JOIN s ON w.word = s.word),
r AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM f UNION SELECT r.word, coalesce(f.form, r.root), f.form IS NULL FROM r JOIN f ON f.word = r.root WHERE NOT done)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN r ON f.word = r.word AND done
"""
