"""What quality filters cost in every order, by a subset-zeta transform over counts of masks.

A document fails some of the filters: a mask. Documents are counted by part and mask, one partial aggregate. The subset-zeta transform turns a
part's counts into survivors for every subset of the filters; what a filter removes at a step of an order is then the difference between two
neighbouring subsets, and so are the good and toxic documents that it loses. No document is looked at again for any order.

A filter for exact copies needs no way back to the documents: rows of one text fail the other filters alike, so all are counted as copies first
and those of the text's least doc_id are counted back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


#: Whether a text fails, of its text (never null) and its words.
Fails = Callable[[Column, Column], Column]

#: Conditions under which a text fails, by letter. None: it is the text of a smaller doc_id.
FILTERS: dict[str, Fails | None] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
    "E": None,
}


def _masks(docs: DataFrame, labels: DataFrame, part: str, filters: Mapping[str, Fails | None]) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    copies = sum(bit[f] for f, fails in filters.items() if fails is None)
    judged = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    # the words are made once: a struct in an array of one, so that the optimizer doesn't inline them into each use
    judged = judged.select("id", "part", F.inline(F.array(F.struct("text", words(F.col("text")).alias("words")))))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), bit[f]).otherwise(0) for f, fails in filters.items() if fails is not None), F.lit(0))
    judged = judged.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("key"))

    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    zero = [F.lit(0).alias("good"), F.lit(0).alias("toxic")]
    known = judged.where("id IS NOT NULL").join(marks, "id", "left").select("id", "part", "mask", "key", *[F.coalesce(m, F.lit(0)).alias(m) for m in ("good", "toxic")])
    # rows without doc_id are no copies and have no labels; apart, they don't meet in one task
    rest = judged.where("id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", *zero)
    if not copies:
        return known.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).unionByName(rest)

    sums = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    # the join has dealt the rows by doc_id, so this step needs no shuffle; it has a row for each part of a doc_id and text, mostly one
    one = known.groupBy("key", "id", "part", "mask").agg(*sums)
    cells = one.groupBy("key", "id").agg(F.collect_list(F.struct("part", "mask", "n", "good", "toxic")).alias("cells"))
    # of each text the cells of its least doc_id, whole: a partial aggregate, however many copies there are
    first = cells.groupBy("key").agg(F.min(F.struct("id", "cells")).alias("least")).select(F.inline("least.cells"))
    as_copies = one.select("part", F.col("mask").bitwiseOR(copies).alias("mask"), "n", "good", "toxic")
    back = first.select("part", F.col("mask").bitwiseOR(copies).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    return as_copies.unionByName(first).unionByName(back).unionByName(rest)


def _survivors(part_masks: DataFrame, k: int) -> DataFrame:
    """(part, n, good, toxic): by subset S of the filters, how many documents fail none outside of S. The zeta transform: S sums the counts of all its subsets."""
    cells = part_masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    by_part = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("at"))  # 2^k entries at most

    def counts(of: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: F.coalesce(F.col("at")[m].getField(of), F.lit(0).cast("long")))

    def over(of: str, low: int) -> Column:
        return F.transform(of, lambda x, m: x + F.when(m.bitwiseAND(low) > 0, F.get(F.col(of), m.bitwiseXOR(F.lit(low)))).otherwise(0))

    for of in ("n", "good", "toxic"):
        by_part = by_part.withColumn(of, counts(of))
        for b in range(k):
            by_part = by_part.withColumn(of, over(of, 1 << b))
    return by_part.drop("at")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: Mapping[str, Fails | None] = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    filters: a letter each, with the condition on its text and words under which a document fails; None: its text is also that of a row with a smaller
    doc_id, removed or not. Six filters have 720 orders; more are refused.

    Null texts count as empty, null parts as ''. Rows without doc_id are nobody's copies, make none and have no labels. Rows of equal doc_id are
    counted each. A doc_id with several labels is good (toxic) if one of them says so. No documents: no rows. Columns of other names don't matter.
    """
    letters, k = list(filters), len(filters)
    if not 1 <= k <= 6 or any(len(f) != 1 for f in letters):
        raise ValueError("filters must be one to six, a letter each")
    parts = _survivors(_masks(docs, labels, part, filters), k)
    everything = (1 << k) - 1
    bits = F.create_map(*[F.lit(x) for i, f in enumerate(letters) for x in (f, 1 << i)])
    at = lambda of, removed: F.get(F.col(of), F.lit(everything).bitwiseXOR(removed))  # survivors of the filters in `removed`
    lost = lambda of, before, bit: at(of, before) - at(of, before.bitwiseOR(bit))  # what one more filter removes

    # over all orders a filter follows just the subset S in |S|! (k - 1 - |S|)! of them
    weights = F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)])
    subsets = lambda bit: F.filter(F.sequence(F.lit(0), F.lit(everything)), lambda m: m.bitwiseAND(bit) == 0)
    shares = lambda bit: F.aggregate(subsets(bit), F.lit(0).cast("long"), lambda s, m: s + F.get(weights, F.bit_count(m)) * lost("n", m, bit))
    parts = parts.withColumn("shares", F.map_from_arrays(F.array(*[F.lit(f) for f in letters]), F.array(*[shares(F.lit(1 << i)) for i in range(k)])))

    steps = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda s, f: s + F.coalesce(bits[f], F.lit(0)))
    steps = steps.withColumn("bit", bits[F.col("letter")]).withColumn("before", before)
    bit, before = F.col("bit"), F.col("before")
    removed = lost("n", before, bit)
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("n", before.bitwiseOR(bit)).alias("kept"),
        removed.alias("removed"),
        (lost("n", F.lit(0), bit) - removed).alias("redundant"),
        lost("n", F.lit(everything).bitwiseXOR(bit), bit).alias("unique_fails"),
        lost("good", before, bit).alias("good_lost"),
        lost("toxic", before, bit).alias("toxic_lost"),
        F.col("shares")[F.col("letter")].alias("shapley"),
    )


#: For the filters above and parts by lang; it counts each step's documents by their masks, without subsets' sums or differences.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT part, o, step, n, good, toxic, fails[o[step]] AS here, len(list_filter(o[1:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, o, step, sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN here AND alone THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, list_aggregate(list_transform(o, lambda x: chr((64 + x)::INT)), 'string_agg', '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley FROM r
"""
