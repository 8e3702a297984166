"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of all bytes over the bytes it has. Each document's
repetition count inverts a Poisson distribution of that mean at a uniform number made from a
hash of seed and doc_id; the document is exploded by the count, and the copies are dealt out
and sorted by a hash, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import table

#: A rate above this is split into equal Poisson parts, so that exp(-rate) never underflows.
PART = 16.0
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from 13 hex digits of an MD5; other engines make the same number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate) over all documents: target share * epochs * all bytes / the source's bytes.

    weights: by source; a source that isn't named gets 0. Without weights a source's weight is its
    bytes to the power `alpha`. A null source is a source of its own. A source without bytes gets 0.
    """
    sums = docs.groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    if weights is None:
        weight = F.when(F.col("bytes") > 0, F.pow(F.col("bytes").cast("double"), F.lit(alpha))).otherwise(0.0)
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.when(F.col("bytes") > 0, F.try_element_at(named, F.coalesce("source", F.lit("")))).cast("double"), F.lit(0.0))
    sums = sums.withColumn("weight", weight)
    total = sums.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("weight") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * F.lit(float(epochs)) * F.col("all_bytes") / F.col("bytes"))
    return sums.crossJoin(F.broadcast(total)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))  # total is one row


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """The columns of `docs`, a row for each copy, with mix_copy (from 1) and mix_key (the place in the shuffle).

    Rows of equal doc_id get equal counts. A null doc_id hashes as its own value; null and empty texts
    weigh nothing and follow their source's rate. Columns of `docs` named mix_copy or mix_key are replaced, all
    others are kept, whatever their names.
    """
    docs = docs.drop("mix_copy", "mix_key")
    r = table(rates(docs, weights, alpha, epochs), "rates")  # so that `docs` is summed once
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    # cdf[k] = P(X <= k), until what is left is below the uniform number's own step
    cdf = F.aggregate(
        F.sequence(F.lit(1), (F.lit(40) + 4 * F.ceil(F.col("part"))).cast("int")),
        F.struct(F.exp(-F.col("part")).alias("p"), F.array(F.exp(-F.col("part"))).alias("c")),
        lambda s, k: F.struct((s.p * F.col("part") / k).alias("p"), F.concat(s.c, F.array(F.element_at(s.c, -1) + s.p * F.col("part") / k)).alias("c")),
        lambda s: s.c,
    )
    many = r.count() if weights is None else len(weights)  # sources that aren't named have rate 0 and need no row
    r = r.where("rate > 0").withColumn("parts", parts).withColumn("part", F.col("rate") / F.col("parts"))
    r = r.select(F.col("source").alias("of"), "parts", cdf.alias("cdf"))
    # the row is one struct from here on, so that no column's name can clash with these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(F.broadcast(r) if many <= BROADCAST_SOURCES else r, F.col("row.source").eqNullSafe(F.col("of")))
    who = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))
    uniform = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: _uniform(F.lit(str(seed)), who, j.cast("string")))
    n = F.aggregate(uniform, F.lit(0), lambda s, u: s + F.size(F.filter("cdf", lambda c: c < u)))
    counted = joined.select("row", n.alias("n")).where("n > 0")
    copies = counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}p"), who, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    dealt = copies.withColumn("key", key).repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("copy").alias("mix_copy"), F.col("key").alias("mix_key"))


#: For alpha = 0.5, one epoch, seed 42 and rates up to PART.
SQL = """
WITH s AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS b FROM documents GROUP BY source),
t AS (SELECT sum(b) AS tb, sum(CASE WHEN b > 0 THEN sqrt(b) ELSE 0 END) AS tw FROM s),
r AS (SELECT source, CASE WHEN b > 0 THEN sqrt(b) / tw * tb / b ELSE 0 END AS rate FROM s, t),
c AS (SELECT source, k, sum(CASE WHEN rate > 0 THEN exp(-rate + k * ln(rate) - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(0, 105)) AS k)),
u AS (SELECT *, ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null') || '|1'), 1, 13))::BIGINT / 4503599627370496.0 AS u01 FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, c.k FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u01)
SELECT doc_id, text, lang, source, n_chars, k + 1 AS mix_copy,
  ('0x' || substr(md5('42p|' || coalesce(doc_id::VARCHAR, 'null') || '|' || (k + 1)), 1, 15))::BIGINT AS mix_key FROM n
"""
