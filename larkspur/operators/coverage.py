"""Coverage of enrichment, queues and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(json: Column, field: str) -> Column:
    """Whether an object has a field that isn't JSON null; false for text that is no object."""
    v = F.try_parse_json(json)
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    got = F.try_variant_get(v, f"$.{field}", "variant")
    return whole & got.isNotNull() & ~F.coalesce(F.is_variant_null(got), F.lit(True))


def signal_counts(rows: DataFrame, meta: str, fields: list[str], key: str = "id") -> DataFrame:
    """Distinct keys, and of those the ones that have each field."""
    return rows.agg(F.countDistinct(key).alias("total"), *[F.countDistinct(F.when(present(F.col(meta), f), F.col(key))).alias(f) for f in fields])


def fraction(part: Column, total: Column) -> Column:
    """In [0, 1], 6 places; null for no total."""
    return F.when(total > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part / total)), 6))


def throughput_per_day(snapshots: DataFrame, as_of: Column, since: Column | None = None) -> DataFrame:
    """One row: enriched a day in the last 24 hours; null for fewer than two points, no gain or under 900 seconds."""
    start = as_of - F.expr("interval 24 hours")
    if since is not None:
        start = F.greatest(start, F.least(since, as_of))
    s = snapshots.where((F.col("ts") >= start) & (F.col("ts") <= as_of) & F.col("enriched_properties").isNotNull())
    g = s.agg(F.count(F.lit(1)).alias("n"), F.min_by("enriched_properties", "ts").alias("a"), F.max_by("enriched_properties", "ts").alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    seconds = (F.unix_micros("t1") - F.unix_micros("t0")) / 1e6
    ok = (F.col("n") >= 2) & (F.col("b") > F.col("a")) & (seconds >= 900)
    return g.select(F.when(ok, (F.col("b") - F.col("a")) / (seconds / 86400)).alias("per_day"))


def eta_days(remaining: Column, per_day: Column) -> Column:
    return F.when(remaining <= 0, 0).when(per_day > 0, F.ceil(remaining / per_day)).cast("long")


def bucket(blocked: Column, quarantined: Column) -> Column:
    """Each candidate lies in one: blocked before quarantined before workable."""
    return F.when(F.coalesce(blocked, F.lit(False)), "blocked").when(F.coalesce(quarantined, F.lit(False)), "quarantined").otherwise("workable")


def census(rows: DataFrame) -> DataFrame:
    """One row of counts over (blocked, quarantined, enriched)."""
    b = bucket(F.col("blocked"), F.col("quarantined"))
    out = rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(b == "blocked").alias("blocked"), F.count_if(b == "quarantined").alias("quarantined"), F.count_if((b == "workable") & ~F.col("enriched")).alias("remaining"), F.count_if(b == "workable").alias("enrichable"))
    return out.withColumn("pct", fraction(F.col("enrichable") - F.col("remaining"), F.col("enrichable")))


def sliding_rate(events: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """Per minute over the last `seconds` (1 place), mean duration (2 places) and total."""
    recent = F.col("ts") > as_of - F.make_interval(secs=F.lit(seconds))
    return events.agg(F.round(F.count_if(recent) / (seconds / 60), 1).alias("per_minute"), F.round(F.avg("duration"), 2).alias("mean_duration"), F.count(F.lit(1)).alias("total"))


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.avg(value).alias("mean"))


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row over keys in both: share of equal categories, mean and mean absolute difference of scores."""
    j = a.select(key, F.col("category").alias("c1"), F.col("score").alias("s1")).join(b.select(key, F.col("category").alias("c2"), F.col("score").alias("s2")), key)
    both = F.col("c1").isNotNull() & F.col("c2").isNotNull()
    return j.agg(F.avg(F.when(both, (F.col("c1") == F.col("c2")).cast("double"))).alias("agreement"), F.avg(F.col("s2") - F.col("s1")).alias("mean_delta"), F.avg(F.abs(F.col("s2") - F.col("s1"))).alias("mean_abs_delta"))


def retrieval(ranks: DataFrame) -> DataFrame:
    """Top-1 share and mean reciprocal rank of (query, rank): the rank of each query's first relevant answer."""
    return ranks.agg(F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.avg(1 / F.col("rank")).alias("mrr"))


def progress(counts: DataFrame, fields: list[str], today: Column, active: Column, remaining: Column, per_day: Column) -> DataFrame:
    """(signal, enriched, total, fraction) of the row of `signal_counts`, beside what is left and when it will be done.

    Rate, days and date are null unless a run is active and the rate is above 0.
    """
    left = F.greatest(remaining, F.lit(0))
    rate = F.when(active & (per_day > 0) & (per_day < float("inf")), per_day)
    days = left / rate
    signals = F.explode(F.array(*[F.struct(F.lit(f).alias("signal"), F.greatest(F.coalesce(F.col(f), F.lit(0)), F.lit(0)).alias("enriched")) for f in fields]))
    out = counts.withColumn("s", signals).select("s.signal", "s.enriched", F.greatest("total", F.lit(0)).alias("total"))
    done = F.when(F.ceil(days) <= 1_000_000, F.date_add(today, F.ceil(days).cast("int")))
    return out.withColumns({"fraction": fraction(F.col("enriched"), F.col("total")), "remaining": left, "per_day": F.round(rate, 1), "eta_days": F.round(days, 2), "done_on": done})


def backlog(rows: DataFrame, title: str = "title", description: str = "description", embedding: str = "embedding", active: str = "active") -> DataFrame:
    """One row: active rows, those with text, those with an embedding, and those with text that lack one."""
    words = (F.trim(F.coalesce(F.col(title), F.lit(""))) != "") | (F.trim(F.coalesce(F.col(description), F.lit(""))) != "")
    has = F.col(embedding).isNotNull()
    n = lambda c: F.count_if(c)
    return rows.where(F.col(active)).agg(F.count(F.lit(1)).alias("active"), n(words).alias("with_text"), n(has).alias("embedded"), n(words & ~has).alias("missing"))


def probe_order(rows: DataFrame, before: Column, limit: int) -> DataFrame:
    """Active listings with an address that weren't seen since `before`, longest unseen first, those never seen before all."""
    due = F.col("active") & (F.trim("url") != "") & (F.col("last_seen").isNull() | (F.col("last_seen") < before))
    return rows.where(due).orderBy(F.asc_nulls_first("last_seen"), "id").limit(limit)


def feasibility(latencies: DataFrame, rows: int, concurrency: int, requests_per_row: int, daily_requests: int) -> DataFrame:
    """One row of the stages' p50 seconds: hours of work, requests, days that the requests need."""
    total = latencies.agg(F.sum("p50").alias("per_row_s"))
    return total.select("per_row_s", (F.lit(rows) * F.col("per_row_s") / max(1, concurrency) / 3600).alias("hours"), F.lit(rows * requests_per_row).alias("requests"), F.ceil(F.lit(rows * requests_per_row) / daily_requests).alias("days"))
