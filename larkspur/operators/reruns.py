"""What is to be enriched again, what is missing, and how far enrichment is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.gates import rerun_action

MODES = ("missing", "force", "stale_before")
STAGES = ("all", "visual+sentiment", "verdict_only")


def _field(meta: Column, name: str) -> Column:
    """A field of JSON text as a variant; JSON null is a value, a missing field or text that is no object gives null."""
    return F.try_variant_get(F.try_parse_json(meta), f"$.{name}", "variant")


def lacks(meta: Column, name: str) -> Column:
    return _field(meta, name).isNull()


def missing_score(score: Column) -> Column:
    """Neither a row, nor null, nor 0 counts as enriched."""
    return F.coalesce(score, F.lit(0)) == 0


def enriched_at(meta: Column) -> Column:
    """The moment in a row's `enriched_at`; UTC where it names no zone; null for what is no ISO moment."""
    text = F.trim(F.try_variant_get(F.try_parse_json(meta), "$.enriched_at", "string"))
    text = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    return F.when(text.rlike(r"^\d{4}-"), F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp"))


def stale(meta: Column, before: Column) -> Column:
    """Enriched before `before`, or nobody knows when."""
    return F.coalesce(enriched_at(meta) < before, F.lit(True))


def prior_stages(meta: Column) -> Column:
    """Whether visual and sentiment results are there, as objects that aren't empty."""
    one = lambda k: F.coalesce(F.schema_of_variant(_field(meta, k)).startswith("OBJECT") & (F.schema_of_variant(_field(meta, k)) != "OBJECT<>"), F.lit(False))
    return one("visual") & one("sentiment")


def photo_count(urls: Column) -> Column:
    """Non-blank entries of a JSON array's text; 0 for null and for other JSON."""
    whole = F.startswith(F.trim(urls), F.lit("["))
    return F.when(whole, F.coalesce(F.size(F.filter(F.from_json(urls, "array<string>"), lambda u: F.coalesce(F.trim(u) != "", F.lit(False)))), F.lit(0))).otherwise(F.lit(0))


def candidates(properties: DataFrame, metrics: DataFrame, mode: str, before: Column | None = None, areas: DataFrame | None = None, platform: str | None = None, area_ids: list | None = None, city: str | None = None, active_only: bool = True) -> DataFrame:
    """properties (id, active, platform, area_id, image_urls: JSON) with their metrics (property_id, ai_score, meta: JSON) that fit the filters and the mode.

    A property without metrics stays, with nulls; `city` keeps those of areas (area_id, city) of that very name.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "stale_before" and before is None:
        raise ValueError("stale_before needs a moment")
    p = properties.where("active") if active_only else properties
    if platform:
        p = p.where(F.col("platform") == platform)
    if area_ids:
        p = p.where(F.col("area_id").isin(area_ids))
    if city:
        p = p.join(areas.where(F.col("city") == city).select("area_id"), "area_id", "left_semi")
    m = metrics.select(F.col("property_id").alias("id"), "ai_score", "meta")
    rows = p.join(m, "id", "left")
    return {"missing": rows.where(missing_score(F.col("ai_score"))), "force": rows, "stale_before": rows.where(stale(F.col("meta"), before) if before is not None else F.lit(True))}[mode]


def classified(rows: DataFrame, stages: str, needed: int) -> DataFrame:
    """Adds action: queue, skip_images, skip_photos (fewer than `needed`) or, of verdicts alone, skip_prior."""
    if stages not in STAGES:
        raise ValueError(f"unknown stages: {stages}")
    verdict = F.lit(stages == "verdict_only")
    n = photo_count(F.col("image_urls"))
    images = F.coalesce(F.size(F.from_json("image_urls", "array<string>")), F.lit(0))
    return rows.withColumn("action", rerun_action(F.lit(False), "force", F.lit(True), images, stages != "verdict_only", verdict | (n >= needed), ~verdict | prior_stages(F.col("meta"))))


def queued(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows to queue, of least id first; `limit` bounds these alone, however many are skipped before them."""
    out = rows.where("action = 'queue'")
    return out if limit is None else out.orderBy("id").limit(limit)


def without_verdict(properties: DataFrame, metrics: DataFrame) -> DataFrame:
    """Active properties with metrics that hold no deal_verdict; one of JSON null counts as there."""
    m = metrics.where(lacks(F.col("meta"), "deal_verdict")).select(F.col("property_id").alias("id"), "meta")
    return properties.where("active").join(m, "id")


def with_sentiment(properties: DataFrame, metrics: DataFrame, area_id: object = None) -> DataFrame:
    """(area_id, meta) of properties in an area (in `area_id`, if given) whose metrics hold a sentiment, JSON null included."""
    p = properties.where(F.col("area_id").isNotNull() if area_id is None else F.col("area_id") == area_id)
    m = metrics.where(~lacks(F.col("meta"), "sentiment")).select(F.col("property_id").alias("id"), "meta")
    return p.join(m, "id").select("area_id", "meta")


def without_description(properties: DataFrame, listings: DataFrame, platforms: list[str], limit: int | None = None) -> DataFrame:
    """(id, platform, url) of active properties with a blank description, by their active listing with a URL that was seen last (ties: least URL)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    p = properties.where(F.col("active") & blank(F.col("description")) & F.col("platform").isin(platforms)).select("id", "platform")
    # the greatest of (seen, url turned round) isn't to be had, so the least of (never seen, seconds ago, url)
    seen = F.struct(F.col("last_seen").isNull(), -F.unix_micros("last_seen"), F.col("url"))
    u = listings.where(F.col("active") & ~blank(F.col("url"))).groupBy(F.col("property_id").alias("id")).agg(F.min_by("url", seen).alias("url"))
    out = p.join(u, "id").select("id", "platform", "url")
    return out if limit is None else out.orderBy("id").limit(limit)


def remaining(properties: DataFrame, metrics: DataFrame, needed: int) -> DataFrame:
    """One row: remaining, the active properties without a score that have `needed` photos."""
    rows = candidates(properties, metrics, "missing")
    return rows.agg(F.count_if(photo_count(F.col("image_urls")) >= needed).alias("remaining"))


def observed_per_day(metrics: DataFrame, as_of: Column) -> DataFrame:
    """One row: per_day, 24 times what was enriched later than an hour before `as_of`; null where nothing was."""
    recent = F.count_if(F.coalesce(enriched_at(F.col("meta")) > as_of - F.expr("interval 60 minutes"), F.lit(False)))
    return metrics.agg(F.nullif(recent, F.lit(0)).alias("n")).select((F.col("n") * 24.0).alias("per_day"))


def health(properties: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: total properties and how many metrics have a score above 0."""
    scored = metrics.agg(F.count_if(F.col("ai_score") > 0).alias("enriched"))
    return properties.agg(F.count(F.lit(1)).alias("total")).crossJoin(scored)  # one row each


def backfill_order(rows: DataFrame) -> DataFrame:
    """Of least first_seen first, those that were never dated before all; ties by id."""
    return rows.orderBy(F.asc_nulls_first("first_seen"), "id")


def ai_score(visual: Column, text: Column) -> Column:
    return 0.7 * visual + 0.3 * text


def history_minutes(snapshots: DataFrame, minutes: int, as_of: Column) -> DataFrame:
    """Snapshots of the last `minutes` (1 to 10,080, else the nearer end), oldest first."""
    n = max(1, min(10_080, minutes))
    return snapshots.where((F.col("ts") >= as_of - F.make_interval(mins=F.lit(n))) & (F.col("ts") <= as_of)).orderBy("ts")


def area_detail(areas: DataFrame, properties: DataFrame) -> DataFrame:
    """Each area (area_id, ...) with property_count, its active properties; 0 for none."""
    n = properties.groupBy("area_id").agg(F.count_if(F.coalesce(F.col("active"), F.lit(False))).alias("n"))
    return areas.join(n, "area_id", "left").withColumn("property_count", F.coalesce("n", F.lit(0))).drop("n")


def images_once(images: DataFrame) -> DataFrame:
    """(sha256, id, n): each content (binary or text) once, by the least id that has it; null content drops."""
    return images.where("content IS NOT NULL").groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
