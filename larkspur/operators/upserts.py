"""Changes to tables, as functions from an old version and a delta to a new version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: list[str], same: Column, insert: bool = True) -> DataFrame:
    """A full join on `key` with `action`: inserted, updated, unchanged, kept, or skipped where nothing is inserted.

    Columns of `new` but the key are prefixed with n_; `same` compares them with the old ones.
    """
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in key], F.lit(True).alias("in_new"))
    j = old.withColumn("in_old", F.lit(True)).join(n, key, "full")
    missing = "inserted" if insert else "skipped"
    return j.withColumn("action", F.when(F.col("in_old").isNull(), missing).when(F.col("in_new").isNull(), "kept").when(same, "unchanged").otherwise("updated"))


def applied(changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    take = F.col("action").isin("inserted", "updated")
    return changes.where("action <> 'skipped'").select(*key, *[F.when(take, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def last_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of `parts`, of each key the row of the last part that has it."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("part_nth", F.lit(i)) for i, p in enumerate(parts)])
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*key, "part_nth")]), "part_nth").alias("r")).select(*key, "r.*")


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` of keys that `old` lacks, each key once, added."""
    return old.unionByName(new.dropDuplicates(key).join(old, key, "left_anti").select(*old.columns))


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def retained(rows: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Without rows older than `days`; 0 or less keeps all."""
    return rows if days <= 0 else rows.where(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))


def rekeyed(listings: DataFrame, new_type: Column, order: str) -> DataFrame:
    """Listings with their type inferred anew: of equal new keys the one that had it stays; a sale costs its base price."""
    n = listings.withColumn("new_type", new_type)
    w = Window.partitionBy("platform", "platform_listing_id", "new_type").orderBy((F.col("listing_type") != F.col("new_type")).cast("int"), order)
    n = n.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    price = F.when((F.col("new_type") == "sale") & (F.col("listing_type") != "sale"), F.coalesce("base_price", "price")).otherwise(F.col("price"))
    return n.withColumns({"price": price, "listing_type": F.col("new_type")}).drop("new_type", "rank")


def moved(children: DataFrame, merges: DataFrame, column: str = "property_id") -> DataFrame:
    """Children of merged parents (orphan -> keeper) under their keepers."""
    return children.join(merges, F.col(column) == F.col("orphan"), "left").withColumn(column, F.coalesce("keeper", column)).drop("orphan", "keeper")


def still_active(listings: DataFrame) -> DataFrame:
    """(property_id, active): whether any listing of it is."""
    return listings.groupBy("property_id").agg((F.count_if("active") > 0).alias("active"))
