"""Continuous forms of the jobs: windows, debounce, first-event windows and price history, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators import history


def tumbling(events: DataFrame, seconds: int = 30, late: str = "1 minute", by: str = "event_type") -> DataFrame:
    """Counts and sums by window, of streams and tables alike."""
    w = F.window("ts", f"{seconds} seconds")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_ts"), by, "n", "total")


def sliding(events: DataFrame, seconds: int = 300, step: int = 30, late: str = "1 minute") -> DataFrame:
    """Events a minute in the last `seconds`, every `step`."""
    w = F.window("ts", f"{seconds} seconds", f"{step} seconds")
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").alias("end_ts"), (F.col("n") / (seconds / 60)).alias("per_minute"))


def debounced(alerts: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(property_id, ts) of alerts that are sent: at most one of a property in `seconds`. Each micro-batch is put in order by time.

    A property's last alert is forgotten once the watermark, `late` behind, is `seconds` past it: whatever comes then is sent anyway.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        sent = []
        for t in sorted(t for b in batches for t in b["us"]):
            if last is None or t - last >= seconds * 1_000_000:
                sent.append(t)
                last = t
        _keep_until(state, (int(last),), int(last) // 1000 + seconds * 1000)
        yield pd.DataFrame({"property_id": [key[0]] * len(sent), "us": pd.Series(sent, dtype="int64")})

    rows = alerts.withWatermark("ts", late).select("property_id", "ts", F.unix_micros("ts").alias("us"))
    out = rows.groupBy("property_id").applyInPandasWithState(step, "property_id long, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("property_id", F.timestamp_micros("us").alias("ts"))


def _keep_until(state: GroupState, value: tuple, ms: int) -> None:
    """Holds `value` until the watermark reaches `ms`; not at all if it has."""
    if ms > state.getCurrentWatermarkMs():
        state.update(value)
        state.setTimeoutTimestamp(ms)
    elif state.exists:
        state.remove()


def first_event_windows(events: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """(key, opened, used): windows that the first event opens and that end `hours` later; one row each time one has grown. A window is forgotten when the watermark is past its end."""
    span = hours * 3_600_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = []
        for t, n in sorted((t, n) for b in batches for t, n in zip(b["us"], b["amount"], strict=True)):
            if opened is None or t >= opened + span:
                if opened is not None:
                    rows.append((key[0], opened, used))
                opened, used = int(t), 0
            used += int(n)
        rows.append((key[0], opened, used))
        _keep_until(state, (opened, used), (opened + span) // 1000)
        yield pd.DataFrame(rows, columns=["key", "us", "used"]).astype({"us": "int64", "used": "int64"})

    rows = events.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "amount")
    out = rows.groupBy("key").applyInPandasWithState(step, "key long, us long, used long", "opened long, used long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("key", F.timestamp_micros("us").alias("opened"), "used")


def merged_windows(ads: DataFrame, hours: int = 48, late: str = "10 minutes") -> DataFrame:
    """(id, rent_price, sale_price) each time an ad's other side arrives: first with the side that came first, once more with both. An ad without id passes as it is.

    ads: id, listing_type, price, ts. Of rows of one id in a micro-batch the earliest of each side counts; a side that is known stays, and so does an ad
    whose new row is of neither side, or has no price above 0. An ad is forgotten `hours` after its last news.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rent, sale = state.get[:2] if state.exists else (None, None)
        seen, rows = state.exists, []
        all_rows = [r for b in batches for r in zip(b["us"], b["listing_type"], b["price"], strict=True)]
        for _, kind, price in sorted(all_rows, key=lambda r: (r[0], str(r[1]), r[2])):
            good = kind in ("rent", "sale") and price > 0
            if not seen or (good and (rent if kind == "rent" else sale) is None):
                rent, sale = (price, sale) if good and kind == "rent" else (rent, price) if good else (rent, sale)
                rows.append((key[0], rent, sale))
                seen = True
        _keep_until(state, (rent, sale), int(max(r[0] for r in all_rows)) // 1000 + hours * 3_600_000)
        yield pd.DataFrame(rows, columns=["id", "rent_price", "sale_price"]).astype({"rent_price": "float64", "sale_price": "float64"})

    rows = ads.withWatermark("ts", late).select("id", "ts", F.unix_micros("ts").alias("us"), "listing_type", "price")
    kinds = "id string, rent_price double, sale_price double"
    known = rows.where("id IS NOT NULL").groupBy("id").applyInPandasWithState(step, kinds, "rent double, sale double", "append", GroupStateTimeout.EventTimeTimeout)
    side = lambda k: F.when((F.col("listing_type") == k) & (F.col("price") > 0), F.col("price")).alias(f"{k}_price")
    return known.unionByName(rows.where("id IS NULL").select("id", side("rent"), side("sale")))


HISTORY = "property_id string, listing_type string, platform string, property_listing_id string, price double, start_ts timestamp"
#: Buckets that the open intervals are dealt to by key.
BUCKETS = 64


def _open(spark: SparkSession, folder: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The open interval of each key: of all versions (below one) the last."""
    try:
        rows = spark.read.schema(f"{HISTORY}, bucket int, version int").option("basePath", f"{folder}/open").parquet(f"{folder}/open")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HISTORY)
    if below is not None:
        rows = rows.where(F.col("version") < below)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))  # partitions: others aren't read
    last = rows.groupBy(*history.KEY).agg(F.max_by(F.struct("price", "start_ts"), "version").alias("x"))
    return last.select(*history.KEY, "x.price", "x.start_ts")


def price_table(spark: SparkSession, folder: str) -> DataFrame:
    """All price intervals that `price_history` keeps in `folder`; open ones have no end_ts."""
    live = _open(spark, folder).withColumn("end_ts", F.lit(None).cast("timestamp"))
    try:
        closed = spark.read.schema(f"{HISTORY}, end_ts timestamp, batch int").option("basePath", f"{folder}/closed").parquet(f"{folder}/closed").drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return live
    return closed.unionByName(live)


def price_history(prices: DataFrame, folder: str, checkpoint: str, compact: int = 20):
    """Keeps price intervals in `folder` (`price_table` reads them). A micro-batch reads the buckets of its keys, and writes these keys' intervals alone.

    closed/batch=n holds the intervals that batch n has ended, open/version=2n what is open since then. Every `compact` batches the open versions become one,
    open/version=2n-1, and the older ones go. A repeated batch reads what was there before it and replaces its own files; an empty one writes nothing. Prices of
    a batch are put in order by time; one that is older than its key's open interval is left out.
    """
    bucket = F.pmod(F.xxhash64(*history.KEY), F.lit(BUCKETS)).cast("int")

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        rows = rows.where("price IS NOT NULL AND ts IS NOT NULL").select(*history.KEY, "price", "ts").persist()
        try:
            buckets = [r.bucket for r in rows.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
            if not buckets:
                return
            if n and n % compact == 0:
                _open(spark, folder, 2 * n - 1).withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/open/version={2 * n - 1}")
                _drop_below(spark, f"{folder}/open", 2 * n - 1)
            keys = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in history.KEY]
            named = rows.select(*[F.col(k).alias(f"of_{k}") for k in history.KEY]).distinct()
            live = _open(spark, folder, 2 * n, buckets).join(named, keys, "left_semi").select(*history.KEY, "price", F.col("start_ts").alias("ts"))
            was = live.select(*[F.col(k).alias(f"of_{k}") for k in history.KEY], F.col("ts").alias("since"))
            later = rows.join(was, keys, "left").where("since IS NULL OR ts > since").select(*history.KEY, "price", "ts")
            after = history.intervals(live.unionByName(later)).drop("old_price").persist()
            after.where("end_ts IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/closed/batch={n}")
            after.where("end_ts IS NULL").drop("end_ts").withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/open/version={2 * n}")
            after.unpersist()
        finally:
            rows.unpersist()

    return prices.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def _drop_below(spark: SparkSession, folder: str, version: int) -> None:
    """Deletes the versions that a compacted one has replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("version=") and int(name.split("=")[1]) < version:
            fs.delete(entry.getPath(), True)
