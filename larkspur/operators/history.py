"""Price intervals, price-drop alerts and budgets over ordered events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.scratch import discard, written

#: Microseconds of a key's life that are put in order in one task: four days.
SPAN = 4 * 86_400_000_000
#: Requests of a key whose waits are followed in one task.
BLOCK = 50_000
KEY = ["property_id", "listing_type", "platform", "property_listing_id"]


def intervals(prices: DataFrame, key: list[str] = KEY, ts: str = "ts", price: str = "price", tie: str | None = None) -> DataFrame:
    """Observed prices -> intervals (key, price, start_ts, end_ts): a change closes one and opens the next, which stays open."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c) for c in (ts, tie) if c])
    changed = prices.where(F.col(price).isNotNull()).withColumn("was", F.lag(price).over(w)).where(F.col("was").isNull() | (F.col("was") != F.col(price)))
    return changed.withColumn("end_ts", F.lead(ts).over(w)).select(*key, F.col(price).alias("price"), F.col(ts).alias("start_ts"), "end_ts", F.col("was").alias("old_price"))


def apply_prices(history: DataFrame, now: DataFrame, as_of: Column, key: list[str] = KEY) -> DataFrame:
    """One step of the above: the new version of `history` after observing `now` (key, price) at `as_of`. Null keys match nulls."""
    new = now.select(*[F.col(k).alias(f"n_{k}") for k in key], F.col("price").alias("n_price"))
    on = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in key]
    live = history.where("end_ts IS NULL")
    joined = live.join(new, on, "full")
    kept = joined.where(F.coalesce(F.col("start_ts").isNotNull(), F.lit(False))).select(*key, "price", "start_ts", F.when(F.col("n_price") != F.col("price"), as_of).alias("end_ts"))
    opened = joined.where("n_price IS NOT NULL AND (start_ts IS NULL OR n_price <> price)").select(*[F.col(f"n_{k}").alias(k) for k in key], F.col("n_price").alias("price"), as_of.alias("start_ts"), F.lit(None).cast("timestamp").alias("end_ts"))
    return history.where("end_ts IS NOT NULL").select(*kept.columns).unionByName(kept).unionByName(opened)


def newest_first(history: DataFrame, property_id: str, **only: str | None) -> DataFrame:
    out = history.where(F.col("property_id") == property_id)
    for column, value in only.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(F.desc("start_ts"))


def drops(changes: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Alerts on price changes (property_id, old_price, price): against the price last notified, else the old one.

    A watch fires if the drop is its min_drop_pct (5) or more and the price isn't the one last notified.
    """
    c = changes.join(watchlist, "property_id")
    reference = F.coalesce(F.nullif("last_notified_price", F.lit(0.0)), F.col("old_price"))
    c = c.withColumn("reference", reference).withColumn("drop_pct", F.try_divide((F.col("reference") - F.col("price")) * 100, F.col("reference")))
    again = F.coalesce(F.abs(F.col("price") - F.col("last_notified_price")) <= 0.001, F.lit(False))
    return c.where((F.col("drop_pct") >= F.coalesce("min_drop_pct", F.lit(5.0))) & ~again)


def notified(watchlist: DataFrame, alerts: DataFrame) -> DataFrame:
    """The watchlist with each property's price of its latest alert (`drops` with a time `ts`) as last_notified_price; others keep theirs.

    Alerts of one time: the smallest price counts. A next `drops` with this list is silent about the same price.
    """
    last = alerts.groupBy("property_id").agg(F.max_by("price", F.struct("ts", -F.col("price"))).alias("told_price"))
    out = watchlist.join(last, "property_id", "left").withColumn("last_notified_price", F.coalesce("told_price", "last_notified_price"))
    return out.select(*watchlist.columns)


def watched_prices(watchlist: DataFrame, listings: DataFrame) -> DataFrame:
    """Each watch with its property's cheapest listing, active or not, of any type; watches without listings drop."""
    low = listings.groupBy("property_id").agg(F.min_by(F.struct("price", "listing_type"), F.struct(F.col("price").isNull(), "price", "listing_type")).alias("best"))
    return watchlist.join(low, "property_id").select(watchlist["*"], F.col("best.price").alias("price"), F.col("best.listing_type").alias("listing_type"))


def evaluate_watches(watchlist: DataFrame, listings: DataFrame) -> DataFrame:
    """Periodic alerts. A first pass has no price to fall from and so stays silent."""
    now = watched_prices(watchlist, listings)
    return drops(now.select("property_id", "price", F.col("price").alias("old_price")).distinct(), watchlist)


def followers(alerts: DataFrame, seconds: int, key: str) -> DataFrame:
    """alerts (key, at: microseconds; each once) with `after`: the first alert of the key `seconds` later or more, null for none.

    Alerts and the moments that they ask for are sorted together, by key and spans of some days, and the nearest alert ahead is carried along; where a span
    has none ahead, the next span's first counts. So a key's whole life is in no one task.
    """
    wait = seconds * 1_000_000
    both = alerts.select(key, F.col("at").alias("moment"), F.lit(True).alias("alert")).unionByName(alerts.select(key, (F.col("at") + wait).alias("moment"), F.lit(False).alias("alert")))
    both = both.withColumn("span", F.floor(F.col("moment") / SPAN))
    later = Window.partitionBy(key, "span").orderBy(F.desc("moment"), F.desc("alert")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("after", F.last(F.when(F.col("alert"), F.col("moment")), ignorenulls=True).over(later)).where("NOT alert")
    starts = both.groupBy(key, "span").agg(F.min(F.when(F.col("alert"), F.col("moment"))).alias("first"))
    ahead = Window.partitionBy(key).orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("next", F.last("first", ignorenulls=True).over(ahead)).select(F.col(key).alias("of_key"), F.col("span").alias("of_span"), "next")
    out = found.join(starts, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("span") == F.col("of_span")))
    return out.select(key, (F.col("moment") - wait).alias("at"), F.coalesce("after", "next").alias("after"))


def leaders(alerts: DataFrame, key: str, span: int) -> DataFrame:
    """alerts (key, at: microseconds; each once) with `before`: the key's alert before, null for none. Again by spans, of whose first the last one of an earlier span is before."""
    rows = alerts.withColumn("span", F.floor(F.col("at") / span))
    inside = rows.withColumn("before", F.lag("at").over(Window.partitionBy(key, "span").orderBy("at")))
    ends = rows.groupBy(key, "span").agg(F.max("at").alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(Window.partitionBy(key).orderBy("span"))).select(F.col(key).alias("of_key"), F.col("span").alias("of_span"), "end")
    out = inside.join(ends, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("span") == F.col("of_span")))
    return out.select(key, "at", F.coalesce("before", "end").alias("before"))


def debounced(alerts: DataFrame, seconds: int = 3600, key: str = "property_id") -> DataFrame:
    """At most one alert of a key in `seconds` after one that was sent.

    What is sent is where the first alert of each key leads to, step by step (`followers`). An alert `seconds` after the one before it is sent whatever
    came earlier, so all such are starts at once; the others are reached by steps that double in length each round.
    """
    at = alerts.where(F.col("ts").isNotNull()).select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).distinct()
    steps = written(followers(at, seconds, key), "steps")
    sent = written(leaders(steps.select(key, "at"), key, SPAN).where(F.col("before").isNull() | (F.col("at") - F.col("before") >= seconds * 1_000_000)).select(key, "at"), "sent")
    known = sent.count()
    jump = steps.where("after IS NOT NULL")
    while True:
        to = jump.select(F.col(key).alias("of_key"), F.col("at").alias("of_at"), "after")
        on = F.col(key).eqNullSafe(F.col("of_key")) & (F.col("at") == F.col("of_at"))
        more = written(sent.unionByName(sent.join(to, on).select(key, F.col("after").alias("at"))).distinct(), "sent")
        discard(sent)
        sent, was, known = more, known, more.count()
        if known == was:
            break
        twice = jump.select(key, F.col("at").alias("start"), F.col("after").alias("at")).join(to, on).select(key, F.col("start").alias("at"), "after")
        jump = written(twice, "steps")
    return sent.select(key, F.timestamp_micros("at").alias("ts"))


def rolling_sum(events: DataFrame, seconds: int, key: list[str], ts: str = "ts", amount: str = "amount") -> DataFrame:
    """Adds `used`: what the last `seconds` before and at each event took."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("used", F.sum(amount).over(w))


def tripped(outcomes: DataFrame, threshold: int, key: str = "platform", ts: str = "ts") -> DataFrame:
    """Runs of consecutive failures of one reason (null reason: success): key, reason, n, from_ts, to_ts of those that reach `threshold`."""
    w = Window.partitionBy(key).orderBy(ts)
    run = outcomes.withColumn("new", (~F.col("reason").eqNullSafe(F.lag("reason").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    out = run.where("reason IS NOT NULL").groupBy(key, "run", "reason").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"))
    return out.where(F.col("n") >= threshold).drop("run")


def quarantined(attempts: DataFrame, most: int) -> DataFrame:
    """Keys with `most` failed attempts or more since their last success."""
    ok = attempts.where("ok").groupBy("id").agg(F.max("ts").alias("last_ok"))
    bad = attempts.where("NOT ok").join(ok, "id", "left").where("last_ok IS NULL OR ts > last_ok")
    return bad.groupBy("id").agg(F.count(F.lit(1)).alias("attempts")).where(F.col("attempts") >= most)


def _carried(rows: DataFrame, key: str, order: list[str], span: str, take: str) -> DataFrame:
    """`rows` with `take` of the last row before or at each, by `order` within `key`, that has one; a key is put in order by spans (`span`), not in one task."""
    inside = Window.partitionBy(key, span).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(key, span).agg(F.max_by(take, F.when(F.col(take).isNotNull(), F.struct(*order))).alias("end"))
    before = Window.partitionBy(key).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("of_key"), F.col(span).alias("of_span"), F.last("end", ignorenulls=True).over(before).alias("end"))
    out = rows.withColumn("last", F.last(take, ignorenulls=True).over(inside)).join(ends, F.col(key).eqNullSafe(F.col("of_key")) & F.col(span).eqNullSafe(F.col("of_span")))
    return out.withColumn(take, F.coalesce("last", "end")).drop("last", "end", "of_key", "of_span")


def _numbered(requests: DataFrame, key: str) -> DataFrame:
    """Adds nth (from 1) and upto, the running sum of need, in order of at and id; sums of spans of time are added up, so a key's whole life is in no one task."""
    rows = requests.withColumn("span", F.floor(F.col("at") / SPAN))
    w = Window.partitionBy(key, "span").orderBy("at", "id")
    sums = rows.groupBy(key, "span").agg(F.count(F.lit(1)).alias("n"), F.sum("need").alias("total"))
    earlier = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("of_key"), F.col("span").alias("of_span"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("total"))
    rows = rows.withColumns({"row": F.row_number().over(w), "sum": F.sum("need").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out = rows.join(sums, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("span") == F.col("of_span")))
    return out.select(key, "id", "at", "need", (F.col("row") + F.col("n")).alias("nth"), (F.col("sum") + F.col("total")).alias("upto"))


def _inside(step: int):
    """A block of requests in a row (key, id, at, need, nth, to) -> with start, exit, steps: what pointers within the block lead to, and where they leave it, so many steps away; exit is null for nowhere."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("nth")
        first = t.column("nth")[0].as_py()
        start = t.column("at").to_numpy().copy()
        jump, steps = t.column("to").fill_null(0).to_numpy() - first, np.ones(len(start), np.int64)
        while len(i := np.flatnonzero(jump >= 0)):
            j = jump[i]
            start[i], steps[i], jump[i] = np.maximum(start[i], start[j] + step * steps[i]), steps[i] + steps[j], jump[j]
        out = jump + first
        return t.drop_columns(["to"]).append_column("start", pa.array(start)).append_column("exit", pa.array(out, mask=out < 1)).append_column("steps", pa.array(steps))

    return run


def launches(requests: DataFrame, limit: int, seconds: int = 60, key: str = "platform") -> DataFrame:
    """requests (key, id, at: microseconds, need: tokens >= 0) with wait (microseconds): first come, first served, each starts at the first moment at which
    what started less than `seconds` ago leaves room for it under `limit`; one that needs more waits until all before it has aged out.

    Of each request the prefix sums tell which earlier one must have aged out: the last whose tokens, with all from it on, are more than the limit. Starts
    are then a largest sum along these pointers, a(p) + `seconds` a step, as later requests point at later ones. Pointers are followed within blocks of BLOCK
    requests of a key at once; between blocks only those that they leave a block for are left, whose pointers double in length each round.
    Rows without a moment drop; null needs count as 0; ids must be unique in a key.
    """
    step = seconds * 1_000_000
    rows = written(_numbered(requests.where("at IS NOT NULL").select(key, "id", F.col("at").cast("long").alias("at"), F.coalesce("need", F.lit(0)).cast("long").alias("need")), key), "requests")
    # where a request's tokens begin, beside the sums that ask for the last beginning below them
    kept = lambda on: [F.col(c) if on else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "at", "need")]
    begins = rows.select(key, (F.col("upto") - F.col("need")).alias("tokens"), F.lit(1).alias("asks"), "nth", F.col("nth").cast("long").alias("to"), *kept(False))
    asks = rows.select(key, (F.col("upto") - limit).alias("tokens"), F.lit(0).alias("asks"), "nth", F.lit(None).cast("long").alias("to"), *kept(True))
    both = begins.unionByName(asks).withColumn("span", F.floor(F.col("tokens") / (1000 * limit)))
    found = _carried(both, key, ["tokens", "asks", "nth"], "span", "to").where("asks = 0")
    found = found.select(key, "id", "at", "need", F.col("nth").cast("long").alias("nth"), F.when(F.col("to").isNotNull(), F.least("to", F.col("nth") - 1)).cast("long").alias("to"), F.floor((F.col("nth") - 1) / BLOCK).alias("block"))
    kinds = StructType([f for f in found.schema if f.name != "to"]).add("start", "long").add("exit", "long").add("steps", "long")
    block = written(found.groupBy(key, "block").applyInArrow(_inside(step), kinds).drop("block"), "blocks")
    discard(rows)
    start = _reached(block, key, step)
    out = block.join(start, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("exit") == F.col("of_nth")), "left")
    return out.select(key, "id", "at", "need", (F.greatest("start", F.col("reached") + step * F.col("steps")) - F.col("at")).alias("wait"))


def _reached(block: DataFrame, key: str, step: int) -> DataFrame:
    """(of_key, of_nth, reached): the starts of the requests that pointers leave a block for."""
    ends = block.where("exit IS NOT NULL").select(F.col(key).alias("of_key"), F.col("exit").alias("of_nth")).distinct()
    on = F.col(key).eqNullSafe(F.col("of_key")) & (F.col("nth") == F.col("of_nth"))
    now = written(block.join(ends, on, "left_semi").select(key, "nth", "start", F.col("exit").alias("to"), "steps"), "starts")
    while not now.where("to IS NOT NULL").isEmpty():
        ahead = now.select(F.col(key).alias("of_key"), F.col("nth").alias("of_nth"), F.col("start").alias("reached"), F.col("to").alias("far"), F.col("steps").alias("more"))
        far = now.join(ahead, F.col(key).eqNullSafe(F.col("of_key")) & (F.col("to") == F.col("of_nth")), "left")
        nxt = written(far.select(key, "nth", F.greatest("start", F.col("reached") + step * F.col("steps")).alias("start"), F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "starts")
        discard(now)
        now = nxt
    return now.select(F.col(key).alias("of_key"), F.col("nth").alias("of_nth"), F.col("start").alias("reached"))
