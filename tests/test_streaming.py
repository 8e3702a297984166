"""Streams over files, in several micro-batches, give what the batch forms give."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larkspur.operators import history
from larkspur.streaming import jobs

T0 = datetime(2024, 1, 1)


def stream(spark, folder, frames, schema):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_tumbling(spark, tmp_path):
    rows = [(T0 + timedelta(seconds=s), "a", 1.0) for s in (0, 10, 29, 30, 61)]
    df = stream(spark, tmp_path / "in", [rows[:3], rows[3:], [(T0 + timedelta(hours=1), "a", 0.0)]], "ts timestamp, event_type string, value double")
    got = sorted((r.start_ts, r.n) for r in drain(jobs.tumbling(df), tmp_path, "tumbling") if r.start_ts < T0 + timedelta(minutes=30))
    assert got == [(T0, 3), (T0 + timedelta(seconds=30), 1), (T0 + timedelta(seconds=60), 1)]


def test_debounced(spark, tmp_path):
    rows = [(k, T0 + timedelta(minutes=m)) for m in (0, 30, 59, 60, 100, 121) for k in (1, 2)]
    df = stream(spark, tmp_path / "in", [rows[:5], rows[5:]], "property_id long, ts timestamp")
    got = sorted(map(tuple, drain(jobs.debounced(df), tmp_path, "debounced")))
    want = sorted((r.property_id, r.ts) for r in history.debounced(spark.createDataFrame(rows, "property_id long, ts timestamp")).collect())
    assert got == want


def test_first_event_windows(spark, tmp_path):
    rows = [(1, T0 + timedelta(hours=h), 2) for h in (5, 20, 28, 29, 60)]
    df = stream(spark, tmp_path / "in", [rows[:2], rows[2:]], "key long, ts timestamp, amount long")
    last = {}
    for r in drain(jobs.first_event_windows(df), tmp_path, "first_event"):
        last[r.opened] = max(r.used, last.get(r.opened, 0))
    assert last == {T0 + timedelta(hours=5): 6, T0 + timedelta(hours=29): 2, T0 + timedelta(hours=60): 2}


def test_state_leaves(spark, tmp_path):
    """After a day of other keys nothing of the first ones is held."""
    frames = [[(k, T0) for k in range(20)], [(100, T0 + timedelta(days=1))], [(101, T0 + timedelta(days=2))], [(101, T0 + timedelta(days=2, minutes=1))]]
    df = stream(spark, tmp_path / "in", frames, "property_id long, ts timestamp")
    q = jobs.debounced(df).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[0] == 20 and held[-1] <= 2


PRICES = "property_id string, listing_type string, platform string, property_listing_id string, price double, ts timestamp"


def observed(key, price, hours):
    return (key, "rent", "x", None if key == "none" else "1", price, T0 + timedelta(hours=hours))


def run_history(spark, folder, df, compact=20):
    q = jobs.price_history(df, str(folder / "out"), str(folder / "cp"), compact).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return sorted((r.property_id, r.price, r.start_ts, r.end_ts) for r in jobs.price_table(spark, str(folder / "out")).collect())


def test_price_history(spark, tmp_path):
    frames = [
        [observed("p", 10.0, 0), observed("q", 5.0, 0), observed("none", 1.0, 0)],
        [observed("p", 10.0, 24), observed("q", 6.0, 30), observed("q", 7.0, 26)],
        [observed("p", None, 40)],
        [observed("p", 9.0, 48), observed("q", 1.0, 2)],
        [observed("none", 2.0, 50)],
    ]
    for compact in (20, 2):
        folder = tmp_path / str(compact)
        folder.mkdir()
        got = run_history(spark, folder, stream(spark, folder / "in", frames, PRICES), compact)
        rows = [r for r in sum(frames, []) if r[4] is not None and r[4] != 1.0 or r[0] == "none"]  # without the late one
        batch = history.intervals(spark.createDataFrame(rows, PRICES))
        assert got == sorted((r.property_id, r.price, r.start_ts, r.end_ts) for r in batch.collect())
        written = sorted(x.name for x in (folder / "out/open").iterdir() if x.name.startswith("version"))
        assert written == (["version=0", "version=2", "version=6", "version=8"] if compact == 20 else ["version=7", "version=8"])
        assert len(list((folder / "out/open/version=8").glob("bucket=*"))) == 1  # its one key's


def test_price_history_again(spark, tmp_path):
    """A batch that runs again, as after a failure, changes nothing; neither does an empty one."""
    frames = [[observed("p", 10.0, 0)], [observed("p", 9.0, 24)]]
    got = run_history(spark, tmp_path, stream(spark, tmp_path / "in", frames, PRICES))
    for commit in (tmp_path / "cp/commits").glob("*1*"):
        commit.unlink()
    assert run_history(spark, tmp_path, stream(spark, tmp_path / "in", frames, PRICES)) == got and len(got) == 2
    assert jobs.price_table(spark, str(tmp_path / "nowhere")).count() == 0


def test_second_side_is_told_again(spark, tmp_path):
    """Both orders of the sides, over batches and within one; repeats and strange types are silent."""
    at = lambda m: T0 + timedelta(minutes=m)
    frames = [
        [("a", "rent", 10.0, at(0)), ("b", "sale", 500.0, at(0)), ("c", "sale", 7.0, at(2)), ("c", "rent", 1.0, at(1)), (None, "rent", 3.0, at(0)), ("d", "other", 9.0, at(0))],
        [("a", "sale", 900.0, at(3)), ("a", "rent", 11.0, at(3)), ("b", "sale", 501.0, at(3)), (None, "rent", 3.0, at(3)), ("d", "rent", None, at(3))],
        [("b", "rent", 5.0, at(4)), ("a", "rent", 12.0, at(4)), ("d", "rent", 2.0, at(4))],
    ]
    df = stream(spark, tmp_path / "in", frames, "id string, listing_type string, price double, ts timestamp")
    got = [tuple(None if x is None or x != x else x for x in r) for r in drain(jobs.merged_windows(df), tmp_path, "merged")]
    want = [("a", 10.0, None), ("a", 10.0, 900.0), ("b", None, 500.0), ("b", 5.0, 500.0), ("c", 1.0, None), ("c", 1.0, 7.0), ("d", None, None), ("d", 2.0, None)]
    assert sorted(got, key=str) == sorted([*want, (None, 3.0, None), (None, 3.0, None)], key=str)
