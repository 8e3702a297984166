"""Pushed pages, budget waits, areas with holes and buffers, and what is to be enriched again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import geo
from larkspur.operators import history, reruns
from larkspur.sources import files, flight


def of(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expr).collect()]


def test_unescaped(spark):
    r"""Known escapes are read, of others the backslash goes, raw control characters stay."""
    got = of(spark, flight.unescaped(F.col("x")), r"a\nb\t\"q\"\\n", r"é\/\b\x", "raw\nline", "", None)
    assert got == ['a\nb\t"q"\\n', "é/bx", "raw\nline", "", None]


def ads_of(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r.ads for r in flight.with_ads(rows).orderBy("i").collect()]


def push(text):
    return '<script>self.__next_f.push([1,' + json.dumps(text, ensure_ascii=False) + "])</script>"


def test_page_ads(spark):
    ads = [{"listId": 1, "t": 'a ] } \\ "b"'}, {"advertisingId": 2}, 3, {"id": 0, "list_id": "x"}]
    text = "7:" + json.dumps({"ads": [], "inner": {"ads": ads, "z": "]"}})
    cut = [push(text[:i]) + "<p>" + push(text[i:]) for i in range(0, len(text), 3)]
    state = lambda props: f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"pageProps": props}})}</script>'
    pages = [*cut, state({"initialState": {"search": {"ads": ads}}}), state({"state": {"data": {"ads": ads}}}), state({"initialState": {}, "listings": ads}), state({"initialState": {"ads": []}}) + push(text)]
    want = [ads[0], ads[3]]
    got = ads_of(spark, *pages)
    assert [[json.loads(a) for a in g] for g in got] == [want] * len(pages)
    assert ads_of(spark, "", None, push('"ads":[{"id":1}'), push("x") * 50, state({"ads": 5})) == [[]] * 5


def test_long_page(spark):
    """A page of megabytes is read whole."""
    text = json.dumps({"pad": "x\\" * 400_000, "ads": [{"id": 5, "d": "y" * 1_000_000}]})
    got = ads_of(spark, push(text[:700_000]) + push(text[700_000:]))
    assert [json.loads(a)["id"] for a in got[0]] == [5]


def test_band_and_pages(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 50.0), (1, 0.0), (2, 50.0), (2, None), (3, None)], "k int, p double")
    assert dict(rows.groupBy("k").agg(flight.band_holds(F.col("p"), 1, 10)).collect()) == {1: True, 2: False, 3: False}
    got = of(spark, flight.pages_read(F.from_json("x", "array<int>"), 3), "[10,12,10]", "[10,12,9]", "[10,0,10]", "[10,10]", "[]", "[11,10,10,10]", "[3,10]")
    assert [tuple(g) for g in got] == [(3, 32, True), (3, 31, False), (1, 10, False), (2, 20, False), (0, 0, False), (3, 31, True), (1, 3, False)]


def in_turn(requests, limit, seconds):
    """Waits by letting one request in after the other."""
    open_, start, out = [], None, []
    for at, need in requests:
        now = at if start is None else max(at, start)
        while True:
            used = sum(n for t, n in open_ if t > now - seconds)
            if used + need <= limit or not any(t > now - seconds for t, n in open_):
                break
            now = min(t for t, n in open_ if t > now - seconds) + seconds
        start = now
        open_.append((now, need))
        out.append(now - at)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_launches(spark, seed, monkeypatch):
    """Against one at a time: bursts, ties, requests above the limit and of nothing, a null key, spans shorter than a burst."""
    r = random.Random(seed)
    monkeypatch.setattr(history, "SPAN", r.choice([7, 40, history.SPAN]))
    rows, want = [], {}
    for key in ("a", "b", None):
        at = sorted(r.choice([r.randrange(3000), r.randrange(200)]) for _ in range(r.randrange(1, 120)))
        need = [r.choice([0, 1, 2, 3, 5, 12]) for _ in at]
        for i, w in enumerate(in_turn([(x * 1_000_000, n) for x, n in zip(at, need, strict=True)], 10, 60_000_000)):
            rows.append((key, i, at[i] * 1_000_000, need[i]))
            want[key, i] = w
    r.shuffle(rows)
    df = spark.createDataFrame([*rows, ("c", 1, None, 1), ("d", 1, 5, None)], "platform string, id long, at long, need int")
    assert {(x.platform, x.id): x.wait for x in history.launches(df, 10).collect()} == want | {("d", 1): 0}
    assert history.launches(df.limit(0), 10).count() == 0


POINT = "struct<lon:double,lat:double>"


def areas(spark, *rings):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in ring] if ring is not None else None) for i, ring in enumerate(rings)], f"id int, ring array<{POINT}>")


def test_validity(spark):
    """Square, closed square, bow-tie, spike, touching corner, two corners, none, null, a repeated position, a ring folded onto its own edge, a long simple one."""
    saw = [(i, i % 2) for i in range(301)] + [(300, -5), (0, -5)]
    crossed = [*saw[:150], (20.5, -9), *saw[150:]]
    rings = [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0, 0), (1, 1), (1, 0), (0, 1)], [(0, 0), (2, 0), (1, 0), (1, 1)], [(0, 0), (2, 0), (1, 1), (1, 0), (0, 2)], [(0, 0), (1, 1)], [], None, [(0, 0), (0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (2, 0)], saw, crossed]
    got = {x.id: x.valid for x in geo.with_validity(areas(spark, *rings)).collect()}
    assert [got[i] for i in range(len(rings))] == [True, True, False, False, False, False, False, False, True, False, True, False]


def test_buffers_and_holes(spark, tmp_path):
    """Against the distance to each edge, on random points; holes are read from the file, their edges belong to the area."""
    outer, hole = [(0.0, 0.0), (0.04, 0.0), (0.04, 0.04), (0.02, 0.01), (0.0, 0.04)], [(0.005, 0.004), (0.01, 0.004), (0.01, 0.008), (0.005, 0.008)]
    geometry = {"type": "Polygon", "coordinates": [[*map(list, outer), list(outer[0])], [*map(list, hole), list(hole[0])]]}
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": geometry}]}))
    area = files.features(spark, str(tmp_path / "x.geojson")).select(F.lit(1).alias("id"), "ring", "holes")
    r = random.Random(3)
    pts = [(i, r.uniform(-0.01, 0.05), r.uniform(-0.01, 0.05)) for i in range(800)] + [(800, 0.005, 0.006), (801, 0.0075, 0.006), (802, 0.0, 0.0)]
    points = spark.createDataFrame(pts, "k int, lon double, lat double")

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    def away(ring, x, y):
        def to(a, b):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
            return ((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2) ** 0.5

        return min(to(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))

    for metres in (0.0, 150.0):
        reach = metres / 111_320
        want = {k for k, x, y in pts if (inside(outer, x, y) and not inside(hole, x, y)) or min(away(outer, x, y), away(hole, x, y)) <= max(reach, 1e-12)}
        assert {x.k for x in geo.points_near_areas(points, area, metres, step=0.01).collect()} == want


def test_reruns(spark):
    """Moments with zones, without and none; JSON null is there; stages; a limit on what is queued alone."""
    metas = ['{"enriched_at":"2024-01-01T02:00:00+02:00"}', '{"enriched_at":"2024-01-01"}', '{"enriched_at":"2024-01-01T00:00:01Z"}', '{"enriched_at":5}', '{"enriched_at":"2024"}', "[1]", "no", None]
    at = of(spark, F.unix_seconds(reruns.enriched_at(F.col("x"))), *metas)
    assert at == [1704067200, 1704067200, 1704067201, *[None] * 5]
    assert of(spark, reruns.lacks(F.col("x"), "v"), '{"v":null}', '{"v":1}', "{}", "[]", None) == [False, False, True, True, True]
    assert of(spark, reruns.prior_stages(F.col("x")), '{"visual":{"a":1},"sentiment":{"b":2}}', '{"visual":{},"sentiment":{"b":2}}', '{"visual":{"a":1}}', None) == [True, False, False, False]
    assert of(spark, reruns.photo_count(F.col("x")), '["a"," ",null,"b"]', "{}", "[]", None, "x") == [2, 0, 0, 0, 0]
    p = spark.createDataFrame([(i, i != 4, "p", 1, '["a"]' if i % 2 else "[]") for i in range(9)], "id long, active boolean, platform string, area_id int, image_urls string")
    m = spark.createDataFrame([(1, 0.0, None), (3, 0.5, None)], "property_id long, ai_score double, meta string")
    rows = reruns.classified(reruns.candidates(p, m, "missing"), "all", 1)
    assert {x.id: x.action for x in rows.collect()} == {0: "skip_images", 1: "queue", 2: "skip_images", 5: "queue", 6: "skip_images", 7: "queue", 8: "skip_images"}
    assert [x.id for x in reruns.queued(rows, 2).collect()] == [1, 5]
    for bad in (lambda: reruns.candidates(p, m, "all"), lambda: reruns.candidates(p, m, "stale_before"), lambda: reruns.classified(rows, "none", 1)):
        with pytest.raises(ValueError):
            bad()


def test_small_selections(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id int, first_seen int")
    assert [x.id for x in reruns.backfill_order(rows).collect()] == [2, 3, 1]
    snaps = spark.range(0, 120).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    assert reruns.history_minutes(snaps, 0, F.timestamp_seconds(F.lit(600))).count() == 2
    assert reruns.history_minutes(snaps, 10**9, F.timestamp_seconds(F.lit(600))).count() == 11
    assert spark.range(1).select(reruns.ai_score(F.lit(0.5), F.lit(1.0))).first()[0] == pytest.approx(0.65)


def test_small_rings_are_settled_in_their_row_like_large_ones(spark):
    import random

    from larkspur.functions import geo

    rng = random.Random(3)
    at = lambda: {"lon": float(rng.randint(0, 5)), "lat": float(rng.randint(0, 5))}
    rings = [[at() for _ in range(rng.randint(0, 7))] for _ in range(400)] + [None, [{"lon": None, "lat": 1.0}] * 4]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "id long, ring array<struct<lon:double,lat:double>>")
    out = geo.with_validity(rows)
    got, want = ({r.id: r.valid for r in x.collect()} for x in (out, geo._validity_by_cells(rows, "id")))
    assert got == want and set(got.values()) == {True, False}
    assert out.columns == ["id", "ring", "valid"] and out.where("ring IS NULL").count() == 1
    # no join gathers edges on the driver, whatever the optimizer takes their size for
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
