"""Geography on longitude and latitude columns; rings are arrays of (lon, lat)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.columns import settled
from larkspur.scratch import dealt

RADIUS_M = 6_371_000.0
#: Metres in a degree of latitude, rounded down, so that a cell is never too small.
DEGREE_M = 111_000.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Within: points on the border are outside."""
    return (lon > west) & (lon < east) & (lat > south) & (lat < north)


def _edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ring)), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == F.size(ring), 1).otherwise(i + 1)).alias("b")))


def covers(ring: Column, lon: Column, lat: Column) -> Column:
    """Ray casting; points on an edge are inside."""
    edges = F.when(F.size(ring) >= 3, _edges(ring))
    cross = lambda e: (e.b.lon - e.a.lon) * (lat - e.a.lat) - (e.b.lat - e.a.lat) * (lon - e.a.lon)
    on = F.exists(edges, lambda e: (F.abs(cross(e)) < 1e-12) & lon.between(F.least(e.a.lon, e.b.lon), F.greatest(e.a.lon, e.b.lon)) & lat.between(F.least(e.a.lat, e.b.lat), F.greatest(e.a.lat, e.b.lat)))
    hits = F.size(F.filter(edges, lambda e: ((e.a.lat > lat) != (e.b.lat > lat)) & (lon < (e.b.lon - e.a.lon) * (lat - e.a.lat) / F.nullif(e.b.lat - e.a.lat, F.lit(0.0)) + e.a.lon)))
    return F.coalesce(on | (hits % 2 == 1), F.lit(False))


def on_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies on an edge."""
    cross = lambda e: (e.b.lon - e.a.lon) * (lat - e.a.lat) - (e.b.lat - e.a.lat) * (lon - e.a.lon)
    beside = lambda e: lon.between(F.least(e.a.lon, e.b.lon), F.greatest(e.a.lon, e.b.lon)) & lat.between(F.least(e.a.lat, e.b.lat), F.greatest(e.a.lat, e.b.lat))
    return F.coalesce(F.exists(F.when(F.size(ring) >= 2, _edges(ring)), lambda e: (F.abs(cross(e)) < 1e-12) & beside(e)), F.lit(False))


def covers_outside_holes(ring: Column, holes: Column, lon: Column, lat: Column) -> Column:
    """`covers`, but not strictly inside one of `holes` (array of rings; null for none); points on a hole's edge are inside."""
    out = F.exists(holes, lambda h: covers(h, lon, lat) & ~on_ring(h, lon, lat))
    return covers(ring, lon, lat) & ~F.coalesce(out, F.lit(False))


def edge_distance(ring: Column, lon: Column, lat: Column) -> Column:
    """Least distance from a point to a ring's edges, on the plane of degrees; null for rings without edges."""

    def to(e: Column) -> Column:
        dx, dy = e.b.lon - e.a.lon, e.b.lat - e.a.lat
        along = F.coalesce(((lon - e.a.lon) * dx + (lat - e.a.lat) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(lon - e.a.lon - t * dx, lat - e.a.lat - t * dy)

    return F.array_min(F.transform(F.when(F.size(ring) >= 1, _edges(ring)), to))


def centroid(ring: Column) -> Column:
    """(lon, lat) by the shoelace rule; the mean of the corners where the area is 0."""
    edges = _edges(ring)
    part = lambda e: e.a.lon * e.b.lat - e.b.lon * e.a.lat
    total = lambda f: F.aggregate(edges, F.lit(0.0), lambda s, e: s + f(e))
    area = total(part)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ring)
    axis = lambda k: F.when(F.abs(area) < 1e-15, mean(k)).otherwise(total(lambda e: (e.a[k] + e.b[k]) * part(e)) / (3 * F.nullif(area, F.lit(0.0))))
    return F.struct(axis("lon").alias("lon"), axis("lat").alias("lat"))


def with_box(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds west, south, east, north."""
    lon, lat = F.transform(ring, lambda p: p.lon), F.transform(ring, lambda p: p.lat)
    return areas.withColumns({"west": F.array_min(lon), "south": F.array_min(lat), "east": F.array_max(lon), "north": F.array_max(lat)})


def cell(x: Column, step: float) -> Column:
    return F.floor(x / step).cast("long")


def cells_of_box(step: float) -> Column:
    """Every grid cell that the box of `with_box` touches, as (cx, cy)."""
    xs, ys = F.sequence(cell(F.col("west"), step), cell(F.col("east"), step)), F.sequence(cell(F.col("south"), step), cell(F.col("north"), step))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _bands(lat: Column, radius_m: float, step: float) -> Column:
    """Cells of longitude in the band of `lat`, `step` degrees high: each at least as wide as `radius_m` is there, one near a pole."""
    reach = math.sin(radius_m / RADIUS_M / 2)
    farthest = F.least(F.lit(90.0), F.greatest(F.abs(lat), F.abs(lat + 1)) * step + step)
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), reach / F.greatest(F.cos(F.radians(farthest)), F.lit(1e-12)))))
    return F.greatest(F.lit(1), F.floor(360 / width)).cast("long")


def near_places(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of positions (lon, lat) and (r_lon, r_lat) at most `radius_m` apart, with distance_m; a position of many rows counts once.

    An equi-join on grid cells: each position of `left` looks into its cell and the eight around it. Bands of latitude
    have as many cells of longitude as fit, so that pairs near a pole or across the date line are found too.
    """
    step = radius_m / DEGREE_M
    band = lambda lat: cell(lat, step)
    nth = lambda lon, n: F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("long"), n - 1)
    near = []
    for cy in (band(F.col("lat")) + k for k in (-1, 0, 1)):
        n = _bands(cy, radius_m, step)
        beside = F.array_distinct(F.array(*[F.pmod(nth(F.col("lon"), n) + i, n) for i in (-1, 0, 1)]))
        near.append(F.transform(beside, lambda cx: F.struct(cx.alias("cx"), cy.alias("cy"))))  # noqa: B023  called at once
    a = left.select("lon", "lat").distinct().withColumn("cell", F.explode(F.flatten(F.array(*near)))).select("*", "cell.cx", "cell.cy").drop("cell")
    cy = band(F.col("r_lat"))
    b = right.select("r_lon", "r_lat").distinct().withColumns({"cx": nth(F.col("r_lon"), _bands(cy, radius_m, step)), "cy": cy})
    pairs = a.join(b, ["cx", "cy"]).withColumn("distance_m", haversine_m(F.col("lon"), F.col("lat"), F.col("r_lon"), F.col("r_lat")))
    return pairs.where(F.col("distance_m") <= radius_m).drop("cx", "cy")


def within_radius(left: DataFrame, right: DataFrame, radius_m: float, digits: int | None = None) -> DataFrame:
    """Pairs of rows of `left` (lon, lat) and `right` (r_lon, r_lat) at most `radius_m` apart, with distance_m, rounded to `digits` if given.

    Distances are taken between positions (`near_places`), once for all rows there; rows then meet by position, so no pair is made that isn't returned.
    """
    near = near_places(left, right, radius_m)
    if digits is not None:
        near = settled(near, distance_m=F.round("distance_m", digits))  # else the optimizer may round for each pair of rows
    near = near.withColumnsRenamed({"lon": "of_lon", "lat": "of_lat", "r_lon": "to_lon", "r_lat": "to_lat"})
    asks = dealt(left.join(near, (F.col("lon") == F.col("of_lon")) & (F.col("lat") == F.col("of_lat"))).drop("of_lon", "of_lat"), "to_lon", "to_lat")
    pairs = asks.join(right, (F.col("to_lon") == F.col("r_lon")) & (F.col("to_lat") == F.col("r_lat")))
    return pairs.select(*left.columns, *right.columns, "distance_m")


def points_in_areas(points: DataFrame, areas: DataFrame, step: float = 0.05) -> DataFrame:
    """Pairs of points (lon, lat) and areas (ring) that cover them, by an equi-join on grid cells."""
    a = with_box(areas).withColumn("cell", F.explode(cells_of_box(step))).select("*", "cell.cx", "cell.cy").drop("cell")
    p = points.withColumns({"cx": cell(F.col("lon"), step), "cy": cell(F.col("lat"), step)})
    pairs = p.join(a, ["cx", "cy"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    return pairs.where(covers(F.col("ring"), F.col("lon"), F.col("lat"))).drop("cx", "cy", "west", "south", "east", "north")


#: Metres in a degree by which buffers are measured.
BUFFER_DEGREE_M = 111_320.0


def points_near_areas(points: DataFrame, areas: DataFrame, buffer_m: float, step: float = 0.05) -> DataFrame:
    """Pairs of points (lon, lat) and areas (ring, holes where there are any) that cover them or have an edge within `buffer_m`, by an equi-join on grid cells.

    Metres are read as degrees of longitude at the area's centroid, so the buffer is at least that wide on both axes. Without a buffer areas cover as they are.
    """
    holes = F.col("holes") if "holes" in areas.columns else F.lit(None).cast("array<array<struct<lon:double,lat:double>>>")
    reach = buffer_m / (BUFFER_DEGREE_M * F.greatest(F.cos(F.radians(centroid(F.col("ring")).lat)), F.lit(1e-6))) if buffer_m > 0 else F.lit(0.0)
    a = with_box(areas.withColumn("reach", F.coalesce(reach, F.lit(0.0))))
    a = a.withColumns({"west": F.col("west") - F.col("reach"), "south": F.col("south") - F.col("reach"), "east": F.col("east") + F.col("reach"), "north": F.col("north") + F.col("reach")})
    a = a.withColumn("cell", F.explode(cells_of_box(step))).select("*", "cell.cx", "cell.cy").drop("cell")
    p = points.withColumns({"cx": cell(F.col("lon"), step), "cy": cell(F.col("lat"), step)})
    pairs = p.join(a, ["cx", "cy"]).where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    lon, lat = F.col("lon"), F.col("lat")
    nearest = F.least(edge_distance(F.col("ring"), lon, lat), F.array_min(F.transform(holes, lambda h: edge_distance(h, lon, lat))))
    near = (F.col("reach") > 0) & (F.size("ring") >= 3) & F.coalesce(nearest <= F.col("reach"), F.lit(False))
    return pairs.where(covers_outside_holes(F.col("ring"), holes, lon, lat) | near).drop("cx", "cy", "reach", "west", "south", "east", "north")


#: Rings of more corners have their edges compared over a grid, by joins; fewer are settled in their row, pair by pair.
SMALL_RING = 16


def _simple(lons: pd.Series, lats: pd.Series) -> pd.Series:
    """Whether rings, no position repeated in a row, have three corners or more and no edges that share more than the corners between neighbours; each edge with all before it."""
    sizes = lons.map(len).to_numpy()
    out = sizes >= 3
    for n in np.unique(sizes[out]):
        at = np.flatnonzero(sizes == n)
        p = np.stack([np.stack(list(c.iloc[at])).astype(float).T for c in (lons, lats)], axis=1)  # corner, axis, ring
        bad = np.zeros(len(at), bool)
        side = lambda a, b, q: np.sign((b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]))
        beside = lambda a, b, q: ((np.minimum(a, b) <= q) & (q <= np.maximum(a, b))).all(axis=0)
        for i, j in itertools.combinations(range(n), 2):
            a, b, c, d = p[i], p[i + 1], p[j], p[(j + 1) % n]
            of = [side(c, d, a), side(c, d, b), side(a, b, c), side(a, b, d)]
            a_on, b_on, c_on, d_on = ((s == 0) & beside(*e, q) for s, e, q in zip(of, ((c, d), (c, d), (a, b), (a, b)), (a, b, c, d), strict=True))
            if j == i + 1:
                bad |= a_on | d_on
            elif i == 0 and j == n - 1:
                bad |= b_on | c_on
            else:
                bad |= (of[0] * of[1] < 0) & (of[2] * of[3] < 0) | a_on | b_on | c_on | d_on
        out[at] = ~bad
    return pd.Series(out)


def _kept(areas: DataFrame) -> DataFrame:
    """`areas` with the ring's positions without nulls, repeats in a row and a closing one."""
    ring = F.filter(F.col("ring"), lambda p: p.lon.isNotNull() & p.lat.isNotNull())
    once = F.filter(F.transform(ring, lambda p, i: F.when((i == 0) | (p != F.get(ring, i - 1)), p)), lambda p: p.isNotNull())
    kept = settled(areas, ring=once)
    return settled(kept, ring=F.when((F.size("ring") > 1) & (F.get("ring", F.lit(0)) == F.element_at("ring", -1)), F.slice("ring", F.lit(1), F.size("ring") - 1)).otherwise(F.col("ring")))


def with_validity(areas: DataFrame, key: str = "id") -> DataFrame:
    """Adds valid: whether the ring is simple, with three corners or more, an area, and edges that share nothing but the corners between neighbours.

    Repeated positions in a row count once and a closing one is optional; null rings aren't valid. Rings of up to `SMALL_RING` positions are settled in their row, without
    a shuffle. Edges of larger ones meet by an equi-join on the cells of a grid over their own ring's box, as many as it has edges, so such a ring is neither held in one
    row's expression nor compared edge by edge. `key` must be unique.
    """
    large = F.coalesce(F.size("ring") > SMALL_RING, F.lit(False))
    few = areas.where(~large)
    few = _kept(few.select("*", F.col("ring").alias("_given")))
    axis = lambda k: F.coalesce(F.transform("ring", lambda p: p[k].cast("double")), F.array().cast("array<double>"))
    few = few.withColumn("valid", F.pandas_udf(_simple, "boolean")(axis("lon"), axis("lat")))
    few = few.select(*[F.col("_given").alias("ring") if c == "ring" else F.col(f"`{c}`") for c in areas.columns], "valid")
    return few.unionByName(_validity_by_cells(areas.where(large), key))


def _validity_by_cells(areas: DataFrame, key: str) -> DataFrame:
    """`with_validity` of large rings. Joins shuffle both sides: the optimizer takes the edges of many rings for few and would gather them on the driver."""
    kept = _kept(areas.select(key, "ring")).where("size(ring) >= 3")
    edges = settled(with_box(kept), edges=_edges(F.col("ring")))
    e = edges.select(key, F.size("ring").alias("n"), "west", "south", (F.col("east") - F.col("west")).alias("width"), (F.col("north") - F.col("south")).alias("height"), F.posexplode("edges").alias("i", "e"))
    cells = F.ceil(F.sqrt("n"))
    at = lambda x, low, size: F.least(F.greatest(F.coalesce(F.floor((x - F.col(low)) / F.nullif(F.col(size), F.lit(0.0)) * cells), F.lit(0)), F.lit(0)), cells - 1)
    span = lambda k, low, size: F.sequence(at(F.least(F.col(f"e.a.{k}"), F.col(f"e.b.{k}")), low, size), at(F.greatest(F.col(f"e.a.{k}"), F.col(f"e.b.{k}")), low, size))
    e = e.withColumn("gx", F.explode(span("lon", "west", "width"))).withColumn("gy", F.explode(span("lat", "south", "height"))).select(key, "n", "i", "e", "gx", "gy")
    f = e.select(F.col(key).alias("of"), F.col("i").alias("j"), F.col("e").alias("f"), F.col("gx").alias("hx"), F.col("gy").alias("hy"))
    pairs = e.hint("merge").join(f, (F.col(key) == F.col("of")) & (F.col("gx") == F.col("hx")) & (F.col("gy") == F.col("hy")) & (F.col("i") < F.col("j")))
    side = lambda e, p: F.signum((F.col(f"{e}.b.lon") - F.col(f"{e}.a.lon")) * (F.col(f"{p}.lat") - F.col(f"{e}.a.lat")) - (F.col(f"{e}.b.lat") - F.col(f"{e}.a.lat")) * (F.col(f"{p}.lon") - F.col(f"{e}.a.lon")))
    within = lambda e, p, k: F.col(f"{p}.{k}").between(F.least(f"{e}.a.{k}", f"{e}.b.{k}"), F.greatest(f"{e}.a.{k}", f"{e}.b.{k}"))
    on = lambda e, p: (side(e, p) == 0) & within(e, p, "lon") & within(e, p, "lat")
    # in steps, as one expression of all is too large for the JVM to compile
    pairs = settled(pairs.select(key, "n", "i", "j", "e", "f"), a_on=on("f", "e.a"), b_on=on("f", "e.b"), c_on=on("e", "f.a"), d_on=on("e", "f.b"))
    pairs = settled(pairs, crossed=(side("f", "e.a") * side("f", "e.b") < 0) & (side("e", "f.a") * side("e", "f.b") < 0))
    meet = F.when(F.col("j") == F.col("i") + 1, F.expr("a_on OR d_on")).when((F.col("i") == 0) & (F.col("j") == F.col("n") - 1), F.expr("b_on OR c_on"))
    bad = pairs.where(meet.otherwise(F.expr("crossed OR a_on OR b_on OR c_on OR d_on"))).select(F.col(key).alias("bad")).distinct()
    whole = kept.select(F.col(key).alias("whole"))
    out = areas.join(bad.hint("merge"), F.col(key) == F.col("bad"), "left").join(whole.hint("merge"), F.col(key) == F.col("whole"), "left")
    return out.select(areas["*"], (F.col("bad").isNull() & F.col("whole").isNotNull()).alias("valid"))


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: edges that cross or touch, or one that lies in the other; false for null rings."""
    side = lambda e, p: F.signum((e.b.lon - e.a.lon) * (p.lat - e.a.lat) - (e.b.lat - e.a.lat) * (p.lon - e.a.lon))
    beside = lambda e, p: p.lon.between(F.least(e.a.lon, e.b.lon), F.greatest(e.a.lon, e.b.lon)) & p.lat.between(F.least(e.a.lat, e.b.lat), F.greatest(e.a.lat, e.b.lat))
    on = lambda e, p: (side(e, p) == 0) & beside(e, p)
    cross = lambda e, f: (side(f, e.a) * side(f, e.b) < 0) & (side(e, f.a) * side(e, f.b) < 0)
    touch = lambda e, f: on(f, e.a) | on(f, e.b) | on(e, f.a) | on(e, f.b)
    edges = F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: cross(e, f) | touch(e, f)))
    real = (F.size(a) >= 3) & (F.size(b) >= 3)
    return F.coalesce(real & (edges | covers(a, b[0].lon, b[0].lat) | covers(b, a[0].lon, a[0].lat)), F.lit(False))


def areas_meeting(left: DataFrame, right: DataFrame, step: float = 0.05) -> DataFrame:
    """Pairs of areas (ring) and (r_ring) that share a point, each once: of the grid cells that both boxes touch only the first counts."""
    sides = ["west", "south", "east", "north"]
    cells = lambda rows: rows.withColumn("cell", F.explode(cells_of_box(step))).select("*", "cell.cx", "cell.cy").drop("cell")
    a = cells(with_box(left))
    b = cells(with_box(right, "r_ring")).withColumnsRenamed({x: f"r_{x}" for x in sides})
    pairs = a.join(b, ["cx", "cy"])
    first = (F.col("cx") == cell(F.greatest("west", "r_west"), step)) & (F.col("cy") == cell(F.greatest("south", "r_south"), step))
    boxes = (F.col("west") <= F.col("r_east")) & (F.col("r_west") <= F.col("east")) & (F.col("south") <= F.col("r_north")) & (F.col("r_south") <= F.col("north"))
    return pairs.where(first & boxes).where(rings_meet(F.col("ring"), F.col("r_ring"))).drop("cx", "cy", *sides, *[f"r_{x}" for x in sides])


def point_on_surface(ring: Column) -> Column:
    """(lon, lat) inside: the middle of the widest part of a line at half height; null where no line has width."""
    lats = F.transform(ring, lambda p: p.lat)
    y = (F.array_min(lats) + F.array_max(lats)) / 2
    at = F.array_sort(F.transform(F.filter(_edges(ring), lambda e: (e.a.lat > y) != (e.b.lat > y)), lambda e: e.a.lon + (e.b.lon - e.a.lon) * (y - e.a.lat) / (e.b.lat - e.a.lat)))
    parts = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(at), F.lit(1))), lambda i: (i % 2 == 1) & (i < F.size(at))), lambda i: F.struct((F.get(at, i) - F.get(at, i - 1)).alias("width"), ((F.get(at, i) + F.get(at, i - 1)) / 2).alias("lon")))
    widest = F.array_max(parts)
    return F.when(widest.width > 0, F.struct(widest.lon.alias("lon"), y.alias("lat")))
