"""Geometry as plain columns: points are struct<x,y>, a ring is array<struct<x,y>>.

A polygon with holes, or of several parts, is the array of all its rings: a place
is inside where it lies in an odd number of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371  # fixed value


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def parse_point(wkt: Column) -> Column:
    """``POINT (x y)`` to struct<x,y>."""
    nums = r"POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)"
    return F.when(wkt.rlike(nums), point(F.regexp_extract(wkt, nums, 1), F.regexp_extract(wkt, nums, 2)))


def parse_ring(wkt: Column) -> Column:
    """Outer ring of ``POLYGON ((x y, x y, ...))`` without the closing point."""
    body = F.regexp_extract(wkt, r"POLYGON\s*\(\(([^)]*)\)", 1)
    pairs = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(pairs, lambda p: point(p[0], p[1]))
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(wkt.rlike("^POLYGON"), F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring))


def parse_rings(wkt: Column) -> Column:
    """All rings of a ``POLYGON`` or ``MULTIPOLYGON``, holes too, each without
    its closing point; null for other texts, no ring for ``EMPTY``."""
    def ring(body: Column) -> Column:
        numbers = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
        points = F.transform(numbers, lambda p: point(p[0], p[1]))
        closed = (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
        return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)
    bodies = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.when(wkt.rlike(r"^\s*(MULTI)?POLYGON"), F.transform(bodies, ring))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def point_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def line_text(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    s = [c.cast("string") for c in (x1, y1, x2, y2)]
    return F.concat(F.lit("LINESTRING ( "), s[0], F.lit(" "), s[1], F.lit(", "), s[2], F.lit(" "), s[3], F.lit(")"))


def great_circle_km(lat1: Column, lat2: Column, lon1: Column, lon2: Column) -> Column:
    """Haversine distance in kilometres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((a2 - a1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def plane_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def ring_edges(ring: Column) -> Column:
    """Edges of a ring as array<struct<ax,ay,bx,by>>, closing the ring."""
    ends = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, ends, lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


BORDER = 1 << 20


def edge_score(e: Column, x: Column, y: Column) -> Column:
    """1 where the edge lies right of the point at its height, a large number
    where the point is on the edge.  The sum over a ring tells inside (odd, or
    at least BORDER) from outside."""
    rise = (e["bx"] - e["ax"]) * (y - e["ay"])
    run = (e["by"] - e["ay"]) * (x - e["ax"])
    on = ((rise == run) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
          & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    spans = (e["ay"] > y) != (e["by"] > y)
    left = x < F.try_divide(rise, e["by"] - e["ay"]) + e["ax"]
    return F.when(on, BORDER).when(spans & left, 1).otherwise(0)


def is_inside(score: Column) -> Column:
    return (score >= BORDER) | (score % 2 == 1)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Point in ring by crossing count; points on the border count as inside."""
    return is_inside(F.aggregate(ring_edges(ring), F.lit(0), lambda s, e: s + edge_score(e, x, y)))


def rings_edges(rings: Column) -> Column:
    """Edges of all rings."""
    return F.flatten(F.transform(rings, ring_edges))


def inside_rings(rings: Column, x: Column, y: Column) -> Column:
    """Point in a polygon of several rings; borders, also of holes, count as inside."""
    return is_inside(F.aggregate(rings_edges(rings), F.lit(0), lambda s, e: s + edge_score(e, x, y)))


def inner_point(rings: Column) -> Column:
    """A point inside a polygon: the middle of the widest inner stretch (the left
    one of equals) of a line halfway between two neighbouring corner heights, as
    near to the middle of the box as some edge reaches.  Null where the polygon
    has no height."""
    def across(edges: Column, y: Column) -> Column:
        hit = F.filter(edges, lambda e: (e["ay"] > y) != (e["by"] > y))
        xs = F.array_sort(F.transform(hit, lambda e: e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])))
        return let(xs, lambda x: let(F.array_max(F.transform(F.sequence(F.lit(1), F.size(x) - 1, F.lit(2)), lambda i: F.struct(
            (F.element_at(x, i + 1) - F.element_at(x, i)).alias("width"), (-(F.element_at(x, i + 1) + F.element_at(x, i)) / 2).alias("left")))),
            lambda best: point(-best["left"], y)))

    def nearest_edge(sloped: Column, mid: Column) -> Column:
        def reach(e):
            low, high = F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
            at = F.greatest(low, F.least(high, mid))
            return F.struct(F.abs(at - mid).alias("off"), at.alias("at"), high.alias("high"))
        return F.array_min(F.transform(sloped, reach))

    def height(edges: Column) -> Column:
        ys = F.transform(edges, lambda e: e["ay"])
        sloped = F.filter(edges, lambda e: e["ay"] != e["by"])
        return let(ys, lambda v: let(nearest_edge(sloped, (F.array_min(v) + F.array_max(v)) / 2), lambda e: F.when(
            e["at"] < e["high"], F.array_max(F.filter(v, lambda a: a <= e["at"])) + F.array_min(F.filter(v, lambda a: a > e["at"]))
        ).otherwise(F.array_max(F.filter(v, lambda a: a < e["high"])) + e["high"]) / 2))

    return let(rings_edges(rings), lambda e: let(height(e), lambda y: F.when(y.isNotNull(), across(e, y))))


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def ring_area(ring: Column) -> Column:
    """Signed area (shoelace)."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2


def ring_centroid(ring: Column) -> Column:
    """Area centroid; the vertex mean where the ring has no area."""
    edges = ring_edges(ring)
    cx = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["ax"] + e["bx"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"]))
    cy = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["ay"] + e["by"]) * (e["ax"] * e["by"] - e["bx"] * e["ay"]))
    area = ring_area(ring)
    n = F.size(ring)
    flat_x = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["x"]) / n
    flat_y = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"]) / n
    return F.when(area == 0, point(flat_x, flat_y)).otherwise(point(cx / (6 * area), cy / (6 * area)))
