"""Spatial joins on a grid: equi joins on cells, then the exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from popweave.functions.geo import edge_score, is_inside, plane_distance, ring_edges, rings_edges
from popweave.operators.hot import spread_join
from popweave.operators.ranks import first_per_group, top_k
from popweave.session import cut

LEVELS = 40
#: Rows of one task in a search of neighbours; each may meet hundreds of cells and targets there.
AT_ONCE = 4000
#: The finest grid of targets has 2 ** FINEST cells in a row.
FINEST = 22


def _cell(value, level, cell: float):
    return F.floor(value / (F.lit(float(cell)) * F.pow(F.lit(2.0), level))).cast("long")


def polygon_edges(polygons: DataFrame, poly_id: str, ring: str) -> DataFrame:
    """Edges of all rings of an id (id, ax, ay, bx, by).  ``ring`` holds a ring or
    an array of rings; an id may have several rows."""
    nested = isinstance(polygons.schema[ring].dataType.elementType, ArrayType)
    edges = rings_edges(F.col(ring)) if nested else ring_edges(F.col(ring))
    return polygons.filter(F.col(poly_id).isNotNull()).select(poly_id, F.explode(edges).alias("_e")).select(poly_id, "_e.*")


def polygon_boxes(edges: DataFrame, poly_id: str, cell: float) -> DataFrame:
    """Box, grid level and height bands of each polygon.

    The level is the one where the box covers at most 2 x 2 cells.  There are so
    many bands that an edge lies in two of them on average.
    """
    boxes = edges.groupBy(poly_id).agg(
        *[f(F.least(f"a{c}", f"b{c}") if n == "min" else F.greatest(f"a{c}", f"b{c}")).alias(f"_{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"],
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs(F.col("ay") - F.col("by"))).alias("_rise"))
    tall = F.col("_max_y") - F.col("_min_y")
    extent = F.greatest(F.col("_max_x") - F.col("_min_x"), tall)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(float(cell))) / F.lit(float(cell)))))
    bands = F.when(F.col("_rise") > 0, F.greatest(F.lit(1), F.floor(F.col("_n") * tall / F.col("_rise")))).otherwise(1)
    return boxes.withColumns({"_level": F.least(level, F.lit(LEVELS)).cast("int"), "_bands": bands.cast("long")}).drop("_n", "_rise")


def _band(y: Column) -> Column:
    """The height band of a place in its polygon's box; it never falls as y grows."""
    tall = F.col("_max_y") - F.col("_min_y")
    return F.when(tall > 0, F.least(F.col("_bands") - 1, F.floor((y - F.col("_min_y")) * F.col("_bands") / tall))).otherwise(0).cast("long")


def point_in_polygon(points: DataFrame, pk: str, x: str, y: str, polygons: DataFrame, poly_id: str, ring: str,
                     cell: float, carry: tuple = (), multi: str = "first") -> DataFrame:
    """Points with the polygon that holds them (border counts as inside).

    ``ring`` is a ring or an array of rings: a point in an odd number of them is
    inside, so holes and several parts need nothing else.  On overlap the smallest
    polygon id wins, or all are kept with ``multi='all'``.  Points outside every
    polygon, and points without a place, keep nulls.  A point meets the polygons
    in whose box it lies, and of those only the edges in its height band.
    """
    edges = cut(polygon_edges(polygons, poly_id, ring), "edges")
    boxes = cut(polygon_boxes(edges, poly_id, cell), "boxes")
    span = lambda axis: F.sequence(_cell(F.col(f"_min_{axis}"), F.col("_level"), cell), _cell(F.col(f"_max_{axis}"), F.col("_level"), cell))
    cells = boxes.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    levels = boxes.agg(F.collect_set("_level")).scalar()  # at most LEVELS + 1 values
    located = points.select(pk, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_level", F.explode(levels))
    located = located.withColumns({"_cx": _cell(F.col(x), F.col("_level"), cell), "_cy": _cell(F.col(y), F.col("_level"), cell)})
    in_box = F.col(x).between(F.col("_min_x"), F.col("_max_x")) & F.col(y).between(F.col("_min_y"), F.col("_max_y"))
    near = spread_join(located, cells, ["_level", "_cx", "_cy"]).filter(in_box).select(pk, poly_id, x, y, _band(F.col(y)).alias("_band"))
    banded = edges.join(boxes, poly_id).withColumn("_band", F.explode(F.sequence(_band(F.least("ay", "by")), _band(F.greatest("ay", "by")))))
    sides = banded.select(poly_id, "_band", F.struct("ax", "ay", "bx", "by").alias("_e"))
    met = spread_join(cut(near, "near"), sides, [poly_id, "_band"])
    # Summed in the task that made the pairs, then by point and polygon.
    scored = met.groupBy(pk, poly_id).agg(F.sum(edge_score(F.col("_e"), F.col(x), F.col(y))).alias("_score"))
    hits = scored.filter(is_inside(F.col("_score"))).drop("_score")
    if multi != "all":
        hits = hits.groupBy(pk).agg(F.min(poly_id).alias(poly_id))
    if carry:
        hits = spread_join(cut(hits, "inside"), polygons.select(poly_id, *carry).dropDuplicates([poly_id]), [poly_id])
    # Stored once, so that several layers in a row do not repeat each other.
    return points.join(cut(hits, "hits"), pk, "left")


def nearest(a: DataFrame, a_pk: str, b: DataFrame, b_pk: str, k: int = 1, cutoff: float | None = None,
            within: tuple = (), xy=("x", "y"), b_xy=("bx", "by")) -> DataFrame:
    """The k nearest rows of ``b`` for each row of ``a``, with distance and number.

    ``cutoff`` is the largest allowed distance.  ``within`` names columns that
    must be equal on both sides.  Rows of either side without a place have no
    neighbours.  The targets lie in a hierarchy of grids whose
    cells know how many they hold and in which box.  Every row goes from coarse
    to fine cells and keeps those that may hold one of its k nearest: cells no
    farther than the greatest distance within which k targets are certain.  Only
    the targets of the last cells are opened, few per row wherever it lies.
    """
    within = list(within)
    x, y, bx, by = F.col(xy[0]), F.col(xy[1]), F.col(b_xy[0]), F.col(b_xy[1])
    placed = b.select(*within, b_pk, *b_xy).filter(bx.isNotNull() & by.isNotNull())
    # At one location only the k smallest ids can ever be among the k nearest.
    targets = cut(top_k(placed, [*within, *b_xy], [F.col(b_pk)], k, "_at").drop("_at"), "targets")
    lo_x, hi_x, lo_y, hi_y = targets.agg(F.min(bx), F.max(bx), F.min(by), F.max(by)).first()
    side = max(hi_x - lo_x, hi_y - lo_y, 1e-9) if lo_x is not None else 1.0
    at = lambda v, low: F.least(F.floor((v - F.lit(low or 0.0)) / F.lit(side) * 2**FINEST), F.lit(2**FINEST - 1)).cast("long")
    targets = targets.withColumns({"_fx": at(bx, lo_x), "_fy": at(by, lo_y)})
    last = _last_level(targets, within, k)
    up = lambda c, level: F.shiftright(c, FINEST - level)
    box = {"_x0": F.min(bx), "_x1": F.max(bx), "_y0": F.min(by), "_y1": F.max(by)}
    finest = cut(targets.groupBy(*within, "_fx", "_fy").agg(F.count(F.lit(1)).alias("_n"), *[f.alias(n) for n, f in box.items()]), "cells")

    def cells(level: int, above: int) -> DataFrame:
        own = finest.withColumns({"_cx": up(F.col("_fx"), level), "_cy": up(F.col("_fy"), level)})
        merged = own.groupBy(*within, "_cx", "_cy").agg(F.sum("_n").alias("_n"), F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"),
                                                        F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"))
        return merged.withColumns({"_px": F.shiftright("_cx", level - above), "_py": F.shiftright("_cy", level - above)})

    zero = F.lit(0).cast("long")
    front = a.select(*within, a_pk, *xy).filter(x.isNotNull() & y.isNotNull())
    # Rows become many where they meet cells, so tasks follow their number, not the bytes that are shuffled.
    front = front.repartition(max(1, math.ceil(front.count() / AT_ONCE)), a_pk).withColumns({"_px": zero, "_py": zero})
    near_by = F.hypot(F.greatest(F.col("_x0") - x, x - F.col("_x1"), F.lit(0.0)), F.greatest(F.col("_y0") - y, y - F.col("_y1"), F.lit(0.0)))
    far_off = F.hypot(F.greatest(x - F.col("_x0"), F.col("_x1") - x), F.greatest(y - F.col("_y0"), F.col("_y1") - y))
    certain = W.partitionBy(a_pk).orderBy("_far").rangeBetween(W.unboundedPreceding, W.currentRow)
    slack = 1 + 1e-9
    levels = [0, *range(2 - last % 2, last + 1, 2)] if last else [0]
    for above, level in zip([0, *levels], levels):
        met = front.join(cells(level, above), [*within, "_px", "_py"]).withColumns({"_near": near_by, "_far": far_off})
        if cutoff is not None:
            met = met.filter(F.col("_near") <= cutoff)
        if level:
            met = met.withColumn("_sure", F.when(F.sum("_n").over(certain) >= k, F.col("_far")))
            met = met.withColumn("_reach", F.min("_sure").over(W.partitionBy(a_pk)))
            met = met.filter(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") * slack))
        front = met.select(*within, a_pk, *xy, F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
    located = targets.withColumns({"_px": up(F.col("_fx"), levels[-1]), "_py": up(F.col("_fy"), levels[-1])}).drop("_fx", "_fy")
    found = front.join(located, [*within, "_px", "_py"]).withColumn("distance", plane_distance(x, y, bx, by))
    if cutoff is not None:
        found = found.filter(F.col("distance") <= cutoff)
    return top_k(found.select(a_pk, b_pk, "distance"), [a_pk], [F.col("distance"), F.col(b_pk)], k, "neighbor")


def _last_level(targets: DataFrame, within: list, k: int) -> int:
    """The coarsest level at which no cell holds more than a few times k targets."""
    cells = targets.groupBy(*within, "_fx", "_fy").count().withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(FINEST))))
    up = lambda c: F.expr(f"shiftright({c}, {FINEST} - _l)")
    busy = (cells.groupBy(*within, "_l", up("_fx").alias("_cx"), up("_fy").alias("_cy")).agg(F.sum("count").alias("n"))
            .groupBy("_l").agg(F.max("n").alias("most")).filter(F.col("most") <= 16 * k).agg(F.min("_l")).first()[0])
    return FINEST if busy is None else busy


def outlier_cutoff(df: DataFrame, distance: str = "distance") -> DataFrame:
    """Keep rows within mean + 3 standard deviations of the distance."""
    bound = df.agg(F.avg(distance) + 3 * F.stddev_samp(distance)).scalar()
    return df.filter(F.col(distance) <= bound)


def bounding_box(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
