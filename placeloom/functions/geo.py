"""Geometry on coordinates as column expressions: distances, cells, curves, segments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.operators.proximity import EARTH_M, distance_m, is_point  # noqa: F401

ROW_E7 = 90_000  # a row of map cells is 0.009 degrees high
EQUATOR_COLUMNS = 360.0 / 0.009
DEGREE_M = math.radians(1) * EARTH_M


def planar_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, degree_m: float = DEGREE_M) -> Column:
    """Equirectangular distance at the mean latitude."""
    dx = (lon_b - lon_a) * F.cos(F.radians((lat_a + lat_b) / 2))
    return F.hypot(dx, lat_b - lat_a) * degree_m


def e7(degrees: Column) -> Column:
    return F.round(degrees * 10_000_000).cast("long")


def cell_row(lat_e7: Column) -> Column:
    return F.floor((lat_e7 + 900_000_000) / ROW_E7).cast("long")


def cell_columns(row: Column) -> Column:
    """Columns of a row, as many as keep its cells about a kilometre wide."""
    mid = (row + 0.5) * ROW_E7 / 1e7 - 90.0
    return F.greatest(F.floor(F.cos(F.radians(mid)) * EQUATOR_COLUMNS).cast("long"), F.lit(1))


def cell_column(row: Column, lon_e7: Column) -> Column:
    n = cell_columns(row)
    return F.least(F.floor((lon_e7 + 1_800_000_000) * n / 3_600_000_000).cast("long"), n - 1)


def ring(row: Column, column: Column) -> Column:
    """(row, column) of a cell and its neighbours, those of other rows by where the cell's edges fall."""
    def of_row(r):
        n, own = cell_columns(r), cell_columns(row)
        first = F.floor((column - 1) * n / own).cast("long")
        last = F.floor((column + 2) * n / own).cast("long")
        return F.transform(F.sequence(first, last), lambda c: F.struct(r.alias("row"), F.pmod(c, n).alias("column")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(row - 1, row + 1), of_row)))


def hilbert_key(lon_e7: Column, lat_e7: Column, bits: int = 31) -> Column:
    """Place along a Hilbert curve over the globe, latitude stretched to twice its width."""
    x0 = F.shiftright(lon_e7 + 1_800_000_000, 32 - bits).cast("long")
    y0 = F.shiftright((lat_e7 + 900_000_000) * 2, 32 - bits).cast("long")
    start = F.struct(x0.alias("x"), y0.alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s, level):
        side = F.expr(f"cast(1 as bigint)") * F.pow(F.lit(2.0), (bits - 1 - level)).cast("long")
        rx = F.when(s["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        ry = F.when(s["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        d = s["d"] * 4 + F.when(rx == 1, 3 - ry).otherwise(ry)
        flip = (ry == 0) & (rx == 1)
        x = F.when(flip, side * 2 - 1 - s["x"].bitwiseAND(side * 2 - 1)).otherwise(s["x"])
        y = F.when(flip, side * 2 - 1 - s["y"].bitwiseAND(side * 2 - 1)).otherwise(s["y"])
        return F.struct(F.when(ry == 0, y).otherwise(x).cast("long").alias("x"), F.when(ry == 0, x).otherwise(y).cast("long").alias("y"), d.cast("long").alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step)["d"]


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed alphabet of the format


def geohash(lat: Column, lon: Column, chars: int) -> Column:
    """Geohash of up to six characters, from whole numbers of cells: no loop."""
    bits = chars * 5
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * 2**nx), F.lit(2**nx - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * 2**ny), F.lit(2**ny - 1)).cast("long")

    def char(k):
        value = F.lit(0).cast("long")
        for j in range(5):
            bit = 5 * k + j
            source, shift = (x, nx - 1 - bit // 2) if bit % 2 == 0 else (y, ny - 1 - bit // 2)
            value = value * 2 + F.shiftright(source, shift).bitwiseAND(F.lit(1))
        return F.substring(F.lit(_BASE32), value.cast("int") + 1, F.lit(1))

    return F.concat(*[char(k) for k in range(chars)])


def wrap(degrees: Column) -> Column:
    """A longitude, or a difference of two, brought to -180 .. 180."""
    return degrees - 360 * F.round(degrees / 360)


def extent(lon: Column) -> tuple[Column, Column, Column]:
    """Aggregates ``(west, east, mean)`` of longitudes.

    Where the span over the date line is the narrower one, east lies beyond 180 and so may the mean.
    """
    over = F.when(lon < 0, lon + 360).otherwise(lon)
    crosses = (F.min(lon) < 0) & (F.max(lon) >= 0) & (F.max(over) - F.min(over) < F.max(lon) - F.min(lon))
    pick = lambda a, b: F.when(crosses, a).otherwise(b)
    return pick(F.min(over), F.min(lon)), pick(F.max(over), F.max(lon)), pick(F.avg(over), F.avg(lon))


def box_rings(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Rings of a box for ``points_in_regions``; one that crosses the date line, e over 180 or w under -180, gives two."""
    corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = lambda x0, x1: F.array(corner(x0, s), corner(x1, s), corner(x1, n), corner(x0, n), corner(x0, s))
    first, last = F.lit(-180.0), F.lit(180.001)  # containment leaves out the eastern edge
    return (
        F.when(e - w >= 360, F.array(ring(first, last)))
        .when(e > 180, F.array(ring(w, last), ring(first, e - 360)))
        .when(w < -180, F.array(ring(w + 360, last), ring(first, e)))
        .otherwise(F.array(ring(w, e)))
    )


def project_to_segment(lon: Column, lat: Column, lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """``struct(t, lon, lat, metres)`` of the nearest place on a segment, in a plane centred on the point."""
    kx = F.cos(F.radians(lat)) * DEGREE_M
    ax, ay = wrap(lon_a - lon) * kx, (lat_a - lat) * DEGREE_M
    dx, dy = wrap(lon_b - lon_a) * kx, (lat_b - lat_a) * DEGREE_M
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return F.struct(t.alias("t"), wrap(lon_a + wrap(lon_b - lon_a) * t).alias("lon"), (lat_a + (lat_b - lat_a) * t).alias("lat"), F.hypot(ax + dx * t, ay + dy * t).alias("metres"))


def degree_window(lat: Column, radius_m: float) -> Column:
    """Half sizes in degrees of a box that holds all within a radius."""
    dlat = radius_m / DEGREE_M
    return F.struct((F.lit(dlat) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))).alias("lon"), F.lit(dlat).alias("lat"))


def box_lower_bound_m(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """A distance no place of the box is nearer than, with 1 % slack; across the date line too."""
    gap = lambda a: F.least(F.abs(a), 360 - F.abs(a))
    dlon = F.when((lon >= west) & (lon <= east), 0.0).otherwise(F.least(gap(lon - west), gap(lon - east)))
    dlat = F.greatest(south - lat, lat - north, F.lit(0.0))
    steepest = F.greatest(F.abs(lat), F.abs(south), F.abs(north))
    return 0.99 * F.hypot(dlon * F.cos(F.radians(steepest)), dlat) * DEGREE_M


def unit_vector(lon: Column, lat: Column) -> Column:
    """A point as a unit vector."""
    a, b = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(b) * F.cos(a)).alias("x"), (F.cos(b) * F.sin(a)).alias("y"), F.sin(b).alias("z"))


def number_at(start: Column, end: Column, step: Column, fraction: Column) -> Column:
    """House number of a range at a fraction of its line, rounded to the step and kept inside."""
    n = start + F.round((end - start) * fraction / step).cast("long") * step
    return F.greatest(F.least(start, end), F.least(F.greatest(start, end), n))


def fraction_of(start: Column, end: Column, step: Column, number: Column) -> Column:
    """Where in a range a number lies; null off step or outside."""
    inside = number.between(F.least(start, end), F.greatest(start, end)) & ((number - start) % step == 0)
    return F.when(inside, F.when(start == end, 0.5).otherwise((number - start) / (end - start)))
