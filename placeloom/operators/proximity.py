"""Points near other points, and points in regions, over a grid of cells.

A shape (circle or polygon) is covered by cells. Cells wholly inside it accept their
points by the equi-join alone; only points of cells on the border are measured. The
grid has rows of equal height and, in each row, as many equal columns as make its
cells about square, so that it serves any latitude, the poles and the date line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.runtime import Scratch

EARTH_M = 6_371_008.8
_SHIFT = 1 << 24  # columns of a row at most: cells of 3 m and more


def distance_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    dlat = F.sin(F.radians(lat_b - lat_a) / 2)
    dlon = F.sin(F.radians(lon_b - lon_a) / 2)
    h = dlat * dlat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * dlon * dlon
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


def is_point(lon: Column, lat: Column) -> Column:
    """Whether coordinates are usable: present, in range and not exactly (0, 0)."""
    return F.coalesce(
        ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90) & ~((lon == 0) & (lat == 0)), F.lit(False)
    )


class Grid:
    """Cells ``side_m`` high and, but for rounding, as wide."""

    def __init__(self, side_m: float):
        if side_m < 3:
            raise ValueError("cells are 3 m at least")
        self.side_m = side_m
        self.step = math.degrees(side_m / EARTH_M)

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.step).cast("long")

    def columns(self, row: Column) -> Column:
        mid = F.radians((row + 0.5) * self.step - 90.0)
        return F.greatest(F.lit(1), F.floor(F.cos(mid) * (360.0 / self.step)).cast("long"))

    def column(self, lon: Column, columns: Column) -> Column:
        return F.pmod(F.floor((lon + 180.0) * (columns / F.lit(360.0))).cast("long"), columns)

    def key(self, row: Column, column: Column) -> Column:
        return row * _SHIFT + column

    def cell(self, lon: Column, lat: Column) -> Column:
        row = self.row(lat)
        return self.key(row, self.column(lon, self.columns(row)))

    def circle(self, df: DataFrame, radius_m: float) -> DataFrame:
        """``df`` (with ``lon``, ``lat``), a row for each cell that its circle touches: ``_cell``, ``_inside``."""
        reach = math.degrees(radius_m / EARTH_M) * (1 + 1e-9) + 1e-9
        half = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(reach))) / F.cos(F.radians("lat")))))
        polar = F.abs("lat") + reach >= 89.0
        rows = df.withColumn("_half", F.when(polar, F.lit(180.0)).otherwise(half)).withColumn(
            "_row", F.explode(F.sequence(self.row(F.greatest(F.lit(-90.0), F.col("lat") - reach)), self.row(F.least(F.lit(90.0), F.col("lat") + reach))))
        )
        rows = rows.withColumn("_n", self.columns(F.col("_row")))
        wide = F.col("_n") / F.lit(360.0)
        first = F.floor((F.col("lon") + 180.0 - F.col("_half")) * wide).cast("long")
        last = F.floor((F.col("lon") + 180.0 + F.col("_half")) * wide).cast("long")
        cells = rows.withColumn(
            "_at", F.explode(F.when(last - first >= F.col("_n"), F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).otherwise(F.sequence(first, last)))
        )
        west, south = F.col("_at") / wide - 180.0, F.col("_row") * self.step - 90.0
        east, north = (F.col("_at") + 1) / wide - 180.0, south + self.step
        near = distance_m(F.col("lon"), F.col("lat"), F.greatest(west, F.least(east, F.col("lon"))), F.greatest(south, F.least(north, F.col("lat"))))
        # the corner farthest from the centre: the far meridian at either parallel
        far_lon = F.when(F.col("lon") - west > east - F.col("lon"), west).otherwise(east)
        far = F.greatest(distance_m(F.col("lon"), F.col("lat"), far_lon, south), distance_m(F.col("lon"), F.col("lat"), far_lon, north))
        polar = F.abs("lat") + reach >= 89.0
        return (
            cells.withColumn("_inside", ~polar & (far <= radius_m * (1 - 1e-6)))
            .filter(polar | (near <= radius_m * 1.001))
            .withColumn("_cell", self.key(F.col("_row"), F.pmod("_at", F.col("_n"))))
            .drop("_half", "_row", "_n", "_at")
        )


def near_points(
    points: DataFrame, places: DataFrame, radius_m: float, point_id: str, place_id: str,
    lon: str = "lon", lat: str = "lat", with_distance: bool = False,
) -> DataFrame:
    """``(point_id, place_id[, distance_m])`` for every point and place at most ``radius_m`` apart.

    Rows whose coordinates are missing, not numbers, out of range or exactly (0, 0) pair with nothing,
    nor do rows without an id. Repeated rows of an id count once; of repeated rows that disagree every
    position counts, each pair once with its least distance. Empty tables give no pairs; other columns,
    whatever their names, are not read.

    The places are copied into the cells of their circle (about twelve with cells of 0.7 radius, of
    which the one around the centre always lies inside); the points, the larger table, move once and
    keep one row each. Never broadcast, as the copies grow with the data. A cell with very many points is one join key on the larger side: AQE splits it.
    """
    grid = Grid(max(3.0, radius_m * 0.70))

    def usable(df: DataFrame, key: str) -> DataFrame:
        df = df.select(F.col(key).alias("_id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
        return df.filter(F.col("_id").isNotNull() & is_point(F.col("lon"), F.col("lat")))

    cover = grid.circle(usable(places, place_id).distinct(), radius_m).select(
        F.col("_id").alias("_b"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "_cell", "_inside"
    )
    probe = usable(points, point_id).withColumn("_cell", grid.cell(F.col("lon"), F.col("lat"))).distinct()
    metres = distance_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    pairs = probe.join(cover.hint("merge"), "_cell").filter(F.col("_inside") | (metres <= radius_m))
    if with_distance:
        return pairs.groupBy(F.col("_id").alias(point_id), F.col("_b").alias(place_id)).agg(F.min(metres).alias("distance_m"))
    return pairs.select(F.col("_id").alias(point_id), F.col("_b").alias(place_id))


PIECE_M = 50.0
PIECES = 64  # of a segment, about: longer ones are cut into longer pieces


def near_shapes(points: DataFrame, layers: list[tuple[int, DataFrame]], radius_m: float, point_id: str) -> DataFrame:
    """``(point_id, layer, shape_id, metres, t)``: the nearest shape of the first layer that has one within a radius.

    Each layer is ``(number, shapes(shape_id, lon, lat, lon2, lat2))``; the lowest number comes first. Null ``lon2`` or ``lat2`` make a
    shape a point, measured along the great circle; others are segments, straight in degrees, measured in a plane centred on the
    point, ``t`` being the place along them. Metres are rounded to millimetres; ties go to the lower ``shape_id`` (a string).
    Unusable points answer nothing; a segment with an unusable end is left out; repeated rows count once.

    One join for all layers: a segment is cut into pieces of 50 m, eight times that for each level by which it has more than
    64 of them, and each piece stands in the cells of its circle at its level. Points move once a level in use, six at most,
    and the pairs carry all that is measured, so that neither side is looked up again.
    """
    lon, lat = F.col("lon"), F.col("lat")
    frames = []
    for number, shapes in layers:
        cols = [F.col(c).cast("double").alias(c) for c in ("lon", "lat", "lon2", "lat2")]
        one = shapes.select(F.lit(number).alias("layer"), F.col("shape_id").cast("string").alias("shape_id"), *cols)
        frames.append(one.filter(is_point(lon, lat) & (F.col("lon2").isNull() | F.col("lat2").isNull() | is_point(F.col("lon2"), F.col("lat2")))))
    shapes = frames[0]
    for f in frames[1:]:
        shapes = shapes.unionByName(f)
    line = F.col("lon2").isNotNull() & F.col("lat2").isNotNull()
    wrap = lambda d: d - 360 * F.round(d / 360)
    degree = math.radians(1) * EARTH_M
    most = F.when(line, F.hypot(wrap(F.col("lon2") - lon), F.col("lat2") - lat) * degree).otherwise(0.0)  # no shorter than the segment anywhere
    level = F.when(most > PIECE_M * PIECES, F.ceil(F.log(most / (PIECE_M * PIECES)) / math.log(8.0) - 1e-9)).otherwise(0).cast("int")
    cut = shapes.withColumn("_most", most).withColumn("_level", level)
    cut = cut.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_most") / (PIECE_M * F.pow(F.lit(8.0), "_level"))).cast("int")))
    cut = cut.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_mid", (F.col("_i") - 0.5) / F.col("_n"))
    middle_lon = F.when(line, wrap(lon + wrap(F.col("lon2") - lon) * F.col("_mid"))).otherwise(lon)
    middle_lat = F.when(line, lat + (F.col("lat2") - lat) * F.col("_mid")).otherwise(lat)
    ends = F.struct("layer", "shape_id", lon.alias("lon"), lat.alias("lat"), "lon2", "lat2").alias("_s")
    pieces = Scratch(points.sparkSession, "shapes").write(cut.select(ends, middle_lon.alias("lon"), middle_lat.alias("lat"), "_level"))
    levels = sorted(r[0] for r in pieces.select("_level").distinct().collect())  # 0 .. 5: the earth is no larger
    once = points.select(F.col(point_id).alias("_id"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    once = once.filter(F.col("_id").isNotNull() & is_point(lon, lat)).distinct()
    covers, cells = [], []
    for v in levels:
        reach = radius_m + PIECE_M * 8**v / 2 + 1
        grid = Grid(0.7 * reach)
        covers.append(grid.circle(pieces.filter(F.col("_level") == v), reach).select("_s", (F.col("_cell") * 8 + v).alias("_cell")))
        cells.append(grid.cell(lon, lat) * 8 + v)
    if not levels:
        covers, cells = [pieces.select("_s", F.lit(0).cast("long").alias("_cell"))], [F.lit(0).cast("long")]
    cover = covers[0]
    for c in covers[1:]:
        cover = cover.unionByName(c)
    met = once.withColumn("_cell", F.explode(F.array(*cells))).join(cover.distinct().hint("merge"), "_cell")
    s = F.col("_s")
    kx = F.cos(F.radians(lat)) * degree
    ax, ay = wrap(s["lon"] - lon) * kx, (s["lat"] - lat) * degree
    dx, dy = wrap(s["lon2"] - s["lon"]) * kx, (s["lat2"] - s["lat"]) * degree
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / long))).otherwise(0.0)
    met = met.withColumn("_t", t)
    metres = F.when(s["lon2"].isNull() | s["lat2"].isNull(), distance_m(lon, lat, s["lon"], s["lat"])).otherwise(F.hypot(ax + dx * F.col("_t"), ay + dy * F.col("_t")))
    near = met.withColumn("_m", F.round(metres, 3)).filter(F.col("_m") <= radius_m)
    best = near.groupBy("_id").agg(F.min(F.struct(s["layer"].alias("layer"), F.col("_m").alias("metres"), s["shape_id"].alias("shape_id"), F.col("_t").alias("t"))).alias("b"))
    return best.select(F.col("_id").alias(point_id), "b.layer", "b.shape_id", "b.metres", "b.t")


TOP = 22.5  # degrees: cells of the first level, sixteen around the globe
STEP = 4  # a cell of a level is that many wide and high in cells of the next
FINE = 48  # a region is about that many of its smallest cells across, but for parts with many edges
EDGES = 64  # border cells with more edges are divided further


def _crossed(edges: np.ndarray, x: np.ndarray, y: np.ndarray, rx: float, ry: float) -> np.ndarray:
    """How many edges (x0, y0, x1, y1) the way from a place to each point crosses."""
    x0, y0, x1, y1 = edges.T[:, :, None]
    side = lambda ax, ay: (x - rx) * (ay - ry) - (y - ry) * (ax - rx) > 0
    line = lambda px, py: (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0) > 0
    return ((side(x0, y0) != side(x1, y1)) & (line(rx, ry) != line(x, y))).sum(0)


def _reference(edges: np.ndarray, w: float, s: float, side: float) -> tuple[float, float]:
    """A place in a cell on none of its edges."""
    best, far = (w + side / 2, s + side / 2), -1.0
    for i in range(8):
        x, y = w + side * ((0.37 + 0.6180339887 * i) % 1), s + side * ((0.43 + 0.7548776662 * i) % 1)
        if not len(edges):
            return x, y
        dx, dy = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
        t = np.clip(((x - edges[:, 0]) * dx + (y - edges[:, 1]) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
        near = np.hypot(edges[:, 0] + t * dx - x, edges[:, 1] + t * dy - y).min()
        if near > far:
            best, far = (x, y), near
        if far > side / 50:
            break
    return best


def _cover(rings: list, top: float, levels: int) -> Iterator[tuple[int, int, int, bool, float, float, bool, np.ndarray]]:
    """(level, row, column, inside, x, y, place inside, edges) of plane cells ``top / 4**level`` degrees wide that cover a polygon.

    A border cell carries the edges that touch it and a place in it of which it is known whether it lies inside; what is
    tested for a cell is passed on to its parts, so that each edge is looked at only where it runs.
    """
    edges = np.concatenate([np.column_stack([r[:-1], r[1:]]) for r in rings])
    lo, hi = edges[:, :2].min(0), edges[:, :2].max(0)
    extent = max(float((hi - lo).max()), 1e-9)
    enough = min(levels, max(0, math.ceil(math.log(top * FINE / extent, STEP))))
    out_x, out_y = lo[0] - 1.2345, lo[1] - 0.6789  # a place outside
    todo = []
    for y in range(int((lo[1] + 90) // top), int((hi[1] + 90) // top) + 1):
        for x in range(math.floor((lo[0] + 180) / top), math.floor((hi[0] + 180) / top) + 1):
            own = edges[_touching(edges, x * top - 180, y * top - 90, top)]
            rx, ry = _reference(own, x * top - 180, y * top - 90, top)
            todo.append((0, y, x, own, rx, ry, bool(_crossed(edges, np.array([rx]), np.array([ry]), out_x, out_y)[0] % 2)))
    while todo:
        level, y, x, own, rx, ry, within = todo.pop()
        if not len(own):
            if within:
                yield level, y, x, True, rx, ry, True, own
            continue
        if level >= enough and (len(own) <= EDGES or level >= levels):
            yield level, y, x, False, rx, ry, within, own
            continue
        side = top / STEP ** (level + 1)
        for i in range(STEP):
            for j in range(STEP):
                w, s = (STEP * x + j) * side - 180, (STEP * y + i) * side - 90
                part = own[_touching(own, w, s, side)]
                px, py = _reference(part, w, s, side)
                odd = _crossed(own, np.array([px]), np.array([py]), rx, ry)[0] % 2
                todo.append((level + 1, STEP * y + i, STEP * x + j, part, px, py, within != bool(odd)))


def _touching(edges: np.ndarray, w: float, s: float, side: float) -> np.ndarray:
    """Which edges touch a cell, a hair of slack included (clipping of all edges at once)."""
    slack = side * 1e-9
    x0, y0, x1, y1 = edges.T
    t0, t1 = np.zeros(len(edges)), np.ones(len(edges))
    ok = np.ones(len(edges), bool)
    for a, d, low, high in ((x0, x1 - x0, w - slack, w + side + slack), (y0, y1 - y0, s - slack, s + side + slack)):
        flat = d == 0
        ok &= ~flat | ((a >= low) & (a <= high))
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (low - a) / d, (high - a) / d
        t0 = np.where(flat, t0, np.maximum(t0, np.minimum(p, q)))
        t1 = np.where(flat, t1, np.minimum(t1, np.maximum(p, q)))
    return ok & (t0 <= t1)


def points_in_regions(
    points: DataFrame, regions: DataFrame, point_id: str, region_id: str, rings: str = "rings",
    lon: str = "lon", lat: str = "lat", levels: int = 7,
) -> DataFrame:
    """``(point_id, region_id)`` for every point inside a region or on its border.

    ``rings`` is ``array<array<struct<lon, lat>>>``: closed rings, holes by the even-odd rule; those that
    cross the date line run on beyond 180 or -180. Each region is covered adaptively: cells wholly inside stay large, those
    on the border are divided by four, until the region is some 48 of them across and further where many edges meet.
    Unusable points, null ids and regions without a ring of three corners pair with nothing; repeated rows count once.

    A point looks itself up once per level in use. One equi-join answers interior cells at once; a border cell carries its own
    edges and a place known to be inside or outside, so that a point is tested against the few edges between
    the two, inside the JVM and without another look at either table.
    """
    id_type = regions.schema[region_id].dataType.simpleString()

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rid, x, y, sizes in zip(frame["_r"], frame["_x"], frame["_y"], frame["_sizes"]):
                own = np.split(np.column_stack([np.asarray(x, float), np.asarray(y, float)]), np.cumsum(sizes)[:-1].astype(int)) if len(x) else []
                own = [np.vstack([r, r[:1]]) if len(r) and (r[0] != r[-1]).any() else r for r in own]
                own = [r for r in own if len(r) >= 4]
                if own:
                    rows = []
                    for lv, y, x, inside, rx, ry, within, edges in _cover(own, TOP, levels):
                        turns, x = divmod(x, int(360 / TOP) * STEP**lv)
                        rows.append((rid, lv, (y << 24) + x, inside, rx - 360 * turns, ry, within, (edges - [360.0 * turns, 0, 360.0 * turns, 0]).ravel()))
                    yield pd.DataFrame(rows, columns=["_r", "_level", "_cell", "_inside", "_rx", "_ry", "_within", "_edges"])

    cells = (
        regions.select(F.col(region_id).alias("_r"), F.col(rings).alias("_rings"))
        .filter("_r is not null and _rings is not null")
        .distinct()
        .select("_r", F.filter("_rings", lambda r: r.isNotNull()).alias("_rings"))
        .select("_r", F.transform(F.flatten("_rings"), lambda p: p["lon"]).alias("_x"), F.transform(F.flatten("_rings"), lambda p: p["lat"]).alias("_y"), F.transform("_rings", F.size).alias("_sizes"))
        .mapInPandas(cover, f"_r {id_type}, _level int, _cell long, _inside boolean, _rx double, _ry double, _within boolean, _edges array<double>")
    )
    corners = F.transform(F.sequence(F.lit(0), (F.size("_edges") / 4).cast("int") - 1), lambda i: F.struct(*[F.get("_edges", (i * 4 + k).cast("int")).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]))
    edges = F.when(F.size("_edges") > 0, corners)
    cells = Scratch(points.sparkSession, "regions").write(cells.withColumn("_edges", edges))
    used = sorted(r[0] for r in cells.select("_level").distinct().collect()) or [0]  # one number a level, seven or so
    lon_, lat_ = F.col("lon"), F.col("lat")
    once = points.select(F.col(point_id).alias("_id"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))
    once = once.filter(F.col("_id").isNotNull() & is_point(lon_, lat_)).withColumn("lon", F.when(lon_ == 180, -180.0).otherwise(lon_)).distinct()
    at = lambda v: F.struct(F.lit(v).alias("level"), (F.floor((lat_ + 90) / (TOP / STEP**v)).cast("long") * _SHIFT + F.pmod(F.floor((lon_ + 180) / (TOP / STEP**v)).cast("long"), F.lit(int(360 / TOP) * STEP**v))).alias("cell"))
    probe = once.select("*", F.explode(F.array(*map(at, used))).alias("_at")).select("_id", "lon", "lat", F.col("_at.level").alias("_level"), F.col("_at.cell").alias("_cell"))
    met = probe.join(cells.hint("merge"), ["_level", "_cell"])
    rx, ry = F.col("_rx"), F.col("_ry")
    side = lambda ax, ay: ((lon_ - rx) * (ay - ry) - (lat_ - ry) * (ax - rx)) > 0
    line = lambda e, px, py: (e["x1"] - e["x0"]) * (py - e["y0"]) - (e["y1"] - e["y0"]) * (px - e["x0"])
    crossed = lambda e: (side(e["x0"], e["y0"]) != side(e["x1"], e["y1"])) & ((line(e, rx, ry) > 0) != (line(e, lon_, lat_) > 0))
    between = lambda v, p, q: (v >= F.least(p, q)) & (v <= F.greatest(p, q))
    on = lambda e: (line(e, lon_, lat_) == 0) & between(lon_, e["x0"], e["x1"]) & between(lat_, e["y0"], e["y1"])
    tested = F.exists("_edges", on) | (F.col("_within") != (F.size(F.filter("_edges", crossed)) % 2 == 1))
    found = met.filter(F.when(F.col("_inside"), True).otherwise(tested)).select(F.col("_id").alias(point_id), F.col("_r").alias(region_id))
    return found.distinct()
