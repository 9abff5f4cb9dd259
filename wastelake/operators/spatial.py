"""Spatial joins as equi joins on grid cells, and tiles and paths."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wastelake.functions import geo as G
from wastelake.session import materialize, spread

CELL_DEGREES = 0.01
LEAF_METRES = 7.8125
SEED_LEVEL = 1  # 31 m
TOP_LEVEL = 11  # 32,768 km: its 3 x 3 cells cover the globe
HOT_CELL = 4_000  # positions of one grid cell that are compared at a time
SLACK = 1e-6
MARGIN = 1e-9  # degrees: 0.1 mm


def with_envelope(polygons: DataFrame) -> DataFrame:
    return polygons.withColumns(G.envelope(G.outer_ring(F.col("rings"))))


def with_centroid(polygons: DataFrame) -> DataFrame:
    c = G.ring_centroid(G.outer_ring(F.col("rings")))
    return polygons.withColumn("centroid", c).withColumns(
        {"centroid_lon": F.col("centroid.lon"), "centroid_lat": F.col("centroid.lat")}
    ).drop("centroid")


#: Positions up to which a ring's edges are compared inside its row.
SMALL_RING = 64


def crossed_polygons(polygons: DataFrame) -> DataFrame:
    """id of every polygon with a large ring of which two edges cross.

    Edges go to the cells of a grid of their ring's own, about as many cells a side as the ring has edges, so that an edge of
    usual length lies in a few; edges meet in a cell, never all with all. A long edge takes the cells along it, row by row.
    """
    ring = F.col("points")
    large = polygons.select("id", F.posexplode("rings").alias("ring", "points")).where(F.size("points") > SMALL_RING)
    box = G.envelope(ring)
    extent = F.greatest(box["max_lon"] - box["min_lon"], box["max_lat"] - box["min_lat"])
    large = materialize(large.withColumn("step", 2 * extent / F.size("points")), "large-rings")  # worked out once a ring, not once an edge
    edges = large.select("id", "ring", "step", F.posexplode(G.segments(ring)).alias("seq", "s"))
    ends = F.struct(G.px(F.col("s.a")).alias("x0"), G.py(F.col("s.a")).alias("y0"), G.px(F.col("s.b")).alias("x1"), G.py(F.col("s.b")).alias("y1"))
    edges = materialize(edges.select("id", "ring", "step", "seq", "s", ends.alias("e")), "edges")
    e, step = F.col("e"), F.col("step")
    rows = edges.withColumn("cy", F.explode(F.sequence(F.floor((F.least(e["y0"], e["y1"]) - MARGIN) / step), F.floor((F.greatest(e["y0"], e["y1"]) + MARGIN) / step))))
    first, last = _columns(e, "x0", "y0", "x1", "y1", F.col("cy"), step)
    cells = rows.withColumn("cx", F.explode(F.sequence(first, last))).select("id", "ring", "cx", "cy", "seq", "s")
    key = ["id", "ring", "cx", "cy"]
    pairs = cells.join(cells.select(*key, F.col("seq").alias("other"), F.col("s").alias("t")), key).where(F.col("seq") < F.col("other"))
    return pairs.where(G.proper_cross(F.col("s"), F.col("t"))).select("id").distinct()


def polygon_problems(polygons: DataFrame) -> DataFrame:
    """Adds `problem`: the first broken geometry rule, or NULL for a usable polygon. A verdict that is there is kept."""
    if "problem" in polygons.columns:
        return polygons
    return polygons.withColumn("problem", G.polygon_problem(F.col("rings")))


def checked(polygons: DataFrame) -> DataFrame:
    """Polygons (unique id, rings) with their `problem`, written once; questions over the result check nothing again.

    For rings of any size: edges of rings above SMALL_RING positions are compared cell by cell.
    """
    judged = materialize(polygons.drop("problem").withColumn("problem", G.polygon_problem(F.col("rings"), SMALL_RING)), "judged")
    crossed = crossed_polygons(judged.where("problem is null")).withColumn("_crossed", F.lit("self_crossing"))
    return materialize(judged.join(crossed, "id", "left").withColumn("problem", F.coalesce("problem", "_crossed")).drop("_crossed"), "polygons")


def layer_problems(features: DataFrame, name: str = "name") -> DataFrame:
    """Per rule the features of a polygon layer (id, name, rings, problem) that break it as a layer, and the broken polygons."""
    named = F.trim(F.coalesce(F.col(name), F.lit("")))
    twice = lambda c: features.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("features"))
    flat = features.agg(
        F.count_if(named == "").alias("blank_name"), F.count_if(F.col("id").isNull() | ~F.col("id").between(-(2**31), 2**31 - 1)).alias("invalid_id"),
        F.count_if(F.col("problem").isNotNull()).alias("broken_polygon"), (F.count("*") == 0).cast("bigint").alias("no_features"),
    )
    out = flat.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("features")) for r in flat.columns])).alias("r")).select("r.*")
    for rule, column in (("duplicate_id", F.col("id")), ("duplicate_name", F.col(name))):
        out = out.unionByName(twice(column).select(F.lit(rule).alias("rule"), "features"))
    return out


def _row(y: Column, step: float) -> Column:
    return F.floor(y / step)


def _columns(e: Column, x0: str, y0: str, x1: str, y1: str, row: Column, step: float) -> tuple[Column, Column]:
    """First and last grid column of an edge's part within a grid row, widened by more than rounding can move it."""
    low, high = F.least(e[y0], e[y1]), F.greatest(e[y0], e[y1])
    at = lambda y: e[x0] + F.try_divide((e[x1] - e[x0]) * (F.least(F.greatest(y, low), high) - e[y0]), e[y1] - e[y0])
    a, b = F.coalesce(at(row * step), e[x0]), F.coalesce(at((row + 1) * step), e[x1])  # NULL: a level edge
    return F.floor((F.least(a, b) - MARGIN) / step), F.floor((F.greatest(a, b) + MARGIN) / step)


def cell_index(polygons: DataFrame, step: float = CELL_DEGREES) -> DataFrame:
    """Polygons (id, rings) as grid cells: polygon_id, ring (0 the outer one), px, py, edges, heights, base.

    A cell without edges lies inside the ring and decides by itself. Any other cell carries the edges that meet it, and what
    lies to its right in short: a ray to the right crosses an even or odd number of those edges, and all but the
    ends of their chains cancel. `base` is the parity of the ends above the cell's row, `heights` are the ends in the row, where
    a chain goes on among the cell's own edges. So no row carries a whole ring, and each answer is that of the full ray
    cast. A ring that does not end where it starts is closed.
    """
    ring = F.col("points")
    closed = F.when(F.element_at(ring, 1) != F.element_at(ring, -1), F.concat(ring, F.array(F.element_at(ring, 1)))).otherwise(ring)
    rings = polygons.select(F.col("id").alias("polygon_id"), F.posexplode("rings").alias("ring", "points")).where(F.size("points") > 2).withColumn("points", closed)
    n = F.size(ring) - 1
    at = lambda i: F.get(ring, F.pmod(i, n))
    edge = lambda i: F.struct(*[at(i + k)[c].alias(f"{'xy'[c]}{k}") for k in (0, 1, 2) for c in (0, 1)])
    rings = rings.select("polygon_id", "ring", F.transform(F.sequence(F.lit(0), n - 1), edge).alias("all"))
    lowest, highest = F.array_min(F.transform("all", lambda e: e["y0"])), F.array_max(F.transform("all", lambda e: e["y0"]))
    rows = rings.withColumn("py", F.explode(F.sequence(_row(lowest, step), _row(highest, step))))
    py = F.col("py")

    def placed(e: Column) -> Column:
        c0, c1 = _columns(e, "x0", "y0", "x1", "y1", py, step)
        follows = F.when(_row(e["y1"], step) == py, _columns(e, "x1", "y1", "x2", "y2", py, step)[0])
        above = (_row(e["y0"], step) > py) != (_row(e["y1"], step) > py)
        return F.struct(e["x0"].alias("x0"), e["y0"].alias("y0"), e["x1"].alias("x1"), e["y1"].alias("y1"), c0.alias("c0"), c1.alias("c1"), follows.alias("n0"), above.alias("above"))

    in_row = lambda e: (_row(F.least(e["y0"], e["y1"]), step) <= py) & (_row(F.greatest(e["y0"], e["y1"]), step) >= py)
    rows = rows.select("polygon_id", "ring", "py", F.transform(F.filter("all", in_row), placed).alias("row"))
    first, last = F.array_min(F.transform("row", lambda e: e["c0"])), F.array_max(F.transform("row", lambda e: e["c1"]))
    px = F.col("px")
    cells = rows.withColumn("px", F.explode(F.sequence(first, last)))
    own = F.transform(F.filter("row", lambda e: (e["c0"] <= px) & (e["c1"] >= px)), lambda e: F.struct(*[e[c].alias(c) for c in ("x0", "y0", "x1", "y1")]))
    ends = F.transform(F.filter("row", lambda e: (F.least(e["c0"], e["n0"]) <= px) & (F.greatest(e["c0"], e["n0"]) > px) & e["n0"].isNotNull()), lambda e: e["y1"])
    base = F.size(F.filter("row", lambda e: e["above"] & (e["c0"] > px))) % 2
    cells = cells.select("polygon_id", "ring", "px", "py", own.alias("edges"), ends.alias("heights"), base.alias("base"))
    return cells.where((F.size("edges") > 0) | (F.col("base") == 1))


#: Elements of one comparison of edges with positions, of a polygon's rows with positions.
BLOCK = 4_000_000


def _odd(edges: np.ndarray, counts: np.ndarray, heights: np.ndarray, height_counts: np.ndarray, base: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Half-open ray cast of the positions of a cell for each row of the index: rows x positions."""
    odd = np.repeat((base % 2 == 1)[:, None], len(lon), axis=1)

    def toggle(hit, counts, total):
        row, step = np.repeat(np.arange(len(counts)), counts), max(1, BLOCK // max(1, len(lon)))
        for i in range(0, total, step):
            rows = row[i : i + step]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            odd[rows[first]] ^= np.logical_xor.reduceat(hit(slice(i, i + step)), first, axis=0)

    def crosses(part):
        x0, y0, x1, y1 = (c[:, None] for c in edges[:, part])
        return ((y0 > lat) != (y1 > lat)) & (lon < (x1 - x0) * (lat - y0) / np.where(y1 == y0, np.nan, y1 - y0) + x0)

    toggle(crosses, counts, edges.shape[1])
    toggle(lambda part: heights[part][:, None] > lat, height_counts, len(heights))
    return odd


def _touching(edges: np.ndarray, counts: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Whether a position lies on an edge of the row: rows x positions."""
    on, row, step = np.zeros((len(counts), len(lon)), bool), np.repeat(np.arange(len(counts)), counts), max(1, BLOCK // max(1, len(lon)))
    for i in range(0, edges.shape[1], step):
        x0, y0, x1, y1 = (c[:, None] for c in edges[:, i : i + step])
        cross = (x1 - x0) * (lat - y0) - (y1 - y0) * (lon - x0)
        hit = (cross == 0) & (lon >= np.minimum(x0, x1)) & (lon <= np.maximum(x0, x1)) & (lat >= np.minimum(y0, y1)) & (lat <= np.maximum(y0, y1))
        rows = row[i : i + step]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        on[rows[first]] |= np.logical_or.reduceat(hit, first, axis=0)
    return on


class _Cell:
    """The positions of one piece of a cell, what was found for them, and the polygon whose rows are being read."""

    def __init__(self, batch: pa.RecordBatch):
        self.lon, self.lat, self.several = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat", "several"))
        self.several = self.several.astype(bool)
        self.matches, self.low = np.zeros(len(self.lon), np.int64), np.full(len(self.lon), None, object)
        self.pairs, self.polygon = [], None

    def joined(self, other: _Cell) -> _Cell:
        for c in ("lon", "lat", "several", "matches", "low"):
            setattr(self, c, np.concatenate([getattr(self, c), getattr(other, c)]))
        return self

    def add(self, ids: list, outer: np.ndarray, hole: np.ndarray) -> None:
        """Rows of a polygon follow one another, through batches; polygons come in ascending order, null first."""
        first = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]]
        ids, outer, hole = [ids[i] for i in first], np.logical_or.reduceat(outer, first, axis=0), np.logical_or.reduceat(hole, first, axis=0)
        if self.polygon is not None and self.polygon[0] == ids[0]:
            outer[0] |= self.polygon[1]
            hole[0] |= self.polygon[2]
        else:
            self.close()
        self.polygon = (ids[-1], outer[-1], hole[-1])
        self.count(ids[:-1], outer[:-1], hole[:-1])

    def count(self, ids: list, outer: np.ndarray, hole: np.ndarray) -> None:
        won = outer & ~hole
        self.matches += won.sum(axis=0)
        named = 1 if ids and ids[0] is None else 0
        if len(ids) > named:
            new = won[named:].any(axis=0) & np.equal(self.low, None).astype(bool)
            where = np.flatnonzero(new)
            self.low[where] = np.array(ids, object)[named:][won[named:][:, where].argmax(axis=0)]
        for i in np.flatnonzero(self.several):
            for k in np.flatnonzero(outer[:, i] | hole[:, i]):
                self.pairs.append((self.lon[i], self.lat[i], ids[k], None, bool(outer[k, i]), bool(hole[k, i]), True))

    def close(self) -> None:
        if self.polygon is not None:
            polygon, outer, hole = self.polygon
            self.polygon = None
            self.count([polygon], outer[None], hole[None])

    def found(self):
        self.close()
        yield from self.pairs
        for i in np.flatnonzero(self.matches):
            yield self.lon[i], self.lat[i], self.low[i], int(self.matches[i]), True, False, False


def _stab(boundary: bool, schema: pa.Schema):
    """Streams rows ordered by (cell, piece, polygon), positions first: positions of one piece and a batch of polygons are held."""

    def rows(cell):
        out = list(cell.found()) if cell is not None else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def meet(cell, part):
        edges, heights = part.column("edges"), part.column("heights")
        counts, height_counts = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (edges, heights))
        flat = edges.flatten()
        edges = np.array([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], float).reshape(4, -1)
        heights, base = heights.flatten().to_numpy(zero_copy_only=False).astype(float), part.column("base").to_numpy(zero_copy_only=False)
        ring, ids = part.column("ring").to_numpy(zero_copy_only=False), part.column("polygon_id")
        at, above = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(height_counts)]
        for i in range(0, part.num_rows, max(1, BLOCK // len(cell.lon))):
            j = min(part.num_rows, i + max(1, BLOCK // len(cell.lon)))
            own = edges[:, at[i] : at[j]]
            inside = _odd(own, counts[i:j], heights[above[i] : above[j]], height_counts[i:j], base[i:j], cell.lon, cell.lat)
            if boundary:
                on = _touching(own, counts[i:j], cell.lon, cell.lat)
                inside = np.where((ring[i:j] == 0)[:, None], inside | on, inside & ~on)
            out = (ring[i:j] == 0)[:, None]
            cell.add(ids.slice(i, j - i).to_pylist(), inside & out, inside & ~out)

    def run(batches):
        with np.errstate(all="ignore"):
            key, cell = None, None
            for batch in batches:
                keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("px", "py", "piece", "side")]
                change = np.zeros(batch.num_rows, bool)
                change[:1] = True
                for k in keys:
                    change[1:] |= k[1:] != k[:-1]
                starts = [*np.flatnonzero(change), batch.num_rows]
                for i, j in zip(starts, starts[1:]):
                    part, here = batch.slice(i, j - i), tuple(int(k[i]) for k in keys[:3])
                    if keys[3][i] == 0:
                        if here == key:
                            cell.joined(_Cell(part))
                        else:
                            yield from rows(cell)
                            key, cell = here, _Cell(part)
                    elif here == key:
                        meet(cell, part)
            yield from rows(cell)

    return run


def membership(points: DataFrame, polygons: DataFrame, boundary: bool = False, step: float = CELL_DEGREES) -> DataFrame:
    """Per point id: the lowest containing polygon id (or NULL) and the number of matches.

    `polygons` are polygons (id, rings) or the rows of their `cell_index`, written before. Points at one position count as
    one; positions and cells of polygons meet on (grid cell, piece). Positions are counted per cell first: a cell with more than
    HOT_CELL is cut into pieces and only its index rows are copied, once per piece; index rows of cells without points drop out.
    A task holds the positions of one piece, reads its polygons in order of their ids and hands on a
    number and the lowest id per position, so that pairs of a point and a polygon are neither written nor shuffled. An id at
    several positions has its polygons listed, as each counts once. `boundary` switches from
    the half-open ray cast to the boundary-inclusive cover.
    """
    cell, place = ["px", "py"], ["lon", "lat"]
    keyed = points.select("id", F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat")).dropna().distinct()
    apart = keyed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("several"))
    keyed = keyed.join(apart, "id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    spots = keyed.groupBy(*place).agg(F.max("several").alias("several")).withColumns({"px": F.floor(F.col("lon") / step), "py": F.floor(F.col("lat") / step)})
    pieces = spots.groupBy(*cell).agg(F.ceil(F.count("*") / HOT_CELL).alias("pieces"))
    spots = spots.join(pieces, cell).withColumn("piece", F.pmod(F.xxhash64(*place), F.col("pieces"))).drop("pieces")
    cover = (polygons if "heights" in polygons.columns else cell_index(spread(polygons, "id"), step)).join(pieces, cell)
    cover = cover.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))).drop("pieces")
    key = [*cell, "piece"]
    both = spots.withColumn("side", F.lit(0)).unionByName(cover.withColumn("side", F.lit(1)), allowMissingColumns=True)
    ordered = spread(both, *key).sortWithinPartitions(*key, "side", "polygon_id")
    kind = cover.schema["polygon_id"].dataType
    schema = T.StructType().add("lon", "double").add("lat", "double").add("polygon_id", kind).add("matches", "long").add("outer", "boolean").add("hole", "boolean").add("several", "boolean")
    near = ordered.mapInArrow(_stab(boundary, to_arrow_schema(schema)), schema)
    held = keyed.join(near, [*place, "several"]).groupBy("id", "polygon_id", "matches").agg(F.max("outer").alias("outer"), F.max("hole").alias("hole"))
    found = held.where("outer and not hole").groupBy("id").agg(F.min("polygon_id").alias("polygon_id"), F.sum(F.coalesce("matches", F.lit(1))).alias("matches"))
    return points.select("id").join(found, "id", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("bigint")))


def _envelope_meets(polygons: DataFrame, bbox) -> DataFrame:
    west, south, east, north = bbox
    return with_envelope(polygons).where(
        (F.col("min_lon") <= east) & (F.col("max_lon") >= west) & (F.col("min_lat") <= north) & (F.col("max_lat") >= south)
    )


def broken_near(polygons: DataFrame, bbox) -> DataFrame:
    """Polygons whose envelope meets the rectangle and that break a geometry rule, with the `problem`."""
    return polygon_problems(_envelope_meets(polygons, bbox)).where(F.col("problem").isNotNull())


def intersecting(polygons: DataFrame, bbox) -> DataFrame:
    """Valid polygons that meet the rectangle; a cheap envelope test runs before the exact one. The others: broken_near."""
    west, south, east, north = bbox
    near = _envelope_meets(polygons, bbox)
    within = (F.col("min_lon") >= west) & (F.col("max_lon") <= east) & (F.col("min_lat") >= south) & (F.col("max_lat") <= north)
    met = near.where(within | G.intersects_bbox(F.col("rings"), bbox))
    valid = polygon_problems(met).where(F.col("problem").isNull())
    return valid.select(*[c for c in polygons.columns if c != "problem"])


# --- nearest point -----------------------------------------------------------

BOX = ["kind", "box_level", "bx", "by"]
BOUNDS = ["west", "east", "south", "north"]
BOX_LEVEL, FINEST_BOX = 3, -4  # boxes of sources: 500 m, down to 3 cm where points are crowded
BOX_POINTS = 4  # points a box of sources holds, about
HOT_BOX = 50_000  # sources of one box that one task compares
POINT_CHUNK = 256  # candidate points of a box in one row
# grids sources are searched in, one after the other: metres of a box, points of a cell (about), candidate points of a cell (at most)
GRIDS = [(500.0, 16, 512), (8_000.0, 64, 2_048), (128_000.0, 64, 2_048)]
FINEST_CELL = 500.0 / 2**14  # 3 cm
GLOBE = 9e7  # metres: positions beyond are left to the pyramid


def _near2() -> Column:
    """Squared distance from a box of sources to a cell's tight box (0 where they meet)."""
    dx = F.greatest(F.col("x0") - F.col("east"), F.col("west") - F.col("x1"), F.lit(0.0))
    dy = F.greatest(F.col("y0") - F.col("north"), F.col("south") - F.col("y1"), F.lit(0.0))
    return dx * dx + dy * dy


def _far2() -> Column:
    """Squared distance of the farthest corners: for every source of the box some point of the cell is not farther."""
    dx = F.greatest(F.col("x1") - F.col("west"), F.col("east") - F.col("x0"))
    dy = F.greatest(F.col("y1") - F.col("south"), F.col("north") - F.col("y0"))
    return dx * dx + dy * dy


def _size(level: Column) -> Column:
    return F.lit(LEAF_METRES) * F.pow(F.lit(4.0), level)


def _grid(v: Column, level: Column) -> Column:
    return F.floor(v / _size(level))


def nearest_point(sources: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest point of the same kind for every source, ties to the lowest point id; exact.

    sources: source_id, kind, x, y; points: point_id, kind, x, y (metres).

    Sources of a kind without points have no row. The others are compared with the points in and around their own cell first,
    of a grid as fine as the points are dense. Whoever finds a point within half a cell has met every point that could be
    nearer. The rest goes on to a wider grid, and what no grid answers walks the pyramid of `_by_boxes`.
    """
    kinds = materialize(points.select("kind").distinct(), "kinds")
    left, done = sources.select("source_id", "kind", "x", "y").where("x is not null and y is not null").join(kinds, "kind", "left_semi"), []
    for grid in GRIDS:
        found = _by_cells(left, points, *grid)
        done.append(found.where("sure").select("source_id", "kind", "best"))
        left = found.where("not sure").select("source_id", "kind", "x", "y")
        if left.isEmpty():
            break
    else:
        done.append(_by_boxes(left, points))
    best = reduce(DataFrame.unionByName, done).groupBy("source_id", "kind").agg(F.min("best").alias("best"))
    return best.select("source_id", "kind", F.col("best.point_id").alias("point_id"), F.sqrt("best.d2").alias("distance_m"))


def _nearest_rows(most: int, schema: pa.Schema):
    """Streams rows ordered by cell, points first and by id: a batch and the points of its last cell are held.

    A source gets the nearest point of its cell, the lowest id of equal ones; none if the cell has no point or more than `most`.
    """

    def run(batches):
        carry = []
        for batch in batches:
            rows = pa.Table.from_batches([*carry, batch]).combine_chunks()
            if not rows.num_rows:
                continue
            kind = rows.column("kind").combine_chunks().dictionary_encode().indices
            keys = [rows.column(c).to_numpy() for c in ("cx", "cy", "depth", "piece")] + [kind.to_numpy(zero_copy_only=False)]
            change = np.ones(rows.num_rows, bool)
            change[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            x, y, source = rows.column("x").to_numpy(), rows.column("y").to_numpy(), rows.column("side").to_numpy() == 1
            starts, before = np.flatnonzero(change), np.r_[0, np.cumsum(~source)]
            ends = np.r_[starts[1:], rows.num_rows]
            d2, at = np.zeros(rows.num_rows), np.full(rows.num_rows, -1)
            for i, p, j in zip(starts, starts + before[ends] - before[starts], ends):
                for k in range(p, j, max(1, BLOCK // max(1, p - i))) if 0 < p - i <= most else ():
                    m = min(j, k + max(1, BLOCK // (p - i)))
                    dx, dy = x[i:p] - x[k:m, None], y[i:p] - y[k:m, None]
                    d = dx * dx + dy * dy
                    at[k:m] = i + d.argmin(1)
                    d2[k:m] = d.min(1)
            carry = rows.slice(starts[-1], min(most + 1, before[-1] - before[starts[-1]])).to_batches()
            found, at = rows.filter(pa.array(source)), at[source]
            ids = rows.column("point_id").combine_chunks().take(pa.array(at, mask=at < 0))
            best = pa.StructArray.from_arrays([pa.array(d2[source]), ids], fields=list(schema.field("best").type), mask=pa.array(at < 0))
            yield from pa.Table.from_arrays([*(found.column(c) for c in schema.names[:-1]), best], schema=schema).to_batches()

    return run


def _by_cells(sources: DataFrame, points: DataFrame, metres: float, cell_points: int, most: int) -> DataFrame:
    """Sources, written, with the nearest of the points in and half a cell around their cell, if any, and whether no other is nearer.

    A cell is a box of `metres`, halved until it holds about `cell_points` points of the box. A point goes to the cells it lies in
    or near, four on average, as far as they hold sources, and a source to its own cell. Cells with more than `most` points around
    give no answer: there the points are much denser than in the box as a whole.
    """
    x, y, depth = F.col("x"), F.col("y"), F.col("depth")
    size, many = F.lit(metres) / F.pow(F.lit(2.0), depth), F.pow(F.lit(2.0), depth).cast("bigint")
    box, key = ["kind", "bx", "by"], ["kind", "depth", "cx", "cy"]
    wide = {"bx": F.floor(x / metres), "by": F.floor(y / metres)}
    inside = points.select("point_id", "kind", "x", "y").where((F.abs("x") < 1.1 * GLOBE) & (F.abs("y") < 1.1 * GLOBE))
    halvings = F.least(F.greatest(F.round(F.log(4.0, F.count("*") / cell_points)), F.lit(0.0)), F.floor(F.log2(F.lit(metres / FINEST_CELL))))
    depths = materialize(inside.withColumns(wide).groupBy(*box).agg(halvings.cast("int").alias("depth")), "depths")
    deep = lambda df: df.join(depths, box, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    src = deep(sources.withColumns(wide)).withColumns({"cx": F.floor(x / size), "cy": F.floor(y / size)}).drop("bx", "by")
    src = materialize(src, "sources")  # read twice
    # a cell crowded with sources is cut into pieces, each with the cell's points
    held = materialize(src.groupBy(*key).agg(F.ceil(F.count("*") / HOT_BOX).alias("pieces")), "held")
    crowded = materialize(held.where("pieces > 1"), "crowded")
    # the boxes a point lies in or near, and in each of them the cells
    about = lambda v: F.explode(F.sequence(F.floor((v - metres / 2) / metres), F.floor((v + metres / 2) / metres)))
    met = deep(inside.withColumn("bx", about(x)).withColumn("by", about(y)))
    low = lambda v, b: F.greatest(F.floor((v - size / 2) / size), F.col(b) * many)
    high = lambda v, b: F.least(F.floor((v + size / 2) / size), (F.col(b) + 1) * many - 1)
    met = met.where((low(x, "bx") <= high(x, "bx")) & (low(y, "by") <= high(y, "by")))
    met = met.withColumn("cx", F.explode(F.sequence(low(x, "bx"), high(x, "bx")))).withColumn("cy", F.explode(F.sequence(low(y, "by"), high(y, "by"))))
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
    met = met.select(*key, "point_id", "x", "y").join(held, key).withColumn("piece", piece).drop("pieces").withColumn("side", F.lit(0))
    piece = F.pmod(F.xxhash64("source_id", "x", "y"), F.coalesce("pieces", F.lit(1).cast("bigint")))
    src = src.join(crowded, key, "left").withColumn("piece", piece).drop("pieces").withColumn("side", F.lit(1))
    cell = ["cx", "cy", "depth", "piece", "kind"]
    ordered = spread(met.unionByName(src, allowMissingColumns=True), *cell).sortWithinPartitions(*cell, "side", "point_id")
    schema = T.StructType([ordered.schema[c] for c in ("source_id", "kind", "x", "y", "depth")]).add("best", T.StructType().add("d2", "double").add("point_id", ordered.schema["point_id"].dataType))
    out = materialize(ordered.mapInArrow(_nearest_rows(most, to_arrow_schema(schema)), schema).withColumn("reach", size / 2 * (1 - 1e-4)), "near")
    sure = (F.col("best.d2") <= F.col("reach") * F.col("reach")) & (F.abs("x") < GLOBE) & (F.abs("y") < GLOBE)
    return out.withColumn("sure", F.coalesce(sure, F.lit(False)))


def _by_boxes(sources: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest point of the same kind for every source as a struct (d2, point_id), one row per source and chunk of points.

    Sources are searched for by boxes: those of one grid cell, finer where points are crowded, so that what moves follows
    the boxes and each source itself moves twice. A grid pyramid (7.8 m cells, each level four times coarser) holds the
    tight box of the points in every occupied cell. The occupied cells around a box give a first distance guaranteed to
    all its sources. Only cells within that distance are opened, on the level that fits it, and refined
    sixteenfold twice with an ever better bound. The points left are compared with the sources of the box, in
    chunks. All steps are equi joins on cells, so no source meets all points, and a crowded cell is opened in fine pieces.
    """
    x, y, lvl = F.col("x"), F.col("y"), F.col("level")
    limit = F.col("best2") * (1 + 1e-12) + SLACK  # keeps exact ties through rounding
    leveled = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP_LEVEL)))).withColumns(
        {"cx": _grid(x, lvl), "cy": _grid(y, lvl)}
    )
    cells = leveled.groupBy("kind", "level", "cx", "cy").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    key = ["kind", "level", "cx", "cy"]
    wide = {"bx": _grid(x, F.lit(BOX_LEVEL)), "by": _grid(y, F.lit(BOX_LEVEL))}
    halvings = F.round(F.log(4.0, F.count("*") / BOX_POINTS))
    depth = points.withColumns(wide).groupBy("kind", "bx", "by").agg((F.least(F.greatest(halvings, F.lit(0.0)), F.lit(2.0 * (BOX_LEVEL - FINEST_BOX))) / 2).alias("depth"))
    src = sources.select("source_id", "kind", "x", "y").withColumns(wide).join(depth, ["kind", "bx", "by"], "left")
    src = src.withColumn("box_level", F.lit(BOX_LEVEL) - F.coalesce("depth", F.lit(0.0))).withColumns({"bx": _grid(x, F.col("box_level")), "by": _grid(y, F.col("box_level"))}).drop("depth")
    src = materialize(src, "sources")  # read three times
    boxes = src.groupBy(*BOX).agg(F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north"), F.count("*").alias("n"))
    box = [*BOX, *BOUNDS]
    # on the top level a cell is a quadrant of the globe; its neighbours make sure a bound exists
    around = F.when(lvl == TOP_LEVEL, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seeds = (
        spread(boxes.select(*box), "kind", "bx", "by").withColumn("level", F.explode(F.sequence(F.lit(SEED_LEVEL), F.lit(TOP_LEVEL))))
        .withColumn("dx", F.explode(around))
        .withColumn("dy", F.explode(around))
        .withColumns({"cx": _grid((F.col("west") + F.col("east")) / 2, lvl) + F.col("dx"), "cy": _grid((F.col("south") + F.col("north")) / 2, lvl) + F.col("dy")})
        .join(cells, key)
        .groupBy(*box)
        .agg(F.min(_far2()).alias("best2"))
    )
    radius = F.sqrt(F.col("best2")) + SLACK
    reach = radius + F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south")) / 2
    fit = F.ceil(F.log(4.0, F.greatest(reach / (2 * LEAF_METRES), F.lit(1.0)))).cast("int")
    span = lambda low, high: F.explode(F.sequence(_grid(F.col(low) - radius, lvl), _grid(F.col(high) + radius, lvl)))
    state = seeds.withColumn("level", F.least(fit, F.lit(TOP_LEVEL))).withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north"))
    # every occupied cell under the cell two levels up (or fewer, at the leaf)
    up = F.pow(F.lit(4.0), F.col("step"))
    children = (
        cells.withColumn("step", F.explode(F.when(lvl == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
        .select("kind", (lvl + F.col("step")).alias("level"), F.floor(F.col("cx") / up).alias("cx"), F.floor(F.col("cy") / up).alias("cy"), lvl.alias("fine"), F.col("cx").alias("fx"), F.col("cy").alias("fy"), "x0", "x1", "y0", "y1")
    )
    for _ in range(2):
        near = state.join(children, key).withColumn("near2", _near2()).where(F.col("near2") <= limit)
        shared = F.min(F.least("best2", _far2())).over(W.partitionBy(*BOX))
        state = near.withColumn("best2", shared).where(F.col("near2") <= limit).select(*box, "best2", F.col("fine").alias("level"), F.col("fx").alias("cx"), F.col("fy").alias("cy"))
    spots = leveled.select(*key, F.struct("point_id", "x", "y").alias("p"), x.alias("x0"), x.alias("x1"), y.alias("y0"), y.alias("y1"))
    left = state.join(spots, key).where(_near2() <= limit).select(*BOX, "p")
    chunks = F.ceil(F.count("*").over(W.partitionBy(*BOX)) / POINT_CHUNK)
    left = left.withColumn("chunk", F.pmod(F.xxhash64("p"), chunks)).groupBy(*BOX, "chunk").agg(F.collect_list("p").alias("near"))
    # a crowded box is cut into pieces, each with the box's points
    crowded = boxes.where(F.col("n") > HOT_BOX).select(*BOX, F.ceil(F.col("n") / HOT_BOX).alias("pieces"))
    pieces = F.coalesce("pieces", F.lit(1).cast("bigint"))
    left = left.join(crowded, BOX, "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    src = src.join(crowded, BOX, "left").withColumn("piece", F.pmod(F.xxhash64("source_id", "x", "y"), pieces)).drop("pieces")
    # spread for the costly comparison, whichever side a broadcast join streams
    met = spread(src, *BOX, "piece").join(spread(left.drop("pieces"), *BOX, "piece"), [*BOX, "piece"])
    dx, dy = (lambda p: p["x"] - x), (lambda p: p["y"] - y)
    best = F.array_min(F.transform("near", lambda p: F.struct((dx(p) * dx(p) + dy(p) * dy(p)).alias("d2"), p["point_id"].alias("point_id"))))
    return met.select("source_id", "kind", best.alias("best"))


# --- tiles -------------------------------------------------------------------

def with_tile(df: DataFrame, zoom: int) -> DataFrame:
    return df.withColumns(
        {"tile_x": G.tile_x(F.col("longitude"), zoom), "tile_y": G.tile_y(F.col("latitude"), zoom)}
    )


def tile_cover(boxes: DataFrame, zoom: int) -> DataFrame:
    """All tiles over each box (west, south, east, north columns)."""
    return boxes.withColumn(
        "tile_x", F.explode(F.sequence(G.tile_x(F.col("west"), zoom), G.tile_x(F.col("east"), zoom)))
    ).withColumn("tile_y", F.explode(F.sequence(G.tile_y(F.col("north"), zoom), G.tile_y(F.col("south"), zoom))))


def tile_clusters(points: DataFrame, zoom: int) -> DataFrame:
    """Points per tile with the mean position in Mercator space."""
    mx, my = G.mercator_x(F.col("longitude")), G.mercator_y(F.col("latitude"))
    return with_tile(points, zoom).groupBy("tile_x", "tile_y").agg(
        F.count("*").alias("points"), F.avg(mx).alias("mean_x"), F.avg(my).alias("mean_y")
    )


# --- paths -------------------------------------------------------------------

CHUNK = 10_000
BUCKET_METRES = 1_000.0


def path_lengths(vertices: DataFrame) -> DataFrame:
    """Cumulative metres along each path (path_id, seq, latitude, longitude).

    Windows run inside chunks of at most 10,000 vertices; chunk totals and the vertex before
    each chunk come from a small per-chunk table, so one endless path still splits.
    """
    spot = F.struct("latitude", "longitude")
    rows = vertices.withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    w = W.partitionBy("path_id", "chunk").orderBy("seq")
    before = W.partitionBy("path_id").orderBy("chunk")
    edges = (
        rows.groupBy("path_id", "chunk")
        .agg(F.max_by(spot, "seq").alias("last"))
        .select("path_id", "chunk", F.lag("last").over(before).alias("entry"))
    )
    joined = rows.join(edges, ["path_id", "chunk"]).withColumn("prev", F.coalesce(F.lag(spot).over(w), F.col("entry")))
    mid = F.cos(F.radians((F.col("latitude") + F.col("prev.latitude")) / 2))
    dx = (F.col("longitude") - F.col("prev.longitude")) * mid * G.METRES_PER_DEGREE
    dy = (F.col("latitude") - F.col("prev.latitude")) * G.METRES_PER_DEGREE
    legs = joined.withColumn("leg_m", F.coalesce(G.hypot(dx, dy), F.lit(0.0)))
    totals = legs.groupBy("path_id", "chunk").agg(F.sum("leg_m").alias("chunk_m"))
    offsets = totals.select("path_id", "chunk", (F.sum("chunk_m").over(before) - F.col("chunk_m")).alias("offset_m"))
    out = legs.join(offsets, ["path_id", "chunk"]).withColumn("length_m", F.col("offset_m") + F.sum("leg_m").over(w))
    return out.select(
        "path_id", "seq", "latitude", "longitude",
        F.col("prev.latitude").alias("prev_latitude"), F.col("prev.longitude").alias("prev_longitude"), "leg_m", "length_m",
    )


def path_positions(lengths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point at a distance along a path: wanted (path_id, distance_m), clamped to the path.

    Legs and distances meet on (path, kilometre bucket), so a long path never pairs every leg
    with every wanted distance.
    """
    ends = lengths.groupBy("path_id").agg(F.max("length_m").alias("total_m"))
    legs = lengths.where(F.col("leg_m") > 0).withColumn("start_m", F.col("length_m") - F.col("leg_m"))
    legs = legs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_m") / BUCKET_METRES), F.floor(F.col("length_m") / BUCKET_METRES))))
    asked = wanted.join(ends, "path_id").withColumn("d", F.least(F.greatest(F.col("distance_m"), F.lit(0.0)), F.col("total_m")))
    asked = asked.withColumn("bucket", F.floor(F.col("d") / BUCKET_METRES))
    d = F.col("d")
    hits = asked.join(legs.withColumnRenamed("path_id", "leg_path"), (F.col("path_id") == F.col("leg_path")) & (asked["bucket"] == legs["bucket"]) & d.between(F.col("start_m"), F.col("length_m")))
    # a distance on a shared vertex touches two legs; the later one wins
    best = hits.groupBy("path_id", "distance_m").agg(
        F.max_by(F.struct("seq", "d", "start_m", "leg_m", "latitude", "longitude", "prev_latitude", "prev_longitude"), "seq").alias("h")
    )
    share = (F.col("h.d") - F.col("h.start_m")) / F.col("h.leg_m")
    return best.select(
        "path_id", "distance_m", F.col("h.seq").alias("seq"),
        (F.col("h.prev_latitude") + (F.col("h.latitude") - F.col("h.prev_latitude")) * share).alias("latitude"),
        (F.col("h.prev_longitude") + (F.col("h.longitude") - F.col("h.prev_longitude")) * share).alias("longitude"),
    )
