"""Spatial operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wastelake.catalog.book import Book
from wastelake.catalog.views import LON_SCALE
from wastelake.functions import geo as G
from wastelake.operators import allocation as AL, spatial as O
from wastelake.sources import tables as S

BOOK = Book()
BOX = (25.2, 54.7, 25.2005, 54.7003)
IN_POLYGON = "longitude >= x0 and longitude < x1 and latitude >= y0 and latitude < y1 and not (holed and longitude >= hx0 and longitude < hx1 and latitude >= hy0 and latitude < hy1)"
COVERED = "longitude between x0 and x1 and latitude between y0 and y1 and not (holed and longitude > hx0 and longitude < hx1 and latitude > hy0 and latitude < hy1)"

EDGES = {
    "corners": """select id, unnest([x0, x1, x1, x0]) as ax, unnest([y0, y0, y1, y1]) as ay, unnest([x1, x1, x0, x0]) as bx, unnest([y0, y1, y1, y0]) as bY, unnest([1,2,3,4]) as k from cells""",
    "centroids": """select c.id, sx / (3 * a2) as cx, sy / (3 * a2) as cy from (
        select id, ((c1 + c2) + c3) + c4 as a2, (((x0 + x1) * c1 + (x1 + x1) * c2) + (x1 + x0) * c3) + (x0 + x0) * c4 as sx,
          (((y0 + y0) * c1 + (y0 + y1) * c2) + (y1 + y1) * c3) + (y1 + y0) * c4 as sy from (
          select *, x0 * y0 - x1 * y0 as c1, x1 * y1 - x1 * y0 as c2, x1 * y1 - x0 * y1 as c3, x0 * y0 - x0 * y1 as c4 from cells)) c""",
}


@BOOK.add("project_metres", f"select id, round(longitude * {LON_SCALE}, 3) as x, round(latitude * 111320.0::double, 3) as y from sites", digits=3)
def _(spark, sf):
    return S.sites(spark, sf).select("id", G.project_x(F.col("longitude")).alias("x"), G.project_y(F.col("latitude")).alias("y"))


@BOOK.add("polygon_envelope", "select id, round(x0, 6) as min_lon, round(y0, 6) as min_lat, round(x1, 6) as max_lon, round(y1, 6) as max_lat from cells")
def _(spark, sf):
    return O.with_envelope(S.cells(spark, sf)).select("id", "min_lon", "min_lat", "max_lon", "max_lat")


@BOOK.add("polygon_centroid", "select id, round(cx, 6) as lon, round(cy, 6) as lat from centroids", **EDGES)
def _(spark, sf):
    return O.with_centroid(S.cells(spark, sf)).select("id", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat"))


@BOOK.add("polygon_checks", """
    select case id % 7 when 1 then 'unclosed' when 2 then 'too_few_positions' when 3 then 'zero_area' when 4 then 'self_crossing' when 5 then 'invalid_position' else 'valid' end as problem, count(*) as polygons
    from cells group by 1""")
def _(spark, sf):
    ring = F.element_at("rings", 1)
    p = [F.element_at(ring, i) for i in range(1, 5)]
    broken = (
        F.when(F.col("id") % 7 == 1, F.array(F.array(*p, p[1])))
        .when(F.col("id") % 7 == 2, F.array(F.array(p[0], p[1], p[0])))
        .when(F.col("id") % 7 == 3, F.array(F.array(p[0], F.array(p[0][0] + 0.001, p[0][1]), F.array(p[0][0] + 0.002, p[0][1]), p[0])))
        .when(F.col("id") % 7 == 4, F.array(F.array(p[0], p[2], p[1], F.array(p[0][0] - 0.001, p[2][1] + 0.001), p[0])))
        .when(F.col("id") % 7 == 5, F.array(F.array(p[0], F.array(F.lit(200.0), p[1][1]), p[2], p[0])))
        .otherwise(F.col("rings"))
    )
    checked = O.checked(S.cells(spark, sf).withColumn("rings", broken))
    return checked.groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("polygons"))


@BOOK.add("layer_problems", """
    with f as (select case when id % 13 = 0 then 1 else id end as id, case when id % 11 = 0 then ' ' when id % 5 = 0 then 'again' else 'cell ' || id end as name from cells)
    select 'blank_name' as rule, count(*) as features from f where trim(name) = '' union all select 'duplicate_id', coalesce(sum(n), 0)::bigint from (select count(*) as n from f group by id having count(*) > 1)
    union all select 'duplicate_name', coalesce(sum(n), 0)::bigint from (select count(*) as n from f group by name having count(*) > 1) union all select unnest(['invalid_id', 'broken_polygon', 'no_features']), 0""")
def _(spark, sf):
    i = F.col("id")
    name = F.when(i % 11 == 0, " ").when(i % 5 == 0, "again").otherwise(F.concat(F.lit("cell "), i.cast("string")))
    return O.layer_problems(O.checked(S.cells(spark, sf)).withColumn("name", name).withColumn("id", F.when(i % 13 == 0, 1).otherwise(i)))


@BOOK.add("point_in_polygon", f"select b.id, m.polygon_id, coalesce(m.matches, 0) as matches from bins b left join (select b.id, min(c.id) as polygon_id, count(*) as matches from bins b join cells c on {IN_POLYGON} group by b.id) m on m.id = b.id")
def _(spark, sf):
    return O.membership(S.bins(spark, sf), S.cells(spark, sf))


@BOOK.add("point_covered_by", f"select b.id, m.polygon_id, coalesce(m.matches, 0) as matches from bins b left join (select b.id, min(c.id) as polygon_id, count(*) as matches from bins b join cells c on {COVERED} group by b.id) m on m.id = b.id")
def _(spark, sf):
    return O.membership(S.bins(spark, sf), S.cells(spark, sf), boundary=True)


@BOOK.add("polygon_intersects_bbox", """
    select 'wide' as box, id from cells where x0 <= 25.3 and x1 >= 25.1 and y0 <= 54.75 and y1 >= 54.65
    union all select 'tiny', id from cells where x0 <= 25.2005 and x1 >= 25.2 and y0 <= 54.7003 and y1 >= 54.7 and not (holed and hx0 < 25.2 and hx1 > 25.2005 and hy0 < 54.7 and hy1 > 54.7003)""")
def _(spark, sf):
    cells = S.cells(spark, sf)
    wide = O.intersecting(cells, (25.1, 54.65, 25.3, 54.75)).select(F.lit("wide").alias("box"), "id")
    return wide.unionByName(O.intersecting(cells, BOX).select(F.lit("tiny").alias("box"), "id"))


NEAREST = f"""
    select s.id as source_id, p.kind, arg_min(p.point_id, {{'d': sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 'i': p.point_id}}) as point_id,
      round(min(sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y))), 4) as distance_m
    from (select id, clon * {LON_SCALE} as x, clat * 111320.0::double as y from cells) s,
      (select min(id) as point_id, waste_type as kind, longitude * {LON_SCALE} as x, latitude * 111320.0::double as y from bins group by waste_type, latitude, longitude) p
    group by 1, 2"""


@BOOK.add("nearest_point", NEAREST, digits=4)
def _(spark, sf):
    points = S.bins(spark, sf).groupBy(F.col("waste_type").alias("kind"), "latitude", "longitude").agg(F.min("id").alias("point_id"))
    points = points.select("point_id", "kind", G.project_x(F.col("longitude")).alias("x"), G.project_y(F.col("latitude")).alias("y"))
    ring = F.element_at("rings", 1)
    from wastelake.sources.tables import lat_of, lon_of

    sources = S.cells(spark, sf).select(
        F.col("id").alias("source_id"), G.project_x(lon_of("plon", F.col("id"))).alias("x"), G.project_y(lat_of("plat", F.col("id"))).alias("y"),
        F.explode(F.array(*[F.lit(w) for w in ("Mixed municipal waste", "Paper/plastic waste", "Glass waste", "Food/organic waste")])).alias("kind"),
    )
    return O.nearest_point(sources, points)


HAV = "2 * {r}::double * asin(sqrt(least(1.0::double, greatest(0.0::double, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))))"


@BOOK.add("haversine_topk", f"""
    select id, round({HAV.format(r='6371008.8', a='54.7::double', b='latitude', c='25.25::double', d='longitude')}, 3) as distance_metres from sites
    order by 2, id limit 10""", digits=3)
def _(spark, sf):
    from wastelake.operators.area import nearest_facilities

    return nearest_facilities(S.sites(spark, sf), 54.7, 25.25, 10).select("id", "distance_metres")


MX = "((longitude + 180.0::double) / 360.0::double)"
MY = "((1.0::double - ln(tan(radians(latitude)) + sqrt(tan(radians(latitude)) * tan(radians(latitude)) + 1.0::double)) / pi()) / 2.0::double)"


@BOOK.add("tile_key", f"select id, floor({MX} * 16384)::bigint as tile_x, floor({MY} * 16384)::bigint as tile_y from sites")
def _(spark, sf):
    return O.with_tile(S.sites(spark, sf), 14).select("id", "tile_x", "tile_y")


@BOOK.add("tile_to_lonlat", """
    select x, y, px, round((x + px / 4096.0::double) / 4096.0::double * 360 - 180, 6) as lon,
      round(degrees(atan(sinh(pi() * (1 - 2 * (y + (4096 - px * 100) / 4096.0::double) / 4096.0::double)))), 6) as lat, count(*) as n
    from (select l_suppkey % 4096 as x, l_partkey % 4096 as y, l_linenumber as px from lineitem) group by 1, 2, 3""")
def _(spark, sf):
    x, y, p = F.col("l_suppkey") % 4096, F.col("l_partkey") % 4096, F.col("l_linenumber")
    rows = S.table(spark, sf, "lineitem").groupBy(x.alias("x"), y.alias("y"), p.alias("px")).agg(F.count("*").alias("n"))
    return rows.select("x", "y", "px", G.tile_lon(F.col("x"), F.col("px"), 12, 4096.0).alias("lon"), G.tile_lat(F.col("y"), F.col("px") * 100, 12, 4096.0).alias("lat"), "n")


@BOOK.add("tile_cover", """
    select id, tx as tile_x, ty as tile_y from (
      select id, unnest(generate_series(x1, x2)) as tx, y1, y2 from (
        select id, floor((x0 + 180.0) / 360.0 * 16384)::bigint as x1, floor((x1 + 180.0) / 360.0 * 16384)::bigint as x2,
          floor((1.0::double - ln(tan(radians(y1)) + sqrt(tan(radians(y1)) * tan(radians(y1)) + 1.0::double)) / pi()) / 2 * 16384)::bigint as y1,
          floor((1.0::double - ln(tan(radians(y0)) + sqrt(tan(radians(y0)) * tan(radians(y0)) + 1.0::double)) / pi()) / 2 * 16384)::bigint as y2 from cells)) a,
      lateral (select unnest(generate_series(y1, y2)) as ty)""")
def _(spark, sf):
    boxes = O.with_envelope(S.cells(spark, sf)).select("id", F.col("min_lon").alias("west"), F.col("min_lat").alias("south"), F.col("max_lon").alias("east"), F.col("max_lat").alias("north"))
    return O.tile_cover(boxes, 14).select("id", "tile_x", "tile_y")


@BOOK.add("tile_cluster", f"select floor({MX} * 2048)::bigint as tile_x, floor({MY} * 2048)::bigint as tile_y, count(*) as points, round(avg({MX}), 9) as mean_x, round(avg({MY}), 9) as mean_y from bins group by 1, 2", digits=9)
def _(spark, sf):
    return O.tile_clusters(S.bins(spark, sf), 11)


PATHS = {
    "verts": "select id // 40 as path_id, id % 40 as seq, latitude, longitude from sites",
    "legs": """select *, coalesce(sqrt(pow((longitude - plon) * cos(radians((latitude + plat) / 2)) * 111320, 2) + pow((latitude - plat) * 111320, 2)), 0) as leg_m from (
        select *, lag(latitude) over w as plat, lag(longitude) over w as plon from verts window w as (partition by path_id order by seq))""",
    "lens": "select *, sum(leg_m) over (partition by path_id order by seq) as length_m from legs",
}


def vertices(spark, sf):
    return S.sites(spark, sf).select(F.expr("id div 40").alias("path_id"), (F.col("id") % 40).alias("seq"), "latitude", "longitude")


@BOOK.add("path_length", "select path_id, seq, round(leg_m, 4) as leg_m, round(length_m, 4) as length_m from lens", digits=4, **PATHS)
def _(spark, sf):
    return O.path_lengths(vertices(spark, sf)).select("path_id", "seq", "leg_m", "length_m")


@BOOK.add("path_position", """
    select w.path_id, w.distance_m, seq, round(plat + (latitude - plat) * (d - (length_m - leg_m)) / leg_m, 6) as latitude, round(plon + (longitude - plon) * (d - (length_m - leg_m)) / leg_m, 6) as longitude
    from (select *, least(distance_m, total) as d from (select path_id, (k * 37000)::double as distance_m, total from (select path_id, max(length_m) as total from lens group by 1) t, (select unnest(generate_series(0, 40)) as k))) w
    join lens l on l.path_id = w.path_id and leg_m > 0 and d >= length_m - leg_m and (d < length_m or (d = total and length_m = total))""", **PATHS)
def _(spark, sf):
    lengths = O.path_lengths(vertices(spark, sf))
    wanted = vertices(spark, sf).select("path_id").distinct().select("path_id", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"))
    return O.path_positions(lengths, wanted.select("path_id", (F.col("k") * 37000.0).alias("distance_m")))
