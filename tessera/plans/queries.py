"""Registered queries of the geospatial operators, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import mercator, morton, style
from tessera.functions.style import Style
from tessera.operators import dataset, encoders, pyramid, raster, shapes, tiles
from tessera.operators.features import as_rows, line_features, point_features
from tessera.plans import fixtures as fx
from tessera.plans import render
from tessera.plans.fixtures import with_
from tessera.sources import text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6) + F.lit(0.0)


WORLD = "4294967296.0::double"
#: Tiles of the city at zoom 11 and 13, found from its corner places.
CITY_Z = 11
CITY_TILES = [(CITY_Z, 327, 791), (CITY_Z, 327, 792)]
_TILE_VALUES = ", ".join(f"({z}, {x}, {y})" for z, x, y in CITY_TILES)
LAT = "degrees(atan((exp(pi()*(1-2*({y})/{n}))-exp(-pi()*(1-2*({y})/{n})))/2))"


def lat_sql(y: str, n: str = WORLD) -> str:
    return LAT.format(y=y, n=n)


def lon_sql(x: str, n: str = WORLD) -> str:
    return f"(360.0::double*({x})/{n} - 180.0)"


# ---- text ---------------------------------------------------------------

_LINE_KEYS = "l_orderkey, l_linenumber, cast(l_quantity as bigint) q, {a} % 1600001 - 800000 a, {b} % 3590001 - 1795000 b".format(a=fx.LAT, b=fx.LON)


def _decimal(n: str) -> str:
    """Exact text of n / 10000 from integers."""
    return f"concat(case when {n} < 0 then '-' else '' end, cast(abs({n}) DIV 10000 as string), '.', lpad(cast(abs({n}) % 10000 as string), 4, '0'))"


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one or two points, metas of several forms, comments, and
    lines without any point."""
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity as bigint) q", f"{fx.LAT} % 1600001 - 800000 a", f"{fx.LON} % 3590001 - 1795000 b")
    point = f"concat({_decimal('a')}, ',', {_decimal('b')})"
    line = f"case l_linenumber % 4 when 0 then concat(':', q) when 1 then concat({point}, ' :', q, ' // note 1,2') when 2 then concat(' ', {point}, '  ', {point}, ' 4:3 4:', q % 16) else concat({point}, ' x ', {point}) end"
    return rows.selectExpr("l_orderkey", "l_linenumber", f"{line} as value")


@query(f"""select l_orderkey, l_linenumber, case when l_linenumber % 4 = 2 then 2 else 1 end as n, round(a/10000.0::double, 4) as lat, round(b/10000.0::double, 4) as lon,
case l_linenumber % 4 when 1 then q when 2 then 48 + q % 16 else 0 end as meta from (select {_LINE_KEYS} from lineitem) where l_linenumber % 4 <> 0""")
def parse_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.element_at("verts", -1)
    return text.parse_shapes(text_lines(spark, sf_dir), 8).select("l_orderkey", "l_linenumber", F.col("n").cast("int").alias("n"), F.round(last["lat"], 4).alias("lat"), F.round(last["lon"], 4).alias("lon"), "meta")


_MOVED = "l_orderkey, l_linenumber, cast(l_quantity as bigint) q, {a} % 1600001 - 800000 + case when l_linenumber % 3 = 0 then 70000 else 0 end a, ({b} % 3590001 - 1795000) * case when l_linenumber % 5 = 0 then 2 else 1 end b".format(a=fx.LAT, b=fx.LON)


@query(f"select l_orderkey, l_linenumber, a between -850511 and 850511 and b between -1799999 and 1799999 as valid, q > 31 as overflow, q % 32 as kept from (select {_MOVED} from lineitem)")
def validate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two points, the first of which may be out of range, and metas
    that may not fit into five bits."""
    rows = fx.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_MOVED_COLUMNS)
    lines = rows.selectExpr("l_orderkey", "l_linenumber", f"concat({_decimal('a')}, ',', {_decimal('b')}, ' 0,0 :', q) as value")
    return text.parse_shapes(lines, 5).select("l_orderkey", "l_linenumber", text.valid_shapes().alias("valid"), "overflow", F.col("meta").alias("kept"))


_MOVED_COLUMNS = ["cast(l_quantity as bigint) q", f"{fx.LAT} % 1600001 - 800000 + case when l_linenumber % 3 = 0 then 70000 else 0 end a", f"({fx.LON} % 3590001 - 1795000) * case when l_linenumber % 5 = 0 then 2 else 1 end b"]


# ---- scalar functions ------------------------------------------------------


@query(f"{with_('pts')} select orderkey, linenumber, x, y from pts")
def project_world(spark, sf_dir):
    return fx.points(spark, sf_dir).select("orderkey", "linenumber", "x", "y")


@query(f"{with_('pts')} select orderkey, linenumber, round({lat_sql('y')}, 6) as lat, round({lon_sql('x')}, 6) as lon from pts")
def unproject_world(spark, sf_dir):
    lat, lon = mercator.unproject(F.col("x"), F.col("y"))
    return fx.points(spark, sf_dir).select("orderkey", "linenumber", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"{with_('city')} select orderkey, linenumber, x//2097152 as tx, y//2097152 as ty, (x - (x//2097152)*2097152)/2097152.0::double as fx, (y - (y//2097152)*2097152)/2097152.0::double as fy from city")
def tile_fraction(spark, sf_dir):
    p = fx.points(spark, sf_dir, "city").withColumns({"tx": mercator.tile_of(F.col("x"), F.lit(11)), "ty": mercator.tile_of(F.col("y"), F.lit(11))})
    return p.select("orderkey", "linenumber", "tx", "ty", mercator.fraction(F.col("x"), F.col("tx"), 11).alias("fx"), mercator.fraction(F.col("y"), F.col("ty"), 11).alias("fy"))


_KEY = "cast(list_sum([cast(((({x}) // cast(pow(2, i) as bigint)) % 2) as hugeint) * cast(pow(4, i) as hugeint) + cast(((({y}) // cast(pow(2, i) as bigint)) % 2) as hugeint) * cast(2 * pow(4, i) as hugeint) for i in range(32)]) - 9223372036854775808 as bigint)"


def key_sql(x: str = "x", y: str = "y") -> str:
    return _KEY.format(x=x, y=y)


@query(f"{with_('pts')} select orderkey, linenumber, {key_sql()} as qkey, x as back_x, y as back_y from pts")
def morton_key(spark, sf_dir):
    p = fx.points(spark, sf_dir).withColumn("qkey", morton.key(F.col("x"), F.col("y")))
    bx, by = morton.decode(F.col("qkey"))
    return p.select("orderkey", "linenumber", "qkey", bx.alias("back_x"), by.alias("back_y"))


_TRK = "trk as (select user_id, list(x order by ts, event_id) as xs, list(y order by ts, event_id) as ys from tp group by user_id)"
_LEVEL = "least(24, 32 - case when d = 0 then 0 else length(bin(d)) end)"
_LEVELS = f"lv as (select user_id, legs, {_LEVEL} as level from (select tp.user_id, count(*) as legs, bit_or(xor(x, x0) | xor(y, y0)) as d from tp join (select user_id, arg_min(x, (ts, event_id)) as x0, arg_min(y, (ts, event_id)) as y0 from tp group by user_id) f on tp.user_id = f.user_id group by tp.user_id))"
_PAIRS = f"pr as (select user_id, seq, case when x0 = x1 and y0 = y1 then 24 else least(24, 32 - length(bin(xor(x0, x1) | xor(y0, y1)))) end as level from seg)"


def _pair_shapes(spark, sf_dir) -> DataFrame:
    """Every track segment as a line of two vertices."""
    s = fx.track_segments(spark, sf_dir)
    vert = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    return s.select("user_id", "seq", F.array(vert(0), vert(1)).alias("verts"), (F.col("user_id") % 7).alias("meta"))


@query(f"{with_('tp', 'seg')[:-1]}, {_LEVELS}, {_PAIRS} select user_id, cast(-1 as bigint) as seq, cast(level as int) as level from lv union all select user_id, seq, cast(level as int) from pr")
def record_level(spark, sf_dir):
    whole = fx.tracks(spark, sf_dir).select("user_id", F.lit(-1).cast("long").alias("seq"), "verts")
    both = whole.unionByName(_pair_shapes(spark, sf_dir).select("user_id", F.col("seq").cast("long").alias("seq"), "verts"))
    return both.select("user_id", "seq", shapes.level(F.col("verts")).alias("level"))


@query(f"{with_('tp', 'seg')[:-1]}, {_LEVELS} select user_id, cast(legs as int) as legs, cast(level as int) as level, cast(ceil((48 + 8 + (48 - 2*level)*(legs - 1))/8.0) as bigint) as bytes from lv")
def record_bytes(spark, sf_dir):
    t = fx.tracks(spark, sf_dir).select("user_id", F.size("verts").alias("legs"), shapes.level(F.col("verts")).alias("level"))
    return t.withColumn("bytes", shapes.record_bytes(F.col("legs"), F.col("level"), 48, 8))


@query(f"{with_('tp', 'seg')[:-1]}, {_LEVELS} select cast(legs as int) as legs, cast(level as int) as level, count(*) as records, max(max(legs)) over () as maxn from lv group by legs, level")
def partition_inventory(spark, sf_dir):
    """Records of each (legs, level) of stored tracks, and the largest legs
    that the data set's properties tell."""
    ds = fx.stored(spark, sf_dir, "tracks", lambda: fx.tracks(spark, sf_dir).select("verts", "meta"))
    return dataset.inventory(ds.shapes).withColumn("maxn", F.lit(ds.maxn).cast("long"))


# ---- index, union ------------------------------------------------------------

_RANKED = f"rk as (select qkey, meta, x, y, row_number() over (order by qkey, meta) - 1 as rank from (select {key_sql()} as qkey, meta, x, y from cut))"


def _ranked(spark, sf_dir) -> DataFrame:
    return dataset.ranked(fx.keyed_points(spark, sf_dir).select("qkey", "meta", "x", "y"))


@query(f"{with_('city', 'cut')[:-1]}, {_RANKED} select qkey, meta, rank from rk")
def index_sorted_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("qkey", "meta", "rank")


@query(f"{with_('city', 'cut')[:-1]}, {_RANKED} select qkey, meta, rank from rk where rank % 16 = 0")
def lod_sample(spark, sf_dir):
    look = style.point_look(Style(), 9)
    return tiles.sampled(_ranked(spark, sf_dir), look.step).select("qkey", "meta", "rank")


def _halves(spark, sf_dir) -> list[DataFrame]:
    p = fx.keyed_points(spark, sf_dir).select("linenumber", "qkey", "x", "y", F.expr("meta % 3").alias("meta"))
    rows = p.select("linenumber", "qkey", F.array(F.struct("x", "y")).alias("verts"), "meta")
    return [rows.where("linenumber <= 4").drop("linenumber"), rows.where("linenumber >= 3").drop("linenumber")]


_HALVES = "a as (select x, y, meta % 3 as meta from cut where linenumber <= 4), b as (select x, y, meta % 3 as meta from cut where linenumber >= 3)"


@query(f"{with_('city', 'cut')[:-1]}, {_HALVES} select x, y, meta from a union all select x, y, meta from b")
def union_all(spark, sf_dir):
    return dataset.overlay(*_halves(spark, sf_dir)).select(F.col("verts")[0]["x"].alias("x"), F.col("verts")[0]["y"].alias("y"), "meta")


@query(f"{with_('city', 'cut')[:-1]}, {_HALVES} select x, y, meta from a union select x, y, meta from b")
def union_distinct(spark, sf_dir):
    rows = dataset.distinct(dataset.overlay(*_halves(spark, sf_dir)))
    return rows.select(F.col("verts")[0]["x"].alias("x"), F.col("verts")[0]["y"].alias("y"), "meta")


# ---- pyramid ------------------------------------------------------------------

_ZOOM = "cast(z as int) as z, x // cast(pow(2, 32 - z) as bigint) as x, y // cast(pow(2, 32 - z) as bigint) as y"


@query(f"{with_('pts')} select {_ZOOM}, count(*) as count from pts, range(15) r(z) group by all")
def tile_pyramid(spark, sf_dir):
    return pyramid.pyramid(fx.points(spark, sf_dir), 14)


@query(f"{with_('pts')} select z, x, y, count, round({lat_sql('sy')}, 6) as lat, round({lon_sql('sx')}, 6) as lon from (select cast(r.z as int) as z, p.x // cast(pow(2, 32 - r.z) as bigint) as x, p.y // cast(pow(2, 32 - r.z) as bigint) as y, count(*) as count, cast(sum(p.x) // count(*) as bigint) as sx, cast(sum(p.y) // count(*) as bigint) as sy from pts p, range(9) r(z) group by 1, 2, 3)")
def tile_centroid(spark, sf_dir):
    return pyramid.centroids(fx.points(spark, sf_dir), 8).select("z", "x", "y", "count", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"{with_('pts')} select {_ZOOM}, count(*) as count from pts, range(3, 9) r(z) where x between 1000000000 and 2500000000 and y between 900000000 and 2000000000 group by all")
def tile_bbox_pyramid(spark, sf_dir):
    return pyramid.pyramid(pyramid.in_bbox(fx.points(spark, sf_dir), (1000000000, 900000000), (2500000000, 2000000000)), 8, 3)


_DIST = "sqrt(cast(x1-x0 as double)*(x1-x0) + cast(y1-y0 as double)*(y1-y0))"


@query(f"{with_('tp', 'seg')} select z, x, y, count, round(len, 6) as len from (select cast(r.z as int) as z, f.x // cast(pow(2, 32 - r.z) as bigint) as x, f.y // cast(pow(2, 32 - r.z) as bigint) as y, count(*) as count, sum(f.len) / pow(2.0, 32 - r.z) as len from (select user_id, arg_min(x0, seq) as x, arg_min(y0, seq) as y, sum(case when d < 400000 then d else 0 end) as len from (select *, {_DIST} as d from seg) group by user_id) f, range(15) r(z) group by r.z, 2, 3)")
def tile_lengths(spark, sf_dir):
    got = pyramid.lengths(fx.track_segments(spark, sf_dir), "user_id", 14, longest=400000.0)
    return got.select("z", "x", "y", "count", F.round("len", 6).alias("len"))


_REAL = f"t as (select {_ZOOM}, count(*) as count from city, range(15) r(z) group by all)"


@query(f"{with_('city')[:-1]}, {_REAL}, p as (select distinct z, x // 2 as px, y // 2 as py from t where z > 0), c as (select z, 2*px + dx as x, 2*py + dy as y from p, range(2) a(dx), range(2) b(dy)) select z, x, y, count from t union all select z, x, y, 0 from (select z, x, y from c except select z, x, y from t)")
def tile_siblings(spark, sf_dir):
    return pyramid.with_siblings(pyramid.pyramid(fx.points(spark, sf_dir, "city"), 14))


@query(f"{with_('city')[:-1]}, {_REAL} select concat_ws(' ', 'city', z, x, y, count) as value from t")
def tile_listing(spark, sf_dir):
    return pyramid.listing(pyramid.pyramid(fx.points(spark, sf_dir, "city"), 14), "city")


# ---- tiles --------------------------------------------------------------------


@query(f"{with_('city', 'cut')} select orderkey, linenumber, meta from cut where x // 524288 = 1309 and y // 524288 = 3166 and meta <= 30")
def tile_points(spark, sf_dir):
    rows = tiles.tile_points(fx.keyed_points(spark, sf_dir), 13, 1309, 3166)
    return rows.where("meta <= 30").select("orderkey", "linenumber", "meta")


@query(f"{with_('pts')} select cast(t.z as int) as z, t.x as tx, t.y as ty, orderkey, linenumber from pts p join (select distinct r.z as z, q.x // cast(pow(2, 32 - r.z) as bigint) as x, q.y // cast(pow(2, 32 - r.z) as bigint) as y from pts q, (values (5), (7)) r(z)) t on p.x // cast(pow(2, 32 - t.z) as bigint) = t.x and p.y // cast(pow(2, 32 - t.z) as bigint) = t.y")
def points_of_tiles(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    listed = pyramid.pyramid(p, 7, 5).where("z <> 6").select("z", "x", "y")
    return tiles.points_of_tiles(p, listed, [5, 7]).select("z", "tx", "ty", "orderkey", "linenumber")


_TILE_LIST = "tl(z, x, y) as (values (11, 327, 791), (11, 327, 792), (12, 654, 1583), (13, 1309, 3166), (14, 2618, 6333))"


def _meets(x0: str, y0: str, x1: str, y1: str) -> str:
    """SQL: the segment meets the unit square."""
    t = lambda v, a, d: f"(({v}) - ({a})) / nullif({d}, 0)"
    dx, dy = f"(({x1}) - ({x0}))", f"(({y1}) - ({y0}))"
    lo = f"greatest(0, coalesce(least({t(0, x0, dx)}, {t(1, x0, dx)}), 0), coalesce(least({t(0, y0, dy)}, {t(1, y0, dy)}), 0))"
    hi = f"least(1, coalesce(greatest({t(0, x0, dx)}, {t(1, x0, dx)}), 1), coalesce(greatest({t(0, y0, dy)}, {t(1, y0, dy)}), 1))"
    return f"({lo} <= {hi} and ({dx} <> 0 or ({x0}) between 0 and 1) and ({dy} <> 0 or ({y0}) between 0 and 1))"


@query(f"{with_('tp', 'seg')[:-1]}, {_TILE_LIST} select z, cast(x as bigint) as x, cast(y as bigint) as y, user_id, seq from (select tl.z, tl.x, tl.y, user_id, seq, x0/pow(2.0, 32-tl.z) - tl.x as a, y0/pow(2.0, 32-tl.z) - tl.y as b, x1/pow(2.0, 32-tl.z) - tl.x as c, y1/pow(2.0, 32-tl.z) - tl.y as d from seg, tl) where {_meets('a', 'b', 'c', 'd')}")
def tile_lines(spark, sf_dir):
    listed = tiles.listed(spark, [(11, 327, 791), (11, 327, 792), (12, 654, 1583), (13, 1309, 3166), (14, 2618, 6333)])
    lines = _pair_shapes(spark, sf_dir).withColumn("level", shapes.level(F.col("verts"), 64)).withColumn("legs", F.lit(2))
    return tiles.lines_of_tiles(lines, listed, mapbits=64).select("z", "x", "y", "user_id", F.col("seq").cast("long").alias("seq"))


@query(f"{with_('city')} select orderkey, linenumber, meta from city where meta <= 25")
def meta_filter(spark, sf_dir):
    return style.drawn_metas(fx.points(spark, sf_dir, "city"), Style(max_meta=25)).select("orderkey", "linenumber", "meta")


# ---- dumps --------------------------------------------------------------------

_HEX = "printf('%08x %08x ', x, y)"
_VERT_STRINGS = f"vs as (select user_id, seq, printf('%.6f,%.6f ', {lat_sql('y0')}, {lon_sql('x0')}) as p0, printf('%.6f,%.6f ', {lat_sql('y1')}, {lon_sql('x1')}) as p1, printf('%08x %08x %08x %08x ', x0, y0, x1, y1) as h, x0, y0, x1, y1 from seg)"


@query(f"{with_('tp', 'seg')[:-1]}, {_VERT_STRINGS} select user_id, seq, concat(p0, p1, '8:', user_id % 7, ' // ', h) as line from vs")
def dump_text(spark, sf_dir):
    return _pair_shapes(spark, sf_dir).select("user_id", F.col("seq").cast("long").alias("seq"), text.dump_text(F.col("verts"), F.col("meta"), 8).alias("line"))


@query(f"""{with_('tp', 'seg')} select user_id, seq, concat('{{ "type": "Feature", "properties": {{ "meta": ', user_id % 7, ' }}, "geometry": {{ "type": "LineString", "coordinates": [ ', printf('[ %.6f, %.6f ], [ %.6f, %.6f ]', {lon_sql('x0')}, {lat_sql('y0')}, {lon_sql('x1')}, {lat_sql('y1')}), ' ] }} }}') as feature from seg""")
def dump_geojson(spark, sf_dir):
    return _pair_shapes(spark, sf_dir).select("user_id", F.col("seq").cast("long").alias("seq"), text.dump_geojson(F.col("verts"), F.col("meta"), 8).alias("feature"))


@query(f"{with_('tp', 'seg')} select user_id, seq, x0, y0, x1, y1, user_id % 7 as meta from seg")
def dump_round_trip(spark, sf_dir):
    back = text.read_dump(dump_text(spark, sf_dir), line_col="line")
    place = [F.col("verts")[k][c].alias(f"{c}{k}") for k in (0, 1) for c in "xy"]
    return back.select("user_id", "seq", *place, "meta")


# ---- style --------------------------------------------------------------------

_HUE = "(cast(meta as double) - 10)/(40 - 10)*(480 - (-800)) + (-800)"


@query(f"{with_('city')} select orderkey, linenumber, round(case when h < -2 then -1.0 when h between 0 and 1 then h when h > 0 and h = floor(h) then 1.0 else h - floor(h) end, 6) as hue from (select *, ({_HUE})/360 as h from city)")
def hue_map(spark, sf_dir):
    return fx.points(spark, sf_dir, "city").select("orderkey", "linenumber", F.round(style.hue(F.col("meta").cast("double"), 10, -800, 40, 480), 6).alias("hue"))


def _zoom_values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


@query("select z::int as z, round(case when z > 13 then 1 else floor(pow(2.0, 13 - z) + 0.5) end, 6) as step, round(case when z > 13 then pow(2.0, z - 13) else 1 end, 6) as brush, round(0.05917 * pow(1.23, z - 13) * case when z > 13 then 1 else floor(pow(2.0, 13 - z) + 0.5) / pow(2.0, 13 - z) end, 9) as bright from range(19) r(z)")
def point_brightness(spark, sf_dir):
    rows = [(z, float(p.step), p.brush, p.bright) for z in range(19) for p in [style.point_look(Style(), z)]]
    return spark.createDataFrame(rows, "z int, step double, brush double, bright double").select("z", "step", "brush", F.round("bright", 9).alias("bright"))


@query("select z::int as z, round(0.05917 * 6.64 / 2 * pow(1.23 / 1.1, z - 13), 9) as bright, round(2 * pow(1.1, z - 13), 9) as thick from range(19) r(z)")
def line_brightness(spark, sf_dir):
    rows = [(z, *style.line_look(Style(line_thick=2, line_ramp=1.1), z)) for z in range(19)]
    return spark.createDataFrame(rows, "z int, bright double, thick double").select("z", F.round("bright", 9).alias("bright"), F.round("thick", 9).alias("thick"))


@query(f"{with_('city')} select orderkey, linenumber, meta * 0.05917::double as bright, meta * 2.0::double as brush from city")
def meta_scaling(spark, sf_dir):
    return fx.points(spark, sf_dir, "city").select("orderkey", "linenumber", style.by_meta(F.lit(0.05917), F.col("meta"), True).alias("bright"), style.by_meta(F.lit(2.0), F.col("meta"), True).alias("brush"))


_LEAST = "(1600 * pow(1.5, 16 - 12))"


@query(f"{with_('tp', 'seg')} select user_id, seq, round(b, 9) as bright from (select user_id, seq, case when d > {_LEAST} then 0.5 / (d / {_LEAST}) else 0.5 end as b from (select *, {_DIST} as d from seg)) where b >= 0.0025")
def gps_dimming(spark, sf_dir):
    s = fx.track_segments(spark, sf_dir)
    dx, dy = ((F.col(f"{c}1") - F.col(f"{c}0")).cast("double") for c in "xy")
    got = s.select("user_id", F.col("seq").cast("long").alias("seq"), style.gps_brightness(F.lit(0.5), dx, dy, 12).alias("bright"))
    return got.where("bright IS NOT NULL").withColumn("bright", F.round("bright", 9))


_WIDE = "w as (select orderkey, linenumber, x as x0, (x * 3 + cast(linenumber as bigint) * 1000000007) % 4294967296 as x1 from pts)"


@query(f"{with_('pts')[:-1]}, {_WIDE} select orderkey, linenumber, x0, x1 from w where abs(x1 - x0) < 2147483648 union all select orderkey, linenumber, x0 + 4294967296, x1 from w where x1 - x0 >= 2147483648 union all select orderkey, linenumber, x0, x1 - 4294967296 from w where x1 - x0 >= 2147483648 union all select orderkey, linenumber, x0, x1 + 4294967296 from w where x1 - x0 <= -2147483648 union all select orderkey, linenumber, x0 - 4294967296, x1 from w where x1 - x0 <= -2147483648")
def antimeridian_split(spark, sf_dir):
    wide = fx.points(spark, sf_dir).select("orderkey", "linenumber", F.col("x").alias("x0"), F.expr("(x * 3 + linenumber * 1000000007L) % 4294967296L").alias("x1"))
    return shapes.split_antimeridian(wide).select("orderkey", "linenumber", "x0", "x1")


def _noise_sql(v: str, other: str) -> str:
    return f"{v} + " + " + ".join(f"(({other} // {2 ** (15 - i)}) % 2) * {2**i}" for i in range(8))


@query(f"{with_('city', 'cut')} select orderkey, linenumber, {_noise_sql('x', 'y')} as x, {_noise_sql('y', 'x')} as y from cut")
def overzoom_noise(spark, sf_dir):
    rows = fx.keyed_points(spark, sf_dir)
    x, y = style.noise(F.col("x"), F.col("y"), 48)
    return rows.select("orderkey", "linenumber", x.alias("x"), y.alias("y"))


@query("select z::int as z, round(0.01 / cos(atan(sinh(pi() * (1 - 2 * (floor(0.37 * pow(2, z)) + 0.5) / pow(2, z))))) , 9) as size from range(15) r(z)".replace("0.01 /", "300 * 0.00000274 * pow(2, z) / 360 /"))
def circle_size(spark, sf_dir):
    rows = [(z, style.cloud_size(300, z, math.floor(0.37 * 2**z))) for z in range(15)]
    return spark.createDataFrame(rows, "z int, size double").withColumn("size", F.round("size", 9))


@query(f"select z::int as z, round(1 - exp(ln(0.5) / (s * exp(ln(0.5) / 0.5))), 6) as opacity, round(2 * sqrt(pow(2.0, greatest(z - 13, 0)) / pi()), 6) as width from (select z, 1 / (0.05917 * pow(1.23, z - 13)) as s from range(23) r(z))")
def zoom_style_table(spark, sf_dir):
    rows = spark.createDataFrame(style.ZoomRules().rows(), "z int, opacity double, width double")
    return rows.select("z", F.round("opacity", 6).alias("opacity"), F.round("width", 6).alias("width"))


# ---- rasters ------------------------------------------------------------------

SIZE = 256
BRIGHT = 0.05917


def city_dots(spark, sf_dir, z: int = CITY_Z, where: str = "city") -> DataFrame:
    """Points with their tile and place in it; hue from meta."""
    p = fx.points(spark, sf_dir, where)
    p = p.withColumns({"wx": F.col("x"), "wy": F.col("y")})
    p = p.withColumns({"z": F.lit(z), "x": mercator.tile_of(F.col("wx"), F.lit(z)), "y": mercator.tile_of(F.col("wy"), F.lit(z))})
    h = style.hue(F.col("meta").cast("double"), 0, 0, 50, 360)
    return p.select("orderkey", "linenumber", "meta", "z", "x", "y", mercator.fraction(F.col("wx"), F.col("x"), z).alias("fx"), mercator.fraction(F.col("wy"), F.col("y"), z).alias("fy"), h.alias("hue"))


def _dots_sql(z: int = CITY_Z, name: str = "dots", where: str = "city") -> str:
    s = 2 ** (32 - z)
    return f"{name} as (select orderkey, linenumber, meta, {z} as z, x//{s} as x, y//{s} as y, (x % {s})/{s}.0::double as fx, (y % {s})/{s}.0::double as fy, meta/50.0::double as hue from {where})"


def _splat_sql(source: str, px: str, py: str, b: str, keys: str, size: int | None = SIZE, extra: str = "") -> str:
    clip = f"where px between 0 and {size - 1} and py between 0 and {size - 1}" if size else ""
    four = f"select {keys}, hue, cast(floor({px}) + i as bigint) as px, cast(floor({py}) + j as bigint) as py, ({b}) * (case i when 1 then ({px}) - floor({px}) else 1 - (({px}) - floor({px})) end) * (case j when 1 then ({py}) - floor({py}) else 1 - (({py}) - floor({py})) end) as b from {source}, range(2) ii(i), range(2) jj(j) {extra}"
    lit = "sum(case when hue >= 0 then b * {f}(2*pi()*hue) else 0 end)"
    return f"acc as (select {keys}, px, py, sum(b) as image, {lit.format(f='cos')} as cx, {lit.format(f='sin')} as cy from ({four}) {clip} group by {keys}, px, py)"


_ACC_OUT = "select z, x, y, px, py, round(image, 6) + 0.0 as image, round(cx, 6) + 0.0 as cx, round(cy, 6) + 0.0 as cy from acc"
_KEYS = "z, x, y"
TILE_KEYS = ["z", "x", "y"]


def _rounded(acc: DataFrame) -> DataFrame:
    return acc.select(*[c for c in acc.columns if c not in ("image", "cx", "cy")], *(r6(c).alias(c) for c in ("image", "cx", "cy")))


def _splatted(spark, sf_dir) -> DataFrame:
    return raster.accumulate(raster.draw_points(city_dots(spark, sf_dir), SIZE, F.lit(BRIGHT)), TILE_KEYS, SIZE)


_SPLAT = f"{with_('city')[:-1]}, {_dots_sql()}, {_splat_sql('dots', 'fx*256 - 0.5', 'fy*256 - 0.5', '0.05917', _KEYS)}"


@query(f"{_SPLAT} {_ACC_OUT}")
def splat_points(spark, sf_dir):
    return _rounded(_splatted(spark, sf_dir))


def _kernel_sql(brush: float, gaussian: bool = False) -> str:
    """The disk in SQL: cells of a ninth of a pixel, column by column, summed
    up per pixel; weights add up to the brush."""
    weight = "exp(-(((c - mid) * (c - mid) + (r - mid) * (r - mid)) / (radius * radius)) / (2.0::double / 9))" if gaussian else "1.0::double"
    base = f"select 9 * sqrt({brush!r}::double / pi()) as radius, cast(ceil(sqrt({brush!r}::double / pi())) as bigint) as w"
    columns = f"select radius, w, (2 * w + 1) * 9 // 2 as mid, unnest(range((2 * w + 1) * 9 // 2 - cast(floor(radius) as bigint), (2 * w + 1) * 9 // 2 + cast(floor(radius) as bigint) + 1)) as c from ({base})"
    cells = f"select *, unnest(range(mid - half, mid + half + 1)) as r from (select *, cast(floor(abs(sin(acos((c - mid) / radius))) * radius) as bigint) as half from ({columns}))"
    return f"(select ki, kj, {brush!r}::double * v / sum(v) over () as kw from (select c // 9 - w as ki, r // 9 - w as kj, sum({weight}) as v from ({cells}) group by 1, 2)) k"


@query(f"{with_('city')[:-1]}, {_dots_sql()}, kd as (select dots.*, ki, kj, kw from dots, {_kernel_sql(4.0)}), {_splat_sql('kd', 'fx*256 - 0.5 + ki', 'fy*256 - 0.5 + kj', '0.05917 * kw', _KEYS)} {_ACC_OUT}")
def brush_points(spark, sf_dir):
    return _rounded(raster.accumulate(raster.draw_brush(city_dots(spark, sf_dir), SIZE, F.lit(BRIGHT), 4.0), TILE_KEYS, SIZE))


@query(f"{with_('city')[:-1]}, {_dots_sql(13)}, nb as (select z, x + i as x, y + j as y, fx - i as fx, fy - j as fy, hue from dots, range(-1, 2) a(i), range(-1, 2) b(j)), kd as (select nb.*, ki, kj, kw from nb, {_kernel_sql(8.0, True)}), {_splat_sql('kd', 'fx*256 - 0.5 + ki', 'fy*256 - 0.5 + kj', '0.05917 * kw', _KEYS)} {_ACC_OUT}")
def neighbour_brush(spark, sf_dir):
    near = raster.with_neighbours(city_dots(spark, sf_dir, 13), SIZE, 6.0, 13)
    return _rounded(raster.accumulate(raster.draw_brush(near, SIZE, F.lit(BRIGHT), 8.0, True), TILE_KEYS, SIZE))


def _segments_px(spark, sf_dir, z: int = CITY_Z) -> DataFrame:
    """Track segments on the canvas of the tile of their first vertex; short
    ones only, so that a line stays near its tile."""
    s = fx.track_segments(spark, sf_dir)
    size = float(2 ** (32 - z))
    rows = s.withColumns({"z": F.lit(z), "x": mercator.tile_of(F.col("x0"), F.lit(z)), "y": mercator.tile_of(F.col("y0"), F.lit(z))})
    place = {f"{c}{k}": (F.col(f"{c}{k}") - F.col(c) * F.lit(int(size))) / size * SIZE for c in "xy" for k in (0, 1)}
    return rows.withColumns(place).withColumn("hue", F.lit(-1.0)).drop("seq")


_SEG_PX = f"sp as (select user_id, {CITY_Z} as z, x0//2097152 as x, y0//2097152 as y, (x0 - (x0//2097152)*2097152)/2097152.0::double*256 as x0, (y0 - (y0//2097152)*2097152)/2097152.0::double*256 as y0, (x1 - (x0//2097152)*2097152)/2097152.0::double*256 as x1, (y1 - (y0//2097152)*2097152)/2097152.0::double*256 as y1 from seg)"


def _clip_sql(source: str, low: float, high: float) -> str:
    t = lambda v, a: f"({v} - {a}0) / nullif({a}1 - {a}0, 0)"
    lo = f"greatest(0, coalesce(least({t(low, 'x')}, {t(high, 'x')}), 0), coalesce(least({t(low, 'y')}, {t(high, 'y')}), 0))"
    hi = f"least(1, coalesce(greatest({t(low, 'x')}, {t(high, 'x')}), 1), coalesce(greatest({t(low, 'y')}, {t(high, 'y')}), 1))"
    return f"cl as (select user_id, z, x, y, x0 + lo*(x1-x0) as x0, y0 + lo*(y1-y0) as y0, x0 + hi*(x1-x0) as x1, y0 + hi*(y1-y0) as y1 from (select *, {lo} as lo, {hi} as hi from {source}) where lo <= hi and (x0 <> x1 or x0 between {low} and {high}) and (y0 <> y1 or y0 between {low} and {high}))"


def _wu_sql(source: str, b: str) -> str:
    steep = "abs(y1-y0) > abs(x1-x0)"
    turn = f"tu as (select z, x, y, st, b, least(p, q) as a0, greatest(p, q) as a1, case when p <= q then r else s end as c0, case when p <= q then s else r end as c1 from (select z, x, y, {steep} as st, {b} as b, case when {steep} then y0 else x0 end as p, case when {steep} then y1 else x1 end as q, case when {steep} then x0 else y0 end as r, case when {steep} then x1 else y1 end as s from {source}) where p <> q)"
    steps = "stp as (select *, unnest(range(cast(floor(a0) as bigint), cast(floor(a1) as bigint) + 1)) as i from tu)"
    mid = "md as (select *, least(a1, i + 1) - greatest(a0, i) as w, c0 + ((greatest(a0, i) + least(a1, i + 1))/2 - a0)*(c1 - c0)/(a1 - a0) as v from stp)"
    acc = f"acc as (select z, x, y, px, py, sum(l) as image from (select z, x, y, case when st then cast(floor(v) as bigint) + j else i end as px, case when st then i else cast(floor(v) as bigint) + j end as py, b * w * case j when 1 then v - floor(v) else 1 - (v - floor(v)) end as l from md, range(2) jj(j) where w > 0) where px between 0 and 255 and py between 0 and 255 group by all)"
    return f"{turn}, {steps}, {mid}, {acc}"


def _line_image(pixels: DataFrame) -> DataFrame:
    return raster.accumulate(pixels, TILE_KEYS, SIZE).select(*TILE_KEYS, "px", "py", r6("image").alias("image"))


@query(f"{with_('tp', 'seg')[:-1]}, {_SEG_PX}, {_clip_sql('sp', -2.0, 257.0)}, {_wu_sql('cl', '0.4')} select z, x, y, px, py, round(image, 6) + 0.0 as image from acc")
def aa_lines(spark, sf_dir):
    return _line_image(raster.draw_lines(raster.clipped(_segments_px(spark, sf_dir), -2.0, 257.0), F.lit(0.4)))


#: A line of 3.5 pixels: three whole parallels and a quarter at each edge.
_OFFSETS = "(0.0::double, 1.0::double), (1.0, 1.0), (-1.0, 1.0), (1.25, 0.25), (-1.25, 0.25)"
_THICK = f"th as (select z, x, y, x0 - (y1-y0)/ln*o as x0, y0 + (x1-x0)/ln*o as y0, x1 - (y1-y0)/ln*o as x1, y1 + (x1-x0)/ln*o as y1, 0.4*s as bb from (select *, sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) as ln from cl), (values {_OFFSETS}) t(o, s) where ln > 0)"


@query(f"{with_('tp', 'seg')[:-1]}, {_SEG_PX}, {_clip_sql('sp', -5.0, 260.0)}, {_THICK}, {_wu_sql('th', 'bb')} select z, x, y, px, py, round(image, 6) + 0.0 as image from acc")
def thick_lines(spark, sf_dir):
    return _line_image(raster.draw_thick_lines(raster.clipped(_segments_px(spark, sf_dir), -5.0, 260.0), F.lit(0.4), 3.5))


_GRID = "gr as (select user_id, x0//65536 as x0, y0//65536 as y0, x1//65536 as x1, y1//65536 as y1 from seg)"


def _plain_sql() -> str:
    return "ex as (select *, greatest(abs(x1-x0), abs(y1-y0)) as l, least(abs(x1-x0), abs(y1-y0)) as s, abs(x1-x0) > abs(y1-y0) as f from gr where (x0, y0) <> (x1, y1)), st as (select *, unnest(range(l)) as k from ex), pl as (select *, cast(ceil((k*s - l//2) / cast(l as double)) as bigint) as m from st)"


@query(f"{with_('tp', 'seg')[:-1]}, {_GRID}, {_plain_sql()} select px, py, count(*) as hits from (select x0 + cast(sign(x1-x0) as bigint)*case when f then k else m end as px, y0 + cast(sign(y1-y0) as bigint)*case when f then m else k end as py from pl) group by all")
def bresenham_lines(spark, sf_dir):
    s = fx.track_segments(spark, sf_dir).selectExpr("user_id", *(f"{c}{k} div 65536 as {c}{k}" for c in "xy" for k in (0, 1)))
    return raster.draw_plain_lines(s).groupBy("px", "py").agg(F.count("*").alias("hits"))


@query(f"{with_('tp', 'seg')[:-1]}, {_GRID}, {_plain_sql()} select px, py, count(*) as hits from (select x0 + cast(sign(x1-x0) as bigint)*case when f then k else m end + case when f then 0 else n end as px, y0 + cast(sign(y1-y0) as bigint)*case when f then m else k end + case when f then n else 0 end as py from pl, range(-1, 2) nn(n)) group by all")
def thick_plain_lines(spark, sf_dir):
    s = fx.track_segments(spark, sf_dir).selectExpr("user_id", *(f"{c}{k} div 65536 as {c}{k}" for c in "xy" for k in (0, 1)))
    return raster.draw_plain_lines(s, 4.0).groupBy("px", "py").agg(F.count("*").alias("hits"))


def _tone_sql(s: Style, hue: bool = True) -> str:
    """The tone map of rounded accumulators, written for SQL."""
    names = "rgb"
    h = "atan2(cy, cx)"
    mids = []
    for k, c in enumerate(s.middle):
        if s.cie:
            turn, gain = ((math.pi - 2, 0.417211), (math.pi + 1.5, 0.158136), (math.pi, 0.455928))[k]
            colour = f"least(255, greatest(0, trunc(round(255 * pow((sin({h} + {math.pi / 2 - (math.pi - 2)!r} + {turn!r}) * {gain} * least(sat, 1.0) + 0.5) * 0.923166 + 0.0791025, 1.25), 9))))"
        else:
            colour = f"trunc(round(255 * pow(sin(pi() * (-({h} / (2 * pi()) + 0.5) + {k / 3!r})), 2) * sat + {c} * (1 - sat), 9))"
        mids.append(f"case when cx <> 0 or cy <> 0 then {colour} else {c} end as m{names[k]}")
    level = f"case when image <> 0 then pow(image, {s.gamma}) else 0 end"
    if s.invert:
        level = f"greatest(0.0, 0.5 - ({level}))"
    step1 = "select *, case when (cx <> 0 or cy <> 0) and image <> 0 then sqrt(cx*cx + cy*cy) / image else 0 end as sat from ra"
    step2 = f"select *, {level} as lv, {', '.join(mids)} from ({step1})"
    step3 = f"select *, case when sat <> 0 then least(lv, {s.color_cap}) else lv end as cap0 from ({step2})"
    step4 = f"select *, {'least(cap0, 1.0) * 0.5' if s.no_oversaturation else 'cap0'} as cap from ({step3})"
    step5 = f"select *, cap / 0.5 as a, (255 * (cap / 0.5) + {s.transparency} * (1 - cap / 0.5)) / 255 as o from ({step4})"
    byte = lambda v: f"least(255, greatest(0, trunc(round({v}, 9))))"
    out = []
    for n, bg, fg in zip(names, s.bg, s.fg, strict=True):
        out.append(f"cast(case when lv = 0 then {bg} when cap <= 0.5 then {byte(f'm{n} * (a / nullif(o, 0)) + {bg} * (1 - a / nullif(o, 0))')} when cap <= 1 then {byte(f'{fg} * ((cap - 0.5) / 0.5) + m{n} * (1 - (cap - 0.5) / 0.5)')} else {fg} end as int) as {n}")
    alpha = f"cast(case when lv = 0 then {s.transparency} when cap <= 0.5 then {byte('o * 255')} else 255 end as int) as a"
    return f"select z, x, y, px, py, {', '.join(out)}, {alpha} from ({step5})"


def _toned(spark, sf_dir, s: Style) -> DataFrame:
    acc = _rounded(_splatted(spark, sf_dir))
    r, g, b, a = style.tone_map(F.col("image"), F.col("cx"), F.col("cy"), s)
    return acc.select(*TILE_KEYS, "px", "py", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


_RA = f"{_SPLAT}, ra as ({_ACC_OUT})"
TONE, TONE_CIE, TONE_MASK = Style(transparency=128), Style(cie=True, no_oversaturation=True), Style(invert=True, transparency=0, white=True)


@query(f"{_RA} {_tone_sql(TONE)}")
def tone_map(spark, sf_dir):
    return _toned(spark, sf_dir, TONE)


@query(f"{_RA} {_tone_sql(TONE_CIE)}")
def tone_map_cie(spark, sf_dir):
    return _toned(spark, sf_dir, TONE_CIE)


@query(f"{_RA} {_tone_sql(TONE_MASK)}")
def tone_map_mask(spark, sf_dir):
    return _toned(spark, sf_dir, TONE_MASK)


_BOX = (686200000, 1660000000)


@query(f"{with_('city')[:-1]}, dots as (select 0 as one, -1.0 as hue, (x - {_BOX[0]}.0::double)/1048576.0 as fx, (y - {_BOX[1]}.0::double)/1048576.0 as fy from city), {_splat_sql('dots', 'fx*256 - 0.5', 'fy*256 - 0.5', '0.05917', 'one', 600)} select px, py, round(image, 6) + 0.0 as image from acc")
def bbox_assemble(spark, sf_dir):
    dots = raster.on_canvas(fx.points(spark, sf_dir, "city"), 12, _BOX, SIZE).withColumn("hue", F.lit(-1.0)).select("hue", "fx", "fy")
    acc = raster.accumulate(raster.draw_points(dots, SIZE, F.lit(BRIGHT)), [], 600)
    return acc.select("px", "py", r6("image").alias("image"))


@query(f"{with_('city')[:-1]}, {_dots_sql(10)}, {_splat_sql('dots', 'fx*512 - 0.5 - 256', 'fy*512 - 0.5 - 256', '0.05917', _KEYS)} {_ACC_OUT}".replace("from dots, range", "from (select * from dots where x = 163 and y = 395) dots, range"))
def retina_tile(spark, sf_dir):
    s, z, x, y, ox, oy = style.with_retina(Style(), 11, 327, 791)
    dots = city_dots(spark, sf_dir, z).where((F.col("x") == x) & (F.col("y") == y))
    pixels = raster.splat(dots, F.col("fx") * s.tilesize - 0.5 + ox, F.col("fy") * s.tilesize - 0.5 + oy, F.lit(BRIGHT))
    return _rounded(raster.accumulate(pixels, TILE_KEYS, SIZE))


@query(f"{with_('city', 'cut')[:-1]}, both_ as (select * from (select orderkey, linenumber, meta, x, y from city where linenumber <= 4) union all select orderkey, linenumber, meta, x, y from cut where linenumber >= 3), {_dots_sql(where='both_')}, {_splat_sql('dots', 'fx*256 - 0.5', 'fy*256 - 0.5', '0.05917', _KEYS)} {_ACC_OUT}")
def multi_dataset_overlay(spark, sf_dir):
    fine = fx.points(spark, sf_dir, "city").where("linenumber <= 4").select("meta", "x", "y")
    coarse = fx.keyed_points(spark, sf_dir).where("linenumber >= 3").select("meta", "x", "y")
    p = dataset.overlay(fine, coarse).withColumns({"wx": F.col("x"), "wy": F.col("y")})
    p = p.withColumns({"z": F.lit(CITY_Z), "x": mercator.tile_of(F.col("wx"), F.lit(CITY_Z)), "y": mercator.tile_of(F.col("wy"), F.lit(CITY_Z))})
    h = style.hue(F.col("meta").cast("double"), 0, 0, 50, 360)
    dots = p.select(*TILE_KEYS, mercator.fraction(F.col("wx"), F.col("x"), CITY_Z).alias("fx"), mercator.fraction(F.col("wy"), F.col("y"), CITY_Z).alias("fy"), h.alias("hue"))
    return _rounded(raster.accumulate(raster.draw_points(dots, SIZE, F.lit(BRIGHT)), TILE_KEYS, SIZE))


@query(f"{_SPLAT} select z, x, y, px, py, round({lat_sql('y*2097152.0::double + px_y')}, 6) as lat, round({lon_sql('x*2097152.0::double + px_x')}, 6) as lon from (select *, px*2097152.0::double/256 as px_x, py*2097152.0::double/256 as px_y from acc)")
def pixel_coordinates(spark, sf_dir):
    got = raster.pixel_places(_splatted(spark, sf_dir).select(*TILE_KEYS, "px", "py"), CITY_Z, SIZE)
    return got.select(*TILE_KEYS, "px", "py", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"{with_('city')[:-1]}, {_dots_sql()} select z, x, y, meta, cx, cy, row_number() over (partition by z, x, y, meta, cx, cy order by vx, vy) - 1 as feature, vx, vy from (select z, x, y, meta % 4 as meta, cast(floor(fx*256) as bigint) as cx, cast(floor(fy*256) as bigint) as cy, cast(trunc(fx*4096) as bigint) as vx, cast(trunc(fy*4096) as bigint) as vy from dots)")
def mvt_point_features(spark, sf_dir):
    return point_features(city_dots(spark, sf_dir).withColumn("meta", F.col("meta") % 4))


_P = (1 << 31) - 1


def _draw_sql(wx: str, wy: str, n: str, salt: int) -> str:
    """The hashed number of a dot, as three nested squarings."""
    h = f"(({wx}) * 48271 + ({wy}) * 40692 + ({n}) * 69621 + {salt}) % {_P}"
    for c in (12345, 6789, 24036583):
        h = f"list_reduce([{h}, 0], lambda v, unused: (v * v + {c}) % {_P})"
    return f"(({h}) / {_P}.0::double)"


def _scatter_sql(source: str, count: str, own: str, radius: str) -> str:
    """Rows of ``source`` (fx, fy, wx, wy, meta, hue), scattered."""
    r, a = _draw_sql("wx", "wy", own, 2), _draw_sql("wx", "wy", own, 3)
    return f"sc as (select * exclude (fx, fy, rr, aa), fx + sqrt(rr) * {radius} * cos(2 * pi() * aa) as fx, fy + sqrt(rr) * {radius} * sin(2 * pi() * aa) as fy from (select *, {r} as rr, {a} as aa from (select *, unnest(range(1, {count} + 1)) as n from {source})))"


_FEET = "(3000 * 0.00000274 / cos(atan(sinh(pi() * (1 - 2 * (791 + 0.5) / 2048)))) / (360 / 2048.0::double))"


@query(f"{with_('city')[:-1]}, {_dots_sql()}, pl as (select dots.*, x*2097152 + cast(fx*2097152 as bigint) as wx, y*2097152 + cast(fy*2097152 as bigint) as wy from dots), {_scatter_sql('pl', 'meta', 'n', _FEET)}, {_splat_sql('sc', 'fx*256 - 0.5', 'fy*256 - 0.5', '0.05917', _KEYS)} {_ACC_OUT}")
def circle_scatter(spark, sf_dir):
    dots = city_dots(spark, sf_dir)
    acc = raster.accumulate(raster.scatter(dots, SIZE, style.cloud_size(3000, CITY_Z, 791), BRIGHT, CITY_Z), TILE_KEYS, SIZE)
    return _rounded(acc)


def _points_sql(z: int, keep: str, bright: str, size: int = SIZE) -> str:
    """Pixels of the stored points that ``keep`` chooses, at a zoom."""
    s = 2 ** (32 - z)
    return f"{with_('city', 'cut')[:-1]}, {_RANKED}, dots as (select {z} as z, x//{s} as x, y//{s} as y, (x % {s})/{s}.0::double as fx, (y % {s})/{s}.0::double as fy, -1.0::double as hue from rk where {keep}), {_splat_sql('dots', 'fx*256 - 0.5', 'fy*256 - 0.5', bright, _KEYS)}"


def _request(spark, sf_dir, listed, s: Style = Style(), *, lines: bool = False) -> render.Request:  # noqa: B008
    ds = fx.city_lines(spark, sf_dir) if lines else fx.city_points(spark, sf_dir)
    return render.Request((ds,), tuple(listed), s)


@query(f"{with_('city', 'cut')[:-1]}, {_RANKED} select qkey, meta, x, y, rank, cast(case when rank = 0 then 63 else length(regexp_extract(bin(rank), '0*$')) end as int) as lod, 1 as legs, 0 as level from rk")
def encode_store(spark, sf_dir):
    """Shapes written, opened and read back with their ranks."""
    ds = fx.city_points(spark, sf_dir)
    first = F.col("verts")[0]
    return ds.stored.select("qkey", "meta", first["x"].alias("x"), first["y"].alias("y"), "rank", "lod", "legs", "level")


_MERGED = "select x // 256 * 256 as x, y // 256 * 256 as y, meta from (select x, y, meta % 3 as meta from city where linenumber <= 4 {u} select x, y, meta % 3 from city where linenumber >= 3)"


def _merged(spark, sf_dir, unique: bool) -> DataFrame:
    vert = F.array(F.struct("x", "y")).alias("verts")
    halves = [fx.stored(spark, sf_dir, f"half{k}", lambda w=w: fx.points(spark, sf_dir, "city").where(w).select(vert, F.expr("meta % 3").alias("meta"))) for k, w in enumerate(("linenumber <= 4", "linenumber >= 3"))]
    first = F.col("verts")[0]
    return dataset.merged(halves, unique=unique).select(first["x"].alias("x"), first["y"].alias("y"), "meta")


@query(f"{with_('city')} {_MERGED.format(u='union all')}")
def merge_stored(spark, sf_dir):
    return _merged(spark, sf_dir, False)


@query(f"{with_('city')} select distinct * from ({_MERGED.format(u='union all')})")
def merge_stored_unique(spark, sf_dir):
    return _merged(spark, sf_dir, True)


@query(f"{_points_sql(CITY_Z, f'rank % 4 = 0 and (x//2097152, y//2097152) in ((327, 791), (327, 792))', '0.05917 * pow(1.23, -2)')} {_ACC_OUT}")
def render_tile_points(spark, sf_dir):
    """Two tiles, of which a zoom shows every fourth point."""
    return _rounded(render.pixels(spark, _request(spark, sf_dir, CITY_TILES)))


_SNAP = f"{with_('city', 'cut')[:-1]}, dots as (select 13 as z, x//524288 as x, y//524288 as y, (floor((x % 524288)/524288.0::double*256) + 0.5)/256 as fx, (floor((y % 524288)/524288.0::double*256) + 0.5)/256 as fy, -1.0::double as hue from cut where meta <= 30 and x//524288 = 1309 and y//524288 = 3166), {_splat_sql('dots', 'fx*256 - 0.5', 'fy*256 - 0.5', '0.05917', _KEYS)}"


@query(f"{_SNAP} {_ACC_OUT}")
def render_snapped(spark, sf_dir):
    """Without antialiasing, and only points of a meta up to 30."""
    return _rounded(render.pixels(spark, _request(spark, sf_dir, [(13, 1309, 3166)], Style(antialias=False, max_meta=30))))


@query(f"{with_('city', 'cut')[:-1]}, dots as (select 14 as z, 2618 as x, 6333 as y, x/262144.0::double - 2618 as fx, y/262144.0::double - 6333 as fy, -1.0::double as hue from cut where x//262144 between 2617 and 2619 and y//262144 between 6332 and 6334), kd as (select dots.*, ki, kj, kw from dots, {_kernel_sql(2.0)}), {_splat_sql('kd', 'fx*256 - 0.5 + ki', 'fy*256 - 0.5 + kj', '0.05917 * 1.23 * kw', _KEYS)} {_ACC_OUT}")
def render_overzoom(spark, sf_dir):
    """Dots larger than a pixel, also of the tiles around."""
    return _rounded(render.pixels(spark, _request(spark, sf_dir, [(14, 2618, 6333)])))


@query(f"{with_('city', 'cut')[:-1]}, dots as (select 13 as z, 1309 as x, 3166 as y, meta, x/524288.0::double - 1309 as fx, y/524288.0::double - 3166 as fy, -1.0::double as hue from cut where x//524288 between 1308 and 1310 and y//524288 between 3165 and 3167), kd as (" + " union all ".join(f"select dots.*, ki, kj, kw from dots, {_kernel_sql(float(m))} where meta = {m}" for m in range(1, 51)) + f"), {_splat_sql('kd', 'fx*256 - 0.5 + ki', 'fy*256 - 0.5 + kj', '0.05917 * kw', _KEYS)} {_ACC_OUT}")
def render_by_meta(spark, sf_dir):
    """Dots whose area is their meta value."""
    return _rounded(render.pixels(spark, _request(spark, sf_dir, [(13, 1309, 3166)], Style(scale="radius"))))


_Z_LINES = "sg as (select user_id, seq, x0//256*256 as x0, y0//256*256 as y0, x1//256*256 as x1, y1//256*256 as y1 from seg), lv as (select *, case when x0 = x1 and y0 = y1 then 24 else least(24, 32 - length(bin(xor(x0, x1) | xor(y0, y1)))) end as level from sg)"
_LINE_PX = f"sp as (select user_id, 12 as z, 654 as x, 1583 as y, (x0 - 654*1048576)/1048576.0::double*256 as x0, (y0 - 1583*1048576)/1048576.0::double*256 as y0, (x1 - 654*1048576)/1048576.0::double*256 as x1, (y1 - 1583*1048576)/1048576.0::double*256 as y1 from lv where level <= 20 and {_meets('x0/1048576.0 - 654', 'y0/1048576.0 - 1583', 'x1/1048576.0 - 654', 'y1/1048576.0 - 1583')})"


@query(f"{with_('tp', 'seg')[:-1]}, {_Z_LINES}, {_LINE_PX}, {_clip_sql('sp', -2.0, 257.0)}, {_wu_sql('cl', '0.05917 * 6.64 / 1.23')} select z, x, y, px, py, round(image, 6) + 0.0 as image from acc")
def render_tile_lines(spark, sf_dir):
    acc = render.pixels(spark, _request(spark, sf_dir, [(12, 654, 1583)], lines=True))
    return acc.select(*TILE_KEYS, "px", "py", r6("image").alias("image"))


_SET_STEP = "cast(pow(2, 13 - z) as bigint)"
_SET_SIZE = "cast(pow(2, 32 - z) as bigint)"


@query(f"{with_('city', 'cut')[:-1]}, {_RANKED}, dots as (select cast(z as int) as z, x // {_SET_SIZE} as x, y // {_SET_SIZE} as y, (x % {_SET_SIZE})/{_SET_SIZE}::double as fx, (y % {_SET_SIZE})/{_SET_SIZE}::double as fy, 0.05917 * pow(1.23, z - 13) as lb, -1.0::double as hue from rk, range(9, 14) r(z) where rank % {_SET_STEP} = 0), {_splat_sql('dots', 'fx*256 - 0.5', 'fy*256 - 0.5', 'lb', _KEYS)} select z, x, y, px, py, round(image + 1e-9, 6) as image from acc")
def render_tileset(spark, sf_dir):
    """All tiles of zooms 9 to 13, listed by the pyramid."""
    ds = fx.city_points(spark, sf_dir)
    listed = [tuple(r) for r in pyramid.pyramid(ds.points, 13, 9).select("z", "x", "y").collect()]  # the request
    acc = render.pixels(spark, _request(spark, sf_dir, listed))
    # Weights are multiples of a 64th, so that sums lie on ties of rounding.
    return acc.select(*TILE_KEYS, "px", "py", F.round(F.col("image") + 1e-9, 6).alias("image"))


@query(f"{with_('city', 'cut')[:-1]}, {_RANKED}, pl as (select {CITY_Z} as z, 327 as x, 791 as y, meta, rank, x as wx, y as wy, x/2097152.0::double - 327 as fx, y/2097152.0::double - 791 as fy, -1.0::double as hue from rk where x//2097152 between 326 and 328 and y//2097152 between 790 and 792), {_scatter_sql('pl', 'cast(floor(meta / 4.0::double + rank * 40503 % 65536 / 65536.0::double) as bigint)', 'n + rank * 8191', _FEET)}, {_splat_sql('sc', 'fx*256 - 0.5', 'fy*256 - 0.5', '0.05917 * pow(1.23, -2)', _KEYS)} {_ACC_OUT}")
def render_scatter(spark, sf_dir):
    """Every fourth of the scattered dots, remainders carried from point to
    point, circles of the tiles around included."""
    return _rounded(render.pixels(spark, _request(spark, sf_dir, [(CITY_Z, 327, 791)], Style(circle_feet=3000))))


_IN_DUMP = f"({_meets('x0/2097152.0 - 327', 'y0/2097152.0 - 791', 'x1/2097152.0 - 327', 'y1/2097152.0 - 791')} or {_meets('x0/4194304.0 - 164', 'y0/4194304.0 - 395', 'x1/4194304.0 - 164', 'y1/4194304.0 - 395')})"


@query(f"{with_('tp', 'seg')[:-1]}, {_Z_LINES} select concat(printf('%.6f,%.6f ', {lat_sql('y0')}, {lon_sql('x0')}), printf('%.6f,%.6f ', {lat_sql('y1')}, {lon_sql('x1')}), '8:', user_id % 7, ' // ', printf('%08x %08x %08x %08x ', x0, y0, x1, y1)) as value from lv where {_IN_DUMP}")
def render_dump(spark, sf_dir):
    """Lines of three tiles, one inside another, each record once."""
    return render.dump(spark, _request(spark, sf_dir, [(CITY_Z, 327, 791), (12, 654, 1583), (10, 164, 395)], lines=True))


@query(f"{with_('city', 'cut')[:-1]}, {_RANKED} select printf('%.6f,%.6f', {lat_sql('wy')}, {lon_sql('wx')}) as value from (select 327*2097152 + cast(trunc(((x - 327*2097152)/2097152.0::double*256 - 0.5)/256*2097152.0::double) as bigint) as wx, 791*2097152 + cast(trunc(((y - 791*2097152)/2097152.0::double*256 - 0.5)/256*2097152.0::double) as bigint) as wy from rk where rank % 4 = 0 and x//2097152 = 327 and y//2097152 = 791)")
def render_pixel_text(spark, sf_dir):
    return render.pixel_text(spark, _request(spark, sf_dir, [(CITY_Z, 327, 791)]))


_ENUM = f"e as (select cast(r.z as int) as z, lv.x0 // cast(pow(2, 32 - r.z) as bigint) as x, lv.y0 // cast(pow(2, 32 - r.z) as bigint) as y, count(*) as count, cast(sum(lv.x0) // count(*) as bigint) as sx, cast(sum(lv.y0) // count(*) as bigint) as sy, sum(case when {_DIST} < 400000 then {_DIST} else 0 end) / pow(2.0, 32 - r.z) as len from lv, range(13) r(z) group by r.z, 2, 3)"


@query(f"{with_('tp', 'seg')[:-1]}, {_Z_LINES}, {_ENUM}, p as (select distinct z, x // 2 as px, y // 2 as py from e where z > 0), c as (select z, 2*px + dx as x, 2*py + dy as y from p, range(2) a(dx), range(2) b(dy) except select z, x, y from e) select z, x, y, count, round({lat_sql('sy')}, 6) as lat, round({lon_sql('sx')}, 6) as lon, round(len, 6) as len from e union all select z, x, y, 0, round({lat_sql('y*pow(2.0, 32-z)')}, 6), round({lon_sql('x*pow(2.0, 32-z)')}, 6), 0.0 from c")
def enumerate_tiles(spark, sf_dir):
    """Counts, mean places, lengths and missing siblings of a stored set."""
    got = pyramid.enumerated(fx.city_lines(spark, sf_dir).shapes, 12, verbose=True, distance=True, siblings=True, longest=400000.0)
    return got.select(*TILE_KEYS, "count", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "len")))


# ---- encoded tiles, read back ---------------------------------------------------


def _pixel_rows(images: DataFrame) -> DataFrame:
    """Pixels of encoded images."""

    def read(batches):
        for b in batches:
            for z, x, y, image in zip(b.z, b.x, b.y, b.image, strict=True):
                rgba = encoders.read_png(bytes(image))
                py, px = np.indices(rgba.shape[:2]).reshape(2, -1)
                colours = {c: rgba[..., k].ravel().astype("i4") for k, c in enumerate("rgba")}
                yield pd.DataFrame({"z": np.int32(z), "x": x, "y": y, "px": px, "py": py, **colours})

    return images.mapInPandas(read, "z int, x long, y long, px long, py long, r int, g int, b int, a int")


def _whole_sql(toned: str, blank: str, listed: str) -> str:
    """All pixels of the listed tiles; those without light are blank."""
    colours = ", ".join(f"cast(coalesce(tn.{c}, {v}) as int) as {c}" for c, v in zip("rgba", blank.split(","), strict=True))
    return f", tn as ({toned}), ls as ({listed}) select ls.z, ls.x, ls.y, i.px, j.py, {colours} from ls cross join range(256) i(px) cross join range(256) j(py) left join tn on tn.z = ls.z and tn.x = ls.x and tn.y = ls.y and tn.px = i.px and tn.py = j.py"


@query(f"{_RA}{_whole_sql(_tone_sql(TONE), '0,0,0,128', 'select distinct z, x, y from ra')}")
def png_tiles(spark, sf_dir):
    """Tiles encoded as images, and the pixels read from them."""
    return _pixel_rows(encoders.png_tiles(_toned(spark, sf_dir, TONE), SIZE, (0, 0, 0, 128)))


_RENDERED = f"{_points_sql(CITY_Z, f'rank % 4 = 0 and (x//2097152, y//2097152) in ((327, 791), (327, 792))', '0.05917 * pow(1.23, -2)')}, ra as (select * from acc)"


@query(f"{_RENDERED}{_whole_sql(_tone_sql(Style()), '0,0,0,255', 'select distinct z, x, y from ra')}")
def render_png(spark, sf_dir):
    """Two tiles from the stored points to the pixels of their images."""
    return _pixel_rows(render.png_tiles(spark, _request(spark, sf_dir, CITY_TILES)))


def _vector(spark, sf_dir) -> DataFrame:
    points = as_rows(point_features(city_dots(spark, sf_dir).withColumn("meta", F.col("meta") % 4)))
    segs = _segments_px(spark, sf_dir).withColumn("meta", F.col("user_id") % 4)
    return points.unionByName(line_features(raster.clipped(segs, -1.0, SIZE + 1.0), SIZE))


def _features(tiles_: DataFrame) -> DataFrame:
    """Points (with their number among those of their cell and meta, in the
    order of the features, of which none has two) and lines (-1) of encoded
    vector tiles."""
    names = ["z", "x", "y", "kind", "meta", "feature", "vx0", "vy0", "vx1", "vy1"]

    def read(batches):
        for b in batches:
            for z, x, y, tile in zip(b.z, b.x, b.y, b.tile, strict=True):
                seen, held, n = {}, [], 0
                for layer, meta, path in encoders.tile_features(bytes(tile)):
                    if layer == "points":
                        v = encoders.read_points(path)
                        cell = (v[:, 0] * encoders.CELLS // encoders.EXTENT) * encoders.CELLS + v[:, 1] * encoders.CELLS // encoders.EXTENT
                        if len(np.unique(cell)) < len(cell):
                            raise ValueError(f"a feature of {z}/{x}/{y} has two points of one cell")
                        count = seen.setdefault(meta, np.zeros(encoders.CELLS**2, np.int64))
                        held.append((True, meta, count[cell], np.concatenate([v, v], 1)))
                        count[cell] += 1
                    else:
                        path = encoders.read_commands(path)
                        v = np.array([(*a[1:], *e[1:]) for a, e in zip(path, path[1:]) if e[0] == encoders.LINE_TO], np.int64)  # noqa: B905
                        held.append((False, meta, np.full(len(v), -1), v))
                    n += len(v)
                    if n >= 100_000:
                        yield rows_of(z, x, y, held)
                        held, n = [], 0
                if held:
                    yield rows_of(z, x, y, held)

    def rows_of(z, x, y, held):
        sizes = [len(h[3]) for h in held]
        kind = np.repeat(np.array(["point" if h[0] else "line" for h in held], object), sizes)
        place = np.concatenate([h[3] for h in held])
        columns = (np.int32(z), x, y, kind, np.repeat([h[1] for h in held], sizes), np.concatenate([h[2] for h in held]), *place.T)
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return tiles_.mapInPandas(read, "z int, x long, y long, kind string, meta long, feature long, vx0 long, vy0 long, vx1 long, vy1 long")


_VECTOR_LINES = f"{_SEG_PX}, {_clip_sql('sp', -1.0, 257.0)}, ln as (select z, x, y, user_id % 4 as meta, cast(floor(x0*4096/256) as bigint) as vx0, cast(floor(y0*4096/256) as bigint) as vy0, cast(floor(x1*4096/256) as bigint) as vx1, cast(floor(y1*4096/256) as bigint) as vy1 from cl)"
_LINES_OUT = "select z, x, y, 'line' as kind, meta, cast(-1 as bigint) as feature, vx0, vy0, vx1, vy1 from ln where (vx0, vy0) <> (vx1, vy1)"


@query(f"{with_('tp', 'seg')[:-1]}, {_VECTOR_LINES} {_LINES_OUT}")
def mvt_lines(spark, sf_dir):
    return _features(encoders.vector_tiles(_vector(spark, sf_dir).where("kind = 'line'")))


@query(f"{with_('city', 'tp', 'seg')[:-1]}, {_dots_sql()}, {_VECTOR_LINES}, pt as (select z, x, y, meta % 4 as meta, cast(floor(fx*256) as bigint) as cx, cast(floor(fy*256) as bigint) as cy, cast(trunc(fx*4096) as bigint) as vx, cast(trunc(fy*4096) as bigint) as vy from dots) select z, x, y, 'point' as kind, meta, row_number() over (partition by z, x, y, meta, cx, cy order by vx, vy) - 1 as feature, vx as vx0, vy as vy0, vx as vx1, vy as vy1 from pt union all {_LINES_OUT}")
def mvt_tiles(spark, sf_dir):
    """Vector tiles of points and lines, and the features read from them."""
    return _features(encoders.vector_tiles(_vector(spark, sf_dir)))
