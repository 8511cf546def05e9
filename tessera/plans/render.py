"""Whole requests: any number of tiles, or one bounding box, in one job."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import mercator, style
from tessera.functions.style import Style
from tessera.operators import encoders, raster, shapes, tiles
from tessera.operators.dataset import Dataset
from tessera.operators.features import as_rows, line_features, point_features
from tessera.sources import text

Tile = tuple[int, int, int]
KEYS = ["z", "x", "y"]
#: Lines whose enclosing tile lies more zooms deeper are below a pixel.
DEEPEST = 8


@dataclass(frozen=True)
class Request:
    """What to draw: data sets, tiles and style."""

    datasets: tuple[Dataset, ...]
    tiles: tuple[Tile, ...]
    style: Style = Style()

    def listed(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.tiles), "z int, x long, y long")

    def by_zoom(self) -> list[list[Tile]]:
        """Distinct tiles, zoom by zoom."""
        return [sorted({t for t in self.tiles if t[0] == z}) for z in sorted({t[0] for t in self.tiles})]


def _hue(s: Style, metabits: int):
    if s.hues and metabits:
        return style.hue(F.col("meta").cast("double"), *s.hues)
    return F.lit(-1.0)


def _placed(points: DataFrame, z: int) -> DataFrame:
    rows = points.withColumns({"wx": F.col("x"), "wy": F.col("y")})
    rows = rows.withColumns({"z": F.lit(z), "x": mercator.tile_of(F.col("wx"), F.lit(z)), "y": mercator.tile_of(F.col("wy"), F.lit(z))})
    return rows.select(*KEYS, "meta", "hue", "rank", mercator.fraction(F.col("wx"), F.col("x"), z).alias("fx"), mercator.fraction(F.col("wy"), F.col("y"), z).alias("fy"))


@dataclass(frozen=True)
class Dots:
    """Points of the listed tiles of one zoom, ready to draw: rows z, x, y,
    meta, hue, fx, fy, rank."""

    rows: DataFrame
    look: style.PointLook
    scatter: float = 0.0
    inner: int = 1
    by_meta: bool = False


def point_dots(ds: Dataset, asked: list[Tile], s: Style, y: int | None = None, *, spread: bool = True) -> Dots:
    """Read the key ranges of the tiles (of one zoom) and of those around them
    whose dots may reach in, sampled by the stored ranks."""
    z = asked[0][0]
    look = style.point_look(s, z, y)
    scatter = style.cloud_size(s.circle_feet, z, y or 0) if s.circle_feet else 0.0
    step, inner = look.step, 1
    if s.circle_feet and step > 1 and scatter * s.tilesize > 0.0625:
        step, inner = 1, look.step
    by_meta = s.scale == "radius" and ds.metabits > 0
    reach = math.sqrt(max(look.brush, 1.0) / math.pi) + 2 if look.brush > 1 else 1.0
    if s.circle_feet:
        reach += scatter * s.tilesize
    most = reach
    if by_meta:
        top = min(ds.points.agg(F.max("meta")).first()[0] or 0, s.max_meta if s.max_meta is not None else 1 << 62)
        most += math.sqrt(look.brush * top / math.pi) + 2
    wide = spread and (look.brush > 1 or bool(s.circle_feet) or by_meta)
    points = tiles.points_near(ds.points, asked, math.ceil(most / s.tilesize) if wide else 0)
    points = style.drawn_metas(tiles.sampled(points, step), s)
    if z >= ds.mapbits // 2 - 8:
        nx, ny = style.noise(F.col("x"), F.col("y"), ds.mapbits)
        points = points.withColumns({"_x": nx, "_y": ny}).withColumns({"x": F.col("_x"), "y": F.col("_y")})
    dots = _placed(points.withColumn("hue", _hue(s, ds.metabits)), z)
    if not s.antialias:
        dots = dots.withColumns({"fx": style.snapped(F.col("fx"), s.tilesize), "fy": style.snapped(F.col("fy"), s.tilesize)})
    if wide:
        own = F.lit(reach) + (F.sqrt(F.col("meta") * look.brush / math.pi) if by_meta else 0.0)
        dots = raster.with_neighbours(dots, s.tilesize, own, z)
    return Dots(dots.join(tiles.listed(dots.sparkSession, asked), KEYS), look, scatter, inner, by_meta)


def point_pixels(ds: Dataset, asked: list[Tile], s: Style, y: int | None = None) -> DataFrame:
    """Light of the points of the tiles (of one zoom)."""
    d = point_dots(ds, asked, s, y)
    z, look = asked[0][0], d.look
    bright = style.by_meta(F.lit(look.bright), F.col("meta"), s.scale == "brightness")
    if s.circle_feet:
        lit = raster.scatter(d.rows, s.tilesize, d.scatter, look.bright, z, d.inner, look.brush, s.gaussian)
    elif d.by_meta:
        lit = raster.draw_brush_by_meta(d.rows, s.tilesize, bright, look.brush, s.gaussian)
    elif look.brush <= 1:
        lit = raster.draw_points(d.rows, s.tilesize, bright * look.brush)
    else:
        lit = raster.draw_brush(d.rows, s.tilesize, bright, look.brush, s.gaussian)
    return lit.select(*KEYS, "px", "py", "b", "hue")


def tile_segments(ds: Dataset, asked: list[Tile], s: Style) -> DataFrame:
    """Segments of lines that meet the tiles (of one zoom), in their pixels."""
    z, spark = asked[0][0], ds.stored.sparkSession
    listed = tiles.listed(spark, asked)
    near = tiles.lines_near(style.drawn_metas(ds.lines, s), asked, DEEPEST)
    lines = tiles.lines_of_tiles(near, listed, mapbits=ds.mapbits, deepest=DEEPEST, zooms=[z])
    pair = F.transform(F.sequence(F.lit(1), F.size("verts") - 1), lambda i: F.struct(*(F.col("verts")[i - 1 + k][c].alias(f"{c}{k}") for c in "xy" for k in (0, 1))))
    segs = lines.select(*KEYS, "meta", F.explode(pair).alias("_s")).select(*KEYS, "meta", "_s.*")
    segs = shapes.split_antimeridian(segs)
    size = float(2 ** (32 - z))
    dx, dy = ((F.col(f"{c}1") - F.col(f"{c}0")).cast("double") for c in "xy")
    bright, _ = style.line_look(s, z)
    light = style.by_meta(F.lit(bright), F.col("meta"), s.scale == "brightness")
    light = style.gps_brightness(light, dx, dy, z, s.gps) if s.gps else light
    segs = segs.withColumns({"light": light, "hue": _hue(s, ds.metabits)}).where("light IS NOT NULL")
    return segs.withColumns({f"{c}{k}": (F.col(f"{c}{k}") - F.col(c) * F.lit(int(size))) / size * s.tilesize for c in "xy" for k in (0, 1)})


def line_pixels(ds: Dataset, asked: list[Tile], s: Style) -> DataFrame:
    _, thick = style.line_look(s, asked[0][0])
    segs = raster.clipped(tile_segments(ds, asked, s), -1.0 - thick, s.tilesize + thick)
    if s.antialias:
        return raster.draw_thick_lines(segs, F.col("light"), thick).select(*KEYS, "px", "py", "b", "hue")
    whole = segs.withColumns({c: F.floor(c).cast("long") for c in ("x0", "y0", "x1", "y1")})
    return raster.draw_plain_lines(whole).select(*KEYS, "px", "py", F.col("light").alias("b"), "hue")


def pixels(spark: SparkSession, request: Request) -> DataFrame:
    """Accumulated light: z, x, y, px, py, image, cx, cy."""
    s, parts = request.style, []
    for asked in request.by_zoom():
        by_row = s.mercator_lat is not None or s.circle_feet
        rows = {y: [t for t in asked if t[2] == y] for y in sorted({t[2] for t in asked})} if by_row else {None: asked}
        for ds in request.datasets:
            parts += [point_pixels(ds, mine, s, y) for y, mine in rows.items()]
            if ds.maxn > 1:
                parts.append(line_pixels(ds, asked, s))
    return raster.accumulate(reduce(DataFrame.unionByName, parts), KEYS, s.tilesize)


def coloured(acc: DataFrame, s: Style) -> DataFrame:
    r, g, b, a = style.tone_map(F.col("image"), F.col("cx"), F.col("cy"), s)
    return acc.select(*[c for c in acc.columns if c not in ("image", "cx", "cy")], r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def empty_pixel(s: Style) -> tuple[int, int, int, int]:
    """Colour of a pixel without light; a mask shows its full colour there."""
    if not s.invert:
        return (*s.bg, s.transparency)
    return (*s.middle, 255)


def png_tiles(spark: SparkSession, request: Request) -> DataFrame:
    """(z, x, y, image) of every tile with data."""
    s = request.style
    return encoders.png_tiles(coloured(pixels(spark, request), s), s.tilesize, empty_pixel(s))


def retina_tile(spark: SparkSession, datasets: tuple[Dataset, ...], tile: Tile, s: Style) -> DataFrame:
    """One tile drawn as the quarter of its parent at twice the size."""
    big, z, x, y, ox, oy = style.with_retina(s, *tile)
    acc = pixels(spark, Request(datasets, ((z, x, y),), big))
    moved = acc.withColumns({"px": F.col("px") + ox, "py": F.col("py") + oy, "z": F.lit(tile[0]), "x": F.lit(tile[1]).cast("long"), "y": F.lit(tile[2]).cast("long")})
    moved = moved.where(F.col("px").between(0, s.tilesize - 1) & F.col("py").between(0, s.tilesize - 1))
    return encoders.png_tiles(coloured(moved, s), s.tilesize, empty_pixel(s))


def tiles_of_box(z: int, low: tuple[float, float], high: tuple[float, float], tilesize: int = 256) -> tuple[tuple[Tile, ...], tuple[float, float, float, float]]:
    """Tiles of a box of (lat, lon) corners, and the box in fractional tiles."""

    def place(lat: float, lon: float) -> tuple[float, float]:
        phi = math.radians(lat)
        return 2**z * (lon + 180) / 360, 2**z * (1 - math.log(math.tan(phi) + 1 / math.cos(phi)) / math.pi) / 2

    (xa, ya), (xb, yb) = place(*low), place(*high)
    x0, x1, y0, y1 = min(xa, xb), max(xa, xb), min(ya, yb), max(ya, yb)
    if (x1 - x0) * (y1 - y0) * tilesize**2 > 1e8:
        raise ValueError("the box has more than 10^8 pixels")
    found = tuple((z, x, y) for y in range(int(y0), int(y1) + 1) for x in range(int(x0), int(x1) + 1))
    return found, (x0, y0, x1, y1)


def box_image(spark: SparkSession, datasets: tuple[Dataset, ...], z: int, low: tuple[float, float], high: tuple[float, float], s: Style) -> bytes:
    """One image of a bounding box, assembled without seams."""
    found, (x0, y0, x1, y1) = tiles_of_box(z, low, high, s.tilesize)
    width, height = math.ceil((x1 - x0) * s.tilesize), math.ceil((y1 - y0) * s.tilesize)
    rows = coloured(pixels(spark, Request(datasets, found, s)), s)
    at = lambda c, o: (F.col(c) * s.tilesize + F.col(f"p{c}") - F.lit(int(o * s.tilesize))).alias(f"p{c}")
    got = rows.select(at("x", x0), at("y", y0), "r", "g", "b", "a").where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).toArrow()
    canvas = np.empty((height, width, 4), "u1")
    canvas[:] = empty_pixel(s)
    v = {c: got.column(c).to_numpy() for c in got.column_names}
    canvas[v["py"], v["px"]] = np.stack([v[c] for c in "rgba"], 1)
    return encoders.png(canvas)


def vector_tiles(spark: SparkSession, request: Request) -> DataFrame:
    """(z, x, y, tile) with the layers lines and points."""
    return encoders.vector_tiles(vector_rows(request))


def vector_rows(request: Request) -> DataFrame:
    """Points and lines of the tiles in their units; points as small as a
    vector tile draws them, so no dot reaches in from a neighbour."""
    s, parts = request.style, []
    for asked in request.by_zoom():
        for ds in request.datasets:
            parts.append(as_rows(point_features(point_dots(ds, asked, s, spread=False).rows)))
            if ds.maxn > 1:
                segs = raster.clipped(tile_segments(ds, asked, s), -1.0, s.tilesize + 1.0)
                parts.append(line_features(segs, s.tilesize))
    return reduce(DataFrame.unionByName, parts)


def dump(spark: SparkSession, request: Request, *, geojson: bool = False) -> DataFrame:
    """Shapes that meet any of the tiles, each record once per data set, as
    lines."""
    asked, out = tiles.without_nested(list(request.tiles)), []
    listed = tiles.listed(spark, asked)
    groups = [[t for t in asked if t[0] == z] for z in sorted({t[0] for t in asked})]
    for ds in request.datasets:
        # No listed tile lies in another, so a point is in one at most.
        near = [tiles.points_of_tiles(tiles.points_near(ds.points, g), listed.where(F.col("z") == g[0][0]), [g[0][0]]) for g in groups]
        rows = reduce(DataFrame.unionByName, near).select(F.array(F.struct("x", "y")).alias("verts"), "meta")
        if ds.maxn > 1:
            met = [tiles.lines_of_tiles(tiles.lines_near(ds.named_lines, g), listed.where(F.col("z") == g[0][0]), mapbits=ds.mapbits, zooms=[g[0][0]]) for g in groups]
            lines = reduce(DataFrame.unionByName, met)
            lines = lines.dropDuplicates(["_id"]) if len(asked) > 1 else lines
            rows = rows.unionByName(lines.select("verts", "meta"))
        form = text.dump_geojson if geojson else text.dump_text
        out.append(style.drawn_metas(rows, request.style).select(form(F.col("verts"), F.col("meta"), ds.metabits).alias("value")))
    return reduce(DataFrame.unionByName, out)


def pixel_text(spark: SparkSession, request: Request) -> DataFrame:
    """Latitude and longitude of every pixel that is drawn, as lines: dots at
    their place, lines without antialiasing, a line each time they are hit."""
    s, parts = request.style, []
    for asked in request.by_zoom():
        z = asked[0][0]
        rows = {y: [t for t in asked if t[2] == y] for y in sorted({t[2] for t in asked})} if s.circle_feet else {None: asked}
        for ds in request.datasets:
            for y, mine in rows.items():
                d = point_dots(ds, mine, s, y)
                dots = raster.scattered(d.rows, d.scatter, d.inner, z) if s.circle_feet and d.scatter * s.tilesize >= 0.5 else d.rows
                half = 0.5 if d.look.brush <= 1 else 0.0
                parts.append(dots.select(*KEYS, *((F.col(f"f{c}") * s.tilesize - half).alias(f"p{c}") for c in "xy")))
            if ds.maxn > 1:
                _, thick = style.line_look(s, z)
                segs = raster.clipped(tile_segments(ds, asked, s), -1.0 - thick, s.tilesize + thick)
                whole = segs.withColumns({c: F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")})
                parts.append(raster.draw_plain_lines(whole, thick).select(*KEYS, *(F.col(f"p{c}").cast("double").alias(f"p{c}") for c in "xy")))
    hit = reduce(DataFrame.unionByName, parts)
    lat, lon = raster.world_places(hit, s.tilesize)
    return hit.select(F.format_string("%.6f,%.6f", lat, lon).alias("value"))


def orange(s: Style) -> Style:
    """The canned look of single tiles."""
    return replace(s, transparency=style.TRANSPARENT_ORANGE.transparency, middle=style.TRANSPARENT_ORANGE.middle)
