"""Tile pyramids: counts, centroids, lengths, siblings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import mercator

#: Zooms that one aggregation adds up.
STEP = 5


def pyramid(points: DataFrame, max_zoom: int, min_zoom: int = 0, **sums) -> DataFrame:
    """Counts (and the named ``sums``) of points per tile of every zoom.

    Rows are aggregated once, at the deepest zoom.  Coarser zooms are added up
    from tiles, ``STEP`` zooms at a time, each step from the coarsest tiles of
    the one before, so that the deepest tiles are not repeated for all zooms.
    """
    tiles = points.select(mercator.tile_of(F.col("x"), max_zoom).alias("x"), mercator.tile_of(F.col("y"), max_zoom).alias("y"), *(c.alias(n) for n, c in sums.items()))
    total = [F.sum("count").alias("count"), *(F.sum(n).alias(n) for n in sums)]
    base = tiles.groupBy("x", "y").agg(F.count("*").alias("count"), *(F.sum(n).alias(n) for n in sums))
    out, deep = [base.select(F.lit(max_zoom).alias("z"), "x", "y", "count", *sums)], max_zoom
    while deep > min_zoom:
        low = max(min_zoom, deep - STEP)
        zooms = base.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(deep - 1))))
        shift = (F.lit(deep) - F.col("z")).cast("int")
        up = zooms.select("z", *(F.call_function("shiftrightunsigned", F.col(c), shift).alias(c) for c in "xy"), "count", *sums)
        step = up.groupBy("z", "x", "y").agg(*total)
        out.append(step)
        base, deep = step.where(F.col("z") == low).drop("z"), low
    return reduce(DataFrame.unionByName, out)


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def _mean_place() -> tuple[Column, Column]:
    """Latitude and longitude of the mean place (in the projection)."""
    mean = lambda c: F.expr(f"CAST({c} div count AS bigint)")
    return mercator.unproject(mean("xsum"), mean("ysum"))


def centroids(points: DataFrame, max_zoom: int, min_zoom: int = 0) -> DataFrame:
    """Counts and the mean place of each tile."""
    tiles = pyramid(points, max_zoom, min_zoom, xsum=_wide("x"), ysum=_wide("y"))
    lat, lon = _mean_place()
    return tiles.select("z", "x", "y", "count", lat.alias("lat"), lon.alias("lon"))


def enumerated(shapes: DataFrame, max_zoom: int, min_zoom: int = 0, *, verbose: bool = False, distance: bool = False, siblings: bool = False, longest: float = 6400.0) -> DataFrame:
    """Tiles of shapes (verts) by their first vertex: z, x, y and, with
    ``verbose``, count and mean place, with ``distance`` the length of the
    lines in tile units (segments from ``longest`` world units on are jumps).
    Missing siblings have count 0, length 0 and the place of their corner."""
    sums = {}
    if verbose:
        sums |= {"xsum": _wide("x"), "ysum": _wide("y")}
    if distance:
        sums["len"] = F.col("len")
        shapes = shapes.withColumn("len", line_length(F.col("verts"), longest))
    first = F.col("verts")[0]
    points = shapes.withColumns({"x": first["x"], "y": first["y"]})
    tiles = pyramid(points, max_zoom, min_zoom, **sums)
    if distance:
        tiles = tiles.withColumn("len", F.col("len") / F.pow(F.lit(2.0), 32 - F.col("z")))
    if verbose:
        lat, lon = _mean_place()
        tiles = tiles.withColumns({"lat": lat, "lon": lon}).drop("xsum", "ysum")
    if siblings:
        missing = with_siblings(tiles).where("count = 0")
        if distance:
            missing = missing.withColumn("len", F.lit(0.0))
        if verbose:
            corner = lambda c: (F.col(c) * F.pow(F.lit(2.0), 32 - F.col("z"))).cast("long")
            lat, lon = mercator.unproject(corner("x"), corner("y"))
            missing = missing.withColumns({"lat": lat, "lon": lon})
        tiles = tiles.unionByName(missing)
    return tiles if verbose else tiles.drop("count")


def line_length(verts: Column, longest: float) -> Column:
    """Length of a line without its jumps, in world units."""
    gap = lambda i, c: (verts[i][c] - verts[i - 1][c]).cast("double")
    steps = F.transform(F.sequence(F.lit(1), F.size(verts) - 1), lambda i: F.sqrt(gap(i, "x") * gap(i, "x") + gap(i, "y") * gap(i, "y")))
    whole = F.aggregate(F.filter(steps, lambda d: d < longest), F.lit(0.0), lambda a, d: a + d)
    return F.when(F.size(verts) < 2, 0.0).otherwise(whole)


def in_bbox(points: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Points of a world box, all sides inclusive."""
    return points.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]))


def lengths(segs: DataFrame, track: str, max_zoom: int, min_zoom: int = 0, longest: float = 6400.0) -> DataFrame:
    """Length of lines in tile units per tile of their first vertex; segments
    from ``longest`` world units on count as jumps."""
    d = F.sqrt((F.col("x1") - F.col("x0")).cast("double") ** 2 + (F.col("y1") - F.col("y0")).cast("double") ** 2)
    per_line = segs.groupBy(track).agg(F.min_by(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), "seq").alias("p"), F.sum(F.when(d < longest, d).otherwise(0.0)).alias("len"))
    tiles = pyramid(per_line.select("p.x", "p.y", "len"), max_zoom, min_zoom, len=F.col("len"))
    return tiles.withColumn("len", F.col("len") / F.pow(F.lit(2.0), 32 - F.col("z")))


def with_siblings(tiles: DataFrame) -> DataFrame:
    """Tiles, and the missing ones of each parent's four with count 0."""
    parents = tiles.where("z > 0").select("z", F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py")).distinct()
    two = F.array(F.lit(0), F.lit(1))
    four = parents.withColumn("dx", F.explode(two)).withColumn("dy", F.explode(two))
    four = four.select("z", (2 * F.col("px") + F.col("dx")).alias("x"), (2 * F.col("py") + F.col("dy")).alias("y"))
    missing = four.join(tiles, ["z", "x", "y"], "left_anti").withColumn("count", F.lit(0).cast("long"))
    return tiles.select("z", "x", "y", "count").unionByName(missing)


def listing(tiles: DataFrame, name: str) -> DataFrame:
    """One text line per tile."""
    extra = [F.col(c).cast("string") for c in ("count",) if c in tiles.columns]
    if "lat" in tiles.columns:
        extra.append(F.format_string("%.6f,%.6f", "lat", "lon"))
    if "len" in tiles.columns:
        extra.append(F.format_string("%.6f", "len"))
    return tiles.select(F.concat_ws(" ", F.lit(name), "z", "x", "y", *extra).alias("value"))
