"""Shapes of tiles: range predicates and prefix joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import mercator, morton
from tessera.operators.dataset import TOP_TIER
from tessera.operators.shapes import touches


def tile_points(points: DataFrame, z: int, x: int, y: int) -> DataFrame:
    """Points of one tile: a range of the stored key, pushed to the scan."""
    return points.where(morton.in_tile(F.col("qkey"), z, x, y))


Tile = tuple[int, int, int]


def around(tiles: list[Tile], spread: int) -> list[Tile]:
    """Tiles of one zoom and those up to ``spread`` tiles away."""
    out = {(z, x + i, y + j) for z, x, y in tiles for i in range(-spread, spread + 1) for j in range(-spread, spread + 1)}
    return sorted(t for t in out if 0 <= t[1] < 1 << t[0] and 0 <= t[2] < 1 << t[0])


def points_near(points: DataFrame, tiles: list[Tile], spread: int = 0) -> DataFrame:
    """Points whose key lies in the ranges of these tiles (a few ranges that
    may cover a little more): what a request reads of the stored points."""
    while spread > 2 and min(t[0] for t in tiles) > 0:  # ancestors serve as well
        tiles, spread = sorted({(z - 1, x >> 1, y >> 1) for z, x, y in tiles}), -(-spread // 2)
    if any(z <= 0 for z, _, _ in tiles):
        return points
    ranges = morton.merged_ranges([morton.tile_range(*t) for t in around(tiles, spread)])
    return points.where(morton.in_ranges(F.col("qkey"), ranges))


def bordering(tiles: list[Tile]) -> list[Tile]:
    """Tiles of one zoom and those east and south of them, whose first row and
    column of places lie on the border of a tile, which counts as inside."""
    out = {(z, x + i, y + j) for z, x, y in tiles for i in (0, 1) for j in (0, 1)}
    return sorted(t for t in out if t[1] < 1 << t[0] and t[2] < 1 << t[0])


#: Tiles of a request that go to every task of a join.
SENT = 20_000


def listed(spark: SparkSession, tiles: list[Tile]) -> DataFrame:
    """Rows z, x, y of a request.  They are sent to the rows they are joined
    with, so that what lies in one tile is not gathered in one task."""
    rows = spark.createDataFrame(tiles, "z int, x long, y long")
    return F.broadcast(rows) if len(tiles) <= SENT else rows


def lines_near(lines: DataFrame, tiles: list[Tile], deepest: int | None = None) -> DataFrame:
    """Lines that may meet tiles of one zoom, by folder and key range: those
    that start in a tile or one that borders on it, and per level above it
    those of its ancestors."""
    z = tiles[0][0]
    key, level = F.col("qkey"), F.col("level")
    below = level > z
    if deepest is not None:
        below = below & (level <= z + deepest)
    tiles = bordering(tiles)
    own = [morton.tile_range(*t) for t in tiles]
    found = below & morton.in_ranges(key, morton.merged_ranges(own)) if z else below
    for up in range(z + 1):
        at = sorted({(z - up, x >> up, y >> up) for _, x, y in tiles})
        reach = morton.in_ranges(key, morton.merged_ranges([morton.tile_range(*t) for t in at], 16)) if z > up else F.lit(True)
        found = found | ((level == z - up) & reach)
    return lines.where(found)


def points_of_tiles(points: DataFrame, tiles: DataFrame, zooms: list[int]) -> DataFrame:
    """Points with every listed tile they fall in: an equi-join by tile."""
    at = points.withColumn("z", F.explode(F.array(*(F.lit(z) for z in zooms))))
    at = at.withColumns({"tx": mercator.tile_of(F.col("x"), F.col("z")), "ty": mercator.tile_of(F.col("y"), F.col("z"))})
    keys = tiles.select("z", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return at.join(keys, ["z", "tx", "ty"])


def lines_of_tiles(lines: DataFrame, tiles: DataFrame, *, mapbits: int = 48, deepest: int | None = None, zooms: list[int] | None = None) -> DataFrame:
    """(tile, line) pairs that meet: one equi-join on the prefix, then the
    exact test.

    A line is found by the tile that encloses it, cut to the zoom of the tiles
    where it lies below: that is a tile itself, an ancestor, or the same of the
    tiles east and south of it, whose lines may touch its border.
    ``deepest`` leaves out lines whose enclosing tile is so many zooms below
    that they would be less than a pixel.
    """
    if zooms is None:
        zooms = [r["z"] for r in tiles.select("z").distinct().collect()]  # a few zooms
    near = F.expr("transform(sequence(0, 3), k -> named_struct('x', x + k % 2, 'y', y + k div 2))")
    enclosing = F.expr("array_distinct(transform(_near, t -> named_struct('ax', shiftrightunsigned(t.x, z - _up), 'ay', shiftrightunsigned(t.y, z - _up))))")
    own = tiles.select("z", "x", "y", near.alias("_near"), F.explode(F.sequence(F.lit(0), F.least("z", F.lit(mapbits // 2)))).alias("_up"))
    own = own.select("z", "x", "y", "_up", F.explode(enclosing).alias("_e")).select("z", "x", "y", "_up", "_e.*")
    first, last = F.col("verts")[0], F.element_at("verts", -1)
    at = lines.withColumn("z", F.explode(F.array(*(F.lit(z) for z in zooms))))
    if deepest is not None:
        at = at.where(F.col("level") <= F.col("z") + deepest)
    at = at.withColumn("_up", F.least("level", "z"))
    placed = at.withColumns({"ax": mercator.tile_of(first["x"], F.col("_up")), "ay": mercator.tile_of(first["y"], F.col("_up"))})
    both = placed.join(own, ["z", "_up", "ax", "ay"]).drop("_up", "ax", "ay")
    size = F.pow(F.lit(2.0), 32 - F.col("z"))
    part = lambda v, c: (v[c] - F.col(c) * size) / size
    met = F.exists(F.sequence(F.lit(1), F.size("verts") - 1), lambda i: touches(part(F.col("verts")[i - 1], "x"), part(F.col("verts")[i - 1], "y"), part(F.col("verts")[i], "x"), part(F.col("verts")[i], "y"), 0.0, 1.0, 1.0))
    # Most lines are told by their ends alone, in whole numbers.
    bits = (F.lit(32) - F.col("z")).cast("int")
    low = lambda c: F.call_function("shiftleft", F.col(c), bits)
    high = lambda c: F.call_function("shiftleft", F.col(c) + 1, bits)
    inside = lambda v: v["x"].between(low("x"), high("x")) & v["y"].between(low("y"), high("y"))
    beside = lambda c: (F.greatest(first[c], last[c]) < low(c)) | (F.least(first[c], last[c]) > high(c))
    apart = (F.size("verts") == 2) & (beside("x") | beside("y"))
    return both.where((F.size("verts") > 1) & (inside(first) | inside(last) | (~apart & met)))


def sampled(ranked: DataFrame, step: int) -> DataFrame:
    """Every step-th point in key order; powers of two use the stored lod,
    and the folders of its tiers where the points have them."""
    if step > 1 and step & (step - 1) == 0:
        lod = step.bit_length() - 1
        kept = ranked.where(F.col("lod") >= lod)
        return kept.where(F.col("tier") >= min(lod - lod % 2, TOP_TIER)) if "tier" in ranked.columns else kept
    return ranked.where(F.col("rank") % step == 0)


def without_nested(tiles: list[Tile]) -> list[Tile]:
    """Tiles that lie in no other one of the list."""
    every = set(tiles)
    return sorted(t for t in every if not any((t[0] - k, t[1] >> k, t[2] >> k) in every for k in range(1, t[0] + 1)))
