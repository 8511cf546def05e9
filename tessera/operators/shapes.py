"""Shapes in world coordinates: projection, levels, keys, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import mercator, morton


def projected(shapes: DataFrame) -> DataFrame:
    """``verts`` of latitudes and longitudes as world coordinates."""

    def world(v: Column) -> Column:
        x, y = mercator.project(v["lat"], v["lon"])
        return F.struct(x.alias("x"), y.alias("y"))

    return shapes.withColumn("verts", F.transform("verts", world))


def level(verts: Column, mapbits: int = 48) -> Column:
    """Zoom of the smallest tile around all vertices; 0 for single points."""
    differing = F.aggregate(verts, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(v["x"].bitwiseXOR(verts[0]["x"])).bitwiseOR(v["y"].bitwiseXOR(verts[0]["y"])))
    bits = F.when(differing == 0, 0).otherwise(F.length(F.bin(differing)))
    found = F.least(F.lit(mapbits // 2), F.lit(32) - bits)
    return F.when(F.size(verts) == 1, 0).otherwise(found).cast("int")


def record_bytes(n: Column, lev: Column, mapbits: int, metabits: int) -> Column:
    """Bytes of a packed record: a storage report."""
    bits = mapbits + metabits + (mapbits - 2 * lev) * (n - 1)
    return F.ceil(bits / 8).cast("long")


def keyed(shapes: DataFrame, mapbits: int = 48, metabits: int = 0) -> DataFrame:
    """Index rows: verts cut to the precision, legs, level, qkey, meta."""
    cut = F.transform("verts", lambda v: F.struct(morton.truncated(v["x"], mapbits).alias("x"), morton.truncated(v["y"], mapbits).alias("y")))
    masked = F.col("meta").bitwiseAND(F.lit((1 << metabits) - 1 if metabits < 64 else -1))
    rows = shapes.withColumn("verts", cut)
    first = F.col("verts")[0]
    return rows.select(morton.key(first["x"], first["y"], mapbits).alias("qkey"), "verts", masked.alias("meta"), F.size("verts").alias("legs"), level(F.col("verts"), mapbits).alias("level"))


def segments(points: DataFrame, track: str, *order: str) -> DataFrame:
    """Consecutive vertices of each track: x0, y0, x1, y1 and seq from 0."""
    w = Window.partitionBy(track).orderBy(*order)
    ahead = points.withColumns({"seq": F.row_number().over(w) - 1, "x1": F.lead("x").over(w), "y1": F.lead("y").over(w)})
    return ahead.where("x1 IS NOT NULL").select(track, "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1")


def split_antimeridian(segs: DataFrame) -> DataFrame:
    """A segment over half the world wide becomes two, shifted by a world."""
    world = 1 << 32
    dx = F.col("x1") - F.col("x0")
    pair = lambda a, b: F.struct((F.col("x0") + a).alias("x0"), (F.col("x1") + b).alias("x1"))
    plain = F.array(pair(0, 0))
    east, west = F.array(pair(world, 0), pair(0, -world)), F.array(pair(0, world), pair(-world, 0))
    pieces = F.when(dx >= 1 << 31, east).when(dx <= -(1 << 31), west).otherwise(plain)
    others = [c for c in segs.columns if c not in ("x0", "x1")]
    return segs.select(*others, F.explode(pieces).alias("_p")).select(*others, "_p.x0", "_p.x1")


def touches(x0: Column, y0: Column, x1: Column, y1: Column, low: float, high_x: float, high_y: float) -> Column:
    """Whether a segment meets the box [low, high]: the parameter interval of
    both axes and of the segment is not empty; borders count as inside."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    inside = F.lit(True)
    for a, b, top in ((x0, x1, high_x), (y0, y1, high_y)):
        d = b - a
        t0, t1 = F.try_divide(low - a, d), F.try_divide(top - a, d)
        lo = F.when(d == 0, lo).otherwise(F.greatest(lo, F.least(t0, t1)))
        hi = F.when(d == 0, hi).otherwise(F.least(hi, F.greatest(t0, t1)))
        inside = inside & ((d != 0) | ((a >= low) & (a <= top)))
    return inside & (lo <= hi)
