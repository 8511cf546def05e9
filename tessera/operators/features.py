"""Features of vector tiles from dots and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.encoders import CELLS, EXTENT


def point_features(dots: DataFrame) -> DataFrame:
    """The k-th point of a cell of its tile and meta goes to feature k, so the
    points of one feature lie apart."""
    place = {"cx": F.floor(F.col("fx") * CELLS), "cy": F.floor(F.col("fy") * CELLS), "vx": (F.col("fx") * EXTENT).cast("long"), "vy": (F.col("fy") * EXTENT).cast("long")}
    keys = ["z", "x", "y", "meta", "cx", "cy"]
    order = Window.partitionBy(*keys).orderBy("vx", "vy")
    return dots.withColumns(place).withColumn("feature", (F.row_number().over(order) - 1).cast("long")).select(*keys, "feature", "vx", "vy")


def line_features(segs: DataFrame, size: int) -> DataFrame:
    """Segments (z, x, y, meta, x0 ... y1) in tile units; layers are dealt when
    a tile is encoded."""
    unit = lambda c: F.floor(F.col(c) * EXTENT / size).cast("long").alias(f"v{c}")
    rows = segs.select("z", "x", "y", "meta", F.lit("line").alias("kind"), F.lit(0).cast("long").alias("feature"), unit("x0"), unit("y0"), unit("x1"), unit("y1"))
    return rows.where("vx0 <> vx1 OR vy0 <> vy1")


def as_rows(points: DataFrame) -> DataFrame:
    """Point features in the form of lines without length, for one table."""
    place = {f"v{c}{k}": F.col(f"v{c}") for c in "xy" for k in (0, 1)}
    return points.withColumns(place).select("z", "x", "y", "meta", F.lit("point").alias("kind"), "feature", "vx0", "vy0", "vx1", "vy1")
