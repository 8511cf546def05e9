"""Pixels: splats, brushes, lines, and their sum per pixel.

All geometry is in pixel units of a canvas; keys such as (z, x, y) are carried
along, so one job draws any number of tiles.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERSAMPLE = 9


def accumulate(pixels: DataFrame, keys: list[str], size: int | None = None, *, height: int | None = None) -> DataFrame:
    """Sum of light per pixel; hue (-1: none) adds a vector.  Partial sums are
    made before the shuffle.  ``size`` clips to the canvas."""
    if size is not None:
        pixels = pixels.where(F.col("px").between(0, size - 1) & F.col("py").between(0, (height or size) - 1))
    angle = 2 * math.pi * F.col("hue")
    lit = lambda c: F.sum(F.when(F.col("hue") >= 0, F.col("b") * c).otherwise(0.0))
    return pixels.groupBy(*keys, "px", "py").agg(F.sum("b").alias("image"), lit(F.cos(angle)).alias("cx"), lit(F.sin(angle)).alias("cy"))


def splat(dots: DataFrame, x: Column, y: Column, b: Column) -> DataFrame:
    """Bilinear light of a dot at (x, y) on its four pixels: px, py, b."""
    kept = [c for c in dots.columns if c not in ("px", "py", "b")]
    # Computed once per dot.
    whole = lambda v: F.floor(v).cast("long")
    dot = F.struct(whole(x).alias("x"), whole(y).alias("y"), (x - F.floor(x)).alias("fx"), (y - F.floor(y)).alias("fy"), b.alias("b"))
    rows = dots.select(*kept, F.explode(F.array(dot)).alias("_d"))
    rows = rows.select(*kept, "_d", F.explode(F.array(*map(F.lit, range(4)))).alias("_c"))
    i, j = F.shiftright("_c", 1), F.col("_c").bitwiseAND(1)
    part = lambda f, k: F.when(k == 1, F.col(f"_d.{f}")).otherwise(1 - F.col(f"_d.{f}"))
    return rows.select(*kept, (F.col("_d.x") + i).alias("px"), (F.col("_d.y") + j).alias("py"), (F.col("_d.b") * part("fx", i) * part("fy", j)).alias("b"))


def draw_points(dots: DataFrame, tilesize: int, bright: Column) -> DataFrame:
    """Dots at fractions fx, fy of their tile, no larger than a pixel."""
    return splat(dots, F.col("fx") * tilesize - 0.5, F.col("fy") * tilesize - 0.5, bright)


@lru_cache(maxsize=64)
def kernel(brush: float, gaussian: bool = False) -> tuple[tuple[int, int, float], ...]:
    """Cells (dx, dy, weight) of a disk of area ``brush``; weights add up to
    the brush.  The disk is drawn oversampled and binned."""
    radius = OVERSAMPLE * math.sqrt(brush / math.pi)
    width = 2 * math.ceil(radius / OVERSAMPLE) + 1
    big = width * OVERSAMPLE
    mid = big // 2
    cells = np.zeros((width, width))
    for column in range(mid - math.floor(radius), mid + math.floor(radius) + 1):
        half = math.floor(abs(math.sin(math.acos((column - mid) / radius))) * radius)
        for row in range(mid - half, mid + half + 1):
            d2 = ((column - mid) ** 2 + (row - mid) ** 2) / radius**2
            cells[column // OVERSAMPLE, row // OVERSAMPLE] += math.exp(-d2 / (2 / 9)) if gaussian else 1.0
    cells *= brush / cells.sum()
    at = width // 2
    return tuple((i - at, j - at, float(cells[i, j])) for i in range(width) for j in range(width) if cells[i, j])


def draw_brush(dots: DataFrame, tilesize: int, bright: Column, brush: float, gaussian: bool = False) -> DataFrame:
    """Dots of an area of ``brush`` pixels: the kernel is a literal array of a
    size set by the zoom alone, so no join is needed."""
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in kernel(brush, gaussian)))
    rows = dots.withColumn("_k", F.explode(cells))
    return _stamped(rows, tilesize, bright)


def _stamped(rows: DataFrame, tilesize: int, bright: Column) -> DataFrame:
    """Light of dots with one kernel cell ``_k`` each; cells off the canvas go
    before they become pixels."""
    rows = rows.withColumns({f"_{c}": F.col(f"f{c}") * tilesize - 0.5 + F.col(f"_k.{k}") for c, k in (("x", "i"), ("y", "j"))})
    rows = rows.where(F.col("_x").between(-1, tilesize) & F.col("_y").between(-1, tilesize)).withColumn("b", bright * F.col("_k.w"))
    return splat(rows.drop("_k"), F.col("_x"), F.col("_y"), F.col("b")).drop("_x", "_y")


_CELLS = "meta long, cells array<struct<i: int, j: int, w: double>>"


def draw_brush_by_meta(dots: DataFrame, tilesize: int, bright: Column, brush: float, gaussian: bool = False) -> DataFrame:
    """Dots of an area of ``brush`` pixels times their meta; a meta of 0 draws
    nothing.  Kernels are made once per distinct meta and joined."""

    def kernels(batches):
        for b in batches:
            rows = [(int(m), [{"i": i, "j": j, "w": w} for i, j, w in kernel(m * brush, gaussian)]) for m in b["meta"]]
            yield pd.DataFrame(rows, columns=["meta", "cells"])

    known = dots.select("meta").where("meta > 0").distinct().mapInPandas(kernels, _CELLS)
    rows = dots.join(known, "meta").withColumn("_k", F.explode("cells")).drop("cells")
    return _stamped(rows, tilesize, bright)


def with_neighbours(dots: DataFrame, tilesize: int, reach: float | Column, z: int) -> DataFrame:
    """Dots (z, x, y, fx, fy) for every tile their footprint of ``reach``
    pixels (of the row, if a column) touches, with fractions of that tile."""
    r = reach / tilesize
    lo = lambda c: F.floor(c - r).cast("int")
    hi = lambda c: F.floor(c + r).cast("int")
    rows = dots.withColumn("_i", F.explode(F.sequence(lo(F.col("fx")), hi(F.col("fx"))))).withColumn("_j", F.explode(F.sequence(lo(F.col("fy")), hi(F.col("fy")))))
    rows = rows.withColumns({"x": F.col("x") + F.col("_i"), "y": F.col("y") + F.col("_j"), "fx": F.col("fx") - F.col("_i"), "fy": F.col("fy") - F.col("_j")})
    last = (1 << z) - 1
    return rows.where(F.col("x").between(0, last) & F.col("y").between(0, last)).drop("_i", "_j")


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with these columns, each computed once per row: an array of one is
    a fence, so that what follows refers to values, not to the expressions
    behind them, which would be repeated in every use."""
    kept = [c for c in rows.columns if c not in columns]
    fence = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select(*kept, F.explode(F.array(fence)).alias("_f")).select(*kept, *(F.col(f"_f.{n}").alias(n) for n in columns))


def clipped(segs: DataFrame, low: float, high: float) -> DataFrame:
    """Segments x0, y0, x1, y1 cut to the square [low, high]; those outside go."""
    lo, hi, inside = [F.lit(0.0)], [F.lit(1.0)], F.lit(True)
    for a, b in (("x0", "x1"), ("y0", "y1")):
        d = F.nullif(F.col(b) - F.col(a), F.lit(0.0))
        t0, t1 = (low - F.col(a)) / d, (high - F.col(a)) / d
        # Bounds of a flat axis are null, which least and greatest pass over.
        lo.append(F.least(t0, t1))
        hi.append(F.greatest(t0, t1))
        inside = inside & ((F.col(a) != F.col(b)) | F.col(a).between(low, high))
    rows = computed(segs, **{c: F.col(c) for c in ("x0", "y0", "x1", "y1")}).where(inside)
    rows = computed(rows, _lo=F.greatest(*lo), _hi=F.least(*hi)).where("_lo <= _hi")
    cut = {f"{c}{k}": F.col(f"{c}0") + F.col(t) * (F.col(f"{c}1") - F.col(f"{c}0")) for c in "xy" for k, t in ((0, "_lo"), (1, "_hi"))}
    return computed(rows, **cut).drop("_lo", "_hi")


def draw_lines(segs: DataFrame, bright: Column) -> DataFrame:
    """Antialiased lines: each step along the longer axis lights two pixels
    across it, by how much of the step is covered."""
    steep = F.abs(F.col("y1") - F.col("y0")) > F.abs(F.col("x1") - F.col("x0"))
    ends = lambda *names: F.struct(*(F.col(n).alias(a) for n, a in zip(names, "acbd", strict=True)))
    along = F.when(steep, ends("y0", "x0", "y1", "x1")).otherwise(ends("x0", "y0", "x1", "y1"))
    rows = computed(segs, _s=steep, b=bright, _e=along).drop("x0", "y0", "x1", "y1")
    back = F.col("_e.a") > F.col("_e.b")
    pick = lambda a, b: F.when(back, F.col(f"_e.{a}")).otherwise(F.col(f"_e.{b}"))
    rows = computed(rows, _a=pick("b", "a"), _b=pick("a", "b"), _c=pick("d", "c"), _d=pick("c", "d")).drop("_e").where("_b > _a")
    # Two pixels a step, numbered in one sequence.
    rows = rows.withColumn("_n", F.explode(F.sequence(2 * F.floor("_a").cast("long"), 2 * F.floor("_b").cast("long") + 1)))
    rows = rows.withColumns({"_i": F.shiftright("_n", 1), "_k": F.col("_n").bitwiseAND(1)})
    start, end = F.greatest("_a", F.col("_i").cast("double")), F.least("_b", (F.col("_i") + 1).cast("double"))
    across = F.col("_c") + ((start + end) / 2 - F.col("_a")) * (F.col("_d") - F.col("_c")) / (F.col("_b") - F.col("_a"))
    rows = computed(rows, _w=end - start, _y=across).where("_w > 0")
    part, cell = F.col("_y") - F.floor("_y"), F.floor("_y").cast("long") + F.col("_k")
    light = F.col("b") * F.col("_w") * F.when(F.col("_k") == 1, part).otherwise(1 - part)
    kept = [c for c in segs.columns if c not in ("x0", "y0", "x1", "y1", "b")]
    return rows.select(*kept, F.when(F.col("_s"), cell).otherwise(F.col("_i")).alias("px"), F.when(F.col("_s"), F.col("_i")).otherwise(cell).alias("py"), light.alias("b"))


def offsets(thick: float) -> list[tuple[float, float]]:
    """(distance from the centre, share of brightness) of parallel lines that
    make up a thickness."""
    if thick <= 1:
        return [(0.0, thick)]
    out, left, at = [(0.0, 1.0)], thick - 1, 1.0
    while left > 0:
        if left >= 2:
            out += [(at, 1.0), (-at, 1.0)]
        else:
            edge = at - 1 + left / 2
            out += [(edge, left / 2), (-edge, left / 2)]
        left, at = left - 2, at + 1
    return out


def draw_thick_lines(segs: DataFrame, bright: Column, thick: float) -> DataFrame:
    """Lines of a thickness, as parallels along the normal."""
    if thick <= 1:
        return draw_lines(segs, bright * thick)
    pairs = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(s).alias("s")) for o, s in offsets(thick)))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = segs.withColumn("_len", F.sqrt(dx * dx + dy * dy)).where("_len > 0").withColumn("_o", F.explode(pairs))
    nx, ny = -dy / F.col("_len") * F.col("_o.o"), dx / F.col("_len") * F.col("_o.o")
    moved = rows.withColumns({"x0": F.col("x0") + nx, "x1": F.col("x1") + nx, "y0": F.col("y0") + ny, "y1": F.col("y1") + ny, "_b": bright * F.col("_o.s")}).drop("_len", "_o")
    return draw_lines(moved, F.col("_b")).drop("_b")


def draw_plain_lines(segs: DataFrame, thick: float = 1.0) -> DataFrame:
    """Pixels of lines without antialiasing, end point excluded: px, py.

    Of L steps along the longer axis, step k lies ceil((k S - L div 2) / L)
    across it, S being the shorter extent.  ``thick`` repeats pixels across.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    flat = F.abs(dx) > F.abs(dy)
    rows = segs.withColumns({"_f": flat, "_l": F.greatest(F.abs(dx), F.abs(dy)), "_s": F.least(F.abs(dx), F.abs(dy)), "_sx": F.signum(dx).cast("long"), "_sy": F.signum(dy).cast("long")}).where("_l > 0")
    rows = rows.withColumn("_k", F.explode(F.expr("sequence(0L, _l - 1)")))
    rows = rows.withColumn("_m", F.expr("CAST(ceil((_k * _s - _l div 2) / _l) AS bigint)"))
    n = math.ceil(thick / 2) - 1
    rows = rows.withColumn("_n", F.explode(F.array(*(F.lit(i).cast("long") for i in range(-n, n + 1))))) if n > 0 else rows.withColumn("_n", F.lit(0).cast("long"))
    kept = [c for c in segs.columns if c not in ("x0", "y0", "x1", "y1")]
    px = F.when(F.col("_f"), F.col("x0") + F.col("_sx") * F.col("_k")).otherwise(F.col("x0") + F.col("_sx") * F.col("_m") + F.col("_n"))
    py = F.when(F.col("_f"), F.col("y0") + F.col("_sy") * F.col("_m") + F.col("_n")).otherwise(F.col("y0") + F.col("_sy") * F.col("_k"))
    return rows.select(*kept, px.alias("px"), py.alias("py"))


_P = (1 << 31) - 1


def draw(world_x: Column, world_y: Column, n: Column, salt: int) -> Column:
    """A number from 0 to 1 that place, number and salt fix: three squarings
    modulo a prime, in whole numbers that any engine computes alike."""
    h = (world_x * 48271 + world_y * 40692 + n * 69621 + salt) % _P
    for c in (12345, 6789, 24036583):
        h = (h * h + c) % _P
    return h / float(_P)


def scattered(dots: DataFrame, radius: float, step: int, z: int) -> DataFrame:
    """Of every dot as many as its ``meta`` over ``step``, uniform in a circle
    of ``radius`` tiles around it.  Places and the rounding follow from the
    dot's world place and ``rank`` (where it has one), so that neighbouring
    tiles agree and the remainders of dots in a row even out."""
    size = float(2 ** (32 - z))
    rows = dots.withColumns({f"_w{c}": F.round((F.col(c) + F.col(f"f{c}")) * size).cast("long") for c in "xy"})
    # Steps of the golden section fall evenly into the unit interval.
    carry = F.col("rank") * 40503 % 65536 / 65536.0 if "rank" in dots.columns else draw(F.col("_wx"), F.col("_wy"), F.lit(0), 1)
    count = F.floor(F.col("meta") / step + (carry if step > 1 else 0.0)).cast("int")
    rows = rows.withColumn("_count", count).where("_count >= 1").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    own = F.col("_n") + (F.col("rank") * 8191 if "rank" in dots.columns else F.lit(0))
    rows = rows.withColumns({"_r": F.sqrt(draw(F.col("_wx"), F.col("_wy"), own, 2)) * radius, "_a": 2 * math.pi * draw(F.col("_wx"), F.col("_wy"), own, 3)})
    return rows.withColumns({"fx": F.col("fx") + F.col("_r") * F.cos("_a"), "fy": F.col("fy") + F.col("_r") * F.sin("_a")}).drop("_wx", "_wy", "_count", "_n", "_r", "_a")


def scatter(dots: DataFrame, tilesize: int, radius: float, bright: float, z: int, step: int = 1, brush: float = 1.0, gaussian: bool = False) -> DataFrame:
    """Light of scattered dots; circles below half a pixel are one dot of
    their whole light."""
    if radius * tilesize < 0.5:
        rows, light = dots.where("meta > 0"), bright * F.col("meta") / step
    else:
        rows, light = scattered(dots, radius, step, z), F.lit(bright)
    if brush <= 1:
        return draw_points(rows, tilesize, light * brush)
    return draw_brush(rows, tilesize, light, brush, gaussian)


def on_canvas(points: DataFrame, z: int, low: tuple[float, float], tilesize: int) -> DataFrame:
    """Points of a bounding box as canvas fractions: one canvas from its
    north-west corner, without seams between tiles."""
    size = float(2 ** (32 - z))
    place = {f"f{c}": (F.col(c) - F.lit(float(o))) / size for c, o in zip("xy", low, strict=True)}
    return points.withColumns(place)


def pixel_places(pixels: DataFrame, z: int, tilesize: int, offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """Latitude and longitude of each touched pixel."""
    from tessera.functions.mercator import unproject

    size = float(2 ** (32 - z))
    wx = F.col("x") * size + (F.col("px") - offset[0]) * size / tilesize
    wy = F.col("y") * size + (F.col("py") - offset[1]) * size / tilesize
    lat, lon = unproject(wx, wy)
    return pixels.withColumns({"lat": lat, "lon": lon})


def world_places(pixels: DataFrame, tilesize: int) -> tuple[Column, Column]:
    """Latitude and longitude of rows z, x, y, px, py of any zoom; places
    within a tile are cut to whole world units."""
    from tessera.functions.mercator import unproject

    size = F.pow(F.lit(2.0), 32 - F.col("z"))
    wx, wy = (F.col(c) * size + (F.col(f"p{c}") / tilesize * size).cast("long") for c in "xy")
    return unproject(wx, wy)
