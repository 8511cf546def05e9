"""Styling of points and lines: brightness, hue, noise, tone mapping."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feet to degrees of longitude at the equator, and feet per metre.
FOOT_DEGREES, FEET_PER_METRE = 0.00000274, 3.28


@dataclass(frozen=True)
class Style:
    """Drawing options with their defaults."""

    tilesize: int = 256
    dot_base: float = 13.0
    dot_bright: float = 0.05917
    dot_ramp: float = 1.23
    exponent: float = 2.0
    gamma: float = 0.5
    line_thick: float = 1.0
    line_ramp: float = 1.0
    point_size: float = 1.0
    gaussian: bool = False
    background: tuple[int, int, int] = (0, 0, 0)
    transparency: int = 255
    middle: tuple[int, int, int] = (128, 128, 128)
    saturated: tuple[int, int, int] | None = None
    white: bool = False
    invert: bool = False
    no_oversaturation: bool = False
    color_cap: float = 0.7
    cie: bool = False
    hues: tuple[float, float, float, float] | None = None  # meta1, hue1, meta2, hue2
    scale: str | None = None  # meta scales "brightness" or "radius"
    max_meta: int | None = None
    circle_feet: float | None = None
    mercator_lat: float | None = None
    gps: tuple[float, float, float] | None = None  # base, distance, ramp
    antialias: bool = True
    retina: bool = False

    @property
    def fg(self) -> tuple[int, int, int]:
        return self.saturated or ((0, 0, 0) if self.white else (255, 255, 255))

    @property
    def bg(self) -> tuple[int, int, int]:
        return (255, 255, 255) if self.white and self.background == (0, 0, 0) else self.background


#: Preset for one canned tile: no background, orange dots.
TRANSPARENT_ORANGE = Style(transparency=0, middle=(0xFF, 0x88, 0x00))


@dataclass(frozen=True)
class PointLook:
    """What a zoom gives for points: keep every step-th, dot area, light."""

    step: int
    brush: float
    bright: float


def point_look(s: Style, z: int, y: int | None = None) -> PointLook:
    """Step, brush and brightness of points at zoom ``z``."""
    bright = s.dot_bright * s.dot_ramp ** (z - s.dot_base)
    if z > s.dot_base:
        step, brush = 1, 2.0 ** (z - s.dot_base)
    else:
        step, brush = math.floor(s.exponent ** (s.dot_base - z) + 0.5), 1.0
        bright *= step / 2 ** (s.dot_base - z)
    bright, brush = bright / s.point_size, brush * s.point_size
    if s.mercator_lat is not None and s.mercator_lat >= 0 and y is not None:
        from tessera.functions.mercator import centre_latitude

        brush *= math.cos(math.radians(s.mercator_lat)) ** 2 / math.cos(centre_latitude(y, z)) ** 2
    return PointLook(step, brush * (s.tilesize / 256) ** 2, bright)


def by_meta(value: Column, meta: Column, scaled: bool) -> Column:
    """Brightness or dot area, times the meta value where the style says so."""
    return value * meta if scaled else value


def drawn_metas(rows, s: Style):
    """Rows whose meta value is not above the style's largest."""
    return rows if s.max_meta is None else rows.where(F.col("meta") <= s.max_meta)


def line_look(s: Style, z: int) -> tuple[float, float]:
    """(brightness, drawn thickness) of lines at zoom ``z``."""
    bright, thick = s.dot_bright * 6.64 / s.line_thick, s.line_thick
    if s.line_ramp >= 1:
        thick *= s.line_ramp ** (z - s.dot_base)
        bright *= (s.dot_ramp / s.line_ramp) ** (z - s.dot_base)
    else:
        bright *= s.dot_ramp ** (z - s.dot_base)
    return bright, thick * s.tilesize / 256


def cloud_size(feet: float, z: int, y: int) -> float:
    """Radius of a scatter circle in tile units."""
    from tessera.functions.mercator import centre_latitude

    return feet * FOOT_DEGREES / math.cos(centre_latitude(y, z)) / (360 / 2**z)


def hue(meta: Column, m1: float, h1: float, m2: float, h2: float) -> Column:
    """Hue in [0, 1] of a meta value, -1 where uncoloured."""
    h = ((meta - m1) / (m2 - m1) * (h2 - h1) + h1) / 360
    wrapped = F.when((h > 0) & (h == F.floor(h)), F.lit(1.0)).otherwise(h - F.floor(h))
    return F.when(h < -2, F.lit(-1.0)).when((h >= 0) & (h <= 1), h).otherwise(wrapped)


def noise(x: Column, y: Column, mapbits: int) -> tuple[Column, Column]:
    """Fill the bits below the stored precision from the other axis."""
    nb = 32 - mapbits // 2
    for i in range(nb):
        at = 2 * nb - 1 - i
        if at > 31:
            continue
        x = x.bitwiseOR(F.shiftleft(F.shiftright(y, at).bitwiseAND(F.lit(1)), i))
        y = y.bitwiseOR(F.shiftleft(F.shiftright(x, at).bitwiseAND(F.lit(1)), i))
    return x, y


def gps_brightness(bright: Column, dx: Column, dy: Column, z: int, gps: tuple[float, float, float] = (16.0, 1600.0, 1.5)) -> Column:
    """Brightness of a segment dimmed by its length; null below visibility."""
    base, distance, ramp = gps
    least = distance * ramp ** (base - z)
    dist = F.sqrt(dx * dx + dy * dy)
    dimmed = F.when(dist > least, bright / (dist / least)).otherwise(bright)
    return F.when(dimmed >= 0.0025, dimmed)


def snapped(frac: Column, tilesize: int) -> Column:
    """Middle of the pixel a fraction falls in (no antialiasing)."""
    return (F.floor(frac * tilesize) + 0.5) / tilesize


def _whole(v: Column) -> Column:
    """Truncated, where a value a rounding step below a whole number counts
    as that number: results then agree whatever the order of the sums."""
    return F.round(v, 9).cast("int")


def _byte(v: Column) -> Column:
    return F.least(F.greatest(_whole(v), F.lit(0)), F.lit(255))


def tone_map(image: Column, cx: Column, cy: Column, s: Style) -> tuple[Column, Column, Column, Column]:
    """(r, g, b, a) of an accumulated pixel."""
    coloured = (cx != 0) | (cy != 0)
    sat = F.when(coloured & (image != 0), F.hypot(cx, cy) / image).otherwise(F.lit(0.0))
    h = F.atan2(cy, cx)
    mids = []
    for k, c in enumerate(s.middle):
        if s.cie:
            turn, gain = ((math.pi - 2, 0.417211), (math.pi + 1.5, 0.158136), (math.pi, 0.455928))[k]
            angle = h + (math.pi / 2 - (math.pi - 2))
            v = F.sin(angle + turn) * gain * F.least(sat, F.lit(1.0)) + 0.5
            mids.append(F.when(coloured, _byte(255 * F.pow(v * 0.923166 + 0.0791025, F.lit(1.25)))).otherwise(F.lit(c)))
        else:
            turned = -(h / (2 * math.pi) + 0.5)
            wave = 255 * F.pow(F.sin(math.pi * (turned + k / 3)), F.lit(2.0))
            mids.append(F.when(coloured, _whole(wave * sat + c * (1 - sat))).otherwise(F.lit(c)))
    level = image
    if s.gamma != 1:
        level = F.when(image != 0, F.pow(image, F.lit(s.gamma))).otherwise(F.lit(0.0))
    if s.invert:
        level = F.greatest(F.lit(0.0), 0.5 - level)
    capped = F.when(sat != 0, F.least(level, F.lit(s.color_cap))).otherwise(level)
    if s.no_oversaturation:
        capped = F.least(capped, F.lit(1.0)) * 0.5
    a = capped / 0.5
    o = (255 * a + s.transparency * (1 - a)) / 255
    over = (capped - 0.5) / 0.5
    out = []
    for mid, bg, fg in zip(mids, s.bg, s.fg, strict=True):
        low = mid * (a / o) + bg * (1 - a / o)
        out.append(F.when(level == 0, F.lit(bg)).when(capped <= 0.5, _byte(low)).when(capped <= 1, _byte(fg * over + mid * (1 - over))).otherwise(F.lit(fg)).cast("int"))
    alpha = F.when(level == 0, F.lit(s.transparency)).when(capped <= 0.5, _byte(o * 255)).otherwise(F.lit(255)).cast("int")
    return (*out, alpha)


@dataclass(frozen=True)
class ZoomRules:
    """Text style rules of a data set by zoom (no data access)."""

    style: Style = field(default_factory=Style)
    max_zoom: int = 22

    def rows(self) -> list[tuple[int, float, float]]:
        """(zoom, opacity, line width)."""
        s, out = self.style, []
        for z in range(self.max_zoom + 1):
            at = min(z, s.dot_base)
            steps = 1 / (s.dot_bright / s.point_size * s.dot_ramp ** (z - s.dot_base))
            half = steps * math.exp(math.log(0.5) / s.gamma)
            opacity = 1 - math.exp(math.log(0.5) / half)
            size = s.point_size * 2 ** (z - at)
            out.append((z, opacity, 2 * math.sqrt(size / math.pi)))
        return out

    def text(self) -> str:
        """The style sheet itself."""
        bg = self.style.bg
        lines = ["Map {", f"  background-color: rgba({bg[0]},{bg[1]},{bg[2]},{self.style.transparency / 255:.3f});", "}"]
        lines += ["#points, #lines {", "  line-comp-op: plus;"]
        for z, opacity, width in self.rows():
            lines.append(f"  [zoom = {z}] {{ line-opacity: {opacity:.6f}; line-width: {width:.6f}; }}")
        return "\n".join([*lines, "}"])


def with_retina(s: Style, z: int, x: int, y: int) -> tuple[Style, int, int, int, int, int]:
    """The request for a retina tile: style, z, x, y and pixel offsets."""
    if z == 0:
        return s, z, x, y, 0, 0
    return replace(s, tilesize=2 * s.tilesize), z - 1, x // 2, y // 2, -s.tilesize * (x % 2), -s.tilesize * (y % 2)
