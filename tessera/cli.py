"""Command line: ``python -m tessera.cli encode|merge|enumerate|render ...``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions.mercator import project
from tessera.functions.style import Style, ZoomRules
from tessera.operators import dataset, pyramid, shapes
from tessera.operators.dataset import Dataset
from tessera.plans import render as plans
from tessera.plans.backends import BACKENDS
from tessera.sources import text
from tessera.sources.tree import write_tree


def _colour(v: str) -> tuple[int, int, int]:
    n = int(v, 16)
    return n >> 16 & 255, n >> 8 & 255, n & 255


def _numbers(v: str) -> tuple[float, ...]:
    return tuple(float(x) for x in v.split(":"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    e = sub.add_parser("encode")
    e.add_argument("-z", type=int, default=16)
    e.add_argument("-m", type=int, default=0)
    e.add_argument("-o", required=True)
    e.add_argument("files", nargs="*", help="text files; standard input without any")
    m = sub.add_parser("merge")
    m.add_argument("-o", required=True)
    m.add_argument("-u", action="store_true")
    m.add_argument("dirs", nargs="+")
    n = sub.add_parser("enumerate")
    n.add_argument("-z", type=int)
    n.add_argument("-Z", type=int, default=0)
    for flag in "aDdsv":
        n.add_argument(f"-{flag}", action="store_true")
    n.add_argument("-b", help="minlat,minlon,maxlat,maxlon")
    n.add_argument("dir")
    r = sub.add_parser("render")
    for flag in "AdDrwmsgva":
        r.add_argument(f"-{flag}", action="store_true")
    r.add_argument("-f", action="append", default=[])
    r.add_argument("-T", type=int, default=256)
    r.add_argument("-t", type=int, default=255)
    for flag in "bcS":
        r.add_argument(f"-{flag}", type=_colour)
    for flag in "BO":
        r.add_argument(f"-{flag}", type=_numbers)
    for flag, default in (("e", 2.0), ("G", 0.5), ("L", 1.0), ("l", 1.0)):
        r.add_argument(f"-{flag}", type=float, default=default)
    r.add_argument("-M", type=float)
    r.add_argument("-p", default="1")
    r.add_argument("-C")
    r.add_argument("-x", action="append", default=[])
    r.add_argument("-o")
    r.add_argument("--format", choices=(*BACKENDS, "txt"), default="png")
    r.add_argument("--canned", action="store_true", help="orange dots on nothing, into tiles/<name of dir>")
    r.add_argument("dir")
    r.add_argument("place", nargs="*", type=float, help="z x y, or z and a box with -A; without any, lines of tiles on standard input, as enumerate prints them")
    return top


def style_of(a: argparse.Namespace) -> Style:
    """Options of ``render`` as a style."""
    base = a.B or (13.0, 0.05917, 1.23)
    hues = None
    if a.C:
        given = _numbers(a.C)
        hues = (0.0, 0.0, given[0], 360.0) if len(given) == 1 else given
    area = float(a.p.lstrip("g") or 1)
    extra: dict = {}
    for x in a.x:
        if x[0] == "c":
            extra["circle_feet"] = float(x[1:].rstrip("fm")) * (3.28 if x.endswith("m") else 1)
        elif x[0] in "br":
            extra["scale"] = {"b": "brightness", "r": "radius"}[x[0]]
        elif x[0] == "s":
            extra["color_cap"] = float(x[1:])
        elif x[0] == "u":
            extra["cie"] = True
        elif x[0] == "l":
            extra["max_meta"] = int(x[1:])
        else:
            raise SystemExit(f"unknown -x {x}")
    return Style(tilesize=a.T, dot_base=base[0], dot_bright=base[1], dot_ramp=base[2], exponent=max(1.0, a.e), gamma=a.G, line_thick=a.L, line_ramp=a.l, point_size=area, gaussian=a.p.startswith("g"), background=a.b or (0, 0, 0), transparency=a.t, middle=a.c or (128, 128, 128), saturated=a.S, white=a.w, invert=a.m, no_oversaturation=a.s, hues=hues, mercator_lat=a.M, gps=(a.O or (16.0, 1600.0, 1.5)) if a.g else None, antialias=not a.a, retina=a.r, **extra)


def _show(lines) -> None:
    for r in lines.toLocalIterator():
        print(r["value"])


def _enumerate(spark: SparkSession, a: argparse.Namespace) -> None:
    ds = Dataset(spark, a.dir)
    if a.a or a.D:
        form = text.dump_geojson if a.D else text.dump_text
        _show(ds.ordered().select(form(F.col("verts"), F.col("meta"), ds.metabits).alias("value")))
        return
    deepest = a.z if a.z is not None else ds.mapbits // 2 - 8
    rows = ds.shapes
    if a.b:
        lat0, lon0, lat1, lon1 = map(float, a.b.split(","))
        corners = spark.range(1).select(*(c.alias(n) for n, c in zip("abcd", (*project(F.lit(lat0), F.lit(lon0)), *project(F.lit(lat1), F.lit(lon1))), strict=True))).first()
        first = F.col("verts")[0]
        inside = [first[c].between(min(corners[p], corners[q]), max(corners[p], corners[q])) for c, p, q in (("x", "a", "c"), ("y", "b", "d"))]
        rows = rows.where(inside[0] & inside[1])
    tiles = pyramid.enumerated(rows, deepest, a.Z, verbose=a.v, distance=a.d, siblings=a.s)
    _show(pyramid.listing(tiles.orderBy("z", "x", "y"), a.dir))


def _render(spark: SparkSession, a: argparse.Namespace) -> None:
    s = style_of(a)
    if a.v:
        print(ZoomRules(s).text())
        return
    sets = tuple(Dataset(spark, d) for d in [*a.f, a.dir])
    if a.A:
        z, lat0, lon0, lat1, lon1 = a.place
        listed, _ = plans.tiles_of_box(int(z), (lat0, lon0), (lat1, lon1), s.tilesize)
    elif a.place:
        listed = (tuple(int(v) for v in a.place),)
    else:
        listed = tuple(tuple(int(v) for v in line.split()[-3:] if line.strip()) for line in sys.stdin if line.strip())
    out = a.o
    if a.canned:
        s, out = plans.orange(s), out or f"tiles/{os.path.basename(a.dir.rstrip('/'))}"
    request = plans.Request(sets, listed, s)
    if a.d or a.D:
        lines = plans.dump(spark, request, geojson=a.D)
        if a.D:
            sys.stdout.writelines(text.collection(r["value"] for r in lines.toLocalIterator()))
        else:
            _show(lines)
    elif a.format == "txt":
        _show(plans.pixel_text(spark, request))
    elif a.A and a.format == "png":
        sys.stdout.buffer.write(plans.box_image(spark, sets, int(a.place[0]), tuple(a.place[1:3]), tuple(a.place[3:5]), s))
    else:
        backend = BACKENDS[a.format]
        got = backend.tiles(spark, request)
        if out:
            write_tree(got, out if "://" in out else f"file://{os.path.abspath(out)}", column="data", extension=backend.filetype, description=a.dir)
        else:
            for r in got.toLocalIterator():
                sys.stdout.buffer.write(bytes(r["data"]))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tessera {a.command}").getOrCreate()
    if a.command == "encode":
        copied = f"{a.o.rstrip('/')}.input"
        found = text.read_text(spark, a.files, a.m) if a.files else text.read_stream(spark, sys.stdin.buffer, copied, a.m)
        dataset.write_dataset(shapes.projected(found.where(text.valid_shapes())), a.o, mapbits=2 * (a.z + 8), metabits=a.m)
        if not a.files:
            dataset.delete(spark, copied)
    elif a.command == "merge":
        dataset.merge(spark, a.o, *a.dirs, unique=a.u)
    elif a.command == "enumerate":
        _enumerate(spark, a)
    else:
        _render(spark, a)


if __name__ == "__main__":
    main()
