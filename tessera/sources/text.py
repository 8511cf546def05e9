"""Text shapes: reading, validating, and writing them back."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.mercator import MAX_LAT, unproject

_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
#: A point or a meta; a line break may end the last token of a line.
_TOKEN = re.compile(rf"(?:({_NUMBER}),({_NUMBER})|(\d+)?:(-?\d+))(?:\r\n|[\r\n])?", re.ASCII)
_LONG, _WORD = (1 << 63) - 1, (1 << 64) - 1
_PARSED = "verts array<struct<lat: double, lon: double>>, n int, meta long, overflow boolean"
_VERT = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])


def _packed(metas: list[tuple[str | None, str]], metabits: int) -> tuple[int, bool]:
    """Metas (bits, value) as one number, and whether any does not fit; a
    shorter total is left-aligned."""
    limit = (1 << metabits) - 1 if metabits < 63 else _LONG
    out, used, overflow = 0, 0, False
    for b, v in metas:
        bits, value = int(b) if b else metabits, int(v)
        if bits > 0x7FFFFFFF:
            bits = metabits
        # A meta beyond 64 bits counts as the nearest number that fits.
        kept = min(max(value, -_LONG - 1), _LONG)
        overflow = overflow or kept != value or kept > limit
        if used < metabits:
            take = min(bits, metabits - used)
            low = kept & ((1 << bits) - 1 if bits < 64 else _WORD)
            out, used = (out << (take & 63) | low >> (bits - take & 63)) & _WORD, used + take
    out = out << (metabits - used & 63) & _WORD
    return out - (1 << 64) if out > _LONG else out, overflow


def parse_shapes(lines: DataFrame, metabits: int = 0, *, line_col: str = "value") -> DataFrame:
    """``lines`` with verts (latitude and longitude), n, meta and overflow.

    Tokens are separated by spaces: points ``lat,lon``, metas ``:value`` or
    ``bits:value``; the first other token ends the line, so comments are
    ignored.  Several metas are packed in order, the most significant first,
    and the first ``metabits`` bits of them are kept; ``overflow`` tells values
    that do not fit (those beyond 64 bits count as the nearest that do).  Lines without a point
    are dropped.  Everything happens within a row; nothing is shuffled.
    """
    at = lines.columns.index(line_col)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _TOKEN.fullmatch
        for batch in batches:
            kept, ends, lats, lons, packed, wide = [], [0], [], [], [], []
            for row, line in enumerate(batch.column(at).to_pylist()):
                metas = []
                for token in line.split(" ") if line else ():
                    if token:
                        found = match(token)
                        if found is None:
                            break
                        lat, lon, bits, value = found.groups()
                        if lat is None:
                            metas.append((bits, value))
                        else:
                            lats.append(lat)
                            lons.append(lon)
                if len(lats) > ends[-1]:
                    kept.append(row)
                    ends.append(len(lats))
                    meta, overflow = _packed(metas, metabits) if metas else (0, False)
                    packed.append(meta if metabits else 0)
                    wide.append(overflow)
            vert = pa.StructArray.from_arrays([pa.array(map(float, v), pa.float64(), size=len(v)) for v in (lats, lons)], fields=list(_VERT))
            verts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), vert)
            added = [verts, pa.array(np.diff(ends).astype("i4")), pa.array(packed, pa.int64()), pa.array(wide, pa.bool_())]
            own = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *added], [*own.schema.names, "verts", "n", "meta", "overflow"])

    schema = StructType([*lines.schema.fields, *StructType.fromDDL(_PARSED).fields])
    return lines.mapInArrow(parse, schema)


def valid_shapes() -> Column:
    """All vertices of ``verts`` can be projected (NaN cannot)."""
    return F.expr(f"forall(verts, v -> NOT isnan(v.lat) AND NOT isnan(v.lon) AND v.lat BETWEEN -{MAX_LAT}D AND {MAX_LAT}D AND v.lon > -180 AND v.lon < 180)")


def read_text(spark: SparkSession, paths: str | list[str], metabits: int = 0) -> DataFrame:
    return parse_shapes(spark.read.text(paths), metabits)


def read_stream(spark: SparkSession, stream: BinaryIO, folder: str, metabits: int = 0) -> DataFrame:
    """Lines of an open stream, such as standard input: copied to a file in
    ``folder``, which the caller deletes, and read from there in parallel."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/lines.txt")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    while chunk := stream.read(1 << 20):
        out.write(bytearray(chunk))
    out.close()
    return read_text(spark, str(path.toString()), metabits)


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points of GPX files as verts of one point, texts kept exactly."""
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat string, _lon string").load(path)
    return rows.select(F.array(F.struct(F.col("_lat").cast("double").alias("lat"), F.col("_lon").cast("double").alias("lon"))).alias("verts"), F.concat_ws(",", "_lat", "_lon").alias("value"))


def read_dump(lines: DataFrame, *, line_col: str = "value") -> DataFrame:
    """World vertices of dumped lines from their hexadecimal part, exactly."""
    words = F.split(F.regexp_extract(line_col, r"// ([0-9a-f ]*)", 1), " +")
    hexes = F.filter(words, lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(0), (F.size(hexes) / 2).cast("int") - 1), lambda i: F.struct(*(F.conv(F.get(hexes, (2 * i + k).cast("int")), 16, 10).cast("long").alias(n) for k, n in enumerate("xy"))))
    meta = F.regexp_extract(line_col, r" \d+:(-?\d+) +//", 1)
    kept = [c for c in lines.columns if c != line_col]
    return lines.select(*kept, F.when(F.size(hexes) >= 2, pairs).alias("verts"), F.when(meta != "", meta.cast("long")).otherwise(0).alias("meta"))


def _places(verts: Column):
    def both(v: Column) -> tuple[Column, Column]:
        return unproject(v["x"], v["y"])

    return both


def dump_text(verts: Column, meta: Column, metabits: int) -> Column:
    """One line per shape: places, meta, then the exact vertices in hex."""
    both = _places(verts)
    places = F.array_join(F.transform(verts, lambda v: F.format_string("%.6f,%.6f ", *both(v))), "")
    number = F.concat(F.lit(f"{metabits}:"), meta.cast("string"), F.lit(" ")) if metabits else F.lit("")
    hexes = F.array_join(F.transform(verts, lambda v: F.concat(*(F.concat(F.lpad(F.lower(F.hex(v[c])), 8, "0"), F.lit(" ")) for c in "xy"))), "")
    return F.concat(places, number, F.lit("// "), hexes)


def dump_geojson(verts: Column, meta: Column, metabits: int) -> Column:
    """One GeoJSON feature per shape, longitude first."""
    both = _places(verts)
    pairs = F.transform(verts, lambda v: F.format_string("[ %.6f, %.6f ]", *both(v)[::-1]))
    properties = F.concat(F.lit('{ "meta": '), meta.cast("string"), F.lit(" }")) if metabits else F.lit("{ }")
    kind = F.when(F.size(verts) == 1, "Point").otherwise("LineString")
    coordinates = F.when(F.size(verts) == 1, F.array_join(pairs, "")).otherwise(F.concat(F.lit("[ "), F.array_join(pairs, ", "), F.lit(" ]")))
    return F.concat(F.lit('{ "type": "Feature", "properties": '), properties, F.lit(', "geometry": { "type": "'), kind, F.lit('", "coordinates": '), coordinates, F.lit(" } }"))


def write_geojson(features: DataFrame, path: str, *, column: str = "feature") -> None:
    """Newline-delimited features; ``collection`` wraps them in one."""
    features.select(F.col(column)).write.text(path)


def collection(features: Iterable[str]) -> Iterator[str]:
    """Pieces of a FeatureCollection, feature by feature."""
    yield '{ "type": "FeatureCollection", "features": ['
    for k, f in enumerate(features):
        yield (",\n" if k else "\n") + f
    yield "\n] }\n"
