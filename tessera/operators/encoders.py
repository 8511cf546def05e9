"""Binary tile formats: PNG and vector tiles.

An image takes at most size^2 pixels, which pass one canvas.  A vector tile is
one record by its format, so the task that writes it holds its bytes; the
features are dealt and packed in parts of a tile before, in any number of
tasks.  A feature has at most ``FEATURE_POINTS`` points or lines, a further one
takes the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENT, CELLS, FEATURE_POINTS = 4096, 256, 10_000
_IMAGES = 64
#: Lines of a part of a crowded tile, and the numbers of point features of one.
PART_LINES, PART_FEATURES = 9_000, 16
#: Points that are dealt at once, and bytes of packed features of a batch.
_BLOCK, _BATCH = 1 << 18, 1 << 22
MOVE_TO, LINE_TO, CLOSE_PATH = 1, 2, 7
#: Field numbers of the tile format.
TILE_LAYER = 3
LAYER_NAME, LAYER_FEATURE, LAYER_KEY, LAYER_VALUE, LAYER_EXTENT, LAYER_VERSION = 1, 2, 3, 4, 5, 15
FEATURE_TAGS, FEATURE_TYPE, FEATURE_GEOMETRY = 2, 3, 4
VALUE_INT = 4
LINESTRING = 2


def png(rgba: np.ndarray) -> bytes:
    """8-bit RGBA image without interlacing."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = rgba.shape[:2]
    lines = np.concatenate([np.zeros((height, 1), "u1"), rgba.reshape(height, width * 4).astype("u1")], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of an image that ``png`` wrote."""
    at, parts = 8, {}
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        parts[data[at + 4 : at + 8]] = data[at + 8 : at + 8 + n]
        at += 12 + n
    width, height = struct.unpack(">II", parts[b"IHDR"][:8])
    return np.frombuffer(zlib.decompress(parts[b"IDAT"]), "u1").reshape(height, 1 + 4 * width)[:, 1:].reshape(height, width, 4)


def png_tiles(pixels: DataFrame, size: int, background: tuple[int, int, int, int]) -> DataFrame:
    """(z, x, y, image) from pixels z, x, y, px, py, r, g, b, a.

    Pixels come sorted by tile, so a task holds one canvas and one batch."""
    blank = int.from_bytes(bytes(background), "little")
    colour = F.col("r").cast("long") + F.col("g") * (1 << 8) + F.col("b") * (1 << 16) + F.col("a").cast("long") * (1 << 24)
    rows = pixels.select("z", "x", "y", (F.col("py") * size + F.col("px")).cast("int").alias("at"), colour.alias("colour"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, canvas = None, np.empty(size * size, "<u4")
        done: list[tuple] = []

        def finished() -> tuple:
            return (*key, png(canvas.view("u1").reshape(size, size, 4)))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["z", "x", "y", "image"])
            done.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            z, x, y, at, light = (c.to_numpy() for c in b.columns)
            change = np.flatnonzero((np.diff(z) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for i, j in zip([0, *change], [*change, len(z)], strict=True):
                own = (int(z[i]), int(x[i]), int(y[i]))
                if own != key:
                    if key is not None:
                        done.append(finished())
                        if len(done) >= _IMAGES:
                            yield flush()
                    key = own
                    canvas[:] = blank
                canvas[at[i:j]] = light[i:j]
        if key is not None:
            done.append(finished())
            yield flush()

    return rows.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y").mapInArrow(encode, "z int, x long, y long, image binary")


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        if not n:
            out.append(low)
            return bytes(out)
        out.append(low | 128)


def _field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value & (1 << 64) - 1)


def geometry(commands: list[tuple[int, int, int]]) -> list[int]:
    """Integers of (command, x, y): runs of one command share a head, places
    are differences in zigzag form; closing a path has none."""
    out: list[int] = []
    last, at, cx, cy = None, 0, 0, 0
    for command, x, y in commands:
        if command != last:
            last, at = command, len(out)
            out.append(command)
        out[at] += 8
        if command != CLOSE_PATH:
            for d in (x - cx, y - cy):
                out.append(d << 1 if d >= 0 else (-d << 1) - 1)
            cx, cy = x, y
    return out


def packed(lines: np.ndarray, first: np.ndarray, *, joined: bool = True) -> list[bytes]:
    """Geometries of features: rows x0, y0, x1, y1, of which ``first`` tells
    where a feature begins.  Unless ``joined`` every line has its own move."""
    x0, y0, x1, y1 = lines.T
    px, py = (np.where(first, 0, np.concatenate([[0], v[:-1]])) for v in (x1, y1))
    move = first | (x0 != px) | (y0 != py) if joined else np.ones(len(lines), bool)
    heads = np.flatnonzero(move)
    runs = np.diff(np.append(heads, len(lines)))
    ends = np.cumsum(np.where(move, 6, 2))
    zigzag = lambda d: (d << 1) ^ (d >> 63)
    out = np.empty(ends[-1], np.int64)
    out[ends - 2], out[ends - 1] = zigzag(x1 - x0), zigzag(y1 - y0)
    at = ends[heads] - 6
    out[at], out[at + 3] = 1 << 3 | MOVE_TO, runs << 3 | LINE_TO
    out[at + 1], out[at + 2] = zigzag((x0 - px)[heads]), zigzag((y0 - py)[heads])
    width = 1 + sum((out >> 7 * k > 0).astype(np.int64) for k in range(1, 6))
    stops = np.cumsum(width)
    data = np.empty(stops[-1], "u1")
    for k in range(int(width.max())):
        more = width > k
        data[(stops - width)[more] + k] = (out[more] >> 7 * k & 127) | np.where(width[more] > k + 1, 128, 0)
    cuts = (stops - width)[ends[first] - 6].tolist()
    whole = data.tobytes()
    return [whole[i:j] for i, j in zip(cuts, [*cuts[1:], len(whole)], strict=True)]


def layer(name: str, features: list[tuple[int, bytes]]) -> bytes:
    """A layer of (meta, geometry); values are listed as they are first seen."""
    values: dict[int, int] = {}
    body = [_number(LAYER_VERSION, 1), _field(LAYER_NAME, name.encode())]
    for meta, path in features:
        tags = varint(0) + varint(values.setdefault(meta, len(values)))
        body.append(_field(LAYER_FEATURE, _field(FEATURE_TAGS, tags) + _number(FEATURE_TYPE, LINESTRING) + _field(FEATURE_GEOMETRY, path)))
    body.append(_field(LAYER_KEY, b"meta"))
    body += [_field(LAYER_VALUE, _number(VALUE_INT, v)) for v in values]
    return b"".join([*body, _number(LAYER_EXTENT, EXTENT)])


def vector_tile(lines: list[tuple[int, bytes]], points: list[tuple[int, bytes]]) -> bytes:
    tile = b"".join(_field(TILE_LAYER, layer(n, f)) for n, f in (("lines", lines), ("points", points)) if f)
    return zlib.compress(tile)


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a message: whole numbers and byte strings."""
    at, out = 0, []

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b, at = data[at], at + 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        head = number()
        if head & 7:
            size = number()
            out.append((head >> 3, data[at : at + size]))
            at += size
        else:
            out.append((head >> 3, number()))
    return out


def _numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def tile_features(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(layer, meta, geometry) of each feature of a tile, in order."""
    for _, body in _fields(memoryview(zlib.decompress(data))):
        fields = _fields(body)
        values = [_fields(v)[0][1] for n, v in fields if n == LAYER_VALUE]
        name = bytes(next(v for n, v in fields if n == LAYER_NAME)).decode()
        for _, feature in (f for f in fields if f[0] == LAYER_FEATURE):
            own = dict(_fields(feature))
            meta = values[_numbers(own[FEATURE_TAGS])[1]]
            yield name, meta - (1 << 64) if meta >> 63 else meta, own[FEATURE_GEOMETRY]


def read_points(path: bytes) -> np.ndarray | None:
    """Places (x, y) of a geometry of moves with a line of one unit each; None
    for any other."""
    data = np.frombuffer(path, "u1")
    stops = np.flatnonzero(data < 128)
    if len(stops) % 6:
        return None
    starts = np.concatenate([[0], stops[:-1] + 1])
    numbers = np.zeros(len(stops), np.int64)
    for k in range(int((stops - starts).max(initial=-1)) + 1):
        more = starts + k <= stops
        numbers[more] |= (data[starts[more] + k].astype(np.int64) & 127) << 7 * k
    numbers = numbers.reshape(-1, 6)
    if (numbers[:, [0, 3, 4, 5]] != (1 << 3 | MOVE_TO, 1 << 3 | LINE_TO, 2, 0)).any():
        return None
    return np.cumsum((numbers[:, 1:3] >> 1 ^ -(numbers[:, 1:3] & 1)) + (1, 0), 0) - (1, 0)


def read_commands(path: bytes) -> list[tuple[int, int, int]]:
    """Commands with their places of a geometry."""
    commands, x, y, numbers = [], 0, 0, iter(_numbers(path))
    for head in numbers:
        for _ in range(head >> 3):
            if head & 7 != CLOSE_PATH:
                dx, dy = ((v >> 1) ^ -(v & 1) for v in (next(numbers), next(numbers)))
                x, y = x + dx, y + dy
            commands.append((head & 7, x, y))
    return commands


def line_commands(lines: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Lines that go on where the last one ended need no move."""
    out: list[tuple[int, int, int]] = []
    for x0, y0, x1, y1 in lines:
        if not out or out[-1][1:] != (x0, y0):
            out.append((MOVE_TO, x0, y0))
        out.append((LINE_TO, x1, y1))
    return out


def layered(lines: list[tuple[int, int, int, int]] | np.ndarray, width: int = CELLS) -> list[np.ndarray]:
    """Deal lines, in order, to the first layer that their cells do not touch
    yet and that has room.  Every cell has the set of its layers as the bits of
    a number, so a line takes one step per cell, however many layers there are."""
    lines = np.asarray(lines, np.int64).reshape(-1, 4)
    lines = lines[(lines[:, 0] != lines[:, 2]) | (lines[:, 1] != lines[:, 3])]
    if not len(lines):
        return []
    cells, sizes = _cells(lines * width // EXTENT)
    used = [0] * (max(cells) + 1)
    counts: list[int] = []
    full, at, out = 0, 0, []
    for n in sizes:
        own, at = cells[at : at + n], at + n
        taken = full
        for c in own:
            taken |= used[c]
        free = ~taken & (taken + 1)
        for c in own:
            used[c] |= free
        k = free.bit_length() - 1
        if k == len(counts):
            counts.append(0)
        counts[k] += 1
        if counts[k] == FEATURE_POINTS:
            full |= free
        out.append(k)
    order = np.argsort(out, kind="stable")
    return np.split(lines[order], np.cumsum(counts)[:-1])


def _cells(lines: np.ndarray) -> tuple[list[int], list[int]]:
    """Numbers of the cells of all lines, one after another, and how many each
    line has; its end is among them."""
    x0, y0, x1, y1 = lines.T
    dx, dy = x1 - x0, y1 - y0
    long, short = np.maximum(abs(dx), abs(dy)), np.minimum(abs(dx), abs(dy))
    flat = abs(dx) > abs(dy)
    sizes = long + 1
    line = np.repeat(np.arange(len(lines)), sizes)
    k = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    run = np.maximum(long, 1)[line]
    across = np.where(k < long[line], -((long[line] // 2 - k * short[line]) // run), short[line])
    x = x0[line] + np.sign(dx)[line] * np.where(flat[line], k, across)
    y = y0[line] + np.sign(dy)[line] * np.where(flat[line], across, k)
    x, y = x - x.min(), y - y.min()
    return (x * (int(y.max()) + 1) + y).tolist(), sizes.tolist()


def point_groups(features: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Feature of each point of one meta, in the given order: the one it has,
    or the next with less than ``FEATURE_POINTS`` points."""
    if not len(features) or np.unique(features, return_counts=True)[1].max() <= FEATURE_POINTS:
        return features
    out, filled, after, used = np.empty(len(features), np.int64), {}, {}, {}
    for i, cell in enumerate(cells.tolist()):
        p, passed = used.get(cell, 0), []
        while p in after:  # full: to one that was not when last seen
            passed.append(p)
            p = after[p]
        for q in passed:
            after[q] = p
        out[i], used[cell] = p, p + 1
        filled[p] = filled.get(p, 0) + 1
        if filled[p] == FEATURE_POINTS:
            after[p] = p + 1
    return out


def _line_features(v: np.ndarray) -> list[bytes]:
    layers = layered(v)
    if not layers:
        return []
    first = np.zeros(sum(map(len, layers)), bool)
    first[np.cumsum([0, *map(len, layers[:-1])])] = True
    return packed(np.concatenate(layers), first)


def _point_features(feature: np.ndarray, v: np.ndarray) -> list[bytes]:
    x, y = v[:, 0], v[:, 1]
    group = point_groups(feature, (x * CELLS // EXTENT) * CELLS + y * CELLS // EXTENT)
    order = np.argsort(group, kind="stable")
    x, y, group = x[order], y[order], group[order]
    return packed(np.stack([x, y, x + 1, y], 1), np.diff(group, prepend=group[0] - 1) != 0, joined=False)


_PART = ["z", "x", "y", "layer", "meta", "part"]
_PACKED = pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("layer", pa.int32()), ("meta", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("features", pa.list_(pa.binary()))])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows of equal keys (the first columns) of sorted batches."""
    for b in batches:
        if b.num_rows:
            change = np.zeros(b.num_rows - 1, bool)
            for c in b.columns[:keys]:
                change |= np.diff(c.to_numpy()) != 0
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                run = b.slice(i, j - i)
                yield tuple(c[0].as_py() for c in run.columns[:keys]), run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed features of the parts of tiles, a block of rows at a time."""
    key, held, n, block, done, size = None, [], 0, 0, [], 0

    def finish() -> None:
        nonlocal held, n, block, size
        rows = np.concatenate(held)
        made = _point_features(rows[:, 0], rows[:, 1:3]) if key[3] else _line_features(rows[:, 1:])
        if made:
            done.append((*key, block, made))
            size += sum(map(len, made)) + 64 * len(made)
        held, n, block = [], 0, block + 1

    def batch() -> pa.RecordBatch:
        nonlocal size
        out = pa.RecordBatch.from_pylist([dict(zip(_PACKED.names, r, strict=True)) for r in done], _PACKED)
        done.clear()
        size = 0
        return out

    for own, run in _runs(batches, len(_PART)):
        if own != key:
            if n:
                finish()
            key, block = own, 0
        rows = np.stack([c.to_numpy() for c in run.columns[len(_PART) :]], 1)
        most = _BLOCK if key[3] else FEATURE_POINTS
        while len(rows):
            held.append(rows[: most - n])
            rows, n = rows[most - n :], n + len(held[-1])
            if n == most:
                finish()
                if size > _BATCH:
                    yield batch()
        if size > _BATCH or len(done) >= 4096:
            yield batch()
    if n:
        finish()
    if done:
        yield batch()


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles from their packed features, which come sorted."""
    key, layers = None, ([], [])

    def tile() -> pa.RecordBatch:
        data = [vector_tile(*layers)]
        for features in layers:
            features.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((*([k] for k in key), data), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["z", "x", "y", "tile"])

    for own, run in _runs(batches, 3):
        if own != key:
            if key is not None:
                yield tile()
            key = own
        for k, meta, features in zip(*(run.column(c).to_pylist() for c in ("layer", "meta", "features")), strict=True):
            layers[k].extend((meta, path) for path in features)
    if key is not None:
        yield tile()


def vector_tiles(shapes: DataFrame) -> DataFrame:
    """(z, x, y, tile) from rows z, x, y, meta, kind (point or line), feature
    (long) and coordinates vx0, vy0, vx1, vy1 in tile units.

    Lines of a crowded tile are dealt to layers in parts, which a hash of their
    places makes; points in parts of a few features."""
    tile, places = ["z", "x", "y"], ["vx0", "vy0", "vx1", "vy1"]
    line = F.col("kind") == "line"
    # As few rows as there are parts.
    crowded = shapes.where(line).groupBy(*tile, "meta").agg(F.count("*").alias("_n")).where(F.col("_n") > FEATURE_POINTS)
    parts = F.ceil(F.col("_n") / PART_LINES)
    hashed = F.coalesce(F.pmod(F.xxhash64(*places), parts), F.lit(0).cast("long"))
    part = F.when(line, hashed).otherwise(F.floor(F.col("feature") / PART_FEATURES)).alias("part")
    rows = shapes.join(F.broadcast(crowded), [*tile, "meta"], "left")
    rows = rows.select(*tile, F.when(line, 0).otherwise(1).alias("layer"), "meta", part, "feature", *places)
    n = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    features = rows.repartition(n, *_PART).sortWithinPartitions(*_PART, "feature", *places).mapInArrow(_pack, "z int, x long, y long, layer int, meta long, part long, block long, features array<binary>")
    order = [*_PART, "block"]
    return features.repartition(*tile).sortWithinPartitions(*order).mapInArrow(_assemble, "z int, x long, y long, tile binary")
