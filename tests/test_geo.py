"""Edge cases, properties and independent models of the operators."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import morton, style
from tessera.operators import dataset, encoders, raster, shapes, tiles
from tessera.sources import text
from tessera.sources.tree import write_tree


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parser_edges(spark):
    rows = text.parse_shapes(lines(spark, "37.5,-122.5", " 1,2 3,4 :5", "", ":7", "1,2 :300", "1,2 x 3,4", "1,2 4:3 4:1", "nan,2", "1e1,2 // 3,4", None), 8)
    got = {r["value"]: (r["n"], r["meta"], r["overflow"]) for r in rows.collect()}
    assert got == {"37.5,-122.5": (1, 0, False), " 1,2 3,4 :5": (2, 5, False), "1,2 :300": (1, 44, True), "1,2 x 3,4": (1, 0, False), "1,2 4:3 4:1": (1, 49, False), "1e1,2 // 3,4": (1, 0, False)}


def test_valid_range(spark):
    places = [("85.0511,0", True), ("85.0512,0", False), ("0,180", False), ("0,-180", False), ("-85.0511,179.9", True), ("0,0 0,181", False)]
    rows = text.parse_shapes(lines(spark, *(p for p, _ in places))).select("value", text.valid_shapes().alias("ok")).collect()
    assert {r["value"]: r["ok"] for r in rows} == dict(places)


def test_dataset_round_trip_merge_and_errors(spark, tmp_path):
    vert = "verts array<struct<x:bigint,y:bigint>>, meta bigint"
    a = spark.createDataFrame([([(256, 512)], 1), ([(256, 512)], 1), ([(0, 0), (1 << 31, 1 << 31)], 2), ([(5, 5), (6, 6)], 0)], vert)
    out = f"file://{tmp_path}/a"
    dataset.write_dataset(a, out, mapbits=48, metabits=8)
    with pytest.raises(Exception, match="exists"):
        dataset.write_dataset(a, out, mapbits=48, metabits=8)
    opened = dataset.Dataset(spark, out)
    assert (opened.mapbits, opened.metabits, opened.maxn) == (48, 8, 2)
    assert opened.points.count() == 2 and opened.part(7, 3).count() == 0
    # Two vertices in one cell are kept at the deepest level.
    assert {(r["legs"], r["level"]) for r in opened.lines.collect()} == {(2, 0), (2, 24)}
    dataset.merge(spark, f"file://{tmp_path}/b", out, out, unique=True)
    assert dataset.Dataset(spark, f"file://{tmp_path}/b").shapes.count() == 3
    with pytest.raises(ValueError):
        dataset.write_dataset(a, f"file://{tmp_path}/c", mapbits=8)


def test_stored_ranks(spark, tmp_path):
    """Ranks number the points in key order, whatever the ranges."""
    rng = np.random.default_rng(4)
    rows = [([(int(x) << 8, int(y) << 8)], int(m)) for x, y, m in zip(rng.integers(0, 1 << 6, 3000), rng.integers(0, 1 << 24, 3000), rng.integers(0, 5, 3000), strict=True)]
    rows += [([(512, 512)], 1)] * 2000
    frame = spark.createDataFrame(rows, "verts array<struct<x:bigint,y:bigint>>, meta bigint").repartition(3)
    dataset.write_dataset(frame, f"file://{tmp_path}/r", mapbits=48, metabits=8)
    points = dataset.Dataset(spark, f"file://{tmp_path}/r").points.orderBy("rank").collect()
    assert [p["rank"] for p in points] == list(range(5000))
    keys = [(p["qkey"], p["meta"]) for p in points]
    assert keys == sorted(keys)
    for p in points:
        lod = 63 if p["rank"] == 0 else (p["rank"] & -p["rank"]).bit_length() - 1
        assert (p["lod"], p["tier"]) == (lod, min(12, lod - lod % 2))
    assert tiles.sampled(dataset.Dataset(spark, f"file://{tmp_path}/r").points, 8).count() == 625


def test_requests_read_key_ranges(spark, tmp_path):
    rng = np.random.default_rng(5)
    spots = [(int(x), int(y)) for x, y in rng.integers(0, 1 << 32, (2000, 2))]
    lines_ = [([(x, y), (min(x + int(d), (1 << 32) - 1), y)], 0) for (x, y), d in zip(spots, 2 ** rng.integers(1, 31, 2000), strict=True)]
    frame = spark.createDataFrame([([s], 0) for s in spots] + lines_, "verts array<struct<x:bigint,y:bigint>>, meta bigint")
    dataset.write_dataset(frame, f"file://{tmp_path}/q", mapbits=64)
    ds = dataset.Dataset(spark, f"file://{tmp_path}/q")
    asked = [(4, 3, 5), (4, 9, 9)]
    near = tiles.points_near(ds.points, asked)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(qkey" in plan
    assert near.count() == sum(any(x >> 28 == t[1] and y >> 28 == t[2] for t in asked) for x, y in spots)
    listed = spark.createDataFrame(asked, "z int, x long, y long")
    whole = tiles.lines_of_tiles(ds.lines, listed, mapbits=64).select("x", "y", "verts")
    part = tiles.lines_of_tiles(tiles.lines_near(ds.lines, asked), listed, mapbits=64, zooms=[4]).select("x", "y", "verts")
    assert sorted(map(str, whole.collect())) == sorted(map(str, part.collect())) and part.count() > 5
    assert tiles.without_nested([(1, 0, 0), (3, 1, 2), (3, 7, 7), (3, 7, 7)]) == [(1, 0, 0), (3, 7, 7)]
    assert morton.merged_ranges([(0, 3), (4, 7), (20, 21), (10, 12)], 2) == [(0, 12), (20, 21)]


def test_lines_on_the_border_of_a_tile(spark, tmp_path):
    """Borders count as inside, also for lines that lie in the next tile."""
    from tessera.plans import render

    edge, deep = 6 << 28, 1 << 10
    rows = [([(edge + deep, 1 << 28), (edge, 1 << 28)], 1), ([(5 << 28, 2 << 28), (5 << 28, (2 << 28) + deep)], 2), ([(edge + deep, 1 << 28), (edge + 256, 1 << 28)], 3), ([(edge + deep, (2 << 28) + deep), (edge, 2 << 28)], 4)]
    dataset.write_dataset(spark.createDataFrame(rows, "verts array<struct<x:bigint,y:bigint>>, meta bigint"), f"file://{tmp_path}/e", metabits=8)
    ds = dataset.Dataset(spark, f"file://{tmp_path}/e")
    got = tiles.lines_of_tiles(ds.lines, tiles.listed(spark, [(4, 5, 1)])).collect()
    assert sorted(r["meta"] for r in got) == [1, 2, 4]
    assert render.dump(spark, render.Request((ds,), ((4, 5, 1),))).count() == 3


def test_requests_are_sent_to_their_rows(spark, tmp_path):
    """No shuffle by tile: one tile may hold most of the rows."""
    from tessera.plans import render

    rows = [([(1 << 28, 1 << 28), (1 << 29, 1 << 28)], 2), ([(1 << 28, 1 << 28)], 3)]
    dataset.write_dataset(spark.createDataFrame(rows, "verts array<struct<x:bigint,y:bigint>>, meta bigint"), f"file://{tmp_path}/s", metabits=8)
    ds = dataset.Dataset(spark, f"file://{tmp_path}/s")
    for frame in (render.point_dots(ds, [(4, 1, 1)], style.Style()).rows, render.tile_segments(ds, [(4, 1, 1)], style.Style())):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and frame.count() == 1


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 24), st.data())
def test_tile_range_is_prefix(z, data):
    x, y = (data.draw(st.integers(0, (1 << z) - 1)) for _ in "xy")
    low, high = morton.tile_range(z, x, y)
    assert high - low == (1 << (64 - 2 * z)) - 1
    if z:
        parent = morton.tile_range(z - 1, x >> 1, y >> 1)
        assert parent[0] <= low and high <= parent[1]


@pytest.mark.parametrize("brush,gaussian", [(1.5, False), (2.0, False), (8.0, True), (64.0, False)])
def test_kernel_light(brush, gaussian):
    assert math.isclose(sum(w for _, _, w in raster.kernel(brush, gaussian)), brush, rel_tol=1e-9)


def test_interior_dot_keeps_its_light(spark):
    dots = spark.createDataFrame([(0.5, 0.5, -1.0)], "fx double, fy double, hue double")
    for pixels, light in ((raster.draw_points(dots, 256, F.lit(0.3)), 0.3), (raster.draw_brush(dots, 256, F.lit(0.3), 8.0), 2.4)):
        assert math.isclose(raster.accumulate(pixels, [], 256).agg(F.sum("image")).first()[0], light, rel_tol=1e-9)


def test_line_light_is_its_length(spark):
    segs = spark.createDataFrame([(10.2, 20.1, 60.7, 33.3), (5.0, 5.0, 5.0, 5.0), (30.5, 80.2, 28.1, 10.4)], "x0 double, y0 double, x1 double, y1 double")
    got = raster.draw_lines(segs, F.lit(1.0)).agg(F.sum("b")).first()[0]
    assert math.isclose(got, 50.5 + 69.8, rel_tol=1e-9)


def test_plain_lines_model(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(int, rng.integers(-20, 20, 4))) for _ in range(200)]
    segs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, x0 long, y0 long, x1 long, y1 long")
    got: dict[int, set] = {}
    for r in raster.draw_plain_lines(segs).collect():
        got.setdefault(r["k"], set()).add((r["px"], r["py"]))
    for i, (x0, y0, x1, y1) in enumerate(rows):
        mine = got.get(i, set())
        assert len(mine) == max(abs(x1 - x0), abs(y1 - y0))
        if mine:
            assert (x0, y0) in mine and (x1, y1) not in mine
            d = math.hypot(x1 - x0, y1 - y0)
            assert all(abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / d <= 0.5 + 1e-9 for x, y in mine)


def test_level_model(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x, y = map(int, rng.integers(0, 1 << 32, 2))
        d = int(rng.integers(0, 33))
        rows.append((i, [(x, y), (x ^ int(rng.integers(0, 1 << d)) if d else x, y)]))
    got = spark.createDataFrame(rows, "k int, verts array<struct<x:bigint,y:bigint>>").select("k", shapes.level(F.col("verts")).alias("l")).collect()
    for r in got:
        (ax, _), (bx, _) = rows[r["k"]][1]
        want = 0
        while want < 24 and ax >> (31 - want) == bx >> (31 - want):
            want += 1
        assert r["l"] == want


def test_png_pixels():
    rgba = np.arange(3 * 2 * 4, dtype="u1").reshape(3, 2, 4)
    data = encoders.png(rgba)
    at, parts = 8, {}
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        parts[data[at + 4 : at + 8]] = data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), "u1").reshape(3, 9)
    assert (rows[:, 0] == 0).all() and (rows[:, 1:].reshape(3, 2, 4) == rgba).all()


def test_geometry_commands():
    commands = [(1, 3, 6), (2, 8, 12), (2, 20, 34), (7, 0, 0)]
    assert encoders.geometry(commands) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert encoders.varint(300) == b"\xac\x02"
    assert encoders.line_commands([(0, 0, 1, 1), (1, 1, 2, 2), (5, 5, 6, 6)]) == [(1, 0, 0), (2, 1, 1), (2, 2, 2), (1, 5, 5), (2, 6, 6)]


def test_layers_do_not_touch():
    same = [(0, 0, 4000, 4000)] * 3
    assert [len(x) for x in encoders.layered([*same, (4000, 0, 4000, 500), (7, 7, 7, 7)])] == [2, 1, 1]


def test_crowded_tile_is_packed_in_parts(spark):
    """A crowd of crossing lines is dealt in seconds, and whole."""
    import time

    rng = np.random.default_rng(6)
    v = rng.integers(0, 4096, (9_000, 4))
    began = time.time()
    layers = encoders.layered(v)
    assert time.time() - began < 15
    assert sorted(map(tuple, np.concatenate(layers).tolist())) == sorted(map(tuple, v.tolist()))
    for x in (layers[0], layers[-1]):
        cells, sizes = encoders._cells(x * encoders.CELLS // encoders.EXTENT)
        assert len(set(cells)) == len(cells) and len(sizes) == len(x)
    rows = spark.range(25_000).selectExpr("11 AS z", "1L AS x", "2L AS y", "id % 2 AS meta", "'line' AS kind", "0L AS feature", "id % 4096 AS vx0", "id % 61 AS vy0", "id % 4096 + 1 AS vx1", "id % 61 AS vy1")
    tile = encoders.vector_tiles(rows).collect()[0]["tile"]
    ends = [c for _, _, path in encoders.tile_features(bytes(tile)) for c in encoders.read_commands(path) if c[0] == encoders.LINE_TO]
    assert len(ends) == 25_000


def test_features_beyond_their_room_keep_the_numbers_of_sql(spark):
    """A meta with a point in more cells than a feature holds."""
    from tessera.plans import queries

    points = spark.range(24_000).selectExpr("11 AS z", "1L AS x", "2L AS y", "4L AS meta", "'point' AS kind", "id div 12000 AS feature", *(f"{c} AS {n}{k}" for k in (0, 1) for n, c in (("vx", "id % 12000 div 256 * 16"), ("vy", "id % 12000 % 256 * 16"))))
    got = queries._features(encoders.vector_tiles(points))
    assert got.exceptAll(points.select(got.columns)).count() == 0 and got.count() == 24_000


def test_crowded_cell_keeps_every_point(spark, monkeypatch):
    from tessera.plans import queries

    crowd = spark.range(10_050).selectExpr("4 AS meta", "11 AS z", "327L AS x", "791L AS y", "0.5D AS fx", "0.5D AS fy")
    monkeypatch.setattr(queries, "city_dots", lambda *_: crowd)
    assert queries._vector(spark, "/root/testdata/sf0.001").where("kind = 'point'").count() == 10_050


def test_scatter_takes_every_quantity(spark, monkeypatch):
    from tessera.plans import queries

    dots = queries.city_dots(spark, "/root/testdata/sf0.001").where("meta = 50").limit(3).cache()
    monkeypatch.setattr(queries, "city_dots", lambda *_: dots)
    assert dots.count() > 0 and queries.circle_scatter(spark, "").count() > 0


def test_full_features_pass_points_on():
    from collections import Counter

    from tessera.operators.encoders import FEATURE_POINTS, point_groups

    cells = np.concatenate([np.arange(12_000), np.arange(12_000)])
    got = point_groups(np.repeat([0, 1], 12_000), cells)
    assert Counter(got.tolist()) == {0: FEATURE_POINTS, 1: FEATURE_POINTS, 2: 4_000}
    assert len(set(zip(got.tolist(), cells.tolist(), strict=True))) == 24_000


def test_tree_and_metadata(spark, tmp_path):
    tiles = spark.createDataFrame([(1, 0, 1, bytearray(b"a")), (3, 5, 6, bytearray(b"b"))], "z int, x long, y long, tile binary")
    meta = write_tree(tiles, f"file://{tmp_path}/out", column="tile", extension="pbf", description="d")
    assert (tmp_path / "out/3/5/6.pbf").read_bytes() == b"b"
    assert (meta["minzoom"], meta["maxzoom"]) == (1, 3)
    again = write_tree(tiles.where("z = 3"), f"file://{tmp_path}/out", column="tile", extension="pbf", description="d", postprocess=lambda b: b + b"!")
    assert (again["minzoom"], again["maxzoom"]) == (1, 3) and (tmp_path / "out/3/5/6.pbf").read_bytes() == b"b!"
    assert {x["id"] for x in json.loads(json.loads((tmp_path / "out/metadata.json").read_text())["json"])["vector_layers"]} == {"points", "lines"}


def test_meta_beyond_64_bits(spark):
    rows = text.parse_shapes(lines(spark, "1,2 :99999999999999999999", "1,2 :-99999999999999999999", "1,2 :5"), 8).collect()
    assert [r["overflow"] for r in rows] == [True, True, False] and rows[2]["meta"] == 5


def test_parser_takes_metas_of_63_bits_and_long_lines(spark):
    """In one pass of a worker, without an array of tokens per row."""
    rows = text.parse_shapes(lines(spark, "1,2 63:5", "1,2 " * 50_000 + ":9"), 8)
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["n"], r["meta"], r["overflow"]) for r in rows.collect()) == [(1, 0, False), (50_000, 9, False)]


def test_clipping_is_computed_once_per_segment(spark):
    """The plan of a thick line stays small: no value is repeated by its uses."""
    segs = spark.range(1).selectExpr("id + 1.5D AS x0", "id + 2.5D AS y0", "id + 400D AS x1", "id + 90D AS y1")
    drawn = raster.draw_thick_lines(raster.clipped(segs, -5.0, 260.0), F.lit(0.4), 3.5)
    assert len(drawn._jdf.queryExecution().optimizedPlan().toString()) < 12_000 and drawn.count() > 1_000


def test_scatter_carries_remainders(spark):
    """100 records of meta 3 at step 4: about 75 dots."""
    dots = spark.range(100).selectExpr("id AS rank", "3L AS meta", "11 AS z", "327L AS x", "791L AS y", "0.5D AS fx", "0.5D AS fy", "-1D AS hue")
    assert abs(raster.scattered(dots, 0.05, 4, 11).count() - 75) <= 3
    assert raster.scattered(dots, 0.05, 1, 11).count() == 300


def test_dump_of_several_tiles(spark, tmp_path):
    from tessera.plans import render

    rows = [([(5 << 29, 5 << 29)], 1), ([(1 << 28, 1 << 28), (1 << 29, 1 << 28)], 2), ([(1 << 28, 1 << 28), (1 << 29, 1 << 28)], 2), ([(1 << 28, 1 << 28)], 3)]
    dataset.write_dataset(spark.createDataFrame(rows, "verts array<struct<x:bigint,y:bigint>>, meta bigint"), f"file://{tmp_path}/d", metabits=8)
    ds = dataset.Dataset(spark, f"file://{tmp_path}/d")
    for asked, n in ((((0, 0, 0),), 4), (((1, 0, 0), (2, 0, 0)), 3), (((4, 1, 1), (4, 2, 1)), 3), (((1, 1, 1),), 1)):
        assert render.dump(spark, render.Request((ds,), asked)).count() == n, asked


def test_gpx(spark, tmp_path):
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="42.10" lon="-1.5"/><trkpt lat="1" lon="2"><ele>3</ele></trkpt></trkseg></trk></gpx>')
    assert [r["value"] for r in text.read_gpx(spark, f"{tmp_path}/t.gpx").collect()] == ["42.10,-1.5", "1,2"]


def test_stream_appends_once(spark, tmp_path):
    from tessera.streaming.ingest import batches, compact, start

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("37.5,-122.5 :3\nbad\n1,2\n")
    q = start(spark.readStream.text(f"{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", metabits=8)
    q.awaitTermination(120)
    found = batches(spark, f"file://{tmp_path}/out")
    assert sorted(r["meta"] for d in found for r in d.shapes.collect()) == [0, 3]
    (tmp_path / "in/b.txt").write_text("3,4 5,6 :7\n1,2\n")
    start(spark.readStream.text(f"{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", metabits=8).awaitTermination(120)
    one = compact(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/one", unique=True)
    assert sorted(r["meta"] for r in one.shapes.collect()) == [0, 3, 7] and one.maxn == 2
    assert [r["rank"] for r in one.points.orderBy("rank").collect()] == [0, 1]


def test_style_text_and_retina():
    assert "zoom = 22" in style.ZoomRules().text()
    s, z, x, y, ox, oy = style.with_retina(style.Style(), 11, 327, 791)
    assert (s.tilesize, z, x, y, ox, oy) == (512, 10, 163, 395, -256, -256)
    assert style.with_retina(style.Style(), 0, 0, 0)[1:] == (0, 0, 0, 0, 0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
