"""Deterministic shapes from the test tables, the same in both engines.

``SQL`` holds the matching common table expressions for the SQL side.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import mercator, morton
from tessera.operators.dataset import Dataset, write_dataset

LAT, LON = "(l_orderkey*7919 + l_partkey*104729 + l_linenumber*31)", "(l_suppkey*15485863 + l_partkey*32452843 + l_orderkey*49979687)"
PLACES = {"pts": ("1600001 as double)/10000.0 - 80.0", "3590001 as double)/10000.0 - 179.5"), "city": ("4001 as double)/40000.0 + 37.70", "4001 as double)/40000.0 - 122.52")}
TRACK_LAT, TRACK_LON = "cast((event_id*7919 + user_id*104729) % 4001 as double)/40000.0 + 37.70", "cast((event_id*15485863 + user_id*32452843) % 4001 as double)/40000.0 - 122.52"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, where: str = "pts") -> DataFrame:
    """orderkey, linenumber, meta, lat, lon, x, y of every line item."""
    lat, lon = (f"cast({n} % {p}" for n, p in zip((LAT, LON), PLACES[where], strict=True))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_quantity").cast("long").alias("meta"), F.expr(lat).alias("lat"), F.expr(lon).alias("lon"))
    x, y = mercator.project(F.col("lat"), F.col("lon"))
    return rows.withColumns({"x": x, "y": y})


def keyed_points(spark: SparkSession, sf_dir: str, where: str = "city", mapbits: int = 48) -> DataFrame:
    rows = points(spark, sf_dir, where)
    cut = {c: morton.truncated(F.col(c), mapbits) for c in "xy"}
    return rows.withColumns(cut).withColumn("qkey", morton.key(F.col("x"), F.col("y"), mapbits))


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(TRACK_LAT).alias("lat"), F.expr(TRACK_LON).alias("lon"))
    x, y = mercator.project(F.col("lat"), F.col("lon"))
    return rows.withColumns({"x": x, "y": y})


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polyline per user: user_id, verts, meta; vertices in time order."""
    at = F.struct("ts", "event_id", "x", "y")
    rows = track_points(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(at)).alias("v"))
    verts = F.transform("v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return rows.select("user_id", verts.alias("verts"), (F.col("user_id") % 7).alias("meta"))


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.shapes import segments

    return segments(track_points(spark, sf_dir), "user_id", "ts", "event_id")


_STORES: dict[tuple, Dataset] = {}


def stored(spark: SparkSession, sf_dir: str, kind: str, rows: Callable[[], DataFrame]) -> Dataset:
    """Shapes written as a data set below the shared folder, once a session."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _STORES:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='tessera_')}"
        path = f"{base}/tessera/{kind}-{uuid.uuid4().hex}"
        write_dataset(rows(), path, metabits=8)
        _STORES[at] = Dataset(spark, path)
    return _STORES[at]


def city_points(spark: SparkSession, sf_dir: str) -> Dataset:
    vert = F.array(F.struct("x", "y"))
    return stored(spark, sf_dir, "points", lambda: points(spark, sf_dir, "city").select(vert.alias("verts"), "meta"))


def city_lines(spark: SparkSession, sf_dir: str) -> Dataset:
    """Every track segment as a line of two vertices."""

    def rows() -> DataFrame:
        vert = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
        return track_segments(spark, sf_dir).select(F.array(vert(0), vert(1)).alias("verts"), (F.col("user_id") % 7).alias("meta"))

    return stored(spark, sf_dir, "lines", rows)


def _world(lat: str, lon: str) -> str:
    phi = f"(({lat})*pi()/180)"
    return f"cast(trunc(4294967296.0::double*((({lon})+180)/360)) as bigint) as x, cast(trunc(4294967296.0::double*(1 - ln(tan{phi} + 1/cos{phi})/pi())/2) as bigint) as y"


def _points_sql(name: str) -> str:
    lat, lon = (f"cast({n} % {p}" for n, p in zip((LAT, LON), PLACES[name], strict=True))
    return f"{name} as (select l_orderkey as orderkey, l_linenumber as linenumber, cast(l_quantity as bigint) as meta, {lat} as lat, {lon} as lon, {_world(lat, lon)} from lineitem)"


_CUT = "(x // 256) * 256"
SQL = {
    "pts": _points_sql("pts"),
    "city": _points_sql("city"),
    "cut": "cut as (select orderkey, linenumber, meta, (x // 256) * 256 as x, (y // 256) * 256 as y from city)",
    "tp": f"tp as (select user_id, ts, event_id, {_world(TRACK_LAT, TRACK_LON)} from events)",
    "seg": "seg as (select * from (select user_id, row_number() over w - 1 as seq, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from tp window w as (partition by user_id order by ts, event_id)) where x1 is not null)",
}


def with_(*names: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names) + " "
