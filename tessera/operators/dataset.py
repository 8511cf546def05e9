"""Indexed data sets: writing, opening, ranking, merging."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.shapes import keyed

VERSION = 1
_META = "version int, mapbits int, metabits int, maxn int"
_STORED = "qkey long, verts array<struct<x: long, y: long>>, meta long, legs int, rank long, lod int, tier int, level int"
#: Points of this lod and above share the folder of the last tier.
TOP_TIER = 12


def _place(key: str, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, found in two short steps."""
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda c: c <= F.col(key)
    coarse = F.size(F.filter(F.array(*(F.lit(g[0]) for g in groups)), below))
    fine = F.size(F.filter(F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), coarse - 1), below))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine)


def lod_of(rank: Column) -> Column:
    """Trailing zero bits of a rank; 63 for the first."""
    lowest = rank.bitwiseAND(-rank)
    return F.when(rank == 0, 63).otherwise(F.length(F.bin(lowest)) - 1).cast("int")


def ranked(points: DataFrame, partitions: int | None = None) -> DataFrame:
    """Points (qkey, meta, x, y) with rank (0-based place in key order) and
    lod (its trailing zero bits).

    Ranges of keys, cut at quantiles, are numbered side by side; only the cuts
    and the sizes of the ranges come to the driver, from two scans of the keys
    without a shuffle of rows.  Equal points are interchangeable and counted
    first, so a crowded place is one row.
    """
    n = partitions or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = points.agg(F.percentile_approx("qkey", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    part = _place("qkey", cuts)
    sizes = {r["_part"]: r["n"] for r in points.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()}
    starts = [0]
    for p in range(len(cuts)):
        starts.append(starts[-1] + sizes.get(p, 0))
    keys = points.groupBy("qkey", "meta", "x", "y").agg(F.count("*").alias("_n")).withColumn("_part", part)
    before = Window.partitionBy("_part").orderBy("qkey", "meta").rowsBetween(Window.unboundedPreceding, -1)
    first = F.get(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("_part")) + F.coalesce(F.sum("_n").over(before), F.lit(0))
    rows = keys.withColumn("_first", first).select("qkey", "meta", "x", "y", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("rank"))
    return rows.withColumn("lod", lod_of(F.col("rank")))


def write_dataset(shapes: DataFrame, path: str, *, mapbits: int = 48, metabits: int = 0, overwrite: bool = False) -> None:
    """Encode world shapes (verts, meta) below ``path``, which must not exist
    unless ``overwrite``: Parquet in key order, and the properties beside it.

    Ranges of (level, qkey, meta) are sorted side by side and written once;
    then points get their rank from the sizes of the ranges before theirs and
    their row number in their own file, without another shuffle.  Folders are
    ``tier`` (points by their lod, so that a coarse zoom reads its share of
    them only; -1 for lines) and ``level``.
    """
    if not 8 < mapbits <= 64 or mapbits % 2:
        raise ValueError("mapbits is 2 * (zoom + 8) for a zoom of 1 to 24")
    spark, mode = shapes.sparkSession, "overwrite" if overwrite else "errorifexists"
    rows = keyed(shapes, mapbits, metabits).withColumn("line", (F.col("legs") > 1).cast("int"))
    # A crowded place splits, as equal records are interchangeable.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    order = ("line", "level", "qkey", "meta")
    rows = rows.repartitionByRange(*order, salt).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    staged = f"{path}/_staged"
    if not overwrite:
        _absent(spark, path)
    rows.write.mode(mode).partitionBy("line").parquet(staged)
    sorted_rows = spark.read.parquet(staged)
    found = sorted_rows.groupBy("line", "part").agg(F.count("*").alias("n"), F.max("legs").alias("legs")).collect()  # a row per range
    starts, at = [], 0
    for r in sorted((r for r in found if not r["line"]), key=lambda r: r["part"]):
        starts.append((r["part"], at))
        at += r["n"]
    start = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part int, start long"))
    rank = F.when(F.col("line") == 0, F.col("start") + F.col("row"))
    tier = F.when(F.col("line") == 1, -1).otherwise(F.least(F.lit(TOP_TIER), F.col("lod") - F.col("lod") % 2))
    numbered = sorted_rows.withColumn("row", F.col("_metadata.row_index")).join(start, "part", "left").withColumn("rank", rank)
    out = numbered.withColumn("lod", lod_of(F.col("rank"))).withColumn("tier", tier.cast("int"))
    out.select("qkey", "verts", "meta", "legs", "rank", "lod", "tier", "level").sortWithinPartitions("tier", "level", "qkey", "meta").write.mode(mode).partitionBy("tier", "level").parquet(f"{path}/shapes")
    maxn = max((r["legs"] for r in found), default=0)
    spark.createDataFrame([(VERSION, mapbits, metabits, int(maxn))], _META).coalesce(1).write.mode(mode).json(f"{path}/meta")
    delete(spark, staged)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _absent(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    if fs.exists(p):
        raise FileExistsError(f"{path} exists")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that all executors share."""
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete data sets below ``path``."""
    fs, p = _folder(spark, path)
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    meta = lambda q: _folder(spark, f"{q.toString()}/meta/_SUCCESS")
    return [q.getName() for q in found if (m := meta(q))[0].exists(m[1])]


class Dataset:
    """An opened data set; a missing (legs, level) is an empty frame."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        meta = spark.read.schema(_META).json(f"{path}/meta").first()
        if meta is None or meta["version"] != VERSION:
            raise ValueError(f"{path}: not a data set of version {VERSION}")
        self.path, self.mapbits, self.metabits, self.maxn = path, meta["mapbits"], meta["metabits"], meta["maxn"]
        self.stored = spark.read.schema(_STORED).parquet(f"{path}/shapes")

    @property
    def shapes(self) -> DataFrame:
        return self.stored.select("qkey", "verts", "meta", "legs", "level")

    def part(self, legs: int, level: int) -> DataFrame:
        return self.shapes.where((F.col("legs") == legs) & (F.col("level") == level))

    @property
    def points(self) -> DataFrame:
        """qkey, x, y, meta, rank, lod; a filter of tier picks folders."""
        first = F.col("verts")[0]
        return self.stored.where("tier >= 0").select("qkey", first["x"].alias("x"), first["y"].alias("y"), "meta", "rank", "lod", "tier")

    @property
    def lines(self) -> DataFrame:
        return self.stored.where("tier = -1").select("qkey", "verts", "meta", "legs", "level")

    @property
    def named_lines(self) -> DataFrame:
        """Lines with ``_id``, which tells equal records apart."""
        named = self.stored.where("tier = -1").withColumn("_id", F.struct("_metadata.file_path", "_metadata.row_index"))
        return named.select("qkey", "verts", "meta", "legs", "level", "_id")

    def ordered(self) -> DataFrame:
        return self.shapes.orderBy("qkey", "meta")


def overlay(*frames: DataFrame) -> DataFrame:
    """Several data sets on one canvas: a bag union."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merged(datasets: list[Dataset], *, unique: bool = False) -> DataFrame:
    """Union of data sets of equal precision, with ``unique`` without repeated
    records (all vertices in order and the meta value)."""
    if len({(d.mapbits, d.metabits) for d in datasets}) != 1:
        raise ValueError("data sets differ in mapbits or metabits")
    rows = overlay(*(d.shapes for d in datasets))
    return distinct(rows) if unique else rows


def distinct(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["verts", "meta"])


def merge(spark: SparkSession, out: str, *paths: str, unique: bool = False) -> None:
    datasets = [Dataset(spark, p) for p in paths]
    write_dataset(merged(datasets, unique=unique).select("verts", "meta"), out, mapbits=datasets[0].mapbits, metabits=datasets[0].metabits)


def inventory(rows: DataFrame) -> DataFrame:
    """Records of each (legs, level)."""
    return rows.groupBy("legs", "level").agg(F.count("*").alias("records"))
