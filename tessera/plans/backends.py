"""Output formats as exchangeable backends.

A backend turns a request into rows z, x, y, data; ``BACKENDS`` names them by
their file type.  Another one only needs the two attributes of ``Backend``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import render
from tessera.plans.render import Request


class Backend(Protocol):
    filetype: str

    def tiles(self, spark: SparkSession, request: Request) -> DataFrame: ...


@dataclass(frozen=True)
class Binary:
    """Tiles as files of bytes."""

    filetype: str
    draw: Callable[[SparkSession, Request], DataFrame]

    def tiles(self, spark: SparkSession, request: Request) -> DataFrame:
        rows = self.draw(spark, request)
        return rows.select("z", "x", "y", F.col(rows.columns[-1]).alias("data"))


def _png(spark: SparkSession, request: Request) -> DataFrame:
    """Images; with the retina style, quarters of parents at twice the size."""
    if not request.style.retina:
        return render.png_tiles(spark, request)
    parts = [render.retina_tile(spark, request.datasets, t, request.style) for t in request.tiles]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


BACKENDS: dict[str, Backend] = {"png": Binary("png", _png), "pbf": Binary("pbf", render.vector_tiles)}
