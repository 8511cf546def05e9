"""Tile trees: one file per tile, and the description beside them."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path of a Hadoop URI."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def write_tree(tiles: DataFrame, out: str, *, column: str, extension: str, description: str, postprocess: Callable[[bytes], bytes] | None = None) -> dict:
    """Write ``out``/z/x/y.extension from the tasks and metadata.json once.
    Files are whole or absent: each is moved into place when complete.
    ``postprocess`` may change the bytes of each file.  The zooms told are
    those of the whole tree, earlier runs included."""

    def put(rows: Iterator[Row]) -> None:
        fs, root = _store(out)
        for r in rows:
            folder = f"{root}/{r['z']}/{r['x']}"
            fs.create_dir(folder, recursive=True)
            temporary = f"{folder}/.{r['y']}.{uuid.uuid4().hex}.part"
            data = bytes(r[column])
            with fs.open_output_stream(temporary) as f:
                f.write(postprocess(data) if postprocess else data)
            fs.move(temporary, f"{folder}/{r['y']}.{extension}")

    tiles.select("z", "x", "y", column).foreachPartition(put)
    fs, root = _store(out)
    fs.create_dir(root, recursive=True)
    zooms = [int(f.base_name) for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.Directory and f.base_name.isdigit()]
    meta = metadata(out.rstrip("/").rsplit("/", 1)[-1], description, min(zooms, default=None), max(zooms, default=None), extension)
    with fs.open_output_stream(f"{root}/metadata.json") as f:
        f.write(json.dumps(meta, indent=1).encode())
    return meta


def metadata(name: str, description: str, low: int | None, high: int | None, extension: str) -> dict:
    meta = {"name": name, "description": description, "version": "1", "minzoom": low or 0, "maxzoom": high or 0, "type": "overlay", "format": extension}
    if extension == "pbf":
        layers = [{"id": n, "description": "", "minzoom": low or 0, "maxzoom": high or 0, "fields": {"meta": "Number"}} for n in ("points", "lines")]
        meta["json"] = json.dumps({"vector_layers": layers})
    return meta
