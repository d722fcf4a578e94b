"""Tile files as a data source that Spark writes in parallel and commits as a whole.

Each task writes its tiles below a folder of its own and tells the driver which zooms it wrote. The commit is one small file that names
those folders, written last; readers follow the commits only. So tiles of a failed or repeated task, or of a job that ended early,
are never seen, and tiles of a committed job are seen all at once. ``append`` adds a commit; ``overwrite`` starts with one that hides
those before it.

    spark.dataSource.register(TileFiles)
    tiles.write.format("tilefiles").mode("append").save(root)
    spark.read.format("tilefiles").load(root)

Layout: ``root/commits/<number>-<job>.json`` and ``root/data/<job>/<task>/<raster>/<z>/<x>/<y>.<format>``, with an index of the task's tiles
by zoom, from which files are read without listing folders. Tiles have raster_id, z, tx, ty and content; none may be null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import qualified

COLUMNS = ("raster_id", "z", "tx", "ty", "content")
SCHEMA = "raster_id bigint, z int, tx int, ty int, content binary"
INDEX = pa.schema([("raster_id", pa.int64()), ("tx", pa.int32()), ("ty", pa.int32()), ("file", pa.string())])
INDEX_ROWS = 100_000
READ_ROWS = 256


def _place(root: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(root)
    return store, base.rstrip("/")


def _commits(store: fs.FileSystem, base: str) -> list[tuple[int, str]]:
    found = store.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
    return sorted((int(f.base_name.split("-")[0]), f.path) for f in found if f.base_name.endswith(".json"))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    tiles: dict[int, int]  # of each zoom


@dataclass
class Part(InputPartition):
    folder: str
    zoom: int


class TileFiles(DataSource):
    """Options: ``path`` (with its scheme on a cluster), ``format`` (png)."""

    @classmethod
    def name(cls) -> str:
        return "tilefiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TileReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = sorted(set(COLUMNS) - set(schema.names))
        if missing:
            raise ValueError(f"tiles lack the columns {', '.join(missing)}")
        return TileWriter(self.options, overwrite)


class TileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.format, self.overwrite = options["path"], options.get("format", "png"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        """A folder of its own for every attempt of a task; tiles are written as they come."""
        store, base = _place(self.root)
        folder = f"data/{self.job}/{uuid.uuid4().hex}"
        counts: dict[int, int] = {}
        writers: dict[int, pq.ParquetWriter] = {}
        waiting: dict[int, list[tuple]] = {}
        made: set[str] = set()

        def flush(zoom: int) -> None:
            if zoom not in writers:
                writers[zoom] = pq.ParquetWriter(f"{base}/{folder}/index-{zoom}.parquet", INDEX, filesystem=store)
            columns = [pa.array(c, t) for c, t in zip(zip(*waiting[zoom]), INDEX.types)]
            writers[zoom].write_table(pa.Table.from_arrays(columns, schema=INDEX))
            waiting[zoom] = []

        try:
            for row in rows:
                zoom = row["z"]
                file = f"{row['raster_id']}/{zoom}/{row['tx']}/{row['ty']}.{self.format}"
                above = file.rsplit("/", 1)[0]
                if above not in made:
                    store.create_dir(f"{base}/{folder}/{above}", recursive=True)
                    made.add(above)
                with store.open_output_stream(f"{base}/{folder}/{file}") as out:
                    out.write(bytes(row["content"]))
                counts[zoom] = counts.get(zoom, 0) + 1
                waiting.setdefault(zoom, []).append((row["raster_id"], row["tx"], row["ty"], file))
                if len(waiting[zoom]) == INDEX_ROWS:
                    flush(zoom)
            for zoom in list(waiting):
                if waiting[zoom]:
                    flush(zoom)
        finally:
            for writer in writers.values():
                writer.close()
        return Written(folder, counts)

    def commit(self, messages: list[Written | None]) -> None:
        """Named last and under its final name only, so a reader finds all of it or nothing."""
        store, base = _place(self.root)
        parts = [{"folder": m.folder, "tiles": m.tiles} for m in messages if m is not None and m.tiles]
        number = max([n for n, _ in _commits(store, base)], default=-1) + 1
        store.create_dir(f"{base}/commits", recursive=True)
        name = f"{base}/commits/{number:09d}-{self.job}"
        with store.open_output_stream(f"{name}.new") as out:
            out.write(json.dumps({"overwrite": self.overwrite, "parts": parts}).encode())
        store.move(f"{name}.new", f"{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _place(self.root)
        if store.get_file_info(f"{base}/data/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/data/{self.job}")


class TileReader(DataSourceReader):
    """A partition for each zoom of each task that wrote."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.zoom = int(options["zoom"]) if "zoom" in options else None

    def partitions(self) -> list[Part]:
        store, base = _place(self.root)
        parts: list[Part] = []
        for _, path in _commits(store, base):
            with store.open_input_stream(path) as f:
                commit = json.loads(f.read())
            parts = [] if commit["overwrite"] else parts
            parts += [Part(p["folder"], int(z)) for p in commit["parts"] for z in p["tiles"]]
        return [p for p in parts if self.zoom is None or p.zoom == self.zoom] or [Part("", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.folder:  # Spark asks for one partition at least
            return
        store, base = _place(self.root)
        with store.open_input_file(f"{base}/{part.folder}/index-{part.zoom}.parquet") as f:
            for batch in pq.ParquetFile(f).iter_batches(READ_ROWS):
                contents = []
                for file in batch.column("file").to_pylist():
                    with store.open_input_stream(f"{base}/{part.folder}/{file}") as tile:
                        contents.append(tile.read())
                zoom = pa.array([part.zoom] * batch.num_rows, pa.int32())
                own = [batch.column("raster_id"), zoom, batch.column("tx"), batch.column("ty"), pa.array(contents, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, list(COLUMNS))


def write_committed(tiles: DataFrame, root: str, fmt: str = "png", mode: str = "append") -> None:
    """All tiles or none become visible below ``root``."""
    spark = tiles.sparkSession
    spark.dataSource.register(TileFiles)
    rows = tiles.select("raster_id", "z", "tx", "ty", tiles["content"].cast("binary").alias("content"))
    rows.write.format("tilefiles").option("format", fmt).mode(mode).save(qualified(spark, root))


def read_committed(spark, root: str, zoom: int | None = None) -> DataFrame:
    """The tiles of all commits; those of one zoom without opening others."""
    spark.dataSource.register(TileFiles)
    reader = spark.read.format("tilefiles")
    return (reader if zoom is None else reader.option("zoom", zoom)).load(qualified(spark, root))
