"""Street-level imagery: tile and feature-collection responses, panorama ids, images, mosaics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.retrieval import usable_thumb

FEATURES = "features array<struct<id: string, geometry: struct<coordinates: array<double>>, assets: struct<sd: struct<href: string>, thumb: struct<href: string>>>>"
PAGE_LIMIT = 100
#: Pixels of a batch; contents that a task holds at once.
PIXELS, HELD = 1 << 18, 64


def features(responses: DataFrame, body: str = "body", max_images: int = 150) -> DataFrame:
    """id, lat, lon, thumb_url of feature collections, in their order; at most a page of 100 a response, without dedup.

    A feature needs coordinates and a thumb; an unreadable response has none.
    """
    rows = responses.withColumn("_f", F.slice(F.from_json(body, FEATURES)["features"], 1, PAGE_LIMIT))
    rows = rows.select(*[c for c in responses.columns if c != body], F.posexplode("_f").alias("pos", "f"))
    thumb = usable_thumb(F.col("f.assets.sd.href"), F.col("f.assets.thumb.href"))
    out = rows.select(*[c for c in responses.columns if c != body], "pos", F.col("f.id").alias("id"), F.get("f.geometry.coordinates", 1).alias("lat"), F.get("f.geometry.coordinates", 0).alias("lon"), thumb.alias("thumb_url"))
    return out.where("lat is not null and lon is not null and thumb_url is not null and pos < " + str(max_images))


def panorama_ids(responses: DataFrame, body: str = "body") -> DataFrame:
    """Every quoted 22-character id with the first coordinates after it, or the query's own (qlat, qlon)."""
    ids = F.regexp_extract_all(body, F.lit(r'"([A-Za-z0-9_-]{22})"'), 1)
    rows = responses.select("*", F.posexplode(ids).alias("pos", "panoid"))
    quoted = F.concat(F.lit('"\\Q'), "panoid", F.lit('\\E".+?\\[null,null,(-?\\d+\\.\\d+),(-?\\d+\\.\\d+)'))
    at = lambda g: F.regexp_extract_all(body, quoted, F.lit(g))
    lat, lon = F.get(at(1), 0).try_cast("double"), F.get(at(2), 0).try_cast("double")
    return rows.select(*[c for c in responses.columns if c != body], "pos", "panoid", F.coalesce(lat, "qlat").alias("lat"), F.coalesce(lon, "qlon").alias("lon"))


def pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, r, g, b and the image's h, w, of rows of the image source, whose bytes are blue, green, red by
    row; a grey image has equal channels. Slices of each image's bytes go out in batches of PIXELS, so an image costs
    time in proportion to its size and no more memory than its bytes and a batch."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, height, channels = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                data = batch.column(4)[i].as_buffer()
                if not width or not height or not channels or data is None:
                    continue
                flat = np.frombuffer(data, np.uint8)[: width * height * channels].reshape(-1, channels)
                for a in range(0, len(flat), PIXELS):
                    part = flat[a : a + PIXELS]
                    at, n = np.arange(a, a + len(part), dtype=np.int64), len(part)
                    colours = [part[:, min(k, channels - 1)].astype(np.int32) for k in (2, 1, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), *map(pa.array, (at // width, at % width, *colours, np.full(n, height, np.int64), np.full(n, width, np.int64)))], names=["image_id", "y", "x", "r", "g", "b", "h", "w"])

    rows = images.select("image_id", "image.width", "image.height", "image.nChannels", "image.data")
    return rows.mapInArrow(run, f"image_id {kind}, y long, x long, r int, g int, b int, h long, w long")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files that aren't images are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).withColumn("image_id", F.col("image.origin"))


def fetched(rows: DataFrame, fetch: Callable[[str], bytes | None], url: str = "thumb_url", tries: int = 2, threads: int = 20, on_progress: Callable[[int], None] | None = None) -> DataFrame:
    """rows with content; rows whose fetch fails, in whatever way, are left out.

    fetch runs in the workers, ``threads`` at once, over HELD rows at a time, so few contents are held. on_progress is
    called there with the number of rows of its task that are done; an accumulator's ``add`` of differences, say.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    at = rows.columns.index(url)

    def one(u: str | None) -> bytes | None:
        for _ in range(tries if u is not None else 0):
            try:
                data = fetch(u)
            except Exception:  # noqa: BLE001  whatever a remote side does, the other rows go on
                continue
            if data is not None:
                return data
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for a in range(0, batch.num_rows, HELD):
                    part = batch.slice(a, HELD)
                    content = []
                    for data in pool.map(one, part.column(at).to_pylist()):
                        content.append(data)
                        done += 1
                        if on_progress:
                            on_progress(done)
                    column = pa.array(content, pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "content"]).filter(pc.is_valid(column))

    return rows.mapInArrow(run, schema)


def mosaics(tiles: DataFrame, decode: Callable[[bytes], np.ndarray] | None = None, columns: int = 4, rows: int = 2, size: int = 512) -> DataFrame:
    """panoid, n_tiles and image (width, height, nChannels, data as the image source has it) of panoramas' tiles.

    tiles: panoid, x, y, content. decode makes an array of height x width x 3 (red, green, blue) of a tile's bytes; by
    default these are such raw bytes. Tiles are pasted at x * size, y * size; missing ones, and those that can't be
    decoded, stay black. A panorama without any content has no row. A group is one panorama: columns * rows tiles.
    """
    read = decode or (lambda data: np.frombuffer(data, np.uint8).reshape(size, size, 3))
    kind = tiles.schema["panoid"].dataType.simpleString()
    there = tiles.where((F.col("content").isNotNull()) & F.col("x").between(0, columns - 1) & F.col("y").between(0, rows - 1))
    # repeats of a tile: the smallest content, so the result doesn't depend on the order of rows
    there = there.groupBy("panoid", "x", "y").agg(F.min("content").alias("content"))

    def paste(table: pa.Table) -> pa.Table:
        out = np.zeros((rows * size, columns * size, 3), np.uint8)
        for x, y, content in zip(*(table[c].to_pylist() for c in ("x", "y", "content")), strict=True):
            try:
                part = np.asarray(read(content), np.uint8)[:size, :size, :3]
                out[y * size : y * size + part.shape[0], x * size : x * size + part.shape[1]] = part
            except Exception:  # noqa: BLE001  stays black
                continue
        data = np.ascontiguousarray(out[:, :, ::-1]).tobytes()
        image = pa.StructArray.from_arrays([pa.array([columns * size], pa.int32()), pa.array([rows * size], pa.int32()), pa.array([3], pa.int32()), pa.array([data], pa.binary())], names=["width", "height", "nChannels", "data"])
        return pa.Table.from_arrays([table["panoid"].slice(0, 1).combine_chunks(), pa.array([len(table)], pa.int64()), image], names=["panoid", "n_tiles", "image"])

    return there.groupBy("panoid").applyInArrow(paste, f"panoid {kind}, n_tiles long, image struct<width: int, height: int, nChannels: int, data: binary>")


def embedded(images: DataFrame, embed: Callable[[list[bytes]], list[list[float]]], column: str = "content") -> DataFrame:
    """images with an embedding from a user's model, a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), HELD):
                part = frame.iloc[a : a + HELD]
                yield part.assign(embedding=embed(list(part[column])))

    return images.mapInPandas(run, f"{images._jdf.schema().toDDL()}, embedding array<float>")


class TilePartition(InputPartition):
    def __init__(self, tile: tuple[float, float, float, float]) -> None:
        super().__init__(tile)
        self.tile = tile


class TileSource(DataSource):
    """A table from a bounding-box search: spark.read.format("imagery_tiles"), a partition a tile.

    Options: tiles (lines of min_lat,min_lon,max_lat,max_lon), limit (rows a tile, 5), module and function (name of the
    search: (tile, limit) -> rows of id, lat, lon, thumb_url). A tile whose search fails is empty.
    """

    @classmethod
    def name(cls) -> str:
        return "imagery_tiles"

    def schema(self) -> str:
        return "id string, lat double, lon double, thumb_url string, tile_no int, pos int"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return TileReader(self.options)


class TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.tiles = [tuple(map(float, x.split(","))) for x in options.get("tiles", "").split("\n") if x.strip()]
        self.limit = int(options.get("limit", 5))
        self.module, self.function = options["module"], options["function"]

    def partitions(self) -> list[InputPartition]:
        return [TilePartition((i, *t)) for i, t in enumerate(self.tiles)]

    def read(self, partition: TilePartition) -> Iterator[tuple]:
        import importlib

        search = getattr(importlib.import_module(self.module), self.function)
        number, *tile = partition.tile
        try:
            rows = list(search(tuple(tile), self.limit))[: self.limit]
        except Exception:  # noqa: BLE001  a tile that can't be searched is empty
            rows = []
        for pos, (key, lat, lon, thumb) in enumerate(rows):
            yield (key, lat, lon, thumb, number, pos)
