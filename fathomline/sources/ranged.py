"""Frame files read by ranges: data sources for Spark that open files in tasks and read only the bytes that they need.

``png_headers`` reads 29 bytes of each PNG file, where ``binaryFile`` would load it whole. ``npz_maps`` reads members of NPZ archives: the
directory at the archive's end, then the members that are asked for; other members are never unpacked, and with ``headers`` only the start of
a member is. Both list the folder once and deal files evenly to partitions.

Stores are opened by Arrow, so a path's scheme has to be one that Arrow knows (local, S3, GCS, HDFS with its client library);
for others there are ``frames.read_frames`` and ``frames.png_header`` on Spark's own reader.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fathomline.sources.frames import IMAGES, PNG_CHANNELS, PNG_START

#: Files of one partition at most, if not asked otherwise.
FILES = 1000
PNG_BYTES = 29
#: Types that maps may be stored in; they are widened to single precision.
STORED = ("<f2", "<f4")


@dataclass
class Files(InputPartition):
    """Some files: path, size, time of change."""

    files: list[tuple[str, int, object]]


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def listed(root: str, extensions: tuple[str, ...], most: int) -> list[Files]:
    """The files of a folder and its folders, in order of their paths, dealt out evenly."""
    store, path = opened(root)
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    files = sorted((f.path, f.size, f.mtime) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(extensions))
    parts = -(-len(files) // most)
    return [Files(files[i::parts]) for i in range(parts)]


def stem_index(path: str) -> int:
    found = re.search(r"([0-9]+)[^/0-9]*\.[^./]+$", path)
    return int(found[1]) if found else 0


def png_header(head: bytes) -> tuple[int, int, int, int | None] | None:
    """width, height, bit depth and channels, as ``frames.png_header``; None unless the bytes are a valid PNG start."""
    if len(head) < PNG_BYTES or head[:16] != bytes.fromhex(PNG_START):
        return None
    width, height, bits, colour, compression, filtering, interlace = struct.unpack(">IIBBBBB", head[16:29])
    return (width, height, bits, PNG_CHANNELS.get(colour)) if (compression, filtering) == (0, 0) and interlace in (0, 1) else None


class _Reader(DataSourceReader):
    extensions: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.root = options["path"]
        self.most = int(options.get("filesPerPartition", FILES))
        self.options = options

    def partitions(self) -> list[Files]:
        return listed(self.root, self.extensions, self.most) or [Files([])]

    def read(self, part: Files) -> Iterator[tuple]:
        store = opened(self.root)[0]
        for path, size, changed in part.files:
            yield from self.rows(store, path, size, changed)

    def rows(self, store, path, size, changed) -> Iterator[tuple]:
        raise NotImplementedError


class PngHeaderReader(_Reader):
    extensions = tuple(e for e in IMAGES if e == ".png")

    def rows(self, store, path, size, changed):
        with store.open_input_file(path) as f:
            head = png_header(f.read_at(min(PNG_BYTES, size), 0))
        yield (path, stem_index(path), size, changed, *(head or (None,) * 4))


class PngHeaders(DataSource):
    """path, frame_idx, length, modified, width, height, bit_depth, channels of the PNG files under a path; the last four are null where a file isn't one."""

    @classmethod
    def name(cls) -> str:
        return "png_headers"

    def schema(self) -> str:
        return "path string, frame_idx int, length long, modified timestamp, width long, height long, bit_depth int, channels int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PngHeaderReader(self.options)


# --- NPZ ----------------------------------------------------------------------------------------------------------------


def npy_header(stream) -> tuple[tuple[int, ...], str]:
    """Shape and type of an array whose stream is at its start; leaves it at the data."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if fortran or dtype.hasobject:
        raise ValueError("arrays have to be plain and row by row")
    return shape, dtype.str


def npz_array(archive: zipfile.ZipFile, name: str, most: int) -> tuple[tuple[int, ...], str, np.ndarray]:
    """One member, whose data may have at most ``most`` bytes by its header."""
    with archive.open(f"{name}.npy") as stream:
        shape, dtype = npy_header(stream)
        n = int(np.prod(shape, dtype=np.int64)) * np.dtype(dtype).itemsize
        if n > most:
            raise ValueError(f"{name} has {n} bytes")
        data = stream.read(n)
        if len(data) != n or stream.read(1):
            raise ValueError(f"{name} isn't as long as its header says")
    return shape, dtype, np.frombuffer(data, dtype).reshape(shape)


class NpzMapReader(_Reader):
    extensions = (".npz",)

    def __init__(self, options: dict):
        super().__init__(options)
        self.kind = options.get("kind", "raw")
        self.headers = options.get("headers", "false") == "true"
        self.native = tuple(int(x) for x in options["shape"].split("x")) if "shape" in options else None
        self.stored = options.get("dtype")
        self.most = int(options.get("filesPerPartition", FILES))
        self.largest = int(options.get("largestMap", 1 << 28))
        if self.kind not in ("raw", "metric"):
            raise ValueError(f"unknown kind of maps: {self.kind}")

    def rows(self, store, path, size, changed):
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                yield (path, stem_index(path), *(self.metric(archive) if self.kind == "metric" else self.raw(archive)))
        except (ValueError, KeyError, zipfile.BadZipFile, EOFError, OSError) as e:
            raise ValueError(f"{path}: {e}") from e

    def held(self, shape, dtype, stored=STORED) -> None:
        """Ends the job at a map that isn't of the native shape and a stored type."""
        if len(shape) != 2 or self.native and shape != self.native:
            raise ValueError(f"shape {'x'.join(map(str, shape))}")
        if dtype not in stored or self.stored and dtype != self.stored:
            raise ValueError(f"type {dtype}")

    def raw(self, archive) -> tuple:
        if self.headers:
            with archive.open("values.npy") as stream:
                shape, dtype = npy_header(stream)
            self.held(shape, dtype)
            return list(shape), dtype, None
        shape, dtype, values = npz_array(archive, "values", self.largest)
        self.held(shape, dtype)
        return list(shape), dtype, values.astype(np.float32).ravel().tolist()

    def metric(self, archive) -> tuple:
        shape, dtype, inverse = npz_array(archive, "inverse_depth", self.largest)
        self.held(shape, dtype, ("<f4",))
        valid_shape, valid_type, valid = npz_array(archive, "valid", self.largest)
        if valid_shape != shape or valid_type != "|b1":
            raise ValueError("valid doesn't fit the map")
        focal = float(npz_array(archive, "focal_x_normalized", 8)[2].reshape(-1)[0])
        if not (np.isfinite(focal) and focal > 0):
            raise ValueError(f"focal length {focal}")
        if not np.isfinite(inverse).all() or (inverse[valid] <= 0).any() or inverse[~valid].any():
            raise ValueError("inverse depth is positive where it is valid, and 0 elsewhere")
        return list(shape), dtype, inverse.ravel().tolist(), valid.ravel().tolist(), focal


class NpzMaps(DataSource):
    """path, frame_idx, shape, dtype and the maps of the NPZ files under a path.

    Options: ``kind`` (raw: ``values`` widened to single precision; metric: ``inverse_depth``, ``valid``, ``focal_x_normalized``), ``shape`` (as 8x8)
    and ``dtype`` that every map must have, ``headers`` (true: no data, raw only), ``filesPerPartition``. A file that isn't as stated ends the job.
    """

    @classmethod
    def name(cls) -> str:
        return "npz_maps"

    def schema(self) -> str:
        more = "inverse_depth array<float>, valid array<boolean>, focal_x_normalized float" if self.options.get("kind") == "metric" else "`values` array<float>"
        return f"path string, frame_idx int, shape array<int>, dtype string, {more}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzMapReader(self.options)


class HashReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.extensions = tuple(options["extensions"].split(",")) if options.get("extensions") else ("",)
        self.chunk = int(options.get("chunkBytes", 1 << 20))

    def rows(self, store, path, size, changed):
        sha = hashlib.sha256()
        with store.open_input_file(path) as f:
            while data := f.read(self.chunk):
                sha.update(data)
        yield path, path.rsplit("/", 1)[-1], size, changed, sha.hexdigest()


class FileHashes(DataSource):
    """path, name, length, modified and sha256 of the files under a path, read in chunks. Options: ``extensions`` (.png,.json), ``chunkBytes``, ``filesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "path string, name string, length long, modified timestamp, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HashReader(self.options)


def verified_shots(records: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """by, state, reason: shots whose recorded files (by, name, sha256) are all there (``files``: name, sha256) and are what was recorded.

    One file of a shot that is absent makes it pending, one that differs makes it invalid. A shot's files are never gathered, only counted.
    """
    there = files.select("name", F.col("sha256").alias("__there"))
    seen = records.join(there, "name", "left").groupBy(*by).agg(F.count(F.when(F.col("__there").isNull(), 1)).alias("absent"), F.count(F.when(F.col("__there") != F.col("sha256"), 1)).alias("other"), F.min(F.when(F.col("__there") != F.col("sha256"), F.col("name"))).alias("which"))
    reason = F.when(F.col("other") > 0, F.concat(F.lit("hash mismatch: "), "which")).when(F.col("absent") > 0, "files are absent").otherwise("files match")
    state = F.when(F.col("other") > 0, "invalid").when(F.col("absent") > 0, "pending").otherwise("reusable")
    return seen.select(*by, state.alias("state"), reason.alias("reason"))


def register(spark: SparkSession) -> None:
    for source in (PngHeaders, NpzMaps, FileHashes):
        spark.dataSource.register(source)


def read_png_headers(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(PngHeaders.name()).options(**options).load(folder)


def read_npz_maps(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(NpzMaps.name()).options(**options).load(folder)


def read_file_hashes(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FileHashes.name()).options(**options).load(folder)
