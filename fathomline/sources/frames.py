"""Frame folders, PNG headers and settings documents as tables; idempotent and partition-wise sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Extensions of images and videos, and the signature and chunk name at the start of a PNG file.
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
VIDEOS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm")
PNG_START = "89504E470D0A1A0A0000000D49484452"
#: Channels of each PNG colour type.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGES)


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEOS)


def stem_index(path: Column) -> Column:
    """The number in a file's name; 0 if there is none."""
    return F.coalesce(F.regexp_extract(path, r"([0-9]+)[^/0-9]*\.[^./]+$", 1).try_cast("int"), F.lit(0))


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, length and frame_idx of the images of a folder, without their content (which stays unread)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.filter(is_image(F.col("path"))).select("path", F.col("modificationTime").alias("modified"), "length", stem_index(F.col("path")).alias("frame_idx"))


def png_header(content: Column) -> Column:
    """width, height, bit_depth and channels from the first 29 bytes; null unless they are a valid PNG start."""
    head = F.hex(F.substring(content, 1, 29))
    number = lambda at, n: F.conv(F.substring(head, 2 * at + 1, 2 * n), 16, 10).cast("int")
    colour = number(25, 1)
    channels = F.create_map(*[F.lit(x) for pair in PNG_CHANNELS.items() for x in pair])
    ok = (F.length(head) == 58) & F.startswith(head, F.lit(PNG_START)) & (number(26, 1) == 0) & (number(27, 1) == 0) & number(28, 1).isin(0, 1)
    return F.when(ok, F.struct(number(16, 4).alias("width"), number(20, 4).alias("height"), number(24, 1).alias("bit_depth"), F.try_element_at(channels, colour).alias("channels")))


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest settings document under a path (ties by name); values that don't fit the schema are null."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_name").alias("name"))
    newest = files.groupBy().agg(F.max_by("value", F.struct("modified", "name")).alias("value"))
    return newest.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the table at ``path`` hasn't yet, and returns the table. Running it again adds nothing."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
        fresh = df.dropDuplicates(keys).join(there.select(*keys), keys, "left_anti")
    except Exception as e:  # the table is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df.dropDuplicates(keys)
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def commit_shots(df: DataFrame, path: str, by: list[str], index: str, counts: DataFrame) -> DataFrame:
    """Replaces whole partitions of a table, after each has been found contiguous and of the planned length; else an error, and nothing is written."""
    seen = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max(index) - F.min(index) + 1).alias("span"), F.countDistinct(index).alias("d"))
    wrong = seen.join(counts, by, "full_outer").filter(~F.coalesce((F.col("n") == F.col("expected")) & (F.col("span") == F.col("n")) & (F.col("d") == F.col("n")), F.lit(False)))
    bad = wrong.limit(5).collect()
    if bad:
        raise ValueError(f"shots are not whole: {[tuple(r[b] for b in by) for r in bad]}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)
