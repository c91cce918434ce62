"""Readers and writers: logs, movies, trace arrays, session tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracespark.sources import binary


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir), set as the
    checkpoint folder. Only in local mode a temporary one is made where none is named."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracespark-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir().get()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders of a session table, however many recordings it has.
PARTS = 128


def write_stats(df: DataFrame, path: str, by: str = "rec") -> None:
    """Session tables with nested lists, in ``PARTS`` folders by the recordings' hash; of what is there,
    only the recordings written are replaced. Others of the folders touched are written again with them."""
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")
    rows = df.withColumn("part", part)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.parquet(path)
        own = df.select(by).distinct()
        rows = rows.unionByName(there.join(own.select(part.alias("part")).distinct(), "part", "left_semi").join(
            own, there[by].eqNullSafe(own[by]), "left_anti"))
    rows.repartition("part").sortWithinPartitions("part", by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


#: The file name up to its ending; looked for behind slashes only, so that long paths cost little.
FILE_NAME = r"(?:^|/)([^/]+?)(?:\.[^./]*)?$"


def write_logs(lines: DataFrame, path: str) -> None:
    """Lines (rec, line_no, raw) as one text file per recording, named after it."""
    lines.repartition("rec").sortWithinPartitions("rec", "line_no").select(F.col("rec").cast("string").alias("rec"), "raw").write.format(
        _registered(lines.sparkSession, binary.LogFiles)).mode("append").save(path)


def _least_split(spark: SparkSession) -> int:
    """Bytes up to which Spark leaves a file whole: a split has as many as opening a file counts for, or
    the most that the session lets a split have."""
    sizes = [spark.conf.get(f"spark.sql.files.{k}") for k in ("openCostInBytes", "maxPartitionBytes")]
    return min(int(n) << 10 * " kmgtp".index((unit or " ").lower()[0].replace("b", " ")) for n, unit in (
        re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", x).groups() for x in sizes))


def read_logs(spark: SparkSession, path: str, rec: str = FILE_NAME) -> DataFrame:
    """Behaviour logs: rec (what the pattern finds in a file's path), line_no and raw of
    every line that is not empty.

    Long logs are read in Spark's splits. Lines are numbered inside a split, and the numbers of
    lines in the splits before it are added; the table of these has a row for each split of a file that
    may have several. Files too small to be split are read once only.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value",
        F.monotonically_increasing_id().alias("_at"))
    counts = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n").where(F.col("_metadata.file_size") > _least_split(spark)).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1
    return lines.withColumn("_k", inside).join(offsets, ["_file", "_block"], "left").select(
        F.regexp_extract("_file", rec, 1).alias("rec"), (F.coalesce("_before", F.lit(0)) + F.col("_k")).alias("line_no"),
        F.regexp_replace("value", "\r$", "").alias("raw")).where("raw <> ''")


def discovered(a: DataFrame, z: DataFrame, by: str = "rec") -> DataFrame:
    """Sessions that have both inputs."""
    return a.select(by).distinct().join(z.select(by).distinct(), by, "left_semi")


def files_of(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Session ids (file names up to the first dot) of the files that fit a pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(
        F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("rec"))


def _registered(spark: SparkSession, source: type) -> str:
    spark.dataSource.register(source)
    return source.name()


def _pushed(spark: SparkSession) -> str:
    """Whether the session lets Python data sources take filters."""
    return str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()


def write_movie(frames: DataFrame, path: str) -> None:
    """Frames (frame, pixels: bytes of int16) as raw movie files of some frames each, named
    in order of frame."""
    frames.repartitionByRange("frame").sortWithinPartitions("frame").select("frame", "pixels").write.format(
        _registered(frames.sparkSession, binary.RawMovie)).mode("append").save(path)


def read_movie(spark: SparkSession, path: str, height: int, width: int, frames: tuple[int, int] | None = None, split: int = binary.SPLIT) -> DataFrame:
    """Raw int16 movie: frame, mean and pixels of each frame.

    A file, or the files of a folder by name, are cut into ranges of about ``split`` bytes;
    their sizes must be whole numbers of frames. Only frames from ``frames[0]`` to before
    ``frames[1]`` are read; filters on frame narrow this further where the session
    lets data sources take them (spark.sql.python.filterPushdown.enabled).
    """
    low, high = frames or (0, 2**62)
    return spark.read.format(_registered(spark, binary.RawMovie)).options(
        height=height, width=width, split=split, pushed=_pushed(spark), **{"from": low, "to": high}).load(path)


def roi_means(frames: DataFrame, masks: DataFrame | dict, least: int = 10, most_broadcast: int = 4_000_000) -> DataFrame:
    """Mean of each region's pixels in every frame; regions of fewer than ``least`` pixels are missing.

    ``masks`` has a row (roi, pixel) for each pixel (flat index) of a region, or is a dict
    of such. Masks go along with the frames, which are split, in blocks of whole regions of about
    ``most_broadcast`` rows, one block after the other. A pixel outside a frame is an error.
    """
    spark = frames.sparkSession
    if isinstance(masks, dict):
        masks = spark.createDataFrame([(int(k), int(x)) for k, v in masks.items() for x in v], "roi long, pixel long")
    n_blocks = -(-masks.count() // most_broadcast) or 1
    means = [_block_means(frames, masks.where(F.pmod(F.xxhash64("roi"), F.lit(n_blocks)) == k), least) for k in range(n_blocks)]
    return reduce(DataFrame.unionByName, means)


def _block_means(frames: DataFrame, masks: DataFrame, least: int) -> DataFrame:
    own = masks.select("roi", "pixel").toPandas()
    rois, order = np.unique(own["roi"].to_numpy(np.int64), return_inverse=True)
    shared = frames.sparkSession.sparkContext.broadcast((rois, order, own["pixel"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rois, order, pixel = shared.value
        n = np.bincount(order, minlength=rois.size)
        for batch in batches:
            for frame, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums = np.bincount(order, np.frombuffer(x, "<i2")[pixel], rois.size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rois.size, frame)), pa.array(rois), pa.array(sums / n, mask=n < least)], names=["frame", "roi", "value"])

    return frames.select("frame", "pixels").mapInArrow(run, "frame long, roi long, value double")


def write_traces(packed: DataFrame, path: str) -> None:
    """Traces (rec, roi, values) as one .npy matrix per recording, named after it: rows in
    order of ROI, written one by one."""
    sizes = packed.groupBy("rec").agg(F.count("*").alias("n_rows"), F.max(F.size("values")).cast("long").alias("n_samples"))
    packed.join(sizes, "rec").repartition("rec").sortWithinPartitions("rec", "roi").select(
        F.col("rec").cast("string").alias("rec"), "n_rows", "n_samples", F.col("values").cast("array<double>").alias("values")).write.format(
        _registered(packed.sparkSession, binary.TraceMatrices)).mode("append").save(path)


def read_traces(
    spark: SparkSession, path: str, pattern: str = r"\.npy$", rec: str = FILE_NAME, rois: tuple[int, int] | None = None, split: int = binary.SPLIT,
) -> DataFrame:
    """Trace matrices saved as .npy: rec (what the pattern finds in a file's path), roi and
    values. Headers are held against the files' sizes; a matrix is read in ranges of rows,
    and of those only from ``rois[0]`` to before ``rois[1]``; see ``read_movie``."""
    low, high = rois or (0, 2**62)
    return spark.read.format(_registered(spark, binary.TraceMatrices)).options(
        pattern=pattern, rec=rec, split=split, pushed=_pushed(spark), **{"from": low, "to": high}).load(path)


def write_summary(df: DataFrame, path: str) -> None:
    """The flat columns of a session summary as CSV."""
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "struct", "map")]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def todo(sessions: DataFrame, done: DataFrame, by: str = "rec") -> DataFrame:
    """Sessions without a result yet."""
    return sessions.join(done.select(by).distinct(), by, "left_anti")
