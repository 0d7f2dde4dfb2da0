"""Where samples, frames and labelled truth come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline import schemas
from fathomline.functions import frames


def frame_files(spark: SparkSession, folder: str, *, archive: str | None = None, per_trigger: int = 100) -> DataFrame:
    """A stream of the frame files that land in a folder; with ``archive`` read files are moved there."""
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.plmp").option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return frames.decoded(reader.load(folder))


def frame_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The frames of a folder, undecodable ones with an error."""
    return frames.decoded(spark.read.format("binaryFile").option("pathGlobFilter", "*.plmp").load(folder))


def frame_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of frames from Kafka; offsets are committed with the checkpoint. Needs Spark's Kafka connector."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return frames.decoded(raw.select(F.col("value").alias("content")))


def truth_lines(spark: SparkSession, path: str) -> DataFrame:
    """Labelled events of a JSON-lines file; a path that doesn't exist is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.TRUTH).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schemas.TRUTH)


def drained_folder(spark: SparkSession, folder: str, handle: Callable[[DataFrame], None]) -> tuple[int, int]:
    """One poll of a folder: its frames in order of file name go to ``handle``, then files move to ``.processed``, those
    that can't be decoded with ``.invalid`` behind their name. How many of each there were. What comes in meanwhile is
    left to the next poll; a handler that fails leaves all files where they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    base = path(folder)
    fs = base.getFileSystem(conf)
    names = sorted(f.getPath().getName() for f in fs.listStatus(base) if f.isFile() and f.getPath().getName().endswith(".plmp"))
    if not names:
        return 0, 0
    raw = spark.read.format("binaryFile").load([f"{folder.rstrip('/')}/{n}" for n in names]).select("path", "content")
    rows = frames.decoded(raw, keep=("path",)).withColumn("file", F.substring_index("path", "/", -1)).drop("path")
    good, bad = split_errors(rows)
    invalid = {r["file"] for r in bad.select("file").collect()}  # names of this poll's files alone
    handle(good.orderBy("file"))
    done = path(base, ".processed")
    fs.mkdirs(done)
    for n in names:
        fs.rename(path(base, n), path(done, n + (".invalid" if n in invalid else "")))
    return len(names) - len(invalid), len(invalid)


def split_errors(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, what to quarantine)."""
    return decoded.where("error is null").drop("error"), decoded.where("error is not null")
