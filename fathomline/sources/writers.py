"""Where events, series and frames go."""

from __future__ import annotations

import itertools
import json
import os
import shutil
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import frames, identity


def json_lines(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def posted(df: DataFrame, url: str, timeout_s: float = 10.0) -> None:
    """One POST of JSON for each row from the executors; any status but 2xx fails the task."""

    def send(rows: Iterator[Row]) -> None:
        for row in rows:
            request = urllib.request.Request(url, json.dumps(row.asDict(True), default=str).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                if not 200 <= answer.status < 300:
                    raise OSError(f"status {answer.status}")

    df.foreachPartition(send)


def to_topic(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: Column):
    out = stream.select(key.cast("string").alias("key"), F.col("content").alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def each_batch(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]):
    """Every sink in turn for each batch, the batch computed once; the first failure comes after all were tried."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        failed = []
        for sink in sinks:
            try:
                sink(batch, number)
            except Exception as e:
                failed.append(e)
        batch.unpersist()
        if failed:
            raise failed[0]

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()


def frame_files(batch: DataFrame, folder: str) -> None:
    """One ``.plmp`` file for each frame in a folder that executors share, named by shard, emitter, view, epoch and
    sequence, so that a batch that is tried again writes the same files."""
    named = frames.encoded(batch.withColumn("file", F.concat_ws("-", *[F.col(c).cast("string") for c in ("shard_id", "emitter_id", "view_id", "epoch", "seq")])), keep=("file",))

    def write(rows: Iterator[Row]) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            path = os.path.join(folder, row["file"])
            with open(f"{path}.part-{uuid.uuid4().hex}", "wb") as f:
                f.write(row["content"])
            os.replace(f.name, path + ".plmp")

    named.foreachPartition(write)


class Spool:
    """A sink that may be down, with a bounded backlog on disk: a batch that the sink refuses waits as Parquet, later
    batches wait behind it, and every batch first tries what waits, oldest first. A batch that would take the backlog
    over ``most_bytes`` is dropped and counted; one that can't be read any more is skipped and counted."""

    def __init__(self, sink: Callable[[DataFrame, int], None], folder: str, most_bytes: int):
        self.sink, self.folder, self.most = sink, folder, most_bytes
        self.dropped = self.unreadable = 0
        os.makedirs(folder, exist_ok=True)

    def waiting(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if not n.startswith("."))

    def held(self) -> int:
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(self.folder) for f in names)

    def drain(self, spark: SparkSession) -> bool:
        """Whether the backlog is empty after trying it in order."""
        for name in self.waiting():
            path = os.path.join(self.folder, name)
            try:
                batch = spark.read.parquet(path)
                batch.count()
            except Exception:
                self.unreadable += 1
                shutil.rmtree(path, ignore_errors=True)
                continue
            try:
                self.sink(batch, int(name))
            except Exception:
                return False
            shutil.rmtree(path)
        return True

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.drain(batch.sparkSession):
            try:
                return self.sink(batch, number)
            except Exception:
                pass
        part = os.path.join(self.folder, f".{number:020d}")
        batch.write.mode("overwrite").parquet(part)
        if self.held() > self.most:
            self.dropped += 1
            shutil.rmtree(part)
            return
        os.replace(part, os.path.join(self.folder, f"{number:020d}"))


def teed(sink: Callable[[DataFrame, int], None], audit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink whose batches an audit sees too, before they go out and whether or not they do."""

    def run(batch: DataFrame, number: int) -> None:
        audit(batch, number)
        sink(batch, number)

    return run


def report_json(report: DataFrame, path: str) -> None:
    """A report of one row as a JSON file that is there whole or not at all."""
    row = report.first()
    with open(f"{path}.part", "w") as f:
        json.dump(row.asDict(True) if row else {}, f, default=str, indent=2)
    os.replace(f"{path}.part", path)


def save_state(state: DataFrame, folder: str) -> None:
    """A state table as a new version of ``folder``; readers see the old one until the new one is whole."""
    name = uuid.uuid4().hex
    state.write.parquet(f"{folder.rstrip('/')}/{name}")
    with open(os.path.join(folder, ".current.part"), "w") as f:
        f.write(name)
    os.replace(f.name, os.path.join(folder, ".current"))
    for old in os.listdir(folder):
        if old not in (name, ".current"):
            shutil.rmtree(os.path.join(folder, old), ignore_errors=True)


def load_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last whole version of a state table; none yet is an empty one."""
    try:
        with open(os.path.join(folder, ".current")) as f:
            return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{f.read()}")
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def remote_write_rows(series: DataFrame, name: str = "name", labels: dict[str, str] | None = None) -> DataFrame:
    """(labels as an array ordered by name, value, timestamp_ms) with a valid metric name, as remote-write wants them."""
    extra = [F.struct(F.lit(k).alias("name"), F.col(v).cast("string").alias("value")) for k, v in (labels or {}).items()]
    metric = F.struct(F.lit("__name__").alias("name"), identity.metric_name(F.col(name)).alias("value"))
    return series.select(F.sort_array(F.array(metric, *extra)).alias("labels"), "value", "timestamp_ms")


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def remote_write_request(rows: list[Row]) -> bytes:
    """The protocol buffer message of rows of ``remote_write_rows``."""
    import struct

    out = []
    for r in rows:
        names = b"".join(_field(1, _field(1, x["name"].encode()) + _field(2, x["value"].encode())) for x in r["labels"])
        sample = b"\x09" + struct.pack("<d", r["value"]) + b"\x10" + _varint(r["timestamp_ms"] & (1 << 64) - 1)
        out.append(_field(1, names + _field(2, sample)))
    return b"".join(out)


def remote_written(rows: DataFrame, url: str, per_request: int = 500, timeout_s: float = 10.0) -> None:
    """Rows of ``remote_write_rows`` posted from the executors, so many series in each request; any status but 2xx fails
    the task."""

    def send(part: Iterator[Row]) -> None:
        while batch := list(itertools.islice(part, per_request)):
            headers = {"Content-Type": "application/x-protobuf", "Content-Encoding": "snappy", "X-Prometheus-Remote-Write-Version": "0.1.0"}
            request = urllib.request.Request(url, snappy_block(remote_write_request(batch)), headers)
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                if not 200 <= answer.status < 300:
                    raise OSError(f"status {answer.status}")

    rows.foreachPartition(send)


def snappy_block(data: bytes) -> bytes:
    """The block format of snappy with literals only."""
    out = [_varint(len(data))]
    for k in range(0, len(data), 65536):
        part = data[k : k + 65536]
        n = len(part) - 1
        out.append(bytes([n << 2]) if n < 60 else bytes([60 << 2, n]) if n < 256 else bytes([61 << 2]) + n.to_bytes(2, "little"))
        out.append(part)
    return b"".join(out)
