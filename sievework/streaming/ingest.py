"""Resumable ingest: manifest lines stream into a run folder batch by batch, and a restart neither loses nor repeats any.

A run folder holds `rows` (Parquet by batch), `rejected` (lines that are no records) and `done` (a marker per cell).
The stream's own checkpoint says which files were read; a batch that runs again overwrites its own folder, so each
line is stored once."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.sources.manifest import SCHEMA, violations


def ingest(spark: SparkSession, incoming: str, run: str, *, cell: str = "probe_group", continuous: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts the stream from the folder `incoming` of JSON lines; with continuous off it ends when all is read."""
    lines = spark.readStream.schema(SCHEMA + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).json(incoming)

    def store(batch: DataFrame, number: int) -> None:
        # One pass decides; the batch is bounded by files_per_batch.
        judged = batch.withColumn("problems", F.when(F.col("_corrupt").isNotNull(), F.array(F.lit("no record"))).otherwise(violations())).persist()
        try:
            good = judged.where("size(problems) = 0").drop("_corrupt", "problems")
            good.write.mode("overwrite").parquet(f"{run}/rows/batch={number}")
            judged.where("size(problems) > 0").select("_corrupt", "image_id", "problems").write.mode("overwrite").parquet(f"{run}/rejected/batch={number}")
            cells = good.select(F.coalesce(F.col(cell).cast("string"), F.lit("")).alias("cell")).distinct().withColumn("batch", F.lit(number))
            cells.write.mode("overwrite").parquet(f"{run}/done/batch={number}")
        finally:
            judged.unpersist()

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", f"{run}/checkpoint")
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def stored(spark: SparkSession, run: str) -> DataFrame:
    """The manifest rows of a run folder."""
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{run}/rows")


def rejected(spark: SparkSession, run: str) -> DataFrame:
    return spark.read.schema("_corrupt string, image_id string, problems array<string>").option("recursiveFileLookup", True).parquet(f"{run}/rejected")


def remaining(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cells that are not done: what a restart has to make."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def counted(spark: SparkSession, incoming: str, *, window: str = "1 hour", late: str = "2 hours", time: str = "ts", key: str = "event_type") -> DataFrame:
    """A stream of counts by window and key over JSON or Parquet events; rows later than `late` are dropped.

    incoming: a folder of Parquet files with the columns event_id, ts, event_type, value."""
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(incoming)
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


# A driver that makes cells one after another keeps its own file and markers.


def append_line(path: str, record: dict) -> None:
    """Appends the record as one JSON line, and returns once it is on the disk."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(json.dumps(record, ensure_ascii=False).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def marker(run: str, cell: str) -> Path:
    return Path(run, "_done", hashlib.sha1(cell.encode()).hexdigest() + ".marker")


def mark_done(run: str, cell: str) -> None:
    path = marker(run, cell)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.touch()


def is_done(run: str, cell: str) -> bool:
    return marker(run, cell).exists()


def not_done(run: str, cells: Iterable[str]) -> list[str]:
    """The cells without a marker, in their order; the folder is listed once."""
    folder = Path(run, "_done")
    there = {p.name for p in folder.iterdir()} if folder.exists() else set()
    return [c for c in cells if marker(run, c).name not in there]


def repair_tail(path: str, backup: str = ".bak") -> bool:
    """Mends what an interrupted append left at the end of a file of JSON lines; True if there was anything.

    A last line that is no JSON is cut off, and one that only lacks its line end gets it. The file as it was stays
    beside it. Only the end of the file is read, so its size does not matter."""
    if not os.path.exists(path) or not (size := os.path.getsize(path)):
        return False
    with open(path, "rb") as f:
        tail, at = b"", size
        while at and b"\n" not in tail[:-1]:  # back to the line end before the last line
            at = max(0, at - 65536)
            f.seek(at)
            tail = f.read(size - at)
    start = at + tail[:-1].rfind(b"\n") + 1
    last = tail[start - at :]
    try:
        json.loads(last.decode("utf-8"))
        whole = True
    except ValueError:  # half a character is no UTF-8, half a record no JSON
        whole = False
    if whole and last.endswith(b"\n"):
        return False
    shutil.copy2(path, path + backup)
    with open(path, "r+b") as f:
        if whole:
            f.seek(size)
            f.write(b"\n")
        else:
            f.truncate(start)
        f.flush()
        os.fsync(f.fileno())
    return True
