"""Event logs: JSON lines, of which the last one may be incomplete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields of an event.
EVENT = "schema_version string, run_id string, sequence long, event_id string, emitted_at string, event string, data string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-line files; lines that aren't complete JSON objects of these fields are left out."""
    parsed = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    rows = spark.read.text(path).select(parsed.alias("e"))
    return rows.where("e.run_id is not null and e.sequence is not null").select("e.*")


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of the files that appear in a folder."""
    rows = spark.readStream.text(path).select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"))
    return rows.where("e.run_id is not null and e.sequence is not null").select("e.*")


def tail(lines: DataFrame, order: str, size: int) -> DataFrame:
    """The last lines (order, line) that together, with their line ends, fit in ``size`` bytes.

    Only lines within ``size`` rows of the end can fit, so no more leave each task.
    """
    bytes_ = (F.octet_length("line") + 1).cast("long")
    last = lines.orderBy(F.desc(order)).limit(size)
    w = Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return last.withColumn("_after", F.sum(bytes_).over(w)).where(F.col("_after") <= size).drop("_after")
