"""Lines of text files with ``seq``, the order of arrival: files in their order, lines by their place in a file.

Spark reads files in pieces and in any order. A line's piece begins at a byte that Spark tells, and rows of one piece come
in their order; so the lines of each piece are counted, and the pieces before it tell where its numbers begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from sagebrush.operators.order import running_total

from .logs import is_there


def numbered_lines(spark: SparkSession, path: str, by_time: bool = False) -> DataFrame:
    """seq (from 0, without gaps), file and value of each line, blank ones included; a path without files gives no rows.

    Files stand in the order of their paths, or of their times of change and then their paths. One pass counts lines by
    piece, one row for each piece of a file; a second one numbers them.
    """
    if not is_there(spark, path):
        return spark.createDataFrame([], "seq long, file string, value string")
    meta = lambda c: F.col(f"_metadata.{c}")
    time = meta("file_modification_time") if by_time else F.lit(None).cast("timestamp")
    lines = spark.read.text(path).select("value", time.alias("time"), meta("file_path").alias("file"), meta("file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    # Ids rise within a piece, one by one, wherever Spark reads it.
    pieces = lines.groupBy("time", "file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    upto = running_total(pieces, "upto", F.col("n"), F.asc_nulls_first("time"), F.col("file"), F.col("at"))
    begins = upto.select("file", "at", (F.col("upto") - F.col("n") - F.col("first")).alias("shift"))
    return lines.join(begins, ["file", "at"]).select((F.col("id") + F.col("shift")).alias("seq"), "file", "value")


def arrived_jsonl(spark: SparkSession, path: str, schema: str, by_time: bool = False) -> DataFrame:
    """Rows of JSON lines with ``seq``, the number of their line; blank and malformed lines have a number and no row."""
    fields = StructType.fromDDL(schema)
    parsed = StructType([*fields.fields]).add("_corrupt_record", StringType())
    lines = numbered_lines(spark, path, by_time).filter(F.trim("value") != "")
    rows = lines.select("seq", F.from_json("value", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.filter("r._corrupt_record is null").select("seq", *(F.col("r")[f].alias(f) for f in fields.names))
