"""The event log as a stream: live counts, latest rows, windows, replays and checks that fall due."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sagebrush.operators.latest import counts_since_marker
from sagebrush.operators.order import checkpoint_folder, until_exit
from sagebrush.sources.store import Ledger, Store


def read_log(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the Parquet files below ``path``; event time needs a zone, so ts is cast."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and total value of each day, told once the watermark has passed it."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sliding(log: DataFrame, size: str, slide: str, late: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(log: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def latest_per_key(log: DataFrame, key: str) -> DataFrame:
    """The latest row of each key so far, in complete or update mode; streams have no row_number."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", -F.col("event_id"))).alias("r")).select(key, "r.*")


def without_replays(log: DataFrame, id_column: str, late: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_column])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_at(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole result of an aggregation in a store's versions; each batch writes the next one, and readers see whole ones only."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: Store(df.sparkSession, path, schema).replace(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, complete: bool = False) -> DataFrame:
    """Run a stream over what is there, and read what it wrote to the shared folder; the folder goes when the session ends."""
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    until_exit(spark, base)
    if complete:
        replace_at(stream, f"{base}/rows", f"{base}/state").awaitTermination()
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
        return Store(spark, f"{base}/rows", schema).read()
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/rows")
    append_to(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def due_checks(log: DataFrame, every: int = 10) -> DataFrame:
    """Runs of each category since its last accuracy check, and whether a check is due, as an update after each batch.

    The log has seq, type and category. The state of a category is two numbers. Of a batch's rows the places of runs after
    the latest check are held, 8 bytes each; where a category is hot, :func:`counted_since` counts it in several tasks.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, upto = state.get if state.exists else (0, -1)
        last, held = upto, []
        for rows in batches:
            last = max(last, rows.loc[rows["type"] == "accuracy_check", "seq"].max() if (rows["type"] == "accuracy_check").any() else last)
            places = rows.loc[(rows["type"] == "live_run") & (rows["seq"] > last), "seq"]
            held.append(places.to_numpy())
        n = (n if last == upto else 0) + int(sum((x > last).sum() for x in held))
        state.update((n, int(last)))
        yield pd.DataFrame({"category": [key[0]], "n_since": [n], "due": [n >= every]})

    schema = "category string, n_since long, due boolean"
    return log.select("category", "seq", "type").groupBy("category").applyInPandasWithState(count, schema, "n long, upto long", "update", GroupStateTimeout.NoTimeout)


def counts_store(spark: SparkSession, folder: str, key: str, key_type: str) -> Store:
    """The table of :func:`counted_since`: one row a key."""
    return Store(spark, f"{folder}/counts", f"{key} {key_type}, marker_seq long, n_since long", ledger=Ledger(spark, f"{folder}/ledger"))


def counted_since(log: DataFrame, key: str, marker: Column, what: Column, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep one row of each key in a table: the place of its last marker, and the rows since for which ``what`` holds.

    ``log`` has seq, which rises from batch to batch but not within one. Each batch is counted by aggregates, in part
    before the shuffle, so a hot key is counted in many tasks. Its changes are committed under its number, and a batch
    that is done again changes nothing.
    """
    kind = log.schema[key].dataType.simpleString()

    def add(rows: DataFrame, number: int) -> None:
        store = counts_store(rows.sparkSession, folder, key, kind)
        if str(number) in store.ledger.batches():
            return
        new = counts_since_marker(rows, marker, what, key).alias("new")
        old = store.read().alias("old")
        both = new.join(old, F.col(f"new.{key}").eqNullSafe(F.col(f"old.{key}")), "left")
        kept = F.when(F.col("new.marker_seq").isNull(), F.coalesce("old.n_since", F.lit(0))).otherwise(0)
        found = both.select(F.col(f"new.{key}").alias(key), F.coalesce("new.marker_seq", "old.marker_seq").alias("marker_seq"), (F.col("new.n_since") + kept).alias("n_since"))
        store.ledger.commit(str(number), [(store, "upsert", found, (key,))])

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
