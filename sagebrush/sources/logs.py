"""Readers of event logs, registries and texts, and the sinks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def is_there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are left out. A path without files gives no rows."""
    fields = StructType.fromDDL(schema)
    if not is_there(spark, path):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a malformed line fails the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def chat_traces(spark: SparkSession, folder: str) -> DataFrame:
    """messages of all files called traces.jsonl below ``folder`` that begin with system, user and assistant."""
    lines = spark.read.schema("messages array<struct<role:string,content:string>>").option("recursiveFileLookup", True).option("pathGlobFilter", "traces.jsonl").option("mode", "DROPMALFORMED").json(folder)
    return lines.filter(F.slice(F.transform("messages", lambda m: m["role"]), 1, 3) == F.array(*map(F.lit, ("system", "user", "assistant"))))


def trace_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row: n_lines of all files called traces.jsonl, n_malformed, n_other_shape (roles that aren't system, user, assistant), n_kept."""
    schema = "messages array<struct<role:string,content:string>>, _corrupt_record string"
    lines = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "traces.jsonl").json(folder)
    bad = F.col("_corrupt_record").isNotNull()
    shaped = F.coalesce(F.slice(F.transform("messages", lambda m: m["role"]), 1, 3) == F.array(*map(F.lit, ("system", "user", "assistant"))), F.lit(False))
    # Only counted: Spark refuses to read the corrupt records alone, so the messages are read with them.
    return lines.select(bad.alias("bad"), shaped.alias("shaped")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("bad").alias("n_malformed"), F.count_if(~F.col("bad") & ~F.col("shaped")).alias("n_other_shape"), F.count_if(~F.col("bad") & F.col("shaped")).alias("n_kept"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """name and text of each file, whole."""
    found = spark.read.text(path, wholetext=True)
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def slice_of(entries: DataFrame, key: str, required: bool = True) -> DataFrame:
    """The entry (key, value) with a key, one row; without it an error when the row is read, or a null value if not ``required``."""
    found = entries.filter(F.col("key") == key).agg(F.max("value").alias("value"))
    missing = F.raise_error(F.lit(f"no entry {key}")).cast(found.schema["value"].dataType) if required else F.lit(None)
    return found.select(F.lit(key).alias("key"), F.coalesce(F.col("value"), missing).alias("value"))


def first_source(key: list[str], order: str, *tiers: DataFrame) -> DataFrame:
    """One row of each key, from the first tier that has it and of that the first in ``order``; column tier tells which (from 0)."""
    ranked = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    every = ranked[0]
    for t in ranked[1:]:
        every = every.unionByName(t)
    rest = [c for c in every.columns if c not in key]
    return every.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("tier", order)).alias("r")).select(*key, "r.*")


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key and value of one JSON object in a file; a missing file and what doesn't parse give no rows."""
    if not is_there(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """category, slug, name and scraper_url of ``folder``/category/slug.json, sorted; unreadable files are left out."""
    found = spark.read.schema("name string, slug string, category string, scraper_url string, _corrupt_record string").option("multiLine", True).json(f"{folder}/*/*.json")
    file = F.col("_metadata.file_path")
    keyed = found.select(
        F.coalesce("category", F.regexp_extract(file, r"/([^/]+)/[^/]+\.json$", 1)).alias("category"),
        F.coalesce("slug", F.regexp_extract(file, r"/([^/]+)\.json$", 1)).alias("slug"),
        "name",
        F.coalesce("scraper_url", F.lit("")).alias("scraper_url"),
        "_corrupt_record",
    )
    return keyed.filter("_corrupt_record is null").drop("_corrupt_record").orderBy("category", "slug")


def memo_key(name: Column) -> Column:
    """date, category and slug of ``{date}-{category}-{slug}.md``; null if the name has another shape."""
    shape = r"^(\d{4}-\d{2}-\d{2})-([^-]+)-(.+)\.md$"
    return F.when(name.rlike(shape), F.struct(*(F.regexp_extract(name, shape, i).alias(k) for i, k in enumerate(("date", "category", "slug"), 1))))


def repaired_json(text: Column, schema: str) -> Column:
    """The object between the first and the last brace of a noisy text, trailing commas dropped; null if none parses."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """Add rows to a log of Parquet files."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def absent_from(df: DataFrame, there: DataFrame, *key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``there``: what is left to do."""
    return df.join(there.select(*key).distinct(), list(key), "left_anti")
