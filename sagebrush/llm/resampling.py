"""Importance resampling towards a target distribution, with hashed word n-grams.

DuckDB counts each partition: SQL takes a text's words apart, makes n-grams by windows over them, and a registered zlib
CRC deals these to buckets. The bucket counts of each row are spilled to Parquet; Spark adds them up over the
corpus and over the target, turns both into a gain for each bucket, and scores every row from its own spilled counts.
Gumbel noise from a hash of the id makes the highest scores a draw without replacement.

Ranks are places along a global order, parted by range: each part numbers its own rows, and the parts' sizes, one
number a part, tell where it begins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of, text_slices

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that DuckDB counts at once, and the memory it may use.
SLICE_BYTES, MEMORY = 2_000_000, "400MB"
COUNTED = "n_words long, n_features long, buckets array<int>, counts array<long>"


def grams_sql(grams: int) -> str:
    """Every run of 1 to ``grams`` words of each row of ``words`` (row, place, word), joined by one space."""
    size = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER (PARTITION BY row ORDER BY place)" for i in range(1, n))])
    each = [f"SELECT row, {size(n)} AS feature FROM words" for n in range(1, grams + 1)]
    return f"SELECT row, feature FROM ({' UNION ALL '.join(each)}) WHERE feature IS NOT NULL"


def counting_sql(grams: int, buckets: int) -> str:
    """Bucket counts of each row of ``slice`` (row, text)."""
    return f"""
        WITH split AS (SELECT row, regexp_extract_all(translate(text, '{CAPITALS}', '{SMALL}'), '{WORD}') AS w FROM slice),
        words AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS place FROM split),
        counted AS (SELECT row, feature, count(*) AS n FROM ({grams_sql(grams)}) GROUP BY ALL),
        hashed AS (SELECT feature, crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
        dealt AS (SELECT row, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
        told AS (SELECT row, sum(n)::BIGINT AS n_features, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts FROM dealt GROUP BY row)
        SELECT len(w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
        FROM split LEFT JOIN told USING (row) ORDER BY row"""


def crc32(words: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(w.encode()) for w in words.to_pylist()], pa.int64())


def bucket_counts(docs: DataFrame, grams: int, buckets: int, ids: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``ids`` (long), n_words, n_features, and the buckets of each row's n-grams with their counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(", ".join([*(f"{c} long" for c in ids), COUNTED]))
    arrow, sql = to_arrow_schema(schema), counting_sql(grams, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # No temporary folder: a slice fits the memory, and nothing goes to an executor's own disk.
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            con.create_function("crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                for part in text_slices(batch, SLICE_BYTES, len(ids)):
                    con.register("slice", pa.table({"row": pa.array(range(part.num_rows), pa.int32()), "text": part.column(len(ids))}))
                    found = con.sql(sql).to_arrow_table()
                    con.unregister("slice")
                    columns = [*part.columns[: len(ids)], *(found.column(i).combine_chunks() for i in range(4))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*(F.col(c).cast("long") for c in ids), text_of().alias("text")).mapInArrow(run, schema)


def totals(counted: DataFrame, name: str) -> DataFrame:
    """bucket and the sum of its counts over all rows."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket, from bucket counts of the corpus and the target; ``buckets`` numbers, whatever the corpus."""
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(totals(source, "s"), "bucket", "left").join(totals(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    size = lambda df: df.agg(F.sum("n_features")).first()[0] or 0
    n_source, n_target = size(source) + buckets, size(target) + buckets
    ratio = ((F.col("t") + 1).cast("double") * float(n_source)) / ((F.col("s") + 1).cast("double") * float(n_target))
    found = both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    out = [0] * buckets
    for r in found:
        out[r.bucket] = r.gain
    return out


def weight_of(gain: list[int]) -> Column:
    """The sum of the gains of a row's n-grams. The list is a constant of the plan, folded once."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    each = F.zip_with("buckets", "counts", lambda b, n: F.get(table, b) * n)
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda total, x: total + x)


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of doc_id; a null id counts as empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank; rank is null for rows that aren't drawn.

    Drawn are ``percent`` of the rows of ``least_words`` words or more, rounded down: the highest scores, ties to the
    smaller doc_id, null ids last, then the one of fewer n-grams. Null texts count as empty: no n-grams, weight 0, never
    drawn. Repeated ids are kept, each row by itself, with the same noise. Other columns of either side are not read. An
    empty target leaves the corpus's own frequencies to tell the gains; no documents give no rows.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    own = scratch.keep(bucket_counts(docs, grams, buckets, ("doc_id",)), "documents")
    aim = scratch.keep(bucket_counts(target, grams, buckets), "target")
    scored = own.select("doc_id", "n_words", "n_features", weight_of(gains(own, aim, buckets)).alias("weight"))
    scored = scored.withColumn("score", F.col("weight") + noise(seed)).withColumn("fits", F.col("n_words") >= least_words).drop("n_words")
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    # The number that Spark gives a row is its place in its part, and above that the part; written, both stay as they are.
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = scratch.keep(placed, "placed")
    part, bits = F.shiftright("place", 33), (1 << 33) - 1
    sizes = sorted((r.part, r.n, r.fit) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fit")).collect())
    begins, total = [], 0
    for p, n, _ in sizes:
        begins.append((p, total))
        total += n
    drawn = percent * sum(f for _, _, f in sizes) // 100
    starts = F.broadcast(docs.sparkSession.createDataFrame(begins, "part int, begin long"))
    rank = F.col("place").bitwiseAND(F.lit(bits)) + F.col("begin") + 1
    found = placed.withColumn("part", part.cast("int")).join(starts, "part")
    return found.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **settings: int) -> DataFrame:
    """``docs`` with all its columns, only the rows whose doc_id is drawn; a repeated id is drawn with all its rows.

    Rows with null ids are never among them. The drawn ids grow with the documents, so the join is always merged.
    """
    ids = resample(docs, target, **settings).filter("rank is not null and doc_id is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids.hint("merge"), F.col("doc_id").cast("long") == F.col("_drawn"), "left_semi")
