"""What several operators of this subpackage share: scratch tables and small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOCAL_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a local session gets a folder of its own; a cluster
    session is refused, since its executors don't see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_SCRATCH:
        LOCAL_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return LOCAL_SCRATCH[app]


class Scratch:
    """Tables that an operator writes to cut its lineage: a lost executor costs a re-read, not a recomputation.

    They are Parquet files below :func:`shared_folder`. ``drop`` removes one early; the rest go when the session ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jvm_path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self.jvm_path(self.root))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.jvm_path(f"{self.root}/{name}"), True)


def text_of(column: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def map_texts(df: DataFrame, rows: Callable[..., list], schema: str, ids: tuple[str, ...] = ("doc_id",), slice_bytes: int = 4_000_000) -> DataFrame:
    """Run ``rows(*ids, texts)`` over slices of Arrow batches of the columns ``ids`` and text.

    A slice ends after ``slice_bytes`` of text, so that memory is bounded by that plus one text. Null texts arrive as
    empty ones. Only these columns leave the JVM, whatever else ``df`` holds. ``rows`` returns one Arrow array, or
    something that ``pyarrow.array`` takes, for each column of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, slice_bytes, len(ids)):
                columns = rows(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.select(*ids, text_of().alias("text")).mapInArrow(run, parsed)


def text_slices(batch: pa.RecordBatch, slice_bytes: int, column: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``slice_bytes`` of text."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= slice_bytes:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
