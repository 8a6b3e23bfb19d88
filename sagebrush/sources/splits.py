"""Training files and the held-out files that go with them, told by their names when a job is planned."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .logs import is_there

TRAIN = re.compile(r"\.train(\.[^./]+)$")
LAST = re.compile(r"(\.[^./]+)$")


class Split(NamedTuple):
    train: str
    val: str | None


def siblings(path: str) -> Split:
    """Names of the two parts of a file: ``x.train.jsonl`` and ``x.val.jsonl`` for ``x.jsonl``; without an ending they are appended."""
    name = path.rsplit("/", 1)[-1]
    if not LAST.search(name) or name.startswith(".") and name.count(".") == 1:
        return Split(f"{path}.train", f"{path}.val")
    return Split(LAST.sub(r".train\1", path), LAST.sub(r".val\1", path))


def resolved(spark: SparkSession, path: str) -> Split:
    """What to read for ``path``: both parts, if both are there, go before the whole.

    A path that names the training part itself stays, with its held-out part if that is there.
    """
    if TRAIN.search(path):
        val = TRAIN.sub(r".val\1", path)
        return Split(path, val if is_there(spark, val) else None)
    both = siblings(path)
    return both if all(is_there(spark, p) for p in both) else Split(path, None)


def evaluation_path(enabled: bool, given: str | None, found: str | None) -> str | None:
    """The held-out file to use: none unless evaluation is on; a given one goes before one that was found."""
    return (given or found) if enabled else None


def training_rows(spark: SparkSession, path: str, schema: str, evaluate: bool = False, given: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Training rows, and held-out rows if evaluation is on and there is a file of them. Malformed lines fail the job."""
    from .logs import strict_jsonl

    split = resolved(spark, path)
    held = evaluation_path(evaluate, given, split.val)
    return strict_jsonl(spark, split.train, schema), strict_jsonl(spark, held, schema) if held else None


def write_split(rows: DataFrame, path: str, column: str = "split") -> Split:
    """Write rows whose ``column`` says train or val to the two parts of ``path``, as folders of JSON lines."""
    out = siblings(path)
    for name, where in zip(("train", "val"), out, strict=True):
        rows.filter(rows[column] == name).drop(column).write.mode("overwrite").json(where)
    return out
