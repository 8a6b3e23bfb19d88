"""Exact top-k inner products over an impact-ordered index, score at a time.

Candidates are dealt to blocks, and each block is indexed by itself: for each dimension and quantised impact, a
segment lists the vectors whose component has that impact. A block is built once, in one task; all queries stream past
it in batches. Segments are processed by descending impact; all of a segment's vectors get the same addition to their
scores. At any time a score is known to within the query's weights times the impact not yet seen (or the
quantisation), which proves that most vectors can't be among the k best. Once few are left, or at the end of the index,
all that are possible are scored exactly.

The queries go to every block, as a search of all of them against all rows must; larger blocks mean fewer copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Candidates in a block, on average, and queries that meet it at once.
BLOCK_ROWS, QUERY_ROWS = 8192, 256
LEVELS = 64
#: Possible members for which the index is left before its end.
FEW = 64


class Block:
    """Impact-ordered segments of a block of integer vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.vectors = rows[order], ids[order], vectors[order]
        self.step = max(1, -(-int(np.abs(self.vectors).max()) // LEVELS))
        self.levels = np.abs(self.vectors) // self.step
        # (level, dimension, addition, rows), by descending level
        self.segments: list[tuple[int, int, int, np.ndarray]] = []
        signed = np.where(self.vectors < 0, -1, 1) * (2 * self.levels + 1)
        for d in range(self.vectors.shape[1]):
            by = np.argsort(signed[:, d], kind="stable")
            values, starts = np.unique(signed[by, d], return_index=True)
            for v, rows in zip(values.tolist(), np.split(by, starts[1:]), strict=True):
                level = (abs(v) - 1) // 2
                self.segments.append((level, d, (1 if v > 0 else -1) * (level * self.step + self.step // 2), rows))
        self.segments.sort(key=lambda s: -s[0])

    def best(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, vector ids and scores of each query's k best in this block, ties to smaller ids."""
        scores = np.zeros((len(self.ids), len(queries)), np.int64)
        weights = np.abs(queries).sum(axis=1)
        own = self.rows[:, None] == query_rows[None, :]
        places = max(0, len(self.ids) - k)
        possible = np.ones_like(own)
        level = None
        for at, (this, d, addition, rows) in enumerate(self.segments):
            scores[rows] += addition * queries[:, d]
            level = this
            after = self.segments[at + 1][0] if at + 1 < len(self.segments) else -1
            # Bounds are looked at where the unseen impact has halved.
            if after == level or (after >= 0 and after & (after + 1)) or after > LEVELS // 4:
                continue
            slack = weights * max(self.step // 2, (after + 1) * self.step - 1 if after >= 0 else 0)
            known = np.where(own, np.iinfo(np.int64).min, scores)
            least = np.partition(known, places, axis=0)[places] - 2 * slack if places else np.full(len(queries), np.iinfo(np.int64).min)
            possible = (scores >= least) & ~own
            if possible.sum(axis=0).max() <= max(FEW, 4 * k):
                break
        possible &= ~own
        out_q, out_v, out_s = [], [], []
        for j in range(len(queries)):
            rows = np.flatnonzero(possible[:, j])
            exact = self.vectors[rows] @ queries[j]
            top = np.lexsort((self.ids[rows], -exact))[:k]
            out_q.append(np.full(len(top), j)), out_v.append(self.ids[rows[top]]), out_s.append(exact[top])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_v, out_s))


def stream(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The k best of each query in each block of a partition sorted by size, block and ``asks``, candidates first."""
    key, waiting, block = None, [], None
    for batch in batches:
        cuts = np.flatnonzero((batch[["size", "block", "asks"]].to_numpy()[1:] != batch[["size", "block", "asks"]].to_numpy()[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(batch)), cuts):
            rows = batch.iloc[part]
            first = rows.iloc[0]
            if key != (first["size"], first["block"]):
                key, waiting, block = (first["size"], first["block"]), [], None
            if not first["asks"]:
                waiting.append(rows)
                continue
            if block is None and waiting:
                block = Block(*(np.concatenate([x[c].to_numpy() for x in waiting]) for c in ("row", "vec_id")), np.stack([v for x in waiting for v in x["vector"]]))
                waiting = []
            if block is None:
                continue
            for at in range(0, len(rows), QUERY_ROWS):
                some = rows.iloc[at : at + QUERY_ROWS]
                q, v, s = block.best(some["row"].to_numpy(), np.stack(some["vector"].to_numpy()), k)
                yield pd.DataFrame({"query_row": some["row"].to_numpy()[q], "query_id": some["vec_id"].to_numpy()[q], "vec_id": v, "score": s})


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest integer inner products of each query.

    ``vectors`` has vec_id and embedding; rows for which the column ``is_query`` holds are queries, and every row but
    the query's own is a candidate. A component x counts as floor(scale * x). Ties go to the smaller vec_id. Vectors
    that are null, empty, or hold null or non-finite components, and rows with null vec_id, take no part; only
    vectors of one length are compared. Rows that repeat a vec_id are candidates and queries of their own; each such
    query has its own ranks. A query with fewer than k candidates returns all. Other columns are not read. No rows
    give no rows.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    # Rows are told apart by a number that is written with them, once.
    ints = ints.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"), F.size("embedding").alias("size"), is_query.alias("asks"))
    ints = scratch.keep(ints, "vectors")
    blocks = max(-(-ints.count() // BLOCK_ROWS), 1)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    candidates = ints.select("row", "vec_id", "vector", "size", block.alias("block"), F.lit(False).alias("asks"))
    queries = ints.filter("asks").select("row", "vec_id", "vector", "size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"))
    dealt = candidates.union(queries).repartition(blocks, "size", "block").sortWithinPartitions("size", "block", "asks")
    found = dealt.mapInPandas(lambda batches: stream(batches, k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
