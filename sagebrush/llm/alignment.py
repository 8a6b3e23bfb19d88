"""Alignment of two tokenizers by byte-owner arrays.

Both token sequences of a text are spelled in bytes; repeating each token's index over its bytes tells, for either
tokenizer, which token owns a byte. Where neighbouring bytes have another pair of owners, a new link (an overlap of two
tokens) begins; where both owners change at once, both tokenizers cut, and a new group begins.

How often a pair of ids is linked is counted over the corpus. Texts are taken in chunks; a chunk writes its distinct
pairs once, and each of its texts refers to them by number. So what is shuffled is a chunk's pairs and not its links, a
pair that stands everywhere comes once a chunk, and the counts return to the chunks the same way.

Long texts are cut, before encoding, at single spaces between ASCII letters, where both tokenizers cut in any case.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_table
from .common import Scratch, map_texts

#: Characters after which a text is cut at the next good place, bytes of text that are encoded at once, and of a chunk.
PART_CHARS, ENCODED_BYTES, CHUNK_BYTES = 200_000, 500_000, 4_000_000
GOOD_CUT = re.compile(r"[A-Za-z] (?=[A-Za-z])")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: A pair of ids as one number: the first one's, then so many bits of the second's.
ID_BITS = 24
CHUNK = "chunk long, doc_id array<long>, sums array<long>, hashes array<string>, pairs array<long>, links array<long>, sizes array<int>, packed binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def parts(text: str) -> Iterator[str]:
    """The text, or, if it is long, pieces of it; between two of them one space is left out."""
    at = 0
    while len(text) - at > PART_CHARS and (hit := GOOD_CUT.search(text, at + PART_CHARS)):
        yield text[at : hit.start() + 1]
        at = hit.end()
    yield text[at:]


class Aligner:
    """Both tokenizers. The files must be readable on every executor."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        table = str.maketrans({c: chr(b) for b, c in enumerate(byte_table())})
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = entry.translate(table).encode("latin-1")
        self.bytes_b = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        # Decimal ids with what follows them in the spelling of groups: by (kind of mark, id).
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        self.spelled = [f"{i}{mark}" for mark in ",|;" for i in range(self.most)]

    def piece(self, i: int) -> bytes:
        entry = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(BYTE_PIECE.fullmatch(entry)[1], 16)])
        return entry.replace("▁", " ").encode()

    def encoded(self, some: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of both tokenizers for each text, and whether both spell a space and the text."""
        a = self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False)
        for text, found, b in zip(some, a, self.b.encode(some, num_threads=1), strict=True):
            ids, raw = found.ids, b" " + text.encode()
            yield ids, b, b"".join(map(self.bytes_a.__getitem__, ids)) == raw == b"".join(map(self.bytes_b.__getitem__, b))

    def linked(self, ids_a: list[int], ids_b: list[int]) -> tuple[np.ndarray, int, str]:
        """Links as pairs of ids in their order, the number of groups, and their spelling with a mark at its end."""
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        owner_a = np.repeat(np.arange(len(a), dtype=np.int32), self.size_a[a])
        owner_b = np.repeat(np.arange(len(b), dtype=np.int32), self.size_b[b])
        new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        first = np.flatnonzero(new_a | new_b)
        group = np.cumsum(new_a & new_b)
        # Tokens by group, those of A first; the last of either side in a group bears another mark than a comma.
        place = np.concatenate([2 * group[new_a], 2 * group[new_b] + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        mark = np.where(np.diff(place, append=-1) != 0, 1 + (place & 1), 0)
        text = "".join(map(self.spelled.__getitem__, (mark * self.most + np.concatenate([a, b])[order]).tolist()))
        return a[owner_a[first]] << ID_BITS | b[owner_b[first]], int(group[-1]), text


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The tokenizers, read once in each Python worker."""
    return Aligner(path_a, path_b)


def batches_of(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Parts of the texts with the texts' numbers, as many as are encoded at once."""
    batch, size = [], 0
    for i, text in enumerate(texts):
        for part in parts(text) if text else ():
            batch.append((i, part))
            size += len(part)
            if size >= ENCODED_BYTES:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def added(known: tuple[np.ndarray, np.ndarray] | None, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and how often they stand, those of ``known`` included."""
    distinct, counts = np.unique(pairs, return_counts=True)
    if known is None:
        return distinct, counts
    both, at = np.unique(np.concatenate([known[0], distinct]), return_inverse=True)
    return both, np.bincount(at, np.concatenate([known[1], counts])).astype(np.int64)


def chunk_of(ids: list, texts: list[str], own: Aligner) -> list:
    """One row of ``CHUNK``: sums of each text, its distinct pairs as numbers into the chunk's, and how often they stand."""
    n = len(texts)
    sums, bad = np.zeros((n, 4), np.int64), np.zeros(n, bool)
    hashes, held = [None] * n, [None] * n
    for batch in batches_of(texts):
        for (i, _), (a, b, good) in zip(batch, own.encoded([t for _, t in batch]), strict=True):
            bad[i] |= not good
            if bad[i]:
                continue
            pairs, groups, spelled = own.linked(a, b)
            sums[i] += len(a), len(b), groups, len(pairs)
            if hashes[i] is None:
                hashes[i] = hashlib.sha256()
            else:
                hashes[i].update(b";")
            hashes[i].update(spelled[:-1].encode())
            held[i] = added(held[i], pairs)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums[bad] = 0
    held = [none if h is None or x else h for h, x in zip(held, bad, strict=True)]
    hashes = ["" if h is None or x else h.hexdigest() for h, x in zip(hashes, bad, strict=True)]
    distinct, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    counts = np.concatenate([c for _, c in held])
    links = np.bincount(at, counts, len(distinct)).astype(np.int64) if len(at) else counts
    sizes = np.array([len(p) for p, _ in held], np.int32)
    return [[uuid.uuid4().int >> 65], [ids], [sums.ravel()], [hashes], [distinct], [links], [sizes], [packed(at, counts)]]


def packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    """Numbers of pairs, which rise within a text, as steps; and counts. Both small, so that they compress well."""
    raw = np.concatenate([np.diff(at, prepend=0), counts]).astype(np.int32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    both = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.int32) if size else np.zeros(0, np.int32)
    steps, counts = np.split(both, 2)
    return np.cumsum(steps, dtype=np.int64), counts.astype(np.int64)


def told(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """Rows of ``RESULT`` from a chunk and the corpus-wide counts of its pairs (slot, count, best)."""
    row = {c: chunk.column(c)[0] for c in chunk.column_names}
    ids, sizes = row["doc_id"].values, np.array(row["sizes"].values)
    at, counts = unpacked(row["packed"].as_py())
    slots = known.column("slot").to_numpy()
    count, best = np.zeros(len(slots), np.int64), np.zeros(len(slots), bool)
    count[slots], best[slots] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(sizes)), sizes)
    total, n_best = (np.zeros(len(sizes), np.int64) for _ in range(2))
    np.add.at(total, text, count[at] * counts)
    np.add.at(n_best, text, best[at] * counts)
    sums = np.array(row["sums"].values).reshape(-1, 4)
    columns = [ids, *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(4)), pa.array(n_best), pa.array(total), row["hashes"].values]
    return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each row of ``docs``, with the columns of ``RESULT``.

    A encodes a space and the text, B the text, to which it adds the space itself; neither adds special tokens, and the
    strings of special tokens are text. n_links counts the overlaps of tokens, n_best those whose pair of ids is B's
    most frequent one in the corpus (ties count), count_sum adds up how often the corpus holds each link's pair.
    groups_sha256 hashes the groups, spelled ``a1,a2|b1;a3|b2``.

    Null and empty texts, and those that either tokenizer doesn't spell byte by byte, have no tokens: zeros, and an
    empty groups_sha256. Null and repeated ids are kept, each row by itself, and count each. Other columns are not read.
    No rows give no rows. A task holds one chunk of texts, or one longer text's ids.
    """
    scratch = Scratch(docs.sparkSession, "alignment")

    def rows(ids: list, texts: list[str]) -> list:
        return chunk_of(ids, texts, aligner(path_a, path_b))

    chunks = scratch.keep(map_texts(docs, rows, CHUNK, slice_bytes=CHUNK_BYTES), "chunks")
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "links")).alias("slot", "p")).select("chunk", "slot", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    counts = scratch.keep(each.groupBy("pair").agg(F.sum("links").alias("count")), "counts")
    # One row for each id of B's vocabulary at most, whatever the corpus.
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    known = counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    # A pair stands once in a chunk, so no key of this join is hot; both sides grow, so it is always merged.
    back = each.select(F.col("chunk").alias("of"), "slot", "pair").join(known.hint("merge"), "pair").select("of", "slot", "count", "best")
    return chunks.drop("pairs", "links").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(told, RESULT)
