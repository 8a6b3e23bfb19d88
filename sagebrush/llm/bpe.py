"""Byte-level BPE with the tokenizers library: encoding, offsets and decoding over Arrow batches.

A rank file lists byte strings in the order of their merges. The library's BPE model works on text, so each byte
stands for one printable character (the byte table); the model's vocabulary is the rank file written in those
characters. Every split of a token into two tokens is one of its merges, in the order of ranks.

A rank-driven merge always joins the neighbours that make the token of the lowest rank, the leftmost of several. The
library does so too, but if one token can be made at several places from different halves, it takes the halves that
its list of merges names first, wherever they stand. That changes the outcome only if the two places overlap, or if
one of the joins makes a pair of a lower rank possible. Pieces in which that can happen hold one of a fixed set of byte
strings; an automaton finds them, and they are merged by rank here. All others go to the library.

Texts are split by the pattern first, and each piece is encoded by itself. Where engines of regular expressions disagree
on what is a letter, a number or a space, the split is that of rank-driven encoders. A worker keeps the ids of pieces it has
seen, up to a bound; one call of the library encodes all new pieces of a text, as one string in which a token that
nothing else makes stands between them. Ids are kept as arrays, and what they stand for is taken from Arrow tables.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from functools import cached_property, lru_cache
from itertools import accumulate, batched, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Marks strings that make a piece doubtful wherever they stand; others are marked by their rank.
ONCE = -1
#: Pieces of a generation. A worker remembers two: when one is full, the one before it goes, but for what is used again.
CACHE_PIECES = 150_000
#: Pieces that one call of the library encodes at most.
CALL_PIECES = 10_000
#: Bytes of text whose tokens are in memory at once.
SLICE_BYTES = 1_000_000


def byte_table() -> list[str]:
    """The printable character of each byte: itself where Latin-1 prints it, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in prints}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one rank file. ``path`` must be readable on every executor."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        chars = byte_table()
        self.table = str.maketrans({c: chr(b) for b, c in enumerate(chars)})
        spell = lambda b: "".join([chars[x] for x in b])
        self.ranks = ranks
        splits = {t: [i for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks] for t in sorted(ranks, key=ranks.__getitem__)}
        merges = [(spell(t[:i]), spell(t[i:])) for t, at in splits.items() for i in at]
        self.doubtful = doubtful_strings(ranks, splits)
        # What stands between pieces: a byte that UTF-8 never has, a character that the byte table lacks, a token of its own.
        self.between = max(ranks.values()) + 1
        self.chars = np.array([ord(c) for c in chars[:0xFF]] + [ord(" ")], "<u2")
        # Spark runs a worker for each core, so the library needs no threads; its own cache would only keep what ours has.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabulary = {spell(b): r for b, r in ranks.items()} | {" ": self.between}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split(" ", "isolated")
        self.pattern = pattern
        self.findall = regex.compile(pattern).findall
        self.fast_findall = fast_findall(pattern)
        self.n_bytes = np.zeros(self.between, np.int64)
        self.n_bytes[list(ranks.values())] = [len(b) for b in ranks]
        # Decoding reverses the byte table: a token's characters back to the bytes they stand for.
        bytes_of = {r: self.tokenizer.id_to_token(r).translate(self.table).encode("latin-1") for r in ranks.values()}
        self.bytes_of = pa.array(map(bytes_of.get, range(self.between)), pa.large_binary())
        self.decimals = pa.array([b"%d," % r for r in range(self.between)], pa.large_binary())
        self.ids_of: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def may_differ(self) -> Callable[[str], re.Match | None]:
        """Finds a character from the first one on that needs a stand-in; most texts have none."""
        return re.compile(f"[{chr(min(stand_ins(), default=0x10FFFF))}-\U0010ffff]").search

    def split(self, text: str) -> list[str]:
        """The pieces of a text, which together are the text."""
        if self.fast_findall and (text.isascii() or not beyond_bmp(text)):
            return self.fast_findall(text)
        if text.isascii() or not self.may_differ(text):
            return self.findall(text)
        ends = [0, *accumulate(map(len, self.findall(text.translate(stand_ins()))))]
        return [text[a:b] for a, b in pairwise(ends)]

    def is_doubtful(self, piece: str) -> bool:
        """Whether the library's order of merges may matter in a piece."""
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        if len(raw) < 3 or self.doubtful is None:
            return False
        hits = [hit for _, hit in self.doubtful.iter(raw)]
        return (ONCE in hits or len(hits) > len(set(hits))) and piece.encode() not in self.ranks

    def by_library(self, pieces: Iterable[bytes]) -> Iterable[bytes]:
        """The ids of each piece, as the bytes of an array, by one call of the library."""
        spelled = self.chars[np.frombuffer(b"\xff".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
        (found,) = self.tokenizer.encode_batch_fast([spelled], add_special_tokens=False)
        ids = np.array(found.ids, np.int32)
        raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.between)).tolist()
        return map(raw.__getitem__, map(slice, [0, *(e + 4 for e in ends)], [*ends, len(raw)]))

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of all pieces, as the bytes of an array, into the cache."""
        new = pieces.difference(self.ids_of)
        if not new:
            return
        if len(self.ids_of) + len(new) > CACHE_PIECES:
            self.older, self.ids_of = self.ids_of, {}
            new = pieces
        again = self.older.keys() & new
        self.ids_of.update((p, self.older[p]) for p in again)
        rest = []
        for piece in new - again:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.ids_of[piece] = rank.to_bytes(4, sys.byteorder)
            elif self.is_doubtful(piece):
                self.ids_of[piece] = array("i", merged_by_rank(raw, self.ranks)).tobytes()
            else:
                rest.append((piece, raw))
        for some in batched(rest, CALL_PIECES):
            names, raws = zip(*some, strict=True)
            self.ids_of.update(zip(names, self.by_library(raws), strict=True))

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, every piece by itself, no special tokens."""
        pieces = self.split(text)
        self.learn(set(pieces))
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, pieces)), np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as lists."""
        return [self.ids(text).tolist() for text in texts]

    def spans(self, text: str, ids: np.ndarray | list[int]) -> np.ndarray:
        """Start and end of each token in characters of ``text``, as two columns.

        A token that begins or ends inside a character counts from the start, or to the end, of that character, so
        the tokens of a split character overlap in it.
        """
        ends = np.cumsum(self.n_bytes[ids]) if len(ids) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ids) else ends
        if text.isascii():
            return np.column_stack([starts, ends])
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        return np.column_stack([char_of_byte[starts], char_of_byte[ends - 1] + 1])

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes that the ids stand for; characters split over tokens come together again as bytes."""
        return told(self.bytes_of, ids)

    def decimal(self, ids: np.ndarray | list[int]) -> bytes:
        """The decimal ids, joined by commas."""
        return told(self.decimals, ids)[:-1]


def told(entries: pa.Array, ids: np.ndarray | list[int]) -> bytes:
    """The entries of a table of bytes that the ids name, one after the other."""
    if not len(ids):
        return b""
    _, offsets, raw = entries.take(pa.array(ids, pa.int32())).buffers()
    return raw.slice(0, np.frombuffer(offsets, np.int64)[len(ids)]).to_pybytes()


#: Finds a character that takes more than two bytes in UTF-16.
beyond_bmp = re.compile("[\U00010000-\U0010ffff]").search

#: For each class of characters that the pattern tells apart, one that all engines put in it and no contraction holds.
STAND_INS = {r"\p{L}": "a", r"\p{N}": "0", r"\s": "\t", "": "!"}


def their_class(name: str, every: str) -> str:
    """The characters of ``every`` that the engine of rank-driven encoders puts in a class.

    They are read off by encoding all of them, byte by byte, with the class as the pattern: what doesn't match is left
    out.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    ids = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
    return bytes(ids).decode()


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Code points that the engine of rank-driven encoders puts in another class than ours, with a stand-in of that class.

    Engines follow different editions of Unicode.
    """
    import regex

    every = "".join(map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000))))
    theirs, ours = {}, {}
    for name in filter(None, STAND_INS):
        theirs.update(dict.fromkeys(their_class(name, every), name))
        ours.update(dict.fromkeys(regex.findall(name, every), name))
    return {ord(c): STAND_INS[theirs.get(c, "")] for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


@lru_cache(maxsize=4)
def fast_findall(pattern: str) -> Callable[[str], list[str]] | None:
    r"""``findall`` of a pattern by the standard library's engine, for texts without characters beyond U+FFFF.

    It is faster, but lacks \p{L} and \p{N}, and its \s is another one. So these are spelled out, as rank-driven
    encoders have them. None for a pattern that holds other escapes, flags or groups that capture.
    """
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    if re.search(r"\((?!\?[!=:])", pattern):
        return None
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\.|\[\^?|\])", pattern):
        if part.startswith("["):
            if inside:
                return None
            inside = True
        elif part == "]":
            inside = False
        elif part in (r"\p{L}", r"\p{N}", r"\s", r"\S") and not (inside and part == r"\S"):
            points = sorted(map(ord, their_class(part.lower() if part == r"\S" else part, every)))
            gaps = [i for i in range(1, len(points)) if points[i] > points[i - 1] + 1]
            ranges = "".join(f"\\u{points[a]:04x}-\\u{points[b - 1]:04x}" for a, b in pairwise([0, *gaps, len(points)]))
            part = ranges if inside else f"[^{ranges}]" if part == r"\S" else f"[{ranges}]"
        elif part.startswith("\\") and part[1:].isalnum() and part[1:] not in "rnt":
            return None
        out.append(part)
    return re.compile("".join(out)).findall


def doubtful_strings(ranks: dict[bytes, int], splits: dict[bytes, list[int]]):
    """An automaton of the strings (bytes as Latin-1) that make a piece doubtful: ``ONCE``, or if they stand in it twice."""
    import ahocorasick

    below = {part for t, at in splits.items() for i in at for part in (t[:i], t[i:]) if ranks[part] > ranks[t]}
    found = ahocorasick.Automaton()
    for token, at in splits.items():
        n = len(token)
        # Both places of an overlap: the token, and once more from where its own beginning ends it.
        for b in at:
            if n - b in at and token[:b] == token[n - b :]:
                found.add_word((token + token[b:]).decode("latin-1"), ONCE)
        if len(at) > 1 and token in below and token.decode("latin-1") not in found:
            found.add_word(token.decode("latin-1"), ranks[token])
    if not len(found):
        return None
    found.make_automaton()
    return found


def merged_by_rank(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the neighbours that make the token of the lowest rank are joined, the leftmost first."""
    if raw in ranks:
        return [ranks[raw]]
    end = list(range(1, len(raw) + 1))
    before = list(range(-1, len(raw) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and end[i] < len(raw) and (rank := ranks.get(raw[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (rank, i, end[end[i]]))

    for i in range(len(raw) - 1):
        offer(i)
    while heap:
        _, i, upto = heapq.heappop(heap)
        # Parts that were joined meanwhile have no end, or another one.
        if not end[i] or end[i] >= len(raw) or end[end[i]] != upto:
            continue
        gone = end[i]
        end[i], end[gone] = upto, 0
        if upto < len(raw):
            before[upto] = i
        offer(i)
        offer(before[i])
    ids, i = [], 0
    while i < len(raw):
        ids.append(ranks[raw[i : end[i]]])
        i = end[i]
    return ids


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of a rank file, built once in each Python worker."""
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, with_tokens: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return one row for each row of ``docs``.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded
    bytes), round_trip (the decoded bytes are the text's); ``with_tokens`` adds ids, starts and ends (character
    offsets of each token, see :meth:`ByteBpe.spans`).

    Null texts count as empty: no tokens, and hashes of the empty string. Rows with null or repeated ids are kept
    as they are, each by itself. Other columns of ``docs`` are not read. No rows give no rows. No shuffle: a text is
    one row of one task, and memory holds one slice of texts, one text's ids and the bounded piece cache.
    """

    def rows(ids: list, texts: list[str]) -> list:
        bpe = coder(path, pattern)
        n, ids_sha, raw_sha, same, spans = [], [], [], [], []
        tokens = array("i")
        for text in texts:
            found = bpe.ids(text)
            raw = bpe.decode(found)
            n.append(len(found))
            ids_sha.append(hashlib.sha256(bpe.decimal(found)).hexdigest())
            raw_sha.append(hashlib.sha256(raw).hexdigest())
            same.append(raw == text.encode())
            if with_tokens:
                tokens.frombytes(found.tobytes())
                spans.append(bpe.spans(text, found).astype(np.int32))
        columns = [pa.array(ids, pa.int64()), n, ids_sha, raw_sha, same]
        if with_tokens:
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)
            columns += [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x))) for x in (np.frombuffer(tokens, np.int32) if tokens else flat[:, 0], flat[:, 0], flat[:, 1])]
        return columns

    extra = ", ids array<int>, starts array<int>, ends array<int>" if with_tokens else ""
    return map_texts(docs, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + extra, slice_bytes=SLICE_BYTES)
