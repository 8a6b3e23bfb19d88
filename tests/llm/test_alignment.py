"""Alignment of two tokenizers against overlaps that are found pair by pair."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sagebrush.llm import alignment
from sagebrush.llm.queries import QUERIES, VOCABULARY_A, VOCABULARY_B

PATHS = public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)


def spelled_tokens(text: str | None) -> tuple[list, list]:
    """(id, bytes) of both tokenizers; none if a text isn't spelled byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    if not hasattr(spelled_tokens, "both"):
        a = Tokenizer.from_file(PATHS[0])
        a.encode_special_tokens = True
        spelled_tokens.both = a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a, b = spelled_tokens.both
    if not text:
        return [], []
    chars = {c: i for i, c in enumerate(alignment.byte_table())}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a"
    left = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else ([], [])


def plain(texts: list) -> list:
    """The result's columns but doc_id, for each text."""
    every, rows = Counter(), []
    for text in texts:
        sides = []
        for side in spelled_tokens(text):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            sides.append([(i, e - len(x), e) for (i, x), e in zip(side, ends, strict=True)])
        a, b = sides
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ["|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in sides) for low, high in zip([0, *cuts], cuts, strict=False)]
        every.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = Counter()
    for (_, j), n in every.items():
        most[j] = max(most[j], n)
    return [(a, b, g, len(x), sum(every[p] == most[p[1]] for p in x), sum(every[p] for p in x), h) for a, b, g, x, h in rows]


def texts() -> list:
    rng = random.Random(8)
    parts = ["the", " of", "naïve", " 漢字", "🎉", "\n\n", "  ", "<s>", "<|endoftext|>", "<0x0A>", "</s>", "don't", "12345", "\t", "\x00", "é", "é", "é", " unbelievable", "ﬁ", "​", "aaaaaaaaaa", ".", "Straße"]
    made = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(150)]
    return [None, "", " ", "a▁b", "▁", "word", "word", " lead", "trail ", *made]


@pytest.fixture(scope="module")
def wanted():
    return plain([*texts(), "word", None])


def test_by_overlaps(spark, wanted):
    rows = [(i, t) for i, t in enumerate(texts())] + [(5, "word"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk int, count string").repartition(5)
    found = alignment.align(docs, *PATHS).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found) == sorted((key(i), *w) for (i, _), w in zip(rows, wanted, strict=True))
    assert sum(w[0] == 0 for w in wanted) >= 5 and any(w[2] < min(w[0], w[1]) for w in wanted)
    assert alignment.align(docs.limit(0), *PATHS).count() == 0


def test_long_texts_in_parts(monkeypatch):
    """Cut at spaces between letters, a text has the ids, links and groups of the whole."""
    rng = random.Random(9)
    words = ["the", "unbelievable", "naïve", "x", "it's", "漢字", "2024", "end.", "Straße", "a"]
    long = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", " \n"]) for _ in range(3000))
    own = alignment.aligner(*PATHS)
    whole = alignment.chunk_of([1, 2], [long, "short text"], own)
    monkeypatch.setattr(alignment, "PART_CHARS", 50)
    monkeypatch.setattr(alignment, "ENCODED_BYTES", 300)
    cut = alignment.chunk_of([1, 2], [long, "short text"], own)
    assert len(list(alignment.parts(long))) > 100
    for k in range(1, 8):
        assert all(np.array_equal(x, y) for x, y in zip(whole[k], cut[k], strict=True))


def test_vocabularies_cut_at_spaces():
    """No piece of B holds a space after another character, so a space before a word always begins a token."""
    own = alignment.aligner(*PATHS)
    assert not [p for p in own.bytes_b if b" " in p.lstrip(b" ")]
    ids, pieces, good = next(own.encoded(["<s> a"]))
    assert good and own.a.id_to_token(ids[0]) and len(pieces) > 2


def test_query(spark, sf):
    import pandas as pd

    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    short = docs[docs.text.fillna("").str.len() < 100_000]
    assert len(short) == len(docs)
    found = QUERIES["op13_tokenizer_alignment"](spark, sf).toPandas().sort_values("doc_id")
    few = [spelled_tokens(t) for t in docs.text]
    assert list(found.n_a) == [len(a) for a, _ in few] and list(found.n_b) == [len(b) for _, b in few]
    own, every = alignment.aligner(*PATHS), Counter()
    links = []
    for a, b in few:
        links.append(own.linked([i for i, _ in a], [i for i, _ in b])[0].tolist() if a else [])
        every.update(links[-1])
    assert list(found.count_sum) == [sum(every[p] for p in x) for x in links]
