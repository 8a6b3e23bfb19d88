"""How the byte-level BPE remembers, splits and tells pieces."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest

from sagebrush.llm import bpe
from sagebrush.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    ranks = bpe.coder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_in_use_are_learned_once(monkeypatch, theirs):
    """Pieces that every text holds stay known, however many others come and go; ids stay tiktoken's."""
    monkeypatch.setattr(bpe, "CACHE_PIECES", 400)
    own = bpe.ByteBpe(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    judged, is_doubtful = Counter(), own.is_doubtful
    monkeypatch.setattr(own, "is_doubtful", lambda piece: judged.update([piece]) or is_doubtful(piece))
    rng = random.Random(3)
    word = lambda: " " + "".join(rng.choices("bcdfghjkqxzé", k=9))
    common = [word() for _ in range(100)]
    for _ in range(60):
        text = "".join(common + [word() for _ in range(60)])
        assert own.encode([text])[0] == theirs.encode_ordinary(text)
    assert {judged[piece] for piece in common} == {1}


@pytest.mark.parametrize("at_once", [1, 7, 10_000])
def test_pieces_by_calls_of_any_size(monkeypatch, theirs, at_once):
    monkeypatch.setattr(bpe, "CALL_PIECES", at_once)
    own = bpe.ByteBpe(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(20):
        text = "".join(rng.choice(["ÿ", " ", " ", "\0", "\n", "😀", "zq", "ħ", "Ġ", "\xa0", "x" * 40]) * rng.randint(1, 3) for _ in range(300))
        ids = own.ids(text)
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert own.decode(ids) == text.encode() and own.decimal(ids) == ",".join(map(str, ids.tolist())).encode()
    assert own.ids("").tolist() == [] and own.decode([]) == own.decimal([]) == b""


def test_fast_split():
    """The faster engine splits as the other one with stand-ins does; patterns that it may read differently are left to that."""
    own = bpe.coder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    slow = bpe.ByteBpe(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    slow.fast_findall = None
    rng = random.Random(6)
    for i in range(3000):
        top = (0x7F, 0x24F, 0xD7FF, 0x1FFFF)[i % 4]
        points = [rng.choice([rng.randint(0, top), *b" 'a1!\n\t\x1c"]) for _ in range(30)]
        text = "".join(chr(p) for p in points if not 0xD800 <= p < 0xE000)
        assert own.split(text) == slow.split(text)
    assert own.fast_findall
    for pattern in (r"(?i)a|\s", r"(a)|b", r"\w+", r"\p{Lu}+|.", r"[^\S\n]+|\S", r"[[:alpha:]]+|."):
        assert bpe.fast_findall(pattern) is None
