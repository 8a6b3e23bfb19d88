"""Null, empty and long texts, repeated rows, empty tables and extra columns: each operator has a defined result."""

from __future__ import annotations

import random
import time

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sagebrush.llm import bpe, decontamination, licenses, line_dedup, minhash, quality, secrets, token_counts, topk, toxicity
from sagebrush.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, label string, row int, n_lines string, key int, score string"
LINE = "a very long line that holds more than twenty words so that two of them make a passage of fifty words at least here number {}"
PASSAGE = "\n".join(LINE.format(x) for x in "abc")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [None, "", "   ", "one two", "one two", "é ü 漢字 🎉 token=abc123XYZ", PASSAGE, "own words first\n" + PASSAGE + "\nand last", LONG, "MIT License and the Apache License"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two"), (3, "one two"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "apache"), (4, LINE.format("b"))], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")


def operators(labels, items):
    path = public_tokenizers.path(VOCABULARY)
    return {
        "near": minhash.near_duplicates,
        "quality": lambda d: quality.classify(d, labels),
        "good": lambda d: quality.only_good(d, labels),
        "bpe": lambda d: bpe.encode_decode(d, path, public_tokenizers.PATTERN, with_tokens=True),
        "leaks": lambda d: decontamination.matches(d, items),
        "clean": lambda d: decontamination.without_leaks(d, items),
        "licenses": licenses.scan,
        "tokens": lambda d: token_counts.section_token_counts(d, path, public_tokenizers.PATTERN),
        "lines": line_dedup.without_repeats,
        "secrets": secrets.scan,
        "toxic": lambda d: toxicity.classify(d, labels),
    }


EVERY_ROW = ["near", "quality", "bpe", "licenses", "lines", "secrets", "toxic"]


@pytest.mark.parametrize("name", EVERY_ROW)
def test_every_row_stays(docs, labels, items, name):
    found = operators(labels, items)[name](docs).toPandas()
    assert sorted(found.doc_id.dropna()) == sorted(i for i, _ in ROWS if i is not None)
    assert found.doc_id.isna().sum() == 2


@pytest.mark.parametrize("name", [*EVERY_ROW, "good", "leaks", "clean", "tokens"])
def test_no_rows(docs, labels, items, name):
    assert operators(labels, items)[name](docs.limit(0)).count() == 0


def test_near(docs):
    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert [found[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1]
    assert found[4].component_id == 3 and not found[4].kept
    assert all(found[i].component_id == i and found[i].kept for i in (0, 1, 2, 3, 5))
    assert found[8].n_shingles == len(brute.shingles(LONG))


def test_near_finds_links_a_star_misses(spark):
    """A chain of texts, each linked with the next only, and many that share a passage without a link."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 80])) for i in range(8)]
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [(100 + i, shared + " " + " ".join(f"own{i}x{j}" for j in range(40 + i))) for i in range(60)]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.components(dict(rows))


def test_passages_go_once(docs):
    found = {r.doc_id: r for r in line_dedup.without_repeats(docs).collect() if r.doc_id not in (None, 3)}
    assert found[6].text == PASSAGE and found[6].n_deleted == 0
    assert found[7].text == "own words first\nand last" and found[7].n_deleted == 3
    assert found[0].text is None and found[0].n_lines == 0


def test_leaks(docs, items):
    found = sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.matches(docs, items).collect() if r.doc_id is not None)
    assert (3, 1, 0) in found and (4, 1, 0) in found and (7, 4, 0) in found
    assert all(i in (1, 4) for _, i, _ in found)
    assert {r.doc_id for r in decontamination.without_leaks(docs, items).collect()} == {None, 0, 1, 2, 5, 8, 9}
    assert decontamination.without_leaks(docs, items).columns == docs.columns


def test_leaks_by_brute_force(spark, monkeypatch):
    """Edits and places of planted, edited items against whole matrices; with the items in one block and in many."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdef", k=rng.randrange(1, 8))) for _ in range(60)]
    phrase = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = {i: phrase(n) for i, n in enumerate([2, 2, 4, 8, 12, 20, 30])} | {7: "One, TWO!"}
    texts = ["stone twofold", "say one  two again", "one two", "stone two", ""]
    for _ in range(60):
        t = list(rng.choice([items[i] for i in range(7)]))
        for _ in range(rng.randrange(0, 1 + len(t) // 10)):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([0, 1])] = rng.choice(["", "a", " ", "xy"])
        texts.append(f"{phrase(rng.randrange(0, 12))} {''.join(t).title()}, {phrase(rng.randrange(0, 12))}")
    wanted = {}
    for d, t in enumerate(texts):
        for i, item in items.items():
            plain = decontamination.normal(item)
            edits = brute.edit_distance_within(f" {plain} ", f" {decontamination.normal(t)} ")
            if edits <= len(plain) // decontamination.CHARS_PER_EDIT:
                wanted[d, i] = edits
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for size in (decontamination.BLOCK_CHARS, 200):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        found = {(r.doc_id, r.item_id): r for r in decontamination.matches(docs, queries).collect()}
        assert {k: r.edits for k, r in found.items()} == wanted
        for (d, i), r in found.items():
            here = decontamination.normal(texts[d][r.start : r.end])
            assert brute.edit_distance_within(f" {decontamination.normal(items[i])} ", f" {here} ") == r.edits
        assert {r.doc_id for r in decontamination.without_leaks(docs, queries).collect()} == set(range(len(texts))) - {d for d, _ in wanted}
    assert (0, 7) not in wanted and (1, 7) in wanted and len(wanted) > 30


def test_offsets_and_tokens(docs):
    path = public_tokenizers.path(VOCABULARY)
    for r in bpe.encode_decode(docs.filter("doc_id != 8"), path, public_tokenizers.PATTERN, with_tokens=True).collect():
        assert r.round_trip and len(r.ids) == r.n_tokens == len(r.starts) == len(r.ends)
        if r.ids and r.doc_id is not None:
            assert r.starts[0] == 0 and r.ends[-1] == len(TEXTS[r.doc_id])


def test_secrets(spark):
    key = "kX9qLm2Zp7Rt4Wv8Yb1Nc6"
    rows = [(0, f"key {key} end"), (1, "zzzzzzzzzzzzzzzzzzzzzzzz1111"), (2, "🎉 Secret: 'abcdef' AKIA" + "A1" * 8), (3, "123e4567-e89b-12d3-a456-426614174000")]
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].spans == f"entropy:4:{4 + len(key)}"
    assert found[1].spans == "" and found[3].spans == ""
    assert found[2].spans == brute.secrets(rows[2][1])[-1] and found[2].n_assign == 1 and found[2].n_access == 1


def test_entropy_of_long_candidates(spark):
    """Time grows with a candidate's length, not with its square, and every window counts."""
    rng = random.Random(1)
    dull = "ab1" * 200
    key = "".join(rng.choices(secrets.ALPHABET[:62], k=24))
    long = "".join(rng.choices("abcdefgh12345678", k=100_000))
    texts = [dull, dull + key + dull, key[:19], key[:20], long, "x " * 5000 + key, "f0" * 60, "deadbeef01234c5678a9" * 2, "é" * 30 + key]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    df.count()
    began = time.perf_counter()
    found = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert time.perf_counter() - began < 15
    for i, text in enumerate(texts):
        wanted = brute.random_spans(text, secrets.WINDOW, secrets.THRESHOLDS, secrets.ALLOWED)
        base = brute.secrets(text)[-1]
        spans = [s for s in found[i].split(",") if s.startswith("entropy")]
        assert spans == [f"entropy:{s}:{e}" for s, e in wanted if f"hex:{s}:{e}" not in base]


def test_topk(spark):
    # Row 1 stands twice, with other components; so does query 50, whose rows are candidates of each other.
    rows = [(0, [0.5, 0.5]), (50, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (1, [2.0, 2.0]), (50, [1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.select("*", *(F.lit("x").alias(c) for c in ("score", "row", "block", "size", "asks", "vector", "rank")))
    found = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k=5).collect())
    fine = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)]
    wanted = []
    for q, (i, v) in enumerate(fine):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for c, (j, w) in enumerate(fine) if c != q and len(w) == len(v))
            wanted += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:5], 1)]
    assert found == sorted(wanted)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_licenses_with_a_word_dropped(spark):
    template = next(iter(licenses.TEMPLATES)).split()
    rows = [(0, " ".join(template[:9] + template[10:])), (1, "under the MIT\nLicense, or CC BY")]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].labels == "bsd" and found[0].base_labels == "" and found[0].score >= 0.9
    assert found[1].base_labels == "cc-by,mit" and (found[1].first_word, found[1].last_word) == (2, 5)


def test_license_templates_by_brute_force(spark, monkeypatch):
    """Labels and score of generated texts, with templates in one block and in many, and of repeated rows."""
    rng = random.Random(3)
    templates = [t.split() for t in licenses.TEMPLATES]
    phrases = [t.split() for t in licenses.PHRASES]
    texts = []
    for _ in range(150):
        out = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(templates + phrases + [["plain", "words", "of", "a", "text"]]))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(part) + 1)
                part[at : at + rng.choice([0, 1])] = [rng.choice(["other", "word", *part[:1]])] if rng.random() < 0.5 else []
            out += part + ["between"] * rng.randrange(0, 4)
        texts.append(" ".join(w.title() if rng.random() < 0.2 else w for w in out))
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[4]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted((-1 if i is None else i, *brute.license_labels(t, licenses.PHRASES, licenses.TEMPLATES, licenses.COVERAGE, licenses.DRIFT)) for i, t in rows)
    for size in (licenses.BLOCK_PAIRS, 40):
        monkeypatch.setattr(licenses, "BLOCK_PAIRS", size)
        found = licenses.scan(df).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.labels, round(r.score, 9)) for r in found) == wanted
    assert len({labels for _, labels, _ in wanted}) > 10


def test_passages_inside_lines_go(spark):
    """A passage of 50 words that begins and ends inside lines, over one, two and three lines."""
    passage = [f"p{i}" for i in range(50)]
    own = lambda d, part: " ".join(f"own{d}{part}{i}" for i in range(30))
    rows = [(0, f"{own(0, 'a')} {' '.join(passage)} {own(0, 'b')}")]
    rows += [(k, f"{own(k, 'a')} " + "\n".join(" ".join(passage[50 * i // k : 50 * (i + 1) // k]) for i in range(k)) + f" {own(k, 'b')}") for k in (1, 2, 3)]
    rows += [(4, f"{own(4, 'a')} {' '.join(passage[:49])} {own(4, 'b')}")]
    found = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), inside_lines=True).collect()}
    assert found[0] == (rows[0][1], 1, 0) and found[4] == (rows[4][1], 1, 0)
    assert found[1] == (f"{own(1, 'a')} {own(1, 'b')}", 1, 0)
    assert found[2] == (f"{own(2, 'a')}\n{own(2, 'b')}", 2, 0)
    assert found[3] == (f"{own(3, 'a')}\n{own(3, 'b')}", 3, 1)
    found = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.without_repeats(spark.createDataFrame(rows + [(5, rows[3][1])], "doc_id long, text string").filter("doc_id in (3, 5) or doc_id = 1")).collect()}
    assert found[1] == (rows[1][1], 0) and found[5] == ("", 3)


def test_whole_lines_of_a_passage_go(spark):
    """Of a passage of 50 words that begins and ends inside lines, the whole lines go, few as their words are."""
    lines = [" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 20), ("b", 10), ("c", 20))]
    rows = [(d, f"own{d} {lines[0]}\n{lines[1]}\n{lines[2]} end{d}") for d in range(2)]
    found = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: (rows[0][1], 0), 1: (f"own1 {lines[0]}\n{lines[2]} end1", 1)}


def test_good_without_labels_keeps_all(docs, labels):
    for none in (labels.limit(0), labels.filter("quality is null")):
        assert quality.only_good(docs, none).count() == len(ROWS)


def test_topk_in_several_blocks(spark, monkeypatch):
    """Blocks of few rows, batches of few queries, ties and repeated rows give the same ranks as sorting all scores."""
    import numpy as np

    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-6, 7, (500, 12)) / 4
    ids = [int(x) for x in rng.integers(0, 300, 500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k=5).collect())
    ints = np.floor(256 * vectors).astype(int)
    wanted = []
    for q in (q for q in range(500) if ids[q] % 50 == 0):
        scores = sorted((-int(ints[q] @ ints[c]), ids[c]) for c in range(500) if c != q)
        wanted += [(ids[q], rank, j, -s) for rank, (s, j) in enumerate(scores[:5], 1)]
    assert found == sorted(wanted)


def test_runs_that_share_fingerprints_with_other_places(spark):
    """Each repeated window goes, though its fingerprints stand earlier in other surroundings; in one text, too."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    parts = [words(n) for n in (26, 30, 26, 50, 49, 51, 75)]
    x, g, y = parts[:3]
    texts = ["\n".join(" ".join(p) for p in t) for t in ([g, words(26)], [x, g, y], [g, y], [x, g, y], [x, g])]
    for i in range(60):
        chosen = [rng.choice(parts) if rng.random() < 0.7 else words(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 9))]
        flat = [w for p in chosen for w in p]
        texts.append("".join(w + rng.choice("   \n") for w in flat))
    texts += [texts[9], " ".join(["same"] * 140), "\n".join(["a line of five words"] * 60)]
    rows = dict(enumerate(texts))
    df = spark.createDataFrame([*rows.items()], "doc_id long, text string")
    found = {r.doc_id: r.text.split() for r in line_dedup.without_repeats(df, inside_lines=True).collect()}
    assert found == brute.words_once(rows)
    assert found[3] == [] and found[1] == x + g + y


def test_long_text_of_many_lines(spark):
    """20,000 lines, each standing twice in one text and once more in another."""
    lines = [f"line number {i} of a text that has very many of them" for i in range(10_000)]
    text = "\n".join(lines + lines)
    found = {r.doc_id: r for r in line_dedup.without_repeats(spark.createDataFrame([(0, text), (1, "\n".join(lines))], "doc_id long, text string")).collect()}
    assert found[0].text == "\n".join(lines) and found[0].n_deleted == 10_000
    assert found[1].text == "" and found[1].n_deleted == 10_000


def test_told_sections(spark):
    path = public_tokenizers.path(VOCABULARY)
    rows = [(0, "one two three", [0, 4, 6, 99]), (1, "naïve été", None), (2, "", [0, 3]), (3, None, [1])]
    found = token_counts.section_token_counts(spark.createDataFrame(rows, "doc_id long, text string, at array<int>"), path, public_tokenizers.PATTERN, "at").collect()
    spans = sorted((r.doc_id, r.section, r.char_start, r.char_end) for r in found)
    assert spans == [(0, 0, 0, 4), (0, 1, 4, 6), (0, 2, 6, 13), (1, 0, 0, 9), (2, 0, 0, 0), (3, 0, 0, 0)]
    own = bpe.coder(path, public_tokenizers.PATTERN)
    for i, text, _ in rows[:2]:
        assert sum(r.n_tokens for r in found if r.doc_id == i) == len(own.encode([text])[0])
    assert sum(r.n_crossing for r in found) >= 1


@pytest.mark.parametrize("parts", [1, 8])
def test_lines_of_short_texts_only(spark, parts):
    """Texts that are all shorter than a passage, one of them or thousands in a batch, have nothing to delete."""
    rows = [(i, f"six words are in text {i % 7}") for i in range(400)]
    found = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), inside_lines=True).collect()
    assert sorted((r.doc_id, r.text, r.n_deleted) for r in found) == [(i, t, 0) for i, t in rows]
    # A slice in which short texts stand beside a long one, before and after it.
    long = " ".join(f"w{i}" for i in range(60))
    mixed = [(i, long if i in (200, 300) else f"text {i}") for i in range(400)]
    found = line_dedup.without_repeats(spark.createDataFrame(mixed, "doc_id long, text string").repartition(parts), inside_lines=True).collect()
    assert {r.doc_id: r.text for r in found} == dict(mixed) | {300: ""}


def test_lines_with_clashing_columns(spark):
    names = ["_runs", "_own_doc_id", "_run_doc_id", "runs", "row", "left", "text_a", "text_b", "n_words_deleted", "a.b"]
    df = spark.createDataFrame([(i, PASSAGE, *range(len(names))) for i in range(2)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    found = {r.doc_id: r for r in line_dedup.without_repeats(df).collect()}
    assert (found[0].text, found[1].text) == (PASSAGE, "")
    assert all(found[1][n] == i for i, n in enumerate(names) if n != "n_words_deleted") and found[1].n_words_deleted == len(PASSAGE.split())


def test_many_secrets_in_one_text(spark):
    """200,000 matches in one text take time in proportion; spans are those of brute force."""
    key = "kX9qLm2Zp7Rt4Wv8Yb1Nc6"
    some = [f"token={'x' * (6 + i % 3)}{i} {'0123456789abcdef' * 2} {key}{i} AKIA{'A1' * 8} password: {key}" for i in range(40_000)]
    df = spark.createDataFrame([(0, " ".join(some)), (1, " ".join(some[:200]))], "doc_id long, text string").cache()
    df.count()
    began = time.perf_counter()
    found = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert time.perf_counter() - began < 60
    assert found[0].n_assign == 80_000 and found[0].n_access == 40_000 and found[0].n_hex == 40_000
    *counts, spans = brute.secrets(" ".join(some[:200]))
    base = {(int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(","))}
    random = [(s, e) for s, e in brute.random_spans(" ".join(some[:200]), secrets.WINDOW, secrets.THRESHOLDS, secrets.ALLOWED) if not any(a <= s and e <= b for a, b in base)]
    assert (found[1].n_assign, found[1].n_access, found[1].n_hex, found[1].base_sha256) == tuple(counts)
    assert sorted((int(s), int(e)) for k, s, e in (x.split(":") for x in found[1].spans.split(",")) if k == "entropy") == random and random


def test_good_with_labels_of_one_class(docs, labels):
    for only in (0, 1):
        assert quality.only_good(docs, labels.filter(f"quality = {only}")).count() == len(ROWS)


def test_bpe_splits_every_code_point(spark):
    """Every code point beside a letter, a digit and a sign gives tiktoken's ids; so do pairs of unusual letters."""
    import tiktoken

    own = bpe.coder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    points = [*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE0200), *range(0x34000, 0x110000, 997)]
    for k in range(0, len(points), 512):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in map(chr, points[k : k + 512]))
        assert own.encode([text])[0] == theirs.encode_ordinary(text), hex(points[k])
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(chr(rng.choice(points)) for _ in range(rng.randint(1, 12)))
        assert own.encode([text])[0] == theirs.encode_ordinary(text), text



def test_leaks_with_a_phrase_that_all_items_share(spark, monkeypatch):
    """2,000 items with one phrase, documents full of it, repeated items and ids: in time, and with the few that occur."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    phrase = "which of the following is right"
    items = [(i % 1500, f"{' '.join(word() for _ in range(8))} {phrase} {' '.join(word() for _ in range(8))}") for i in range(2000)]
    texts = [" ".join(f"{word()} {phrase} {word()}" for _ in range(50)) for _ in range(20)]
    for d in range(0, 20, 4):
        texts[d] += " " + items[d * 90][1].replace("following", "folowing")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(items + items[:700], "item_id long, text string")
    began = time.perf_counter()
    found = sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.matches(docs, queries).collect())
    assert time.perf_counter() - began < 60
    assert found == [(d, d * 90, 1) for d in range(0, 20, 4)]
    # Blocks hold no more than their size, also where one id has many texts.
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 5000)
    same = queries.withColumn("item_id", F.lit(7).cast("long"))
    blocks = list(decontamination.item_blocks(same))
    assert sum(map(len, blocks)) == 2000 and all(sum(len(t) for _, t in b) <= 5000 for b in blocks)
