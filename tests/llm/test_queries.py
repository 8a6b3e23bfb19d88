"""The registered queries against plain versions, over whole small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sagebrush.llm import bpe, decontamination, labelled, quality, toxicity
from sagebrush.llm.queries import ORACLES, QUERIES, VOCABULARY
from sagebrush.llm.secrets import ALLOWED, KINDS, THRESHOLDS, WINDOW


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def result(spark, sf):
    return lambda name: QUERIES[name](spark, sf).toPandas()


def none(x):
    return None if pd.isna(x) else int(x)


def test_near_dedup(result, docs):
    wanted = brute.components(dict(zip(docs.doc_id, docs.text, strict=True)))
    found = result("op1_minhash_near_dedup").set_index("doc_id")
    assert dict(found.component_id) == wanted
    assert dict(found.n_shingles) == {i: len(brute.shingles(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert set(found.index[found.kept]) == set(wanted.values())


@pytest.mark.parametrize(("name", "label", "folds", "out", "least"), [("op2_quality_classifier", "quality", 4, 2, 0.85), ("op10_toxicity", "toxic", 3, 1, 0.85)])
def test_classifiers(spark, name, label, folds, out, least):
    sf = "/root/testdata/sf0.01"
    found = QUERIES[name](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert sorted(found.doc_id) == sorted(pd.read_parquet(f"{sf}/documents.parquet").doc_id)
    assert list(found.held_out) == [zlib.crc32(str(i).encode()) % folds == out for i in found.doc_id]
    assert found.score.between(0, 1).all()
    assert list(found.predicted) == [int(s >= 0.7) for s in found.score]
    held = found[found.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held[label]).mean() >= least


def test_quality_by_plain_ftrl(spark):
    """Scores are those of plain FTRL on the same rows, dealt to the same shards."""
    sf = "/root/testdata/sf0.001"
    q = quality
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = sorted((r.place, r.doc_id, r.text, r.label) for r in labelled.sample(docs, labels, "quality", 4, 2, q.SAMPLE_ROWS).collect())
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert rows and all(zlib.crc32(str(i).encode()) % 4 != 2 and known[i] == y for _, i, _, y in rows)
    weights = Counter()
    for shard in range(q.SHARDS):
        part = [(brute.quality_features(t, q.BITS), y) for place, _, t, y in rows if place % q.SHARDS == shard]
        for i, w in brute.ftrl(part, q.PASSES, q.ALPHA, q.BETA, q.L1, q.L2).items():
            weights[i] += w * len(part) / len(rows)
    found = {r.doc_id: r.score for r in q.classify(docs, labels).collect()}
    for r in docs.collect():
        z = sum(weights[i] * v for i, v in brute.quality_features(r.text or "", q.BITS).items())
        assert found[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_by_walking_the_trees(spark):
    """Scores are the isotonic steps at the trees' margin over plain features; the lexicon and the trees don't see the calibrating rows."""
    sf, x = "/root/testdata/sf0.01", toxicity
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = labelled.sample(docs, labels, "toxic", 3, 1, x.SAMPLE_ROWS)
    model = x.Model(rows)
    flipped = rows.withColumn("label", F.when(F.col("place") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    again = x.Model(flipped)
    grown = [m.trees.toDebugString.split("\n", 1)[1] for m in (model, again)]
    assert again.learned == model.learned and grown[0] == grown[1]
    features = {r.doc_id: brute.toxicity_features(r.text or "", x.LEXICON, model.learned, x.SECOND_PERSON, x.DISGUISES, x.NEAR) for r in docs.collect()}
    found = {r.doc_id: r.score for r in model.score(docs).collect()}
    at, value = model.steps.boundaries.toArray(), model.steps.predictions.toArray()
    trees = list(zip(model.trees.trees, model.trees.treeWeights, strict=True))
    for i in sorted(features)[::9]:
        margin = sum(w * t.predict(Vectors.dense(features[i])) for t, w in trees)
        assert found[i] == pytest.approx(np.interp(margin, at, value), abs=1e-6)


def test_bpe(result, docs):
    import tiktoken

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = result("op3_byte_bpe").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        ids = theirs.encode_ordinary(text)
        assert found.n_tokens[i] == len(ids)
        assert found.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found.decoded_sha256[i] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_mixed_strings():
    """10,000 strings of mixed scripts, combining marks, repeated characters and random tokens give tiktoken's ids."""
    import tiktoken

    own = bpe.coder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng, tokens = random.Random(5), list(own.ranks)
    scripts = [(0x20, 0x7E), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x590, 0x6FF), (0x900, 0x97F), (0x1E00, 0x2FFF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F6FF)]
    makers = [
        lambda: "".join(chr(rng.randint(*rng.choice(scripts))) for _ in range(rng.randint(1, 80))),
        lambda: "".join(rng.choice("abeinrst ") for _ in range(rng.randint(1, 80))),
        lambda: "".join(rng.choice("a.!=-\n \t0") * rng.randint(1, 9) for _ in range(rng.randint(1, 20))),
        lambda: b"".join(rng.choices(tokens, k=rng.randint(1, 12))).decode("utf-8", "ignore"),
    ]
    doubtful = 0
    for i in range(10_000):
        text = makers[i % 4]()
        (ids,) = own.encode([text])
        assert ids == theirs.encode_ordinary(text), text
        assert own.decode(ids).decode() == text
        doubtful += any(map(own.is_doubtful, own.split(text)))
    assert doubtful > 100


def test_decontamination(result, docs, sf):
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    found = result("op4_decontamination")
    got = {(d, i): e for d, i, e in zip(found.doc_id, found.item_id, found.edits, strict=True)}
    texts = {i: decontamination.normal(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    some = sorted({d for d, _ in got})[:6] + sorted(i for i in texts if len(texts[i]) < 900)[:6]
    for d in dict.fromkeys(some):
        for i, t in list(zip(items.item_id, items.text, strict=True))[:12]:
            item = decontamination.normal(t)
            edits = brute.edit_distance_within(item, texts[d][:6000])
            if len(texts[d]) <= 6000:
                assert got.get((d, i)) == (edits if edits <= len(item) // decontamination.CHARS_PER_EDIT else None)


def test_licenses(result, docs):
    found = result("op5_license_scan").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        r = found.loc[i]
        base = brute.licenses(text)
        assert (r.n_words, r.n_base, none(r.first_word), none(r.last_word), r.base_labels) == base
        assert set(base[-1].split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_token_counts(result, docs):
    found = result("op6_token_counts")
    own = bpe.coder(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    tokens = {r: b for b, r in own.ranks.items()}
    columns = ["section", "char_start", "char_end", "n_tokens", "n_crossing"]
    by_doc = {i: sorted(map(tuple, g[columns].to_numpy().tolist())) for i, g in found.groupby("doc_id")}
    for i, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        (ids,) = own.encode([text])
        assert by_doc[i] == brute.sections(text, [tokens[t] for t in ids])
    whole = result("op3_byte_bpe").set_index("doc_id").n_tokens
    assert dict(found.groupby("doc_id").n_tokens.sum()) == dict(whole)
    lines = {i: max(1, t.count("\n") + (not t.endswith("\n"))) for i, t in zip(docs.doc_id, docs.text.fillna(""), strict=True)}
    assert dict(found.groupby("doc_id").section.count()) == lines
    assert dict(found.groupby("doc_id").char_end.max()) == {i: len(t) for i, t in zip(docs.doc_id, docs.text.fillna(""), strict=True)}


def test_topk(result, sf):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    columns = ["query_id", "rank", "vec_id", "score"]
    wanted = c.execute(ORACLES["op7_exact_topk"]).df()[columns].sort_values(columns).to_numpy()
    assert np.array_equal(result("op7_exact_topk")[columns].sort_values(columns).to_numpy(), wanted)


def test_line_dedup(result, docs):
    """Of each text the words of later repeated windows go and no others; lines in which all words stay, stay as they are."""
    found = result("op8_line_dedup").set_index("doc_id")
    wanted = brute.words_once(dict(zip(docs.doc_id, docs.text, strict=True)))
    cut = 0
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        assert found.text[i].split() == wanted[i]
        lines, left = text.split("\n"), found.text[i].split("\n") if found.n_deleted[i] < found.n_lines[i] else []
        assert found.n_lines[i] == len(lines) and found.n_deleted[i] == len(lines) - len(left)
        if len(wanted[i]) == len(text.split()):
            assert found.text[i] == text
        cut += len(wanted[i]) < len(text.split())
    assert cut > 10


def test_secrets(result, docs):
    found = result("op9_secret_scan").set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        r = found.loc[i]
        *counts, spans = brute.secrets(text)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == tuple(counts)
        known = sorted((int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x))
        random = [(s, 3, e) for s, e in brute.random_spans(text, WINDOW, THRESHOLDS, ALLOWED) if not any(a <= s and e <= b for a, _, b in known)]
        assert r.spans == ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(known + random))
