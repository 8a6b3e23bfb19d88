"""License scans by diagonal voting.

All rolling word pairs of all texts are hashed and joined with the positions of the same pairs in license templates.
A hit votes for its diagonal, the text position at which the template would begin. Votes are counted by diagonal,
neighbouring diagonals are merged, since an inserted or dropped word shifts what follows, and the words of a span are
compared with the template's before it counts.

A document's word array stays beside the exploded pairs, so that only hits carry a copy of the words to compare, and
the pairs that hit nothing end within the task that made them. Templates are taken in blocks of ``BLOCK_PAIRS`` word
pairs, each broadcast by itself, so that what is broadcast is bounded however many there are.

Rows are told apart by doc_id and two hashes of the text, which a repeated task computes again alike; equal rows are
one until the end, when as many come out as went in.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever their words stand one after another.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Longer texts, of which ``COVERAGE`` must be found.
TEMPLATES = {
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version": "mpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
}
COVERAGE = 0.9
#: Diagonals at most so far apart are merged.
DRIFT = 2
#: Most word pairs of templates in a block.
BLOCK_PAIRS = 100_000
ROW = ["doc_id", "text_a", "text_b", "n_words"]


def template_blocks(phrases: dict[str, str], templates: dict[str, str]) -> Iterator[list[tuple]]:
    """Rows (template, label, base, words) in blocks of at most ``BLOCK_PAIRS`` word pairs, or one longer template."""
    block, size = [], 0
    for i, (text, label, base) in enumerate([*((t, x, True) for t, x in phrases.items()), *((t, x, False) for t, x in templates.items())]):
        words = text.split()
        if block and size + len(words) > BLOCK_PAIRS:
            yield block
            block, size = [], 0
        block.append((i, label, base, words))
        size += len(words)
    yield block


def template_pairs(docs: DataFrame, rows: list[tuple]) -> DataFrame:
    df = docs.sparkSession.createDataFrame(rows, "template int, label string, base boolean, words array<string>")
    df = df.select("template", "label", "base", F.col("words").alias("wanted"), F.posexplode("words").alias("at", "word"))
    df = df.filter(F.col("at") + 1 < F.size("wanted")).select("template", "label", "base", "wanted", "at", F.xxhash64("word", F.element_at("wanted", F.col("at") + 2)).alias("pair"))
    return F.broadcast(df)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``phrases`` must stand word by word; n_base counts their places, first_word and last_word are the smallest and
    largest start (null if none). Of ``templates``, ``COVERAGE`` of the words must agree. Labels are distinct, sorted
    and joined by commas. score is the largest share found of any phrase or template, 0 to 1. Phrases and templates
    have two words or more, in lower case.

    A null or empty text has no words and no labels. Null and repeated ids are kept, each row by itself. Other
    columns are not read; no rows give no rows.
    """
    # lower() differs from lower-casing A-Z only within words that have a letter beyond ASCII, which no template has.
    words = F.regexp_extract_all(F.lower(text_of()), F.lit(WORD), F.lit(0))
    words = docs.select("doc_id", F.xxhash64(text_of()).alias("text_a"), F.xxhash64(F.lit(1), text_of()).alias("text_b"), words.alias("words")).withColumn("n_words", F.size("words").cast("long"))
    # Before its words each row has a place -1 that hits nothing and stays, so that rows without a hit come out too.
    each = words.select(*ROW, "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words").cast("int") - 2, F.lit(-1)))).alias("pos"))
    each = each.withColumn("pair", F.when(F.col("pos") >= 0, F.xxhash64(F.get("words", "pos"), F.get("words", F.col("pos") + 1))))
    here = F.col("pos") < 0
    diagonal = F.col("pos") - F.col("at")
    there = F.when(diagonal >= 0, F.slice("words", diagonal + 1, F.size("wanted"))).otherwise(F.concat(F.array_repeat(F.lit(""), -diagonal), F.slice("words", 1, F.greatest(F.size("wanted") + diagonal, F.lit(0)))))
    hits = None
    for block in template_blocks(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates):
        some = each.join(template_pairs(docs, block), "pair", "left").filter(F.col("template").isNotNull() | (here if hits is None else F.lit(False)))
        some = some.select(*ROW, "template", "label", "base", "wanted", diagonal.alias("diagonal"), F.when(F.col("template").isNotNull(), there).alias("there"))
        hits = some if hits is None else hits.union(some)
    votes = hits.groupBy(*ROW, "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"), *(F.first(c).alias(c) for c in ("label", "base", "wanted", "there")))
    agree = F.size(F.filter(F.zip_with("wanted", "there", lambda a, b: a == b), lambda same: same))
    votes = votes.withColumn("agree", agree).withColumn("length", F.size("wanted"))
    near = Window.partitionBy(*ROW, "template").orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near), F.lit(0)) > DRIFT
    votes = votes.withColumn("new", gap.cast("int")).withColumn("group", F.sum("new").over(near))
    whole = F.col("base") & (F.col("agree") == F.col("length"))
    part = F.sum(F.when(~F.col("base"), F.col("agree"))) / F.first("length")
    share = F.when(part > 1, 1.0).otherwise(part)
    spans = votes.groupBy(*ROW, "template", "label", "group").agg(
        F.count(F.when(whole, 1)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
        F.coalesce(share, F.max(F.when(F.col("base"), F.col("agree") / F.col("length"))), F.lit(0.0)).alias("share"),
        F.first("base").alias("base"),
        F.sum(F.when(F.col("template").isNull(), F.col("votes"))).alias("copies"),
    )
    named = (F.col("places") > 0) | (~F.col("base") & (F.col("share") >= COVERAGE))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    found = spans.groupBy(*ROW).agg(
        F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        joined(F.col("places") > 0).alias("base_labels"),
        joined(named).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sum("copies").cast("int").alias("copies"),
    )
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
