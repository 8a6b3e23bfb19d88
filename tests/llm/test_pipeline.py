"""The pipeline stage by stage, each against a plain version on its own input."""

from __future__ import annotations

import brute
import corpus_pipeline
import pandas as pd
from sagebrush.llm import decontamination, quality
from sagebrush.llm.queries import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        kept.append(docs.toPandas())
    start = pd.read_parquet(f"{sf}/documents.parquet")
    good = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas()
    assert set(kept[0].doc_id) == set(good.doc_id[good.predicted == 1]) and len(kept[0]) > len(start) / 2
    once = brute.words_once(dict(zip(kept[0].doc_id, kept[0].text, strict=True)))
    assert {i: t.split() for i, t in zip(kept[1].doc_id, kept[1].text, strict=True)} == {i: w for i, w in once.items() if w}
    assert (kept[1].n_chars == kept[1].text.str.len()).all()
    assert set(kept[2].doc_id) == set(brute.components(dict(zip(kept[1].doc_id, kept[1].text, strict=True))).values())
    matcher = decontamination.Matcher(list(pd.read_parquet(f"{sf}/benchmark.parquet").itertuples(index=False, name=None)))
    assert set(kept[3].doc_id) == {i for i, t in zip(kept[2].doc_id, kept[2].text, strict=True) if not matcher.find(t)}
    assert set(kept[4].doc_id) == set(kept[3].doc_id) and kept[4].round_trip.all()
    assert (kept[4].ids.str.len() == kept[4].n_tokens).all()
    assert sorted(corpus_pipeline.run(spark, sf).toPandas().ids_sha256) == sorted(kept[4].ids_sha256)


def test_stages_without_rows_texts_or_counts(spark, sf, tmp_path):
    """Empty tables, null texts and documents without n_chars go through all stages."""
    for name, docs in {
        "none": spark.createDataFrame([], "doc_id long, text string"),
        "null": spark.createDataFrame([(1, None), (None, None), (2, ""), (3, "a few words"), (None, "a few words")], "doc_id long, text string"),
    }.items():
        base = f"{tmp_path}/{name}"
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        docs.write.parquet(f"{base}/documents.parquet")
        found = corpus_pipeline.run(spark, base).collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in found) == ([] if name == "none" else [-1, -1, 1, 2, 3])
