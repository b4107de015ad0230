"""The corpus pipeline stage by stage on small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from test_corpus_ops import WORDS, edited, prose


def _tables(spark, path, rows, bench):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 30)] + [(i, 0, 0) for i in range(30, 40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    item = prose(rng, 40)
    rows = [(i, prose(rng, 80), "en", "a", 1) for i in range(30)]
    rows += [(30 + i, "$$$ ### " + prose(rng, 60).replace(" ", "%%% "), "en", "b", 1) for i in range(10)]
    rows += [(100 + i, edited(rng, rows[i][1], 1), "en", "a", 1) for i in range(5)]
    rows += [(200, f"{prose(rng, 40)} {item} {prose(rng, 20)}", "en", "a", 1), (300, "12 34 !!", "en", "a", 1), (301, None, "en", "a", 1)]
    # Rows without an id are judged by their texts: one is clean, one holds the passage.
    unnamed = prose(rng, 90)
    rows += [(None, unnamed, None, None, None), (None, f"{item} {prose(rng, 50)}", None, None, None), (None, "?? 12", None, None, None)]
    path = str(tmp_path / "t")
    _tables(spark, path, rows, [(1, item)])
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontaminate", "mix", "token_files"]
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "token_files":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            here = docs.select("doc_id", "text").collect()
            kept.append({r.doc_id for r in here if r.doc_id is not None})
            texts = [r.text for r in here if r.doc_id is None]
            assert set(texts) <= {unnamed, rows[-2][1]} and (len(texts) == 2 if name in ("language", "near_copies") else set(texts) <= {unnamed})
            assert name != "decontaminate" or texts == [unnamed]
    clean = set(range(40))
    assert kept[0] == clean | {*range(100, 105), 200}
    assert kept[1] == clean | {200}
    assert kept[2] == clean
    assert set(range(30)) <= kept[3] <= clean
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(out.collect(), key=lambda r: r.start)
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
    sizes = [len(lib.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]
    assert [r.doc_id for r in got] == [d for d, _ in texts]
    assert sorted(r.n_tokens for r in got) == sorted(sizes)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    assert WORDS and len(corpus_pipeline.run(spark, path).collect()) == len(got)


def test_language_verdict_is_on_the_row(spark):
    """An accepted text does not keep a rejected one of the same id."""
    good = "plain words that anyone can read in a line"
    rows = [(1, good, "en", "a", 1), (1, "12 34 !!", "en", "a", 2), (1, None, "en", "a", 3), (2, good, "en", "a", 4), (2, good, "en", "a", 5), (3, "##", "en", "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.n_chars for r in kept.collect()) == [1, 4, 5]


@pytest.mark.parametrize("gone", ["documents", "benchmark", "labels"])
def test_empty_tables(spark, tmp_path, gone):
    rng = random.Random(2)
    path = str(tmp_path / "t")
    rows = [(i, prose(rng, 60), "en", "a", 1) for i in range(6)]
    _tables(spark, path, rows, [(1, prose(rng, 20))])
    frame = spark.read.parquet(f"{path}/{gone}.parquet")
    frame.limit(0).write.parquet(f"{path}/none")
    empty = spark.read.parquet(f"{path}/none")
    empty.write.mode("overwrite").parquet(f"{path}/{gone}.parquet")
    n = len(corpus_pipeline.run(spark, path).collect())
    assert n == 0 if gone == "documents" else n >= 6
