"""The stages against plain Python on what each was given."""

from __future__ import annotations

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfield.llm import quality
from lumenfield.session import work_folder
from tests.conftest import DATA
from tests.llm import brute


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        path = work_folder(spark, "pipeline-test")
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality_stage(steps):
    before, after = _texts(steps[0]), _texts(steps[1])
    for k, t in before.items():
        b = brute.quality(t)
        if b[0] < 20 or 100 * b[4] > 30 * b[0]:
            assert k not in after
        elif not re.search(r"[#*$%&|<>]", t) and not b[3]:
            assert after[k] == t  # plain prose stays


def test_near_stage(steps):
    before, after = _texts(steps[1]), _texts(steps[2])
    kept = {k for k, _, _, keep in brute.near(sorted(before.items())) if keep}
    assert after == {k: before[k] for k in kept}


def test_decontamination_stage(spark, steps):
    before, after = _texts(steps[2]), _texts(steps[3])
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    for k, t in before.items():
        n, hit, _ = brute.contamination(t, items) if len(t) < 20_000 else (1, None, None)
        if hit is not None:
            assert (k in after) == (not (hit > 0 and 20 * hit >= n))


def test_secret_stage(steps):
    before, after = _texts(steps[3]), _texts(steps[4])
    assert before.keys() == after.keys()
    for k, t in after.items():
        assert not brute.secrets(t)
        if "[secret]" not in t:
            assert t == before[k]


def test_bpe_stage(steps):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before = _texts(steps[4])
    rows = steps[5].collect()
    assert sorted(r.doc_id for r in rows) == sorted(before)
    assert all(r.round_trip and r.ids == t.encode(before[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, DATA).count() == steps[-1].count()


@pytest.fixture(scope="module")
def clashing(odd):
    """The odd rows with columns named like the stages' inner ones."""
    names = ("_contamination", "_spans", "_t", "_w", "_n", "c0", "_bpe", "_hash", "key", "set", "spans_")
    return odd.select("*", *[F.lit(f"own {c}").alias(c) for c in names if c not in odd.columns])


def test_stages_on_odd_rows(spark, clashing):
    """Every stage has a result for nulls, empty and very long texts, repeats and clashing names, and loses no column."""
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        done = stage(spark, clashing, DATA)
        assert done.columns == clashing.columns
        got = done.collect()
        assert all(r["_contamination"] == "own _contamination" and r["_spans"] == "own _spans" and r["c0"] == "own c0" for r in got)
        texts = [(r.doc_id, r.text) for r in got]
        if stage is corpus_pipeline.quality_rules:
            assert all(len(brute.words(t)) >= 20 for _, t in texts)
        elif stage is corpus_pipeline.near_duplicates:
            keep = {k for (k, _, _, kept) in brute.near(rows) if kept and k is not None}
            assert sorted(map(repr, texts)) == sorted(repr(r) for r in rows if r[0] is None or r[0] in keep)
        elif stage is corpus_pipeline.decontamination:
            assert sorted(map(repr, texts)) == sorted(map(repr, rows))
        else:
            marked = [(k, t.replace("token = 'abcdef123456'", "[secret]'") if t else t) for k, t in rows]
            assert sorted(map(repr, texts)) == sorted(map(repr, marked))
    last = corpus_pipeline.bpe_ids(spark, clashing, DATA).collect()
    assert len(last) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    assert sum(r.n_tokens == 0 for r in last) == sum(not t for _, t in rows)


def test_stages_on_an_empty_table(spark, clashing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing.limit(0), DATA).count() == 0


def test_base_statistics_keep_clashing_columns(clashing):
    got = quality.base_statistics(clashing)
    assert set(clashing.columns) - {"text"} <= set(got.columns)
    for r in got.collect():
        assert (r["_t"], r["_w"], r["c0"]) == ("own _t", "own _w", "own c0")
