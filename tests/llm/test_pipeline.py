"""The pipeline's stages, one after another, against plain restatements."""

import corpus_pipeline
import pytest

from tests.llm import brute


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage got and gave."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        path = str(tmp_path_factory.mktemp("stages") / name)
        got.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_array_dedup", "best_fit_packing"]


def test_toxicity(steps):
    before, after = steps[0]
    assert after.columns == before.columns and set(rows(after)) <= set(rows(before))
    assert after.count() > 0.7 * before.count()


def test_near_duplicates(steps):
    before, after = steps[1]
    want = brute.near_groups(rows(before))
    assert sorted(k for k, _ in rows(after)) == sorted(k for k, v in want.items() if k == v)
    assert after.columns == before.columns


def test_repeats(steps):
    import hashlib

    before, after = steps[2]
    sizes = {k: (n - gone, digest) for k, n, gone, _, digest in brute.bytes_left(rows(before))}
    assert after.columns == before.columns and after.count() == before.count()
    for r in after.collect():
        raw = (r["text"] or "").encode()
        assert len(raw) <= sizes[r["doc_id"]][0] and r["n_chars"] == len(r["text"] or "")
        if len(raw) == sizes[r["doc_id"]][0]:
            assert hashlib.sha256(raw).hexdigest() == sizes[r["doc_id"]][1]


def test_packing(steps):
    before, after = steps[3]
    assert {r["doc_id"] for r in after.collect()} == {k for k, _ in rows(before)}
    by = {}
    for r in after.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, sf, steps):
    assert corpus_pipeline.run(spark, sf).count() == steps[3][1].count()
