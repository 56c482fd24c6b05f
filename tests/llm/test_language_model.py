"""Scores of the language model: held out, by a plain restatement, and whatever the partitions are."""

import numpy as np
import pyarrow as pa

from argentum.llm import lbl
from argentum.llm.session import cut, ship
from tests.llm import brute
from tests.llm.data import corner_docs, frame


def test_held_out_scores_beat_the_base(spark, sf):
    ship(spark)
    got = lbl.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").toPandas()
    assert len(got) and got.score.sum() > got.base_score.sum() + 0.02 * got.n_tokens.sum()


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(lbl, "SHARD", 2000)
    got = []
    for n in (1, 5):
        rows = lbl.score_documents(frame(spark, corner_docs()).repartition(n)).collect()
        got.append(sorted((str(r["doc_id"]), r["n_tokens"], r["base_score"], r["score"]) for r in rows))
    assert all(a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-9) for a, b in zip(*got, strict=True))


def test_scores_against_a_plain_sum(spark):
    """For the trained model: the sum over tokens of log10 of a softmax over all symbols, times the word's share of its class."""
    ship(spark)
    docs = frame(spark, corner_docs())
    counts = cut(lbl.counted(docs), "counts")
    voc = lbl.vocabulary(counts)
    model = lbl.train(cut(lbl.encoded(docs.select("doc_id", "text"), voc), "symbols").select("doc_id", "symbols"), voc)
    by_word = {r["word"]: r["n"] for r in counts.collect()}
    want = []
    for key, text in corner_docs():
        h, c, _ = lbl.tokens(pa.array([text], pa.string()))
        assert len(h) == 1 + len(brute.WORD.findall(text or ""))
        one = two = 0
        total = 0.0
        for w, cls in zip(h.view(np.int64).tolist(), c.tolist(), strict=True):
            at = np.flatnonzero(voc.head.view(np.int64) == w)
            symbol = int(voc.symbol[at[0]]) if len(at) else -1
            share = 1.0
            if symbol < 0:
                symbol = 1 + voc.words + cls
                share = (by_word.get(w, 0) + 0.1) / (voc.class_total[cls] + 0.1 * (voc.class_distinct[cls] + 1))
            z = (model.near[one] + model.far[two]).astype(float) @ model.out.T + model.bias
            p = np.exp(z - z.max())
            total += np.log10(p[symbol] / p.sum() * share)
            one, two = symbol, one
        want.append((str(key), len(h), total))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lbl.score_documents(docs).collect())
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * abs(b[2]) for a, b in zip(got, sorted(want), strict=True))


def test_frequent_words_are_found_by_a_histogram(spark):
    counts = spark.createDataFrame([(i, i % 512, 1 + (i * i) % 5000) for i in range(3000)], "word long, class int, n long")
    kept = [r["n"] for r in lbl.frequent(counts, 700).collect()]
    every = sorted((r["n"] for r in counts.collect()), reverse=True)
    assert 600 < len(kept) <= 700 and sorted(kept, reverse=True) == every[: len(kept)]
    assert lbl.frequent(counts, 5000).count() == 3000
