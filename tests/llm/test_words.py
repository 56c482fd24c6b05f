"""Words that a polynomial hash takes for one another, in every operator that tells words apart."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from argentum.llm import fm_dedup, lbl, neardup, packing, repair, repeats, toxicity, words
from argentum.llm.session import ship
from tests.llm import brute
from tests.llm.data import frame

X = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
Y = X.translate(str.maketrans("ab", "ba"))
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def column(texts):
    return pa.array(texts, pa.string())


@pytest.mark.parametrize("collide", [False, True])
def test_numbers_are_told_by_bytes(monkeypatch, collide):
    """Also where all words of several blocks have one hash."""
    if collide:
        real = words.Words.hashes
        monkeypatch.setattr(words.Words, "hashes", lambda self: np.where(self.end - self.start > 8, 0, real(self)).astype(np.uint64))
    texts = [f"{X} {Y} a b", "", f"b a {X} {Y}", None, "a" * 16 + " " + "a" * 17 + " " + "a" * 15 + "b", "abcdefgh abcdefgi abcdefgh", "x" * 9 + " " + "y" * 9 + " " + "x" * 9]
    w = words.Words(column(texts))
    first, number = w.numbers()
    own = [w.text(i, i + 1) for i in range(len(w))]
    assert [own[i] for i in first[number].tolist()] == own and len({*own}) == len(first)
    ids = [e.ids for e in _library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    from argentum.llm.word_tokens import Pieces

    assert [np.frombuffer(x, "<u4").tolist() for x in Pieces(VOCABULARY).encode([t or "" for t in texts])] == ids


def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_ids_of_colliding_words(spark):
    rows = [(1, X), (2, Y), (3, f"{X} {Y}")]
    ids = [_library().encode(t, add_special_tokens=False).ids for _, t in rows]
    path = repair.target(ship(spark))
    repair.write_ids(frame(spark, rows), VOCABULARY, path)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in repair.read_ids(spark, path, with_ids=True).collect()}
    assert got == {i + 1: [*x, 1] for i, x in enumerate(ids)}
    packed = packing.pack_documents(frame(spark, rows), VOCABULARY, 0, 4096).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in packed} == {i + 1: zlib.crc32(np.array([*x, 0], "<u4").tobytes()) for i, x in enumerate(ids)}


def test_windows_of_colliding_words(spark):
    ship(spark)
    some = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{some} {X}"), (2, f"{some} {Y}"), (3, f"{some} {Y}")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in fm_dedup.fm_dedup(frame(spark, docs), digest=True).collect())
    assert got == sorted(brute.words_left(docs)) and [r[2] for r in got] == [0, 0, 13]


def test_shingles_of_colliding_words(spark):
    ship(spark)
    docs = [(1, f"p q r s {X}"), (2, f"p q r s {Y}"), (3, X), (4, Y)]
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, docs)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_counts_of_colliding_words(spark):
    ship(spark)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:3]
    docs = [*((i, X) for i in learned), (held, f"{X} {Y}")]
    got = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in lbl.score_documents(frame(spark, docs)).collect()}
    assert got[held] == (3, 2)


def test_rows_without_id_are_spread(spark):
    """4,000 rows without doc_id that begin alike, and several heavy ids, by one job for all."""
    ship(spark)
    rows = [(None, f"https://example.org/{i} " + "x" * 200) for i in range(4000)] + [(k, f"https://{k}/{i} " + "y" * 200) for k in (7, 8, 30) for i in range(400)] + [(i, "z" * 300) for i in range(100, 300)]
    size = sum(len(t) for _, t in rows)
    parts, n = repeats.dealt(frame(spark, rows).repartition(4), each=size // 40)
    counts = {r[repeats.PART]: r["n"] for r in parts.groupBy(repeats.PART).agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    nulls = parts.filter("doc_id is null").select(repeats.PART).distinct().count()
    assert n < 80 and nulls >= 27 and max(counts.values()) < 4 * len(rows) / 40
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r[repeats.TEXT_HASH])
    by_part = sorted(parts.select("doc_id", repeats.TEXT_HASH, repeats.PART).collect(), key=lambda r: (r[repeats.PART], key(r)))
    assert list(map(key, by_part)) == sorted(map(key, by_part))


def test_toxicity_learns_from_one_text_an_id(spark, monkeypatch):
    ship(spark)
    seen = []
    real = toxicity.calibrated
    monkeypatch.setattr(toxicity, "calibrated", lambda rows, bits: seen.append(rows) or real(rows, bits))
    docs = frame(spark, [(i % 3, f"text {i % 50} of many") for i in range(20_000)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(3)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels, most=10)
    assert len(seen[0]) <= 3
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40)
    toxicity.train(docs, labels, most=10)
    assert sum(x.nbytes for x, _ in seen[1]) <= 80 < sum(x.nbytes for x, _ in seen[0]) or len(seen[1]) < len(seen[0])
