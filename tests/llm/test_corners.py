"""Every operator on corner cases, against plain restatements."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from argentum.llm import audio, byte_bpe, fm_dedup, lbl, neardup, packing, repair, suffix_dedup, syncmers, toxicity
from argentum.llm.session import ship
from tests.llm import brute
from tests.llm.data import corner_docs, frame

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return frame(spark, corner_docs())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def same(a, b):
    assert Counter(a) == Counter(b)


@pytest.mark.parametrize("each", [12 << 20, 1200])
def test_suffix_dedup(docs, empty, monkeypatch, each):
    from argentum.llm import repeats

    real = repeats.dealt
    monkeypatch.setattr(suffix_dedup, "dealt", lambda d: real(d.repartition(3), each=each))
    got = suffix_dedup.suffix_array_dedup(docs, digest=True)
    same(rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.bytes_left(corner_docs()))
    assert rows(suffix_dedup.suffix_array_dedup(empty, digest=True), "doc_id") == []
    full = suffix_dedup.suffix_array_dedup(docs)
    assert full.count() == len(corner_docs()) and {"score", "bucket", "part", "n_removed", "text"} <= set(full.columns)


@pytest.mark.parametrize("each", [12 << 20, 1200])
def test_fm_dedup(docs, empty, monkeypatch, each):
    from argentum.llm import repeats

    real = repeats.dealt
    monkeypatch.setattr(fm_dedup, "dealt", lambda d: real(d.repartition(3), each=each))
    got = fm_dedup.fm_dedup(docs, digest=True)
    same(rows(got, "doc_id", "n_words", "n_removed", "kept_sha256"), brute.words_left(corner_docs()))
    assert rows(fm_dedup.fm_dedup(empty, digest=True), "doc_id") == []
    assert fm_dedup.fm_dedup(docs).count() == len(corner_docs())


@pytest.mark.parametrize("step", [150, 700])
def test_runs_of_long_documents(monkeypatch, step):
    """Equal windows have equal anchors wherever they are, though the document has more values than a place can tell."""
    import pyarrow as pa

    from argentum.llm import repeats

    monkeypatch.setattr(repeats, "STEP", step)
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << 10) - 1))
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 400)
    parts = [rng.integers(97, 123, n) for n in (2500, 60, 1900, 90)]
    docs = [np.concatenate([parts[0], passage, parts[1]]), parts[3], np.concatenate([parts[2], passage, passage])]
    table = pa.table({"text": [bytes(d.astype(np.uint8).tolist()).decode() for d in docs]})
    seen, places = {}, Counter()
    for s in suffix_dedup.read_bytes(table, 100):
        assert len(s.values) <= step + 99 or len(s.bounds) > 2
        for at, low, high, h, doc in zip(s.at.tolist(), s.low.tolist(), s.high.tolist(), s.hash.tolist(), s.doc.tolist(), strict=True):
            for w in range(low, high + 1):
                assert 0 <= at - w <= 68
                where = w - int(s.bounds[doc]) + s.offset
                text = docs[s.first + doc][where : where + 100].tobytes()
                places[s.first + doc, where] += 1
                assert seen.setdefault(text, (h, at - w)) == (h, at - w)
    assert places == Counter((i, w) for i, d in enumerate(docs) for w in range(len(d) - 99))


def test_dedup_of_a_document_beyond_the_places(spark):
    """A passage that repeats behind 2**24 bytes of one document."""
    rng = np.random.default_rng(6)
    filler = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    passage = filler(700)
    made = [(1, filler(900) + passage), (2, filler((1 << 24) + 5000) + passage + filler(300) + passage)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_array_dedup(frame(spark, made), digest=True).collect()}
    assert got == {1: (1600, 0, 0), 2: (len(made[1][1]), 1400, 2)}


def test_near_duplicates(spark, docs, empty):
    got = {}
    for key, n, component, kept in rows(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept"):
        if key is None:
            assert component is None and kept
        else:
            got.setdefault(key, set()).add(component)
            assert kept == (key == component)
    single = [d for d in corner_docs() if d[0] not in (None, 61)]
    want = brute.near_groups(single)
    assert {k: {v} for k, v in want.items()} == {k: v for k, v in got.items() if k != 61}
    assert rows(neardup.near_duplicates(empty), "doc_id") == []


def test_near_duplicates_of_one_large_group(spark):
    import random

    rng = random.Random(9)
    base = [f"v{rng.randrange(300)}" for _ in range(120)]
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    got = dict(rows(neardup.near_duplicates(frame(spark, made)), "doc_id", "component_id"))
    assert got == brute.near_groups(made)


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.9, 0.8, 0.6):
        b = a.copy()
        n = round(len(a) * (1 - share) / (1 + share))
        b[:n] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        keys = np.concatenate([np.sort(a), np.sort(b)])
        s = neardup.odd_sketches(neardup.signatures(keys, np.array([0, len(a), 2 * len(a)])))
        odd = int(np.bitwise_count(s[0] ^ s[1]).sum())
        j = 1 + neardup.BITS / (4 * neardup.BANDS * neardup.ROWS) * np.log(1 - 2 * odd / neardup.BITS)
        assert abs(j - share) < 0.13


def test_byte_bpe(docs, empty):
    import tiktoken

    bpe = byte_bpe.encoder(BYTES)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    want = []
    for key, text in corner_docs():
        ids = plain.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    same(rows(byte_bpe.encode_documents(docs, BYTES, digest=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)
    assert rows(byte_bpe.encode_documents(empty, BYTES), "doc_id") == []
    for r in byte_bpe.encode_documents(docs, BYTES).collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] and len(r["offsets"]) == 4 * r["n_pretokens"]


def test_scan_is_the_same_in_blocks():
    rng = np.random.default_rng(2)
    steps = rng.integers(0, 256, 1000).astype(np.uint8)
    f, want = sum(s << 2 * s for s in range(4)), []
    for g in steps.tolist():
        f = sum((g >> 2 * (f >> 2 * s & 3) & 3) << 2 * s for s in range(4))
        want.append(f)
    assert byte_bpe.scan(steps, 16).tolist() == want


def token_ids(text):
    from tokenizers import Tokenizer

    token_ids.t = getattr(token_ids, "t", None) or Tokenizer.from_file(WORDS)
    return token_ids.t.encode(text or "", add_special_tokens=False).ids


def test_token_ids(spark, docs, empty):
    path = repair.target(spark)
    repair.write_ids(docs, WORDS, path, end_id=1, shard_ids=700)
    got = sorted(rows(repair.read_ids(spark, path, with_ids=True), "start", "doc_id", "n_tokens", "ids_crc32", "ids"))
    at = 0
    seen = []
    for start, key, n, crc, ids in got:
        assert start == at and n == len(ids) // 4 and crc == zlib.crc32(ids)
        at += n
        seen.append((key, tuple(np.frombuffer(ids, "<u4").tolist())))
    assert [k for k, _ in seen if k is None] == [None, None] and [k for k, _ in seen if k is not None] == sorted(k for k, _ in seen if k is not None)
    same(seen, [(k, (*token_ids(t), 1)) for k, t in corner_docs()])
    path = repair.target(spark)
    repair.write_ids(empty, WORDS, path)
    assert rows(repair.read_ids(spark, path), "doc_id") == []


def test_repair_shards_decode_at_random():
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 500)
        ids = np.array([rng.randrange(rng.choice([2, 6, 60])) for _ in range(n)], np.uint32)
        starts = np.array(sorted({0} | {rng.randrange(n) for _ in range(5)}))
        s = repair.Shard(repair.dump(ids, starts))
        a = rng.randrange(n)
        b = rng.randint(a, n)
        assert (s.all() == ids).all() and (s.range(a, b) == ids[a:b]).all()
        ends = [*starts[1:].tolist(), n]
        assert all((s.document(i) == ids[starts[i] : ends[i]]).all() for i in range(len(starts)))


def neighbours(seq, places):
    """Pairs of neighbours inside documents, those of a run of one symbol without overlap."""
    count, edge, last = Counter(), set(places.tolist()), -2
    for i in range(1, len(seq)):
        if i in edge or (seq[i - 1] == seq[i] and last == i - 1 and seq[i - 2] == seq[i]):
            continue
        count[seq[i - 1], seq[i]] += 1
        last = i
    return count


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(7)
    phrase = rng.permutation(5000)[:64]
    alike = np.concatenate([np.tile(phrase, 200), np.full(4001, 9)])
    # More pairs than fit into a round's former limit, and many that share a slot of the hash table.
    wide = np.concatenate([np.tile(np.stack([a, b]), 8).ravel() for a, b in zip(range(30000), range(30000, 60000), strict=True)])
    for ids in (alike, wide, rng.integers(0, 40, 20000)):
        ids, starts = ids.astype(np.uint32), np.array([0, 5000, 5001])
        seq, rules, places, base = repair.compress(ids, starts)
        assert max(neighbours(seq.tolist(), places).values(), default=0) < 8
        lengths = repair.expansion_lengths(rules, base)
        assert (repair.expand(seq, rules, lengths, base) == ids).all() and len(places) == 3
        assert ids[0] != alike[0] or lengths.max() >= 64


def test_packing(docs, empty):
    got = packing.pack_documents(docs, WORDS, 0, 64).collect()
    want = []
    for key, text in corner_docs():
        ids = [*token_ids(text), 0]
        want += [(key, i // 64, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())) for i in range(0, len(ids), 64)]
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == len(best_fit([w[3] for w in want], 64))
    assert packing.pack_documents(empty, WORDS).collect() == []


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def test_audio(docs, empty):
    got = audio.audio_features(docs).collect()
    by_text = {}
    texts = {}
    for key, text in corner_docs():
        texts.setdefault(key, set()).add((text or "").encode())
    for r in got:
        fits = [b for b in texts[r["doc_id"]] if len(b) == r["n_bytes"]]
        ok = False
        for b in fits:
            payload = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
            ok |= (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) == (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])
        assert ok and r["media_bytes"] == r["payload_bytes"] + 44 and len(r["tensor"]) == audio.MELS * audio.COLUMNS
        assert by_text.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert len(got) == len(corner_docs()) and audio.audio_features(empty).collect() == []


def test_audio_parts():
    x = np.sin(np.arange(4000) * 0.2).astype(np.float32)
    y = audio.resample(x, 3, 2)
    assert len(y) == 6000 and abs(y[300:5700].std() - x.std()) < 0.05
    level = np.array([0, 5, 4, 2, 2, 0, 5, 0], float)
    assert audio.spans(level, 4, 1).tolist() == [[1, 5], [6, 7]]
    rate, samples = audio.from_wav(audio.to_wav(b"abc"))
    assert (rate, samples) == (audio.RATE, b"abc")


def test_toxicity(spark, docs, empty):
    import random

    rng = random.Random(6)
    made = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(40)) + (" nasty scum" if i % 5 == 1 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(600)] + [(3, 1, None), (None, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, made), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 5 == 1) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    none = labels.limit(0)
    assert {round(r["score"], 9) for r in toxicity.toxicity(docs, none).collect()} == {0.25}
    assert toxicity.toxicity(empty, labels).collect() == []
    kept = toxicity.score(docs, toxicity.train(docs, labels), keep=tuple(docs.columns), column="s")
    assert kept.count() == len(corner_docs())


def test_language_model(docs, empty):
    got = lbl.score_documents(docs).collect()
    rows_ = [(k, [*brute.WORD.findall((t or "").translate(brute.LOW)), 0]) for k, t in corner_docs()]
    learned = [k is not None and zlib.crc32(str(k).encode()) % 10 != 0 for k, _ in rows_]
    c = Counter(x for (_, w), ok in zip(rows_, learned, strict=True) if ok for x in w)
    total, unit = sum(c.values()), np.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    want = [(k, not ok, len(w), sum(c[x] > 0 for x in w), total, round(sum(np.log10(c[x] + 0.1) for x in w) - len(w) * unit, 6)) for (k, w), ok in zip(rows_, learned, strict=True)]
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got], want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lbl.score_documents(empty).collect() == []


def test_language_model_is_normalised():
    p = np.full(1 + lbl.WORDS + lbl.CLASSES, 1.0)
    m = lbl.start(p / p.sum())
    v = lbl.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, np.zeros(lbl.CLASSES), np.zeros(lbl.CLASSES), lbl.WORDS)
    s = lbl.Scorer(m)
    every = np.arange(v.size)
    assert abs((10 ** s.score(np.full(v.size, 3), np.full(v.size, 9), every)).sum() - 1) < 1e-3


def test_syncmers(docs, empty):
    got = syncmers.with_edited(docs).collect()
    texts = [t or "" for _, t in brute.by_text(corner_docs())]
    want = []
    for i, t in enumerate(texts):
        cut = len(t) // 4
        want.append((len(t), hashlib.sha256((t[: len(t) - cut] + texts[(i + 1) % len(texts)][:cut]).encode()).hexdigest()))
    same([(r["n_chars"], r["edited_sha256"]) for r in got], want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert syncmers.with_edited(empty).collect() == []
    prints = {r["doc_id"]: r["fingerprint"] for r in got if r["doc_id"] is not None}
    assert prints[20] == prints[0] and prints[50] == prints[51] == prints[52] == ""


def test_syncmers_of_texts_with_one_kmer(spark):
    made = [(i, " ".join(f"v{i}_{j}" for j in range(syncmers.K))) for i in range(60)] + [(60, "")]
    got = {r["doc_id"]: r for r in syncmers.with_edited(frame(spark, made)).collect()}
    prints = [got[i]["fingerprint"] for i in range(60)]
    assert "" not in prints and len(set(prints)) == 60 and got[60]["fingerprint"] == ""
    assert all(got[i]["near_next"] == 0 for i in range(60))


def test_syncmers_are_context_free(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    made = [(i, " ".join([f"q{rng.randrange(99)}" for _ in range(i)] + passage)) for i in range(12)]
    got = [set(x for x in r[0] if x is not None) for r in frame(spark, made).select(syncmers.anchors(F.col("text"))).collect()]
    inner = got[0]
    assert inner and all(inner <= g for g in got)


def test_stages_on_corner_cases(spark, docs, empty, tmp_path):
    from argentum.llm import stages

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (stages.drop_toxic, stages.drop_near_duplicates, stages.drop_repeats):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and stage(spark, empty, str(tmp_path)).collect() == []
        if stage is not stages.drop_near_duplicates:
            assert got.count() == docs.count()
    assert stages.pack(spark, empty, str(tmp_path)).collect() == []


@pytest.mark.parametrize("operator", ["bytes", "words"])
def test_dedup_with_hot_anchors_and_repeated_ids(spark, monkeypatch, operator):
    """A passage in most rows, anchors sent window by window, and one doc_id (and rows without any) cut into several parts."""
    import random

    from argentum.llm import repeats
    from tests.llm.data import prose

    rng = random.Random(12)
    passage = prose(rng, 50)
    made = [(key, f"{prose(rng, rng.randrange(0, 30))} {passage} {prose(rng, rng.randrange(0, 30))}") for key in [None] * 40 + [7] * 40 + list(range(40))]
    made += made[:5] + made[45:50] + made[-3:]
    monkeypatch.setattr(repeats, "HOT", 6)
    real, parts = repeats.dealt, []

    def dealt(d):
        df, n = real(d, each=4000)
        parts.append({(r["doc_id"], r[repeats.PART]) for r in df.collect()})
        return df, n

    module, want = (suffix_dedup, brute.bytes_left(made)) if operator == "bytes" else (fm_dedup, brute.words_left(made))
    monkeypatch.setattr(module, "dealt", dealt)
    ship(spark)
    docs = frame(spark, made)
    if operator == "bytes":
        got = rows(suffix_dedup.suffix_array_dedup(docs, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    else:
        got = rows(fm_dedup.fm_dedup(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    same(got, want)
    assert all(sum(k == key for k, _ in parts[0]) > 2 for key in (None, 7))
