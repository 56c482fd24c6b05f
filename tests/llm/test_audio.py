"""Audio features against a plain restatement, and tensors as Arrow stores them."""

import math

import numpy as np
import pyarrow as pa

from argentum.llm import audio
from argentum.llm.session import ship
from tests.llm.data import corner_docs, frame


def plain(payload):
    """Picture and spans: zeros put between samples, one long filter, every third output, sums instead of transforms."""
    x = [(b - 128) / 128 for b in payload]
    taps = audio.TAPS * audio.UP
    h = [np.sinc((i - (taps - 1) / 2) / max(audio.UP, audio.DOWN)) * (0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (taps + 1))) for i in range(taps)]
    h = [v * audio.UP / sum(h) for v in h]
    dense = [0.0] * (len(x) * audio.UP)
    dense[:: audio.UP] = x
    y = []
    for m in range(math.ceil(len(x) * audio.UP / audio.DOWN)):
        at = m * audio.DOWN + (audio.TAPS // 2 - 1) * audio.UP  # the filter's delay
        y.append(sum(h[k] * dense[at - k] for k in range(taps) if 0 <= at - k < len(dense)))
    rate = audio.RATE * audio.UP / audio.DOWN
    frames = max(1, math.ceil((len(y) - audio.FRAME) / audio.HOP) + 1)
    y += [0.0] * (frames * audio.HOP + audio.FRAME)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hertz = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    picture, level = [], []
    for t in range(frames):
        part = np.array(y[t * audio.HOP : t * audio.HOP + audio.FRAME]) * [0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1)) for i in range(audio.FRAME)]
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        row = []
        for a, b, c in zip(hertz, hertz[1:], hertz[2:]):
            total = sum(p * max(0, min((k * rate / audio.FRAME - a) / (b - a), (c - k * rate / audio.FRAME) / (c - b))) for k, p in enumerate(power))
            row.append(math.log(total + audio.FLOOR))
        picture.append(row)
        level.append(sum(row) / len(row) * 10 / math.log(10))
    mean, on, spans = sum(level) / len(level), None, []
    for t, v in enumerate([*level, -1e9]):
        if on is None and v >= mean + audio.ON_DB:
            on = t
        elif on is not None and v < mean + audio.OFF_DB:
            spans.append((round(on * audio.HOP * 1000 / rate), round(t * audio.HOP * 1000 / rate)))
            on = None
    edges = [int(i * frames / audio.COLUMNS) for i in range(audio.COLUMNS + 1)]
    pooled = []
    for a, b in zip(edges, edges[1:]):
        b = min(max(b, a + 1), frames)
        pooled.append(np.mean(picture[min(a, b - 1) : b], axis=0))
    return np.array(pooled), spans


def test_features_against_plain_sums():
    rng = np.random.default_rng(4)
    loud = bytes(rng.integers(0, 256, 3000).tolist())
    quiet = bytes((128 + rng.integers(-2, 3, 4000)).tolist())
    for payload in (quiet + loud + quiet, b"Some words of a text, not very many. " * 60 + b"x" * 3000, bytes(64)):
        picture, spans = audio.features(payload, audio.RATE)
        want, want_spans = plain(payload)
        assert picture.shape == want.shape and np.abs(picture - want).max() < 0.02
        assert [tuple(s) for s in spans.tolist()] == want_spans
    assert audio.features(quiet + loud + quiet, audio.RATE)[1].shape == (1, 2)


def test_media_are_stored_and_read_back(spark, monkeypatch):
    ship(spark)
    seen = []
    real = audio.cut
    monkeypatch.setattr(audio, "cut", lambda df, *a, **k: seen.append(real(df, *a, **k)) or seen[-1])
    got = audio.audio_features(frame(spark, corner_docs())).collect()
    media = sorted(bytes(r["media"]) for r in seen[0].collect())
    texts = sorted(audio.to_wav((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0")) for _, t in corner_docs())
    assert media == texts and "parquet" in seen[0].inputFiles()[0] and len(got) == len(texts)
    for r in got:
        numbers, spans = r["feature"].split(";")
        assert np.allclose([float(x) for x in numbers.split(",")], r["tensor"], atol=0.006)
        assert spans == ",".join(f"{a}-{b}" for a, b in zip(r["span_start_ms"], r["span_end_ms"], strict=True))


def test_tensors_have_a_fixed_shape(spark, monkeypatch):
    """What the query stores on its way."""
    ship(spark)
    paths, real = [], audio.place
    monkeypatch.setattr(audio, "place", lambda *a: paths.append(real(*a)) or paths[-1])
    features = audio.audio_features(frame(spark, corner_docs())).cache()
    path = paths[0]
    tables = [audio.read_tensors(bytes(r["data"])) for r in spark.read.parquet(path).collect()]
    assert all(t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (audio.COLUMNS, audio.MELS)) for t in tables)
    got = sorted((str(k), x.ravel().tolist()) for t in tables for k, x in zip(t["doc_id"].to_pylist(), t["tensor"].combine_chunks().to_numpy_ndarray(), strict=True))
    assert got == sorted((str(r["doc_id"]), r["tensor"]) for r in features.collect())
