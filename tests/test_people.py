"""Constrained clustering: in one task, in rounds over tables, and as a plain loop."""

import numpy as np
import pytest

from argentum.operators import people


def plain(v, photo, link, least, mean):
    """Groups of places by the links in order."""
    score = np.round(v.astype(float) @ v.astype(float).T, 9)
    links = sorted((-score[i, j], i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if photo[i] != photo[j] and score[i, j] >= link)
    groups, head = {i: [i] for i in range(len(v))}, list(range(len(v)))
    for _, i, j in links:
        a, b = head[i], head[j]
        if a == b or {photo[x] for x in groups[a]} & {photo[x] for x in groups[b]}:
            continue
        cross = [score[x, y] for x in groups[a] for y in groups[b]]
        if min(cross) < least or round(sum(cross) / len(cross), 9) < mean:
            continue
        for x in groups[b]:
            head[x] = a
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def faces(seed, n, k, noise):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(k, 6))[rng.integers(0, k, n)] + noise * rng.normal(size=(n, 6))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    v[5] = v[6] = v[n // 2]  # ties
    return v, rng.integers(0, n // 3, n).tolist()


@pytest.mark.parametrize("seed,noise", [(1, 0.5), (2, 0.9)])
def test_rounds_equal_a_plain_loop(spark, seed, noise):
    v, photo = faces(seed, 45, 3, noise)
    df = spark.createDataFrame([(i, photo[i], x.tolist()) for i, x in enumerate(v)], "id long, photo_id long, vector array<float>")
    want = plain(v, photo, 0.6, 0.45, 0.5)
    for alone in (0, people.ALONE):
        got, keys = {}, {}
        for r in people.groups(df, alone=alone).collect():
            got.setdefault(r["person_key"], []).append(r["id"])
            keys[r["person_key"]] = r["size"]
        assert sorted(map(sorted, got.values())) == want
        assert all(k == "{}:{}".format(*min((photo[i], i) for i in ids)) and keys[k] == len(ids) for k, ids in got.items())


def test_a_low_mean_rejects_one_link_only(spark):
    """After the clusters have grown, a later link between them may pass."""
    v, photo = faces(7, 30, 2, 0.8)
    df = spark.createDataFrame([(i, photo[i], x.tolist()) for i, x in enumerate(v)], "id long, photo_id long, vector array<float>")
    want = plain(v, photo, 0.5, 0.1, 0.62)
    got = {}
    for r in people.groups(df, 0.5, 0.1, 0.62, alone=0).collect():
        got.setdefault(r["person_key"], []).append(r["id"])
    assert sorted(map(sorted, got.values())) == want


def test_clusters_of_strong_links_go_on_in_rounds(spark, monkeypatch):
    """Pairs of single faces are written from `link` on only; those between clusters are sums."""
    v, photo = faces(3, 60, 5, 0.25)
    df = spark.createDataFrame([(i, photo[i], x.tolist()) for i, x in enumerate(v)], "id long, photo_id long, vector array<float>")
    written, cut = {}, people.cut

    def counted(rows, name="step", **options):
        out = cut(rows, name, **options)
        written.setdefault(name, out.count())
        return out

    monkeypatch.setattr(people, "cut", counted)
    got = {}
    for r in people.groups(df, 0.3, 0.1, 0.2, alone=30).collect():
        got.setdefault(r["person_key"], []).append(r["id"])
    score = np.round(v.astype(float) @ v.astype(float).T, 9)
    own = np.array(photo)[:, None] != np.array(photo)[None]
    assert sorted(map(sorted, got.values())) == plain(v, photo, 0.3, 0.1, 0.2)
    assert written["alike"] == (np.triu(score >= 0.3, 1) & own).sum() < (np.triu(score >= 0.1, 1) & own).sum()


def test_many_links_are_no_table(spark, monkeypatch):
    """Whatever the number of links, a table on the way has a row for each face at most; copies of one face, more than a task holds, go on in stars."""
    rng = np.random.default_rng(5)
    v, photo = faces(3, 60, 5, 0.25)
    v = np.concatenate([v, v[:1] + 0.05 * rng.normal(size=(30, 6)), v[:1].repeat(10, 0)]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    photo += range(100, 140)
    df = spark.createDataFrame([(i, photo[i], x.tolist()) for i, x in enumerate(v)], "id long, photo_id long, vector array<float>")
    written, cut = {}, people.cut

    def counted(rows, name="step", **options):
        out = cut(rows, name, **options)
        written.setdefault(name, []).append(out.count())
        return out

    for module in (people, getattr(people, "rounds", people)):
        monkeypatch.setattr(module, "cut", counted)
    monkeypatch.setattr(people, "ALONE", 16)
    monkeypatch.setattr(people, "LINKS", 2, raising=False)
    got = {}
    for r in people.groups(df, 0.3, 0.1, 0.2, alone=16).collect():
        got.setdefault(r["person_key"], []).append(r["id"])
    want = plain(v, photo, 0.3, 0.1, 0.2)
    assert sorted(map(sorted, got.values())) == want and max(map(len, want)) > 32
    assert max(map(max, written.values())) <= len(v)
    assert len(written["clusters"]) < 24  # rounds: not one for each copy


def state(rng, n, few):
    """Rows of clusters that are dealt to parts, with where they stopped."""
    from argentum.operators.rounds import Rows

    v, photo = faces(int(rng.integers(1000)), n, 3, 0.4)
    cluster = np.sort(rng.integers(0, few, n))
    first = np.append(0, np.flatnonzero(np.diff(cluster)) + 1)
    cluster = first[np.searchsorted(first, np.arange(n), "right") - 1]
    stop = np.round(rng.uniform(0.5, 1.2, n), 3)[cluster]
    return Rows(np.arange(n), cluster, cluster % 4, np.array(photo), stop, np.full(n, -1), np.full(n, -1), v)


@pytest.mark.parametrize("tile,wide", [(512, 4096), (3, 5)])
def test_first_links_that_leave(monkeypatch, tile, wide):
    """Blocks and tiles of any size find the same first links as a loop over all pairs."""
    from argentum.operators import rounds

    monkeypatch.setattr(rounds, "TILE", tile)
    monkeypatch.setattr(rounds, "WIDE", wide)
    for seed in range(20):
        rows = state(np.random.default_rng(seed), 40, (8, 25)[seed % 2])
        score, n, want = rounds.products(rows.x.astype(float), rows.x.astype(float)), len(rows), {}
        for i in range(n):
            for j in range(i + 1, n):
                c, d = rows.cluster[i], rows.cluster[j]
                own, other = np.flatnonzero(rows.cluster == c), np.flatnonzero(rows.cluster == d)
                if rows.part[i] == rows.part[j] or score[i, j] < 0.4 or score[i, j] >= min(rows.s[i], rows.s[j]) or score[np.ix_(own, other)].min() < 0.1 or set(rows.photo[own]) & set(rows.photo[other]):
                    continue
                for k in (c, d):
                    want[k] = min(want.get(k, (0.0, 0, 0)), (-score[i, j], i, j))
        half = int(rows.start[len(rows.start) // 2])
        one, two = rows.slice(0, half), rows.slice(half, n)
        home = [rounds.Home(x, 0.4, 0.1, 1e-5) for x in (one, two)]
        first = rounds.First(len(two.start), 0.4)
        for x in home:
            x.itself()
        home[0].meet(two, first)
        got = {}
        for x, f in ((one, home[0].first), (two, home[1].first), (two, first)):
            for k in f.found():
                c = x.cluster[x.start[k]]
                got[c] = min(got.get(c, (0.0, 0, 0)), (-f.s[k], f.a[k], f.b[k]))
        assert got == want


@pytest.mark.parametrize("ahead", [1 << 20, 4])
def test_a_group_holds_few_links_at_once(monkeypatch, ahead):
    from argentum.operators import rounds

    for name, value in (("TILE", 3), ("WIDE", 5), ("AHEAD", ahead)):
        monkeypatch.setattr(rounds, name, value)
    for seed in range(10):
        v, photo = faces(seed, 40, 3, 0.5)
        n = len(v)
        rows = rounds.Rows(np.arange(n), np.arange(n), np.zeros(n), np.array(photo), np.full(n, np.inf), np.full(n, -1), np.full(n, -1), v)
        out = rounds.First(n, 0.5)
        head = rounds.decide(rows, out, 0.5, 0.1, 0.62)
        got = sorted(g for g in (np.flatnonzero(head == k).tolist() for k in range(n)) if len(g) > 1)
        assert got == plain(v, photo, 0.5, 0.1, 0.62) and not len(out.found())
