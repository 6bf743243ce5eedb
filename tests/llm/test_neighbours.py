import numpy as np
import pytest

from meridia.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, v double, place string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, "x", None) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    wide = max({len(v) for _, v in good}, key=lambda n: sum(len(v) == n for _, v in good))
    good = [(i, v) for i, v in good if len(v) == wide]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((-float(np.dot(q, v)), j) for j, v in good if j != i)[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def check(got, want):
    assert len(got) == sum(map(len, want.values()))
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, found in by.items():
        found.sort()
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want[q]]
        assert np.allclose([s for *_, s in found], [s for *_, s in want[q]])


def data(n=600, wide=16, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, wide))
    v[: n // 3] = v[0] + 0.01 * rng.normal(size=(n // 3, wide))
    v[n // 3 : n // 3 + 30] = v[n // 2]
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    return rows + [(9000, None), (9020, [0.0] * wide), (9040, [float("nan")] * wide), (9060, [None] + [1.0] * (wide - 1)), (9080, [1.0]), (None, [1.0] * wide), (9100, [])]


def test_against_brute_force(spark):
    rows = data()
    check(neighbours.nearest(frame(spark, rows), 20, 20).collect(), brute(rows, 20, 20))


def test_small_blocks_share_bounds(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("MOST_BLOCKS", 5), ("SLICE", 3), ("WINDOW", 4), ("PART", 4)):
        monkeypatch.setattr(neighbours, name, value)
    rows = data(200)
    check(neighbours.nearest(frame(spark, rows), 20, 7, window=4).collect(), brute(rows, 20, 7))


def test_blocks_go_where_they_are_asked_for(spark, monkeypatch):
    """With many parts and tight clusters most blocks are asked for by few parts, and their rows are sent to these alone."""
    for name, value in (("BLOCK", 20), ("PART", 2)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    centres = 40 * rng.normal(size=(20, 6))
    v = np.repeat(centres, 40, axis=0) + 0.01 * rng.normal(size=(800, 6))
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    sent, plain = [], neighbours._sent
    monkeypatch.setattr(neighbours, "_sent", lambda blocks, asked: sent.append(plain(blocks, asked)) or sent[-1])
    check(neighbours.nearest(frame(spark, rows), 20, 3).collect(), brute(rows, 20, 3))
    parts = 40 // 2
    assert sent[0].count() < 0.25 * parts * len(rows)


def test_fewer_candidates_than_asked_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.5]), (20, [0.0, 1.0])]
    check(neighbours.nearest(frame(spark, rows)).collect(), brute(rows, 20, 20))
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(0, None)])).count() == 0


def test_curves_alone_find_near_rows(spark):
    """On vectors with structure the windows alone have a recall of 0.9."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2000, 4)) @ rng.normal(size=(4, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    want = brute(rows, 20, 10)
    got = neighbours.nearest(frame(spark, rows), 20, 10, complete=False).collect()
    found = {(r.query_id, r.vec_id) for r in got}
    assert sum((q, j) in found for q, w in want.items() for _, j, _ in w) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_is_one_path(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * n), axis=-1).reshape(-1, n)
    place = neighbours.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
