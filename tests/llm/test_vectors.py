import numpy as np
import pytest

from lakesnap.llm import bitslice, graph


def table(spark, seed=1, n=400, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)]
    rows += [(1000 + k, x[7].tolist(), 0) for k in range(0, 60)] + [(2000, None, 0), (2100, [], 0), (2200, [0.0] * dims, 0), (2300, [float("nan")] * dims, 0), (2400, [float("inf")] + [0.0] * (dims - 1), 0), (2500, [None] + [0.5] * (dims - 1), 0), (None, x[0].tolist(), 0)]
    rows += [(100, x[100].tolist(), 5), (3000, [0.5, -0.25], 0), (3001, [1.0, 1.0], 0), (3100, [30.0, -40.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)


def brute(rows, measure, whole, k=10):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and (not whole or any(v)):
            good[i] = np.array(v, np.float32).astype(float)
    out = []
    for q, v in good.items():
        if q % 100 == 0:
            found = sorted((measure(v, x), i) for i, x in good.items() if i != q and len(x) == len(v))[:k]
            out += [(q, r + 1, i, -s if not whole else s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rows, df = table(spark)
    up = lambda v: np.floor(1024 * v).astype(int)
    want = brute([r for k, r in enumerate(rows) if k != 467], lambda v, x: -int(up(v) @ up(x)), False)
    unique = df.dropDuplicates(["vec_id"])
    assert sorted(tuple(r) for r in bitslice.top_k(unique).collect()) == want
    monkeypatch.setattr(bitslice, "ROWS", 100)
    monkeypatch.setattr(bitslice, "QUERIES", 2)
    assert sorted(tuple(r) for r in bitslice.top_k(unique).collect()) == want
    assert bitslice.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 5, 50, 90, 200])
def test_block(k):
    rng = np.random.default_rng(k)
    values = rng.integers(-1500, 1500, (90, 7))
    values[10:30] = values[5]
    ids = rng.permutation(90)
    block = bitslice.Block(ids, values)
    for q in (values[5], values[0], np.zeros(7, int), rng.integers(-3, 4, 7)):
        scores = values @ q
        order = [r for r in np.lexsort((ids, -scores)) if ids[r] != ids[5]][:k]
        found, got = block.top(q, k, ids[5])
        assert found.tolist() == ids[order].tolist()
        assert got.tolist() == scores[order].tolist()


def test_nearest_equals_brute_force_on_small_tables(spark):
    rows, df = table(spark)
    want = brute(rows, lambda v, x: float(np.sqrt(((x - v) ** 2).sum())), True)
    got = sorted(tuple(r) for r in graph.nearest(df).collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=1e-12)
    assert graph.nearest(df.limit(0)).count() == 0


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHARD", 700)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {r[:1] + r[2:3] for r in brute([(k, v.tolist(), 0) for k, v in enumerate(x)], lambda v, y: float(np.sqrt(((y - v) ** 2).sum())), True)}
    got = {(r.query_id, r.vec_id) for r in graph.nearest(df).collect()}
    assert len(got) == len(want) == 200
    assert len(got & want) >= 190


@pytest.mark.parametrize(("name", "factor", "offset", "spread"), [("far", 1.0, 1e4, 0.0), ("further", 1.0, 2e4, 0.0), ("large", 1e20, 0.0, 0.0), ("small", 1e-20, 0.0, 0.0), ("huge", 1e150, 0.0, 0.0), ("tight", 1.0, 0.0, 1e-4)])
def test_recall_does_not_hang_on_scale_and_place(spark, monkeypatch, name, factor, offset, spread):
    monkeypatch.setattr(graph, "SHARD", 700)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 16))
    if spread:
        x = rng.normal(size=(20, 16))[rng.integers(0, 20, 2000)] + spread * x
    x = (x + offset) * factor
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in graph.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 2000, 100):
        d = np.sqrt((((x - x[q]) / factor) ** 2).sum(1))
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hit >= 0.95 * 200, name


def test_stored_slices_and_too_large_components(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(-5000, 5000, (130, 5))
    values[:, 2] = 7
    slices = bitslice.Block.sliced(values)
    back = bitslice.Block.loaded(*bitslice.Block.stored(slices), len(values))
    assert [len(x) for x in back] == [len(x) for x in slices] and all((a == b).all() for x, y in zip(slices, back, strict=True) for a, b in zip(x, y, strict=True))
    df = spark.createDataFrame([(0, [1e16, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        bitslice.top_k(df)
