import random

import numpy as np
import pytest

from lakesnap.llm import mixing


def test_targets():
    got = mixing.targets([("b", 100), ("a", 1000), (None, 10), ("c", 0)])
    assert got[None] == 20 and got["c"] == 0  # capped
    assert got["a"] + got["b"] + got[None] + got["c"] == pytest.approx(1.5 * 1110)
    assert got["b"] == 200 and got["a"] == pytest.approx(1665 - 220)
    even = mixing.targets([("a", 1000), ("b", 1000), ("c", 1000)])
    assert [even[k] for k in "abc"] == pytest.approx([2000, 2500 / 3, 5000 / 3])  # 2250 is cut to 2000; 250 goes 1 : 2
    assert mixing.targets([]) == {}


def test_split_has_exact_quotas():
    rng = np.random.default_rng(1)
    for shards in (1, 2, 7, 64):
        q = rng.integers(0, 300, 9)
        parts = mixing.split(q, shards, 5)
        assert len(parts) == shards and (sum(parts) == q).all() and all((p >= 0).all() for p in parts)
        sizes = [int(p.sum()) for p in parts]
        assert max(sizes) - min(sizes) <= 1 + shards.bit_length()
        assert all((a == b).all() for a, b in zip(parts, mixing.split(q, shards, 5), strict=True))


def rows():
    rnd = random.Random(2)
    out = [(1, None, "a", 0), (2, "", "a", 0), (3, " \n ", None, 0), (None, "x y", "b", 0), (4, "w " * 30_000, "hot", 0)]
    out += [(5, "same text here", "b", 0)] * 40
    out += [(10 + k, "w " * rnd.randint(1, 200), "hot" if k % 3 else rnd.choice(["a", "b", "ä", "empty", None]), 0) for k in range(3000)]
    return out + [(9999, None, "none", 0)]


def test_takes_what_targets_say(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix_report(df, shards=8).collect()
    assert len(got) == len(rows())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_report(df.repartition(5), shards=8).collect()))
    size = {}
    for d, t, s, _ in rows():
        size[s] = size.get(s, 0) + len((t or "").split())
    want = mixing.targets(list(size.items()))
    taken = {}
    by_id = {}
    for d, _, s, _ in rows():
        by_id.setdefault(d, s)
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s]) and r.taken in (0, r["size"], 2 * r["size"]) and len(r.shards) <= 2
        taken[s] = taken.get(s, 0) + r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]), s
    mixed = mixing.mix(df, shards=8)
    assert mixed.columns[:4] == df.columns and mixed.count() == sum(len(r.shards) for r in got)
    per_shard = [r[1] for r in mixed.groupBy("__shard").count().collect()]
    assert len(per_shard) == 8 and max(per_shard) < 2 * min(per_shard)


def test_shards_on_disk_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    assert mixing.mix_report(df.limit(0)).count() == 0
    mixing.write_mix(df, str(tmp_path / "mix"), shards=4)
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mixing.mix(df, shards=4).count()


def test_shards_are_in_the_order_of_their_places(spark):
    import corpus_pipeline

    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int").repartition(3)
    report = mixing.mix_report(df).select("doc_id", "shards", "places").collect()
    at = [(s, p, r.doc_id) for r in report for s, p in zip(r.shards, r.places, strict=True)]
    mixed = mixing.mix(df).select("__shard", "__place", "doc_id").collect()
    assert sorted(at, key=repr) == sorted(map(tuple, mixed), key=repr)
    assert len({p for _, p, _ in at}) > 0.9 * len(at)
    order = lambda x: (x[0], x[1])
    got = corpus_pipeline.mixing(spark, df, "").rdd.glom().map(lambda part: [r.doc_id for r in part]).collect()
    assert sum(map(len, got)) == len(at)
    shards_of = {}
    for s, _, d in at:
        shards_of.setdefault(d, set()).add(s)
    want = {}
    for s, p, d in sorted(at, key=order):
        want.setdefault(s, []).append(d)
    for part in got:  # whole shards, one after the other
        while part:
            s = next(s for s in sorted(want) if s in shards_of[part[0]] and part[: len(want[s])] == want[s])
            part = part[len(want.pop(s)) :]
    assert not want
