import random

import numpy as np

from lakesnap.llm import minhash
from lakesnap.llm.components import components


def brute(rows, size, percent):
    def own(text):
        ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        return {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())

    sets = [own(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted((d if d is not None else -1, len(s), least.get(root(k), -1)) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    common = [word() for _ in range(40)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Two words"), (1004, "two  WORDS"), (1005, "tWo"), (None, "x y z w v"), (1006, "x y z w v"), (1007, "Ä b c d e"), (1008, "ä b c d e")]
    for k in range(30):
        base = [word() for _ in range(rnd.randint(5, 200))]
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                own[rnd.randrange(len(own))] = word()
            if k % 3 == 0:
                own += common
            rows.append((rnd.randrange(10**6) * 2 + 2000, (" " if k % 2 else "\n").join(own)))
    rows += [(500 + k, rows[20][1]) for k in range(20)]
    long = [word() for _ in range(20_000)]
    rows += [(7, " ".join(long)), (5, " ".join([*long[:-300], "end"]))]
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed, size in ((1, 4), (2, 5)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int").repartition(3)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in minhash.near_duplicates(df, size).collect())
        assert got == brute(rows, size, 80)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_exact_and_nothing_left_behind(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables = {t.name for t in spark.catalog.listTables()}
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in minhash.near_duplicates(df, 4, exact=True).collect())
    assert got == brute(rows, 4, 80)
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_heavy_values_are_posted_last(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY", 64)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in minhash.near_duplicates(df, 4).collect())
    assert got == brute(rows, 4, 80)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 1)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in minhash.near_duplicates(df, 4).collect())
    assert got == brute(rows, 4, 80)


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(1).permutation(200)
    edges = [(int(a), int(b)) for a, b in zip(order, order[1:], strict=False)] + [(300, 301), (302, 300), (400, 400)]
    got = dict((r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{int(k): 0 for k in order}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
