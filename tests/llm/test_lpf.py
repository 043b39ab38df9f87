import hashlib
import random

import numpy as np
import pytest

from lakesnap.llm import lpf


def brute(rows, span):
    seen, out = {}, []
    for d, t in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        raw = (t or "").encode()
        for k in range(len(raw) - span + 1):
            seen.setdefault(raw[k : k + span], (d, k))
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - span + 1 if d is not None else 0):
            if seen[raw[k : k + span]] < (d, k):
                gone[k : k + span] = b"\1" * span
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d if d is not None else -1, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, span):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choices("abcdeé \n", k=n))
    common, line = text(3 * span), text(span // 2) + "\n"
    rows = [(None, common), (None, None), (3, None), (4, ""), (5, "x" * (span - 1)), (6, "x" * (span + 1)), (7, "y" * 40 * span), (8, common), (8, common), (9, "ab" * 3 * span)]
    for k in range(60):
        parts = [text(rnd.randint(1, 3 * span))]
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randint(0, 2 * span)
            parts += [common[a : a + rnd.randint(span // 2, 2 * span)], text(rnd.randint(1, span)), line]
        rows.append((10 + k, "".join(parts)))
    rows += [(100 + k, rows[30][1]) for k in range(15)] + [(99, rows[30][1][5:-5])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "step"), [(lpf.HOT, lpf.STEP), (3, 700)])
def test_equals_brute_force(spark, monkeypatch, hot, step):
    monkeypatch.setattr(lpf, "HOT", hot)
    monkeypatch.setattr(lpf, "STEP", step)
    if hot == 3:
        monkeypatch.setattr(lpf, "OFTEN", 2)
        monkeypatch.setattr(lpf, "PART", 2)
    for seed, span in ((1, 100), (2, 24)):
        rows = corpus(seed, span)
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k int").repartition(3)
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lpf.repeats_removed(df, span).collect())
        assert got == brute(rows, span)
    assert lpf.repeats_removed(df.limit(0)).count() == 0


def test_previous_factors():
    rnd = random.Random(1)
    for trial in range(60):
        t = bytes(rnd.choices(b"ab" if trial % 2 else b"a", k=rnd.randint(0, 60)))
        n = len(t)
        want = [max([0, *(next((k for k in range(n - p + 1) if p + k == n or t[p + k] != t[q + k]), 0) for q in range(p))]) for p in range(n)]
        raw, starts = t + bytes(range(100, 164)), np.arange(n)  # what follows differs everywhere, so matches end where t does
        order, common = lpf.suffix_order(raw, starts, 64)
        assert [raw[s : s + 64] for s in order] == sorted(raw[s : s + 64] for s in starts)
        assert lpf.previous_factors(order, common, starts).tolist() == want
        for span in (3, 8, 11):
            got = lpf.previous_factors(*lpf.suffix_order(raw, starts, span), starts, span)
            assert [x >= span for x in got] == [x >= span for x in want]


def test_repeated_windows_of_repeated_rows():
    raw, starts = b"abcdabcdabcd", np.array([0, 4, 8])
    doc, at = np.array([1, 1, 2]), np.array([0, 0, 5])
    assert lpf.repeated_windows(raw, starts, doc, at, 4).tolist() == [False, False, True]
    assert lpf.repeated_windows(b"", starts[:0], doc[:0], at[:0], 4).tolist() == []
