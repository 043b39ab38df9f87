import random
import time

import numpy as np

from lakesnap.llm import toxicity as T


def distance(a, b):
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(d[j] + (x != y), d[j + 1] + 1, new[j] + 1))
        d = np.array(new)
    return d[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(1)
    terms = {"".join(rnd.choices("abc", k=rnd.randint(3, 8))): 1.0 for _ in range(40)}
    lexicon = T.Lexicon(terms, {"zzz": 2.0})
    for _ in range(4000):
        w = "".join(rnd.choices("abcz", k=rnd.randint(1, 10)))
        got = lexicon.find(w)
        if w in terms:
            assert got == ("exact", w)
        elif w.startswith("zzz"):
            assert got == ("stem", "zzz")
        else:
            near = [t for t in terms if len(t) >= T.FUZZY_FROM and len(w) >= T.FUZZY_FROM and distance(w, t) <= 1]
            assert (got is not None) == bool(near), (w, got, near)
            assert got is None or got[1] in near


def test_context():
    lexicon = T.Lexicon({"idiot": 3.0, "moron": 3.0}, {})
    plain, quoted, far = (dict(zip(T.FEATURES, T.features(lexicon, t), strict=True)) for t in ("you idiot, you moron", 'she said he was called "idiot" once', "idiot " + "x " * 50 + "moron"))
    assert plain["company"] > far["company"] == 0 and plain["quoted"] == 0 and quoted["quoted"] == 1
    assert T.features(lexicon, "an idoit and an idiott")[T.FEATURES.index("fuzzy")] > 0
    assert not any(T.features(lexicon, None) + T.features(lexicon, "") + T.features(lexicon, "fine words"))


def corpus():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(300)]
    bad = ["nastyword", "vileterm", "grossness"]
    rows, labels = [], []
    for k in range(1500):
        text = rnd.choices(words, k=60)
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                text[rnd.randrange(60)] = rnd.choice(bad) if rnd.random() < 0.8 else rnd.choice(bad)[:-1] + "x"
        rows.append((k, " ".join(text), "lang", 0.0))
        labels.append((k, 1, int(toxic)))
    rows += [(5000, None, "x", 0.0), (5001, "", "x", 0.0), (None, "words", "x", 0.0), (5002, "long " * 100_000, "x", 0.0)]
    return rows, [*labels, (None, 1, 1), (7000, 1, None)]


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = T.toxicity(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert len(held) > 200 and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.98
    empty = T.toxicity(docs, known.limit(0)).collect()
    assert len({r.score for r in empty}) == 1 and T.toxicity(docs.limit(0), known).count() == 0


def test_long_words_take_linear_time_and_stay_out_of_the_memo():
    lexicon = T.Lexicon({"idiot": 3.0}, {"mor": 3.0})
    for text in ("x" * 5_000_000, "mor" + "y" * 5_000_000, "idiot" * 1_000_000, "nö" * 2_000_000):
        began = time.process_time()
        T.features(lexicon, text)
        assert time.process_time() - began < 10
    assert lexicon.find("mor" + "y" * 1000) == ("stem", "mor") and lexicon.find("idiots" * 1000) is None
    assert all(len(w) <= T.LONG for w in lexicon.looked_up)


def test_repeated_and_tied_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows[:600] + rows[:3] + [(0, "other words", "x", 0.0)], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame([*labels[:600], (1, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = T.toxicity(docs, known).collect()
    by_text = {}
    for r, row in zip(got, docs.collect(), strict=True):
        assert by_text.setdefault(row.text, r.score) == r.score
    assert len(got) == 604
