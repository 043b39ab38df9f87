"""Ids against the library over all code points, and the bounds of the transducer."""

import random
import sys
import tracemalloc
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakesnap.llm import bpe, repair

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
EVERY = [chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000] + [chr(k) for k in range(0x30000, sys.maxunicode + 1, 997)]
MARKS = [c for c in EVERY if unicodedata.combining(c)]


def encoders(name):
    path = public_tokenizers.path(name)
    own = bpe.encoder(path)
    yield "transducer", lambda x: np.frombuffer(own.encode(x), "<u4").tolist()
    if name.startswith("byte"):
        fast = repair.Vocabulary(path)
        yield "token files", lambda x: np.frombuffer(fast.encode(x), "<u4").tolist()


def differ(name, texts):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids for k in range(0, len(texts), 20_000) for x in lib.encode_batch(texts[k : k + 20_000], add_special_tokens=False)]
    return [(kind, x) for kind, f in encoders(name) for x, ids in zip(texts, want, strict=True) if f(x) != ids]


@pytest.mark.parametrize("name", NAMES)
def test_every_code_point(name):
    assert differ(name, [f"a{c}b" for c in EVERY]) == []
    assert differ(name, [f"{c}{c} x{c}" for c in EVERY]) == []


@pytest.mark.parametrize("name", NAMES)
def test_pairs_with_combining_marks_and_random_texts(name):
    rnd = random.Random(7)
    bases = [c for c in EVERY if unicodedata.category(c)[0] in "LNMSP"]
    pairs = [f"{rnd.choice(bases)}{m}{rnd.choice(MARKS)}{m} {m}" for m in MARKS for _ in range(20)]
    pairs += ["".join(rnd.choices(MARKS, k=rnd.randint(2, 6))) for _ in range(20_000)]
    parts = [*" \t\n'", "'s", "'LL", "  ", "\x1c", "\x85", " ", "​", "ſ", "K", "İ", "Σ", "<|endoftext|>", "the", "12", "…"]
    texts = ["".join(rnd.choice(parts) if rnd.random() < 0.5 else rnd.choice(bases) for _ in range(rnd.randint(1, 25))) for _ in range(30_000)]
    assert differ(name, pairs + texts) == []


def test_merges_of_the_byte_vocabulary_are_in_the_order_of_their_ids():
    """What merging by id, as the token files do, rests on."""
    t = bpe.encoder(public_tokenizers.path(NAMES[1])).transducer
    made = [t.ids[a + b] for (a, b), _ in sorted(t.rank.items(), key=lambda x: x[1])]
    assert made == sorted(made) and len(set(made)) == len(made)
    assert all(t.made[a + b][0] == r for (a, b), r in t.rank.items())


def test_lookahead_bounds_what_may_change():
    rnd, closest = random.Random(1), 0.0
    for trial in range(150):
        alphabet = "ab" if trial % 3 else "abc"
        tokens, merges = list(alphabet), []
        for _ in range(rnd.randint(1, 14)):
            a, b = rnd.choice(tokens), rnd.choice(tokens)
            if len(a + b) <= 6 and a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        t = bpe.Transducer({x: i for i, x in enumerate(tokens)}, merges)
        for _ in range(10):
            s = "".join(rnd.choices(alphabet, k=60)) if rnd.random() < 0.5 else ((rnd.choice(tokens) + rnd.choice(tokens)) * 30)[:60]
            whole = np.cumsum([len(x) for x in t.plain(s)]).tolist()
            for k in range(1, len(s)):
                ends = np.cumsum([len(x) for x in t.plain(s[:k])]).tolist()
                stable = max([0, *(e for n, e in enumerate(ends) if ends[: n + 1] == whole[: n + 1])])
                assert k - stable <= t.lookahead, (merges, s, k)
                closest = max(closest, (k - stable) / t.lookahead)
    assert closest > 0.4  # the bound means something


@pytest.mark.parametrize("name", NAMES)
def test_a_very_long_word_is_streamed(name):
    rnd = random.Random(2)
    word = "".join(rnd.choices("abcdefgh", k=5_000_000))
    own, n, most = bpe.encoder(public_tokenizers.path(name)), 0, 0
    assert own.transducer.lookahead < 1000
    list(own.transducer.encode(word[:1_000_000]))  # automaton and memo are filled
    tracemalloc.start()
    for _ in own.transducer.encode(word[:1_000_000]):
        n += 1
        if not n % 10_000:
            most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert most < 4 << 20 < n * 40  # what a list of the tokens would take
    ids = own.encode(word)
    assert ids == np.array(Tokenizer.from_file(public_tokenizers.path(name)).encode(word, add_special_tokens=False).ids, "<u4").tobytes()
