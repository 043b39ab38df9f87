import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakesnap.llm import bpe

PARTS = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "é", "é", "Σ", "ς", "İ", "ß", "1", "²", "½", "Ⅷ", "'", "'s", "!!", "...", "<|endoftext|>", "<|startoftext|>", "日本", "\U0001f600", "\x1c", "\x85", "\xa0", "​", "_", "-", "ﬁ", "ab" * 40, "=" * 70, "\r\n", "\x00"]


def texts():
    rnd = random.Random(3)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, 20))) for _ in range(500)] + ["", "a" * 5000, "ab" * 2000, "-" * 3000, " " * 500 + "a"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_text_equal_the_library(name):
    path = public_tokenizers.path(name)
    lib, own = Tokenizer.from_file(path), bpe.encoder(path)
    for x in texts():
        ids = lib.encode(x, add_special_tokens=False).ids
        got = memoryview(own.encode(x)).cast("I").tolist()
        assert got == ids, x
        d = own.decoder()
        assert "".join(d.feed([i]) for i in got) + d.end() == lib.decode(ids, skip_special_tokens=False)


def test_transducer_equals_merging_by_rank_and_emits_early():
    rnd = random.Random(5)
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "ab"), ("ba", "ab"), ("b", "b")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(x + y for x, y in merges)])}
    t = bpe.Transducer(vocab, merges)
    for _ in range(2000):
        s = "".join(rnd.choices("ab", k=rnd.randint(1, 40)))
        assert list(t.encode(s)) == t.plain(s), s
    read = []
    stream = t.encode(read.append(c) or c for c in "ab" * 10_000)
    next(stream)
    assert len(read) < 200


def test_query_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "Hello wörld", 5), (2, None, 5), (3, "", None), (3, "", None), (None, "x " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = [tuple(r) for r in bpe.bpe_round_trip(df, path).collect()]
    lib = Tokenizer.from_file(path)
    for (doc, text, _), r in zip(rows, got, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert r == (doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.bpe_round_trip(df.limit(0), path).count() == 0
    both = spark.createDataFrame([("a  b",), (None,)], "text string")
    byte = public_tokenizers.path("byte_bpe_50k.json")
    back = both.select(bpe.encode_column(both.text, byte).alias("i")).select(bpe.decode_column("i", byte).alias("t")).collect()
    assert [r.t for r in back] == ["a  b", ""]
