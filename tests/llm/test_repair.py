import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lakesnap.llm import repair


def test_grammar_round_trip_and_random_access():
    rnd = np.random.default_rng(1)
    words = [rnd.integers(0, 300, rnd.integers(1, 8)) for _ in range(50)]
    docs = [np.concatenate([words[k] for k in rnd.integers(0, 50, n)]) if n else np.zeros(0, int) for n in (500, 0, 1, 2000, 0, 3000)] + [np.full(4001, 7)]
    ids, lengths = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs], np.uint32)
    payload = repair.pack(np.arange(len(docs)), ids, lengths, 300)
    assert len(payload) < 4 * len(ids) / 2
    s = repair.Shard(payload)
    assert (s.all() == ids).all()
    for k, d in enumerate(docs):
        assert (s.document(k) == d).all()
    for a, b in [(0, 0), (0, 1), (5, 777), (499, 502), (len(ids) - 3, len(ids)), (0, len(ids))]:
        assert (s.ids(a, b) == ids[a:b]).all()


def test_files_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(9, "a  b   c \n\n  d ", 1), (2, None, 1), (7, "", 1), (7, "", 1), (None, "x", 1), (5, "word !" * 20_000, 1), (3, "<|endoftext|> end", 1)] + [(k, f"some text {k}\t\n it's  {k * k} ", 0) for k in range(10, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in repair.token_files(df, path).collect()), key=lambda r: r[1])
    start = 0
    for (doc, text, _), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        assert r == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert repair.token_files(df.limit(0), path).count() == 0
