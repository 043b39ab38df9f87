"""Token-id files: Re-Pair grammars per shard, with random access.

The file set is a Parquet table with a row per shard: `part`, `shard`, `start` (ids before it within its part),
`n_docs`, `n_tokens` and a binary `payload`. A payload holds, little-endian, one after the other:

* 8 unsigned 32-bit integers: magic, base (ids below it are terminals), rules, documents, ids, symbols, bytes a symbol,
  1 if document ids are present for all
* rules x 2 unsigned 32-bit integers: the pair that nonterminal base + k stands for
* rules unsigned 32-bit integers: the ids that it expands to
* documents 64-bit integers: doc_id (the least integer: null)
* documents unsigned 32-bit integers: ids of the document
* documents unsigned 32-bit integers: symbols of the document
* the symbols

No pair reaches across the end of a document, so a document is a run of symbols, and any run of ids inside a shard is
found from the expansion lengths without decoding what lies before it.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesnap.llm.bpe import BYTE_PATTERN, byte_symbols
from lakesnap.llm.common import partitions, scratch

MAGIC = 0x52504731
NULL_ID = np.iinfo(np.int64).min
#: A shard is closed when it has this many ids (documents stay whole).
SHARD_TOKENS = 1 << 20
ROUNDS, RULES_A_ROUND, LEAST = 8, 1024, 16


def grammar(ids: np.ndarray, lengths: np.ndarray, base: int, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one shard: in each round, the a_round most frequent pairs get a nonterminal each, until no pair
    occurs `least` times or `rounds` are over. -> rules (n x 2), symbols, symbols of each document."""
    narrow = base + rounds * a_round <= 1 << 16
    seq = ids.astype(np.uint16 if narrow else np.uint32)
    wide, half = (np.uint32, np.uint32(16)) if narrow else (np.uint64, np.uint64(32))
    factor, down = (np.uint32(2654435769), np.uint32(32 - 18)) if narrow else (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - 18))
    ends = np.zeros(len(seq), bool)  # last symbols of documents
    ends[np.cumsum(lengths, dtype=np.int64)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    n, bits = base, 18
    for _ in range(rounds):
        if len(seq) < 2:
            break
        every = seq[:-1].astype(wide)
        every <<= half
        every |= seq[1:]
        bucket = ((every * factor) >> down).astype(np.intp)
        bucket[ends[:-1]] = 1 << bits  # no pair
        counts = np.bincount(bucket, minlength=(1 << bits) + 1)
        counts[-1] = 0
        # the buckets that hold the a_round most frequent pairs, at least
        above = np.cumsum(np.bincount(np.minimum(counts, 1 << 16))[::-1])[::-1]
        often = int(np.searchsorted(-above, -a_round, "right")) - 1
        at = np.flatnonzero((counts >= max(often, least))[bucket])
        keys = every[at]
        pairs, count = np.unique(keys, return_counts=True)
        pairs, count = pairs[count >= least], count[count >= least]
        pairs = np.sort(pairs[np.lexsort((pairs, -count))[:a_round]])
        if not len(pairs):
            break
        rule = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        hit = pairs[rule] == keys
        at, rule = at[hit], rule[hit]
        # of pairs that overlap in a row, every other one from the left
        first = np.r_[True, at[1:] != at[:-1] + 1]
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0
        at, rule = at[take], rule[take]
        seq[at] = n + rule
        ends[at] = ends[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, ends = seq[keep], ends[keep]
        rules.append(np.stack([pairs >> half, pairs & ((wide(1) << half) - wide(1))], 1).astype(np.uint32))
        n += len(pairs)
    per_doc = np.zeros(len(lengths), np.uint32)
    per_doc[lengths > 0] = np.diff(np.r_[0, np.flatnonzero(ends) + 1])
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq, per_doc


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    size = np.ones(base + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        size[base + k] = size[a] + size[b]
    return size[base:]


def pack(doc_ids: np.ndarray, ids: np.ndarray, lengths: np.ndarray, base: int) -> bytes:
    rules, symbols, per_doc = grammar(ids, lengths, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = np.array([MAGIC, base, len(rules), len(lengths), len(ids), len(symbols), width, 1], "<u4")
    parts = [head, rules.astype("<u4"), expansions(rules, base).astype("<u4"), doc_ids.astype("<i8"), lengths.astype("<u4"), per_doc.astype("<u4"), symbols.astype(f"<u{width}")]
    return b"".join(x.tobytes() for x in parts)


@functools.cache
def _terminals(base: int) -> list[bytes]:
    return [i.to_bytes(4, "little") for i in range(base)]


class Shard:
    """A payload, opened; nothing is decoded before it is asked for."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, "<u4", 8)
        if head[0] != MAGIC:
            raise ValueError("not a token shard")
        _, self.base, n_rules, n_docs, self.n_tokens, n_symbols, width, _ = map(int, head)
        at = 32

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.rules = part("<u4", 2 * n_rules).reshape(-1, 2)
        self.size = part("<u4", n_rules)
        self.doc_ids, self.lengths, self.per_doc = part("<i8", n_docs), part("<u4", n_docs), part("<u4", n_docs)
        self.symbols = part(f"<u{width}", n_symbols)
        self._flat = None

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._flat is None:
            size = np.r_[np.ones(self.base, np.int64), self.size]
            where = np.r_[0, np.cumsum(size)]
            terms = list(_terminals(self.base))
            for a, b in self.rules.tolist():
                terms.append(terms[a] + terms[b])
            flat = np.frombuffer(b"".join(terms), "<u4")
            self._flat = flat, where[:-1], size
        return self._flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, where, size = self._table()
        n = size[symbols]
        ends = np.cumsum(n)
        return flat[np.repeat(where[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        end = int(self.per_doc[: k + 1].sum())
        return self._expand(self.symbols[end - int(self.per_doc[k]) : end])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only symbols that reach into them are expanded."""
        _, _, size = self._table()
        ends = np.cumsum(size[self.symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.symbols[a:b])[start - before : stop - before]


class Vocabulary:
    """Ids of whole texts as the tokenizers library gives them. The merges run in tiktoken, built from the same
    vocabulary (a byte-level vocabulary's ids are its ranks); texts that hold a special token go to the library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.base = self.lib.get_vocab_size(with_added_tokens=True)
        self.special = tuple(x.content for x in self.lib.get_added_tokens_decoder().values())
        of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(of[c] for c in t): i for t, i in self.lib.get_vocab().items() if t not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if any(x in text for x in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One for each vocabulary file and worker process."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all texts, end_id after each, in ascending doc_id order (null first; rows of one doc_id by the
    hash of their text), as token shards under path. One range shuffle of the texts; a task holds one shard."""
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = vocabulary_of(vocabulary), np.array([end_id], "<u4").tobytes()
        part, shard, start, own, ids = 0, 0, 0, [], []

        def closed() -> pd.DataFrame:
            nonlocal shard, start, own, ids
            lengths = np.array([len(x) // 4 for x in ids], np.uint32)
            payload = pack(np.array(own, np.int64), np.frombuffer(b"".join(ids), "<u4"), lengths, words.base)
            out = pd.DataFrame({"part": [part], "shard": [shard], "start": [start], "n_docs": [len(own)], "n_tokens": [int(lengths.sum())], "payload": [payload]})
            shard, start, own, ids = shard + 1, start + int(lengths.sum()), [], []
            return out

        held = 0
        for pdf in batches:
            part = int(pdf.part.iloc[0]) if len(pdf) else part
            for doc, text in zip(pdf.doc_id.tolist(), pdf.text, strict=True):
                x = words.encode(text or "")
                own.append(doc)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= shard_tokens:
                    yield closed()
                    held = 0
        if own:
            yield closed()

    rows.select(F.coalesce("doc_id", F.lit(int(NULL_ID))).alias("doc_id"), "text", F.spark_partition_id().alias("part")).mapInPandas(
        shards, "part int, shard int, start long, n_docs long, n_tokens long, payload binary"
    ).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from token shards."""
    table = spark.read.parquet(path)
    # one number for each part, of which there are as many as the writer had shuffle partitions
    sizes = dict(table.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, starts = 0, {}
    for p in sorted(sizes):
        starts[p] = before
        before += sizes[p]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, start, payload in zip(pdf.part, pdf.start, pdf.payload, strict=True):
                s = Shard(payload)
                ids = memoryview(s.all().astype("<u4")).cast("B")
                ends = np.cumsum(s.lengths, dtype=np.int64)
                at = ends - s.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
                doc = pd.array(s.doc_ids, dtype="Int64")
                doc[s.doc_ids == NULL_ID] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": at + start + starts[part], "n_tokens": s.lengths.astype(np.int64), "ids_crc32": crc})

    return table.select("part", "start", "payload").mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token files of docs into the shared folder and reads them back: a row per row of docs. Null texts
    count as empty (their only id is the end id); an empty table gives no rows."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, vocabulary)
    return read_tokens(spark, path)
