"""Longest-previous-factor dedup: removes what also stands earlier in the corpus, and keeps the first.

Blocks of text are made so that every two equal strings of `span` bytes share one; within a block, windows of `span`
bytes are put in suffix order, and from the previous and the next smaller position in that order comes the longest match
of each one with anything earlier (`previous_factors`). Windows with a match of `span` bytes are removed.

* Every window has an anchor, the least-hashed of its GRAM-byte strings, which its bytes alone decide. Consecutive
  windows with one anchor form a *run*. Equal windows have equal anchor strings.
* Runs are dealt by anchor string. Of runs equal as a whole, only the first goes on; the others are removed: they are
  the later copies of a longer match, found by a hash of their content.
* Where different runs share an anchor string, their bytes go into a block, in position order.
* Anchor strings that very many texts share are spread by content as well, and those with more than HOT runs that differ
  are not brought together at all: their windows are aggregated by a 128-bit hash to their first position, which gives
  the same result. Which strings are spread is found on a part of the documents, and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesnap.llm.common import Steps, claim, small_batches

GRAM = 16
#: Runs of one anchor string that are brought together; bytes of a block; bytes that are hashed at a time; tasks at most.
HOT, BLOCK, STEP, MOST = 10_000, 2 << 20, 1 << 19, 100_000
#: Anchor strings that are spread at most: those met most often, OFTEN times at least, in one of PART documents.
HEAVY, OFTEN, PART = 1 << 16, 8, 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def suffix_order(raw: bytes, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of `span` bytes at starts in the order of their bytes, equal ones in the order given; and of each the
    number of bytes that it has in common with the one before it. Eight bytes at a time, only where windows still tie."""
    at = np.ndarray((len(raw) + 1,), ">u8", raw + b"\0" * 8, 0, (1,))
    order, common = np.arange(len(starts)), np.zeros(len(starts), np.int32)
    slot, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for k in range(0, span if len(starts) else 0, 8):
        k = max(0, min(k, span - 8))
        key = at[starts[order[slot]] + k].astype(np.uint64)
        if span < 8:
            key >>= np.uint64(64 - 8 * span)
        by = np.lexsort((key, group))  # stable, and groups are in order already
        order[slot], key = order[slot][by], key[by]
        same = group[1:] == group[:-1]
        x = key[1:] ^ key[:-1]
        tie, new = same & (x == 0), same & (x != 0)
        x = x[new]
        common[slot[1:][new]] = k + sum((x < np.uint64(1 << 8 * j)).astype(np.int32) for j in range(1, 8)) - (8 - min(8, span))
        keep = np.r_[False, tie] | np.r_[tie, False]
        slot, group, tied = slot[keep], np.r_[0, np.cumsum(~tie)][keep], np.r_[False, tie][keep]
        if not len(slot):
            return order, common
    if len(starts):
        common[slot[tied]] = span
    return order, common


def previous_factors(order: np.ndarray, common: np.ndarray, position: np.ndarray, wanted: int = 0) -> np.ndarray:
    """For each string the longest match with one of a smaller position, from suffix order: that with the nearest smaller
    position on either side. Matches shorter than `wanted` may come out as 0. All strings jump at once, each over what
    its candidate has jumped over, so there are about log n rounds."""
    out = np.zeros(len(order), np.int32)
    for p, length, to in ((position[order], common, order), (position[order][::-1], np.r_[common[1:], 0][::-1][: len(order)], order[::-1])):
        before, least = np.arange(len(p)) - 1, length.copy()
        least[before < 0] = 0
        before[least < max(wanted, 1)] = -1
        todo = np.flatnonzero(before >= 0)
        todo = todo[p[before[todo]] >= p[todo]]
        while len(todo):
            over = before[todo]
            least[todo] = np.minimum(least[todo], least[over])
            before[todo] = np.where(least[todo] < max(wanted, 1), -1, before[over])
            todo = todo[before[todo] >= 0]
            todo = todo[p[before[todo]] >= p[todo]]
        out[to] = np.maximum(out[to], np.where(before >= 0, least, 0))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def _loaded(raw: bytes, n: int) -> np.ndarray:
    """The 8 bytes at each of n positions as integers, first byte highest."""
    return np.ndarray((n,), ">u8", raw, 0, (1,)).astype(np.uint64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        _powers[n] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)], dtype=np.uint64) for x in (_B, inverse))
    return _powers[n]


def runs(raw: bytes, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (ends: their ends): first window, end of windows, anchor string hash and content hash of each run."""
    none = np.zeros(0, np.int64)
    n = len(raw) - span + 1
    if n <= 0:
        return none, none, none, none
    grams = len(raw) - GRAM + 1
    padded = raw + b"\0" * 8
    eight = _loaded(padded, len(raw))
    h = _mixed(eight[:grams] * _B + _mixed(eight[8 : 8 + grams]))
    low = np.uint64((1 << 22) - 1)
    m = (h & ~low) | np.arange(grams, dtype=np.uint64)
    width, left = 1, span - GRAM + 1
    while 2 * width <= left:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if left > width:
        m = np.minimum(m[: -(left - width)], m[left - width :])
    anchor = (m & low).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    valid = np.zeros(n + 1, np.int32)
    long = ends - starts >= span
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - span + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    first = np.zeros(n, bool)
    first[starts[long]] = True
    change = valid & (first | np.r_[True, anchor[1:] != anchor[:-1]])
    p0 = np.flatnonzero(change)
    if not len(p0):
        return none, none, none, none
    stop = np.flatnonzero(np.r_[valid[:-1] & ~valid[1:], valid[-1]])  # last windows of texts
    last = stop[np.searchsorted(stop, p0)] + 1
    p1 = np.minimum(np.r_[p0[1:], n], last)
    power, inverse = _power(max(STEP + (1 << 16), 1 << int(grams).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(h * power[:grams], dtype=np.uint64)]
    content = _mixed((total[p1 + span - GRAM] - total[p0]) * inverse[p0] + (p1 - p0).astype(np.uint64))
    return p0, p1, h[anchor[p0]].view(np.int64), content.view(np.int64)


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals, joined where they touch or overlap."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.r_[True, a[1:] > b[:-1]] if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return a[at], b[np.r_[at[1:] - 1, len(b) - 1]] if len(at) else b


def _pieces(pdf: pd.DataFrame, span: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents in id order, long ones in overlapping parts, about STEP bytes at a time: ids, offsets, bytes."""
    ids, offsets, raw, held = [], [], [], 0
    for doc, text in sorted(zip(pdf.doc_id.tolist(), pdf.text, strict=True), key=lambda r: r[0]):
        data = (text or "").encode("utf-8", "surrogatepass")
        for k in range(0, max(1, len(data) - span + 1), STEP):
            part = data[k : k + STEP + span - 1]
            ids.append(doc)
            offsets.append(k)
            raw.append(part)
            held += len(part)
            if held >= STEP:
                yield ids, offsets, raw
                ids, offsets, raw, held = [], [], [], 0
    if ids:
        yield ids, offsets, raw


def found_runs(docs: DataFrame, span: int, heavy: np.ndarray) -> DataFrame:
    """kind, k, c, doc_id, p0, p1: the distinct runs of each part of the input (kind 0, or 2 for those of heavy: anchor
    string k, content c), and the byte intervals that a part's own earlier text removes (kind 1; k spreads them)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(heavy))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lpf")
        often = shared.value
        for pdf in batches:
            for ids, offsets, raw in _pieces(pdf, span):
                ends = np.cumsum([len(x) for x in raw])
                p0, p1, k, c = runs(b"".join(raw), ends, span)
                if not len(p0):
                    continue
                at = np.searchsorted(ends, p0, "right")
                doc = np.array(ids, np.int64)[at]
                shift = np.array(offsets, np.int64)[at] - np.r_[0, ends[:-1]][at]
                a, b = p0 + shift, p1 + shift
                order = np.lexsort((a, doc, c, k))
                same = np.r_[False, (k[order][1:] == k[order][:-1]) & (c[order][1:] == c[order][:-1])]
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                later = (doc[order] != doc[order[head]]) | (a[order] != a[order[head]])
                keep, gone = order[~same], order[same & later]
                kind = 2 * np.isin(k[keep], often).astype(np.int8)
                yield pd.DataFrame({"kind": kind, "k": k[keep], "c": c[keep], "doc_id": doc[keep], "p0": a[keep], "p1": b[keep]})
                if len(gone):
                    # intervals of one document, joined
                    _, row = np.unique(doc[gone], return_inverse=True)
                    wide = np.int64(1) << np.int64(40)
                    x, y = _merged(a[gone] + row * wide, b[gone] + span - 1 + row * wide)
                    d = np.unique(doc[gone])[x // wide]
                    x, y = x % wide, y % wide
                    yield pd.DataFrame({"kind": np.int8(1), "k": _mixed((d * 31 + x).view(np.uint64)).view(np.int64), "c": np.int64(0), "doc_id": d, "p0": x, "p1": y})

    return docs.where("doc_id is not null and octet_length(text) >= %d" % span).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "kind byte, k long, c long, doc_id long, p0 long, p1 long")


def heavy_anchors(docs: DataFrame, span: int) -> np.ndarray:
    """Anchor strings that many texts share, from one of PART documents: a few numbers, and a matter of speed alone."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0)
    often = found_runs(some, span, np.zeros(0, np.int64)).where("kind = 0").groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return often.orderBy(F.desc("n"), "k").limit(HEAVY).select("k").toArrow()["k"].to_numpy()


def repeated_windows(raw: bytes, starts: np.ndarray, doc: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Which of the windows of `span` bytes at starts (positions doc, at) have an earlier equal."""
    if not len(starts):
        return np.zeros(0, bool)
    position = np.arange(len(starts))
    if not ((doc[1:] > doc[:-1]) | ((doc[1:] == doc[:-1]) & (at[1:] > at[:-1]))).all():  # rows of one doc_id
        by = np.lexsort((at, doc))
        position[by] = np.r_[0, np.cumsum((np.diff(doc[by]) != 0) | (np.diff(at[by]) != 0))]
    return previous_factors(*suffix_order(raw, starts, span), position, span) >= span


def _windows(pdf: pd.DataFrame, span: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes laid end to end, start of each window in them, its document and its position there."""
    size = pdf.bytes.map(len).to_numpy(np.int64)
    n = size - span + 1
    base = np.cumsum(size) - size
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return b"".join(pdf.bytes), np.repeat(base, n) + inner, np.repeat(pdf.doc_id.to_numpy(np.int64), n), np.repeat(pdf.p0.to_numpy(np.int64), n) + inner


def _intervals(doc: np.ndarray, at: np.ndarray, span: int) -> pd.DataFrame:
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + span)] if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:] - 1, len(at) - 1] if len(head) else head
    return pd.DataFrame({"doc_id": doc[head], "p0": at[head], "p1": at[tail] + span})


def removed(docs: DataFrame, span: int, steps: Steps) -> DataFrame:
    """doc_id, p0, p1: byte intervals, possibly overlapping, covered by a string of `span` bytes that also starts earlier."""
    every = found_runs(docs, span, heavy_anchors(docs, span))
    # one shuffle serves both windows: by anchor string, and for those that many texts share by content too
    every = every.withColumn("part", F.when(F.col("kind") == 2, F.col("c")).otherwise(F.lit(0)))
    same, anchor = Window.partitionBy("kind", "k", "part", "c").orderBy("doc_id", "p0"), Window.partitionBy("kind", "k", "part")
    every = every.withColumn("first", F.first(F.struct("doc_id", "p0")).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    every = every.withColumn("later", (F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.p0") != F.col("p0"))).drop("first")
    every = every.withColumn("mixed", (F.min("c").over(anchor) != F.max("c").over(anchor)) | (F.col("kind") == 2))
    what = F.when(F.col("kind") == 1, 1).when(F.col("later"), 2).when(F.col("mixed"), 3)
    every = steps.written(every.select(what.alias("what"), "k", "doc_id", "p0", "p1").where("what is not null"), "runs")
    whole = every.where("what < 3").select("doc_id", "p0", F.when(F.col("what") == 1, F.col("p1")).otherwise(F.col("p1") + (span - 1)).alias("p1"))

    open_runs = every.where("what = 3")
    hot = steps.written(open_runs.groupBy("k").count().where(F.col("count") > HOT).select("k", F.lit(True).alias("hot")), "hot")
    marked = open_runs.join(hot, "k", "left")  # few: a hot string takes HOT runs
    per_doc = marked.groupBy("doc_id").agg(F.collect_list(F.struct("k", "p0", "p1", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lpf")
        for pdf in batches:
            out = []
            for doc, text, own in zip(pdf.doc_id, pdf.text, pdf.runs, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(r["k"], r["hot"], doc, r["p0"], data[r["p0"] : r["p1"] + span - 1]) for r in own if r["p1"] + span - 1 <= len(data)]
            if out:
                yield pd.DataFrame(out, columns=["k", "hot", "doc_id", "p0", "bytes"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(per_doc, "doc_id")
    bodies = steps.written(texts.mapInPandas(cut, "k long, hot boolean, doc_id long, p0 long, bytes binary"), "bodies")
    size = bodies.where("not hot").agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        raw, starts, doc, at = _windows(pdf.sort_values(["doc_id", "p0"]), span)
        hit = repeated_windows(raw, starts, doc, at, span)
        return _intervals(doc[hit], at[hit], span)

    dealt = bodies.where("not hot").withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks))).repartition(min(blocks, MOST), "block")
    cold = dealt.groupBy("block").applyInPandas(in_block, "doc_id long, p0 long, p1 long")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lpf")
        for pdf in batches:
            raw, starts, doc, at = _windows(pdf, span)
            h = [xxhash.xxh3_128_digest(raw[s : s + span]) for s in starts.tolist()]
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"x": both[:, 0], "y": both[:, 1], "doc_id": doc, "p0": at})

    windows = bodies.where("hot").mapInPandas(hashed, "x long, y long, doc_id long, p0 long")
    first = windows.groupBy("x", "y").agg(F.min(F.struct("doc_id", "p0")).alias("first"))
    warm = windows.join(first, ["x", "y"]).where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.p0") != F.col("p0"))).select("doc_id", "p0", (F.col("p0") + span).alias("p1"))
    return whole.unionByName(cold).unionByName(warm)


def cut_out(text: str | None, intervals: list | None) -> tuple[int, int, int, bytes]:
    """n_bytes, n_removed, n_spans and the bytes that are left."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if intervals is None or not len(intervals):
        return len(data), 0, 0, data
    a, b = _merged(np.array([r["p0"] for r in intervals], np.int64), np.minimum(np.array([r["p1"] for r in intervals], np.int64), len(data)))
    kept = b"".join(data[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
    return len(data), len(data) - len(kept), len(a), kept


def repeats_removed(docs: DataFrame, span: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for each row of docs.

    A byte goes if a string of `span` bytes over it also starts earlier: at a smaller doc_id, or earlier in the same
    document. Null texts count as empty. Rows with a null doc_id take no part and stay whole. Rows that repeat a doc_id
    and its text are one document and get one result; should the texts of a doc_id differ, what is removed from either
    is removed from both, by position. Columns other than doc_id and text are not read."""
    small_batches(docs.sparkSession)
    with Steps(docs.sparkSession) as steps:
        gone = removed(docs, span, steps).groupBy("doc_id").agg(F.collect_list(F.struct("p0", "p1")).alias("gone"))  # as long as its document
        gone = steps.result(gone, "removed")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("lpf")
        for pdf in batches:
            out = [cut_out(t, g) for t, g in zip(pdf.text, pdf.gone, strict=True)]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "n_bytes": [r[0] for r in out], "n_removed": [r[1] for r in out], "n_spans": [r[2] for r in out], "kept_sha256": [hashlib.sha256(r[3]).hexdigest() for r in out], "kept": [r[3] for r in out]})

    joined = docs.select("doc_id", "text").join(gone, "doc_id", "left")
    return joined.mapInPandas(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
