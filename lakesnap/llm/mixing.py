"""Mixing sources to target weights: whole documents, dealt out to shards by a multivariate-hypergeometric tree.

A source's documents fall into blocks by a hash, so block order is a random permutation. The driver sees only block
sizes (at most BLOCKS of them beside one for each source, of which there may be MAX_SOURCES). It turns each source's target into so many whole passes
over all blocks and a last pass over the first few; the one block in which that pass ends is decided document by
document. Blocks are then dealt to output shards: the tree halves the shards again and again, and draws how many
blocks of each source the left half gets, so that every shard is a random sample of the mix with exact quotas.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesnap.llm.common import Steps, unused, words, written

#: Blocks over all sources; documents in a block at least.
BLOCKS, BLOCK_DOCS = 1 << 16, 64
#: Sources at most: their targets, and the blocks of each, are decided on the driver. More are an error, not left out.
MAX_SOURCES = 100_000
#: Output shards at least, unless given, and words of one from which there are more.
SHARDS, SHARD_WORDS = 16, 1 << 22


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Words that each source gives: share x all words by weight (dealt in code point order, null last), cap x its own
    at most; what is above is reshared by weight until none is."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    own, out, left = dict(order), {}, share * sum(n for _, n in order)
    while active := [s for s in own if s not in out]:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > cap * own[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = cap * own[s]
        left -= sum(cap * own[s] for s in over)
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> list[np.ndarray]:
    """Quotas of each shard: rows that add up to quotas, of sizes that differ by one at most."""
    out: list[np.ndarray] = []

    def node(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out.append(q)
            return
        mid, total = (lo + hi) // 2, int(q.sum())
        n = total * mid // shards - total * lo // shards if hi - lo == shards else total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, n, method="marginals")
        node(left, lo, mid)
        node(q - left, mid, hi)

    node(np.asarray(quotas, np.int64), 0, shards)
    return out


@dataclass
class Plan:
    """What the driver decides: a row for each source and each block."""

    sources: DataFrame  # source, source_size, target, n_blocks, passes, whole (blocks of the last pass), left (words from the next one)
    blocks: DataFrame  # source, block, shards (of each copy)
    shards: int


def size_and_key(docs: DataFrame, seed: int) -> tuple[F.Column, F.Column]:
    """Words of a row, and the hash that deals it out. Rows equal in doc_id and text share a key."""
    return F.coalesce(words(docs["text"]), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("key")


def plan(sized: DataFrame, seed: int, shards: int | None, share: float, cap: float, weights: tuple[float, ...]) -> Plan:
    """sized: source, size, key. Two small aggregates; only their results reach the driver."""
    spark = sized.sparkSession
    per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per_source.sort(key=lambda r: (r.source is None, r.source or ""))
    target = targets([(r.source, r["size"]) for r in per_source], share, cap, weights)
    docs = sum(r.n for r in per_source)
    n_blocks = {r.source: max(1, min(r.n // BLOCK_DOCS, BLOCKS * r.n // max(docs, 1))) for r in per_source}
    dealt = spark.createDataFrame([(s, n) for s, n in n_blocks.items()], "source string, n_blocks int")
    blocks = sized.join(F.broadcast(dealt), sized.source.eqNullSafe(dealt.source)).groupBy(sized.source, F.pmod("key", "n_blocks").cast("int").alias("block")).agg(F.sum("size").alias("size")).collect()
    size = {s: np.zeros(n, np.int64) for s, n in n_blocks.items()}
    for r in blocks:
        size[r.source][r.block] = r["size"]
    rows, units = [], []
    for k, r in enumerate(per_source):
        s, own = r.source, r["size"]
        passes = min(int(target[s] // own), int(cap)) if own else 0
        left = int(round(target[s] - passes * own)) if own else 0
        ends = np.cumsum(size[s])
        whole = int(np.searchsorted(ends, left, "right"))
        left -= int(ends[whole - 1]) if whole else 0
        rows.append((s, own, target[s], n_blocks[s], passes, whole, left))
        units.append([*list(range(n_blocks[s])) * passes, *range(min(whole + (left > 0), n_blocks[s]))])
    quotas = np.array([len(u) for u in units], np.int64)
    shards = shards or max(SHARDS, min(BLOCKS // 4, int(sum(target.values())) // SHARD_WORDS))
    shards = max(1, min(shards, int(quotas.sum()) or 1))
    dealt_to = [[] for _ in units]
    for shard, q in enumerate(split(quotas, shards, seed) if len(quotas) else []):
        for k in np.flatnonzero(q):
            dealt_to[k] += [shard] * int(q[k])
    of_block: dict[tuple[int, int], list[int]] = {}
    for k, (u, to) in enumerate(zip(units, dealt_to, strict=True)):
        for block, shard in zip(u, to, strict=True):
            of_block.setdefault((k, block), []).append(shard)
    return Plan(
        spark.createDataFrame(rows, "source string, source_size long, target double, n_blocks int, passes int, whole int, left long"),
        spark.createDataFrame([(rows[k][0], block, to) for (k, block), to in of_block.items()], "source string, block int, shards array<int>"),
        shards,
    )


def _border(groups_left: pd.DataFrame) -> pd.DataFrame:
    """Of the block in which a source's last pass ends, in key order, each document that still fits."""
    pdf = groups_left.sort_values(["key", "size"])
    left, take = int(pdf.left.iloc[0]) if len(pdf) else 0, []
    for size, n in zip(pdf["size"], pdf.n, strict=True):
        m = min(int(n), left // int(size)) if size else int(n)
        take.append(m)
        left -= m * int(size)
    return pdf.assign(m=take)[["source", "key", "m"]]


def mixed(docs: DataFrame, seed: int = 1, shards: int | None = None, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """`row` (struct of all columns of docs) and `take` = struct<size, source_size, target, copies, shards> for each row
    of docs: how often the mix takes it, and into which shards. copies is at most cap (rounded down); the copies' words
    add up to each source's target but for less than its smallest document left over. Null and empty texts have size 0;
    null is a source of its own; rows equal in doc_id and text are told apart only by count. Columns of docs may have
    any names. More than MAX_SOURCES sources are an error. Reruns agree.

    docs is read twice (sizes, then the result); sizes, keys and sources are kept as a table between."""
    spark, (size, key) = docs.sparkSession, size_and_key(docs, seed)
    with Steps(spark) as steps:
        sized = steps.written(docs.select(docs["source"], size, key), "sizes")
        p = plan(sized, seed, shards, share, cap, weights)
        sources, blocks = p.sources, p.blocks
        s = sized.join(F.broadcast(sources), sized.source.eqNullSafe(sources.source)).where((F.col("left") > 0) & (F.pmod("key", "n_blocks") == F.col("whole")))
        border = s.select(sized.source, "key", "size", "left").groupBy("source", "key", "size", "left").agg(F.count("*").alias("n"))
        border = steps.result(border.groupBy("source").applyInPandas(_border, "source string, key long, m long").where("m > 0"), "border")

    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"].alias("origin"), size, key)
    d = d.join(F.broadcast(sources), d["origin"].eqNullSafe(sources.source)).drop("source").withColumn("block", F.pmod("key", "n_blocks").cast("int"))
    d = d.join(F.broadcast(blocks), d["origin"].eqNullSafe(blocks.source) & (d["block"] == blocks.block), "left").select(d["*"], blocks.shards)
    at_border = (F.col("left") > 0) & (F.col("block") == F.col("whole"))
    inner, rest = d.where(at_border), d.where(~at_border)
    rest = rest.withColumn("copies", F.col("passes") + (F.col("block") < F.col("whole")).cast("int"))
    inner = inner.join(border, inner["origin"].eqNullSafe(border.source) & (inner["key"] == border.key), "left").select(inner["*"], "m")
    same = Window.partitionBy("origin", "key").orderBy("size")
    inner = inner.withColumn("copies", F.col("passes") + (F.row_number().over(same) <= F.coalesce("m", F.lit(0))).cast("int")).drop("m")
    both = rest.unionByName(inner)
    to = F.slice(F.coalesce("shards", F.array().cast("array<int>")), 1, F.col("copies"))
    return both.select("row", F.struct("size", "source_size", "target", "copies", to.alias("shards")).alias("take"))


def place(seed: int, shard, copy, doc_id, text) -> F.Column:
    """Where a copy stands in its shard: shards are in ascending order of it, which is a random one."""
    return F.xxhash64(F.lit(seed), shard, copy, doc_id, text)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards and places (of each copy) for each row of docs."""
    seed = options.get("seed", 1)
    found = mixed(docs.select("doc_id", "text", "source"), **options)
    t, row = F.col("take"), F.col("row")
    places = F.transform(t.shards, lambda shard, copy: place(seed, shard, copy, row.doc_id, row.text))
    taken = (t.size * t.copies).alias("taken")
    return found.select(row.doc_id.alias("doc_id"), t.size.alias("size"), t.source_size.alias("source_size"), t.target.alias("target"), taken, t.shards.alias("shards"), places.alias("places"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, and at the end the number of the copy, its shard
    and a random place in it: `__copy`, `__shard`, `__place`, with more underscores where docs has such columns."""
    copy, shard, at = unused(docs.columns, "__copy", "__shard", "__place")
    found = mixed(docs, **options).select("row", F.posexplode("take.shards").alias("copy", "shard"))
    row = F.col("row")
    where = place(options.get("seed", 1), F.col("shard"), F.col("copy"), row.doc_id, row.text)
    return found.select("row.*", F.col("copy").alias(copy), F.col("shard").alias(shard), where.alias(at))


def shuffled(found: DataFrame, n: int | None = None) -> DataFrame:
    """What mix() gives, dealt by shard over n partitions (those of the session), each shard in the order of its places."""
    _, shard, at = found.columns[-3:]
    dealt = found.repartition(n, shard) if n else found.repartition(shard)
    return dealt.sortWithinPartitions(shard, at)


def write_mix(docs: DataFrame, path: str, **options) -> None:
    """The mix as Parquet, a folder for each shard, shuffled within it."""
    found = mix(docs, **options)
    copy, shard, at = found.columns[-3:]
    shuffled(found, options.get("shards")).drop(copy, at).write.partitionBy(shard).parquet(path)
