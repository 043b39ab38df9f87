"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of the rows.

A graph is built in rounds over its vectors: a greedy beam search for each vector over the graph so far proposes what it
has visited as neighbours; pruning keeps the nearest candidate, drops those that it is nearer to (by the factor
`relax`) than the vector is, and so on, so that the edges that stay point in different directions; edges are then put in
backwards, and full lists pruned again. All of it runs for many vectors at once. A search starts at the vector next to
the mean and follows the `beam` nearest found so far until none is left to follow.

Equal vectors are one node: its rows are reported by id, so only the smallest ids can be, and those are kept.

Distances are sums of products in double precision, of vectors that have been scaled by a power of two and moved by the
shard's mean: a large common offset, or vectors that are very large or small, cost no digits. Scores are taken from the
vectors as they came.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesnap.llm.common import Steps, partitions

#: Nodes of a shard; queries of a block; tasks at most.
SHARD, QUERIES, MOST = 1 << 13, 256, 100_000
#: Query blocks that go to a shard's graph together.
BUNDLE = 64
DEGREE, BEAM_BUILD, BEAM, RELAX = 40, 64, 160, 1.2
BATCH, AHEAD = 256, 4


def _distances(x: np.ndarray, sq: np.ndarray, ids: np.ndarray, q: np.ndarray, qq: np.ndarray) -> np.ndarray:
    """Squared distances of q (b x dims) to x[ids] (b x m)."""
    return np.maximum(sq[ids] + qq[:, None] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0], 0)


def scale_of(x: np.ndarray) -> float:
    """A power of two that brings the largest component near 1."""
    return 2.0 ** -np.clip(np.frexp(np.abs(x).max(initial=0))[1], -1000, 1000)


def beam_search(x: np.ndarray, sq: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the nodes of its beam (-1: none) and their squared distances, nearest first."""
    b, n = len(q), len(x)
    qq = (q * q).sum(1)
    ids = np.full((b, beam), -1)
    d = np.full((b, beam), np.inf, x.dtype)
    ids[:, 0] = start
    d[:, 0] = _distances(x, sq, ids[:, :1], q, qq)[:, 0]
    done = ids < 0
    seen = np.zeros((b, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    rows = np.arange(b)
    while True:
        order = np.argsort(done, axis=1, kind="stable")[:, :AHEAD]  # nearest that have not been followed
        follow = ~np.take_along_axis(done, order, 1)
        active = np.flatnonzero(follow.any(1))
        if not len(active):
            return ids, d
        order, follow, r = order[active], follow[active], rows[active][:, None]
        done[r, order] = True
        near = graph[np.where(follow, ids[r, order], 0)]
        near = np.where(follow[:, :, None] & (near >= 0), near, n).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[r, near]] = n
        seen[r, near] = True
        # only what is new
        width = int((near < n).sum(1).max())
        if not width:
            continue
        near = np.sort(near, axis=1)[:, :width]
        dist = _distances(x, sq, np.minimum(near, n - 1), q[active], qq[active])
        dist[near == n] = np.inf
        every_d = np.concatenate([d[active], dist], 1)
        every = np.concatenate([ids[active], np.where(near == n, -1, near)], 1)
        every_done = np.concatenate([done[active], near == n], 1)
        best = np.argsort(every_d, axis=1, kind="stable")[:, :beam]
        d[active], ids[active], done[active] = (np.take_along_axis(a, best, 1) for a in (every_d, every, every_done))


def prune(x: np.ndarray, sq: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point of up to m candidates (-1: none) at most `degree` diverse ones, -1 after them."""
    b, m = found.shape
    found = np.sort(found, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found[found == points[:, None]] = -1
    at = np.maximum(found, 0)
    d = _distances(x, sq, at, x[points], sq[points])
    d[found < 0] = np.inf
    keep = np.argsort(d, axis=1)[:, : min(m, 3 * degree)]
    found, at, d = (np.take_along_axis(a, keep, 1) for a in (found, at, d))
    v = x[at]
    between = np.maximum(sq[at][:, :, None] + sq[at][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    out = np.full((b, degree), -1)
    rows = np.arange(b)
    for k in range(degree):
        c = np.argmin(d, axis=1)
        left = np.isfinite(d[rows, c])
        if not left.any():
            break
        out[left, k] = found[rows, c][left]
        near = relax * relax * between[rows, c] <= d
        d[near] = np.inf
        d[rows, c] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, relax: float = RELAX, seed: int = 1) -> tuple[np.ndarray, int]:
    """Neighbours of each vector (n x degree, -1: none) and the node that searches start at."""
    n = len(x)
    sq = (x * x).sum(1)
    start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, min(degree, n)))
    if graph.shape[1] < degree:
        graph = np.c_[graph, np.full((n, degree - graph.shape[1]), -1)]
    for factor in (1.0, relax):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            points = order[k : k + BATCH]
            found, _ = beam_search(x, sq, graph, start, x[points], beam)
            own = prune(x, sq, points, np.concatenate([found, graph[points]], 1), degree, factor)
            graph[points] = own
            source, to = np.repeat(points, degree), own.ravel()
            source, to = source[to >= 0], to[to >= 0]
            by = np.argsort(to, kind="stable")
            source, to = source[by], to[by]
            ends, count = np.unique(to, return_counts=True)
            extra = np.full((len(ends), count.max(initial=0)), -1)
            extra[np.repeat(np.arange(len(ends)), count), np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)] = source
            both = np.concatenate([graph[ends], extra], 1)
            for j in range(0, len(ends), BATCH):
                part = slice(j, j + BATCH)
                graph[ends[part]] = _room(x, sq, ends[part], both[part], degree, factor)
    return graph, start


def _room(x: np.ndarray, sq: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Candidates as they are where they fit, pruned where they don't."""
    found = np.sort(found, axis=1)[:, ::-1].copy()
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found[found == points[:, None]] = -1
    found = np.sort(found, axis=1)[:, ::-1].copy()
    full = (found >= 0).sum(1) > degree
    out = found[:, :degree].copy()
    if out.shape[1] < degree:
        out = np.c_[out, np.full((len(out), degree - out.shape[1]), -1)]
    if full.any():
        out[full] = prune(x, sq, points[full], found[full], degree, relax)
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) of vectors without null or non-finite components that aren't null, empty or zero."""
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))


def index(rows: DataFrame, k: int, steps: Steps, shard: int = SHARD) -> tuple[DataFrame, int]:
    """A row for each shard and length of vectors: shard, dims, start, scale, mean, ends (of the ids of a node), ids,
    vectors, graph; and the number of shards. Each shard is a task's work of its own."""
    equal = Window.partitionBy("v").orderBy("id")
    nodes = rows.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1)
    nodes = nodes.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    nodes = steps.written(nodes, "nodes")
    shards = max(1, -(-nodes.count() // shard))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(low=pdf.ids.map(lambda a: a[0])).sort_values("low")
        out = []
        for dims, some in pdf.groupby(pdf.v.map(len)):
            x = np.stack(some.v.to_numpy()).astype(np.float64)
            scale = scale_of(x)
            mean = (x * scale).mean(0)
            graph, start = build(x * scale - mean)
            ends = np.cumsum(some.ids.map(len).to_numpy(np.int64))
            ids = np.concatenate(some.ids.to_list()).astype(np.int64)
            out.append((int(pdf.shard.iloc[0]), dims, start, scale, mean.tobytes(), ends.tobytes(), ids.tobytes(), x.tobytes(), graph.astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["shard", "dims", "start", "scale", "mean", "ends", "ids", "vectors", "graph"])

    # a number of partitions is not coalesced by bytes: a shard has few of those, and much work
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int")).repartition(min(4 * shards, MOST), "shard")
    schema = "shard int, dims int, start int, scale double, mean binary, ends binary, ids binary, vectors binary, graph binary"
    return steps.written(dealt.groupBy("shard").applyInPandas(one, schema), "graphs"), shards


def found_in(pdf: pd.DataFrame, asked: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k best of one graph (a row of pdf) for each query of asked (rows q_ids, q_vectors)."""
    out = []
    for dims, start, scale, mean, ends, ids, x, graph in pdf[["dims", "start", "scale", "mean", "ends", "ids", "vectors", "graph"]].itertuples(index=False):
        x = np.frombuffer(x).reshape(-1, dims)
        ends, ids = np.frombuffer(ends, np.int64), np.frombuffer(ids, np.int64)
        mean, graph = np.frombuffer(mean), np.frombuffer(graph, np.int32).reshape(len(x), -1)
        near, firsts = x * scale - mean, np.r_[0, ends[:-1]]
        sq = (near * near).sum(1)
        for q_ids, q in zip(asked.q_ids, asked.q_vectors, strict=True):
            q = np.frombuffer(q).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                found, _ = beam_search(near, sq, graph, start, np.nan_to_num(q * scale - mean, posinf=1e150, neginf=-1e150).clip(-1e150, 1e150), beam)
            for own, v, nodes in zip(np.frombuffer(q_ids, np.int64).tolist(), q, found, strict=True):
                nodes = nodes[nodes >= 0]
                with np.errstate(over="ignore"):
                    score = np.sqrt(((x[nodes] - v) ** 2).sum(1))
                size = ends[nodes] - firsts[nodes]
                rows = np.repeat(firsts[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row_ids, score = ids[rows], np.repeat(score, size)
                other = row_ids != own
                row_ids, score = row_ids[other], score[other]
                best = np.lexsort((row_ids, score))[:k]
                out.append((np.full(len(best), own), row_ids[best], score[best]))
    parts = zip(*out, strict=True) if out else ([np.zeros(0)],) * 3
    return pd.DataFrame({n: np.concatenate(list(p)) for n, p in zip(("query_id", "vec_id", "score"), parts, strict=True)})


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k nearest other rows found, by
    Euclidean distance in double precision, ties to smaller ids (all rows of the same length, if there are fewer).

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Rows that
    repeat an id and its vector are one; if an id has several vectors, the least is the query, and the id is reported
    once, by its nearest. Every shard's graph is searched for every query.

    A shard's graph meets BUNDLE blocks of queries at a time: it is sent once for each bundle, and queries, which are
    few and small, once for each shard. What leaves is k rows a query and shard."""
    spark = vectors.sparkSession
    with Steps(spark) as steps:
        rows = usable(vectors, id_col, vector_col)
        graphs, shards = index(rows, k, steps)
        asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
        blocks = max(1, -(-asked.count() // QUERIES))

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [(int(pdf.asked.iloc[0]), dims, some.id.to_numpy(np.int64).tobytes(), np.stack(some.v.to_numpy()).astype(np.float64).tobytes()) for dims, some in pdf.groupby(pdf.v.map(len))]
            return pd.DataFrame(out, columns=["asked", "dims", "q_ids", "q_vectors"])

        asked = asked.withColumn("asked", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(min(blocks, partitions(spark)), "asked")
        asked = steps.written(asked.groupBy("asked").applyInPandas(packed, "asked int, dims int, q_ids binary, q_vectors binary"), "queries")
        bundles = -(-blocks // BUNDLE)
        n = min(4 * shards * bundles, MOST)
        left = graphs.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))).repartition(n, "shard", "dims", "bundle")
        right = asked.withColumn("bundle", F.pmod("asked", F.lit(bundles))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(n, "shard", "dims", "bundle")

        def search(graph: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            return found_in(graph, some, k, beam)

        by = ("shard", "dims", "bundle")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best))
        return steps.result(found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
