"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers. A block of rows keeps, for each component and each bit of its upper bits, a bitmap
over the rows (a slice); these are what the index stores, beside the quantised values. A query's weighted sum of components is added slice by slice with bitmap arithmetic: full
adders take three bitmaps of one weight to one of that weight and one of the next, for all rows of a word at once. From
the most significant slice of the sum downward, the k-th best sum is found; rows whose sum is within the quantisation's
error of it form the boundary, which is resolved by exact scores; rows above it are sure, and scored for the report.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesnap.llm.common import Steps

#: Rows of an index block; queries of a query block; bits of a component that the slices leave out.
ROWS, QUERIES, DROPPED = 1 << 15, 256, 3
#: Query blocks that go to an index block together; tasks at most.
BUNDLE, MOST = 64, 100_000
#: Products are summed in 64-bit integers: the length times the greatest |value| squared must stay below this.
SUMS = 1 << 62


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """A boolean row vector as a bitmap of 64-bit words."""
    padded = np.zeros(-(-len(bits) // 64) * 64, bool)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def unpack_bits(bitmap: np.ndarray, n: int) -> np.ndarray:
    """Row numbers of the ones."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def digits(x: int) -> list[tuple[int, int]]:
    """x as few signed powers of two: (exponent, sign)."""
    out, k = [], 0
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((k, d))
            x -= d
        x >>= 1
        k += 1
    return out


class Block:
    """The index of a block: slices of (component >> DROPPED) minus its least value in the block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: list[list[np.ndarray]] | None = None):
        self.ids, self.values = ids, values
        self.n = len(ids)
        self.ones = pack_bits(np.ones(self.n, bool))
        self.slices = self.sliced(values) if slices is None else slices
        self.inverse = [[self.ones & ~s for s in x] for x in self.slices]
        self.spread = (1 << DROPPED) - 1

    @staticmethod
    def sliced(values: np.ndarray) -> list[list[np.ndarray]]:
        """For each component its bitmaps, least significant bit first."""
        upper = values >> DROPPED
        upper = upper - upper.min(0)
        return [[pack_bits((upper[:, d] >> b) & 1 == 1) for b in range(int(upper[:, d].max()).bit_length())] for d in range(values.shape[1])]

    @staticmethod
    def stored(slices: list[list[np.ndarray]]) -> tuple[bytes, bytes]:
        """Bits of each component, and all bitmaps laid end to end."""
        return bytes(len(x) for x in slices), b"".join(s.tobytes() for x in slices for s in x)

    @staticmethod
    def loaded(bits: bytes, bitmaps: bytes, n: int) -> list[list[np.ndarray]]:
        every = iter(np.frombuffer(bitmaps, np.uint64).reshape(-1, -(-n // 64)))
        return [[next(every) for _ in range(b)] for b in bits]

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of a number for each row: sum of query x upper components, plus the same
        constant for all rows. A subtracted slice enters as its inverse, which only shifts all rows alike."""
        columns: list[list[np.ndarray]] = []

        def put(weight: int, bitmap: np.ndarray) -> None:
            while len(columns) <= weight:
                columns.append([])
            columns[weight].append(bitmap)

        for q, plain, inverse in zip(query.tolist(), self.slices, self.inverse, strict=True):
            for shift, sign in digits(q):
                for b, bitmap in enumerate(plain if sign > 0 else inverse):
                    put(shift + b, bitmap)
        out, w = [], 0
        while w < len(columns):
            column = columns[w]
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                ab = a ^ b
                column.insert(0, ab ^ c)
                put(w + 1, (a & b) | (ab & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                put(w + 1, a & b)
            out.append(column[0] if column else np.zeros_like(self.ones))
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but `own`, ties to smaller ids."""
        mask = self.ones
        if own is not None and len(at := np.flatnonzero(self.ids == own)):
            mask = mask.copy()
            for r in at:
                mask[r // 64] &= ~np.uint64(1 << (int(r) % 64))
        slices = self.sums(query)
        # the k-th greatest sum, from the most significant slice downward
        sure, tied, kth = np.zeros_like(mask), mask, 0
        for w in range(len(slices) - 1, -1, -1):
            x = sure | (tied & slices[w])
            if int(np.bitwise_count(x).sum()) >= k:
                tied = tied & slices[w]
                kth |= 1 << w
            else:
                sure = x
                tied = tied & ~slices[w]
        # the bits left out change a row's score by what lies between these; in units of the sum
        error = self.spread * int(np.abs(query).sum())
        floor = kth - (error >> DROPPED) - 1
        rows = unpack_bits(self._at_least(slices, max(0, floor)) & mask, self.n)
        scores = self.values[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]

    def _at_least(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        above, equal = np.zeros_like(self.ones), self.ones
        for w in range(max(len(slices), least.bit_length()) - 1, -1, -1):
            s = slices[w] if w < len(slices) else np.zeros_like(self.ones)
            if least >> w & 1:
                equal = equal & s
            else:
                above = above | (equal & s)
                equal = equal & ~s
        return above | equal


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array<int>: floor(scale x component)), of the vectors that are whole: not null, no null or non-finite component."""
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _packed(rows: DataFrame, size: int, name: str, slices: bool, steps: Steps) -> tuple[DataFrame, int]:
    """Rows dealt by a hash to blocks of about `size`: block, dims, kind (of integer), ids, values, and with slices bits
    and bitmaps. Each block is a task's work of its own."""
    blocks = max(1, -(-rows.count() // size))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        out = []
        for dims, some in pdf.groupby(pdf.v.map(len)):  # vectors of another length have another space
            values = np.stack(some.v.to_numpy()).astype(np.int64)
            if dims * max(abs(int(values.min())), abs(int(values.max()))) ** 2 >= SUMS:
                raise OverflowError("components are too large for 64-bit inner products")
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max)
            bits, bitmaps = Block.stored(Block.sliced(values)) if slices else (b"", b"")
            out.append((int(pdf.block.iloc[0]), dims, kind, some.id.to_numpy(np.int64).tobytes(), values.astype(kind).tobytes(), bits, bitmaps))
        return pd.DataFrame(out, columns=["block", "dims", "kind", "ids", "values", "bits", "bitmaps"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(min(4 * blocks, MOST), "block")
    return steps.written(dealt.groupBy("block").applyInPandas(one, "block int, dims int, kind string, ids binary, values binary, bits binary, bitmaps binary"), name), blocks


def _values(ids: bytes, kind: str, values: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, kind).reshape(-1, dims).astype(np.int64)


def found_in(index: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k best of an index block (a row of index) for each query in the rows of asked."""
    out = []
    for dims, kind, ids, values, bits, bitmaps in index[["dims", "kind", "ids", "values", "bits", "bitmaps"]].itertuples(index=False):
        ids, values = _values(ids, kind, values, dims)
        block = Block(ids, values, Block.loaded(bits, bitmaps, len(ids)))
        for q_kind, q_ids, q_values in asked[["kind", "ids", "values"]].itertuples(index=False):
            for own, q in zip(*_values(q_ids, q_kind, q_values, dims), strict=True):
                found, scores = block.top(q, k, own)
                out.append((np.full(len(found), own), found, scores))
    parts = zip(*out, strict=True) if out else ([np.zeros(0, np.int64)],) * 3
    return pd.DataFrame({n: np.concatenate(list(p)) for n, p in zip(("query_id", "vec_id", "score"), parts, strict=True)})


def top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k greatest integer inner
    products with other rows of the same length (all, if fewer), ties to smaller ids.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id. A row
    is no candidate of a query with its id. Rows that repeat an id and its vector are one; if an id has several vectors,
    each is a candidate and the least is the query. Components so large that an inner product might leave 64 bits are an
    error.

    Index blocks hold ROWS rows and their slices, query blocks QUERIES. An index block meets BUNDLE query blocks at a
    time: it is sent once for each bundle, and queries, which are few and small, once for each index block. What leaves
    is k rows a query and index block."""
    with Steps(vectors.sparkSession) as steps:
        rows = quantised(vectors, id_col, vector_col, scale).dropDuplicates(["id", "v"])
        index, n_index = _packed(rows, ROWS, "index", True, steps)
        asked, n_asked = _packed(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), QUERIES, "queries", False, steps)
        bundles = -(-n_asked // BUNDLE)
        n, by = min(4 * n_index * bundles, MOST), ("block", "dims", "bundle")
        left = index.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))).repartition(n, *by)
        right = asked.withColumn("bundle", F.pmod("block", F.lit(bundles))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1)))).repartition(n, *by)

        def search(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            return found_in(block, some, k)

        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return steps.result(found.select("query_id", "rank", "vec_id", "score"), "top-k")
