"""MinHash near-duplicates by an inverted join of signature coordinates.

Each document's signature has K coordinates; a pair whose sets overlap by `similarity` agrees in more than LEAST of
them but for one pair in millions. Pairs that agree in LEAST coordinates share one of the first K - LEAST + 1 under any
common order of (coordinate, value): only those are posted (the prefix), rare values first, so values that a passage
puts into many documents are rarely posted at all. Documents meet where they are posted alike. Instead of a merge of
posting lists, the collisions of two that meet are counted over their whole signatures, after pairs whose sizes or
components rule them out have been skipped; links are confirmed on whole sets.

Exact copies of a set are one class throughout. In each of ROUNDS rounds, the classes of a posting list are compared
with one of them (first with the most central one, which near copies of one text have most in common with), a number of
pairs in proportion to the postings; classes in one component need no more comparisons.
At the end, all that still meet in different components are compared: in lists of up to FEW classes as pairs, in longer
lists by a prefix join on the shingles themselves (`prefix_pairs`), which forms no pairs of texts that only share a
part. With `exact`, that join takes the place of the signatures for all classes, and no link can be lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesnap.llm.common import Memo, Steps, claim, small_batches
from lakesnap.llm.components import components

K, LEAST = 48, 24
#: A (coordinate, value) is heavy if it has over 1 / HEAVY of all postings; there are fewer than HEAVY of those.
HEAVY = 1 << 18
#: Times that the classes of a list are compared with one of them only, before any two that are still apart are.
ROUNDS = 3
#: Classes of a list whose pairs are formed as rows at the end; longer lists go through a prefix join.
FEW = 64
#: Bytes of the memo of word hashes; characters of a word that enters it.
MEMO, LONG = 24 << 20, 64
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * K + 1, dtype=np.uint64) * _MULTIPLY)
_XOR, _ODD = _SEEDS[:K], _SEEDS[K:] | np.uint64(1)


_words = Memo("minhash", MEMO, xxhash.xxh3_64_intdigest, LONG)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word sequences of `size` (of the whole, if it is shorter)."""
    ws = (text or "").encode("utf-8", "replace").lower().split()  # both ASCII only
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, ws), np.uint64, len(ws))
    n = min(size, len(ws))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = out * _MULTIPLY + h[k : len(h) - n + 1 + k]
    out = np.sort(_mixed(out))
    return out[np.r_[True, out[1:] != out[:-1]]]


def signature(found: np.ndarray) -> np.ndarray:
    """K 32-bit coordinates of a set that isn't empty."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 2048):
        least = np.minimum(least, ((found[k : k + 2048, None] ^ _XOR) * _ODD).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set (128-bit hash of the set; null if empty), signature (array<int>)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("minhash")
        for pdf in batches:
            out = []
            for text in pdf.text:
                s = shingles(text, size)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s)) if len(s) else (0, None, None))
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_shingles": [r[0] for r in out], "set": [r[1] for r in out], "signature": [r[2] for r in out]})

    return docs.select("doc_id", "text").mapInPandas(rows, "doc_id long, n_shingles long, set binary, signature array<int>")


def _tokens(classes: DataFrame, signature) -> DataFrame:
    """node, token: coordinate and value as one integer."""
    value = F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))
    return classes.select("node", F.posexplode(signature).alias("i", "v")).select("node", (F.shiftleft(F.col("i").cast("long"), 32) + value).alias("token"))


def postings(classes: DataFrame, size: int = K, least: int = LEAST) -> DataFrame:
    """node, token, central: of each class (node, signature) the first K - LEAST + 1 tokens, light ones first, then heavy
    ones from rare to frequent; central is high for classes whose coordinates many others have: the text that near
    copies were made from has more in common with them than they with each other."""
    spark = classes.sparkSession
    total = classes.count() * size
    counted = _tokens(classes, "signature").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > max(2, total // HEAVY))
    heavy = counted.toArrow().sort_by("token")  # fewer than HEAVY rows of two integers
    if not heavy.num_rows:
        return _tokens(classes, F.slice("signature", 1, size - least + 1)).withColumn("central", F.lit(0.0).cast("float"))
    shared = spark.sparkContext.broadcast((heavy["token"].to_numpy(), heavy["n"].to_numpy()))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("minhash")
        keys, often = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            sig = np.stack(pdf.signature.to_numpy()).astype(np.int32).view(np.uint32).astype(np.int64)
            token = sig + (np.arange(size, dtype=np.int64) << 32)
            at = np.minimum(np.searchsorted(keys, token), len(keys) - 1)
            weight = np.where(keys[at] == token, often[at], 0)
            order = np.lexsort((token, weight))[:, : size - least + 1]  # by weight, then token
            central = np.log2(1.0 + weight).sum(1).astype(np.float32)
            yield pd.DataFrame({"node": np.repeat(pdf.node.to_numpy(), size - least + 1), "token": np.take_along_axis(token, order, 1).ravel(), "central": np.repeat(central, size - least + 1)})

    return classes.select("node", "signature").mapInPandas(first, "node long, token long, central float")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, steps: Steps) -> DataFrame:
    """Of pairs (a, b) those with 100 x intersection >= percent x union of their whole sets. The texts of all a are a
    table of their own: the join on a shuffles both sides, so that Spark can split the partition of an a with many b."""
    hubs = steps.written(texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "hubs")
    a, b = hubs.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("minhash")
        last, x = None, None
        for pdf in batches:
            keep = []
            for p, s, t in zip(pdf.a, pdf.text_a, pdf.text_b, strict=True):
                if p != last:
                    last, x = p, shingles(s, size)
                y = shingles(t, size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def prefix_pairs(nodes: DataFrame, size: int, percent: int, steps: Steps, least: int = 0) -> DataFrame:
    """Pairs (a, b) of nodes (node, component, signature, text) of different components that may be similar enough: every
    pair that is, is among them (with least: that also agrees in the last byte of so many coordinates). Shingles are ordered from rare to frequent; of two similar sets, the first shingle in common is
    among the first n - ceil(percent n / 100) + 1 of the larger, among the first n - ceil(2 percent n / (100 + percent)) + 1
    of the smaller, and leaves enough behind it in both. Texts that share a part, however many, meet nowhere unless
    that part is nearly all of one."""

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("minhash")
        for pdf in batches:
            sets = [shingles(t, size).view(np.int64) for t in pdf.text]
            n = np.array([len(s) for s in sets], np.int64)
            if n.sum():
                yield pd.DataFrame({"node": np.repeat(pdf.node.to_numpy(), n), "component": np.repeat(pdf.component.to_numpy(), n), "n": np.repeat(n, n), "s": np.concatenate(sets)})

    crowd = nodes.select("node", _sketch("signature").alias("sketch"))
    shingled = steps.written(nodes.select("node", "component", "text").mapInPandas(every, "node long, component long, n long, s long"), "shingles")
    often = shingled.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    # of each set the shingles that others have too, in order; those before them are its own alone
    shared = shingled.join(often, "s").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l"))
    alone = F.col("n") - F.size("l")
    first = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - alone.cast("int"))
    shared = shared.select("node", "component", "n", alone.alias("alone"), F.slice("l", 1, first).alias("l"))
    posted = shared.select("node", "component", "n", "alone", F.posexplode("l").alias("k", "x")).select("node", "component", "n", (F.col("alone") + F.col("k")).alias("i"), "x.s")
    posted = posted.where((F.col("n") - F.col("i")) * 100 >= percent * F.col("n"))
    posted = steps.written(posted.join(crowd, "node") if least else posted.withColumn("sketch", F.lit(None).cast("array<smallint>")), "prefixes")
    larger = posted.select("s", F.struct("n", "node").alias("p"), F.col("component").alias("cp"), (F.col("n") - F.col("i")).alias("rest_p"), F.col("sketch").alias("sp"))
    smaller = posted.where((F.col("n") - F.col("i")) * (100 + percent) >= 2 * percent * F.col("n"))
    smaller = smaller.select("s", F.struct("n", "node").alias("q"), F.col("component").alias("cq"), (F.col("n") - F.col("i")).alias("rest_q"), F.col("sketch").alias("sq"))
    fits = (F.col("q") < F.col("p")) & (F.col("cp") != F.col("cq")) & (100 * F.col("q.n") >= percent * F.col("p.n"))
    enough = (100 + percent) * F.least("rest_p", "rest_q") >= percent * (F.col("p.n") + F.col("q.n"))
    likely = fits & enough & (_agree("sp", "sq") >= least) if least else fits & enough
    return larger.join(smaller, "s").where(likely).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _sketch(signature: str) -> F.Column:
    """The last byte of each coordinate."""
    return F.transform(signature, lambda x: x.bitwiseAND(F.lit(255)).cast("short"))


def _agree(p: str, q: str) -> F.Column:
    """Number of places in which two arrays agree."""
    return F.aggregate(F.zip_with(p, q, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _alike(pairs: DataFrame, classes: DataFrame, least: int, percent: int, steps: Steps) -> DataFrame:
    """Of pairs (a, b) those that agree in `least` coordinates, and whose set sizes allow the similarity. As in
    _confirmed, the classes of all a are a table of their own."""
    pairs = steps.written(pairs, "met")
    hubs = steps.written(classes.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", "signature", "n_shingles"), "met-hubs")
    a = hubs.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    b = classes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(b, "b").join(a, "a").where(sizes & (_agree("sa", "sb") >= least)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents are linked if 100 x intersection >= percent x union of their distinct word shingles. Null and empty texts
    are linked with nothing; rows equal in their set are linked, repeated rows too; a null doc_id is linked with
    nothing and kept. Rows of one doc_id with different texts are told apart by their sets. Words and hashes ignore
    the case of A-Z. Columns other than doc_id and text are not read.

    A link at the similarity of `percent` is lost with a chance below 1e-6, unless exact: then candidates come from the
    shingles themselves, at the price of a shuffle of all of them."""
    spark = docs.sparkSession
    small_batches(spark)
    with Steps(spark) as steps:
        rows = steps.written(signed(docs, size), "signed")
        own = rows.where("n_shingles > 0 and doc_id is not null")
        classes = own.groupBy("set").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
        classes = steps.bucketed(classes, "node", "classes")
        found = _all_links(docs, classes, size, percent, steps) if exact else _links(docs, classes, size, percent, steps)
        of = classes.select("set", F.col("node")).join(found, "node", "left").select("set", F.coalesce("component", "node").alias("component_id"))
        alone = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
        out = rows.select("doc_id", "n_shingles", "set").join(of, "set", "left").select("doc_id", "n_shingles", alone.alias("component_id"))
        return steps.result(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")


def _links(docs: DataFrame, classes: DataFrame, size: int, percent: int, steps: Steps) -> DataFrame:
    """node, component of the classes that have links."""
    posted = steps.written(postings(classes), "postings").withColumn("component", F.col("node"))
    links = texts = found = tested = None
    for r in range(ROUNDS + 1):
        # only lists in which two components meet
        order = F.struct("central", F.xxhash64("node")) if r == 0 else F.struct(F.xxhash64("node", F.lit(r)))
        hub = F.max_by(F.struct("node", "component"), order)
        lists = posted.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), hub.alias("hub")).where("x < y").select("token", "hub")
        posted = steps.written(posted.join(steps.written(lists, "hubs-of-lists"), "token"), "lists")
        if r == 0:
            texts = steps.bucketed(_texts(docs, classes.join(posted.select("node").distinct(), "node", "left_semi"), size), "node", "texts")
        if r < ROUNDS:
            pairs = posted.where("component <> hub.component").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
        else:
            many = steps.written(posted.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > FEW), "long-lists")
            short = posted.join(many, "token", "left_anti").join(classes.select("node", F.col("n_shingles").alias("n"), _sketch("signature").alias("s")), "node")
            a, b = (short.select("token", F.col("node").alias(n), F.col("component").alias(f"c{n}"), F.col("n").alias(f"n{n}"), F.col("s").alias(f"s{n}")) for n in "ab")
            fits = F.expr("a < b and ca <> cb") & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            pairs = a.join(b, "token").where(fits & (_agree("sa", "sb") >= LEAST)).select("a", "b").distinct()
            crowd = posted.join(many, "token", "left_semi").select("node", "component").distinct()
            crowd = crowd.join(texts, "node").join(classes.select("node", "signature"), "node")
            pairs = pairs.union(prefix_pairs(crowd, size, percent, steps, LEAST)).distinct()
        pairs = _alike(pairs, classes, LEAST, percent, steps)
        # a pair may come as (a, b) and as (b, a); a is the hub, so that only joins on a are uneven
        pairs = pairs.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).dropDuplicates(["x", "y"])
        pairs = steps.written(pairs.join(tested.select("x", "y"), ["x", "y"], "left_anti") if tested else pairs, "pairs")
        tested = pairs.union(tested.select(pairs.columns)) if tested else pairs
        new = steps.written(_confirmed(pairs.select("a", "b"), texts, size, percent, steps), "links")
        links = links.union(new) if links else new
        found = steps.written(components(links, steps), "components")
        posted = posted.select("token", "node", "central").join(found, "node", "left").select("token", "node", "central", F.coalesce("component", "node").alias("component"))
    return found


def _all_links(docs: DataFrame, classes: DataFrame, size: int, percent: int, steps: Steps) -> DataFrame:
    """_links() without signatures."""
    texts = steps.bucketed(_texts(docs, classes, size), "node", "texts")
    pairs = steps.written(prefix_pairs(texts.withColumns({"component": F.col("node"), "signature": F.lit(None).cast("array<int>")}), size, percent, steps), "pairs")
    return steps.written(components(steps.written(_confirmed(pairs, texts, size, percent, steps), "links"), steps), "components")


def _texts(docs: DataFrame, met: DataFrame, size: int) -> DataFrame:
    """node, text of the classes met (node, set): of the rows of docs with that doc_id one with that set."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("minhash")
        for pdf in batches:
            keep = [xxhash.xxh3_128_digest(shingles(t, size).tobytes()) == bytes(s) for t, s in zip(pdf.text, pdf.set, strict=True)]
            if any(keep):
                yield pdf.loc[keep, ["node", "text"]]

    rows = docs.select(F.col("doc_id").alias("node"), "text").join(met.select("node", "set"), "node")
    return rows.select("node", "text", "set").mapInPandas(own, "node long, text string").dropDuplicates(["node"])
