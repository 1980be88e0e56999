"""Approximate nearest neighbours by adaptive dimension scan over probed lists, for the largest inner product.

Vectors get one more component that gives all of them one norm, so that the largest inner product is the smallest
distance, and are rotated at random. Lists come from k-means on a bounded sample; every vector is indexed. How many lists
a query probes is measured: for a few of the queries all vectors are scanned, and as many of the nearest lists are
probed as hold TARGET of their true neighbours. So vectors that cluster are searched in few lists, others in many.

A query first scans its nearest lists. Its k-th score there bounds what the other lists have to beat. Inside a list the
rotated components are read in blocks of columns: after each block the partial distance, scaled to all dimensions, is a guess of the
whole, and a candidate is abandoned as soon as a hypothesis test finds that guess too far above the bound. Whatever is
left is scored exactly, in double precision on the original vectors.

Lists are split into cells of at most about CELL candidates and BLOCK queries, so that neither a large list nor a
popular one meets in one task. Rows that tie keep the smaller id, in cells and over all.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do those of another
length than most (the shorter of two as frequent lengths). A query whose lists hold fewer than k candidates goes through
all lists. Repeated ids are separate rows; a query never meets a row of its own id. Components are scaled by the largest of
them, so that no finite vector overflows. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.llm import common

#: Bound of the sample that centroids are fitted on.
SAMPLE = 16_384
#: Share of the true neighbours that the probed lists hold, by the queries it is measured on; the fewest lists; the lists
#: scanned first are one in FIRST of them.
TARGET = 0.96
MEASURED = 64
PROBES = 8
FIRST = 8
MOST_LISTS = 2048
CELL = 4096
BLOCK = 2048
COLUMNS = 16
#: Width of the hypothesis test, in standard deviations over the square root of the dimensions read.
EPSILON = 2.1
SEED = 11


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(ok, F.lit(False)))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (top["d"] if top else 0))


class Index:
    """Rotation, centroids and the common norm (squared, of vectors over `largest`, the largest component). Vectors are made
    unit-free: scaled, augmented, then rotated."""

    def __init__(self, sample: np.ndarray, largest: float, norm2: float, rows: int):
        self.largest = largest
        rng = np.random.default_rng(SEED)
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
        self.norm2 = norm2
        x = self.rotate(sample)
        k = int(min(MOST_LISTS, max(1, np.sqrt(rows)), len(x)))
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(8):
            near = self.nearest(x, c, 1)[:, 0]
            n = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, x[:, j], k) for j in range(d)], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
        self.centroids = c
        self.probes = k

    def rotate(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        v = v / self.largest
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm2 - (v * v).sum(1), 0))
        return np.concatenate([v, more[:, None]], 1).astype(np.float32) @ self.rotation

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids of each row, in no order."""
        out = []
        for i in range(0, len(x), 4096):
            d = (c * c).sum(1) - 2 * (x[i : i + 4096] @ c.T)
            out.append(d.argmin(1)[:, None] if n == 1 else np.argpartition(d, min(n, len(c)) - 1, axis=1)[:, :n])
        return np.concatenate(out)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def scan(index: Index, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): each query's k best candidates of a cell by exact score, ties to the smaller id. least is the
    k-th score that each query has found elsewhere, minus infinity where it has none."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    x, q = index.rotate(vectors), index.rotate(queries, query=True)
    d, m = x.shape[1], len(ids)
    out = []
    for i in range(0, len(q), 128):
        block, own = q[i : i + 128], query_ids[i : i + 128]
        alive_q, alive_x = np.divmod(np.arange(len(block) * m), m)
        other = ids[alive_x] != own[alive_q]
        alive_q, alive_x = alive_q[other], alive_x[other]
        # The k-th distance among a first batch of candidates bounds the k-th distance over all.
        first = min(m, 4 * k)
        seen = ((block**2).sum(1)[:, None] - 2 * (block @ x[:first].T) + (x[:first] ** 2).sum(1)).astype(np.float64)
        seen[ids[:first][None, :] == own[:, None]] = np.inf
        bound = np.partition(seen, k - 1, axis=1)[:, k - 1] if first > k else np.full(len(block), np.inf)
        if least is not None:
            known = least[i : i + 128] / index.largest / index.largest
            bound = np.minimum(bound, (block**2).sum(1, dtype=np.float64) + index.norm2 - 2 * known)
        partial = np.zeros(len(alive_q), np.float32)
        for j in range(0, d, COLUMNS):
            to = min(d, j + COLUMNS)
            bx, bq = x[:, j:to], block[:, j:to]
            if j == 0:
                whole = (bq**2).sum(1)[:, None] - 2 * (bq @ bx.T) + (bx**2).sum(1)
                partial = whole[alive_q, alive_x]
            else:
                diff = bx[alive_x] - bq[alive_q]
                partial = partial + np.einsum("ij,ij->i", diff, diff)
            width = 1.0 + EPSILON / np.sqrt(to) if to < d else 1.0
            stay = partial * (d / to) <= bound[alive_q] * width**2 * (1 + 1e-5) + 1e-5
            alive_q, alive_x, partial = alive_q[stay], alive_x[stay], partial[stay]
        for a in range(0, len(alive_q), 65536):
            aq, ax = alive_q[a : a + 65536], alive_x[a : a + 65536]
            out.append((i + aq, ax, (vectors[ax] * queries[i + aq]).sum(1)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    qi, xi, s = (np.concatenate(c) for c in zip(*out))
    rank = np.lexsort((ids[xi], -s, qi))
    qi, xi, s = qi[rank], xi[rank], s[rank]
    starts = np.searchsorted(qi, np.arange(len(q)))
    best = np.arange(len(qi)) - starts[qi] < k
    return query_ids[qi[best]], ids[xi[best]], s[best]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def measured_probes(index: Index, listed: DataFrame, asked: pd.DataFrame, k: int) -> int:
    """The fewest nearest lists that hold TARGET of the k true neighbours of asked(vec_id, v), by a scan of all of listed."""
    own, q = asked["vec_id"].to_numpy(), _vectors(asked["v"])

    def exact(batches):
        best = pd.DataFrame({"q": np.zeros(0, np.int32), "score": np.zeros(0), "list": np.zeros(0, np.int32)})
        for b in batches:
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                s = q @ _vectors(part["v"]).T
                s[own[:, None] == part["vec_id"].to_numpy()[None, :]] = -np.inf
                n = min(k, len(part))
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                rows = pd.DataFrame({"q": np.repeat(np.arange(len(q), dtype=np.int32), n), "score": np.take_along_axis(s, at, 1).ravel(), "list": part["list"].to_numpy()[at.ravel()]})
                best = pd.concat([best, rows[np.isfinite(rows["score"])]]).sort_values("score", ascending=False, kind="stable").groupby("q").head(k)
        yield best

    top = listed.mapInPandas(exact, "q int, score double, list int")
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))).filter(F.col("n") <= k)
    true = top.select("q", "list").toPandas()
    if not len(true):
        return len(index.centroids)
    c, x = index.centroids, index.rotate(q, query=True)
    place = np.argsort(np.argsort((c * c).sum(1) - 2 * (x @ c.T), axis=1, kind="stable"), axis=1)
    hits = np.sort(place[true["q"].to_numpy(), true["list"].to_numpy()])
    return min(len(c), max(PROBES, int(hits[int(np.ceil(TARGET * len(hits))) - 1]) + 1))


def search(df: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of df(vec_id, embedding) that is_query keeps, its k nearest found."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = common.written(usable(df), "vectors")
    count, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not count:
        return empty
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest)))).first()[0]
    # Rows that share an id are picked by their vector too, so that one common id brings no more than its share.
    pick = lambda of, n, seed: of.filter(F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(1 << 31)) / float(1 << 31) < n).toPandas().sort_values("vec_id", kind="stable")
    sample = pick(rows, SAMPLE / count, SEED)
    if not len(sample):
        sample = rows.limit(1).toPandas()
    index = Index(_vectors(sample["v"]), float(largest), float(norm2), count)
    held = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            near = Index.nearest(held.value.rotate(_vectors(b["v"])), held.value.centroids, 1)[:, 0] if len(b) else []
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "list": near})

    listed = common.written(rows.mapInPandas(assign, "vec_id long, v array<double>, list int"), "listed")
    queries = rows.filter(is_query)
    n_queries = queries.count()
    some = pick(queries, MEASURED / max(1, n_queries), SEED + 1)
    lists = len(index.centroids)
    probes = measured_probes(index, listed, some, k) if len(some) else lists
    first = max(1, -(-probes // FIRST))

    def probe(batches):
        for b in batches:
            if len(b):
                c, x = held.value.centroids, held.value.rotate(_vectors(b["v"]), query=True)
                near = np.argsort((c * c).sum(1) - 2 * (x @ c.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": b["vec_id"], "v": b["v"], "lists": list(near.astype(np.int32))})

    asked = queries.mapInPandas(probe, "query_id long, v array<double>, lists array<int>")
    asked = common.written(asked.select("query_id", "v", F.posexplode("lists").alias("turn", "list")), "asked")
    n_x = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # MOST_LISTS of them at most

    def scanned(asked: DataFrame) -> DataFrame:
        """The best of the lists in asked(query_id, v, list, least)."""
        # Sizes decide into how many cells a list is cut.
        n_q = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
        cells = spark.createDataFrame([(x, -(-n // CELL), max(1, -(-n_q.get(x, 0) // BLOCK))) for x, n in n_x.items() if x in n_q], "list int, cx int, cq int")
        cut = F.broadcast(cells)
        left = listed.join(cut, "list").select("list", F.pmod(F.xxhash64("vec_id", "v"), F.col("cx").cast("long")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("cq") - 1)).alias("q"), "vec_id", "v")
        right = asked.join(cut, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cx").cast("long") - 1)).alias("x"), F.pmod(F.xxhash64("query_id"), F.col("cq").cast("long")).cast("int").alias("q"), "query_id", "v", "least")

        def cell(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
            got = scan(held.value, a["vec_id"].to_numpy(), _vectors(a["v"]), b["query_id"].to_numpy(), _vectors(b["v"]), k, b["least"].fillna(-np.inf).to_numpy())
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got)))

        by = ["list", "x", "q"]
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(cell, "query_id long, vec_id long, score double")
        return common.written(_best(found, k).select("query_id", "vec_id", "score"), "found")

    none = F.lit(None).cast("double").alias("least")
    near = scanned(asked.filter(F.col("turn") < first).select("query_id", "v", "list", none))
    least = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    far = scanned(asked.filter(F.col("turn") >= first).join(least, "query_id", "left").select("query_id", "v", "list", "least")) if probes > first else near.limit(0)
    found = common.written(_best(near.union(far), k).select("query_id", "rank", "vec_id", "score"), "best")
    if probes < lists:
        full = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        short = common.written(queries.join(full, "vec_id", "left_anti").select(F.col("vec_id").alias("query_id"), "v"), "short")
        if short.count():
            every = short.select("query_id", "v", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), none)
            more = _best(scanned(every), k).select("query_id", "rank", "vec_id", "score")
            found = found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
