"""Exact top-k inner products with norm-bucketed pruning.

Vectors become integers and are dealt by a hash of their id into blocks of
at most about ``BLOCK`` candidates; queries are dealt into blocks likewise, and every
query block meets every candidate block. Inside a block the candidates are
grouped by length. A query visits the buckets from the longest down with the
score of its k-th best so far: the score divided by its own and the bucket's
greatest length is the local cosine threshold. Above one the bucket is
skipped; a high threshold prunes by the range that the query's largest
coordinates allow; a low one prunes by length. What is left is verified with
exact integer products. Blocks return at most k rows a query; the last step
keeps k of them, thinned before its shuffle.

Defined results: vectors that are null or hold a null or non-finite component
take no part; only vectors of equal dimension meet. Ties go to the smaller
id, and rows that repeat an id are candidates of their own (all but those
with the query's id); of rows that repeat a query's id only one asks, the least
by dimension and bytes. Ids that are null take no part. An empty table gives an
empty result. Products beyond 64 bits are held at the 64-bit limits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpulse.llm.common import shuffle_partitions

BLOCK = 8192
QUERY_BLOCK = 1024
#: lengths in a bucket reach down to this share of its greatest
BUCKET_SHARE = 0.9
BUCKET_ROWS = 2048
#: local cosine threshold from which coordinates prune
COORDINATE_FROM = 0.6
FOCUS = 4
EPS = 1e-9


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype="<i8") for v in vectors])


class Bucket:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.vectors, self.lengths = ids, vectors, lengths
        self.unit = vectors / np.where(lengths == 0, 1.0, lengths)[:, None]
        self.longest = float(lengths[0])


def buckets(ids: np.ndarray, vectors: np.ndarray) -> list[Bucket]:
    """Longest first; each bucket is sorted by length."""
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    out, begin = [], 0
    while begin < len(ids):
        end = int(np.searchsorted(-lengths, -BUCKET_SHARE * lengths[begin], side="right"))
        end = max(begin + 1, min(end, begin + BUCKET_ROWS))
        out.append(Bucket(ids[begin:end], vectors[begin:end], lengths[begin:end]))
        begin = end
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    if most < 2 ** 52:  # sums of whole numbers are exact in doubles
        return np.rint(queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if most < 2 ** 62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def within_range(query: np.ndarray, cosine: float, bucket: Bucket) -> np.ndarray:
    """Candidates whose direction can be within the angle of ``cosine``, by the query's largest coordinates."""
    focus = np.argsort(-np.abs(query))[:FOCUS]
    ok = np.ones(len(bucket.ids), dtype=bool)
    beta = np.arccos(min(1.0, cosine))
    for f in focus:
        alpha = np.arccos(np.clip(query[f], -1.0, 1.0))
        upper = 1.0 if alpha <= beta else np.cos(alpha - beta)
        lower = -1.0 if alpha + beta >= np.pi else np.cos(alpha + beta)
        ok &= (bucket.unit[:, f] <= upper + EPS) & (bucket.unit[:, f] >= lower - EPS)
    return np.flatnonzero(ok)


def search(query_ids: np.ndarray, queries: np.ndarray, found: list[Bucket], k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score): the k best of these candidates for each query."""
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    units = queries / np.where(norms == 0, 1.0, norms)[:, None]
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)

    def add(q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        mine = (scores >= floor[q]) & (ids != query_ids[q])
        if not mine.any():
            return
        scores, ids = np.append(best[q][0], scores[mine]), np.append(best[q][1], ids[mine])
        order = np.lexsort((ids, -scores))[:k]
        best[q] = scores[order], ids[order]
        if len(order) == k:
            floor[q] = scores[order[-1]]

    for bucket in found:
        reach = norms * bucket.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, floor / np.where(reach > 0, reach, 1.0), np.where(floor > 0, np.inf, -np.inf))
        by_length = np.flatnonzero(cosine < COORDINATE_FROM)
        if len(by_length):
            # the prefix that any of these queries can still reach by length
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where((floor[by_length] > 0) & (norms[by_length] > 0), floor[by_length] / norms[by_length], 0.0)
            end = int(np.searchsorted(-bucket.lengths, -(need.min() * (1 - EPS) - EPS), side="right"))
            if end:
                scores = products(queries[by_length], bucket.vectors[:end])
                for row, q in zip(scores, by_length, strict=True):
                    add(q, bucket.ids[:end], row)
        for q in np.flatnonzero((cosine >= COORDINATE_FROM) & (cosine <= 1 + EPS)):
            near = within_range(units[q], float(cosine[q]) * (1 - EPS), bucket)
            if len(near):
                add(q, bucket.ids[near], products(queries[q:q + 1], bucket.vectors[near])[0])
    return [(int(q), int(v), int(s)) for q, (scores, ids) in zip(query_ids, best, strict=True)
            for s, v in zip(scores, ids, strict=True)]


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
          scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` the ``k``
    candidates with the greatest inner product of ``floor(scale * x)``."""
    vec = F.col(vec_col)
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(vec, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(F.col(id_col).isNotNull() & vec.isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"), ints.alias("ints"), F.coalesce(is_query, F.lit(False)).alias("asks"))

    def to_bytes(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "dim": [len(v) for v in batch["ints"]], "asks": batch["asks"],
                                "vec": [np.asarray(v, dtype="<i8").tobytes() for v in batch["ints"]]})

    packed = rows.mapInPandas(to_bytes, "id long, dim int, asks boolean, vec binary")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks = max(shuffle_partitions(vectors.sparkSession), -(-size["n"] // BLOCK))  # at least one a task
    query_blocks = max(1, -(-size["q"] // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own, ask = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks))
    candidates = packed.select("id", "dim", "vec", own.alias("block"),
                               every(query_blocks).alias("part"))
    # of rows that repeat a query's id one asks
    asked = packed.where("asks").groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("q")).select("id", "q.*")
    queries = asked.select("id", "dim", "vec", ask.alias("part"), every(blocks).alias("block"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        for dim, asked in right.groupby("dim"):
            there = left[left["dim"] == dim]
            if len(there):
                found = buckets(there["id"].to_numpy(), _matrix(there["vec"]))
                out += search(asked["id"].to_numpy(), _matrix(asked["vec"]), found, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = candidates.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(
        meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
