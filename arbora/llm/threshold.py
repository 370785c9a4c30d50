"""Exact top-k by inner product: the threshold algorithm over sorted lists, one for each dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import save, table
from arbora.llm.tiles import Tile, finite, over_pairs, pack

#: Rows of a list's first round; each round goes four times as deep.
FIRST = 16
QUERY_TILE = 512


#: Bytes of a score as a sort key: the components are longs, so scores have 126 bits, and more for each doubling of dimensions.
KEY = 24


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """As Python's integers, which do not overflow."""
    return np.array([int(x) for x in v.ravel().tolist()], object).reshape(v.shape)


class Lists:
    """The sorted lists of a tile: for each dimension its rows by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.v = ids, vectors
        self.order = np.argsort(self.v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, self.order, axis=0)
        self.n = len(self.ids)

    def exact(self, q: np.ndarray) -> bool:
        """Are sums of products in doubles exact integers?"""
        return float(np.abs(q).max(initial=0)) * float(np.abs(self.v).max(initial=0)) * len(q) < 2**53

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows for q but ``own``: more score, then smaller id.

        Sorted access goes down the lists from the end that the sign of q asks for; what it meets is scored whole. No row
        that is not met scores above the sum of the lists' values at that depth times q: once that is below the k-th
        score, all k are found. At a tie a smaller id may follow, so equality goes on.
        """
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        rows, scores, depth = np.zeros(0, np.int64), np.zeros(0), min(FIRST, self.n)
        while True:
            met = np.zeros(self.n, bool)
            met[self.order[self.n - depth :, up].ravel()] = True
            met[self.order[:depth, down].ravel()] = True
            if depth == self.n or not len(up) + len(down):
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            part = self.v if len(new) > 0.7 * self.n else self.v[new]
            got = part @ q
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, got[new] if part is self.v else got])
            if len(rows) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= kth
                rows, scores = rows[keep], scores[keep]
                bound = self.sorted[self.n - depth, up] @ q[up] + self.sorted[depth - 1, down] @ q[down]
                if bound < kth and len(new) < self.n:
                    break
            if met.all():
                break
            depth = min(self.n, depth * 4)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k best of all other rows for each vec_id divisible by ``every``.

    Components are floor(scale * x). Each tile of rows answers each tile of queries with its own k best by the threshold
    algorithm; of those the best k stay. Vectors that are null, empty, or hold null or non-finite components, or
    have a null vec_id, take no part; vectors of another length than the query's are no candidates; equal rows are
    candidates each, but a query's own vec_id is none; fewer candidates than k give fewer rows; none, none.

    Rows and queries whose products are no exact doubles are scored in whole numbers, apart from the lists. Components
    beyond a long stand at its ends, and so do scores; ranks go by the whole scores.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = save(vectors.where(finite(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.lit(1).cast("long").alias("weight"), whole.alias("vector")), "vectors")
    n = rows.count()
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "vector"])
    lists = save(pack(rows.repartition(max(1, -(-n // 4096)), "id")), "lists")
    asked = save(pack(queries.repartition(max(1, -(-n // every // QUERY_TILE)), "id"), QUERY_TILE).withColumn("tile", -F.col("tile")), "queries")
    pairs = lists.select(F.col("tile").alias("a"), "dim").join(asked.select(F.col("tile").alias("b"), "dim"), "dim").select("a", "b")

    def kernel(block: Tile, ask: Tile) -> dict[str, np.ndarray]:
        large = np.abs(block.vectors).max(axis=1) > np.sqrt(2**53 / block.vectors.shape[1])
        usual, rest = Lists(block.ids[~large], block.vectors[~large]), whole_numbers(block.vectors[large])
        every = None
        out: list[tuple[int, int, int]] = []
        for own, q in zip(ask.ids.tolist(), ask.vectors, strict=True):
            ids, scores, v = [], [], rest
            if usual.exact(q):
                ids, scores = (x.tolist() for x in usual.top(q, own, k))
                others = block.ids[large]
            else:
                every = whole_numbers(block.vectors) if every is None else every
                others, v = block.ids, every
            if len(others):
                ids, scores = [*ids, *others.tolist()], [*map(int, scores), *(v @ whole_numbers(q)).tolist()]
            best = sorted((-int(x), i) for i, x in zip(ids, scores, strict=True) if i != own)[:k]
            out += [(own, i, -x) for x, i in best]
        query, ids, scores = zip(*out, strict=True) if out else ((), (), ())
        keys = [(x + (1 << (8 * KEY - 1))).to_bytes(KEY, "big") for x in scores]
        clipped = [max(-(1 << 63), min((1 << 63) - 1, x)) for x in scores]
        return {"query_id": np.array(query, np.int64), "vec_id": np.array(ids, np.int64), "score": np.array(clipped, np.int64), "key": pa.array(keys, pa.binary())}

    found = over_pairs(pairs, lists, asked, kernel, "query_id long, vec_id long, score long, key binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
