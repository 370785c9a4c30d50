"""Epsilon grid order join of vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import save, table
from arbora.llm.components import components
from arbora.llm.tiles import TILE, TILE_SCHEMA, Tile, finite, over_own_pairs, pack

#: Leading principal dimensions that make the grid.
LEAD = 8
#: Vectors the principal axes are fitted on. They set the order only, never a result.
AXES_SAMPLE = 5_000
#: Rows at which an interval is compared rather than split.
LEAF = 256
#: Files of tiles up to which each tile has its own, and tiles of a file beyond: tasks are pairs of files.
FILES, FILE_TILES = 64, 32


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the leading first."""
    u = unit(sample)
    d = u - u.mean(axis=0)
    return np.linalg.eigh(d.T @ d)[1][:, ::-1]


class Joiner:
    """Joins two tiles whose rows are in grid order, by recursion on halves of their intervals."""

    def __init__(self, a: Tile, b: Tile, turn: np.ndarray, cosine: float, eps: float):
        self.same, self.cosine, self.eps = a.tile == b.tile, cosine, eps
        self.tiles = (a, a) if self.same else (a, b)
        self.u = [unit(t.vectors) for t in self.tiles]
        z = [u @ turn for u in self.u]
        self.low = [np.minimum.reduceat(x, np.arange(0, len(x), LEAF)) for x in z]
        self.high = [np.maximum.reduceat(x, np.arange(0, len(x), LEAF)) for x in z]
        self.links = [np.zeros(len(x), np.int64) for x in z]
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.root.setdefault(x, x) != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def far(self, p: tuple[int, int], q: tuple[int, int]) -> bool:
        """Are all rows of the leaves p of one side and q of the other provably more than eps apart?"""
        lo, hi = [self.low[s][a:b].min(axis=0) for s, (a, b) in enumerate((p, q))], [self.high[s][a:b].max(axis=0) for s, (a, b) in enumerate((p, q))]
        gap = np.maximum(0, np.maximum(lo[1] - hi[0], lo[0] - hi[1]))
        return float(gap @ gap) > self.eps**2 + 1e-9

    def join(self, p: tuple[int, int], q: tuple[int, int]) -> None:
        if self.same and q[1] <= p[0] or self.far(p, q):
            return
        if p[1] - p[0] == q[1] - q[0] == 1:
            return self.compare(p[0], q[0])
        halves = lambda r: [(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])] if r[1] - r[0] > 1 else [r]
        for x in halves(p):
            for y in halves(q):
                self.join(x, y)

    def compare(self, p: int, q: int) -> None:
        if self.same and q < p:
            return
        a, b = self.tiles
        i, j = slice(p * LEAF, (p + 1) * LEAF), slice(q * LEAF, (q + 1) * LEAF)
        hit = self.u[0][i] @ self.u[1][j].T >= self.cosine
        if self.same and p == q:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.links[0][i] += hit @ b.weights[j]
        if not self.same or p != q:
            self.links[0 if self.same else 1][j] += hit.T @ a.weights[i]
        rows, cols, most = a.ids[i], b.ids[j], np.iinfo(np.int64).max
        x, y = rows.copy(), cols.copy()
        while True:  # the least id of each row's and column's component in this block
            new_y = np.minimum(y, np.where(hit, x[:, None], most).min(axis=0))
            new_x = np.minimum(x, np.where(hit, new_y[None, :], most).min(axis=1))
            if (new_x == x).all() and (new_y == y).all():
                break
            x, y = new_x, new_y
        for ids, to in ((rows, x), (cols, y)):
            for u, v in zip(ids[to < ids].tolist(), to[to < ids].tolist(), strict=True):
                self.root[self.find(u)] = self.find(v)

    def out(self) -> dict[str, np.ndarray]:
        self.join((0, len(self.low[0])), (0, len(self.low[1])))
        ids = np.concatenate([t.ids for t in self.tiles[: 1 if self.same else 2]])
        links = np.concatenate(self.links[: 1 if self.same else 2])
        ids, links = ids[links > 0], links[links > 0]
        return {"id": ids, "links": links, "root": np.array([self.find(x) for x in ids.tolist()], np.int64)}


def keyed(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with a digest of 16 bytes in the place of their last column, the vector, of which it is as good as distinct."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.columns[-1]
            flat, at = v.values.to_numpy(zero_copy_only=False) + 0.0, v.offsets.to_numpy()  # -0.0 equals 0.0
            keys = [blake2b(flat[i:j].tobytes(), digest_size=16).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], names)

    return rows.mapInArrow(run, schema)


def join(vectors: DataFrame, cosine: float = 0.9, tile: int = TILE) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept): pairs of a cosine of at least ``cosine`` link.

    Equal vectors are one row with a weight, so a vector that holds a third of all rows costs one. Distinct ones are sorted
    by the cells, eps wide, of their leading principal coordinates; tiles of that order join where their boxes in all
    coordinates may be within eps. A pair of tiles gives counts and a spanning forest, not its links. Vectors are shuffled twice,
    when equal ones are found and when they are sorted, and saved twice, as floats where they are floats; pairs are read, not shuffled.
    Vectors that are null, empty, zero, or hold null or non-finite components, and those of a null vec_id, have no links, and
    are their own components; only vectors of one length are compared; rows of one vec_id are vectors of their own that
    share a component if they link; no rows give no rows; other columns are not read.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    good = rows.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull())
    classes = save(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    links, forest = None, None
    for (dim,) in classes.select(F.size("v")).distinct().collect():
        mine = classes.where(F.size("v") == dim)
        sample = mine.orderBy(F.xxhash64("id")).limit(AXES_SAMPLE).select("v").toArrow()
        turn, lead = axes(sample.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)), min(LEAD, dim)

        def cells(batches: Iterator[pa.RecordBatch], turn=turn, lead=lead, dim=dim) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    c = np.floor(unit(x) @ turn[:, :lead] / eps).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c[:, k]) for k in range(lead))], ["id", "weight", "vector", *(f"c{k}" for k in range(lead))])

        def boxes(batches: Iterator[pa.RecordBatch], turn=turn, lead=lead) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = [unit(Tile(row).vectors) @ turn[:, :lead] for row in batch.to_pylist()]
                sides = [pa.array([f(x, 0).tolist() for x in z], pa.list_(pa.float64())) for f in (np.min, np.max)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *sides], [*batch.schema.names, "lo", "hi"])

        grid = [f"c{k}" for k in range(lead)]
        placed = mine.select("id", "weight", F.col("v").alias("vector")).mapInArrow(cells, f"id long, weight long, vector array<{kind}>, " + ", ".join(f"{c} int" for c in grid))
        order, n = [*grid, "id"], max(1, -(-mine.count() // tile))
        spread = placed.repartitionByRange(max(min(n, FILES), -(-n // FILE_TILES)), *order).sortWithinPartitions(*order)
        tiles = save(pack(spread, tile, kind).mapInArrow(boxes, TILE_SCHEMA + ", lo array<double>, hi array<double>"), "tiles")

        def near(a: DataFrame, b: DataFrame) -> Column:
            gaps = F.zip_with(F.zip_with("b_lo", "a_hi", lambda x, y: x - y), F.zip_with("a_lo", "b_hi", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
            return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + 1e-9

        def kernel(x: Tile, y: Tile, turn=turn) -> dict[str, np.ndarray]:
            return Joiner(x, y, turn, cosine, eps).out()

        hits = over_own_pairs(tiles, near, kernel, "id long, links long, root long", "hits")
        counted = hits.groupBy("id").agg(F.sum("links").alias("links"))
        linked = hits.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
        links, forest = (counted, linked) if links is None else (links.union(counted), forest.union(linked))
    own = keyed(classes.select("id", "weight", "v"), "id long, weight long, key binary")
    if links is None:
        own = own.select("key", "weight", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    else:
        comps = components(forest).withColumnRenamed("node", "id")
        own = own.join(links, "id", "left").join(comps, "id", "left").select("key", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    alone = rows.where(~(finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()) | F.col("v").isNull())
    out = keyed(good, "vec_id long, key binary").join(own, "key").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "embeddings"))
