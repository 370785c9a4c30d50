"""Vectors packed into tiles, and kernels over pairs of tiles, a pair at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import save, small_batches

#: Rows of a tile; with 64 floats each, one MB.
TILE = 4096
#: Pairs of tiles that a Python worker is handed at a time.
PAIRS = 8
TILE_SCHEMA = "tile long, dim int, n int, ids binary, weights binary, vectors binary"


def finite(v: Column) -> Column:
    """Neither null nor with components that are null or not finite."""
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: F.coalesce((x - x) == 0, F.lit(False))), F.lit(False))


def pack(rows: DataFrame, size: int = TILE, kind: str = "double") -> DataFrame:
    """(id long, weight long, vector array<float|double>) in the order of its partitions -> tiles of one dimension each, whose
    components are kept as ``kind``, float or double."""
    dtype = {"float": np.float32, "double": np.float64}[kind]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal k
            ids, weights, vectors = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            k += 1
            return pa.RecordBatch.from_pylist([{"tile": part * (1 << 32) + k, "dim": dim, "n": len(ids), "ids": ids.tobytes(), "weights": weights.tobytes(), "vectors": vectors.tobytes()}], schema=SCHEMA)

        for batch in batches:
            ids, weights = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            flat, at = batch.column(2).values.to_numpy(zero_copy_only=False).astype(dtype), batch.column(2).offsets.to_numpy()
            for dim in np.unique(np.diff(at)).tolist():
                rows = np.flatnonzero(np.diff(at) == dim)
                for a in range(0, len(rows), size):
                    r = rows[a : a + size]
                    have = sum(len(x[0]) for x in held.get(dim, []))
                    if have and have + len(r) > size:
                        yield out(dim)
                    held.setdefault(dim, []).append((ids[r], weights[r], flat[at[r][:, None] + np.arange(dim)]))
        for dim in list(held):
            yield out(dim)

    SCHEMA = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary())])
    return rows.select("id", "weight", F.col("vector").cast(f"array<{kind}>").alias("vector")).mapInArrow(tiles, TILE_SCHEMA)


class Tile:
    def __init__(self, row: dict):
        self.tile, self.ids, self.weights = row["tile"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
        dtype = np.float32 if len(row["vectors"]) == 4 * row["n"] * row["dim"] else np.float64
        self.vectors = np.frombuffer(row["vectors"], dtype).reshape(row["n"], row["dim"]).astype(np.float64)


def over_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, kernel: Callable[[Tile, Tile], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``kernel`` on the tiles of each pair (a, b), of which one task holds two at a time. ``left`` and ``right`` may be one table."""
    parts = pairs.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("tile")).join(left, "tile")
    parts = parts.union(pairs.where("a <> b").select("a", "b", F.lit(1).alias("side"), F.col("b").alias("tile")).join(right, "tile").select(parts.columns))

    def run(got: pa.Table) -> pa.Table:
        rows = sorted(got.to_pylist(), key=lambda r: r["side"])
        return pa.table(kernel(Tile(rows[0]), Tile(rows[-1])))

    return parts.groupBy("a", "b").applyInArrow(run, schema)


def over_own_pairs(tiles: DataFrame, near: Callable[[DataFrame, DataFrame], Column], kernel: Callable[[Tile, Tile], dict[str, np.ndarray]], schema: str, name: str) -> DataFrame:
    """``kernel`` on each unordered pair of saved tiles, own pairs too, that may be ``near``; its rows are saved.

    A task holds the tiles of one file at a time and reads those of another: no tile is shuffled, so pairs take no disk.
    """
    spark, cols = tiles.sparkSession, ["tile", "dim", "n", "ids", "weights", "vectors"]
    a, b = (tiles.select(*[F.col(c).alias(f"{side}_{c}") for c in tiles.columns]) for side in "ab")
    odd = (F.shiftright("a_tile", 32) + F.shiftright("b_tile", 32)) % 2 == 1  # deals out the halves of the square evenly
    once = F.when(odd, F.col("a_tile") > F.col("b_tile")).otherwise(F.col("a_tile") <= F.col("b_tile"))
    pairs = a.join(b.hint("shuffle_replicate_nl"), once & near(a, b)).select(*[f"{side}_{c}" for side in "ab" for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(batch.num_columns)]
                out = kernel(*(Tile(dict(zip(cols, row[at : at + len(cols)], strict=True))) for at in (0, len(cols))))
                yield pa.RecordBatch.from_pydict(out)

    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small_batches(spark, PAIRS)
    try:
        return save(pairs.mapInArrow(run, schema), name)
    finally:
        small_batches(spark, int(rows))
