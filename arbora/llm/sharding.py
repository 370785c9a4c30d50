"""Consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import table, utf8_bytes

#: Positions of the ring. The plan has some rows more than that, whatever the data's size.
CELLS = 1 << 14


def ring(shards: int, vnodes: int, cells: int = CELLS) -> list[int]:
    """The shard of the first virtual node at or clockwise of each cell."""
    nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s) for s in range(shards) for v in range(vnodes))
    owner, k = [], 0
    for c in range(cells):
        while k < len(nodes) and nodes[k][0] < c:
            k += 1
        owner.append(nodes[k % len(nodes)][1])
    return owner


def plan(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the rows of each cell go, by their rank in the cell.

    A shard takes N // shards rows, or one more for the first N % shards. Cells fill their own shard first; what
    overflows goes on clockwise, to the next shard that still has room, so only the overflow moves.
    """
    room = [sum(counts) // shards + (s < sum(counts) % shards) for s in range(shards)]
    slot, out, over, cells = [0] * shards, [], [], len(counts)

    def put(cell: int, at: int, n: int, shard: int) -> None:
        if n:
            out.append((cell, at, at + n, shard, slot[shard]))
            slot[shard] += n
            room[shard] -= n

    for cell, n in enumerate(counts):
        k = min(n, room[owner[cell]])
        put(cell, 0, k, owner[cell])
        if k < n:
            over.append((cell, k, n - k))
    for cell, at, n in over:
        around = (owner[(cell + d) % cells] for d in range(1, cells))
        for to in chain(around, range(shards)):  # at last, to shards whose nodes others hide
            k = min(n, room[to])
            put(cell, at, k, to)
            at, n = at + k, n - k
            if not n:
                break
    return out


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 100) -> DataFrame:
    """Adds nothing to ``docs`` but returns doc_id, size, text_crc32, shard and slot of each row.

    Law ``rows``: the shards' counts differ by one at most. The key is doc_id (null: the text's hash). Null texts have no
    bytes; repeated rows are placed one by one; no rows give no rows; more columns are not read. Only ids, sizes and
    hashes are shuffled. The driver sees a count for each of ``CELLS`` cells, at any size of the data.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(0))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(17))).otherwise(key)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (utf8_bytes(F.col("text")) + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), key.alias("key"), F.pmod(key, F.lit(CELLS)).cast("int").alias("cell"),
    )
    counts = [0] * CELLS
    for r in docs.select(F.pmod(key, F.lit(CELLS)).cast("int").alias("cell")).groupBy("cell").count().collect():  # CELLS rows at most
        counts[r[0]] = r[1]
    to = spark.createDataFrame(plan(counts, ring(shards, vnodes), shards) or [(0, 0, 0, 0, 0)], "cell int, lo long, hi long, shard int, slot0 long")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id", "text_crc32", "size")).cast("long") - 1
    placed = rows.withColumn("rank", rank).join(F.broadcast(to), "cell").where("rank >= lo and rank < hi")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_bounded_load_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
