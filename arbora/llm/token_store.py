"""Token ids in ORC: stripes with run-length coded integers, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import join_small, running_base, shared_dir, shuffle_partitions, small_batches, table
from arbora.llm.tokens import encoder, slices, word_bpe

SCHEMA = "doc_id long, shard int, local_start long, n_tokens long, token_ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, shards: int | None = None, stripe_mb: int = 16) -> int:
    """Writes (doc_id, text) as ORC files in ascending doc_id order, and returns the number of shards asked for.

    Each file is one shard, a range of doc_id: its rows hold the ids of a document with the end id, and where they start
    within the shard. Null texts count as empty; null doc_ids come first; rows of one doc_id are ordered by their
    text's hash, so repeated rows are all kept. Other columns are not read. The shuffle moves texts once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = shards or shuffle_partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1):
                flat, ends = enc.documents(part.column(1))
                n, ends = np.diff(ends), ends[1:]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + ends - n), pa.array(n), values], ["doc_id", "shard", "local_start", "n_tokens", "token_ids"])
                at += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    (
        rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
        .mapInArrow(encode, SCHEMA).write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_mb << 20)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").orc(path)
    )
    return shards


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids`` the filter reaches ORC, whose stripe statistics and Bloom filters skip the rest."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def starts(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """(shard, base): ids in the shards before. Reads two columns; has a row for each shard."""
    totals = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return running_base(totals, ["shard"], "n", "base").select("shard", "base")


def digest(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids that are in the files, stripes in parallel."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "shard", "local_start", "token_ids").mapInArrow(crc, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
    return join_small(rows, starts(spark, path, shards), ["shard"], shards).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_orc_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens.orc")
    shards = write_tokens(table(spark, sf_dir, "documents"), path, word_bpe())
    return digest(spark, path, shards)
