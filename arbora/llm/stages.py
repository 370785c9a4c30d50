"""The operators as stages: each takes (spark, docs, sf_dir) and, but for the last, returns the columns of docs.

Each first lets go of what the stages before held, so that the driver's memory does not add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import mixing, near_dedup, packing, pii, quality
from arbora.llm.common import release, save, table
from arbora.llm.tokens import word_bpe


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from these documents' labels, does not reject. Without any label, all stay;
    null and empty texts are scored as texts without bytes; repeated rows are kept or rejected alike; no rows give none."""
    release(spark)
    labels = table(spark, sf_dir, "labels")
    if not labels.where(F.col("quality").isin(0, 1)).limit(1).count():
        return docs
    model = quality.fit(docs, labels)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # whatever the columns' names
    good = quality.score(plain, model, f"c{docs.columns.index('text')}").where(F.col("score") >= 0.7)
    return good.drop("score").toDF(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows without id or words all stay."""
    release(spark)
    gone = save(near_dedup.groups(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.limit(1).count():  # repeated rows of one id
        left = left.where("doc_id is not null").dropDuplicates(["doc_id"]).union(left.where("doc_id is null"))
    return left


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for private data; null and empty texts and repeated rows as ``pii.replace`` has them."""
    release(spark)
    return pii.replace(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null sources are one source; see ``mixing.mix``."""
    release(spark)
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a window; null texts are their end id; see ``packing.pack``."""
    release(spark)
    return packing.pack(docs, word_bpe())
