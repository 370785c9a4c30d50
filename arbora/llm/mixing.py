"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import join_small, save, table

#: A source's words are repeated so often at most.
MOST_COPIES = 3
#: Documents of a source in one bucket of the ranking, about.
BUCKET_ROWS = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> and weight, target: weights 1, 2, 3 in turn by code point (null last).

    A target stops at ``cap`` times its source's size; what is above is shared by weight among the others. The level
    at which targets meet caps follows from the sources in the order of cap / weight. A row for each source.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", ((F.row_number().over(one) - 1) % 3 + 1).cast("long")).withColumn("cap", F.col("source_size") * cap)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    # the level if this source and those after it are below their caps; the first that is, sets it
    w = w.withColumn("level", F.col("left_size").cast("double") / F.col("left_weight").cast("double"))
    w = w.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    w = w.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return w.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, _h): the words of each text, and its digest, which tells rows of one id or of none apart."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), text_hash())


def text_hash() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("_h")


def unit(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the text's digest alone: 48 bits of their md5."""
    named = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text)
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def ranked(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Adds what ``plan`` has for the source, the rank _q and its bucket _b to rows of (doc_id, source, _h)."""
    u = unit(F.col("doc_id"), F.col("_h"), seed)
    q = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    rows = join_small(rows.withColumn("_key", source_key()), plan, ["_key"], plan.count()).drop("_key")
    return rows.withColumn("_q", F.when(F.col("_p") > 0, q)).withColumn("_b", F.floor(F.col("_q") / (1 + F.col("_q")) * F.col("_buckets")))


def source_key() -> Column:
    """A join key that tells null from every name."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def thresholds(sizes: DataFrame, seed: str = "mix:") -> DataFrame:
    """``sized`` rows -> a row for each source: what ``ranked`` needs, and the last bucket and rank that are taken.

    Each document is due target / source_size copies: whole ones are certain, the fraction _p is its inclusion
    probability. Documents rank by the odds of a random number over the odds of _p, and are taken by rank as long as the
    source's words hold: a sample of a fixed size in words. For what is lacking, the one other document whose size comes
    nearest is taken. No sort of a source is needed: bucket sums lead to the bucket at the border, and only that one, of
    some BUCKET_ROWS rows, is ordered.
    """
    totals = save(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "sources")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(totals.select("source", "source_size")).withColumn("_key", source_key()).join(totals.select(source_key().alias("_key"), "_n"), "_key")
    plan = plan.withColumn("_whole", F.floor(due)).withColumn("_p", due - F.floor(due))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn("_buckets", F.greatest(F.lit(16), F.ceil(F.col("_n") / BUCKET_ROWS)).cast("long"))
    plan = save(plan.select("_key", "source_size", "target", "_whole", "_p", "_rest", "_buckets"), "plan")
    rows = ranked(sizes, plan, seed).where("_p > 0").select(source_key().alias("_key"), "size", "_rest", "_q", "_b")
    sums = rows.groupBy("_key", "_b").agg(F.sum("size").alias("_s"), F.first("_rest").alias("_rest"))
    run = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    border = sums.withColumn("_before", F.sum("_s").over(run) - F.col("_s")).where("_before <= _rest and _before + _s > _rest").select("_key", "_b", "_before")
    border = save(border, "border")
    within = Window.partitionBy("_key").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    at = join_small(rows, border, ["_key", "_b"], plan.count()).withColumn("_upto", F.col("_before") + F.sum("size").over(within))
    last = at.where("_upto <= _rest").groupBy("_key").agg(F.max("_q").alias("_last_q"), F.max("_upto").alias("_got"))
    plan = plan.join(border.select("_key", F.col("_b").alias("_last_b"), "_before"), "_key", "left").join(last, "_key", "left")
    plan = save(plan.withColumn("_lack", F.col("_rest") - F.coalesce("_got", "_before")).drop("_before", "_got"), "prefix")
    left = ranked(sizes, plan, seed).where(~prefix() & (F.col("_p") > 0)).withColumn("_off", F.abs(F.col("size") - F.col("_lack")))
    one = left.where("_off < _lack").groupBy(source_key().alias("_key")).agg(F.min(F.struct("_off", "_q")).alias("_one"))
    return save(plan.join(one, "_key", "left").withColumn("_one_q", F.col("_one._q")).drop("_one"), "thresholds")


def prefix() -> Column:
    """Is the row's rank within what fits the source's words?"""
    return F.col("_last_b").isNull() | (F.col("_b") < F.col("_last_b")) | ((F.col("_b") == F.col("_last_b")) & F.coalesce(F.col("_q") <= F.col("_last_q"), F.lit(False)))


def copies() -> Column:
    """Of a row that ``ranked`` has joined with thresholds."""
    more = prefix() | F.coalesce(F.col("_q") == F.col("_one_q"), F.lit(False))
    return (F.col("_whole") + F.when((F.col("_p") > 0) & more, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, seed: str = "mix:") -> DataFrame:
    """``docs`` (doc_id, source, text and more), each row as often as the mix takes it.

    Null sources are one source, the last; null and empty texts have no words and come as often as their rank says; rows
    of one doc_id, or of none, rank by their texts, and those of one text, too, share a rank; no rows give no rows; other columns are kept, whatever their names.
    """
    sizes = save(sized(docs), "sizes")
    whole = docs.select("doc_id", "source", text_hash(), F.struct(*docs.columns).alias("_row"))  # whatever their names
    rows = ranked(whole, thresholds(sizes, seed), seed).withColumn("_copies", copies()).where("_copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = save(sized(table(spark, sf_dir, "documents")), "sizes")
    rows = ranked(sizes, thresholds(sizes), "mix:")
    return rows.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER o AS k,
    (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
    (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)
), v AS (
  SELECT CAST(left_size AS DOUBLE) / CAST(left_weight AS DOUBLE) AS level FROM l
  WHERE CAST(left_size AS DOUBLE) / CAST(left_weight AS DOUBLE) * weight <= cap ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM v) * weight), CAST(cap AS DOUBLE)) AS target FROM w
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due FROM t
), q AS (
  SELECT d.doc_id, d.size, d.h, d.source, p.source_size, p.target, CAST(floor(p.due) AS BIGINT) AS whole, p.due - floor(p.due) AS f,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || d.h), 1, 12) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), r AS (
  SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS odds, target - whole * source_size AS rest FROM q
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, h ROWS UNBOUNDED PRECEDING) AS upto FROM r
), g AS (
  SELECT source, coalesce(max(upto) FILTER (upto <= rest), 0) AS got FROM c GROUP BY source
), x AS (
  SELECT c.*, abs(size - (rest - got)) AS off, rest - got AS lack,
    row_number() OVER (PARTITION BY c.source ORDER BY CASE WHEN upto <= rest OR f = 0 THEN 1 ELSE 0 END, abs(size - (rest - got)), odds) AS k
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN f > 0 AND (upto <= rest OR (k = 1 AND off < lack)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x
"""
