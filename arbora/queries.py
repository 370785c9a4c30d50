"""Queries over the driver's tables, each with SQL of the same result, or without where it is a random fit."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.special import ndtr, ndtr_sql
from arbora.operators import binning, calibrate, checks, leaves, trees
from arbora.operators.encode import Encoder
from arbora.plans import callbacks, diagnostics, prior, sweep
from arbora.plans.estimator import Bart, Sparse, effective_predictors
from arbora.plans.moves import Proposer, Tree
from arbora.plans.sampler import Rows, log_p_theta
from arbora.sources import rtext, synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# A forest of known trees: features are the quantity, the discount in percent and the line number.
HEAPS = [([0, 0, 1, 0], [0, 25, 5, 0], {4: 1.0, 5: 2.0, 3: 3.0}), ([0, 2, 0, 0], [0, 4, 0, 0], {2: -1.0, 3: 1.0}), ([0, 0, 0, 0], [0, 0, 0, 0], {1: 0.5}), ([0, 1, 0, 0], [0, 3, 0, 40], {2: 0.25, 6: -0.5, 7: 0.75})]
FOREST = [(c, s, i, *HEAPS[h]) for c, s, hs in ((0, 0, (0, 1, 2)), (0, 1, (3, 1, 2)), (1, 0, (0, 3, 3))) for i, h in enumerate(hs)]
MAX_SPLIT = [50, 10, 7]


def slots(leaf: dict[int, float], n: int = 8) -> list[float]:
    return [leaf.get(i, 0.0) for i in range(n)]


def forest(spark: SparkSession, k: int = 1, rows: list | None = None) -> DataFrame:
    """k components: the j-th is j + 1 times the first."""
    return spark.createDataFrame([(c, s, i, v, sp, [[x * (j + 1) for j in range(k)] for x in slots(leaf)]) for c, s, i, v, sp, leaf in rows or FOREST], trees.TRACE)


def forest_sql(rows: list | None = None) -> str:
    values = ", ".join(f"({c}, {s}, {i}, {v}, {sp}, {slots(leaf)}::DOUBLE[])" for c, s, i, v, sp, leaf in rows or FOREST)
    return f"f AS (SELECT * FROM (VALUES {values}) AS x(chain, sample, tree, v, s, l))"


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "lineitem")
    return d.select(F.array(F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.col("l_linenumber")).alias("xb"), "l_extendedprice", "l_tax", "l_returnflag")


ROWS_SQL = "r AS (SELECT [CAST(l_quantity AS INT), CAST(round(l_discount * 100) AS INT), l_linenumber] AS x, l_extendedprice, l_tax, l_returnflag FROM lineitem)"
DOWN = "CASE WHEN n >= 4 OR s[n + 1] = 0 THEN n ELSE 2 * n + CAST(x[v[n + 1] + 1] >= s[n + 1] AS INT) END"
WALK_SQL = f"w AS (SELECT * EXCLUDE (n), {DOWN} AS leaf FROM (SELECT * EXCLUDE (n), {DOWN} AS n FROM (SELECT *, 1 AS n FROM r CROSS JOIN f)))"
WITH = f"WITH {forest_sql()}, {ROWS_SQL}, {WALK_SQL} "
NODES_SQL = "nd AS (SELECT chain, sample, tree, v, s, l, n AS node FROM f, range(1, 8) AS q(n) WHERE n = 1 OR s[n // 2 + 1] <> 0)"
INNER = "(node < 4 AND s[least(node, 3) + 1] <> 0)"


# binning


@query("WITH m AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 256 AS step FROM lineitem) SELECT CAST(greatest(0, least(255, ceil((l_extendedprice - lo) / step) - 1)) AS INT) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1")
def bin_even(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem")
    b = binning.RangeEvenBinner(d, ["l_extendedprice"], 256)
    return d.groupBy(b.column(0).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS INT) AS bin, CAST(15 AS INT) AS above, count(*) AS n FROM lineitem")
def bin_even_constant(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").withColumn("c", F.lit(7.0))
    b = binning.RangeEvenBinner(d, ["c"], 16)
    return d.select(b.column(0).cast("int").alias("bin"), F.col("c")).withColumn("c", F.col("c") + 1).groupBy("bin", b.column(0).cast("int").alias("above")).agg(F.count("*").alias("n"))


def _quantile_sql(table: str, column: str, bins: int) -> str:
    m = bins - 1
    return f"""c AS (SELECT k, c FROM (SELECT *, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM (
      SELECT v + (lead(v) OVER (ORDER BY v) - v) / 2 AS c FROM (SELECT DISTINCT CAST({column} AS DOUBLE) AS v FROM {table} WHERE {column} IS NOT NULL)) WHERE c IS NOT NULL)
      JOIN (SELECT range AS k FROM range(1, {bins})) ON CASE WHEN n <= {m} THEN k = i + 1 ELSE round_even(CAST(-1 + k * (n + 1) / CAST({bins} AS DOUBLE) AS DOUBLE), 0) = i END)"""


@query("WITH " + _quantile_sql("part", "p_retailprice", 64) + " SELECT CAST(k AS BIGINT) AS k, round(c, 6) AS c FROM c")
def cut_quantile_unique(spark, sf_dir):
    return binning.quantile_cuts(t(spark, sf_dir, "part").select(F.lit(0).alias("j"), F.col("p_retailprice").alias("v")), 64).select("k", r6(F.col("c")).alias("c"))


@query("WITH " + _quantile_sql("lineitem", "l_quantity", 32) + " SELECT CAST(bin AS INT) AS bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM c WHERE c.c < l_quantity) AS bin FROM lineitem) GROUP BY 1")
def bin_quantile(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem")
    b = binning.UniqueQuantileBinner(d, ["l_quantity"], 32, max_subsample=None)
    return d.groupBy(b.column(0).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice > 1000 AS INT) + CAST(o_totalprice > 50000 AS INT) + CAST(o_totalprice > 150000.5 AS INT) + CAST(o_totalprice > 300000 AS INT) AS INT) AS bin FROM orders")
def bin_given_splits(spark, sf_dir):
    b = binning.GivenSplitsBinner(["o_totalprice"], [[1000, 50000, 150000.5, float("nan"), 300000]])
    return t(spark, sf_dir, "orders").select("o_orderkey", b.column(0).cast("int").alias("bin"))


@query("SELECT CAST(2 AS INT) AS var")
def blocked_predictors(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").withColumn("c", F.lit(1.0))
    b = binning.UniqueQuantileBinner(d, ["l_quantity", "l_discount", "c"], 16, max_subsample=None)
    return spark.createDataFrame([(j,) for j in b.blocked()], "var int")


# encoding

_TYPES = "SELECT DISTINCT p_type FROM part"


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(rank AS INT) AS hot, CAST(1 AS DOUBLE) AS total FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS rank FROM (" + _TYPES + ")) USING (p_type)")
def encode_one_hot(spark, sf_dir):
    d = t(spark, sf_dir, "part")
    e = Encoder(levels="observed").fit(d.select("p_size", "p_type"))
    hot = F.array(*[F.col(f"`{n}`") for n in e.names[1:]])
    return e.transform(d).select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.array_position(hot, 1.0) - 1).cast("int").alias("hot"), F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).alias("total"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderkey, CAST(list_position(" + str(PRIORITIES) + ", o_orderpriority) - 1 AS DOUBLE) AS priority FROM orders")
def encode_ordinal(spark, sf_dir):
    d = t(spark, sf_dir, "orders")
    e = Encoder({"o_orderpriority": PRIORITIES}, {"o_orderpriority"}).fit(d, ["o_orderpriority"])
    return e.transform(d).select("o_orderkey", F.col("o_orderpriority").alias("priority"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT)::DOUBLE AS final FROM orders")
def encode_bool(spark, sf_dir):
    d = t(spark, sf_dir, "orders").withColumn("final", F.col("o_orderstatus") == "F")
    return Encoder().fit(d, ["final"]).transform(d).select("o_orderkey", "final")


@query("SELECT 'p_size' AS name, CAST(3 AS DOUBLE) AS weight UNION ALL SELECT 'p_type=' || p_type, round(CAST(1 AS DOUBLE) / (SELECT count(*) FROM (" + _TYPES + ")), 6) FROM (" + _TYPES + ")")
def weights_expanded(spark, sf_dir):
    e = Encoder(levels="observed").fit(t(spark, sf_dir, "part").select("p_size", "p_type"))
    return spark.createDataFrame(list(zip(e.names, [round(w, 6) for w in e.weights([3.0, 1.0])], strict=True)), "name string, weight double")


# calibration


@query("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean FROM orders")
def offset_continuous(spark, sf_dir):
    return t(spark, sf_dir, "orders").agg(*calibrate.offset_columns(F.col("o_totalprice"), False)).select("n", r6(F.col("mean")).alias("mean"))


@query("SELECT count(toxic) AS n, round(greatest(1.0 / (count(toxic) + 1), least(count(toxic) / (count(toxic) + 1.0), avg(CAST(toxic <> 0 AS INT)))), 6) AS mean FROM labels")
def offset_binary_prop(spark, sf_dir):
    return t(spark, sf_dir, "labels").agg(*calibrate.offset_columns(F.col("toxic"), True)).select("n", r6(F.col("mean")).alias("mean"))


@query("SELECT count(y) AS n, round(avg(y), 6) AS mean FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS y FROM orders)")
def offset_masked(spark, sf_dir):
    return t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("y")).agg(*calibrate.offset_columns(F.col("y"), False)).select("n", r6(F.col("mean")).alias("mean"))


@query("SELECT round(pow(2 * sqrt(200.0) / ((max(l_tax) - min(l_tax)) / 2), 2), 6) AS lam FROM lineitem")
def leaf_prior_precision(spark, sf_dir):
    return spark.createDataFrame([(round(calibrate.leaf_precision(t(spark, sf_dir, "lineitem"), "l_tax", 200), 6),)], "lam double")


@query("SELECT count(*) AS n, round(var_pop(l_quantity), 6) AS variance FROM lineitem")
def response_variance(spark, sf_dir):
    return calibrate.response_variance(t(spark, sf_dir, "lineitem"), "l_quantity").select("n", r6(F.col("variance")).alias("variance"))


@query("WITH d AS (SELECT l_quantity AS y, 1 / ((1 + l_tax) * (1 + l_tax)) AS w FROM lineitem WHERE l_linenumber <> 3), m AS (SELECT count(*) AS n, sum(w * y) / sum(w) AS mean FROM d) SELECT n, round(mean, 6) AS mean, round(sum(w * (y - mean) * (y - mean)) / n, 6) AS variance FROM d, m GROUP BY n, mean")
def response_variance_weighted(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("y"), (1 + F.col("l_tax")).alias("s"))
    return calibrate.response_variance(d, "y", "s").select("n", r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance"))


@query("SELECT round((regr_syy(l_quantity, l_discount) - regr_sxy(l_quantity, l_discount) * regr_sxy(l_quantity, l_discount) / regr_sxx(l_quantity, l_discount)) / (count(*) - 2), 4) AS sigma2 FROM lineitem")
def ols_sigma2(spark, sf_dir):
    return spark.createDataFrame([(round(calibrate.ols_sigma2(t(spark, sf_dir, "lineitem"), ["l_discount"], ["l_quantity"])[0], 4),)], "sigma2 double")


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS y FROM orders")
def standardize_y(spark, sf_dir):
    d = t(spark, sf_dir, "orders")
    m, s = calibrate.standardized(d, "o_totalprice")
    return d.select("o_orderkey", r6((F.col("o_totalprice") - m) / s).alias("y"))


@query("SELECT CAST(count_if(l_linenumber <> 3) AS BIGINT) AS n_valid, round(sum(CASE WHEN l_linenumber <> 3 THEN 1 / ((1 + l_tax) * (1 + l_tax)) ELSE 0 END), 4) AS w FROM lineitem")
def precision_scale_attrs(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("y"), (1 + F.col("l_tax")).alias("s"))
    return calibrate.precision_scales(d, "s", "y").agg(F.count("y").alias("n_valid"), F.round(F.sum("w"), 4).alias("w"))


@query("SELECT CAST(d AS INT) AS depth, CASE WHEN d = 5 THEN 0.0 ELSE round(0.95 / pow(1 + d, 2), 6) END::DOUBLE AS p FROM range(6) AS q(d)")
def p_nonterminal(spark, sf_dir):
    return spark.createDataFrame([(d, round(p, 6)) for d, p in enumerate(calibrate.p_nonterminal(6))], "depth int, p double")


# trees


@query(WITH + "SELECT chain, sample, tree, leaf, count(*) AS n FROM w GROUP BY ALL")
def traverse_forest(spark, sf_dir):
    return trees.traverse(line_rows(spark, sf_dir), forest(spark)).groupBy("chain", "sample", "tree", "leaf").agg(F.count("*").alias("n"))


@query(WITH + "SELECT l_returnflag, chain, sample, round(sum(l[leaf + 1]), 6) AS f FROM w GROUP BY ALL")
def evaluate_forest_sum(spark, sf_dir):
    d = trees.evaluate(line_rows(spark, sf_dir), forest(spark), ["l_returnflag", "chain", "sample"])
    return d.select("l_returnflag", "chain", "sample", r6(F.col("f")[0]).alias("f"))


@query(WITH + "SELECT chain, sample, tree, round(sum(l[leaf + 1]), 6) AS f FROM w GROUP BY ALL")
def evaluate_per_tree(spark, sf_dir):
    d = trees.evaluate(line_rows(spark, sf_dir), forest(spark), ["chain", "sample", "tree"])
    return d.select("chain", "sample", "tree", r6(F.col("f")[0]).alias("f"))


@query(WITH + "SELECT chain, sample, round(sum(l[leaf + 1]), 6) AS f0, round(sum(2 * l[leaf + 1]), 6) AS f1 FROM w GROUP BY ALL")
def evaluate_multivariate(spark, sf_dir):
    d = trees.evaluate(line_rows(spark, sf_dir), forest(spark, 2), ["chain", "sample"])
    return d.select("chain", "sample", r6(F.col("f")[0]).alias("f0"), r6(F.col("f")[1]).alias("f1"))


@query(WITH + "SELECT l_returnflag, round(sum(l[leaf + 1]), 6) AS f FROM w WHERE chain = 0 AND sample = 0 GROUP BY ALL")
def evaluate_compiled(spark, sf_dir):
    d = line_rows(spark, sf_dir)
    rows = [x for x in forest(spark).collect() if (x.chain, x.sample) == (0, 0)]
    return d.groupBy("l_returnflag").agg(r6(F.sum(trees.compiled(rows, [F.col("xb")[j] for j in range(3)]))).alias("f"))


O_ROWS = "r AS (SELECT o_orderkey, [CAST(o_totalprice / 10000 AS INT), CAST(o_custkey % 11 AS INT), CAST(o_orderkey % 8 AS INT)] AS x, o_totalprice FROM orders)"
O_WITH = f"WITH {forest_sql()}, {O_ROWS}, {WALK_SQL}, p AS (SELECT o_orderkey, chain, sample, 0.1 + sum(l[leaf + 1]) AS f FROM w GROUP BY ALL) "


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array(F.round(F.col("o_totalprice") / 10000).cast("int"), (F.col("o_custkey") % 11).cast("int"), (F.col("o_orderkey") % 8).cast("int"))
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", x.alias("xb"))


@query(O_WITH + "SELECT o_orderkey, chain, sample, round(f, 6) AS f FROM p")
def latent_samples(spark, sf_dir):
    return trees.latent(order_rows(spark, sf_dir), ["o_orderkey"], forest(spark), [0.1]).select("o_orderkey", "chain", "sample", r6(F.col("latent")[0]).alias("f"))


@query(O_WITH + "SELECT o_orderkey, round(avg(f), 6) AS f FROM p GROUP BY ALL")
def posterior_mean(spark, sf_dir):
    return trees.latent(order_rows(spark, sf_dir), ["o_orderkey"], forest(spark), [0.1], mean=True).select("o_orderkey", r6(F.col("latent")[0]).alias("f"))


@query(O_WITH + "SELECT o_orderkey, round(quantile_cont(f, 0.25), 6) AS lo, round(quantile_cont(f, 0.5), 6) AS mid, round(quantile_cont(f, 0.75), 6) AS hi FROM p GROUP BY ALL")
def posterior_quantiles(spark, sf_dir):
    d = trees.latent(order_rows(spark, sf_dir), ["o_orderkey"], forest(spark), [0.1]).withColumn("f", F.col("latent")[0])
    return d.groupBy("o_orderkey").agg(*[r6(F.expr(f"percentile(f, {q})")).alias(n) for n, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))])


@query(O_WITH + f"SELECT o_orderkey, round(avg({ndtr_sql('f')}), 6) AS p FROM p GROUP BY ALL")
def prob_mean(spark, sf_dir):
    d = trees.latent(order_rows(spark, sf_dir), ["o_orderkey"], forest(spark), [0.1])
    return d.groupBy("o_orderkey").agg(r6(F.avg(ndtr(F.col("latent")[0]))).alias("p"))


@query(O_WITH + f"SELECT o_orderkey, CAST(avg({ndtr_sql('f')}) > 0.9 AS INT) AS class FROM p GROUP BY ALL")
def class_pred(spark, sf_dir):
    d = trees.latent(order_rows(spark, sf_dir), ["o_orderkey"], forest(spark), [0.1])
    return d.groupBy("o_orderkey").agg((F.avg(ndtr(F.col("latent")[0])) > 0.9).cast("int").alias("class"))


# aggregates by leaf

_W = "1 / ((1 + l_tax) * (1 + l_tax))"
_SUMS = f"SELECT chain, sample, tree, leaf, count(*) AS n, sum({_W}) AS w, sum({_W} * (l_extendedprice / 10000)) AS wr FROM w GROUP BY ALL"


def sums(spark: SparkSession, sf_dir: str, **kw: object) -> DataFrame:
    return leaves.leaf_sums(line_rows(spark, sf_dir), forest(spark), 1 / ((1 + F.col("l_tax")) * (1 + F.col("l_tax"))), F.col("l_extendedprice") / 10000, **kw)


@query(WITH + f"SELECT chain, sample, tree, leaf, n, round(w, 4) AS w, round(wr, 4) AS wr FROM ({_SUMS})")
def leaf_sums(spark, sf_dir):
    return sums(spark, sf_dir).select("chain", "sample", "tree", "leaf", "n", F.round("w", 4).alias("w"), F.round("wr", 4).alias("wr"))


@query(WITH + f"SELECT chain, sample, tree, leaf, n FROM ({_SUMS}) WHERE leaf BETWEEN 4 AND 5")
def leaf_sums_subset(spark, sf_dir):
    return sums(spark, sf_dir, between=(4, 5)).select("chain", "sample", "tree", "leaf", "n")


@query(WITH + f"SELECT chain, sample, tree, leaf, round(2.0 * wr / (1.5 + 2.0 * w), 6) AS leaf_mean, round(1 / (1.5 + 2.0 * w), 9) AS leaf_var FROM ({_SUMS})")
def leaf_posterior_mean(spark, sf_dir):
    return leaves.leaf_terms(sums(spark, sf_dir), 2.0, 1.5).select("chain", "sample", "tree", "leaf", r6(F.col("leaf_mean")).alias("leaf_mean"), F.round("leaf_var", 9).alias("leaf_var"))


_V = "(0.0004 / (1.5 + {} * 0.02))"


@query(WITH + f", s AS ({_SUMS}), q AS (SELECT a.chain, a.sample, a.tree, a.w AS wl, a.wr AS rl, b.w AS w2, b.wr AS r2 FROM s a JOIN s b ON a.chain = b.chain AND a.sample = b.sample AND a.tree = b.tree AND a.leaf % 2 = 0 AND b.leaf = a.leaf + 1) SELECT chain, sample, tree, round(ln({_V.format('wl')} * {_V.format('w2')} / ((0.0004 / 1.5) * {_V.format('(wl + w2)')})) / 2 + (rl * rl * {_V.format('wl')} + r2 * r2 * {_V.format('w2')} - (rl + r2) * (rl + r2) * {_V.format('(wl + w2)')}) / 2, 4) AS llr FROM q")
def log_likelihood_ratio(spark, sf_dir):
    s = sums(spark, sf_dir)
    a = s.where("leaf % 2 = 0").select("chain", "sample", "tree", "leaf", F.col("w").alias("wl"), F.col("wr").alias("rl"))
    b = s.select("chain", "sample", "tree", (F.col("leaf") - 1).alias("leaf"), F.col("w").alias("w2"), F.col("wr").alias("r2"))
    d = a.join(b, ["chain", "sample", "tree", "leaf"])
    return d.select("chain", "sample", "tree", F.round(leaves.log_likelihood_ratio(F.col("wl"), F.col("rl"), F.col("w2"), F.col("r2"), 0.02, 1.5), 4).alias("llr"))


@query(f"WITH {forest_sql()}, r AS (SELECT row_number() OVER () AS id, [CAST(l_quantity AS INT), CAST(round(l_discount * 100) AS INT), l_linenumber] AS x FROM lineitem), {WALK_SQL} SELECT a.tree AS tree_a, a.leaf AS leaf_a, b.tree AS tree_b, b.leaf AS leaf_b, count(*) AS n FROM w a JOIN w b ON a.id = b.id AND a.chain = 0 AND a.sample = 0 AND b.chain = 0 AND b.sample = 0 GROUP BY ALL")
def leaf_gram(spark, sf_dir):
    return leaves.leaf_gram(line_rows(spark, sf_dir), forest(spark).where("chain = 0 and sample = 0")).select("tree_a", "leaf_a", "tree_b", "leaf_b", "n")


@query(O_WITH + "SELECT chain, sample, round(sum((o_totalprice / 100000 - f) * (o_totalprice / 100000 - f)), 4) AS rss FROM p JOIN orders USING (o_orderkey) GROUP BY ALL")
def residual_ss(spark, sf_dir):
    d = trees.latent(order_rows(spark, sf_dir), ["o_orderkey", "o_totalprice"], forest(spark), [0.1])
    e = F.col("o_totalprice") / 100000 - F.col("latent")[0]
    return d.groupBy("chain", "sample").agg(F.round(F.sum(e * e), 4).alias("rss"))


# shapes of trees


@query(f"WITH {forest_sql()}, {NODES_SQL} SELECT chain, sample, CAST(var AS INT) AS var, CAST(count_if({INNER} AND v[least(node, 3) + 1] = var) AS BIGINT) AS splits FROM nd, range(3) AS q(var) GROUP BY ALL")
def var_histogram(spark, sf_dir):
    return trees.var_histogram(forest(spark), 3, ["chain", "sample"])


@query(f"WITH {forest_sql()}, {NODES_SQL} SELECT CAST(var AS INT) AS var, round(count_if({INNER} AND v[least(node, 3) + 1] = var) / 3, 6) AS splits FROM nd, range(3) AS q(var) GROUP BY ALL")
def varcount_mean(spark, sf_dir):
    return trees.var_histogram(forest(spark), 3, ["chain", "sample"]).groupBy("var").agg(r6(F.avg("splits")).alias("splits"))


@query("SELECT CAST(v AS INT) AS var, CASE WHEN v = 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS prob FROM range(3) AS q(v)")
def varprob_uniform(spark, sf_dir):
    from arbora.plans.sampler import Model, State

    p = State(Model(max_split=[50, 0, 7], offset=[0.0], leaf_prec=[[1.0]], binary=[False], trees=1), 0, 1).varprob()
    return spark.createDataFrame(list(enumerate(p)), "var int, prob double")


_DEPTH = "CASE WHEN s[3] <> 0 OR s[4] <> 0 THEN 2 WHEN s[2] <> 0 THEN 1 ELSE 0 END"


@query(f"WITH {forest_sql()} SELECT chain, sample, CAST({_DEPTH} AS INT) AS depth, count(*) AS trees FROM f GROUP BY ALL")
def depth_distr(spark, sf_dir):
    return trees.depth_distr(forest(spark))


@query(f"WITH {forest_sql()} SELECT chain, sample, round(avg(len(list_filter(s, lambda z: z <> 0)) + 1), 6) AS mean_leaves FROM f GROUP BY ALL")
def mean_leaves(spark, sf_dir):
    return trees.mean_leaves(forest(spark)).withColumn("mean_leaves", r6(F.col("mean_leaves")))


@query(f"WITH {forest_sql()}, {NODES_SQL} SELECT chain, sample, tree, CAST(node AS INT) AS node, CAST(floor(log2(node)) AS INT) AS depth, NOT {INNER} AS is_leaf, {INNER} AND NOT coalesce(node = 1 AND (s[3] <> 0 OR s[4] <> 0), false) AS leaves_parent FROM nd")
def actual_leaves(spark, sf_dir):
    return trees.nodes(forest(spark)).select("chain", "sample", "tree", "node", "depth", "is_leaf", "leaves_parent")


_LEAFN = f"WITH {forest_sql()}, {ROWS_SQL}, {WALK_SQL}, {NODES_SQL}, g AS (SELECT chain, sample, tree, leaf AS node, count(*) AS n FROM w GROUP BY ALL) "


@query(_LEAFN + f"SELECT chain, sample, coalesce(n, 0) AS points, count(*) AS nodes FROM (SELECT * FROM nd WHERE NOT {INNER}) LEFT JOIN g USING (chain, sample, tree, node) GROUP BY ALL")
def points_per_leaf(spark, sf_dir):
    return trees.points_per_node(line_rows(spark, sf_dir), forest(spark))


@query(_LEAFN + f", h AS (SELECT chain, sample, tree, node // 2 AS node, sum(n) AS n FROM g GROUP BY ALL) SELECT chain, sample, CAST(coalesce(n, 0) AS BIGINT) AS points, count(*) AS nodes FROM (SELECT * FROM nd WHERE {INNER} AND NOT (node = 1 AND (s[3] <> 0 OR s[4] <> 0))) LEFT JOIN h USING (chain, sample, tree, node) GROUP BY ALL")
def points_per_decision_node(spark, sf_dir):
    return trees.points_per_node(line_rows(spark, sf_dir), forest(spark), parents=True)


DEEP = [(0, 0, 0, [0, 0, 0, 0], [0, 20, 10, 30], {4: 1.0, 5: 2.0, 6: 3.0, 7: 4.0}), (0, 0, 1, [0, 0, 1, 0], [0, 20, 5, 21], {4: 1.0, 5: 2.0, 6: 3.0, 7: 4.0})]


@query(f"WITH {forest_sql(DEEP)}, {NODES_SQL} SELECT tree, CAST(node AS INT) AS node, CAST(v[node + 1] AS INT) AS var, CAST(CASE WHEN node = 3 AND v[4] = v[2] THEN s[2] + 1 ELSE 1 END AS INT) AS lo, CAST(CASE WHEN node = 2 AND v[3] = v[2] THEN s[2] ELSE [50, 10, 7][v[node + 1] + 1] + 1 END AS INT) AS hi FROM nd WHERE {INNER}")
def split_ranges(spark, sf_dir):
    return trees.split_range(forest(spark, rows=DEEP), MAX_SPLIT).select("tree", "node", "var", "lo", "hi")


@query("SELECT CAST(n AS INT) AS node, CASE WHEN n = 1 THEN []::INT[] WHEN n < 4 THEN [1] ELSE [CAST(n // 2 AS INT), 1] END::VARCHAR AS up FROM range(1, 8) AS q(n)")
def ancestor_nodes(spark, sf_dir):
    d = spark.range(1, 8).select(F.col("id").cast("int").alias("node"))
    return d.select("node", F.concat(F.lit("["), F.concat_ws(", ", trees.ancestors(F.col("node")).cast("array<string>")), F.lit("]")).alias("up"))


BAD = [
    (0, 0, 0, [0, 0, 1, 0], [0, 25, 5, 0], {4: 1.0}), (0, 1, 0, [0, 0, 1, 0], [0, 0, 5, 0], {1: 1.0}), (0, 2, 0, [0, 5, 0, 0], [0, 3, 0, 0], {2: 1.0}),
    (0, 3, 0, [0, 1, 0, 0], [0, 11, 0, 0], {2: 1.0}), (0, 4, 0, [0, 0, 0, 0], [0, 20, 25, 0], {4: 1.0}), (0, 5, 0, [1, 0, 0, 0], [0, 20, 0, 0], {2: 1.0}), (0, 6, 0, [0, 0, 1, 0], [0, 25, 5, 0], {4: 1.0}),
]
BAD_BITS = [0, 16 + 64, 128, 256, 32, 4, 0]


@query("SELECT CAST(sample AS INT) AS sample, CAST(error AS INT) AS error, goes_bad FROM (VALUES " + ", ".join(f"({i}, {b}, {str(bool(b) and not BAD_BITS[i - 1]).lower()})" for i, b in enumerate(BAD_BITS)) + ") AS x(sample, error, goes_bad)")
def tree_goes_bad(spark, sf_dir):
    return checks.goes_bad(checks.check_trace(forest(spark, rows=BAD), MAX_SPLIT)).select("sample", "error", "goes_bad")


# diagnostics

DIAG_ROWS = [(c, i, 0.5 + 0.25 * ((i * 7 + c * 3) % 5), 100, 40 + i + c, 90, 30 + 2 * i - c) for c in range(2) for i in range(6)]
_DIAG = "d AS (SELECT * FROM (VALUES " + ", ".join(map(str, DIAG_ROWS)) + ") AS x(chain, iter, prec, grow_prop, grow_acc, prune_prop, prune_acc))"


def diag(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DIAG_ROWS, "chain int, iter int, prec double, grow_prop int, grow_acc int, prune_prop int, prune_acc int")


@query(f"WITH {_DIAG} SELECT chain, round(avg(sqrt(1 / CAST(prec AS DOUBLE))), 6) AS sdev, round(sqrt(avg(1 / CAST(prec AS DOUBLE))), 6) AS root_mean FROM d GROUP BY ALL")
def error_sdev(spark, sf_dir):
    d = diag(spark).select("chain", F.col("iter").alias("sample"), F.array("prec").alias("prec"))
    each = diagnostics.error_sdev(d, [False]).groupBy("chain").agg(r6(F.avg("sdev")).alias("sdev"))
    return each.join(diagnostics.error_sdev(d, [False], ["chain", "component"]).select("chain", r6(F.col("sdev")).alias("root_mean")), "chain")


@query(f"WITH {_DIAG} SELECT chain, round(avg(grow_prop / (grow_prop + prune_prop)), 6) AS grow, round(avg((grow_acc + prune_acc) / (grow_prop + prune_prop)), 6) AS accepted FROM d GROUP BY ALL")
def accept_rates(spark, sf_dir):
    chains: dict[int, callbacks.Stats] = {}
    for chain, _, _, *done in DIAG_ROWS:  # what a callback sees of a chain after each iteration
        seen = SimpleNamespace(done=dict(zip(("grow_prop", "grow_acc", "prune_prop", "prune_acc"), done, strict=True)), trees=[Tree(2, 1)], varprob=lambda: np.ones(2) / 2)
        chains.setdefault(chain, callbacks.Stats()).update([seen])
    reports = [(c, *(x.report()[k] for k in ("grow", "accepted"))) for c, x in chains.items()]
    return spark.createDataFrame(reports, "chain int, grow double, accepted double").select("chain", r6(F.col("grow")).alias("grow"), r6(F.col("accepted")).alias("accepted"))


@query("WITH s AS (SELECT l_linenumber AS var, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1) SELECT round(exp(-sum(p * ln(p))), 6) AS effective FROM s")
def effective_number(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem")
    return effective_predictors(d.groupBy(F.col("l_linenumber").alias("var")).agg((F.count("*") / F.lit(d.count())).alias("prob"))).select(r6(F.col("effective")).alias("effective"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN 'train' ELSE 'test' END AS split FROM orders")
def train_test_split(spark, sf_dir):
    train, test = synth.split(t(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey")
    return train.withColumn("split", F.lit("train")).union(test.withColumn("split", F.lit("test")))


TEXT = "2 1 2\n3\n1 0 24 0\n2 0 0 1.5\n3 0 0 -2.5\n1\n1 0 0 0.25\n"


@query("SELECT sample, node, var, split, CAST(leaf AS DOUBLE) AS leaf FROM (VALUES (0, 1, 0, 25, 0), (0, 2, -1, 0, 1.5), (0, 3, -1, 0, -2.5), (1, 1, -1, 0, 0.25)) AS x(sample, node, var, split, leaf)")
def r_text_trees_import(spark, sf_dir):
    return trees.nodes(rtext.to_trace(spark, TEXT)[1]).select("sample", "node", F.coalesce("var", F.lit(-1)).alias("var"), "split", F.coalesce(F.col("leaf")[0], F.lit(0.0)).alias("leaf"))


@query("WITH q AS (SELECT CAST(d AS INT) AS depth, CASE WHEN d = 5 THEN 0.0 ELSE 0.95 / pow(1 + d, 2) END::DOUBLE AS p FROM range(6) AS r(d)) SELECT a.depth, round(ln(a.p / (1 - a.p)) + 2 * ln(1 - b.p), 6) AS log_odds FROM q a JOIN q b ON b.depth = a.depth + 1")
def log_prior_ratio(spark, sf_dir):
    q = calibrate.p_nonterminal(6)
    d = spark.createDataFrame(list(zip(range(5), q[:-1], q[1:], strict=True)), "depth int, p double, below double")
    return d.select("depth", r6(F.log(F.col("p") / (1 - F.col("p"))) + 2 * F.log(1 - F.col("below"))).alias("log_odds"))


@query("SELECT CAST(p AS INT) AS p, round(0.25 * (2 + (1.0 * 1.8 * 2.5 - 3) / p), 6) AS variance FROM range(2, 12) AS r(p)")
def het_var_closed_form(spark, sf_dir):
    v = [(p, round(synth.Params(p=p, q=0, sigma2_lin=1, sigma2_quad=0, sigma2_eps=1, het_strength=0.5, het_shape="scalar", scale=synth.Scale("gamma", 2.5)).het_variance, 6)) for p in range(2, 12)]
    return spark.createDataFrame(v, "p int, variance double")


@query()
def prior_depths(spark, sf_dir):
    return trees.depth_distr(prior.sample_prior(spark, 200, 20, [20, 20, 3], calibrate.p_nonterminal(6), [1.0], rho=3.0, a=0.5, b=1.0, seed=1))


@query()
def synthetic_rows(spark, sf_dir):
    return synth.Params(p=6, q=2, sigma2_lin=1, sigma2_quad=1, sigma2_eps=1, seed=2).generate(spark, 5000).select("row_id", F.col("y")[0].alias("y"), F.col("mu")[0].alias("mu"))


# fits: random, hence rows only here; tests hold them to laws and to each other

FIT = {"num_trees": 10, "n_burn": 15, "n_save": 10, "num_chains": 2, "seed": 3}


# the sampler's own steps, on sums over a table or on given uniforms


def _steps(d: DataFrame, f: Callable, schema: str) -> DataFrame:
    return d.mapInPandas(lambda it: (f(p) for p in it), schema)


SPOT = ["chain", "sample", "tree", "leaf"]
_SPOT = "chain int, sample int, tree int, leaf int"
TWO, LEAF_TWO = np.array([[2.0, 0.5], [0.5, 1.0]]), np.array([[1.5, 0.3], [0.3, 1.0]])


@query(WITH + f"SELECT chain, sample, tree, leaf, round(2.0 * wr / (1.5 + 2.0 * w) + 1 / sqrt(1.5 + 2.0 * w), 6) AS drawn FROM ({_SUMS})")
def step_leaf_draw(spark, sf_dir):
    one = np.array([[2.0]])

    def f(p):
        a, b = sweep.precision(one, p.w.to_numpy()[None, None]) + 1.5, sweep.score(one, p.wr.to_numpy()[None, None])
        return p[SPOT].assign(drawn=sweep.draw(a, b, np.ones((len(p), 1)))[:, 0])

    return _steps(sums(spark, sf_dir), f, _SPOT + ", drawn double").withColumn("drawn", r6(F.col("drawn")))


_TWO = (
    "s AS (SELECT chain, sample, tree, leaf, count(*) AS n, sum(l_extendedprice / 10000) AS c0, sum(l_tax) AS c1 FROM w GROUP BY ALL), "
    "e AS (SELECT *, 2.0 * n + 1.5 AS a00, 0.5 * n + 0.3 AS a01, n + 1.0 AS a11, 2.0 * c0 + 0.5 * c1 AS b0, 0.5 * c0 + c1 AS b1 FROM s), "
    "d AS (SELECT *, CAST(a00 * a11 - a01 * a01 AS DOUBLE) AS det FROM e)"
)


def two_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.leaf_totals(line_rows(spark, sf_dir), forest(spark), [F.col("l_extendedprice") / 10000, F.col("l_tax")])


def two_terms(p) -> tuple[np.ndarray, np.ndarray]:
    c = np.stack([p.v0.to_numpy(), p.v1.to_numpy()])[None]
    return sweep.precision(TWO, p.n.to_numpy(float)[None, None]) + LEAF_TWO, sweep.score(TWO, c)


@query(
    WITH + f", {_TWO} SELECT chain, sample, tree, leaf, round((a11 * b0 - a01 * b1) / det + (1 - a01 / sqrt(a00) / sqrt(det / a00)) / sqrt(a00), 6) AS f0, "
    "round((a00 * b1 - a01 * b0) / det + 1 / sqrt(det / a00), 6) AS f1 FROM d"
)
def step_leaf_draw_multivariate(spark, sf_dir):
    def f(p):
        drawn = sweep.draw(*two_terms(p), np.ones((len(p), 2)))
        return p[SPOT].assign(f0=drawn[:, 0], f1=drawn[:, 1])

    return _steps(two_sums(spark, sf_dir), f, _SPOT + ", f0 double, f1 double").select(*SPOT, r6(F.col("f0")).alias("f0"), r6(F.col("f1")).alias("f1"))


def _pairs(d: DataFrame, names: list[str], f: Callable) -> DataFrame:
    """The log likelihood ratio of each two sibling leaves."""
    a, b = (d.where(F.col("leaf") % 2 == k).select(*SPOT[:3], (F.col("leaf") - k).alias("leaf"), *[F.col(c).alias(f"{c}_{k}") for c in names]) for k in (0, 1))

    def ratio(p):
        out = []
        for r in p.itertuples():
            two = pd.DataFrame({c: [getattr(r, f"{c}_0"), getattr(r, f"{c}_1")] for c in names})
            out.append(f(two))
        return p[SPOT].assign(ratio=np.array(out, float))

    return _steps(a.join(b, SPOT), ratio, _SPOT + ", ratio double").withColumn("ratio", F.round("ratio", 4))


_EVIDENCE = "(0.5 * ({b} * {b} / {a} - ln({a})))"


@query(
    WITH + f", s AS (SELECT *, CAST(0.02 * w + 1.5 AS DOUBLE) AS a, 0.02 * wr AS b FROM ({_SUMS})) SELECT x.chain, x.sample, x.tree, x.leaf, round(0.5 * ln(1.5) + "
    + _EVIDENCE.format(a="x.a", b="x.b") + " + " + _EVIDENCE.format(a="y.a", b="y.b") + " - " + _EVIDENCE.format(a="(x.a + y.a - 1.5)", b="(x.b + y.b)")
    + ", 4) AS ratio FROM s x JOIN s y ON x.chain = y.chain AND x.sample = y.sample AND x.tree = y.tree AND x.leaf % 2 = 0 AND y.leaf = x.leaf + 1"
)
def step_split_ratio(spark, sf_dir):
    one, prior = np.array([[0.02]]), np.array([[1.5]])

    def f(p):
        return sweep.split_evidence(sweep.precision(one, p.w.to_numpy()[None, None]) + prior, sweep.score(one, p.wr.to_numpy()[None, None]), 0, 1, prior)[0]

    return _pairs(sums(spark, sf_dir), ["w", "wr"], f)


_EVIDENCE_TWO = "(0.5 * (({a11} * {b0} * {b0} - 2 * {a01} * {b0} * {b1} + {a00} * {b1} * {b1}) / ({a00} * {a11} - {a01} * {a01}) - ln({a00} * {a11} - {a01} * {a01})))"


def _two_of(form: str, **less: float) -> str:
    return _EVIDENCE_TWO.format(**{c: form.format(c, less.get(c, 0)) for c in ("a00", "a01", "a11", "b0", "b1")})


@query(
    WITH + f", {_TWO} SELECT x.chain, x.sample, x.tree, x.leaf, round(0.5 * ln(1.41) + {_two_of('CAST(x.{0} AS DOUBLE)')} + {_two_of('CAST(y.{0} AS DOUBLE)')} - "
    f"{_two_of('CAST(x.{0} + y.{0} - {1} AS DOUBLE)', a00=1.5, a01=0.3, a11=1.0)}, 4) AS ratio "
    "FROM d x JOIN d y ON x.chain = y.chain AND x.sample = y.sample AND x.tree = y.tree AND x.leaf % 2 = 0 AND y.leaf = x.leaf + 1"
)
def step_split_ratio_multivariate(spark, sf_dir):
    return _pairs(two_sums(spark, sf_dir), ["n", "v0", "v1"], lambda p: sweep.split_evidence(*two_terms(p), 0, 1, LEAF_TWO)[0])


def heap(i: int) -> Tree:
    """A tree of HEAPS as the sampler has it."""
    out = Tree(3, 1)
    out.var[:], out.split[:] = HEAPS[i][:2]
    return out


@query(WITH + "SELECT tree, leaf, count(*) AS n FROM w WHERE chain = 0 AND sample = 0 GROUP BY ALL")
def step_positions(spark, sf_dir):
    own = [heap(i) for i in range(3)]
    slots = [x.leaves() for x in own]

    def f(p):
        at = Rows(np.arange(len(p)), np.array(p.xb.tolist()).reshape(len(p), -1), np.zeros((len(p), 1)), np.ones((len(p), 1))).positions(own, slots)
        found = [(i, s, int(n)) for i, slot in enumerate(slots) for s, n in zip(slot, np.bincount(at[i], minlength=len(slot)), strict=True) if n]
        return pd.DataFrame(found, columns=["tree", "leaf", "n"])

    return _steps(line_rows(spark, sf_dir).select("xb"), f, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))


UNIFORMS = 200
_UNIFORMS = f"u AS (SELECT CAST(id AS INT) AS id, CAST((id + 0.5) / {UNIFORMS} AS DOUBLE) AS u1, CAST((id * 37 % {UNIFORMS} + 0.5) / {UNIFORMS} AS DOUBLE) AS u2 FROM range({UNIFORMS}) AS r(id))"
CUTS = [50, 10, 0, 7]


def _rules(spark: SparkSession, tree: Tree, node: int, log_s: np.ndarray | None) -> DataFrame:
    who = Proposer(np.array(CUTS), [0.95, 0.2, 0.1, 0.0], None)
    given = [iter(((i + 0.5) / UNIFORMS, (i * 37 % UNIFORMS + 0.5) / UNIFORMS)) for i in range(UNIFORMS)]
    return spark.createDataFrame([(i, *who.rule(tree, node, SimpleNamespace(random=g.__next__), log_s)) for i, g in enumerate(given)], "id int, var int, cut int")


@query(
    f"WITH {_UNIFORMS}, v AS (SELECT *, [0, 1, 3][CAST(floor(u1 * 3) AS INT) + 1] AS var FROM u), b AS (SELECT *, CASE var WHEN 0 THEN 25 ELSE 1 END AS lo, [51, 11, 1, 8][var + 1] AS hi FROM v) "
    "SELECT id, CAST(var AS INT) AS var, CAST(lo + floor(u2 * (hi - lo)) AS INT) AS cut FROM b"
)
def step_rule(spark, sf_dir):
    """At the right child of a cut of variable 0 at 24; variable 2 has no cuts."""
    tree = Tree(4, 1)
    tree.split[1] = 24
    return _rules(spark, tree, 3, None)


@query(
    f"WITH {_UNIFORMS}, v AS (SELECT *, CASE WHEN u1 * 0.6 < 0.5 THEN 0 ELSE 3 END AS var FROM u) "
    "SELECT id, var, CAST(1 + floor(u2 * [50, 10, 0, 7][var + 1]) AS INT) AS cut FROM v"
)
def step_rule_weighted(spark, sf_dir):
    """Where variable 1 has no cut left."""
    tree = Tree(4, 1)
    tree.var[1], tree.split[1] = 1, 10
    return _rules(spark, tree, 3, np.log([0.5, 0.2, 0.2, 0.1]))


@query(
    f"WITH {_UNIFORMS}, q AS (SELECT 0.95 AS q0, 0.2 AS q1, 0.1 AS q2), m AS (SELECT id, tree, tree = 0 OR u2 < 0.5 AS grow, u1, q0, q1, q2 FROM u, q, range(3) AS t(tree)), "
    "n AS (SELECT *, CASE WHEN tree = 0 THEN 1 WHEN tree = 1 THEN CASE WHEN NOT grow THEN 1 WHEN u1 < 0.5 THEN 2 ELSE 3 END "
    "WHEN NOT grow THEN 2 WHEN u1 * (q1 + 2 * q2) < q1 THEN 3 WHEN u1 * (q1 + 2 * q2) < q1 + q2 THEN 4 ELSE 5 END AS node FROM m) "
    "SELECT id, CAST(tree AS INT) AS tree, grow, CAST(node AS INT) AS node, round(-ln(CASE WHEN tree = 0 THEN 1.0 WHEN tree = 1 THEN CASE WHEN grow THEN 0.5 * 0.5 ELSE 1.0 END "
    "WHEN NOT grow THEN 0.5 * q1 / (q1 + q1) WHEN node = 3 THEN 0.5 * 2 * q1 / (q1 + 2 * q2) ELSE 0.5 * q2 / (q1 + 2 * q2) END::DOUBLE), 6) + 0.0 AS log_partial FROM n"
)
def step_proposal(spark, sf_dir):
    """Of a root alone, of one rule, and of two rules below one another."""
    own = [Tree(4, 1) for _ in range(3)]
    own[1].split[1] = own[2].split[1] = own[2].split[2] = 20
    who, out = Proposer(np.array(CUTS), [0.95, 0.2, 0.1, 0.0], None), []
    for i in range(UNIFORMS):
        u = np.array([(i * 37 % UNIFORMS + 0.5) / UNIFORMS, (i + 0.5) / UNIFORMS])
        for k, tree in enumerate(own):
            move = who.propose(tree, SimpleNamespace(random=lambda n=None, u=u: u if n else 0.5), None)
            out.append((i, k, move.grow, move.node, round(float(move.log_partial), 6) + 0.0))
    return spark.createDataFrame(out, "id int, tree int, grow boolean, node int, log_partial double")


@query(
    WITH + ", m AS (SELECT l_extendedprice / 10000 + 0.1 * CASE WHEN x[1] >= 25 THEN 3 WHEN x[2] >= 5 THEN 5 ELSE 4 END AS y, CASE WHEN x[3] >= 4 THEN 3 ELSE 2 END AS leaf FROM r) "
    "SELECT CAST(leaf AS INT) AS leaf, round(sum(y), 4) AS s, round((SELECT sum(y * y) FROM m), 3) AS q FROM m GROUP BY 1"
)
def step_residuals(spark, sf_dir):
    """Sums of residuals by leaf of one tree, and their squares, after the leaves of another have moved by a tenth of their slots."""
    own = [heap(i) for i in range(2)]
    slots = [x.leaves() for x in own]
    where = {(i, s): j for j, (i, s) in enumerate((i, s) for i, x in enumerate(slots) for s in x)}
    d, f = line_rows(spark, sf_dir), forest(spark).where("chain = 0 and sample = 0 and tree < 2")
    y = F.col("l_extendedprice") / 10000
    g, s = np.zeros((len(where), len(where))), np.zeros(len(where))
    for r in leaves.leaf_gram(d, f).collect():  # a row for each two leaves
        g[where[r.tree_a, r.leaf_a], where[r.tree_b, r.leaf_b]] = r.n
    for r in leaves.leaf_sums(d, f, residual=y).collect():
        s[where[r.tree, r.leaf]] = r.wr
    stats = sweep.Gram(np.diag(g), g[None, None], s[None, None], np.array([[d.agg(F.sum(y * y)).first()[0]]]), slots)
    stats.move(0, 0.1 * np.array(slots[0], float)[:, None])
    after = stats.leaf(1)[2][0, 0]
    return spark.createDataFrame([(x, round(float(v), 4), round(float(stats.q[0, 0]), 3)) for x, v in zip(slots[1], after, strict=True)], "leaf int, s double, q double")


@query(
    "WITH g AS (SELECT CAST(i AS INT) AS i, CAST((i + 0.5) / 40 AS DOUBLE) AS x FROM range(40) AS r(i)), h AS (SELECT *, 3.0 * x / (1 - x) AS theta FROM g) "
    "SELECT i, round((0.5 - 1) * ln(x) + (2.0 - 1) * ln(1 - x) + lgamma(theta) - 6 * lgamma(theta / 6) + theta / 6 * (-14.5), 6) AS log_p FROM h"
)
def step_theta(spark, sf_dir):
    log_p = log_p_theta((np.arange(40) + 0.5) / 40, 3.0, 0.5, 2.0, 6, -14.5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(log_p)], "i int, log_p double").withColumn("log_p", r6(F.col("log_p")))


def even(d: DataFrame, f: list[str]) -> binning.Binner:
    return binning.RangeEvenBinner(d, f, 64)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return d.select("o_orderkey", "c_acctbal", "c_nationkey", F.month("o_orderdate").alias("month"), (F.col("o_totalprice") / 1e5).alias("y"), (F.col("o_orderstatus") == "F").cast("int").alias("z"))


X = ["c_acctbal", "c_nationkey", "month"]


@query()
def fit_continuous(spark, sf_dir):
    m = Bart(_orders(spark, sf_dir), X, "y", row_id="o_orderkey", binner=even, **FIT)
    return m.predict("train").select("row_id", F.col("prediction")[0].alias("f"))


@query()
def fit_probit(spark, sf_dir):
    m = Bart(_orders(spark, sf_dir), X, "z", outcome="binary", row_id="o_orderkey", binner=even, **FIT)
    return m.predict("train").select("row_id", F.col("prediction")[0].alias("p"))


@query()
def fit_multivariate(spark, sf_dir):
    m = Bart(_orders(spark, sf_dir), X, ["y", "z"], outcome=["continuous", "binary"], row_id="o_orderkey", binner=even, **FIT)
    return m.predict("train").select("row_id", F.col("prediction")[0].alias("f"), F.col("prediction")[1].alias("p"))


@query()
def fit_sparse(spark, sf_dir):
    m = Bart(_orders(spark, sf_dir), X, "y", row_id="o_orderkey", binner=even, sparse=Sparse(augment=True), **FIT)
    return m.varprob_mean()


@query()
def fit_gram(spark, sf_dir):
    m = Bart(_orders(spark, sf_dir), X, "y", row_id="o_orderkey", binner=even, engine="gram", **FIT | {"n_burn": 3, "n_save": 3})
    return m.predict("train").select("row_id", F.col("prediction")[0].alias("f"))


