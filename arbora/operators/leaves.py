"""Aggregates of rows by leaf, as relations: counts, precisions, residual sums, and the leaves' Gram matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.trees import BROADCAST_BYTES, BYTES, leaf_index, leaf_totals


def leaf_sums(rows: DataFrame, trace: DataFrame, weight: Column | None = None, residual: Column | None = None, between: tuple[int, int] | None = None, xb: str = "xb") -> DataFrame:
    """(chain, sample, tree, leaf, n, w, wr); ``between`` restricts it to a range of slots."""
    w = F.lit(1.0) if weight is None else weight
    r = F.lit(0.0) if residual is None else residual
    found = leaf_totals(rows, trace, [w, w * r], xb).withColumnsRenamed({"v0": "w", "v1": "wr"})
    return found.where(F.col("leaf").between(*between)) if between else found


def leaf_gram(rows: DataFrame, trace: DataFrame, weight: Column | None = None, xb: str = "xb") -> DataFrame:
    """(tree_a, leaf_a, tree_b, leaf_b, n, w): how many rows, of what weight, share two leaves of one forest.

    A row's leaves are gathered in an array and paired inside the row: no join on rows, hence no key is needed.
    """
    small = (trace.agg(F.sum(BYTES())).first()[0] or 0) <= BROADCAST_BYTES
    forest = trace.select(F.collect_list(F.struct("tree", "var_tree", "split_tree")).alias("forest"))
    found = rows.select(F.col(xb), (F.lit(1.0) if weight is None else weight).alias("_w")).crossJoin(F.broadcast(forest) if small else forest)
    at = F.transform("forest", lambda t: F.struct(t["tree"].alias("tree"), leaf_index(F.col(xb), t["var_tree"], t["split_tree"]).alias("leaf")))
    one = found.select("_w", at.alias("at")).select("_w", "at", F.explode("at").alias("a")).select("_w", "a", F.explode("at").alias("b"))
    return one.groupBy(F.col("a.tree").alias("tree_a"), F.col("a.leaf").alias("leaf_a"), F.col("b.tree").alias("tree_b"), F.col("b.leaf").alias("leaf_b")).agg(F.count("*").alias("n"), F.sum("_w").alias("w"))


def leaf_terms(sums: DataFrame, tau: float, lam: float) -> DataFrame:
    """Posterior mean and variance of each leaf: tau R / (lam + n tau), 1 / (lam + n tau)."""
    v = F.lit(lam) + F.col("w") * tau
    return sums.withColumn("leaf_mean", F.col("wr") * tau / v).withColumn("leaf_var", 1 / v)


def log_likelihood_ratio(wl: Column, rl: Column, wr: Column, rr: Column, tau: float, lam: float) -> Column:
    """Of a split over none, from the children's precisions and residual sums."""
    v = lambda w: F.lit(tau * tau) / (F.lit(lam) + w * tau)
    v0, vl, vr, vt = F.lit(tau * tau / lam), v(wl), v(wr), v(wl + wr)
    return F.log(vl * vr / (v0 * vt)) / 2 + (rl * rl * vl + rr * rr * vr - (rl + rr) * (rl + rr) * vt) / 2
