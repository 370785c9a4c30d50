"""Forests drawn from the prior, a row for each tree, by counters: any partition draws the same."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arbora.functions.rng import stream
from arbora.functions.special import loggamma
from arbora.operators.trees import TRACE
from arbora.plans.moves import Proposer, Tree


def sample_theta(rng: np.random.Generator, rho: float, a: float, b: float) -> float:
    x = rng.beta(a, b)
    return rho * x / (1 - x)


def sample_log_s(rng: np.random.Generator, theta: float, p: int) -> np.ndarray:
    g = loggamma(rng, np.full(p, theta / p))
    return g - (g.max() + np.log(np.exp(g - g.max()).sum()))


def grow(rng: np.random.Generator, who: Proposer, leaf_sd: np.ndarray, log_s: np.ndarray | None) -> Tree:
    """One tree: each node that has a rule left splits with its depth's probability, the left child first."""
    tree = Tree(len(who.q), len(leaf_sd))
    todo = [1]
    while todo:
        node = todo.pop()
        d = node.bit_length() - 1
        if d < len(who.q) - 1 and who.has_rule(tree, node) and rng.random() < who.q[d]:
            tree.var[node], tree.split[node] = who.rule(tree, node, rng, log_s)
            todo += [2 * node + 1, 2 * node]
        else:
            tree.leaf[node] = rng.standard_normal(len(leaf_sd)) * leaf_sd
    return tree


@dataclass(frozen=True)
class Selection:
    """Weights of variables: given (log_s, for all samples or for each), Dirichlet of a given theta, of a random theta (rho, a, b), or even."""

    log_s: list[float] | list[list[float]] | None = None
    theta: float | None = None
    rho: float | None = None
    a: float | None = None
    b: float | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.log_s, self.theta, self.rho)) > 1 or (self.rho is None) != (self.a is None) or (self.rho is None) != (self.b is None):
            raise ValueError("give log_s, or theta, or rho, a and b, or none of them")

    def draw(self, rng: np.random.Generator, sample: int, p: int) -> tuple[float | None, np.ndarray | None]:
        """(theta, log_s) of a sample, its stream's first draws; None where there is none."""
        if self.log_s is not None:
            given = np.array(self.log_s, float)
            return None, given if given.ndim == 1 else given[sample]
        if self.theta is None and self.rho is None:
            return None, None
        theta = self.theta if self.theta is not None else sample_theta(rng, self.rho, self.a, self.b)
        return theta, sample_log_s(rng, theta, p)


def sample_weights(spark: SparkSession, samples: int, p: int, selection: Selection, seed: int = 0) -> DataFrame:
    """(chain, sample, theta, log_s): what ``sample_prior`` draws its trees with; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(0).to_pylist():
                theta, log_s = selection.draw(stream(seed, 0, s, 9), s, p)
                out.append({"chain": 0, "sample": s, "theta": theta, "log_s": None if log_s is None else log_s.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chain", pa.int32()), ("sample", pa.int32()), ("theta", pa.float64()), ("log_s", pa.list_(pa.float64()))]))

    return spark.range(samples).mapInArrow(run, "chain int, sample int, theta double, log_s array<double>")


def sample_prior(
    spark: SparkSession, samples: int, trees: int, max_split: list[int], nonterminal: list[float], leaf_sd: list[float], *, log_s: list[float] | list[list[float]] | None = None, theta: float | None = None,
    rho: float | None = None, a: float | None = None, b: float | None = None, seed: int = 0,
) -> DataFrame:
    """A trace of chain 0, with the weights of ``Selection``."""
    selection = Selection(log_s, theta, rho, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who = Proposer(np.array(max_split), list(nonterminal), None)
        for batch in batches:
            out = []
            for s in batch.column(0).to_pylist():
                rng = stream(seed, 0, s, 9)
                _, weights = selection.draw(rng, s, len(max_split))
                for t in range(trees):
                    tree = grow(rng, who, np.array(leaf_sd, float), weights)
                    out.append({"chain": 0, "sample": s, "tree": t, "var_tree": tree.var.tolist(), "split_tree": tree.split.tolist(), "leaf_tree": tree.leaf.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chain", pa.int32()), ("sample", pa.int32()), ("tree", pa.int32()), ("var_tree", pa.list_(pa.int32())), ("split_tree", pa.list_(pa.int32())), ("leaf_tree", pa.list_(pa.list_(pa.float64())))]))

    return spark.range(samples).mapInArrow(run, TRACE)
