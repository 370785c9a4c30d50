"""Trees in the text format of R's BART packages: a header ``ndpost ntree p``, then for each tree its number of nodes and a
line ``node var cut leaf`` for each. Nodes are numbered as in heaps; a cut counts from 0; inner nodes are those with children."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from arbora.operators.trees import TRACE


@dataclass
class Meta:
    ndpost: int
    ntree: int
    p: int
    numcut: int
    heap_size: int


def scan(text: str) -> tuple[Meta, list[list[tuple[int, int, int, float]]]]:
    """Checks the text; lists the nodes of each tree."""
    lines = [x.split() for x in text.strip().splitlines()]
    at = 0

    def take(n: int) -> list[str]:
        nonlocal at
        if at >= len(lines):
            raise ValueError("the text ends early")
        if len(lines[at]) != n:
            raise ValueError(f"line {at + 1} has {len(lines[at])} fields, not {n}")
        at += 1
        return lines[at - 1]

    ndpost, ntree, p = map(int, take(3))
    trees = []
    for _ in range(ndpost * ntree):
        nodes = [(int(a), int(b), int(c), float(d)) for a, b, c, d in (take(4) for _ in range(int(take(1)[0])))]
        have = {n for n, *_ in nodes}
        if 1 not in have or any(n > 1 and n // 2 not in have or n < 1 or not 0 <= v < p or c < 0 for n, v, c, _ in nodes) or len(have) != len(nodes):
            raise ValueError(f"tree before line {at + 1} is no tree of {p} variables")
        trees.append(nodes)
    if at != len(lines):
        raise ValueError(f"text is left from line {at + 1} on")
    top = max((n for t in trees for n, *_ in t), default=1)
    return Meta(ndpost, ntree, p, max((c + 1 for t in trees for _, _, c, _ in t), default=0), 1 << top.bit_length()), trees


def to_trace(spark: SparkSession, text: str, chain: int = 0) -> tuple[Meta, DataFrame]:
    """The trees as a trace: cuts from 1, leaves by node."""
    meta, trees = scan(text)
    rows = []
    for i, nodes in enumerate(trees):
        have = {n for n, *_ in nodes}
        half = meta.heap_size // 2
        var, split, leaf = [0] * half, [0] * half, [[0.0] for _ in range(2 * half)]
        for n, v, c, x in nodes:
            if 2 * n in have:
                var[n], split[n] = v, c + 1
            else:
                leaf[n] = [x]
        rows.append((chain, i // meta.ntree, i % meta.ntree, var, split, leaf))
    return meta, spark.createDataFrame(rows, TRACE)
