"""Trees as heaps in arrays: node 1 is the root, 2i and 2i + 1 are its children, slot 0 is not used.

A trace row is (chain, sample, tree, var_tree, split_tree, leaf_tree); split 0 makes a node a leaf; a row of bins goes
left if bin < split. ``leaf_tree`` has a vector for each slot, of one component for a single response.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACE = "chain int, sample int, tree int, var_tree array<int>, split_tree array<int>, leaf_tree array<array<double>>"
#: Bytes of a forest that are sent to every executor at most; more samples are scored in groups.
BROADCAST_BYTES = 128 << 20
#: Trees from which on rows are dealt out evenly before they are scored: a row then costs far more than its way.
EVEN_TREES = 1000
#: Rules of a tree whose outcomes make the number of a table's entry, at most 8.
MOST_RULES = 6
#: Bytes of outcomes of rules that are kept while a block of rows is scored.
KNOWN_BYTES = 2 << 20


def V() -> Column:  # noqa: N802
    return F.col("var_tree")


def S() -> Column:  # noqa: N802
    return F.col("split_tree")


def L() -> Column:  # noqa: N802
    return F.col("leaf_tree")


def BYTES() -> Column:  # noqa: N802
    """Of a tree in a ``Forest``."""
    return F.size(S()) * 8 + F.size(L()) * F.size(F.get(L(), 1)) * 8


def depth(split: Column | None = None) -> Column:
    """Levels of a tree's heap."""
    split = S() if split is None else split
    return F.log2(F.size(split)).cast("int") + 1


def node_depth(node: Column) -> Column:
    return F.when(node > 0, F.length(F.bin(node)) - 1).otherwise(0)


def leaf_index(xb: Column, var: Column | None = None, split: Column | None = None) -> Column:
    """The slot where a row of bins ends: a fold over the levels."""
    var, split = V() if var is None else var, S() if split is None else split
    def down(i: Column, _: Column) -> Column:
        inner = F.when(i < F.size(split), F.get(split, i)).otherwise(0)
        return F.when(inner == 0, i).otherwise(2 * i + (F.get(xb, F.get(var, i)) >= inner).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), depth(split) - 1)), F.lit(1), down)


def traverse(rows: DataFrame, trace: DataFrame, xb: str = "xb") -> DataFrame:
    """Each row with each tree and its ``leaf`` there; a trace of over BROADCAST_BYTES is not broadcast.

    The way down is a projection for each level, which stays in code generation; ``leaf_index`` is the same as one
    expression. For totals by leaf see ``leaf_totals``, for sums over large traces ``latent``.
    """
    levels, size = trace.agg(F.max(depth()), F.sum(BYTES())).first()
    found = rows.crossJoin(F.broadcast(trace) if (size or 0) <= BROADCAST_BYTES else trace).withColumn("leaf", F.lit(1))
    inner = F.when(F.col("leaf") < F.size(S()), F.get(S(), F.col("leaf"))).otherwise(0)
    for _ in range(max(1, (levels or 1) - 1)):
        found = found.withColumn("__rule", inner)
        found = found.withColumn("leaf", F.when(F.col("__rule") == 0, F.col("leaf")).otherwise(2 * F.col("leaf") + (F.get(F.col(xb), F.get(V(), F.col("leaf"))) >= F.col("__rule")).cast("int")))
    return found.drop("__rule")


def evaluate(rows: DataFrame, trace: DataFrame, by: list[str], xb: str = "xb") -> DataFrame:
    """Sums of leaf vectors over the trees that share ``by`` (row keys, chain, sample, tree): component k in f[k]."""
    k = len(trace.select(F.get(L(), 1)).first()[0])
    found = traverse(rows, trace, xb)
    return found.groupBy(*by).agg(F.array(*[F.sum(F.get(L(), F.col("leaf"))[j]) for j in range(k)]).alias("f"))


def compiled(trees: list[dict], names: list[Column], component: int = 0) -> Column:
    """A small forest as nested CASE expressions, which stay inside whole-stage code generation."""
    def at(t: dict, i: int) -> Column:
        s = t["split_tree"][i] if i < len(t["split_tree"]) else 0
        return F.when(names[t["var_tree"][i]] < s, at(t, 2 * i)).otherwise(at(t, 2 * i + 1)) if s else F.lit(float(t["leaf_tree"][i][component]))

    total = F.lit(0.0)
    for t in trees:
        total = total + at(t, 1)
    return total


class Forest:
    """Heaps of many trees in numpy: var, split (m, H), leaf (m, 2H, k)."""

    def __init__(self, var: np.ndarray, split: np.ndarray, leaf: np.ndarray):
        self.var, self.split, self.leaf = var, split, leaf
        used = self.split.any(axis=0).nonzero()[0]
        self.levels = int(math.log2(used.max())) + 1 if len(used) else 0  # below them all are leaves

    @classmethod
    def of(cls, rows: list) -> "Forest":
        half = max(2, *(len(r["split_tree"]) for r in rows))
        pad = lambda a, n: np.pad(a, (0, n - len(a)))
        leaf = np.stack([np.pad(np.array(r["leaf_tree"], float), ((0, 2 * half - len(r["leaf_tree"])), (0, 0))) for r in rows])
        return cls(np.stack([pad(r["var_tree"], half) for r in rows]).astype(np.int32), np.stack([pad(r["split_tree"], half) for r in rows]).astype(np.int32), leaf)

    def leaves(self, xb: np.ndarray, t: int) -> np.ndarray:
        """Slots of the rows (n, p) in tree t."""
        at = np.ones(len(xb), np.int64)
        rows = np.arange(len(xb))
        for _ in range(self.levels):
            s = self.split[t].take(at, mode="clip") * (at < self.split.shape[1])
            at = np.where(s > 0, 2 * at + (xb[rows, self.var[t].take(at, mode="clip")] >= s), at)
        return at

    def values(self, columns: list[np.ndarray], t: int, k: int) -> np.ndarray | float:
        """Component k of tree t at the rows of ``columns``: one comparison and one choice for each rule of the tree."""
        var, split, leaf = self.var[t].tolist(), self.split[t].tolist(), self.leaf[t, :, k].tolist()

        def at(i: int) -> np.ndarray | float:
            s = split[i] if i < len(split) else 0
            return np.where(columns[var[i]] >= s, at(2 * i + 1), at(2 * i)) if s else leaf[i]

        return at(1)

    @cached_property
    def tables(self) -> list[tuple[list[tuple[int, int]], np.ndarray] | None]:
        """Of each tree of at most MOST_RULES rules: the rules (variable, cut), and the leaf vectors (k, 2^rules) by their outcomes as bits."""
        out = []
        for var, split, leaf in zip(self.var, self.split, self.leaf, strict=True):
            inner = np.flatnonzero(split).tolist()
            if len(inner) > MOST_RULES:
                out.append(None)
                continue
            slot, cases = np.ones(1 << len(inner), np.int64), np.arange(1 << len(inner))
            for bit, i in enumerate(inner):  # parents stand before their children
                slot = np.where(slot == i, 2 * i + (cases >> bit & 1), slot)
            out.append((list(zip(var[inner].tolist(), split[inner].tolist(), strict=True)), np.ascontiguousarray(leaf[slot].T)))
        return out

    def sums(self, xb: np.ndarray, groups: int) -> np.ndarray:
        """(groups, n, k): sums over consecutive groups of trees."""
        m, k, n = len(self.var), self.leaf.shape[2], len(xb)
        columns = [np.ascontiguousarray(c, np.int32) for c in xb.T]
        out = np.zeros((groups, k, n))
        known: dict[tuple[int, int], np.ndarray] = {}
        for t, table in enumerate(self.tables):
            into = out[t * groups // m]
            if table is None:
                for j in range(k):
                    into[j] += self.values(columns, t, j)
                continue
            case = np.zeros(n, np.uint8)
            for bit, rule in enumerate(table[0]):
                yes = known.get(rule)
                if yes is None:
                    yes = (columns[rule[0]] >= rule[1]).view(np.uint8)
                    if len(known) * n < KNOWN_BYTES:
                        known[rule] = yes
                case |= yes << np.uint8(bit)
            for j in range(k):
                into[j] += table[1][j].take(case)
        return np.swapaxes(out, 1, 2)


class Held:
    """The forests of all samples in broadcasts of at most BROADCAST_BYTES, or of one sample; a task holds one of them at a time."""

    def __init__(self, trace: DataFrame):
        spark = trace.sparkSession
        self.samples = [tuple(r) for r in trace.select("chain", "sample").distinct().orderBy("chain", "sample").collect()]
        if not self.samples:
            raise ValueError("the trace has no samples")
        first = trace.where((F.col("chain") == self.samples[0][0]) & (F.col("sample") == self.samples[0][1]))
        per = max(1, BROADCAST_BYTES // max(1, first.select(F.sum(BYTES())).first()[0]))
        self.parts = [self.samples[g : g + per] for g in range(0, len(self.samples), per)]
        self.forests, self.trees = [], []
        for part in self.parts:
            some = trace.join(F.broadcast(spark.createDataFrame(part, "chain int, sample int")), ["chain", "sample"]).orderBy("chain", "sample", "tree").collect()
            self.trees.append(np.array([(r.chain, r.sample, r.tree) for r in some], np.int32))
            self.forests.append(spark.sparkContext.broadcast(Forest.of(some)))

    def each(self) -> Iterator[tuple[list[tuple[int, int]], Forest]]:
        for part, b in zip(self.parts, self.forests, strict=True):
            yield part, b.value
            if len(self.parts) > 1 and getattr(b, "_path", None):
                b.__dict__.pop("_value", None)  # it is read again from the worker's file


def blocks(batches: Iterator[pa.RecordBatch], xb: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in pieces, with the bins of their rows as a matrix."""
    for whole in batches:
        for a in range(0, whole.num_rows, rows):
            batch = whole.slice(a, rows)
            x = batch.column(xb)
            yield batch, np.asarray(x.flatten()).reshape(len(x), -1)


def dealt(rows: DataFrame, held: Held) -> DataFrame:
    """Rows in even partitions where there are many trees: files may have fewer row groups than there are cores."""
    return rows if rows.isStreaming or sum(map(len, held.trees)) < EVEN_TREES else rows.hint("rebalance")


def latent(rows: DataFrame, keys: list[str], trace: DataFrame, offset: list[float], xb: str = "xb", mean: bool = False) -> DataFrame:
    """(keys, chain, sample, latent array) or, with ``mean``, (keys, latent array) averaged over samples.

    Rows are read once, whatever the number of samples, and shuffled at most to deal them out; rows of equal keys stay apart.
    """
    held = Held(trace)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda z: pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[-1], dtype=np.int32)), pa.array(z.ravel()))
        many = len(held.parts) > 1  # forests are read anew for each block: large blocks
        for big, bins in blocks(batches, len(keys), 1 << 20 if many else 2048):
            total = np.zeros((len(bins), len(offset)))
            for part, f in held.each():
                c = np.array(part, np.int32)
                for a in range(0, len(bins), 2048):
                    batch, z = big.slice(a, 2048), f.sums(bins[a : a + 2048], 1 if mean else len(part))
                    if mean:
                        total[a : a + 2048] += z[0]
                        continue
                    n = batch.num_rows
                    take = pa.array(np.tile(np.arange(n), len(part)))
                    own = [batch.column(i).take(take) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.repeat(c[:, i], n)) for i in (0, 1)), at(z + np.array(offset))], [*keys, "chain", "sample", "latent"])
            if mean:
                yield pa.RecordBatch.from_arrays([*(big.column(i) for i in range(len(keys))), at(total / len(held.samples) + np.array(offset))], [*keys, "latent"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), *([] if mean else ["chain int", "sample int"]), "latent array<double>"])
    return dealt(rows.select(*keys, xb), held).mapInArrow(score, schema)


def leaf_totals(rows: DataFrame, trace: DataFrame, values: list[Column] | None = None, xb: str = "xb") -> DataFrame:
    """(chain, sample, tree, leaf, n, v0, v1, ...): rows and sums of ``values`` (null: 0) in each slot where rows end.

    A task adds up its rows in arrays of the forest's size and sends them on once; rows are read once for each
    broadcast of forests.
    """
    values = values or []
    held, k = Held(trace), len(values)
    names = ["chain", "sample", "tree", "leaf", "n", *(f"v{j}" for j in range(k))]
    schema = "chain int, sample int, tree int, leaf int, n long" + "".join(f", v{j} double" for j in range(k))
    read = rows.select(F.col(xb), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"v{j}") for j, v in enumerate(values)])
    read = dealt(read, held)
    out = None
    for forest, trees in zip(held.forests, held.trees, strict=True):

        def add(batches: Iterator[pa.RecordBatch], forest=forest, trees=trees) -> Iterator[pa.RecordBatch]:
            f = forest.value
            m, width = f.leaf.shape[:2]
            n, sums = np.zeros((m, width), np.int64), np.zeros((k, m, width))
            for batch, bins in blocks(batches, 0, 8192):
                v = [np.asarray(batch.column(j + 1)) for j in range(k)]
                for t in range(m):
                    at = f.leaves(bins, t)
                    n[t] += np.bincount(at, minlength=width)
                    for j in range(k):
                        sums[j, t] += np.bincount(at, v[j], width)
            t, at = n.nonzero()
            for a in range(0, len(t), 100_000):
                i, s = t[a : a + 100_000], at[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([*(pa.array(trees[i, c]) for c in range(3)), pa.array(s.astype(np.int32)), pa.array(n[i, s]), *(pa.array(sums[j, i, s]) for j in range(k))], names)

        one = read.mapInArrow(add, schema)
        out = one if out is None else out.union(one)
    return out.groupBy(*names[:4]).agg(*[F.sum(c).alias(c) for c in names[4:]])


def nodes(trace: DataFrame) -> DataFrame:
    """(chain, sample, tree, node, depth, var, split, leaf): a row for each slot that is a node, with is_leaf and leaves_parent."""
    half = F.size(S())
    split = F.when(F.col("node") < half, F.get(S(), F.col("node"))).otherwise(0)
    child = lambda c: F.when(c < half, F.get(S(), c)).otherwise(0)
    out = trace.withColumn("node", F.explode(F.sequence(F.lit(1), F.size(L()) - 1)))
    out = out.where((F.col("node") == 1) | (F.get(S(), F.floor(F.col("node") / 2).cast("int")) != 0))
    return out.select(
        "chain", "sample", "tree", "node", node_depth(F.col("node")).alias("depth"), F.when(split != 0, F.get(V(), F.col("node"))).alias("var"), split.alias("split"),
        (split == 0).alias("is_leaf"), ((split != 0) & (child(2 * F.col("node")) == 0) & (child(2 * F.col("node") + 1) == 0)).alias("leaves_parent"), F.when(split == 0, F.get(L(), F.col("node"))).alias("leaf"),
    )


def actual_depth(split: Column | None = None) -> Column:
    """Depth of the deepest leaf."""
    split = S() if split is None else split
    inner = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(split) - 1)), lambda i: F.when(i < F.size(split), F.get(split, i)).otherwise(0) != 0)
    return F.coalesce(F.length(F.bin(F.array_max(inner))), F.lit(0))


def depth_distr(trace: DataFrame) -> DataFrame:
    return trace.groupBy("chain", "sample", actual_depth().alias("depth")).agg(F.count("*").alias("trees"))


def mean_leaves(trace: DataFrame) -> DataFrame:
    return trace.groupBy("chain", "sample").agg(F.avg(F.size(F.filter(S(), lambda s: s != 0)) + 1).alias("mean_leaves"))


def var_histogram(trace: DataFrame, p: int, by: list[str]) -> DataFrame:
    """Splits on each of p variables, zeros included."""
    used = trace.select(*by, F.explode(F.arrays_zip(V().alias("v"), S().alias("s"))).alias("x")).where("x.s <> 0")
    counts = used.groupBy(*by, F.col("x.v").alias("var")).agg(F.count("*").alias("n"))
    every = trace.select(*by).distinct().withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))) if by else trace.sparkSession.range(p).select(F.col("id").cast("int").alias("var"))
    return every.join(counts, [*by, "var"], "left").select(*by, "var", F.coalesce("n", F.lit(0)).cast("long").alias("splits"))


def points_per_node(rows: DataFrame, trace: DataFrame, parents: bool = False, xb: str = "xb") -> DataFrame:
    """(chain, sample, points, nodes): how many leaves, or parents of two leaves, hold how many rows; empty ones count."""
    key = ["chain", "sample", "tree", "node"]
    got = leaf_totals(rows, trace, xb=xb).withColumnRenamed("leaf", "node")
    every = nodes(trace)
    if parents:
        got = got.withColumn("node", F.floor(F.col("node") / 2).cast("int")).groupBy(*key).agg(F.sum("n").alias("n"))
    every = every.where("leaves_parent" if parents else "is_leaf").select(*key)
    return every.join(got, key, "left").groupBy("chain", "sample", F.coalesce("n", F.lit(0)).cast("long").alias("points")).agg(F.count("*").alias("nodes"))


def ancestors(node: Column) -> Column:
    """Nodes on the way to the root, the parent first."""
    return F.when(node > 1, F.transform(F.sequence(F.lit(1), node_depth(node)), lambda h: F.call_function("shiftright", node, h))).otherwise(F.array().cast("array<int>"))


def split_range(trace: DataFrame, max_split: list[int]) -> DataFrame:
    """(chain, sample, tree, node, var, lo, hi): the cuts lo <= c < hi that ancestors of the same variable leave to a node."""
    tree = trace.select("chain", "sample", "tree", V(), S())
    n = nodes(trace).where("not is_leaf").select("chain", "sample", "tree", "node", "var", "split").join(tree, ["chain", "sample", "tree"])
    top = F.array(*[F.lit(m) for m in max_split])
    up = F.filter(ancestors(F.col("node")), lambda a: F.get(V(), a) == F.col("var"))
    # which child of ancestor a the way leads through
    side = lambda a: F.call_function("shiftright", F.col("node"), node_depth(F.col("node")) - node_depth(a) - 1) % 2
    lo = F.coalesce(F.array_max(F.transform(F.filter(up, lambda a: side(a) == 1), lambda a: F.get(S(), a) + 1)), F.lit(1))
    hi = F.coalesce(F.array_min(F.transform(F.filter(up, lambda a: side(a) == 0), lambda a: F.get(S(), a))), F.get(top, F.col("var")) + 1)
    return n.select("chain", "sample", "tree", "node", "var", "split", lo.alias("lo"), hi.alias("hi"))


def format_tree(row: dict, every: bool = False) -> str:
    """A tree as text; ``every`` shows slots that are not used too."""
    out: list[str] = []
    half = len(row["split_tree"])

    def show(i: int, bar: str, mark: str, live: bool) -> None:
        s = row["split_tree"][i] if i < half else 0
        values = ", ".join(f"{v:#.4g}" for v in row["leaf_tree"][i])
        text = f"x{row['var_tree'][i]} < {s}" if s and live else f"leaf {values}" if live else f"(unused {values})"
        out.append(f"{mark}{i}: {text}")
        if s and live or every and 2 * i < 2 * half:
            for k, c in enumerate((2 * i, 2 * i + 1)):
                if c < len(row["leaf_tree"]):
                    show(c, bar + ("│   " if k == 0 else "    "), bar + ("├── " if k == 0 else "└── "), bool(s and live))

    show(1, "", "", True)
    return "\n".join(out)
