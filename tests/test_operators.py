import math
from statistics import NormalDist

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora import queries as q
from arbora.functions import special
from arbora.operators import binning, calibrate, checks, trees
from arbora.operators.encode import Encoder
from arbora.sources import rtext

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "labels", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql_agrees(spark, duck, name):
    a, b = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    x, y = (d[cols].sort_values(cols).reset_index(drop=True) for d in (a, b))
    for c in cols:
        assert (x[c] == y[c]).all(), c


@pytest.mark.parametrize("cuts", [[1.0, 2.0, 3.0], [0.5 * k for k in range(60)], []])
def test_bins_are_right_closed(spark, cuts):
    values = [-1.0, 0.0, 0.25, 1.0, 1.5, 2.0, 3.0, 29.5, 100.0]
    b = binning.GivenSplitsBinner(["v"], [cuts])
    got = b.transform(spark.createDataFrame([(v,) for v in values], "v double")).collect()
    assert [r.xb[0] for r in got] == [sum(c < v for c in cuts) for v in values]


def test_quantile_cuts(spark):
    d = spark.createDataFrame([(float(v),) for v in [3, 1, 1, 2, 10, 4]], "v double")
    assert binning.UniqueQuantileBinner(d, ["v"], 256).cuts == [[1.5, 2.5, 3.5, 7.0]]
    x = list(np.random.default_rng(0).random(500))
    d = spark.createDataFrame([(float(v),) for v in x], "v double")
    s = np.unique(x)
    mid = s[:-1] + np.diff(s) / 2
    want = [mid[int(np.rint(-1 + j * (len(mid) + 1) / 16))] for j in range(1, 16)]
    assert binning.UniqueQuantileBinner(d, ["v"], 16).cuts[0] == pytest.approx(want)
    assert len(binning.UniqueQuantileBinner(d, ["v"], 256, max_subsample=20).cuts[0]) == 19
    assert binning.UniqueQuantileBinner(d.limit(1), ["v"], 16).cuts == [[]]
    assert binning.UniqueQuantileBinner(d, [], 16).cuts == []
    two = d.withColumn("u", F.when(F.col("v") < 0.5, F.col("v"))).withColumn("w", F.lit(None).cast("double"))
    got = binning.UniqueQuantileBinner(two, ["u", "w", "v"], 16).cuts
    assert got == [binning.UniqueQuantileBinner(two, ["u"], 16).cuts[0], [], binning.UniqueQuantileBinner(two, ["v"], 16).cuts[0]]
    far = spark.range(50_000).select(F.col("id").cast("double").alias("v"))  # a sample by a hash's threshold is full
    assert len(binning.UniqueQuantileBinner(far, ["v"], 2000, max_subsample=500).cuts[0]) == 499


def test_errors_of_binners(spark):
    d = spark.createDataFrame([(1.0,)], "v double")
    for f in (lambda: binning.RangeEvenBinner(d, ["v"], 0), lambda: binning.RangeEvenBinner(d.limit(0), ["v"], 8), lambda: binning.GivenSplitsBinner(["v"], [[], []]), lambda: binning.UniqueQuantileBinner(d, ["v"], 8, max_subsample=0)):
        with pytest.raises(ValueError):
            f()


def test_encoder(spark):
    d = spark.createDataFrame([("a", "lo", True, 1.5), ("b", "hi", False, 2.5)], "c string, o string, f boolean, x double")
    e = Encoder({"c": ["a", "b", "z"], "o": ["lo", "hi"]}, {"o"}).fit(d)
    assert e.names == ["c=a", "c=b", "c=z", "o", "f", "x"] and e.original == [0, 0, 0, 1, 2, 3]
    got = [[r[f"{n}"] for n in e.names] for r in e.transform(d.select("c", F.col("o"), "f", "x").drop()).select(*[F.col(f"`{n}`") for n in e.names]).collect()]
    assert got == [[1, 0, 0, 0, 1, 1.5], [0, 1, 0, 1, 0, 2.5]]
    assert e.weights([3, 1, 1, 1]) == [1, 1, 1, 1, 1, 1]
    with pytest.raises(Exception, match="unseen category in c: q"):
        e.transform(d.withColumn("c", F.lit("q"))).collect()
    with pytest.raises(TypeError):
        Encoder().fit(d)
    with pytest.raises(ValueError):
        e.transform(d.drop("x"))
    with pytest.raises(RuntimeError):
        Encoder().names  # noqa: B018


def test_special_functions():
    assert special.norm_ppf(0.3) == NormalDist().inv_cdf(0.3)
    u = np.array([1e-12, 0.2, 0.5, 0.9, 1 - 1e-9])
    z = special.truncated_normal(u, np.ones(5, bool), np.full(5, -np.inf))
    assert special.norm_cdf(z) == pytest.approx(1 - u, rel=1e-6)
    for bound in (-3.0, 0.0, 4.0, 30.0, 80.0):
        z = special.truncated_normal(np.random.default_rng(0).random(20_000), np.ones(20_000, bool), np.full(20_000, bound))
        assert (z >= bound).all()
        tail = 0.5 * math.erfc(bound / math.sqrt(2))
        mean = math.exp(-bound * bound / 2) / math.sqrt(2 * math.pi) / tail if tail > 1e-290 else bound + 1 / bound
        assert z.mean() == pytest.approx(mean, abs=0.03)
    assert (special.truncated_normal(u, np.zeros(5, bool), np.full(5, 1.0)) <= 1).all()
    for a, p in ((1.5, 0.9), (0.3, 0.1), (40.0, 0.5)):
        assert 1 - special.gammainc_upper(a, special.gammainccinv(a, 1 - p)) == pytest.approx(p)
    assert special.gammainc_upper(1, 2.0) == pytest.approx(math.exp(-2))
    g = special.loggamma(np.random.default_rng(0), np.full(50_000, 0.05))
    assert np.exp(g).mean() == pytest.approx(0.05, rel=0.1) and np.isfinite(g).all()
    w = np.mean([special.wishart(np.random.default_rng(i), 7.0, np.array([[2.0, 0.5], [0.5, 1.0]])) for i in range(4000)], axis=0)
    assert w == pytest.approx(7 * np.linalg.inv([[2.0, 0.5], [0.5, 1.0]]), rel=0.1)


def test_ndtr_column(spark):
    x = [-8.0, -2.5, -0.1, 0.0, 0.7, 3.3]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "x double").select(special.ndtr(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([NormalDist().cdf(v) for v in x], abs=2e-7)
    con = duckdb.connect()
    assert [con.execute(f"select {special.ndtr_sql(f'CAST({v} AS DOUBLE)')}").fetchone()[0] for v in x] == pytest.approx(got, abs=1e-12)


def test_ols_of_dependent_columns(spark):
    r = np.random.default_rng(1)
    a = r.random(60)
    b = r.random(60)
    y = 2 * a - b + r.standard_normal(60)
    d = spark.createDataFrame([tuple(map(float, v)) for v in zip(a, b, a + b, y)], "a double, b double, c double, y double")
    x = np.column_stack([np.ones(60), a, b])
    res = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert calibrate.ols_sigma2(d, ["a", "b", "c"], ["y"])[0] == pytest.approx(res @ res / 57)
    assert calibrate.ols_sigma2(d.limit(3), ["a", "b", "c"], ["y"]) == [None]


def test_latent_agrees_with_fold_and_compiled(spark):
    d = q.line_rows(spark, SF).limit(200).withColumn("id", F.monotonically_increasing_id())
    rows = spark.createDataFrame(d.collect(), d.schema)
    f = q.forest(spark, 2)
    a = {(r.id, r.chain, r.sample): r.f for r in trees.evaluate(rows, f, ["id", "chain", "sample"]).collect()}
    b = {(r.id, r.chain, r.sample): r.latent for r in trees.latent(rows, ["id"], f, [0.0, 0.0]).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    mean = {r.id: r.latent for r in trees.latent(rows, ["id"], f, [1.0, 2.0], mean=True).collect()}
    for i in {k[0] for k in a}:
        assert mean[i] == pytest.approx(np.mean([v for k, v in a.items() if k[0] == i], axis=0) + [1, 2])


def test_groups_of_samples_agree(spark, monkeypatch):
    rows = q.order_rows(spark, SF)
    one = {r.o_orderkey: r.latent for r in trees.latent(rows, ["o_orderkey"], q.forest(spark), [0.0], mean=True).collect()}
    few = q.line_rows(spark, SF).select("xb", "l_tax")
    totals = lambda: {tuple(r[:4]): (r.n, r.v0) for r in trees.leaf_totals(few, q.forest(spark), [F.col("l_tax")]).collect()}
    walked = lambda: {tuple(r[:4]): (r.n, pytest.approx(r.s)) for r in trees.traverse(few, q.forest(spark)).groupBy("chain", "sample", "tree", "leaf").agg(F.count("*").alias("n"), F.sum("l_tax").alias("s")).collect()}
    assert totals() == walked()
    monkeypatch.setattr(trees, "BROADCAST_BYTES", 1)
    assert totals() == walked()
    assert {r.o_orderkey: r.latent for r in trees.latent(rows, ["o_orderkey"], q.forest(spark), [0.0], mean=True).collect()} == {k: pytest.approx(v) for k, v in one.items()}


def test_rows_of_equal_keys_stay_apart(spark, monkeypatch):
    rows = q.line_rows(spark, SF).limit(50).withColumn("id", F.lit(1))
    count = lambda: trees.latent(rows, ["id"], q.forest(spark), [0.0], mean=True).count()
    assert count() == 50
    monkeypatch.setattr(trees, "BROADCAST_BYTES", 1)
    assert count() == 50


def test_totals_of_no_rows_and_deep_trees(spark):
    none = q.line_rows(spark, SF).limit(0)
    assert trees.leaf_totals(none, q.forest(spark)).count() == 0 and trees.traverse(none, q.forest(spark)).count() == 0
    r = np.random.default_rng(3)
    var, split = r.integers(0, 3, 64).tolist(), [0, *r.integers(1, 20, 31).tolist(), *([0] * 32)]
    deep = spark.createDataFrame([(0, 0, 0, var, split, [[float(i)] for i in range(128)])], trees.TRACE)
    rows = spark.createDataFrame([(v.tolist(),) for v in r.integers(0, 20, (300, 3))], "xb array<int>")
    want = {x.leaf: x.n for x in rows.crossJoin(deep).groupBy(trees.leaf_index(F.col("xb")).alias("leaf")).agg(F.count("*").alias("n")).collect()}
    assert {x.leaf: x.n for x in trees.leaf_totals(rows, deep).collect()} == want
    assert {x.leaf: x.n for x in trees.traverse(rows, deep).groupBy("leaf").agg(F.count("*").alias("n")).collect()} == want


@pytest.mark.parametrize("rules", [1, 4, 6, 9])
def test_tables_agree_with_walks(rules, monkeypatch):
    r = np.random.default_rng(rules)
    var, split = r.integers(0, 3, (30, 32)).astype(np.int32), np.zeros((30, 32), np.int32)
    for row in split:
        live = [1]
        for _ in range(rules):
            i = live.pop(r.integers(len(live)))
            row[i] = r.integers(1, 20)
            live += [x for x in (2 * i, 2 * i + 1) if x < 32]
    f = trees.Forest(var, split, r.random((30, 64, 2)))
    x = r.integers(0, 20, (500, 3))
    want = [sum(f.leaf[t][f.leaves(x, t)] for t in range(g * 10, g * 10 + 10)) for g in range(3)]
    assert np.allclose(f.sums(x, 3), want)
    monkeypatch.setattr(trees, "KNOWN_BYTES", 0)
    assert np.allclose(f.sums(x, 3), want)


def test_erfc_of_arrays():
    x = np.concatenate([np.linspace(-7, 26, 2001), [0.0, -40.0, 40.0]])
    assert special._erfc(x) == pytest.approx([math.erfc(v) for v in x], rel=1e-12, abs=1e-300)


def test_compiled_stays_in_code_generation(spark):
    rows = [r for r in q.forest(spark).collect() if r.chain == 0 and r.sample == 0]
    d = q.line_rows(spark, SF).select(trees.compiled(rows, [F.col("xb")[j] for j in range(3)]).alias("f"))
    assert "WholeStageCodegen" in d._jdf.queryExecution().explainString(d.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) or d.count()


def test_checks_name_what_fails(spark):
    got = [r.error for r in checks.check_trace(q.forest(spark, rows=q.BAD), q.MAX_SPLIT).orderBy("sample").collect()]
    assert [checks.describe(e, q.MAX_SPLIT) for e in got] == [[], ["stray_nodes", "num_nodes"], ["var_in_bounds"], ["split_in_bounds"], ["rule_consistency"], ["unused_node"], []]


def test_format_tree(spark):
    text = trees.format_tree(q.forest(spark).first().asDict())
    assert text == "1: x0 < 25\n├── 2: x1 < 5\n│   ├── 4: leaf 1.000\n│   └── 5: leaf 2.000\n└── 3: leaf 3.000"


TEXT = """1 2 3
3
1 0 24 0
2 0 0 1.5
3 0 0 -2.5
1
1 0 0 0.25
"""


def test_text_trees(spark):
    meta, trace = rtext.to_trace(spark, TEXT)
    rows = trace.orderBy("tree").collect()
    assert (meta.ndpost, meta.ntree, meta.numcut, meta.heap_size) == (1, 2, 25, 4)
    assert rows[0].split_tree == [0, 25] and [x[0] for x in rows[0].leaf_tree] == [0, 0, 1.5, -2.5] and rows[1].leaf_tree[1] == [0.25]
    for bad in (TEXT + "1\n", TEXT.replace("3 0 0 -2.5", "7 0 0 -2.5"), TEXT[:-12], TEXT.replace("1 0 24 0", "1 9 24 0")):
        with pytest.raises(ValueError):
            rtext.scan(bad)
