import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.operators import trees
from arbora.operators.binning import RangeEvenBinner
from arbora.operators.encode import Encoder
from arbora.compat.rlike import gbart, mc_gbart
from arbora.compat.sklike import BARTModel, NotSampledError
from arbora.plans import callbacks, diagnostics, estimator, prior, sampler
from arbora.plans.estimator import Bart, Sparse
from arbora.plans.moves import Proposer, Tree
from arbora.plans.sampler import Loop, Model, Rows, State, direct
from arbora.sources import synth
from arbora.streaming.score import score_stream

X = ["a", "b", "c"]
SMALL = {"num_trees": 6, "n_burn": 5, "n_save": 4, "num_chains": 2, "row_id": "id", "binner": lambda d, f: RangeEvenBinner(d, f, 32)}


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    n = 240
    x = r.random((n, 3))
    y = np.sin(6 * x[:, 0]) + 2 * (x[:, 1] > 0.5) + 0.2 * r.standard_normal(n)
    d = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "z": (y > 1).astype(int), "s": np.where(np.arange(n) % 3 == 0, 2.0, 1.0)}))
    d = d.withColumn("m", F.when(F.col("id") % 5 != 0, F.col("y"))).withColumn("m2", F.when(F.col("id") % 7 != 0, F.col("c")))
    return spark.createDataFrame(d.collect(), d.schema)


def tables(m):
    t = m.trace.orderBy("chain", "sample", "tree").collect()
    return [list(r.split_tree) for r in t], [np.array(list(map(list, r.leaf_tree))) for r in t]


CASES = [
    {"y": "y"}, {"y": "y", "error_scale": "s", "sparse": Sparse(augment=True)}, {"y": "z", "outcome": "binary"}, {"y": ["y", "c"]}, {"y": ["y", "z"], "outcome": ["continuous", "binary"]},
    {"y": ["m", "m2"], "error_scale": "s"}, {"y": ["y", "c"], "error_scale": ["s", "b"]}, {"y": "m", "min_points_per_leaf": 4},
]


@pytest.mark.parametrize("case", CASES)
def test_engines_agree(data, case):
    a, b = (Bart(data, X, engine=e, seed=4, **SMALL, **case) for e in ("local", "gram"))
    (sa, la), (sb, lb) = tables(a), tables(b)
    assert sa == sb and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(la, lb))
    a.check()


def test_gram_does_not_depend_on_partitions(spark, data):
    m = Bart(data, X, "y", **SMALL | {"n_burn": 1, "n_save": 1})
    s = State(m.model, 0, m.n)
    moves, slots = s.propose()
    one = sampler.gram_pass(m.data.coalesce(1), [(s, moves, slots)])[0]
    many = sampler.gram_pass(m.data.repartition(70), [(s, moves, slots)])[0]
    for x, y in ((one.n, many.n), (one.g, many.g), (one.s, many.s), (one.q, many.q)):
        assert x == pytest.approx(y, abs=1e-8)
    assert one.n.sum() == m.n * m.model.trees


def run_state(model, rows, steps, n_valid):
    s = State(model, 0, float(len(rows.ids)))
    for _ in range(steps):
        moves, slots = s.propose()
        s.finish(moves, slots, direct(s, rows, moves, slots), n_valid)
    return s


def test_resume_is_exact():
    r = np.random.default_rng(0)
    rows = Rows(np.arange(80), r.integers(0, 8, (80, 2)).astype(np.int32), r.standard_normal((80, 1)), np.ones((80, 1)))
    model = Model([7, 7], [0.0], [[1.0]], [False], trees=5, prec_df=3.0, prec_rate=[[1.0]], min_decision=2)
    a = run_state(model, rows, 10, np.array([80.0]))
    b = run_state(model, rows, 4, np.array([80.0]))
    b = State.load(b.dump())
    for _ in range(6):
        moves, slots = b.propose()
        b.finish(moves, slots, direct(b, rows, moves, slots), np.array([80.0]))
    assert all((x.leaf == y.leaf).all() and (x.split == y.split).all() for x, y in zip(a.trees, b.trees)) and (a.prec == b.prec).all()


@pytest.mark.parametrize(("p", "cuts", "sparse"), [(1, 1, None), (3, 2, None), (4, 3, 2.0)])
def test_prior_is_recovered_without_data(spark, p, cuts, sparse):
    """Chains that see no rows must draw forests from the prior."""
    rows = Rows(np.zeros(0, np.int64), np.zeros((0, p), np.int32), np.zeros((0, 1)), np.zeros((0, 1)))
    model = Model([cuts] * p, [0.0], [[1.0]], [False], trees=3, maxdepth=4, min_decision=None, sparse=sparse is not None, theta=sparse, augment=True, seed=11)
    s, leaves, deep, used = State(model, 0, 0.0), [], [], []
    for i in range(4000):
        moves, slots = s.propose()
        s.finish(moves, slots, direct(s, rows, moves, slots), np.array([0.0]))
        if i >= 200:
            leaves.append(np.mean([np.count_nonzero(t.split) + 1 for t in s.trees]))
            deep.append(np.mean([int(t.split.nonzero()[0].max(initial=0)).bit_length() for t in s.trees]))
            used.append(len({int(v) for t in s.trees for v in t.var[t.split > 0]}))
    d = prior.sample_prior(spark, 3000, 3, [cuts] * p, model.nonterminal(), [1.0], theta=sparse, seed=5).collect()
    by = {}
    for r in d:
        by.setdefault(r.sample, []).append(np.array(r.split_tree))
    want = [np.mean([np.count_nonzero(t) + 1 for t in ts]) for ts in by.values()]
    want_deep = [np.mean([int(t.nonzero()[0].max(initial=0)).bit_length() for t in ts]) for ts in by.values()]
    for got, exact in ((leaves, want), (deep, want_deep)):
        se = np.sqrt(np.var(got) / diagnostics.ess(np.array([got])) + np.var(exact) / len(exact))
        assert abs(np.mean(got) - np.mean(exact)) < 5 * se + 1e-9


@pytest.mark.parametrize("kw", [{"rho": 3.0, "a": 0.5, "b": 1.0}, {"theta": 2.0}, {"log_s": [[0.0, -1.0, -50.0], [-50.0, 0.0, 0.0]] * 3}, {}])
def test_weights_of_the_prior(spark, kw):
    """The recorded weights are those that the trees were drawn with."""
    chosen, q = prior.Selection(**kw), [0.95, 0.5, 0.0]
    got = {r.sample: r for r in prior.sample_weights(spark, 6, 3, chosen, seed=4).collect()}
    assert sorted(got) == list(range(6))
    for r in prior.sample_prior(spark, 6, 1, [5] * 3, q, [1.0], seed=4, **kw).collect():
        rng = prior.stream(4, 0, r.sample, 9)
        theta, log_s = chosen.draw(rng, r.sample, 3)
        assert got[r.sample].theta == theta and (got[r.sample].log_s is None) == (log_s is None)
        assert log_s is None or got[r.sample].log_s == log_s.tolist()
        tree = prior.grow(rng, Proposer(np.array([5] * 3), q, None), np.ones(1), log_s)
        assert list(r.split_tree) == tree.split.tolist() and list(r.var_tree) == tree.var.tolist()
        if "log_s" in kw:
            assert not {2 if r.sample % 2 == 0 else 0} & {int(v) for v in tree.var[tree.split > 0]}
    with pytest.raises(ValueError):
        prior.Selection(theta=1.0, rho=2.0, a=1.0, b=1.0)


def test_proposal_ranges_by_brute_force():
    rng = np.random.default_rng(2)
    who = Proposer(np.array([3, 2, 0]), [0.95, 0.5, 0.3, 0.1, 0.0], None)
    for _ in range(200):
        t = prior.grow(rng, who, np.ones(1), None)
        for node in t.internal():
            lo, hi = 1, int(who.max_split[t.var[node]]) + 1
            x = node
            while x > 1:
                if t.var[x >> 1] == t.var[node]:
                    lo, hi = (max(lo, t.split[x >> 1] + 1), hi) if x & 1 else (lo, min(hi, t.split[x >> 1]))
                x >>= 1
            assert lo <= t.split[node] < hi
            assert who.rule(t, node, rng, None)[0] != 2
    assert not Proposer(np.array([1]), [0.9, 0.5, 0.0], None).has_rule(_split(Tree(3, 1), 1, 0, 1), 2)


def _split(t, node, var, split):
    t.var[node], t.split[node] = var, split
    return t


def test_fit_learns_and_converges(data, spark):
    m = Bart(data, X, "y", **SMALL | {"num_trees": 25, "n_burn": 250, "n_save": 200, "num_chains": 4})
    truth = data.select("id", (F.sin(6 * F.col("a")) + 2 * (F.col("b") > 0.5).cast("int")).alias("f"))
    err = m.predict("train").join(truth, F.col("row_id") == F.col("id")).select(F.sqrt(F.avg((F.col("prediction")[0] - F.col("f")) ** 2))).first()[0]
    assert err < 0.2
    sd = m.error_sdev().toPandas().pivot(index="chain", columns="sample", values="sdev").to_numpy()
    assert 0.12 < sd.mean() < 0.3 and diagnostics.rank_rhat(sd) < 1.2
    assert m.error_sdev(mean=True).first()["sdev"] == pytest.approx(np.sqrt((sd**2).mean()))
    use = {r["var"]: r.splits for r in m.varcount_mean().collect()}
    assert use[0] > use[2] and use[1] > 0
    assert m.latent_prec().count() == 4 * 450 and m.ndpost == 800


def test_predictions(data, tmp_path, spark):
    m = Bart(data, X, "y", **SMALL)
    new = data.select("id", *X)
    a = {r.id: r.prediction[0] for r in m.predict(new).collect()}
    lat = m.predict(new, "latent_samples").toPandas()
    assert lat.groupby("id").prediction.apply(lambda s: np.mean([v[0] for v in s])).to_dict() == pytest.approx(a)
    train = {r.row_id: r.prediction[0] for r in m.predict("train").collect()}
    assert train == pytest.approx(a)
    draws = m.predict(new, "outcome_samples", seed=1)
    again = {(r.id, r.chain, r.sample): r.prediction[0] for r in m.predict(new.repartition(7), "outcome_samples", seed=1).collect()}
    assert {(r.id, r.chain, r.sample): r.prediction[0] for r in draws.collect()} == again
    with pytest.raises(ValueError):
        m.predict(new, "outcome_samples")
    with pytest.raises(ValueError):
        m.predict(new.withColumn("a", F.col("a").cast("float")))
    with pytest.raises(ValueError):
        m.predict(new.withColumn("s", F.lit(1.0)), error_scale="s")
    m.dump(str(tmp_path / "model"))
    loaded = Bart.load(spark, str(tmp_path / "model"))
    assert {r.id: r.prediction[0] for r in loaded.predict(new).collect()} == pytest.approx(a)
    assert [s.steps for s in m.states()] == [9, 9]
    src = str(tmp_path / "rows")
    new.write.parquet(src)
    out = score_stream(loaded, spark.readStream.schema(new.schema).parquet(src), ["id"]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert {r.id: r.prediction[0] for r in spark.table("scored").collect()} == pytest.approx(a)


def test_probabilities_average_the_cdf(data):
    from statistics import NormalDist

    m = Bart(data, X, "z", outcome="binary", **SMALL)
    new = data.select("id", *X)
    p = {r.id: r.prediction[0] for r in m.predict(new).collect()}
    lat = m.predict(new, "latent_samples").toPandas()
    want = lat.groupby("id").prediction.apply(lambda s: np.mean([NormalDist().cdf(v[0]) for v in s])).to_dict()
    assert p == pytest.approx(want, abs=1e-6)
    assert {r.prediction[0] for r in m.predict(new, "outcome_samples", seed=2).collect()} <= {0.0, 1.0}
    assert m.error_sdev().where("sdev is not null").count() == 0


def test_missing_equals_dropped(data):
    a = Bart(data, X, "m", **SMALL, offset=0.5)
    b = Bart(data.where("m is not null"), X, "m", offset=0.5, **SMALL | {"binner": lambda d, f: a.binner})
    assert tables(a)[0] == tables(b)[0]
    assert all(x == pytest.approx(y, abs=1e-9) for x, y in zip(tables(a)[1], tables(b)[1]))


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_few_rows(data, rows):
    m = Bart(data.limit(rows), X, "y", **SMALL | {"binner": lambda d, f: RangeEvenBinner(data, f, 8)})
    assert m.predict(data.select("id", *X)).count() == 240
    m.check()


@pytest.mark.parametrize("engine", ["local", "gram"])
def test_extension_is_exact(data, engine):
    kw = SMALL | {"num_trees": 4, "n_burn": 3}
    a = Bart(data, X, "y", engine=engine, **kw | {"n_save": 5})
    b = Bart(data, X, "y", engine=engine, **kw | {"n_save": 2}).extend(3)
    assert b.ndpost == 10 and tables(a)[0] == tables(b)[0] and all((x == y).all() or np.allclose(x, y, atol=1e-9) for x, y in zip(tables(a)[1], tables(b)[1]))
    assert b.goes_bad().where("goes_bad").count() == 0 and b.points_per_leaf().count() and b.depth_distr().count() and b.mean_leaves().count() == 10
    assert b.format_tree(0, 4, 0).startswith("1: ") and b.states()[0].steps == 8
    with pytest.raises(IndexError):
        b.format_tree(9, 0, 0)


def test_constant_response_and_predictor(data):
    d = data.withColumn("y", F.lit(3.0)).withColumn("c", F.lit(1.0))
    m = Bart(d, X, "y", **SMALL)
    assert all(abs(r.prediction[0] - 3) < 1 for r in m.predict("train").collect())
    with pytest.raises(ValueError, match="without a cut: \\['c'\\]"):
        Bart(d, X, "y", rm_const=False, **SMALL | {"binner": None})  # quantiles


def test_bad_arguments(data):
    for kw in ({"y": "z", "outcome": "binary", "sigma_scale": 1.0}, {"y": "y", "outcome": "odd"}, {"y": "y", "varprob": [1, 0, 1]}):
        with pytest.raises(ValueError):
            Bart(data, X, **kw, **SMALL)
    for kw in ({"engine": "odd"}, {"engine": "local", "callback": lambda i, s: None}):
        with pytest.raises(ValueError):
            Bart(data, X, "y", **kw, **SMALL)
    with pytest.raises(TypeError):
        Bart(data.withColumn("a", F.lit("x")), X, "y", **SMALL)


def test_callbacks(data, caplog):
    seen = []
    stats = callbacks.Stats()
    cb = callbacks.compose(lambda i, s: seen.append(i), lambda i, s: stats.update(s), callbacks.printing(9, 3))
    with caplog.at_level("INFO", "arbora"):
        Bart(data, X, "y", callback=cb, **SMALL)
    assert seen == list(range(9)) and stats.report()["effective"] == pytest.approx(3) and len(caplog.records) == 3


def test_local_bound(data, monkeypatch):
    """All bytes of the rows count: 240 of 48, where the bins alone are 12."""
    monkeypatch.setattr(estimator, "LOCAL_BYTES", 240 * 47)
    with pytest.raises(ValueError, match="11520 bytes"):
        Bart(data, X, "y", engine="local", **SMALL)
    assert Bart(data, X, "y", **SMALL | {"n_burn": 1, "n_save": 1}).engine == "gram"


def test_progress_bar():
    states = [State(Model(max_split=[5, 5], offset=[0.0], leaf_prec=[[1.0]], binary=[False], trees=2, maxdepth=3, base=0.95, power=2.0, prec_df=3.0, prec_rate=[[1.0]], prec_start=[[1.0]]), 0, 10)]
    out = io.StringIO()
    bar = callbacks.progress(4, width=8, every=2, file=out)
    for i in range(4):
        bar(i, states)
    drawn = out.getvalue().split("\r")[1:]
    assert [d.split("]")[0].count("#") for d in drawn] == [2, 4, 6, 8] and "3/4" in drawn[2] and "effective 2" in drawn[3] and drawn[3].endswith("\n")


def test_r_like(data):
    kw = {"ndpost": 6, "nskip": 3, "ntree": 5, "row_id": "id", "keys": ["id"]}
    m = mc_gbart(data, X, "y", data.select("id", *X), **kw)
    assert m.yhat_test.count() == 240 * 6 and m.yhat_test_mean.count() == 240 and m.sigma.count() == 12 and m.sigma_.count() == 6 and m.prob_train is None
    p = gbart(data, X, "z", type="pbart", usequants=True, keepevery=1, **kw)
    assert p.prob_train_mean.where("prob between 0 and 1").count() == 240 and p.yhat_train_mean is None and p.ndpost == 6 and p.sigma_mean is None
    with pytest.raises(TypeError):
        gbart(data, X, "y", mc_cores=2)


def test_sample_and_predict(data):
    d = data.withColumn("g", F.when(F.col("a") > 0.5, "u").otherwise("v"))
    m = BARTModel()
    with pytest.raises(NotSampledError):
        m.predict(d)
    m.sample(d, [*X, "g"], "y", num_burnin=5, num_mcmc=4, encoder=Encoder({"g": ["u", "v"]}), row_id="id", mean_forest_params={"num_trees": 5, "max_depth": 4})
    out = m.predict(d.select("id", *X, "g"), type="mean")
    assert out.count() == 240 and abs(out.agg(F.avg("y_hat")).first()[0] - d.agg(F.avg("y")).first()[0]) < 0.5
    p = BARTModel().sample(d, X, "z", num_burnin=3, num_mcmc=3, row_id="id", general_params={"outcome": "binary", "link": "probit"}, mean_forest_params={"num_trees": 4})
    assert {r.y_hat for r in p.predict(d.select("id", *X), type="mean", scale="class").collect()} <= {0.0, 1.0}
    for bad in ({"num_gfr": 1}, {"general_params": {"nope": 1}}, {"mean_forest_params": {"max_depth": 99}}):
        with pytest.raises((ValueError, NotImplementedError)):
            BARTModel().sample(d, X, "y", **bad)


def test_synthetic_moments(spark):
    p = synth.Params(p=12, q=2, sigma2_lin=0.4, sigma2_quad=0.3, sigma2_eps=0.3, k=2, lambda_=0.5, seed=3, error_corr=[[1, 0.6], [0.6, 1]])
    d = p.generate(spark, 4000).cache()
    x = np.array(d.select("x").toPandas()["x"].tolist())
    assert abs(x.mean()) < 0.02 and x.var() == pytest.approx(1, rel=0.02)
    e = np.array(d.select(F.array(*[(F.col("z")[j] - F.col("mu")[j]) for j in range(2)]).alias("e")).toPandas()["e"].tolist())
    assert e.var(axis=0) == pytest.approx([0.3, 0.3], rel=0.1) and np.corrcoef(e.T)[0, 1] == pytest.approx(0.6, abs=0.05)
    assert [s.count() for s in synth.split(d, 1000)] == [1000, 3000]
    v = [np.var(np.array(synth.Params(p=8, q=2, sigma2_lin=0.5, sigma2_quad=0.5, sigma2_eps=0.1, seed=i).beta)) for i in range(40)]
    assert np.mean(v) == pytest.approx(0.5 / 8, rel=0.35)
    part = synth.partition(np.random.default_rng(0), 11, 3)
    assert part.sum(axis=0).tolist() == [1] * 11 and sorted(part.sum(axis=1)) == [3, 4, 4]
    assert synth.ring(7, 2).sum(axis=1).tolist() == [3] * 7
    assert synth.Family(4).quantize(synth.Family(4).ppf(np.array([0.1, 0.3, 0.6, 0.9])), 4).tolist() == [0, 1, 2, 3]
    for kind in ("spike_slab", "gamma"):
        s = synth.Scale.from_peff(kind, 100, 40).sample(np.random.default_rng(0), 200_000)
        assert (s**2).mean() == pytest.approx(1, rel=0.05) and (s**4).mean() == pytest.approx(2.5, rel=0.1)
    h = synth.Params(p=10, q=0, sigma2_lin=1, sigma2_quad=0, sigma2_eps=1, het_strength=0.8, het_shape="scalar", seed=1)
    w = np.array(h.generate(spark, 3000).select("error_scale").toPandas()["error_scale"].tolist())
    assert (w**2).mean() == pytest.approx(1, abs=0.15)
    for bad in ({"k": 2}, {"q": 3}, {"het_shape": "scalar"}):
        with pytest.raises(ValueError):
            synth.Params(**{"p": 6, "q": 2, "sigma2_lin": 1, "sigma2_quad": 1, "sigma2_eps": 1} | bad)


def test_rhat_and_ess():
    r = np.random.default_rng(0)
    x = r.standard_normal((4, 1000))
    assert diagnostics.rank_rhat(x) < 1.01 and diagnostics.rank_rhat(x + np.arange(4)[:, None]) > 1.3 and 3000 < diagnostics.ess(x) < 6000
    a = np.zeros((4, 2000))
    for i in range(1, 2000):
        a[:, i] = 0.9 * a[:, i - 1] + r.standard_normal(4)
    assert 200 < diagnostics.ess(a) < 800
    assert Loop(2, 3, 2).n == 8 and trees.TRACE
