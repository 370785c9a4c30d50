import glob
import os
import pathlib
import tempfile

import numpy as np

from arbora.llm import common, ego_join, threshold

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in vectors], SCHEMA)


def clusters(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // 8, dim))
    return [(3 * i, (c[i % len(c)] + rng.choice([0.05, 0.3]) * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]


ODD = [(100_001, None), (100_002, []), (100_003, [0.0] * 16), (100_004, [float("nan")] + [1.0] * 15), (100_005, [float("inf")] + [1.0] * 15), (100_006, [None] + [1.0] * 15), (None, [1.0] * 16), (100_007, [1.0, 0.0]), (100_008, [2.0, 0.001])]


def test_join_against_brute_force(spark):
    vs = clusters(400)
    vs += [(90_000 + i, vs[0][1]) for i in range(30)] + ODD  # a common vector
    got = {r.vec_id: r for r in ego_join.join(frame(spark, vs), tile=100).collect()}
    assert len(got) == len(vs)
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vs if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in good}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
    comp = {i: i for i in links}
    for _ in range(60):
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
    for i, r in got.items():
        assert r.n_links == len(links.get(i, ())) and r.component_id == comp.get(i, i) and r.kept == (r.component_id == i)


def test_pairs_of_tiles_are_not_shuffled(spark):
    """The files under the shared folder and all shuffles are a few times the vectors, however many pairs of tiles there are."""
    rng = np.random.default_rng(1)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((6000, 64)).astype(np.float32))])
    df.write.parquet(path := common.shared_dir(spark, "vectors"))
    local = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    had = set(glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data"))
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    on_disk = lambda: sum(f.stat().st_size for f in shared.rglob("*.parquet") if f.is_file())
    before = on_disk()
    ego_join.join(spark.read.parquet(path), tile=100).write.format("noop").mode("overwrite").save()
    shuffled = sum(os.stat(f).st_size for f in set(glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data")) - had if os.path.exists(f))
    assert on_disk() - before + shuffled < 8 * 6000 * 64 * 4


def test_join_of_signed_zeros_and_doubles(spark):
    """Vectors whose zeros differ in sign are one class; components that are no floats stay exact."""
    rows = [(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [1.0, 0.4843221048378526]), (4, [1.0, 0.0])]  # 3 and 4 stand at 0.9 in doubles
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array(rows[2][1]) / np.linalg.norm(rows[2][1])
    assert {r.vec_id: (r.n_links, r.component_id) for r in ego_join.join(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (int(x[0] >= 0.9), 3), 4: (int(x[0] >= 0.9), 3 if x[0] >= 0.9 else 4)}


def test_join_empty(spark):
    assert ego_join.join(frame(spark, [])).count() == 0
    assert [r.n_links for r in ego_join.join(frame(spark, ODD[:4])).collect()] == [0] * 4


def test_top_k_against_brute_force(spark):
    vs = [(100 * (i // 2) if i % 50 == 0 else i, v) for i, v in clusters(300)] + [(7001, clusters(8)[0][1]), (7003, clusters(8)[0][1])] + ODD
    vs = list(dict(vs).items())
    got = {}
    for r in threshold.top_k(frame(spark, vs), k=10, every=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vs if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    queries = [i for i in whole if i % 100 == 0]
    assert queries and set(got) == {q for q in queries if any(len(whole[j]) == len(whole[q]) and j != q for j in whole)}
    for q in got:
        s = sorted((-sum(a * b for a, b in zip(whole[q], v)), j) for j, v in whole.items() if j != q and len(v) == len(whole[q]))[:10]
        assert sorted(got[q]) == [(k + 1, j, -x) for k, (x, j) in enumerate(s)]


def test_threshold_stops_early():
    """On lists where one dimension tells, few rows are met."""

    class Tile:
        ids = np.arange(5000)
        vectors = np.column_stack([np.arange(5000.0), np.zeros(5000)])

    class Counted(np.ndarray):
        rows = 0

        def __getitem__(self, key):
            Counted.rows += len(key) if isinstance(key, np.ndarray) else 0
            return np.asarray(self).__getitem__(key)

    lists = threshold.Lists(Tile.ids, Tile.vectors)
    lists.v = lists.v.view(Counted)
    ids, scores = lists.top(np.array([3.0, 0.0]), 4999, 3)
    assert ids.tolist() == [4998, 4997, 4996] and scores.tolist() == [14994.0, 14991.0, 14988.0] and 0 < Counted.rows < 100


def test_top_k_empty(spark):
    assert threshold.top_k(frame(spark, [])).count() == 0
    assert threshold.top_k(frame(spark, [(100, [1.0] * 4)])).count() == 0


def test_top_k_of_large_components(spark):
    """Scores beyond doubles' and longs' whole numbers: exact ranks, ties to the smaller id, scores at the ends of a long."""
    rng = np.random.default_rng(5)
    vs = [(i, (rng.standard_normal(3) * 10.0 ** rng.choice([0, 4, 9, 14, 17])).tolist()) for i in range(1, 140)]
    vs += [(200, [1e14, 3.0, -2.0]), (300, [1e14, 3.0, -2.0]), (400, [0.0, 0.0, 0.0]), (500, [1e300, -1e300, 0.5])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    ends = lambda x: max(-(2**63), min(2**63 - 1, x))
    # the ends of a long, as the double next to them
    whole = {i: [int(float(ends(int(np.floor(1024 * x))))) for x in v] for i, v in vs}
    got = {}
    for r in threshold.top_k(df, k=10, every=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {100, 200, 300, 400, 500}
    for q, rows in got.items():
        s = sorted((-sum(a * b for a, b in zip(whole[q], v)), j) for j, v in whole.items() if j != q)[:10]
        assert rows == [(j, ends(-x)) for x, j in s]
