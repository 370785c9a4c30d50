import glob
import os
import tempfile
import time
import zlib

import numpy as np
import pytest

from arbora.llm import common, mixing, near_dedup, pii, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return quality.op6_byte_cnn(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    assert len(scored) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored.itertuples())
    out = scored[scored.held_out & scored.quality.notna()]
    assert len(out) > 60 and (out.predicted == out.quality).mean() > 0.95
    assert (scored.predicted == (scored.score >= 0.7)).all() and scored.score.between(0, 1).all()


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in quality.fresh().items()}
    raw = rng.integers(0, 256, (6, quality.CHUNK)).astype(np.uint8)
    fill, bad, weight = np.array([256, 256, 100, 6, 40, 256]), np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6)

    def loss(q):
        r = quality.responses(q, raw)
        r[np.arange(r.shape[1]) * quality.STRIDE + quality.WIDTH > fill[:, None]] = -np.inf
        m = np.concatenate([np.maximum(r.max(axis=1) + q["b"], 0), (fill / quality.CHUNK)[:, None]], axis=1)
        z = np.maximum(m @ q["v"] + q["c"], 0) @ q["o"] + q["d"]
        return np.mean(np.log1p(np.exp(z)) - bad * z)

    g = quality.gradients(p, raw, fill, bad, weight)
    for k, at in (("w", (3, 5)), ("b", (7,)), ("v", (2, 3)), ("c", (1,)), ("o", (4,)), ("d", (0,)), ("e", (raw[0, 9], 2))):
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert g[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=0.02, abs=2e-5)


def test_whole_text_counts_and_batches_do_not():
    p = quality.train([b"good words here and there " * 20, b"## $$ %% && ** !! " * 30] * 6, np.array([1.0, 0.0] * 6))
    texts = [b"", b"a", b"x" * 127, b"y" * 128, b"z" * 129, b"good words here and there " * 4000, b"good words here and there " * 3000 + b"## $$ %% && ** !! " * 3000]
    together = quality.probability(p, texts)
    assert together == pytest.approx([quality.probability(p, [t])[0] for t in texts], abs=1e-5)
    assert together[5] > 0.7 > together[6]
    assert [len(z) for z in quality.logits(p, texts)] == [1, 1, 1, 1, 1, -(-len(texts[5]) // 128) - 1, -(-len(texts[6]) // 128) - 1]


def test_score_of_odd_rows(docs, odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (7, 7, 0)], "doc_id long, quality int, toxic int")
    d = docs(odd)
    model = quality.fit(d, labels)
    got = quality.score(d, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs([]), quality.fit(docs([]), labels.limit(0))).count() == 0


def test_the_driver_does_not_learn(docs, spark, monkeypatch):
    """One task learns; the driver gets weights."""
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "train", lambda texts, good: {"pid": np.array([os.getpid()]), "n": np.array([len(texts)])})
    got = quality.fit(docs([(k, f"text {k}", "s") for k in range(5)]), labels)
    assert got["pid"][0] != os.getpid() and got["n"][0] == 2


def test_released_shuffles_are_deleted(spark):
    """Garbage collection tells the cleaner; long runs of small heaps would keep their shuffles."""
    root = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    files = lambda: set(glob.glob(f"{root}/blockmgr-*/*/shuffle_*"))
    before = files()
    spark.range(1000).repartition(7, "id").write.format("noop").mode("overwrite").save()
    made, end = files() - before, time.monotonic() + 20
    while made & files() and time.monotonic() < end:
        common.release(spark)
        time.sleep(0.2)
    assert made and not made & files()


def test_pipeline_against_plain_steps(spark):
    import corpus_pipeline as c
    from arbora.llm.common import save

    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf), name)
        assert docs.dtypes == before.dtypes
        kept[name] = docs
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    whole = spark.read.parquet(f"{sf}/documents.parquet").collect()
    p = quality.probability(model, [r.text.encode() for r in whole])
    assert ids(kept["quality"]) == sorted(r.doc_id for r, x in zip(whole, p) if x >= 0.7)
    rows = [(r.doc_id, r.text, r.source) for r in kept["quality"].collect()]
    from tests.llm.test_near_dedup import truth

    comp = truth(rows)
    assert ids(kept["near_dedup"]) == sorted(i for i, *_ in rows if comp.get(i, i) == i)
    assert ids(kept["pii"]) == ids(kept["near_dedup"])
    again = {r.doc_id: r.text for r in pii.replace(kept["near_dedup"]).collect()}
    assert {r.doc_id: r.text for r in kept["pii"].collect()} == again
    sizes = mixing.sized(kept["pii"])
    n = {r.doc_id: r.c for r in mixing.ranked(sizes, mixing.thresholds(sizes), "mix:").withColumn("c", mixing.copies()).collect()}
    assert ids(kept["mixing"]) == sorted(i for i, k in n.items() for _ in range(k))
    pieces = c.run(spark, sf).collect()
    from tests.llm.test_tokens import check_pieces

    check_pieces(pieces, [(r.doc_id, r.text, r.source) for r in kept["mixing"].collect()], 2048)
    assert near_dedup.SIMILAR == 0.8


def test_without_labels_all_documents_stay(spark, docs, odd, tmp_path):
    from arbora.llm import stages

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs(odd)
    assert sorted(map(str, stages.keep_good(spark, d, str(tmp_path)).collect())) == sorted(map(str, d.collect()))


def test_forward_pass_against_plain_loops():
    """The score of a text by loops over chunks, windows and filters."""
    p = quality.train([b"good words here and there " * 20, b"## $$ %% && ** !! " * 30] * 4, np.array([1.0, 0.0] * 4))
    for text in (b"", b"short", b"good words " * 40, bytes(range(256)) * 3):
        raw = quality.padded(text)
        starts = range(0, max(1, len(raw) // quality.HALF - 1) * quality.HALF, quality.HALF)
        z = []
        for a in starts:
            best = np.zeros(quality.FILTERS)
            for k in range(a, min(a + quality.CHUNK, len(raw)), quality.STRIDE):
                if k + quality.WIDTH <= len(text) and k < a + quality.CHUNK:
                    x = np.concatenate([p["e"][b] for b in text[k : k + quality.WIDTH]])
                    best = np.maximum(best, x @ p["w"] + p["b"])
            halves = [np.clip(len(text) - b, 0, quality.HALF) / quality.HALF for b in (a, a + quality.HALF) if b < max(len(raw), 1)]
            m = np.append(best, sum(halves) / (2 if len(halves) == 2 else 1))
            if len(halves) == 1:
                m[-1] = halves[0]
            z.append(np.maximum(m @ p["v"] + p["c"], 0) @ p["o"] + p["d"][0])
        z = np.array(z)
        x = np.array([z.max(), z.mean(), np.log(len(z))])
        want = 1 / (1 + np.exp(-(p["beta"][0] + ((x - p["mean"]) / p["sd"]) @ p["beta"][1:])))
        assert quality.probability(p, [text])[0] == pytest.approx(want, abs=2e-3)
