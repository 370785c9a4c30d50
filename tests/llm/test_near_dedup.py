import math
import random
from collections import Counter

import numpy as np
import pytest

from arbora.llm import near_dedup as nd
from arbora.llm.components import components


def alike(p, q):
    """The probability Jaccard similarity of two dicts of weights, term by term as it is defined."""
    if set(p) == set(q) and len(set(p.values())) == len(set(q.values())) == 1:
        return 1.0
    if len(p.keys() & q.keys()) < 0.5 * min(len(p), len(q)):
        return 0.0  # far below 0.8 in these tests, whose weights differ little
    return sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys()) for i in p.keys() & q.keys())


def truth(rows, alike=alike):
    sh = {}
    for i, t, _ in rows:
        w = (t or "").split()
        if i is not None and w:
            n = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
            sh[i] = {x: 1 + math.log(k) for x, k in n.items()}
    comp = {i: i for i in sh}
    ids = sorted(sh)
    known = {}
    for _ in ids:
        before = dict(comp)
        for a in ids:
            for b in ids:
                if a < b and comp[a] != comp[b]:
                    if (a, b) not in known:
                        plain = set(sh[a].values()) == set(sh[b].values()) == {1.0}
                        both = len(sh[a].keys() & sh[b].keys())
                        known[a, b] = both >= 0.8 * len(sh[a].keys() | sh[b].keys()) if plain else alike(sh[a], sh[b]) >= 0.8 - 1e-9
                    if known[a, b]:
                        comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return comp


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 5), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (1, 25), (40, 41), (40, 41)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 20: 1, 21: 1, 22: 1, 23: 1, 24: 1, 25: 1, 1: 1, 40: 40, 41: 40}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_against_brute_force(docs, odd):
    r = random.Random(3)
    base = [[f"v{r.randrange(5000)}" for _ in range(r.randrange(6, 120))] for _ in range(25)]
    rows = list(odd)
    for i in range(260):
        w = list(base[i % 25])
        for _ in range(r.choice([0, 0, 1, 2, 5, 9])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((100 + i, " ".join(w), "a"))
    rows += [(500, "same short", "a"), (501, "same  short", "b"), (502, "other short", "a")]
    got = nd.groups(docs(rows)).collect()
    assert len(got) == len(rows)
    want = truth(rows)
    for g in got:
        assert g.component_id == want.get(g.doc_id, g.doc_id) and g.kept == (g.doc_id is None or g.component_id == g.doc_id)


def test_one_large_group_of_varied_copies(docs):
    r = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(80)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "a"))
    want = truth(rows)
    assert {g.doc_id: g.component_id for g in nd.groups(docs(rows)).collect()} == want


def test_empty(docs):
    assert nd.groups(docs([])).count() == 0


@pytest.mark.parametrize("shared", [20, 60, 90])
def test_signature_estimates_probability_jaccard(shared):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    b = np.concatenate([a[:shared], rng.integers(0, 2**63, 100 - shared).astype(np.uint64)])
    wa, wb = rng.integers(1, 6, 100).astype(float), rng.integers(1, 6, 100).astype(float)
    p, q = dict(zip(a.tolist(), wa / wa.sum())), dict(zip(b.tolist(), wb / wb.sum()))
    jp = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys()) for i in p.keys() & q.keys())
    s = nd.prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 100), 2, 4096)
    assert abs((s[0] == s[1]).mean() - jp) < 5 * np.sqrt(jp * (1 - jp) / 4096) + 0.003


def test_signature_does_not_depend_on_the_batch():
    x = ["a b c d e f".split(), [f"w{i}" for i in range(300)], ["z"]]
    alone = [nd.sketches([w]) for w in x]
    keys, sig = nd.sketches(x)
    for i in range(3):
        assert (keys[i] == alone[i][0][0]).all() and (sig[i] == alone[i][1][0]).all()


def test_similarity_is_the_sum_that_defines_it():
    r = np.random.default_rng(2)
    for _ in range(50):
        sets = [np.unique(r.integers(0, 30, r.integers(1, 25)).astype(np.uint64)) for _ in range(2)]
        x, y = ((s, nd.weights(r.integers(1, 9, len(s)))) for s in sets)
        p, q = (dict(zip(s.tolist(), w.tolist(), strict=True)) for s, w in (x, y))
        want = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys()) for i in p.keys() & q.keys())
        assert nd.similarity(x, y) == pytest.approx(want, abs=1e-12)


def test_repeated_passages_against_brute_force(docs):
    """Passages that repeat weigh more, and other lines that fill most of two texts do not make them alike."""
    r = random.Random(7)
    rows = []
    for g in range(4):
        w = [f"g{g}w{i}" for i in range(200)]
        for k, times in enumerate((0, 1, 5, 20)):
            x = list(w)
            for _ in range(k):
                x[r.randrange(200)] = f"n{r.randrange(10**6)}"
            a = r.randrange(190)
            rows.append((10 * g + k, " ".join(x + x[a : a + 10] * times), "a"))
    rows += [(100 + i, " ".join([f"own{i}x{j}" for j in range(60)] + ["is", "so."] * 300), "a") for i in range(6)]
    rows += [(200 + i, " ".join([f"all{j}" for j in range(400)] + [f"one{i}"] * 400), "a") for i in range(3)]
    want = truth(rows)
    assert len({want[i] for i in range(100, 106)}) == 6 and len({want[i] for i in range(200, 203)}) == 1
    assert len({want[i] for i in (0, 1, 2, 3)}) < 4
    assert {g.doc_id: g.component_id for g in nd.groups(docs(rows)).collect()} == want


def test_recall_of_pairs_just_above_the_threshold():
    """Of 400 pairs of similarity 0.8 to 0.82, with repeated shingles, all share a band and are likely."""
    r = random.Random(11)
    texts, found = [], 0
    while len(texts) < 800:
        w = [f"v{r.randrange(10**6)}" for _ in range(300)]
        w += w[50:80] * 3
        x = list(w)
        for _ in range(r.randrange(8, 16)):
            x[r.randrange(len(x))] = f"n{r.randrange(10**6)}"
        both = []
        for t in (w, x):
            s, n = np.unique(nd.shingles(t), return_counts=True)
            both.append((s, nd.weights(n)))
        if 0.8 <= nd.similarity(*both) < 0.82:
            texts += [w, x]
    for k in range(0, 800, 2):
        keys, sig = nd.sketches(texts[k : k + 2])
        found += (keys[0] == keys[1]).any() and (sig[0] == sig[1]).mean() >= nd.LIKELY
    assert found >= 398
