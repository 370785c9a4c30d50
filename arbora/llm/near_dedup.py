"""Near-duplicate documents by ProbMinHash of weighted word shingles, banding, and verification.

A shingle that stands n times in a document weighs 1 + ln n there: more than one that stands once, but a line that fills
half a text, as in tables and forms, does not make unrelated documents alike. Signatures estimate the probability Jaccard
similarity of the weights, bands and the cut of candidates follow that estimate, and pairs are verified by that
similarity, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import save, small_batches, table
from arbora.llm.components import components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
#: Components of a signature. The first BANDS * ROWS make the bands; all of them estimate the similarity.
SIZE = 512
#: Estimates from which a pair is verified: four standard deviations below SIMILAR.
LIKELY = 0.73
#: Rows of a block of a bucket: of those outside its largest component, and of all.
OUTSIDE, INSIDE = 512, 2048
_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2^64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Of _BASE and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(words: list[str]) -> np.ndarray:
    """64 bits for each word, from differences of prefix sums of a polynomial in its bytes."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    up, down = powers(len(raw))
    ends = np.flatnonzero(raw == 32)
    with np.errstate(over="ignore"):
        sums = np.cumsum((raw + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums[ends[:-1]]])
        starts = np.concatenate([[0], ends[:-1] + 1])
        return mixed((sums[ends] - before) * down[starts])


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of so many word hashes."""
    n = len(h) - length + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = mixed(out * _GOLD + h[j : j + n] + np.uint64(j + 1))
    return out


def shingles(words: list[str], k: int = WORDS) -> np.ndarray:
    """A 64-bit hash of each run of k words; fewer words are one shingle, none are none."""
    return runs(word_hashes(words), min(k, len(words))) if words else np.zeros(0, np.uint64)


def distinct(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, how often) of lists of words, none empty, each once, sorted by document and shingle."""
    size = np.array([len(w) for w in texts])
    at = np.concatenate([[0], np.cumsum(size)])
    h = word_hashes([x for w in texts for x in w])
    own = np.repeat(np.arange(len(texts)), np.maximum(size - WORDS + 1, 1))
    if (size >= WORDS).all():
        every = runs(h, WORDS)
        found = every[np.arange(len(own)) + np.repeat(np.arange(len(texts)), size - WORDS + 1) * (WORDS - 1)]
    else:
        found = np.concatenate([runs(h[a:b], min(WORDS, b - a)) for a, b in zip(at[:-1], at[1:], strict=True)])
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (own[1:] != own[:-1])]))
    return found[new], own[new], np.diff(new, append=len(found))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, m: int = SIZE) -> np.ndarray:
    """(docs, m) components, m a power of 2, of ProbMinHash signatures: two agree in one with the probability Jaccard similarity.

    ``owner`` has each element's document. Each element arrives in a Poisson process at the rate of its weight; each
    arrival picks a component, which keeps the element that came first. An element goes on only as long as it may come
    before the first arrival at the last of its document's components: when none may, the signature is complete. The
    documents of a batch draw their next arrivals together, but each draw depends on its element alone.
    """
    first, winner = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    own, gap, time, count, limit = owner, 1 / weights, np.zeros(len(elements)), 0, np.full(docs, np.inf)
    while len(elements):
        each = 1 + 4096 // len(elements)  # few elements draw more at a time; what they draw is the same
        with np.errstate(over="ignore"):
            bits = mixed(elements[:, None] + np.arange(count + 1, count + each + 1, dtype=np.uint64) * _GOLD)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * gap[:, None]  # high bits for the time
        gaps[:, 0] += time
        at = np.cumsum(gaps, axis=1)
        where = own[:, None] * m + (bits & np.uint64(m - 1)).astype(np.int64)  # low bits for the place
        count, time = count + each, at[:, -1]
        better = np.flatnonzero((at < first[where]).ravel())
        at, where = at.ravel(), where.ravel()
        better = better[np.argsort(-at[better], kind="stable")]  # the earliest is written last
        first[where[better]], winner[where[better]] = at[better], elements[better // each]
        left = own[np.flatnonzero(np.diff(own, prepend=-1))]
        limit[left] = first.reshape(docs, m)[left].max(axis=1)
        live = time < limit[own]
        if live.mean() < 0.75:  # those that are late go on for a while, and change nothing
            elements, own, gap, time = elements[live], own[live], gap[live], time[live]
    return winner.reshape(docs, m)


def weights(often: np.ndarray) -> np.ndarray:
    return 1 + np.log(often)


def sketches(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of words, none empty: keys of the bands (docs, BANDS), signatures in 8 bits."""
    found, owner, often = distinct(texts)
    winner = prob_minhash(found, weights(often), owner, len(texts))
    s = winner[:, : BANDS * ROWS].reshape(len(texts), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), BANDS))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mixed(key * _GOLD + s[:, :, r])
    return key.view(np.int64), (mixed(winner) >> np.uint64(56)).astype(np.uint8)


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of (distinct elements, weights): of the elements i of both, the sum of
    1 / sum over all j of max(x_j / x_i, y_j / y_i).

    In the order of the ratios x_i / y_i the maxima are x's from an element on and y's before it, so sums of
    ends of that order give all terms. Equal weights give the Jaccard similarity of the sets.
    """
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    a, b = x[1][i].astype(np.float64), y[1][j].astype(np.float64)
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    from_here = np.cumsum(a[::-1])[::-1] + (x[1].sum() - a.sum())
    before = np.cumsum(b) - b + (y[1].sum() - b.sum())
    return float((a / (from_here + a / b * before)).sum())


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, words_hash, bands, signature) of documents that have an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            a = 0
            while a < whole.num_rows:
                b, size = a, 0  # documents of some 100,000 words at a time, or one
                ids, texts, hashes = [], [], []
                while b < whole.num_rows and (b == a or size < 100_000):
                    words = (whole.column(1)[b].as_py() or "").split()
                    if words:
                        ids.append(whole.column(0)[b].as_py())
                        texts.append(words)
                        hashes.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                        size += len(words)
                    b += 1
                a = b
                if ids:
                    key, sig = sketches(texts)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(key.tolist(), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "words_hash", "bands", "signature"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, words_hash binary, bands array<long>, signature binary")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(len x, len y) shares of equal components of signatures."""
    out = np.zeros((len(x), len(y)), np.int32)
    for a in range(0, len(x), 16):
        out[a : a + 16] = (x[a : a + 16, None, :] == y[None]).sum(axis=2)
    return out / SIZE


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in a share of at least LIKELY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in ("sa", "sb"))
                keep = np.flatnonzero((x == y).mean(axis=1) >= LIKELY)
                yield batch.take(pa.array(keep)).select(["a", "b"])

    s = sigs.select("doc_id", "signature")
    wide = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b")
    return wide.mapInArrow(run, "a long, b long")


def across(active: DataFrame, sigs: DataFrame, step: str) -> DataFrame:
    """Likely pairs (a, b) of the buckets' members (key, band, doc_id, component, open) that lie in different components.

    Of a bucket, those outside its largest component meet all, in blocks: the rows of a task are bounded, and the largest
    component, which may be most of the table, is not compared with itself. Only pairs with an open member are sought,
    and members that have none to meet are left out. A pair that shares several bands is given by the first.
    Step "best": of each document only its likeliest partner; "other": one of its partners, by hash; "all": all of them.
    """
    sizes = active.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum(F.col("open").cast("long")).alias("q")).groupBy("key").agg(
        F.max_by("component", F.struct("k", "component")).alias("core"), F.max_by("q", F.struct("k", "component")).alias("open_in"), F.sum("q").alias("open_all"), F.sum("k").alias("size"), F.max("k").alias("most")
    )
    open_out = F.col("open_all") - F.col("open_in")
    rows = active.join(sizes.where("core is not null and size > most"), "key")
    rows = rows.withColumn("out", (F.col("component") != F.col("core")) & (F.col("open") | (F.col("open_in") > 0))).withColumn("in", F.col("open") | (open_out > 0)).where(F.col("out") | F.col("in"))
    rows = rows.withColumn("ob", F.ceil((F.col("size") - F.col("most")) / OUTSIDE)).withColumn("mb", F.ceil(F.col("size") / INSIDE))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    cell = lambda side, o, m: F.struct(F.lit(side).alias("side"), o.alias("o"), m.alias("m"))
    upto = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    none = F.array().cast("array<struct<side:int,o:int,m:int>>")
    outer = F.when(F.col("out"), F.transform(upto(F.col("mb")), lambda m: cell(0, block(F.col("ob")), m))).otherwise(none)
    inner = F.when(F.col("in"), F.transform(upto(F.col("ob")), lambda o: cell(1, o, block(F.col("mb"))))).otherwise(none)
    own = rows.select("doc_id", F.struct("key", "band", "component", "open", F.concat(outer, inner).alias("cells")).alias("at")).groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    own = own.join(sigs.select("doc_id", "signature", "bands"), "doc_id")  # a signature once a document, of BANDS memberships at most
    spread = own.select("doc_id", "signature", "bands", F.explode("at").alias("at")).select("doc_id", "signature", "bands", "at.key", "at.band", "at.component", "at.open", F.explode("at.cells").alias("cell")).select("*", "cell.*").drop("cell")

    def run(got: pa.Table) -> pa.Table:
        side = got.column("side").to_numpy()
        ids, comp, live = (got.column(c).to_numpy() for c in ("doc_id", "component", "open"))
        sig = np.frombuffer(b"".join(got.column("signature").to_pylist()), np.uint8).reshape(-1, SIZE)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        e = agreement(sig[x], sig[y])
        ok = (e >= LIKELY) & (comp[x][:, None] != comp[y]) & (live[x][:, None] | live[y])
        i, j = np.nonzero(ok)
        if step != "all" and len(i):
            if step == "other":
                e = 1 + (mixed(ids[x].astype(np.uint64)[:, None] * _GOLD + ids[y].astype(np.uint64)) >> np.uint64(12)).astype(np.float64)
            e = np.where(ok, e, -1)
            i, j = np.flatnonzero(ok.any(axis=1)), e.argmax(axis=1)[ok.any(axis=1)]
        score = e[i, j]
        a, b = x[i], y[j]
        if step == "all" and len(a):  # this band is the first that they share, if none before is equal
            keys = np.array(got.column("bands").to_pylist(), np.int64)
            own = (keys[a] == keys[b]).argmax(axis=1) == got.column("band")[0].as_py()
            a, b, score = a[own], b[own], score[own]
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64()), "e": pa.array(score, pa.float64())})

    found = spread.groupBy("key", "o", "m").applyInArrow(run, "a long, b long, e double")
    if step != "all":
        found = found.groupBy("a").agg(F.max_by("b", F.struct("e", "b")).alias("b"))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' shingles, by their ``weights``, have a similarity of at least SIMILAR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None

        def weighed(text: str) -> tuple[np.ndarray, np.ndarray]:
            found, often = np.unique(shingles(text.split()), return_counts=True)
            return found, weights(often)

        for batch in batches:
            keep, x, y = [], batch.column("ta"), batch.column("tb")
            for k, b in enumerate(batch.column("b").to_pylist()):  # texts one by one: they may be long
                if b != last:  # pairs of one pivot come together
                    last, own = b, weighed(y[k].as_py())
                if similarity(weighed(x[k].as_py()), own) >= SIMILAR - 1e-9:
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    wide = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return wide.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, component_id, kept): documents linked, also over others, by a similarity of 0.8 or more.

    Documents of the same words are one class, in the name of the least id. Of the classes that share a band, first each is
    compared with one pivot of the bucket: the one whose buckets hold most rows, which is the middle of a group of varied
    copies. Buckets that are not yet one component go on: each document outside a bucket's largest component is
    compared with its likeliest partner in another component, then with any other; then all likely pairs across components are. A pair is
    likely if its signatures agree in 0.73 of 512 components, four standard deviations below 0.8. A document for which a step
    finds no likely partner is closed: it has none later, as components only grow. Buckets without open documents are
    done. So no link between components is lost, while a large group of copies costs few pairs a row.
    Similarity: ``similarity`` of ``weights``, which count as shares of a document, so that a text and the same text twice
    are alike. Null, empty and blank texts and null ids link with nothing; repeated rows of an id share its component;
    ``kept`` marks the least id of each component; other columns are not read; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    sig = save(signatures(docs), "signatures")
    classes = save(sig.groupBy("words_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sig.join(classes.select(F.col("rep").alias("doc_id"), "words_hash"), ["doc_id", "words_hash"], "left_semi").dropDuplicates(["doc_id"])
    rows = reps.select(F.posexplode("bands").alias("band", "key"), "doc_id")
    members = save(rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "members")
    middle = members.join(members.groupBy("doc_id").agg(F.sum("size").alias("near")), "doc_id")
    pivots = middle.groupBy("key").agg(F.max_by("doc_id", F.struct("near", F.xxhash64("doc_id"), "doc_id")).alias("p"))
    pairs = members.join(pivots, "key").where(F.col("doc_id") != F.col("p")).select(F.greatest("doc_id", "p").alias("a"), F.least("doc_id", "p").alias("b")).distinct()
    tried, comps, live = None, None, None
    for step in ("pivot", "best", "other", "all"):
        if step != "pivot":
            now = members.where("size > 2").select("key", "band", "doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            now = now.withColumn("open", F.lit(True)) if live is None else now.join(live, "doc_id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
            split = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("open").alias("z")).where("x <> y and z").select("key")
            active = save(now.join(split, "key"), "active")
            if not active.limit(1).count():
                break
            found = save(across(active, sig, step), "likely")
            live = found.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("open", F.lit(True))
            pairs = found.join(tried, ["a", "b"], "left_anti")
        pairs = save(likely(pairs, sig) if step == "pivot" else pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = save(verified(pairs, docs), "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
        comps = components(found if comps is None else found.union(comps.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    own = sig.select("doc_id", "words_hash").join(classes.where("copies > 1").select("words_hash", "rep"), "words_hash", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("node"))
    if comps is not None:
        own = own.join(comps, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    else:
        own = own.withColumnRenamed("node", "component_id").select("doc_id", "component_id")
    alone = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"))
    return own.union(alone.select("doc_id", F.col("doc_id").alias("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
