"""Mixture-controlled packing: deficit round-robin over one queue of documents for each source.

In round r each queue's deficit grows by its quantum, and the queue serves the whole tokens of its deficit; the fraction
is carried to the next round. Quanta are ratios of integers, so what queue s has served before round r is
``min(N_s, r * A_s // B)``: the deficits at any round, in any partition, are known without the rounds before, and
partitions pack on their own. A round holds about one window of tokens, in the queues' order; windows are cut from the
stream of rounds, so each is full and meets the targets within a token or two a source, except where a queue is empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import BROADCAST_ROWS, running_base, save, small_batches, table
from arbora.llm.tokens import encoder, slices, word_bpe

WINDOW = 2048
#: Of more sources than so many, those without a target share queues, by hash.
MOST_QUEUES = 2000
#: Names of the queue of null sources, and what those of shared queues start with.
NULL, SHARED = "\U0010ffff", "\U0010fffe"
_SAFE = 1 << 62
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def scaled(r: np.ndarray, a: int, b: int) -> np.ndarray:
    """r * a // b for integers r >= 0, exact at any size."""
    if not len(r) or int(r.max()) * a < _SAFE:
        return r * a // b
    return np.array([int(x) * a // b for x in r], np.int64)


class Plan:
    """Quanta of the queues: tokens[s] in queue s, weights[s] its target share."""

    def __init__(self, tokens: list[int], weights: list[float] | None, window: int = WINDOW):
        self.tokens, self.window = np.array(tokens, np.int64), window
        total = int(sum(tokens))
        if weights is None:  # each source's share of all tokens: all queues end together
            self.a, self.b = [int(n) for n in tokens], max(1, -(-total // window))
        else:
            if not all(w > 0 for w in weights):
                raise ValueError("weights must be positive")
            scale = 1 << 20
            whole = [max(1, round(w / sum(weights) * scale)) for w in weights]
            self.a, self.b = [w * window for w in whole], sum(whole)

    def served(self, s: int, r: np.ndarray) -> np.ndarray:
        return np.minimum(self.tokens[s], scaled(r, self.a[s], self.b))

    def rounds_of(self, s: int, first: int, last: int) -> np.ndarray:
        """The rounds that serve the tokens first..last of queue s."""
        at = [-(-(x + 1) * self.b // self.a[s]) - 1 for x in (first, last)]
        return np.arange(at[0], at[1] + 1, dtype=np.int64)

    def before(self, s: int, r: np.ndarray) -> np.ndarray:
        """Tokens of the stream before queue s in round r."""
        out = np.zeros(len(r), np.int64)
        for k in range(len(self.a)):
            out += self.served(k, r + 1 if k < s else r)
        return out

    def pieces(self, s: int, at: int, n: int) -> list[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of the n tokens of queue s from its token at."""
        r = self.rounds_of(s, at, at + n - 1)
        lo, hi = np.maximum(self.served(s, r), at), np.minimum(self.served(s, r + 1), at + n)
        where = self.before(s, r) + lo - self.served(s, r)
        out: list[tuple[int, int, int, int]] = []
        for a, b, p in zip(lo.tolist(), hi.tolist(), where.tolist(), strict=True):
            while a < b:
                k = min(b - a, self.window - p % self.window)
                if out and out[-1][2] == p // self.window and out[-1][3] + out[-1][1] == p % self.window:  # goes on without a gap
                    out[-1] = (out[-1][0], out[-1][1] + k, *out[-1][2:])
                else:
                    out.append((a - at, k, p // self.window, p % self.window))
                a, p = a + k, p + k
        return out


def queue_of(queues: int | None, named: list[str]) -> Column:
    """The queue of a row: its source, or one of so many shared ones where the source isn't named."""
    source = F.col("source").cast("string")
    if queues is not None:
        shared = F.concat(F.lit(SHARED), F.pmod(F.hash(source), F.lit(queues)).cast("string"))
        source = F.when(source.isin(named), source).otherwise(F.when(source.isNotNull(), shared)) if named else shared
    return F.coalesce(source, F.lit(NULL)).alias("queue")


def tokenized(docs: DataFrame, vocabulary: str, queue: Column) -> DataFrame:
    """Writes (doc_id, source, queue, part, at, ids): ``at`` counts the tokens of the queue before, in the same part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary), TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in slices(whole, 3):
                flat, ends = enc.documents(batch.column(3))
                ids = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                where = []
                for q, x in zip(batch.column(2).to_pylist(), ids, strict=True):
                    where.append(at.get(q, 0))
                    at[q] = where[-1] + len(x) // 4
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([part] * len(ids), pa.int32()), pa.array(where, pa.int64()), pa.array(np.diff(ends)), pa.array(ids, pa.binary())], ["doc_id", "source", "queue", "part", "at", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), queue, "text")
    return save(rows.mapInArrow(encode, "doc_id long, source string, queue string, part int, at long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Packs (doc_id, source, text) into windows of ``window`` tokens: one row for each piece of a document.

    targets: weights of the sources in each window (those not named: 1); by default their shares of all tokens, so that
    every window has them all up to the end. Of more than MOST_QUEUES sources, those without a target share queues that
    weigh what their sources do together; more targets than MOST_QUEUES are an error there. Every token is packed once; only the last window may be short.
    Null and empty texts are their end id; null sources are a queue of their own, after the others; repeated rows are
    packed as often as they stand; no rows give no rows; further columns are not read.
    """
    small_batches(docs.sparkSession)
    queues, named = None, [s for s in targets or () if s is not None]
    if docs.select("source").distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES:
        queues = MOST_QUEUES
        if len(named) > MOST_QUEUES:
            raise ValueError(f"targets for more than {MOST_QUEUES} sources")
    toks = tokenized(docs, vocabulary, queue_of(queues, named))
    by_part = save(toks.groupBy("part", "queue").agg(F.sum("n").alias("n")), "queues")  # a source's rows meet as a row a part
    names = sorted((r.queue, r.n) for r in by_part.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # at most 2 * MOST_QUEUES + 1
    number = {q: k for k, (q, _) in enumerate(names)}
    weights = None
    if targets is not None:
        together = {}
        if queues is not None:
            together = {r.queue: r["count"] for r in docs.select("source").distinct().select(queue_of(queues, named)).groupBy("queue").count().where(F.col("queue").startswith(SHARED)).collect()}
        weights = [together.get(q) or targets.get(None if q == NULL else q, 1.0) for q, _ in names]
    plan = Plan([n for _, n in names], weights, window)
    bases = running_base(by_part, ["part"], "n", "base", ["queue"]).select("part", "queue", "base")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                out = []
                for doc, source, queue, at, ids in zip(*(c.to_pylist() for c in whole.slice(k, 256).columns), strict=True):
                    n = len(ids) // 4
                    for start, length, seq, offset in plan.pieces(number[queue], at, n):
                        out.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, seq, offset, source))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [x.split()[0] for x in PIECES.split(", ")])

    few = by_part.count() <= BROADCAST_ROWS
    rows = toks.join(F.broadcast(bases) if few else bases, ["part", "queue"]).select("doc_id", "source", "queue", (F.col("base") + F.col("at")).alias("at"), "ids")
    return rows.mapInArrow(cut, PIECES)


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe())
