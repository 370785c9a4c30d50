"""What can run after each iteration of the gram engine: ``callback(i, states)`` may read and change the chains."""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass, field
from typing import TextIO

import numpy as np

from arbora.plans.sampler import Callback, State

log = logging.getLogger("arbora")


def compose(*callbacks: Callback) -> Callback:
    def run(i: int, states: list[State]) -> None:
        for c in callbacks:
            c(i, states)

    return run


@dataclass
class Stats:
    """Averages since the last report: share of grow moves, acceptance, leaves a tree, effective number of predictors."""

    seen: int = 0
    sums: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("grow", "accepted", "leaves"), 0.0))
    prob: np.ndarray | None = None

    def update(self, states: list[State]) -> None:
        self.seen += 1
        done = {k: sum(s.done[k] for s in states) for k in states[0].done}
        prop = max(1, done["grow_prop"] + done["prune_prop"])
        self.sums["grow"] += done["grow_prop"] / prop
        self.sums["accepted"] += (done["grow_acc"] + done["prune_acc"]) / prop
        self.sums["leaves"] += float(np.mean([np.count_nonzero(t.split) + 1 for s in states for t in s.trees]))
        self.prob = np.mean([s.varprob() for s in states], axis=0)

    def report(self) -> dict[str, float]:
        p = self.prob[self.prob > 0]
        return {k: v / max(1, self.seen) for k, v in self.sums.items()} | {"effective": float(np.exp(-(p * np.log(p)).sum()))}


def printing(total: int, every: int = 100) -> Callback:
    """Logs a report each ``every`` iterations."""
    stats = Stats()

    def run(i: int, states: list[State]) -> None:
        nonlocal stats
        stats.update(states)
        if (i + 1) % every == 0 or i + 1 == total:
            log.info("%d/%d %s", i + 1, total, " ".join(f"{k} {v:.3g}" for k, v in stats.report().items()))
            stats = Stats()

    return run


def progress(total: int, width: int = 40, every: int = 50, file: TextIO | None = None) -> Callback:
    """A bar on ``file`` (standard error if none), drawn anew each iteration, with a report's averages each ``every``."""
    stats, note = Stats(), ""

    def run(i: int, states: list[State]) -> None:
        nonlocal stats, note
        stats.update(states)
        if (i + 1) % every == 0 or i + 1 == total:
            note, stats = " ".join(f"{k} {v:.3g}" for k, v in stats.report().items()), Stats()
        full = width * (i + 1) // total
        out = file or sys.stderr
        out.write(f"\r[{'#' * full}{'-' * (width - full)}] {i + 1}/{total} {note}" + ("\n" if i + 1 == total else ""))
        out.flush()

    return run
