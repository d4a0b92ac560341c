"""The FSRS update for many items at once, on numpy arrays: the same rule as `fsrs.step_sql` and `streaming.steps.review`.

A log is a sequence, but logs of different items are not: the k-th answers of all items of a batch are applied in one step.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

from studyloom.functions import fsrs

W = fsrs.W
STAGES = ("New", "Learning", "Review", "Relearning")
NEW, LEARNING, REVIEW, RELEARNING = range(4)
NEVER = np.iinfo(np.int64).min


@dataclass
class Memories:
    """One memory per item; `last_review` is NEVER for items not yet answered."""

    stage: np.ndarray
    due: np.ndarray
    stability: np.ndarray
    difficulty: np.ndarray
    reps: np.ndarray
    lapses: np.ndarray
    last_review: np.ndarray

    @classmethod
    def fresh(cls, due: np.ndarray) -> Memories:
        n = len(due)
        whole = lambda: np.zeros(n, np.int64)
        return cls(whole(), due.copy(), np.zeros(n), np.zeros(n), whole(), whole(), np.full(n, NEVER))

    def at(self, i) -> Memories:
        return Memories(*[getattr(self, f.name)[i] for f in fields(self)])

    def put(self, i, other: Memories) -> None:
        for f in fields(self):
            getattr(self, f.name)[i] = getattr(other, f.name)

    def row(self, i: int) -> tuple:
        last = int(self.last_review[i])
        return (STAGES[self.stage[i]], int(self.due[i]), float(self.stability[i]), float(self.difficulty[i]), int(self.reps[i]), int(self.lapses[i]), None if last == NEVER else last)

    def put_row(self, i: int, row: tuple) -> None:
        for f, v in zip(fields(self), (STAGES.index(row[0]), *row[1:6], NEVER if row[6] is None else row[6]), strict=True):
            getattr(self, f.name)[i] = v


def spread_unit(seed: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """0..1 from the hash state of `<item>/` and the number of answers before, digit by digit."""
    h, digits = seed.astype(np.uint64), 1
    while (reps >= 10**digits).any():
        digits += 1
    for k in range(digits - 1, -1, -1):
        on = (reps >= 10**k) | (k == 0)
        ch = (reps // 10**k % 10 + 48).astype(np.uint64)
        h = np.where(on, ((h ^ ch) * np.uint64(fsrs.FNV_PRIME)) & np.uint64(0xFFFFFFFF), h)
    return (h % np.uint64(10_000)).astype(np.float64) / 9999.0


def clamped(d: np.ndarray) -> np.ndarray:
    return np.clip(d, 1.0, 10.0)


def reviewed(m: Memories, ts: np.ndarray, rating: np.ndarray, seed: np.ndarray, retention: float = 0.9) -> Memories:
    """The memories after an answer (1 Again … 4 Easy) to each item at `ts` (microseconds)."""
    n = np.arange(len(ts))
    fresh, review, again = m.stage == NEW, m.stage == REVIEW, rating == 1
    with np.errstate(all="ignore"):
        elapsed = np.where(m.last_review == NEVER, 0.0, (ts - np.where(m.last_review == NEVER, ts, m.last_review)) / float(fsrs.DAY))
        s, d = np.where(m.stability > 0, m.stability, 1.0), np.where(fresh, 1.0, m.difficulty)
        recall = np.where(m.stability > 0, np.power(1.0 + fsrs.FACTOR * np.maximum(0.0, elapsed) / s, fsrs.DECAY), 0.0)
        gain = np.exp(W[8]) * (11.0 - d) * np.power(s, -W[9]) * (np.exp(W[10] * (1.0 - recall)) - 1.0)
        forgot = np.minimum(m.stability, W[11] * np.power(d, -W[12]) * (np.power(m.stability + 1.0, W[13]) - 1.0) * np.exp(W[14] * (1.0 - recall)))
        later = np.stack([forgot, m.stability * (1.0 + gain * W[15]), m.stability * (1.0 + gain), m.stability * (1.0 + gain * W[16])])
        soon = m.stability * np.exp(W[17] * (np.arange(1.0, 5.0)[:, None] - 3.0 + W[18]))
    first = np.broadcast_to(np.array(W[:4])[:, None], later.shape)
    options = np.maximum(fsrs.MIN_STABILITY, np.where(fresh, first, np.where(elapsed < 1, soon, later)))
    unit, chosen = spread_unit(seed, m.reps), options[rating - 1, n]

    def days(at_least: np.ndarray | float, stability: np.ndarray) -> np.ndarray:
        x = stability / fsrs.FACTOR * (retention ** (1.0 / fsrs.DECAY) - 1.0)
        x = np.where(x < 3, x, x * (0.95 + 0.1 * unit))
        return np.minimum(float(fsrs.MAX_INTERVAL_DAYS), np.maximum(np.maximum(1.0, at_least), np.rint(x)))

    hard = days(1.0, options[1])
    good = days(hard + review, options[2])
    picked = np.where(rating == 2, np.minimum(hard, good), np.where(rating == 3, good, days(good + 1.0, options[3])))
    whole = np.where(review | (rating == 4), picked, days(1.0, chosen)).astype(np.int64)
    start = lambda g: clamped(W[4] - np.exp(W[5] * (g - 1.0)) + 1.0)
    drift = d - W[6] * (rating - 3.0) * (10.0 - d) / 9.0
    difficulty = np.where(fresh, start(rating), clamped(W[7] * start(4.0) + (1.0 - W[7]) * drift))
    learned = (rating == 4) | ((rating == 3) & ~fresh)
    stage = np.where(review, np.where(again, RELEARNING, REVIEW), np.where(learned, REVIEW, np.where(m.stage == RELEARNING, RELEARNING, LEARNING)))
    minutes = np.where(review | (m.stage == RELEARNING), np.where(again, 10, 6), np.select([again, rating == 2], [1, 6], 10))
    wait = np.where(stage == REVIEW, whole * fsrs.DAY, minutes * fsrs.MINUTE)
    return Memories(stage, ts + wait, chosen, difficulty, m.reps + 1, m.lapses + (review & again), ts.copy())
