"""The FSRS update for one answer in Python: state held by a streaming operator cannot be a column expression.

It is the same rule as `functions.fsrs.step_sql`; a test holds the two together over whole logs.
"""

from __future__ import annotations

import math

from studyloom.functions import fsrs

W = fsrs.W


def fnv1a(text: str, h: int = fsrs.FNV_OFFSET) -> int:
    for ch in text:
        h = ((h ^ ord(ch)) * fsrs.FNV_PRIME) & 0xFFFFFFFF
    return h


def _clamp(d: float) -> float:
    return min(10.0, max(1.0, d))


def _start_difficulty(g: int) -> float:
    return _clamp(W[4] - math.exp(W[5] * (g - 1)) + 1.0)


def review(memory: tuple, ts: int, rating: int, item: str, retention: float = 0.9, seed: int | None = None) -> tuple:
    """(stage, due, stability, difficulty, reps, lapses, last_review) after an answer at `ts` (microseconds).

    `seed`: the hash state of `<item>/` where it is known already.
    """
    stage, _, s, d, reps, lapses, last = memory
    elapsed = 0.0 if last is None else (ts - last) / fsrs.DAY
    unit = ((fnv1a(f"{item}/{reps}") if seed is None else fnv1a(str(reps), seed)) % 10000) / 9999.0
    if stage == "New":
        options = list(W[:4])
    elif elapsed < 1:
        options = [s * math.exp(W[17] * (g - 3 + W[18])) for g in (1, 2, 3, 4)]
    else:
        r = (1.0 + fsrs.FACTOR * max(0.0, elapsed) / s) ** fsrs.DECAY if s > 0 else 0.0
        gain = math.exp(W[8]) * (11.0 - d) * s ** -W[9] * (math.exp(W[10] * (1.0 - r)) - 1.0)
        forgot = min(s, W[11] * d ** -W[12] * ((s + 1.0) ** W[13] - 1.0) * math.exp(W[14] * (1.0 - r)))
        options = [forgot, s * (1 + gain * W[15]), s * (1 + gain), s * (1 + gain * W[16])]
    options = [max(fsrs.MIN_STABILITY, x) for x in options]

    def days(at_least: float, stability: float) -> float:
        x = stability / fsrs.FACTOR * (retention ** (1.0 / fsrs.DECAY) - 1.0)
        x = x if x < 3 else x * (0.95 + 0.1 * unit)
        return min(float(fsrs.MAX_INTERVAL_DAYS), max(1.0, at_least, round(min(x, 1e9))))

    if stage == "New":
        difficulty = _start_difficulty(rating)
    else:
        drift = d - W[6] * (rating - 3.0) * (10.0 - d) / 9.0
        difficulty = _clamp(W[7] * _start_difficulty(4) + (1.0 - W[7]) * drift)
    if stage == "Review":
        nxt = "Relearning" if rating == 1 else "Review"
    elif rating == 4 or (rating == 3 and stage != "New"):
        nxt = "Review"
    else:
        nxt = "Relearning" if stage == "Relearning" else "Learning"
    if nxt != "Review":
        minutes = (10 if rating == 1 else 6) if stage in ("Review", "Relearning") else {1: 1, 2: 6}.get(rating, 10)
        wait = minutes * fsrs.MINUTE
    elif stage == "Review" or rating == 4:
        hard = days(1.0, options[1])
        good = days(hard + (1.0 if stage == "Review" else 0.0), options[2])
        pick = min(hard, good) if rating == 2 else good if rating == 3 else days(good + 1.0, options[3])
        wait = int(pick) * fsrs.DAY
    else:
        wait = int(days(1.0, options[rating - 1])) * fsrs.DAY
    return (nxt, ts + wait, options[rating - 1], difficulty, reps + 1, lapses + (stage == "Review" and rating == 1), ts)
