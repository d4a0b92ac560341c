"""FSRS-5 spaced repetition as Spark SQL expressions.

Times inside a memory are microseconds (BIGINT), so arithmetic is exact and the same expression serves the batch fold,
the one-step update and the stream. `let` binds an intermediate value (a one-element array `transform`), so each is
evaluated once per review.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published FSRS-5 default weights w0..w18 and bounds.
W = (
    0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192,
    1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621,
)
DECAY = -0.5
FACTOR = 0.9 ** (1.0 / DECAY) - 1.0
MAX_INTERVAL_DAYS = 36500
MIN_STABILITY = 0.01
LEARN_AHEAD_MINUTES = 20
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619

MINUTE = 60_000_000
DAY = 86_400_000_000

MEMORY_TYPE = (
    "struct<stage:string,due:bigint,stability:double,difficulty:double,reps:int,lapses:int,last_review:bigint>"
)


def _n(x: float) -> str:
    return f"{x!r}D"


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def recall_sql(stability: str, days: str) -> str:
    """Chance of recall after `days`."""
    return (
        f"(CASE WHEN {stability} <= 0 THEN 0D "
        f"ELSE pow(1D + {_n(FACTOR)} * greatest(0D, {days}) / {stability}, {_n(DECAY)}) END)"
    )


def interval_sql(retention: float, stability: str) -> str:
    """Days until the chance of recall has fallen to `retention`."""
    return f"({stability} / {_n(FACTOR)} * {_n(retention ** (1.0 / DECAY) - 1.0)})"


def recall(stability: Column | str, days: Column | str) -> Column:
    s, d = (F.col(x) if isinstance(x, str) else x for x in (stability, days))
    return F.when(s <= 0, F.lit(0.0)).otherwise(
        F.pow(F.lit(1.0) + F.lit(FACTOR) * F.greatest(F.lit(0.0), d) / s, F.lit(DECAY))
    )


def interval_days(retention: Column | float, stability: Column) -> Column:
    r = retention if isinstance(retention, Column) else F.lit(float(retention))
    return stability / F.lit(FACTOR) * (F.pow(r, F.lit(1.0 / DECAY)) - F.lit(1.0))


def fnv_sql(text: str, start: str = f"{FNV_OFFSET}L") -> str:
    """FNV-1a, 32 bits, continued from `start`."""
    return f"aggregate(split({text}, ''), {start}, (h, c) -> ((h ^ ascii(c)) * {FNV_PRIME}L) & 4294967295L)"


def fnv1a(text: Column, start: Column | None = None) -> Column:
    return F.aggregate(
        F.split(text, ""),
        start if start is not None else F.lit(FNV_OFFSET).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(
            F.lit(4294967295).cast("long")
        ),
    )


def fuzz(days: Column, hash32: Column) -> Column:
    """Three days or more, spread by up to 5 % either way."""
    unit = (hash32 % 10000) / F.lit(9999.0)
    return F.when(days < 3, days).otherwise(days * (F.lit(0.95) + F.lit(0.1) * unit))


def whole_days(days: Column, hash32: Column, at_least: Column | float = 1.0) -> Column:
    lo = at_least if isinstance(at_least, Column) else F.lit(float(at_least))
    return F.least(F.lit(float(MAX_INTERVAL_DAYS)), F.greatest(F.lit(1.0), lo, F.rint(fuzz(days, hash32))))


def fresh_sql(due: str) -> str:
    """The memory of an item never reviewed."""
    return (
        f"named_struct('stage', 'New', 'due', {due}, 'stability', 0D, 'difficulty', 0D, 'reps', 0, 'lapses', 0, "
        "'last_review', CAST(NULL AS BIGINT))"
    )


def step_sql(m: str, ts: str, rating: str, seed_hash: str, retention: float = 0.9) -> str:
    """The memory after `m` was answered with `rating` (1 Again … 4 Easy) at `ts` (microseconds).

    `seed_hash` is the FNV state of `<item id>/`; the review number is hashed on top, so the spread is the same for
    the same item and review.
    """
    w = [_n(x) for x in W]
    clamp = lambda d: f"least(10D, greatest(1D, {d}))"
    d0 = lambda g: clamp(f"{w[4]} - exp({w[5]} * ({g} - 1)) + 1D")
    keep = lambda s: f"greatest({_n(MIN_STABILITY)}, {s})"
    days = lambda lo, s: (
        let("iv", interval_sql(retention, keep(s)),
            f"least({MAX_INTERVAL_DAYS}D, greatest(1D, {lo}, rint(CASE WHEN iv < 3 THEN iv ELSE iv * (0.95D + 0.1D * u) END)))")
    )
    same_day = lambda g: f"{m}.stability * exp({w[17]} * ({g} - 3D + {w[18]}))"
    grown = lambda bonus: f"{m}.stability * (1D + gain * {bonus})"
    forgot = (
        f"least({m}.stability, {w[11]} * pow({m}.difficulty, -{w[12]}) * (pow({m}.stability + 1D, {w[13]}) - 1D) "
        f"* exp({w[14]} * (1D - r)))"
    )
    # the stabilities each answer would give: again, hard, good, easy
    options = (
        f"CASE WHEN {m}.stage = 'New' THEN array({w[0]}, {w[1]}, {w[2]}, {w[3]}) "
        f"WHEN elapsed < 1 THEN array({same_day('1D')}, {same_day('2D')}, {same_day('3D')}, {same_day('4D')}) "
        f"ELSE "
        + let("r", recall_sql(f"{m}.stability", "elapsed"),
              let("gain",
                  f"exp({w[8]}) * (11D - {m}.difficulty) * pow({m}.stability, -{w[9]}) * (exp({w[10]} * (1D - r)) - 1D)",
                  f"array({forgot}, {grown(w[15])}, {grown('1D')}, {grown(w[16])})"))
        + " END"
    )
    drift = (
        f"{w[7]} * {d0('4D')} + (1D - {w[7]}) * "
        f"({m}.difficulty - {w[6]} * ({rating} - 3D) * (10D - {m}.difficulty) / 9D)"
    )
    difficulty = f"CASE WHEN {m}.stage = 'New' THEN {d0(rating)} ELSE {clamp(drift)} END"
    ordered = let(
        "hard", days("1D", "opts[1]"),
        let("good", days(f"hard + IF({m}.stage = 'Review', 1D, 0D)", "opts[2]"),
            f"CASE {rating} WHEN 2 THEN least(hard, good) WHEN 3 THEN good ELSE {days('good + 1D', 'opts[3]')} END"),
    )
    wait_days = (
        f"CASE WHEN {m}.stage = 'Review' OR {rating} = 4 THEN {ordered} ELSE {days('1D', f'opts[{rating} - 1]')} END"
    )
    stage = (
        f"CASE WHEN {m}.stage = 'Review' THEN IF({rating} = 1, 'Relearning', 'Review') "
        f"WHEN {rating} = 4 OR ({rating} = 3 AND {m}.stage <> 'New') THEN 'Review' "
        f"WHEN {m}.stage = 'Relearning' THEN 'Relearning' ELSE 'Learning' END"
    )
    minutes = (
        f"CASE WHEN {m}.stage IN ('Review', 'Relearning') THEN IF({rating} = 1, 10L, 6L) "
        f"ELSE CASE {rating} WHEN 1 THEN 1L WHEN 2 THEN 6L ELSE 10L END END"
    )
    wait = (
        f"IF(next_stage = 'Review', CAST({let('u', unit(f'{m}.reps', seed_hash), wait_days)} AS BIGINT) * {DAY}L, "
        f"{minutes} * {MINUTE}L)"
    )
    result = (
        f"named_struct('stage', next_stage, 'due', {ts} + {wait}, 'stability', {keep(f'opts[{rating} - 1]')}, "
        f"'difficulty', {difficulty}, 'reps', {m}.reps + 1, "
        f"'lapses', {m}.lapses + IF({m}.stage = 'Review' AND {rating} = 1, 1, 0), 'last_review', {ts})"
    )
    elapsed = f"CASE WHEN {m}.last_review IS NULL THEN 0D ELSE ({ts} - {m}.last_review) / {float(DAY)!r}D END"
    return let("elapsed", elapsed, let("opts", options, let("next_stage", stage, result)))


def unit(reps: str, seed_hash: str) -> str:
    """0..1 from the seed and the review number."""
    return f"({fnv_sql(f'CAST({reps} AS STRING)', seed_hash)} % 10000) / 9999D"


def fold_sql(log: str, start: str, seed_hash: str, retention: float = 0.9) -> str:
    """Memory after every review of `log` (array of struct(ts BIGINT, seq, rating INT), sorted)."""
    return f"aggregate({log}, {start}, (m, x) -> {step_sql('m', 'x.ts', 'x.rating', seed_hash, retention)})"


def is_due(stage: Column, due: Column, now: Column, tz: str = "UTC") -> Column:
    """Due now; items learned in days are due all of their (local) day."""
    day = lambda t: F.to_date(F.from_utc_timestamp(t, tz))
    return F.when(stage == "Review", day(due) <= day(now)).otherwise(due <= now)


def is_due_for_review(stage: Column, due: Column, now: Column, tz: str = "UTC") -> Column:
    """Due in a review session: short steps ending within 20 minutes count."""
    soon = now + F.expr(f"INTERVAL {LEARN_AHEAD_MINUTES} MINUTES")
    return F.when(stage.isin("Learning", "Relearning"), due <= soon).otherwise(is_due(stage, due, now, tz))


def format_interval(seconds: Column) -> Column:
    """10 min, 3 h, 4 d, 2.5 mo, 1.2 y."""
    whole = lambda x: F.rint(x).cast("long").cast("string")

    def one_place(x: Column) -> Column:
        tenths = F.round(x * 10).cast("long")
        frac = F.when(tenths % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("."), (tenths % 10).cast("string")))
        return F.concat(F.floor(tenths / 10).cast("string"), frac)

    m, h, d = seconds / 60.0, seconds / 3600.0, seconds / 86400.0
    return (
        F.when(m < 59.5, F.concat(F.greatest(F.lit(1), F.rint(m).cast("long")).cast("string"), F.lit(" min")))
        .when(h < 23.5, F.concat(whole(h), F.lit(" h")))
        .when(d < 30, F.concat(whole(d), F.lit(" d")))
        .when(d < 365, F.concat(one_place(d / 30.4), F.lit(" mo")))
        .otherwise(F.concat(one_place(d / 365.25), F.lit(" y")))
    )
