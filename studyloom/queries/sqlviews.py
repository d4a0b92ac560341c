"""The derived views of `studyloom.plans.views` as DuckDB SQL, for checking queries against the same tables."""

from __future__ import annotations

from studyloom.functions.fsrs import W

NOW = "2024-01-31 00:00:00"

EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""

REVIEWS = (
    EV
    + """,
reviews AS (
  SELECT user_id AS learner_id, k % 4 AS item_id, ts, event_id AS seq,
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS rating
  FROM ev WHERE event_type <> 'signup')"""
)


def fnv(text: str) -> str:
    return (
        f"list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), "
        "lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"
    )


def memory_cte(source: str = "reviews") -> str:
    """Replays `source` one review per recursion: step(learner_id, item_id, n, …), memory(…)."""
    w = [f"{x!r}::DOUBLE" for x in W]
    factor = "(pow(0.9::DOUBLE, -2.0::DOUBLE) - 1.0::DOUBLE)"
    iv = lambda s: f"(greatest(0.01::DOUBLE, {s}) / {factor} * (pow(0.9::DOUBLE, -2.0::DOUBLE) - 1.0::DOUBLE))"
    fz = lambda s: (
        f"round_even(CASE WHEN {iv(s)} < 3 THEN {iv(s)} ELSE {iv(s)} * (0.95::DOUBLE + 0.1::DOUBLE * u) END, 0)"
    )
    d0 = lambda g: f"least(10.0::DOUBLE, greatest(1.0::DOUBLE, {w[4]} - exp({w[5]} * ({g} - 1)) + 1.0::DOUBLE))"
    return f"""logs AS (
  SELECT learner_id, item_id, epoch_us(ts) AS us, rating,
         row_number() OVER (PARTITION BY learner_id, item_id ORDER BY ts, seq) AS n FROM {source}),
step AS (
  SELECT learner_id, item_id, CAST(0 AS BIGINT) AS n, 'New' AS stage, CAST(0 AS BIGINT) AS due, 0.0::DOUBLE AS s,
         0.0::DOUBLE AS d, 0 AS reps, 0 AS lapses, CAST(NULL AS BIGINT) AS last_us
  FROM logs WHERE n = 1
  UNION ALL
  SELECT learner_id, item_id, n, next_stage,
         us + CASE WHEN next_stage = 'Review' THEN CAST(CASE WHEN stage = 'Review' OR rating = 4 THEN
                CASE rating WHEN 2 THEN least(hard, good) WHEN 3 THEN good
                  ELSE least(36500, greatest(1.0::DOUBLE, good + 1, {fz('s4')})) END
                ELSE least(36500, greatest(1.0::DOUBLE, {fz('CASE rating WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END')})) END AS BIGINT) * 86400000000
              ELSE 60000000 * CASE WHEN stage IN ('Review', 'Relearning') THEN CASE rating WHEN 1 THEN 10 ELSE 6 END
                ELSE CASE rating WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 10 END END END,
         greatest(0.01::DOUBLE, CASE rating WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END),
         CASE WHEN stage = 'New' THEN {d0('rating')}
              ELSE least(10.0::DOUBLE, greatest(1.0::DOUBLE, {w[7]} * {d0('4.0::DOUBLE')} + (1.0::DOUBLE - {w[7]}) *
                   (d - {w[6]} * (rating - 3) * (10.0::DOUBLE - d) / 9.0::DOUBLE))) END,
         reps + 1, lapses + CASE WHEN stage = 'Review' AND rating = 1 THEN 1 ELSE 0 END, us
  FROM (
    SELECT *, least(36500, greatest(1.0::DOUBLE, hard + CASE WHEN stage = 'Review' THEN 1 ELSE 0 END, {fz('s3')})) AS good,
      CASE WHEN stage = 'Review' THEN CASE WHEN rating = 1 THEN 'Relearning' ELSE 'Review' END
           WHEN rating = 4 OR (rating = 3 AND stage <> 'New') THEN 'Review'
           WHEN stage = 'Relearning' THEN 'Relearning' ELSE 'Learning' END AS next_stage
    FROM (SELECT *, least(36500, greatest(1.0::DOUBLE, {fz('s2')})) AS hard FROM (
      SELECT *,
        CASE WHEN stage = 'New' THEN {w[0]} WHEN elapsed < 1 THEN s * exp({w[17]} * (1 - 3 + {w[18]}))
             ELSE least(s, {w[11]} * pow(d, -{w[12]}) * (pow(s + 1.0::DOUBLE, {w[13]}) - 1.0::DOUBLE) * exp({w[14]} * (1.0::DOUBLE - r))) END AS s1,
        CASE WHEN stage = 'New' THEN {w[1]} WHEN elapsed < 1 THEN s * exp({w[17]} * (2 - 3 + {w[18]})) ELSE s * (1.0::DOUBLE + gain * {w[15]}) END AS s2,
        CASE WHEN stage = 'New' THEN {w[2]} WHEN elapsed < 1 THEN s * exp({w[17]} * (3 - 3 + {w[18]})) ELSE s * (1.0::DOUBLE + gain) END AS s3,
        CASE WHEN stage = 'New' THEN {w[3]} WHEN elapsed < 1 THEN s * exp({w[17]} * (4 - 3 + {w[18]})) ELSE s * (1.0::DOUBLE + gain * {w[16]}) END AS s4
      FROM (SELECT *, CASE WHEN s > 0 THEN exp({w[8]}) * (11.0::DOUBLE - d) * pow(s, -{w[9]}) * (exp({w[10]} * (1.0::DOUBLE - r)) - 1.0::DOUBLE) ELSE 0 END AS gain
      FROM (SELECT *, CASE WHEN s > 0 THEN pow(1.0::DOUBLE + {factor} * greatest(0, elapsed) / s, -0.5::DOUBLE) ELSE 0 END AS r
      FROM (SELECT st.learner_id, st.item_id, l.n, st.stage, st.due, st.s, st.d, st.reps, st.lapses, l.us, l.rating,
              CASE WHEN st.last_us IS NULL THEN 0.0::DOUBLE ELSE (l.us - st.last_us) / 86400000000.0::DOUBLE END AS elapsed,
              ({fnv("concat(st.learner_id, '-', st.item_id, '/', st.reps)")} % 10000) / 9999.0::DOUBLE AS u
            FROM step st JOIN logs l ON l.learner_id = st.learner_id AND l.item_id = st.item_id AND l.n = st.n + 1)))))))
,
memory AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY learner_id, item_id ORDER BY n DESC) = 1)"""


MEMORY = REVIEWS + ",\n" + memory_cte()


def due_for_review(stage: str = "stage", due_us: str = "due") -> str:
    """Due at NOW in a review session (UTC days)."""
    now = f"epoch_us(TIMESTAMP '{NOW}')"
    return (
        f"CASE WHEN {stage} IN ('Learning', 'Relearning') THEN {due_us} <= {now} + 1200000000 "
        f"WHEN {stage} = 'Review' THEN {due_us} // 86400000000 <= {now} // 86400000000 ELSE {due_us} <= {now} END"
    )


QUESTIONS = """questions AS (
  SELECT user_id AS learner_id, k % 4 AS item_id, k % 3 AS q, k % 3 < 2 AS is_choice,
         max(CASE WHEN event_type = 'click' THEN ts END) AS last_asked
  FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL)"""

NEW_CARDS = """new_cards AS (
  SELECT user_id AS learner_id, 'n' || event_id AS card_id, ts AS created_utc, k AS segment
  FROM ev WHERE event_type IN ('signup', 'purchase'))"""

SEGMENTS = (
    EV
    + """,
seg0 AS (
  SELECT user_id AS paper_id, ts, event_id, event_type, k, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM ev),
segments AS (
  SELECT paper_id, idx, CASE WHEN event_type = 'signup' THEN 'heading' ELSE 'sentence' END AS kind,
         CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY idx) AS BIGINT) AS section,
         idx // 10 AS page,
         CASE WHEN event_type = 'purchase' THEN 'E' || (k % 5) END AS own_visual,
         CASE WHEN event_type = 'error' THEN 'E' || (k % 5) END AS ref_visual,
         concat_ws(' ', 'Equation', k % 7, event_type, CAST(trunc(value) AS INTEGER)) AS say, k, ts, event_id
  FROM seg0),
clips AS (
  SELECT paper_id, idx, CAST(floor(400 + 1000.0::DOUBLE * (k + 1) / 15) AS BIGINT) AS duration_ms FROM segments WHERE idx % 17 <> 3)"""
)


def rec(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
