"""FSRS values and invariants; the three forms of the update agree."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from studyloom.functions import fsrs
from studyloom.functions.fsrs_arrays import Memories, reviewed
from studyloom.operators import memory, review
from studyloom.plans import views
from studyloom.streaming import steps

SF = "/root/testdata/sf0.001"
T0 = int(dt.datetime(2026, 9, 1, 9, tzinfo=dt.timezone.utc).timestamp() * 1e6)
NEW = ("New", T0, 0.0, 0.0, 0, 0, None)


def days(m, at):
    return (m[1] - at) / fsrs.DAY


def test_recall_and_interval(spark):
    r = spark.range(1).select(
        fsrs.recall(F.lit(12.0), F.lit(12.0)).alias("r"), fsrs.interval_days(0.9, F.lit(12.0)).alias("i"), fsrs.interval_days(0.95, F.lit(12.0)).alias("j")
    ).first()
    assert abs(r.r - 0.9) < 1e-12 and abs(r.i - 12) < 1e-9 and r.j < 12


def test_first_steps():
    assert steps.review(NEW, T0, 1, "c")[1] == T0 + fsrs.MINUTE
    good = steps.review(NEW, T0, 3, "c")
    assert good[0] == "Learning" and good[1] == T0 + 10 * fsrs.MINUTE
    again = steps.review(good, good[1], 3, "c")
    assert again[0] == "Review" and days(again, good[1]) >= 1
    easy = steps.review(NEW, T0, 4, "c")
    assert easy[0] == "Review" and easy[1] > again[1]


def test_lapse_and_order():
    m = steps.review(NEW, T0, 4, "c")
    at = m[1]
    nxt = [steps.review(m, at, r, "c") for r in (1, 2, 3, 4)]
    assert nxt[0][1] < nxt[1][1] < nxt[2][1] < nxt[3][1]
    assert nxt[0][0] == "Relearning" and nxt[0][5] == 1 and nxt[0][2] < m[2] and nxt[0][3] > m[3] and nxt[0][1] == at + 10 * fsrs.MINUTE
    assert steps.review(nxt[0], nxt[0][1], 3, "c")[0] == "Review"
    late = steps.review(m, at + 20 * fsrs.DAY, 3, "c")
    assert late[2] > nxt[2][2]


def test_interval_labels(spark):
    s = [600, 4 * 86400, 61 * 86400, 548 * 86400]
    got = spark.createDataFrame([(float(x),) for x in s], "s double").select(fsrs.format_interval(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["10 min", "4 d", "2 mo", "1.5 y"]


def test_python_step_equals_column_fold(spark):
    r = views.reviews(spark, SF)
    logs = {}
    for row in r.select("learner_id", "item_id", F.unix_micros("ts").alias("ts"), "seq", "rating").collect():
        logs.setdefault((row.learner_id, row.item_id), []).append((row.ts, row.seq, row.rating))
    for row in memory.replay(r).collect():
        log = sorted(logs[row.learner_id, row.item_id])
        m = ("New", log[0][0], 0.0, 0.0, 0, 0, None)
        for ts, _, rating in log:
            m = steps.review(m, ts, rating, f"{row.learner_id}-{row.item_id}")
        assert tuple(row.memory)[:2] == m[:2] and abs(row.memory.stability - m[2]) < 1e-9 and abs(row.memory.difficulty - m[3]) < 1e-9
        assert tuple(row.memory)[4:] == m[4:]


def folded(log, item):
    log = sorted(log)
    m = ("New", log[0][0], 0.0, 0.0, 0, 0, None)
    for ts, _, rating in log:
        m = steps.review(m, ts, rating, item)
    return m


def close(a, b):
    near = lambda x, y: x == y or isinstance(x, float) and abs(x - y) < 1e-9 * max(1.0, abs(x))
    return len(a) == len(b) and all(map(near, a, b))


def test_array_steps_equal_single_ones():
    rng = np.random.default_rng(2)
    n, ts = 400, T0
    m, seed = Memories.fresh(np.full(n, T0)), np.array([steps.fnv1a(f"{i}/") for i in range(n)])
    rows = [NEW] * n
    for _ in range(130):
        ts = ts + rng.choice([fsrs.MINUTE, fsrs.DAY // 2, 3 * fsrs.DAY, 400 * fsrs.DAY], n)
        rating = rng.integers(1, 5, n)
        m = reviewed(m, ts, rating, seed)
        rows = [steps.review(r, int(t), int(g), str(i)) for i, (r, t, g) in enumerate(zip(rows, ts, rating, strict=True))]
        assert all(close(m.row(i), rows[i]) for i in range(n))


def test_replay_over_batches_and_from_memories(spark):
    """Items cut by batches anywhere, with and without earlier memories, null keys, answers that can't be read."""
    r = random.Random(8)
    log = [(k, g, dt.datetime(2026, 1, 1) + dt.timedelta(hours=r.randint(0, 90_000)), i, r.randint(1, 4)) for k in (1, 2, None) for g in ("a", "b", None) for i in range(r.choice([1, 2, 40]))]
    bad = [(1, "a", None, 900, 3), (9, "z", dt.datetime(2026, 1, 1), 901, None), (9, "z", dt.datetime(2026, 1, 1), 902, 7)]
    schema = "k long, g string, ts timestamp, seq long, rating int"
    name = lambda k, g: "-".join(str(x) for x in (k, g) if x is not None)
    micros = lambda t: int(t.replace(tzinfo=dt.UTC).timestamp() * 1_000_000 + 0.5)
    logs = {}
    for k, g, ts, seq, rating in log:
        logs.setdefault((k, g), []).append((micros(ts), seq, rating))
    want = {key: folded(v, name(*key)) for key, v in logs.items()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            d = spark.createDataFrame(log + bad, schema)
            whole = {(x.k, x.g): tuple(x.memory) for x in memory.replay(d, ["k", "g"]).collect()}
            assert whole.keys() == want.keys() and all(close(whole[x], want[x]) for x in want)
            cut = F.lit("2031-01-01").cast("timestamp")
            then = memory.replay(d.filter(F.col("ts") < cut), ["k", "g"])
            both = {(x.k, x.g): tuple(x.memory) for x in memory.replay(d.filter(F.col("ts") >= cut), ["k", "g"], prior=then).collect()}
            assert both.keys() == want.keys() and all(close(both[x], want[x]) for x in want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_item_of_fifty_thousand_reviews(spark):
    d = spark.range(50_000).selectExpr("1L learner_id", "7 item_id", "timestamp_seconds(1700000000 + id * 3600) ts", "id seq", "cast(1 + id % 4 as int) rating")
    plan = memory.replay(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan
    got = [tuple(x.memory) for x in memory.replay(d).collect()]
    want = folded([((1_700_000_000 + i * 3600) * 1_000_000, i, 1 + i % 4) for i in range(50_000)], "1-7")
    assert len(got) == 1 and close(got[0], want)


def test_invariants(spark):
    assert all(1 <= x.memory.difficulty <= 10 and x.memory.stability >= 0.01 for x in memory.replay(views.reviews(spark, SF)).collect())


def test_queue_order_and_new_limit(spark):
    now = dt.datetime(2026, 9, 1, 9)
    day = dt.timedelta(days=1)
    base = dict(learner_id=1, item_kind="card", created_utc=now - 100 * day, segment=0)
    rows = [
        dict(base, item_key="slight", stage="Review", due=now - day, stability=10.0, last_review=now - 11 * day),
        dict(base, item_key="late", stage="Review", due=now - 30 * day, stability=10.0, last_review=now - 40 * day),
        dict(base, item_key="step", stage="Learning", due=now, stability=1.0, last_review=now - day),
        dict(base, item_key="later", stage="Review", due=now + 9 * day, stability=10.0, last_review=now - day),
    ] + [dict(base, item_key=f"new {i:02d}", stage="New", due=now, stability=0.0, last_review=None, segment=i) for i in range(25)]
    schema = "learner_id long, item_key string, item_kind string, stage string, due timestamp, stability double, last_review timestamp, created_utc timestamp, segment int"
    items = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    at = F.lit("2026-09-01 09:00:00").cast("timestamp")
    q = [r.item_key for r in review.review_queue(items, at).orderBy("position").collect()]
    assert q[:4] == ["step", "late", "slight", "new 00"] and len(q) == 23
    assert review.due_count(items, at).first().due_count == 23


def test_pick_question(spark):
    t = dt.datetime(2026, 1, 1)
    q = spark.createDataFrame(
        [(1, 0, True, t + dt.timedelta(days=3)), (1, 1, False, t), (1, 2, True, None)], "idea int, q int, is_choice boolean, last_asked timestamp"
    )
    assert review.pick_question(q, ["idea"], "q").first().q == 1
    assert review.pick_question(q, ["idea"], "q", choice_only=True).first().q == 2
    out = spark.createDataFrame([(1, 2)], "idea int, q int")
    assert review.pick_question(q, ["idea"], "q", choice_only=True, exclude=out).first().q == 0


def test_a_script_is_made_once_for_a_query(spark, monkeypatch):
    """stops and learners are made from one narrated script."""
    from studyloom.queries import study as queries

    made = []

    def shown(*given, make=queries.shown):
        made.append(given)
        return make(*given)

    monkeypatch.setattr(queries, "shown", shown)
    for query in (queries.next_steps, queries.minutes_left):
        made.clear()
        query(spark, "/root/testdata/sf0.001")
        assert len(made) == 1


def test_the_lines_of_a_plan_are_read_once(spark):
    """what is joined afterwards reads stored lines; no join cuts the replies again."""
    from studyloom.queries import study as queries

    d = queries.plans_parsed(spark, "/root/testdata/sf0.001")
    assert "posexplode" not in d._jdf.queryExecution().optimizedPlan().toString()
