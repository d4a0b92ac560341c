"""Running values with null keys, null order values and null inputs, in buckets and in plain windows, against lists."""

import random

import pytest
from pyspark.sql import functions as F

from studyloom.plans.ordered import Running, by_index, number, scan

SPECS = ("sum", "sum_before", "max", "max_before", "last", "last_before", "next", "next_after", "lag", "lead")


def plain(rows, kind):
    """rows in order -> the running values of their last column."""
    v, out = [r[2] for r in rows], []
    for i in range(len(v)):
        upto, after = v[: i if kind.endswith("before") else i + 1], v[i + 1 :] if kind.endswith("after") else v[i:]
        some = [x for x in upto if x is not None]
        if kind.startswith("sum"):
            out.append(sum(some))
        elif kind.startswith("max"):
            out.append(max(some, default=None))
        elif kind.startswith("last"):
            out.append(some[-1] if some else None)
        elif kind.startswith("next"):
            out.append(next((x for x in after if x is not None), None))
        elif kind == "lag":
            out.append(v[i - 1] if i else None)
        else:
            out.append(v[i + 1] if i + 1 < len(v) else None)
    return out


@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("n", [13, 300])
def test_nulls_are_kept(spark, bounded, n):
    r = random.Random(n)
    rows = [(k, None if i == 0 else i, r.choice([None, 1, 5, -2, 7])) for k in (None, "a", "b") for i in range(n)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k string, i long, v long")
    got = scan(df, ["k"], ["i"], by_index("i", 8), [Running(s, s, F.col("v")) for s in SPECS], bounded).collect()
    assert len(got) == len(rows)
    by = {(g["k"], g["i"]): g for g in got}
    for k in (None, "a", "b"):
        own = [x for x in rows if x[0] == k]
        for s in SPECS:
            assert [by[x[:2]][s] for x in own] == plain(own, s), (k, s)
    places = number(df, ["k"], ["i"], by_index("i", 8), "n", bounded=bounded).collect()
    assert sorted((x["k"] or "", x["n"]) for x in places) == sorted((k or "", j) for k in (None, "a", "b") for j in range(n))


def test_making_a_scan_runs_no_job_and_its_plan_is_the_same_for_every_size(spark):
    def plan(n):
        df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"))
        spark.sparkContext.setJobGroup("scan", "scan")
        d = scan(df, ["k"], ["i"], by_index("i"), [Running("s", "sum", F.col("i"))])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("scan")
        ops = [line.strip(" +-:*()0123456789").split(" ")[0].split("(")[0] for line in d._jdf.queryExecution().sparkPlan().toString().splitlines()]
        return ops

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # Spark's own choice of joins by size
    try:
        assert plan(10) == plan(10_000_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
