"""Running values over an ordered sequence whose key may hold any share of the rows.

`Window.partitionBy(key)` puts a whole key into one task: a paper or learner holding a third of all rows would stall
the job. So the sequence of a key is cut into buckets by an order-preserving expression (`idx div 1024`, a day). Rows are
shuffled by (key, bucket); each bucket is reduced to one carry row by a map-side combined aggregate; only the carry
rows, a thousandth of the input, are scanned per key; and the carry is joined back by (key, bucket), where the
row-level windows run without another exchange. There is this one plan for every size of input, and making it runs no job.
Nulls are values like others: a null key is one key, null order values come first, and they share a bucket.

Keys that are small by their nature (the lines of one printed page) are declared `bounded`, and get plain windows.

The input of a scan is read twice; operators that scan what they scanned cut the lineage between the two.

The bucket expression must be monotone in the order columns: a row of a later bucket sorts after every row of an
earlier one. The order columns must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
DAY_MICROS = 86_400_000_000


def by_index(col: str, width: int = 1024) -> Column:
    """Bucket for a dense integer ordinal."""
    return F.floor(F.col(col) / F.lit(width)).cast("long")


def by_day(col: str) -> Column:
    """Bucket for a timestamp: its UTC day."""
    return F.floor(F.unix_micros(F.col(col)) / F.lit(DAY_MICROS)).cast("long")


@dataclass(frozen=True)
class Running:
    """One running column.

    kind: `sum` / `sum_before` (this row in or out), `max` / `max_before`, `last` / `last_before` (forward fill of
    non-null values), `next` / `next_after` (backward fill), `lag`, `lead`.
    """

    name: str
    kind: str
    value: Column


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, specs: Sequence[Running], bounded: bool = False) -> DataFrame:
    """`df` with one column per spec. See the module docstring for the plan."""
    return _scan_whole(df, keys, order, specs) if bounded else _scan_buckets(df, keys, order, bucket, specs)


def _scan_whole(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[Running]) -> DataFrame:
    pos = [F.col(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*pos)
    rev = Window.partitionBy(*keys).orderBy(*[p.desc() for p in pos])
    out = {}
    for s in specs:
        to = -1 if s.kind.endswith(("_before", "_after")) else 0
        upto, from_end = (x.rowsBetween(Window.unboundedPreceding, to) for x in (w, rev))
        if s.kind.startswith("sum"):
            out[s.name] = F.coalesce(F.sum(s.value).over(upto), F.lit(0))
        elif s.kind.startswith("max"):
            out[s.name] = F.max(s.value).over(upto)
        elif s.kind.startswith("last"):
            out[s.name] = F.last(s.value, ignorenulls=True).over(upto)
        elif s.kind.startswith("next"):
            out[s.name] = F.last(s.value, ignorenulls=True).over(from_end)
        elif s.kind == "lag":
            out[s.name] = F.lag(s.value).over(w)
        elif s.kind == "lead":
            out[s.name] = F.lead(s.value).over(w)
        else:
            raise ValueError(s.kind)
    return df.withColumns(out)


def _scan_buckets(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, specs: Sequence[Running]
) -> DataFrame:
    keys, order = list(keys), list(order)
    vals = {f"_v_{s.name}": s.value for s in specs}
    d = df.withColumn(BUCKET, bucket).withColumns(vals)
    pos = [F.col(c) for c in order]
    aggs = []
    for s in specs:
        v, t = F.col(f"_v_{s.name}"), f"_t_{s.name}"
        tagged = F.struct(*pos, v.alias("v"))
        if s.kind.startswith("sum"):
            aggs.append(F.sum(v).alias(t))
        elif s.kind.startswith("max"):
            aggs.append(F.max(v).alias(t))
        elif s.kind.startswith("last"):
            aggs.append(F.max(F.when(v.isNotNull(), tagged)).alias(t))
        elif s.kind.startswith("next"):
            aggs.append(F.min(F.when(v.isNotNull(), tagged)).alias(t))
        elif s.kind == "lag":
            aggs.append(F.max(tagged).alias(t))
        elif s.kind == "lead":
            aggs.append(F.min(tagged).alias(t))
        else:
            raise ValueError(s.kind)
    totals = d.groupBy(*keys, BUCKET).agg(*aggs)

    back = Window.partitionBy(*keys).orderBy(BUCKET)
    before = back.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc())
    after = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for s in specs:
        t, c = F.col(f"_t_{s.name}"), f"_c_{s.name}"
        if s.kind.startswith("sum"):
            e = F.coalesce(F.sum(t).over(before), F.lit(0))
        elif s.kind.startswith("max"):
            e = F.max(t).over(before)
        elif s.kind.startswith("last"):
            e = F.last(t, ignorenulls=True).over(before)["v"]
        elif s.kind.startswith("next"):
            e = F.last(t, ignorenulls=True).over(after)["v"]
        elif s.kind == "lag":
            e = F.lag(t).over(back)["v"]
        else:
            e = F.lag(t).over(ahead)["v"]
        carries.append(e.alias(c))
    part = [*keys, BUCKET]
    carry = totals.select(*[F.col(k).alias(f"_k_{k}") for k in part], *carries)
    row = Window.partitionBy(*part).orderBy(*pos)
    rev = Window.partitionBy(*part).orderBy(*[p.desc() for p in pos])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in part]
    j = d.join(carry, reduce(and_, same)).drop(*[f"_k_{k}" for k in part])
    out = {}
    for s in specs:
        v, c = F.col(f"_v_{s.name}"), F.col(f"_c_{s.name}")
        w, back_w = (row, rev)
        to = -1 if s.kind.endswith(("_before", "_after")) else 0
        if s.kind.startswith("sum"):
            out[s.name] = c + F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, to)), F.lit(0))
        elif s.kind.startswith("max"):
            out[s.name] = F.greatest(c, F.max(v).over(w.rowsBetween(Window.unboundedPreceding, to)))
        elif s.kind.startswith("last"):
            out[s.name] = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, to)), c)
        elif s.kind.startswith("next"):
            out[s.name] = F.coalesce(
                F.last(v, ignorenulls=True).over(back_w.rowsBetween(Window.unboundedPreceding, to)), c
            )
        elif s.kind == "lag":
            prev = F.lag(F.struct(v.alias("v"))).over(w)
            out[s.name] = F.when(prev.isNotNull(), prev["v"]).otherwise(c)
        else:
            nxt = F.lead(F.struct(v.alias("v"))).over(w)
            out[s.name] = F.when(nxt.isNotNull(), nxt["v"]).otherwise(c)
    return j.withColumns(out).drop(*vals, *[f"_c_{s.name}" for s in specs], BUCKET)


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str, start: int = 0, bounded: bool = False) -> DataFrame:
    """Dense position within the key (`start`, `start`+1, …)."""
    d = scan(df, keys, order, bucket, [Running(name, "sum_before", F.lit(1).cast("long"))], bounded)
    return d.withColumn(name, (F.col(name) + F.lit(start)).cast("long"))
