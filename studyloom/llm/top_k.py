"""Exact top-k search by inner product, as a Voronoi kNN join.

Vectors are lifted by one coordinate so that the nearest rows by distance are those of the largest inner product: a row r
gets sqrt(M - |r|^2), with M the largest squared length, and a query gets 0, so |q' - r'|^2 = |q|^2 + M - 2 q.r. Pivots
cut the lifted space into cells. From a summary of each cell (its k + 1 shortest distances to the pivot, the longest one
among its queries) follows a distance within which every query of a cell finds k rows. A row is sent to a group of query
cells only if the triangle inequality can't rule it out for one of them. Groups are solved in blocks of bounded size, and
the blocks' best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.common import stored


@dataclass(frozen=True)
class Sizes:
    """Pivots (a bounded sample of rows), and the most queries and rows that one task multiplies."""

    pivots: int = 64
    queries: int = 2048
    rows: int = 32768


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component; vectors that are null or hold null or non-finite ones take no part."""
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable)
    return d.groupBy("id").agg(F.min(F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("long"))).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to `width`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    out = np.zeros((len(column), width), np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()] if len(column) else np.zeros(0)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = values
    return out


def to_pivots(v: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to the lifted pivots."""
    x = np.column_stack([v, last])
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows but its own; ties to the smaller id."""
    by = np.argsort(ids, kind="stable")
    ids, rows = ids[by], rows[by]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    large = max(np.abs(q).max(initial=0), 1) * max(np.abs(rows).max(initial=0), 1) * max(q.shape[1], 1) >= 2**53
    if large:  # beyond what doubles hold exactly
        q, rows = q.astype(np.int64), rows.astype(np.int64)
    lowest = np.iinfo(np.int64).min
    for b in range(0, len(q_ids), 64):
        scores = (q[b : b + 64] @ rows.T).astype(np.int64)
        scores[q_ids[b : b + 64, None] == ids[None, :]] = lowest
        for i, s in enumerate(scores):
            m = min(k, int((s != lowest).sum()))
            if not m:
                continue
            least = np.partition(s, len(s) - m)[len(s) - m]
            above = np.flatnonzero(s > least)
            level = np.flatnonzero(s == least)[: m - len(above)]  # ids are in order
            at = np.concatenate([above, level])
            out.append((np.full(m, q_ids[b + i]), ids[at], s[at]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64, sizes: Sizes = Sizes()) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that `is_query` (a condition on `id`, the key as a long) its k best.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null key. Vectors of
    different lengths are filled up with zeros. Rows that repeat a key are one row, with the least of their vectors. A
    query with fewer than k other rows gets them all; an empty table gives none. Scores must fit a long.
    """
    spark = vectors.sparkSession
    d = stored(quantised(vectors, key, vector, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, queries, longest, width = d.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(square), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not queries:
        return spark.createDataFrame([], schema)
    first = d.orderBy(F.xxhash64("id"), "id").limit(min(sizes.pivots, max(1, int(n**0.5)))).toPandas()
    raw = np.zeros((len(first), width))
    for i, v in enumerate(first["v"]):
        raw[i, : len(v)] = v
    lift = lambda v: np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
    pivots = np.column_stack([raw, lift(raw)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), width)
            far = to_pivots(v, lift(v), pivots)
            as_query = to_pivots(v, np.zeros(len(v)), pivots)
            cells = {"cell": far.argmin(axis=1), "far": far.min(axis=1, initial=np.inf), "q_cell": as_query.argmin(axis=1), "q_far": as_query.min(axis=1, initial=np.inf)}
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "v": b.column("v"), "query": b.column("query")} | {c: pa.array(x) for c, x in cells.items()})

    placed = d.withColumn("query", is_query).mapInArrow(dealt, "id long, v array<long>, query boolean, cell long, far double, q_cell long, q_far double")
    placed = stored(placed, "cells")
    near = placed.select("cell", "far", F.row_number().over(Window.partitionBy("cell").orderBy("far")).alias("n")).filter(F.col("n") <= k + 1).toPandas()
    asked = placed.filter("query").groupBy("q_cell").agg(F.max("q_far").alias("far"), F.count(F.lit(1)).alias("n")).toPandas()

    # the driver holds pivots, and k + 1 numbers of each cell: bounded by `pivots` alone
    p = len(pivots)
    apart = to_pivots(pivots[:, :-1], pivots[:, -1], pivots)
    slack = 1e-6 * (1 + np.sqrt(longest) * 4)  # roundings must not rule a row out
    low, high = np.full((p, p), np.inf), np.full((p, p), -np.inf)
    for c, reach in zip(asked["q_cell"], asked["far"], strict=True):
        ub = np.sort(apart[c, near["cell"].to_numpy()] + reach + near["far"].to_numpy())
        within = ub[k] if len(ub) > k else np.inf
        low[c], high[c] = apart[c] - reach - within - slack, apart[c] + reach + within + slack
    # query cells go into groups of about `queries`, neighbours together
    group, held, groups = np.zeros(p, np.int64), 0, 0
    todo = dict(zip(asked["q_cell"], asked["n"], strict=True))
    at = max(todo, key=todo.get)
    while todo:
        m = todo.pop(at)
        if held and held + m > sizes.queries:
            groups, held = groups + 1, 0
        group[at], held = groups, held + m
        if todo:
            at = min(todo, key=lambda c: (apart[at, c], c))
    groups += 1
    asked["group"] = group[asked["q_cell"].to_numpy()]
    q_blocks = np.zeros(groups, np.int64)
    for g, m in asked.groupby("group")["n"].sum().items():
        q_blocks[g] = -(-m // sizes.queries)
    d_blocks = -(-n // sizes.rows)
    low_g = np.full((groups, p, p), np.inf)
    high_g = np.full((groups, p, p), -np.inf)
    for c in asked["q_cell"]:
        low_g[group[c], c], high_g[group[c], c] = low[c], high[c]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to the groups that may need them, once for each block of queries."""
        for b in batches:
            cell, far, ids = (b.column(c).to_numpy() for c in ("cell", "far", "id"))
            block = (ids * 2654435761 & 0xFFFFFFFF) % d_blocks
            for g in range(groups):
                need = np.flatnonzero(((far >= low_g[g][:, cell]) & (far <= high_g[g][:, cell])).any(axis=0))
                part = b.select(["id", "v"]).take(pa.array(need))
                for qb in range(q_blocks[g]):
                    fixed = {"group": np.full(len(need), g), "q_block": np.full(len(need), qb), "d_block": block[need]}
                    yield pa.RecordBatch.from_pydict({c: pa.array(x.astype(np.int64)) for c, x in fixed.items()} | {"id": part.column("id"), "v": part.column("v")})

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to every block of rows of their group."""
        for b in batches:
            ids, g = b.column("id").to_numpy(), group[b.column("q_cell").to_numpy()]
            qb = (ids * 2654435761 >> 7 & 0xFFFFFF) % q_blocks[g]
            for block in range(d_blocks):
                fixed = {"group": g, "q_block": qb, "d_block": np.full(len(ids), block)}
                yield pa.RecordBatch.from_pydict({c: pa.array(x.astype(np.int64)) for c, x in fixed.items()} | {"id": b.column("id"), "v": b.column("v")})

    def solved(_: tuple, q: pa.Table, rows: pa.Table) -> pa.Table:
        a, b, s = best(q.column("id").to_numpy(), matrix(q.column("v"), width), rows.column("id").to_numpy(), matrix(rows.column("v"), width), k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())})

    keys, kind = ["group", "q_block", "d_block"], "group long, q_block long, d_block long, id long, v array<long>"
    q = placed.filter("query").mapInArrow(asking, kind).groupBy(*keys)
    rows = placed.mapInArrow(sent, kind).groupBy(*keys)
    found = q.cogroup(rows).applyInArrow(solved, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
