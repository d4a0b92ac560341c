"""What several operators share: stored steps, bounded slices of texts, gapless numbers within hot keys."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: white space of every contract here: U+0020 and U+0009 to U+000D
SPACE = " \t\n\x0b\x0c\r"
#: a word, as Java and Python read it
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
#: A-Z to a-z, byte by byte: no other character of UTF-8 has such a byte
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: what str.split takes for white space and the contracts don't
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def lower_words(text: str) -> list[str]:
    """The words of a text, A-Z in lower case."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    return [w for w in SPACES.split(low) if w] if ODD_SPACE.search(low) else low.split()


class WordHashes:
    """64-bit hashes of words; a bounded number of those met is kept."""

    def __init__(self, most: int = 300_000, longest: int = 64) -> None:
        self.kept: dict[str, int] = {}
        self.most, self.longest = most, longest

    def __call__(self, words: list[str]) -> list[int]:
        kept, out = self.kept, []
        if len(kept) > self.most:
            kept.clear()
        for w in words:
            h = kept.get(w)
            if h is None:
                h = xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                if len(w) <= self.longest:
                    kept[w] = h
            out.append(h)
        return out


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of its own only where that is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-llm-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, its lineage cut, readable after any executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What a finished task has freed goes back to the system, so that workers that wait for work hold little."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidily(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`step` of a mapInArrow, its memory given back at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose `column` holds about `limit` bytes, or one row where that alone is longer."""
    sizes = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, bucket: Column) -> DataFrame:
    """`df` with `name`: gapless from 0 within `keys`, in the order of (`bucket`, `order`).

    One key may hold any share of the rows. Rows are shuffled by (keys, bucket) and numbered there; only one count per
    (keys, bucket) is summed up in order per key. `bucket` is a non-null long of bounded range that never falls in the
    wanted order. Rows alike in `order` take their numbers in any order.
    """
    keys = list(keys)
    b, offset = "_bucket", "_offset"
    d = df.withColumn(b, bucket)
    within = Window.partitionBy(*keys, b).orderBy(*order)
    d_no = d.withColumn(name, F.row_number().over(within).cast("long"))
    counts = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(offset)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(b).alias("_b"), ahead)
    on = F.col(b) == F.col("_b")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return d_no.join(offsets, on).withColumn(name, F.col(name) - 1 + F.col(offset)).drop(b, "_b", offset, *[f"_k_{k}" for k in keys])
