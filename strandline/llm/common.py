"""Helpers that several operators share: tables, written intermediates, Arrow batches."""

from __future__ import annotations

import gc
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.shared import remove, shared_dir, written  # noqa: F401

#: Words of the near-duplicate, substring and mixing operators: runs of bytes other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column | str) -> Column:
    """A-Z in lower case, every other letter as it is (lower() would change those too)."""
    return F.translate(column, _UPPER, _LOWER)


def free_name(taken, name: str) -> str:
    """name, or with as many _ behind it as it takes not to be one of taken (columns' names, in any case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_at)


def cells_for(spark: SparkSession, size: int, each: int = 16 << 20) -> int:
    """Groups to deal size bytes to, so that one has about ``each`` bytes, however large the data; as many as there are shuffle partitions at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // each))


def by_cell(cell: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each cell that occurs, and where, in order of place."""
    if not len(cell):
        return []
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(np.append(True, cell[order[1:]] != cell[order[:-1]]))
    return [(int(cell[order[a]]), order[a:b]) for a, b in zip(edges, np.append(edges[1:], len(cell)), strict=True)]


def small(table: DataFrame, width: Column, limit: int = 64 << 20) -> DataFrame:
    """A written table, to be broadcast if its rows (width: bytes of each, about) take at most limit bytes, else sorted and merged."""
    size = table.agg(F.sum(width).alias("n")).first().n or 0
    return F.broadcast(table) if size <= limit else table.hint("merge")


def some_rows(df: DataFrame, n: int, each: int | None = None) -> DataFrame:
    """About n rows of df (all, if it has fewer), or one in ``each`` if these are more. For choices that results don't depend on."""
    total = df.count()
    n = max(n, total // each) if each else n
    return df if total <= n else df.sample(fraction=n / total, seed=17)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps whose results are written: it does so when the driver collects garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row's bytes start (one more entry than rows). Null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch with about limit bytes of text each (a longer text has a slice of its own), so that work arrays stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def code_points(names) -> list:
    """Names in code point order, null last."""
    return sorted((n for n in names if n is not None), key=lambda s: [ord(c) for c in s]) + [n for n in names if n is None]


def plain_words(text: str | None) -> list[str]:
    return re.findall(WORD, text or "", re.ASCII)
