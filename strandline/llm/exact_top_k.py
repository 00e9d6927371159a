"""Exact top-k search by inner product over a vector-approximation file.

Vectors are quantised to integers floor(256 x). The approximation replaces each component by its cell among
``cells`` cells of equal width between the column's smallest and largest value. A cell's edges bound the component, so two
sums bound the inner product with a query. Candidates travel as cells (a byte a component) in blocks, queries in blocks,
and each query block meets each candidate block once by an equi-join on the block number: a query set against all rows.

A block keeps, for each query, the candidates whose upper bound reaches the k-th largest lower bound there; the k-th
largest lower bound over all blocks then leaves few. Their exact vectors are read in the order of their upper bounds, in
waves of growing size: a wave joins the next candidates of every query that isn't certain yet, and a query is certain
once no upper bound left reaches its k-th score. So vectors beyond that are never read, and no task holds a query's.

Equal vectors are one candidate that stands for its k + 1 smallest ids (k besides the query itself), so a vector that
thousands of rows share costs no more than one.

Defined results: a null vector, one with a null or non-finite component and one without components take no part, and a
query only meets vectors of its own length; rows that share a vec_id are one row, with the smallest vector; null ids
take no part; fewer candidates than k give fewer rows; ties go to the smaller id; other columns are ignored; an empty
table gives an empty result. Bounds are widened by what doubles may round off, and scores are added up in whole numbers;
vectors so large that a score may not fit 63 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

K, EVERY, SCALE, CELLS = 5, 50, 256, 64
#: Rows of a query block and of a candidate block.
QUERIES, CANDIDATES = 256, 4096
#: Exact vectors that the first wave reads for a query, and how many times as many each further one reads.
WAVE, GROWTH = 64, 4
#: Scores must stay under this.
LARGEST = float(1 << 63)


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers) and dim of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0**31
    v = F.transform("embedding", lambda x: F.when(fits(x), F.floor(F.lit(scale) * x.cast("double")).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for exact scores"))))
    use = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    return use.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _packed(rows: DataFrame, n: int, id_column: str, value: str, kind) -> DataFrame:
    """One row per block: dim, block, ids and values as bytes. Rows are dealt to n blocks by hash."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(id_column)
        values = _matrix(table.column(value).combine_chunks(), table.column("dim")[0].as_py()).astype(kind)
        packed = {"ids": pa.array([table.column(id_column).to_numpy().astype(np.int64).tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary())}
        return pa.table({c: table.column(c).slice(0, 1) for c in ("dim", "block")} | packed)

    return rows.withColumn("block", F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int")).groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, values binary")


def edges(vectors: DataFrame) -> DataFrame:
    """Smallest and largest value of each component: dim, low, high. Each batch sends one row a length."""

    def ends(batches):
        for batch in batches:
            dims, column = np.asarray(batch.column("dim")), batch.column("v")
            for dim in np.unique(dims):
                own = _matrix(column.filter(pa.array(dims == dim)), int(dim))
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([own.min(0).tolist()], pa.list_(pa.int64())), pa.array([own.max(0).tolist()], pa.list_(pa.int64()))], ["dim", "low", "high"])

    rows = vectors.select("dim", "v").mapInArrow(ends, "dim int, low array<long>, high array<long>")
    at = rows.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x")).groupBy("dim", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    rows = at.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("e"))
    return rows.select("dim", F.col("e.low").alias("low"), F.col("e.high").alias("high"))


def _cell_edges(low: np.ndarray, high: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First value of each component, and the cells' width."""
    return low, np.maximum(1, -(-(high - low + 1) // cells))


def approximated(vectors: DataFrame, cells: int = CELLS) -> DataFrame:
    """Distinct vectors (by no) as cells, and their bounds: dim, no, cell values, low, high."""

    def cut(batches):
        for batch in batches:
            out = []
            for v, low, high in zip(batch.column("v").to_pylist(), batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True):
                first, width = _cell_edges(np.array(low), np.array(high), cells)
                out.append(((np.array(v) - first) // width).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("dim"), batch.column("no"), pa.array(out, pa.list_(pa.int64()))], ["dim", "no", "cells"])

    return vectors.join(F.broadcast(edges(vectors)), "dim").select("dim", "no", "v", "low", "high").mapInArrow(cut, "dim int, no long, cells array<long>")


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    vectors = written(quantised(rows, scale), "vectors")
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    first = vectors.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    distinct = written(first.groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("no", F.get("ids", F.lit(0))), "distinct-vectors")
    queries = vectors.where(F.col("vec_id") % every == 0)
    bounds = written(edges(distinct), "edges")  # two values a component
    size = F.aggregate(F.zip_with("low", "high", lambda a, b: F.greatest(F.abs(a), F.abs(b)).cast("double")), F.lit(0.0), lambda acc, x: acc + x * x)
    if (bounds.agg(F.max(size).alias("n")).first().n or 0) >= LARGEST:
        raise ValueError("vectors are too large: a score may not fit 63 bits")
    bounds = F.broadcast(bounds)
    parts = lambda df, rows: max(1, -(-df.count() // rows))
    n = parts(distinct, CANDIDATES)
    q_n = parts(queries, QUERIES)
    q = _packed(queries, q_n, "vec_id", "v", np.float64).withColumnsRenamed({"block": "q_block", "ids": "q_ids", "values": "q_values"})
    c = written(_packed(approximated(distinct, cells), n, "no", "cells", np.uint8), "cells")

    def bound(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_ids, ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "ids"))
                q = np.frombuffer(row["q_values"], np.float64).reshape(-1, dim)
                first, width = _cell_edges(np.array(row["low"]), np.array(row["high"]), cells)
                low = (first + np.frombuffer(row["values"], np.uint8).reshape(-1, dim) * width).astype(np.float64)
                high = low + (width - 1)
                plus, minus = np.maximum(q, 0), np.minimum(q, 0)
                upper, lower = plus @ high.T + minus @ low.T, plus @ low.T + minus @ high.T
                slack = 4 * dim * np.finfo(np.float64).eps * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
                upper, lower = upper + slack, lower - slack
                # the query itself may be its vector's only row, so one more is kept
                least = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)] if len(ids) > k else np.full(len(q), -np.inf)
                i, j = np.nonzero(upper >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(lower[i, j]), pa.array(upper[i, j])], ["query_id", "no", "lower", "upper"])

    # Query blocks become n times as many here, and vectors are larger than their files: Spark, which counts bytes before either,
    # must not take a side for small and send it through the driver.
    q = q.repartition(q_n, "dim", "q_block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = c.join(q.hint("merge"), ["dim", "block"]).join(bounds, "dim").repartition(F.col("dim"), F.col("block"), F.col("q_block"))
    near = written(met.mapInArrow(bound, "query_id long, no long, lower double, upper double"), "bounds")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))).where(F.col("r") <= k + 1)
    certain = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("least"))
    left = near.join(certain, "query_id").where((F.col("n") <= k) | (F.col("upper") >= F.col("least"))).select("query_id", "no", "upper")

    left = written(left, "candidates")
    best, wave = None, WAVE
    while not left.isEmpty():
        # the next candidates of each query, by upper bound
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "no"))
        now = left.withColumn("turn", turn).where(F.col("turn") <= wave)
        exact = now.join(distinct.select("no", "v", "ids").hint("merge"), "no").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).hint("merge"), "query_id")
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda acc, x: acc + x)
        found = exact.select("query_id", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        last, best = best, written((found if best is None else best.drop("rank").unionByName(found)).withColumn("rank", rank).where(F.col("rank") <= k), "best")
        certain = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        more = left.withColumn("turn", turn).where(F.col("turn") > wave).drop("turn").join(certain, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least")
        before, left = left, written(more, "candidates")
        discard(before, *([last] if last is not None else []))
        wave *= GROWTH
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
