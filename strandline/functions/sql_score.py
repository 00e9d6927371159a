"""The scorer as a SQL function, and a second scorer that Catalyst evaluates by itself.

    register(spark)
    spark.sql("SELECT sw_score(q.codes, d.codes), sw_score(q.codes, d.codes, 'pam250', 3, 1) FROM q, d")
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strandline.operators.params import SearchParams

from . import kernel
from .matrices import matrix


def _scores(a: pa.Array, b: pa.Array, *options: pa.Array) -> pa.Array:
    """Scores of encoded sequences, row by row. Rows of a batch that share the first sequence and the options are scored
    together, shorter sequences first; null with anything is null."""
    a, b, chosen = a.to_pylist(), b.to_pylist(), list(zip(*(x.to_pylist() for x in options), strict=True)) or [()] * len(a)
    groups: dict = {}
    for i, (query, sequence, own) in enumerate(zip(a, b, chosen, strict=True)):
        if query is not None and sequence is not None and None not in own:
            groups.setdefault((own, query), []).append(i)
    out = np.zeros(len(a), np.int64)
    known = np.zeros(len(a), bool)
    for (own, query), rows in groups.items():
        params = SearchParams(*own)
        rows = sorted(rows, key=lambda i: len(b[i]))
        for part in kernel.batches(np.array([len(b[i]) for i in rows])):
            at = rows[part]
            out[at] = kernel.scores(query, kernel.padded([b[i] for i in at]), params.scores(), params.gap_open, params.gap_extend)
        known[rows] = True
    return pa.array(out, pa.int32(), mask=~known)


def register(spark: SparkSession, name: str = "sw_score") -> None:
    """Makes name(a, b[, matrix[, gap_open[, gap_extend]]]) known to SQL; a and b as ``alphabet.encode`` makes them."""
    spark.udf.register(name, F.arrow_udf(_scores, "int"))


def fold_score(a: Column, b: Column, name: str = "blosum62", gap_open: int = 10, gap_extend: int = 2) -> Column:
    """The score of two arrays of codes as folds of Catalyst's own: over a's residues, and within over b's. No Python at run
    time, and no line in common with the kernel. For short sequences: a row is appended to cell by cell."""
    SearchParams(name, gap_open, gap_extend)
    flat = F.lit([int(x) for x in matrix(name).reshape(-1)])
    oe, e = gap_open + gap_extend, gap_extend
    zeros = F.transform(b, lambda _: F.lit(0))

    def cell(row, at, residue, above):
        """row: h and f so far, what runs along the row, and H up and to the left."""
        h, f = above["h"], above["f"]
        value = F.greatest(F.lit(0), row["diagonal"] + F.get(flat, residue * 24 + F.get(b, at)), row["along"], F.get(f, at))
        return value, F.get(h, at)

    def one_row(above, residue):
        start = F.struct(F.array().cast("array<int>").alias("h"), F.array().cast("array<int>").alias("f"), F.lit(0).alias("along"), F.lit(0).alias("diagonal"))

        def step(row, at):
            value, diagonal = cell(row, at, residue, above)
            both = F.struct(value.alias("v"), diagonal.alias("d"))
            put = lambda x: F.struct(
                F.array_append(row["h"], x["v"]).alias("h"), F.array_append(row["f"], F.greatest(F.get(above["f"], at) - e, x["v"] - oe)).alias("f"),
                F.greatest(row["along"] - e, x["v"] - oe).alias("along"), x["d"].alias("diagonal"),
            )
            return F.get(F.transform(F.array(both), put), F.lit(0))  # the value is worked out once

        done = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step)
        best = lambda x: F.struct(x["h"].alias("h"), x["f"].alias("f"), F.greatest(above["best"], F.array_max(x["h"])).alias("best"))
        return F.get(F.transform(F.array(done), best), F.lit(0))

    first = F.struct(zeros.alias("h"), zeros.alias("f"), F.lit(0).alias("best"))
    score = F.aggregate(a, first, one_row, lambda x: x["best"])
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(score).cast("int")
