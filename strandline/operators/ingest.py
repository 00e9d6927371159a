"""Sequences to a database in length order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.alphabet import encode, letters

#: seq_ordinals that one step of the numbering handles together.
STEP = 1 << 16


def encoded(sequences: DataFrame) -> DataFrame:
    """seq_ordinal, title, codes, len of the sequences with at least one letter; null and empty ones are dropped."""
    rows = sequences.select("seq_ordinal", "title", letters("residues").alias("residues")).where(F.length("residues") > 0)
    return rows.select("seq_ordinal", "title", encode("residues").alias("codes"), F.length("residues").alias("len"))


def with_position(rows: DataFrame) -> DataFrame:
    """Adds db_pos: the 0-based rank by (len, seq_ordinal, title); a null ordinal comes after all others of its length, a null title first.

    A rank needs counts, not a sort of all rows in one task: rows of smaller length, then rows of the same length in
    earlier steps of STEP ordinals, then the rank within a step.
    """
    last = F.lit((1 << 63) - 1)  # for null ordinals
    rows = rows.withColumn("step", F.coalesce(F.floor(F.col("seq_ordinal") / STEP), F.floor(last / STEP) + 1))
    counts = rows.groupBy("len", "step").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_len = counts.groupBy("len").agg(F.sum("n").alias("n")).select("len", before(Window.orderBy("len")).alias("shorter"))
    at = counts.select("len", "step", before(Window.partitionBy("len").orderBy("step")).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("len", "step").orderBy(F.asc_nulls_last("seq_ordinal"), "title")) - 1
    out = rows.withColumn("within", within).join(at, ["len", "step"]).join(by_len, "len")
    return out.select((F.col("shorter") + F.col("earlier") + F.col("within")).cast("long").alias("db_pos"), *(c for c in rows.columns if c != "step"))


def preprocess(sequences: DataFrame) -> DataFrame:
    """db_pos, seq_ordinal, title, codes, len."""
    return with_position(encoded(sequences))


def query_set(sequences: DataFrame) -> DataFrame:
    """query_id, title, codes, len, disp (residues of the queries before it, by query_id). Sequences without an ordinal are no queries.

    As with positions, sums go over steps of STEP ordinals first, and codes aren't moved for them in one task.
    """
    step = F.floor(F.col("seq_ordinal") / STEP)
    rows = encoded(sequences).where("seq_ordinal is not null").withColumn("step", step)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = rows.groupBy("step").agg(F.sum("len").alias("n")).select("step", before(Window.orderBy("step"), "n").alias("earlier"))
    within = before(Window.partitionBy("step").orderBy("seq_ordinal", "title"), "len")
    out = rows.withColumn("within", within).join(steps, "step").withColumn("disp", (F.col("earlier") + F.col("within")).cast("long"))
    return out.select(F.col("seq_ordinal").alias("query_id"), "title", "codes", "len", "disp")
