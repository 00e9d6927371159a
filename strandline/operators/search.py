"""Every query against every database sequence.

Queries and sequences meet on a grid of tasks. Queries are dealt to row groups of about ``QUERY_RESIDUES`` residues, the
database to columns; a query travels to each task of its row, a sequence to each task of its column, and there they are
scored. So any number of queries is one plan of one size, and none of them passes through the driver.

Long sequences travel in pieces. An alignment can't span more columns than the penalties let the query pay for
(``kernel.reach``); pieces overlap by so many, so every alignment lies within one of them, and the best of a sequence's
pieces is its score. Where extending a gap is free there is no such bound, and sequences stay whole. Pieces are dealt in
order of length, like cards, so tasks have about as many cells each.

A task takes the longest sequences first and keeps ``top`` hits a query. As soon as it has that many, a pair is left out
if its residues can't reach the last of them (``kernel.bounds``), and scoring stops at the row of the query from which on
no lane can. What a task sends is ``top`` hits a query at most; titles are joined to the hits that are left.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.functions import kernel

from .params import SearchParams

#: Residues of queries that a task holds, about: as many row groups as that takes.
QUERY_RESIDUES = 8_000_000

SCORED = "query_id long, db_pos long, score int, cells long, skipped long, seconds double"


def pieces(db: DataFrame, size: int | None, overlap: int) -> DataFrame:
    """db_pos, piece, codes, len, own of each sequence, or of its pieces of ``size`` columns, neighbours of which share
    ``overlap``. own: columns that belong to this piece alone; these add up to the sequence's length."""
    rows = db.select("db_pos", "codes", "len")
    if size is None:
        return rows.select("db_pos", F.lit(0).alias("piece"), "codes", "len", F.col("len").alias("own"))
    step = size - overlap
    number = F.greatest(F.lit(1), F.ceil((F.col("len") - overlap) / F.lit(step))).cast("int")
    cut = rows.select("*", number.alias("of"), F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"))
    codes = F.when(F.col("of") == 1, F.col("codes")).otherwise(F.substring("codes", F.col("piece") * step + 1, F.lit(size)))
    own = F.when(F.col("piece") == F.col("of") - 1, F.col("len") - F.col("piece") * step).otherwise(F.lit(step))
    return cut.select("db_pos", "piece", codes.alias("codes"), own.alias("own")).select("db_pos", "piece", "codes", F.octet_length("codes").alias("len"), "own")


def grid(queries: DataFrame, sequences: DataFrame, rows: int, columns: int) -> DataFrame:
    """Queries (side 0) and pieces (side 1), each in every task of its row or column; a place is a partition. There queries
    come first, then sequences, the longest ones before others."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Places in length order, one after another, are dealt forth and back, so that no column always gets the longer one.
    turn = F.pmod(F.col("db_pos") + F.col("piece"), F.lit(2 * columns))
    dealt: Column = F.least(turn, F.lit(2 * columns - 1) - turn).cast("int")
    left = queries.select(F.lit(0).alias("side"), F.col("query_id").alias("id"), "codes", F.octet_length("codes").alias("len"), F.lit(0).alias("own"), F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int").alias("row"), every(columns).alias("column"))
    right = sequences.select(F.lit(1).alias("side"), F.col("db_pos").alias("id"), "codes", "len", "own", every(rows).alias("row"), dealt.alias("column"))
    both = left.unionByName(right).withColumn("place", (F.col("row") * columns + F.col("column")).cast("int")).drop("row", "column")
    return both.repartitionById(rows * columns, "place").sortWithinPartitions("side", F.desc("len"), "id").drop("place")


class Hits:
    """The best ``top`` sequences of one query so far: by score, ties to the larger db_pos, each sequence once."""

    def __init__(self, top: int):
        self.top, self.score, self.pos = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, pos: np.ndarray) -> None:
        score, pos = np.concatenate([self.score, score]), np.concatenate([self.pos, pos])
        order = np.lexsort((-pos, -score))
        _, first = np.unique(pos[order], return_index=True)
        keep = order[np.sort(first)][: self.top]
        self.score, self.pos = score[keep], pos[keep]

    def least(self) -> int:
        """Scores under this one are no hits any more."""
        return int(self.score[-1]) if len(self.score) == self.top else 0


def _rows(query_id, pos, score, tally=None) -> pa.RecordBatch:
    n = len(pos)
    columns = [pa.array([query_id] * n, pa.int64()), pa.array(pos, pa.int64()), pa.array(score, pa.int32())]
    columns += [pa.array([x] * n, kind) for x, kind in zip(tally or (0, 0, 0.0), (pa.int64(), pa.int64(), pa.float64()), strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "db_pos", "score", "cells", "skipped", "seconds"])


def _scorer(params: SearchParams, top: int | None):
    """A function over the rows of a place. Besides hits it yields one row without a db_pos: its cells, those left out, its seconds."""
    matrix = params.scores()
    # pairs in full leave nothing out, so a small working set asks for narrow tiles there and not for few lanes
    room = params.batch_cells if top is not None else max(params.batch_cells, kernel.BATCH_CELLS)

    def score(batches):
        ids, queries, hits, cells, skipped, began = [], [], [], 0, 0, time.perf_counter()
        for batch in batches:
            side = np.asarray(batch.column("side"))
            for i in np.flatnonzero(side == 0):
                ids.append(batch.column("id")[i].as_py())
                queries.append(batch.column("codes")[i].as_py())
                hits.append(Hits(top or 1))
            residues = sum(map(len, queries))
            batch = batch.filter(pa.array(side == 1))
            if not batch.num_rows or not queries:
                continue
            batch = batch.take(pa.array(np.argsort(np.asarray(batch.column("len")), kind="stable")))
            pos, own, codes, lengths = np.asarray(batch.column("id")), np.asarray(batch.column("own")), batch.column("codes").to_pylist(), np.asarray(batch.column("len"))
            for part in reversed(list(kernel.batches(lengths, room, kernel.WIDE))):
                lanes = kernel.padded(codes[part])
                there, use, least = kernel.counts(lanes), range(len(queries)), None
                if top is not None:
                    least = [h.least() for h in hits]
                    use = [q for q in use if not least[q] or kernel.bounds(queries[q], there, matrix).max() >= least[q]]
                    least = [least[q] for q in use]
                block = kernel.Batch(lanes, matrix, params.gap_open, params.gap_extend, params.batch_cells)
                found = block.scores([queries[q] for q in use], least)
                for q, scores in zip(use, found, strict=True):
                    if top is None:
                        yield _rows(ids[q], pos[part], scores)
                    else:
                        hits[q].add(scores, pos[part])
                share = own[part].sum() / max(1, lanes.size)  # padding and what neighbours share count for nothing
                cells += int(own[part].sum()) * residues
                skipped += int(own[part].sum()) * (residues - sum(len(queries[q]) for q in use)) + int(block.skipped * share)
        if top is not None:
            for query_id, own in zip(ids, hits, strict=True):
                yield _rows(query_id, own.pos, own.score)
        yield _rows(None, [None], [None], (cells, skipped, time.perf_counter() - began))

    return score


def _shape(queries: DataFrame, tasks: int | None) -> tuple[int, int, int]:
    """Rows and columns of the grid, and the longest query's residues."""
    facts = queries.agg(F.sum(F.octet_length("codes")).alias("residues"), F.max(F.octet_length("codes")).alias("longest")).first()
    rows = max(1, -(-(facts.residues or 0) // QUERY_RESIDUES))
    return rows, max(1, (tasks or 4 * queries.sparkSession.sparkContext.defaultParallelism) // rows), facts.longest or 0


def _scored(queries: DataFrame, db: DataFrame, params: SearchParams, top: int | None, tasks: int | None, observation: Observation | None) -> DataFrame:
    queries = queries.where("query_id is not null and octet_length(codes) > 0").select("query_id", "codes")
    rows, columns, longest = _shape(queries, tasks)
    overlap = kernel.reach(longest, params.scores(), params.gap_open, params.gap_extend)
    cut = top is not None and overlap is not None  # pairs in full are not added up again, so they keep sequences whole
    sequences = pieces(db, max(params.piece, 4 * overlap), overlap) if cut else pieces(db, None, 0)
    found = grid(queries, sequences, rows, columns).mapInArrow(_scorer(params, top), SCORED)
    if observation is not None:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        found = found.observe(observation, total("cells").alias("cells"), total("skipped").alias("skipped"), F.max("cells").alias("largest_task"), F.max("seconds").alias("longest_task"), F.sum("seconds").alias("task_seconds"))
    return found.where("db_pos is not null").select("query_id", "db_pos", "score")


def _diagonals(matrix: np.ndarray):
    """A function over the rows of a place: each pair's best run without a gap, pairs without a positive score left out."""

    def best(batches):
        ids, queries = [], []
        for batch in batches:
            side = np.asarray(batch.column("side"))
            for i in np.flatnonzero(side == 0):
                ids.append(batch.column("id")[i].as_py())
                queries.append(batch.column("codes")[i].as_py())
            batch = batch.filter(pa.array(side == 1))
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(np.asarray(batch.column("len")), kind="stable")))
            pos, codes, lengths = np.asarray(batch.column("id")), batch.column("codes").to_pylist(), np.asarray(batch.column("len"))
            for part in kernel.batches(lengths):
                lanes = kernel.padded(codes[part])
                for query_id, query in zip(ids, queries, strict=True):
                    score, diagonal = kernel.best_diagonals(query, lanes, lengths[part], matrix)
                    some = score > 0
                    columns = [pa.array([query_id] * int(some.sum()), pa.int64()), pa.array(pos[part][some], pa.int64())]
                    columns += [pa.array(x[some], pa.int32()) for x in (diagonal, score)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "db_pos", "diagonal", "score"])

    return best


def best_diagonals(queries: DataFrame, db: DataFrame, matrix: np.ndarray, tasks: int | None = None) -> DataFrame:
    """query_id, db_pos, diagonal, score of each pair that has a run of a positive score. Both sides: codes, not empty; db: len as well."""
    rows, columns, _ = _shape(queries, tasks)
    met = grid(queries, pieces(db, None, 0), rows, columns)
    return met.mapInArrow(_diagonals(matrix), "query_id long, db_pos long, diagonal int, score int")


def score_pairs(queries: DataFrame, db: DataFrame, params: SearchParams = SearchParams(), tasks: int | None = None, observation: Observation | None = None) -> DataFrame:
    """query_id, db_pos, score of every pair, zero scores included."""
    return _scored(queries, db, params, None, tasks, observation)


def best_of(queries: DataFrame, db: DataFrame, params: SearchParams = SearchParams(), tasks: int | None = None, observation: Observation | None = None) -> DataFrame:
    """query_id, db_pos, score: pairs among which are every query's ``top`` best, at most ``top`` a query and task. Rows of a
    query are brought together here, so that nothing more is moved when they are ranked."""
    found = _scored(queries, db, params, params.top, tasks, observation).repartition("query_id")
    return found.groupBy("query_id", "db_pos").agg(F.max("score").alias("score"))


def top_hits(pairs: DataFrame, top: int) -> DataFrame:
    """Adds rank: by score, ties to the larger db_pos; keeps the first ``top`` of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("db_pos")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top)


def with_titles(hits: DataFrame, db: DataFrame) -> DataFrame:
    return hits.join(db.select("db_pos", "seq_ordinal", "title"), "db_pos").select("query_id", "db_pos", "seq_ordinal", "title", "score", "rank")


def search(queries: DataFrame, db: DataFrame, params: SearchParams = SearchParams(), tasks: int | None = None, observation: Observation | None = None) -> DataFrame:
    """query_id, db_pos, seq_ordinal, title, score, rank: the best hits of every query. tasks: places of the grid, four a
    core unless given. observation: gets cells, skipped (cells that could not change the result and were left out),
    largest_task (its cells), longest_task and task_seconds when the result is computed."""
    return with_titles(top_hits(best_of(queries, db, params, tasks, observation), params.top), db)
