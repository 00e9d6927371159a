"""Hard negatives by exact integer inner products, several candidates a multiplication (Kronecker packing).

Vectors are quantised to integers floor(256 x). Less the smallest component there is, no component is negative, and with
that bias the inner product of two vectors is smaller than some 2^s. So the components of several candidates lie in fields
of s bits of one wide integer, a word a component: each anchor component multiplies the word once, the products are added
up, and the sum holds every candidate's biased inner product in its own field, as no field carries into the next. Taking
the bias out again gives the exact score. Words have 53 bits, the integers that a double holds exactly, so that the
products of a block of anchors with a block of words are one matrix multiplication; where not even one field fits, words
have 63 bits.

Blocks of anchors and of packed candidates meet on a grid: anchors lie in row groups, candidates in column groups, and a
block travels once to each place of its row or column, where it meets the others' blocks. A task goes through its pairs of
blocks one by one and keeps each anchor's few best, so what leaves it grows with the anchors and not with the pairs. A first
pass gives each anchor its positives, a second one, with their scores, the negatives in each positive's band of scores.

Defined results: rows with a null id, label or vector, with a null or non-finite component or without components take no
part; rows that share an id are one row (the smallest vector, then the smallest label); vectors meet vectors of their own
length only; ties of score go to the smaller id; a positive without negatives in its band gives no rows; other columns are
ignored; an empty table gives an empty result; vectors so large that a score may not fit 63 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 5, 100, 256
#: A negative's score lies between this part of the positive's (in hundredths) and the positive's.
BAND = 80
#: Rows of a block of anchors and of a block of candidates.
ANCHORS, CANDIDATES = 128, 4096
#: Blocks of anchors in a row group: what a task keeps is bounded by the anchors of its row.
ROW_BLOCKS = 32
#: Bits of a word of doubles, and of one of integers.
EXACT, WIDE = 53, 63
#: Below all scores.
NONE = np.iinfo(np.int64).min

HITS = "anchor_id long, positive_id long, other_id long, score long"


def relabelled(label: Column, vec_id: Column) -> Column:
    """A wrong label for every seventh id, as the task has it."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (integers), dim of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0**31
    v = F.transform("embedding", lambda x: F.when(fits(x), F.floor(F.lit(scale) * x.cast("double")).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for exact scores"))))
    use = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & whole)
    one = use.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(v.alias("v"), F.col("label").cast("long").alias("label"))).alias("x"))
    return one.select("vec_id", relabelled(F.col("x.label"), F.col("vec_id")).alias("label"), "x.v", F.size("x.v").alias("dim"))


def field_bits(low: int, high: int, dim: int) -> int:
    """Bits that the inner product of two vectors of dim components between low and high needs, both biased by low."""
    return max(1, (dim * (high - low) ** 2).bit_length())


def packed(own: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Candidates (rows of own) as words: component by word. Word w holds candidates w * fields, w * fields + 1 and so on, the first in its lowest bits."""
    room = EXACT if bits <= EXACT else WIDE
    fields = max(1, room // bits)
    biased = np.zeros((-(-len(own) // fields) * fields, own.shape[1]), np.int64)
    biased[: len(own)] = own - low
    shifts = bits * np.arange(fields, dtype=np.int64)
    words = (biased.reshape(-1, fields, own.shape[1]) << shifts[:, None]).sum(axis=1)
    return np.ascontiguousarray(words.T, np.float64 if room == EXACT else np.int64)


def unpacked(anchors: np.ndarray, words: np.ndarray, sums: np.ndarray, low: int, bits: int) -> np.ndarray:
    """Scores of each anchor (rows) with each candidate. sums: each candidate's sum of biased components."""
    biased = anchors - low
    room = EXACT if bits <= EXACT else WIDE
    fields = max(1, room // bits)
    total = (biased.astype(words.dtype) @ words).astype(np.int64)
    shifts = bits * np.arange(fields, dtype=np.int64)
    own = (total[:, :, None] >> shifts) & np.int64((1 << bits) - 1)
    own = own.reshape(len(anchors), -1)[:, : len(sums)]
    return own + low * (biased.sum(axis=1)[:, None] + sums) + anchors.shape[1] * low * low


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _bytes(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _numbered(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Deals rows to blocks of about ``size`` rows by a hash of their id; and the number of blocks."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n


def candidate_blocks(vectors: DataFrame, low: int, bits: int) -> tuple[DataFrame, int]:
    """dim, block, ids, labels, sums, words (bytes) of each block of candidates, in order of id; and the number of blocks."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        own = _matrix(table.column("v").combine_chunks(), table.column("dim")[0].as_py())
        columns = {"ids": table.column("vec_id").to_numpy(), "labels": table.column("label").to_numpy(), "sums": (own - low).sum(axis=1), "words": packed(own, low, bits)}
        return pa.table({c: table.column(c).slice(0, 1) for c in ("dim", "block")} | {c: _bytes(x) for c, x in columns.items()})

    rows, n = _numbered(vectors, CANDIDATES)
    return rows.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, labels binary, sums binary, words binary"), n


def anchor_blocks(anchors: DataFrame, n: int) -> DataFrame:
    """dim, block, ids, labels, values of each block of anchors, and their positives and these's scores, n an anchor (NONE: no such one)."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("vec_id")
        own = _matrix(table.column("v").combine_chunks(), table.column("dim")[0].as_py())
        wide = {c: np.array([(x or [])[:n] + [NONE] * (n - len((x or [])[:n])) for x in table.column(c).to_pylist()], np.int64) for c in ("positive_ids", "positive_scores")}
        columns = {"ids": table.column("vec_id").to_numpy(), "labels": table.column("label").to_numpy(), "values": own} | wide
        return pa.table({c: table.column(c).slice(0, 1) for c in ("dim", "block")} | {c: _bytes(x) for c, x in columns.items()})

    rows, _ = _numbered(anchors, ANCHORS)
    return rows.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, labels binary, values binary, positive_ids binary, positive_scores binary")


def met(anchors: DataFrame, candidates: DataFrame, rows: int, columns: int) -> DataFrame:
    """Blocks of anchors (side 0) and of candidates (side 1), each in every task of its row or column of the grid. A place
    is a partition; there a length's anchors come before its candidates."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"side": F.lit(0), "row": F.pmod("block", F.lit(rows)), "column": every(columns)})
    right = candidates.withColumns({"side": F.lit(1), "column": F.pmod("block", F.lit(columns)), "row": every(rows)})
    both = left.unionByName(right, allowMissingColumns=True).withColumn("place", (F.col("row") * columns + F.col("column")).cast("int"))
    return both.drop("row", "column").repartitionById(rows * columns, "place").sortWithinPartitions("place", "dim", "side", "block")


class Best:
    """The largest ``k`` scores of each key, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def add(self, key, scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.of:
            scores, ids = (np.concatenate(x) for x in zip(self.of[key], (scores, ids), strict=True))
        keep = np.lexsort((ids, -scores))[: self.k]
        self.of[key] = scores[keep], ids[keep]

    def batches(self):
        rows = [(*key, int(i), int(s)) for key, (scores, ids) in self.of.items() for s, i in zip(scores, ids, strict=True)]
        for begin in range(0, len(rows), 50_000):
            part = list(zip(*rows[begin : begin + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], ["anchor_id", "positive_id", "other_id", "score"])


def _scan(low: int, bits: int, k: int, take):
    """A function over the blocks of grid places that keeps what ``take(best, anchors, candidates, scores)`` adds of each two that meet."""
    kind = np.float64 if bits <= EXACT else np.int64

    def scan(batches):
        best, at, anchors = Best(k), None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = {c: np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "sums", "values", "positive_ids", "positive_scores") if row[c] is not None}
                if at != (row["place"], row["dim"]):
                    at, anchors = (row["place"], row["dim"]), []
                if row["side"] == 0:
                    anchors.append(block | {"values": block["values"].reshape(-1, row["dim"])})
                    continue
                words = np.frombuffer(row["words"], kind).reshape(row["dim"], -1)
                for own in anchors:
                    take(best, own, block, unpacked(own["values"], words, block["sums"], low, bits))
        yield from best.batches()

    return scan


def take_positives(best: Best, anchors: dict, block: dict, scores: np.ndarray) -> None:
    for a, (anchor, label) in enumerate(zip(anchors["ids"], anchors["labels"], strict=True)):
        at = np.flatnonzero((block["labels"] == label) & (block["ids"] != anchor))
        if len(at) > best.k:  # no more than the k best and those as good as the last of them
            own = scores[a, at]
            at = at[own >= np.partition(own, -best.k)[-best.k]]
        if len(at):
            best.add((int(anchor), 0), scores[a, at], block["ids"][at])


def take_negatives(best: Best, anchors: dict, block: dict, scores: np.ndarray, band: int = BAND) -> None:
    n = len(anchors["positive_ids"]) // len(anchors["ids"])
    ids, limits = anchors["positive_ids"].reshape(-1, n), anchors["positive_scores"].reshape(-1, n)
    for a, (anchor, label) in enumerate(zip(anchors["ids"], anchors["labels"], strict=True)):
        there = limits[a] != NONE
        if not there.any():
            continue
        high, low = limits[a][there], -((-band * limits[a][there]) // 100)
        at = np.flatnonzero((block["labels"] != label) & (scores[a] <= high.max()) & (scores[a] >= low.min()))
        if not len(at):
            continue
        at = at[np.argsort(-scores[a, at], kind="stable")]  # ids come in order, so ties do
        own = scores[a, at]
        first, last = np.searchsorted(-own, -high, "left"), np.searchsorted(-own, -low, "right")
        for p, begin, end in zip(ids[a][there], first, last, strict=True):
            end = min(int(end), int(begin) + best.k)
            if begin < end:
                best.add((int(anchor), int(p)), own[begin:end], block["ids"][at[begin:end]])


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, scale: int = SCALE, band: int = BAND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose id is divisible by
    ``every`` and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    whose score is between ``band`` hundredths of the positive's and the positive's."""
    if not 0 <= band <= 100:
        raise ValueError("band must be 0..100")
    spark = rows.sparkSession
    vectors = written(quantised(rows, scale), "labelled-vectors")
    edge = vectors.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.max("dim").alias("dim")).first()
    low, high, dim = edge.low or 0, edge.high or 0, edge.dim or 1
    bits = field_bits(low, high, dim)
    # neither a field nor a hundredfold score with its bias in it may pass 63 bits
    if max(bits, (400 * dim * max(abs(low), abs(high), high - low) ** 2).bit_length()) > WIDE:
        raise ValueError("vectors are too large: a score may not fit 63 bits")
    packed_rows, n = candidate_blocks(vectors, low, bits)
    candidates = written(packed_rows, "packed-candidates")
    anchors = vectors.where(F.col("vec_id") % every == 0)
    rows_of_grid = max(1, -(-anchors.count() // (ANCHORS * ROW_BLOCKS)))
    columns = max(1, min(n, 4 * spark.sparkContext.defaultParallelism // rows_of_grid))
    none = F.array().cast("array<long>")
    plain = anchor_blocks(anchors.withColumns({"positive_ids": none, "positive_scores": none}), positives)
    first = met(plain, candidates, rows_of_grid, columns).mapInArrow(_scan(low, bits, positives, take_positives), HITS)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other_id"))
    own = first.withColumn("r", rank("anchor_id")).where(F.col("r") <= positives)
    own = own.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("r", "other_id", "score"))).alias("p"))
    known = written(anchors.join(own, anchors["vec_id"] == own["anchor_id"]).select("vec_id", "label", "v", "dim", F.col("p.other_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")), "anchors")

    second = met(anchor_blocks(known, positives), candidates, rows_of_grid, columns)
    found = second.mapInArrow(_scan(low, bits, negatives, lambda best, anchors, block, scores: take_negatives(best, anchors, block, scores, band)), HITS)
    ranked = found.withColumn("rank", rank("anchor_id", "positive_id")).where(F.col("rank") <= negatives)
    pairs = known.select(F.col("vec_id").alias("anchor_id"), F.explode(F.arrays_zip("positive_ids", "positive_scores")).alias("p"))
    pairs = pairs.select("anchor_id", F.col("p.positive_ids").alias("positive_id"), F.col("p.positive_scores").alias("positive_score"))
    out = ranked.join(pairs, ["anchor_id", "positive_id"])
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    discard(vectors, candidates, known)
    return out
