"""Mixing sources to target weights by entropy balancing.

Each document gets a rate w in (0, 2): how often the mix takes it. Among all rates whose words meet every source's
target, those are chosen that are closest in (bounded) relative entropy to taking every document once. The dual of
that convex problem has one multiplier l per source, and its solution tilts the rates exponentially by size:

    w(d) = 2 e^t / (1 + e^t),   t = l(source) * size(d) / mean size(source)

(the Fermi-Dirac form of exponential tilting keeps w under 2). Newton iterations on the dual need, per source, the
words the current rates take and their derivative: two sums, which Spark computes over the table of distinct
(source, size) with counts. That table is the documents pre-aggregated on the map side, so a source with a third of
all rows costs no more than its distinct sizes. Iterations are guarded by a bracket, so they always converge.

Rates become whole copies by systematic rounding: documents of a source stand in order of size, the running sum of
rates R is cut at whole numbers, and a document gets as many copies as cuts fall into its step. Neighbours have
nearly the same size, so the words taken differ from the target by at most one largest document. The running sum
comes from the table of distinct sizes, and within one size from hashed cells, so no source and no size is ever
sorted in one task. Within a cell documents stand in order of doc_id and a hash of their text, and multipliers are rounded to
DIGITS places, below which sums of doubles depend on the order of tasks: so reruns give every document the same copies.

The driver holds one row per source (name, words, target, multiplier), as the targets themselves are given per source;
``max_sources`` bounds that.

Defined results: null and empty texts have size 0 and take 0 words; a null source is a source; rows that share a
doc_id are separate documents with the same id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, code_points, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Cells that documents of one source and size are dealt to before they are numbered.
CELLS = 1024
MAX_SOURCES = 1_000_000
#: Decimal places of multipliers.
DIGITS = 6


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> dict:
    """Words for each source. Sources by code point, null last, weigh weights in turn and share ``share`` of all words;
    none gets over ``most`` times its words, and the excess is shared again by weight among the others."""
    names = code_points(sizes)
    weigh = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weigh[s] for s in open_)
        full = [s for s in open_ if left * weigh[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weigh[s] / total for s in open_}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _rate(tilt, most: int = MOST):
    return F.lit(float(most)) / (1 + F.exp(-tilt))


def multipliers(histogram: DataFrame, want: dict[int, tuple[float, float, float]], rounds: int = 60, close: float = 1e-6, most: int = MOST) -> dict[int, float]:
    """Newton on the dual, all sources at once, one Spark aggregation a round.

    histogram: source_no, size, n. want: source_no -> (words, target, mean size). Sources whose target is 0 or
    ``most`` times their words need no finite multiplier and get minus or plus infinity.
    """
    out, bracket = {}, {}
    for s, (words, target, _) in want.items():
        if words == 0 or target <= 0 or target >= most * words:
            out[s] = -math.inf if target <= 0 and words else math.inf if words else 0.0
        else:
            # with the first guess 0 every rate is most / 2
            bracket[s] = [-64.0, 64.0, 0.0]
    spark = histogram.sparkSession
    for _ in range(rounds):
        if not bracket:
            break
        now = spark.createDataFrame([(s, b[2], want[s][2]) for s, b in bracket.items()], "source_no int, l double, mean double")
        x = F.col("size") / F.col("mean")
        at = histogram.join(F.broadcast(now), "source_no").withColumn("w", _rate(F.col("l") * x, most))
        rows = at.groupBy("source_no").agg(
            F.sum(F.col("n") * F.col("size") * F.col("w")).alias("words"), F.sum(F.col("n") * F.col("size") * x * F.col("w") * (1 - F.col("w") / most)).alias("slope")
        )
        for r in rows.collect():
            b, target = bracket[r.source_no], want[r.source_no][1]
            miss = r.words - target
            if abs(miss) <= close * max(1.0, target):
                out[r.source_no] = round(b[2], DIGITS)
                del bracket[r.source_no]
                continue
            b[1 if miss > 0 else 0] = b[2]
            step = b[2] - miss / r.slope if r.slope > 0 else math.nan
            b[2] = step if b[0] < step < b[1] else (b[0] + b[1]) / 2
    return out | {s: round(b[2], DIGITS) for s, b in bracket.items()}


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, max_sources: int = MAX_SOURCES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (and the columns in keep) of every row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    cell = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(CELLS)).cast("int")
    rows = written(docs.select("doc_id", "source", *(c for c in keep if c not in ("doc_id", "source", "text")), size.alias("size"), cell.alias("cell"), F.xxhash64("text").alias("text_hash")), "sizes")
    cells = rows.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    spark = docs.sparkSession
    words = {r.source: r.words for r in totals}
    want = targets(words, weights, share, most)
    number = {name: i for i, name in enumerate(code_points(words))}
    ids = spark.createDataFrame([(name, i, words[name], float(want[name])) for name, i in number.items()], "source string, source_no int, source_size long, target double")
    histogram = written(by_size.join(F.broadcast(ids), by_size.source.eqNullSafe(ids.source)).select("source_no", "size", "n"), "size-counts")
    mean = {r.source: max(1.0, r.words / r.docs) for r in totals}
    found = multipliers(histogram, {i: (words[s], want[s], mean[s]) for s, i in number.items()}, most=most)
    tilts = spark.createDataFrame([(i, found[i], mean[s]) for s, i in number.items()], "source_no int, l double, mean double")

    rate = F.when(F.col("l") == math.inf, F.lit(float(most))).when(F.col("l") == -math.inf, F.lit(0.0)).otherwise(_rate(F.col("l") * F.col("size") / F.col("mean"), most))
    upto = Window.partitionBy("source_no").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    classes = histogram.join(F.broadcast(tilts), "source_no").withColumn("rate", rate)
    classes = classes.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(upto), F.lit(0.0))).select("source_no", "size", "rate", "start")

    before = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    places = cells.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("source", "size", "cell").orderBy("doc_id", "text_hash")
    numbered = rows.withColumn("at", F.row_number().over(within))
    numbered = numbered.join(F.broadcast(ids), numbered.source.eqNullSafe(ids.source)).drop(ids.source)
    places = places.join(F.broadcast(ids.select("source", "source_no")), places.source.eqNullSafe(ids.source)).select("source_no", "size", "cell", "skip")
    out = numbered.join(places, ["source_no", "size", "cell"]).join(classes, ["source_no", "size"])
    end = F.col("start") + (F.col("skip") + F.col("at")) * F.col("rate")
    cut = lambda c: F.floor(c + 0.5 + 1e-9)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(most), cut(end) - cut(end - F.col("rate")))).cast("long")
    return out.withColumn("copies", copies).select("doc_id", "source", *(c for c in keep if c not in ("doc_id", "source", "text")), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
