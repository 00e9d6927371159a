"""The documents that rank highest for each item by a sum over the item's terms, over classes of equal bags.

A document's score depends on how often it holds each term of the items, and on its length, which counts by one small
number m. So documents are restricted to the items' vocabulary: a bag is the sorted list of term numbers and frequencies.
Documents with the same bag and m are a class: a 64-bit hash brings them together, the bag and m themselves are compared.
Each class is scored once, and ranks by its score and smallest doc_id; then classes are expanded, members in order of
doc_id. As many members as hits are asked for are kept of a class, and as many classes of an item: more can't be hits.

    1. A pass over the texts writes doc_id, n (terms) and the bag of each document. The vocabulary is broadcast.
    2. Counts (N, L, df) are sums over these. They give m and the terms' weights.
    3. Classes: the smallest ids of each bag, cut to ``top`` by parts of a class (a class may hold any share of the
       documents, so its members are salted), then by class.
    4. Scores: a batch of classes by all items as sums over pairs of a class's term and an item with that term, in whole
       numbers. Each task sends its ``top`` best classes an item.

The items' terms are broadcast, so items are taken in blocks of at most BLOCK_BYTES of terms, a pass each; documents never
are.

Defined results: a null text has no terms; a document without terms of an item does not come for it (nor one whose score
is 0, as weights of very frequent terms can be); rows that share a doc_id are documents of their own, each with its rank;
rows with a null doc_id count in N, L and df, but name no document and are no hits; rows of one item_id are items of their
own only in so far as their texts differ: their terms are put together; rows with a null item_id are no items; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, utf8, written

TOP = 10
#: Bytes of terms (with 64 for each, besides) of a block of items; what is broadcast is a few times that at most.
BLOCK_BYTES = 64 << 20
#: Parts that members of one class are dealt to before they are cut to ``top``.
SALTS = 64
#: Fixed values of the score: weights are in thousandths, a document of mean length has m = 100, of which LENGTH are by its length.
WEIGHT, ONE, LENGTH, TERM, EACH = 1000, 100, 75, 1_000_000_000, 8
#: Pairs of a class's term and an item that are worked on at once, and classes of a batch times items.
PAIRS, SCORES = 1 << 21, 1 << 21

#: Every byte that is no part of a term becomes a blank; A-Z become a-z.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() and b < 0x80 else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII digits and letters (in lower case) and non-ASCII characters."""
    return text.translate(_TABLE).split()


def item_blocks(items: DataFrame):
    """Dicts of item_id to Counter of its terms, each block of bounded size. Items come in order; the driver holds one block."""
    block, size, last = {}, 0, None
    for r in items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator():
        own = Counter(terms((r.text or "").encode()))
        cost = sum(64 + len(t) for t in own)
        if block and r.item_id != last and size + cost > BLOCK_BYTES:
            yield block
            block, size = {}, 0
        block.setdefault(r.item_id, Counter()).update(own)
        size, last = size + cost, r.item_id
    if block:
        yield block


def bags(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, bag (bytes: term numbers, ascending, then their frequencies, 32 bits each) of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        number = shared.value
        for whole in batches:
            for batch in blocks(whole, "text", 8 << 20):
                data, starts = utf8(batch.column("text"))
                data, sizes, own = data.tobytes(), [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    words = terms(data[a:b])
                    sizes.append(len(words))
                    found = sorted((number[t], n) for t, n in Counter(words).items() if t in number)
                    own.append(np.array(found, np.int32).T.tobytes() if found else b"")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "n", "bag"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, bag binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many bags hold each of ``size`` terms."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column("bag").to_pylist():
                total[np.frombuffer(bag, np.int32)[: len(bag) // 8]] += 1  # a bag holds a term once
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.where("bag <> X''").select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        out[r.term] = r.df
    return out


def classes(rows: DataFrame, n_documents: int, n_terms: int, top: int) -> DataFrame:
    """m, bag, ids: the classes of documents with a term of the items, and their ``top`` smallest doc_ids."""
    m = F.lit(ONE - LENGTH) + F.expr(f"({LENGTH}L * n * {n_documents}L) div {max(1, n_terms)}L")
    use = rows.where("doc_id is not null and bag <> X''").select("doc_id", "bag", m.cast("long").alias("m"))
    use = use.withColumn("hash", F.xxhash64("m", "bag")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    key = ("hash", "m", "bag")
    for by in ((*key, "salt"), key):
        use = use.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id"))).where(F.col("place") <= top).drop("place")
    return use.groupBy(*key).agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).select("m", "bag", "ids")


def _summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by place, exact: doubles hold the sums of halves of 31 bits each."""
    if not len(values) or int(values.max()) * len(values) < 1 << 53:
        return np.bincount(at, values, size).astype(np.int64)
    return (np.bincount(at, values >> 31, size).astype(np.int64) << 31) + np.bincount(at, values & 0x7FFFFFFF, size).astype(np.int64)


def _scored(sizes: np.ndarray, term: np.ndarray, gain: np.ndarray, starts: np.ndarray, item: np.ndarray, weight: np.ndarray, n_items: int) -> np.ndarray:
    """Scores, classes by items. sizes: terms of each class; term, gain: these one after another; starts, item, weight:
    each term's items and its weight there, times its frequency in the item."""
    out = np.zeros(len(sizes) * n_items, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    fan = starts[term + 1] - starts[term]
    ends = np.cumsum(fan)
    begin = 0
    while begin < len(term):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        own = fan[begin:end]
        pair = np.repeat(np.arange(begin, end), own)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(own) - own, own) + starts[term[pair]]
        out += _summed(of[pair] * n_items + item[at], weight[at] * gain[pair], len(out))
        begin = end
    return out.reshape(-1, n_items)


def best_classes(found: DataFrame, block: dict[int, Counter], numbers: dict[bytes, int], weights: np.ndarray, top: int) -> DataFrame:
    """item_id, score, ids: every task's best classes of each item."""
    ids = np.array(list(block), np.int64)
    flat = [(numbers[t], i, n) for i, own in enumerate(block.values()) for t, n in own.items()]
    by_term = np.array(sorted(flat), np.int64).reshape(-1, 3)
    starts = np.searchsorted(by_term[:, 0], np.arange(len(numbers) + 1))
    shared = found.sparkSession.sparkContext.broadcast((ids, starts, by_term[:, 1].copy(), by_term[:, 2] * weights[by_term[:, 0]]))

    def score(batches):
        ids, starts, item, weight = shared.value
        best: list[list] = [[] for _ in ids]  # of each item: (-score, smallest id, ids)
        step = max(1, SCORES // len(ids))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                bag, members = batch.column("bag").to_pylist(), batch.column("ids").to_pylist()
                parts = [np.frombuffer(b, np.int32) for b in bag]
                sizes = np.array([len(p) // 2 for p in parts])
                term = np.concatenate([p[: len(p) // 2] for p in parts]).astype(np.int64)
                tf = np.concatenate([p[len(p) // 2 :] for p in parts]).astype(np.int64)
                gain = (TERM * tf) // (1000 * tf + EACH * np.repeat(np.asarray(batch.column("m")), sizes))
                scores = _scored(sizes, term, gain, starts, item, weight, len(ids))
                for i, column in enumerate(scores.T):
                    least = max(1, -best[i][-1][0] if len(best[i]) >= top else 1)
                    at = np.flatnonzero(column >= least)
                    if len(at) > top:
                        at = at[column[at] >= np.partition(column[at], -top)[-top]]
                    if len(at):
                        best[i] = sorted(best[i] + [(-int(column[k]), members[k][0], members[k]) for k in at])[:top]
        rows = [(int(ids[i]), -s, own) for i, hits in enumerate(best) for s, _, own in hits]
        for begin in range(0, len(rows), 10_000):
            part = list(zip(*rows[begin : begin + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.list_(pa.int64()))], ["item_id", "score", "ids"])

    return found.mapInArrow(score, "item_id long, score long, ids array<long>")


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents of each item, by score, ties by smaller doc_id."""
    spark, out = documents.sparkSession, []
    for block in item_blocks(items):
        numbers = {t: i for i, t in enumerate(sorted(set().union(*block.values())))}
        rows = written(bags(documents, numbers), "bags")
        total = rows.where("n > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = document_frequencies(rows, len(numbers)).tolist()
        weights = np.array([math.floor(WEIGHT * math.log((2 * total.n + 2) / (2 * n + 1))) for n in df], np.int64)
        found = best_classes(classes(rows, total.n, total.terms, top), block, numbers, weights, top)
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
        hits = found.select("item_id", "score", F.explode("ids").alias("doc_id")).withColumn("rank", rank).where(F.col("rank") <= top)
        out.append(written(hits.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "hits"))
        discard(rows)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
