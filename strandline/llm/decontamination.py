"""Benchmark decontamination with DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window); windows are told apart by their
words, and a window knows its items. Any window of L words that occurs in a document covers, wherever it stands, a whole
aligned block of b = (L + 1) // 2 words: one that begins at a multiple of b. So a document is looked up only once in b
words, by the hash of its aligned blocks, in the broadcast hash set of all b-word blocks of windows. A block travels with
the words of all windows that may hold it (2 L - b at most), never with its document, so the work is linear in a text's
length. Each window around a block that is in the set is looked up among the windows by its own hash, and the words
themselves are compared: a place of a document meets one window, however many items share it. Items are joined once for
each window that a document holds. Documents are scanned once, for all window lengths together.

Windows and blocks are broadcast while they take at most ``broadcast_bytes`` (each); beyond that the same equi-joins
shuffle both sides and sort them.

Defined results: null texts and texts without a word have no words and no hits; null or wordless items have no windows;
an item with a null id marks words but isn't counted; items that share an id are one item; every row of docs gives one
row, repeated and null ids included; other columns are ignored; an empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, small, written

WINDOW, BROADCAST_BYTES = 10, 64 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a broadcast row, and of each word in it, besides the words' own.
ROW_BYTES, WORD_BYTES = 80, 24


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK), "")


def _blocks(length: int) -> Column:
    """Each block that begins at a multiple of b: p, its hash, and the words from ``room`` before it to the end of the last window that holds it."""
    b = (length + 1) // 2
    room = length - b

    def one(p):
        first = F.greatest(F.lit(0), p - room)
        return F.struct(F.lit(length).alias("length"), p.alias("p"), F.xxhash64(F.slice("words", p + 1, F.lit(b))).alias("block"), F.slice("words", first + 1, p - first + length).alias("near"))

    enough = F.size("words") >= length
    return F.when(enough, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - b), F.lit(b)), one)).otherwise(F.array().cast("array<struct<length:int,p:int,block:bigint,near:array<string>>>"))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """no, length, window (its words), hash and ids (of its items) of every distinct window, as a written table."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("item")).where(F.size("item") > 0).withColumn("length", F.least(F.lit(window), F.size("item")))
    places = items.select("item_id", "item", "length", F.explode(F.sequence(F.lit(0), F.size("item") - F.col("length"))).alias("q"))
    own = places.groupBy("length", F.slice("item", F.col("q") + 1, F.col("length")).alias("window")).agg(F.collect_set("item_id").alias("ids"))
    return written(own.select(F.monotonically_increasing_id().alias("no"), "length", "window", F.xxhash64("window").alias("hash"), "ids"), "windows")


def _joined(table: DataFrame, bytes_of_all: int, limit: int) -> DataFrame:
    return F.broadcast(table) if bytes_of_all <= limit else table.hint("merge")


def windows_found(docs: DataFrame, windows: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row, doc_id, n_words, start, length, no) of every benchmark window that occurs in a row of docs, repeats possible;
    each row of docs is there at least once, with a null start besides its windows."""
    length, b = F.col("length"), F.floor((F.col("length") + 1) / 2).cast("int")
    facts = windows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("window", ""))).alias("bytes")).collect()  # a row a length, at most ``window``
    cuts = windows.select("length", F.explode(F.transform(F.sequence(F.lit(0), length - b), lambda s: F.xxhash64(F.slice("window", s + 1, b)))).alias("block")).distinct()
    cuts = _joined(cuts.withColumn("known", F.lit(True)), sum(r.n * (r.length - (r.length + 1) // 2 + 1) * ROW_BYTES for r in facts), broadcast_bytes)
    lookup = windows.select("length", "hash", F.col("window").alias("of_item"), "no")
    lookup = _joined(lookup, sum(r.bytes + r.n * (ROW_BYTES + WORD_BYTES * r.length) for r in facts), broadcast_bytes)
    itself = F.struct(F.lit(0).alias("length"), F.lit(-1).alias("p"), F.xxhash64("doc_id", F.size("words")).alias("block"), F.array().cast("array<string>").alias("near"))
    texts = docs.select("doc_id", words("text").alias("words"))
    # the row number keeps Spark from working out the blocks twice, below and in a filter on them
    cut = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(F.array(itself), *(_blocks(r.length) for r in facts)).alias("x"))
    seeds = cut.select("row", "doc_id", "n_words", F.explode("x").alias("x")).select("row", "doc_id", "n_words", "x.*")
    met = seeds.join(cuts, ["length", "block"], "left").where((length == 0) | F.col("known"))
    # the windows that hold the block: each begins s words before it, if the text has so many there and enough behind
    ahead = F.least(F.greatest(F.col("p"), F.lit(0)), F.floor(length / 2).cast("int"))  # words in front of the block, of length - b at most
    fits = F.filter(F.sequence(F.lit(0), ahead), lambda s: ahead - s + length <= F.size("near"))
    around = F.transform(fits, lambda s: F.struct((F.col("p") - s).alias("start"), F.slice("near", ahead - s + 1, length).alias("window")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("start"), F.array().cast("array<string>").alias("window")))
    each = met.select("row", "doc_id", "n_words", "length", F.explode(F.when(length == 0, none).otherwise(around)).alias("x"))
    each = each.select("row", "doc_id", "n_words", "length", "x.start", "x.window", F.when(length == 0, F.xxhash64("row")).otherwise(F.xxhash64("x.window")).alias("hash"))
    found = each.join(lookup, ["length", "hash"], "left").where((length == 0) | (F.col("window") == F.col("of_item")))
    return found.select("row", "doc_id", "n_words", "start", "length", "no")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings), spans (maximal runs of hit words: start, end exclusive), contaminated."""
    windows = _windows(benchmark, window)
    is_hit = F.col("start").isNotNull()
    rows = windows_found(docs, windows, broadcast_bytes).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.collect_set(F.when(is_hit, F.struct("start", "length"))).alias("hits"),
        F.collect_set(F.when(is_hit, F.col("no"))).alias("windows"),
    )
    rows = written(rows, "documents-hit")
    ids = rows.select("row", F.explode("windows").alias("no")).join(windows.select("no", "ids"), "no")
    ids = ids.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1)))))
    items = F.array_sort(F.transform(F.coalesce("ids", F.array().cast("array<long>")), lambda i: i.cast("string")))
    out = rows.join(ids, "row", "left").select("doc_id", "n_words", hit.alias("hit"), items.alias("items"))
    begins = F.filter("hit", lambda x, i: (i == 0) | (F.get("hit", i - 1) != x - 1))
    ends = F.filter("hit", lambda x, i: (i == F.size("hit") - 1) | (F.get("hit", i + 1) != x + 1))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    n_hit = F.size("hit").cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", spans.alias("spans"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs in whose id's texts no benchmark window occurs, with all their columns. Only the ids found go on."""
    # hits are told apart after they are gathered by row: a filter before that would have Spark work out a text's words anew for each block
    rows = windows_found(docs, _windows(benchmark, window), broadcast_bytes).groupBy("row").agg(F.first("doc_id").alias("id"), F.max("n_words").alias("n_words"), F.count("start").alias("found"))
    own = free_name(docs.columns, "contaminated_id")
    found = rows.where((F.col("found") > 0) & (F.col("n_words") > 0)).select(F.col("id").alias(own)).distinct()
    found = small(written(found, "contaminated"), F.lit(64))
    return docs.join(found, docs["doc_id"].eqNullSafe(found[own]), "left_anti")
