"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree of variable order: the counts of each symbol after every context of up to three
bytes. A symbol unseen in a context costs the context's escape probability (method C: distinct symbols over occurrences
plus distinct symbols) and is then coded in the next shorter context, where the symbols of the longer one are excluded;
below order 0 all symbols are alike. The statistics are frozen after training, so a text's exact code length in a
language is a sum over its positions, and the language with the shortest code wins. The score is that language's share
of 2^-bits.

Symbols are all bytes, with A-Z in lower case. The counts of all trees are kept sparse: sorted (language, context,
symbol) keys for the orders 0 to 3, found by binary search. The ``symbols`` - 1 bytes most frequent in training have, as
a cache, a dense table of their code lengths in addition (symbols^4 rows, languages x symbols^4 x 4 bytes, 21 MB a
language), which each worker builds; its values are those of the search, so that no result depends on ``symbols``.

Training reads about ``train_docs`` documents a language, chosen by a hash of the id: a bounded sample, as counts beyond
it hardly move. Prediction reads all texts as a whole and moves no row.

Defined results: a null text, and a text without a letter, is ``und`` with score 0, as is everything when no language
could be learned; equal code lengths go to the language first by code point; a null doc_id is neither held out nor
trained on; rows that share a doc_id are predicted each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8, written

SYMBOLS, TRAIN_DOCS, FOLDS = 48, 2_000, 5
#: Grams that are searched at a time.
CHUNK = 1 << 15
UNKNOWN = "und"
#: Bytes of the dense table in a Python worker, and languages that can be told apart in it.
TABLE_BYTES, LANGUAGES = 256 << 20, 2_000


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _lower() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


#: Symbols there are: bytes, without A-Z.
ALPHABET = len(np.unique(_lower()))


def _padded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in lower case, each preceded by three line ends, three more at the end; and the place at which each text's
    grams (of four symbols, by their first place) begin. After each text's grams three follow that belong to none."""
    lengths = np.diff(starts)
    places = np.arange(len(data)) + np.repeat(3 * np.arange(1, len(lengths) + 1), lengths)
    symbols = np.full(len(data) + 3 * (len(lengths) + 1), 10, np.uint8)
    symbols[places] = _lower()[data]
    return symbols, starts[:-1] + 3 * np.arange(len(lengths))


def _grams(symbols: np.ndarray, size: int) -> np.ndarray:
    """The number of the four symbols at each place but the last three."""
    grams = symbols[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        grams *= size
        grams += symbols[k : len(symbols) - 3 + k]
    return grams


def fitting(symbols: int, languages: int) -> int:
    """Symbols of the dense table, ``symbols`` at most, so that it takes TABLE_BYTES at most: fewer ones, the more languages."""
    if languages > LANGUAGES:
        raise ValueError(f"{languages} languages are more than the {LANGUAGES} that the model can hold")
    while symbols > 2 and 4 * languages * symbols**4 > TABLE_BYTES:
        symbols -= 1
    return symbols


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among keys (sorted), and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trees:
    """Frozen context trees: languages, and (language, gram of four bytes, count)."""

    def __init__(self, languages: list[str], size: int, language: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.languages, self.size = languages, size
        self.language, self.gram, self.count = language, gram, count
        self.lut = self._lut()
        self._levels = self._bits = None

    def __getstate__(self):
        return self.__dict__ | {"_levels": None, "_bits": None}

    def levels(self) -> list[tuple[np.ndarray, ...]]:
        """For each order: keys of (language, context, symbol) with the symbol's probability, and keys of (language, context)
        with the factor of all symbols unseen there. Built once per process."""
        if self._levels is None:
            levels, whole = [], (self.language.astype(np.int64) << 32) | self.gram
            for order in range(4):
                keys, place = np.unique(self._suffix(whole, order), return_inverse=True)
                n = np.bincount(place, weights=self.count)
                contexts, first = np.unique(keys >> 8, return_index=True)
                kinds, total = np.diff(first, append=len(keys)), np.add.reduceat(n, first)
                escape = np.where(kinds < ALPHABET, kinds, 0)
                lower = levels[-1][1][_find(levels[-1][0], self._suffix(keys, order - 1))[0]] if levels else np.full(len(keys), 1 / ALPHABET)
                rest = np.maximum(1 - np.add.reduceat(lower, first), 1e-12)
                levels.append((keys, n / np.repeat(total + escape, kinds), contexts, escape / (total + escape) / rest))
            self._levels = levels
        return self._levels

    @staticmethod
    def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
        """Keys of (language, gram) with the last order + 1 bytes of the gram only."""
        return (keys >> 32 << 32) | (keys & ((1 << 8 * (order + 1)) - 1))

    def code(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram of four bytes in each language."""
        whole = (np.arange(len(self.languages), dtype=np.int64)[:, None] << 32) | grams.astype(np.int64)
        p = np.full(whole.shape, 1 / ALPHABET)
        for order, (keys, own, contexts, factor) in enumerate(self.levels()):
            wanted = self._suffix(whole, order)
            at, known = _find(contexts, wanted >> 8)
            p = np.where(known, factor[at] * p, p)
            at, seen = _find(keys, wanted)
            p = np.where(seen, own[at], p)
        return -np.log2(np.maximum(p, 1e-300)).T.astype(np.float32)

    def _lut(self) -> np.ndarray:
        """Each byte's number in the dense table; the last number stands for all bytes that are not in it."""
        n = np.bincount(self.gram & 255, weights=self.count, minlength=256)
        top = sorted(np.unique(_lower()).tolist(), key=lambda b: (-n[b], b))[: self.size - 1]
        lut = np.full(256, self.size - 1, np.uint8)
        lut[top] = np.arange(len(top))
        return lut

    def bits(self) -> np.ndarray:
        """Code length of the last symbol of each gram of the dense table in each language; built once per process. In
        the last column is the mean of the bytes that are not in the table (code() has each of them)."""
        if self._bits is None:
            s, lut = self.size, self.lut
            table = np.empty((s**4, len(self.languages)), np.float32)
            for k in range(len(self.languages)):
                p = np.full((1, s), 1 / ALPHABET, np.float32)
                for order, (keys, own, contexts, factor) in enumerate(self.levels()):
                    if order:
                        p = np.tile(p, (s, 1))
                    place, at = self._dense(contexts, k, order, 24, lut)
                    p[place] *= factor[at, None].astype(np.float32)
                    place, at = self._dense(keys, k, order + 1, 32, lut)
                    p.reshape(-1)[place] = own[at]
                p[:, -1] = np.maximum(1 - p[:, :-1].sum(1), 1e-12) / (256 - s + 1)
                table[:, k] = -np.log2(p.reshape(-1))
            self._bits = table
        return self._bits

    def _dense(self, keys: np.ndarray, language: int, n: int, shift: int, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a language's keys with n bytes each: the places in the dense table, and which keys have one."""
        begin, end = np.searchsorted(keys, [language << shift, (language + 1) << shift])
        place, inside = np.zeros(end - begin, np.int64), np.ones(end - begin, bool)
        for k in reversed(range(n)):
            symbol = lut[(keys[begin:end] >> (8 * k)) & 255]
            place, inside = place * self.size + symbol, inside & (symbol < self.size - 1)
        return place[inside], begin + np.flatnonzero(inside)

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        lengths = np.diff(starts)
        if not len(lengths):
            return np.zeros((0, len(self.languages)))
        padded, first = _padded(data, starts)
        symbols = self.lut[padded]
        each = self.bits()[_grams(symbols, self.size)]
        rare = symbols == self.size - 1
        rare = np.flatnonzero(rare[:-3] | rare[1:-2] | rare[2:-1] | rare[3:])
        if len(rare):  # grams that the dense table lacks
            gram = np.zeros(len(rare), np.uint32)
            for k in range(4):
                gram = (gram << 8) | padded[rare + k]
            gram, place = np.unique(gram, return_inverse=True)
            for k in range(0, len(gram), CHUNK):  # work arrays have a bound
                gone = (place >= k) & (place < k + CHUNK)
                each[rare[gone]] = self.code(gram[k : k + CHUNK])[place[gone] - k]
        edges = np.stack([first, first + lengths], 1).reshape(-1)
        out = np.add.reduceat(np.concatenate([each, np.zeros((4, each.shape[1]), np.float32)]), edges, axis=0, dtype=np.float64)[::2]
        out[lengths == 0] = 0
        return out


def train(docs: DataFrame, symbols: int = SYMBOLS, train_docs: int = TRAIN_DOCS) -> Trees:
    """Context trees of all languages, from text and lang of about train_docs documents each outside the held-out fold."""
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold("doc_id") != 0))
    counts = docs.where(F.col("lang").isNotNull() & (fold("doc_id") != 0)).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    symbols = fitting(symbols, len(counts))
    if not counts:
        return Trees([], symbols, *(np.zeros(0, np.int64) for _ in range(3)))
    parts = spark.createDataFrame([(r.lang, min(1.0, train_docs / r.n)) for r in counts], "lang string, part double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = written(usable.select("doc_id", "lang", "text").join(F.broadcast(parts), "lang").where(place < F.col("part")).select("lang", "text"), "language-sample")

    def gram_counts(batches):
        for batch in batches:
            for block in blocks(batch, "text"):
                names = np.array(block.column("lang").to_pylist(), object)
                for name in dict.fromkeys(names):
                    data, starts = utf8(block.filter(pa.array(names == name)).column("text"))
                    padded, first = _padded(data, starts)
                    grams = _grams(padded, 256)
                    own = np.zeros(len(grams) + 1, np.int32)
                    np.add.at(own, first, 1)
                    np.add.at(own, first + np.diff(starts), -1)
                    gram, n = np.unique(grams[np.cumsum(own)[:-1] > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = sample.mapInArrow(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    languages = sorted(set(names), key=lambda s: [ord(c) for c in s])
    number = {name: k for k, name in enumerate(languages)}
    return Trees(languages, symbols, np.array([number[n] for n in names], np.int16), found.column("gram").to_numpy().astype(np.int64), found.column("n").to_numpy())


def identify(docs: DataFrame, trees: Trees) -> Column:
    """A column (lang, score) for docs.text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(text: pa.Array, letter: pa.Array) -> pa.Array:
        trees, languages, scores = shared.value, [], []
        for block in blocks(pa.RecordBatch.from_arrays([text, letter], ["text", "letter"]), "text"):
            bits = trees.code_lengths(*utf8(block.column("text"))) if trees.languages else np.zeros((len(block), 0))
            known = np.array(block.column("letter").fill_null(False)) & bool(trees.languages)
            best = bits.argmin(1) if trees.languages else np.zeros(len(block), np.int64)
            share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1) if trees.languages else np.zeros(len(block))
            languages += [trees.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, share, 0.0))
        return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["lang", "score"])

    return F.arrow_udf(predict, "lang string, score double")(F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def predicted(docs: DataFrame, symbols: int = SYMBOLS, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    trees = train(docs, symbols, train_docs)
    rows = docs.select("doc_id", "text").select("doc_id", identify(docs, trees).alias("found"), F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
