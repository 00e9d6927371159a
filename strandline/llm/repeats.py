"""Where a document repeats a window of units (bytes or words) that also starts in a document with a smaller id.

Shared by the two substring operators, which differ in the unit and in how windows of one partition are compared.

1. Anchors. Every window of W units contains W - k + 1 runs of k units; the one with the smallest hash is its anchor.
   Equal windows have equal anchors, and neighbouring windows mostly share one, so a document has about
   2 / (W - k + 2) anchors per unit, not one per unit.
2. Anchors of at least two documents are found by a shuffle of 32-bit anchor hashes, packed by cell. An anchor that one
   batch already saw twice leaves that batch once. A wrong hit (two anchors with one hash) costs time, never a result.
3. The stretches around such anchors, and only they, go to the cell of their anchor with their content. Of stretches with
   equal content that a task holds, only those of the smallest document bring it along: the others are repeated for
   certain. Equal windows meet in the cell, and ``compare`` decides about the windows of different stretches.
4. Each document gets its repeated windows back.

Step 2 counts every anchor's documents. Anchors of ``crowd`` documents or more (a license line, a group of thousands of
copies) are hot. Their windows are dealt singly by their own hash, so the texts around a hot line don't meet in one task,
however few of all documents have it. The driver and the tasks hold the ``hot_anchors`` most frequent of them, 4 bytes each;
an anchor beyond these has less than one in ``hot_anchors`` of all anchors of the corpus. A window of a hot anchor that a
bounded sample of documents holds in a smaller document, with the same bytes, is repeated and needs no dealing at all. Both
decide how windows travel, never what is repeated.

The number of cells follows the size of the texts, so that a cell's size doesn't grow with the data.

Rows with a null id are smaller than none and have none smaller: they neither repeat nor are repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_cell, cells_for, discard, release, some_rows, utf8, written

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Anchors that a task packs at a time; bounds its memory.
ANCHORS_TOGETHER = 500_000
#: The same for stretches.
STRETCHES_TOGETHER = 150_000
#: And for windows of a sample.
WINDOWS_TOGETHER = 100_000
#: Rows of anchors on their way: seen once in a batch, seen in several documents of it, and how many more these are.
FRESH, KNOWN, MORE = range(3)
COUNTED = np.dtype([("mark", np.uint32), ("docs", np.int64)])
DEALT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("content", pa.binary())])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_R, n), out=self.sums[1:])
        self.back = _powers(_R_INVERSE, n + 1)

    def each(self, length: int) -> np.ndarray:
        """Of every stretch of this length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


@dataclass
class Units:
    """The units of a block of texts: a value each, where each text's units begin, and each unit's place in the bytes."""

    values: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @staticmethod
    def of_bytes(data: np.ndarray, starts: np.ndarray) -> Units:
        place = np.arange(len(data) + 1)
        return Units(_BYTES[data], starts, data, place[:-1], place[1:])

    @staticmethod
    def of_words(data: np.ndarray, starts: np.ndarray) -> Units:
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        own = starts[:-1][starts[:-1] < starts[1:]]  # words don't go on into the next text
        first[own] = inside[own]
        last[starts[1:][starts[:-1] < starts[1:]] - 1] = inside[starts[1:][starts[:-1] < starts[1:]] - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        values = Rolling(_BYTES[data]).at(begin, end) if len(data) else np.zeros(0, np.uint64)
        return Units(values, np.searchsorted(begin, starts), data, begin, end)


@dataclass
class Stretches:
    """Maximal runs of neighbouring windows with one anchor hash."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    rolling: Rolling = field(repr=False)


def stretches(units: Units, window: int, k: int) -> Stretches:
    n = len(units.values)
    rolling = Rolling(units.values)
    if n < window:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.astype(np.uint64), rolling)
    least, width, size = rolling.each(k), window - k + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    lengths = np.diff(units.starts)
    long = np.flatnonzero(lengths >= window)
    count = lengths[long] - window + 1
    valid = np.zeros(n + 2, np.int8)
    np.add.at(valid, units.starts[long], 1)
    np.add.at(valid, units.starts[long] + count, -1)
    at = np.flatnonzero(np.cumsum(valid, dtype=np.int8)[: len(least)])
    if not len(at):
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.astype(np.uint64), rolling)
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    firsts = np.cumsum(count) - count  # each text's first window among the valid ones
    new[firsts] = True
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(at)))
    text = long[np.searchsorted(firsts, begin, "right") - 1]
    return Stretches(text, at[begin], windows, least[at[begin]], rolling)


def low32(anchor: np.ndarray) -> np.ndarray:
    """Anchors are minima, so small; mixed again they spread evenly."""
    return mix(anchor + np.uint64(0x632BE59BD9B4E019))


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Documents by a hash of their id: ids themselves may all be multiples of the number of buckets."""
    return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def dealt_back(ids: np.ndarray, values: np.ndarray, buckets: int) -> pa.Table:
    """Values of documents packed by the document's bucket: one row per bucket, however many documents."""
    parts = by_cell(bucket_of(ids, buckets))
    columns = ([b for b, _ in parts], [ids[p].tobytes() for _, p in parts], [values[p].tobytes() for _, p in parts])
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("bucket", "ids", "packed"), columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)})


def by_document(dealt: DataFrame, column: str, buckets: int) -> DataFrame:
    """(doc_id, column): all values of each document, as bytes. Buckets from ``buckets`` on are of no document: a row with a null id each."""

    def gather(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:  # of no document
            return pa.table({"doc_id": pa.array([None], pa.int64()), column: pa.array([b"".join(table.column("packed").to_pylist())], pa.binary())})
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        packed = b"".join(table.column("packed").to_pylist())
        values = np.frombuffer(packed, np.dtype((np.void, len(packed) // len(ids))))
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        each = [values[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True)]
        return pa.table({"doc_id": pa.array(ids[cut]), column: pa.array(each, pa.binary())})

    return dealt.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(gather, f"doc_id long, {column} binary")


@dataclass(frozen=True)
class Plan:
    """unit: Units.of_bytes or Units.of_words; window and k in units; compare: see repeated(). Anchors of crowd documents are hot."""

    unit: Callable
    window: int
    k: int
    compare: Callable
    crowd: int = 2_000
    hot_anchors: int = 1_000_000
    sample_docs: int = 2_000
    hot_docs: int = 4
    hot_windows: int = 250_000
    hot_bytes: int = 256


def _parts(batch: pa.RecordBatch, plan: Plan):
    for block in blocks(batch, "text"):
        units = plan.unit(*utf8(block.column("text")))
        yield block, np.asarray(block.column("doc_id")), units, stretches(units, plan.window, plan.k)


def hot_marks(marks: DataFrame, plan: Plan) -> np.ndarray:
    """Marks of the hot anchors, at most hot_anchors of them, the most frequent ones, in order."""

    def unpack(batches):
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column("marks").to_pylist()), COUNTED)
            yield pa.RecordBatch.from_arrays([pa.array(found["mark"].astype(np.int64)), pa.array(found["docs"])], ["mark", "docs"])

    every = marks.where("doc_id is null").select("marks").mapInArrow(unpack, "mark long, docs long")
    top = every.orderBy(F.desc("docs"), "mark").limit(plan.hot_anchors).select("mark").toArrow()
    return np.unique(top.column(0).to_numpy().astype(np.uint32))


def hot_windows(docs: DataFrame, plan: Plan, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Windows of hot anchors that about sample_docs documents share: their hashes, in order, the smallest sampled id of
    each, and their bytes. At most hot_windows, of hot_bytes bytes at most each."""
    if not len(anchors):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(anchors)

    def windows(batches):
        """Windows by their bytes, with how often they occur and the smallest id: copies in a task are one row."""
        seen = {}
        for batch in batches:
            for _, ids, units, s in _parts(batch, plan):
                at, of = single_windows(s, np.isin(low32(s.anchor).astype(np.uint32), shared.value))
                fit = units.end[at + plan.window - 1] - units.begin[at] <= plan.hot_bytes
                at, of, data = at[fit], of[fit], units.data.tobytes()
                begin, end, hashes = units.begin[at], units.end[at + plan.window - 1], s.rolling.at(at, at + plan.window).view(np.int64)
                for a, b, key, i in zip(begin.tolist(), end.tolist(), hashes.tolist(), ids[of].tolist(), strict=True):
                    _, least, n = seen.get(data[a:b], (key, i, 0))
                    seen[data[a:b]] = key, min(least, i), n + 1
                if len(seen) >= WINDOWS_TOGETHER:
                    yield counted(seen)
                    seen = {}
        yield counted(seen)

    def counted(seen):
        columns = [list(c) for c in zip(*seen.values(), strict=True)] or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], ["content", "hash", "least", "n"])

    sample = some_rows(docs, plan.sample_docs).repartition(8)
    each = sample.mapInArrow(windows, "content binary, hash long, least long, n long")
    found = each.groupBy("hash", "content").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    top = found.where(F.col("n") >= plan.hot_docs).orderBy(F.desc("n"), "hash").limit(plan.hot_windows).toArrow()
    hashes, least = top.column("hash").to_numpy().astype(np.int64).view(np.uint64), top.column("least").to_numpy().astype(np.int64)
    order, content = np.argsort(hashes), top.column("content").to_pylist()
    return hashes[order], least[order], [content[i] for i in order.tolist()]


def single_windows(s: Stretches, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of some stretches: its first unit, and its text."""
    n = s.windows[own]
    return np.repeat(s.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(s.text[own], n)


def shared_anchors(docs: DataFrame, plan: Plan, cells: int) -> DataFrame:
    """(doc_id, marks): hashes of the document's anchors that a second document has, 4 bytes each. In rows with a null id:
    marks of anchors of plan.crowd documents at least, with how many (COUNTED)."""

    def pack(batches):
        found, size = [], 0
        for batch in batches:
            for block, ids, _, s in _parts(batch, plan):
                found.append((low32(s.anchor), ids[s.text]))
                size += len(s.anchor)
                if size >= ANCHORS_TOGETHER:
                    yield from packed_cells(found)
                    found, size = [], 0
        yield from packed_cells(found)

    def packed_cells(found):
        """Anchors by cell: those seen once go on to be met; those of several documents are known, and go on once, with how many more there are."""
        if not found:
            return
        anchor, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, anchor))
        anchor, ids = anchor[order], ids[order]
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])) if len(anchor) else np.zeros(0, bool)
        anchor, ids = anchor[fresh], ids[fresh]
        new = np.append(True, anchor[1:] != anchor[:-1]) if len(anchor) else np.zeros(0, bool)
        many = ~new
        many[:-1] |= ~new[1:]
        first = np.flatnonzero(new)
        more = np.diff(np.append(first, len(anchor))) - 1
        cell, mark = ((anchor >> np.uint64(32)) % np.uint64(cells)).astype(np.int32), anchor.astype(np.uint32)
        out = []
        kinds = ((FRESH, first, ids), (KNOWN, np.flatnonzero(many), ids), (MORE, first[more > 0], np.repeat(more, more + 1)))
        for kind, own, values in kinds:
            where = bucket_of(ids[own], cells) if kind == KNOWN else cell[own]
            out += [(c, kind, mark[own[part]].tobytes(), values[own[part]].tobytes()) for c, part in by_cell(where)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int8(), pa.binary(), pa.binary()), strict=True)], ["cell", "kind", "marks", "ids"])

    def second(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        marks, ids = ([np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("marks", np.uint32), ("ids", np.int64)))
        take = lambda parts, which: np.concatenate([p for p, k in zip(parts, kinds, strict=True) if k == which] or [parts[0][:0]])
        mark, who = take(marks, FRESH), take(ids, FRESH)
        names, place, n = np.unique(mark, return_inverse=True, return_counts=True)
        again = n[place] > 1 if len(mark) else np.zeros(0, bool)
        back = dealt_back(np.concatenate([take(ids, KNOWN), who[again]]), np.concatenate([take(marks, KNOWN), mark[again]]), cells)
        np.add.at(n, np.searchsorted(names, take(marks, MORE)), take(ids, MORE))  # all of these came fresh, too
        full = np.flatnonzero(n >= plan.crowd)
        if not len(full):
            return back
        counted = np.zeros(len(full), COUNTED)
        counted["mark"], counted["docs"] = names[full], n[full]
        bucket = cells + table.column("cell")[0].as_py()
        return pa.concat_tables([back, pa.table({"bucket": pa.array([bucket], pa.int32()), "ids": pa.array([b""], pa.binary()), "packed": pa.array([counted.tobytes()], pa.binary())})])

    packed = docs.mapInArrow(pack, "cell int, kind byte, marks binary, ids binary")
    return by_document(packed.repartitionById(cells, "cell").groupBy("cell").applyInArrow(second, "bucket int, ids binary, packed binary"), "marks", cells)


def _joined(parts: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of byte strings, and how many each row has."""
    rows = parts.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) // np.dtype(kind).itemsize for r in rows], np.int64)


def repeated(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, spans): runs of repeated windows as pairs of int32 (first unit, windows), in bytes.

    plan.compare(contents, windows, key, least) gets the distinct stretches of a partition whose anchor another stretch
    shares: their bytes, number of windows, anchor and smallest document id, all in order of (anchor, id). It returns
    (stretch, first window, windows) arrays of those windows that a stretch with a smaller id holds as well.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    buckets, cells = cells_for(spark, size), cells_for(spark, size, 8 << 20)
    marks = written(shared_anchors(texts, plan, buckets), "repeat-marks")
    anchors = hot_marks(marks, plan)
    frequent = spark.sparkContext.broadcast((anchors, *hot_windows(texts, plan, anchors)))
    release(spark)
    both = texts.join(marks, "doc_id")

    def deal(batches):
        hot_anchors, hot_hashes, hot_least, hot_contents = frequent.value
        waiting = []
        for batch in batches:
            for block, ids, units, s in _parts(batch, plan):
                mark, count = _joined(block.column("marks"), np.uint32)
                key = (np.repeat(np.arange(len(ids), dtype=np.uint64), count) << np.uint64(32)) | mark
                own = (s.text.astype(np.uint64) << np.uint64(32)) | low32(s.anchor).astype(np.uint32)
                take = np.isin(own, key)
                text, start, windows, anchor = s.text[take], s.start[take], s.windows[take], s.anchor[take]
                data = units.data.tobytes()
                single = np.isin(low32(anchor).astype(np.uint32), hot_anchors)
                at, of = single_windows(s, np.flatnonzero(take)[single])
                hashes = s.rolling.at(at, at + plan.window)
                place = np.minimum(np.searchsorted(hot_hashes, hashes), max(0, len(hot_hashes) - 1))
                sure = (hot_hashes[place] == hashes) & (hot_least[place] < ids[of]) if len(hot_hashes) else np.zeros(len(at), bool)
                alike = np.flatnonzero(sure)
                begin, end = units.begin[at[alike]].tolist(), units.end[at[alike] + plan.window - 1].tolist()
                sure[alike] = np.array([data[a:b] == hot_contents[p] for a, b, p in zip(begin, end, place[alike].tolist(), strict=True)], bool)
                # certain windows go on as runs of their document, without content
                where, who = at[sure] - units.starts[of[sure]], of[sure]
                cut = np.flatnonzero(np.append(True, (where[1:] != where[:-1] + 1) | (who[1:] != who[:-1]))) if len(where) else np.zeros(0, np.int64)
                runs = np.diff(np.append(cut, len(where)))
                texts_ = np.concatenate([text[~single], of[~sure], who[cut]])
                starts_ = np.concatenate([start[~single], at[~sure], where[cut] + units.starts[who[cut]]])
                windows_ = np.concatenate([windows[~single], np.ones((~sure).sum(), np.int64), runs])
                keys_ = np.concatenate([anchor[~single], hashes[~sure], ids[who[cut]].astype(np.uint64)])
                rest = len(texts_) - len(cut)
                begin, end = units.begin[starts_[:rest]], units.end[starts_[:rest] + windows_[:rest] + plan.window - 2]
                content = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)] + [None] * len(cut)
                part = [keys_.view(np.int64), ids[texts_], (starts_ - units.starts[texts_]).astype(np.int32), windows_.astype(np.int32)]
                waiting.append(pa.RecordBatch.from_arrays([*map(pa.array, part), pa.array(content, pa.binary())], schema=DEALT))
                if sum(map(len, waiting)) >= STRETCHES_TOGETHER:
                    yield from packed_stretches(waiting)
                    waiting = []
        yield from packed_stretches(waiting)

    def packed_stretches(waiting):
        """One compressed row a cell, however many stretches."""
        if not waiting:
            return
        table = pa.Table.from_batches(waiting).combine_chunks()
        key, doc, content = table.column("key").to_numpy().copy(), table.column("doc_id").to_numpy(), table.column("content")
        code = content.combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy().astype(np.int64)
        least = np.full(code.max(initial=-1) + 2, np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        again = (code >= 0) & (doc > least[code])
        key[again] = doc[again]
        content = pc.if_else(pa.array(again), pa.scalar(None, pa.binary()), content)
        table = table.set_column(0, "key", pa.array(key)).set_column(4, "content", content)
        out = []
        for c, at in by_cell((mix(key.view(np.uint64)) % np.uint64(cells)).astype(np.int32)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, DEALT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(table.take(pa.array(at)).cast(DEALT))
            out.append((c, sink.getvalue().to_pybytes()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["cell", "packed"])

    def decide(packed: pa.Table) -> pa.Table:
        table = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in packed.column("packed").to_pylist()]).combine_chunks()
        doc, start, windows = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "start", "windows"))
        content = table.column("content")
        sure = np.asarray(content.is_null())
        spans = [(doc[sure], start[sure], windows[sure])]
        if not sure.all():
            doc, start, windows, key = doc[~sure], start[~sure], windows[~sure], table.column("key").to_numpy()[~sure]
            coded = content.filter(pa.array(~sure)).combine_chunks().dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            code, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            least = np.full(kinds, np.iinfo(np.int64).max)
            np.minimum.at(least, code, doc)
            again = doc > least[code]
            spans.append((doc[again], start[again], windows[again]))
            first = np.zeros(kinds, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            its_key, its_windows = key[first], windows[first]
            order = np.lexsort((least, its_key))
            k = its_key[order]
            shared = np.zeros(len(k), bool)
            shared[1:] |= k[1:] == k[:-1]
            shared[:-1] |= k[1:] == k[:-1]
            order = order[shared]
            if len(order):
                contents = coded.dictionary.take(pa.array(order)).to_pylist()
                which, offset, count = plan.compare(contents, its_windows[order], its_key[order], least[order])
                if len(which):
                    # a stretch's first document may hold it at several places
                    rows = np.flatnonzero(doc == least[code])
                    by = np.argsort(code[rows], kind="stable")
                    rows, sorted_code = rows[by], code[rows][by]
                    lo, hi = np.searchsorted(sorted_code, order[which]), np.searchsorted(sorted_code, order[which], "right")
                    n = hi - lo
                    at = rows[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    spans.append((doc[at], start[at] + np.repeat(offset, n), np.repeat(count, n)))
        doc, start, windows = (np.concatenate(x) for x in zip(*spans, strict=True))
        return dealt_back(doc, np.stack([start, windows], 1).astype(np.int32), buckets)

    decided = both.mapInArrow(deal, "cell int, packed binary").repartitionById(cells, "cell").groupBy("cell").applyInArrow(decide, "bucket int, ids binary, packed binary")
    spans = written(by_document(decided, "spans", buckets), "repeat-spans")
    discard(marks)
    release(spark)
    return spans


def covered(spans: bytes | None, window: int, units: int) -> np.ndarray:
    """Which units of a text its repeated windows cover."""
    edge = np.zeros(units + 1, np.int32)
    if spans:
        pairs = np.frombuffer(spans, np.int32).reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, np.minimum(units, pairs[:, 0] + pairs[:, 1] + window - 1), -1)
    return np.cumsum(edge[:-1]) > 0
