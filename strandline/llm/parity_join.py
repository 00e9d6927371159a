"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles, hashed to 64 bits. With sizes a and b, a similarity of 0.75 or more means
that at most D = (a + b) / 7 shingles are in one set only.

Parity sketches. Hash the shingles to K parts and XOR the hashes of each part. A shingle that only one set has changes the
parity of one part, so the number of differing parts, as the Hamming distance of two sketches, is at most D. Documents
are joined by size band with one K a band (a document near a band's upper end joins the next band as well). K is so large
that each document fills over 2 n / 7 parts: then, by the pigeonhole principle, a similar pair agrees on a filled part.
It even agrees on one among the first n / 3 + 1 in any common order of (part, XOR) values, so only those become join
keys. The order puts parts with shingles that are frequent in a sample last and parts with several shingles first. Under
``SMALL`` shingles each is a part of its own. A document that fills too few parts is noticed, and all are hashed anew.

Candidates. Keys meet by value in cells, whose number follows the data. Within a key the smallest id is paired with each
other one (a star, never all pairs), for which each document's LOW_KEYS lowest keys are enough; a batch that sees a key
twice makes its own star and sends one entry on. Pairs are checked by size and by the Hamming distance of parity sketches
of about two bits a shingle, then by the shingles of both whole texts. Verified links give components. Copies with equal
sets are linked by a hash of the set, and one of each group goes on.

Where a key still holds members of several components, each component's nearest pair is verified, round by round while
this joins any: pairs grow with the components, not with the square of a group. A key in which no pair can link leaves
after the first round. In the end every pair across components that is left is verified, so no link is lost.

Components come from alternating large-star and small-star steps, each written to the shared folder.

Defined results: null and wordless texts have no shingles and are linked with nothing; a text of under five words is one
shingle; rows with a null id link with nothing and have a null component; rows that share a doc_id are one document in
links, and each gives a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_cell, cells_for, discard, release, small, some_rows, utf8, written
from .repeats import Rolling, Units, bucket_of, mix

WORDS = 5
#: Sets of fewer shingles are joined shingle by shingle; the first band, and each band's upper over its lower end.
SMALL, RATIO, PARTS_PER_SHINGLE = 64, 4, 0.45
SKETCH_BITS = 1024
#: Of each document's keys, in order of value, those that make stars, and those that tell where a pair is to be reported.
LOW_KEYS = 6
HOT_DOCS, SAMPLE_DOCS, HOT_SHINGLES, HOT_BITS = 6, 3_000, 100_000, 22
#: One in so many documents is in the sample, if that is more: what is frequent is then a number of documents and not a share of them,
#: as pairs of a key's members grow with its square.
SAMPLE_EACH = 80
#: Members of a key that are compared each with each other at once, without looking for nearest pairs first.
FEW = 16
#: Nearest pairs are looked for round by round while one joins more than so many components.
JOINS = 1_000
#: Rows of nearest pairs that a cell gathers before it keeps each component's first.
GATHERED = 1 << 19
#: Members of a key that are compared in one task, about.
HOT_MEMBERS = 8_192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(block: pa.RecordBatch, column: str = "text", words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle of each text, in order of (row, hash)."""
    data, starts = utf8(block.column(column))
    units = Units.of_words(_LOWER[data], starts)
    lengths, n = np.diff(units.starts), len(units.values)
    rolling = Rolling(units.values)
    whole = rolling.each(words)
    row = np.repeat(np.arange(len(lengths)), lengths)
    inside = row[: len(whole)] == row[words - 1 :] if n >= words else np.zeros(0, bool)
    short = np.flatnonzero((lengths > 0) & (lengths < words))
    rows = np.concatenate([row[: len(whole)][inside], short])
    hashes = np.concatenate([whole[inside], rolling.at(units.starts[short], units.starts[short + 1]) + np.uint64(1)])
    order = _ordered(rows, hashes)
    rows, hashes = rows[order], hashes[order]
    fresh = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])) if len(rows) else np.zeros(0, bool)
    return rows[fresh], hashes[fresh]


def _ordered(row: np.ndarray, value: np.ndarray, first: np.ndarray | None = None, bits: int = 0) -> np.ndarray:
    """Where values stand in order of (row, first, value); first: numbers of so many bits. One sort, of numbers made of row, first and
    the value's first bits, unless different values agree in these."""
    of_row = int(row.max(initial=0)).bit_length()
    left = 64 - of_row - bits
    if left >= 32:
        number = value >> np.uint64(64 - left)
        if of_row:
            number |= row.astype(np.uint64) << np.uint64(64 - of_row)
        if first is not None:
            number |= first.astype(np.uint64) << np.uint64(left)
        order = np.argsort(number)
        number, there = number[order], value[order]
        if not ((number[1:] == number[:-1]) & (there[1:] != there[:-1])).any():
            return order
    return np.lexsort((value, row) if first is None else (value, first, row))


def _band(n: np.ndarray) -> np.ndarray:
    """0 under SMALL, then 1, 2, ... for sizes from SMALL, SMALL * RATIO, ..."""
    band = np.zeros(len(n), np.int64)
    edge = SMALL
    while (n >= edge).any():
        band[n >= edge] += 1
        edge *= RATIO
    return band


def _upper(band: np.ndarray) -> np.ndarray:
    return SMALL * RATIO**band


def parts(row: np.ndarray, t: np.ndarray, band: np.ndarray, seed: int, hot: np.ndarray | None):
    """The filled parts of each row in its band's sketch: (row, value, shingles, whether one of them is hot), by row."""
    k = np.ceil(PARTS_PER_SHINGLE * _upper(band)).astype(np.uint64)[row]
    place = mix(t + np.uint64(seed)) % np.maximum(k, np.uint64(1))
    place = np.where(band[row] == 0, mix(t), place)
    # places come first in their numbers' bits: those of sketches are small
    spread = np.uint64(64 - int(k.max(initial=np.uint64(1))).bit_length())
    order = _ordered(row, np.where(band[row] == 0, place, place << spread))
    row, place, t = row[order], place[order], t[order]
    if not len(row):
        return row, t, row, np.zeros(0, bool)
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])))
    value = np.bitwise_xor.reduceat(mix(t ^ np.uint64(0x5851F42D4C957F2D)), cut)
    count = np.diff(np.append(cut, len(row)))
    known = np.logical_or.reduceat(hot[(t >> np.uint64(64 - HOT_BITS)).astype(np.int64)], cut) if hot is not None else np.zeros(len(cut), bool)
    row = row[cut]
    return row, mix(value ^ mix(place[cut] * np.uint64(64) + band[row].astype(np.uint64))), count, known


def too_few_parts(row: np.ndarray, t: np.ndarray, sizes: np.ndarray, seed: int, filled: tuple | None = None) -> np.ndarray:
    """Which rows fill so few parts of their band's sketch that a similar one may agree on none. filled: ``parts`` of their own bands, if known."""
    band = _band(sizes)
    return (band > 0) & (np.bincount((filled or parts(row, t, band, seed, None))[0], minlength=len(sizes)) < 2 * sizes // 7 + 1)


def join_keys(row: np.ndarray, t: np.ndarray, sizes: np.ndarray, seed: int, hot: np.ndarray, filled: tuple | None = None):
    """(row, key) that every row joins by. filled: ``parts`` of the rows' own bands, if known."""
    own = _band(sizes)
    rows, keys = [], []
    up = (sizes > 0) & (4 * sizes >= 3 * _upper(own))
    for more in (False, True):
        use = up if more else sizes > 0
        band = own + more
        pick = use[row]
        r, key, count, known = filled if filled and not more else parts(row[pick], t[pick], band, seed, hot)
        order = _ordered(r, key, known * 256 + 255 - np.minimum(count, 255), 9)
        r, key = r[order], key[order]
        first = np.searchsorted(r, np.arange(len(sizes)))
        rank = np.arange(len(r)) - first[r]
        limit = np.where(band == 0, sizes - -(-3 * sizes // 4) + 1, sizes // 3 + 1)
        rows.append(r[rank < limit[r]])
        keys.append(key[rank < limit[r]])
    return np.concatenate(rows), np.concatenate(keys)


def _sketches(row: np.ndarray, t: np.ndarray, n: int) -> list[bytes]:
    """Parity of each row's shingles in each of its sketch's bits. A sketch has 2 bits a shingle, rounded up to a power of
    two, and SKETCH_BITS at least: with too few, sketches of long documents look alike."""
    sizes = np.bincount(row, minlength=n)
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    place, out = mix(t + np.uint64(11)), [b""] * n
    for width in np.unique(bits):
        own = np.flatnonzero(bits == width)
        number = np.full(n, -1)
        number[own] = np.arange(len(own))
        take = number[row] >= 0
        at = number[row[take]] * width + (place[take] & np.uint64(width - 1)).astype(np.int64)
        packed = np.packbits((np.bincount(at, minlength=len(own) * width) & 1).astype(np.uint8).reshape(len(own), width), axis=1)
        for i, sketch in zip(own, packed, strict=True):
            out[i] = sketch.tobytes()
    return out


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) with fewer bits: halves laid over each other."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _short(sketch: bytes) -> bytes:
    return _folded(np.frombuffer(sketch, np.uint64)[None], SKETCH_BITS // 64).tobytes()


def _sets(row: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Two hashes of each row's set."""
    out = np.zeros((n, 2), np.uint64)
    for k, salt in enumerate((1, 2)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(t + np.uint64(salt)), dtype=np.uint64)])
        edge = np.searchsorted(row, np.arange(n + 1))
        out[:, k] = sums[edge[1:]] - sums[edge[:-1]]
    return out


def hot_shingles(texts: DataFrame) -> np.ndarray:
    """A bit map over the first HOT_BITS bits of shingle hashes, set for at most HOT_SHINGLES that several of a sample's documents
    hold (about SAMPLE_DOCS, or one in SAMPLE_EACH). It only decides the order of keys, so a wrong bit does no harm."""

    def seen(batches):
        for batch in batches:
            for block in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(block)[1].view(np.int64))], ["t"])

    often = some_rows(texts, SAMPLE_DOCS, SAMPLE_EACH).select("text").mapInArrow(seen, "t long").groupBy("t").count().where(F.col("count") >= HOT_DOCS)
    top = often.orderBy(F.desc("count"), "t").limit(HOT_SHINGLES).select("t").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    bits = np.zeros(1 << HOT_BITS, bool)
    bits[(top >> np.uint64(64 - HOT_BITS)).astype(np.int64)] = True
    return bits


def _blocks_of(batch: pa.RecordBatch):
    for block in blocks(batch, "text"):
        row, t = shingles(block)
        yield np.asarray(block.column("doc_id")), row, t, np.bincount(row, minlength=len(block))


def described(texts: DataFrame, seed: int, hot) -> DataFrame:
    """doc_id, n (shingles), two hashes of the set, its sketch as a whole and folded, whether it fills too few parts, and its join keys (bytes, in order)."""

    def describe(batches):
        for batch in batches:
            for ids, row, t, sizes in _blocks_of(batch):
                n = len(ids)
                both, sketches = _sets(row, t, n), _sketches(row, t, n)
                filled = parts(row, t, _band(sizes), seed, hot.value)
                weak = too_few_parts(row, t, sizes, seed, filled)
                r, key = join_keys(row, t, sizes, seed, hot.value, filled)
                order = _ordered(r, key)
                edges, key = np.searchsorted(r[order], np.arange(n + 1)) * 8, key[order].tobytes()
                keys = [key[edges[i] : edges[i + 1]] for i in range(n)]
                columns = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)), pa.array(sketches, pa.binary()), pa.array([_short(s) for s in sketches], pa.binary()), pa.array(weak), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_a", "set_b", "sketch", "short", "weak", "keys"])

    return texts.mapInArrow(describe, "doc_id long, n long, set_a long, set_b long, sketch binary, short binary, weak boolean, keys binary")


def stars(about: DataFrame) -> DataFrame:
    """Per cell: the keys of at least two documents with their documents (keys, ids), and the pairs of each key's star (a, b)."""
    cells = cells_for(about.sparkSession, (about.agg(F.sum(F.col("n") / 3 + 1)).first()[0] or 0) * 16)

    def star(key, ids, low):
        """Entries by key, low ones first, then by id: which are a key's first, which have company, and the distinct pairs
        of a key's first and its other low entries."""
        order = np.argsort(key)
        there = key[order]
        more = np.zeros(len(key), bool)  # only keys that come several times have an order of their own
        more[1:] = there[1:] == there[:-1]
        more[:-1] |= more[1:]
        several = order[more]
        order[more] = several[np.lexsort((ids[several], ~low[several], key[several]))]
        key, ids, low = key[order], ids[order], low[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])) if len(key) else np.zeros(0, bool)
        key, ids, low = key[fresh], ids[fresh], low[fresh]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        head = ids[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else ids
        many = ~first
        many[:-1] |= ~first[1:]
        pairs = np.unique(np.stack([head, ids], 1)[low & ~first], axis=0)
        return key, ids, low, first, many, pairs

    def pack(batches):
        for batch in batches:
            ids, n, a, b = (np.asarray(batch.column(c)) for c in ("doc_id", "n", "set_a", "set_b"))
            order = np.lexsort((ids, b, a))
            order = order[n[order] > 0]
            if not len(order):
                continue
            # of the batch's copies the smallest id goes on
            lead = order[np.append(True, (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))]
            own = batch.column("keys").take(pa.array(lead)).to_pylist()
            count = np.array([len(k) // 8 for k in own])
            key = np.frombuffer(b"".join(own), np.uint64)
            low = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count) < LOW_KEYS
            key, ids, low, first, many, pairs = star(key, np.repeat(ids[lead], count), low)
            out = [(int(bucket_of(ids[many][:1], cells)[0]), key[many].tobytes(), ids[many].tobytes(), b"", pairs.tobytes(), False)] if many.any() else []
            key, ids, low = key[first], ids[first], low[first]
            out += [(c, key[at].tobytes(), ids[at].tobytes(), low[at].tobytes(), b"", True) for c, at in by_cell((mix(key) % np.uint64(cells)).astype(np.int64))]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), *[pa.binary()] * 4, pa.bool_()), strict=True)], ["cell", "keys", "ids", "low", "pairs", "open"])

    def meet(table: pa.Table) -> pa.Table:
        still = np.array(table.column("open").to_pylist(), bool)
        met = table.filter(pa.array(still))
        key, ids, low = (np.frombuffer(b"".join(met.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("ids", np.int64), ("low", bool)))
        key, ids, _, _, many, pairs = star(key, ids, low)
        columns = ("keys", "ids", "pairs")
        own = pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(columns, (key[many], ids[many], pairs), strict=True)})
        return pa.concat_tables([table.filter(pa.array(~still)).select(columns), own])

    packed = about.select("doc_id", "n", "set_a", "set_b", "keys").mapInArrow(pack, "cell int, keys binary, ids binary, low binary, pairs binary, open boolean")
    return packed.repartitionById(cells, "cell").groupBy("cell").applyInArrow(meet, "keys binary, ids binary, pairs binary")


def _unpacked(found: DataFrame, *columns: str) -> DataFrame:
    """Rows of two long values from packed columns: ("pairs",) or ("keys", "ids")."""

    def unpack(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                both = np.frombuffer(row[0], np.int64).reshape(-1, 2).T if len(row) == 1 else [np.frombuffer(x, np.int64) for x in row]
                for i in range(0, len(both[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 18)]) for x in both], ["a", "b"])

    return found.select(*columns).mapInArrow(unpack, "a long, b long")


def possible(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow, and whether their sets are equal."""
    side = lambda x: about.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("set_a").alias(f"s_{x}"), F.col("set_b").alias(f"r_{x}"), F.col("sketch").alias(f"k_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where("4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a")
    return both.withColumn("d", F.arrow_udf(_distance, "long")("k_a", "k_b")).where(F.col("d") <= F.floor((F.col("n_a") + F.col("n_b")) / 7)).select("a", "b", ((F.col("s_a") == F.col("s_b")) & (F.col("r_a") == F.col("r_b"))).alias("equal"))


def _distance(x: pa.Array, y: pa.Array) -> pa.Array:
    """Hamming distances, of the wider sketch folded to the width of the other."""
    x, y, by = x.to_pylist(), y.to_pylist(), {}
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        by.setdefault((len(a), len(b)), []).append(i)
    out = np.zeros(len(x), np.int64)
    for (a, b), own in by.items():
        left, right = (np.frombuffer(b"".join(side[i] for i in own), np.uint64).reshape(len(own), -1) for side in (x, y))
        words = min(a, b) // 8
        out[own] = np.bitwise_count(_folded(left, words) ^ _folded(right, words)).sum(1, dtype=np.int64)
    return pa.array(out)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets have 100 * intersection >= 75 * union."""

    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        both = pa.RecordBatch.from_arrays([x, y], ["text", "other"])
        for block in blocks(both, "text"):
            (r, t), (s, u) = shingles(block), shingles(block, "other")
            n = len(block)
            a, b = np.bincount(r, minlength=n), np.bincount(s, minlength=n)
            row, hashes = np.concatenate([r, s]), np.concatenate([t, u])
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            twice = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
            common = np.bincount(row[1:][twice], minlength=n)
            out.append((100 * common >= 75 * (a + b - common)) & (common > 0))
        return pa.array(np.concatenate([*out, np.zeros(0, bool)]))

    asked = pairs.where(~F.col("equal"))
    ids = written(asked.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")
    own = texts.join(small(ids, F.lit(16)), "doc_id", "left_semi")  # so that other texts don't travel
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}"))
    check = asked.join(side("b"), "b").join(side("a"), "a")
    found = check.where(F.arrow_udf(similar, "boolean")("t_a", "t_b")).select("a", "b").distinct()
    return pairs.where("equal").select("a", "b").unionByName(found)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of edges (a, b) reaches, for ids that aren't roots themselves."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, written(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
        after = mark(now)
        if after == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) after links (a, b) between components. Only the roots that are linked are looked at."""
    side = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"r_{x}"))
    edges = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
    new = components(edges)
    moved = roots.join(new.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return written(moved.unionByName(new), "roots")


def still_split(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, root), written, of the keys with members (key, id) of several components. A key of over HOT_MEMBERS members is hot
    and cut into blocks of a third as many; every two blocks make a key of their own, which is never cut again. Members of
    hot keys are told by a broadcast of these keys (64 MB at most; a key has HOT_MEMBERS members, so there are few), so that
    no task holds a whole hot key."""
    now = members.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    counts = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"))
    blocks_of = F.when(F.col("n") > HOT_MEMBERS, F.ceil(3 * F.col("n") / HOT_MEMBERS).cast("int"))
    counts = written(counts.select("key", (F.col("x") != F.col("y")).alias("split"), blocks_of.alias("blocks")).where("split or blocks is not null"), "key-counts")
    hot = small(counts.where("blocks is not null"), F.lit(40))
    told = now.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.xxhash64("key", F.least(own, other), F.greatest(own, other)))
    cut = told.where("split").select(F.explode(pairs).alias("key"), "id", "root")
    rest = told.where("blocks is null").select("key", "id", "root").join(counts.where("blocks is null").select("key"), "key")
    out = written(rest.unionByName(cut), "members")
    discard(counts)
    return out


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """Of rows with the same first value, the smallest."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.append(True, rows[1:, 0] != rows[:-1, 0])] if len(rows) else rows


def across(members: DataFrame, about: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of members (key, id, root) of one key and different roots that sizes and folded sketches allow.

    A cell has many keys. Its members stand in order of (key, size), and each is compared with the next, the one after
    that and so on, all keys at once, until sizes differ too much or the key ends. With nearest, a cell only sends each
    component's pair of smallest distance (root, d, a, b), and the keys that have any (key).
    """
    cells = cells_for(members.sparkSession, members.count() * (SKETCH_BITS // 8 + 64))

    def compare(table: pa.Table) -> pa.Table:
        key, n, ids, root = (table.column(c).to_numpy() for c in ("key", "n", "id", "root"))
        sketch = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint64).reshape(len(n), SKETCH_BITS // 64)
        order = np.lexsort((ids, n, key))
        key, n, ids, root = key[order], n[order], ids[order], root[order]
        if not nearest:
            low = table.column("low").to_pylist()
            lowest = np.full((len(n), LOW_KEYS), np.iinfo(np.int64).max)
            for i, j in enumerate(order):
                lowest[i, : len(low[j])] = low[j]
        pairs, opened, at, ahead = [np.zeros((0, 2), np.int64)], np.zeros(len(n), bool), np.arange(len(n)), 0
        best, gathered = [np.zeros((0, 4), np.int64)], 0  # the first of each component, and what has come since
        while len(at):
            ahead += 1
            at = at[at + ahead < len(n)]
            at = at[(key[at] == key[at + ahead]) & (3 * n[at + ahead] <= 4 * n[at])]
            apart = at[root[at] != root[at + ahead]]
            for i in range(0, len(apart), 1 << 16):
                x = apart[i : i + (1 << 16)]
                y = x + ahead
                distance = np.bitwise_count(sketch[order[x]] ^ sketch[order[y]]).sum(1, dtype=np.int64)
                hit = distance <= (n[x] + n[y]) // 7
                x, y, distance = x[hit], y[hit], distance[hit]
                if nearest:
                    part, a, b = distance * 1000 // (n[x] + n[y]), np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                    best += [np.stack([root[z], part, a, b], 1) for z in (x, y)]
                    gathered += 2 * len(x)
                    if gathered > max(GATHERED, len(best[0])):
                        best, gathered = [_first_of_each(np.concatenate(best))], 0
                    opened[x] = True
                    continue
                # a pair with a smaller key in common, among the lowest of both, is reported there
                same = (lowest[x][:, :, None] == lowest[y][:, None, :]) & (lowest[x] < key[x][:, None])[:, :, None]
                once = ~same.any((1, 2))
                x, y = ids[x[once]], ids[y[once]]
                pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        if not nearest:
            found = np.unique(np.concatenate(pairs), axis=0)
            return pa.table({"a": found[:, 0], "b": found[:, 1]})
        best, opened = _first_of_each(np.concatenate(best)), np.unique(key[opened])
        columns = [np.concatenate([c, np.zeros(len(opened), np.int64)]) for c in best.T]
        return pa.table(dict(zip(("root", "d", "a", "b"), columns, strict=True)) | {"key": pa.array(np.concatenate([np.zeros(len(best), np.int64), opened]), mask=np.arange(len(best) + len(opened)) < len(best))})

    sized = members.join(about.select(F.col("doc_id").alias("id"), "n", "short"), "id")
    if not nearest:
        sized = sized.join(members.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LOW_KEYS).alias("low")), "id")
    dealt = sized.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")).repartitionById(cells, "cell").groupBy("cell")
    return dealt.applyInArrow(compare, "root long, d long, a long, b long, key long") if nearest else dealt.applyInArrow(compare, "a long, b long").distinct()


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hot = spark.sparkContext.broadcast(hot_shingles(texts))
    seed = 1
    while True:
        about = written(described(texts, seed, hot), "sets")
        if about.where("weak").isEmpty():
            break
        discard(about)
        seed += 1
    sets = about.where("n > 0").drop("keys", "weak").dropDuplicates(["doc_id"])
    found = written(stars(about), "stars")
    release(spark)
    pairs = written(possible(_unpacked(found, "pairs").distinct(), sets), "pairs")
    copies = sets.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = written(copies, "copied-sets")  # a row a group; a group of any size stays where its members are
    copies = written(sets.join(small(groups, F.lit(64)), ["set_a", "set_b", "n"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")), "copies")
    roots = components(verified(pairs, texts).unionByName(copies))
    release(spark)

    held = _unpacked(found, "keys", "ids").select(F.col("a").alias("key"), F.col("b").alias("id"))
    members = still_split(held.join(copies, held["id"] == copies["b"], "left_anti").distinct(), roots)
    discard(found, pairs)
    release(spark)
    # In keys of many members each component's nearest pair joins it to another; such keys without any pair that may link are left
    # alone. Components of a group all of whose pairs link are at least halved, so as many as were joined are left of such groups at most.
    sizes = members.groupBy("key").count().where(F.col("count") > FEW).select("key")
    crowded, joins, before = written(members.join(sizes, "key"), "crowded"), JOINS + 1, roots
    while joins > JOINS and not crowded.isEmpty():
        near = written(across(crowded, sets, True), "nearest")
        least = near.where("key is null").groupBy("root").agg(F.min(F.struct("d", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        links = written(verified(written(possible(least, sets), "pairs"), texts), "links")
        joins = links.count()
        if joins:
            roots = joined(roots, links)
            last, crowded = crowded, still_split(crowded.join(near.where("key is not null").select("key").distinct(), "key"), roots)
            discard(last, near)
        release(spark)
    if roots is not before:
        last, members = members, still_split(members, roots)
        discard(last)
    # then every pair that is left
    if not members.isEmpty():
        rest = written(possible(across(members, sets, False), sets), "pairs")
        if not rest.isEmpty():
            roots = joined(roots, verified(rest, texts))
        release(spark)
    counted = rows.where("text is null").select("doc_id", F.lit(0).cast("long").alias("n")).unionByName(rows.where("doc_id is null and text is not null").mapInArrow(_count, "doc_id long, n long")).unionByName(about.select("doc_id", "n"))
    return counted.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _count(batches):
    for batch in batches:
        for block in blocks(batch, "text"):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.bincount(shingles(block)[0], minlength=len(block)))], ["doc_id", "n"])
