"""The local-alignment scorer: Smith-Waterman with affine gaps, score only, exact.

With open + extend as the cost of a gap's first residue (oe) and extend (e) of each further one, and zero outside:

    H[i,j] = max(0, H[i-1,j-1] + M[a_i, b_j], E[i,j], F[i,j])
    E[i,j+1] = max(E[i,j] - e, H[i,j] - oe)      F[i+1,j] = max(F[i,j] - e, H[i,j] - oe)

A row of the query is done at once for a batch of sequences, one a lane, padded to equal length. Leaving E out of the H that
opens a gap is exact because oe >= e: opening a gap right behind a gap never beats extending it. So E is a running maximum
along the row of H' (H without E), and in a tilted frame, where j e is added to all values of column j, it is that maximum
less a constant.

A running maximum is the one step that arrays do a cell at a time. So columns are striped: SEGMENT neighbours of a lane lie
in as many rows of a matrix, one below the other, and the maximum runs down these rows, all segments of all lanes at once;
only the segments' own maxima, an eighth of the cells, are run through in order.

A batch whose sequences are no wider than a tile is done in unsigned bytes first (``_Whole``), which move half as much memory
and take eight times the lanes a call. Lanes whose scores bytes can't hold are done again in 16 bits, these again in tiles.

Columns come in tiles. A tile hands on, for each row of the query, H and the running maximum of its last column, and the
next tile goes on from there. So a sequence of any length is worked on in rows that stay in the cache, and in 16 bits.
"""

from __future__ import annotations

import numpy as np

from .alphabet import SIZE

#: Cells that a batch's working rows hold at most (lanes x padded length); a longer sequence is a batch of its own, in tiles.
BATCH_CELLS = 1 << 15
#: Columns of a segment.
SEGMENT = 8
#: Values of 16 bits stay under this, and tiles have so many columns at least.
SHORT, LEAST_TILE = 30_000, 512
#: Rows after which a batch looks whether it can stop, once what is left of the query can't reach the score asked for by itself.
LOOK = 4
#: A batch in bytes takes so many times the cells; the least score that a type must hold to be tried; rows after which a batch
#: looks whether all its lanes have left the type.
WIDE, LEAST_SCORE, FULL = 8, 64, 16
#: Padding of such a batch, in batches of the usual size: about what a batch costs besides its cells.
PADDING = 2
#: Bytes that tiles of a batch hand on at most, all queries together that are worked on at a time.
HANDED_ON = 64 << 20


def batches(lengths: np.ndarray, cells: int = BATCH_CELLS, wide: int = 1):
    """Slices of sequences that come in order of length, each padding to the length of its last. Sequences no wider than a tile are
    up to ``wide`` times as many, as long as their padding costs no more than another batch would."""
    begin, upto = 0, np.append(0, np.cumsum(lengths, dtype=np.int64))
    for end in range(1, len(lengths) + 1):
        if end < len(lengths):
            longest = int(lengths[end])
            padding = (end + 1 - begin) * longest - int(upto[end + 1] - upto[begin])
            room = wide * cells if longest <= cells and padding <= PADDING * cells else cells
        if end == len(lengths) or (end + 1 - begin) * longest > room:
            yield slice(begin, end)
            begin = end


def padded(codes: list[bytes]) -> np.ndarray:
    """Encoded sequences (bytes of code + 1) as rows of codes of equal length."""
    width = max(map(len, codes), default=0)
    return np.frombuffer(b"".join(c.ljust(width, bytes([SIZE])) for c in codes), np.uint8).reshape(len(codes), width) - 1


def best_possible(query: bytes, matrix: np.ndarray) -> np.ndarray:
    """What the residues from each place of the query on can add to a score at most (one more entry than residues: 0)."""
    gain = np.maximum(matrix.max(axis=1), 0)[np.frombuffer(query, np.uint8) - 1]
    return np.append(np.cumsum(gain[::-1])[::-1], 0)


def reach(query_length: int, matrix: np.ndarray, gap_open: int, gap_extend: int) -> int | None:
    """Columns that an alignment of a positive score spans at most: a gap of more columns costs more than all residues of
    the query can gain. None: no bound, as extending a gap is free."""
    gain = query_length * max(0, int(matrix.max()))
    if gain <= gap_open:
        return query_length
    return query_length + (gain - gap_open) // gap_extend if gap_extend else None


def counts(lanes: np.ndarray) -> np.ndarray:
    """How often each code occurs in each lane."""
    at = lanes.astype(np.int64) + SIZE * np.arange(len(lanes))[:, None]
    return np.bincount(at.reshape(-1), minlength=SIZE * len(lanes)).reshape(len(lanes), SIZE)


def bounds(query: bytes, residues: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Scores that no lane with so many residues of each code (``counts``) can pass: every residue of one side meets one of the other at most."""
    own = np.bincount(np.frombuffer(query, np.uint8) - 1, minlength=SIZE)
    there = residues > 0
    # what each residue of the query gains with the best residue that the lane has, and the other way round
    rows = np.maximum(np.where(there[:, None, :], matrix[None, :, :], 0).max(axis=2), 0) @ own
    columns = residues @ np.maximum(matrix[own > 0].max(axis=0, initial=0), 0)
    return np.minimum(rows, columns)


class Batch:
    """Sequences (rows of codes, of equal length) that queries are scored against."""

    def __init__(self, lanes: np.ndarray, matrix: np.ndarray, gap_open: int, gap_extend: int, cells: int = BATCH_CELLS, kinds: tuple = (np.uint8, np.uint16)):
        self.lanes, self.matrix, self.cells = lanes, matrix, cells
        self.e, self.oe = gap_extend, gap_open + gap_extend
        self.kinds = tuple(k for k in kinds if _Whole.limit(matrix, self.e, self.oe, k) >= LEAST_SCORE) if lanes.shape[1] <= cells else ()
        #: Cells of the last call, and how many of them were left out as they could not change what was asked for.
        self.worked = self.skipped = 0

    def scores(self, queries: list[bytes], least: list[int] | None = None) -> np.ndarray:
        """Scores, queries by lanes. least: scores under least[q] are of no interest to query q, and any lower number may stand for them."""
        count, width = self.lanes.shape
        out = np.zeros((len(queries), count), np.int64)
        self.worked, self.skipped = count * width * sum(map(len, queries)), 0
        if not width:
            return out
        if self.kinds:
            whole = _Whole(self.lanes, self.matrix, self.e, self.oe, self.kinds[0])
            for q, query in enumerate(queries):
                if query:
                    floor = least[q] if least is not None else None
                    out[q], over, rows = whole.run(query, floor)
                    if over.any():
                        rest = Batch(self.lanes[over], self.matrix, self.oe - self.e, self.e, self.cells, self.kinds[1:])
                        out[q, over] = rest.scores([query], None if floor is None else [floor])[0]
                        self.skipped += rest.skipped
                    self.skipped += rows * width * int((~over).sum())
            return out
        for kind, members in self._kinds(queries).items():
            bound = max(int(best_possible(queries[q], self.matrix)[0]) for q in members)
            tile = self._tile(kind, bound)
            for some in self._together(queries, members, 2 * count * np.dtype(kind).itemsize):
                edge: dict = {}  # of each query, what the tile before has handed on
                for begin in range(0, width, tile):
                    own = _Tile(self.lanes[:, begin : begin + tile], self.matrix, self.e, self.oe, kind)
                    last = begin + tile >= width
                    for q in some:
                        floor = least[q] if least is not None and tile >= width else None
                        best, edge[q], rows = own.run(queries[q], edge.get(q), not last, floor)
                        np.maximum(out[q], best, out=out[q])
                        self.skipped += rows * count * width
        return out

    def _kinds(self, queries: list[bytes]) -> dict:
        """Queries by the smallest type that holds their values."""
        kinds: dict = {}
        for q, query in enumerate(queries):
            if query:
                top = int(best_possible(query, self.matrix)[0]) + 2 * self.oe
                kinds.setdefault(np.int16 if top + LEAST_TILE * self.e < SHORT else np.int32 if top + self.cells * self.e < 2**30 else np.int64, []).append(q)
        return kinds

    def _together(self, queries: list[bytes], members: list[int], size: int):
        """Queries whose tiles hand on HANDED_ON bytes at most, or one; size: bytes for each residue."""
        some, room = [], HANDED_ON
        for q in members:
            if some and room < size * len(queries[q]):
                yield some
                some, room = [], HANDED_ON
            some.append(q)
            room -= size * len(queries[q])
        yield some

    def _tile(self, kind, bound: int) -> int:
        """Columns of a tile: whole segments, as what is handed on is the last column's."""
        room = self.cells // max(1, len(self.lanes))
        room = min(room, (SHORT - bound - 2 * self.oe) // max(1, self.e)) if kind == np.int16 else room
        return max(SEGMENT, room if room >= self.lanes.shape[1] else room - room % SEGMENT)


class _Tile:
    """Columns of a batch, striped, with the working rows that all queries use in turn."""

    def __init__(self, lanes: np.ndarray, matrix: np.ndarray, e: int, oe: int, kind):
        self.count, width = lanes.shape
        self.depth = min(SEGMENT, width)
        self.across = -(-width // self.depth)
        whole = np.full((self.count, self.across * self.depth), SIZE - 1, np.uint8)
        whole[:, :width] = lanes
        self.codes = np.ascontiguousarray(whole.reshape(self.count, self.across, self.depth).transpose(2, 0, 1)).reshape(self.depth, -1)
        self.matrix, self.e, self.oe, self.kind, self.profile = matrix, e, oe, kind, {}
        shape = self.codes.shape
        at = np.arange(self.depth)[:, None] + self.depth * np.arange(self.across)[None, :]
        self.ramp = np.tile((at * e).astype(kind)[:, None, :], (1, self.count, 1)).reshape(shape)
        self.h, self.f, self.now, self.run_of, self.peak = np.empty((self.depth + 1, shape[1]), kind), *(np.empty(shape, kind) for _ in range(4))
        self.maxima = np.empty((self.count, self.across + 1), kind)

    def _gain(self, a: int) -> np.ndarray:
        if a not in self.profile:
            self.profile[a] = (self.matrix[a] + self.e).astype(self.kind)[self.codes]
        return self.profile[a]

    def run(self, query: bytes, left: tuple | None, hand_on: bool, least: int | None) -> tuple:
        """Best score of each lane within the tile; what to hand on (or None); rows left out."""
        e, oe, kind, ramp, across = self.e, self.oe, self.kind, self.ramp, self.across
        h, f, now, run_of, peak, maxima = self.h, self.f, self.now, self.run_of, self.peak, self.maxima
        edges = h[0].reshape(self.count, across), h[-1].reshape(self.count, across)
        start = run_of[0].reshape(self.count, across)
        length = across * self.depth
        h[1:] = ramp
        np.subtract(ramp, kind(oe), out=f)
        peak[:] = ramp
        h_in, g_in = left if left else (None, None)
        h_out, g_out = (np.zeros((len(query) + 1, self.count), kind), np.empty((len(query), self.count), kind)) if hand_on else (None, None)
        after = best_possible(query, self.matrix) if least is not None else None
        constant, step, cost = kind(oe - e), kind(e), kind(oe)
        for i, a in enumerate((np.frombuffer(query, np.uint8) - 1).tolist()):
            edges[0][:, 1:] = edges[1][:, :-1]
            edges[0][:, 0] = 0 if h_in is None else h_in[i]
            edges[0][:, 0] -= step  # column -1 in the tilted frame
            np.add(h[:-1], self._gain(a), out=now)
            np.maximum(now, f, out=now)
            np.maximum(now, ramp, out=now)
            maxima[:, 0] = 0 if g_in is None else g_in[i]
            maxima[:, 1:] = np.maximum.reduce(now, axis=0).reshape(self.count, across)
            if across > 1 or hand_on:
                np.maximum.accumulate(maxima, axis=1, out=maxima)
            start[:] = maxima[:, :-1]
            for t in range(1, self.depth):
                np.maximum(run_of[t - 1], now[t - 1], out=run_of[t])
            np.subtract(run_of, constant, out=run_of)
            own = h[1:]
            np.maximum(now, run_of, out=own)
            np.maximum(peak, own, out=peak)
            np.subtract(f, step, out=f)
            np.subtract(own, cost, out=now)
            np.maximum(f, now, out=f)
            if hand_on:
                h_out[i + 1] = edges[1][:, -1] - kind((length - 1) * e)
                np.maximum(maxima[:, -1] - kind(length * e), 0, out=g_out[i])
            if least and i % LOOK == LOOK - 1 and after[i + 1] < least and after[i + 1] + int((own - ramp).max()) < least and int((peak - ramp).max()) < least:
                return self._best(), None, len(query) - 1 - i
        return self._best(), (h_out, g_out) if hand_on else None, 0

    def _best(self) -> np.ndarray:
        return (self.peak - self.ramp).reshape(self.depth, self.count, self.across).max(axis=(0, 2)).astype(np.int64)


class _Whole:
    """A batch in unsigned numbers, in one tile, lanes of a segment side by side. Frames tilt within a segment only, and zero is
    ``bias``, so that no value falls below 0. A value that could pass the type's last leaves a peak of ``full`` or more in its lane,
    and no other lane's values depend on it: such lanes are reported, and are done again in a wider type.

    A gap down a column opens from H' as well: a gap along the row and one down the column behind it cost the same in the other order.
    """

    @staticmethod
    def bias(matrix: np.ndarray, e: int, oe: int) -> int:
        return max(oe + e, e - int(matrix.min()))

    @staticmethod
    def full(matrix: np.ndarray, e: int, kind) -> int:
        return int(np.iinfo(kind).max) + 1 - max(0, int(matrix.max()) + e)

    @classmethod
    def limit(cls, matrix: np.ndarray, e: int, oe: int, kind) -> int:
        """Scores up to this one are held for sure."""
        return cls.full(matrix, e, kind) - 1 - cls.bias(matrix, e, oe) - (SEGMENT - 1) * e

    def __init__(self, lanes: np.ndarray, matrix: np.ndarray, e: int, oe: int, kind):
        self.count, width = lanes.shape
        self.depth = SEGMENT
        self.across = -(-width // self.depth)
        whole = np.full((self.count, self.across * self.depth), SIZE - 1, np.uint8)
        whole[:, :width] = lanes
        self.codes = np.ascontiguousarray(whole.reshape(self.count, self.across, self.depth).transpose(2, 1, 0)).reshape(self.depth, -1)
        self.matrix, self.e, self.oe, self.kind, self.profile = matrix, e, oe, kind, {}
        self.zero, self.top = self.bias(matrix, e, oe), self.full(matrix, e, kind)
        shape = _, n = self.codes.shape
        self.floor = np.repeat((self.zero + np.arange(self.depth) * e).astype(kind)[:, None], n, axis=1)
        self.h, self.f, self.now, self.peak = np.empty((self.depth + 1, n), kind), *(np.empty(shape, kind) for _ in range(3))
        self.along = np.zeros((self.depth + 1, n), kind)  # one row down, as a gap covers the columns behind the one it opens in
        self.entry, self.spare, self.falls = np.zeros(n, kind), np.empty(n, kind), {}

    def _gain(self, a: int) -> np.ndarray:
        if a not in self.profile:
            self.profile[a] = (self.matrix[a] + self.e).astype(self.kind)[self.codes]  # sums wrap, and come out right
        return self.profile[a]

    def run(self, query: bytes, least: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Best score of each lane; lanes that the type doesn't hold; rows left out."""
        h, f, now, peak, floor, kind = self.h, self.f, self.now, self.peak, self.floor, self.kind
        count = self.count
        own, opened = h[1:], self.along[1:]
        # the best gap opened in a column or before it in its segment, in steps of 1, 2 and 4 columns
        blocks = [(opened.reshape(-1, 2 * d, opened.shape[1]), d) for d in (1, 2, 4)]
        steps = [(x[:, d:], x[:, d - 1 : d]) for x, d in blocks]
        cost, step, back = kind(self.oe - self.e), kind(self.e), kind(self.depth * self.e)
        h[0, :count] = self.zero - self.e  # column -1
        own[:] = floor
        np.subtract(floor, kind(self.oe), out=f)
        peak[:] = floor
        after = best_possible(query, self.matrix) if least is not None else None
        for i, a in enumerate((np.frombuffer(query, np.uint8) - 1).tolist()):
            np.subtract(h[-1, :-count], back, out=h[0, count:])
            np.add(h[:-1], self._gain(a), out=now)
            np.maximum(now, f, out=now)
            np.maximum(now, floor, out=now)
            np.maximum(peak, now, out=peak)
            np.subtract(now, cost, out=opened)
            np.maximum(f, opened, out=f)
            np.subtract(f, step, out=f)
            for later, before in steps:
                np.maximum(later, before, out=later)
            np.maximum(now, self.along[:-1], out=own)
            if self.across > 1 and self._entering(opened[-1]):
                np.maximum(own, self.entry, out=own)
            if i % FULL == FULL - 1 and self._over().all():
                break
            if least and i % LOOK == LOOK - 1 and after[i + 1] < least and after[i + 1] + int((own - floor).max()) < least and int((peak - floor).max()) < least:
                return self._best(), self._over(), len(query) - 1 - i
        return self._best(), self._over(), 0

    def _fall(self, n: int) -> np.ndarray:
        if n not in self.falls:
            self.falls[n] = np.full(len(self.entry), n, self.kind)  # numpy is slow on the larger of an array and a number
        return self.falls[n]

    def _entering(self, last: np.ndarray) -> bool:
        """The best gap that runs into each segment from those before it, in ``entry``; a segment costs depth * e. In steps of 1, 2, 4
        segments, as far as a gap can come before it is worth nothing. False: no gap comes as far as the next segment."""
        entry, spare, back, d, n, kind = self.entry, self.spare, self.depth * self.e, 1, self.count, self.kind
        top = int(np.maximum.reduce(last)) - back
        if top < self.zero:
            return False
        np.maximum(last[:-n], self._fall(back)[n:], out=spare[n:])
        np.subtract(spare[n:], kind(back), out=entry[n:])
        while d < self.across and top - d * back >= self.zero:
            m = n * d
            np.maximum(entry[:-m], self._fall(d * back)[m:], out=spare[m:])
            np.subtract(spare[m:], kind(d * back), out=spare[m:])
            np.maximum(entry[m:], spare[m:], out=entry[m:])
            d *= 2
        return True

    def _over(self) -> np.ndarray:
        return self.peak.max(axis=0).reshape(self.across, self.count).max(axis=0) >= self.top

    def _best(self) -> np.ndarray:
        return (self.peak - self.floor).max(axis=0).reshape(self.across, self.count).max(axis=0).astype(np.int64)


def scores(query: bytes, lanes: np.ndarray, matrix: np.ndarray, gap_open: int, gap_extend: int, cells: int = BATCH_CELLS) -> np.ndarray:
    """Score of the query (encoded) with each lane (codes)."""
    return Batch(lanes, matrix, gap_open, gap_extend, cells).scores([query])[0]


def best_diagonals(query: bytes, lanes: np.ndarray, lengths: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each lane (codes, padded to equal length) the best score of a run without a gap, 0 if none is positive, and its diagonal
    (place in the lane less place in the query; of equal ones the smallest). A cell holds the best run that ends there."""
    count, width = lanes.shape
    never = -(1 << 30)  # for padding, whatever the matrix has
    inside, profile = np.arange(width) < lengths[:, None], {}
    best, diagonal = np.zeros(count, np.int64), np.zeros(count, np.int64)
    ends, every = np.zeros((count, width + 1), np.int32), np.arange(count)
    for i, a in enumerate((np.frombuffer(query, np.uint8) - 1).tolist()):
        if a not in profile:
            profile[a] = np.where(inside, matrix[a].astype(np.int32)[lanes], never)
        now = np.maximum(ends[:, :-1], 0) + profile[a]
        at = now.argmax(axis=1)
        score = now[every, at]
        better = (score > best) | (score == best) & (score > 0) & (at - i < diagonal)
        best[better], diagonal[better] = score[better], (at - i)[better]
        ends[:, 1:] = now
    return best, diagonal
