"""Suffix-array dedup by bytes: prefix doubling over the positions that can repeat.

Every byte that a string of ``window`` bytes covers is removed where the string also starts in a document with a smaller
id; strings are judged on the input, and never cross documents.

Ranking every byte position of a corpus by doubling writes it out many times over. Most positions are unique within a
few bytes, though, and need no rank: only stretches around anchors that two documents share (see repeats.py) are dealt,
by anchor, so that all positions that can begin the same string meet in one partition. There positions get a rank by
their first 8 bytes. Round by round the pair (rank of p, rank of p + h) is sorted and ranked anew, for h = 8, 16, 32 ...
up to the threshold; a position whose rank is unique leaves. Positions with the same rank in the end begin the same
``window`` bytes, compared as bytes and not as hashes. (Windows of hot anchors that have the bytes of one in a sampled
document with a smaller id are left out before they get here; see ``repeats``.)

Defined results: null and empty texts have no bytes; rows with a null id neither repeat nor are repeated; rows that
share a doc_id don't repeat each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8
from .repeats import Plan, Units, covered, repeated

WINDOW, ANCHOR = 50, 20


def doubled(data: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that begin the same window bytes as another position does, and their ranks.
    left: how many bytes each position's text still has, itself included."""
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = 1
    at = np.flatnonzero(left >= window)
    rank = np.full(len(data), -1, np.int64)
    if window >= 8:
        h = 8
        first = np.zeros(len(data) - 7, np.uint64)
        for j in range(8):
            first |= data[j : len(data) - 7 + j].astype(np.uint64) << np.uint64(8 * j)
    else:
        first = data.astype(np.uint64)
    alive = np.flatnonzero(left >= h)  # later halves are ranked, too
    names = first[alive]
    while True:
        _, name, count = np.unique(names, return_inverse=True, return_counts=True)
        shared = count[name] > 1
        rank[:] = -1
        rank[alive[shared]] = name[shared]
        if h == window:
            own = at[rank[at] >= 0]
            return own, rank[own]
        step = min(h, window - h)
        alive = alive[shared]
        alive = alive[left[alive] >= h + step]
        alive = alive[rank[alive + step] >= 0]
        if not len(alive):
            return alive, alive
        names = rank[alive] * (len(count) + 1) + rank[alive + step]
        h += step


def _compare(window: int):
    def compare(contents, windows, key, least):
        sizes = np.array([len(c) for c in contents], np.int64)
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(contents), np.uint8)
        of = np.repeat(np.arange(len(contents)), sizes)
        offset = np.arange(len(data)) - begin[of]
        at, rank = doubled(data, sizes[of] - offset, window)
        if not len(at):
            return (at,) * 3
        names, rank = np.unique(rank, return_inverse=True)
        smallest = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(smallest, rank, least[of[at]])
        hit = at[smallest[rank] < least[of[at]]]
        hit = hit[offset[hit] < windows[of[hit]]]
        if not len(hit):
            return (hit,) * 3
        cut = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])))
        return of[hit[cut]], offset[hit[cut]], np.diff(np.append(cut, len(hit)))

    return compare


def plan(window: int = WINDOW, anchor: int = ANCHOR) -> Plan:
    return Plan(Units.of_bytes, window, anchor, _compare(window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256 of every row of docs."""

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for block in blocks(pa.RecordBatch.from_arrays([text, spans], ["text", "spans"]), "text"):
            data, starts = utf8(block.column("text"))
            for i, own in enumerate(block.column("spans").to_pylist()):
                part = data[starts[i] : starts[i + 1]]
                gone = covered(own, window, len(part)) if own else np.zeros(len(part), bool)
                runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                kept = part[~gone].tobytes() if runs else part.tobytes()
                rows.append((len(part), int(gone.sum()), runs, kept, hashlib.sha256(kept).hexdigest()))
        columns = zip(*rows, strict=True) if rows else ([],) * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = texts.join(repeated(texts, plan(window, anchor)), "doc_id", "left")
    kept = F.arrow_udf(cut, "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")("text", "spans")
    return done.select("doc_id", kept.alias("cut")).select("doc_id", "cut.*")
