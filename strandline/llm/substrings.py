"""Substring dedup by words: suffix automata of reference shards, matching statistics, maximal spans.

Every word that a window of ``window`` words covers is removed where that word sequence also starts in a document with a
smaller id; windows are judged on the input.

A broadcast automaton of the whole corpus can't exist at scale, and broadcasting shard after shard makes every document
meet every shard. So shards are made by content: a window's anchor (see repeats.py) names its shard, and only the
stretches around anchors that two documents share are sent there. In a shard, stretches come in order of document id.
Each is streamed through the suffix automaton of the stretches before it; where the matching statistic (the longest
suffix read so far that the automaton holds) reaches ``window``, a window repeats. Then the stretch joins the automaton.

Defined results: null and empty texts have no words; rows with a null id neither repeat nor are repeated; rows that
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

WINDOW, ANCHOR = 13, 5


class SuffixAutomaton:
    """Of several word sequences. States are numbers; 0 is the root."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for the suffixes that end in p and word."""
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:  # another sequence has been here
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                continue
            last = self._state({}, 0, self.length[p] + 1)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)

    def matching(self, words):
        """For each word, how many words up to it the automaton holds in this order."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield length


def _compare(window: int):
    def compare(contents, windows, key, least):
        out, i, n = [], 0, len(contents)
        split = [c.split() for c in contents]
        while i < n:
            j = i
            automaton = SuffixAutomaton()
            while j < n and key[j] == key[i]:
                same = j
                while same < n and key[same] == key[i] and least[same] == least[j]:  # of one document: not before each other
                    if j > i:
                        hits = [at - window + 1 for at, length in enumerate(automaton.matching(split[same])) if length >= window]
                        out += [(same, at, 1) for at in hits]
                    same += 1
                for own in range(j, same):
                    automaton.add(split[own])
                j = same
            i = j
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    return compare


def plan(window: int = WINDOW, anchor: int = ANCHOR) -> Plan:
    return Plan(Units.of_words, window, anchor, _compare(window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words joined by one space), kept_sha256 of every row of docs."""

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for block in blocks(pa.RecordBatch.from_arrays([text, spans], ["text", "spans"]), "text"):
            units = Units.of_words(*utf8(block.column("text")))
            data = units.data.tobytes()
            for i, own in enumerate(block.column("spans").to_pylist()):
                a, b = units.starts[i], units.starts[i + 1]
                keep = ~covered(own, window, b - a) if own else np.ones(b - a, bool)
                kept = b" ".join([data[x:y] for x, y in zip(units.begin[a:b][keep].tolist(), units.end[a:b][keep].tolist(), strict=True)])
                rows.append((b - a, b - a - int(keep.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["n_words", "n_removed", "kept", "kept_sha256"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = texts.join(repeated(texts, plan(window, anchor)), "doc_id", "left")
    kept = F.arrow_udf(cut, "n_words long, n_removed long, kept string, kept_sha256 string")("text", "spans")
    return done.select("doc_id", kept.alias("cut")).select("doc_id", "cut.*")
