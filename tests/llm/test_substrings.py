import dataclasses
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import repeats, substrings, suffix_array

from .helpers import SCHEMA, WORD, awkward, frame, repeated_windows


def check_words(got, texts, window):
    units = [WORD.findall(t or "") for t in texts]
    for i, gone in enumerate(repeated_windows(units, window)):
        kept = " ".join(w for w, g in zip(units[i], gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(units[i]), sum(gone), kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def check_bytes(got, texts, window):
    units = [list((t or "").encode()) for t in texts]
    for i, gone in enumerate(repeated_windows(units, window)):
        kept = bytes(b for b, g in zip(units[i], gone) if not g)
        runs = sum(g and not before for before, g in zip([False, *gone], gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(units[i]), sum(gone), runs, kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_awkward_texts(spark):
    texts = awkward()
    check_words(by_id(substrings.remove_repeats(frame(spark, texts))), texts, 13)
    check_bytes(by_id(suffix_array.remove_repeats(frame(spark, texts))), texts, 50)


def test_hot_passage_and_small_windows(spark, monkeypatch):
    """A passage in every document: hot anchors, whose windows travel singly; and blocks and batches of odd sizes."""
    r = random.Random(2)
    line = " ".join(f"lic{i}" for i in range(25))
    texts = [" ".join([*(f"a{r.randrange(9999)}" for _ in range(r.randrange(30))), line, *(f"b{r.randrange(9999)}" for _ in range(r.randrange(30)))]) for _ in range(60)]
    check_words(by_id(substrings.remove_repeats(frame(spark, texts))), texts, 13)
    check_bytes(by_id(suffix_array.remove_repeats(frame(spark, texts))), texts, 50)
    check_bytes(by_id(suffix_array.remove_repeats(frame(spark, texts), window=9, anchor=4)), texts, 9)
    check_words(by_id(substrings.remove_repeats(frame(spark, texts), window=3, anchor=2)), texts, 3)
    texts += [texts[0].replace("lic3 ", "lic3  ")]  # the same words, other bytes
    for known in (2, 1_000):  # windows that a sample settles, and none
        for module in (substrings, suffix_array):
            whole = module.plan
            monkeypatch.setattr(module, "plan", lambda *size, whole=whole, known=known: dataclasses.replace(whole(*size), crowd=20, hot_docs=known))
        check_words(by_id(substrings.remove_repeats(frame(spark, texts))), texts, 13)
        check_bytes(by_id(suffix_array.remove_repeats(frame(spark, texts))), texts, 50)
        check_bytes(by_id(suffix_array.remove_repeats(frame(spark, texts), window=9, anchor=4)), texts, 9)


@pytest.mark.parametrize("module", [substrings, suffix_array])
def test_hot_anchors_are_counted(spark, module):
    """A line in 0.1 % of the documents, whose ids are multiples of the number of buckets: no sample decides whether it is hot."""
    r = random.Random(7)
    line = " ".join(f"licence{i}" for i in range(30))
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(20)) for _ in range(6_000)]
    for i in range(0, 6_000, 1_000):
        texts[i] += " " + line + f" {i}"
    ids = [8 * i for i in range(6_000)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    plan = dataclasses.replace(module.plan(), crowd=6)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["doc_id", "text"])
    held = {(mark, int(i)) for _, own, _, s in repeats._parts(batch, plan) for mark, i in zip(repeats.low32(s.anchor).astype(np.uint32).tolist(), own[s.text], strict=True)}
    count = Counter(mark for mark, _ in held)
    for parts in (1, 8):
        got = repeats.shared_anchors(docs.repartition(parts), plan, 8).collect()
        marks = {(mark, x.doc_id) for x in got if x.doc_id is not None for mark in np.frombuffer(x.marks, np.uint32).tolist()}
        assert marks >= {(mark, i) for mark, i in held if count[mark] > 1}
        counted = np.concatenate([np.frombuffer(x.marks, repeats.COUNTED) for x in got if x.doc_id is None])
        assert {int(m): int(n) for m, n in counted} == {m: n for m, n in count.items() if n >= 6} and len(counted)
        frame_ = spark.createDataFrame([x for x in got], "doc_id long, marks binary")
        assert repeats.hot_marks(frame_, plan).tolist() == sorted(m for m, n in count.items() if n >= 6)
        assert len(repeats.hot_marks(frame_, dataclasses.replace(plan, hot_anchors=1))) == 1


def test_empty_null_and_repeated_ids(spark):
    for operator in (substrings.remove_repeats, suffix_array.remove_repeats):
        assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
        text = " ".join(f"w{i}" for i in range(40))
        rows = [(1, text), (1, text), (None, text), (None, None), (2, text), (3, None)]
        got = sorted((r.doc_id or -1, r.n_removed) for r in operator(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        whole = 40 if operator is substrings.remove_repeats else len(text)
        assert got == [(-1, 0), (-1, 0), (1, 0), (1, 0), (2, whole), (3, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=5), st.lists(st.sampled_from("abc"), max_size=30))
def test_automaton_matching_statistics(known, query):
    automaton = substrings.SuffixAutomaton()
    for words in known:
        automaton.add(words)
    texts = ["".join(k) for k in known]
    for i, length in enumerate(automaton.matching(query)):
        longest = max(n for n in range(i + 2) if any("".join(query[i + 1 - n : i + 1]) in t for t in texts))
        assert length == longest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=5), st.sampled_from([3, 8, 9, 11, 16, 20]))
def test_doubling_finds_equal_strings(parts, window):
    parts = [bytes(b % 3 for b in p) for p in parts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    left = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
    at, rank = suffix_array.doubled(data, left.astype(np.int64), window)
    whole = {i: data[i : i + window].tobytes() for i in np.flatnonzero(left >= window)}
    twice = {i for i, s in whole.items() if list(whole.values()).count(s) > 1}
    assert set(at.tolist()) == twice
    assert len(set(zip(rank.tolist(), (whole[i] for i in at.tolist())))) == len(set(rank.tolist())) == len({whole[i] for i in twice})


@pytest.mark.parametrize("operator", [substrings.remove_repeats, suffix_array.remove_repeats])
def test_partitioning_does_not_matter(spark, operator):
    docs = frame(spark, awkward(4))
    one = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in operator(docs.coalesce(1)).collect())
    assert one == sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in operator(docs.repartition(7)).collect())
