import random

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import decontamination, exact_top_k, parity_join

from .helpers import SCHEMA, WORD, awkward, components, frame, grouped, prose


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def check(spark, texts, docs=None):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    got = {r.doc_id: r for r in parity_join.linked_components(docs or frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, root in enumerate(components(len(texts), links)):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), root), i
    return links


def test_awkward_texts(spark):
    assert len(check(spark, awkward())) > 30


def test_chains_edges_of_similarity_and_sizes(spark):
    """Chains of copies of copies (components whose ends aren't similar), pairs at exactly 0.75, and sizes at band ends."""
    r = random.Random(7)
    texts = []
    for n in (60, 64, 70, 250, 256, 340, 1024):
        words = prose(r, n + 4, 10_000).split(" ")
        for _ in range(6):
            texts.append(" ".join(words))
            for _ in range(max(1, n // 90)):
                words[r.randrange(len(words))] = f"chain{r.randrange(10_000)}"
        a = prose(r, 304, 100_000).split(" ")
        texts += [" ".join(a), " ".join(a[:229]), " ".join(a[:228])]  # 300 shingles; 225 is 0.75, 224 just under
    r.shuffle(texts)
    check(spark, texts)


def test_group_of_near_copies_in_many_components(spark, monkeypatch):
    """Copies of one text with many edits each: few of their pairs are links, so components are joined round by round; and keys cut into blocks."""
    r = random.Random(12)
    words = prose(r, 200, 100_000).split(" ")
    texts = []
    for _ in range(40):
        near = list(words)
        for _ in range(r.randrange(3, 9)):
            near[r.randrange(len(near))] = f"edit{r.randrange(100_000)}"
        texts += [" ".join(near)] * r.choice((1, 1, 3))
    texts += [prose(r, 100, 100_000) for _ in range(20)]
    monkeypatch.setattr(parity_join, "HOT_MEMBERS", 10)
    links = check(spark, texts, frame(spark, texts).repartition(11))
    assert 0 < len(links) < len(texts) ** 2 // 4


def test_hot_keys_are_cut_once(spark, monkeypatch):
    """A key of 1,000 members, one of 31 and one of one component: blocks hold at most HOT_MEMBERS, every two members
    meet, and a second cut changes nothing."""
    monkeypatch.setattr(parity_join, "HOT_MEMBERS", 200)
    rows = [(1, i) for i in range(1000)] + [(2, i) for i in range(31)] + [(3, i) for i in range(2000, 2900)]
    members = spark.createDataFrame(rows, "key long, id long")
    roots = spark.createDataFrame([(i, 2000) for i in range(2001, 2900)], "id long, root long")
    once = parity_join.still_split(members, roots)
    groups = [{r.id for r in g} for g in grouped(once.collect(), "key").values()]
    assert max(map(len, groups)) <= 200 and all(i < 2000 for g in groups for i in g)
    met = {(a, b) for g in groups for a in g for b in g}
    assert len(met) == 1000 * 1000
    assert sorted(map(tuple, parity_join.still_split(once, roots).collect())) == sorted(map(tuple, once.collect()))


def test_shared_passages_are_no_links(spark):
    r = random.Random(8)
    passage = prose(r, 40, 10_000)
    texts = [f"{prose(r, 60, 10_000)} {passage} {prose(r, 60, 10_000)}" for _ in range(60)] + [passage] * 5
    assert len(check(spark, texts, frame(spark, texts).repartition(9))) == 10


def test_too_few_parts_are_noticed():
    r = np.random.default_rng(1)
    t = r.integers(1, 1 << 63, 255).astype(np.uint64)
    row = np.zeros(255, np.int64)
    assert not parity_join.too_few_parts(row, t, np.array([255]), 1).any()
    place = parity_join.mix(t + np.uint64(1)) % np.uint64(116)
    crowded = t[place < 20]  # all in a sixth of the parts
    many = np.concatenate([crowded, r.integers(1, 1 << 63, 40_000).astype(np.uint64)])
    many = many[parity_join.mix(many + np.uint64(1)) % np.uint64(116) < 20][:200]
    assert parity_join.too_few_parts(np.zeros(200, np.int64), many, np.array([200]), 1).all()


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(2)
    for _ in range(20):
        n = int(r.choice([200, 900, 3000]))
        a = r.integers(1, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: r.integers(n // 2, n)], r.integers(1, 1 << 63, n // 3).astype(np.uint64)])
        other = r.integers(1, 1 << 63, n).astype(np.uint64)
        x, y, z = (parity_join._sketches(np.zeros(len(s), np.int64), s, 1)[0] for s in (a, b, other))
        near, far = parity_join._distance(pa.array([x, x]), pa.array([y, z])).to_pylist()
        assert near <= len(set(a) ^ set(b)) and far > 2 * n / 7
        assert parity_join._distance(pa.array([parity_join._short(x)]), pa.array([y]))[0].as_py() <= near


def test_join_on_empty_null_and_repeated(spark):
    assert parity_join.linked_components(spark.createDataFrame([], SCHEMA)).count() == 0
    text = prose(random.Random(1), 100)
    rows = [(5, text), (5, text), (None, text), (None, None), (7, text), (8, None), (9, "")]
    got = sorted((r.doc_id or -1, r.n_shingles > 0, r.component_id or -1) for r in parity_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, False, -1), (-1, True, -1), (5, True, 5), (5, True, 5), (7, True, 5), (8, False, 8), (9, False, 9)]


def item_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def decontaminated(texts, items, window=10):
    out = []
    for text in texts:
        words, hit, ids = item_words(text), set(), set()
        for item, own in enumerate(items):
            own = item_words(own)
            n = min(window, len(own))
            for q in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[q : q + n]:
                        hit |= set(range(p, p + n))
                        ids.add(item)
        out.append((len(words), len(hit), sorted(map(str, ids))))
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    items = [prose(r, n, 50) for n in (1, 4, 9, 10, 11, 30, 60)] + [None, "", "!!", "repeat " * 14, "Ünï c0de ÄB"]
    texts = [None, "", "...", prose(r, 8, 50), "REPEAT, " * 30, "x ünï c0de Äb y", "x" * 50_000]
    for item in items[2:7]:
        words = item.split(" ")
        texts += [f"{prose(r, 15, 5000)} {item.upper()} {prose(r, 9, 5000)}", " ".join(words[1:]), f"{' '.join(words[:9])} gap {' '.join(words[9:])}", item + "!" + item]
    bench = spark.createDataFrame([(i, t, "w") for i, t in enumerate(items)], "item_id long, text string, words string")
    want = decontaminated(texts, items)
    for limit in (decontamination.BROADCAST_BYTES, 0):  # broadcast, and the shuffled way
        got = {x.doc_id: x for x in decontamination.decontaminate(frame(spark, texts), bench, broadcast_bytes=limit).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i].items) for i in range(len(texts))] == want
        assert all(sum(s.end - s.start for s in x.spans) == x.n_hit and x.contaminated == (x.n_hit > 0) for x in got.values())
    kept = {x.doc_id for x in decontamination.remove_contaminated(frame(spark, texts), bench).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[1]}
    none = bench.where("false")
    assert decontamination.decontaminate(frame(spark, texts), none).where("contaminated").count() == 0
    assert decontamination.decontaminate(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_decontamination_of_null_and_repeated_ids(spark):
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage), (1, f"{passage} eleven"), (None, "lone item"), (2, None)], "item_id long, text string")
    rows = [(5, f"a {passage} eleven"), (5, "clean"), (None, passage), (None, "the lone item here"), (7, "fine"), (7, "fine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (decontamination.BROADCAST_BYTES, 0):
        got = decontamination.decontaminate(docs, bench, broadcast_bytes=limit).collect()
        assert sorted((x.doc_id or 0, x.n_words, x.n_hit, x.items) for x in got) == [(0, 4, 2, []), (0, 10, 10, ["1"]), (5, 1, 0, []), (5, 12, 11, ["1"]), (7, 1, 0, []), (7, 1, 0, [])]
        assert [x.doc_id for x in decontamination.remove_contaminated(docs, bench, broadcast_bytes=limit).collect()] == [7, 7]


def test_decontamination_of_long_texts(spark):
    """The work is linear in a text's length, broadcast or shuffled."""
    r = random.Random(11)
    item = prose(r, 40, 100_000)
    text = f"{prose(r, 160_000, 100_000)} {item} {prose(r, 160_000, 100_000)}"
    docs, bench = frame(spark, [text]), spark.createDataFrame([(3, item)], "item_id long, text string")
    for limit in (decontamination.BROADCAST_BYTES, 0):
        got = decontamination.decontaminate(docs, bench, broadcast_bytes=limit).first()
        assert (got.n_hit, got.items, [tuple(s) for s in got.spans]) == (40, ["3"], [(160_000, 160_040)])


def brute_top(vectors, k, every):
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in whole if i % every == 0):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return out


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_top_k, "QUERIES", 3)
    monkeypatch.setattr(exact_top_k, "CANDIDATES", 20)
    r = np.random.default_rng(4)
    vectors = {i: r.normal(0, 0.3, 8).round(3).tolist() for i in range(120)}
    vectors |= {i: vectors[10] for i in range(120, 150)} | {200: None, 210: [], 220: [0.1] * 7 + [None], 230: [0.1] * 7 + [float("nan")], 240: [float("inf")] + [0.0] * 7, 250: [0.5, 0.5], 260: [0.1, 0.9], 270: [0.0] * 8}
    rows = [(i, v, 1, 2, "x") for i, v in vectors.items()] + [(10, vectors[10], 1, 2, "x"), (None, vectors[1], 1, 2, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int, block int, no string")
    floats = {i: v and [None if x is None else float(np.float32(x)) for x in v] for i, v in vectors.items()}
    for k, cells in ((5, 64), (3, 4)):
        got = sorted(map(tuple, exact_top_k.top_k(table, k=k, every=10, cells=cells).collect()))
        assert got == brute_top(floats, k, 10)
    assert exact_top_k.top_k(table.where("false")).count() == 0


def test_top_k_in_waves_and_of_large_vectors(spark, monkeypatch):
    """Bounds too wide to tell much, so that many waves are read; components beyond what doubles add up exactly; and vectors whose scores don't fit."""
    monkeypatch.setattr(exact_top_k, "WAVE", 6)
    monkeypatch.setattr(exact_top_k, "GROWTH", 3)
    r = np.random.default_rng(5)
    for size in (0.2, 1e6):
        vectors = {i: (r.normal(0, size, 6)).tolist() for i in range(60)}
        table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
        assert sorted(map(tuple, exact_top_k.top_k(table, k=4, every=10, cells=2).collect())) == brute_top(vectors, 4, 10)
    for big in (1e7, 1e300, -8.3e6):
        with pytest.raises(Exception, match="too large"):
            exact_top_k.top_k(spark.createDataFrame([(0, [big] * 3), (1, [1.0] * 3)], "vec_id long, embedding array<double>")).collect()


def test_keys_of_few_members_need_no_rounds(spark, monkeypatch):
    """Documents that share keys but are no near copies: their pairs are compared once, not in rounds of nearest pairs."""
    calls, across = [], parity_join.across

    def seen(members, about, nearest):
        calls.append(nearest)
        return across(members, about, nearest)

    monkeypatch.setattr(parity_join, "across", seen)
    r, texts = random.Random(31), []
    for _ in range(12):
        words = prose(r, 60, 10_000).split()
        texts += [" ".join(words), " ".join(words[:52] + prose(r, 8, 10_000).split()), " ".join(words[:48] + prose(r, 12, 10_000).split())]
    assert len(check(spark, texts)) >= 12
    assert calls == [False]


def test_one_sort_orders_as_three_do():
    """Also where numbers that begin alike are told apart by their last bits only, and for more rows than leave bits for values."""
    r = np.random.default_rng(8)
    for rows, values in ((50, r.integers(0, 1 << 63, 3000)), (50, r.integers(0, 40, 3000)), (1, r.integers(0, 9, 300)), (1 << 40, r.integers(0, 1 << 63, 3000))):
        row, value, first = r.integers(0, rows, len(values)), values.astype(np.uint64), r.integers(0, 512, len(values))
        for own in (None, first):
            order, want = parity_join._ordered(row, value, own, 9 if own is not None else 0), np.lexsort((value, row) if own is None else (value, own, row))
            assert all((x[order] == x[want]).all() for x in (row, value, *([first] if own is not None else [])))


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """Query blocks, repeated for each candidate block, and vectors don't go through the driver, however small Spark takes them
    for; two edges a component do."""
    plans, write = {}, exact_top_k.written

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(exact_top_k, "written", seen)
    monkeypatch.setattr(exact_top_k, "CANDIDATES", 20)
    r = np.random.default_rng(6)
    vectors = {i: r.normal(0, 0.3, 8).tolist() for i in range(100)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_top_k.top_k(table, every=10).collect())) == brute_top(vectors, 5, 10)
    assert plans["bounds"][0].count("BroadcastExchange") == 1 and plans["best"]
    assert not any("BroadcastExchange" in p for p in plans["best"])


def test_items_that_share_a_line(spark):
    """Many items share a window: a document's places meet the window once, and every item is counted."""
    r = random.Random(21)
    line = prose(r, 12, 10_000)
    items = [f"{prose(r, 9, 10_000)} {line} {prose(r, 9, 10_000)}" for _ in range(60)] + [line, line]
    texts = [f"{prose(r, 30, 10_000)} {line} {prose(r, 30, 10_000)} {line}" for _ in range(20)] + [items[3], prose(r, 50, 10_000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    windows = decontamination._windows(bench, 10)
    found = decontamination.windows_found(frame(spark, texts), windows)
    # two places of three windows each, seen by way of one or two aligned blocks, however many items there are
    assert 20 * 6 <= found.where("start is not null and doc_id < 20").count() <= 20 * 12
    got = {x.doc_id: x for x in decontamination.decontaminate(frame(spark, texts), bench).collect()}
    want = decontaminated(texts, items)
    for i, x in got.items():
        assert (x.n_words, x.n_hit, x["items"]) == want[i], i
    assert got[0].n_items == 62 and got[20].n_items == 62 and got[21].n_items == 0


def test_buckets_do_not_follow_ids():
    from strandline.llm.repeats import bucket_of

    for ids in (np.arange(20_000), np.arange(20_000) * 8, -np.arange(20_000) * 64):
        sizes = np.bincount(bucket_of(ids.astype(np.int64), 8), minlength=8)
        assert sizes.max() <= 1.1 * len(ids) / 8
