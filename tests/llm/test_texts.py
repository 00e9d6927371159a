import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from strandline.llm import language_id, mixing, pii, registry, token_counts

from .helpers import SCHEMA, WORD, awkward, frame, grouped

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    odd = ["a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "  lead\n\n\ttail  ", "don't we'LL I'm", "١٢٣ ½ Ⅷ 東京 🙂🙂 é  x y​", "\x00\x1c\x85", "".join(chr(r.randrange(1, 0x2FA0)) for _ in range(3000))]
    texts = awkward() + odd
    want = [len(e) for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for size in (100_000, 20):
        got = {x.doc_id: x for x in token_counts.token_counts(frame(spark, texts), BPE, head_size=size).collect()}
        assert [got[i].n_tokens for i in range(len(texts))] == want
        assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 1024) for i, t in enumerate(texts))
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), BPE).count() == 0
    twice = token_counts.token_counts(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string"), BPE).collect()
    assert sorted((x.doc_id or 0, x.n_tokens) for x in twice) == [(0, 1), (1, 2), (1, 2)]  # a row a row
    with pytest.raises(ValueError):
        token_counts._tools(public_tokenizers.path("word_bpe_49k.json"))


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": 250 * 2 / 3, "c": 250 / 3}
    assert mixing.targets({}) == {} and mixing.targets({None: 10}) == {None: 15.0}
    sizes = {f"s{i}": 10 * i for i in range(9)} | {None: 7}
    out = mixing.targets(sizes)
    assert sum(out.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(out[s] <= 2 * n + 1e-9 for s, n in sizes.items())


def test_mix(spark):
    r = random.Random(2)
    texts, sources = [], []
    for i in range(3_000):
        source = r.choice(["hot"] * 5 + ["b", "ä", "Z", None, "one-size"])
        texts.append(None if i % 97 == 0 else "w " * (30 if source == "one-size" else int(r.paretovariate(1.2) * 10)))
        sources.append(source)
    docs = frame(spark, texts, sources=sources)
    rows = mixing.mix(docs).collect()
    assert sorted(x.doc_id for x in rows) == list(range(3_000))
    size = [len(WORD.findall(t or "")) for t in texts]
    total = {s: sum(n for n, own in zip(size, sources) if own == s) for s in set(sources)}
    want = mixing.targets(total)
    for source, own in grouped(rows, "source").items():
        largest = max(x.size for x in own)
        assert abs(sum(x.taken for x in own) - want[source]) <= largest + 1
        assert all((x.size, x.source_size, x.target) == (size[x.doc_id], total[source], want[source]) and x.taken == x.copies * x.size and 0 <= x.copies <= 2 for x in own)
        if 0.6 < want[source] / total[source] < 0.95:  # tilted by size, one way
            by_size = sorted(own, key=lambda x: x.size)
            half = [np.mean([x.copies for x in part]) for part in (by_size[: len(own) // 2], by_size[len(own) // 2 :])]
            assert source == "one-size" or half[0] >= half[1]
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in rows)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(frame(spark, [None, "", None])).agg({"taken": "sum"}).first()[0] == 0


def closest_rates(sizes, counts, target, most=2.0):
    """The primal problem itself, without its dual: rates of least bounded entropy that take target words, by exchanges
    between two sizes at a time along the constraint."""
    rates = [target / sum(s * n for s, n in zip(sizes, counts, strict=True))] * len(sizes)
    cost = lambda w: w * math.log(w) + (most - w) * math.log(most - w) if 0 < w < most else 2 * math.log(2) if w in (0, most) else math.inf
    for _ in range(150):
        for i in range(len(sizes)):
            for j in range(i):
                di, dj = 1 / (sizes[i] * counts[i]), -1 / (sizes[j] * counts[j])  # words move from j to i
                low = max(-rates[i] / di, (rates[j] - most) / -dj)
                high = min((most - rates[i]) / di, rates[j] / -dj)
                for _ in range(60):
                    a, b = low + (high - low) / 3, high - (high - low) / 3
                    at = [counts[i] * cost(rates[i] + x * di) + counts[j] * cost(rates[j] + x * dj) for x in (a, b)]
                    low, high = (low, b) if at[0] < at[1] else (a, high)
                x = (low + high) / 2
                rates[i], rates[j] = rates[i] + x * di, rates[j] + x * dj
    return rates


def test_rates_against_another_solver(spark):
    r = random.Random(12)
    tables = [([3, 10, 40, 90, 400], [50, 30, 20, 4, 1]), ([1, 2, 7, 8], [1, 1, 1, 1]), ([5, 500], [900, 2])]
    shares = [0.3, 1.7, 1.2]
    words = [sum(s * n for s, n in zip(*t, strict=True)) for t in tables]
    mean = [w / sum(t[1]) for w, t in zip(words, tables, strict=True)]
    rows = [(i, s, n) for i, t in enumerate(tables) for s, n in zip(*t, strict=True)]
    r.shuffle(rows)
    found = mixing.multipliers(spark.createDataFrame(rows, "source_no int, size long, n long"), {i: (words[i], shares[i] * words[i], mean[i]) for i in range(3)})
    for i, (sizes, counts) in enumerate(tables):
        want = closest_rates(sizes, counts, shares[i] * words[i])
        tilt = [found[i] * s / mean[i] for s in sizes]
        assert [2 / (1 + math.exp(-t)) for t in tilt] == pytest.approx(want, abs=2e-3)
        assert sum(s * n * w for s, n, w in zip(sizes, counts, want, strict=True)) == pytest.approx(shares[i] * words[i])


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    got = language_id.predicted(docs).collect()
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x.held_out and known[x.doc_id]]
    assert len(held) > 150 and np.mean([x.lang_pred == known[x.doc_id] for x in held]) > 0.99
    assert all(0 <= x.score <= 1 for x in got)


def test_language_code_lengths_and_odd_texts(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcde ") for _ in range(200)) for _ in range(40)] + ["".join(r.choice("vwxyz ") for _ in range(200)) for _ in range(40)]
    langs = ["aa"] * 40 + ["zz"] * 40
    texts += [None, "", "12 34 !?", "é", "abc" * 40_000, "abcde", "vwxyz"]
    langs += [None, "aa", "zz", None, None, None, None]
    docs = frame(spark, texts, langs)
    trees = language_id.train(docs, symbols=20)
    bits = trees.bits().reshape(-1, 20, len(trees.languages))
    sums = (2.0 ** -bits[:, :-1].astype(float)).sum(1) + 2.0 ** -(bits[:, -1].astype(float) - np.log2(256 - 20 + 1))
    assert np.all(sums < 1.001) and np.all(sums > 0.9)  # every context's code is complete but for rounding
    got = {x.doc_id: x for x in language_id.predicted(docs, symbols=20).collect()}
    assert [got[i].lang_pred for i in range(80)] == langs[:80]
    assert [got[80 + i].lang_pred for i in (0, 1, 2, 4, 5, 6)] == ["und", "und", "und", "aa", "aa", "zz"] and got[80].score == 0
    no_labels = frame(spark, ["abc", None], [None, None])
    assert {x.lang_pred for x in language_id.predicted(no_labels).collect()} == {"und"}
    assert language_id.predicted(spark.createDataFrame([], SCHEMA)).count() == 0


def small_scripts():
    """A large corpus of 51 Latin bytes, and two small languages of one script whose letters differ in the last byte only."""
    r = random.Random(7)
    letters = {"hi": [chr(c) for c in range(0x915, 0x923)], "mr": [chr(c) for c in range(0x923, 0x931)]}
    write = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    texts = [write("abcdefghijklmnopqrstuvwxyz0123456789 .,;:!?()-+*/='", 400) for _ in range(400)]
    langs = ["en"] * 400
    for name, own in letters.items():
        texts += [write(own, 20) for _ in range(40)]
        langs += [name] * 40
    return texts, langs


def test_small_languages_of_another_script(spark):
    texts, langs = small_scripts()
    got = {x.doc_id: x for x in language_id.predicted(frame(spark, texts, langs)).collect()}
    held = [i for i in range(400, len(texts)) if got[i].held_out]
    assert len(held) > 5 and all(got[i].lang_pred == langs[i] for i in range(len(texts)))


def test_language_codes_are_those_of_the_bytes(spark):
    import zlib
    from collections import Counter

    texts, langs = small_scripts()
    docs = frame(spark, texts, langs)
    trees = language_id.train(docs)
    assert trees.languages == ["en", "hi", "mr"]
    counts = {name: [Counter() for _ in range(4)] for name in trees.languages}
    for i, (text, name) in enumerate(zip(texts, langs, strict=True)):
        if zlib.crc32(str(i).encode()) % 5:
            data = b"\n\n\n" + text.encode().lower()
            for at in range(3, len(data)):
                for order in range(4):
                    counts[name][order][data[at - order : at + 1]] += 1
    alphabet = [b for b in range(256) if not 65 <= b < 91]

    def brute(name, context):
        p = dict.fromkeys(alphabet, 1 / len(alphabet))
        for order in range(4):
            own = {b: counts[name][order][context[3 - order :] + bytes([b])] for b in alphabet}
            seen, total = [b for b in alphabet if own[b]], sum(own.values())
            if seen:
                rest = 1 - sum(p[b] for b in seen)
                p = {b: (own[b] if own[b] else len(seen) * p[b] / rest) / (total + len(seen)) for b in alphabet}
        return p

    samples = ["xy? \u0916\u0924a", "", "\u0929\u0930" * 3, "Zq\u00e9\u6771 \u0915"]
    data = np.frombuffer("".join(samples).encode(), np.uint8)
    starts = np.cumsum([0] + [len(t.encode()) for t in samples])
    want = []
    for text in samples:
        whole = b"\n\n\n" + text.encode().lower()
        want.append([sum(-np.log2(brute(name, whole[at - 3 : at])[whole[at]]) for at in range(3, len(whole))) for name in trees.languages])
    assert np.allclose(trees.code_lengths(data, starts), want, rtol=1e-4)
    assert np.allclose(language_id.train(docs, symbols=8).code_lengths(data, starts), want, rtol=1e-4)
    for context in (b"abc", b"\xe0\xa4\x95", b"a\xff ", b"\x01\x02\x03"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in alphabet], np.uint32)
        assert np.allclose((2.0 ** -trees.code(grams).astype(float)).sum(0), 1, atol=1e-4)


def brute_pii(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        check = sum(n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for k, n in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and check % 10 == 0:
            found.append((2, *m.span()))
    return found + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_pii_base_spans(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab1@.+- 9().2") for _ in range(r.randrange(60))) for _ in range(400)]
    texts += ["a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 12.3.4.5", "4111111111111111 4111 1111 1111 1112 4111-1111-1111-1111", "+1 (988) 555-2485", "é😀 x@y.zz", None, "", "1" * 30_000, "1.1.1." * 9_000, "a@" * 9_000]
    assert all(pii.base_spans(t) == brute_pii(t) for t in texts[:406] if t)
    got = {x.doc_id: x for x in pii.find_pii(frame(spark, texts), {}).collect()}
    assert all([tuple(s) for s in got[i].base] == [tuple(s) for s in got[i].spans] == brute_pii(t or "") for i, t in enumerate(texts))
    assert pii.find_pii(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pii_field_finds_what_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = pii.train(docs)
    find = lambda text: [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), weights)]
    assert find("reach me at (724) 555-7058 today") == [("phone", "(724) 555-7058")]
    assert find("order 1234567 of 2024-02-29, 17 pages, version 1.2.3") == []
    texts = {x.doc_id: x.text for x in docs.collect()}
    got = pii.find_pii(docs, weights).collect()
    assert len(got) == len(texts) and sum(len(x.base) for x in got) > 50
    for x in got:
        base, spans = ([tuple(s) for s in c] for c in (x.base, x.spans))
        assert base == brute_pii(texts[x.doc_id]) and set(base) <= set(spans) and spans == sorted(spans)
        assert all(not any(s[1] < b[2] and b[1] < s[2] for b in base) for s in set(spans) - set(base))


def test_pii_field_finds_addresses_of_few_digits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = pii.train(docs)
    find = lambda text: [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), weights)]
    assert find("host 10[.]0[.]0[.]5 is up") == [("ip", "10[.]0[.]0[.]5")]
    assert find("host 8 . 8 . 8 . 8 is up") == [("ip", "8 . 8 . 8 . 8")]
    assert find("in 1999 and 2001, 12 - 14 items, 3.50 or 1,234.56") == []
    region = pii.Region("8.8.8.8", 0, 7)
    assert [region.may(0, 7, k) for k in range(4)] == [False, True, False, False]
    assert "ip|marks|" in set(region.features(0, 7, 1, 1)) and "ip|marks|." in set(region.features(0, 7, 1))
    phone = pii.Region("+1 (988) 555-2485", 0, 17)
    assert [[f for f in phone.features(0, len(phone.tokens), 3, hide) if "|shape|" in f or "|digits|" in f] for hide in range(3)] == [
        ["phone|shape|+d1 (d3) d3-d4", "phone|digits|11"], ["phone|shape|d1 (d3) d3-d4", "phone|digits|11"], ["phone|shape|(d3) d3-d4", "phone|digits|10"]
    ]
    assert pii.train(docs, 300) == pii.train(docs.repartition(7), 300)


def segmentations(spans, at, n):
    """Every set of spans (numbers) that don't overlap."""
    yield []
    for k, span in enumerate(spans):
        if span[0] >= at:
            yield from ([k, *rest] for rest in segmentations(spans, span[1], n))


def test_field_against_every_segmentation():
    """The best segmentation, the sum over all, each span's probability and the gradient, for short regions and random weights."""
    r = random.Random(5)
    for _ in range(40):
        text = "".join(r.choice(["1234567", "89", "+", " ", "a@b.c", "(", "-"]) for _ in range(5)).strip()
        for region, blocked, own in pii.regions(text, []):
            n, spans = len(region.tokens), [(i, j, kind, list(f)) for i, j, kind, f in pii.candidates(region, blocked)]
            first, end = [s[0] for s in spans], [s[1] for s in spans]
            score = [r.uniform(-1, 1) for _ in spans]
            every = list(segmentations(spans, 0, n))
            value = [sum(score[k] for k in s) for s in every]
            assert sum(score[k] for k in pii.decode(n, first, end, score)) == pytest.approx(max(value))
            total, chance = pii.marginals(n, first, end, score)
            whole = sum(np.exp(value))
            assert total == pytest.approx(np.log(whole))
            assert chance == pytest.approx([sum(np.exp(v) for v, s in zip(value, every, strict=True) if k in s) / whole for k in range(len(spans))])
            if spans:
                number = {}
                example = pii.Example(region, [(spans[0][2], region.at[spans[0][0]], region.at[spans[0][1]])], 0)
                example.numbered(number, {f for span in spans for f in span[3]})
                weights = np.array([r.uniform(-0.3, 0.3) for _ in number])
                gain = np.bincount(example.ids, weights=example.gradient(weights)[1], minlength=len(number))
                for f in r.sample(range(len(number)), 5):
                    more, less = weights.copy(), weights.copy()
                    more[f] += 1e-5
                    less[f] -= 1e-5
                    assert (example.gradient(more)[0] - example.gradient(less)[0]) / 2e-5 == pytest.approx(gain[f], abs=1e-4)


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_field_finds_planted_misses(spark, scale):
    """Entities of each kind in forms that the patterns miss, most of them forms that training writes, in the given documents' own
    words; and none where there is none."""
    r = random.Random(8)
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    weights = pii.train(docs)
    words = [w for x in docs.limit(50).collect() for w in (x.text or "").split()[:40] if w.isalpha()]
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    word = lambda: r.choice(words).lower()

    def card(mark):
        d = digits(15)
        d += next(c for c in "0123456789" if pii.luhn(d + c))
        return mark.join(d[i : i + 4] for i in range(0, 16, 4))

    plant = {
        "phone": lambda: r.choice(("({}) {}-{}", "{}.{}.{}", "{}-{}-{}", "{}/{}-{}")).format(digits(3), digits(3), digits(4)),
        "ip": lambda: r.choice(("{}[.]{}[.]{}[.]{}", "{} . {} . {} . {}")).format(*(r.randrange(1, 256) for _ in range(4))),
        "email": lambda: r.choice(("{}.{} @ {}.org", "{}{} @ {}.com", "{}.{}[at]{}.net", "{}{}(at){}(dot)com", "{}{}\u00e9@{}.net")).format(word(), r.choice((digits(2), word())), word()),
        "card": lambda: card(r.choice((".", "/", " - ", "_", "\u2013"))),
    }
    found, said = Counter(), Counter()
    for kind, make in plant.items():
        for _ in range(200):
            entity = make()
            text = f"{' '.join(r.sample(words, 6))} {entity} {' '.join(r.sample(words, 6))}"
            got = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.added_spans(text, pii.base_spans(text), weights)]
            found[kind] += (kind, entity) in got
            said[kind] += len(got)
    assert all(found[k] >= 180 and found[k] >= 0.95 * said[k] for k in plant), (found, said)
    numbers = ("1999", "12,500", "3.50", "page 17", "2024-02-29", "1234567", "10-12", "3.14159265", "1,234,567.89", "12:30:45", "look @ 5.30", "meet @ noon. Then", "v1.2.3.4.5", "1/2/2003", "4111 1111 1111 1112")
    plain = [f"{' '.join(r.sample(words, 5))} {n} {' '.join(r.sample(words, 5))}" for n in numbers for _ in range(3)]
    assert not [(t, x) for t in plain for x in pii.added_spans(t, pii.base_spans(t), weights)]


def test_respelled_entities_stay_where_they_are_said_to_be():
    text = "mail ann.5@b.example.org, ring +1 (988) 555-2485 or pay 4111 1111 1111 1111 from 10.0.0.5"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == [0, 1, 2, 3]
    seen = set()
    for way in range(pii.WAYS):
        other, spans = pii.respelled(text, base, way)
        parts = {k: other[a:b] for k, a, b in spans}
        assert re.sub("[^0-9]", "", parts[2]) == "4" + "1" * 15 and re.sub("[^0-9]", "", parts[3]) == "9885552485" and re.sub("[^0-9]", "", parts[1]) == "10005"
        assert parts[0].endswith("b.example.org") and other.startswith("mail ") and ", ring " in other
        assert all(region.may(*place, k) for region, _, own in pii.regions(other, spans, True) for *place, k in pii._known(region, own))
        assert sum(len(pii._known(region, own)) for region, _, own in pii.regions(other, spans, True)) == 4
        seen.add(other)
        assert pii.respelled(text, base, way, True)[1] == []
    assert len(seen) == pii.WAYS


def test_an_at_alone_takes_its_neighbours():
    whole = lambda t: [t[a:b] for a, b in pii.chunks(t)]
    assert whole("write ann.lee @ example.org now") == ["ann.lee @ example.org"]
    assert whole("write ann[at]example.org now") == ["ann[at]example.org"]
    assert whole("@") == ["@"] and whole(" @ ") == [" @ "[1:2]] and whole("a @") == ["a @"] and whole("@ b") == ["@ b"] and whole("a  @  b") == ["@"]
    assert whole("[at] x") == ["[at] x"] and whole("x (AT) y 12") == ["x (AT) y 12"]
    region = pii.Region("ann.lee(at)b(dot)org", 0, 20)
    assert region.shapes == ["w", ".", "w", "@", "w", ".", "w"]
    assert [region.may(i, 7, 0) for i in range(3)] == [True, False, False]  # the whole local part or none


def test_every_query_is_registered():
    names = list(registry.queries())
    numbered = [n for n in names if re.match(r"op\d+_", n)]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in numbered] == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names) and set(names) - set(numbered) <= set(registry.oracle_sql())


def test_tables_of_many_languages_have_a_bound():
    for n in (1, 4, 60, 200, language_id.LANGUAGES):
        s = language_id.fitting(language_id.SYMBOLS, n)
        assert 4 * n * s**4 <= language_id.TABLE_BYTES and s >= 12
    assert language_id.fitting(48, 4) == 48
    with pytest.raises(ValueError):
        language_id.fitting(48, language_id.LANGUAGES + 1)
