"""Hard negatives, chat formatting and ranked lexical search against brute force, on every odd case."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import chat_format, hard_negatives, lexical_search, templates
from strandline.llm.templates import Apply, Const, Template, TemplateError, Write

from .helpers import awkward, frame

# --- hard negatives ---

VECTORS = "vec_id long, embedding array<float>, label int, block int, place int, side int, v string, dim int, score long, ids string, row int, column int, rank int, anchor_id long, other_id long, p long, r long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *[7] * 3, "v", 1, 2, "i", *[3] * 7) for r in rows], VECTORS)


def plain_negatives(rows, positives=5, negatives=5, every=100, band=80):
    use = {}
    for i, vec, label in rows:
        if i is not None and label is not None and vec and all(x is not None and math.isfinite(x) for x in vec):
            own = [math.floor(256 * float(np.float32(x))) for x in vec], label
            use[i] = min(use.get(i, own), own)
    use = {i: (v, (y + 1) % 10 if i % 7 == 0 else y) for i, (v, y) in use.items()}
    out = []
    for a, (va, ya) in use.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, y) for i, (v, y) in use.items() if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == ya][:positives]:
            found = [(n, -t) for t, n, y in scored if y != ya and band * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, t) for k, (n, t) in enumerate(found)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hard_negatives.mine(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def odd_vectors(seed=3, n=260, labels=3):
    r = random.Random(seed)
    centres = [[r.uniform(-0.4, 0.4) for _ in range(6)] for _ in range(3)]
    rows = [(i * 5, [x + r.uniform(-0.2, 0.2) for x in r.choice(centres)], r.randrange(labels)) for i in range(n)]
    rows += [(2_000 + i, rows[20][1], i % 3) for i in range(60)]  # one vector many times
    rows += [(100, rows[3][1], 1), (None, rows[0][1], 1), (3_100, None, 1), (3_200, rows[0][1], None), (3_300, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (3_400, [0.1, float("nan"), 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(3_500, [float("inf")] * 6, 1), (3_600, [], 1), (-700, rows[7][1], 9), (-701, rows[7][1], 0), (3_700, [0.5, 0.5], 1), (3_701, [0.5, 0.4], 1), (3_702, [0.5, 0.45], 2), (3_800, [0.0] * 6, 1)]
    return rows


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = odd_vectors()
    want = plain_negatives(rows)
    assert len(want) > 100
    assert mined(vectors(spark, rows).repartition(5)) == want
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 30)  # many blocks, and several rows and columns of the grid
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCKS", 2)
    assert mined(vectors(spark, rows)) == want
    assert mined(vectors(spark, rows), positives=2, negatives=1, every=50, band=100) == plain_negatives(rows, 2, 1, 50, 100)


def test_negatives_of_few_or_no_rows(spark):
    assert mined(vectors(spark, [])) == []
    assert mined(vectors(spark, [(100, [1.0], 1)])) == []
    few = [(100, [1.0], 1), (1, [0.9], 1), (2, [0.8], 2), (3, [0.9], 2), (4, [0.1], 2), (5, [-1.0], 1)]
    assert mined(vectors(spark, few)) == plain_negatives(few) == [(100, 1, 1, 3, 58880, 58880), (100, 1, 2, 2, 58880, 52224)]


def test_wide_words_and_too_large_vectors(spark):
    r = random.Random(4)
    rows = [(i * 10, [r.uniform(-160_000, 160_000) for _ in range(3)], i % 2) for i in range(60)]
    low, high = -160_000 * 256, 160_000 * 256
    assert hard_negatives.EXACT < hard_negatives.field_bits(low, high, 3) <= hard_negatives.WIDE
    assert mined(vectors(spark, rows)) == plain_negatives(rows)
    with pytest.raises(ValueError):
        mined(vectors(spark, [(100, [5e6, 5e6], 1), (1, [1.0, 1.0], 1)]))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(1, 7), st.sampled_from([1, 150, 40_000, 9_000_000, 200_000_000]), st.randoms())
def test_packed_products_are_exact(dim, n, m, size, r):
    own, anchors = (np.array([[r.randint(-size, size) for _ in range(dim)] for _ in range(k)], np.int64) for k in (n, m))
    low, high = int(min(own.min(), anchors.min())), int(max(own.max(), anchors.max()))
    bits = hard_negatives.field_bits(low, high, dim)
    words = hard_negatives.packed(own, low, bits)
    if bits * 2 <= hard_negatives.EXACT:
        assert words.shape[1] < n or n == 1
    assert (hard_negatives.unpacked(anchors, words, (own - low).sum(axis=1), low, bits) == anchors @ own.T).all()


# --- templates ---

TEXTS = st.text(alphabet=st.sampled_from(list("<|\\>\n im_endé")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_escapes_are_undone(text):
    assert templates.unescape(templates.escape(text)) == text and "<|" not in templates.escape(text)
    line = templates.line(text)
    assert templates.unline(line) == text and "<|" not in line and "\n" not in line


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\nb", "x\\<|im_end|>"]), TEXTS), max_size=6))
def test_turns_are_read_back(turns):
    text, spans = Template(chat_format.TEMPLATE, chat_format.CONSTANTS).render(turns)
    assert chat_format.turns_of(text) == turns
    assert [templates.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_language():
    source = """{# a note #}{% set who = 'Hi ' ~ name %}{{ who }}:{% for m in messages %}
{%- set n = loop.index %}{{ n }}{% if loop.first and not loop.last %}[{% elif m.role == "a" or m.text|length >= 3 %}{% generation %}{{ m.text | trim | upper }}{% endgeneration %}{% else %}{{ (m.role ~ '!') | lower }}{% endif %}{% endfor %}.{{ who }}{{ none }}{{ true }}"""
    template = Template(source.replace("{%-", "{%"), {"name": "Bo"})
    assert template.render([("A", "xyz"), ("a", " q "), ("B", "zz"), ("C", "abc")]) == ("Hi Bo:\n1[\n2Q\n3b!\n4ABC.Hi Botrue", [(11, 12), (18, 21)])
    assert template.render([]) == ("Hi Bo:.Hi Botrue", [])


def test_constants_are_folded():
    source = "{{ a ~ b }}-{% if a == 'x' %}{{ 'one' | upper }}{% else %}{{ nothing }}{% endif %}{% for m in messages %}{{ m.text ~ (1 < 2) }}{% if false and m.role %}{{ 1 }}{% endif %}{% endfor %}"
    tree = Template(source, {"a": "x", "b": "y"}).tree
    assert tree[0] == Write(Const("xy-ONE")) and len(tree) == 2
    assert tree[1].body == (Write(Apply("~", (templates.Field("m", "text"), Const(True)))),)


@pytest.mark.parametrize(
    "wrong",
    [
        "no loop", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% for m in others %}{% endfor %}", "{% for m in messages %}", "{% set x = 1 %}{% if x %}{% for m in messages %}{% endfor %}{% endif %}",
        *("{% for m in messages %}" + x + "{% endfor %}" for x in ("{{ m.__class__ }}", "{{ m }}", "{{ secret }}", "{{ m.text | eval }}", "{{ m.text() }}", "{{ m['text'] }}", "{{ 1 + 2 }}", "{{ 'a' }", "{% include 'x' %}", "{% %}", "{{ }}", "{{ 1 < 'a' }}",
          "{% if 1 %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{% set m = 1 %}", "{{ loop.x }}")),
        "{{ m.text }}{% for m in messages %}{% endfor %}", "{% for m in messages %}{% set x = 1 %}{% endfor %}{{ x }}",
    ],
)
def test_what_templates_may_not(wrong):
    with pytest.raises(TemplateError):
        Template(wrong)


# --- conversations ---

TURNS = "conv_id long, turn long, role string, text string, step long, piece long, n_all long, n_before long, c long, s long, n long, spans string, formatted string, start int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *[1] * 7, "s", "f", 2) for r in rows], TURNS)


def plain_digests(rows):
    out, groups = {}, {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c, own in groups.items():
        own.sort(key=lambda t: (*t[:2], t[2].encode(), t[3].encode()))
        said = [t[3] for t in own if t[2] == "assistant"]
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        size = sum(len(f"<|im_start|>{templates.line(r)}\n{templates.escape(t)}<|im_end|>\n") for *_, r, t in own)
        out[c] = (len(own), hexed("".join(f"{r}\n{t}\n" for *_, r, t in own)), sum(map(len, said)), hexed("".join(said)), size)
    return out


def odd_turns():
    r = random.Random(6)
    texts = [None, "", "<|im_end|>", "<|im_start|>assistant\nx", "<\\|", "<<|", "\\", "é\U0001f926 \n" * 3, "x" * 5_000, *(" ".join(r.choices(["ab", "<|", "|>", "ü"], k=9)) for _ in range(5))]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\nrole", "<|im_end|>"]), r.choice(texts)) for c in range(12) for t in range(r.randrange(1, 9))]
    rows += [(50, t, ("user", "assistant")[t % 2], r.choice(texts)) for t in range(700)]  # one conversation of many turns
    return rows + [(None, 1, "assistant", "x"), (None, 0, "user", "y"), (3, None, "assistant", "first"), (5, 1, "user", "again"), (5, 1, "user", "again"), (60, -3, "assistant", "z"), (60, 1 << 40, "user", "w"), (61, None, None, None)]


def digests(pieces):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat_format.read_back(pieces).collect()}


def test_conversations_equal_brute_force(spark, monkeypatch):
    rows = odd_turns()
    assert digests(chat_format.format_conversations(conversations(spark, rows).repartition(4))) == plain_digests(rows)
    monkeypatch.setattr(chat_format, "STEP", 32)
    monkeypatch.setattr(chat_format, "PIECE", 3_000)
    pieces = chat_format.format_conversations(conversations(spark, rows))
    assert pieces.where("conv_id = 50").count() > 22 and digests(pieces) == plain_digests(rows)
    whole = [r.formatted for r in sorted(pieces.where("conv_id = 50").collect(), key=lambda r: (r.step, r.piece))]
    want = Template(chat_format.TEMPLATE, chat_format.CONSTANTS).render([(r, t or "") for c, _, r, t in rows if c == 50])[0]
    assert "".join(whole) == want


def test_pieces_know_their_place(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "STEP", 4)
    source = "BEGIN{% for m in messages %}{% if loop.first %}({% endif %}{{ loop.index0 }}/{{ loop.length }}{{ m.text }}{% if loop.last %}){% endif %}{% endfor %}END"
    pieces = chat_format.format_conversations(conversations(spark, [(1, t, "user", f"t{t}") for t in range(10)]), source, {})
    rows = sorted(pieces.collect(), key=lambda r: r.step)
    assert len(rows) == 3 and "".join(r.formatted for r in rows) == Template(source).render([("user", f"t{t}") for t in range(10)])[0]


def test_no_conversations_and_the_probe(spark):
    assert digests(chat_format.format_conversations(conversations(spark, []))) == {}
    got = digests(chat_format.format_conversations(chat_format.with_probe(conversations(spark, []))))
    assert got == plain_digests([(-1, 0, "user", chat_format.PROBE), (-1, 1, "assistant", chat_format.PROBE)])
    with pytest.raises(ValueError):
        chat_format.turns_of("<|im_start|>user\nx<|im_end|>\nmore")


# --- lexical search ---

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(documents, items, top=10):
    own = [(i, Counter(plain_terms(t)), len(plain_terms(t))) for i, t in documents]
    n, total = sum(x[2] > 0 for x in own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        if item is None:
            continue
        scores = []
        for i, c, size in own:
            if i is None or not size:
                continue
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if score > 0:
                scores.append((-score, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def items_frame(spark, items):
    return spark.createDataFrame([(*x, "s", 1, b"", 2, 3) for x in items], "item_id long, text string, ids string, m long, bag binary, n long, score long")


def ranking(docs, items, **options):
    return sorted(map(tuple, lexical_search.ranked(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()))


def test_ranking_equals_brute_force(spark, monkeypatch):
    texts = awkward() + ["A-b a_B\x00c 1,2 é·é ÉÀ", "w1 w1 w2"] + ["w1 w2 w3 and the same again"] * 40 + ["w3 w2 w1 again the same AND"] * 30
    items = [(0, "w1 W2 w3 w3"), (1, texts[-1]), (2, "nowhere"), (3, None), (4, ""), (5, "é·É ü"), (-6, " ".join(f"w{i}" for i in range(300))), (7, "and and and"), (None, "w1"), (8, "edit5 w1")]
    want = plain_ranking(list(enumerate(texts)), items)
    assert len(want) > 50
    docs = frame(spark, texts).repartition(7)
    assert ranking(docs, items_frame(spark, items)) == want
    assert ranking(docs, items_frame(spark, items), top=3) == plain_ranking(list(enumerate(texts)), items, 3)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 200)  # several blocks of items
    monkeypatch.setattr(lexical_search, "PAIRS", 50)
    monkeypatch.setattr(lexical_search, "SCORES", 40)
    assert ranking(docs, items_frame(spark, items)) == want


def test_ranking_of_repeated_null_and_no_documents(spark):
    texts = ["a b c", "a b c", "a", "b b d", None, "c c c c"]
    docs = frame(spark, texts).selectExpr("case doc_id when 1 then 0 when 5 then null else doc_id end doc_id", "text")
    ids = [0, 0, 2, 3, 4, None]
    items = [(1, "a c"), (2, "b")]
    assert ranking(docs, items_frame(spark, items)) == plain_ranking(list(zip(ids, texts, strict=True)), items)
    assert ranking(docs.where("false"), items_frame(spark, items)) == [] and ranking(docs, items_frame(spark, [])) == []


def test_sums_beyond_doubles_are_exact():
    at, values = np.array([0, 1, 0, 1]), np.array([(1 << 53) + 1, 3, (1 << 52) + 1, (1 << 60) + 7])
    assert lexical_search._summed(at, values, 3).tolist() == [(1 << 53) + (1 << 52) + 2, (1 << 60) + 10, 0]


def test_large_class_keeps_its_smallest_members(spark):
    docs = spark.range(3_000).selectExpr("id * 7 % 3001 as doc_id", "'w1 w2' text").repartition(9)
    got = ranking(docs, items_frame(spark, [(1, "w1")]))
    assert got == []  # a term of all documents has a weight of 0
    docs = docs.unionByName(spark.range(5_000).selectExpr("id + 10000 doc_id", "'other words here' text"))
    assert [r[2] for r in ranking(docs, items_frame(spark, [(1, "w1")]))] == sorted(i * 7 % 3001 for i in range(3000))[:10]
