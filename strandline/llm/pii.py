"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns (base spans) always stay. The field looks at regions: stretches of neighbouring chunks of text with a
digit or an @ in them that no base span covers (a blank, or a mark between blanks, joins two chunks). It segments a region into tokens that are nothing and entities of at
most ``MAX_TOKENS`` tokens, each of a kind. A segment's score is a sum of weights of features of the whole span: its
shape (runs of digits and marks with their lengths), counts of digits and marks, words before it, what ends it. Dynamic
programming over token boundaries, with the bounded length, picks the best segmentation: boundaries and kinds jointly.
The segmentations' scores make a conditional distribution; the forward and backward sums over segments give the
probability that a span is an entity of its kind, whatever stands beside it. An entity of the best segmentation is
reported if that probability is ``probability`` at least.

Weights are trained here: gradient ascent (with a step size for each feature, and a penalty on the squares of weights) on
the log-likelihood of the known segmentations, whose gradient is the features seen less those that the forward and
backward sums expect. The examples are regions of at most ``MAX_TRAIN_TOKENS`` tokens, ``train_regions`` at most, of about
``train_docs`` documents chosen by a hash of id and text, with base spans as the known entities: a bounded sample. Each is
seen three times: as it is, with the mark hidden that a pattern needs (a phone's plus, an address's dots), and with a
phone's country code hidden as well, so that the rest of the span has to tell. Then it is seen with its entities written in
other ways (``respelled``): blanks around an email's @, other marks between the groups of an address, a card or a phone; and
with numbers in their places (decimals, dates, prices), which are none. An @ is never hidden: without one, or an [at] in
brackets, which counts as one, no span with letters is looked at. Values of a feature that are rare in training are one
value, as unknown ones are later.

Defined results: null and empty texts have no spans; each row of the input gives one row, repeated ids included; other
columns are ignored; an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, PROBABILITY = 24, 0.85
TRAIN_DOCS, TRAIN_REGIONS, MAX_TRAIN_TOKENS, ROUNDS = 3_000, 2_000, 400, 6
#: First step size, and the penalty's factor a step.
RATE, PENALTY = 0.5, 1e-3
#: Ways in which training writes entities anew.
WAYS = 6
#: Training regions that a feature's value must occur in; values of fewer count as one.
RARE = 3

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Least and most digits of an entity without @, by kind.
DIGITS = {None: (4, 19), 1: (4, 12), 2: (7, 19), 3: (7, 19)}
#: The mark of a kind that training hides.
HIDDEN = {1: ".", 3: "+"}
_MARK, _GAP, _JOIN = re.compile("[0-9@]"), re.compile(r"\s"), re.compile(r"[ \t]([^\w\s][ \t])?")
#: An @ and a dot as words in brackets.
_AT, _DOT = re.compile(r"[\[({<]at[\])}>]", re.I), re.compile(r"[\[({<]dot[\])}>]", re.I)
_MARK_OR_AT = re.compile(f"{_MARK.pattern}|{_AT.pattern}", re.I)
_TOKEN = re.compile(rf"{_AT.pattern}|{_DOT.pattern}|[0-9]+|[^\W\d_]+|\s+|.", re.S | re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards: the same matches as scanning for the local part, without trying every word."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _shape(token: str) -> str:
    if "0" <= token[0] <= "9":
        return f"d{min(len(token), 5)}"
    if token[0].isalpha():
        return "w"
    if len(token) > 1 and not token.isspace():
        return "@" if _AT.fullmatch(token) else "."
    return " " if token.isspace() else token


class Region:
    """Tokens of a stretch of text, with sums that make whole-span features cheap."""

    def __init__(self, text: str, start: int, end: int):
        self.at = [start]
        self.tokens = []
        for m in _TOKEN.finditer(text, start, end):
            self.tokens.append(m[0])
            self.at.append(m.end())
        self.shapes = [_shape(t) for t in self.tokens]
        self.digits, self.ats, self.dots, self.letters = [0], [0], [0], [0]
        for t, s in zip(self.tokens, self.shapes, strict=True):
            self.digits.append(self.digits[-1] + (len(t) if s[0] == "d" and len(s) == 2 else 0))
            self.ats.append(self.ats[-1] + (s == "@"))
            self.dots.append(self.dots[-1] + (s == "."))
            self.letters.append(self.letters[-1] + (s == "w"))
        before = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start])
        self.cue = before[-1].lower() if before else ""

    def may(self, i: int, j: int, kind: int) -> bool:
        """Whether a span could be an entity of a kind: it begins and ends in a token, and has an @ inside (an email) or digits enough (the others)."""
        first, last = self.shapes[i], self.shapes[j - 1]
        if first.isspace() or last.isspace() or not (last[0] == "d" or last == "w"):
            return False
        if ats := self.ats[j] - self.ats[i]:
            if i and (self.shapes[i - 1][0] in "dw" or self.shapes[i - 1] in tuple("._%+-")):  # the whole local part or none
                return False
            return kind == 0 and ats == 1 and first != "@" and last != "@" and self.dots[j] > self.dots[i]
        least, most = DIGITS.get(kind, (1, 0))
        return least <= self.digits[j] - self.digits[i] <= most and self.letters[j] == self.letters[i]

    def features(self, i: int, j: int, kind: int, hide: int = 0):
        """Names (kind|what|value) of the features of a span as an entity of a kind. With hide, the kind's mark is left out,
        and with 2, a phone's country code, too."""
        dots, digits, k = self.dots[j] - self.dots[i], self.digits[j] - self.digits[i], KINDS[kind]
        begin = i
        if hide == 2 and kind == 3 and self.shapes[i] == "+" and i + 2 < j:
            begin = i + 2 + self.shapes[i + 2].isspace()
            digits = self.digits[j] - self.digits[begin]
        shapes = self.shapes[begin:j]
        if hide and kind in HIDDEN:
            shapes = [s for s in shapes if s != HIDDEN[kind]]
            dots = 0 if HIDDEN[kind] == "." else dots
        marks = "".join(sorted({s for s in shapes if s[0] != "d" and s != "w"}))
        yield f"{k}||"
        yield f"{k}|shape|{''.join(shapes)}" if len(shapes) <= 15 else f"{k}|shape|long"
        yield f"{k}|outline|{outline(shapes, kind)}"
        if kind:
            yield f"{k}|digits|{min(digits, 22)}"
        yield f"{k}|marks|{marks}"
        if kind:
            yield f"{k}|dots|{min(dots, 4)}"
        yield f"{k}|ends|{shapes[0]} {shapes[-1]}"
        if kind in (1, 2):
            runs = [t for t, s in zip(self.tokens[i:j], self.shapes[i:j], strict=True) if s[0] == "d" and len(s) == 2]
            yield f"{k}|check|{luhn(''.join(runs)) if kind == 2 else len(runs) == 4 and all(len(t) <= 3 and int(t) <= 255 for t in runs)}"
        yield f"{k}|after|{self.shapes[i - 1][:1] if i else ''}"
        if not i:
            yield f"{k}|cue|{self.cue}"
        yield f"{k}|before|{self.shapes[j][:1] if j < len(self.shapes) else ''}"


def outline(shapes: Sequence[str], kind: int) -> str:
    """A shape without its marks, cut to 40 characters: an email's words on either side of the @ as one, the last one and blanks apart; the others' runs of digits."""
    if kind:
        return " ".join(s for s in shapes if s[0] == "d" and len(s) == 2)[:40]
    at = shapes.index("@")
    sides = ["".join("n" if s[0] in "dw" else "n" if s in "._%+-" else s for s in side) for side in (shapes[:at], shapes[at + 1 : -1])]
    return re.sub("n+", "n", f"{sides[0]}@{sides[1]}|{shapes[-1]}")[:40]


def rare(feature: str) -> str:
    """The class of a feature's values that too few training regions have: unknown values are scored as these."""
    return f"{feature[: feature.index('|', feature.index('|') + 1)]}|?"


def candidates(region: Region, blocked: Sequence[bool], hide: int = 0):
    """Spans that may be entities (first token, end token, kind, features), by end. blocked tokens belong to none."""
    for j in range(1, len(region.tokens) + 1):
        if not (region.shapes[j - 1][0] == "d" or region.shapes[j - 1] == "w"):
            continue
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            if blocked[i]:
                break
            for kind in range(len(KINDS)):
                if region.may(i, j, kind):
                    yield i, j, kind, region.features(i, j, kind, hide)


def decode(n: int, first: Sequence[int], end: Sequence[int], score: Sequence[float]) -> list[int]:
    """The spans (by number) of the best segmentation of n tokens. Spans stand in order of their end."""
    best, back, k = [0.0] * (n + 1), [-1] * (n + 1), 0
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        while k < len(end) and end[k] == j:
            if best[first[k]] + score[k] > best[j]:
                best[j], back[j] = best[first[k]] + score[k], k
            k += 1
    out, j = [], n
    while j:
        if back[j] >= 0:
            out.append(back[j])
            j = first[back[j]]
        else:
            j -= 1
    return out[::-1]


def _add(x: float, y: float) -> float:
    """Log of the sum of two exponentials."""
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def sums(n: int, first: Sequence[int], end: Sequence[int], score: Sequence[float]) -> tuple[list[float], list[float]]:
    """Logs of the sums over all segmentations of the tokens before each token (forward) and from it on (backward)."""
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    k = 0
    for j in range(1, n + 1):
        forward[j] = forward[j - 1]
        while k < len(end) and end[k] == j:
            forward[j] = _add(forward[j], forward[first[k]] + score[k])
            k += 1
    for j in range(n, 0, -1):
        backward[j - 1] = _add(backward[j - 1], backward[j])
        while k and end[k - 1] == j:
            k -= 1
            backward[first[k]] = _add(backward[first[k]], backward[j] + score[k])
    return forward, backward


def marginals(n: int, first: Sequence[int], end: Sequence[int], score: Sequence[float]) -> tuple[float, list[float]]:
    """Log of the sum over all segmentations of n tokens, and the probability of each span."""
    forward, backward = sums(n, first, end, score)
    return forward[n], [math.exp(forward[i] + x + backward[j] - forward[n]) for i, j, x in zip(first, end, score, strict=True)]


def chunks(text: str):
    """Stretches of neighbouring chunks (parts without space) that each hold a digit or an @, one blank or one mark between blanks apart at most."""
    start = end = 0
    mark = _MARK_OR_AT if _AT.search(text) else _MARK
    m = mark.search(text)
    while m:
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        gap = _GAP.search(text, m.end())
        b = gap.start() if gap else len(text)
        if _lone(text[a:b]):
            a, b = _with_neighbours(text, a, b, end)
        if end and _JOIN.fullmatch(text, end, a):
            end = b
        else:
            if end:
                yield start, end
            start, end = a, b
        m = mark.search(text, b)
    if end:
        yield start, end


def _lone(chunk: str) -> bool:
    """Whether an @ stands alone, with blanks around."""
    return chunk == "@" or _AT.fullmatch(chunk) is not None


def _with_neighbours(text: str, a: int, b: int, least: int) -> tuple[int, int]:
    """A chunk with the chunks that are one blank away on either side, from least on."""
    if a - 1 > least and text[a - 1] in " \t" and not text[a - 2].isspace():
        a -= 2
        while a > least and not text[a - 1].isspace():
            a -= 1
    if b + 1 < len(text) and text[b] in " \t" and not text[b + 1].isspace():
        gap = _GAP.search(text, b + 1)
        b = gap.start() if gap else len(text)
    return a, b


def _marked(part: str) -> bool:
    """Whether a part of a text has an @ or digits enough for an entity."""
    return "@" in part or sum("0" <= c <= "9" for c in part) >= DIGITS[None][0] or _AT.search(part) is not None


def regions(text: str, base: list[tuple[int, int, int]], known: bool = False):
    """Regions of a text, each with its tokens covered by base spans; those without free tokens only if known."""
    for a, b in chunks(text):
        part = text[a:b]
        if not _marked(part):
            continue
        own = [s for s in base if s[1] < b and a < s[2]]
        if not known and own and not _MARK_OR_AT.search("".join(c for i, c in enumerate(part, a) if not any(s[1] <= i < s[2] for s in own))):
            continue
        region = Region(text, min([a, *(s[1] for s in own)]), max([b, *(s[2] for s in own)]))
        yield region, [any(s[1] < region.at[t + 1] and region.at[t] < s[2] for s in own) for t in range(len(region.tokens))], own


def _known(region: Region, own) -> list[tuple[int, int, int]]:
    begin, end = {p: i for i, p in enumerate(region.at[:-1])}, {p: i for i, p in enumerate(region.at)}
    return sorted((begin[a], end[b], kind) for kind, a, b in own if a in begin and b in end and end[b] - begin[a] <= MAX_TOKENS)


def _groups(digits: str, first: str, mark: str, sizes: Sequence[int]) -> str:
    """Digits in groups, first after the first of them and mark after the others; the last group takes the rest."""
    at = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
    groups = [*(digits[a:b] for a, b in zip(at, at[1:], strict=False)), digits[at[-1] :]]
    return first.join([groups[0], mark.join(filter(None, groups[1:]))])


def _number(digits: str, way: int) -> str:
    """Digits as a number that is nobody's: a decimal, thousands with cents, a date with a time, a price after an @."""
    d = (digits * 14)[:14]
    return (f"{d[0]}.{d[1:9]}", f"{d[0]},{d[1:4]},{d[4:7]}.{d[7:9]}", f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}:{d[10:12]}:{d[12:]}", f"it @ {d[0]}.{d[1:3]}")[way % 4]


def respelled(text: str, base: Sequence[tuple[int, int, int]], way: int, numbers: bool = False) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with its entities written in another way, and where they are now. With numbers, they make room
    for numbers, which are none."""
    out, spans, done = [], [], 0
    for kind, a, b in sorted(base, key=lambda s: s[1]):
        if a < done:  # within another entity
            continue
        entity, digits = text[a:b], re.sub("[^0-9]", "", text[a:b])
        if numbers:
            out += [text[done:a], _number(digits or "1", way)]
            done = b
            continue
        if kind == 0:
            local, host = entity.split("@")
            word = max(re.findall("[A-Za-z]+", entity), key=len)
            letters = re.sub("[0-9]+", word[::-1], local)
            entity = (f"{local} @ ", f"{letters} @ ", f"{word} [at] ", f"{letters}@ ", f"{local}(at)", f"{word} @ ")[way] + host
        elif kind == 1:
            entity = entity.replace(".", ("[.]", " . ", "(.)", ". ", "[dot]", " .")[way])
        elif kind == 2:
            mark = (".", "/", " - ", "_", "\u2013", ". ")[way]
            entity = _groups(digits, mark, mark, (4, 4, 4))
        elif kind == 3:
            first, mark = ("--", "..", "  ", "/-", "\u2013\u2013", "/ ")[way]
            entity = _groups(digits[-10:], first, mark, (3, 3))
        out += [text[done:a], entity]
        start = sum(map(len, out)) - len(entity)
        spans.append((kind, start, start + len(entity)))
        done = b
    return "".join([*out, text[done:]]), sorted(spans)


class Example:
    """A region with its known segmentation, features by number."""

    def __init__(self, region: Region, own, hide: int):
        spans = [(i, j, kind, list(f)) for i, j, kind, f in candidates(region, [False] * len(region.tokens), hide)]
        self.n, self.features = len(region.tokens), [span[3] for span in spans]
        self.first, self.end = [span[0] for span in spans], [span[1] for span in spans]
        known = set(_known(region, own))
        self.gold = np.array([span[:3] in known for span in spans], bool)

    def numbered(self, number: dict[str, int], often: set[str]) -> Example:
        """Gives features (those in often, and classes of the others) their numbers."""
        known = lambda own: (f for f in own if f in often or "|cue|" not in f)  # noqa: E731  (a rare word says nothing)
        ids = [[number.setdefault(f if f in often else rare(f), len(number)) for f in known(own)] for own in self.features]
        self.ids, self.sizes = np.array([f for i in ids for f in i], np.int64), np.array([len(i) for i in ids], np.int64)
        return self

    def scores(self, weights: np.ndarray) -> list[float]:
        return np.add.reduceat(weights[self.ids], np.cumsum(self.sizes) - self.sizes).tolist() if len(self.ids) else []

    def gradient(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of the known segmentation, and what it gains with each feature of ids."""
        score = self.scores(weights)
        total, expected = marginals(self.n, self.first, self.end, score)
        return float(np.array(score) @ self.gold - total) if score else 0.0, np.repeat(self.gold - np.array(expected), self.sizes)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_regions: int = TRAIN_REGIONS, rounds: int = ROUNDS) -> dict[str, float]:
    """Weights, from the regions of about train_docs documents. Only texts with regions, cut to these, come to the driver."""

    def near(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                out += [text[max(0, r.at[0] - 24) : r.at[-1] + 1] for r, _, _ in regions(text, base_spans(text), True) if len(r.tokens) <= MAX_TRAIN_TOKENS]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    n = docs.count()
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = docs.where(place < train_docs / n) if n > train_docs else docs
    found = chosen.where("text is not null").select("text").mapInArrow(near, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(train_regions)
    examples, seen, number = [], Counter(), {}
    for text in found.toArrow().column(0).to_pylist():
        for region, _, own in regions(text, base_spans(text), True):
            views = [e for hide in range(3) if (e := Example(region, own, hide)).features]
            seen.update({f for e in views for own_features in e.features for f in own_features})
            examples += views
        for way in range(WAYS if (base := base_spans(text)) else 0):
            views = []
            for numbers in (False, True) if way < 4 else (False,):
                other, spans = respelled(text, base, way, numbers)
                views += [e for region, _, own in regions(other, spans, True) if (own or numbers) and (e := Example(region, own, 0)).features]
            seen.update({f for e in views for own_features in e.features for f in own_features})
            examples += views
    often = {f for f, n in seen.items() if n >= RARE}
    examples = [e.numbered(number, often) for e in examples]
    weights, squares = np.zeros(len(number)), np.full(len(number), 1e-6)
    for _ in range(rounds):
        for example in examples:
            own, place = np.unique(example.ids, return_inverse=True)
            step = np.bincount(place, weights=example.gradient(weights)[1]) - PENALTY * weights[own]
            squares[own] += step**2
            weights[own] += RATE * step / np.sqrt(squares[own])
    return {f: float(weights[i]) for f, i in sorted(number.items())}


def added_spans(text: str, base: list[tuple[int, int, int]], weights: dict, probability: float = PROBABILITY) -> list[tuple[int, int, int]]:
    """(kind, start, end) of entities that overlap no base span."""
    out = []
    for region, blocked, _ in regions(text, base):
        n = len(region.tokens)
        first, end, kinds, score = array("i"), array("i"), array("b"), array("d")  # a region may be a whole table of numbers
        for i, j, kind, features in candidates(region, blocked):
            first.append(i)
            end.append(j)
            kinds.append(kind)
            score.append(sum(weights[f] if f in weights else weights.get(rare(f), 0.0) for f in features))
        if best := decode(n, first, end, score):
            forward, backward = sums(n, first, end, score)
            sure = [k for k in best if math.exp(forward[first[k]] + score[k] + backward[end[k]] - forward[n]) >= probability]
            out += [(kinds[k], region.at[first[k]], region.at[end[k]]) for k in sure]
    return out


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None, probability: float = PROBABILITY) -> DataFrame:
    """doc_id, base and spans of every row of docs: arrays of (kind, start, end), by kind, then start; kind indexes KINDS."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs) if weights is None else weights)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(text: pa.Array) -> pa.Array:
        base, spans = [], []
        for value in text.to_pylist():
            own = base_spans(value) if value else []
            more = added_spans(value, own, shared.value, probability) if value else []
            row = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(found)]
            base.append(row(own))
            spans.append(row(own + more))
        return pa.StructArray.from_arrays([pa.array(base, kind), pa.array(spans, kind)], ["base", "spans"])

    item = "array<struct<kind:int,start:int,end:int>>"
    return docs.select("doc_id", F.arrow_udf(find, f"base {item}, spans {item}")("text").alias("found")).select("doc_id", "found.*")


def label(spans: str):
    """kind:start:end, comma-joined, of a column of spans."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
