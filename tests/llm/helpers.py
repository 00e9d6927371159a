"""Small tables with every odd case, and plain versions of what operators compute."""

import random
import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Extra columns whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, words string, start int, n int, size int, hits string, cell int, u long, a long"


def frame(spark, texts, langs=None, sources=None):
    """One document per text, ids from 0; None is a null text."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None, 1, "k", "w", 2, 3, 4, "h", 5, 6, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"{'ABé'[r.randrange(3)] if r.random() < 0.1 else ''}w{r.randrange(vocabulary)}" for _ in range(n))


def awkward(seed: int = 1) -> list:
    """Nulls, empty and tiny texts, copies, near copies, shared passages, repeats inside a text, a very long one."""
    r = random.Random(seed)
    passage, long = prose(r, 30), prose(r, 9_000, 5_000)
    texts = [None, "", " \t\n", "one", "one two three", "é ü", "x" * 60, "ab" * 5_000, "w1 " * 400]
    base = [prose(r, n) for n in (5, 12, 13, 14, 40, 63, 64, 70, 120, 250, 260, 300, 1_100)]
    for text in base:
        words = text.split(" ")
        texts += [text, text]
        for change in (1, 2, 6):
            near = list(words)
            for _ in range(change):
                near[r.randrange(len(near))] = f"edit{r.randrange(1000)}"
            texts.append(" ".join(near))
        texts.append(" ".join(words[: len(words) * 3 // 4 + 1]))
    texts += [f"{prose(r, 20)} {passage} {prose(r, 20)}" for _ in range(12)]
    texts += [long, long[: len(long) // 2] + " " + passage, text.upper(), text + " tail", None, ""]
    r.shuffle(texts)
    return texts


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def repeated_windows(units, window):
    """For each document (a list of units), which units a window covers that starts in an earlier one, too."""
    least = {}
    for i, own in enumerate(units):
        for p in range(len(own) - window + 1):
            least.setdefault(tuple(own[p : p + window]), i)
    out = []
    for i, own in enumerate(units):
        gone = [False] * len(own)
        for p in range(len(own) - window + 1):
            if least[tuple(own[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append(gone)
    return out


def grouped(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
