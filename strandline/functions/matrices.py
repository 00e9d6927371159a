"""The eight substitution matrices, as arrays and as a table.

PAM matrices follow from a rule: the one-step mutation matrix of 1978 (exchange rates and frequencies of the 20 amino
acids), raised to the n-th power, as log-odds. BLOSUM matrices are published counts (blosum.py).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .alphabet import LETTERS, OTHER, SIZE
from .blosum import TRIANGLES

# Exchange rates (lower triangle) and frequencies of the amino acids in their published order.
_ACIDS = "ARNDCQEGHILKMFPSTWYV"
_EXCHANGE = """
27
98 32
120 0 905
36 23 0 0
89 246 103 134 0
198 1 148 1153 0 716
240 9 139 125 11 28 81
23 240 535 86 28 606 43 10
65 64 77 24 44 18 61 0 7
41 15 34 0 0 73 11 7 44 257
26 464 318 71 0 153 83 27 26 46 18
72 90 1 0 0 114 30 17 0 336 527 243
18 14 14 0 0 0 0 15 48 196 157 0 92
250 103 42 13 19 153 51 34 94 12 32 33 17 11
409 154 495 95 161 56 79 234 35 24 17 96 62 46 245
371 26 229 66 16 53 34 30 22 192 33 136 104 13 78 550
0 201 23 0 0 0 0 0 27 0 46 0 0 76 0 75 0
24 8 95 0 96 0 22 0 127 37 28 13 0 698 0 34 42 61
208 24 15 18 49 35 37 54 44 889 175 10 258 12 48 30 157 0 28
"""
_FREQUENCY = "0.087127 0.040904 0.040432 0.046872 0.033474 0.038255 0.049530 0.088612 0.033618 0.036886 0.085357 0.080482 0.014753 0.039772 0.050680 0.069577 0.058542 0.010494 0.029916 0.064718"
#: Units of a bit for each matrix.
_PAM = {"pam30": (30, 2), "pam70": (70, 2), "pam250": (250, 3)}
# Published entries that the rule rounds the other way.
_PAM_ROUNDED = {
    "pam30": {"PK": -6, "RL": -8, "TR": -6, "ZF": -13},
    "pam70": {"ED": 3, "NH": 1},
    "pam250": {"FA": -3, "FB": -4, "HH": 6, "NF": -3, "PG": 0, "VR": -2},
}

NAMES = ("blosum45", "blosum50", "blosum62", "blosum80", "blosum90", "pam30", "pam70", "pam250")


def _blosum(name: str) -> np.ndarray:
    out = np.zeros((SIZE, SIZE), np.int32)
    for i, line in enumerate(TRIANGLES[name].split("\n")[1:-1]):
        row = [int(x) for x in line.split()[1:]]
        out[i, : i + 1] = out[: i + 1, i] = row
    return out


def _pam(name: str) -> np.ndarray:
    steps, units = _PAM[name]
    rate = np.zeros((20, 20))
    for i, line in enumerate(_EXCHANGE.split("\n")[1:-1], 1):
        rate[i, :i] = rate[:i, i] = [float(x) for x in line.split()]
    f = np.array([float(x) for x in _FREQUENCY.split()])
    rate = rate * f
    rate -= np.diag(rate.sum(1))
    once = np.eye(20) + rate * 0.01 / -(f * np.diag(rate)).sum()  # one change in a hundred
    odds = np.linalg.matrix_power(once, steps) / f
    odds = (odds + odds.T) / 2
    # B is N or D, Z is Q or E, X is anything, in proportion to frequency
    groups = {c: c for c in _ACIDS} | {"B": "ND", "Z": "QE"}
    weight = np.zeros((SIZE, 20))
    for i, c in enumerate(LETTERS):
        own = [_ACIDS.index(x) for x in groups.get(c, _ACIDS)]
        weight[i, own] = f[own] / f[own].sum()
    out = np.zeros((SIZE, SIZE), np.int32)
    known = np.rint(units * np.log2(weight[:OTHER] @ odds @ weight[:OTHER].T))
    x = LETTERS.index("X")
    score = units * np.log2(odds)
    known[x, :] = known[:, x] = np.rint(weight[:OTHER] @ score @ f)
    out[:OTHER, :OTHER] = known
    for pair, value in _PAM_ROUNDED[name].items():
        i, j = (LETTERS.index(c) for c in pair)
        out[i, j] = out[j, i] = value
    return out


@lru_cache(maxsize=len(NAMES))
def matrix(name: str) -> np.ndarray:
    """24 x 24 scores by code; the last row and column, of OTHER, are zero."""
    if name not in NAMES:
        raise ValueError(f"unknown matrix {name!r}; one of {', '.join(NAMES)}")
    return _pam(name) if name in _PAM else _blosum(name)


def matrix_table(spark: SparkSession, *names: str) -> DataFrame:
    """matrix, i, j, res_i, res_j, score for the 23 real codes."""
    rows = [(name, i, j, a, b, int(matrix(name)[i, j])) for name in (names or NAMES) for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS)]
    return spark.createDataFrame(rows, "matrix string, i int, j int, res_i string, res_j string, score int")
