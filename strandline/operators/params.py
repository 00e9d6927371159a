"""What a search can be told, checked."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandline.functions.matrices import matrix


@dataclass(frozen=True)
class SearchParams:
    """matrix: one of eight names. gap_open 0..255 and gap_extend 0..127: a gap of length L costs open + L * extend.
    top: hits per query. batch_cells: working set of the scorer, in cells. piece: columns after which a long sequence is cut (at least four times the overlap)."""

    matrix: str = "blosum62"
    gap_open: int = 10
    gap_extend: int = 2
    top: int = 10
    batch_cells: int = 1 << 15
    piece: int = 1 << 14

    def __post_init__(self):
        matrix(self.matrix)
        for name, low, high in (("gap_open", 0, 255), ("gap_extend", 0, 127), ("top", 1, None), ("batch_cells", 1, None), ("piece", 1, None)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{name} must be a whole number, not {value!r}")
            if value < low or high is not None and value > high:
                raise ValueError(f"{name} must be {low}..{high}, not {value}" if high is not None else f"{name} must be {low} or more, not {value}")

    def scores(self) -> np.ndarray:
        return matrix(self.matrix)
