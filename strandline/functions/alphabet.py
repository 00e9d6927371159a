"""Residue letters and their codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 23 residue letters, whose places are their codes, and the code of padding and of every other letter.
LETTERS = "ABCDEFGHIKLMNPQRSTVWXYZ"
OTHER = 23
SIZE = 24


def letters(text: Column | str) -> Column:
    """A text as residues: ASCII letters only, in upper case. Letters are taken out first, as upper() makes new ones of some others."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def encode(residues: Column | str) -> Column:
    """Residues as bytes, code + 1 each (translate drops what maps to 0); letters without a code (J, O, U) become OTHER + 1."""
    return F.translate(residues, LETTERS + "JOU", "".join(map(chr, range(1, SIZE))) + chr(SIZE) * 3).cast("binary")


def code_array(residues: Column | str) -> Column:
    """Residues as an array of codes."""
    known = F.transform(F.filter(F.split(residues, ""), lambda c: c != ""), lambda c: F.instr(F.lit(LETTERS), c) - 1)
    return F.transform(known, lambda c: F.when(c < 0, OTHER).otherwise(c).cast("int"))


def encode_text(residues: str) -> bytes:
    """As encode(), for one text of letters."""
    return bytes(1 + (LETTERS.index(c) if c in LETTERS else OTHER) for c in residues)
