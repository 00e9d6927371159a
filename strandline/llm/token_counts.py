"""Token counts: pieces are counted once per distinct pre-token and joined to per-document pre-token frequencies.

No token ids are made. A byte-level BPE never merges across pre-tokens, so a text's count is the sum over its
pre-tokens of (occurrences x pieces). Pre-tokens follow Zipf's law, which decides the plan:

* the head, at most ``head_size`` frequent pre-tokens taken from a bounded sample of documents, is counted and
  broadcast. Its size is fixed by the parameter, whatever the size of the corpus;
* every other pre-token leaves the scan as a row (row of documents, pre-token, occurrences). The distinct ones are counted
  once each, and an equi-join gives the counts back.

The head only decides where a pre-token is counted, never its count, so results don't depend on the sample.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row of documents gives a row of its own, with
whatever doc_id it has (null and repeated ones, too); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import some_rows, written

#: Pre-tokens in the broadcast head, at most, and the documents whose pre-tokens it is taken from.
HEAD_SIZE, HEAD_DOCS = 200_000, 8_000
LIMIT = 1024


@lru_cache(maxsize=2)
def _tools(path: str):
    """The tokenizer, the compiled pre-token pattern and special-string splitter of a tokenizer file; once per process."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    with open(path) as f:
        about = json.load(f)
    before = about["pre_tokenizer"]
    if about["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or about["normalizer"]:
        raise ValueError(f"{path}: only a byte-level BPE without normaliser splits into independent pre-tokens")
    special = [t["content"] for t in about["added_tokens"]]
    splitter = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    return Tokenizer.from_file(path), regex.compile(public_tokenizers.PATTERN), splitter


def _frequencies(path: str, text: str) -> tuple[Counter, int]:
    """Occurrences of each pre-token, and the number of special strings (each is one token by the library's default)."""
    _, pattern, splitter = _tools(path)
    if splitter is None or not splitter.search(text):
        return Counter(pattern.findall(text)), 0
    parts, found = splitter.split(text), Counter()
    for part in parts:
        found.update(pattern.findall(part))
    return found, len(parts) - 1


def _pieces(path: str, tokens: list[str]) -> list[int]:
    encode = _tools(path)[0].encode_batch
    return [len(e) for i in range(0, len(tokens), 4096) for e in encode(tokens[i : i + 4096], add_special_tokens=False)]


def _counted(tokens: DataFrame, path: str) -> DataFrame:
    """(token, pieces) of each row of tokens."""

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pieces(path, batch.column(0).to_pylist()), pa.int64())], ["token", "pieces"])

    return tokens.mapInArrow(count, "token string, pieces long")


def pre_token_head(docs: DataFrame, path: str, head_size: int = HEAD_SIZE, head_docs: int = HEAD_DOCS) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of at most head_docs documents; at most head_size entries."""

    def tokens(batches):
        for batch in batches:
            found = Counter()
            for text in batch.column(0).to_pylist():
                found.update(_frequencies(path, text)[0])
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["token", "n"])

    sample = some_rows(docs, head_docs).where("text is not null").select("text")
    top = sample.mapInArrow(tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(head_size)
    found = _counted(top.select("token"), path).toArrow()
    return dict(zip(found.column("token").to_pylist(), found.column("pieces").to_pylist(), strict=True))


def token_counts(docs: DataFrame, path: str, head_size: int = HEAD_SIZE, head_docs: int = HEAD_DOCS, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs."""
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(pre_token_head(docs, path, head_size, head_docs))

    def scan(batches):
        known, row = head.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, at, tokens, occurrences = batch.column(0).to_pylist(), [], [], []
            sure, sizes = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    sure.append(0)
                    sizes.append(0)
                    continue
                found, total = _frequencies(path, text)
                for token, n in found.items():
                    pieces = known.get(token)
                    if pieces is None:
                        at.append(row + i)
                        tokens.append(token)
                        occurrences.append(n)
                    else:
                        total += n * pieces
                sure.append(total)
                sizes.append(len(text.encode()))
            rows, more = len(ids), len(at)
            columns = (list(range(row, row + rows)) + at, ids + [None] * more, sizes + [0] * more, sure + occurrences)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([None] * rows + tokens, pa.string())], ["row", "doc_id", "n_bytes", "n", "token"])
            row += rows

    # a row's number holds for this written table, whatever an attempt that was lost had numbered
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "row long, doc_id long, n_bytes long, n long, token string"), "pre-tokens")

    rare = rows.where("token is not null")
    pieces = _counted(rare.select("token").distinct(), path)
    counted = rare.join(pieces, "token").select("row", "doc_id", "n_bytes", (F.col("n") * F.col("pieces")).alias("n"))
    sure = rows.where("token is null").select("row", "doc_id", "n_bytes", "n")
    total = sure.unionByName(counted).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
