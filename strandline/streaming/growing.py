"""Searching a database that grows: sequences arrive as a stream, and every query keeps its best hits among all so far.

A micro-batch is scored where its sequences lie, each task sending ``top`` hits a query at most. A stateful operator keyed
by query holds the best of all micro-batches in the state store and sends a query's hits whenever they change. State is
``top`` rows a query, however long the stream runs; after a restart it goes on from the checkpoint. The hits are those of a
batch search over all sequences that have arrived: by score, ties to the longer sequence, then the larger seq_ordinal, which
is the order of db_pos.

The query set is fixed and held by every task, so its residues are bounded (``QUERY_RESIDUES``); more of it is more streams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.functions import kernel
from strandline.functions.alphabet import encode, letters
from strandline.operators.params import SearchParams
from strandline.operators.search import QUERY_RESIDUES

HIT = "score int, len int, seq_ordinal long, title string"
HITS = "query_id long, rank int, seq_ordinal long, title string, score int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first(hits, top: int) -> list[tuple]:
    """The best ``top`` of (score, len, seq_ordinal, title), each sequence once, the best first."""
    return sorted(set(hits), key=lambda h: (-h[0], -h[1], -h[2], h[3] or ""))[:top]


class KeepBest(StatefulProcessor):
    def __init__(self, top: int):
        self.top = top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("best", HIT)

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(h) for h in self.held.get()]
        best = first([*held, *((r.score, r.len, r.seq_ordinal, r.title) for r in rows)], self.top)
        if best != held:
            self.held.put(best)
            for rank, (score, _, ordinal, title) in enumerate(best, 1):
                yield Row(query_id=key[0], rank=rank, seq_ordinal=ordinal, title=title, score=score)

    def close(self) -> None:
        pass


def best_of_arriving(arriving: DataFrame, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """query_id, rank, seq_ordinal, title, score: a stream of the queries' new hits whenever these change (update mode).
    arriving: a stream of seq_ordinal, title, residues. queries: query_id, codes."""
    spark = arriving.sparkSession
    queries = queries.where("query_id is not null and octet_length(codes) > 0").select("query_id", "codes")
    if (queries.agg(F.sum(F.octet_length("codes")).alias("n")).first().n or 0) > QUERY_RESIDUES:
        raise ValueError(f"the queries have more than {QUERY_RESIDUES} residues; search with several streams")
    shared = spark.sparkContext.broadcast([(r.query_id, bytes(r.codes)) for r in queries.orderBy("query_id").toLocalIterator()])

    def score(batches):
        ids, texts = [q for q, _ in shared.value], [c for _, c in shared.value]
        best: dict = {}
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(np.asarray(batch.column("len")), kind="stable")))
            ordinals, titles, codes = (batch.column(c).to_pylist() for c in ("seq_ordinal", "title", "codes"))
            lengths = np.asarray(batch.column("len"))
            for part in kernel.batches(lengths, params.batch_cells, kernel.WIDE):
                block = kernel.Batch(kernel.padded(codes[part]), params.scores(), params.gap_open, params.gap_extend, params.batch_cells)
                for query, scores in zip(ids, block.scores(texts), strict=True):
                    found = zip(scores.tolist(), lengths[part].tolist(), ordinals[part], titles[part], strict=True)
                    best[query] = first([*best.get(query, ()), *found], params.top)
        rows = [(query, *hit) for query, hits in best.items() for hit in hits]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["query_id", "score", "len", "seq_ordinal", "title"])

    rows = arriving.select("seq_ordinal", "title", letters("residues").alias("residues")).where("residues <> '' and seq_ordinal is not null")
    rows = rows.select("seq_ordinal", "title", encode("residues").alias("codes"), F.length("residues").alias("len"))
    found = rows.mapInArrow(score, f"query_id long, {HIT}")
    return found.groupBy("query_id").transformWithState(KeepBest(params.top), HITS, "Update", "None")


def search_growing(arriving: DataFrame, queries: DataFrame, path: str, checkpoint: str, params: SearchParams = SearchParams(), **trigger) -> StreamingQuery:
    """Writes the hits that change to Parquet at path, a folder a micro-batch (written anew if it runs again). A query's
    hits are those of its latest micro-batch: ``latest``."""
    arriving.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = best_of_arriving(arriving, queries, params).writeStream.outputMode("update").foreachBatch(put)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(written: DataFrame) -> DataFrame:
    """query_id, rank, seq_ordinal, title, score of what ``search_growing`` has written: each query's latest hits."""
    last = written.groupBy("query_id").agg(F.max("batch").alias("batch"))
    return written.join(last, ["query_id", "batch"]).drop("batch")
