"""Searching with queries that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.alphabet import encode, letters
from strandline.operators.params import SearchParams
from strandline.operators.search import search


def search_stream(arriving: DataFrame, db: DataFrame, path: str, checkpoint: str, params: SearchParams = SearchParams(), **trigger) -> StreamingQuery:
    """Appends the best hits of each arriving query (query_id, title, residues) to Parquet at path.

    A micro-batch is a search of its own. Its hits go to a folder of the batch's number, overwritten if the batch runs
    again after a failure, so each query's hits are there once.
    """

    def run(batch: DataFrame, number: int) -> None:
        queries = batch.select("query_id", encode(letters("residues")).alias("codes")).where(F.length("codes") > 0)
        search(queries, db, params).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
