"""Command line: preprocess a FASTA file into a database, search it, or show the engine's settings.

Options have a second long name where the established one differs from the one used in this library.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.matrices import NAMES
from strandline.operators import ingest, stats
from strandline.operators.params import SearchParams
from strandline.operators.search import best_of, top_hits
from strandline.sources.fasta import read_fasta
from strandline.sources.tables import read_database, titles_of, write_database


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandline", description=__doc__)
    does = out.add_subparsers(dest="operation", required=True)
    p = does.add_parser("preprocess", help="FASTA to a database")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-c", "--cpu_threads", "--tasks", dest="tasks", type=int, default=None, help="files of the database; as Spark sees fit unless given")
    s = does.add_parser("search", help="query FASTA against a database")
    s.add_argument("-q", "--query", required=True)
    s.add_argument("-d", "--db", required=True)
    s.add_argument("-s", "--sm", "--matrix", dest="matrix", choices=NAMES, default="blosum62")
    s.add_argument("-g", "--gap_open", "--gap-open", dest="gap_open", type=int, default=10)
    s.add_argument("-e", "--gap_extend", "--gap-extend", dest="gap_extend", type=int, default=2)
    s.add_argument("-r", "--top", type=int, default=10, help="hits a query; 0 reports none, as a check of input and options")
    s.add_argument("-b", "--cpu_block_width", "--batch-cells", dest="batch_cells", type=int, default=1 << 15)
    s.add_argument("-c", "--cpu_threads", "--tasks", dest="tasks", type=int, default=None, help="partitions of the database; four a core unless given")
    s.add_argument("-o", "--output", help="Parquet folder for the hits; all are printed unless given")
    does.add_parser("info", help="settings of the session")
    return out


def report(hits: DataFrame) -> None:
    """Every hit as a line of its columns, tabs between; a partition at a time comes to the driver."""
    print(*hits.columns, sep="\t")
    for r in hits.toLocalIterator():
        print(*r, sep="\t")


def search_params(options: argparse.Namespace) -> SearchParams:
    return SearchParams(options.matrix, options.gap_open, options.gap_extend, options.top or 1, options.batch_cells)


def database(options: argparse.Namespace, spark: SparkSession) -> None:
    """What preprocess does: a FASTA file or folder becomes a database on disk."""
    write_database(ingest.preprocess(read_fasta(spark, options.input)), options.output, options.tasks)


def hits(options: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """What search reports: the hits of a query FASTA in a database, titles from the files that hold them."""
    params, db = search_params(options), read_database(spark, options.db)
    tasks = options.tasks or 4 * spark.sparkContext.defaultParallelism
    best = top_hits(best_of(ingest.query_set(read_fasta(spark, options.query)), db, params, tasks), params.top)
    return titles_of(best.where(F.col("rank") <= options.top), options.db)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(args)
    if options.operation == "search":
        search_params(options)  # wrong ones are told before a session starts
    spark = spark or SparkSession.builder.appName("strandline").getOrCreate()
    if options.operation == "preprocess":
        database(options, spark)
        stats.db_stats(read_database(spark, options.output)).show(truncate=False)
    elif options.operation == "search":
        found = hits(options, spark)
        if options.output:
            found.write.parquet(options.output)
        else:
            report(found.orderBy("query_id", "rank"))
    else:
        stats.engine_info(spark).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
