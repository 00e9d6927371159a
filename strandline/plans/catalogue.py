"""The engine's registered queries. Those on pairs that SQL checks score region names against part names, both whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import cli
from strandline.functions.alphabet import OTHER, SIZE, code_array, letters
from strandline.functions.matrices import NAMES, matrix_table
from strandline.functions.sql_score import fold_score, register
from strandline.operators import ingest, search, stats
from strandline.operators.params import SearchParams
from strandline.sources.fasta import read_fasta, write_fasta
from strandline.sources.shared import fresh_path, written
from strandline.sources.tables import read_database, table, text_sequences, write_database

from .sql import SQL  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sequences(table(spark, sf_dir, "documents"), "doc_id", "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sequences(table(spark, sf_dir, "benchmark"), "item_id", "text")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sequences(table(spark, sf_dir, "part"), "p_partkey", "p_name")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_sequences(table(spark, sf_dir, "region"), "r_regionkey", "r_name")


def _db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.preprocess(documents(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vector_groups(_db(spark, sf_dir))


def seq_ingest(spark, sf_dir):
    rows = documents(spark, sf_dir).select("seq_ordinal", letters("residues").alias("residues")).where("residues <> ''")
    return rows.select("seq_ordinal", "residues", F.length("residues").alias("len"))


def residue_composition(spark, sf_dir):
    return stats.residue_composition(seq_ingest(spark, sf_dir))


def db_stats(spark, sf_dir):
    return stats.db_stats(ingest.encoded(documents(spark, sf_dir)))


def query_stats(spark, sf_dir):
    return stats.query_stats(ingest.encoded(benchmark(spark, sf_dir)))


def query_displacements(spark, sf_dir):
    return ingest.query_set(benchmark(spark, sf_dir)).select("query_id", "len", "disp")


def db_length_order(spark, sf_dir):
    return _db(spark, sf_dir).select("db_pos", "seq_ordinal", "len")


def chunk_assembly(spark, sf_dir):
    return stats.chunks(_groups(spark, sf_dir))


def group_slice(spark, sf_dir):
    return stats.group_slice(_groups(spark, sf_dir), 10, 40)


def sample_prefix(spark, sf_dir):
    return stats.sample_prefix(_db(spark, sf_dir), 0.01).select("db_pos", "seq_ordinal", "len")


def sample_fair(spark, sf_dir):
    return stats.sample_fair(_db(spark, sf_dir), 0.01).select("db_pos", "seq_ordinal", "len", "stratum")


def ungapped_diagonals(spark, sf_dir):
    residues = lambda rows: rows.select("seq_ordinal", "title", letters("residues").alias("residues")).where("residues <> ''")
    queries = residues(regions(spark, sf_dir)).withColumnRenamed("seq_ordinal", "query_id")
    return stats.ungapped(queries, ingest.with_position(residues(parts(spark, sf_dir)).withColumn("len", F.length("residues"))), _every_residue(spark))


def _every_residue(spark):
    """blosum62 with zeros for the letters without a code, so that these take up places."""
    rest = spark.createDataFrame([(i, j, 0) for i in range(SIZE) for j in range(SIZE) if OTHER in (i, j)], "i int, j int, score int")
    return matrix_table(spark, "blosum62").select("i", "j", "score").unionByName(rest)


def submat_lookup(spark, sf_dir):
    """How much each matrix's row of each residue adds up to over all documents, by the join on residue codes."""
    n = stats.residue_composition(seq_ingest(spark, sf_dir)).where(F.col("code") < OTHER).select(F.col("code").alias("j"), "n")
    found = n.join(F.broadcast(matrix_table(spark)), "j")
    return found.groupBy("matrix", "j", "res_j").agg(F.sum(F.col("score") * F.col("n")).alias("total"), F.max("score").alias("best"))


def score_profile(spark, sf_dir):
    rows = ingest.with_position(parts(spark, sf_dir).select("seq_ordinal", "title", letters("residues").alias("residues")).where("residues <> ''").withColumn("len", F.length("residues")))
    return stats.score_profile(rows, matrix_table(spark, "blosum62"))


def _pairs(spark, sf_dir, params: SearchParams = SearchParams()) -> DataFrame:
    return search.score_pairs(ingest.query_set(regions(spark, sf_dir)), ingest.preprocess(parts(spark, sf_dir)), params)


def _with(name: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        return _pairs(spark, sf_dir, SearchParams(**options))

    query.__name__ = name
    return query


def sw_scores(spark, sf_dir):
    return _pairs(spark, sf_dir)


def sw_topk(spark, sf_dir):
    return search.top_hits(_pairs(spark, sf_dir), 10)


def hit_titles(spark, sf_dir):
    return search.search(ingest.query_set(regions(spark, sf_dir)), ingest.preprocess(parts(spark, sf_dir)))


def sw_overflow_stats(spark, sf_dir):
    return stats.overflow(_pairs(spark, sf_dir, SearchParams("pam250", 0, 0)), 40)


def cells(spark, sf_dir):
    return stats.cells(ingest.query_set(benchmark(spark, sf_dir)), ingest.encoded(documents(spark, sf_dir)))


def search_benchmark_documents(spark, sf_dir):
    """Every benchmark item against every document, whole texts: the engine's headline."""
    db = written(_db(spark, sf_dir), "database")  # read for scores and again for titles
    return search.search(ingest.query_set(benchmark(spark, sf_dir)), db)


def sw_score_sql(spark, sf_dir):
    """The SQL function on a join of SQL, under two sets of options."""
    register(spark)
    ingest.query_set(regions(spark, sf_dir)).createOrReplaceTempView("strandline_queries")
    ingest.preprocess(parts(spark, sf_dir)).createOrReplaceTempView("strandline_db")
    return spark.sql(
        """SELECT query_id, db_pos, sw_score(q.codes, d.codes) AS score, sw_score(q.codes, d.codes, 'pam250', 3, 1) AS pam250_score
        FROM strandline_queries q CROSS JOIN strandline_db d"""
    )


def sw_score_fold(spark, sf_dir):
    """The scorer that Catalyst evaluates alone."""
    codes = lambda rows: rows.select("seq_ordinal", "title", letters("residues").alias("residues")).where("residues <> ''")
    left = codes(regions(spark, sf_dir)).select(F.col("seq_ordinal").alias("query_id"), code_array("residues").alias("a"))
    right = ingest.with_position(codes(parts(spark, sf_dir)).withColumn("len", F.length("residues"))).select("db_pos", code_array("residues").alias("b"))
    return right.join(F.broadcast(left)).select("query_id", "db_pos", fold_score(F.col("a"), F.col("b")).alias("score"))


def sw_scores_tiles(spark, sf_dir):
    """Tiles of eight columns: every name is cut, and boundary columns are handed on."""
    return _pairs(spark, sf_dir, SearchParams(batch_cells=8))


def hit_titles_pieces(spark, sf_dir):
    """Pieces as short as the penalties allow: names are cut, and their pieces overlap."""
    params = SearchParams(gap_open=255, gap_extend=127, piece=1)
    return search.search(ingest.query_set(regions(spark, sf_dir)), ingest.preprocess(parts(spark, sf_dir)), params)


def fasta_database(spark, sf_dir):
    """The front door: documents as FASTA files, these preprocessed to a database on disk, and the database read back.
    Titles hold the ids, which give ties of length their order."""
    fasta, path = fresh_path(spark, "fasta"), fresh_path(spark, "database")
    write_fasta(seq_ingest(spark, sf_dir).select(F.col("seq_ordinal").cast("string").alias("title"), "residues"), fasta)
    write_database(ingest.preprocess(read_fasta(spark, fasta).withColumn("seq_ordinal", F.col("title").cast("long"))), path)
    return read_database(spark, path).select("db_pos", "seq_ordinal", "title", "len")


def fasta_search(spark, sf_dir):
    """The command line's whole way, with its own options: queries and sequences as FASTA files, a database in three files,
    its search in six tasks, and the report. Titles hold the ids."""
    path = {name: fresh_path(spark, name) for name in ("queries", "sequences", "database")}
    for name, rows in (("queries", regions(spark, sf_dir)), ("sequences", parts(spark, sf_dir))):
        in_order = rows.withColumn("residues", letters("residues")).where("residues <> ''").repartitionByRange(3, "seq_ordinal").sortWithinPartitions("seq_ordinal")
        write_fasta(in_order, path[name])
    parse = cli.parser().parse_args
    cli.database(parse(["preprocess", "-i", path["sequences"], "-o", path["database"], "-c", "3"]), spark)
    found = cli.hits(parse(["search", "-q", path["queries"], "-d", path["database"], "-s", "pam250", "-g", "3", "-e", "1", "-r", "7", "-c", "6"]), spark)
    asked = read_fasta(spark, path["queries"]).select(F.col("seq_ordinal").alias("query_id"), F.col("title").cast("long").alias("asked"))
    return found.join(asked, "query_id").select(F.col("asked").alias("query_id"), "db_pos", F.col("title").cast("long").alias("seq_ordinal"), "score", "rank")


def fasta_files(spark, sf_dir):
    """Documents as several FASTA files with Windows line ends, read by the data source in ranges of few bytes. Ordinals
    order them by file and place; the rows must be the documents' letters, each with its id as title."""
    folder = fresh_path(spark, "fasta")
    rows = documents(spark, sf_dir).select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce(letters("residues"), F.lit("")).alias("residues"))
    wrapped = F.regexp_replace("residues", "(.{70})(?=.)", "$1\r\n")
    lines = rows.select("title", F.concat(F.lit(">"), "title", F.lit("\r\n"), wrapped, F.lit("\r")).alias("value"))
    lines.repartition(max(5, spark.sparkContext.defaultParallelism), "title").select("value").write.text(folder)
    read = read_fasta(spark, folder, split=100_000)
    return read.select(F.col("title").cast("long").alias("doc_id"), "residues", (F.col("seq_ordinal") >= 0).alias("placed"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for benchmark item 0."""
    queries = ingest.query_set(benchmark(spark, sf_dir)).where("query_id = 0")
    return search.search(queries, ingest.preprocess(documents(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        seq_ingest, residue_composition, db_stats, query_stats, query_displacements, db_length_order, chunk_assembly, group_slice, sample_prefix, sample_fair, ungapped_diagonals,
        submat_lookup, score_profile, sw_scores, sw_topk, hit_titles, sw_overflow_stats, cells, search_benchmark_documents, fasta_database, fasta_files, fasta_search,
        sw_score_sql, sw_score_fold, sw_scores_tiles, hit_titles_pieces,
        *(_with(f"sw_scores_{name}", matrix=name) for name in NAMES), *(_with(f"sw_scores_gaps_{o}_{e}", gap_open=o, gap_extend=e) for o, e in ((0, 0), (3, 1), (255, 127))),
    )
}
QUERIES["vector_groups"] = _groups
