"""Tables of texts as sequences, and the preprocessed database on disk.

A database is a folder of Parquet files, each a range of lengths, and its manifest: a line for each file with its name,
sequences, residues, longest sequence and range of db_pos. The manifest is written last, when all files are committed. So a
folder without one, or whose files are not those that it lists, is no database; a lost or repeated task leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

MANIFEST = "file string, sequences long, residues long, max_len int, max_title_len int, low long, high long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_sequences(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A table of texts as seq_ordinal, title, residues."""
    return rows.select(F.col(id_column).cast("long").alias("seq_ordinal"), F.col(id_column).cast("string").alias("title"), F.col(text_column).alias("residues"))


def write_database(db: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet files (as many as said, or as Spark sees fit), each a range of lengths, so that a filter on len or db_pos
    skips files and row groups; then the manifest."""
    spark = db.sparkSession
    ranges = db.repartitionByRange(files, "len", "db_pos") if files else db.repartitionByRange("len", "db_pos")
    ranges.sortWithinPartitions("len", "db_pos").write.mode("errorifexists").parquet(path)
    rows = spark.read.parquet(path)
    lines = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("len").alias("residues"), F.max("len").alias("max_len"), F.max(F.length("title")).alias("max_title_len"),
        F.min("db_pos").alias("low"), F.max("db_pos").alias("high"),
    )
    lines.coalesce(1).write.json(f"{path}/_manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, sequences, residues, max_len, max_title_len, low, high of each file that holds rows."""
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest")


def _name(file: str) -> str:
    return file.rstrip("/").rpartition("/")[2]


def read_database(spark: SparkSession, path: str) -> DataFrame:
    """The database's rows. A missing manifest, a missing file and one that the manifest doesn't list are errors."""
    rows = spark.read.parquet(path)
    there, listed = {_name(f) for f in rows.inputFiles()}, {r.file for r in manifest(spark, path).select("file").toLocalIterator()}
    if lost := listed - there:
        raise ValueError(f"{path} is damaged: {len(lost)} of its files are missing, {min(lost)} among them")
    if (more := there - listed) and not spark.read.parquet(*(f for f in rows.inputFiles() if _name(f) in more)).isEmpty():  # files without rows are not listed
        raise ValueError(f"{path} holds files that its manifest doesn't list, {min(more)} among them")
    return rows


def files_of(hits: DataFrame, path: str) -> list[str]:
    """Names of the files that hold the hits' sequences. The driver gets names of files only."""
    lines = manifest(hits.sparkSession, path).select("file", "low", "high")
    met = lines.join(hits.select("db_pos").distinct(), F.col("db_pos").between(F.col("low"), F.col("high")), "left_semi")
    return sorted(r.file for r in met.toLocalIterator())


def titles_of(hits: DataFrame, path: str) -> DataFrame:
    """Hits (query_id, db_pos, score, rank) with seq_ordinal and title, read from the files that hold them and no others."""
    spark = hits.sparkSession
    hits = written(hits, "hits")
    files = files_of(hits, path)
    columns = ("query_id", "db_pos", "seq_ordinal", "title", "score", "rank")
    rows = spark.read.parquet(*(f"{path}/{f}" for f in files)) if files else spark.read.parquet(path).where("false")
    return hits.join(rows.select("db_pos", "seq_ordinal", "title"), "db_pos").select(*columns)
