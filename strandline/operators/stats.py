"""Figures of a database and its layout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.alphabet import LETTERS, OTHER, SIZE, code_array, encode

from . import search

#: Sequences of a vector group, and positions of a column block.
LANES, BLOCK = 16, 28
CHUNK_BYTES = 134_217_728


def db_stats(db: DataFrame) -> DataFrame:
    return db.agg(
        F.count(F.lit(1)).alias("sequences_count"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("residues"), F.max("len").cast("int").alias("max_len"), F.max(F.length("title")).cast("int").alias("max_title_len")
    )


def query_stats(queries: DataFrame) -> DataFrame:
    return queries.agg(F.count(F.lit(1)).alias("queries_count"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("residues"))


def residue_composition(sequences: DataFrame) -> DataFrame:
    """code, residue (null for OTHER), n of the codes that occur. sequences: residues as letters. A letter's number is what a text loses
    in length without it, so that one row of sums goes on, and not a row a letter."""
    size = F.octet_length("residues")
    lost = [F.sum((size - F.octet_length(F.replace("residues", F.lit(c), F.lit("")))).cast("long")).alias(c) for c in LETTERS]
    sums = sequences.agg(*lost, F.sum(size.cast("long")).alias("total"))
    known = [F.struct(F.lit(i).alias("code"), F.lit(c).alias("residue"), F.col(c).alias("n")) for i, c in enumerate(LETTERS)]
    other = F.struct(F.lit(OTHER).alias("code"), F.lit(None).cast("string").alias("residue"), (F.col("total") - sum((F.col(c) for c in LETTERS), F.lit(0))).alias("n"))
    return sums.select(F.explode(F.array(*known, other)).alias("x")).select("x.*").where("n > 0")


def vector_groups(db: DataFrame, lanes: int = LANES, block: int = BLOCK) -> DataFrame:
    """Groups of neighbours in length order: sequences, longest length, its column blocks, padded residues."""
    rows = db.groupBy(F.floor(F.col("db_pos") / lanes).alias("vector_group")).agg(F.count(F.lit(1)).alias("sequences"), F.max("len").cast("int").alias("max_len"))
    return rows.withColumn("blocks", F.ceil(F.col("max_len") / block).cast("long")).withColumn("padded", F.col("max_len").cast("long") * lanes)


def chunks(groups: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Vector groups cut into chunks where their padded residues, added up, pass multiples of chunk_bytes.

    The sum runs over one row per group, within and then over steps of 4096 groups, so no task sees all groups.
    """
    step = F.floor(F.col("vector_group") / 4096)
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = groups.groupBy(step.alias("step")).agg(F.sum("padded").alias("s")).select("step", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("step").orderBy("vector_group").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("step", step).withColumn("inside", F.coalesce(F.sum("padded").over(inside), F.lit(0))).join(steps, "step")
    chunk = F.floor((F.col("before") + F.col("inside")) / chunk_bytes)
    out = placed.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("groups"), F.sum("sequences").cast("long").alias("sequences"), F.sum("padded").cast("long").alias("padded"), F.min("vector_group").alias("first_group"))
    running = F.sum("groups").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("groups_before", F.coalesce(running, F.lit(0)).cast("long"))


def group_slice(groups: DataFrame, start: int, end: int) -> DataFrame:
    return groups.where((F.col("vector_group") >= start) & (F.col("vector_group") < end))


def sample_prefix(db: DataFrame, part: float) -> DataFrame:
    """The shortest sequences, ``part`` of all by number, rounded up."""
    if not 0 < part <= 1:
        raise ValueError("part must be over 0 and at most 1")
    total = db.agg(F.ceil(F.count(F.lit(1)) * F.lit(part)).alias("keep"))
    return db.join(F.broadcast(total), F.col("db_pos") < F.col("keep")).drop("keep")


def sample_fair(db: DataFrame, part: float) -> DataFrame:
    """db's columns and stratum (bits of the length): of each stratum the ``part`` (rounded up) whose ids have the smallest
    hashes. So every length has its share, a larger part holds a smaller one, and neither partitions nor runs matter.

    A stratum may hold any share of the rows, so it is never sorted: rows are counted by the first digits of their hash,
    which tells the digits that go whole, and only those that share the digits at the edge are put in order.
    """
    if not 0 < part <= 1:
        raise ValueError("part must be over 0 and at most 1")
    rows = db.withColumns({"stratum": F.length(F.bin("len")), "hash": F.md5(F.col("seq_ordinal").cast("string"))}).withColumn("digits", F.substring("hash", 1, 3))
    counts = rows.groupBy("stratum", "digits").agg(F.count(F.lit(1)).alias("n"))  # 4096 a stratum at most
    own = Window.partitionBy("stratum")
    before = F.coalesce(F.sum("n").over(own.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.ceil(F.sum("n").over(own) * F.lit(part)) - before
    edges = counts.select("stratum", "digits", "n", room.alias("room")).where("room > 0")
    met = rows.join(edges, ["stratum", "digits"])
    place = F.row_number().over(Window.partitionBy("stratum", "digits").orderBy("hash", "seq_ordinal"))
    kept = met.where("n <= room").select(*db.columns, "stratum")
    return kept.unionByName(met.where("n > room").withColumn("place", place).where(F.col("place") <= F.col("room")).select(*db.columns, "stratum"))


def ungapped(queries: DataFrame, db: DataFrame, matrix: DataFrame) -> DataFrame:
    """query_id, db_pos, diagonal, score: of each pair the best run of residues without a gap, and its diagonal (place in the
    sequence less place in the query; of equal ones the smallest). Pairs without a positive score are left out.

    queries: query_id, residues; db: db_pos, residues; matrix: i, j, score (residues that it doesn't list score 0). Sequences meet
    queries on the search's grid and each pair is scored where it meets: no row a cell, and neither side is broadcast.
    """
    scores = np.zeros((SIZE, SIZE), np.int64)
    for x in matrix.select("i", "j", "score").collect():  # at most a row for each pair of codes
        scores[x.i, x.j] += x.score
    codes = encode(F.regexp_replace("residues", f"[^{LETTERS}]", "J"))  # J has no code
    coded = lambda rows, key: rows.where("residues <> ''").select(key, codes.alias("codes")).withColumn("len", F.octet_length("codes"))
    return search.best_diagonals(coded(queries, "query_id"), coded(db, "db_pos"), scores)


def score_profile(sequences: DataFrame, matrix: DataFrame) -> DataFrame:
    """db_pos, place, i, score: what each residue i scores at each place of each sequence. sequences: db_pos, residues."""
    places = sequences.select("db_pos", F.posexplode(code_array("residues")).alias("place", "j"))
    return places.join(F.broadcast(matrix.select("i", "j", "score")), "j").select("db_pos", "place", "i", "score")


def overflow(pairs: DataFrame, cap: int = 127) -> DataFrame:
    """Pairs whose score an 8-bit scorer could not hold, by query."""
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("score") >= cap).cast("long")).alias("over"), F.sum(F.least(F.col("score"), F.lit(cap))).alias("capped_sum"))


def cells(queries: DataFrame, db: DataFrame) -> DataFrame:
    """Cells of the dynamic programme by query: its length times all residues."""
    total = db.agg(F.sum("len").alias("total"))
    return queries.join(F.broadcast(total)).select("query_id", (F.col("len") * F.col("total")).cast("long").alias("cells"))


def engine_info(spark: SparkSession) -> DataFrame:
    sc = spark.sparkContext
    rows = [("spark_version", spark.version), ("master", sc.master), ("default_parallelism", str(sc.defaultParallelism))]
    rows += [(k, spark.conf.get(k)) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")]
    return spark.createDataFrame(rows, "name string, value string")
