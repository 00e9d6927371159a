import random

import pytest

from strandline import cli
from strandline.operators import ingest
from strandline.operators.search import search
from strandline.plans import catalogue
from strandline.sources.fasta import read_fasta
from strandline.sources.tables import read_database
from strandline.streaming.growing import latest, search_growing
from strandline.streaming.queries import search_stream

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def database(spark, tmp_path):
    r = random.Random(9)
    (tmp_path / "db.fasta").write_text("".join(f">s{i}\n{''.join(r.choices('ACDEFGHIKLMNPQRSTVWY', k=r.randint(5, 40)))}\n" for i in range(30)))
    (tmp_path / "q.fasta").write_text(">q0\nACDEFGHIKLMNP\n>q1\nWYWYVTSRQPNML\n")
    assert cli.main(["preprocess", "-i", str(tmp_path / "db.fasta"), "-o", str(tmp_path / "db")], spark) == 0
    return tmp_path


def test_command_line(spark, database, capsys):
    assert cli.main(["search", "-q", str(database / "q.fasta"), "-d", str(database / "db"), "-r", "3", "-c", "2", "-o", str(database / "hits")], spark) == 0
    got = spark.read.parquet(str(database / "hits"))
    want = search(ingest.query_set(read_fasta(spark, str(database / "q.fasta"))), read_database(spark, str(database / "db")), cli.SearchParams(top=3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 6
    capsys.readouterr()
    assert cli.main(["search", "--query", str(database / "q.fasta"), "--db", str(database / "db"), "--sm", "pam30", "--gap_open", "9", "--gap_extend", "1", "--top", "30"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 61
    assert cli.main(["search", "-q", str(database / "q.fasta"), "-d", str(database / "db"), "-r", "0"], spark) == 0 and len(capsys.readouterr().out.splitlines()) == 1
    assert cli.main(["info"], spark) == 0 and "spark_version" in capsys.readouterr().out
    for wrong in (["search", "-q", "x"], ["search", "-q", "x", "-d", "y", "-s", "BLOSUM62"], ["align"]):
        with pytest.raises(SystemExit):
            cli.main(wrong, spark)
    with pytest.raises(ValueError):
        cli.main(["search", "-q", "x", "-d", "y", "-g", "256"], spark)


def test_files_give_what_tables_give(spark):
    """The command line's way over FASTA files, and the same search over tables."""
    params = cli.SearchParams("pam250", 3, 1, 7)
    want = search(ingest.query_set(catalogue.regions(spark, SMALL)), ingest.preprocess(catalogue.parts(spark, SMALL)), params).drop("title")
    got = catalogue.fasta_search(spark, SMALL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 35


def test_stream_equals_batch(spark, database):
    queries = spark.createDataFrame([(0, "a", "ACDEFGHIKL"), (1, "b", "WYWYVTSRQ"), (2, "c", "123")], "query_id long, title string, residues string")
    for k in range(3):
        queries.where(f"query_id = {k}").write.mode("append").parquet(str(database / "arriving"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(database / "arriving"))
    db = read_database(spark, str(database / "db"))
    assert search_stream(stream, db, str(database / "out"), str(database / "state")).awaitTermination(120) is True
    got = spark.read.parquet(str(database / "out")).drop("batch")
    want = search(ingest.query_set(queries.withColumnRenamed("query_id", "seq_ordinal")), db)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 20


def test_database_that_grows_equals_batch_search(spark, tmp_path):
    """Three arrivals, the stream stopped and started again between them; ties of score and length, repeated texts."""
    r = random.Random(4)
    texts = ["".join(r.choices("ACDEF", k=r.choice([4, 9, 30, 31]))) for _ in range(36)]
    texts += texts[:9]
    rows = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)] + [(99, "none", None)], "seq_ordinal long, title string, residues string")
    queries = ingest.query_set(spark.createDataFrame([(i, "q", q) for i, q in enumerate(["ACDEFACDEF", "FFEEDDCCAA", "W"])], "seq_ordinal long, title string, residues string"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    params = cli.SearchParams(top=5, batch_cells=64)
    for k in range(3):
        rows.where(f"seq_ordinal % 3 = {(k + 1) % 3}").repartition(3).write.mode("append").parquet(str(tmp_path / "arriving"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "arriving"))
        assert search_growing(stream, queries, str(tmp_path / "out"), str(tmp_path / "state"), params).awaitTermination(120) is True
        so_far = rows.where(f"seq_ordinal % 3 in ({','.join(str((j + 1) % 3) for j in range(k + 1))})")
        want = {(x.query_id, x.rank, x.seq_ordinal, x.title, x.score) for x in search(queries, ingest.preprocess(so_far), params).collect()}
        assert {tuple(x) for x in latest(spark.read.parquet(str(tmp_path / "out"))).collect()} == want and len(want) == 15
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
