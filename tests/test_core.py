"""The scorer against a plain recurrence, matrices against fingerprints, ingest and search against small brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandline.functions import kernel, sql_score
from strandline.functions.alphabet import LETTERS, OTHER, code_array, encode, encode_text, letters
from strandline.functions.matrices import NAMES, matrix, matrix_table
from strandline.operators import ingest, search, stats
from strandline.operators.params import SearchParams
from strandline.sources import fasta
from strandline.sources.fasta import read_fasta, write_fasta
from strandline.sources.tables import files_of, manifest, read_database, text_sequences, titles_of, write_database

FINGERPRINTS = {
    "blosum45": "178a70eaa3484fff", "blosum50": "f17821f594830ffa", "blosum62": "e6a389a48de31114", "blosum80": "9cec75b116a0eac0",
    "blosum90": "d9a356843aed572f", "pam30": "9cd877526275e3a3", "pam70": "f06ece3e1f8c2612", "pam250": "49e9836b8aacd9ec",
}


def plain(a: str, b: str, name="blosum62", gap_open=10, gap_extend=2) -> int:
    m, oe, e = matrix(name), gap_open + gap_extend, gap_extend
    code = lambda c: LETTERS.index(c) if c in LETTERS else OTHER
    h, f, best = [0] * (len(b) + 1), [0] * (len(b) + 1), 0
    for x in a:
        diagonal, along = 0, 0
        for j, y in enumerate(b, 1):
            now = max(0, diagonal + m[code(x), code(y)], along, f[j])
            diagonal, h[j] = h[j], now
            along, f[j], best = max(along - e, now - oe), max(f[j] - e, now - oe), max(best, now)
    return int(best)


def fast(a: str, b: str, name="blosum62", gap_open=10, gap_extend=2) -> int:
    return int(kernel.scores(encode_text(a), kernel.padded([encode_text(b)]), matrix(name), gap_open, gap_extend)[0])


@pytest.mark.parametrize("name", NAMES)
def test_matrices(name):
    core = matrix(name)[:23, :23]
    assert hashlib.sha256(",".join(map(str, core.ravel())).encode()).hexdigest()[:16] == FINGERPRINTS[name]
    assert (core == core.T).all() and not matrix(name)[OTHER].any() and not matrix(name)[:, OTHER].any()
    with pytest.raises(ValueError):
        matrix(name.upper())


@pytest.mark.parametrize(
    "a, b, name, gaps, score",
    [
        ("W", "W", "blosum62", (10, 2), 11), ("X", "X", "blosum62", (10, 2), 0), ("JOU", "JOU", "blosum62", (10, 2), 0), ("AAA", "WWW", "pam250", (10, 2), 0),
        ("ACDEFGHIKLMNPQRSTVWY", "ACDEFGHIKLMNPQRSTVWY", "blosum62", (10, 2), 116), ("WWWWCCCC", "WWWWAACCCC", "blosum62", (10, 2), 66), ("WWWWCCCC", "WWWWACCCC", "blosum62", (10, 2), 71),
        ("W" * 11 + "E", "W" * 11 + "E", "blosum62", (10, 2), 126), ("W" * 11 + "C", "W" * 11 + "C", "blosum62", (10, 2), 130), ("W" * 12, "W" * 12, "blosum62", (10, 2), 132),
        ("W" * 14 + "HHHH", "W" * 14 + "AHHHH", "blosum62", (120, 20), 176), ("HEAGAWGHEE", "PAWHEAE", "blosum45", (0, 0), 42), ("HEAGAWGHEE", "PAWHEAE", "pam30", (255, 127), 23),
        ("HEAGAWGHEE", "PAWHEAE", "pam250", (3, 1), 25), ("HEAGAWGHEE", "PAWHEAE", "blosum80", (10, 2), 31), ("W" * 3000, "W" * 3000, "blosum62", (10, 2), 33000),
    ],
)
def test_golden_scores(a, b, name, gaps, score):
    assert fast(a, b, name, *gaps) == fast(b, a, name, *gaps) == score


residues = st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ", min_size=1, max_size=40)


@settings(max_examples=150, deadline=None)
@given(residues, st.lists(residues, min_size=1, max_size=6), st.sampled_from(NAMES), st.integers(0, 255), st.integers(0, 127))
def test_scorer_equals_recurrence(query, lanes, name, gap_open, gap_extend):
    got = kernel.scores(encode_text(query), kernel.padded([encode_text(x) for x in lanes]), matrix(name), gap_open, gap_extend)
    assert got.tolist() == [plain(query, x, name, gap_open, gap_extend) for x in lanes]


@pytest.mark.parametrize("length", [1, 27, 28, 29, 255, 257])
def test_lengths_and_types(length):
    r = random.Random(length)
    a, b = ("".join(r.choices(LETTERS, k=length)) for _ in range(2))
    assert fast(a, b) == plain(a, b)
    long = "".join(r.choices(LETTERS, k=20_000))  # needs 32 bits: the ramp along the row passes 16
    assert fast(a, long) == plain(a, long)


def test_batches_cover_in_order():
    lengths = np.sort(np.random.default_rng(1).integers(1, 500, 300))
    parts = list(kernel.batches(lengths, 2_000))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(300))
    assert all((p.stop - p.start) * lengths[p.stop - 1] <= 2_000 or p.stop - p.start == 1 for p in parts)
    assert list(kernel.batches(np.array([100_000]), 10)) == [slice(0, 1)]


def test_params():
    SearchParams("pam30", 0, 0, 1)
    for wrong in ({"gap_open": 256}, {"gap_extend": 128}, {"gap_open": -1}, {"top": 0}, {"matrix": "blosum61"}):
        with pytest.raises(ValueError):
            SearchParams(**wrong)
    with pytest.raises(TypeError):
        SearchParams(top="10")


def test_fasta(spark, tmp_path):
    path = tmp_path / "a.fasta"
    path.write_bytes(b">one first > record\r\nACDE\r\nfghi\r\n>empty\r\n\r\n>two\nAC DE*\n\nJOU\n>three\nWW")
    rows = sorted(read_fasta(spark, str(path)).collect())
    assert [(r.title, r.residues) for r in rows] == [("one first > record", "ACDEfghi"), ("empty", ""), ("two", "ACDE*JOU"), ("three", "WW")]
    db = {r.title: r for r in ingest.preprocess(read_fasta(spark, str(path))).collect()}
    assert {t: (r.db_pos, r.len) for t, r in db.items()} == {"three": (0, 2), "two": (1, 7), "one first > record": (2, 8)}
    assert bytes(db["two"].codes) == encode_text("ACDEJOU")
    write_fasta(read_fasta(spark, str(path)).where("title <> 'empty'"), str(tmp_path / "out"))
    again = read_fasta(spark, str(tmp_path / "out"))
    assert {(r.title, r.residues) for r in again.collect()} == {(r.title, r.residues) for r in rows if r.residues}


def test_fasta_source_is_the_same_however_it_is_cut(spark, tmp_path, monkeypatch):
    """Several files, both kinds of line ends, blank lines, empty titles and records; ranges of every size, and reads of few bytes."""
    (tmp_path / "in").mkdir()
    files = {"b.fa": b"\n>b1\r\nAC\r\nDE\r\n>\r\nFG\r\n>b3 x > y\r\n\r\n", "a.fa": b">a1\nA>C\n>a2\n" + b"WY\n" * 40 + b">a3\nK", "_hidden": b">no\nA", "c.fa": b"", "d.fa": b">>d\nA"}
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    want = [("a1", "A>C"), ("a2", "WY" * 40), ("a3", "K"), ("b1", "ACDE"), ("", "FG"), ("b3 x > y", ""), (">d", "A")]
    offsets = None
    monkeypatch.setattr(fasta, "READ", 3)
    for split in (1, 2, 5, 64, 1 << 20):
        out = sorted((p.before + at, r) for p in fasta.FastaReader(str(tmp_path / "in"), split).partitions() for at, r in fasta.records(open(p.path, "rb"), p.start, p.end))
        offsets = offsets or [x for x, _ in out]
        assert [x for x, _ in out] == offsets and len(out) == len(want)
    rows = read_fasta(spark, str(tmp_path / "in"), split=7).orderBy("seq_ordinal").collect()
    assert [(r.title, r.residues) for r in rows] == want and [r.seq_ordinal for r in rows] == offsets
    assert [r.title for r in spark.read.format("fasta").load(str(tmp_path / "in" / "[ad].fa")).orderBy("seq_ordinal").collect()] == ["a1", "a2", "a3", ">d"]
    (tmp_path / "wrong.fa").write_bytes(b"AC\n>x\n")
    for wrong in ("wrong.fa", "missing"):
        with pytest.raises(Exception, match="FASTA|missing"):
            read_fasta(spark, str(tmp_path / wrong)).collect()


def test_fasta_writer_keeps_every_row(spark, tmp_path):
    rows = [(None, "ACD"), ("two\r\nlines", "A" * 61 + ">C\n>D"), ("", ""), ("x", None)]
    write_fasta(spark.createDataFrame(rows, "title string, residues string"), str(tmp_path / "out"))
    want = sorted([("", "ACD"), ("two lines", "A" * 61 + "CD"), ("", ""), ("x", "")])
    for read in (read_fasta, fasta.read_fasta_lines):
        assert sorted((r.title, r.residues) for r in read(spark, str(tmp_path / "out")).collect()) == want


def test_database_is_whole_or_not_there(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "ACDE" * (1 + i)) for i in range(60)], "seq_ordinal long, title string, residues string")
    path = str(tmp_path / "db")
    write_database(ingest.preprocess(rows), path, 6)
    lines = manifest(spark, path).orderBy("low").collect()
    assert sum(x.sequences for x in lines) == 60 and lines[-1].max_len == 240 and all(a.high < b.low for a, b in zip(lines, lines[1:], strict=False))
    hits = spark.createDataFrame([(0, 59, 5, 1), (1, 58, 4, 1), (2, 59, 3, 1)], "query_id long, db_pos long, score int, rank int")
    assert files_of(hits, path) == [lines[-1].file]
    got = titles_of(hits, path)
    assert {f.rpartition("/")[2] for f in got.inputFiles()} & {x.file for x in lines} == {lines[-1].file}
    assert sorted((r.query_id, r.title) for r in got.collect()) == [(0, "t59"), (1, "t58"), (2, "t59")] and titles_of(hits.where("false"), path).count() == 0
    part = tmp_path / "db" / lines[2].file
    part.rename(tmp_path / "away")
    with pytest.raises(ValueError, match="missing"):
        read_database(spark, path)
    (tmp_path / "away").rename(part)
    (tmp_path / "db" / "more.parquet").write_bytes(part.read_bytes())
    with pytest.raises(ValueError, match="list"):
        read_database(spark, path)
    rows.write.parquet(str(tmp_path / "none"))
    with pytest.raises(Exception, match="manifest"):
        read_database(spark, str(tmp_path / "none"))


def test_encode_strips_before_upper(spark):
    rows = spark.createDataFrame([("aßc1 dé", ), (None,), ("",)], "t string").select(letters("t").alias("x"))
    assert [r.x for r in rows.collect()] == ["ACD", None, ""]
    assert [bytes(r.c) for r in rows.where("x = 'ACD'").select(encode("x").alias("c")).collect()] == [encode_text("ACD")]


def test_positions_with_repeated_and_extra(spark):
    r = random.Random(3)
    data = [(i * 40_000, str(i), "".join(r.choices("ACDEFG", k=r.randint(0, 3))) or None, "x") for i in range(60)]
    sequences = spark.createDataFrame(data, "seq_ordinal long, title string, residues string, len string")
    got = ingest.preprocess(sequences.select("seq_ordinal", "title", "residues")).collect()
    want = sorted((len(x[2]), x[0]) for x in data if x[2])
    assert [(x.len, x.seq_ordinal) for x in sorted(got, key=lambda x: x.db_pos)] == want
    assert sorted(x.db_pos for x in got) == list(range(len(want)))


def test_null_ordinals_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, "n", "AC"), (5, "b", "CA"), (None, "m", "AC"), (1 << 40, "c", "DD"), (2, None, "A")], "seq_ordinal long, title string, residues string")
    got = sorted((r.db_pos, r.title) for r in ingest.preprocess(rows).collect())
    assert got == [(0, None), (1, "b"), (2, "c"), (3, "m"), (4, "n")]
    queries = sorted((r.query_id, r.len, r.disp) for r in ingest.query_set(rows).collect())
    assert queries == [(2, 1, 0), (5, 2, 1), (1 << 40, 2, 3)]


def test_tasks_have_the_same_work(spark):
    """Cells by place of the grid, for lengths that differ by a factor of thousands: no task has over 1.1 of the mean."""
    r = random.Random(11)
    lengths = [r.choice([3, 40, 300, 2_000]) + r.randrange(50) for _ in range(900)] + [200_000, 90_000]
    db = ingest.preprocess(spark.createDataFrame([(i, str(i), n) for i, n in enumerate(lengths)], "seq_ordinal long, title string, n int").select("seq_ordinal", "title", F.expr("repeat('A', n)").alias("residues")))
    queries = ingest.query_set(spark.createDataFrame([(0, "q", "ACDEFG")], "seq_ordinal long, title string, residues string"))
    cut = search.pieces(db, 4_000, 100)
    assert cut.agg(F.sum("own")).first()[0] == sum(lengths) and cut.agg(F.max("len")).first()[0] == 4_000
    work = search.grid(queries, cut, 1, 16).where("side = 1").groupBy(F.spark_partition_id()).agg(F.sum("own").alias("n")).collect()
    assert len(work) == 16 and max(x.n for x in work) <= 1.1 * sum(lengths) / 16


@settings(max_examples=80, deadline=None)
@given(residues, st.lists(residues, min_size=1, max_size=4), st.sampled_from(NAMES), st.sampled_from([(10, 2), (0, 0), (3, 1), (255, 127), (0, 100)]), st.sampled_from([1, 8, 40, 100]))
def test_tiles_equal_whole_rows(query, lanes, name, gaps, cells):
    """Columns in tiles of eight and more, H and the running maximum handed on."""
    block = kernel.Batch(kernel.padded([encode_text(x * 2) for x in lanes]), matrix(name), *gaps, cells)
    assert block.scores([encode_text(query), encode_text(query[::-1])]).tolist() == [[plain(q, x * 2, name, *gaps) for x in lanes] for q in (query, query[::-1])]


@settings(max_examples=80, deadline=None)
@given(residues, st.lists(residues, min_size=1, max_size=4), st.sampled_from(NAMES), st.integers(0, 200), st.integers(0, 30), st.integers(0, 6))
def test_bounds_hold_and_low_scores_may_be_left_out(query, lanes, name, least, gap_open, gap_extend):
    m, codes = matrix(name), kernel.padded([encode_text(x) for x in lanes])
    want = np.array([plain(query, x, name, gap_open, gap_extend) for x in lanes])
    assert (kernel.bounds(encode_text(query), kernel.counts(codes), m) >= want).all()
    got = kernel.Batch(codes, m, gap_open, gap_extend).scores([encode_text(query)], [least])[0]
    assert (got[want >= least] == want[want >= least]).all() and (got[want < least] < least).all() if least else (got == want).all()


@settings(max_examples=60, deadline=None)
@given(residues, residues, st.sampled_from(NAMES), st.integers(0, 30), st.integers(1, 20))
def test_no_alignment_spans_more_than_reach(query, text, name, gap_open, gap_extend):
    far = kernel.reach(len(query), matrix(name), gap_open, gap_extend)
    text = text + "W" * far + query  # an alignment of both ends would span more
    parts = [text[i : i + far] for i in range(len(text))]
    assert max(plain(query, x, name, gap_open, gap_extend) for x in set(parts)) == plain(query, text, name, gap_open, gap_extend)
    assert kernel.reach(5, matrix(name), 0, 0) is None and kernel.reach(0, matrix(name), 0, 0) == 0


def test_composition(spark):
    rows = spark.createDataFrame([("AACJ",), ("ZOUX",), (None,), ("",)], "residues string")
    assert {r.code: (r.residue, r.n) for r in stats.residue_composition(rows).collect()} == {0: ("A", 2), 2: ("C", 1), 20: ("X", 1), 22: ("Z", 1), OTHER: (None, 3)}
    assert stats.residue_composition(rows.where("false")).count() == 0


def test_search_with_ties_and_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choices(LETTERS, k=r.randint(1, 60))) for _ in range(40)]
    texts += texts[:15]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    db = ingest.preprocess(text_sequences(frame, "id", "t"))
    write_database(db, str(tmp_path / "db"))
    db = read_database(spark, str(tmp_path / "db"))
    queries = ingest.query_set(text_sequences(frame.where("id < 3"), "id", "t"))
    monkeypatch.setattr(search, "QUERY_RESIDUES", 20)  # several row groups
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))
    for top in (4, 1000):
        got = search.search(queries, db, SearchParams(top=top, batch_cells=200), tasks=3).collect()
        for q in range(3):
            ranked = sorted(((-plain(texts[q], texts[i]), -p, i) for p, i in enumerate(order)))[:top]
            mine = sorted((x.rank, -x.score, -x.db_pos, x.seq_ordinal) for x in got if x.query_id == q)
            assert mine == [(k + 1, *x) for k, x in enumerate(ranked)]


def test_pieces_and_pruning_change_no_hit(spark):
    """Long texts in overlapping pieces, in one task and in many, against whole texts; what is counted while it runs."""
    r = random.Random(8)
    texts = ["".join(r.choices("ACDEFGHIK", k=r.choice([2, 30, 700, 3_000]))) for _ in range(40)]
    texts[3] = texts[3][:20] + texts[5][:40] + texts[3][20:]
    rows = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "seq_ordinal long, title string, residues string")
    queries = spark.createDataFrame([(i, "q", texts[5][i : i + 35] + "WWWW") for i in range(3)], "seq_ordinal long, title string, residues string")
    db, queries = ingest.preprocess(rows), ingest.query_set(queries)
    every = search.score_pairs(queries, db, SearchParams(gap_extend=9))
    want = {(x.query_id, x.rank, x.db_pos, x.score) for x in search.top_hits(every, 4).collect()}
    for tasks in (1, 7):
        seen = Observation()
        got = search.search(queries, db, SearchParams(gap_extend=9, top=4, batch_cells=100, piece=1), tasks, seen).collect()
        assert {(x.query_id, x.rank, x.db_pos, x.score) for x in got} == want
        assert seen.get["cells"] == stats.cells(queries, db).agg(F.sum("cells")).first()[0] and 0 < seen.get["skipped"] < seen.get["cells"]


def test_score_in_sql_and_by_folds(spark):
    sql_score.register(spark)
    r = random.Random(2)
    pairs = [tuple("".join(r.choices(LETTERS + "JO", k=r.randrange(0, 12))) for _ in range(2)) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", encode("x").alias("a"), encode("y").alias("b"), code_array("x").alias("c"), code_array("y").alias("d"))
    folded = [sql_score.fold_score(F.col("c"), F.col("d")).alias("f"), sql_score.fold_score(F.col("c"), F.col("d"), "pam30", 0, 0).alias("g")]
    for x in rows.select("x", "y", F.expr("sw_score(a, b) s"), F.expr("sw_score(a, b, 'pam30', 0, 0) t"), *folded).collect():
        assert (x.s, x.t) == (x.f, x.g) == (plain(x.x, x.y), plain(x.x, x.y, "pam30", 0, 0))
    none = spark.sql("select sw_score(cast(null as binary), X'01') a, sw_score(X'', X'01') b, sw_score(X'01', X'01', cast(null as string)) c").first()
    assert tuple(none) == (None, 0, None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq_ordinal long, title string, residues string")
    db = ingest.preprocess(none)
    assert search.search(ingest.query_set(none), db).count() == 0
    assert stats.db_stats(db).first().sequences_count == 0
    assert stats.chunks(stats.vector_groups(db)).count() == 0


def test_chunks_and_sample(spark):
    groups = spark.createDataFrame([(i, 16, 10, 1, 160) for i in range(10_000)], "vector_group long, sequences long, max_len int, blocks long, padded long")
    got = stats.chunks(groups, 1_000).orderBy("chunk").collect()
    assert sum(r.groups for r in got) == 10_000 and got[5].groups_before == sum(r.groups for r in got[:5])
    assert all(r.chunk == r.first_group * 160 // 1_000 for r in got)
    db = spark.createDataFrame([(i,) for i in range(101)], "db_pos long")
    assert stats.sample_prefix(db, 0.01).count() == 2
    assert matrix_table(spark, "pam70").count() == 529


def test_fair_sample(spark):
    r = random.Random(13)
    rows = [(i, f"t{i}", r.choice([1, 3, 50, 700]) + r.randrange(3)) for i in range(5_000)]
    db = spark.createDataFrame(rows, "seq_ordinal long, title string, len int")
    sets = {}
    for part in (0.01, 0.2, 1.0):
        own = defaultdict(list)
        for i, _, n in rows:
            own[n.bit_length()].append((hashlib.md5(str(i).encode()).hexdigest(), i))
        want = {i for x in own.values() for _, i in sorted(x)[: -int(-len(x) * part // 1)]}
        for n in (1, 9):
            got = stats.sample_fair(db.repartition(n), part)
            assert got.columns == [*db.columns, "stratum"] and {x.seq_ordinal for x in got.collect()} == want
        sets[part] = want
    assert sets[0.01] < sets[0.2] < sets[1.0] and len(sets[1.0]) == 5_000
    assert stats.sample_fair(db.where("false"), 0.5).count() == 0
    with pytest.raises(ValueError):
        stats.sample_fair(db, 0)


def test_ungapped_against_all_diagonals(spark):
    r = random.Random(14)
    queries, texts = (["".join(r.choices("ACDWX", k=r.randrange(1, 9))) for _ in range(n)] for n in (5, 12))
    m = matrix("blosum62")
    want = {}
    for a, q in enumerate(queries):
        for b, t in enumerate(texts):
            runs = [(-sum(m[LETTERS.index(q[k]), LETTERS.index(t[k + d])] for k in range(x, y)), d) for d in range(-len(q), len(t)) for x in range(max(0, -d), len(q)) for y in range(x + 1, min(len(q), len(t) - d) + 1)]
            score, d = min(runs)
            if score < 0:
                want[a, b] = (d, -score)
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, residues string")
    got = stats.ungapped(frame(queries, "query_id"), frame(texts, "db_pos"), matrix_table(spark, "blosum62")).collect()
    assert {(x.query_id, x.db_pos): (x.diagonal, x.score) for x in got} == want and want


@pytest.mark.parametrize("name, gap_open, gap_extend", [("blosum62", 10, 2), ("pam250", 3, 1), ("blosum45", 0, 0), ("pam30", 0, 3), ("blosum62", 30, 0), ("blosum50", 255, 127)])
def test_whole_batches_in_bytes_and_16_bits(name, gap_open, gap_extend):
    r = random.Random(16)
    word = "".join(r.choices(LETTERS, k=70))
    query = word + word[:30]
    # copies with gaps among others, so that some lanes pass 255 and others don't; gaps longer than a segment
    texts = ["".join(r.choices("ACDEFGHIKLWJ", k=n)) for n in (1, 7, 8, 9, 60, 150)] + [query, word[:40] + "A" * 17 + word[40:], word[:20] + word[33:], "W" * 90, word[:12]]
    want = [plain(query, t, name, gap_open, gap_extend) for t in texts]
    lanes, m = kernel.padded([encode_text(t) for t in texts]), matrix(name)
    for kinds in ((np.uint8, np.uint16), (np.uint16,), ()):
        assert kernel.Batch(lanes, m, gap_open, gap_extend, kinds=kinds).scores([encode_text(query)])[0].tolist() == want
        least = sorted(want)[-3]
        some = kernel.Batch(lanes, m, gap_open, gap_extend, kinds=kinds).scores([encode_text(query)], [least])[0].tolist()
        assert [x for x in some if x >= least] == [x for x in want if x >= least]
    if kernel._Whole.limit(m, gap_extend, gap_open + gap_extend, np.uint8) >= kernel.LEAST_SCORE:
        best, over, _ = kernel._Whole(lanes, m, gap_extend, gap_open + gap_extend, np.uint8).run(encode_text(query), None)
        assert over.any() and not over.all() and all(o or b == w for b, o, w in zip(best, over, want, strict=True))


def test_scores_past_16_bits():
    lanes = kernel.padded([encode_text("W" * 6_500), encode_text("WAW")])
    assert kernel.scores(encode_text("W" * 6_000), lanes, matrix("blosum62"), 10, 2).tolist() == [66_000, plain("W" * 6_000, "WAW")]


def test_small_ranges_share_a_task_and_read_little(spark, tmp_path):
    r = random.Random(19)
    want = [(f"t{i}", "".join(r.choices(LETTERS, k=r.choice([0, 5, 90, 3_000, 60_000])))) for i in range(60)]
    path = tmp_path / "in" / "a.fasta"
    path.parent.mkdir()
    path.write_text("".join(f">{t}\r\n{x}\r\n" for t, x in want))
    rows = read_fasta(spark, str(path.parent), split=1_000)
    assert rows.rdd.getNumPartitions() == 1  # a thousand before
    got = rows.orderBy("seq_ordinal").collect()
    assert [(x.title, x.residues) for x in got] == want

    class Counted:
        taken = 0

        def __init__(self, file):
            self.file, self.seek = file, file.seek

        def read(self, n):
            data = self.file.read(n)
            Counted.taken += len(data)
            return data

    size = path.stat().st_size
    with path.open("rb") as file:
        found = [x for a in range(0, size, 10_000) for x in fasta.records(Counted(file), a, min(size, a + 10_000))]
    assert len(found) == len(want) and Counted.taken < 8 * size


def test_narrow_tiles_take_many_lanes():
    """Pairs in full with a working set of eight cells: tiles of eight columns, but not a batch for each name."""
    r = random.Random(17)
    texts, query = sorted(("".join(r.choices(LETTERS, k=r.randrange(1, 30))) for _ in range(300)), key=len, reverse=True), "ACDEFWWGHIKL"
    rows = [(0, 7, encode_text(query), len(query), 0)] + [(1, i, encode_text(t), len(t), len(t)) for i, t in enumerate(texts)]
    kinds = zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in kinds], ["side", "id", "codes", "len", "own"])
    got = [x for b in search._scorer(SearchParams(batch_cells=8), None)([batch]) for x in [b.to_pylist()]]
    assert len(got) < 10  # 301 before
    assert {x["db_pos"]: x["score"] for b in got for x in b if x["db_pos"] is not None} == {i: plain(query, t) for i, t in enumerate(texts)}


def test_tiles_hand_on_for_some_queries_at_a_time(monkeypatch):
    r = random.Random(18)
    queries, texts = (["".join(r.choices(LETTERS, k=r.randrange(1, 40))) for _ in range(n)] for n in (9, 20))
    monkeypatch.setattr(kernel, "HANDED_ON", 2_000)
    lanes = kernel.padded([encode_text(t) for t in texts])
    got = kernel.Batch(lanes, matrix("blosum62"), 10, 2, 8).scores([encode_text(q) for q in queries])
    assert got.tolist() == [[plain(q, t) for t in texts] for q in queries]


def test_ungapped_has_no_row_a_cell(spark):
    from strandline.plans import catalogue

    plan = catalogue.ungapped_diagonals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # places of the database, which Spark broadcast, as it takes them for as small as the names


def test_best_diagonals_of_lanes_of_unequal_length():
    r = random.Random(15)
    m = np.array([[r.randrange(-4, 6) for _ in range(24)] for _ in range(24)])  # residues without a code score as well; padding never does
    texts = sorted((bytes(r.choices(range(1, 25), k=r.randrange(1, 12))) for _ in range(30)), key=len)
    lengths = np.array(list(map(len, texts)))
    for query in (bytes(r.choices(range(1, 25), k=n)) for n in (1, 4, 9)):
        want = []
        for t in texts:
            runs = [(-sum(int(m[query[k] - 1, t[k + d] - 1]) for k in range(x, y)), d) for d in range(-len(query), len(t)) for x in range(max(0, -d), len(query)) for y in range(x + 1, min(len(query), len(t) - d) + 1)]
            want.append(min([x for x in runs if x[0] < 0], default=(0, 0)))
        score, diagonal = kernel.best_diagonals(query, kernel.padded(texts), lengths, m)
        assert [(-s, d) for s, d in zip(score.tolist(), diagonal.tolist(), strict=True)] == want


def test_flagship(spark):
    import __spark_entry__ as e

    got = [(r.rank, r.db_pos, r.seq_ordinal, r.score) for r in sorted(e.entry(spark).collect(), key=lambda r: r.rank)]
    want = [(152, 96, 267), (117, 57, 216), (122, 36, 210), (188, 81, 204), (142, 142, 203), (157, 89, 201), (121, 198, 200), (194, 51, 199), (197, 169, 198), (172, 84, 197)]
    assert got == [(k + 1, *x) for k, x in enumerate(want)]
