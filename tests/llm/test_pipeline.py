import re

import corpus_pipeline
from strandline.llm import mixing

from .helpers import SCHEMA, WORD, components, grouped
from .test_joins import decontaminated, shingle_set
from .test_secrets import brute as secrets_of

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_001, None, "en", "src1", 0), (10_002, "", "en", None, 0), (10_003, "123 456", "de", "src1", 7), (10_004, "Ünder token = abcdefghijklmnop1", None, None, 31), (None, "a text without an id", "en", "src1", 20)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    texts = by_id(docs)
    stages = dict(corpus_pipeline.STAGES)

    spoken = stages["language"](spark, docs, SF)
    assert spoken.columns == docs.columns
    kept = by_id(spoken)
    assert kept.keys() == {i for i, r in texts.items() if r.text and re.search(r"[^\W\d_]", r.text)} and all(kept[i] == texts[i] for i in kept)

    single = stages["near_duplicates"](spark, spoken, SF)
    ids = sorted(i for i in kept if i is not None)
    sets = [shingle_set(kept[i].text) for i in ids]
    links = [(x, y) for x in range(len(ids)) for y in range(x) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    left = by_id(single)
    assert links and left.keys() == {ids[i] for i, root in enumerate(components(len(ids), links)) if root == i} | {None}

    clean = stages["decontamination"](spark, single, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    order = list(left)
    hit = decontaminated([left[i].text for i in order], items)
    fine = by_id(clean)
    assert fine.keys() == {i for i, h in zip(order, hit, strict=True) if not h[1]} and len(fine) < len(left)

    masked = stages["secrets"](spark, clean, SF)
    hidden = by_id(masked)
    assert hidden.keys() == fine.keys() and masked.columns == docs.columns
    for i, r in hidden.items():
        if secrets_of(fine[i].text):
            assert "[SECRET]" in r.text and not secrets_of(r.text) and r.n_chars == len(r.text)
        elif r != fine[i]:
            assert "[SECRET]" in r.text  # a linked weak part

    mixed = stages["mixing"](spark, masked, SF)
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    mixed = mixed.collect()
    size = {i: len(WORD.findall(r.text)) for i, r in hidden.items()}
    assert len(mixed) < len(size) and all(r.size == size[r.doc_id] and r.text == hidden[r.doc_id].text and r.copies in (1, 2) and r.taken == r.copies * r.size for r in mixed)
    total = {s: sum(size[r.doc_id] for r in own) for s, own in grouped(hidden.values(), "source").items()}
    want = mixing.targets(total)
    for source, own in grouped(mixed, "source").items():
        assert abs(sum(r.taken for r in own) - want[source]) <= max(size[i] for i, r in hidden.items() if r.source == source) + 1


def test_run_and_empty_tables(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert 100 < len(got) <= 200 and {r.copies for r in got} == {1, 2}
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_repeated_rows_and_extra_columns_pass_through(spark):
    text = " ".join(f"word{i}" for i in range(60)) + " token = abcdefghijklmnop1"
    row = (1, text, "en", "s", 0, 1, "k", "w", 2, 3, 4, "h", 5, 6, 7)
    docs = spark.createDataFrame([row, row, (2, *row[1:]), (None, *row[1:])], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert sorted((r.doc_id or 0, r.text.endswith("[SECRET]"), r.words, r.row) for r in docs.collect()) == [(0, True, "w", 1), (1, True, "w", 1), (1, True, "w", 1)]


def test_language_keeps_texts_when_none_is_learned(spark):
    texts = ["plain text", "Ünder", None, "", "12 34"]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 1, "k", "w", 2, 3, 4, "h", 5, 6, 7) for i, t in enumerate(texts)], SCHEMA)
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]


#: Names that stages and operators use for columns of their own.
INSIDE = (
    "found", "gone", "contaminated_id", "contaminated", "secret_id", "secret_hash", "secret_spans", "mixed_row", "row", "size", "source_size", "target", "copies", "taken", "cell", "at", "n", "skip", "rate",
    "start", "source_no", "text_hash", "spans", "hits", "windows", "no", "ids", "component_id", "root", "key", "id", "a", "b", "_found", "_row", "_spans", "_id", "_hash", "_hit", "_gone", "lang_pred", "score", "words", "block", "near", "length", "x",
)


def test_names_of_users_columns_are_theirs(spark):
    """Documents with every name that stages use inside: no stage fails, and every value comes out as it went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in INSIDE))
    before, now = by_id(docs), docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.columns[: len(docs.columns)] == docs.columns, name
        for i, r in by_id(now).items():
            assert all(r[c] == before[i][c] for c in INSIDE), name
    assert now.columns[len(docs.columns) :] == [f"{c}_" for c in ("size", "source_size", "target", "copies", "taken")]
    assert 0 < now.count() < len(before) and now.where("copies_ < 1").isEmpty()


def test_mix_is_the_same_in_every_run(spark):
    """Rows that share an id: after another dealing each text has the same copies."""
    docs = spark.range(900).selectExpr("if(id % 3 = 0, 7, id) doc_id", "repeat('w ', cast(20 + id % 4 as int)) || id text", "concat('s', id % 2) source")
    runs = [sorted((r.doc_id, r.text, r.copies) for r in corpus_pipeline.mixed(spark, docs.repartition(n), SF).collect()) for n in (1, 7, 13)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 300
