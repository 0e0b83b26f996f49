import corpus_pipeline as C
from orderscope.llm import near_dedup as N
from orderscope.llm.common import table, tune

from ..conftest import SF_SMALL

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
NEAR_B = B + " c"


def components(spark, rows):
    tune(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect())


def test_repeated_id_that_is_no_representative(spark):
    got = components(spark, [(2, A), (3, A), (3, B), (4, NEAR_B), (5, "other words of no group at all")])
    assert got == [(2, 56, 2, True), (3, 56, 2, False), (3, 56, 2, False), (4, 57, 2, False), (5, 3, 5, True)]


def test_empty_text_beside_a_linked_one(spark):
    assert components(spark, [(2, A), (3, ""), (3, A), (3, None), (4, ""), (4, "")]) == [
        (2, 56, 2, True), (3, 0, 2, False), (3, 0, 2, False), (3, 56, 2, False), (4, 0, 4, True), (4, 0, 4, True)]


def test_ids_that_join_several_classes(spark):
    far = " ".join(f"d{i}" for i in range(60))
    got = components(spark, [(1, far), (5, B), (5, A), (6, A), (6, far), (2, B), (7, NEAR_B), (3, A)])
    assert {c for _, _, c, _ in got} == {1}


def test_pipeline_keeps_one_whole_row_by_a_fixed_rule(spark):
    schema = table(spark, SF_SMALL, "documents").schema
    row = lambda i, t, source: {"doc_id": i, "text": t, "lang": "en", "source": source, "n_chars": len(t)}
    rows = [row(2, A, "x"), row(3, A, "x"), row(3, B, "x"), row(4, NEAR_B, "x"), row(8, "short", "z"),
            row(8, "a longer text", "a"), row(8, "a longer text", "b"), row(8, "", "z")]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in given], schema).repartition(3)
        got = sorted((r.doc_id, r.text, r.source) for r in C.duplicates(spark, df, SF_SMALL).collect())
        assert got == [(2, A, "x"), (8, "a longer text", "b")]
