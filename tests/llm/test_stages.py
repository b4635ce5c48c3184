"""Stages of the pipeline on tables whose doc_ids are null or repeated."""

from collections import Counter

import pytest

import corpus_pipeline
from rulewright.llm import decontaminate, simhash
from tests.llm.test_operators import prose

A, B, C, D = (prose(i, 120) for i in range(900, 904))
BENCH = " ".join(A.split()[30:55])


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def counts(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(
    "rows, kept",
    [
        # a null-id copy of a document goes alone
        ([(3, A), (None, A), (None, B), (None, C)], [(3, A), (None, B), (None, C)]),
        # unlike texts without ids stay, copies among them don't
        ([(None, A), (None, B), (None, B), (None, C)], [(None, A), (None, B), (None, C)]),
        # a row with a repeated id goes alone, and the other's group keeps one
        ([(3, B), (5, A), (5, B), (9, A), (None, A)], [(3, B), (5, A)]),
        # two texts with one id stay both, once each
        ([(5, C), (5, D), (5, D), (7, D)], [(5, C), (5, D)]),
    ],
)
def test_keep_first_keeps_one_row_of_each_group(spark, rows, kept):
    assert counts(simhash.keep_first(table(spark, rows))) == Counter(kept)


def test_contaminated_rows_go_alone(spark, tmp_path):
    rows = [(None, A), (None, B), (None, None), (5, A), (5, C), (5, C), (6, D)]
    table(spark, [(1, BENCH)]).withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_contaminated(spark, table(spark, rows), str(tmp_path))
    assert counts(clean) == Counter(r for r in rows if r[1] != A)
    bench = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    assert counts(decontaminate.decontaminate(table(spark, rows), bench)) == Counter([(6, D)])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder, docs = str(tmp_path), spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
