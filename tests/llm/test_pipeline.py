"""The pipeline's stages against brute force on a small table, and the run as a whole."""

from collections import Counter

import corpus_pipeline as cp
from corpuslab.llm import decontaminate, packing
from tests.llm.test_operators import SF, brute_links, shingle_set


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality", "near_duplicates", "decontaminate", "pack"]


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs_table):
    rows = docs_table.collect()
    kept = cp.near_duplicates(spark, docs_table, SF)
    assert kept.columns == docs_table.columns
    named = [r for r in rows if r.doc_id is not None]
    want = brute_links([(r.doc_id, shingle_set(r.text, 5)) for r in named], 80)
    ids = {r.doc_id for i, r in enumerate(named) if not shingle_set(r.text, 5) or want[i][1] == r.doc_id}
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*ids, None])


def test_near_duplicates_judges_different_texts_of_one_id_apart(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = lambda t: t + " end"
    rows = [(1, a), (5, near(a)), (5, b), (5, b), (7, near(b)), (8, c), (8, d), (9, near(c)), (8, near(d)), (10, ""), (None, a)]
    kept = cp.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    got = Counter(map(tuple, kept.collect()))
    assert {k: n for k, n in got.items() if k[1] not in (d, near(d))} == {(1, a): 1, (5, b): 1, (8, c): 1, (10, ""): 1, (None, a): 1}
    assert sum(n for k, n in got.items() if k[1] in (d, near(d))) == 1


def test_filter_stages_keep_columns_and_rows(spark, docs_table):
    for stage in (cp.language_id, cp.quality_filter, cp.decontaminate):
        out = stage(spark, docs_table, SF)
        assert out.columns == docs_table.columns and out.dtypes == docs_table.dtypes
        assert not (Counter(map(tuple, out.collect())) - Counter(map(tuple, docs_table.collect())))
    kept = {r.doc_id for r in cp.language_id(spark, docs_table, SF).collect()}
    assert kept >= {1, 2, 3, 6, 7, 8, 9, 10, None} and not kept & {4, 5, 11, 13}


def test_run(spark):
    pieces = cp.run(spark, SF)
    assert pieces.columns[:3] == ["doc_id", "start", "length"] and pieces.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hit = {r.doc_id for r in decontaminate.overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not hit & {r.doc_id for r in pieces.collect()}


def test_empty_table_passes_every_stage(spark, docs_table):
    docs = docs_table.where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if docs.columns[:2] == ["doc_id", "start"]:
            break
    assert packing.BlockPacker((256, 512)).last() == []
