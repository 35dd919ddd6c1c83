"""The pipeline against its stages by brute force, and the queries against their SQL twins."""

import os

import pytest

import corpus_pipeline
from compare import database, differences
from panelry.llm.oracle import ORACLES
from panelry.llm.queries import QUERIES
from panelry.llm.shared import components, table
from test_documents import brute_near, brute_removed

SF_DIR = os.environ.get("PANELRY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql_twin(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), database(SF_DIR), ORACLES[name]) == []


def test_each_operator_has_one_query():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_stages_do_what_brute_force_does(spark):
    docs = table(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF_DIR)
    scores = {r.doc_id: r.predicted for r in QUERIES["op6_quality"](spark, SF_DIR).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in scores.items() if p)
    texts = [(r.doc_id, r.text) for r in good.collect()]
    single = stages["MinHash near-dedup"](spark, good, SF_DIR)
    groups = [eval(x) for x in brute_near(texts, 80)]
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, g in groups if i == g)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    cut = stages["suffix-array dedup"](spark, single, SF_DIR)
    left = {i: n - gone for i, n, gone, _, _ in map(eval, brute_removed(rows))}
    for r in cut.collect():
        assert left[r.doc_id] - 6 <= len(r.text.encode()) <= left[r.doc_id] and r.n_chars == len(r.text)
    for frame in (good, single, cut):
        assert frame.columns == docs.columns
    mixed = stages["mixing sources to target weights"](spark, cut, SF_DIR)
    assert mixed.columns == docs.columns
    packed = stages["best-fit packing"](spark, mixed, SF_DIR)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_ends_in_sequences(spark):
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.count() > 0 and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {700 + i: 700 for i in range(9)}
    assert got == want


def test_stages_take_no_rows_repeated_ids_and_extra_columns(spark, odd_documents):
    """Every stage on odd rows, and on none of them, keeps the columns it was given; the last one packs all that is left."""
    for docs in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, docs, SF_DIR)
            assert left.columns == docs.columns, name
            docs = spark.createDataFrame(left.collect(), left.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
        assert packed.where("piece = 0").count() == docs.count()
        assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
