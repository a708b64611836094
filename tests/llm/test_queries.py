import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from panelforge.llm import queries  # noqa: E402
from panelforge.llm.common import table  # noqa: E402

from ..oracle import connect, rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op1_rule_ensemble", "op4_block_rules", "op7_convolution", "op8_licences", "op6_minhash_lines"])
def test_query_has_a_row_for_each_input(spark, name):
    source = "pages" if name.startswith("op4") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == table(spark, SF, source).count()


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        docs = out.checkpoint()
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert 0 < last.count() <= before and last.count() == corpus_pipeline.run(spark, SF).count()
