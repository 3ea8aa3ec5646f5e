"""The registered queries, with their SQL, and the pipeline."""

import collections

import pytest

import corpus_pipeline
from dumpdeck.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, hard, empty):
    """Each stage on what the one before kept; decisions against the operators' own results."""
    docs = hard.select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [collections.Counter((r.doc_id, r.text) for r in docs.collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(collections.Counter((r.doc_id, r.text) for r in docs.collect()))
    for before, after in zip(seen[:3], seen[1:4]):
        assert not after - before  # only rows of the stage before
    assert set(seen[4]) <= set(seen[3]) and max(seen[4].values()) <= 2
    assert all(len(t.split()) >= 50 for _, t in seen[1])
    assert len({"".join(t.split()) for _, t in seen[2]}) == sum(seen[2].values())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(
        {d: n for (d, _), n in seen[4].items()}
    )
    nothing = empty.select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
        assert nothing.count() == 0
        if "text" not in nothing.columns:
            break
