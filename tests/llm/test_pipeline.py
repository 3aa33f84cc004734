"""The pipeline keeps columns and clean documents, and its stages do what the operators do."""

import corpus_pipeline
from conftest_paths import SF

import __spark_entry__ as entry
from dumplake.llm import line_dedup, simhash_dedup
from dumplake.session import stage


def test_stages(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = stage(step(spark, before, SF), name)
        assert after.columns == columns and after.dtypes == docs.dtypes
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        assert set(new) <= set(old)
        if name == "line_dedup":
            assert set(new) == set(old) and sum(map(len, new.values())) < sum(map(len, old.values()))
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            assert all(old[i] == t for i, t in new.items())
        if name == "simhash_dedup":
            assert set(new) == {r.component_id for r in simhash_dedup.cluster(before).collect()}
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in before.collect()}
    assert sorted(last.collect()) == sorted(entry.queries()["pipeline"](spark, SF).collect())


def test_ten_operators_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert line_dedup.RUN_WORDS == 50


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = stage(step(spark, docs, SF), name)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
