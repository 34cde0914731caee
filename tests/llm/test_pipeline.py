"""Each stage of the corpus pipeline on its own input, against a plain statement of it."""

import corpus_pipeline as cp
from ferrule.llm import text_arrays as ta

from .test_llm import SF, brute_leaks, brute_links


def test_stages(spark):
    docs = ta.table(spark, SF, "documents")
    columns = docs.columns
    benchmark = [(r.item_id, r.text) for r in ta.table(spark, SF, "benchmark").collect()]
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = ta.cut(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(after[i] == before[i] for i in after)
        rows = sorted((i, r.text) for i, r in before.items())
        if name == "ngram_jaccard_join":
            assert set(after) == {c for _, c, _ in brute_links(rows).values()}
        if name == "benchmark_decontamination":
            assert set(before) - set(after) == {i for i, _ in brute_leaks(rows, benchmark)}
        if name == "byte_level_bpe":
            assert set(after) == set(before) and all(r.round_trip for r in after.values())
    assert len(after) > 100


def test_empty(spark):
    docs = ta.table(spark, SF, "documents").limit(0)
    for name, stage in cp.STAGES:
        docs = ta.cut(stage(spark, docs, SF), name)
    assert docs.count() == 0
