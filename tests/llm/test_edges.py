"""Every query and stage over odd tables: nulls everywhere, empty tables, repeated rows, clashing columns."""

import pytest

import corpus_pipeline as cp
from ferrule.llm import registry
from ferrule.llm import text_arrays as ta

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score double, Payload string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string, record_type string",
}
LONG = "word " * 60000
ROWS = {
    "documents": [
        (1, None, None, None, None, None, None), (None, "a text without an id", "en", "s", 1, 1.0, "x"), (None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, 0.0, ""), (3, "the same text here for all", None, "s", 5, None, None), (3, "the same text here for all", None, "s", 5, None, None),
        (4, "the same text here for all", "en", None, 5, 2.0, None), (5, LONG, "en", "s", 9, None, None), (6, "\n\n \t", "de", "s", 3, None, None), (7, "42 ##", "de", "s", 3, None, None),
    ],
    "labels": [(1, None, None), (None, 1, 1), (3, 1, 0), (3, 1, 0), (4, 0, 1), (5, 0, 0), (99, 1, 1)],
    "benchmark": [(None, "the same text here for all"), (1, None), (2, ""), (3, "same text"), (3, "same text")],
    "pages": [(1, None, None, "r"), (None, "u", "<p>x</p>", None), (2, "u", "<p>x</p>", None), (2, "u", "<p>x</p>", None), (3, "u", "", None)],
}
NAMES = list(registry.queries())


def folder(spark, path, rows):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name] if rows else [], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), None)


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd, name):
    got = registry.queries()[name](spark, odd).collect()
    if name.startswith("op3_"):
        hits = {(r.doc_id, r.item_id) for r in got}
        assert hits == {(i, k) for i in (3, 4) for k in (None, 3)}
    else:
        assert len(got) == len(ROWS["pages" if name.startswith("op7_") else "documents"])


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def test_odd_pipeline(spark, odd, empty):
    docs = ta.table(spark, odd, "documents")
    for name, stage in cp.STAGES:
        columns = docs.columns
        docs = ta.cut(stage(spark, docs, odd), name)
        assert docs.columns[: len(columns)] == columns
    assert cp.run(spark, empty).count() == 0


def test_values_of_odd_rows(spark, odd):
    run = lambda name: registry.queries()[name](spark, odd).collect()
    links = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in run("op1_ngram_jaccard") if r.doc_id), key=repr)
    assert links == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 2, 3, 2), (3, 2, 3, 2), (4, 2, 3, 2), (5, 1, 5, 0), (6, 0, 6, 0), (7, 1, 7, 0)]
    assert {r.doc_id: r.lang_pred for r in run("op5_language_id") if r.doc_id in (1, 2, 6)} == {1: "und", 2: "und", 6: "und"}
    pages = {(r.page_id, r.record_type, r.refers_to) for r in run("op7_warc")}
    assert pages == {(1, "response", None), (3, "revisit", 1), (2, "response", None), (None, "revisit", 2)}
    scores = [r.score for r in run("op6_toxicity")]
    assert all(0 <= s <= 1 for s in scores)
    assert {r.doc_id: r.n_tokens for r in run("op4_lm_attention") if r.doc_id in (1, 5)} == {1: 1, 5: 60001}


def test_pipeline_keeps_values_of_clashing_columns(spark, tmp_path_factory):
    w = [f"w{i}" for i in range(60)]
    text, near, other = (" ".join(x) for x in (w, ["x", *w[1:]], [f"v{i}" for i in range(60)]))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, ids string, n_tokens string"
    rows = [(i, t, "en", "s", 1, float(-i), f"l{i}", f"i{i}", f"n{i}") for i, t in ((1, text), (1, other), (2, near))]
    sf = str(tmp_path_factory.mktemp("clash"))
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], SCHEMAS["labels"]).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(5, other)], SCHEMAS["benchmark"]).write.parquet(f"{sf}/benchmark.parquet")
    docs = ta.table(spark, sf, "documents")
    kept = []
    for name, stage in cp.STAGES:
        docs = ta.cut(stage(spark, docs, sf), name)
        kept.append(sorted((r.doc_id, r.text == text, r.score, r.lang_pred, r.ids, r.n_tokens) for r in docs.collect()))
    one, two, three = (1, True, -1.0, "l1", "i1", "n1"), (1, False, -1.0, "l1", "i1", "n1"), (2, False, -2.0, "l2", "i2", "n2")
    # the near copy goes, the other text of the same id stays until the benchmark takes it
    assert kept == [[two, one, three], [two, one, three], [two, one], [one], [one]]
    assert {"ids_", "n_tokens_", "round_trip"} <= set(docs.columns)
