"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from kinledger.llm import chat, decontaminate, extract, linechunks, minhash, mixing, quality, toxicity, urlfilter, warc
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i * 7 % 20] + str(i % 997) for i in range(60_000))
ROWS = [
    (1, "a plain text of some words\nin two lines", "en", "a", 40),
    (1, "a plain text of some words\nin two lines", "en", "a", 40),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "text without an id", "en", "b", 18),
    (4, LONG, "en", "b", len(LONG)),
    (5, " \t\n \u00a0 \n", "de", None, 6),
    (6, "!!! ??? ...", "de", "c", 11),
    (7, "\u00e9\u00e8\u4e2d\U0001f600 word\x00word", "fr", "c", 13),
    (8, LONG + " end", "en", "b", len(LONG) + 4),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("key", "node", "size", "copies", "n_words", "bands", "bucket", "root", "target", "score", "rank", "hash", "places", "toxic", "quality", "value", "hit_words")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ROWS, DDL).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (3, 1, None), (None, 1, 1), (6, None, 0), (99, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "some words"), (1, "one two three")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/x", "<p>text"), (2, None, None), (None, "no scheme", ""), (3, "http://a.com/x", "<p>text"), (4, "", "<<<>>&#x110000; &bad; <p"), (1, "http://a.com/x", "<p>text")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", ""), (2, 5, "assistant", "\\n<next/>### x: </turn>\n")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d


QUERIES = [
    warc.op1_warc, extract.op2_html_extraction, toxicity.op3_toxicity, urlfilter.op4_url_filter, chat.op5_chat,
    minhash.op6_near_duplicates, linechunks.op7_line_chunks, decontaminate.op8_decontaminate, mixing.op9_mixing, quality.op10_quality,
]
ROWS_OF = dict.fromkeys(QUERIES, len(ROWS)) | {warc.op1_warc: 6, extract.op2_html_extraction: 6, urlfilter.op4_url_filter: 6, chat.op5_chat: 4}


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_odd_rows(spark, sf, query):
    assert query(spark, sf).count() == ROWS_OF[query]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).count() == (1 if query is chat.op5_chat else 0)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_that_clash(spark, sf, empty, name, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"my {c}"))
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert rows
    if name != "mixing":
        assert out.columns == docs.columns
        assert all(r[c] == f"my {c}" for r in rows for c in CLASHING)
    assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), sf).count() == 0


def test_run_on_odd_and_empty_documents(spark, sf, empty):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_defined_results(spark, sf):
    near = {(r.doc_id, r.class_id, r.kept) for r in minhash.op6_near_duplicates(spark, sf).collect()}
    assert (8, 4, False) in near and (4, 4, True) in near
    assert {(2, 2, True), (3, 3, True), (6, 6, True), (None, None, True)} <= near
    lines = {r.doc_id: r for r in linechunks.op7_line_chunks(spark, sf).collect()}
    assert lines[2].text is None and lines[3].text == ""
    scores = [r for r in toxicity.op3_toxicity(spark, sf).collect()]
    assert all(0 <= r.score <= 1 for r in scores)
    found = {r.doc_id: r for r in decontaminate.op8_decontaminate(spark, sf).collect()}
    assert found[1].n_items == 1 and found[1].n_hit == 2 and found[2].n_words == 0
    judged = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    assert judged[2].n_words == 0 and judged[2].base_failed and not judged[3].kept
    assert judged[7].word_chars == 13 and judged[7].n_words == 2
