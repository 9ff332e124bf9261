"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns: a defined result for each."""

import pytest
from pyspark.sql import functions as F

from tapline.llm import (chat_snapshots, containment, embedding_graph, fst_tokens, language_mixture, license_rules, lsh_forest, packing,
                         toxic_segments, url_trie)
from tapline.llm.queries import vocabulary

LONG = "la casa de los perros " * 40_000
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three four five six mit license"), (4, "one two three four five six mit license"),
         (None, "one two three four five six mit license"), (5, LONG), (6, "12 34 !!"), (7, "x" * 300_000)]
CLASH = ["_norm", "_words", "n_words", "h", "pos", "keys", "region", "sequence_id", "offset", "score", "label", "_id", "_text", "_leaked", "item_id",
         "fp1", "component_id", "kept", "_kept", "lang", "n_tokens", "bucket"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH})
    return df.withColumn("lang", F.when(F.col("doc_id").isin(4, 5), F.when(F.col("doc_id") == 5, "es").otherwise("en")))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_token_counts(docs, none):
    rows = by_id(fst_tokens.token_counts(docs, vocabulary()))
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in rows[:3]] == [(1, 0, 0), (2, 0, 0), (3, 5, rows[2].n_tokens)]
    assert len(rows) == len(TEXTS) and rows[-1].doc_id is None and rows[-1].n_tokens == rows[3].n_tokens == rows[4].n_tokens
    assert fst_tokens.token_counts(none, vocabulary()).collect() == []


def test_packing(docs, none):
    rows = packing.pack_documents(docs, vocabulary()).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert all(r.length == 1 for r in rows if r.doc_id in (1, 2)) and sum(r.doc_id == 4 for r in rows) == 2
    assert packing.pack_documents(none, vocabulary()).collect() == []


def test_near_duplicates(docs, none):
    rows = by_id(lsh_forest.near_duplicates(docs))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows]
    assert got[:3] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert got[3] == got[4] == (4, 4, 4, True) and got[-1] == (None, 4, None, True)
    assert got[5][1:] == (5, 5, True) and got[7] == (7, 1, 7, True)
    assert lsh_forest.near_duplicates(none).collect() == []
    stay = lsh_forest.survivors(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id or 0 for r in stay.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_containment(spark, docs, none):
    items = spark.createDataFrame([(10, "three four five six mit license"), (11, None), (12, ""), (13, "12 34 !!"), (10, "three four five six mit license")],
                                  "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.n_shared, r.n_item) for r in containment.leaks(docs, items).collect())
    assert got == [(0, 10, 2, 2)] * 2 + [(4, 10, 2, 2)] * 4 + [(6, 13, 1, 1)]
    assert containment.leaks(none, items).collect() == [] and containment.leaks(docs, items.where("false")).collect() == []
    assert containment.clean(docs, items).columns == docs.columns
    assert sorted(r.doc_id for r in containment.clean(docs, items).select("doc_id").collect()) == [1, 2, 3, 5, 7]


def test_licenses(docs, none):
    rows = by_id(license_rules.scan(docs))
    assert [tuple(rows[0])[1:], tuple(rows[3])[1:]] == [(0, 0, None, None, "", "", 0.0), (8, 1, 6, 6, "mit", "mit", 0.6)]
    assert rows[3][1:] == rows[4][1:] == rows[-1][1:] and rows[5].n_words == 200_000
    assert license_rules.scan(none).collect() == []


def test_languages(docs, none):
    model = language_mixture.train(docs)
    got = {(r.doc_id, r.lang_pred) for r in language_mixture.predict(docs, model).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (5, "es"), (6, "und"), (7, "en")} or \
        got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (5, "es"), (6, "und"), (7, "es")}
    assert language_mixture.predict(none, model).collect() == []
    blank = language_mixture.train(none)
    assert {r.lang_pred for r in language_mixture.predict(docs, blank).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxic_segments.train(docs, labels)
    rows = toxic_segments.score(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxic_segments.score(none, model).collect() == []
    assert {r.score for r in toxic_segments.score(docs, toxic_segments.train(none, labels)).collect()} < {0.0} | {r.score for r in rows} | {1 / (1 + 2.718281828459045 ** 30)}
    assert toxic_segments.accepted(docs, model).columns == docs.columns


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com?x=/en/", "a://b.net/fr/", "a://b.net/fr",
            "://net/es/#", "http://example.com/en/://x", "http://notexample.com/en/", "http://spam-farm.example.org/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trie.judge(pages).collect()}
    assert [got[i] for i in range(4)] == [("", "", None, "allow")] * 4
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[5] == ("example.com", "", None, "allow") and got[6] == ("b.net", "/fr/", "net/fr/", "block")
    assert got[7] == ("b.net", "/fr", None, "allow") and got[8] == ("net", "/es/", "net/es/", "block")
    assert got[9] == ("example.com", "/en/://x", "example.com/en/", "block") and got[10][2:] == ("com/", "allow")
    assert got[11] == ("spam-farm.example.org", "/", None, "block")
    assert url_trie.judge(pages.where("false")).collect() == []


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo"),
            (4, None, None, None), (None, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 0, "user", "ho")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("h", "pos", "chunk", "n_turns")})
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_snapshots.texts(convs).collect()}
    assert got[1] == (2, 2, "<user>\nhi\n<assistant>\nyo\n") and got[4] == (1, 1, "<unknown>\n\n") and set(got) == {1, 4, 5}
    assert chat_snapshots.digest(convs.where("false")).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [0.0, 0.0], 0), (5, None, 0), (6, [1.0, None], 0), (7, [nan, 1.0], 0),
            (8, [inf, 1.0], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0), (2, [2.0, 0.0], 0),
            (13, [1.0, 0.0], 0)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("v", "homes", "shard", "n_links")})
    got = embedding_graph.near_duplicates(vecs).collect()
    linked = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows) and linked[1] == (3, 1, True) and linked[2] == linked[13] == linked[3] == (3, 1, False)
    assert all(linked[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and linked[None] == (0, None, True)
    assert embedding_graph.near_duplicates(vecs.where("false")).collect() == []
