"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapline.llm import (chat_snapshots, embedding_graph, fst_tokens, graph, license_rules, lsh_forest, packing, queries, textcols, toxic_segments, url_trie)
from tapline.llm.scratch import documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in documents(spark, SF).select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary())


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


# -- text helpers

def test_words_do_not_depend_on_the_step():
    rng = random.Random(1)
    rows = ["".join(rng.choice("abA \n\té") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, ""]
    data, offs = textcols.buffer_of(pa.array(rows, pa.string()))
    whole = textcols.words(data, offs)
    for limit in (1, 7, 64):
        part = textcols.words(data, offs, limit=limit)
        assert np.array_equal(whole[0], part[0]) and np.array_equal(whole[1], part[1])
    flat, o = textcols.row_sets(*whole, 5)
    assert np.diff(o).tolist() == [len(shingles(r)) for r in rows]


def test_spanning_forest_and_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    local = dict(graph.spanning(np.array(edges)).tolist())
    assert all(local.get(x, x) == r for x, r in want.items())
    got = graph.components(spark.createDataFrame(edges + [(7, None)], "a long, b long").repartition(7)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


# -- 1

def test_graph_recall(spark):
    """Four labels of different sizes, with pairs, chains and families of near copies among strangers."""
    rng = np.random.default_rng(4)
    rows, at = [], 0
    for label, n in enumerate([300, 900, 2_000, 5_000]):
        x = embedding_graph.unit(rng.normal(size=(n, 64)))
        for lo, size, noise in [(0, 2, 0.03), (10, 3, 0.035), (20, 40, 0.03), (100, 150, 0.03)] + [(i, 2, 0.032) for i in range(260, n - 2, 9)]:
            x[lo:lo + size] = embedding_graph.unit(x[lo] + noise * rng.normal(size=(size, 64)))
        rows += [(at + i, [float(c) for c in v], label) for i, v in enumerate(x)]
        at += n
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8).checkpoint()
    found = embedding_graph.near_duplicates(vecs)
    seen = embedding_graph.audit(vecs, found, every=5).agg(F.sum("n_true").alias("t"), F.sum("n_links").alias("f"), F.max(F.col("n_links") - F.col("n_true")).alias("over")).first()
    assert seen.over <= 0 and seen.t > 2_000 and seen.f >= 0.99 * seen.t


def test_shards_do_not_grow_with_the_label():
    import pandas as pd

    x = np.random.default_rng(1).normal(size=(4_000, 16))
    sample = pd.DataFrame({"label": 0, "dim": 16, "v": list(x)})
    for n in (2_000, 8_000, 32_000):
        k = len(embedding_graph.centroids(sample, {(0, 16): n})[0, 16])
        assert embedding_graph.OVERLAP * n / k == pytest.approx(embedding_graph.TARGET, rel=0.05)


def test_search_finds_all_of_a_dense_family():
    rng = np.random.default_rng(3)
    base = embedding_graph.unit(rng.normal(size=(40, 32)))
    x = embedding_graph.unit(np.concatenate([base, base[:1] + 0.02 * rng.normal(size=(400, 32)) / 5.6]))
    lists = embedding_graph.robust_prune(x)
    adjacency = np.full((len(x), max(map(len, lists))), -1)
    for i, n in enumerate(lists):
        adjacency[i, :len(n)] = n
    q, n = embedding_graph.range_search(x, adjacency, embedding_graph.medoids(x), np.arange(len(x)), 0.93)
    got = {(a, b) for a, b in zip(q.tolist(), n.tolist()) if a != b and x[a] @ x[b] >= 0.93}
    sim = x @ x.T
    want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(sim >= 0.93))) if a != b}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_search_reaches_all_large_families():
    rng = np.random.default_rng(12)
    base = embedding_graph.unit(rng.normal(size=(20, 64)))
    base[1] = embedding_graph.unit(base[:1] + 0.3 * base[1:2])[0]  # linked with the first, nearer to its own
    x = embedding_graph.unit(np.repeat(base, 100, axis=0) + 0.02 / 8 * rng.normal(size=(2_000, 64)))
    lists = embedding_graph.robust_prune(x)
    adjacency = np.full((len(x), max(map(len, lists))), -1)
    for i, n in enumerate(lists):
        adjacency[i, :len(n)] = n
    got = set()
    for lo in range(0, len(x), 128):
        some = np.arange(lo, min(lo + 128, len(x)))
        q, n = embedding_graph.range_search(x, adjacency, embedding_graph.medoids(x), some, 0.93)
        got |= {(a, b) for a, b in zip(some[q].tolist(), n.tolist()) if a != b and x[a] @ x[b] >= 0.93}
    want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93))) if a != b}
    assert got <= want and len(got) >= 0.99 * len(want) > 200_000


def test_links_of_a_family_of_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "TARGET", 40)
    rng = np.random.default_rng(13)
    base = embedding_graph.unit(rng.normal(size=(2_501, 64)))
    x = np.concatenate([base[1:], embedding_graph.unit(base[:1] + 0.2 / 8 * rng.normal(size=(1_500, 64)))])
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_graph.near_duplicates(df).collect()}
    x = embedding_graph.unit(x)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    links = np.array([got[i][0] for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum() > 1_000_000
    assert {got[i][1] for i in range(2_500, 4_000)} == {2_500}


# -- 3

def near_copies(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out, passage = [], [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(30, 120))]
        if rng.random() < 0.5:
            base[10:10] = passage
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    family = [word() for _ in range(150)]
    for _ in range(700):  # a region larger than REGION
        copy = list(family)
        copy[rng.randrange(150)] = word()
        out.append(" ".join(copy))
    return out


def test_forest_equals_all_pairs(spark):
    rows = near_copies(random.Random(4))
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j):
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(df).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_pairs_in_a_template_crowd(spark):
    """Documents of one template, most of them strangers near 0.7; the ids of linked ones are far apart."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, n = [word() for _ in range(100)], 1_200
    rows = [template + [word() for _ in range(20)] for _ in range(n)]
    for i in range(0, n // 2, 6):  # the partner keeps two of its own words: near 0.75
        rows[i + n // 2] = rows[i][:103 + i // 6 % 3] + [word() for _ in range(17 - i // 6 % 3)]
    sets = [shingles(" ".join(r)) for r in rows]
    place = {s: k for k, s in enumerate(sorted({s for x in sets for s in x}))}
    held = np.zeros((n, len(place)), np.float32)
    for i, x in enumerate(sets):
        held[i, [place[s] for s in x]] = 1
    common = held @ held.T
    size = held.sum(axis=1)
    a, b = np.nonzero(np.triu(100 * common >= 75 * (size[:, None] + size - common), 1))
    root = dict(graph.spanning(np.stack([a, b], axis=1)).tolist())
    assert len(root) > 50
    df = spark.createDataFrame(list(enumerate(map(" ".join, rows))), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df).collect()}
    assert got == {i: root.get(i, i) for i in range(n)}


# -- 4 and 10

ODD = ["", "  ", " a", "a  b", "a\n\nb", "a \n b\t\tc", "don't they're I'll 'tis 's's 're' 'r 'v'l'll ''s '\n's \n'd x'S", "<|endoftext|>",
       "a<|endoftext|> b <|endoftext|>", "<|endoftext|", "日本語 テスト １２３ ²½ é́   x 　y", "a" * 5000, "ab " * 100 + " " * 50 + "\n" * 30, "'r", "it'r e", "x're're",
       "\t's", "🙂🙂 👩‍👩‍👧 ‍", "\x00\x01 \x1c\x1d a\x1f\x85b", "é กำ ١٢", "'", "'l", "'v ", "'ll", "    x", "\U00010d45 \ua7cb"]


def test_counts_equal_the_library(texts, library):
    rng = random.Random(5)
    alphabet = "aeiorstnlvdm'  \n\t.,!1²é日🙂A"
    rows = ODD + list(texts.values()) + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(400)]
    got = fst_tokens.count_rows(pa.array(rows, pa.string()), fst_tokens.vocabulary_bytes(queries.vocabulary()))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]


def test_chunk_maps_compose():
    rng = np.random.default_rng(6)
    maps = rng.integers(0, 12, size=(37, 12)).astype(np.uint8)
    scan = fst_tokens.compose_scan(maps)
    state = np.arange(12)
    for i in range(37):
        assert np.array_equal(scan[i], state)
        state = maps[i][state]


def test_packed_pieces_round_trip(spark, texts, library):
    docs = documents(spark, SF)
    rows = packing.pack_documents(docs, queries.vocabulary(), with_ids=True).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, ps in by_doc.items():
        ps.sort(key=lambda r: r.piece)
        ids = library.encode(texts[d], add_special_tokens=False).ids + [2]
        assert [i for p in ps for i in p.ids] == ids and [p.piece for p in ps] == list(range(len(ps)))
        assert all(p.start == sum(q.length for q in ps[:p.piece]) and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in ps)
        assert all(p.length == 1024 for p in ps[1:]) and (len(ids) <= 1024) == (len(ps) == 1)
    for ps in by_bin.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:i]) for i in range(len(ps))] and sum(p.length for p in ps) <= 1024
    assert len(by_bin) <= 1.03 * math.ceil(sum(r.length for r in rows) / 1024)


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


# -- 5

def test_snapshots_by_brute_force(spark):
    rng = random.Random(7)
    logs = []
    for _ in range(30):
        turns = [(rng.choice(["user", "assistant"]), f"t{rng.randrange(6)}") for _ in range(rng.randint(1, 8))]
        logs += [turns[:k] for k in range(1, len(turns) + 1) if rng.random() < 0.6] or [turns]
    rows = [(c, i * 700, role, text) for c, turns in enumerate(logs) for i, (role, text) in enumerate(turns)]  # turn numbers in several chunks
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = {}
    for c, turns in enumerate(logs):
        longer = any(len(o) > len(turns) and o[:len(turns)] == turns for o in logs)
        if not longer and turns not in logs[:c]:
            want[c] = (len(turns), logs.count(turns), "".join(f"<{r}>\n{t}\n" for r, t in turns))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_snapshots.texts(df).collect()}
    assert got == want


# -- 6

def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(8)

    def brute(s):
        if not len(s):
            return []
        c = np.concatenate([[0], np.cumsum(s)])
        best = max(((c[j] - c[i], -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), key=lambda x: (round(x[0], 9), x[1], -x[2]))
        if best[0] <= 0:
            return []
        _, _, i, j = best
        return brute(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(s[j:])]
    for _ in range(60):
        s = np.round(rng.normal(size=rng.integers(0, 25)), 3) + rng.random(1) * 1e-3
        got = [(a, b) for a, b, _ in toxic_segments.segments(s)]
        assert got == brute(s)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = documents(spark, sf).join(documents(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    labels = documents(spark, sf, "labels")
    scored = toxic_segments.score(docs, toxic_segments.train(docs, labels)).where(queries.language_mixture.fold_of(F.col("doc_id"), 5) == 0)
    got = scored.join(labels, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in got}
    assert share[1] >= 0.55 and share[0] < 0.01


# -- 7

def test_base_phrases_by_brute_force(spark, texts):
    rows = dict(texts) | {10 ** 6: "MIT License mit license, Apache\nLicense! general public-license mit licenses 9mit license"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in license_rules.scan(df).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in rows[r.doc_id]))
        places = [(i, label) for phrase, label in license_rules.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), first, last)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_contained_detections_are_suppressed(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-3.0-or-later")], "doc_id long, text string")
    r = license_rules.scan(df).first()
    assert (r.labels, r.base_labels, r.score) == ("apache,apache-2.0,gpl-3.0", "apache", 1.0)
    assert len({x[1] for x in license_rules.rules()}) > 200


# -- 8

def test_longest_rule_wins_and_ties_block():
    trie = url_trie.Trie([("allow", "a.com", "/x"), ("block", "a.com", "/x/y"), ("allow", "b.a.com", "/"), ("block", "a.com", "/x")])
    assert trie.match("a.com", "/xy") == ("block", "a.com/x") and trie.match("c.a.com", "/x/yz") == ("block", "a.com/x/y")
    assert trie.match("b.a.com", "/x/y") == ("allow", "b.a.com/") and trie.match("com", "/x") is None


# -- 9

def test_languages_on_held_out_rows(spark):
    got = queries.QUERIES["op9_language_mixture"](spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95
