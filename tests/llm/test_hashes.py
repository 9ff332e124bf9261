"""Span hashes: equal spans alike, self-similar patterns apart, in the helpers and in the operators built on them."""

import numpy as np
import pytest

from tapline.llm import containment, fst_tokens, lsh_forest, packing
from tapline.llm import textcols as T
from tapline.llm.queries import vocabulary


def thue_morse(n):
    """Two words that agree under every polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_patterns_differ_and_places_do_not_matter(n):
    a, b = thue_morse(n)
    data = np.frombuffer(f"xx{a}{b}yyy{a}".encode(), np.uint8)
    starts = np.array([2, 2 + n, 5 + 2 * n])
    h = T.span_hashes(data, starts, starts + n)
    assert h[0] == h[2] != h[1]


def test_no_collision_among_many_short_spans():
    data = np.arange(200_000, dtype=np.uint32) * 7919 % 1_000_003
    s = np.arange(len(data) - 3)
    assert len(np.unique(T.span_hashes(data, s, s + 3))) == len(np.unique(np.stack([data[:-3], data[1:-2], data[2:-1]], 1), axis=0))


def test_tables_of_powers_grow():
    up, down = T.prime_powers(300_000)
    p = (1 << 31) - 1
    for i in (0, 1, 65_535, 65_536, 299_999):
        assert int(up[i]) % p == pow(T._PRIME_BASE, i, p) and int(up[i]) * int(down[i]) % p == 1


@pytest.mark.parametrize("n", [1024, 4096])
def test_operators_tell_patterns_apart(spark, n):
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    tok = Tokenizer.from_file(vocabulary())
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    want = {i: tok.encode(t, add_special_tokens=False).ids for i, t in ((1, a), (2, b))}
    assert {r.doc_id: r.n_tokens for r in fst_tokens.token_counts(docs, vocabulary()).collect()} == {i: len(x) for i, x in want.items()}
    got = {(r.doc_id, r.piece): r.ids for r in packing.pieces(docs, vocabulary(), with_ids=True).collect()}
    assert all([x for (d, _), ids in sorted(got.items()) if d == i for x in ids] == want[i] + [2] for i in want)
    assert all(r.kept for r in lsh_forest.near_duplicates(docs).collect())
    items = spark.createDataFrame([(9, b)], "item_id long, text string")
    assert [r.doc_id for r in containment.leaks(docs, items).collect()] == [2]


def test_a_pair_that_shares_one_tree_is_a_candidate(spark):
    parts = spark.createDataFrame([(7, 1, 10, 100, 1, 2, 10), (7, 2, 11, 100, 1, 2, 11), (8, 1, 12, 100, 1, 2, 12), (9, 1, 13, 60, 1, 2, 13), (9, 1, 14, 100, 1, 2, 14)],
                                  "region long, deep long, doc long, n long, hub long, size long, component long")
    assert [tuple(r) for r in lsh_forest.neighbours(parts).collect()] == [(10, 11)]


def test_different_texts_under_one_id(spark):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta " * 3).strip(), "uno dos tres cuatro cinco seis siete ocho nueve diez"
    docs = spark.createDataFrame([(1, one), (1, two), (1, one), (2, two), (3, one + " iota")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in lsh_forest.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
    assert sorted((r.doc_id, r.text) for r in lsh_forest.survivors(docs).collect()) == sorted([(1, one), (1, two)])
