"""Links between two tokenizers against a plain loop over each text's token ends."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapline.llm import token_links
from tapline.llm.fst_tokens import byte_symbols
from tapline.llm.queries import vocabulary
from tapline.llm.scratch import documents

MODEL = vocabulary("piece_bpe_32k.model")


def plain(rows):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] by brute force."""
    tok, sp, of = Tokenizer.from_file(vocabulary()), sentencepiece.SentencePieceProcessor(model_file=MODEL), byte_symbols()
    tok.encode_special_tokens = True
    made = []
    for i, text in rows:
        a = tok.encode(" " + (text or ""), add_special_tokens=False)
        ids, spelled_a = a.ids, [bytes(of[c] for c in t) for t in a.tokens]
        b = sp.encode(text or "")
        spelled_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, sp.id_to_piece(x)) for x in b)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(spelled_a) != whole or b"".join(spelled_b) != whole:
            made.append((i, 0, 0, [], Counter()))
            continue
        groups, pairs, x, y = [], Counter(), 0, 0
        while x < len(ids):
            x0, y0, left, right = x, y, 0, 0
            while True:
                if left <= right:
                    left += len(spelled_a[x])
                    x += 1
                else:
                    right += len(spelled_b[y])
                    y += 1
                if left == right:
                    break
            groups.append((ids[x0:x], b[y0:y]))
            pairs.update((p, q) for p in ids[x0:x] for q in b[y0:y])
        made.append((i, len(ids), len(b), groups, pairs))
    n = Counter(p for m in made for p in m[4])
    best = {}
    for (p, _), c in n.items():
        best[p] = max(best.get(p, 0), c)
    show = lambda ids: ",".join(map(str, ids))
    return [(i, na, nb, len(g), sum(ps.values()), sum(t for p, t in ps.items() if n[p] == best[p[0]]), sum(t * n[p] for p, t in ps.items()),
             hashlib.sha256(";".join(f"{show(p)}|{show(q)}" for p, q in g).encode()).hexdigest() if g else "") for i, na, nb, g, ps in made]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("rid", "codes", "times", "n", "code", "n_a")})
    got = [tuple(r) for r in token_links.links(df, vocabulary(), MODEL).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_texts_of_all_kinds(spark):
    check(spark, [(1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n\tand tabs  "), (5, "mixed été naïve straße 東京 привет 🙂🙂"), (6, "a▁b stays away"),
                  (7, "<|endoftext|> </s> <s> <unk> <0x41>"), (8, "x" * 3000 + " 3.14159 " + "=-" * 400), (9, "the cat the cat the cat"), (9, "the cat the cat the cat"),
                  (None, "the dog"), (10, "nul \x00 and \x7f and   and é and ﬁ"), (11, "http://a.example/x?y=1&z=%20" * 30), (12, "字" * 500), (13, "\n" * 300)])


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()]
    check(spark, rows)


def test_long_text_and_none(spark):
    check(spark, [(1, "la casa de los perros " * 4000), (2, "z" * 900)])
    assert token_links.links(spark.createDataFrame([], "doc_id long, text string"), vocabulary(), MODEL).collect() == []


def test_shuffle_join_and_small_memory_give_the_same(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").limit(60).collect()]
    monkeypatch.setattr(token_links, "BROADCAST_PAIRS", 0)
    check(spark, rows)


@pytest.mark.parametrize("a,b,sa,sb,want", [
    ([1, 2], [3], [2, 3], [5], (b"1,2|3;", 1, 2)),
    ([1, 2, 2], [3, 4], [2, 1, 1], [2, 2], (b"1|3;2,2|4;", 2, 3)),
    ([1], [3, 3, 40], [6], [2, 2, 2], (b"1|3,3,40;", 1, 3))])
def test_windows_by_hand(a, b, sa, sb, want):
    sizes_a, sizes_b = np.zeros(100, np.int64), np.zeros(100, np.int64)
    sizes_a[a], sizes_b[b] = sa, sb
    two = [np.array(x * 2, np.uint32) for x in (a, b)]
    made = token_links.Aligned(*two, np.array([0, len(a), 2 * len(a)]), np.array([0, len(b), 2 * len(b)]), sizes_a, sizes_b, 100)
    for w in (0, 1):
        pairs = slice(made.pair_cut[w], made.pair_cut[w + 1])
        assert (made.digest_text(w), made.groups[w], made.links[w]) == want
        assert Counter(dict(zip(made.codes[pairs].tolist(), made.times[pairs].tolist()))) == Counter(x * 100 + y for x, y in _pairs(want[0]))


def _pairs(text):
    for group in text.decode().rstrip(";").split(";"):
        left, right = group.split("|")
        yield from ((int(x), int(y)) for x in left.split(",") for y in right.split(","))
