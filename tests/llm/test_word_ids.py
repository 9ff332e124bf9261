"""Ids of pre-tokens: one call of the library a step, the ids of the whole texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tapline.llm.fst_tokens import Pretokens, vocabulary_bytes
from tapline.llm.packing import WordIds

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["it's  a test,\n\nwe'll see 12345 ", None, "", "na\u00efve \U0001f600\u4e2d\u6587 \u00a0x", "a<|endoftext|>b <|endoftext|>", "<|endof", "text|> zzqx\x00\ufffd", " "]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, batch, **kw):
        self.given.append(len(batch))
        return self.tokenizer.encode_batch_fast(batch, **kw)


@pytest.mark.parametrize("plain", [False, True])
def test_new_words_go_to_the_library_in_one_input(plain):
    words = WordIds(vocabulary_bytes(PATH), plain)
    words.tokenizer = Counted(words.tokenizer)
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = plain
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    for _ in range(2):  # new words, then known ones
        flat, cuts = words.flat_ids(pa.array(TEXTS))
        assert [flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want
    assert words.tokenizer.given == [1]


def test_ids_that_do_not_spell_their_bytes_are_counted_word_by_word():
    words = WordIds(vocabulary_bytes(PATH))
    words.width = words.width + 1
    flat, cuts = words.flat_ids(pa.array(TEXTS))
    other, at = WordIds(vocabulary_bytes(PATH)).flat_ids(pa.array(TEXTS))
    assert np.array_equal(flat, other) and np.array_equal(cuts, at)


def test_texts_of_many_pretokens():
    pre = Pretokens(pa.array(TEXTS))
    at = np.arange(len(pre.starts))[::-1]
    assert pre.texts(at) == [pre.text(int(i)) for i in at]
