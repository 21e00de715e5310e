import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veritally.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " \n\t ",
    "The THE the's I'll we'd don't 123 4.5 -- ###",
    "<|endoftext|>a <|startoftext|>b<|endoftext|>c <|EndOfText|>",
    "ΣΑΣ ΌΔΟΣ İstanbul é Å ﬁ ½ Ⅷ 一二 👩‍👩‍👧‍👦",
    "a" * 3000,
    "word " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_matches_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(0, TEXTS[3], 9)], "doc_id long, text string, n_tokens int")
    got = sorted(bpe.encode_digests(docs, PATH).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    assert len(got) == len(TEXTS) + 1
    for r in got[2:]:
        found = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False)
        assert r.n_tokens == len(found.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(found.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(found.ids, skip_special_tokens=False).encode()).hexdigest()


def test_ids_and_text_of_the_general_form(spark, library):
    docs = spark.createDataFrame([(1, "Hello, hello world!")], "doc_id int, text string")
    (row,) = bpe.encode_decode(docs, PATH).collect()
    found = library.encode("Hello, hello world!", add_special_tokens=False)
    assert row.ids == found.ids and row.decoded == library.decode(found.ids)


def test_an_empty_table(spark):
    assert bpe.encode_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_the_lowest_rank_is_merged_first():
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    for word in ("lower", "unbelievable", "aaaaaaaa", "x"):
        symbols = [vocabulary.byte_ids[b] for b in word.encode()]
        symbols[-1] = vocabulary.last_ids[word.encode()[-1]]
        slow = symbols[:]
        while True:  # merge the lowest rank anywhere, leftmost first
            ranked = [(vocabulary.ranks.get(a << bpe.PAIR_BITS | b, 1 << 60), i) for i, (a, b) in enumerate(zip(slow, slow[1:], strict=False))]
            rank, i = min(ranked, default=(1 << 60, 0))
            if rank == 1 << 60:
                break
            slow[i : i + 2] = [vocabulary.merged[rank]]
        assert vocabulary.merge(symbols[:]) == slow
