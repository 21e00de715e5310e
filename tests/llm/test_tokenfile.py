import json
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from veritally.llm import tokenfile
from veritally.llm.queries import vocabulary_path

import pyarrow as pa

VOCABULARY = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cuts_do_not_change_ids(library):
    pick = random.Random(5)
    signs = [" ", "  ", "\n", "\t", "\r\n", "a", "b1", "É", "　", "\xa0", "'s", "Ω", ".", ",", "w.", "²", "ª", "\x1c", "​", "漢", "́", "<|endoftext|>", "the", " of"]
    texts = ["".join(pick.choices(signs, k=pick.randint(0, 30))) for _ in range(4000)] + ["", " ", "\n", "x" * 5000, " y" * 5000]
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = tokenfile.Encoder(f.read())
    assert encoder.cuts_are_safe
    got = []
    for at in range(0, len(texts), 64):
        got += encoder.encode(pa.array(texts[at : at + 64])).to_pylist()
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_caches_and_other_kinds_of_vocabulary(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_CUTS", 3)
    with open(VOCABULARY, encoding="utf-8") as f:
        definition = f.read()
    encoder = tokenfile.Encoder(definition)
    unsafe = tokenfile.Encoder(definition.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))
    assert not unsafe.cuts_are_safe
    for text in ["one two, three.\nFour five", "two three six", "one two, three."]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(pa.array([text, None, text]), 2).to_pylist() == [[*ids, 2], [2], [*ids, 2]]
        assert unsafe.encode(pa.array([text])).to_pylist() == [unsafe.library.encode(text, add_special_tokens=False).ids]


def test_only_unknown_cuts_are_learnt(library, monkeypatch):
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = tokenfile.Encoder(f.read())
    learnt, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda cuts: learnt.append(sorted(cuts)) or learn(cuts))
    for text in ["one two, three.\nFour é.five", "one three, two!", "two, one"]:
        assert encoder.encode(pa.array([text])).to_pylist() == [library.encode(text, add_special_tokens=False).ids]
    assert learnt == [["\n", " three", " two", " é", ",", ".", ".five", "Four", "one"], ["!"], ["two", " one"][::-1]]


def test_neighbouring_texts_do_not_touch(library):
    pick = random.Random(8)
    signs = [" ", "\n", "\t", "\r", "\xa0", "a", " b", "é", "×", ".", "'s", "7"]
    texts = ["".join(pick.choices(signs, k=pick.randint(0, 4))) for _ in range(6000)] + ["a\t ", "b", "a\n", "\nb", "a", ".b", None]
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = tokenfile.Encoder(f.read())
    assert encoder.encode(pa.array(texts), 2).to_pylist() == [ids_of(library, t) for t in texts]


def test_texts_with_special_tokens_that_look_like_words():
    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    token = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    spec["added_tokens"] += [{"id": 900_001, "content": "cat", **token}, {"id": 900_002, "content": "..", **token}]
    definition = json.dumps(spec)
    library, encoder = Tokenizer.from_str(definition), tokenfile.Encoder(definition)
    texts = ["cats are", "a cat", "cat", "x...", "..", "cats", "a.b", "concatenate."]
    assert encoder.encode(pa.array(texts)).to_pylist() == [library.encode(t, add_special_tokens=False).ids for t in texts]


ROWS = [(7, "seven words stand in this very line", "x"), (3, None, "x"), (5, "", None), (-2, "minus two", "y"), (9, "long " * 60_000, "y")]
ROWS += [(4, "a row that is repeated", "z")] * 40 + [(4, "the same id, another text", "z"), (None, "no id", "z")]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tokens')}/set"
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string").repartition(3)
    tokenfile.write_tokens(docs, path, VOCABULARY, row_group_rows=20, page_rows=5)
    return path


def test_digests_are_those_of_the_whole_stream(spark, library, written):
    got = tokenfile.token_digests(spark, written).orderBy("start").collect()
    assert len(got) == len(ROWS)
    assert [r.doc_id for r in got] == sorted([r[0] for r in ROWS], key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((r[0] or 0, len(ids := ids_of(library, r[1])), digest(ids)) for r in ROWS)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want


def test_partial_reads(spark, library, written):
    rows = tokenfile.token_digests(spark, written).collect()
    total = sum(r.n_tokens for r in rows)
    stream = []
    for r in tokenfile.read_documents(spark, written, with_ids=True).orderBy("start").collect():
        stream += r.ids
    assert len(stream) == total
    some = tokenfile.read_documents(spark, written, 4, 7).collect()
    assert sorted(r.doc_id for r in some) == [4] * 41 + [5, 7]
    pick = random.Random(1)
    for begin, end in [(0, total), (total - 1, total), (10, 10), (total, total + 9), *[sorted(pick.choices(range(total), k=2)) for _ in range(4)]]:
        got = []
        for r in tokenfile.read_stream(spark, written, begin, end).orderBy("start").collect():
            assert r.start == begin + len(got)
            got += r.ids
        assert got == stream[begin:end]
    # Metadata reads leave the list column alone, and the range is a filter of the scan.
    plan = tokenfile.read_documents(spark, written, 4, 7)._jdf.queryExecution().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "start" in line and "offset" not in line)
    assert "ids" not in scan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,4)" in scan


def test_encodings_row_groups_and_page_indexes(written):
    folder = written.removeprefix("file://") + "/tokens"
    files = pq.ParquetDataset(folder).files
    groups = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            assert meta.row_group(g).num_rows <= 20
            by_name = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert by_name["ids.list.element"].has_dictionary_page
            for name in ("doc_id", "start", "n_tokens"):
                assert not by_name[name].has_dictionary_page and "DELTA_BINARY_PACKED" in by_name[name].encodings
            assert all(c.has_offset_index and c.has_column_index for c in by_name.values())
    assert groups > len(files)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    tokenfile.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY)
    assert tokenfile.token_digests(spark, path).count() == 0
    assert tokenfile.read_stream(spark, path, 0, 5).count() == 0

