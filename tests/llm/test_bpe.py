import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from panelwise.llm import bpe

FILE = path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n a", "aaaaaaaaaaaaa", "it's  they'll\t\r\n x", "a<|endoftext|>b <|endoftext|><|endoftext|>", "é ß ñ 日本語 🙂🙂 \x1c\x1d \x85 　x ", "\x00\x01", "x" * 5000, "123 456abc!!! ###", " '' 's 'S"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def same(library, texts):
    own = bpe.vocabulary(FILE)
    mine = own.encode(texts)
    theirs = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine] == theirs
    assert own.decode(mine) == [library.decode(x, skip_special_tokens=False) for x in theirs]


def test_equals_the_library_on_odd_texts(library):
    same(library, ODD)


def test_equals_the_library_on_random_texts(library):
    rng = random.Random(3)
    letters = "abcdeéß .,'\n\t 019#<|>endoftx日🙂\x1f\xa0"
    same(library, ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)])


def test_full_cache_keeps_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    same(library, ["one two three four five six", "six five four"])


def test_query_on_table(spark, library):
    from panelwise.llm.catalog import QUERIES

    rows = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "a b", 7), (2, "a b", 7)], "doc_id bigint, text string, n_tokens bigint")
    got = sorted(((r.doc_id or 0, r.n_tokens) for r in bpe.round_trip(df, FILE).collect()))
    assert got == [(0, 2), (1, 0), (2, 2), (2, 2)]
    assert bpe.round_trip(df.where("false"), FILE).count() == 0
    assert bpe.encode(df, FILE).where("doc_id = 2").first().ids == Tokenizer.from_file(FILE).encode("a b").ids
