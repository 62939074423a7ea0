import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomspark.llm import byte_bpe
from loomspark.llm.queries import op13_byte_bpe
from tests.llm import brute
from tests.llm.test_bpe import texts

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    return byte_bpe.library_model(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(f.read()), special_tokens={})


def odd_texts():
    r = random.Random(2)
    spaces = ["".join(r.choice(" \n\t\r\xa0　\x85\x1c\x1fab'1!") for _ in range(r.randint(0, 30))) for _ in range(1500)]
    return [*texts(), *spaces, "日本語" * 500, "\U0001f469‍\U0001f469 \U0001f600", "''s 'S 're've", "<|endoftext|>", "a" * 3000, " " * 3000 + "x" + " " * 3000]


@pytest.mark.parametrize("memo", [3, 100_000])
def test_ids_are_the_library_s(model, library, memo):
    made = byte_bpe.ByteBpe(model, memo)
    for text in odd_texts():
        assert made.encode(text).tolist() == library.encode_ordinary(text), repr(text[:80])


def test_long_texts_are_those_of_stretches(model, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STRETCH", 7)
    made = byte_bpe.ByteBpe(model)
    for text in odd_texts():
        assert made.encode(text).tolist() == library.encode_ordinary(text), repr(text[:80])
        assert made.spans(text)[0].tolist() == library.encode_ordinary(text)


def test_spans_are_those_of_the_bytes(model, library):
    made = byte_bpe.ByteBpe(model)
    for text in odd_texts()[::7]:
        of_byte = [n for n, c in enumerate(text) for _ in c.encode()]
        at = 0
        for i, start, end in made.spans(text).T.tolist():
            size = len(library.decode_single_token_bytes(i))
            assert (start, end) == (of_byte[at], of_byte[at + size - 1] + 1)
            at += size
        assert at == len(of_byte)


def test_split_characters(model, library):
    made = byte_bpe.ByteBpe(model)
    text = "x日本語\U0001f600ȩ́"
    ids = library.encode_ordinary(text)
    assert len(ids) > len(text) and made.decode(ids) == text and "".join(made.decode_pieces(ids)) == text
    assert all("�" not in p for p in made.decode_pieces(ids))
    for n in range(len(ids) + 1):
        for part in (ids[:n], ids[n:]):
            want = library.decode_bytes(part)
            assert made.decode_bytes(part) == want
            assert made.decode(part) == "".join(made.decode_pieces(part)) == want.decode("utf-8", "replace")
    assert made.decode([None, -1, 99_999]) == "�" * 3 and made.decode_pieces([]) == []


def test_query_against_library(spark, sf_dir, library):
    got = {x["doc_id"]: x for x in op13_byte_bpe(spark, sf_dir).collect()}
    for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(x["text"] or "")
        row = got.pop(x["doc_id"])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert row["decoded_sha256"] == brute.sha(x["text"] or "")
    assert not got


def test_odd_rows(spark, odd_docs, no_docs, library):
    got = byte_bpe.round_trip(odd_docs, PATH, P.PATTERN).collect()
    want = [library.encode_ordinary(x["text"] or "") for x in odd_docs.collect()]
    assert sorted(x["n_tokens"] for x in got) == sorted(map(len, want))
    made = byte_bpe.encode_spans(byte_bpe.encode_column(odd_docs, PATH, P.PATTERN, out="mark"), PATH, P.PATTERN, out="h")
    for x in made.collect():
        assert x["mark"] == library.encode_ordinary(x["text"] or "") == [t["id"] for t in x["h"]]
    again = byte_bpe.decode_column(made.withColumn("mark", F.expr("if(doc_id <=> 5, null, mark)")), PATH, P.PATTERN, "mark", "back")
    assert all(x["back"] == (None if x["doc_id"] == 5 else x["text"] or "") for x in again.collect())
    assert byte_bpe.round_trip(no_docs, PATH, P.PATTERN).count() == 0 and byte_bpe.encode_spans(no_docs, PATH, P.PATTERN).count() == 0
