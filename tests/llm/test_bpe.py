import random

import pytest
from tokenizers import Tokenizer

from loomspark.llm import bpe, sstable
from loomspark.llm.queries import op9_bpe, vocabulary
from tests.llm import brute

ALPHABET = "aAbB'sStTrReEvV mM lLdD\t\n\x1c\x85\u00a0\u3000ΣσςİıßéÉe\u0301\u0327<|>|endoftext0123٣Ⅷ½日한\U0001f600\u200d.,!-_"


def texts():
    r = random.Random(1)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return [*made, "", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "ΑΣ, İ., don't. x's .,. a.b,", "aaaa" * 3000, "word " * 5000, "\u1680\u2028 a\u205fb"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("make", [bpe.WordBpe, sstable.WordEncoder])
def test_ids_are_the_library_s(make, library):
    for memo in (5, 10_000):
        model = make(vocabulary(), memo)
        for text, ids in zip(texts(), model.encode_batch(texts(), 300), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_decode_is_the_library_s(library):
    model = bpe.WordBpe(vocabulary())
    for text in texts()[:300]:
        ids = model.encode(text)
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query_against_library(spark, sf_dir, library):
    got = {x["doc_id"]: x for x in op9_bpe(spark, sf_dir).collect()}
    for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(x["text"], add_special_tokens=False).ids
        row = got.pop(x["doc_id"])
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert row["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))
    assert not got


def test_odd_rows(spark, odd_docs, no_docs, library):
    got = bpe.round_trip(odd_docs, vocabulary()).collect()
    assert sorted(x["n_tokens"] for x in got) == sorted(len(library.encode(x["text"] or "", add_special_tokens=False).ids) for x in odd_docs.collect())
    column = bpe.encode_column(odd_docs, vocabulary()).collect()
    assert all(x["token_ids"] == library.encode(x["text"] or "", add_special_tokens=False).ids for x in column)
    assert bpe.round_trip(no_docs, vocabulary()).count() == 0
