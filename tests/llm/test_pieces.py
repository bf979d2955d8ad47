"""SentencePiece merge rounds against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from phasegrid.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return pieces.Pieces(file.read())


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def same(model, library, texts):
    for text, (n, ids, said) in zip(texts, pieces.encode_all(model, {}, texts)):
        want = library.encode(text)
        assert (n, ids, said) == (len(want), ",".join(map(str, want)), library.decode(want)), repr(text)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(model, library, seed):
    rng = random.Random(seed)
    parts = ["a", "e", "t", "he", " ", "  ", "\n", "\t", "é", "你", "好", "\U0001f600", "▁", "<s>", "ing", "́", "0", ".", "\x00", " ", "�", "ſ", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(500))) for _ in range(100)]
    same(model, library, texts)


def test_runs_and_long_words(model, library):
    rng = random.Random(7)
    same(model, library, [" " * n for n in range(70)] + ["x" + " " * n + "y" for n in range(40)] + ["a" * n for n in range(1, 2 * pieces.LONG_WORD)])
    same(model, library, ["".join(rng.choice("ACGT") for _ in range(200_000)), " " * 100_000, "你好吗" * 30_000])


def test_rounds_equal_the_heap(model):
    rng = random.Random(9)
    words = ["".join(rng.choice("▁▁abctheing") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    symbols, ends = pieces.merge_rounds(model, words)
    assert [symbols[a:b].tolist() for a, b in zip(ends, ends[1:])] == [pieces.merge_long(model, w) for w in words]


def test_full_cache_starts_anew(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    known = {}
    for text in ["one two three four " * 5, " ".join(map(str, range(100))), "one two three"]:
        assert pieces.encode_all(model, known, [text])[0][1] == ",".join(map(str, library.encode(text)))


def test_operator(spark, docs, odd, small_docs, library):
    got = {r["doc_id"]: r for r in pieces.encode_documents(small_docs, MODEL).collect()}
    for row in small_docs.select("doc_id", "text").collect():
        want = library.encode(row["text"] or "")
        assert got[row["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()
        assert got[row["doc_id"]]["n_tokens"] == len(want)
    rows = pieces.encode_documents(odd, MODEL, ids=True).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    plain = {r["doc_id"]: r["text"] for r in odd.select("doc_id", "text").collect()}
    assert all(r["ids"] == library.encode(plain[r["doc_id"]] or "") and r["decoded"] == (plain[r["doc_id"]] or "") for r in rows)
    assert pieces.encode_documents(odd.where("false"), MODEL).count() == 0
