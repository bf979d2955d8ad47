"""Operators that judge each document by itself, against plain versions and the tokenizers themselves."""

import hashlib
import math
import re
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phasegrid.llm import bpe, language, licenses, secrets, tokens
from phasegrid.llm.common import tokenizer_text
from phasegrid.llm.queries import QUERIES

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def texts_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


# BPE encoding and token counts

def plain_bpe(doc_id, text):
    t = _tools()[0]
    ids = t.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("which", ["odd", "small_docs"])
def test_bpe_equals_library(request, which):
    frame = request.getfixturevalue(which)
    assert rows_of(bpe.encode_documents(frame, WORD_BPE)) == sorted((plain_bpe(*r) for r in texts_of(frame)), key=repr)


def test_bpe_refuses_a_tokenizer_that_joins_words():
    with pytest.raises(ValueError, match="white space"):
        bpe.Encoder(tokenizer_text(BYTE_BPE))


def test_bpe_returns_ids_and_text(docs):
    t = Tokenizer.from_file(WORD_BPE)
    row = bpe.encode_documents(docs([(1, "Hello <|endoftext|> world")]), WORD_BPE, ids=True).first()
    assert row["ids"] == t.encode("Hello <|endoftext|> world", add_special_tokens=False).ids
    assert row["decoded"] == t.decode(row["ids"], skip_special_tokens=False)


ODD_PIECES = st.lists(st.sampled_from(["a", "B", "é", "e\u0301", " ", "\n", "\u00a0", "1", "'s", "<|endoftext|>", "<|", "Σ", "İ", "你", "!", "\u0301", "\u2003"]) | st.text(max_size=3), max_size=60)


@settings(max_examples=150, deadline=None)
@given(ODD_PIECES)
def test_bpe_joins_any_text(pieces):
    text = "".join(pieces)
    t, e = _tools()
    ids = t.encode(text, add_special_tokens=False).ids
    n, found, decoded = e.encode(text)
    assert (n, found) == (len(ids), " ".join(map(str, ids))) and decoded == t.decode(ids, skip_special_tokens=False)


def _tools(held=[]):
    if not held:
        held.extend([Tokenizer.from_file(WORD_BPE), bpe.Encoder(tokenizer_text(WORD_BPE))])
    return held


def test_chunks_rejoin_and_repeat():
    passage = " ".join(sha(str(i))[: 3 + i % 7] for i in range(2000)).encode()
    a, b = bpe.chunks("é".encode() * 999 + passage), bpe.chunks(b"other " * 321 + passage)
    assert b"".join(a) == "é".encode() * 999 + passage and all(c.decode() for c in a)
    assert set(a) & set(b)


def plain_count(doc_id, text):
    n = len(_splitter().tokenizer.encode(text or "", add_special_tokens=False).ids)
    return doc_id, len((text or "").encode()), n, n > 1024


@pytest.mark.parametrize("which", ["odd", "small_docs"])
def test_counts_equal_library(request, which, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_PRETOKENS", 3000)
    frame = request.getfixturevalue(which)
    assert rows_of(tokens.count_tokens(frame, BYTE_BPE)) == sorted((plain_count(*r) for r in texts_of(frame)), key=repr)


@settings(max_examples=200, deadline=None)
@given(ODD_PIECES)
def test_pretokens_count_like_whole_text(pieces):
    text, split = "".join(pieces), _splitter()
    whole = len(split.tokenizer.encode(text, add_special_tokens=False).ids)
    assert sum(split.pieces(split(text))) == whole


def _splitter(held=[]):
    if not held:
        held.append(tokens.Splitter(tokenizer_text(BYTE_BPE)))
    return held[0]


# language ID

def test_language_of_unseen_documents(small_docs):
    found = {r["doc_id"]: r for r in QUERIES["op7_language_id"](small_docs.sparkSession, "/root/testdata/sf0.01").collect()}
    lang = {r["doc_id"]: r["lang"] for r in small_docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    unseen = [i for i, r in found.items() if r["held_out"]]
    assert len(found) == len(lang) and 150 < len(unseen) < 350
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in found.items())
    assert sum(found[i]["lang_pred"] == lang[i] for i in unseen) / len(unseen) > 0.97


def plain_scores(train, texts, alpha=language.SMOOTHING):
    """Naive Bayes with dictionaries over the same buckets."""
    sums, docs = {}, {}
    for lang, text in train:
        docs[lang] = docs.get(lang, 0) + 1
        for k, (h, a, b) in enumerate(zip(*language.grams([text]))):
            for g in h[a[0] : b[0]]:
                key = (lang, k)
                sums.setdefault(key, {}).setdefault(int(g), 0)
                sums[key][int(g)] += 1
    out = []
    for text in texts:
        logs = {}
        for lang in sorted(docs):
            total = math.log(docs[lang] / sum(docs.values()))
            for k, (h, a, b) in enumerate(zip(*language.grams([text]))):
                own = sums.get((lang, k), {})
                n = sum(own.values()) + alpha * language.BUCKETS
                total += sum(math.log((own.get(int(g), 0) + alpha) / n) for g in h[a[0] : b[0]])
            logs[lang] = total
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_language_scores_equal_plain_bayes(docs):
    train = [("en", "the cat and the dog"), ("en", "this is the house"), ("de", "der hund und die katze"), ("fr", "le chat et la souris")]
    texts = ["the mouse", "die maus", "la maison", "x", "Über ALLES"]
    model = language.fit(docs([(i, t, lang) for i, (lang, t) in enumerate(train)]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs(list(enumerate(texts))), model).collect()}
    for i, (lang, score) in enumerate(plain_scores(train, texts)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4)


def test_language_odd_cases(odd, docs):
    model = language.fit(docs([(10, "hello there", "en"), (11, None, "fr"), (12, "sans langue", None), (13, "123", "de"), (14, "guten tag", "de")]))
    assert model[0] == ["de", "en"]
    got = language.predict(odd, model).collect()
    assert len(got) == 11 and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 9}
    empty = language.fit(docs([(1, None, None)]).where("false"))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(odd, empty).collect()} == {("und", 0.0)}
    assert language.predict(odd.where("false"), model).count() == 0


def test_language_does_not_depend_on_neighbours(docs):
    model = language.fit(docs([(1, "hello there", "en"), (2, "guten tag", "de")]))
    texts = ["he", "gu", "there tag", "a"]
    alone = [language.score_texts([t], *model) for t in texts]
    assert [([a[0]], [pytest.approx(a[1])]) for a in zip(*language.score_texts(texts, *model))] == alone


# secrets

def plain_base(text):
    spans = []
    pattern = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets_equal_plain_scan(small_docs, odd, docs):
    for frame in (small_docs, odd):
        got = secrets.find_secrets(frame).collect()
        plain = [(i, plain_base(t or "")) for i, t in texts_of(frame)]
        expect = [(i, *(sum(k == n for _, k, _ in s) for n in range(3)), sha(secrets.written(s))) for i, s in plain]
        assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(expect, key=repr)
        assert all(set(secrets.written(plain_base(t or "")).split(",")) - {""} <= {x for r in got if r["doc_id"] == i for x in r["spans"].split(",")} for i, t in texts_of(frame))
    some = docs([(1, 'password=5e884898da28')])
    assert secrets.find_secrets(some).first()['n_assign'] == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "api_key", "aPiKey", "=", ":", " ", '"', "abc", "0123456789abcdef01234567", "AKIA", "ABCDEF123456", "é", "ſecret", "K", "."]), max_size=25))
def test_secret_patterns(parts):
    assert secrets.base_spans("".join(parts)) == plain_base("".join(parts))


@settings(max_examples=100, deadline=None)
@given(st.text("abcXYZ0189+/", min_size=20, max_size=70), st.floats(1.0, 4.0))
def test_sliding_entropy_equals_recount(value, least):
    def bits(w):
        return -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))

    marked = {i + k for i in range(len(value) - 19) if bits(value[i : i + 20]) >= least + 1e-9 for k in range(20)}
    loose = {i + k for i in range(len(value) - 19) if bits(value[i : i + 20]) >= least - 1e-9 for k in range(20)}
    got = {k for a, b in secrets.dense_ranges(value, least) for k in range(a, b)}
    assert marked <= got <= loose


def test_entropy_spans_and_allow_list(docs):
    rows = [(1, "key Zx8Kq2Lm9Vt4Rb7Yw1Pn5 end"), (2, "Zx8Kq2Lm9Vt4Rb7Yw1Pexample5"), (3, "internationalisationofwords"), (4, "x" * 12 + "1" * 12)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs(rows)).collect()}
    assert got == {1: "entropy:4:25", 2: "", 3: "", 4: ""}
    assert secrets.masked(rows[0][1], got[1]) == "key [secret] end" and secrets.masked(None, "") is None


def test_allow_list_covers_its_windows_only(docs):
    key = "Zx8Kq2Lm9Vt4Rb7Yw1Pn5"
    rows = [(1, f"{key}/static/example/static"), (2, f"example/{key}"), (3, f"{key[:10]}xxxx{key[10:]}"), (4, "xxxx" + key + "x" * 3000 + key)]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs(rows)).collect()}
    assert got[1].startswith("entropy:0:") and int(got[1].split(":")[2]) <= 29 and secrets.masked(rows[0][1], got[1]).startswith("[secret]")
    assert got[2] == "entropy:7:29" and got[3] == "" and got[4] == "entropy:4:25,entropy:3025:3046"


# licenses

def plain_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_equals_plain_scan(small_docs, odd, docs):
    made = docs([(1, "Under the MIT License, under the mit license. CC BY NC cc-by-nc"), (2, "Apache License, Version 2.0 cc by"), (3, "éunder the mit licenseé")])
    for frame in (small_docs, odd, made):
        got = {r["doc_id"]: tuple(r)[1:6] for r in licenses.scan_licenses(frame).collect()}
        assert got == {i: plain_license(t) for i, t in texts_of(frame)}


def test_templates(docs):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "the GNU General Public License as published by the Free Software Foundation; either version 3"),
        (3, "the GNU General Public License as published by somebody; version 3"),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the a b c), to deal in the Software without restriction"),
        (6, "released under the terms of the MIT License"), (7, "Licensed under CC BY-NC 4.0."), (8, "GNU General Public"),
    ]
    got = {r["doc_id"]: (r["labels"], r["base_labels"]) for r in licenses.scan_licenses(docs(rows)).collect()}
    assert got == {1: ("gpl-3", ""), 2: ("gpl-3", ""), 3: ("", ""), 4: ("mit", ""), 5: ("", ""), 6: ("mit", ""), 7: ("cc-by-nc", "cc-by-nc"), 8: ("", "")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=12))
def test_automaton_equals_expression(words):
    auto = licenses.compile_template("x", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;match=2>> d")
    line = "".join(words)
    best = {m.start(): max(n for n in range(m.start() + 1, len(line) + 1) if re.fullmatch("a(bc?)?.{0,2}d", line[m.start() : n])) for m in re.finditer("(?=a(bc?)?.{0,2}d)", line)}
    assert {a: b for a, b, _ in licenses.template_places([w.encode() for w in words], [auto])} == best


def test_template_errors():
    with pytest.raises(ValueError):
        licenses.compile_template("x", "<<beginOptional>>a<<endOptional>>")
    with pytest.raises(ValueError):
        licenses.compile_template("x", "a <<beginOptional>>b")
    with pytest.raises(ValueError):
        licenses.compile_template("x", "<<var;match=2>> a")


def test_empty_tables(odd):
    none = odd.where("false")
    assert bpe.encode_documents(none, WORD_BPE).count() == 0 and tokens.count_tokens(none, BYTE_BPE).count() == 0
    assert secrets.find_secrets(none).count() == 0 and licenses.scan_licenses(none).count() == 0
