"""Operators 4, 5, 7 and 8 and their edge cases against plain versions."""

from __future__ import annotations

import hashlib
import re
from itertools import product
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumora.llm import op05_fingerprints as prints
from lumora.llm import op07_token_files as files
from lumora.llm import op08_chat as chat
from lumora.llm.op04_token_counts import count_tokens
from lumora.llm.text import hash_word, shingles, word_hashes
from lumora.llm.wordcache import WordCache, id_bytes, open_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (3, "The the  THE\tDon't can't we'll 'tis it's. x's", "junk"),
    (1, None, "a"),
    (2, "", "b"),
    (5, "<|endoftext|> a <|StartOfText|> b<|startoftext|>c", "c"),
    (4, "Éa éx ǅ Σας İstanbul ﬁ ½ 12 3.5 日本語。テキスト 🎉🎉 a\u0085b c\x1cd\x1fe", "d"),
    (7, "word " * 3000 + "x" * 5000, "e"),
    (7, "word " * 3000 + "x" * 5000, "e"),
    (-5, " \n\t ", "f"),
    (9, "a,b,, c.. (d) ... 'x' \"y\"", None),
    (None, "no id", "g"),
]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def test_token_counts_are_the_librarys(spark, odd):
    library = open_tokenizer(PATH)
    got = sorted((tuple(r) for r in count_tokens(odd, PATH, 5).collect()), key=repr)
    want = []
    for doc_id, text, _ in ODD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 5))
    assert got == sorted(want, key=repr)
    assert count_tokens(odd.limit(0), PATH).count() == 0


def test_token_counts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = open_tokenizer(PATH)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_token_files(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = open_tokenizer(PATH)
    for table in (docs, odd):
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        want, start = [], 0
        for r in rows:
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want.append((r.doc_id, start, len(ids), crc32(ids.tobytes())))
            start += len(ids)
        got = sorted((tuple(r) for r in files.written_and_read(table, PATH).collect()), key=lambda r: r[1])
        assert got == want
    assert files.written_and_read(odd.limit(0), PATH).count() == 0


def test_words_of_a_column(monkeypatch):
    """Unseen words of a column go to the library many at a time, and every letter, mark and white space comes out as it has them."""
    letters = [chr(x) for x in range(0x250) if chr(x).isalpha()]
    marks = [chr(x) for x in range(33, 127) if not chr(x).isalnum()]
    texts = [t for _, t, _ in ODD] + [f"{c} a{c}b {c}{c}x, {c.upper()}z" for c in letters] + [f"ab{m} é{m}{m}. {m}c a{m}b" for m in marks]
    texts += ["x\u00a0y z\u2003w", "a\x1cb \x85", "e\u0301t \u0301a", "\u212aelvin \u212bx", "a\x00b \x7f", "", " ", "Zz\tzz\nzz"]
    library, cache = open_tokenizer(PATH), WordCache(PATH, id_bytes)
    monkeypatch.setattr("lumora.llm.wordcache.CACHE_WORDS", 10)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (pa.array(texts), pa.array([None, *texts]).slice(1), pa.array(texts, pa.large_string())):
        raw, at = cache.joined(column)
        assert [raw[a:b].view("<u4").tolist() for a, b in zip(at, at[1:], strict=False)] == want
    for empty in (pa.array([], pa.string()), pa.array([None, ""])):
        raw, at = cache.joined(empty)
        assert len(raw) == 0 and at.tolist() == [0] * (len(empty) + 1)
    calls, encode = [], cache.latin.tokenizer
    monkeypatch.setattr(cache.latin, "tokenizer", SimpleNamespace(encode_batch_fast=lambda *a, **k: calls.append(1) or encode.encode_batch_fast(*a, **k)))
    cache.joined(pa.array([" ".join("".join(c) for c in product("bcdfg", repeat=5))]))
    assert len(calls) == 4  # 3,125 words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), st.integers(0, 5))
def test_blocks_round_trip(ids, cuts):
    ids = np.array(ids, np.uint32)
    lengths = np.diff(np.linspace(0, len(ids), cuts + 2).astype(int))
    doc_ids, back, again = files.from_bytes(raw := files.to_bytes([None, *range(len(lengths) - 1)], lengths, ids))
    assert doc_ids[0] is None and (back == lengths).all() and (again == ids).all()
    with pytest.raises(ValueError):
        files.from_bytes(raw[:-1] if len(raw) > 48 else raw[:20])


def test_words_and_shingles():
    texts = ["A b\tC\x0bd e", "a B c D e ", "", None, "x", " ", "é é", "a" * 300_000 + " b"]
    hashes, at = word_hashes(pa.array(texts))
    assert np.diff(at).tolist() == [5, 5, 0, 0, 1, 0, 1, 2]
    assert (hashes[:5] == hashes[5:10]).all() and len(set(hashes[:5].tolist())) == 5
    assert hash_word("C") == hash_word("c") == int(hashes[2]) and hash_word("É") != hash_word("é")
    assert [len(x) for x in shingles(pa.array(texts), 3)] == [3, 3, 0, 0, 1, 0, 1, 1]
    assert [len(x) for x in shingles(pa.array(texts).slice(1, 5), 5)] == [1, 0, 0, 1, 0]


def test_fingerprints(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table in (docs.repartition(5), odd):
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        texts = [r.text or "" for r in rows]
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
        found, changed = prints.sketches(texts), prints.sketches(edited)
        want = [
            (r.doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), prints.pack(f), prints.pack(c), prints.resemblance(f, c), prints.resemblance(f, g))
            for r, t, e, f, c, g in zip(rows, texts, edited, found, changed, found[1:] + found[:1], strict=True)
        ]
        assert sorted((tuple(r) for r in prints.compare_edited(table).collect()), key=repr) == sorted(want, key=repr)
    assert prints.compare_edited(odd.limit(0)).count() == 0
    assert prints.fingerprints(odd).where("fingerprint = ''").count() == 3


def test_estimates():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    a, b = list(words[:3000]), list(words[1000:])
    rng.shuffle(words)
    x, y = prints.sketches([" ".join(a), " ".join(b)])
    assert abs(prints.resemblance(x, y) - 1992 / 4000) < 0.15
    assert abs(prints.containment(x, y) - 1992 / 2996) < 0.2
    assert abs(prints.distinct(x) / 2996 - 1) < 0.3
    parts = prints.sketches([" ".join(a[:1500]), " ".join(a[1496:])])
    assert (prints.merge(*parts) == x).all()


def plain_digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    learnt = "".join(t or "" for _, r, t in turns if r == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), digest(said), len(learnt), digest(learnt)


def test_chats(spark):
    rows = [
        (1, 1, "assistant", "<|im_end|>\\<|x|> <\\|", 0), (1, 0, "user", None, 0), (2, 0, "assistant", "first", 0), (3, 0, "user", "", 0),
        (4, 0, None, "x\n<|im_start|>", 0), (4, None, "we\nird<|r\\n", "y", 0), (None, 0, "user", "é🎉", 0), (None, 1, "assistant", "<<||<\\\\|", 0), (5, 0, "user", "a" * 200_000, 0), (5, 1, "assistant", "b", 0), (5, 1, "assistant", "b", 0),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid int")
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_chats(chat.with_hostile(table))).collect()}
    grouped: dict = {}
    for conv_id, turn, role, text, *_ in [*rows, *chat.HOSTILE]:
        grouped.setdefault(conv_id, []).append((turn, role, text))
    assert got.keys() == grouped.keys()
    for conv_id, turns in grouped.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        assert got[conv_id][:4] == plain_digest(turns)
    assert {k for k, v in got.items() if v[5]} == {1, -1, None}
    assert chat.read_back(chat.format_chats(table.limit(0))).count() == 0
    text = "".join(r.segment for r in chat.format_chats(table.where("conv_id = 1")).collect())
    assert len(re.findall(r"<\|im_start\|>", text)) == 2 and got[1][4] == len(text)


@given(st.text(alphabet="<|\\an\n", max_size=30))
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
