"""Operators 11 to 13 against plain versions, the libraries and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumora.llm import op11_hard_negatives as mining
from lumora.llm import op12_bpe as bpe
from lumora.llm import op13_alignment as alignment
from lumora.llm import queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b ", "  ", "\n", "\n\n", " \t", "ü", "ß ", "é", "<|endoftext|>", "<|endo", "’s", "'s", "'ll ", "1", "12 ", "。", "中", "　", "\xa0", " ", "​", "😀", "́", ".", "...", "x" * 30, "der ", "ก", "\x1c", "\x85", "_", "Ⅷ"]
VECTORS = "vec_id long, embedding array<double>, label int, score double, rank int"


def odd_texts(n: int) -> list[str]:
    draw = random.Random(12)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 900))) for _ in range(n)]
    return [*texts, *(t * 2 for t in texts[: n // 2]), "x" * 50_000, " " * 5000, "word " * 300, "中" * 3000, "<|endoftext|>" * 400]


def plain_mining(rows, anchor, positives=5, negatives=3, low=50, high=95):
    """By whole numbers of any size, pair by pair."""
    usable = []
    for i, vector, label, *_ in rows:
        if i is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in v) < 1 << 62:
            usable.append((i, label, v))
    out = []
    for i, label, v in usable:
        if not anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other == label) for j, other, w in usable if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            near = [(-t, k) for t, k, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(near)]
    return sorted(out)


def mined(frame, **other):
    found = mining.mine_negatives(frame, "vec_id % 50 = 0", **other)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_hard_negatives_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, SF).collect())) == plain_mining(rows, lambda i: i % 50 == 0)


def test_hard_negatives_edge_cases(spark, monkeypatch):
    draw = random.Random(11)
    rows = [(i, [draw.choice((0.0, 0.25, 0.5, 1.0, -0.5)) for _ in range(4)], draw.choice((0, 1, 2))) for i in range(400)]  # ties
    rows += [rows[0], rows[50], rows[7], (50, [1.0, 1.0, 1.0, 1.0], 1)]  # repeated rows and ids, anchors among them
    rows += [(None, [1.0] * 4, 1), (600, None, 1), (601, [1.0] * 4, None), (602, [None, 1.0, 1.0, 1.0], 1), (603, [float("nan")] * 4, 1), (604, [float("inf")] + [0.0] * 3, 1), (605, [], 1)]
    rows += [(650, [1.0, 2.0], 5), (651, [1.0, 1.0], 5), (652, [1.0, 0.2], 6), (-50, [0.5, 0.25, 1.0, 0.0], 1), (700, [3.0] * 4, 9), (750, [-1.0, -1.0, 0.0, 0.0], 0)]  # another length, alone in its label
    rows += [(800, [1e6] * 4, 1), (801, [1e6 + 1] * 4, 1), (802, [7e5 + 0.004] * 4, 2), (803, [1e30] * 4, 1)]  # beyond 2^53; without a place in 64 bits
    full = [(*r, 0.5, 1) for r in rows]
    want = plain_mining(rows, lambda i: i % 50 == 0)
    assert any(s > 1 << 53 for *_, s, _ in want)
    frame = spark.createDataFrame(full, VECTORS).repartition(5)
    assert mined(frame) == want
    monkeypatch.setattr(mining, "ANCHOR_BYTES", 1000)  # many blocks
    assert mined(frame) == want
    assert mined(frame, positives=2, negatives=1, low=80, high=100) == plain_mining(rows, lambda i: i % 50 == 0, 2, 1, 80, 100)
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(frame.where("vec_id % 50 <> 0")) == []


def encoded(texts: list[str], plain: bool = False) -> list[list[int]]:
    own = bpe.open_bpe(A, plain)
    out = []
    for _, buf, offsets in bpe.slices(pa.array(texts)):
        out += [x.tolist() for x in bpe.encode_slice(own, buf, offsets)]
    return out


@pytest.mark.parametrize("plain", [False, True])
def test_chunks_give_the_library_ids(plain):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = plain
    texts = odd_texts(200)
    assert encoded(texts, plain) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_are_shared_and_joins_repaired():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9)))
    passage = " ".join(word() for _ in range(3000))
    texts = [" ".join(word() for _ in range(n)) + " " + passage for n in (5, 77, 311)]
    buf, offsets = bpe.buffers(pa.array(texts))
    raw, at = buf.tobytes(), offsets.tolist()
    chunks = [[raw[lo + x : lo + y] for x, y in zip([0, *c], [*c, hi - lo], strict=True)] for lo, hi, c in zip(at, at[1:], bpe.cut_places(buf, offsets)[0], strict=False)]
    assert all("".join(c.decode() for c in own) == t for own, t in zip(chunks, texts, strict=True))
    assert len(set(chunks[0]) & set(chunks[1]) & set(chunks[2])) > 0.8 * len(chunks[0])
    own = bpe.ByteBpe(A, False)
    found = bpe.encode_slice(own, buf, offsets)
    assert own.reused > own.encoded
    assert [x.tolist() for x in found] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_query(spark):
    library = Tokenizer.from_file(A)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op12_bpe(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_cases(spark):
    texts = [None, "", "", " ", "word " * 40_000, *odd_texts(20)]
    rows = [(i if i != 3 else None, t, "clash", 7) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    found = bpe.decode_ids(bpe.encode_texts(frame, A), A)
    assert found.columns == ["doc_id", "n_tokens", "ids", "text"]
    want = Counter((i, t or "") for i, t, *_ in [*rows, rows[-1]])
    assert Counter((r.doc_id, r.text) for r in found.collect()) == want
    assert bpe.encode_texts(frame.limit(0), A).count() == 0
    with pytest.raises(ValueError):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"), False)


def plain_alignment(texts):
    """Token by token and link by link; (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for each text."""
    library, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    byte = {c: bytes([b]) for c, b in bpe._byte_of().items()}

    def parts(t):
        if not t:
            return None
        a = [(i, b"".join(byte[c] for c in library.id_to_token(i))) for i in library.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(t) for p in [pieces.id_to_piece(i)]]
        whole = (" " + t).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else None

    split = []
    for t in texts:
        both, groups = parts(t), []
        if both:
            ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in both]
            cuts = sorted(set(ends[0]) & set(ends[1]))
            groups = [([], []) for _ in cuts]
            for k in (0, 1):
                for (i, _), e in zip(both[k], ends[k], strict=True):
                    groups[bisect_left(cuts, e)][k].append(i)
        split.append(groups)
    links = [[(x, y) for a, b in g for x in a for y in b] for g in split]
    counts = Counter(p for own in links for p in set(own))
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(counts[p] == best[p[0]] for p in own), sum(counts[p] for p in own), ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g))
        for g, own in zip(split, links, strict=True)
    ]


def test_alignment_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = plain_alignment([t for _, t in docs])
    for (i, _), w, r in zip(docs, want, queries.op13_alignment(spark, SF).orderBy("doc_id").collect(), strict=True):
        assert (r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (i, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest())


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_alignment_edge_cases(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "SLICE_PAIRS", most)  # 40: many slices
    texts = [None, "", "", " ", "▁", "a▁b", "word " * 8000, *odd_texts(16)]
    rows = [(i if i != 3 else None, t, "clash", 7, 1) for i, t in enumerate(texts)]
    rows = [*rows, rows[-1], rows[8]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a string, n_a int, _row int").repartition(3)
    found = alignment.align_texts(frame, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = plain_alignment([t for _, t, *_ in rows])
    assert any(w[0] for w in want[7:])
    assert Counter(map(tuple, found.collect())) == Counter((i, *w) for (i, *_), w in zip(rows, want, strict=True))
    assert alignment.align_texts(frame.limit(0), A, B).count() == 0


def test_links_expand_in_pieces(monkeypatch):
    draw = np.random.default_rng(13)
    a, b = draw.integers(0, 4, 300), draw.integers(0, 5, 300)
    at = np.array([0, 0, 120, 300])
    len_a, len_b = np.array([1, 2, 3, 4]), np.array([3, 2, 1, 4, 2])
    keep = [np.cumsum(len_a[a[at[i] : at[i + 1]]])[-1:].sum() - np.cumsum(len_b[b[at[i] : at[i + 1]]])[-1:].sum() for i in range(3)]
    len_b = np.append(len_b, [1])
    b_texts = [np.concatenate([b[at[i] : at[i + 1]], np.full(max(0, keep[i]), 5)]) for i in range(3)]
    a_texts = [np.concatenate([a[at[i] : at[i + 1]], np.zeros(max(0, -keep[i]), int)]) for i in range(3)]
    at_a, at_b = (np.cumsum([0, *map(len, t)]) for t in (a_texts, b_texts))
    x = alignment.align(np.concatenate(a_texts), at_a, np.concatenate(b_texts), at_b, len_a, len_b)
    whole = alignment.pairs(x, 6)
    monkeypatch.setattr(alignment, "LINKS", 7)
    assert all(np.array_equal(p, q) for p, q in zip(whole, alignment.pairs(x, 6), strict=True))
    assert whole[2].sum() == x.per_text(np.bincount(x.group_a) * np.bincount(x.group_b)).sum()
