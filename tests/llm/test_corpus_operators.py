"""Operators 1, 2, 3, 6, 9 and 10 and the pipeline's stages against plain versions, held-out accuracy and edge cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumora.llm import op02_sentencepiece as pieces
from lumora.llm import op03_mixing as mixing
from lumora.llm import op06_lm as lm
from lumora.llm import op09_embedding_dedup as vectors
from lumora.llm import op10_minhash
from lumora.llm import queries
from lumora.llm.gru import Gru, _sums, streams
from lumora.llm.graph import connected_components
from lumora.llm.op01_langid import LanguageModel, fit, held_out, identify
from lumora.llm.op03_mixing import mix_sources
from lumora.llm.op10_minhash import least_overlap, near_duplicates

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ODD = [(1, None, None), (2, "", "a"), (2, "", "a"), (3, " \n\t", "b"), (4, "12 !? ...", "a"), (None, "one two three four five six", None), (5, "word " * 20_000, "a"), (5, "word " * 20_000, "a"), (6, "x" * 3000, "b")]
ODD_SCHEMA = "doc_id long, text string, source string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def plain_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def plain_near(docs, n, num, den):
    sets = {}
    for doc_id, text in docs:
        w = words(text)
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    holders, shared = defaultdict(list), Counter()
    for doc_id, s in sets.items():
        for x in s:
            holders[x].append(doc_id)
    for ids in holders.values():
        shared.update((a, b) for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), c in shared.items() if den * c >= num * (len(sets[a]) + len(sets[b]) - c)]
    return sets, plain_components(sets, links)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)] + [(None, 3), (9, 9), (9, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    live = [(a, b) for a, b in edges if a is not None]
    assert got == plain_components({x for e in live for x in e}, live)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, num):
    rng = np.random.default_rng(n)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = list(rng.choice(vocabulary, 60))
    docs = []
    for i in range(60):  # originals, chains and stars of edits; many share one passage
        text = list(rng.choice(vocabulary, int(rng.integers(2, 160)))) + passage * (i % 3 == 0)
        docs.append(" ".join(text))
        for _ in range(int(rng.integers(0, 6))):
            if rng.random() < 0.5:
                text = list(text)
            for at in rng.integers(0, len(text), 1 + len(text) // 60):
                text[at] = str(rng.choice(vocabulary))
            docs.append(" ".join(text))
    rows = [(i, t, "x") for i, t in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, text string, class string").repartition(7)
    sets, component = plain_near([r[:2] for r in rows], n, num, 100)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(table, n, num, 100).collect()}
    assert got == {i: (len(sets[i]), component[i], component[i] == i) for i in sets}


def test_near_duplicates_of_odd_rows(spark):
    table = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = sorted((tuple(r) for r in near_duplicates(table).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 2, None, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 6, True)]
    assert got == sorted(want, key=repr)
    assert near_duplicates(table.limit(0)).count() == 0


def test_near_duplicates_in_small_batches(spark, monkeypatch):
    """Workers get texts and full sets by BATCH_ROWS at most, and the session's own limit is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def checked(step):
        def run(batches, **options):
            def small():
                for batch in batches:
                    assert batch.num_rows <= 7
                    yield batch

            return step(small(), **options)

        return run

    monkeypatch.setattr(op10_minhash, "BATCH_ROWS", 7)
    for step in ("_sketches", "_blobs", "_linked"):
        monkeypatch.setattr(op10_minhash, step, checked(getattr(op10_minhash, step)))
    texts = [" ".join(f"{i}w{j}" for j in range(60)) + end for i in range(40) for end in ("", " more")]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i in range(80)]
    assert spark.conf.get(name) == before


def test_least_overlap():
    least = least_overlap(0.85, 64)
    draws = np.random.default_rng(1).binomial(64, 0.85, 200_000)
    assert (draws >= least[64]).mean() > 0.9999 and least[64] > 36 and (np.diff(least) >= 0).all()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == truth.keys()
    out = [r for r in got.values() if r.held_out]
    assert len(out) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95
    model = fit(docs.selectExpr("doc_id AS key", "text", "lang"))
    odd = identify(spark.createDataFrame(ODD, "doc_id long, text string, score string"), model)
    found = sorted((r.doc_id or 0, r.lang_pred) for r in odd.collect())
    assert [lang for i, lang in found if 0 < i < 5] == ["und"] * 5 and {r.score for r in odd.where("lang_pred = 'und'").collect()} == {0.0}
    none = fit(docs.limit(0).selectExpr("doc_id AS key", "text", "lang"))
    assert {r.lang_pred for r in identify(docs.limit(5), none).collect()} == {"und"}
    assert identify(docs.limit(0), model).count() == 0


def test_backoff():
    row = lambda *x: tuple(map(float, x))
    model = LanguageModel(["a", "b"], [{"the": row(1, 5)}, {}, {" t": row(2, 4), "th": row(4, 2)}, {"he ": row(1, 3)}, {}, {}], [5.0, 4.0, 4.0, 4.0, 4.0, 4.0])
    assert model.word_cost("the") == pytest.approx( (1, 5))
    assert model.word_cost("ahe") == pytest.approx( (3.0, 11 / 3))  # " ah", "ahe", "he ": two are unknown
    assert model.word_cost("thx") == pytest.approx( (3.5, 3.5))  # no 3-gram is known; of its 2-grams two of four are
    assert model.word_cost("zz") == pytest.approx( (4, 4))


def unigram_model(vocabulary):
    """The library's own unigram model of the same pieces and scores, as a serialized model."""
    from sentencepiece import SentencePieceProcessor

    given = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n % 128 + 128]), n // 128
        return out + bytes([n])

    def part(field, raw):
        return number(field * 8 + 2) + number(len(raw)) + raw

    out = b""
    for i in range(given.vocab_size()):
        kind = 2 if given.is_unknown(i) else 3 if given.is_control(i) else 6 if given.is_byte(i) else 1
        out += part(1, part(1, given.id_to_piece(i).encode()) + b"\x15" + np.float32(vocabulary.scores[i]).tobytes() + b"\x18" + number(kind))
    trainer = b"\x18\x01" + number(35 * 8) + b"\x01"
    normalizer = part(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"
    return SentencePieceProcessor(model_proto=out + part(2, trainer) + part(3, normalizer))


def test_pieces():
    vocabulary = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    library = unigram_model(vocabulary)
    rng = np.random.default_rng(2)
    texts = ["Hello world", "The quick brown fox", "日本語 テキスト", "🎉🎉 ok é ñandú", "a  b", " lead", "trail ", "x\ny\n\nz", "", " ", "   \n ", "Anblewh sttible athawh", "ﬁ½ ​ q", "\x00\x01", "a▁b"]
    texts += ["".join(rng.choice(list("thenrsoaiéü .,"), 30)) for _ in range(200)]
    encoder = pieces.Encoder(vocabulary)
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert pieces.decode(vocabulary, ids) == text.replace("▁", " ")
        want = library.encode(text)
        score = lambda x: sum(vocabulary.unknown_score if library.is_byte(int(i)) else vocabulary.scores[i] for i in x)
        assert len(ids) == len(want) and score(ids) == pytest.approx(score(want), abs=1e-3), text
    for word in ["thenrsoai" * 20, "é" * 90, "abc🎉def"]:
        [many] = pieces._search_many(vocabulary, [("▁" + word).encode()])
        assert many.tolist() == pieces._search_one(vocabulary, ("▁" + word).encode())


def test_piece_stage_of_odd_rows(spark):
    table = spark.createDataFrame(ODD, "doc_id long, text string, n_pieces string")
    got = pieces.encode_texts(table, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t, _ in ODD)
    assert all(len(r.piece_ids) == r.n_pieces for r in got)


def test_mixing_of_odd_rows(spark):
    table = spark.createDataFrame([(i, t, s, "x") for i, t, s in ODD], "doc_id long, text string, source string, target string")
    got = mix_sources(table).collect()
    assert len(got) == len(ODD)
    budget = sum(r.size for r in got)
    targets = {r.source: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(budget) and sum(r.taken for r in got) <= budget
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 and r.target <= 3 * r.source_size for r in got)
    assert mix_sources(table.limit(0)).count() == 0
    assert {r.taken for r in mix_sources(table.where("size(split(text, 'w')) = 0 or text is null or trim(text) = ''")).collect()} == {0}


def test_mixing_of_repeated_ids(spark, monkeypatch):
    """Half of the rows have no doc_id, many share one: their ranges are split, each row has copies of its own, and targets are met."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 60)
    rows = [(None if i % 2 else i // 40, "w " * (1 + i % 5), f"s{i % 3}", i) for i in range(4000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, row_no long").repartition(7), keep=("row_no",)).collect()
    assert sorted(r.row_no for r in got) == list(range(4000)) and {(r.row_no, r.doc_id, r.size) for r in got} == {(n, i, len(t) // 2) for i, t, _, n in rows}
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 6 for s in target) and sum(taken.values()) <= sum(r.size for r in got)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i * i % 5 % 3}") for i in range(3000)] + [(5000 + i, "v", None) for i in range(40)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)


def test_lookups_and_sums_by_token():
    """Words are found by the first bits of their hashes, also where many share them; rows are summed by token in runs of any length."""
    rng = np.random.default_rng(3)
    shared = (np.uint64(5) << np.uint64(64 - lm.SLOT_BITS)) + np.arange(40, dtype=np.uint64)
    for words in (np.unique(np.concatenate([shared, rng.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])), shared[:1], shared[:0]):
        model = lm.Model(words, np.arange(len(words)) + 1, np.arange(len(words), dtype=np.int32), np.zeros(0), 0, 0, 0)
        asked = np.concatenate([words, words + np.uint64(1), shared, rng.integers(0, 1 << 64, 100, dtype=np.uint64)])
        place = {int(w): i for i, w in enumerate(words)}
        counts, tokens = model.look_up(asked, np.full(len(asked), 7, np.uint8))
        assert counts.tolist() == [place[int(w)] + 1 if int(w) in place else -1 for w in asked]
        assert tokens.tolist() == [place.get(int(w), lm.HEAD_WORDS + 7) for w in asked]
    tokens, x = np.repeat(np.arange(30), np.arange(30)), rng.standard_normal((3, 435, 4))
    order = rng.permutation(435)
    got = _sums(x, order, np.flatnonzero(np.diff(tokens, prepend=-1)))
    assert np.allclose(got, np.stack([x[:, order[tokens == t]].sum(axis=1) for t in range(1, 30)], axis=1))


def test_gradients_and_scores():
    gru = Gru(70, 3, size=5, embedding=4, seed=1)
    gru.p = {k: v.astype(float) for k, v in gru.p.items()}
    rng = np.random.default_rng(0)
    bounds = np.array([0, 5, 6, 13, 16])
    ids = rng.integers(0, 74, 16).astype(np.int32)
    s, h = streams(ids, bounds, 2, gru.end), rng.standard_normal((2, 5))
    _, _, _, grads = gru.loss_and_gradients(s, 0, len(s.token), h)
    for k, v in gru.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in v.shape)
            kept, loss = v[at], []
            for shift in (1e-6, -1e-6):
                v[at] = kept + shift
                nats, n, *_ = gru.loss_and_gradients(s, 0, len(s.token), h)
                loss.append(nats / n)
            v[at] = kept
            assert (loss[0] - loss[1]) / 2e-6 == pytest.approx(grads[k][at], rel=1e-3, abs=1e-6) or kept < -1e8
    whole = gru.score(ids, bounds, width=2, window=3)
    alone = [gru.score(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds, bounds[1:], strict=False)]
    assert whole == pytest.approx(alone)
    assert sum(np.exp(gru.score(np.array([t], np.int32), np.array([0, 1]))[0]) for t in range(74)) == pytest.approx(1)


def test_windows_of_scores_hold_few_tokens(monkeypatch):
    """Many streams have short windows and a few long ones, with the scores of any other."""
    rng = np.random.default_rng(8)
    gru = Gru(70, 3, size=5, embedding=6)
    bounds = np.concatenate([[0], np.cumsum([*rng.integers(1, 90, 500), 900])])
    ids = rng.integers(0, 74, bounds[-1]).astype(np.int32)
    run, seen = Gru.run, []
    monkeypatch.setattr(Gru, "run", lambda self, s, lo, hi, h, keep: (seen.append((hi - lo, len(h))), run(self, s, lo, hi, h, keep))[1])
    got = gru.score(ids, bounds)
    assert max(a * b for a, b in seen) <= 4608 and any(a > 48 for a, _ in seen)
    assert got == pytest.approx(gru.score(ids, bounds, window=7), rel=1e-5)


def test_a_task_counts_its_slices_together(monkeypatch):
    monkeypatch.setattr(lm, "TEXTS", 2)
    texts = pa.RecordBatch.from_pydict({"text": ["a b A", "c", "b b", "", "a"]})
    for most, rows in ((1_000_000, 1), (1, 2)):
        monkeypatch.setattr(lm, "COUNTED", most)
        found = list(lm._count(iter([texts])))
        assert len(found) == rows
        total = Counter()
        for x in found:
            assert len(set(x.column("word").to_pylist())) == x.num_rows
            total.update(dict(zip(x.column("word").to_pylist(), x.column("n").to_pylist(), strict=True)))
        hashes, kinds, _ = lm.words_and_classes(texts.column("text"))
        assert total == Counter(hashes.view(np.int64).tolist())
        of = dict(zip(hashes.view(np.int64).tolist(), kinds.tolist(), strict=True))
        assert all(of[w] == k for x in found for w, k in zip(x.column("word").to_pylist(), x.column("kind").to_pylist(), strict=True))


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE_WORDS", 3000)  # so that known words are looked up too, in many buckets
    monkeypatch.setattr(lm, "BUCKET_WORDS", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out("doc_id", 7, 2))
    more = spark.createDataFrame([(-1, None, False), (-2, "", True), (-3, "Never before seen", True), (-3, "Never before seen", True), (None, "the", None), (-4, "the of " * 30_000, True)], "doc_id long, text string, held_out boolean")
    table = docs.select("doc_id", "text", "held_out").unionByName(more)
    rows = table.collect()
    tokens = [(r, [*words(r.text), None]) for r in rows]
    c = Counter(w for r, t in tokens if not r.held_out for w in t)
    total, distinct = sum(c.values()), len(c)
    want = Counter((r.doc_id, bool(r.held_out), len(t), sum(c[w] > 0 for w in t), total, round(sum(log10((c[w] + 1) / (total + distinct + 1)) for w in t), 3)) for r, t in tokens)
    got = lm.score_texts(table).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 3)) for r in got) == want
    out = [r for r in got if r.held_out and r.doc_id >= 0]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in got)
    assert lm.score_texts(table.limit(0)).count() == 0
    assert lm.score_texts(table.where("held_out")).select("train_tokens").distinct().collect()[0][0] == 0


def test_lm_learns_from_all_texts(spark, monkeypatch):
    """Replicas together train on every text once, and the averaged weights know the corpus; a single long text is learnt too."""
    monkeypatch.setattr(lm, "SMALL_TOKENS", 20_000)
    monkeypatch.setattr(lm, "REPLICA_TOKENS", 20_000)
    seen = spark.sparkContext.accumulator(0)
    real = lm._train

    def counted(texts, *rest):
        seen.add(sum(len(x) // 2 for x in texts.column("ids").to_pylist()))
        return real(texts, *rest)

    monkeypatch.setattr(lm, "_train", counted)
    texts = [(i, " ".join(f"a{(i + k) % 7} b{(i + k) % 7}" for k in range(40)), False) for i in range(6000)] + [(-1, "a1 b1 a2 b2 a3 b3", True), (-2, "a1 b3 a2 b1 a3 b2", True)]
    table = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean").repartition(6)
    scores = {r.doc_id: r.score for r in lm.score_texts(table).where("held_out").collect()}
    assert seen.value == 6000 * 81 > 400_000
    assert scores[-1] > scores[-2] + 3
    one = spark.createDataFrame([(0, "the of " * 300_000, False), (1, "the of the of", True), (2, "the the of of", True)], "doc_id long, text string, held_out boolean")
    scores = {r.doc_id: r.score for r in lm.score_texts(one).where("held_out").collect()}
    assert scores[1] > scores[2] + 1


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_VALUES", 16 * 64)  # so that tiles meet
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([b + rng.standard_normal((12, 16)) * s for b, s in zip(base, np.linspace(0.05, 0.6, 40), strict=True)]))]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None]), (2003, [float("nan")] * 16), (2004, []), (2005, [1.0, 1.0]), (2006, [2.0, 2.0]), (None, rows[0][1]), (2007, [float("inf")]), (2006, [2.0, 2.0])]
    table = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, n_links string").repartition(5)
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(list)
    pairs = []
    for a, (i, v) in enumerate(good):
        for b, (j, w) in enumerate(good):
            if a != b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.9:
                links[a].append(b)
                pairs.append((i, j))
    component = plain_components({i for i, _ in good}, pairs)
    want = Counter((i, len(links[a]), component[i], component[i] == i) for a, (i, _) in enumerate(good))
    want.update([(i, 0, i, True) for i in (2000, 2001, 2002, 2003, 2004, 2007)] + [(None, 0, None, True)])
    assert Counter(tuple(r) for r in vectors.near_duplicates(table).collect()) == want
    assert vectors.near_duplicates(table.limit(0)).count() == 0
    single = table.where("vec_id < 1100").withColumn("embedding", F.col("embedding").cast("array<float>"))
    near = {r.vec_id: r.n_links for r in vectors.near_duplicates(single).collect()}
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 1100}
    units = {i: v / np.linalg.norm(v) for i, v in exact.items()}
    assert near == {i: sum(u @ v >= 0.9 for j, v in units.items() if j != i) for i, u in units.items()}


def test_stages_of_odd_tables(spark):
    """Repeated and missing doc_ids are decided row by row, clashing columns have no effect, no label leaves the texts with letters."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, None, "a"), (2, long, None, "a"), (2, "quite another text of its own kind", None, "b"), (3, long, None, "b"), (3, long, None, "b"), (None, long, None, "a"), (None, "12", None, None), (4, "", None, "b")]
    table = spark.createDataFrame([(*r, 0, 5, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row long, lang_pred string")
    one = corpus_pipeline.keep_identified(spark, table, "")
    assert Counter((r.doc_id, r.lang) for r in one.collect()) == Counter((r[0], None) for r in rows if r[1] not in ("", "12"))
    two = corpus_pipeline.keep_distinct(spark, one.withColumn("copies", F.lit(1)), "")
    assert Counter((r.doc_id, r.text) for r in two.collect()) == Counter([(1, long), (2, rows[2][1])])
    three = corpus_pipeline.mix(spark, one, "")
    assert sum(len(r.text.split()) for r in three.collect()) <= sum(len(r[1].split()) for r in rows)
    known = table.withColumn("lang", F.when(F.col("doc_id") == 1, "xx"))
    assert {r.lang for r in corpus_pipeline.keep_identified(spark, known, "").collect()} == {"xx"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), "").count() == 0


def test_stages_shuffle_no_texts(spark, tmp_path, monkeypatch):
    """Few decisions reach the rows by broadcast, many by a join, with the same result."""
    rows = [(i, " ".join(f"{i % 30}w{j}" for j in range(30 + i % 4)), None, "ab"[i % 2], 0) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for stage in (corpus_pipeline.keep_distinct, corpus_pipeline.mix):
        found = []
        for most in (1_000_000, -1):
            monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", most)
            out = stage(spark, docs, str(tmp_path))
            found.append(sorted(map(tuple, out.collect()), key=repr))
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            assert ("strategy=broadcast" in plan) == (most > 0)
        assert found[0] == found[1] and found[0]


def test_stages(spark, tmp_path):
    extra = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, "12 34 !", "en", None, 7), (None, "the one and only of them", None, "src1", 24)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra)
    found = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        found.append(docs.collect())
    first, second, third, last = found
    assert {r.doc_id for r in first} == {None, *range(200)} and all(r.lang for r in first)
    _, component = plain_near([(r.doc_id, r.text) for r in first if r.doc_id is not None], 5, 80, 100)
    assert {r.doc_id for r in second} == {None, *component.values()}
    copies = Counter(r.doc_id for r in third)
    assert max(copies.values()) <= 3 and copies.keys() <= {r.doc_id for r in second}
    assert Counter((r.doc_id, r.text) for r in last) == Counter((r.doc_id, r.text) for r in third) and all(len(r.piece_ids) == r.n_pieces > 0 for r in last)
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "lang", "source", "n_chars", "text", "piece_ids", "n_pieces"]
