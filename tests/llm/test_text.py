"""Tokens, repetition and mixtures."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadlake.llm import mixing as X
from quadlake.llm import repetition as P
from quadlake.llm import tokens as K
from quadlake.llm.perfect_hash import PerfectHash

DOCS = "doc_id bigint, text string, source string, ids string, tokens int, share int, copies string"
SAMPLE = "/root/testdata/sf0.001/documents.parquet"
TEXT = st.text(st.characters(blacklist_categories=("Cs",)), max_size=60)


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.read_ranks(f"{K.FOLDER}/{K.BYTE_BPE}"))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(f"{K.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


# ---------------------------------------------------------------------- tokens
@given(st.sets(st.binary(max_size=12), max_size=300))
@settings(max_examples=30, deadline=None)
def test_perfect_hash_is_minimal_and_tells_strangers(keys):
    keys = sorted(keys)
    h = PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(len(keys)))
    assert [h.find(k) for k in keys] == list(range(len(keys)))
    assert h.find(b"not one of them!") == -1


def test_whole_vocabulary_is_found(encoder):
    assert all(encoder.whole.find(t) == i for i, t in enumerate(encoder.entries))


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  x", "it's we'll I'D 'tis", "<|endoftext|>", "a" * 5000, " " * 3000, "\r\n\t" * 500, "\xe9" * 400 + " \xf1", "٣٤٥ \xbd Ⅷ x\xb2"]
ODD += ["\x1c\x1d a\x85b　c​d", "\U0001f44d\U0001f3fd\U0001f468‍\U0001f469", "\x00\x01﻿", "0123456789" * 300, "ab" * 20_000, "é\xa0\xa0x y", "日本語テスト"]


def test_odd_texts_equal_both_libraries(encoder, library):
    ranks = {t: i for i, t in enumerate(encoder.entries)}
    import public_tokenizers

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ODD:
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids == other.encode_ordinary(text), text[:20]
        assert b"".join(encoder.entries[i] for i in ids).decode() == text


def test_texts_taken_piece_by_piece(encoder, monkeypatch):
    texts = ["one two  three\n" * 50, "\xe9t\xe9 " * 40]
    whole, words = [encoder.encode(t) for t in texts], P.repeated_words(texts)
    monkeypatch.setattr(K, "LONG_TEXT", 16)
    monkeypatch.setattr(P, "LONG_TEXT", 16)
    assert [encoder.encode(t) for t in texts] == whole
    assert [list(x) for x in P.repeated_words(texts)] == [list(x) for x in words]


def test_merges_do_not_depend_on_the_memo(encoder):
    fresh = K.Encoder(encoder.entries, encoder.pattern)
    for word in ("lematenZogoha", "xX" * 40, "日本語"):
        assert fresh.merge(word.encode()) == encoder.encode(word)


def test_documents(spark, library):
    texts = [None, "", " ", *ODD, "y" * 300_000]
    rows = [(i, t, "s", "clash", 0, 0, "") for i, t in enumerate(texts)] + [(None, "null id", "s", "", 0, 0, "")] * 2
    got = K.encode_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.ids for r in got if r.doc_id is not None}
    assert by[0] == by[1] == []
    for i, t in enumerate(texts):
        assert by[i] == library.encode(t or "", add_special_tokens=False).ids
    assert K.encode_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_sample_documents(spark, library):
    df = spark.read.parquet(SAMPLE)
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for r in K.encode_documents(df).collect():
        assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_texts_come_back_from_their_ids(spark):
    texts = [None, "", "a", " \n\t", "é\U0001f600\u0301 x", "z" * 300_000, "\r\n'll 12 34"]
    df = spark.createDataFrame([(i, t, "s", "", 0, 1, "") for i, t in enumerate(texts)], DOCS)
    back = {r.doc_id: r.text for r in K.decode_documents(K.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_a_large_rank_file_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "MAX_FILE", 10)
    (tmp_path / "ranks").write_bytes(b"YQ== 0\nYg== 1\n")
    with pytest.raises(ValueError):
        K.shared_encoder(spark.range(1), str(tmp_path / "ranks"))


# ------------------------------------------------------------------ repetition
def brute(text, run=P.RUN):
    w = re.findall(r"\w+", text or "")
    seen, covered = set(), set()
    for i in range(len(w) - run + 1):
        key = tuple(w[i : i + run])
        if key in seen:
            covered.update(range(i, i + run))
        seen.add(key)
    return len(w), len(covered)


@given(st.lists(st.lists(st.sampled_from(["a", "b", "A", "é", "1_"]), max_size=60).map(" ".join) | st.none(), max_size=6), st.sampled_from([2, 3, 8]))
@settings(max_examples=150, deadline=None)
def test_repetition_equals_brute_force(texts, run):
    n, again = P.repeated_words(texts, run)
    assert list(zip(n, again)) == [brute(t, run) for t in texts]


def test_a_hash_collision_decides_nothing(monkeypatch):
    monkeypatch.setattr(P, "_BASE", np.uint64(0))  # every run gets the same number
    texts = ["a b c d e f g h i j k l m", "x y " * 20, None]
    n, again = P.repeated_words(texts)
    assert list(zip(n, again)) == [brute(t) for t in texts]


def test_repetition_of_documents(spark):
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(120_000))
    texts = [None, "", "...", "one two three", "again and again " * 9, long, long + " " + long, "word " * 8, "word " * 9]
    rows = [(i, t, "s", "", 0, 1, "") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in P.repetition(spark.createDataFrame(rows + rows[:1], DOCS)).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_repeated) == brute(t)
    assert got[0].share is None and got[2].share is None and got[8].share == 8 / 9
    found = P.repetitive(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.doc_id for x in found} == {i for i, t in enumerate(texts) if brute(t)[0] and 2 * brute(t)[1] >= brute(t)[0]}
    assert P.repetition(spark.createDataFrame([], DOCS)).count() == 0


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=80).map(" ".join), max_size=6), st.integers(0, 2**32), st.sampled_from([0.2, 0.5, 0.9]))
@settings(max_examples=100, deadline=None)
def test_no_weights_lose_a_repetitive_text(texts, seed, share):
    ratio = P.Ratio(tuple(np.random.default_rng(seed).normal(size=2 * P.BUCKETS).tolist()))
    runs = P._Runs(texts, P.RUN)
    for text, score in zip(texts, ratio.scores(runs)):
        n, again = brute(text)
        if n and again >= share * n:
            assert score <= ratio.threshold(share)
        assert np.isnan(score) == (n < P.RUN)


def test_ratio_of_two_corpora(spark):
    """The score alone tells planted texts, and does not depend on how the rows lie."""
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    clean = [text(r.randrange(30, 300)) for _ in range(300)]
    planted = [" ".join([text(20)] * r.randrange(4, 9) + [text(r.randrange(40))]) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "s", "", 0, 1, "") for i, t in enumerate(clean + planted)], DOCS)
    ratio = P.fit_ratio(df.repartition(5))
    assert ratio == P.fit_ratio(df.coalesce(1))
    got = {x.doc_id: x.score for x in P.scores(df, ratio).collect()}
    assert {i for i, x in got.items() if x <= ratio.middle(P.SHARE)} == set(range(300, 330))
    found = P.repetitive(df, ratio=ratio).collect()
    assert {x.doc_id for x in found} == set(range(300, 330)) and all(x.share >= P.SHARE for x in found)
    assert P.repetitive(df.limit(0)).count() == 0 and P.scores(df.limit(0), ratio).count() == 0


# --------------------------------------------------------------------- mixture
WEIGHTS = "source string, target_share double, max_repeats int"


def corpus(spark, n=3000, seed=3):
    r = random.Random(seed)
    words = {"a": "alpha beta gamma", "b": "un deux trois", "c": "eins zwei drei", "x": "junk"}
    rows = []
    for i in range(n):
        s = r.choices(["a", "b", "c", "x"], [70, 20, 5, 5])[0]
        text = " ".join(r.choice(words[s].split()) for _ in range(r.randrange(1, 80)))
        shown = None if r.random() < 0.05 and s != "x" else s
        rows.append((i, r.choice([None, "", text]) if r.random() < 0.03 else text, r.choice(["", " "]) if shown is None and r.random() < 0.3 else shown, "", 1, 1, "clash"))
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


def test_shares_and_caps(spark):
    df, rows = corpus(spark)
    weights = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("missing", 0.1, 3), (None, 0.5, 1)], WEIGHTS)
    mixed, targets, fit = X.mixture(spark, df, weights)
    got = mixed.collect()
    assert len(got) == len(rows)
    cap = {"a": 1, "b": 2, "c": 4}
    tokens = {}
    for r in got:
        assert 0 <= r.copies <= cap.get(r.source, 1 if r.member is not None else 0)
        if r.member is None:
            tokens[r.source] = tokens.get(r.source, 0) + r.tokens * r.copies
    assert tokens["x"] == 0
    report = {r.source: r for r in X.share_report(mixed, targets, fit).collect()}
    assert set(report) == {"a", "b", "c", "missing"}
    assert report["missing"].actual_share < 1e-6 and report["missing"].fitted_share == 0
    for s, want in (("a", 0.4 / 0.9), ("b", 0.3 / 0.9), ("c", 0.2 / 0.9)):
        assert report[s].fitted_share == pytest.approx(want)
        assert report[s].actual_share == pytest.approx(want, abs=0.004)
        assert report[s].most_copies <= cap[s]
    assert fit.residual < 1e-4
    assert max(abs(report[s].rate / cap[s] - 1) < 0.1 for s in cap)


def test_a_smaller_total_and_the_same_result_twice(spark):
    df, _ = corpus(spark, 1200)
    weights = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], WEIGHTS)
    one, *_ = X.mixture(spark, df, weights, total=4000)
    two, *_ = X.mixture(spark, df.repartition(3), weights, total=4000)
    assert sorted((r.doc_id, r.copies) for r in one.collect()) == sorted((r.doc_id, r.copies) for r in two.collect())
    assert sum(r.tokens * r.copies for r in one.collect()) == pytest.approx(4000, rel=0.05)


def test_classifier_on_held_out_documents(spark):
    df, rows = corpus(spark, 2500)
    labelled = [r for r in rows if r[2] and r[2] in "abc" and r[1]]
    targets = X.Targets(("a", "b", "c"), (0.4, 0.3, 0.3), (1, 1, 1))
    x, y = X.training_rows(df, targets, rows=800)
    assert len(x) == 800
    w = X.fit_classifier(x, y, 3)
    e = K.Encoder(K.read_ranks(f"{K.FOLDER}/{K.BYTE_BPE}"))
    p = X.posteriors(w, np.array([X.features(e, r[1]) for r in labelled]))
    assert (p.argmax(axis=1) == ["abc".index(r[2]) for r in labelled]).mean() > 0.95
    assert np.allclose(p.sum(axis=1), 1)


def test_least_squares_meet_soft_targets(spark):
    r = np.random.default_rng(0)
    soft = r.dirichlet([1, 1, 1], 400)
    rows = [(i, None, int(r.integers(1, 50)), [float(v) for v in soft[i]]) for i in range(400)] + [(1000 + i, "abc"[i % 3], 40, None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, member array<double>")
    targets = X.Targets(("a", "b", "c"), (0.5, 0.3, 0.2), (2, 2, 2))
    fit = X.fit_rates(df, targets, total=9000)
    assert fit.residual < 1e-4
    rated = X.with_rates(df, targets, fit).collect()
    totals = np.zeros(3)
    for x in rated:
        totals += x.rate * x.tokens * (np.array(x.member) if x.member is not None else np.eye(3)["abc".index(x.source)])
        assert 0 <= x.rate <= 2
    assert np.allclose(totals, [4500, 2700, 1800], rtol=1e-3)


def test_empty_tables(spark):
    none, weights = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], WEIGHTS)
    mixed, targets, fit = X.mixture(spark, none, weights)
    assert mixed.count() == 0
    assert [r.actual_share for r in X.share_report(mixed, targets, fit).collect()] == [0.0]
    df, rows = corpus(spark, 60)
    mixed, targets, fit = X.mixture(spark, df, spark.createDataFrame([], WEIGHTS))
    assert {r.copies for r in mixed.collect()} == {0}
    assert X.share_report(mixed, targets, fit).count() == 0
