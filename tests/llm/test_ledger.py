from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest

from quadlake.llm import ledger as L
from quadlake.session import scratch_path

SCHEMA = "literal_id bigint, label string, language string, datatype string, loaded_at timestamp_ntz, key string, copies int, first_id int"


def words(x):
    return " ".join("".join(c if c.isalnum() else " " for c in x.upper().replace("\u1e9e", "SS").lower().replace("\u03c2", "\u03c3")).split())


def canonical(label, language):
    label, language = label or "", (language or "").lower().replace("_", "-")
    items = [x for x in re.split("[;|\n\x0b\x0c\r\x85  ]", label) if x.strip()]
    if len(items) >= 2:
        parts = [re.match(r"(?s)([^=:]*)[=:](.*)", x) for x in items]
        if all(m and words(m[1]) for m in parts):
            return language, "list", frozenset((words(m[1]), words(m[2])) for m in parts)
    return language, "text", words(label)


def case(seed=1, n=600):
    r = random.Random(seed)
    names = ["Über", "façal", "keza", "Ñandu", "42", "ΟΔΟΣ", "straße", "b_c"]
    base = [[r.choice(names) for _ in range(r.randrange(1, 5))] for _ in range(60)]
    lists = [{f"n{k}": " ".join(r.choice(names) for _ in range(2)) for k in range(r.randrange(1, 4))} for _ in range(40)]
    out = []
    for i in range(n):
        x = r.random()
        if x < 0.3:
            label = r.choice(["a hot one", "A  HOT-one!", "[a hot, one]"])
        elif x < 0.65:
            w = [r.choice([str.upper, str.lower, str])(t) for t in r.choice(base)]
            label = r.choice(["", "«", "\t"]) + r.choice([" ", "  ", "-", ", ", "_"]).join(w) + r.choice(["", ".", "\n"])
        else:
            f = list(r.choice(lists).items())
            r.shuffle(f)
            eq, sep = r.choice(["=", ": ", " = "]), r.choice(["; ", " | ", "\n", ";;", "\r\n"])
            label = sep.join(a + eq + r.choice([str.upper, str])(b) for a, b in f)
        lang = r.choice([None, "", "en", "EN", "en-GB", "en_gb", "de"])
        out.append((1000 - i, None if r.random() < 0.02 else label, lang, None, None if r.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=r.randrange(999)), "clash", 1, 1))
    return out


def brute(rows):
    groups = {}
    for i, label, lang, *_ in rows:
        groups.setdefault(canonical(label, lang), []).append(i)
    return groups


def test_copies_against_brute_force(spark):
    rows = case()
    for batches in (1, 3):
        keyed, book = L.collapse(spark, spark.createDataFrame(rows, SCHEMA), "literal_id", "label", "language", "loaded_at", batches)
        groups = brute(rows)
        assert sorted((r.first_id, r.copies) for r in book.rows().collect()) == sorted((min(g), len(g)) for g in groups.values())
        got = [(r.first_id, r.record_id) for r in L.copies(keyed, book, limit=30).collect()]
        assert sorted(got) == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_only_touched_buckets_are_written_again(spark):
    book = L.Ledger(spark, scratch_path(spark, "test-ledger"), 8)
    one = spark.createDataFrame([(bytearray([i]), i) for i in range(60)], "key binary, record_id bigint")
    book.add(one)
    assert len(set(book.held.values())) == 1 and len(book.held) == 8
    old = set(book.held.values())
    book.add(one.where("record_id = 7").withColumn("record_id", one["record_id"] - 3))
    assert sum(v not in old for v in book.held.values()) == 1
    rows = {bytes(r.key)[0]: r for r in book.rows().collect()}
    assert len(rows) == 60 and (rows[7].copies, rows[7].first_id) == (2, 4) and rows[8].copies == 1
    before = dict(book.held)
    book.add(one.limit(0))
    assert book.held == before


def test_a_ledger_lasts_and_repeats_nothing(spark):
    path = scratch_path(spark, "test-ledger")
    keyed = L.keyed_records(spark.createDataFrame(case(4), SCHEMA), "literal_id", "label", "language", "loaded_at")
    parts = L.in_batches(keyed, 3)
    with pytest.raises(FileNotFoundError):
        L.Ledger.open(spark, path)
    for k in (0, 1, 0, 1, 2, 2):
        book = L.Ledger(spark, path, 5)
        fresh = not book.has(str(k))
        assert book.add(parts.where(f"_batch = {k}"), str(k)) == fresh
    once = L.Ledger(spark, scratch_path(spark, "test-ledger"), 3)
    once.add(keyed)
    want = sorted((bytes(r.key), r.copies, r.first_id) for r in once.rows().collect())
    book = L.Ledger.open(spark, path)
    assert (book.version, book.buckets) == (3, 5)
    assert sorted((bytes(r.key), r.copies, r.first_id) for r in book.rows().collect()) == want
    # a writer that ended between its manifest and its mark
    book.files.remove(book._mark("2"))
    again = L.Ledger.open(spark, path)
    assert again.has("2") and not again.add(keyed, "2")
    # another writer in between: one of two batches of a version is refused, and can be repeated
    one, two = L.Ledger.open(spark, path), L.Ledger.open(spark, path)
    assert one.add(keyed.limit(10), "x")
    with pytest.raises(RuntimeError):
        two.add(keyed.limit(20), "y")
    assert not L.Ledger.open(spark, path).has("y") and L.Ledger.open(spark, path).add(keyed.limit(20), "y")
    book = L.Ledger.open(spark, path)
    before = sorted((bytes(r.key), r.copies) for r in book.rows().collect())
    assert book.vacuum(1) > 0 and book.vacuum(1) == 0
    book = L.Ledger.open(spark, path)
    assert sorted((bytes(r.key), r.copies) for r in book.rows().collect()) == before and sum(n for _, n in before) == len(case(4)) + 30


def test_defined_results(spark):
    when = datetime(2024, 1, 1)
    rows = [(1, None, None, None, None, "", 0, 0), (2, "", "", None, when, "", 0, 0), (3, " ?! ", None, None, when, "", 0, 0), (4, "a" * 300_000, "en", None, when, "", 0, 0), (5, "A" * 300_000 + ".", "EN", None, when, "", 0, 0), (5, "A" * 300_000 + ".", "EN", None, when, "", 0, 0), (None, "", "", None, when, "", 0, 0)]
    keyed, book = L.collapse(spark, spark.createDataFrame(rows, SCHEMA), "literal_id", "label", "language", "loaded_at")
    assert sorted((r.first_id, r.record_id) for r in L.copies(keyed, book).collect()) == [(1, 2), (1, 3), (4, 5)]
    assert sorted(r.copies for r in book.rows().collect()) == [3, 4]


def test_long_runs_take_linear_time(spark):
    labels = [" " * 400_000 + "a=1;b=2", "a=1" + " " * 400_000 + ";b=2", "?" * 400_000 + "a=1;b=2", "a=1;" * 50_000 + "b=2", ";" * 400_000 + "a=1;b=2", "a=1; " + "\t" * 400_000 + "b=2"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert L.with_canonical_text(df, "label").select("_canonical").distinct().count() == 1


def test_empty_table(spark):
    keyed, book = L.collapse(spark, spark.createDataFrame([], SCHEMA), "literal_id", "label", "language", "loaded_at")
    assert book.rows().count() == 0 and L.copies(keyed, book).count() == 0


def test_near_copies_stay_apart(spark):
    pairs = [("a b", "ab"), ("a=1; b=2", "a=2; b=1"), ("a=1; b=2", "a 1 b 2"), ("x", "x 1"), ("a=1", "a: 1 b"), ("a=1;b", "b;a=1"), ("a=1; b=2; ?!", "b=2; a=1; ?!"), ("a=1; =2", "=2; a=1"), ("a=\x01; b=1", "a=1; b=\x01"), ("\xe9", "é")]
    for a, b in pairs:
        df = spark.createDataFrame([(a,), (b,)], "label string")
        assert L.with_canonical_text(df, "label").select("_canonical").distinct().count() == 2, (a, b)
    same = [("; a : 1 ;; b=\u3000 2 |", "b=2|\ta=1\r\n"), ("a=; b=", "B: | A:"), ("a=b=c; d=e:f", "D: e f; A b c".replace("A b", "A: b")), ("a\x01b", "A B"), ("a=1; b=2", "B: 2 | A: 1"), ("a=1;a=1;b=2", "b=2;a=1"), ("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος")]
    for a, b in same:
        df = spark.createDataFrame([(a,), (b,)], "label string")
        assert L.with_canonical_text(df, "label").select("_canonical").distinct().count() == 1, (a, b)
