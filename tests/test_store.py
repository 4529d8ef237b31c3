from __future__ import annotations

import uuid
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadlake.config import Layout, StoreConfig
from quadlake.errors import ConfigError, TransactionError
from quadlake.session import scratch_scope, shared_dir, stage
from quadlake.sources.nquads import format_quads, parse_lines, read_nquads, write_nquads
from quadlake.sources.quads import SCHEMA
from quadlake.store import QuadStore, open_store
from quadlake.streaming.ingest import ingest, predicate_rates

A, B, P, G = "<http://e/a>", "<http://e/b>", "<http://e/p>", "<http://e/g>"


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, {"path": str(tmp_path), "catalog": "test"})


def quads(source):
    return Counter(tuple(r) for r in source.scan().collect())


def test_add_is_idempotent_and_counts_what_is_new(store):
    with store.connect() as c:
        assert c.add(A, P, B) == 1
        assert c.add(A, P, B, [G, None, G]) == 1
        assert c.add(A, P, B, inferred=True) == 0
        assert c.add_all([(A, P, '"x"', None), (A, P, '"x"', None)]) == 1
    assert quads(store) == Counter([(A, P, B, None), (A, P, B, G), (A, P, '"x"', None)])


@pytest.mark.parametrize("contexts,left", [((), 0), ((None,), 2), ((G,), 2), (("<http://e/unknown>",), 3), ((None, G, None), 1)])
def test_remove(store, contexts, left):
    with store.connect() as c:
        c.add(A, P, B, [None, G, "_:h"])
        assert c.remove(A, P, B, contexts) == 3 - left
        assert c.count() == left


def test_transactions(store):
    c, other = store.connect(), store.connect()
    c.begin()
    c.add(A, P, B)
    c.set_namespace("e", "http://e/")
    assert c.count() == 1 and other.count() == 0 and other.namespace("e") is None
    with pytest.raises(TransactionError):
        c.begin()
    c.commit()
    assert other.count() == 1 and other.namespace("e") == "http://e/"
    c.begin()
    c.remove()
    assert c.count() == 0
    c.rollback()
    assert c.count() == 1
    for call in (c.commit, c.rollback):
        with pytest.raises(TransactionError):
            call()


def test_only_one_of_two_commits_wins(store):
    a, b = store.connect(), store.connect()
    a.begin(), b.begin()
    a.add(A, P, B), b.add(B, P, A)
    a.commit()
    with pytest.raises(TransactionError):
        b.commit()
    assert quads(store) == Counter([(A, P, B, None)])


def test_errors_are_raised_and_nothing_is_kept(store):
    c = store.connect()
    for bad in [('"x"', P, B, None), (A, "_:p", B, None), (A, P, "x", None), (A, P, B, '"g"'), (None, P, B, None)]:
        with pytest.raises(ValueError):
            c.add_all([bad])
    assert store.version() == 0
    c.close()
    with pytest.raises(TransactionError):
        c.add(A, P, B)


def test_a_failed_block_is_rolled_back_and_close_commits(store):
    with pytest.raises(RuntimeError), store.connect() as c:
        c.begin()
        c.add(A, P, B)
        raise RuntimeError
    assert store.version() == 0
    with store.connect() as c:
        c.begin()
        c.add(A, P, B)
    assert store.version() == 1


def test_namespaces_survive(spark, store):
    with store.connect() as c:
        c.set_namespace("ex", "http://old/")
        c.set_namespace("ex", "http://e/")
        c.set_namespace("y", "http://y/")
        c.remove_namespace("never")
        c.remove_namespace("y")
    again = QuadStore.open(spark, store.config).connect()
    assert [tuple(r) for r in again.namespaces().collect()] == [("ex", "http://e/")]
    again.clear_namespaces()
    assert store.connect().namespaces().count() == 0


def test_changes_write_only_what_is_new_and_compact_folds_them(store):
    c = store.connect()
    c.add_all([(A, P, f'"{i}"', G if i % 2 else None) for i in range(20)])
    c.add_all([(A, P, f'"{i}"', None) for i in range(0, 24, 2)])
    assert c.remove(contexts=[G]) == 10 and c.remove(o='"2"') == 1 and c.add(A, P, '"2"') == 1
    entries = store.state()["entries"]
    assert ["remove" in e for e in entries] == [False, False, True, True, False]
    sizes = [c.spark.read.parquet(f"{store.root}/{e['folders']['0']}").count() for e in entries if "folders" in e]
    assert sizes == [20, 2, 1]
    before = quads(store)
    assert len(before) == 12 and set(before.values()) == {1}
    store.compact()
    assert len(store.state()["entries"]) == 1 and quads(store) == before
    assert c.remove() == 12 and c.count() == 0 and c.add(A, P, B) == 1 and c.count() == 1


def test_removal_of_given_quads(spark, store):
    c = store.connect()
    c.add_all([(A, P, f'"{i}"', G if i % 2 else None) for i in range(20)])
    c.add(A, P, '"3"')
    gone = spark.createDataFrame([(A, P, '"3"', G, 1), (A, P, '"3"', G, 2), (A, P, '"4"', None, 3), (A, P, '"5"', None, 4), (B, P, B, None, 5)], SCHEMA + ", n int")
    assert c.remove_all(gone) == 2 and c.remove_all(gone) == 0 and c.remove_all([]) == 0
    want = Counter((A, P, f'"{i}"', G if i % 2 else None) for i in range(20) if i not in (3, 4)) + Counter([(A, P, '"3"', None)])
    assert quads(store) == want
    assert c.add(A, P, '"4"') == 1
    store.compact()
    assert quads(store) == want + Counter([(A, P, '"4"', None)])
    assert store.vacuum() == 4 and quads(store) == want + Counter([(A, P, '"4"', None)])


def test_an_input_is_evaluated_once(spark, tmp_path):
    """Rows that come out differently each time are the same in every layout."""
    store = open_store(spark, {"path": str(tmp_path), "layouts": [{"sort": ["s", "p", "o", "c"]}, {"sort": ["o"]}]})
    c = store.connect()
    rows = spark.range(200).select(F.lit(A).alias("s"), F.lit(P).alias("p"), F.concat(F.lit('"'), F.uuid(), F.lit('"')).alias("o"), F.lit(None).cast("string").alias("c"))
    assert c.add_all(rows) == 200
    entries = store.state()["entries"]
    one, two = (Counter(tuple(r) for r in store.view(entries, k).collect()) for k in (0, 1))
    assert one == two and len(one) == 200
    assert len([n for n in store.files.names("") if n.startswith("quads-")]) == 2


def test_many_commits_keep_a_short_pointer(spark, store, monkeypatch):
    monkeypatch.setattr("quadlake.store.ENTRIES", 6)
    c = store.connect()
    want = Counter()
    c.add_all([(B, P, f'"{i}"', None) for i in range(50)])
    want += Counter((B, P, f'"{i}"', None) for i in range(50))
    first = store.state()["entries"][0]
    for i in range(14):
        c.add(A, P, f'"{i}"')
        want[(A, P, f'"{i}"', None)] += 1
        if i % 5 == 4:
            assert c.remove(o=f'"{i}"') == 2 and c.remove_all([(A, P, f'"{i - 1}"', None)]) == 1
            del want[(A, P, f'"{i}"', None)], want[(B, P, f'"{i}"', None)], want[(A, P, f'"{i - 1}"', None)]
        assert len(store.state()["entries"]) <= 6
        assert i > 3 or store.state()["entries"][0] == first  # small entries are folded without the large one
    assert quads(store) == want
    c.remove()
    assert c.count() == 0


def test_inferred_statements_are_like_others(store):
    c = store.connect()
    assert c.add(A, P, B, inferred=True) == 1 and c.remove(A, P, B, inferred=True) == 1 and c.count() == 0
    assert c.add(A, P, B) == 1 and c.remove(inferred=True) == 1
    assert store.terms.uri("http://e/", "x") == "<http://e/x>" and store.terms.decode(store.terms.literal("x")).value == "x"


def test_bound_columns_prune_the_layout_that_is_sorted_by_them(spark, tmp_path):
    store = open_store(spark, {"path": str(tmp_path), "layouts": [{"sort": ["s", "p"], "partitions": 4}, {"sort": ["o", "p"], "partitions": 4}]})
    with store.connect() as c:
        c.add_all([(f"<http://e/{i}>", P, f'"{i:03}"', None) for i in range(100)])
    folders = store.state()["entries"][0]["folders"]
    for bound, layout in (({"o": '"007"'}, "1"), ({"s": "<http://e/7>"}, "0")):
        df = store.scan(**bound)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert folders[layout] in "".join(df.inputFiles()) and "EqualTo(" + next(iter(bound)) in plan
        assert df.count() == 1


def test_vacuum_and_drop(store):
    c = store.connect()
    c.add_all([(A, P, f'"{i}"', None) for i in range(9)])
    c.add(A, P, B)
    store.compact()
    before = quads(store)
    assert store.vacuum(keep=2) == 0 and store.vacuum() == 2 and store.vacuum() == 0
    assert quads(store) == before and store.version() == 3
    c.add(B, P, A)
    assert store.version() == 4
    store.drop()
    assert store.version() == 0 and store.scan().count() == 0


def test_rollback_leaves_no_files(store):
    c = store.connect()
    c.begin()
    c.add(A, P, B)
    c.rollback()
    assert not [n for n in store.files.names("") if n.startswith("quads-")]


def test_catalogs_and_layouts_do_not_mix(spark, tmp_path):
    layouts = [{"sort": ["c", "s", "p", "o"]}, {"sort": ["o", "p"], "partitions": 2}]
    one = open_store(spark, {"path": str(tmp_path), "catalog": "one", "layouts": layouts})
    two = open_store(spark, {"path": str(tmp_path), "catalog": "two"})
    with one.connect() as c:
        c.add_all([(A, P, f'"{i}"', G if i % 2 else None) for i in range(40)])
    assert two.scan().count() == 0
    assert [one.snapshot().best_layout(**x) for x in ({"o": '"1"', "p": P}, {"c": G}, {})] == [1, 0, 0]
    assert one.scan(o='"7"').count() == 1 and one.scan(contexts=[G]).count() == 20
    assert one.query("SELECT ?o WHERE { ?s ?p ?o } ORDER BY ?o LIMIT 1").first().o == '"0"'


def test_config_round_trip():
    config = StoreConfig("/data", "cat", (Layout(("o", "p", "c"), 7), Layout()))
    assert StoreConfig.from_quads(config.to_quads()) == config
    assert StoreConfig.from_options(config.options()) == config
    assert StoreConfig("/data").layouts == (Layout(),)
    for bad in ({}, {"path": "x", "unknown": 1}, {"path": "x", "catalog": "a/b"}, {"path": "x", "layouts": [{"sort": ["z"]}]}, {"path": "x", "layouts": []}):
        with pytest.raises(ConfigError):
            StoreConfig.from_options(bad)


def test_other_store_types_are_refused(spark, tmp_path):
    with pytest.raises(ConfigError):
        open_store(spark, {"path": str(tmp_path), "type": "other"})


# --------------------------------------------------------------------- N-Quads
TEXT = st.text(st.characters(blacklist_categories=("Cs",)), max_size=30)


@settings(max_examples=5, deadline=None)
@given(labels=st.lists(TEXT, min_size=1, max_size=40))
def test_any_label_survives_nquads(spark, labels):
    data = [(A, P, f'"{x}"' + ("", "@en", "^^<http://e/t>")[i % 3], None if i % 2 else "_:g") for i, x in enumerate(labels)]
    df = spark.createDataFrame(data, SCHEMA)
    back = parse_lines(format_quads(df)).where("ok").select("s", "p", "o", "c").collect()
    assert Counter(tuple(r) for r in back) == Counter(data)


def test_lines_of_other_writers(spark):
    lines = [
        r'<http://e/a> <http://e/p> "tab\tquote\"\\n é\U0001F600"@en-GB <http://e/g> .', "_:b1 <http://e/p> _:b.2 .", "# comment", "   ", "<http://e/a><http://e/p><http://e/b>.",
        '<http://e/a> <http://e/p> "x"^^<http://e/t> . # more', '<http://e/a> "p" "x" .', "<http://e/a> <http://e/p> .", "junk",
    ]
    got = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.ok for r in got].count(False) == 3 and len(got) == 7
    assert got[0].o == '"tab\tquote"\\n é\U0001f600"@en-GB' and got[0].c == "<http://e/g>"
    assert (got[1].s, got[1].o, got[1].c) == ("_:b1", "_:b.2", None)
    assert got[2].o == "<http://e/b>"


def test_long_labels_take_no_stack(spark):
    labels = ["x" * 300_000, '"\\' * 60_000, "\n\t" * 60_000, "\r\n" * 50_000 + "\\u0041"]
    df = spark.createDataFrame([(A, P, f'"{x}"@en', None) for x in labels], SCHEMA)
    assert sorted(r.o for r in parse_lines(format_quads(df)).where("ok").collect()) == sorted(f'"{x}"@en' for x in labels)


def test_nquads_files(spark, tmp_path):
    df = spark.createDataFrame([(A, P, '"a\nb"', None), (A, P, B, G)], SCHEMA)
    write_nquads(df, str(tmp_path / "out"))
    assert read_nquads(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.nq").write_text("junk\n")
    assert read_nquads(spark, str(tmp_path / "bad.nq"), strict=False).count() == 0
    with pytest.raises(Exception, match="not a quad"):
        read_nquads(spark, str(tmp_path / "bad.nq")).collect()


# ------------------------------------------------------------------- streaming
def test_stream_into_a_store(spark, store, tmp_path):
    source = tmp_path / "in"
    batch = spark.createDataFrame([(A, P, B, None), (A, P, '"x"', G), ("bad", P, B, None)], SCHEMA)
    for _ in range(2):  # delivered twice
        batch.write.mode("append").parquet(str(source))
        ingest(spark.readStream.schema(SCHEMA).parquet(str(source)), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert quads(store) == Counter([(A, P, B, None), (A, P, '"x"', G)])
    assert store.version() == 1


def test_rates_of_a_table_and_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(P, "2024-01-01 00:10:00"), (P, "2024-01-01 00:50:00"), (P, "2024-01-01 01:10:00"), (B, None)], "p string, t string")
    df = df.withColumn("t", df["t"].cast("timestamp_ntz"))
    assert sorted(r.n for r in predicate_rates(df, "t").collect()) == [1, 2]
    path = str(tmp_path / "rates")
    df.write.parquet(path)
    name = f"rates_{uuid.uuid4().hex}"
    predicate_rates(spark.readStream.schema(df.schema).parquet(path), "t").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table(name).collect()) == [1, 2]


def test_staged_tables_cut_lineage(spark):
    df = stage(spark, spark.range(10), "numbers")
    assert df.count() == 10 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()


def test_a_scope_removes_what_was_staged_in_it(spark):
    kept = stage(spark, spark.range(3), "kept")
    with scratch_scope():
        df = stage(spark, spark.range(10), "numbers")
        assert df.count() == 10
    with pytest.raises(Exception, match="(?i)not exist|not_exist|cannot find|not found"):
        spark.read.parquet(*df.inputFiles()).count()
    assert kept.count() == 3


def test_only_one_machine_may_do_without_a_shared_folder():
    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {}

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), Conf()

    for master in ("local-cluster[3,2,1024]", "spark://x:7077", "yarn", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(Session(master))
    assert shared_dir(Session("local[4]")).startswith("file:") and shared_dir(Session("local")).startswith("file:")
