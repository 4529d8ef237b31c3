"""A quad store on immutable Parquet files.

A version is a numbered pointer file with a list of entries: folders of quads
that were added, and patterns or folders of quads that were removed. An addition
writes only the quads that are new; a removal hides the matching quads of all
earlier entries. A commit that leaves more than ENTRIES entries folds the newest
of them into one, together with older ones that are no larger, so a quad is
written again only as often as the store doubles and a pointer stays short;
``compact`` folds all. Readers resolve the newest pointer once per call, so they
see a commit as a whole or not at all. Quads are a set of (s, p, o, c). The flag
for inferred statements is accepted everywhere and has no effect: all statements
are alike.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.config import STORE_TYPE, StoreConfig
from quadlake.errors import ConfigError, TransactionError
from quadlake.functions import terms
from quadlake.plans.algebra import Node, Query
from quadlake.plans.compile import execute
from quadlake.plans.sparql import parse
from quadlake.sources.files import Files
from quadlake.sources.quads import COLUMNS, SCHEMA, FrameQuads, QuadSource, context_filter

Quad = tuple[str, str, str, str | None]
#: Entries a version may have before the newest are folded.
ENTRIES = 32


class QuadStore(QuadSource):
    """A catalog: quads and namespaces below ``<path>/<catalog>``."""

    def __init__(self, spark: SparkSession, config: StoreConfig):
        if config.type != STORE_TYPE:
            raise ConfigError(f"unknown store type {config.type!r}")
        self.spark, self.config = spark, config
        self.root = f"{config.path.rstrip('/')}/{config.catalog}"
        self.files = Files(spark, self.root)
        #: helpers that make terms
        self.terms = terms

    @classmethod
    def open(cls, spark: SparkSession, options: StoreConfig | dict) -> QuadStore:
        """The store of a configuration; it comes into being with the first commit."""
        return cls(spark, options if isinstance(options, StoreConfig) else StoreConfig.from_options(options))

    def connect(self) -> Connection:
        return Connection(self)

    # ------------------------------------------------------------------ versions
    def version(self) -> int:
        return max((int(n[:-5]) for n in self.files.names("pointers") if n.endswith(".json")), default=0)

    def state(self) -> dict:
        """Folders and namespaces of the newest version."""
        v = self.version()
        return json.loads(self.files.read(f"pointers/{v:012d}.json")) if v else {"entries": [], "namespaces": {}}

    def publish(self, based_on: int, state: dict) -> None:
        if not self.files.create(f"pointers/{based_on + 1:012d}.json", json.dumps(state)):
            raise TransactionError("another commit came first")

    def view(self, entries: list[dict], layout: int = 0) -> DataFrame:
        """The quads of a list of entries. Folders that the same removals
        follow are read as one table."""
        parts: list[tuple[list[str], list[dict]]] = []
        for i, e in enumerate(entries):
            if "folders" not in e:
                continue
            after = [x["remove"] for x in entries[i + 1 :] if "remove" in x]
            if {} in after:
                continue  # everything was removed since
            path = f"{self.root}/{e['folders'][str(layout)]}"
            if parts and parts[-1][1] == after:
                parts[-1][0].append(path)
            else:
                parts.append(([path], after))
        out = None
        for paths, after in parts:
            rows = self.spark.read.schema(SCHEMA).parquet(*paths)
            for r in after:
                rows = without(rows, self.read(r["folder"])) if "folder" in r else rows.where(~removed(r))
            out = rows if out is None else out.unionByName(rows)
        # the filter tells the planner that there is nothing, so that no join is made with it
        return self.spark.createDataFrame([], SCHEMA).where(F.lit(False)) if out is None else out

    def read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{folder}")

    def write(self, quads: DataFrame) -> dict:
        """Write a set of quads once per layout, as an entry; file statistics
        on the sort columns let scans skip row groups. Only the first layout
        evaluates quads, the others are written from its files, so all hold the
        same quads whatever quads is made of."""
        out: dict[str, str] = {}
        for i, layout in enumerate(self.config.layouts):
            rows = quads if i == 0 else self.read(out["0"])
            rows = rows.repartitionByRange(*([layout.partitions] if layout.partitions else []), *layout.sort)
            out[str(i)] = f"quads-{uuid.uuid4().hex}"
            rows.sortWithinPartitions(*layout.sort).write.parquet(f"{self.root}/{out[str(i)]}")
        return {"folders": out, "rows": self.read(out["0"]).count()}

    def keep(self, quads: DataFrame) -> str:
        """Write quads as they come into a folder of their own."""
        folder = f"quads-{uuid.uuid4().hex}"
        quads.write.parquet(f"{self.root}/{folder}")
        return folder

    @staticmethod
    def folders_of(entry: dict) -> list[str]:
        removal = entry.get("remove", {})
        return [*entry.get("folders", {}).values(), *([removal["folder"]] if "folder" in removal else [])]

    def discard(self, entry: dict) -> None:
        for folder in self.folders_of(entry):
            self.files.remove(folder)

    def settle(self) -> None:
        """Fold the newest entries if there are more than ENTRIES: at least half
        as many, and every older one with no more rows than those after it. What
        was removed stays noted for the entries before them. A commit of another
        connection in between goes first."""
        v, state = self.version(), self.state()
        entries = state["entries"]
        if len(entries) <= ENTRIES:
            return
        start, rows = len(entries), 0
        while start and (len(entries) - start < ENTRIES // 2 or entries[start - 1].get("rows", 0) <= rows):
            start -= 1
            rows += entries[start].get("rows", 0)
        removals = [e for e in entries[start:] if "remove" in e]
        if len(removals) > ENTRIES // 4 or {} in [e["remove"] for e in removals]:
            start, removals = 0, []
        folded = self.write(self.view(entries[start:]))
        try:
            self.publish(v, {**state, "entries": [*entries[:start], *(removals if start else []), folded]})
        except TransactionError:
            self.discard(folded)

    def compact(self) -> None:
        """Write the quads of the newest version as one entry. Older folders
        stay for readers of older versions."""
        v, state = self.version(), self.state()
        if len(state["entries"]) > 1:
            self.publish(v, {**state, "entries": [self.write(self.view(state["entries"]))]})

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` versions and delete the folders
        only they used; gives the number of folders deleted. Not to be run
        while a transaction is open: its folders are not referred to yet."""
        pointers = sorted(n for n in self.files.names("pointers") if n.endswith(".json"))
        kept = pointers[-keep:] if keep > 0 else pointers
        used = {f for n in kept for e in json.loads(self.files.read(f"pointers/{n}"))["entries"] for f in self.folders_of(e)}
        for n in pointers[: len(pointers) - len(kept)]:
            self.files.remove(f"pointers/{n}")
        unused = [n for n in self.files.names("") if n.startswith("quads-") and n not in used]
        for n in unused:
            self.files.remove(n)
        return len(unused)

    def drop(self) -> None:
        """Delete the catalog with all its versions."""
        self.files.remove("")

    def snapshot(self, entries: list[dict] | None = None) -> Snapshot:
        return Snapshot(self, self.state()["entries"] if entries is None else entries)

    def scan(self, s=None, p=None, o=None, contexts=()) -> DataFrame:
        return self.snapshot().scan(s, p, o, contexts)

    def query(self, query: str | Query | Node, bindings: dict[str, str] | None = None) -> DataFrame:
        """The solutions of a query, all of whose patterns see one version."""
        return execute(self.snapshot(), parse(query) if isinstance(query, str) else query, bindings)


class Snapshot(QuadSource):
    """The quads of a fixed list of entries."""

    def __init__(self, store: QuadStore, entries: list[dict]):
        self.store, self.entries = store, entries

    def best_layout(self, **bound: str | None) -> int:
        """The layout whose leading sort columns are bound, the first of equals."""
        layouts = self.store.config.layouts

        def score(i: int) -> int:
            sort = layouts[i].sort
            return next((n for n, c in enumerate(sort) if bound.get(c) is None), len(sort))

        return max(range(len(layouts)), key=lambda i: (score(i), -i))

    def quads(self) -> DataFrame:
        return self.store.view(self.entries)

    def scan(self, s=None, p=None, o=None, contexts=()) -> DataFrame:
        contexts = list(contexts)
        one = contexts[0] if len(contexts) == 1 else None
        rows = self.store.view(self.entries, self.best_layout(s=s, p=p, o=o, c=one))
        return FrameQuads(rows, is_set=True).scan(s, p, o, contexts)


class Connection(QuadSource):
    """Reads and changes a store. Outside a transaction every change is
    committed at once; inside one, changes are entries that only this
    connection sees, until commit publishes them or rollback discards them."""

    def __init__(self, store: QuadStore):
        self.store, self.spark = store, store.spark
        self._own: list[dict] = []
        self._names: dict[str, str] | None = None
        self._based_on: int | None = None
        self._state: dict = {}
        self.is_open = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        if self._based_on is not None and kind is not None:
            self.rollback()
        self.close()

    # -------------------------------------------------------------- transactions
    def begin(self) -> None:
        self._check()
        if self._based_on is not None:
            raise TransactionError("a transaction is already open")
        self._based_on, self._state = self.store.version(), self.store.state()

    def _end(self) -> None:
        self._own, self._names, self._based_on = [], None, None

    def commit(self) -> None:
        if self._based_on is None:
            raise TransactionError("no transaction is open")
        state = {"entries": self._state["entries"] + self._own, "namespaces": self._namespaces()}
        if state != self._state:
            try:
                self.store.publish(self._based_on, state)
            except TransactionError:
                self.rollback()
                raise
            self.store.settle()
        self._end()

    def rollback(self) -> None:
        if self._based_on is None:
            raise TransactionError("no transaction is open")
        for entry in self._own:
            self.store.discard(entry)
        self._end()

    def close(self) -> None:
        """Commits what is staged, like a connection that flushes on close."""
        if self.is_open and self._based_on is not None:
            self.commit()
        self.is_open = False

    def _check(self) -> None:
        if not self.is_open:
            raise TransactionError("the connection is closed")

    def _change(self, run) -> int:
        self._check()
        own = self._based_on is None
        if own:
            self.begin()
        try:
            out = run()
        except BaseException:
            if own:
                self.rollback()
            raise
        if own:
            self.commit()
        return out

    # ---------------------------------------------------------------------- read
    def snapshot(self) -> Snapshot:
        self._check()
        return self.store.snapshot(None if self._based_on is None else self._state["entries"] + self._own)

    def quads(self) -> DataFrame:
        return self.snapshot().quads()

    def scan(self, s=None, p=None, o=None, contexts=(), include_inferred: bool = True) -> DataFrame:
        return self.snapshot().scan(s, p, o, contexts)

    get_statements = scan

    def count(self, s=None, p=None, o=None, contexts=()) -> int:
        return self.scan(s, p, o, contexts).count()

    def query(self, query: str | Query | Node, bindings: dict[str, str] | None = None, include_inferred: bool = True) -> DataFrame:
        return execute(self.snapshot(), parse(query) if isinstance(query, str) else query, bindings)

    # -------------------------------------------------------------------- change
    def add(self, s: str, p: str, o: str, contexts: Iterable[str | None] = (), inferred: bool = False) -> int:
        """Add one statement to each of the contexts, without any to the
        default graph. Gives the number of quads that were new."""
        return self.add_all([(s, p, o, c) for c in dict.fromkeys(contexts or [None])])

    def add_all(self, quads: DataFrame | Iterable[Quad]) -> int:
        """Add quads; those already there change nothing. Illegal terms raise."""

        def run() -> int:
            entry: dict = {}
            new, aside = self._given(quads)
            try:
                if bad := new.where(~F.coalesce(terms.legal_quad(), F.lit(False))).take(1):
                    raise ValueError(f"not a quad: {tuple(bad[0])}")
                entry = self.store.write(fresh(new.distinct(), self.quads()))
            finally:
                self.store.discard(aside)
            if entry["rows"]:
                self._own.append(entry)
            else:
                self.store.discard(entry)
            return entry["rows"]

        return self._change(run)

    def _given(self, quads: DataFrame | Iterable[Quad]) -> tuple[DataFrame, dict]:
        """Quads of a caller, and an entry to discard after use: a DataFrame is
        evaluated once and written aside, so that what is checked is what is stored."""
        if not isinstance(quads, DataFrame):
            return self.spark.createDataFrame(list(quads), SCHEMA), {}
        folder = self.store.keep(quads.select(*COLUMNS))
        return self.store.read(folder), {"folders": {"0": folder}}

    def remove(self, s=None, p=None, o=None, contexts: Iterable[str | None] = (), inferred: bool = False) -> int:
        """Remove the quads that match; None among the contexts is the default
        graph only. Gives the number removed."""

        def run() -> int:
            graphs = list(dict.fromkeys(contexts))
            n = self.scan(s, p, o, graphs).count()
            if n:
                pattern = {k: v for k, v in (("s", s), ("p", p), ("o", o)) if v is not None}
                self._own.append({"remove": pattern | ({"contexts": graphs} if graphs else {})})
            return n

        return self._change(run)

    def remove_all(self, quads: DataFrame | Iterable[Quad]) -> int:
        """Remove each of these quads, all in one change; those that are not
        there change nothing. Gives the number removed."""

        def run() -> int:
            old, aside = self._given(quads)
            try:
                folder = self.store.keep(present(old.distinct(), self.quads()))
            finally:
                self.store.discard(aside)
            entry, n = {"remove": {"folder": folder}}, self.store.read(folder).count()
            if n:
                self._own.append(entry)
            else:
                self.store.discard(entry)
            return n

        return self._change(run)

    def clear(self, *contexts: str | None) -> int:
        return self.remove(contexts=contexts)

    # ---------------------------------------------------------------- namespaces
    def _namespaces(self) -> dict[str, str]:
        if self._names is not None:
            return self._names
        return (self._state if self._based_on is not None else self.store.state())["namespaces"]

    def namespaces(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self._namespaces().items()), "prefix string, name string")

    def namespace(self, prefix: str) -> str | None:
        return self._namespaces().get(prefix)

    def _rename(self, names: dict[str, str]) -> int:
        def run() -> int:
            self._names = names
            return 0

        return self._change(run)

    def set_namespace(self, prefix: str, name: str) -> None:
        self._rename({**self._namespaces(), prefix: name})

    def remove_namespace(self, prefix: str) -> None:
        self._rename({k: v for k, v in self._namespaces().items() if k != prefix})

    def clear_namespaces(self) -> None:
        self._rename({})


def removed(pattern: dict) -> Column:
    """The quads a removal hides."""
    tests = [F.col(n) == pattern[n] for n in ("s", "p", "o") if n in pattern]
    graphs = context_filter(pattern.get("contexts", ()))
    if graphs is not None:
        tests.append(F.coalesce(graphs, F.lit(False)))
    return reduce(Column.__and__, tests) if tests else F.lit(True)


#: A quad's columns as join keys, null contexts equal.
_KEYS = ["s", "p", "o", "_c"]


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_c", F.coalesce("c", F.lit("")))


def without(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of quads that are not in gone."""
    return _keyed(quads).join(_keyed(gone).select(*_KEYS), _KEYS, "left_anti").select(*COLUMNS)


def present(some: DataFrame, quads: DataFrame) -> DataFrame:
    """The rows of some, a set, that are in quads."""
    return _keyed(quads).join(_keyed(some).select(*_KEYS), _KEYS, "left_semi").select(*COLUMNS)


def fresh(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of new that are not in old.

    The old side is first reduced to what new has too, so that a small batch is
    held against a large store by a scan, without shuffling the store.
    """
    return without(new, present(new, old))


def open_store(spark: SparkSession, options: StoreConfig | dict) -> QuadStore:
    return QuadStore.open(spark, options)
