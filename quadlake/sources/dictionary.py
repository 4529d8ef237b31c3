"""Quads held as ids with a dictionary of terms.

A bound term is looked up first and the statements are filtered by its ids, so
the condition on a number reaches their scan; a term the dictionary does not
know matches nothing. Ids become terms last, by the lifetime of the id that is
live when the statement was loaded.

Predicates and graphs are mostly shared terms: they are decoded by the small
vocabulary alone, and only rows it leaves open go on to the dictionary. Subjects
and objects meet the dictionary in one equality join each, with ids that would
fill a task spread over salts; no row is joined by a null key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlake.functions import terms
from quadlake.operators import skew
from quadlake.session import stage
from quadlake.sources.quads import COLUMNS, QuadSource

#: Reserved ids: no value, and the default graph.
NO_VALUE, DEFAULT_GRAPH = 0, 1
#: Ids a single term may have; more is an error in the dictionary.
MAX_IDS = 10_000


class DictionaryQuads(QuadSource):
    """statements: subj, pred, obj, context, loaded_at. values: id, term,
    created_at, deleted_at (one row a lifetime). vocabulary: id, term, always
    live. A statement with an id that is null, reserved or not live is no quad,
    save that a null or reserved context is the default graph. A term key that
    two live rows of an id give counts once.
    """

    def __init__(self, statements: DataFrame, values: DataFrame, vocabulary: DataFrame):
        self.statements = statements.select("subj", "pred", "obj", "context", F.col("loaded_at").alias("at"))
        always = [F.lit(None).cast("timestamp_ntz").alias(x) for x in ("born", "gone")]
        self.values = values.select("id", "term", F.col("created_at").alias("born"), F.col("deleted_at").alias("gone")).where("id > 1 and term is not null").distinct()
        self.vocabulary = vocabulary.select("id", "term", *always).where("id > 1 and term is not null").distinct()

    def ids_of(self, term: str) -> list[int]:
        """Every id that the term has or had."""
        found = self.values.select("id", "term").unionByName(self.vocabulary.select("id", "term")).where(F.col("term") == term).select("id").distinct().limit(MAX_IDS + 1).collect()
        if len(found) > MAX_IDS:
            raise ValueError(f"more than {MAX_IDS} ids for one term")
        return sorted(r.id for r in found)

    def term_of(self, id_: int) -> DataFrame:
        """term, born, gone of every lifetime of an id."""
        return self.values.unionByName(self.vocabulary).where(F.col("id") == id_).select("term", "born", "gone")

    @staticmethod
    def _live(at: Column) -> Column:
        return F.coalesce(F.col("born") <= at, F.col("born").isNull()) & (F.col("gone").isNull() | (F.col("gone") > at))

    def _entries(self) -> DataFrame:
        """id, term, born, gone of every lifetime; an id of the vocabulary has only that record."""
        return self.values.join(self.vocabulary.select("id"), "id", "left_anti").unionByName(self.vocabulary)

    def _decode(self, rows: DataFrame, column: str, to: str, hot: DataFrame) -> DataFrame:
        """Replace the ids of a column by their terms; rows whose id has none
        that is live are left out."""
        entries = skew.replicate(self._entries(), hot.withColumnRenamed(column, "id"), "id").withColumnsRenamed({"id": column, "term": to})
        found = skew.spread(rows, hot, column, F.struct("at", *[c for c in rows.columns if c not in (column, "at")])).join(entries, [column, "_salt"])
        return found.where(self._live(F.col("at"))).drop(column, "_salt", "born", "gone")

    def _shared(self, rows: DataFrame, column: str, to: str) -> DataFrame:
        """Add the terms of a column that the vocabulary knows."""
        return rows.join(self.vocabulary.select(F.col("id").alias(column), F.col("term").alias(to)), column, "left")

    def _decoded(self, rows: DataFrame) -> DataFrame:
        """subj, pred, obj, context, at to s, p, o, c."""
        # counted on the statements themselves, so that no join is done twice for it
        limit = skew.task_rows(rows, self.statements.count())
        hot = {c: skew.hot_keys(rows, c, 0, limit) for c in ("subj", "pred", "obj", "context")}
        rows = rows.dropDuplicates(["subj", "pred", "obj", "context", "at"])
        default = F.col("context").isNull() | F.col("context").isin(NO_VALUE, DEFAULT_GRAPH)
        rows = self._shared(self._shared(rows, "pred", "p"), "context", "c")
        done = F.col("p").isNotNull() & (F.col("c").isNotNull() | default)
        plain = rows.where(done).select("subj", "obj", "at", "p", "c")
        rest = self._decode(rows.where(~done).select("subj", "obj", "at", "pred", "context"), "pred", "p", hot["pred"])
        in_default = rest.where(default).select("subj", "obj", "at", "p", F.lit(None).cast("string").alias("c"))
        in_graph = self._decode(rest.where(~default), "context", "c", hot["context"]).select("subj", "obj", "at", "p", "c")
        out = plain.unionByName(in_default).unionByName(in_graph)
        return self._decode(self._decode(out, "subj", "s", hot["subj"]), "obj", "o", hot["obj"]).select(*COLUMNS)

    def scan(self, s=None, p=None, o=None, contexts=()) -> DataFrame:
        rows = self.statements
        for column, term in (("subj", s), ("pred", p), ("obj", o)):
            if term is not None:
                rows = rows.where(F.col(column).isin(self.ids_of(term)))
        wanted = list(dict.fromkeys(contexts))
        default = F.col("context").isNull() | F.col("context").isin(NO_VALUE, DEFAULT_GRAPH)
        if wanted:
            ids = [i for c in wanted if c is not None for i in self.ids_of(c)]
            graphs = F.col("context").isin(ids)
            rows = rows.where(F.coalesce(graphs, F.lit(False)) | default if None in wanted else graphs)
        rows = self._decoded(rows)
        bound = [F.col(n) == t for n, t in (("s", s), ("p", p), ("o", o)) if t is not None]
        for test in bound:  # an id may have had another term
            rows = rows.where(test)
        if wanted:
            named = [c for c in wanted if c is not None]
            rows = rows.where(F.col("c").isin(named) | (F.col("c").isNull() if None in wanted else F.lit(False)))
        return rows.select("s", "p", "o", "c").distinct()

    # ---------------------------------------------------------------------- write
    def store_values(self, wanted: DataFrame, at: datetime) -> DataFrame:
        """id and term of every term of wanted (a column term), each once; new
        says whether it was stored by this call.

        A term that is live at the time keeps its id (the smallest of several),
        all others get the ids after the largest one there is. Null terms get
        none. Ids are dealt out by every task for its own rows; the result is
        kept in the shared folder, so that they do not change.
        """
        spark = wanted.sparkSession
        asked = wanted.where("term is not null").select("term").distinct()
        held = self._entries().where(self._live(F.lit(at).cast("timestamp_ntz"))).join(asked, "term", "left_semi").groupBy("term").agg(F.min("id").alias("id"))
        known = stage(spark, asked.join(held, "term", "left").withColumn("_n", F.monotonically_increasing_id()), "terms")
        last = self.values.select("id").unionByName(self.vocabulary.select("id")).agg(F.max("id")).first()[0] or DEFAULT_GRAPH
        fresh = known.where("id is null").withColumn("_task", F.shiftright("_n", 33))
        sizes = fresh.groupBy("_task").agg((F.max("_n") - F.shiftleft("_task", 33) + 1).alias("_size"))
        starts = sizes.select("_task", (F.sum("_size").over(Window.orderBy("_task")) - F.col("_size")).alias("_start"))  # one row a task
        numbered = fresh.join(F.broadcast(starts), "_task").select((F.lit(last + 1) + F.col("_start") + F.col("_n") - F.shiftleft("_task", 33)).alias("id"), "term", F.lit(True).alias("new"))
        return known.where("id is not null").select("id", "term", F.lit(False).alias("new")).unionByName(numbered)

    def added(self, quads: DataFrame, at: datetime) -> DictionaryQuads:
        """These statements and those of quads (s, p, o, c), loaded at the time,
        with the terms that were not live then as new values.

        Rows with a null or illegal term are no quads and raise; quads that are
        there already change no result. The new rows are kept in the shared
        folder; writing them to lasting tables is the caller's.
        """
        spark = quads.sparkSession
        rows = stage(spark, quads.select(*COLUMNS).distinct(), "quads")
        if bad := rows.where(~F.coalesce(terms.legal_quad(), F.lit(False))).take(1):
            raise ValueError(f"not a quad: {tuple(bad[0])}")
        ids = stage(spark, self.store_values(rows.select(F.explode(F.array(*COLUMNS)).alias("term")).distinct(), at), "ids")
        n = rows.count()
        hot = {c: skew.hot_keys(rows, c, n) for c in COLUMNS}
        for column, to in (("s", "subj"), ("p", "pred"), ("o", "obj")):
            rows = self._coded(rows, column, to, ids, hot[column])
        of_default = rows.where("c is null").select("subj", "pred", "obj", F.lit(DEFAULT_GRAPH).cast("bigint").alias("context"))
        rows = of_default.unionByName(self._coded(rows.where("c is not null"), "c", "context", ids, hot["c"]).select("subj", "pred", "obj", "context"))
        time = F.lit(at).cast("timestamp_ntz")
        out = DictionaryQuads.__new__(DictionaryQuads)
        out.statements = self.statements.unionByName(stage(spark, rows, "statements").withColumn("at", time))
        out.values = self.values.unionByName(ids.where("new").select("id", "term", time.alias("born"), F.lit(None).cast("timestamp_ntz").alias("gone")))
        out.vocabulary = self.vocabulary
        return out

    @staticmethod
    def _coded(rows: DataFrame, column: str, to: str, ids: DataFrame, hot: DataFrame) -> DataFrame:
        """Replace the terms of a column by their ids."""
        own = skew.replicate(ids.select(F.col("term").alias(column), F.col("id").alias(to)), hot, column)
        return skew.spread(rows, hot, column, F.struct(*rows.columns)).join(own, [column, "_salt"]).drop(column, "_salt")
