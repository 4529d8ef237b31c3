"""Queries p2, p4, p6, p7, p8 and p9 and their SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import heavy, ledger, mixing, registers, repetition, tokens
from quadlake.session import scratch_path, stage
from quadlake.sources.tables import table

P2_SHARE = 0.005
P4_GROUPS = ["day", "c", "p"]


def p2_heavy(spark: SparkSession, folder: str) -> DataFrame:
    return heavy.top_items(heavy.heavy_items(table(spark, folder, "quads"), ["o", "p"]))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    quads = table(spark, folder, "quads")
    found = heavy.heavy_items(quads, ["o", "p"])
    return found.where(F.col("estimate") >= F.lit(quads.count() * P2_SHARE)).select("field", "item")


def p2_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The items of p2_heavy against their exact numbers: how many there are,
    whether none is counted too low, whether as many as the sketch's probability
    says are within their stated error, and whether no frequent one is missing."""
    quads = table(spark, folder, "quads")
    n_rows, found = quads.count(), p2_heavy(spark, folder)
    out = None
    for field in ("o", "p"):
        exact = quads.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("item")).agg(F.count(F.lit(1)).alias("n"))
        both = found.where(F.col("field") == field).join(exact, "item", "full").withColumn("found", F.col("estimate").isNotNull())
        n, wide = F.count(F.when(F.col("found"), 1)), F.count(F.when(F.col("found") & (F.col("estimate") - F.col("n") > F.col("max_error")), 1))
        least = math.exp(-heavy.DEPTH)
        rows = both.agg(
            F.lit(field).alias("field"), n.alias("n_items"), F.coalesce(F.min(F.when(F.col("found"), F.col("estimate") >= F.col("n"))), F.lit(True)).alias("none_below"),
            (wide <= least * n + 4 * F.sqrt(least * n) + 1).alias("bounds_hold"), F.coalesce(F.min(F.when(F.col("n") * heavy.CAPACITY > n_rows, F.col("found"))), F.lit(True)).alias("none_missing"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    quads = table(spark, folder, "quads")
    return quads.select(F.to_date("asserted_at").alias("day"), F.coalesce("c", F.lit("DEFAULT")).alias("c"), "p", "s")


def p4_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return registers.cube(_subjects(spark, folder), P4_GROUPS, "s")


def p4_days(spark: SparkSession, folder: str) -> DataFrame:
    return registers.neighbours(registers.sketch(_subjects(spark, folder), ["day"], "s"), "day")


def p4_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of each named graph and of the default graph: those of either, those of both."""
    return registers.joint_with(registers.sketch(_subjects(spark, folder), ["c"], "s"), "c", "DEFAULT")


def _bounds_hold(inside: Column) -> Column:
    """Whether as many of the rows are inside their 95 % bounds as can be asked
    of a sample: all but 5 %, four standard errors of that number, and one."""
    n, out = F.count(F.lit(1)), F.count(F.when(~inside, 1))
    return out <= 0.05 * n + 4 * F.sqrt(0.0475 * n) + 1


def p4_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Every estimate of p4_distinct against the exact number: for each level,
    the number of groups, whether their stated bounds hold, and whether no
    estimate is off by more than six stated errors and two items (in a set of a
    few items two may fall into one register)."""
    rows = _subjects(spark, folder).where("s is not null")
    # numbers in place of long terms: two of them are the same with a chance of 1 in 2^64 a pair
    coded = {c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in ("c", "p", "s")}
    names = F.filter(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in P4_GROUPS]), lambda x: x.isNotNull())
    exact = rows.withColumns(coded).cube(*P4_GROUPS).agg(F.count_distinct("s").alias("n"), F.array_join(names, "+").alias("level_of"))
    found = registers.cube(rows, P4_GROUPS, "s").withColumns({c: coded[c] for c in ("c", "p")})
    both = found.alias("e").join(exact.alias("x"), reduce(Column.__and__, [F.col(f"e.{c}").eqNullSafe(F.col(f"x.{c}")) for c in ["level_of", *P4_GROUPS]]), "full")
    inside = F.coalesce(F.col("n").between(F.col("low"), F.col("high")), F.lit(False))
    near = F.coalesce(F.abs(F.col("estimate") - F.col("n")) <= 6 * F.col("rel_error") * F.col("n") + 2, F.lit(False))
    return both.groupBy(F.coalesce("e.level_of", "x.level_of").alias("level_of")).agg(F.count(F.lit(1)).alias("n_groups"), _bounds_hold(inside).alias("bounds_hold"), F.min(near).alias("none_far"))


def p4_joint_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Every joint estimate of p4_days and p4_graphs against the exact sets:
    the number of pairs and whether the stated bounds hold."""
    out = None
    for of, key, found in (
        ("days", "day", p4_days(spark, folder).withColumnsRenamed({"previous": "first", "day": "second"})),
        ("graphs", "c", p4_graphs(spark, folder).withColumnRenamed("c", "first").withColumn("second", F.lit("DEFAULT"))),
    ):
        found = stage(spark, found, "pairs")  # estimated once
        subject = F.xxhash64("s").alias("s")  # a number in place of a long term, as in p4_bounds
        sets = _subjects(spark, folder).where("s is not null").select(F.col(key).alias("k"), subject).dropna().distinct()
        sizes = sets.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        pairs = found.select("first", "second").alias("p")
        # subjects meet the pairs of their own set only, then each pair's other set by subject
        met = pairs.join(sets.alias("a"), F.col("p.first") == F.col("a.k")).join(sets.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("p.second") == F.col("b.k")))
        shared = met.groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n_both"))
        exact = found.join(shared, ["first", "second"], "left").fillna(0, ["n_both"])
        for side in ("first", "second"):
            exact = exact.join(sizes.withColumnsRenamed({"k": side, "n": f"n_{side}"}), side, "left").fillna(0, [f"n_{side}"])
        exact = exact.withColumn("n_either", F.col("n_first") + F.col("n_second") - F.col("n_both"))
        exact = exact.withColumn("n_share", F.col("n_both") / F.col("n_either"))
        rows = exact.agg(
            F.lit(of).alias("pairs_of"), F.count(F.lit(1)).alias("n_pairs"),
            *[_bounds_hold(F.abs(F.col(m) - F.col(n)) <= registers.Z * F.col(f"{m}_error") + least).alias(f"{m}_holds") for m, n, least in (("union", "n_either", 0.5), ("intersection", "n_both", 0.5), ("jaccard", "n_share", 0.0))],
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _collapsed(spark: SparkSession, folder: str):
    return ledger.collapse(spark, table(spark, folder, "literals"), "literal_id", "label", "language", "loaded_at")


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    _, book = _collapsed(spark, folder)
    shown = table(spark, folder, "literals").select(F.col("literal_id").alias("first_id"), "label", "language")
    return book.rows().select("first_id", "copies").join(shown, "first_id")


def p6_reopened(spark: SparkSession, folder: str) -> DataFrame:
    """A lasting ledger, opened anew for each of three batches; two of them are
    delivered again and add nothing."""
    path = scratch_path(spark, "ledger")
    keyed = stage(spark, ledger.keyed_records(table(spark, folder, "literals"), "literal_id", "label", "language", "loaded_at"), "keyed")
    numbered = ledger.in_batches(keyed, 3)
    for k in (0, 1, 1, 2, 0):
        ledger.Ledger(spark, path).add(numbered.where(F.col("_batch") == k), f"batch {k}")
    return ledger.Ledger.open(spark, path).rows().select("first_id", "copies")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    keyed, book = _collapsed(spark, folder)
    return ledger.copies(keyed, book).select("first_id", F.col("record_id").alias("literal_id"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_documents(_texts(spark, folder))


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, put together from their ids."""
    return tokens.decode_documents(p7_ids(spark, folder))


def _mixed(spark: SparkSession, folder: str):
    return mixing.mixture(spark, table(spark, folder, "documents").select("doc_id", "text", "source"), table(spark, folder, "source_weights"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0].drop("member")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.share_report(*_mixed(spark, folder))


#: Largest distance of an actual share from the fitted one, in parts of the whole.
P8_TOLERANCE = 0.002


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """For each listed source: the share it can have (sources without documents
    left out), whether no document of it is used more often than allowed, and
    whether its actual share of the tokens meets it."""
    mixed, targets, fit = _mixed(spark, folder)
    mixed = stage(spark, mixed, "mixed")
    limits = table(spark, folder, "source_weights").select("source", "max_repeats").distinct()
    used = mixed.groupBy("source").agg(F.max("copies").alias("most"))
    rows = mixing.share_report(mixed, targets, fit).join(limits, "source").join(used, "source", "left")
    met = F.abs(F.col("actual_share") - F.col("fitted_share")) <= P8_TOLERANCE
    return rows.select("source", F.round("fitted_share", 6).alias("fitted_share"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_held"), met.alias("share_met"))


def p9_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetition(_texts(spark, folder))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The likelihood ratio of every document, and whether it is below the threshold."""
    texts = _texts(spark, folder)
    ratio = repetition.fit_ratio(texts)
    return repetition.scores(texts, ratio).withColumn("below", F.coalesce(F.col("score") <= ratio.threshold(repetition.SHARE), F.lit(False)))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repetitive(_texts(spark, folder)).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_heavy, p2_bounds, p2_found, p4_distinct, p4_days, p4_graphs, p4_bounds, p4_joint_bounds, p6_records, p6_reopened, p6_found, p7_ids, p7_texts, p8_mixture, p8_shares, p8_check, p9_repetition, p9_scores, p9_found)}

_P6_KEYED = r"""WITH cut AS (
  SELECT literal_id, label, language, replace(lower(coalesce(language, '')), '_', '-') AS lang, coalesce(label, '') AS text,
    list_filter(string_split_regex(coalesce(label, ''), '[;|\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]'),
      lambda x: regexp_matches(x, '[^\s\p{Z}\x{85}\x0b\x1c-\x1f]')) AS items
  FROM literals),
fielded AS (
  SELECT *, list_transform(items, lambda x: CASE WHEN regexp_matches(x, '[=:]') THEN
      trim(regexp_replace(lower(regexp_extract(x, '^([^=:]*)[=:]', 1)), '[^\p{L}\p{N}]+', ' ', 'g')) END) AS names,
    list_transform(items, lambda x: trim(regexp_replace(lower(regexp_extract(x, '(?s)^[^=:]*[=:](.*)$', 1)), '[^\p{L}\p{N}]+', ' ', 'g'))) AS parts
  FROM cut),
keyed AS (
  SELECT literal_id, label, language, lang, CASE WHEN len(items) >= 2 AND len(list_filter(names, lambda x: x <> '')) = len(items)
    THEN 'F ' || array_to_string(list_sort(list_distinct(list_transform(list_zip(names, parts), lambda z: z[1] || '=' || z[2]))), ';')
    ELSE 'W ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) END AS k
  FROM fielded),
firsts AS (SELECT *, min(literal_id) OVER (PARTITION BY lang, k) AS first_id, count(*) OVER (PARTITION BY lang, k) AS copies FROM keyed)
"""

#: Word positions covered by a run of eight words seen earlier in the text.
_P9_SHARE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 9),
coded AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM runs),
again AS (SELECT doc_id, i FROM coded QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY i) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 8) r(k) GROUP BY doc_id)
"""

_P4_ROWS = "WITH r AS (SELECT DISTINCT CAST(asserted_at AS DATE) AS day, coalesce(c, 'DEFAULT') AS c, p, s FROM quads WHERE s IS NOT NULL) "
_P4_LEVEL = "concat_ws('+', " + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in P4_GROUPS) + ")"

SQL = {
    "p2_bounds": " UNION ALL ".join(f"SELECT '{c}' AS field, least({heavy.CAPACITY}, count(DISTINCT {c})) AS n_items, true AS none_below, true AS bounds_hold, true AS none_missing FROM quads" for c in "op"),
    "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_bounds": _P4_ROWS
    + f"""SELECT level_of, count(*) AS n_groups, true AS bounds_hold, true AS none_far
FROM (SELECT {_P4_LEVEL} AS level_of FROM r GROUP BY CUBE(day, c, p)) GROUP BY level_of""",
    "p4_joint_bounds": _P4_ROWS
    + """SELECT 'days' AS pairs_of, count(DISTINCT day) - 1 AS n_pairs, true AS union_holds, true AS intersection_holds, true AS jaccard_holds FROM r
UNION ALL SELECT 'graphs', count(DISTINCT c) - 1, true, true, true FROM r""",
    "p2_found": """SELECT 'o' AS field, o AS item FROM quads WHERE o IS NOT NULL GROUP BY o HAVING count(*) >= 0.005 * (SELECT count(*) FROM quads)
UNION ALL SELECT 'p', p FROM quads WHERE p IS NOT NULL GROUP BY p HAVING count(*) >= 0.005 * (SELECT count(*) FROM quads)""",
    "p6_records": _P6_KEYED + "SELECT first_id, copies, label, language FROM firsts WHERE literal_id = first_id",
    "p6_reopened": _P6_KEYED + "SELECT first_id, copies FROM firsts WHERE literal_id = first_id",
    "p6_found": _P6_KEYED + "SELECT first_id, literal_id FROM firsts WHERE literal_id <> first_id",
    "p8_check": """WITH open AS (SELECT * FROM source_weights w WHERE EXISTS (SELECT 1 FROM documents d WHERE d.source = w.source AND d.text <> ''))
SELECT source, round(CASE WHEN source IN (SELECT source FROM open) THEN target_share / (SELECT sum(target_share) FROM open) ELSE 0 END, 6) AS fitted_share,
true AS cap_held, true AS share_met FROM source_weights""",
    "p9_repetition": _P9_SHARE
    + """SELECT w.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n, 0) AS n_repeated,
CASE WHEN len(ws) > 0 THEN coalesce(n, 0) / len(ws) END AS share FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id""",
    "p9_found": _P9_SHARE + "SELECT w.doc_id FROM w JOIN covered c ON w.doc_id = c.doc_id WHERE 2 * n >= len(ws)",
}
