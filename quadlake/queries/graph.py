"""Queries over the mapped tables and the stored quads, with their SQL.

``M`` queries run on the virtual quads of the star-schema tables and
documents; their SQL is written on the base tables, so it checks the mapping
too. ``Q`` queries run on the table quads, taken as a set of (s, p, o, c).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.functions import accessors, terms
from quadlake.functions.terms import XSD
from quadlake.plans import algebra as A
from quadlake.plans.compile import execute
from quadlake.plans.sparql import parse
from quadlake.session import scratch_path, stage
from quadlake.sources.dictionary import DictionaryQuads
from quadlake.sources.mapping import ex, sample_quads
from quadlake.sources.nquads import format_quads, parse_lines
from quadlake.sources.quads import FrameQuads
from quadlake.sources.tables import table
from quadlake.sources.turtle import read_turtle, write_trig
from quadlake.store import QuadStore
from quadlake.streaming.ingest import late_rows, newest_rates, predicate_rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

V = "http://quads.example/v/"
G = "http://quads.example/g/"
PREFIXES = f"PREFIX ex: <http://ex.org/> PREFIX g: <http://ex.org/g/> PREFIX v: <{V}> PREFIX qg: <{G}> PREFIX xsd: <{XSD}> "


def stored(spark: SparkSession, folder: str) -> FrameQuads:
    return FrameQuads(table(spark, folder, "quads"))


# ------------------------------------------------------------- terms in SQL
def i(kind: str, *columns: str) -> str:
    return f"'<http://ex.org/{kind}/' || " + " || '-' || ".join(columns) + " || '>'"


def plain(x: str) -> str:
    return f"""'"' || {x} || '"'"""


def typed(x: str, kind: str) -> str:
    return f"""'"' || {x} || '"^^<{XSD}{kind}>'"""


def dec(x: str) -> str:
    return typed(f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)", "decimal")


def whole(x: str) -> str:
    return typed(f"CAST({x} AS VARCHAR)", "integer")


def moment(x: str) -> str:
    return typed(f"(CASE WHEN epoch_us({x}) % 1000000 = 0 THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END)", "dateTime")


def p(name: str) -> str:
    return f"'{ex(name)}'"


GEO, CATALOG, SALES, TEXT = (f"'{ex(f'g/{g}')}'" for g in ("geo", "catalog", "sales", "text"))
NONE = "CAST(NULL AS VARCHAR)"


def legs(of: str, subject: str, graph: str, /, **objects: str) -> str:
    return " UNION ALL ".join(f"SELECT {subject} AS s, {p(k)} AS p, {o} AS o, {graph} AS c FROM {of} WHERE {o} IS NOT NULL" for k, o in objects.items())


_GEO = legs("region", i("region", "r_regionkey"), GEO, name=plain("r_name")) + " UNION ALL " + legs("nation", i("nation", "n_nationkey"), GEO, name=plain("n_name"), region=i("region", "n_regionkey"))
_CUSTOMER = legs("customer", i("customer", "c_custkey"), NONE, name=plain("c_name"), nation=i("nation", "c_nationkey"), acctbal=dec("c_acctbal"), segment=typed("c_mktsegment", "string"))
_SUPPLIER = legs("supplier", i("supplier", "s_suppkey"), CATALOG, name=plain("s_name"), nation=i("nation", "s_nationkey"), acctbal=dec("s_acctbal"))
_PART = legs("part", i("part", "p_partkey"), CATALOG, name=plain("p_name"), brand=plain("p_brand"), type=plain("p_type"), size=whole("p_size"), price=dec("p_retailprice"))
_VEC = legs("embeddings", i("vec", "vec_id"), CATALOG, label=whole("label"))
#: The quads of the geo and catalog graphs and of the default graph.
_SMALL = f"WITH q AS ({_GEO} UNION ALL {_CUSTOMER} UNION ALL {_SUPPLIER} UNION ALL {_PART} UNION ALL {_VEC}) "
_ORDERS = legs("orders", i("order", "o_orderkey"), SALES, customer=i("customer", "o_custkey"), status=plain("o_orderstatus"), priority=plain("o_orderpriority"), total=dec("o_totalprice"), date=moment("o_orderdate"))
_LINE = legs("lineitem", i("line", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), SALES, order=i("order", "l_orderkey"), part=i("part", "l_partkey"), supplier=i("supplier", "l_suppkey"), quantity=dec("l_quantity"),
             price=dec("l_extendedprice"), discount=dec("l_discount"), tax=dec("l_tax"), returnflag=plain("l_returnflag"), shipdate=moment("l_shipdate"))
_EVENTS = legs("events", i("event", "event_id"), "'_:events'", user=i("user", "user_id"), kind=plain("event_type"), value=dec("value"), at=moment("ts"), props=plain("props"))
_DOCS = legs("documents", i("doc", "doc_id"), TEXT, text="""'"' || text || CASE WHEN length(lang) > 0 THEN '"@' || lang ELSE '"' END""", source=plain("source"), chars=whole("n_chars"), repo=plain("repo"), path=plain("path"), licence=plain("licence_file"))
#: The quads of all branches.
_EVERY = _SMALL.removesuffix(") ") + f" UNION ALL {_ORDERS} UNION ALL SELECT DISTINCT * FROM ({_LINE}) UNION ALL {_EVENTS} UNION ALL {_DOCS}) "


# ---------------------------------------------------------- pattern look-ups
def _scan(name: str, sql: str, contexts: tuple[str | None, ...] = (), **bound: str) -> None:
    QUERIES[name] = lambda spark, folder: sample_quads(spark, folder).scan(bound.get("s"), bound.get("p"), bound.get("o"), contexts)
    SQL[name] = sql


_NATION7, _ASIA = ex("nation/7"), '"ASIA"'
_scan("pattern_s", f"SELECT * FROM ({_CUSTOMER}) WHERE s = '{ex('customer/5')}'", s=ex("customer/5"))
_scan("pattern_p", _SMALL + f"SELECT * FROM q WHERE p = {p('nation')}", p=ex("nation"))
_scan("pattern_o", _SMALL + f"SELECT * FROM q WHERE o = '{_NATION7}'", o=_NATION7)
_scan("pattern_c", _GEO, (ex("g/geo"),))
_scan("pattern_sp", f"SELECT * FROM ({_CUSTOMER}) WHERE s = '{ex('customer/5')}' AND p = {p('acctbal')}", s=ex("customer/5"), p=ex("acctbal"))
_scan("pattern_so", _SMALL + f"SELECT * FROM q WHERE s = '{ex('region/2')}' AND o = '{_ASIA}'", s=ex("region/2"), o=_ASIA)
_scan("pattern_sc", f"SELECT * FROM ({_GEO}) WHERE s = '{_NATION7}'", (ex("g/geo"),), s=_NATION7)
_scan("pattern_po", _SMALL + f"SELECT * FROM q WHERE p = {p('nation')} AND o = '{_NATION7}'", p=ex("nation"), o=_NATION7)
_scan("pattern_pc", f"SELECT * FROM ({_GEO}) WHERE p = {p('name')}", (ex("g/geo"),), p=ex("name"))
_scan("pattern_oc", f"SELECT * FROM ({_SUPPLIER}) WHERE o = '{_NATION7}'", (ex("g/catalog"),), o=_NATION7)
_scan("pattern_spo", _SMALL + f"SELECT * FROM q WHERE s = '{ex('region/2')}' AND p = {p('name')} AND o = '{_ASIA}'", s=ex("region/2"), p=ex("name"), o=_ASIA)
_scan("pattern_spc", f"SELECT * FROM ({_GEO}) WHERE s = '{_NATION7}' AND p = {p('region')}", (ex("g/geo"),), s=_NATION7, p=ex("region"))
_scan("pattern_soc", f"SELECT * FROM ({_GEO}) WHERE s = '{ex('region/2')}' AND o = '{_ASIA}'", (ex("g/geo"),), s=ex("region/2"), o=_ASIA)
_scan("pattern_poc", f"SELECT * FROM ({_SUPPLIER}) WHERE p = {p('nation')} AND o = '{_NATION7}'", (ex("g/catalog"),), p=ex("nation"), o=_NATION7)
_scan("pattern_spoc", f"SELECT * FROM ({_GEO}) WHERE s = '{ex('region/2')}' AND p = {p('name')} AND o = '{_ASIA}'", (ex("g/geo"),), s=ex("region/2"), p=ex("name"), o=_ASIA)
_scan("scan_three_graphs", _SMALL + "SELECT * FROM q", (ex("g/geo"), None, ex("g/catalog")))
_scan("pattern_none", _EVERY + "SELECT * FROM q WHERE s IS NOT NULL")
_scan("pattern_unknown_value", f"SELECT * FROM ({_GEO}) WHERE false", s=ex("nobody/1"), p=ex("name"))
_scan("scan_default_graph", _CUSTOMER, (None,))
_scan("scan_multi_context", f"{_GEO} UNION ALL {_SUPPLIER} UNION ALL {_PART} UNION ALL {_VEC}", (ex("g/geo"), ex("g/catalog"), ex("g/geo"), ex("g/unknown")))
_scan("scan_context_or_default", f"{_GEO} UNION ALL {_CUSTOMER}", (ex("g/geo"), None))

_SET = "WITH q AS (SELECT DISTINCT s, p, o, c FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL) "


def _stored_scan(name: str, where: str, contexts: tuple[str | None, ...] = (), **bound: str) -> None:
    QUERIES[name] = lambda spark, folder: stored(spark, folder).scan(bound.get("s"), bound.get("p"), bound.get("o"), contexts)
    SQL[name] = _SET + "SELECT * FROM q WHERE " + where


_ALL, _STATUS = "<http://quads.example/set/everything>", f"<{V}status>"
_stored_scan("stored_s", f"s = '{_ALL}'", s=_ALL)
_stored_scan("stored_p", f"p = '{_STATUS}'", p=_STATUS)
_stored_scan("stored_o", """o = '"active"'""", o='"active"')
_stored_scan("stored_c", f"c = '<{G}registry>'", (f"<{G}registry>",))
_stored_scan("stored_po_default", f"""p = '{_STATUS}' AND o = '"active"' AND c IS NULL""", (None,), p=_STATUS, o='"active"')
_stored_scan("stored_sc_multi", f"s = '{_ALL}' AND (c = '_:load' OR c IS NULL)", ("_:load", None, "_:load"), s=_ALL)

_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"


def _query(name: str, source: Callable, text: str, sql: str, bindings: dict[str, str] | None = None) -> None:
    QUERIES[name] = lambda spark, folder: execute(source(spark, folder), parse(PREFIXES + text), bindings)
    SQL[name] = sql


M, Q = sample_quads, stored

# ------------------------------------------------------------ contexts and sizes
QUERIES["contexts_list"] = lambda spark, folder: sample_quads(spark, folder).contexts()
SQL["contexts_list"] = f"SELECT unnest([{GEO}, {CATALOG}, {SALES}, {TEXT}, '_:events']) AS c"
QUERIES["stored_contexts"] = lambda spark, folder: stored(spark, folder).contexts()
SQL["stored_contexts"] = "SELECT DISTINCT c FROM quads WHERE c IS NOT NULL"
QUERIES["size_all"] = lambda spark, folder: stored(spark, folder).size()
SQL["size_all"] = _SET + "SELECT count(*) AS n FROM q"
QUERIES["size_pattern"] = lambda spark, folder: sample_quads(spark, folder).size(p=ex("nation"))
SQL["size_pattern"] = "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n"
QUERIES["size_by_context"] = lambda spark, folder: stored(spark, folder).scan().groupBy("c").agg(F.count(F.lit(1)).alias("n"))
SQL["size_by_context"] = _SET + "SELECT c, count(*) AS n FROM q GROUP BY c"

# ------------------------------------------------------------------------- joins
_query("bgp_star_customer", M, "SELECT ?c ?name ?n ?b ?seg WHERE { ?c ex:name ?name ; ex:nation ?n ; ex:acctbal ?b ; ex:segment ?seg }",
       f"SELECT {i('customer', 'c_custkey')} AS c, {plain('c_name')} AS name, {i('nation', 'c_nationkey')} AS n, {dec('c_acctbal')} AS b, {typed('c_mktsegment', 'string')} AS seg FROM customer")
_query("bgp_chain_order_region", M, "SELECT ?r (COUNT(*) AS ?k) WHERE { ?o ex:customer ?c . ?c ex:nation ?n . ?n ex:region ?r } GROUP BY ?r",
       f"SELECT {i('region', 'n_regionkey')} AS r, {whole('count(*)')} AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
_query("bgp_triangle", M, """SELECT ?n (COUNT(*) AS ?k) WHERE {
         ?l ex:order ?o ; ex:supplier ?s . ?o ex:customer ?c . ?c ex:nation ?n . ?s ex:nation ?n } GROUP BY ?n""",
       f"""SELECT {i('nation', 'c_nationkey')} AS n, {whole('count(*)')} AS k FROM {_LINES} JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey GROUP BY c_nationkey""")
_query("bgp_graph_var", M, "SELECT ?g (COUNT(*) AS ?k) WHERE { GRAPH ?g { ?s ex:name ?x } } GROUP BY ?g",
       f"SELECT c AS g, {whole('count(*)')} AS k FROM ({_GEO} UNION ALL {_SUPPLIER} UNION ALL {_PART}) WHERE p = {p('name')} GROUP BY c")
_query("stored_bgp_reading_status", Q, "SELECT ?t (COUNT(*) AS ?k) WHERE { ?r v:of ?i . ?i v:status ?t . ?i v:active ?a } GROUP BY ?t",
       _SET + f"SELECT b.o AS t, {whole('count(*)')} AS k FROM q a JOIN q b ON a.o = b.s JOIN q d ON d.s = b.s WHERE a.p = '<{V}of>' AND b.p = '<{V}status>' AND d.p = '<{V}active>' GROUP BY b.o")
_query("stored_graph_join", Q, "SELECT ?g ?s ?a ?b WHERE { GRAPH ?g { ?s v:status ?a . ?s v:height ?b } }",
       _SET + f"SELECT a.c AS g, a.s AS s, a.o AS a, b.o AS b FROM q a JOIN q b ON a.s = b.s AND a.c = b.c WHERE a.p = '<{V}status>' AND b.p = '<{V}height>'")


def _linked(spark: SparkSession, folder: str) -> FrameQuads:
    """The stored quads, and a link v:near from every subject with a status to
    itself and from every part to what it is part of."""
    rows = stored(spark, folder).scan()
    near = F.lit(f"<{V}near>")
    own = rows.where(F.col("p") == _STATUS).select("s", near.alias("p"), F.col("s").alias("o"), "c")
    whole = rows.where(F.col("p") == f"<{V}part_of>").select("s", near.alias("p"), "o", "c")
    return FrameQuads(rows.unionByName(own).unionByName(whole))


_query("pattern_repeated_var", _linked, "SELECT ?x ?p WHERE { ?x ?p ?x }",
       _SET + f"SELECT s AS x, '<{V}near>' AS p FROM (SELECT DISTINCT s, c FROM q WHERE p = '{_STATUS}' UNION SELECT s, c FROM q WHERE p = '<{V}part_of>' AND s = o) UNION ALL SELECT s, p FROM q WHERE s = o")
_query("cross_product_small", M, "SELECT ?a ?b WHERE { GRAPH g:geo { ?a ex:region ?x } GRAPH g:geo { ?y ex:region ?b } }",
       f"SELECT {i('nation', 'a.n_nationkey')} AS a, {i('region', 'b.n_regionkey')} AS b FROM nation a, nation b")
_query("optional_licence", M, "SELECT ?d ?l WHERE { ?d ex:chars ?n OPTIONAL { ?d ex:licence ?l } }",
       f"SELECT {i('doc', 'doc_id')} AS d, {plain('licence_file')} AS l FROM documents WHERE n_chars IS NOT NULL")
#: The numeric datatypes, and a valid numeric label as a double.
_NUMERIC = "(decimal|double|float|integer|nonPositiveInteger|negativeInteger|long|int|short|byte|nonNegativeInteger|unsignedLong|unsignedInt|unsignedShort|unsignedByte|positiveInteger)"
_BARE = """trim(regexp_extract(o, '^"((?s:.*))"', 1), chr(13) || chr(10) || chr(9) || ' ')"""
_AS_DOUBLE = f"""CASE WHEN regexp_full_match({_BARE}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN')
  AND (regexp_matches(o, '(double|float)>$') OR regexp_full_match({_BARE}, '[0-9.+-]+')) THEN TRY_CAST(replace({_BARE}, 'INF', 'Infinity') AS DOUBLE) END"""
_query("optional_filter_inside", Q, "SELECT ?s ?h WHERE { ?s v:status ?t OPTIONAL { ?s v:height ?h FILTER(?h > 500) } }",
       _SET + f""", h AS (SELECT s, o FROM q WHERE p = '<{V}height>' AND regexp_matches(o, '"\\^\\^<{XSD}{_NUMERIC}>$') AND {_AS_DOUBLE} > 500 AND NOT isnan({_AS_DOUBLE}))
         SELECT a.s AS s, h.o AS h FROM q a LEFT JOIN h ON a.s = h.s WHERE a.p = '{_STATUS}'""")
_query("optional_chained_maybe_unbound", Q, """SELECT ?s ?t ?h WHERE { { ?s v:status ?t OPTIONAL { ?s v:part_of ?h } } { ?s v:active ?a OPTIONAL { GRAPH qg:registry { ?s v:part_of ?h } } } }""",
       _SET + f""", a AS (SELECT x.s, x.o AS t, y.o AS h FROM q x LEFT JOIN q y ON x.s = y.s AND y.p = '<{V}part_of>' WHERE x.p = '{_STATUS}'),
         b AS (SELECT x.s, y.o AS h FROM q x LEFT JOIN q y ON x.s = y.s AND y.p = '<{V}part_of>' AND y.c = '<{G}registry>' WHERE x.p = '<{V}active>')
         SELECT a.s AS s, t, coalesce(a.h, b.h) AS h FROM a JOIN b ON a.s = b.s AND (a.h = b.h OR a.h IS NULL OR b.h IS NULL)""")
_query("exists_semi", M, "SELECT ?c WHERE { ?c ex:segment ?s FILTER EXISTS { ?o ex:customer ?c . ?o ex:status \"F\" } }",
       f"SELECT {i('customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
#: Customers without an urgent finished order.
_CALM = f"SELECT {i('customer', 'c_custkey')} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"
_URGENT = '?o ex:customer ?c . ?o ex:status "F" . ?o ex:priority "1-URGENT"'
_query("not_bound_anti", M, f"SELECT ?c WHERE {{ ?c ex:segment ?s OPTIONAL {{ {_URGENT} }} FILTER(!BOUND(?o)) }}", _CALM)
_query("not_exists_anti", M, f"SELECT ?c WHERE {{ ?c ex:segment ?s FILTER NOT EXISTS {{ {_URGENT} }} }}", _CALM)
_query("string_functions", M, """SELECT ?d (SUBSTR(?p, 2, 5) AS ?part) (STRBEFORE(?p, "/") AS ?top) (STRAFTER(?p, "/") AS ?rest) (CONCAT(UCASE(?r), ":", ?p) AS ?full) (REPLACE(?p, "[0-9]+", "#") AS ?plain)
         (STRLANG(?r, "en") AS ?tagged) (STRDT(?r, ex:repo) AS ?kind) WHERE { ?d ex:path ?p ; ex:repo ?r }""",
       f"""SELECT {i('doc', 'doc_id')} AS d, {plain('substr(path, 2, 5)')} AS part, {plain("CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END")} AS top,
         {plain("CASE WHEN contains(path, '/') THEN substr(path, instr(path, '/') + 1) ELSE '' END")} AS rest, {plain("upper(repo) || ':' || path")} AS full, {plain("regexp_replace(path, '[0-9]+', '#', 'g')")} AS plain,
         '"' || repo || '"@en' AS tagged, '"' || repo || '"^^<http://ex.org/repo>' AS kind FROM documents WHERE path IS NOT NULL AND repo IS NOT NULL""")
_query("number_functions", M, "SELECT ?p (ABS(?z - 25) AS ?a) (CEIL(?c) AS ?up) (FLOOR(?c) AS ?down) (ROUND(?c) AS ?near) WHERE { ?p ex:size ?z ; ex:price ?c }",
       f"SELECT {i('part', 'p_partkey')} AS p, {whole('abs(p_size - 25)')} AS a, {typed('CAST(ceil(CAST(p_retailprice AS DECIMAL(18,2))) AS BIGINT)', 'decimal')} AS up, {typed('CAST(floor(CAST(p_retailprice AS DECIMAL(18,2))) AS BIGINT)', 'decimal')} AS down, "
       f"{typed('CAST(floor(CAST(p_retailprice AS DECIMAL(18,2)) + 0.5) AS BIGINT)', 'decimal')} AS near FROM part")
_query("moment_functions", M, "SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o ex:date ?d } GROUP BY (YEAR(?d) AS ?y) (MONTH(?d) AS ?m)",
       f"SELECT {whole('year(o_orderdate)')} AS y, {whole('month(o_orderdate)')} AS m, {whole('count(*)')} AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)")
_query("values_join", M, 'SELECT ?p ?b ?w WHERE { ?p ex:brand ?b VALUES (?b ?w) { ("Brand#1" ex:low) ("Brand#2" UNDEF) ("Brand#none" ex:no) } }',
       f"SELECT {i('part', 'p_partkey')} AS p, {plain('p_brand')} AS b, CASE WHEN p_brand = 'Brand#1' THEN '{ex('low')}' END AS w FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
_query("bind_extend", M, "SELECT ?p ?d ?big WHERE { ?p ex:size ?z BIND(?z * 2 AS ?d) BIND(?d > 50 AS ?big) FILTER(?d > 20) }",
       f"SELECT {i('part', 'p_partkey')} AS p, {whole('p_size * 2')} AS d, {typed('CAST(p_size * 2 > 50 AS VARCHAR)', 'boolean')} AS big FROM part WHERE p_size * 2 > 20")
_query("dataset_from_named", Q, f"SELECT ?g ?s ?o FROM NAMED <{G}registry> FROM NAMED <{G}unknown> WHERE {{ GRAPH ?g {{ ?s v:status ?o }} }}",
       _SET + f"SELECT c AS g, s, o FROM q WHERE p = '{_STATUS}' AND c = '<{G}registry>'")
_query("dataset_from", Q, f"SELECT ?s ?o FROM <{G}registry> FROM <{G}catalogue> WHERE {{ ?s v:status ?o }}",
       _SET + f"SELECT s, o FROM q WHERE p = '{_STATUS}' AND c IN ('<{G}registry>', '<{G}catalogue>')")

# -------------------------------------------------------- sets, order and slices
_query("union_patterns", M, "SELECT ?x ?a ?b WHERE { { ?x ex:brand ?a } UNION { ?x ex:region ?b } }",
       f"SELECT {i('part', 'p_partkey')} AS x, {plain('p_brand')} AS a, {NONE} AS b FROM part UNION ALL SELECT {i('nation', 'n_nationkey')}, NULL, {i('region', 'n_regionkey')} FROM nation")
_query("minus_patterns", M, "SELECT ?c ?n WHERE { ?c ex:segment ?x . ?c ex:nation ?n MINUS { ?n ex:region <http://ex.org/region/2> } MINUS { ?p ex:brand ?b } }",
       f"SELECT {i('customer', 'c_custkey')} AS c, {i('nation', 'c_nationkey')} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
_query("minus_shared", M, f"SELECT ?c ?b WHERE {{ ?c ex:segment ?x . ?c ex:acctbal ?b MINUS {{ {_URGENT} }} MINUS {{ ?c ex:acctbal ?b FILTER(?b > 9000) }} }}",
       f"SELECT {i('customer', 'c_custkey')} AS c, {dec('c_acctbal')} AS b FROM customer WHERE c_acctbal <= 9000 AND {i('customer', 'c_custkey')} IN ({_CALM})")
QUERIES["intersect_patterns"] = lambda spark, folder: execute(M(spark, folder), A.Intersect(
    A.Project(A.BGP((A.Pattern(A.Var("c"), ex("nation"), A.Var("n")), A.Pattern(A.Var("c"), ex("segment"), A.Var("x")))), ("n",)),
    A.Project(A.BGP((A.Pattern(A.Var("s"), ex("nation"), A.Var("n"), ex("g/catalog")),)), ("n",))))
SQL["intersect_patterns"] = f"SELECT {i('nation', 'c_nationkey')} AS n FROM customer INTERSECT SELECT {i('nation', 's_nationkey')} FROM supplier"
_query("distinct_values", Q, "SELECT DISTINCT ?o WHERE { ?s v:status ?o }", _SET + f"SELECT DISTINCT o FROM q WHERE p = '{_STATUS}'")
_query("reduced_values", M, "SELECT REDUCED ?b WHERE { ?p ex:brand ?b }", f"SELECT DISTINCT {plain('p_brand')} AS b FROM part")
_query("orderby_limit_offset", M, "SELECT ?o ?t WHERE { ?o ex:total ?t } ORDER BY DESC(?t) ?o LIMIT 25 OFFSET 10",
       f"SELECT {i('order', 'o_orderkey')} AS o, {dec('o_totalprice')} AS t FROM orders ORDER BY CAST(o_totalprice AS DECIMAL(18,2)) DESC, {i('order', 'o_orderkey')} LIMIT 25 OFFSET 10")
_query("orderby_mixed_terms", M, """SELECT ?x WHERE { { ?s ex:size ?x } UNION { ?s ex:region ?x } UNION { ?s ex:region ?y OPTIONAL { ?s ex:brand ?x } } UNION { ?s ex:brand ?x } } ORDER BY ?x LIMIT 300""",
       f"""SELECT x FROM (SELECT {whole('p_size')} AS x, 3 AS r, 0 AS k, p_size AS v, '' AS t FROM part UNION ALL SELECT {i('region', 'n_regionkey')}, 2, 2, NULL, {i('region', 'n_regionkey')} FROM nation
         UNION ALL SELECT NULL, 0, 2, NULL, '' FROM nation UNION ALL SELECT {plain('p_brand')}, 3, 2, NULL, p_brand FROM part) ORDER BY r, k, v NULLS FIRST, t, x LIMIT 300""")
_MIXED, _MIXED_ROWS = "SELECT ?x WHERE { { ?s ex:size ?x } UNION { ?s ex:region ?x } UNION { ?s ex:region ?y OPTIONAL { ?s ex:brand ?x } } UNION { ?s ex:brand ?x } } ORDER BY ?x", (
    f"""SELECT {whole('p_size')} AS x, 3 AS r, 0 AS k, p_size AS v, '' AS t FROM part UNION ALL SELECT {i('region', 'n_regionkey')}, 2, 2, NULL, {i('region', 'n_regionkey')} FROM nation
         UNION ALL SELECT NULL, 0, 2, NULL, '' FROM nation UNION ALL SELECT {plain('p_brand')}, 3, 2, NULL, p_brand FROM part""")


def _numbered(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows of an ordered DataFrame with their position from 1; each task numbers its own rows."""
    rows = stage(spark, df.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_task", F.shiftright("_id", 33))
    before = F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")
    starts = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("_n")).select("_task", before.alias("_before"))
    here = F.col("_id") - F.shiftleft("_task", 33)
    return rows.join(starts, "_task").select(*df.columns, (F.col("_before") + here + 1).alias("position"))


#: All rows of orderby_mixed_terms with their positions.
QUERIES["orderby_mixed_all"] = lambda spark, folder: _numbered(spark, execute(M(spark, folder), parse(PREFIXES + _MIXED)))
SQL["orderby_mixed_all"] = f"SELECT x, row_number() OVER (ORDER BY r, k, v NULLS FIRST, t, x) AS position FROM ({_MIXED_ROWS})"

# ------------------------------------------------------------------------ filters
_query("filter_numeric", M, "SELECT ?c ?b WHERE { ?c ex:acctbal ?b . ?c ex:segment ?s FILTER(?b > 5000 && ?b <= 7500.5) }",
       f"SELECT {i('customer', 'c_custkey')} AS c, {dec('c_acctbal')} AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 7500.5")
_query("filter_datetime", M, 'SELECT ?o ?d WHERE { ?o ex:date ?d FILTER(?d >= "1997-01-01T00:00:00Z"^^xsd:dateTime && ?d < "1998-01-01T02:00:00+02:00"^^xsd:dateTime) }',
       f"SELECT {i('order', 'o_orderkey')} AS o, {moment('o_orderdate')} AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
_query("filter_regex", M, 'SELECT ?d ?p WHERE { ?d ex:path ?p FILTER(REGEX(?p, "\\\\.(PY|js)$", "i")) }',
       f"SELECT {i('doc', 'doc_id')} AS d, {plain('path')} AS p FROM documents WHERE regexp_matches(path, '\\.(py|js)$', 'i')")
_query("filter_lang", M, 'SELECT ?d (STRLEN(?t) AS ?n) WHERE { ?d ex:text ?t FILTER(LANGMATCHES(LANG(?t), "PYTHON")) }',
       f"SELECT {i('doc', 'doc_id')} AS d, {whole('length(text)')} AS n FROM documents WHERE lower(lang) = 'python' AND text IS NOT NULL")
_query("filter_sameterm", Q, 'SELECT ?s WHERE { ?s v:status ?o FILTER(SAMETERM(?o, "Active")) }', _SET + f"""SELECT s FROM q WHERE p = '{_STATUS}' AND o = '"Active"'""")
_query("filter_bound", M, "SELECT ?d WHERE { ?d ex:chars ?n OPTIONAL { ?d ex:repo ?r } FILTER(BOUND(?r)) }",
       f"SELECT {i('doc', 'doc_id')} AS d FROM documents WHERE n_chars IS NOT NULL AND repo IS NOT NULL")
_query("filter_logic_error", Q, "SELECT ?s ?o WHERE { ?s v:count ?o FILTER(?o > 4000 || ISIRI(?s) && ?o < 5) }",
       _SET + f""", n AS (SELECT s, o, CASE WHEN regexp_matches(o, '"\\^\\^<{XSD}{_NUMERIC}>$') THEN {_AS_DOUBLE} END AS v FROM q WHERE p = '<{V}count>')
         SELECT s, o FROM n WHERE v > 4000 OR (starts_with(s, '<') AND v < 5)""")
_query("filter_sparql_in", M, 'SELECT ?p ?b WHERE { ?p ex:brand ?b FILTER(?b IN ("Brand#1", "Brand#2")) }',
       f"SELECT {i('part', 'p_partkey')} AS p, {plain('p_brand')} AS b FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
_query("theta_join", M, "SELECT ?a ?b WHERE { ?a ex:segment ?g ; ex:nation ?n ; ex:acctbal ?x . GRAPH g:catalog { ?b ex:nation ?n ; ex:acctbal ?y } FILTER(?x < ?y) }",
       f"SELECT {i('customer', 'c_custkey')} AS a, {i('supplier', 's_suppkey')} AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND CAST(c_acctbal AS DECIMAL(18,2)) < CAST(s_acctbal AS DECIMAL(18,2))")
#: A decimal without closing zeros.
_SHORT = "regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) - 0.5 AS VARCHAR), '[.]?0+$', '')"
_query("arithmetic", M, "SELECT ?p (?z * 2 + 1 AS ?d) (?c - 0.5 AS ?e) WHERE { ?p ex:size ?z . ?p ex:price ?c . ?p ex:brand ?b }",
       f"SELECT {i('part', 'p_partkey')} AS p, {whole('p_size * 2 + 1')} AS d, {typed(_SHORT, 'decimal')} AS e FROM part")
_query("casts", M, "SELECT ?p (xsd:string(?z) AS ?t) (xsd:double(?z) AS ?f) WHERE { ?p ex:size ?z }",
       f"SELECT {i('part', 'p_partkey')} AS p, {typed('p_size', 'string')} AS t, {typed('CAST(CAST(p_size AS DOUBLE) AS VARCHAR)', 'double')} AS f FROM part")
_query("bindings_substitution", M, "SELECT ?s ?n WHERE { ?s ex:nation ?n }",
       f"SELECT s, o AS n FROM ({_CUSTOMER} UNION ALL {_SUPPLIER}) WHERE p = {p('nation')} AND o = '{_NATION7}'", {"n": _NATION7})

# ---------------------------------------------------------- terms and accessors
_LEX = """regexp_extract(o, '^"((?s:.*))"', 1)"""
_SUFFIX = """CASE WHEN starts_with(o, '"') THEN regexp_extract(o, '"([^"]*)$', 1) END"""


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder).scan().select("o").distinct()


_OBJECTS = "WITH t AS (SELECT DISTINCT o FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL) "
QUERIES["term_kinds"] = lambda spark, folder: stored(spark, folder).scan().groupBy(terms.kind(F.col("o")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
SQL["term_kinds"] = _SET + f"""SELECT CASE WHEN starts_with(o, '<') THEN 'uri' WHEN starts_with(o, '_:') THEN 'bnode'
  WHEN length({_LEX}) >= 256 THEN 'long_literal' ELSE 'literal' END AS kind, count(*) AS n FROM q GROUP BY 1"""
QUERIES["term_parts"] = lambda spark, folder: _terms(spark, folder).select(
    "o", terms.string_value(F.col("o")).alias("value"), terms.language(F.col("o")).alias("lang"), terms.datatype(F.col("o")).alias("datatype"))
SQL["term_parts"] = _OBJECTS + f"""SELECT o, CASE WHEN starts_with(o, '<') THEN o[2:-2] WHEN starts_with(o, '_:') THEN o[3:] ELSE {_LEX} END AS value,
  CASE WHEN starts_with({_SUFFIX}, '@') THEN ({_SUFFIX})[2:] WHEN starts_with(o, '"') THEN '' END AS lang,
  CASE WHEN starts_with({_SUFFIX}, '^^<') THEN ({_SUFFIX})[3:] WHEN {_SUFFIX} = '' THEN '<{XSD}string>' END AS datatype FROM t"""


def _iris(spark: SparkSession, folder: str) -> DataFrame:
    """IRIs with each of the three separators: subjects, datatypes, and names made of blank nodes."""
    rows = stored(spark, folder).scan()
    named = rows.where(terms.is_bnode(F.col("s"))).select(terms.make_uri(F.lit("urn:node:"), terms.string_value(F.col("s"))).alias("s"))
    every = rows.where(terms.is_uri(F.col("s"))).select("s").unionByName(rows.select(terms.datatype(F.col("o")).alias("s")).dropna()).unionByName(named)
    return every.distinct().select("s", terms.namespace(F.col("s")).alias("ns"), terms.local_name(F.col("s")).alias("local"))


QUERIES["uri_split"] = _iris
SQL["uri_split"] = _SET + f"""SELECT s, regexp_extract(s, e, 1) AS ns, regexp_extract(s, e, 2) AS local FROM (
  SELECT DISTINCT s, CASE WHEN contains(s, '#') THEN '^<(.*#)([^#]*)>$' WHEN contains(s, '/') THEN '^<(.*/)([^/]*)>$' ELSE '^<(.*:)([^:]*)>$' END AS e FROM (
    SELECT s FROM q WHERE starts_with(s, '<') UNION ALL SELECT '<urn:node:' || s[3:] || '>' FROM q WHERE starts_with(s, '_:')
    UNION ALL SELECT CASE WHEN starts_with({_SUFFIX}, '^^<') THEN ({_SUFFIX})[3:] ELSE '<{XSD}string>' END FROM q WHERE starts_with({_SUFFIX}, '^^<') OR {_SUFFIX} = ''))"""
QUERIES["long_literal"] = lambda spark, folder: sample_quads(spark, folder).scan(p=ex("text")).where(terms.kind(F.col("o")) == "long_literal").select("s", F.length(terms.lex(F.col("o"))).cast("bigint").alias("n"))
SQL["long_literal"] = f"SELECT {i('doc', 'doc_id')} AS s, length(text) AS n FROM documents WHERE length(text) >= 256"


def _accessors(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o")
    named = {n: accessors.as_type(o, n) for n in ("byte", "short", "int", "long", "decimal", "double", "boolean", "date", "dateTime")}
    return _terms(spark, folder).where(terms.is_literal(o)).select("o", *[c.alias(f"as_{n}") for n, c in named.items()])


QUERIES["typed_accessors"] = _accessors
_INT = "CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN TRY_CAST(x AS {}) END"
_ZONE = "regexp_extract(x, '([+-][0-9]{2}:[0-9]{2})$', 1)"
SQL["typed_accessors"] = _OBJECTS + f""", x AS (SELECT o, regexp_replace({_LEX}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS x FROM t WHERE starts_with(o, '"'))
  SELECT o, {_INT.format('TINYINT')} AS as_byte, {_INT.format('SMALLINT')} AS as_short, {_INT.format('INTEGER')} AS as_int, {_INT.format('BIGINT')} AS as_long,
  CASE WHEN regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)') THEN TRY_CAST(x AS DECIMAL(38,10)) END AS as_decimal,
  CASE WHEN x IN ('INF', '-INF', 'NaN') THEN CAST(replace(x, 'INF', 'Infinity') AS DOUBLE) WHEN regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(x AS DOUBLE) END AS as_double,
  CASE WHEN x IN ('true', '1') THEN true WHEN x IN ('false', '0') THEN false END AS as_boolean,
  CASE WHEN regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(x AS DATE) END AS as_date,
  CASE WHEN regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3])(:[0-5][0-9]){{2}}([.][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?')
    THEN TRY_CAST(replace(regexp_extract(x, '^([0-9T:.-]+?)(Z|[+-][0-9]{{2}}:[0-9]{{2}})?$', 1), 'T', ' ') AS TIMESTAMP)
      - CASE WHEN {_ZONE} = '' THEN INTERVAL 0 MINUTE ELSE to_minutes(CAST(({_ZONE})[1] || '1' AS INT) * (CAST(({_ZONE})[2:3] AS INT) * 60 + CAST(({_ZONE})[5:6] AS INT))) END END AS "as_dateTime" FROM x"""



def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    rows = _terms(spark, folder).where(terms.is_literal(F.col("o"))).select("o", accessors.calendar(F.col("o")).alias("k"))
    return rows.where(F.col("k").isNotNull()).select("o", *[F.col(f"k.{n}").alias(n) for n in ("year", "month", "day", "hour", "minute", "zone")])


QUERIES["calendar_accessors"] = _calendar
_YMD = "-?[0-9]{4,9}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
SQL["calendar_accessors"] = _OBJECTS + f""", x AS (SELECT o, regexp_replace({_LEX}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS x FROM t WHERE starts_with(o, '"')),
  z AS (SELECT *, regexp_extract(x, '(Z|[+-](0[0-9]|1[0-4]):[0-5][0-9])$', 1) AS zone FROM x), b AS (SELECT *, x[:length(x) - length(zone)] AS b FROM z),
  k AS (SELECT *, regexp_full_match(b, '{_YMD}(T.*)?') AS full_day FROM b WHERE regexp_full_match(b,
    '({_YMD}T)?([01][0-9]|2[0-3])(:[0-5][0-9]){{2}}([.][0-9]+)?|{_YMD}|-?[0-9]{{4,9}}(-(0[1-9]|1[0-2]))?|--(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?|---(0[1-9]|[12][0-9]|3[01])'))
  SELECT o, TRY_CAST(regexp_extract(b, '^(-?[0-9]{{4,9}})(-|$)', 1) AS INT) AS year, TRY_CAST(regexp_extract(b, '^(-?[0-9]{{4,9}}|-)-([0-9]{{2}})(-|$)', 2) AS INT) AS month,
    TRY_CAST(regexp_extract(b, '^((-?[0-9]{{4,9}}|-)-[0-9]{{2}}|--)-([0-9]{{2}})(T|$)', 3) AS INT) AS day,
    TRY_CAST(regexp_extract(b, '(^|T)([0-9]{{2}}):', 2) AS INT) AS hour, TRY_CAST(regexp_extract(b, '(^|T)[0-9]{{2}}:([0-9]{{2}}):', 2) AS INT) AS minute,
    CASE WHEN zone = 'Z' THEN 0 WHEN zone <> '' THEN CAST(zone[1] || '1' AS INT) * (CAST(zone[2:3] AS INT) * 60 + CAST(zone[5:6] AS INT)) END AS zone
  FROM k WHERE NOT full_day OR TRY_CAST(regexp_extract(b, '^({_YMD})', 1) AS DATE) IS NOT NULL"""

# ------------------------------------------------------- changes of a real store
_LAYOUTS = [{"sort": ["s", "p", "o", "c"]}, {"sort": ["o", "p", "c", "s"]}]
_COPY, _REGISTRY = ex("g/copy"), f"<{G}registry>"


def _whole_store(spark: SparkSession, folder: str, layouts: list | None = None) -> QuadStore:
    """A new store in the shared folder that holds all stored quads."""
    store = QuadStore.open(spark, {"path": scratch_path(spark, "store"), "catalog": "quads", **({"layouts": layouts} if layouts else {})})
    with store.connect() as c:
        c.add_all(table(spark, folder, "quads").where("s is not null and p is not null and o is not null"))
    return store


def _change(name: str, run: Callable, sql: str, layouts: list | None = None) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        store = _whole_store(spark, folder, layouts)
        out = run(store)
        return store.scan() if out is None else out

    QUERIES[name], SQL[name] = query, _SET + sql


def _copies(store: QuadStore) -> DataFrame:
    """Every statement of a status, as it is and in a graph of its own."""
    rows = store.scan(p=_STATUS)
    return rows.unionByName(rows.withColumn("c", F.lit(_COPY)))


def _transaction(end: str) -> Callable:
    def run(store: QuadStore) -> None:
        c = store.connect()
        c.begin()
        c.add_all(_copies(store))
        c.remove(p=f"<{V}of>")
        getattr(c, end)()

    return run


def _flagged(store: QuadStore) -> DataFrame:
    """The flag changes nothing: added with it, removed with it, read without it."""
    with store.connect() as c:
        c.add(ex("a"), ex("knows"), ex("b"), inferred=True)
        c.remove(p=_STATUS, inferred=True)
    return store.connect().scan(include_inferred=False)


_COPIED = f"SELECT s, p, o, '{_COPY}' AS c FROM q WHERE p = '{_STATUS}'"
_change("add_statements", lambda store: store.connect().add_all(_copies(store)) and None, f"SELECT * FROM q UNION {_COPIED}")
_change("add_idempotent", lambda store: [store.connect().add_all(store.scan()) for _ in range(2)] and None, "SELECT * FROM q")
_change("remove_pattern", lambda store: store.connect().remove(p=_STATUS) and None, f"SELECT * FROM q WHERE p <> '{_STATUS}'")
_change("remove_null_context", lambda store: store.connect().remove(p=_STATUS, contexts=[None]) and None, f"SELECT * FROM q WHERE NOT (p = '{_STATUS}' AND c IS NULL)")
_change("remove_quads", lambda store: store.connect().remove_all(_copies(store).where(F.coalesce("c", F.lit("")).isin("", _REGISTRY, _COPY))) and None,
        f"SELECT * FROM q WHERE NOT (p = '{_STATUS}' AND (c IS NULL OR c = '{_REGISTRY}'))")
_change("inferred_flag_ignored", _flagged, f"SELECT * FROM q WHERE p <> '{_STATUS}' UNION ALL SELECT '{ex('a')}', '{ex('knows')}', '{ex('b')}', NULL")
_change("commit_visible", _transaction("commit"), f"SELECT * FROM (SELECT * FROM q UNION {_COPIED}) WHERE p <> '<{V}of>'")
_change("rollback_discards", _transaction("rollback"), "SELECT * FROM q")
#: Read from the layout that is sorted by object.
_change("layout_by_object", lambda store: store.scan(o='"active"'), """SELECT * FROM q WHERE o = '"active"'""", _LAYOUTS)
_change("layouts_after_changes", lambda store: _transaction("commit")(store) or store.compact() or store.scan(o='"active"', contexts=[_COPY, None]),
        f"""SELECT * FROM (SELECT * FROM q UNION {_COPIED}) WHERE p <> '<{V}of>' AND o = '"active"' AND (c IS NULL OR c = '{_COPY}')""", _LAYOUTS)


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    """What each change says it has done, to a store that is dropped in the end."""
    store = _whole_store(spark, folder, _LAYOUTS)
    with store.connect() as c:
        copies = _copies(store)
        steps = [("held", c.count()), ("added", c.add_all(copies)), ("added again", c.add_all(copies))]
        steps.append(("removed in one graph", c.remove(p=_STATUS, contexts=[_COPY])))
        steps.append(("removed as quads", c.remove_all(store.scan(p=f"<{V}of>", contexts=[None]))))
        steps.append(("removed by object", c.remove(o='"active"', contexts=[None, _REGISTRY])))
        steps.append(("left", c.count()))
    store.drop()
    return spark.createDataFrame([*steps, ("after the drop", store.scan().count())], "step string, n bigint")


QUERIES["change_counts"] = _counts
SQL["change_counts"] = _SET + f"""SELECT 'held' AS step, count(*) AS n FROM q UNION ALL SELECT 'added', count(*) FROM (SELECT DISTINCT * FROM ({_COPIED}) EXCEPT SELECT * FROM q) UNION ALL SELECT 'added again', 0
  UNION ALL SELECT 'removed in one graph', count(*) FROM (SELECT DISTINCT * FROM ({_COPIED})) UNION ALL SELECT 'removed as quads', count(*) FROM q WHERE p = '<{V}of>' AND c IS NULL
  UNION ALL SELECT 'removed by object', count(*) FROM q WHERE o = '"active"' AND (c IS NULL OR c = '{_REGISTRY}')
  UNION ALL SELECT 'left', count(*) FROM q WHERE NOT (p = '<{V}of>' AND c IS NULL) AND NOT (o = '"active"' AND (c IS NULL OR c = '{_REGISTRY}')) UNION ALL SELECT 'after the drop', 0"""


def _made_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Statements made of the columns of the documents."""
    docs = table(spark, folder, "documents")
    about = {
        "path": terms.make_literal(F.col("path"), dtype=XSD + "string"), "text": terms.make_literal(F.col("text"), F.coalesce("lang", F.lit(""))),
        "repo": terms.make_uri(F.lit("http://ex.org/repo/"), F.col("repo")), "licence": terms.make_literal(F.col("licence_file")),
    }
    made = F.array(*[F.struct(F.lit(ex(n)).alias("p"), o.alias("o")) for n, o in about.items()])
    return docs.select(terms.make_bnode(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("s"), F.inline(made)).where(F.col("o").isNotNull())


QUERIES["terms_made"] = _made_terms
SQL["terms_made"] = " UNION ALL ".join(f"SELECT '_:d' || doc_id AS s, {p(n)} AS p, {o} AS o FROM documents WHERE {o} IS NOT NULL" for n, o in {
    "path": typed("path", "string"), "text": """'"' || text || CASE WHEN length(lang) > 0 THEN '"@' || lang ELSE '"' END""", "repo": "'<http://ex.org/repo/' || repo || '>'", "licence": plain("licence_file"),
}.items())


def _namespaces(spark: SparkSession, folder: str) -> DataFrame:
    store = QuadStore.open(spark, {"path": scratch_path(spark, "store"), "catalog": "names"})
    with store.connect() as c:
        c.begin()
        for r in table(spark, folder, "namespace_map").collect():  # a fixed table of 9 rows
            c.set_namespace(r.prefix, r.name)
        c.set_namespace("ex", "http://ex.org/")
        c.remove_namespace("old")
        c.remove_namespace("never")
        c.commit()
        return c.namespaces()


QUERIES["namespaces_list"] = _namespaces
SQL["namespaces_list"] = "SELECT prefix, CASE WHEN prefix = 'ex' THEN 'http://ex.org/' ELSE name END AS name FROM namespace_map WHERE prefix <> 'old'"

# ----------------------------------------------------- forms and aggregation
_query("ask_exists", M, "ASK { ?c ex:nation ?n . ?n ex:region ?r . ?r ex:name \"EUROPE\" }", "SELECT count(*) > 0 AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
_query("construct_triples", M, "CONSTRUCT { ?r ex:hasCustomer ?c . ?c ex:in ?r } WHERE { ?c ex:segment ?s . ?c ex:nation ?n . ?n ex:region ?r }",
       f"""WITH j AS (SELECT {i('region', 'n_regionkey')} AS r, {i('customer', 'c_custkey')} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)
         SELECT r AS s, {p('hasCustomer')} AS p, c AS o FROM j UNION ALL SELECT c, {p('in')}, r FROM j""")
_query("group_count", Q, "SELECT ?p (COUNT(?o) AS ?n) (COUNT(DISTINCT ?o) AS ?d) WHERE { ?s ?p ?o } GROUP BY ?p", _SET + f"SELECT p, {whole('count(o)')} AS n, {whole('count(DISTINCT o)')} AS d FROM q GROUP BY p")
#: The mean as a decimal without closing zeros.
_MEAN = "regexp_replace(CAST(CAST(avg(p_size) AS DECIMAL(38,10)) AS VARCHAR), '[.]?0+$', '')"
_query("group_sum_avg", M, """SELECT ?b (SUM(?z) AS ?sum) (SUM(DISTINCT ?z) AS ?once) (AVG(?z) AS ?avg) (MIN(?c) AS ?lo) (MAX(?c) AS ?hi) (SAMPLE(?t) AS ?one)
         WHERE { ?p ex:brand ?b ; ex:size ?z ; ex:price ?c ; ex:type ?t } GROUP BY ?b HAVING(COUNT(*) > 1 && AVG(?z) > 20)""",
       f"""SELECT {plain('p_brand')} AS b, {whole('sum(p_size)')} AS sum, {whole('sum(DISTINCT p_size)')} AS once, {typed(_MEAN, 'decimal')} AS avg, {dec('min(p_retailprice)')} AS lo,
         {dec('max(p_retailprice)')} AS hi, {plain('min(p_type)')} AS one FROM part GROUP BY p_brand HAVING count(*) > 1 AND avg(p_size) > 20""")
_query("count_distinct", M, "SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o ex:customer ?c }", f"SELECT {whole('count(DISTINCT o_custkey)')} AS n FROM orders")


def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All stored quads, written as N-Quads lines and read again."""
    lines = stage(spark, format_quads(stored(spark, folder).scan()), "lines")
    return parse_lines(lines).where("ok").select("s", "p", "o", "c")


QUERIES["nquads_round_trip"] = _round_trip
SQL["nquads_round_trip"] = _SET + "SELECT * FROM q"




def _trig_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All stored quads, written as TriG documents and read again."""
    path = scratch_path(spark, "trig")
    write_trig(stored(spark, folder).scan(), path)
    return read_turtle(spark, path).distinct()


QUERIES["trig_round_trip"] = _trig_round_trip
SQL["trig_round_trip"] = _SET + "SELECT * FROM q"

# ------------------------------------------------- statements held as ids
def _coded(spark: SparkSession, folder: str) -> DictionaryQuads:
    return DictionaryQuads(table(spark, folder, "triples"), table(spark, folder, "term_values"), table(spark, folder, "vocab_terms"))


_DECODED = """WITH v AS (SELECT id, term, NULL AS born, NULL AS gone FROM vocab_terms
    UNION SELECT id, term, created_at, deleted_at FROM term_values WHERE id NOT IN (SELECT id FROM vocab_terms)),
  q AS (SELECT DISTINCT a.term AS s, b.term AS p, d.term AS o, g.term AS c FROM (SELECT DISTINCT subj, pred, obj, context, loaded_at AS t FROM triples)
    JOIN v a ON subj = a.id AND (a.born IS NULL OR a.born <= t) AND (a.gone IS NULL OR a.gone > t)
    JOIN v b ON pred = b.id AND (b.born IS NULL OR b.born <= t) AND (b.gone IS NULL OR b.gone > t)
    JOIN v d ON obj = d.id AND (d.born IS NULL OR d.born <= t) AND (d.gone IS NULL OR d.gone > t)
    LEFT JOIN v g ON context = g.id AND (g.born IS NULL OR g.born <= t) AND (g.gone IS NULL OR g.gone > t)
    WHERE g.term IS NOT NULL OR context IS NULL OR context IN (0, 1)) """
_PADUK = "<http://quads.example/v/paduk>"


def _coded_query(name: str, run: Callable[[DictionaryQuads], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = (lambda spark, folder: run(_coded(spark, folder))), _DECODED + sql


_coded_query("ids_decoded", lambda d: d.scan(), "SELECT * FROM q")
_coded_query("ids_scan_p", lambda d: d.scan(p=_PADUK), f"SELECT * FROM q WHERE p = '{_PADUK}'")
_coded_query("ids_scan_default_graph", lambda d: d.scan(contexts=[None]), "SELECT * FROM q WHERE c IS NULL")
_coded_query("ids_unknown_value", lambda d: d.scan(s="<http://quads.example/nobody>"), "SELECT * FROM q WHERE false")
_coded_query("ids_size_by_predicate", lambda d: d.scan().groupBy("p").agg(F.count(F.lit(1)).alias("n")), "SELECT p, count(*) AS n FROM q GROUP BY p")
#: All stored quads added to the statements, with ids for the terms that have none.
QUERIES["ids_add"] = lambda spark, folder: _coded(spark, folder).added(stored(spark, folder).scan(), datetime(2099, 1, 1)).scan()
SQL["ids_add"] = _DECODED + ", x AS (SELECT s, p, o, c FROM q UNION SELECT s, p, o, c FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL) SELECT * FROM x"

# ----------------------------------------------------------------- streaming
def _stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per predicate and hour, counted by a stream over the table."""
    schema = table(spark, folder, "quads").schema
    target, log = scratch_path(spark, "rates"), scratch_path(spark, "rates-log")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/[q]uads.parquet")  # as a pattern it may be a file or a folder

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    counted = predicate_rates(stream, "loaded_at", late="7 days")
    query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    if late := late_rows(query):
        raise RuntimeError(f"{late} rows came too late")
    return newest_rates(spark.read.parquet(target)).select(F.col("start").cast("timestamp_ntz").alias("hour"), "p", "n")


QUERIES["stream_predicate_rates"] = _stream_rates
SQL["stream_predicate_rates"] = "SELECT date_trunc('hour', loaded_at) AS hour, p, count(*) AS n FROM quads WHERE loaded_at IS NOT NULL GROUP BY ALL"
