"""The registered queries of the engine's own operators, with their SQL.

SPARQL runs on a virtual mapping of the driver's tables; graph algorithms on the
transitions between event types and on the supplier-part-order links; updates and
named graphs on a store built from nations and regions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators.graph import Graph, WeightedGraph
from .sources.mapping import Class, Edges, Mapping
from .store import Engine, Store
from .terms import RDFS

EX = "http://ex/"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def e(name: str) -> str:
    return EX + name


CLASSES = [
    Class(e("Region"), "region", e("region/"), "r_regionkey", {e("r_name"): "r_name"}),
    Class(e("Nation"), "nation", e("nation/"), "n_nationkey", {e("n_name"): "n_name"}, {e("n_region"): (e("region/"), "n_regionkey")}),
    Class(e("Customer"), "customer", e("customer/"), "c_custkey", {e(c): c for c in ("c_name", "c_acctbal", "c_mktsegment")}, {e("c_nation"): (e("nation/"), "c_nationkey")}),
    Class(e("Supplier"), "supplier", e("supplier/"), "s_suppkey", {e(c): c for c in ("s_name", "s_acctbal")}, {e("s_nation"): (e("nation/"), "s_nationkey")}),
    Class(e("Part"), "part", e("part/"), "p_partkey", {e(c): c for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")}),
    Class(e("Order"), "orders", e("order/"), "o_orderkey", {e(c): c for c in ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}, {e("o_customer"): (e("customer/"), "o_custkey")}),
    Class(e("Event"), "events", e("event/"), "event_id", {e(c): c for c in ("ts", "event_type", "value", "props")}, {e("e_user"): (e("user/"), "user_id")}),
]
EDGES = [
    Edges(e("l_supplied_by"), "lineitem", (e("part/"), "l_partkey"), (e("supplier/"), "l_suppkey")),
    Edges(e("l_contains"), "lineitem", (e("order/"), "l_orderkey"), (e("part/"), "l_partkey")),
]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, Mapping(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), CLASSES, EDGES))


def sparql(name: str, text: str, sql: str | None = None) -> None:
    """Registers a SELECT over the mapping."""
    full = f"PREFIX : <{EX}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> {text}"
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).select(full)
    if sql:
        ORACLE[name] = sql


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> frame under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- triple patterns
sparql("scan_sp_o", "SELECT ?o WHERE { <http://ex/nation/3> :n_name ?o }", "SELECT n_name AS o FROM nation WHERE n_nationkey = 3")
sparql("scan_po_s", 'SELECT ?s WHERE { ?s :c_mktsegment "BUILDING" }', "SELECT 'http://ex/customer/' || c_custkey AS s FROM customer WHERE c_mktsegment = 'BUILDING'")
sparql("scan_so_p", "SELECT ?p WHERE { <http://ex/nation/3> ?p <http://ex/region/1> }", "SELECT 'http://ex/n_region' AS p FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1")
sparql("scan_s_po", "SELECT ?p ?o WHERE { <http://ex/nation/3> ?p ?o }", """SELECT 'http://ex/n_name' AS p, n_name AS o FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'http://ex/n_region', 'http://ex/region/' || n_regionkey FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://ex/Nation' FROM nation WHERE n_nationkey = 3""")
sparql("scan_p_so", "SELECT ?s ?o WHERE { ?s :n_region ?o }", "SELECT 'http://ex/nation/' || n_nationkey AS s, 'http://ex/region/' || n_regionkey AS o FROM nation")
sparql("scan_o_ps", "SELECT ?p ?s WHERE { ?s ?p <http://ex/region/1> }", "SELECT 'http://ex/n_region' AS p, 'http://ex/nation/' || n_nationkey AS s FROM nation WHERE n_regionkey = 1")
sparql("scan_all_counts", "SELECT ?c (COUNT(?s) AS ?n) WHERE { ?s rdf:type ?c } GROUP BY ?c", " UNION ALL ".join(f"SELECT '{c.iri}' AS c, count(*) AS n FROM {c.table}" for c in CLASSES))
sparql("scan_repeated_var", "SELECT ?x WHERE { ?x :n_region ?x }", "SELECT 'x' AS x WHERE false")
sparql("scan_unknown_constant", "SELECT ?s WHERE { ?s :n_region <http://ex/region/999> }", "SELECT 'x' AS s WHERE false")


@query("SELECT count(*) > 0 AS answer FROM nation WHERE n_nationkey = 3 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
def scan_spo_exists(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey = 3").first()["n_regionkey"]
    return engine(spark, sf_dir).ask_frame(f"ASK {{ <http://ex/nation/3> <http://ex/n_region> <http://ex/region/{region}> }}")


# --- algebra
sparql("bgp_star", "SELECT ?c ?name ?bal ?seg WHERE { ?c :c_name ?name ; :c_acctbal ?bal ; :c_mktsegment ?seg FILTER(?bal > 5000.0) }", "SELECT 'http://ex/customer/' || c_custkey AS c, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_acctbal > 5000")
sparql("bgp_chain", "SELECT ?region (COUNT(?o) AS ?n) WHERE { ?o :o_customer ?c . ?c :c_nation ?k . ?k :n_region ?r . ?r :r_name ?region } GROUP BY ?region", "SELECT r_name AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("bgp_bowtie", "SELECT ?k (COUNT(*) AS ?n) WHERE { ?c :c_nation ?k ; :c_mktsegment \"BUILDING\" . ?s :s_nation ?k ; :s_acctbal ?b FILTER(?b > 0) } GROUP BY ?k", "SELECT 'http://ex/nation/' || n AS k, cnt AS n FROM (SELECT c_nationkey AS n, count(*) AS cnt FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING' AND s_acctbal > 0 GROUP BY 1)")
sparql("bgp_edges", "SELECT ?n (COUNT(?p) AS ?parts) WHERE { ?p :l_supplied_by ?s . ?s :s_nation ?k . ?k :n_name ?n } GROUP BY ?n", "SELECT n_name AS n, count(*) AS parts FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
sparql("bgp_type", "SELECT ?s ?name WHERE { ?s rdf:type :Supplier ; :s_name ?name }", "SELECT 'http://ex/supplier/' || s_suppkey AS s, s_name AS name FROM supplier")
sparql("join_cross", "SELECT ?a ?b WHERE { ?x :r_name ?a . ?y :r_name ?b }", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y")
sparql("optional_basic", "SELECT ?c ?o WHERE { ?c :c_name ?n OPTIONAL { ?o :o_customer ?c } }", "SELECT 'http://ex/customer/' || c_custkey AS c, 'http://ex/order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
sparql("optional_filter", "SELECT ?c ?o WHERE { ?c :c_acctbal ?b OPTIONAL { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > 100000.0 && ?b > 0) } }", "SELECT 'http://ex/customer/' || c_custkey AS c, 'http://ex/order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 AND c_acctbal > 0")
sparql("optional_chain", "SELECT ?k ?s ?c WHERE { ?k :n_name ?n OPTIONAL { ?s :s_nation ?k ; :s_acctbal ?a FILTER(?a > 8000) } OPTIONAL { ?c :c_nation ?k ; :c_acctbal ?b FILTER(?b > 9500) } }", "SELECT 'http://ex/nation/' || n_nationkey AS k, 'http://ex/supplier/' || s_suppkey AS s, 'http://ex/customer/' || c_custkey AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500")
sparql("optional_reused", "SELECT ?k ?x WHERE { ?k :n_name ?n OPTIONAL { ?x :s_nation ?k ; :s_acctbal ?a FILTER(?a > 9000) } OPTIONAL { ?x :s_nation ?k ; :s_acctbal ?b FILTER(?b < 0) } }", """WITH f AS (SELECT n_nationkey AS k, s_suppkey AS x FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000)
SELECT 'http://ex/nation/' || k AS k, 'http://ex/supplier/' || coalesce(f.x, s.s_suppkey) AS x FROM f LEFT JOIN supplier s ON s.s_nationkey = f.k AND s.s_acctbal < 0 AND (f.x IS NULL OR f.x = s.s_suppkey)""")
sparql("minus_basic", "SELECT ?c WHERE { ?c :c_name ?n MINUS { ?o :o_customer ?c } }", "SELECT 'http://ex/customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sparql("minus_disjoint", "SELECT ?c WHERE { ?c :r_name ?n MINUS { ?o :o_orderstatus ?z } }", "SELECT 'http://ex/region/' || r_regionkey AS c FROM region")
sparql("union_bag", "SELECT ?x WHERE { { ?x :c_nation <http://ex/nation/1> } UNION { ?x :s_nation <http://ex/nation/1> } UNION { ?x :c_nation <http://ex/nation/1> } }", "SELECT 'http://ex/customer/' || c_custkey AS x FROM customer WHERE c_nationkey = 1 UNION ALL SELECT 'http://ex/supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 1 UNION ALL SELECT 'http://ex/customer/' || c_custkey FROM customer WHERE c_nationkey = 1")
sparql("union_missing", "SELECT ?c ?s WHERE { { ?c :c_nation <http://ex/nation/2> } UNION { ?s :s_nation <http://ex/nation/2> } }", "SELECT 'http://ex/customer/' || c_custkey AS c, NULL AS s FROM customer WHERE c_nationkey = 2 UNION ALL SELECT NULL, 'http://ex/supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 2")
sparql("values_single", 'SELECT ?c ?s WHERE { VALUES ?s { "BUILDING" "MACHINERY" } ?c :c_mktsegment ?s }', "SELECT 'http://ex/customer/' || c_custkey AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sparql("values_undef", "SELECT ?k ?r WHERE { VALUES (?k ?r) { (<http://ex/nation/1> UNDEF) (UNDEF <http://ex/region/2>) } ?k :n_region ?r }", "SELECT 'http://ex/nation/' || n_nationkey AS k, 'http://ex/region/' || n_regionkey AS r FROM nation, (VALUES (1, NULL), (NULL, 2)) v(a, b) WHERE (a IS NULL OR a = n_nationkey) AND (b IS NULL OR b = n_regionkey)")
sparql("bind_arith", "SELECT ?p ?x ?y WHERE { ?p :p_size ?s ; :p_retailprice ?r BIND(?s * 2 + 1 AS ?x) BIND(?r / ?s AS ?y) }", "SELECT 'http://ex/part/' || p_partkey AS p, CAST(p_size AS BIGINT) * 2 + 1 AS x, p_retailprice / p_size AS y FROM part")
sparql("exists_corr", "SELECT ?c WHERE { ?c :c_acctbal ?b FILTER EXISTS { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > ?b * 20) } }", "SELECT 'http://ex/customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)")
sparql("not_exists_corr", 'SELECT ?c WHERE { ?c :c_name ?n FILTER NOT EXISTS { ?o :o_customer ?c ; :o_orderstatus "F" } }', "SELECT 'http://ex/customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sparql("exists_in_or", "SELECT ?c WHERE { ?c :c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > 300000) }) }", "SELECT 'http://ex/customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sparql("filter_logic", "SELECT ?p WHERE { ?p :p_size ?s ; :p_retailprice ?r FILTER(!(?s < 10) && (?r < 1200 || ?s = 50)) }", "SELECT 'http://ex/part/' || p_partkey AS p FROM part WHERE NOT (p_size < 10) AND (p_retailprice < 1200 OR p_size = 50)")
sparql("subselect_topk", "SELECT ?c ?n ?t WHERE { { SELECT ?c (ROUND(SUM(?p)) AS ?t) WHERE { ?o :o_customer ?c ; :o_totalprice ?p } GROUP BY ?c ORDER BY DESC(?t) ?c LIMIT 10 } ?c :c_name ?n }", "SELECT 'http://ex/customer/' || c_custkey AS c, c_name AS n, t FROM (SELECT o_custkey, round(sum(o_totalprice)) AS t FROM orders GROUP BY 1 ORDER BY t DESC, o_custkey LIMIT 10) JOIN customer ON c_custkey = o_custkey")

# --- modifiers
sparql("distinct", "SELECT DISTINCT ?b ?t WHERE { ?p :p_brand ?b ; :p_type ?t }", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part")
sparql("order_multi", "SELECT ?n ?b WHERE { ?c :c_name ?n ; :c_acctbal ?b ; :c_mktsegment ?s } ORDER BY ?s DESC(?b) ?n LIMIT 25", "SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_name LIMIT 25")
sparql("limit_offset", "SELECT ?n WHERE { ?c :n_name ?n } ORDER BY ?n OFFSET 5 LIMIT 7", "SELECT n_name AS n FROM nation ORDER BY n_name LIMIT 7 OFFSET 5")
sparql("select_star", "SELECT * WHERE { ?k :n_name ?n ; :n_region ?r }", "SELECT 'http://ex/nation/' || n_nationkey AS k, n_name AS n, 'http://ex/region/' || n_regionkey AS r FROM nation")


@query("SELECT true AS answer")
def ask_true(spark, sf_dir):
    return engine(spark, sf_dir).ask_frame("ASK { ?s <http://ex/n_name> ?n }")


@query("SELECT false AS answer")
def ask_false(spark, sf_dir):
    return engine(spark, sf_dir).ask_frame('ASK { ?s <http://ex/n_name> "ATLANTIS" }')


@query("SELECT DISTINCT '<http://ex/region/' || n_regionkey || '>' AS s, '<http://ex/has>' AS p, '\"' || n_name || '\"' AS o FROM nation")
def construct(spark, sf_dir):
    return engine(spark, sf_dir).construct("PREFIX : <http://ex/> CONSTRUCT { ?r :has ?n } WHERE { ?k :n_region ?r ; :n_name ?n }")


@query("""SELECT '<http://ex/nation/' || n_nationkey || '>' AS s, '<http://ex/n_name>' AS p, '"' || n_name || '"' AS o FROM nation WHERE n_regionkey = 1
UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '>', '<http://ex/n_region>', '<http://ex/region/1>' FROM nation WHERE n_regionkey = 1
UNION ALL SELECT '<http://ex/nation/' || n_nationkey || '>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<http://ex/Nation>' FROM nation WHERE n_regionkey = 1""")
def describe(spark, sf_dir):
    tables = Mapping(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), CLASSES[:2])
    return Engine(spark, tables).construct("DESCRIBE ?k WHERE { ?k <http://ex/n_region> <http://ex/region/1> }")


# --- aggregates
sparql("count_star", "SELECT (COUNT(*) AS ?n) WHERE { ?o :o_orderstatus ?s }", "SELECT count(*) AS n FROM orders")
sparql("count_distinct_star", "SELECT (COUNT(DISTINCT *) AS ?n) (COUNT(*) AS ?m) WHERE { { ?k :n_name ?x } UNION { ?k :n_name ?x } }", "SELECT count(*) AS n, 2 * count(*) AS m FROM nation")
sparql("count_distinct", "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :o_orderstatus ?s ; :o_customer ?c } GROUP BY ?s", "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
sparql("sum_avg", "SELECT ?b (SUM(?s) AS ?total) (AVG(?s) AS ?mean) WHERE { ?p :p_brand ?b ; :p_size ?s } GROUP BY ?b", "SELECT p_brand AS b, CAST(sum(p_size) AS BIGINT) AS total, avg(p_size) AS mean FROM part GROUP BY 1")
sparql("min_max", "SELECT ?s (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) (MIN(?q) AS ?first) WHERE { ?o :o_orderstatus ?s ; :o_totalprice ?p ; :o_orderpriority ?q } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS first FROM orders GROUP BY 1")
sparql("group_concat", 'SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR=",") AS ?names) WHERE { ?k :n_region ?x ; :n_name ?n . ?x :r_name ?r } GROUP BY ?r', "SELECT r_name AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o :o_customer ?c } GROUP BY ?c HAVING (COUNT(?o) > 15)", "SELECT 'http://ex/customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sparql("agg_arith", "SELECT ?s (SUM(?p) / COUNT(?p) AS ?mean) WHERE { ?p_ :p_brand ?s ; :p_size ?p } GROUP BY ?s", "SELECT p_brand AS s, sum(p_size) / count(*) AS mean FROM part GROUP BY 1")
sparql("agg_empty_group", 'SELECT (COUNT(*) AS ?n) (SUM(?x) AS ?s) WHERE { ?p :p_brand "none" ; :p_size ?x }', "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s")
sparql("group_expr", "SELECT ?y (COUNT(?o) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1")
sparql("flagship", "SELECT ?nation (COUNT(?o) AS ?n_orders) (ROUND(SUM(?price)) AS ?total) WHERE { ?o :o_customer ?c ; :o_totalprice ?price ; :o_orderstatus ?st . ?c :c_nation ?nk . ?nk :n_name ?nation FILTER(?price > 1000.0) } GROUP BY ?nation ORDER BY DESC(?total) LIMIT 10", "SELECT n_name AS nation, count(*) AS n_orders, round(sum(o_totalprice)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY total DESC LIMIT 10")

# --- functions
sparql("fn_string", 'SELECT ?p (STRLEN(?n) AS ?l) (UCASE(?n) AS ?u) (LCASE(?b) AS ?w) (CONCAT(?b, "-", ?n) AS ?c) (CONTAINS(?n, "a") AS ?h) (STRSTARTS(?b, "Brand") AS ?s) (STRENDS(?b, "3") AS ?e) (STRBEFORE(?b, "#") AS ?x) (STRAFTER(?b, "#") AS ?y) WHERE { ?p :p_name ?n ; :p_brand ?b }', "SELECT 'http://ex/part/' || p_partkey AS p, CAST(length(p_name) AS BIGINT) AS l, upper(p_name) AS u, lower(p_brand) AS w, p_brand || '-' || p_name AS c, contains(p_name, 'a') AS h, starts_with(p_brand, 'Brand') AS s, ends_with(p_brand, '3') AS e, CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, 1, instr(p_brand, '#') - 1) ELSE '' END AS x, CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE '' END AS y FROM part")
sparql("fn_substr", "SELECT ?n (SUBSTR(?n, 2) AS ?a) (SUBSTR(?n, 2, 3) AS ?b) (SUBSTR(?n, 0, 3) AS ?c) WHERE { ?k :n_name ?n }", "SELECT n_name AS n, substr(n_name, 2) AS a, substr(n_name, 2, 3) AS b, substr(n_name, 1, 2) AS c FROM nation")
sparql("fn_replace_regex", 'SELECT ?n (REPLACE(?n, "[AEIOU]", "_") AS ?a) (REGEX(?n, "^nation_1", "i") AS ?b) WHERE { ?k :n_name ?n }', "SELECT n_name AS n, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS a, regexp_matches(n_name, '(?i)^nation_1') AS b FROM nation")
sparql("fn_encode_uri", 'SELECT ?n (ENCODE_FOR_URI(CONCAT(?n, " &*~")) AS ?u) WHERE { ?k :n_name ?n }', "SELECT n_name AS n, url_encode(n_name || ' &*~') AS u FROM nation")
sparql("fn_lang", 'SELECT ?n (LANG(STRLANG(?n, "en-GB")) AS ?l) (LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "en") AS ?m) (LANG(?n) AS ?e) WHERE { ?k :n_name ?n }', "SELECT n_name AS n, 'en-GB' AS l, true AS m, '' AS e FROM nation")
sparql("fn_datatype", "SELECT ?p (DATATYPE(?s) AS ?a) (DATATYPE(?r) AS ?b) (DATATYPE(?n) AS ?c) WHERE { ?p :p_size ?s ; :p_retailprice ?r ; :p_name ?n }", "SELECT 'http://ex/part/' || p_partkey AS p, 'http://www.w3.org/2001/XMLSchema#integer' AS a, 'http://www.w3.org/2001/XMLSchema#double' AS b, 'http://www.w3.org/2001/XMLSchema#string' AS c FROM part")
sparql("fn_math", "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?c :c_acctbal ?b }", "SELECT 'http://ex/customer/' || c_custkey AS c, abs(c_acctbal) AS a, ceil(c_acctbal) + 0.0::DOUBLE AS u, floor(c_acctbal) AS f, round(c_acctbal) + 0.0::DOUBLE AS r FROM customer")
sparql("fn_datetime", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?x) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) WHERE { ?o :o_orderdate ?d }", "SELECT 'http://ex/order/' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS x, hour(o_orderdate) AS h, minute(o_orderdate) AS i FROM orders")
sparql("fn_tz", "SELECT ?o (TZ(?d) AS ?z) WHERE { ?o :o_orderdate ?d }", "SELECT 'http://ex/order/' || o_orderkey AS o, 'Z' AS z FROM orders")
sparql("fn_hash", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) WHERE { ?k :n_name ?n }", "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation")
sparql("fn_hash_long", "SELECT ?n (SHA384(?n) AS ?a) (SHA512(?n) AS ?b) WHERE { ?k :n_name ?n }")
sparql("fn_if_coalesce", 'SELECT ?c (IF(?b > 0, "plus", "minus") AS ?s) (COALESCE(?z, ?b) AS ?v) WHERE { ?c :c_acctbal ?b OPTIONAL { ?c :p_size ?z } }', "SELECT 'http://ex/customer/' || c_custkey AS c, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS s, c_acctbal AS v FROM customer")
sparql("fn_term_tests", "SELECT ?k (ISIRI(?k) AS ?a) (ISLITERAL(?n) AS ?b) (ISBLANK(?k) AS ?c) (ISNUMERIC(?n) AS ?d) (STR(?k) AS ?s) (SAMETERM(?k, ?k) AS ?e) WHERE { ?k :n_name ?n }", "SELECT 'http://ex/nation/' || n_nationkey AS k, true AS a, true AS b, false AS c, false AS d, 'http://ex/nation/' || n_nationkey AS s, true AS e FROM nation")
sparql("fn_in", 'SELECT ?c WHERE { ?c :c_mktsegment ?s FILTER(?s IN ("BUILDING", "MACHINERY")) }', "SELECT 'http://ex/customer/' || c_custkey AS c FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sparql("fn_cast", "SELECT ?p (xsd:integer(?r) AS ?i) (xsd:double(?s) AS ?d) WHERE { ?p :p_retailprice ?r ; :p_size ?s }", "SELECT 'http://ex/part/' || p_partkey AS p, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS d FROM part")
sparql("fn_compare_time", 'SELECT ?o WHERE { ?o :o_orderdate ?d FILTER(?d < "1997-03-01T00:00:00Z"^^xsd:dateTime) }', "SELECT 'http://ex/order/' || o_orderkey AS o FROM orders WHERE o_orderdate < TIMESTAMP '1997-03-01 00:00:00'")
sparql("fn_similarity", 'SELECT ?n (SIMILARITY(?n, "GERMANY") AS ?s) WHERE { ?k :n_name ?n }')
sparql("fn_random", "SELECT (COUNT(*) AS ?n) WHERE { ?k :n_name ?x BIND(RAND() AS ?r) BIND(STRUUID() AS ?u) FILTER(?r < 1 && STRLEN(?u) = 36 && ISIRI(UUID())) }", "SELECT count(*) AS n FROM nation")


@query("SELECT n_name AS n, reverse(n_name) AS r FROM nation")
def fn_udf(spark, sf_dir):
    own = engine(spark, sf_dir)
    own.register_udf("backwards", lambda text: text[::-1])
    return own.select("SELECT ?n (backwards(?n) AS ?r) WHERE { ?k <http://ex/n_name> ?n }")


# --- paths: nations below regions, customers below nations, orders below customers
sparql("path_seq", "SELECT ?o ?r WHERE { ?o :o_customer/:c_nation/:n_region ?r }", "SELECT DISTINCT 'http://ex/order/' || o_orderkey AS o, 'http://ex/region/' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
sparql("path_alt", "SELECT ?x ?k WHERE { ?x :c_nation|:s_nation ?k }", "SELECT 'http://ex/customer/' || c_custkey AS x, 'http://ex/nation/' || c_nationkey AS k FROM customer UNION SELECT 'http://ex/supplier/' || s_suppkey, 'http://ex/nation/' || s_nationkey FROM supplier")
sparql("path_inverse", "SELECT ?r ?k WHERE { ?r ^:n_region ?k }", "SELECT 'http://ex/region/' || n_regionkey AS r, 'http://ex/nation/' || n_nationkey AS k FROM nation")
sparql("path_opt", "SELECT ?x WHERE { <http://ex/nation/4> :n_region? ?x }", "SELECT 'http://ex/nation/4' AS x UNION SELECT 'http://ex/region/' || n_regionkey FROM nation WHERE n_nationkey = 4")
sparql("path_plus", "SELECT ?c WHERE { ?c (:c_nation|:n_region)+ <http://ex/region/2> }", "SELECT 'http://ex/nation/' || n_nationkey AS c FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'http://ex/customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
sparql("path_star", "SELECT ?x WHERE { <http://ex/customer/7> (:c_nation|:n_region)* ?x }", "SELECT 'http://ex/customer/7' AS x UNION SELECT 'http://ex/nation/' || c_nationkey FROM customer WHERE c_custkey = 7 UNION SELECT 'http://ex/region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
sparql("path_both_free", "SELECT ?a ?b WHERE { ?a (:s_nation|:n_region)+ ?b }", "SELECT 'http://ex/supplier/' || s_suppkey AS a, 'http://ex/nation/' || s_nationkey AS b FROM supplier UNION SELECT 'http://ex/supplier/' || s_suppkey, 'http://ex/region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'http://ex/nation/' || n_nationkey, 'http://ex/region/' || n_regionkey FROM nation")


# --- more of the language on the mapping
sparql("minus_keeps", "SELECT ?c WHERE { ?c :c_name ?n MINUS { ?o :o_customer ?c ; :o_totalprice ?t FILTER(?t > 300000) } }", "SELECT 'http://ex/customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sparql("minus_unbound", "SELECT ?k ?x WHERE { ?k :n_name ?n OPTIONAL { ?x :s_nation ?k ; :s_acctbal ?a FILTER(?a > 5000) } MINUS { ?x :s_acctbal ?b FILTER(?b > 8000) } }", "SELECT 'http://ex/nation/' || n_nationkey AS k, 'http://ex/supplier/' || s_suppkey AS x FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 WHERE s_acctbal IS NULL OR s_acctbal <= 8000")
sparql("join_unbound_both", "SELECT ?k ?x WHERE { { ?k :n_name ?n OPTIONAL { ?x :s_nation ?k ; :s_acctbal ?a FILTER(?a > 9000) } } { ?k :n_region <http://ex/region/1> OPTIONAL { ?x :s_nation ?k ; :s_acctbal ?b FILTER(?b < 500) } } }", "SELECT 'http://ex/nation/' || n_nationkey AS k, 'http://ex/supplier/' || coalesce(f.x, g.x) AS x FROM nation JOIN (SELECT n_nationkey AS k, s_suppkey AS x FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000) f ON f.k = n_nationkey JOIN (SELECT n_nationkey AS k, s_suppkey AS x FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 500) g ON g.k = n_nationkey AND (f.x IS NULL OR g.x IS NULL OR f.x = g.x) WHERE n_regionkey = 1")
sparql("fn_bound", "SELECT ?c (BOUND(?t) AS ?b) WHERE { ?c :c_acctbal ?x OPTIONAL { ?c :c_acctbal ?t FILTER(?t > 5000) } }", "SELECT 'http://ex/customer/' || c_custkey AS c, c_acctbal > 5000 AS b FROM customer")
sparql("fn_seconds", "SELECT ?e (SECONDS(?t) AS ?s) (STR(TIMEZONE(?t)) AS ?z) WHERE { ?e :ts ?t }", "SELECT 'http://ex/event/' || event_id AS e, extract(microsecond FROM ts) / 1000000.0::DOUBLE AS s, 'PT0S' AS z FROM events")
sparql("fn_iri_bnode", 'SELECT ?n (STR(IRI(CONCAT("http://x/", ?n))) AS ?i) (ISIRI(IRI(?n)) AS ?a) (ISBLANK(BNODE(?n)) AS ?b) (BNODE(?n) = BNODE(?n) AS ?c) WHERE { ?k :n_name ?n }', "SELECT n_name AS n, 'http://x/' || n_name AS i, true AS a, true AS b, true AS c FROM nation")
sparql("fn_overflow", "SELECT ?p (xsd:double(?s * 9223372036854775807) AS ?v) (?s * 9223372036854775807 > 1 AS ?big) (DATATYPE(?s * 9223372036854775807) AS ?t) WHERE { ?p :p_size ?s }", "SELECT 'http://ex/part/' || p_partkey AS p, p_size * 9223372036854775807::DOUBLE AS v, true AS big, 'http://www.w3.org/2001/XMLSchema#' || CASE WHEN p_size = 1 THEN 'integer' ELSE 'double' END AS t FROM part")
sparql("fn_now", "SELECT (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d FILTER(?d < NOW()) }", "SELECT count(*) AS n FROM orders")
sparql("agg_sample", "SELECT ?r (SAMPLE(?t) AS ?one) (COUNT(?k) AS ?n) WHERE { ?k :n_region ?r . ?r :r_name ?t } GROUP BY ?r", "SELECT 'http://ex/region/' || r_regionkey AS r, r_name AS one, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
sparql("agg_logic", "SELECT ?r (COUNT(?k) > 3 && MIN(?k) != MAX(?k) AS ?many) WHERE { ?k :n_region ?r } GROUP BY ?r", "SELECT 'http://ex/region/' || n_regionkey AS r, count(*) > 3 AND min(n_nationkey) <> max(n_nationkey) AS many FROM nation GROUP BY n_regionkey")
sparql("select_reduced", "SELECT REDUCED ?r WHERE { ?r :r_name ?n }", "SELECT 'http://ex/region/' || r_regionkey AS r FROM region")


# --- a store with named graphs: a graph for each region, names in the default graph
def geo_store(spark: SparkSession, sf_dir: str) -> Store:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    ref = lambda kind, c: F.concat(F.lit(f"<http://ex/{kind}/"), F.col(c), F.lit(">"))
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    none, p = F.lit(None).cast("string"), lambda n: F.lit(f"<http://ex/{n}>")
    quads = nation.select(ref("region", "n_regionkey").alias("g"), ref("nation", "n_nationkey").alias("s"), p("in").alias("p"), ref("region", "n_regionkey").alias("o"))
    quads = quads.unionAll(nation.select(none, ref("nation", "n_nationkey"), p("name"), text("n_name"))).unionAll(region.select(none, ref("region", "r_regionkey"), p("name"), text("r_name")))
    return Store(spark, quads.unionAll(nation.select(none, ref("nation", "n_nationkey"), p("size"), F.concat(F.lit('"'), F.length("n_name"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>')))))


PRE = "PREFIX : <http://ex/> "


@query("SELECT 'http://ex/nation/' || n_nationkey AS s FROM nation WHERE n_regionkey = 1")
def graph_const(spark, sf_dir):
    return geo_store(spark, sf_dir).select(PRE + "SELECT ?s WHERE { GRAPH <http://ex/region/1> { ?s :in ?r } }")


@query("SELECT 'http://ex/region/' || n_regionkey AS g, 'http://ex/nation/' || n_nationkey AS s, n_name AS n FROM nation")
def graph_var(spark, sf_dir):
    return geo_store(spark, sf_dir).select(PRE + "SELECT ?g ?s ?n WHERE { GRAPH ?g { ?s :in ?r } ?s :name ?n }")


@query("SELECT 'http://ex/nation/' || n_nationkey AS s, CAST(length(n_name) * 3 AS VARCHAR) AS x FROM nation WHERE length(n_name) > 8")
def generic_terms(spark, sf_dir):
    return geo_store(spark, sf_dir).select(PRE + "SELECT ?s (STR(?n * 3) AS ?x) WHERE { ?s :size ?n FILTER(?n > 8) }")


@query("SELECT n_name AS n FROM nation WHERE n_nationkey < 5")
def path_negated(spark, sf_dir):
    return geo_store(spark, sf_dir).select(PRE + "SELECT ?n WHERE { VALUES ?s { " + " ".join(f"<http://ex/nation/{k}>" for k in range(5)) + " } ?s !(:size|:in|^:name) ?n }")


@query("SELECT count(*) + 2 AS n FROM nation")
def upd_insert_data(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    store.update(PRE + 'INSERT DATA { :x :size 1 . :y :size 2 . <http://ex/nation/0> :name "extra" }')
    return store.select(PRE + "SELECT (COUNT(*) AS ?n) WHERE { ?s :size ?x }")


@query("SELECT count(*) AS n FROM nation WHERE length(n_name) <= 8")
def upd_delete_where(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    store.update(PRE + "DELETE { ?s :size ?x } WHERE { ?s :size ?x FILTER(?x > 8) }")
    return store.select(PRE + "SELECT (COUNT(*) AS ?n) WHERE { ?s :size ?x }")


@query("SELECT 'http://ex/nation/' || n_nationkey AS s, CAST(length(n_name) + 100 AS VARCHAR) AS x FROM nation")
def upd_modify(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    store.update(PRE + "DELETE { ?s :size ?x } INSERT { ?s :size ?y } WHERE { ?s :size ?x BIND(?x + 100 AS ?y) }")
    return store.select(PRE + "SELECT ?s ?x WHERE { ?s :size ?x }")


@query("SELECT CAST(3 AS BIGINT) AS changed, CAST(1 AS BIGINT) AS n")
def upd_sequence(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    changed = store.update(PRE + "INSERT DATA { :a :t 1 . :b :t 2 } ; DELETE DATA { :a :t 1 }")
    return store.select(PRE + f"SELECT ({changed} AS ?changed) (COUNT(*) AS ?n) WHERE {{ ?s :t ?x }}")


@query("SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS changed, (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS n")
def upd_clear_graph(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    changed = store.update("CLEAR GRAPH <http://ex/region/1>")
    return store.select(f"SELECT ({changed} AS ?changed) (COUNT(*) AS ?n) WHERE {{ GRAPH ?g {{ ?s ?p ?o }} }}")


@query("SELECT 'http://ex/nation/' || n_nationkey AS s FROM nation WHERE length(n_name) > 8")
def upd_insert_where(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    store.update(PRE + "INSERT { ?s :long true } WHERE { ?s :size ?x FILTER(?x > 8) }")
    return store.select(PRE + "SELECT ?s WHERE { ?s :long true }")


@query("SELECT '<http://ex/name>' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n")
def upd_delete_where_all(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    store.update(PRE + "DELETE WHERE { ?s :size ?x }")
    return store.quads.where("g is null").groupBy("p").agg(F.count("*").alias("n"))


@query("SELECT 'http://ex/nation/' || n_nationkey AS x FROM nation")
def repeated_var_found(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    store.update(PRE + "INSERT { ?s :same ?s . ?s :same :other } WHERE { ?s :size ?x }")
    return store.select(PRE + "SELECT ?x WHERE { ?x :same ?x }")


# --- RDF files written from the nations and read back
def rdf_file(spark: SparkSession, sf_dir: str, head: str, line, tail: str = "") -> str:
    """One file with a line for each nation; ``line`` makes it of (key, name, region key)."""
    from .storage import fresh_path

    path = fresh_path(spark, "rdf")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    body = nation.select(F.lit(1).alias("part"), line(F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string")).alias("value"))
    ends = spark.createDataFrame([(0, head), (2, tail)], "part int, value string").where("value <> ''")
    body.unionAll(ends).coalesce(1).sortWithinPartitions("part", "value").select("value").write.text(path)
    return path


NAMES = "SELECT '<http://ex/nation/' || n_nationkey || '>' AS s, '\"' || n_name || '\"@en' AS o FROM nation"
GRAPHS = "SELECT '<http://ex/region/' || n_regionkey || '>' AS g, '<http://ex/nation/' || n_nationkey || '>' AS s, '\"' || n_name || '\"@en' AS o FROM nation"


def read_rdf(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    from .sources import rdf

    return rdf.read(spark, path, fmt).where("p = '<http://ex/name>'")


@query(NAMES)
def read_ntriples(spark, sf_dir):
    path = rdf_file(spark, sf_dir, "# nations", lambda k, n, r: F.concat(F.lit("<http://ex/nation/"), k, F.lit('> <http://ex/name> "'), n, F.lit('"@en .')))
    return read_rdf(spark, path, "ntriples").select("s", "o")


@query(GRAPHS)
def read_nquads(spark, sf_dir):
    path = rdf_file(spark, sf_dir, "# nations", lambda k, n, r: F.concat(F.lit("<http://ex/nation/"), k, F.lit('> <http://ex/name> "'), n, F.lit('"@en <http://ex/region/'), r, F.lit("> .")))
    return read_rdf(spark, path, "nquads").select("g", "s", "o")


@query(NAMES)
def read_turtle(spark, sf_dir):
    path = rdf_file(spark, sf_dir, "@prefix ex: <http://ex/> .", lambda k, n, r: F.concat(F.lit("<http://ex/nation/"), k, F.lit("> a ex:Nation ; ex:in <http://ex/region/"), r, F.lit('> ; ex:name "'), n, F.lit('"@en .')))
    return read_rdf(spark, path, "turtle").select("s", "o")


@query(GRAPHS)
def read_trig(spark, sf_dir):
    path = rdf_file(spark, sf_dir, "@prefix ex: <http://ex/> .", lambda k, n, r: F.concat(F.lit("<http://ex/region/"), r, F.lit("> { <http://ex/nation/"), k, F.lit('> ex:name "'), n, F.lit('"@en . }')))
    return read_rdf(spark, path, "trig").select("g", "s", "o")


@query(NAMES)
def read_rdfxml(spark, sf_dir):
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://ex/">'
    path = rdf_file(spark, sf_dir, head, lambda k, n, r: F.concat(F.lit('<rdf:Description rdf:about="http://ex/nation/'), k, F.lit('"><ex:name xml:lang="en">'), n, F.lit("</ex:name></rdf:Description>")), "</rdf:RDF>")
    return read_rdf(spark, path, "rdfxml").select("s", "o")


@query("SELECT count(*) AS n FROM nation")
def upd_load(spark, sf_dir):
    path = rdf_file(spark, sf_dir, "# nations", lambda k, n, r: F.concat(F.lit("<http://ex/nation/"), k, F.lit('> <http://ex/title> "'), n, F.lit('" .')))
    store = geo_store(spark, sf_dir)
    store.update(f"LOAD <{path}>")
    return store.select(PRE + "SELECT (COUNT(*) AS ?n) WHERE { ?s :title ?x ; :name ?x }")


@query("SELECT count(*) AS n FROM nation")
def txn_rollback(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    store.begin()
    store.update(PRE + "DELETE WHERE { ?s :size ?x }")
    store.rollback()
    return store.select(PRE + "SELECT (COUNT(*) AS ?n) WHERE { ?s :size ?x }")


@query("SELECT count(*) AS n FROM nation")
def time_travel(spark, sf_dir):
    store = geo_store(spark, sf_dir)
    before = store.version()
    store.update(PRE + "DELETE WHERE { ?s :size ?x }")
    return store.at(before).select(PRE + "SELECT (COUNT(*) AS ?n) WHERE { ?s :size ?x }")


@query("SELECT '<http://ex/in>' AS p, CAST(0 AS BIGINT) AS triples WHERE false UNION ALL SELECT '<http://ex/name>', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) UNION ALL SELECT '<http://ex/size>', (SELECT count(*) FROM nation)")
def pred_stats(spark, sf_dir):
    return geo_store(spark, sf_dir).predicate_stats().select("p", "triples")


# --- reasoning over the nations
def schema_store(spark: SparkSession, sf_dir: str) -> Store:
    store = geo_store(spark, sf_dir)
    sub, dom, rng, subp = (f"<{RDFS}{x}>" for x in ("subClassOf", "domain", "range", "subPropertyOf"))
    a = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
    nations = store.quads.where("p = '<http://ex/in>'").select(F.lit(None).cast("string").alias("g"), "s", "p", "o")
    rows = [(None, "<http://ex/Nation>", sub, "<http://ex/Place>"), (None, "<http://ex/Place>", sub, "<http://ex/Thing>"), (None, "<http://ex/in>", dom, "<http://ex/Nation>"), (None, "<http://ex/in>", rng, "<http://ex/Region>"), (None, "<http://ex/in>", subp, "<http://ex/partOf>"), (None, "<http://ex/x>", a, "<http://ex/Nation>")]
    return Store(spark, nations.unionAll(spark.createDataFrame(rows, "g string, s string, p string, o string")))


@query("SELECT 'http://ex/nation/' || n_nationkey AS s FROM nation UNION ALL SELECT 'http://ex/x'")
def rdfs_closure(spark, sf_dir):
    store = schema_store(spark, sf_dir)
    store.materialize_rdfs()
    return store.select(PRE + "SELECT ?s WHERE { ?s a :Thing }")


@query("SELECT DISTINCT 'http://ex/region/' || n_regionkey AS s FROM nation")
def rdfs_domain_range(spark, sf_dir):
    store = schema_store(spark, sf_dir)
    store.materialize_rdfs()
    return store.select(PRE + "SELECT ?s WHERE { ?s a :Region }")


@query("SELECT 'http://ex/nation/' || n_nationkey AS s, 'http://ex/region/' || n_regionkey AS o FROM nation")
def rdfs_subproperty(spark, sf_dir):
    store = schema_store(spark, sf_dir)
    store.materialize_rdfs()
    return store.select(PRE + "SELECT ?s ?o WHERE { ?s :partOf ?o }")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, n): event type followed by event type of the same user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return events.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


STEP = "step AS (SELECT a, b, count(*) AS n FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY a, b)"


@query(f"WITH RECURSIVE {STEP}, few AS (SELECT a, b FROM step WHERE a < b), c AS (SELECT a, b FROM few UNION SELECT c.a, f.b FROM c JOIN few f ON c.b = f.a) SELECT 'http://ex/' || a AS a, 'http://ex/' || b AS b FROM c")
def rule_transitive(spark, sf_dir):
    few = transitions(spark, sf_dir).where("a < b")
    ref = lambda c: F.concat(F.lit("<http://ex/"), F.col(c), F.lit(">"))
    store = Store(spark, few.select(F.lit(None).cast("string").alias("g"), ref("a").alias("s"), F.lit("<http://ex/next>").alias("p"), ref("b").alias("o")))
    store.add_rule("later", "?x <http://ex/next> ?y => ?x <http://ex/later> ?y")
    store.add_rule("chain", "?x <http://ex/later> ?y . ?y <http://ex/next> ?z => ?x <http://ex/later> ?z")
    store.run_rules()
    return store.select(PRE + "SELECT ?a ?b WHERE { ?a :later ?b }")


# --- graph analytics: supplier-nation-region links, and the event transitions
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> nation -> region, as (a, b)."""
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    name = lambda k, c: F.concat(F.lit(k), F.col(c))
    return s.select(name("s", "s_suppkey").alias("a"), name("n", "s_nationkey").alias("b")).unionAll(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))


LINKS = "links AS (SELECT DISTINCT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), nodes AS (SELECT a AS node FROM links UNION SELECT b FROM links)"


@query(f"WITH {LINKS} SELECT node, (SELECT count(*) FROM links WHERE a = node) AS out_degree, (SELECT count(*) FROM links WHERE b = node) AS in_degree FROM nodes")
def g_degree(spark, sf_dir):
    return Graph(links(spark, sf_dir)).degrees()


@query(f"WITH RECURSIVE {LINKS}, r AS (SELECT 's1' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM r JOIN links ON a = node WHERE hops < 5) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def g_bfs(spark, sf_dir):
    return Graph(links(spark, sf_dir)).bfs("s1").select("node", "hops")


@query("SELECT 's1' AS node, 0 AS place UNION ALL SELECT 'n' || s_nationkey, 1 FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
def g_shortest_path(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey = 1").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.expr("s_nationkey = n_nationkey")).first()
    path = Graph(links(spark, sf_dir)).shortest_path("s1", f"r{n['n_regionkey']}")
    return spark.createDataFrame([(x, k) for k, x in enumerate(path)], "node string, place int")


@query(f"WITH RECURSIVE {LINKS}, ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r AS (SELECT node, node AS c FROM nodes UNION SELECT b, c FROM r JOIN ends ON a = node) SELECT node, min(c) AS component FROM r GROUP BY node")
def g_wcc(spark, sf_dir):
    return Graph(links(spark, sf_dir)).weak_components()


@query(f"WITH RECURSIVE {STEP}, nodes AS (SELECT a AS node FROM step UNION SELECT b FROM step), r AS (SELECT node AS x, node AS y FROM nodes UNION SELECT r.x, s.b FROM r JOIN step s ON s.a = r.y) SELECT p.x AS node, min(p.y) AS component FROM r p JOIN r q ON p.x = q.y AND p.y = q.x GROUP BY p.x")
def g_scc(spark, sf_dir):
    return Graph(transitions(spark, sf_dir)).strong_components()


@query(f"WITH RECURSIVE {STEP}, r AS (SELECT a AS x, b AS y FROM step UNION SELECT r.x, s.b FROM r JOIN step s ON s.a = r.y) SELECT count(*) > 0 AS transitions, false AS links FROM r WHERE x = y")
def g_cycle(spark, sf_dir):
    return spark.createDataFrame([(Graph(transitions(spark, sf_dir)).has_cycle(), Graph(links(spark, sf_dir)).has_cycle())], "transitions boolean, links boolean")


@query("WITH und AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS x, greatest(l_partkey, l_suppkey) AS y FROM lineitem WHERE l_partkey <> l_suppkey) SELECT count(*) AS n FROM und a JOIN und b ON a.y = b.x JOIN und c ON c.x = a.x AND c.y = b.y")
def g_triangles(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return spark.createDataFrame([(Graph(pairs).triangle_count(),)], "n long")


def rank_sql(weight: str, rounds: int, edges: str) -> str:
    out = [f"WITH {edges}, nodes AS (SELECT a AS node FROM step UNION SELECT b FROM step), total AS (SELECT a, sum({weight}) AS t FROM step GROUP BY a), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce((SELECT sum(r.rank * {weight} / t.t) FROM step s JOIN r{k} r ON r.node = s.a JOIN total t ON t.a = s.a WHERE s.b = n.node), 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT a FROM total)) / (SELECT count(*) FROM nodes)) AS rank FROM nodes n)")
    return ", ".join(out) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(rank_sql("1.0::DOUBLE", 8, STEP))
def g_pagerank(spark, sf_dir):
    return Graph(transitions(spark, sf_dir)).pagerank(max_iters=8, tol=0).select("node", F.round("rank", 6).alias("rank"))


@query(rank_sql("n", 8, STEP))
def g_wpagerank(spark, sf_dir):
    edges = transitions(spark, sf_dir).select("a", "b", F.lit("next").alias("p"), F.col("n").alias("w"))
    return WeightedGraph(edges).pagerank(max_iters=8, tol=0).select("node", F.round("rank", 6).alias("rank"))


@query(f"WITH {LINKS} SELECT node, CAST(1 AS BIGINT) AS core FROM nodes")
def g_kcore(spark, sf_dir):
    return Graph(links(spark, sf_dir)).core_numbers()


@query(f"WITH RECURSIVE {LINKS}, r AS (SELECT node AS x, node AS y, 0 AS d FROM nodes UNION SELECT x, b, d + 1 FROM r JOIN links ON a = y WHERE d < 5), m AS (SELECT x, y, min(d) AS d FROM r GROUP BY x, y) SELECT x AS node, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) * (count(*) - 1) / ((SELECT count(*) FROM nodes) - 1) ELSE 0.0 END, 6) AS closeness FROM m GROUP BY x")
def g_closeness(spark, sf_dir):
    return Graph(links(spark, sf_dir)).closeness().select("node", F.round("closeness", 6).alias("closeness"))


@query(f"WITH {LINKS} SELECT node, CAST((SELECT count(*) FROM links WHERE b = node) * (SELECT count(*) FROM links WHERE a = node) AS DOUBLE) AS betweenness FROM nodes")
def g_betweenness(spark, sf_dir):
    return Graph(links(spark, sf_dir)).betweenness()


TRADE = "trade AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), ends AS (SELECT a, b FROM trade UNION ALL SELECT b, a FROM trade)"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier - part, both ways: a graph full of cycles."""
    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    return pairs.unionAll(pairs.select("b", "a"))


@query(f"WITH RECURSIVE {TRADE}, r AS (SELECT 's1' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM r JOIN ends ON a = node WHERE hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def g_bfs_cyclic(spark, sf_dir):
    return Graph(trade(spark, sf_dir)).bfs("s1", max_hops=3).select("node", "hops")


@query(f"WITH {TRADE} SELECT a AS node, count(*) AS out_degree, count(*) AS in_degree FROM ends GROUP BY a")
def g_degree_cyclic(spark, sf_dir):
    return Graph(trade(spark, sf_dir)).degrees()


SSSP_FROM = "(SELECT min(a) FROM step)"


@query(f"WITH RECURSIVE {STEP}, r AS (SELECT {SSSP_FROM} AS node, 0.0::DOUBLE AS d, 0 AS k UNION SELECT s.b, d + 1000.0::DOUBLE / n, k + 1 FROM r JOIN step s ON s.a = r.node WHERE k < 5) SELECT node, round(min(d), 6) AS distance FROM r GROUP BY node")
def g_sssp(spark, sf_dir):
    t = transitions(spark, sf_dir)
    first = t.agg(F.min("a")).first()[0]
    edges = t.select("a", "b", F.lit("next").alias("p"), (1000.0 / F.col("n")).alias("w"))
    return WeightedGraph(edges).distances(first).select("node", F.round("distance", 6).alias("distance"))


@query("SELECT 'n' || n_nationkey AS node, 1 AS hops FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey = 1 UNION ALL SELECT 's1', 0")
def g_bfs_filtered(spark, sf_dir):
    edges = links(spark, sf_dir).withColumn("p", F.when(F.col("b").startswith("n"), "s_nation").otherwise("n_region")).withColumn("w", F.lit(1.0))
    return WeightedGraph(edges).bfs("s1", ["s_nation"])


@query(f"WITH {STEP} SELECT x.a AS u, x.b AS v, y.b AS w, CAST(x.n + y.n AS DOUBLE) AS score FROM step x JOIN step y ON x.b = y.a WHERE x.a <> x.b AND x.b <> y.b AND x.a <> y.b ORDER BY score DESC, u, v, w LIMIT 10")
def g_topk_subgraph(spark, sf_dir):
    edges = transitions(spark, sf_dir).select("a", "b", F.lit("next").alias("p"), F.col("n").alias("w"))
    return WeightedGraph(edges).topk_subgraph([("u", "next", "v"), ("v", "next", "w")], 10)


@query()
def g_louvain(spark, sf_dir):
    return Graph(links(spark, sf_dir)).louvain()


@query()
def g_louvain_directed(spark, sf_dir):
    return Graph(links(spark, sf_dir)).louvain(directed=True)


# --- strings, vectors and grounding
@query("SELECT '\"' || n_name || '\"' AS term, n_name AS text FROM nation WHERE contains(n_name, 'ION_1')")
def trigram_contains(spark, sf_dir):
    from .operators import strings

    terms = strings.terms_of(geo_store(spark, sf_dir).quads.where("p = '<http://ex/name>'")).where(F.col("term").startswith('"'))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("text"))
    return strings.contains(terms.join(names, "text", "left_semi"), "ION_1", strings.trigram_index(terms))


@query("SELECT '\"' || n_name || '\"' AS term, n_name AS text FROM nation WHERE starts_with(n_name, 'NATION_2')")
def prefix_lookup(spark, sf_dir):
    from .operators import strings

    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("text"))
    return strings.prefix(strings.terms_of(geo_store(spark, sf_dir).quads.where("p = '<http://ex/name>'")).join(names, "text", "left_semi"), "NATION_2").select("term", "text")


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]) DESC, vec_id LIMIT 10")
def vec_topk(spark, sf_dir):
    from .qa.vectors import top_k

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    first = table.where("id = 0").first()["vec"]
    return top_k(table, list(first), 10).select("id", F.round("score", 4).alias("score"))


@query("SELECT '<http://ex/nation/' || n_nationkey || '>' AS s, '<http://ex/name>' AS p, '\"' || n_name || '\"' AS o FROM nation WHERE n_nationkey IN (3, 5)")
def citations(spark, sf_dir):
    from .qa.linking import citations as cite

    triples = geo_store(spark, sf_dir).quads.where("g is null").select("s", "p", "o")
    return cite(triples, [e("nation/3"), e("nation/5")], per_entity=1)


@query("""SELECT '<http://ex/nation/' || n_nationkey || '>' AS s, '<http://ex/in>' AS p, '<http://ex/region/' || n_regionkey || '>' AS o FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)""")
def graphrag_subgraph(spark, sf_dir):
    from .qa.linking import subgraph

    links_ = geo_store(spark, sf_dir).quads.where("p = '<http://ex/in>'").select("s", "p", "o")
    return subgraph(links_, ["<http://ex/nation/3>"], hops=2)


@query("SELECT '<http://ex/in>' AS predicate, 'out' AS side UNION ALL SELECT '<http://ex/name>', 'out' UNION ALL SELECT '<http://ex/size>', 'out'")
def schema_context(spark, sf_dir):
    from .qa.linking import schema_context as context

    quads = geo_store(spark, sf_dir).quads.withColumn("g", F.lit(None).cast("string"))
    got = context(quads, [e("nation/3")], []).entities[e("nation/3")]
    return spark.createDataFrame([(p, "out") for p in got["out"]] + [(p, "in") for p in got["into"]], "predicate string, side string")


@query("SELECT n_name AS text FROM nation WHERE n_nationkey = 7")
def link_relax(spark, sf_dir):
    from .qa.linking import Linker

    name = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey = 7").first()["n_name"]
    linker = Linker(geo_store(spark, sf_dir).quads, label="<http://ex/name>")
    return spark.createDataFrame([(linker.link_mention(name.lower(), 1)[0].text,)], "text string")


@query("""WITH p AS (SELECT DISTINCT quality AS k, doc_id AS v FROM labels WHERE toxic = 1), g AS (SELECT DISTINCT quality AS k, doc_id AS v FROM labels WHERE doc_id % 3 = 0),
s AS (SELECT coalesce(p.k, g.k) AS k, count(p.v) AS np, count(g.v) AS ng, count(CASE WHEN p.v IS NOT NULL AND g.v IS NOT NULL THEN 1 END) AS hit FROM p FULL OUTER JOIN g ON p.k = g.k AND p.v = g.v GROUP BY 1)
SELECT k, CASE WHEN np > 0 THEN hit / np ELSE 0.0 END AS precision, CASE WHEN ng > 0 THEN hit / ng ELSE 0.0 END AS recall, CASE WHEN hit > 0 THEN 2.0::DOUBLE * hit / (np + ng) ELSE 0.0 END AS f1 FROM s""")
def eval_prf1(spark, sf_dir):
    from .qa.evaluate import prf1_frame

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("quality").alias("k"), F.col("doc_id").alias("v"), "toxic")
    return prf1_frame(labels.where("toxic = 1"), labels.where("v % 3 = 0"), "k", "v")
