"""The reference queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestql import tpch
from nestql.engine import Engine
from nestql.model import HasMany, Mutation, OwnFilter
from nestql.operators.ordering import window
from nestql.plans.planner import Loading
from nestql.plans.predicate import Custom
from nestql.schema import inputs_of
from nestql.sources.catalog import DerivedCatalog, ParquetCatalog
from nestql.sources.scratch import scratch_path
from nestql.sources.store import VersionedStore

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FLAGSHIP = """
{ Customers(filter: {nation: {region: {r_name: {eq: "ASIA"}}}}, order: [{column: c_custkey}], limit: 10) {
    c_custkey c_name
    nation { n_name region { r_name } }
    orders(filter: {o_orderstatus: {eq: "F"}}) { o_orderkey o_totalprice }
} }
"""


def engine(spark: SparkSession, sf_dir: str, **more) -> Engine:
    return Engine(ParquetCatalog(spark, sf_dir), tpch.schema(), **more)


def _graph(text: str, shape: Callable[[DataFrame], DataFrame] | None, variables: dict | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = engine(spark, sf_dir).dataframe(text, variables=variables)
    return shape(df) if shape else df


def graph(name: str, text: str, sql: str, shape: Callable[[DataFrame], DataFrame] | None = None, variables: dict | None = None) -> None:
    """Register a query given as a document; ``shape`` flattens nested results."""
    QUERIES[name] = partial(_graph, text, shape, variables)
    SQL[name] = sql


def other(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def columns(**paths: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*[F.col(p).alias(n) for n, p in paths.items()])


def exploded(array: str, *flat: str, outer: bool = True, **paths: str) -> Callable[[DataFrame], DataFrame]:
    """A row for each element of an array; its members by ``paths`` from ``x``."""

    def shape(df: DataFrame) -> DataFrame:
        rows = df.select(*flat, (F.explode_outer if outer else F.explode)(array).alias("x"))
        return rows.select(*[f.split(".")[-1] for f in flat], *[F.col(p).alias(n) for n, p in paths.items()])

    return shape


# -- projections ---------------------------------------------------------------
graph("scan_project", "{ Nations { n_nationkey n_name } }", "SELECT n_nationkey, n_name FROM nation")
graph("alias_project", "{ Nations { id: n_nationkey label: n_name } }", "SELECT n_nationkey AS id, n_name AS label FROM nation")
graph("extra_alias_twice", "{ Nations { a: n_name b: n_name n_nationkey } }", "SELECT n_name AS a, n_name AS b, n_nationkey FROM nation")
graph("array_column", "{ Embeddings { vec_id embedding label } }", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE))::DECIMAL(18, 4)::VARCHAR AS total, len(embedding)::INTEGER AS n, label FROM embeddings", lambda df: df.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("decimal(18,4)").cast("string").alias("total"), F.size("embedding").alias("n"), "label"))
graph("enum_project", "{ Orders { o_orderkey status } }", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FINISHED' WHEN 'P' THEN 'PENDING' END AS status FROM orders")
graph("typename", "{ Nations { __typename n_nationkey } }", "SELECT 'Nation' AS __typename, n_nationkey FROM nation")

# -- filters -------------------------------------------------------------------
graph("filter_eq", '{ Customers(filter: {c_mktsegment: {eq: "BUILDING"}}) { c_custkey c_name } }', "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
graph("filter_not_eq", '{ Orders(filter: {o_orderstatus: {not_eq: "O"}}) { o_orderkey o_orderstatus } }', "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
graph("filter_eq_any", "{ Nations(filter: {n_regionkey: {eq_any: [1, 3]}}) { n_nationkey n_name } }", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
graph("filter_eq_any_empty", "{ Nations(filter: {n_regionkey: {eq_any: []}}) { n_nationkey n_name } }", "SELECT n_nationkey, n_name FROM nation WHERE false")
graph("filter_like", '{ Parts(filter: {p_name: {like: "%a%e%"}}) { p_partkey p_name } }', "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%'")
graph("filter_same_col_and", '{ Parts(filter: {p_brand: {not_eq: "Brand#2", like: "Brand%"}, p_size: {eq_any: [1, 2, 3, 4, 5]}}) { p_partkey p_brand p_size } }', "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand <> 'Brand#2' AND p_brand LIKE 'Brand%' AND p_size IN (1, 2, 3, 4, 5)")
graph("filter_and", '{ Customers(filter: {and: [{c_mktsegment: {eq: "BUILDING"}}, {}, {c_name: {like: "%1"}}]}) { c_custkey c_name } }', "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE '%1'")
graph("filter_or", '{ Customers(filter: {or: [{c_mktsegment: {eq: "BUILDING"}}, {}, {c_name: {like: "%1"}}]}) { c_custkey c_name } }', "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name LIKE '%1'")
graph("filter_not", '{ Customers(filter: {not: {c_mktsegment: {eq: "BUILDING"}}}) { c_custkey c_name } }', "SELECT c_custkey, c_name FROM customer WHERE NOT c_mktsegment = 'BUILDING'")
graph(
    "filter_combined",
    '{ Orders(filter: {and: [{o_orderpriority: {like: "%U%"}}], or: [{o_orderstatus: {eq: "F"}}, {o_orderstatus: {eq: "P"}}], not: {o_orderkey: {eq_any: [1, 2, 3]}}, o_orderstatus: {not_eq: "P"}}) { o_orderkey o_orderstatus } }',
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '%U%' AND (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT o_orderkey IN (1, 2, 3) AND o_orderstatus <> 'P'",
)
graph("filter_timestamp_eq", '{ Orders(filter: {o_orderdate: {eq: "1995-03-15T00:00:00"}}) { o_orderkey o_orderdate } }', "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = TIMESTAMP '1995-03-15 00:00:00'")
graph("filter_double_eq", "{ Lineitems(filter: {l_discount: {eq: 0.05}, l_quantity: {eq: 10}}) { l_linenumber l_quantity l_discount } }", "SELECT l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_discount = 0.05::DOUBLE AND l_quantity = 10")
def _tagged(spark: SparkSession, sf_dir: str) -> Engine:
    """Parts with an array column: their size and its half."""
    views = DerivedCatalog(ParquetCatalog(spark, sf_dir), {"part": lambda df: df.withColumn("sizes", F.array(F.col("p_size"), F.floor(F.col("p_size") / 2).cast("int")))})
    entities = tuple(replace(e, fields=(*e.fields, tpch.c("sizes", "[Int]"))) if e is tpch.PART else e for e in tpch.ENTITIES)
    return Engine(views, tpch.schema(entities=entities))


for _name, _op, _sql in (("eq", "eq: [7, 3]", "= [7, 3]"), ("not_eq", "not_eq: [7, 3]", "<> [7, 3]"), ("eq_any", "eq_any: [[7, 3], [10, 5], [1, 2]]", "IN ([7, 3], [10, 5], [1, 2])")):
    other(f"array_{_name}", f"SELECT p_partkey FROM part WHERE [p_size, p_size // 2] {_sql}")(lambda spark, sf_dir, op=_op: _tagged(spark, sf_dir).dataframe(f"{{ Parts(filter: {{sizes: {{{op}}}}}) {{ p_partkey }} }}"))

graph("filter_bool_none", "{ a: Nations(filter: null) { n_nationkey } }", "SELECT n_nationkey FROM nation")
graph("filter_empty", "{ Nations(filter: {n_name: {}, and: [], or: [{}], not: {}}) { n_nationkey } }", "SELECT n_nationkey FROM nation")
graph("enum_filter", "{ Orders(filter: {status: {eq_any: [OPEN, PENDING]}}) { o_orderkey o_orderstatus } }", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
graph(
    "fragment_variables",
    'query Q($seg: String!, $keys: [BigInt!] = [1, 2, 3, 4, 5], $no: Boolean = false) { Customers(filter: {or: [{c_mktsegment: {eq: $seg}}, {c_custkey: {eq_any: $keys}}]}) { ...f c_acctbal @include(if: $no) ... on Customer { c_mktsegment } } } fragment f on Customer { c_custkey label: c_name }',
    "SELECT c_custkey, c_name AS label, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_custkey IN (1, 2, 3, 4, 5)",
    variables={"seg": "MACHINERY"},
)


def _with_nulls(spark: SparkSession, sf_dir: str) -> Engine:
    """Customers whose segment and nation are null in places."""
    base = ParquetCatalog(spark, sf_dir)
    seg = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    nation = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    views = DerivedCatalog(base, {"customer": lambda df: df.withColumns({"c_mktsegment": seg, "c_nationkey": nation})})
    fields = tuple(replace(f, nullable=True) if f.name in ("c_mktsegment", "nation") else f for f in tpch.CUSTOMER.fields)
    entities = tuple(replace(e, fields=fields) if e is tpch.CUSTOMER else e for e in tpch.ENTITIES)
    return Engine(views, tpch.schema(entities=entities))


_NULLS = "WITH customer AS (SELECT * REPLACE (CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS c_nationkey) FROM main.customer) "


def nulls(name: str, text: str, sql: str, shape=None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _with_nulls(spark, sf_dir).dataframe(text)
        return shape(df) if shape else df

    other(name, _NULLS + sql)(run)


nulls("filter_is_null", "{ Customers(filter: {c_mktsegment: {is_null: true}}) { c_custkey } }", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL")
nulls("filter_not_null", "{ Customers(filter: {c_mktsegment: {is_null: false}}) { c_custkey } }", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL")
nulls("filter_null_logic", '{ Customers(filter: {not: {c_mktsegment: {eq: "MACHINERY"}}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE NOT c_mktsegment = 'MACHINERY'")
nulls("filter_nullable_like", '{ Customers(filter: {c_mktsegment: {like: "M%"}}) { c_custkey c_mktsegment } }', "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'M%'")
nulls("rel_nullable", '{ Customers(filter: {nation: {n_name: {like: "%A%"}}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%')")
nulls("rel_nullable_is_null", "{ Customers(filter: {nation: {is_null: true}}) { c_custkey } }", "SELECT c_custkey FROM customer WHERE c_nationkey IS NULL")
nulls("rel_not_in_null_keys", '{ Nations(filter: {not: {customers: {c_acctbal: {not_eq: 0.0}}}}) { n_nationkey } }', "SELECT n_nationkey FROM nation WHERE NOT n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal <> 0)")
nulls("rel_not_in_null_rows", '{ Customers(filter: {not: {nation: {n_name: {like: "%A%"}}}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE NOT c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%')")
nulls("rel_not_in_nothing", '{ Customers(filter: {not: {nation: {n_name: {eq: "no such"}}}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE NOT c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'no such')")
nulls("nest_nullable", "{ Customers { c_custkey nation { n_name } } }", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", columns(c_custkey="c_custkey", n_name="nation.n_name"))

# -- order of nulls --------------------------------------------------------------
for _way in ("ASC", "DESC"):
    for _first in (False, True):

        def _ordered(spark: SparkSession, sf_dir: str, way: str = _way, first: bool = _first) -> DataFrame:
            e = _with_nulls(spark, sf_dir)
            e.nulls_first = first
            return e.dataframe(f"{{ Customers(order: [{{column: c_mktsegment, direction: {way}}}, {{column: c_custkey, direction: DESC}}], limit: 40, offset: 3) {{ c_custkey c_mktsegment }} }}")

        _place = "FIRST" if _first == (_way == "ASC") else "LAST"
        other(f"order_nulls_{_way.lower()}_{'smallest' if _first else 'largest'}", _NULLS + f"SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment {_way} NULLS {_place}, c_custkey DESC LIMIT 40 OFFSET 3")(_ordered)

# -- relation filters ----------------------------------------------------------
graph("rel_has_one", '{ Customers(filter: {nation: {n_regionkey: {eq: 2}}}) { c_custkey c_name } }', "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
graph("rel_two_hop", '{ Customers(filter: {nation: {region: {r_name: {eq: "ASIA"}}}}) { c_custkey c_name } }', "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))")
graph("rel_has_many", '{ Customers(filter: {orders: {o_orderstatus: {eq: "F"}}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
graph("rel_not_in", '{ Customers(filter: {not: {orders: {o_orderstatus: {eq: "F"}}}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE NOT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
graph("rel_or_mixed", '{ Customers(filter: {or: [{c_mktsegment: {eq: "BUILDING"}}, {nation: {n_regionkey: {eq: 1}}}]}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
graph("rel_not_or", '{ Customers(filter: {not: {or: [{c_mktsegment: {eq: "BUILDING"}}, {orders: {o_orderstatus: {eq: "P"}}}]}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))")
graph("rel_negative_leaf", '{ Customers(filter: {orders: {o_orderstatus: {not_eq: "F"}}}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
graph("rel_deep", '{ Regions(filter: {nations: {customers: {orders: {lineitems: {part: {p_size: {eq: 7}}}}}}}) { r_name } }', "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)))))")

# -- order, limit, offset, lookup ------------------------------------------------
graph("order_asc", "{ Customers(order: [{column: c_acctbal}, {column: c_custkey}], limit: 20) { c_custkey c_acctbal } }", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
graph("order_desc", "{ Customers(order: [{column: c_acctbal, direction: DESC}], limit: 20) { c_custkey c_acctbal } }", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
graph("order_multi", "{ Orders(order: [{column: o_orderstatus, direction: DESC}, {column: customer}, {column: o_orderkey, direction: DESC}], limit: 50) { o_orderkey } }", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_custkey, o_orderkey DESC LIMIT 50")
graph("limit", "{ Orders(limit: 7) { o_orderkey } }", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
graph("offset", "{ Customers(offset: 100, order: [{column: c_custkey}]) { c_custkey } }", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
graph("limit_offset", "{ Orders(offset: 10, limit: 5, order: [{column: o_orderkey}]) { o_orderkey } }", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
graph("lookup_pk", "{ Order(primaryKey: {o_orderkey: 1}) { o_orderkey o_totalprice customer { c_name } } }", "SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 1", columns(o_orderkey="o_orderkey", o_totalprice="o_totalprice", c_name="customer.c_name"))
graph("lookup_pk_missing", "{ Order(primaryKey: {o_orderkey: -1}) { o_orderkey } }", "SELECT o_orderkey FROM orders WHERE o_orderkey = -1")
graph("lookup_pk_composite", "{ Message(primaryKey: {conv_id: 1, turn: 0}) { conv_id turn role text } }", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 1 AND turn = 0")

# -- nesting -------------------------------------------------------------------
graph("nest_has_one", "{ Nations { n_name region { r_name } } }", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey", columns(n_name="n_name", r_name="region.r_name"))
graph("nest_two_level", "{ Customers { c_custkey nation { n_name region { r_name } } } }", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", columns(c_custkey="c_custkey", n_name="nation.n_name", r_name="nation.region.r_name"))
graph("nest_has_many", "{ Regions { r_name nations { n_name } } }", "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey", exploded("nations", "r_name", n_name="x.n_name"))
graph("nest_has_many_filtered", '{ Regions { r_name nations(filter: {n_name: {like: "%A"}}) { n_name } } }', "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name LIKE '%A'", exploded("nations", "r_name", n_name="x.n_name"))
graph(
    "nest_multi",
    "{ Nations { n_name customers { c_custkey } suppliers { s_suppkey } } }",
    "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::INTEGER AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::INTEGER AS n_suppliers FROM nation",
    lambda df: df.select("n_name", F.size("customers").alias("n_customers"), F.size("suppliers").alias("n_suppliers")),
)
graph(
    "nest_after_limit",
    "{ Customers(order: [{column: c_acctbal, direction: DESC}], limit: 5) { c_custkey orders { o_orderkey o_totalprice } } }",
    "WITH top AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) SELECT c_custkey, o_orderkey, o_totalprice FROM top LEFT JOIN orders ON o_custkey = c_custkey",
    exploded("orders", "c_custkey", o_orderkey="x.o_orderkey", o_totalprice="x.o_totalprice"),
)
graph(
    "nest_list_order",
    '{ Customers(filter: {c_mktsegment: {eq: "BUILDING"}}) { c_custkey orders { o_orderkey } } }',
    "SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey",
    lambda df: df.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("keys")),
)
graph(
    "nest_three_lists",
    "{ Regions { r_name nations { n_name customers(filter: {c_mktsegment: {eq: \"BUILDING\"}}) { c_custkey } } } }",
    "SELECT r_name, n_name, count(c_custkey)::INTEGER AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY ALL",
    lambda df: df.select("r_name", F.explode("nations").alias("x")).select("r_name", "x.n_name", F.size("x.customers").alias("n")),
)
graph(
    "nest_cycle",
    "{ Nations(filter: {n_nationkey: {eq: 3}}) { n_name region { nations { n_name } } } }",
    "SELECT a.n_name AS n_name, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey = 3",
    lambda df: df.select("n_name", F.explode("region.nations").alias("x")).select("n_name", F.col("x.n_name").alias("other")),
)
graph("nest_labels", "{ Documents(filter: {labels: {toxic: {eq: 1}}}) { doc_id labels { quality } } }", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE toxic = 1", exploded("labels", "doc_id", quality="x.quality"))

# -- shapes of the published benchmark -------------------------------------------
graph(
    "bench_list_list_one_all",
    "{ Customers { c_custkey c_name orders { o_orderkey lineitems { l_linenumber part { p_name } } } } }",
    "SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::INTEGER AS n_orders, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = c_custkey)::INTEGER AS n_parts FROM customer",
    lambda df: df.select("c_custkey", "c_name", F.size("orders").alias("n_orders"), F.aggregate("orders", F.lit(0), lambda a, o: a + F.size(F.filter(o["lineitems"], lambda x: x["part"]["p_name"].isNotNull()))).alias("n_parts")),
)
graph(
    "bench_list_list_one_some",
    "{ Customers(filter: {nation: {n_nationkey: {eq: 7}}}) { c_custkey c_name orders { o_orderkey lineitems { l_linenumber part { p_name } } } } }",
    "SELECT c_custkey, o_orderkey, l_linenumber, p_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_nationkey = 7",
    lambda df: df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey", F.explode("o.lineitems").alias("l")).select("c_custkey", "o_orderkey", "l.l_linenumber", F.col("l.part.p_name").alias("p_name")),
)
graph("bench_one_all", "{ Orders { o_orderkey o_totalprice customer { c_name } } }", "SELECT o_orderkey, o_totalprice, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", columns(o_orderkey="o_orderkey", o_totalprice="o_totalprice", c_name="customer.c_name"))
graph(
    "bench_one_some",
    '{ Lineitems(filter: {l_returnflag: {eq: "R"}}) { l_quantity order { o_orderdate } part { p_name } } }',
    "SELECT l_quantity, o_orderdate, p_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'",
    columns(l_quantity="l_quantity", o_orderdate="order.o_orderdate", p_name="part.p_name"),
)
graph("bench_two_hop", '{ Customers(filter: {orders: {lineitems: {l_returnflag: {eq: "R"}}}}) { c_custkey c_name } }', "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
graph("bench_key", "{ Customers(filter: {c_custkey: {eq: 3}}) { c_custkey c_name } }", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 3")

BENCH = [n for n in QUERIES if n.startswith("bench_")]


# -- mutations -----------------------------------------------------------------
def _writable(spark: SparkSession, sf_dir: str, entities=tpch.ENTITIES) -> Engine:
    """An engine over a store of its own, to which the tables are attached where they lie."""
    store = VersionedStore(spark, scratch_path(spark, "store"))
    tx = store.begin()
    for name in ("region", "nation", "customer", "orders"):
        tx.attach(name, f"{sf_dir}/{name}.parquet")
    tx.commit()
    changed = [e for e in entities if e.name in ("Nation", "Region")]
    mutations = [Mutation(e.name, inputs_of(e, keys=False), None, inputs_of(e, keys=True)) for e in changed]
    return Engine(store, tpch.schema(mutations, entities))


def _done(e: Engine, text: str) -> dict:
    out = e.execute(text)
    if "errors" in out:
        raise RuntimeError(str(out["errors"]))
    return out["data"]


def mutation(name: str, text: str, table: str, sql: str, entities=tpch.ENTITIES) -> None:
    """The table after a mutation."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _writable(spark, sf_dir, entities)
        _done(e, text)
        return e.catalog.table(table)

    other(name, sql)(run)


mutation("mut_insert", 'mutation { CreateNation(NewNation: {nName: "ATLANTIS", nRegionkey: 2}) { n_nationkey n_name region { r_name } } }', "nation", "SELECT * FROM nation UNION ALL SELECT max(n_nationkey) + 1, 'ATLANTIS', 2 FROM nation")
mutation("mut_batch", 'mutation { CreateNations(NewNations: [{nName: "A", nRegionkey: 0}, {nName: "B", nRegionkey: 1}]) { n_nationkey } }', "nation", "SELECT * FROM nation UNION ALL SELECT max(n_nationkey) + 1, 'A', 0 FROM nation UNION ALL SELECT max(n_nationkey) + 2, 'B', 1 FROM nation")
mutation("mut_update", 'mutation { UpdateNation(UpdateNation: {nNationkey: 3, nName: "NEW"}) { n_name } }', "nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name, n_regionkey FROM nation")
mutation("mut_delete", "mutation { DeleteNation(DeleteNation: {n_nationkey: 3}) { count } }", "nation", "SELECT * FROM nation WHERE n_nationkey <> 3")

#: Regions take their nations along, and these their customers.
_CASCADING = tuple(replace(e, fields=tuple(replace(f, on_delete="cascade") if f.name in ("nations", "customers") and isinstance(f, HasMany) else f for f in e.fields)) for e in tpch.ENTITIES)
mutation("mut_cascade", "mutation { DeleteRegion(DeleteRegion: {r_regionkey: 2}) { count } }", "customer", "SELECT * FROM customer WHERE NOT c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", _CASCADING)
mutation(
    "mut_several",
    'mutation { CreateNation(NewNation: {nName: "X", nRegionkey: 4}) { n_nationkey } UpdateNation(UpdateNation: {nNationkey: 7, nName: "SEVEN"}) { n_name } DeleteNation(DeleteNation: {n_nationkey: 1}) { count } b: UpdateNation(UpdateNation: {nNationkey: 7, nRegionkey: 0}) { n_name } }',
    "nation",
    "SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'SEVEN' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 7 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT max(n_nationkey) + 1, 'X', 4 FROM nation",
)


@other("delete_count", "SELECT count(*)::BIGINT AS n FROM nation WHERE n_nationkey = 3")
def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _done(_writable(spark, sf_dir), "mutation { DeleteNation(DeleteNation: {n_nationkey: 3}) { count } }")["DeleteNation"]["count"]
    return spark.createDataFrame([(n,)], "n long")


# -- documents with several root fields, and hooks -------------------------------
@other("multi_root", "SELECT 'nation' AS kind, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region WHERE r_regionkey IN (1, 2)")
def multi_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    text = "{ all: Nations { name: n_name } some: Regions(filter: {r_regionkey: {eq_any: [1, 2]}}) { name: r_name } }"
    frames = [e.dataframe(text, root=root).select(F.lit(kind).alias("kind"), "name") for root, kind in (("all", "nation"), ("some", "region"))]
    return frames[0].unionByName(frames[1])


class _ByRevenue(Loading):
    """Orders come dearest first, and never more than 25 of them."""

    def order(self, planner, q):
        return q.order or [("o_totalprice", True), ("o_orderkey", False)]

    def windowed(self, planner, q, df, order):
        return window(df, order, q.offset, min(q.limit or 25, 25), planner.nulls_first)

    def narrowed(self, q):
        return True


@other("loading_override", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def loading_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = tuple(replace(e, loading=_ByRevenue()) if e.name == "Order" else e for e in tpch.ENTITIES)
    e = Engine(ParquetCatalog(spark, sf_dir), tpch.schema(entities=entities))
    return e.dataframe('{ Orders(filter: {o_orderstatus: {eq: "F"}}) { o_orderkey customer { c_name } } }').select("o_orderkey", "customer.c_name")


@other("filter_own", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12")
def filter_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    def between(value):
        low, high = (value.value[k].value for k in ("low", "high"))
        return Custom(lambda: F.col("p_size").between(low, high), f"p_size BETWEEN {low} AND {high}")

    own = {"size_range": OwnFilter(between, "SizeRange", (("low", "Int!"), ("high", "Int!")))}
    entities = tuple(replace(e, extra_filters=own) if e.name == "Part" else e for e in tpch.ENTITIES)
    return Engine(ParquetCatalog(spark, sf_dir), tpch.schema(entities=entities)).dataframe("{ Parts(filter: {size_range: {low: 10, high: 12}}) { p_partkey } }")


@other("query_modifier", "SELECT c_custkey, count(o_orderkey)::INTEGER AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 WHERE c_acctbal > 0 GROUP BY c_custkey")
def query_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rich(entity, context, selection, df):
        return df.filter(F.col("c_acctbal") > context["least"]) if entity.name == "Customer" else df.filter(F.col("o_totalprice") > 100000)

    entities = tuple(replace(e, modifier=rich) if e.name in ("Customer", "Order") else e for e in tpch.ENTITIES)
    e = Engine(ParquetCatalog(spark, sf_dir), tpch.schema(entities=entities), context={"least": 0})
    return e.dataframe("{ Customers { c_custkey orders { o_orderkey } } }").select("c_custkey", F.size("orders").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).dataframe(FLAGSHIP)


@other(
    "flagship",
    """WITH top AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')) ORDER BY c_custkey LIMIT 10)
    SELECT c_custkey, c_name, n_name, r_name, o_orderkey, o_totalprice FROM top JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'""",
)
def flagship_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flagship(spark, sf_dir).select("c_custkey", "c_name", "nation.n_name", "nation.region.r_name", F.explode_outer("orders").alias("x"))
    return df.select("c_custkey", "c_name", "n_name", "r_name", "x.o_orderkey", "x.o_totalprice")
