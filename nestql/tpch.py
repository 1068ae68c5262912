"""Entities over the driver's tables."""

from __future__ import annotations

from nestql.model import Column, Entity, EnumType, HasMany, HasOne, RootField
from nestql.schema import Schema

OrderStatus = EnumType("OrderStatus", (("OPEN", "O"), ("FINISHED", "F"), ("PENDING", "P")))


def c(name: str, kind="String", **more) -> Column:
    return Column(name, kind, **more)


REGION = Entity("Region", "region", (c("r_regionkey", "Int"), c("r_name"), HasMany("nations", "Nation", "n_regionkey")), ("r_regionkey",))
NATION = Entity(
    "Nation",
    "nation",
    (c("n_nationkey", "Int"), c("n_name"), c("n_regionkey", "Int"), HasOne("region", "Region", "Int", "n_regionkey"), HasMany("customers", "Customer", "c_nationkey"), HasMany("suppliers", "Supplier", "s_nationkey")),
    ("n_nationkey",),
)
CUSTOMER = Entity(
    "Customer",
    "customer",
    (c("c_custkey", "BigInt"), c("c_name"), HasOne("nation", "Nation", "Int", "c_nationkey"), c("c_acctbal", "Double"), c("c_mktsegment"), HasMany("orders", "Order", "o_custkey"), HasMany("events", "Event", "user_id")),
    ("c_custkey",),
)
SUPPLIER = Entity("Supplier", "supplier", (c("s_suppkey", "BigInt"), c("s_name"), HasOne("nation", "Nation", "Int", "s_nationkey"), c("s_acctbal", "Double"), HasMany("lineitems", "Lineitem", "l_suppkey")), ("s_suppkey",))
PART = Entity("Part", "part", (c("p_partkey", "BigInt"), c("p_name"), c("p_brand"), c("p_type"), c("p_size", "Int"), c("p_retailprice", "Double"), HasMany("lineitems", "Lineitem", "l_partkey")), ("p_partkey",))
ORDER = Entity(
    "Order",
    "orders",
    (
        c("o_orderkey", "BigInt"),
        HasOne("customer", "Customer", "BigInt", "o_custkey"),
        c("o_orderstatus"),
        Column("status", OrderStatus, "o_orderstatus"),
        c("o_totalprice", "Double"),
        c("o_orderdate", "NaiveDateTime"),
        c("o_orderpriority"),
        HasMany("lineitems", "Lineitem", "l_orderkey"),
    ),
    ("o_orderkey",),
)
#: Its order and line number don't identify a row in these tables.
LINEITEM = Entity(
    "Lineitem",
    "lineitem",
    (
        HasOne("order", "Order", "BigInt", "l_orderkey"),
        HasOne("part", "Part", "BigInt", "l_partkey"),
        HasOne("supplier", "Supplier", "BigInt", "l_suppkey"),
        c("l_linenumber", "Int"),
        c("l_quantity", "Double"),
        c("l_extendedprice", "Double"),
        c("l_discount", "Double"),
        c("l_tax", "Double"),
        c("l_returnflag"),
        c("l_linestatus"),
        c("l_shipdate", "NaiveDateTime"),
    ),
    ("l_orderkey", "l_linenumber"),
    unique=False,
)
EVENT = Entity("Event", "events", (c("event_id", "BigInt"), c("ts", "NaiveDateTime"), HasOne("user", "Customer", "BigInt", "user_id"), c("event_type"), c("value", "Double"), c("props")), ("event_id",))
DOCUMENT = Entity("Document", "documents", (c("doc_id", "BigInt"), c("text", nullable=True), c("lang", nullable=True), c("source", nullable=True), c("n_chars", "BigInt", nullable=True), HasMany("labels", "Label", "doc_id")), ("doc_id",))
LABEL = Entity("Label", "labels", (c("doc_id", "BigInt"), HasOne("document", "Document", "BigInt", "doc_id"), c("quality", "Int"), c("toxic", "Int")), ("doc_id",))
EMBEDDING = Entity("Embedding", "embeddings", (c("vec_id", "BigInt"), c("embedding", "[Float]"), c("label", "Int")), ("vec_id",))
PAGE = Entity("Page", "pages", (c("page_id", "BigInt"), c("url"), c("html")), ("page_id",))
BENCHMARK = Entity("BenchmarkItem", "benchmark", (c("item_id", "BigInt"), c("text")), ("item_id",))
MESSAGE = Entity("Message", "conversations", (c("conv_id", "BigInt"), c("turn", "BigInt"), c("role"), c("text")), ("conv_id", "turn"))

ENTITIES = (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, LINEITEM, EVENT, DOCUMENT, LABEL, EMBEDDING, PAGE, BENCHMARK, MESSAGE)


def schema(mutations=(), entities=ENTITIES) -> Schema:
    return Schema(entities, [RootField(e.name, lookup=e.unique) for e in entities], mutations)
