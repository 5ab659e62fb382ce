"""Queries over the driver's tables, one for each capability, with DuckDB SQL for each."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import exact_ratio, ratio_sort_key
from .memory import Memory
from .operators import index, lifecycle, relate, search, traverse
from .plans import aggregate, compile
from .plans.ir import Predicate, parse_v1, parse_v2
from .sources import files, fragments, jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def tpch(spark: SparkSession, d: str) -> Memory:
    """The star schema as entities and edges. Order priority 4 is an explicit null and 5 is missing."""
    m = Memory(spark, "tpch")
    t = lambda n: table(spark, d, n)
    ascii_ = {"ascii": True}
    m.register_entity("tpch.Region", t("region"), "r_regionkey", {"name": ("string", "r_name", None, ascii_)})
    m.register_entity("tpch.Nation", t("nation"), "n_nationkey", {"name": ("string", "n_name", None, ascii_), "regionkey": ("long", "n_regionkey")})
    m.register_entity("tpch.Customer", t("customer"), "c_custkey", {
        "name": ("string", "c_name", None, ascii_), "segment": ("string", "c_mktsegment", None, ascii_), "cents": ("long", cents("c_acctbal")), "acctbal": ("double", "c_acctbal"),
        "ghost": ("unresolved", F.lit(None)), "key": ("long", "c_custkey"),
    }, privacy=F.when(F.col("c_acctbal") < 0, "private").otherwise("public"))
    m.register_entity("tpch.Supplier", t("supplier"), "s_suppkey", {"name": ("string", "s_name", None, ascii_), "cents": ("long", cents("s_acctbal"))})
    m.register_entity("tpch.Part", t("part"), "p_partkey", {"name": ("string", "p_name", None, ascii_ | {"searchable": True}), "brand": ("string", "p_brand", None, ascii_), "size": ("long", "p_size")})
    prio = F.col("o_orderpriority")
    m.register_entity("tpch.Order", t("orders"), "o_orderkey", {
        "status": ("string", "o_orderstatus", None, ascii_), "cents": ("long", cents("o_totalprice")), "total": ("double", "o_totalprice"),
        "priority": ("string", F.when(prio != "4-NOT SPECIFIED", prio), prio != "5-LOW", ascii_), "custkey": ("long", "o_custkey"),
        "bonus": ("long", F.when(prio != "4-NOT SPECIFIED", F.col("o_custkey") % 7), prio != "5-LOW"),
    })
    edge = lambda n, s, x: t(n).select(F.col(s).alias("source"), F.col(x).alias("target"))
    m.register_relation("in_region", "tpch.Nation", "tpch.Region", edge("nation", "n_nationkey", "n_regionkey"), "nation_region")
    m.register_relation("has_nation", "tpch.Region", "tpch.Nation", edge("nation", "n_regionkey", "n_nationkey"), "region_nation")
    m.register_relation("in_nation", "tpch.Customer", "tpch.Nation", edge("customer", "c_custkey", "c_nationkey"), "customer_nation")
    m.register_relation("in_nation", "tpch.Supplier", "tpch.Nation", edge("supplier", "s_suppkey", "s_nationkey"), "supplier_nation")
    m.register_relation("placed_by", "tpch.Order", "tpch.Customer", edge("orders", "o_orderkey", "o_custkey"), "order_customer")
    urgent = t("orders").filter(prio == "1-URGENT").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    m.register_relation("placed_by", "tpch.Order", "tpch.Customer", urgent, "urgent_customer")
    m.register_relation("contains", "tpch.Order", "tpch.Part", edge("lineitem", "l_orderkey", "l_partkey").distinct(), "order_part")
    return m


#: The entities' SQL counterparts.
O_ = "(SELECT o_orderkey AS id, o_custkey AS custkey, o_orderstatus AS status, CAST(ROUND(o_totalprice*100) AS BIGINT) AS cents, o_totalprice AS total, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN NULL ELSE o_orderpriority END AS priority, o_orderpriority <> '5-LOW' AS pp, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN NULL ELSE o_custkey % 7 END AS bonus FROM orders)"
C_ = "(SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(ROUND(c_acctbal*100) AS BIGINT) AS cents, c_acctbal AS acctbal, c_nationkey FROM customer)"
_KIND = "CASE WHEN priority IS NOT NULL THEN 'value' WHEN pp THEN 'null' ELSE 'missing' END"


def _ratio_sql(n: str, d: str) -> str:
    """n/d with 12 places, half-even, of non-negative integers."""
    f = f"((CAST({n} AS HUGEINT)*1000000000000)//NULLIF({d},0))"
    t = f"((CAST({n} AS HUGEINT)*1000000000000)%NULLIF({d},0))"
    r = f"({f}+CASE WHEN 2*{t}>{d} OR (2*{t}={d} AND {f}%2=1) THEN 1 ELSE 0 END)"
    return f"(CAST({r}//1000000000000 AS VARCHAR)||'.'||lpad(CAST({r}%1000000000000 AS VARCHAR),12,'0'))"


def _v1(name: str, nodes: dict, edges: list, where: list, returns, sql: str, order=(), limit=1000, offset=0) -> None:
    doc = {
        "query_ir_version": "1", "match": {"nodes": [{"type": t, "as": a} for a, t in nodes.items()], "edges": [dict(zip(("type", "from", "to", "logical_key"), e)) for e in edges]},
        "where": [_where(*w) for w in where], "return": [{"count": True}] if returns == "count" else [{"field": f} for f in returns], "order_by": [{"field": f, "direction": x} for f, x in order],
    } | ({} if returns == "count" else {"limit": limit, "offset": offset})
    QUERIES[name] = lambda spark, d: compile.run_v1(tpch(spark, d), parse_v1(doc))
    SQL[name] = sql


def _where(field: str, op: str, *value) -> dict:
    right = {} if op == "exists" else {"right": {"values": list(value)}} if op == "in" else {"right": {"value": value[0]}}
    return {"left": {"field": field}, "op": op} | right


def _v2(name: str, doc: dict, sql: str) -> None:
    doc = {"query_ir_version": "2"} | doc
    QUERIES[name] = lambda spark, d: compile_v2(spark, d, doc)
    SQL[name] = sql


def compile_v2(spark: SparkSession, d: str, doc: dict) -> DataFrame:
    return aggregate.run_v2(tpch(spark, d), parse_v2(doc))


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CUSTOMER, ORDER = {"c": "tpch.Customer"}, {"o": "tpch.Order"}
_OB = "o.id AS b_o"


def _o(where: str, cols: str = "", order: str = "") -> str:
    return f"SELECT {_OB}{cols} FROM {O_} o WHERE {where} ORDER BY {order}o.id LIMIT 1001"


# -- scans, projections, predicates --------------------------------------------------------------------
_v1("v1_scan_project", CUSTOMER, [], [("c.segment", "eq", "BUILDING")], ["c.name", "c.segment"], f"SELECT c.id AS b_c, c.name AS c_name, true AS c_name_present, c.segment AS c_segment, true AS c_segment_present FROM {C_} c WHERE c.segment = 'BUILDING' ORDER BY lower(c.name), c.name, c.id LIMIT 1001", order=[("c.name", "asc")])
_v1("v1_project_missing_null", ORDER, [], [], ["o.priority", "o.bonus"], _o("true", ", o.priority AS o_priority, o.pp AS o_priority_present, o.bonus AS o_bonus, o.pp AS o_bonus_present"))
_v1("v1_eq", ORDER, [], [("o.priority", "eq", "2-HIGH")], "count", f"SELECT count(*) AS count FROM {O_} WHERE priority = '2-HIGH'")
_v1("v1_eq_null", ORDER, [], [("o.priority", "eq", None)], "count", f"SELECT count(*) AS count FROM {O_} WHERE pp AND priority IS NULL")
_v1("v1_ne", ORDER, [], [("o.priority", "ne", "2-HIGH")], "count", f"SELECT count(*) AS count FROM {O_} WHERE pp AND priority IS DISTINCT FROM '2-HIGH'")
_v1("v1_ne_null", ORDER, [], [("o.priority", "ne", None)], "count", f"SELECT count(*) AS count FROM {O_} WHERE priority IS NOT NULL")
_v1("v1_in", ORDER, [], [("o.priority", "in", "1-URGENT", "2-HIGH")], ["o.priority"], _o("priority IN ('1-URGENT','2-HIGH')", ", o.priority AS o_priority, o.pp AS o_priority_present"))
_v1("v1_in_null", ORDER, [], [("o.priority", "in", None, "2-HIGH")], "count", f"SELECT count(*) AS count FROM {O_} WHERE pp AND (priority IS NULL OR priority = '2-HIGH')")
_v1("v1_exists", ORDER, [], [("o.priority", "exists")], "count", f"SELECT count(*) AS count FROM {O_} WHERE pp")
_v1("v1_range_num", ORDER, [], [("o.cents", "gte", 30000000), ("o.total", "lt", 400000)], ["o.cents"], _o("cents >= 30000000 AND total < 400000", ", o.cents AS o_cents, true AS o_cents_present"))
_v1("v1_range_str_fold", CUSTOMER, [], [("c.name", "lt", "customer#000000100")], ["c.name"], f"SELECT id AS b_c, name AS c_name, true AS c_name_present FROM {C_} WHERE lower(name) < 'customer#000000100' OR (lower(name) = 'customer#000000100' AND name < 'customer#000000100') ORDER BY id LIMIT 1001")
_v1("v1_and", ORDER, [], [("o.status", "eq", "F"), ("o.priority", "ne", "1-URGENT"), ("o.cents", "lte", 20000000)], "count", f"SELECT count(*) AS count FROM {O_} WHERE status = 'F' AND pp AND priority IS DISTINCT FROM '1-URGENT' AND cents <= 20000000")
_v1("v1_unresolved_empty", CUSTOMER, [], [("c.ghost", "eq", None)], "count", "SELECT CAST(0 AS BIGINT) AS count")
_v1("v1_type_strict_number", ORDER, [], [("o.cents", "in", 17359.0)], "count", "SELECT CAST(0 AS BIGINT) AS count")

# -- joins -----------------------------------------------------------------------------------------------
_OC = ("placed_by", "o", "c", "order_customer")
_v1("v1_edge_join", {"o": "tpch.Order", "c": "tpch.Customer"}, [_OC], [("c.segment", "eq", "MACHINERY")], ["o.cents", "c.name"], f"SELECT o.id AS b_o, c.id AS b_c, o.cents AS o_cents, true AS o_cents_present, c.name AS c_name, true AS c_name_present FROM {O_} o JOIN {C_} c ON o.custkey = c.id WHERE c.segment = 'MACHINERY' ORDER BY o.cents DESC, o.id, c.id LIMIT 1001", order=[("o.cents", "desc")])
_v1("v1_three_hop", {"o": "tpch.Order", "c": "tpch.Customer", "n": "tpch.Nation", "r": "tpch.Region"}, [_OC, ("in_nation", "c", "n"), ("in_region", "n", "r")], [("r.name", "eq", "ASIA"), ("o.priority", "eq", "1-URGENT")], "count", f"SELECT count(*) AS count FROM {O_} o JOIN customer c ON o.custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' AND o.priority = '1-URGENT'")
_v1("v1_reverse_edge", {"c": "tpch.Customer", "o": "tpch.Order"}, [_OC], [("c.cents", "gt", 990000)], ["c.name", "o.status"], f"SELECT c.id AS b_c, o.id AS b_o, c.name AS c_name, true AS c_name_present, o.status AS o_status, true AS o_status_present FROM {C_} c JOIN {O_} o ON o.custkey = c.id WHERE c.cents > 990000 ORDER BY c.id, o.id LIMIT 1001")
_v1("v1_parallel_edges", {"o": "tpch.Order", "c": "tpch.Customer"}, [("placed_by", "o", "c")], [], "count", "SELECT count(*) + count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS count FROM orders")
_v1("v1_logical_key", {"o": "tpch.Order", "c": "tpch.Customer"}, [("placed_by", "o", "c", "urgent_customer")], [], "count", "SELECT count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT'")
_v1("v1_cycle", {"n": "tpch.Nation", "r": "tpch.Region"}, [("in_region", "n", "r"), ("has_nation", "r", "n")], [], ["n.name", "r.name"], "SELECT n_nationkey AS b_n, r_regionkey AS b_r, n_name AS n_name, true AS n_name_present, r_name AS r_name, true AS r_name_present FROM nation JOIN region ON n_regionkey = r_regionkey")
_v1("v1_homomorphism", {"a": "tpch.Nation", "r": "tpch.Region", "b": "tpch.Nation"}, [("in_region", "a", "r"), ("in_region", "b", "r")], [], "count", "SELECT count(*) AS count FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_v1("v1_three_way_parts", {"o": "tpch.Order", "p": "tpch.Part", "c": "tpch.Customer"}, [("contains", "o", "p"), _OC], [("p.size", "gt", 45), ("c.segment", "eq", "HOUSEHOLD")], "count", "SELECT count(*) AS count FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE p_size > 45 AND c_mktsegment = 'HOUSEHOLD'")

# -- order and pages ---------------------------------------------------------------------------------------
_v1("v1_order_fold", {"p": "tpch.Part"}, [], [], ["p.name"], "SELECT p_partkey AS b_p, p_name AS p_name, true AS p_name_present FROM part ORDER BY lower(p_name) DESC, p_name DESC, p_partkey LIMIT 51", order=[("p.name", "desc")], limit=50)
_v1("v1_order_missing_last", ORDER, [], [], ["o.priority"], f"SELECT id AS b_o, priority AS o_priority, pp AS o_priority_present FROM {O_} ORDER BY pp DESC, lower(priority) DESC NULLS LAST, priority DESC NULLS LAST, id LIMIT 901", order=[("o.priority", "desc")], limit=900)
_v1("v1_limit_offset", ORDER, [], [("o.status", "eq", "O")], ["o.total"], f"SELECT id AS b_o, total AS o_total, true AS o_total_present FROM {O_} WHERE status = 'O' ORDER BY total, id LIMIT 101 OFFSET 40", order=[("o.total", "asc")], limit=100, offset=40)

# -- version 2 ---------------------------------------------------------------------------------------------
_CM, _OM = {"nodes": [{"type": "tpch.Customer", "as": "c"}]}, {"nodes": [{"type": "tpch.Order", "as": "o"}]}
_OPT = [{"nodes": [{"type": "tpch.Order", "as": "o"}], "edges": [{"type": "placed_by", "from": "o", "to": "c", "logical_key": "order_customer"}], "where": [_where("o.priority", "in", "1-URGENT", "2-HIGH")]}]
_SEG = [{"field": "c.segment", "as": "segment"}]
_PRI = [{"field": "o.priority", "as": "priority"}]
_JOINED = f"(SELECT c.id AS c, c.segment, c.cents AS ccents, o.id AS o, o.cents AS ocents, o.bonus FROM {C_} c LEFT JOIN (SELECT * FROM {O_} WHERE priority IN ('1-URGENT','2-HIGH')) o ON o.custkey = c.id)"


def m_(name, op, **rest):
    return {"as": name, "op": op} | rest


FLAGSHIP = {
    "match": _CM, "optional_match": _OPT, "group_by": _SEG,
    "measures": [m_("customers", "count_distinct", node="c"), m_("urgent_orders", "count", node="o"), m_("affected", "count_distinct", node="c", when={"bound": "o"}), m_("affected_cents", "sum", field="c.cents", distinct_on="c", when={"bound": "o"})],
    "derive": [{"as": "rate", "op": "ratio", "numerator": "affected", "denominator": "customers", "zero_denominator": "null"}],
    "order_by": [{"result": "rate", "direction": "desc"}, {"result": "segment", "direction": "asc"}],
}
_FLAG_IN = f"SELECT segment, count(DISTINCT c) AS customers, count(o) AS urgent_orders, count(DISTINCT CASE WHEN o IS NOT NULL THEN c END) AS affected FROM {_JOINED} GROUP BY segment"
_FLAG_SUM = f"SELECT segment, CAST(sum(ccents) AS BIGINT) AS affected_cents FROM (SELECT DISTINCT segment, c, ccents FROM {_JOINED} WHERE o IS NOT NULL) GROUP BY segment"
_v2("v2_flagship", FLAGSHIP, f"SELECT 'value' AS segment_kind, a.segment, customers, urgent_orders, affected, COALESCE(affected_cents, 0) AS affected_cents, CAST(0 AS BIGINT) AS affected_cents_skipped, {_ratio_sql('affected', 'customers')} AS rate FROM ({_FLAG_IN}) a LEFT JOIN ({_FLAG_SUM}) b ON a.segment = b.segment")
_v2("v2_optional_match", {"match": _CM, "optional_match": _OPT, "measures": [m_("rows", "count", node="c"), m_("bound", "count", node="o"), m_("free", "count", node="c", when={"unbound": "o"})]}, f"SELECT count(*) AS rows, count(o) AS bound, count(*) FILTER (WHERE o IS NULL) AS free FROM {_JOINED}")
_v2("v2_count", {"match": _CM, "optional_match": _OPT, "group_by": _SEG, "measures": [m_("n", "count", node="o")]}, f"SELECT 'value' AS segment_kind, segment, count(o) AS n FROM {_JOINED} GROUP BY segment")
_v2("v2_count_distinct", {"match": _CM, "optional_match": _OPT, "group_by": _SEG, "measures": [m_("c_n", "count_distinct", node="c"), m_("o_n", "count_distinct", node="o")]}, f"SELECT 'value' AS segment_kind, segment, count(DISTINCT c) AS c_n, count(DISTINCT o) AS o_n FROM {_JOINED} GROUP BY segment")
_v2("v2_sum", {"match": _CM, "optional_match": _OPT, "group_by": _SEG, "measures": [m_("total", "sum", field="c.cents")]}, f"SELECT 'value' AS segment_kind, segment, CAST(sum(ccents) AS BIGINT) AS total, CAST(0 AS BIGINT) AS total_skipped FROM {_JOINED} GROUP BY segment")
_v2("v2_sum_distinct_on", {"match": _CM, "optional_match": _OPT, "group_by": _SEG, "measures": [m_("total", "sum", field="c.cents", distinct_on="c"), m_("orders", "count_distinct", node="o")]}, f"SELECT 'value' AS segment_kind, a.segment, total, CAST(0 AS BIGINT) AS total_skipped, orders FROM (SELECT segment, CAST(sum(cents) AS BIGINT) AS total FROM {C_} GROUP BY segment) a JOIN (SELECT segment, count(DISTINCT o) AS orders FROM {_JOINED} GROUP BY segment) b ON a.segment = b.segment")
_v2("v2_when_bound", {"match": _CM, "optional_match": _OPT, "group_by": _SEG, "measures": [m_("n", "count_distinct", node="c", when={"bound": "o"})]}, f"SELECT 'value' AS segment_kind, segment, count(DISTINCT c) FILTER (WHERE o IS NOT NULL) AS n FROM {_JOINED} GROUP BY segment")
_v2("v2_when_unbound", {"match": _CM, "optional_match": _OPT, "group_by": _SEG, "measures": [m_("n", "count_distinct", node="c", when={"unbound": "o"}), m_("s", "sum", field="c.cents", when={"unbound": "o"})]}, f"SELECT 'value' AS segment_kind, segment, count(DISTINCT c) FILTER (WHERE o IS NULL) AS n, CAST(COALESCE(sum(ccents) FILTER (WHERE o IS NULL), 0) AS BIGINT) AS s, CAST(0 AS BIGINT) AS s_skipped FROM {_JOINED} GROUP BY segment")
_v2("v2_typed_keys", {"match": _OM, "group_by": _PRI, "measures": [m_("n", "count", node="o")]}, f"SELECT {_KIND} AS priority_kind, priority, count(*) AS n FROM {O_} GROUP BY ALL")
_v2("v2_two_keys", {"match": _OM, "group_by": [*_PRI, {"field": "o.status", "as": "status"}], "measures": [m_("n", "count_distinct", node="o"), m_("cents", "sum", field="o.cents")]}, f"SELECT {_KIND} AS priority_kind, priority, 'value' AS status_kind, status, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(0 AS BIGINT) AS cents_skipped FROM {O_} GROUP BY ALL")
_v2("v2_coverage_skipped", {"match": _OM, "group_by": [{"field": "o.status", "as": "status"}], "measures": [m_("bonus", "sum", field="o.bonus")]}, f"SELECT 'value' AS status_kind, status, CAST(COALESCE(sum(bonus), 0) AS BIGINT) AS bonus, count(*) FILTER (WHERE bonus IS NULL) AS bonus_skipped FROM {O_} GROUP BY status")
_v2("v2_optional_sum_skipped", {"match": _CM, "optional_match": [_OPT[0] | {"where": []}], "measures": [m_("bonus", "sum", field="o.bonus", distinct_on="o"), m_("n", "count_distinct", node="c")]}, f"SELECT CAST(sum(bonus) AS BIGINT) AS bonus, count(*) FILTER (WHERE bonus IS NULL) AS bonus_skipped, (SELECT count(*) FROM customer) AS n FROM {O_}")
_v2("v2_global", {"match": _OM, "where": [_where("o.cents", "lt", 0)], "measures": [m_("n", "count", node="o"), m_("s", "sum", field="o.cents")]}, "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS s_skipped")
_v2("v2_empty_grouped", {"match": _OM, "where": [_where("o.cents", "lt", 0)], "group_by": _PRI, "measures": [m_("n", "count", node="o")]}, f"SELECT {_KIND} AS priority_kind, priority, count(*) AS n FROM {O_} WHERE cents < 0 GROUP BY ALL")
_v2("v2_ne_null", {"match": _OM, "where": [_where("o.priority", "ne", None)], "measures": [m_("n", "count", node="o")]}, "SELECT CAST(0 AS BIGINT) AS n")
_v2("v2_ne", {"match": _OM, "where": [_where("o.priority", "ne", "2-HIGH")], "measures": [m_("n", "count", node="o")]}, f"SELECT count(*) AS n FROM {O_} WHERE priority <> '2-HIGH'")
_v2("v2_range_str", {"match": _CM, "where": [_where("c.name", "lt", "customer")], "measures": [m_("n", "count", node="c")]}, f"SELECT count(*) AS n FROM {C_} WHERE name < 'customer'")
_v2("v2_unresolved_null", {"match": _CM, "where": [_where("c.ghost", "eq", None)], "measures": [m_("n", "count", node="c")]}, "SELECT count(*) AS n FROM customer")
_RATIO = [{"as": "share", "op": "ratio", "numerator": "high", "denominator": "orders", "zero_denominator": "null"}]
_BYC = {"match": _CM, "optional_match": [_OPT[0] | {"where": []}], "group_by": [{"field": "c.key", "as": "customer"}], "derive": _RATIO}
_v2("v2_ratio", {"match": _OM, "group_by": [{"field": "o.status", "as": "status"}], "measures": [m_("high", "sum", field="o.bonus"), m_("orders", "count", node="o")], "derive": _RATIO}, f"SELECT 'value' AS status_kind, status, CAST(COALESCE(sum(bonus),0) AS BIGINT) AS high, count(*) FILTER (WHERE bonus IS NULL) AS high_skipped, count(*) AS orders, {_ratio_sql('COALESCE(sum(bonus),0)', 'count(*)')} AS share FROM {O_} GROUP BY status")
_v2("v2_zero_denominator", {"match": _CM, "optional_match": [_OPT[0] | {"where": [_where("o.cents", "lt", 0)]}], "group_by": _SEG, "measures": [m_("high", "count", node="c"), m_("orders", "count", node="o")], "derive": _RATIO}, f"SELECT 'value' AS segment_kind, segment, count(*) AS high, count(o) AS orders, {_ratio_sql('count(*)', 'count(o)')} AS share FROM (SELECT c.segment, o.id AS o FROM {C_} c LEFT JOIN (SELECT * FROM {O_} WHERE cents < 0) o ON o.custkey = c.id) GROUP BY segment")
_PER_C = f"(SELECT c.id AS c, CAST(COALESCE(sum(o.bonus),0) AS BIGINT) AS high, count(o.id) FILTER (WHERE o.bonus IS NULL) AS high_skipped, count(o.id) AS orders FROM {C_} c LEFT JOIN {O_} o ON o.custkey = c.id GROUP BY c.id)"
_v2("v2_order_ratio", _BYC | {"measures": [m_("high", "sum", field="o.bonus"), m_("orders", "count", node="o")], "order_by": [{"result": "share", "direction": "desc"}, {"result": "customer", "direction": "asc"}], "limit": 200}, f"SELECT 'value' AS customer_kind, CAST(c AS VARCHAR) AS customer, high, high_skipped, orders, {_ratio_sql('high', 'orders')} AS share FROM {_PER_C} ORDER BY orders = 0, (CAST(high AS HUGEINT) * 1000000000000000000) // NULLIF(orders,0) DESC, c LIMIT 200")
_v2("v2_page", _BYC | {"measures": [m_("high", "sum", field="o.bonus"), m_("orders", "count", node="o")], "order_by": [{"result": "orders", "direction": "asc"}, {"result": "customer", "direction": "desc"}], "limit": 50, "offset": 30}, f"SELECT 'value' AS customer_kind, CAST(c AS VARCHAR) AS customer, high, high_skipped, orders, {_ratio_sql('high', 'orders')} AS share FROM {_PER_C} ORDER BY orders, c DESC LIMIT 50 OFFSET 30")


@_query("v2_exact_ratio", f"SELECT id AS id, {_ratio_sql('cents', 'custkey')} AS ratio FROM {O_}")
def v2_exact_ratio(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cents("o_totalprice").alias("n"), F.col("o_custkey").alias("d"))
    return o.select("id", exact_ratio(F.col("n"), F.col("d")).alias("ratio"))


@_query("v2_ratio_top", f"SELECT id FROM {O_} ORDER BY (CAST(cents AS HUGEINT) * 1000000000000000000) // NULLIF(custkey,0) DESC NULLS LAST, id LIMIT 300")
def v2_ratio_top(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cents("o_totalprice").alias("n"), F.col("o_custkey").alias("d"))
    return o.orderBy(ratio_sort_key(F.col("n"), F.col("d")).desc(), "id").limit(300).select("id")


# -- bundles, drill-down, metrics, ontology ---------------------------------------------------------------------
_MEMBERS = {
    "totals": {"match": _CM, "optional_match": _OPT, "measures": [m_("customers", "count_distinct", node="c"), m_("affected", "count_distinct", node="c", when={"bound": "o"})]},
    "orders": {"match": _OM, "measures": [m_("all", "count_distinct", node="o")]},
    "urgent": {"match": _OM, "where": [_where("o.priority", "eq", "1-URGENT")], "measures": [m_("all", "count_distinct", node="o")]},
}


@_query("bundle_totals", f"SELECT count(DISTINCT c) AS customers, count(DISTINCT c) FILTER (WHERE o IS NOT NULL) AS affected FROM {_JOINED}")
def bundle_totals(spark: SparkSession, d: str) -> DataFrame:
    members = {n: parse_v2({"query_ir_version": "2"} | q) for n, q in _MEMBERS.items()}
    return aggregate.execute_bundle(tpch(spark, d), members)["totals"]


@_query("bundle_coverage", "SELECT 'population' AS role, count(*) AS value FROM orders UNION ALL SELECT 'attributed', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'")
def bundle_coverage(spark: SparkSession, d: str) -> DataFrame:
    members = {n: parse_v2({"query_ir_version": "2"} | q) for n, q in _MEMBERS.items()}
    return aggregate.coverage_frame(tpch(spark, d), members, {"population": ("orders", "all"), "attributed": ("urgent", "all")})


_SEGMENTS = {"query_ir_version": "2", "match": _CM, "group_by": _SEG, "measures": [m_("n", "count", node="c")]}
_POPULATION = lifecycle.population_hash(_SEGMENTS)


@_query("group_id", f"SELECT 'value' AS segment_kind, c_mktsegment AS segment, count(*) AS n, sha256(CAST(json_object('group_key', json_array(json_object('kind', 'value', 'name', 'segment', 'value', c_mktsegment)), 'population_hash', '{_POPULATION}') AS VARCHAR)) AS group_id FROM customer GROUP BY c_mktsegment")
def group_id(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.identified(tpch(spark, d), parse_v2(_SEGMENTS), _POPULATION)


_MEMBERS_OF = {"query_ir_version": "2", "match": _CM, "optional_match": _OPT, "group_by": _SEG, "measures": [m_("urgent", "count_distinct", node="c", when={"bound": "o"}), m_("s", "sum", field="c.cents", distinct_on="c", when={"unbound": "o"})]}


@_query("capture_membership", f"SELECT 'value' AS segment_kind, segment, CASE WHEN o IS NULL THEN 's' ELSE 'urgent' END AS measure, CAST(c AS VARCHAR) AS node_id, count(*) AS bindings FROM {_JOINED} GROUP BY ALL")
def capture_membership(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.membership(tpch(spark, d), parse_v2(_MEMBERS_OF))


def _drill(name: str, view: str, result: str | None, sql: str) -> None:
    q = parse_v2({"query_ir_version": "2"} | FLAGSHIP)
    QUERIES[name] = lambda spark, d: aggregate.drill(tpch(spark, d), q, {"segment": ("value", "BUILDING")}, view, result)
    SQL[name] = sql


_B = f"{_JOINED} WHERE segment = 'BUILDING'"
_drill("drill_bindings", "bindings", None, f"SELECT c, o FROM {_B}")
_drill("drill_counted_entities", "counted_entities", "urgent_orders", f"SELECT o AS node_id, count(*) AS occurrences FROM {_B} AND o IS NOT NULL GROUP BY o")
_drill("drill_numerator", "numerator", "rate", f"SELECT c AS node_id, count(*) AS occurrences FROM {_B} AND o IS NOT NULL GROUP BY c")
_drill("drill_denominator", "denominator", "rate", f"SELECT c AS node_id, count(*) AS occurrences FROM {_B} GROUP BY c")
_drill("drill_sum_contributions", "contributions", "affected_cents", f"SELECT c AS node_id, max(ccents) AS value, count(*) AS occurrences FROM {_B} AND o IS NOT NULL GROUP BY c")


@_query("metric_current", "SELECT event_type AS definition_version, user_id AS dimensions_hash, event_id AS metric_id, value FROM events WHERE event_id % 11 <> 0 AND event_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id % 5 DESC, event_id DESC) = 1")
def metric_current(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    metrics = e.select(F.col("event_type").alias("definition_version"), F.col("user_id").alias("dimensions_hash"), F.col("ts").alias("recorded_at"), (F.col("event_id") % 5).alias("run_id"), F.col("event_id").alias("metric_id"), "value", F.lit("caller").alias("origin"), (F.col("event_id") % 11 != 0).alias("complete"), (F.col("event_id") % 7 == 0).alias("invalidated"))
    return lifecycle.current_metrics(metrics).select("definition_version", "dimensions_hash", "metric_id", "value")


#: Every field of the registered types: entity type, table, field, JSON type, conditions of presence and of an explicit null.
_PRI_NULL = "o_orderpriority = '4-NOT SPECIFIED'"
_FIELDS = [
    *((f"tpch.{e}", t, f, j, "true", "false") for e, t, fs in (
        ("Region", "region", {"name": "string"}), ("Nation", "nation", {"name": "string", "regionkey": "number"}), ("Customer", "customer", {"name": "string", "segment": "string", "cents": "number", "acctbal": "number", "key": "number"}),
        ("Supplier", "supplier", {"name": "string", "cents": "number"}), ("Part", "part", {"name": "string", "brand": "string", "size": "number"}), ("Order", "orders", {"status": "string", "cents": "number", "total": "number", "custkey": "number"}),
    ) for f, j in fs.items()),
    ("tpch.Customer", "customer", "ghost", "unresolved", "true", "true"), *(("tpch.Order", "orders", f, j, "o_orderpriority <> '5-LOW'", _PRI_NULL) for f, j in (("priority", "string"), ("bonus", "number"))),
]
_STATISTICS = " UNION ALL ".join(f"SELECT '{e}' AS entity_type, '{f}' AS field, '{j}' AS json_type, count(*) AS n_nodes, count(*) FILTER (WHERE {p}) AS n_present, count(*) FILTER (WHERE {z}) AS n_null FROM {t}" for e, t, f, j, p, z in _FIELDS)


@_query("ontology_fields", " UNION ALL ".join(f"SELECT '{e}' AS entity_type, '{f}' AS field, '{j}' AS json_type" for e, _, f, j, *_ in _FIELDS))
def ontology_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = [(e["type"], f["name"], f["type"]) for e in tpch(spark, d).ontology("tpch") if "fields" in e for f in e["fields"]]
    return spark.createDataFrame(rows, "entity_type string, field string, json_type string")


@_query("ontology_statistics", _STATISTICS)
def ontology_statistics(spark: SparkSession, d: str) -> DataFrame:
    return tpch(spark, d).ontology_statistics("tpch")


@_query("relation_statistics", "SELECT 'placed_by' AS relation, 'order_customer' AS logical_key, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_active, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_inactive FROM orders")
def relation_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = tpch(spark, d)
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source"), F.lit(True).alias("_done"))
    r = next(r for r in m.relations if r.logical_key == "order_customer")
    m.relations = [type(r)(r.type, r.logical_key, r.source_type, r.target_type, r.df.join(done, "source", "left"))]
    m.deactivate_relation("order_customer", F.col("_done"))
    return m.relation_statistics()


# -- materialised joins --------------------------------------------------------------------------------------------
def events_memory(spark: SparkSession, d: str) -> Memory:
    m = tpch(spark, d)
    e = table(spark, d, "events")
    user = F.when(F.col("event_id") % 10 == 3, F.lit(None)).when(F.col("event_id") % 10 == 4, F.col("user_id") + 10_000_000).otherwise(F.col("user_id"))
    m.register_entity("app.Event", e, "event_id", {"user_id": ("long", user, F.col("event_id") % 10 != 5), "kind": ("string", "event_type", None, {"ascii": True})})
    return m


EVENT_JOIN = {"from": {"type": "app.Event", "fields": ["user_id"]}, "to": {"type": "tpch.Customer", "fields": ["key"]}}
_EV = "(SELECT event_id AS id, CASE WHEN event_id % 10 IN (3, 5) THEN NULL WHEN event_id % 10 = 4 THEN user_id + 10000000 ELSE user_id END AS u, event_type AS kind FROM events)"


@_query("join_materialize_scalar", f"SELECT id AS source, c_custkey AS target FROM {_EV} JOIN customer ON u = c_custkey")
def join_materialize_scalar(spark: SparkSession, d: str) -> DataFrame:
    m = events_memory(spark, d)
    relate.materialize_join(m, "event_user", "user", EVENT_JOIN)
    return m.edges("user", "app.Event", "tpch.Customer", "event_user")


@_query("join_counters", f"SELECT count(c_custkey) AS created, CAST(0 AS BIGINT) AS previously_active, CAST(0 AS BIGINT) AS previously_inactive, count(*) FILTER (WHERE u IS NULL) AS skipped_null_or_missing, count(*) FILTER (WHERE u IS NOT NULL AND c_custkey IS NULL) AS skipped_unmatched FROM {_EV} LEFT JOIN customer ON u = c_custkey")
def join_counters(spark: SparkSession, d: str) -> DataFrame:
    return relate.materialize_join(events_memory(spark, d), "event_user", "user", EVENT_JOIN)


def turns_memory(spark: SparkSession, d: str) -> Memory:
    m = Memory(spark, "turns")
    t = table(spark, d, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    m.register_entity("chat.Turn", t, "id", {"conv": ("long", "conv_id"), "turn": ("long", "turn"), "next": ("long", F.col("turn") + 1)})
    return m


@_query("join_materialize_composite", "SELECT concat_ws('/', a.conv_id, a.turn) AS source, concat_ws('/', b.conv_id, b.turn) AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def join_materialize_composite(spark: SparkSession, d: str) -> DataFrame:
    m = turns_memory(spark, d)
    relate.materialize_join(m, "next_turn", "next", {"from": {"type": "chat.Turn", "fields": ["conv", "next"]}, "to": {"type": "chat.Turn", "fields": ["conv", "turn"]}})
    return m.edges("next", "chat.Turn", "chat.Turn", "next_turn")


@_query("join_materialize_array", "SELECT n_regionkey AS source, n_nationkey AS target FROM nation WHERE n_regionkey <> 2")
def join_materialize_array(spark: SparkSession, d: str) -> DataFrame:
    m = tpch(spark, d)
    lists = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list("n_name")).alias("n"))
    codes = F.when(F.col("id") == 2, F.lit(None)).otherwise(F.to_json(F.array_union("n", F.array(F.lit("NOWHERE"), F.lit("NOWHERE"), F.lit(None)))))
    m.register_entity("geo.Group", lists, "id", {"codes": ("array", codes)})
    relate.materialize_join(m, "group_nation", "member", {"from": {"type": "geo.Group", "fields": ["codes"]}, "to": {"type": "tpch.Nation", "fields": ["name"]}})
    return m.edges("member", "geo.Group", "tpch.Nation", "group_nation")


def _inspected(spark: SparkSession, d: str, where: tuple = ()) -> DataFrame:
    m = events_memory(spark, d)
    relate.materialize_join(m, "event_user", "user", EVENT_JOIN)
    r = m.declaration("event_user")
    # Some edges are gone, some inactive, and some lead elsewhere than the keys say.
    df = r.df.filter("source % 100 <> 7").withColumn("active", F.col("source") % 100 != 8).withColumn("target", F.when(F.col("source") % 100 == 9, F.col("target") + 1).otherwise(F.col("target")))
    m.relations[m.relations.index(r)] = type(r)(r.type, r.logical_key, r.source_type, r.target_type, df, r.definition)
    return relate.inspect_relation(m, "event_user", where)


_REASON = "CASE WHEN c_custkey IS NOT NULL AND id % 100 = 9 THEN 'active_keys_disagree' WHEN u IS NULL THEN 'missing_or_null_key' WHEN c_custkey IS NULL THEN 'no_target' WHEN id % 100 = 8 THEN 'inactive_relation' WHEN id % 100 = 7 THEN 'eligible_not_materialized' ELSE 'linked' END"


@_query("relation_inspect_reasons", f"SELECT {_REASON} AS reason, count(*) AS n_sources, CAST(sum(CASE WHEN u IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_keys FROM {_EV} LEFT JOIN customer ON u = c_custkey GROUP BY 1")
def relation_inspect_reasons(spark: SparkSession, d: str) -> DataFrame:
    return relate.reason_histogram(_inspected(spark, d))


@_query("relation_inspect_rows", f"SELECT id AS source_id, CAST(CASE WHEN u IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_keys, c_custkey AS target_id, {_REASON} AS reason FROM {_EV} LEFT JOIN customer ON u = c_custkey WHERE kind = (SELECT min(event_type) FROM events)")
def relation_inspect_rows(spark: SparkSession, d: str) -> DataFrame:
    kind = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    return _inspected(spark, d, (Predicate("source", "kind", "eq", (kind,)),)).select("source_id", "n_keys", F.get("target_ids", 0).alias("target_id"), "reason")


_CODES = {"from": {"type": "app.Source", "fields": ["codes"]}, "to": {"type": "app.Code", "fields": ["code"]}}


@_query("join_array_counters", "SELECT count(*) FILTER (WHERE t IS NOT NULL) AS created, 0::BIGINT AS previously_active, 0::BIGINT AS previously_inactive, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 0) AS skipped_null_or_missing, (SELECT count(*) FROM customer WHERE c_custkey % 5 = 1) AS skipped_unmatched FROM (SELECT DISTINCT c, t FROM (SELECT c_custkey AS c, unnest([c_nationkey, (c_custkey * 7) % 25]) AS t FROM customer WHERE c_custkey % 5 > 1))")
def join_array_counters(spark: SparkSession, d: str) -> DataFrame:
    """Sources of two codes each: every fifth has none, and every fifth two that no target has."""
    m = Memory(spark, "codes")
    k = F.col("c_custkey")
    codes = F.when(k % 5 == 0, F.lit("[null]")).when(k % 5 == 1, F.lit('["x","y"]')).otherwise(F.concat(F.lit('["'), F.col("c_nationkey").cast("string"), F.lit('","'), (k * 7 % 25).cast("string"), F.lit('",null]')))
    m.register_entity("app.Source", table(spark, d, "customer"), "c_custkey", {"codes": ("array", codes)})
    m.register_entity("app.Code", table(spark, d, "nation"), "n_nationkey", {"code": ("string", F.col("n_nationkey").cast("string"))})
    return relate.materialize_join(m, "has_code", "code", _CODES)


@_query("import_big_number", "SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN 1e300 ELSE CAST(event_id AS DOUBLE) END AS big, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS BIGINT) END AS whole FROM events")
def import_big_number(spark: SparkSession, d: str) -> DataFrame:
    m = Memory(spark, "big")
    rows = table(spark, d, "events").select(F.concat(F.lit('{"key": '), "event_id", F.lit(', "big": '), F.when(F.col("event_id") % 3 == 0, F.lit("1e300")).otherwise(F.col("event_id").cast("string")), F.lit("}")).alias("value"))
    jsonl.import_jsonl(m, "app.Big", rows, {"key": "integer"})
    return m.entity("app.Big").df.select(F.col("i_key").cast("long").alias("key"), F.col("v_big").alias("big"), F.col("i_big").cast("long").alias("whole"))


# -- graph -------------------------------------------------------------------------------------------------------------
def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Customers follow the next customers of their nation: a sparse directed graph."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("source"), (F.col("c_custkey") * 3 % 997 + 1).alias("target"))


_G = "(SELECT c_custkey AS s, c_custkey * 3 % 997 + 1 AS t FROM customer)"


def _reach(name: str, direction: str, depth: int, step: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        edges = _graph(spark, d)
        starts = table(spark, d, "customer").filter("c_custkey <= 5").select(F.col("c_custkey").alias("node"))
        return traverse.reachable(edges, starts, depth, direction)

    QUERIES[name] = run
    SQL[name] = f"WITH RECURSIVE g AS ({step}), r(node, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey <= 5 UNION SELECT t, depth + 1 FROM r JOIN g ON g.s = r.node WHERE depth < {depth}) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node"


_reach("traverse_outbound", "outbound", 4, f"SELECT s, t FROM {_G}")
_reach("traverse_inbound", "inbound", 3, f"SELECT t AS s, s AS t FROM {_G}")
_reach("traverse_both_depth", "both", 3, f"SELECT s, t FROM {_G} UNION SELECT t, s FROM {_G}")


@_query("traverse_bounded", "SELECT 'tpch.Nation:' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'tpch.Region:1', 0")
def traverse_bounded(spark: SparkSession, d: str) -> DataFrame:
    got = traverse.traverse(tpch(spark, d), "tpch.Region:1", ["in_region", "has_nation"], "outbound", 1, 1000)
    return spark.createDataFrame(sorted(got["nodes"].items()), "node string, depth int")


# -- ingestion, privacy ---------------------------------------------------------------------------------------------------
def _lines(df: DataFrame, keep_null: bool = False) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(not keep_null).lower()}).alias("value"))


def imported(spark: SparkSession, d: str) -> Memory:
    """Customers, then a patch of every third one: its segment changes, its balance becomes null; and new ones."""
    m = Memory(spark, "import")
    c = table(spark, d, "customer")
    key = {"key": "integer"}
    jsonl.import_jsonl(m, "crm.Customer", _lines(c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))), key)
    patch = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.lower("c_mktsegment").alias("segment"), F.lit(None).cast("double").alias("balance"))
    fresh = c.filter("c_custkey % 50 = 0").select((F.col("c_custkey") + 1_000_000).alias("key"), F.col("c_name").alias("note"))
    jsonl.import_jsonl(m, "crm.Customer", _lines(patch, True).union(_lines(fresh)), key)
    return m


_IMPORTED = "(SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance, true AS balance_present, CAST(NULL AS VARCHAR) AS note FROM customer UNION ALL SELECT c_custkey + 1000000, NULL, NULL, false, c_name FROM customer WHERE c_custkey % 50 = 0)"


@_query("upsert_patch", f"SELECT key, segment, note FROM {_IMPORTED}")
def upsert_patch(spark: SparkSession, d: str) -> DataFrame:
    return imported(spark, d).entity("crm.Customer").df.select(F.col("i_key").cast("long").alias("key"), F.col("v_segment").alias("segment"), F.col("v_note").alias("note"))


@_query("upsert_null_overwrites", f"SELECT key, balance, balance_present FROM {_IMPORTED}")
def upsert_null_overwrites(spark: SparkSession, d: str) -> DataFrame:
    return imported(spark, d).entity("crm.Customer").df.select(F.col("i_key").cast("long").alias("key"), F.col("v_balance").alias("balance"), F.col("p_balance").alias("balance_present"))


@_query("type_inference", "SELECT 'event_type' AS field, 'string' AS json_type, count(*) AS n_present, CAST(0 AS BIGINT) AS n_null FROM events UNION ALL SELECT 'value', 'number', count(*), count(*) FILTER (WHERE event_id % 4 = 0) FROM events UNION ALL SELECT 'flag', 'boolean', count(*), 0 FROM events UNION ALL SELECT 'gone', NULL, count(*), count(*) FROM events")
def type_inference(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"), (F.col("event_id") > 5).alias("flag"), F.lit(None).cast("string").alias("gone"))
    return jsonl.infer(jsonl.attributes(jsonl.read_lines(_lines(e, True)))).select("field", "json_type", "n_present", "n_null")


@_query("duplicate_keys", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    rows, key = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"]
    return jsonl.duplicate_keys(jsonl.parsed(jsonl.read_lines(_lines(rows)), key), key)


@_query("privacy_propagation", "SELECT o_orderkey AS source, o_custkey AS target, CASE WHEN c_acctbal < 0 THEN 'private' ELSE 'public' END AS privacy FROM orders JOIN customer ON o_custkey = c_custkey")
def privacy_propagation(spark: SparkSession, d: str) -> DataFrame:
    m = tpch(spark, d)
    r = next(r for r in m.relations if r.logical_key == "order_customer")
    return m.with_end_privacy(r.df, r.source_type, r.target_type).select("source", "target", "privacy")


@_query("sanitized_export", "SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS n_edges FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1, 2")
def sanitized_export(spark: SparkSession, d: str) -> DataFrame:
    out = tpch(spark, d).sanitized()
    edges = out.edges("placed_by", "tpch.Order", "tpch.Customer", "order_customer").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return out.entity("tpch.Customer").df.join(edges, "id", "left").select("id", F.col("v_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n_edges"))


# -- retrieval ----------------------------------------------------------------------------------------------------------------
_TERMS = ["the", "and", "of"]
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"


_INDEXES: dict[tuple, index.TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> index.TextIndex:
    """The index of a folder's documents: written once an application and state of its files, as searches find it in use."""
    docs, stamp = table(spark, d, "documents").select("doc_id", "text"), []
    for path in docs.inputFiles():
        system, at = files.system(spark, path)
        about = system.getFileStatus(at)
        stamp.append((path, about.getLen(), about.getModificationTime()))
    name = (spark.sparkContext.applicationId, d, *sorted(stamp))
    if name not in _INDEXES:
        _INDEXES[name] = index.TextIndex.build(docs, ["doc_id"])
    return _INDEXES[name]


@_query("fts_and_match", f"SELECT doc_id FROM (SELECT doc_id, {_TOK} AS w FROM documents) WHERE list_has_all(w, ['the','and','of'])")
def fts_and_match(spark: SparkSession, d: str) -> DataFrame:
    return text_index(spark, d).search(_TERMS).select("doc_id")


def _bm25_sql(documents: str = "documents") -> str:
    score = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1.0) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(3))
    tfs = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(sorted(_TERMS)))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))
    return f"WITH d AS (SELECT doc_id, len(w) AS dl, {tfs} FROM (SELECT doc_id, {_TOK} AS w FROM {documents})), s AS (SELECT count(*) AS n, avg(dl) AS mean, {dfs} FROM d) SELECT doc_id, round({score}, 6) AS score FROM d, s WHERE tf0 > 0 AND tf1 > 0 AND tf2 > 0 ORDER BY {score} DESC, doc_id LIMIT 20"


@_query("fts_bm25_topk", _bm25_sql())
def fts_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return text_index(spark, d).search(_TERMS, 20).select("doc_id", F.round("score", 6).alias("score"))


@_query("fts_bm25_scan", _bm25_sql())
def fts_bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """Without an index: one pass over the texts."""
    return search.fts(table(spark, d, "documents"), _TERMS, ["doc_id"], 20).select("doc_id", F.round("score", 6).alias("score"))


@_query("search_coverage", "SELECT count(*) AS eligible, count(*) AS indexed, true AS complete FROM part")
def search_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = search.search_documents(tpch(spark, d))
    return index.TextIndex.build(docs, ["entity_type", "node_id", "field"]).coverage(docs)


@_query("search_postings", "SELECT token, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_uses FROM (SELECT p_partkey, token, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) AS token FROM part) GROUP BY 1, 2) GROUP BY token")
def search_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.index(search.search_documents(tpch(spark, d))).groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_uses"))


@_query("semantic_topk", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id LIMIT 10")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()[0]
    return search.semantic_top_k(e, first, "vec_id", "embedding", 10).select("vec_id", F.round("score", 6).alias("score"))


@_query("embedding_missing", "SELECT p_partkey AS node_id FROM (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey FROM part WHERE p_partkey % 3 <> 0)")
def embedding_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = search.search_documents(tpch(spark, d))
    have = docs.filter(F.col("node_id").cast("long") % 3 == 0).select("node_id", F.sha2("text", 256).alias("content_hash"))
    return search.missing_embeddings(docs, have, ["node_id"]).select("node_id")


@_query("embedding_coverage", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'ready' END AS status, count(*) AS n FROM part GROUP BY 1")
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = search.search_documents(tpch(spark, d))
    k = F.col("node_id").cast("long") % 4
    have = docs.filter(k > 0).select("node_id", F.sha2(F.when(k == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return search.embedding_coverage(docs, have, ["node_id"])


@_query("embedding_profile", "SELECT 'p' || label AS profile, CAST(len(embedding) AS INTEGER) AS dims, count(*) AS n_records, count(DISTINCT vec_id) AS n_documents FROM embeddings GROUP BY 1, 2")
def embedding_profile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.embedding_profile(e.select(F.concat(F.lit("p"), "label").alias("profile"), "vec_id", F.lit("h").alias("content_hash"), "embedding"))


# -- evidence, explanation, integrity ---------------------------------------------------------------------------------------
@_query("retention_report", "SELECT CASE WHEN retired THEN 'retired' WHEN blocking > 0 THEN 'active' ELSE 'expired' END AS status, count(*) AS n, CAST(sum(blocking) AS BIGINT) AS n_blocking FROM (SELECT user_id, bool_or(event_id % 97 = 0) AS retired, count(*) FILTER (WHERE event_id % 13 = 0 OR (event_id % 5 = 0 AND ts + INTERVAL 30 DAY > TIMESTAMP '2024-01-15')) AS blocking FROM events GROUP BY user_id) GROUP BY 1")
def retention_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    acq = e.select(F.col("user_id").alias("digest"), (F.col("event_id") % 13 == 0).alias("retention_required"), F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("interval 30 days")).alias("retain_until"), (F.col("event_id") % 97 == 0).alias("retired"))
    return fragments.retention(acq, "2024-01-15 00:00:00")


@_query("explain_provenance", "SELECT l_orderkey, l_linenumber, n_name AS source_name, p_size AS size FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def explain_provenance(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("source_id"), F.col("n_name").alias("name"))
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("fragment_id"))
    frag = table(spark, d, "part").select(F.col("p_partkey").alias("fragment_id"), F.col("p_partkey").alias("object_digest"), F.col("p_type").alias("selector"))
    objects = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("digest"), F.col("p_size").alias("size"))
    return lifecycle.explain(facts, s, frag, objects).select("l_orderkey", "l_linenumber", "source_name", "size")


@_query("integrity_orphans", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def integrity_orphans(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.missing_references(table(spark, d, "events"), "user_id", table(spark, d, "customer").filter("c_custkey % 2 = 0"), "c_custkey").select("event_id")


@_query("node_delete_cascade", "SELECT o_orderkey AS source, o_custkey AS target FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def node_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    m = tpch(spark, d)
    m.delete_nodes("tpch.Customer", m.entity("tpch.Customer").df.filter("v_segment = 'BUILDING'"))
    return m.edges("placed_by", "tpch.Order", "tpch.Customer", "order_customer")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["v2_flagship"](spark, d)


from . import queries_facts  # noqa: E402,F401  registers its queries
