"""Filter rules on orders, lineitem, part and customer."""

from pyspark.sql import functions as F

from afluente import FilterRule, consolidate_tables
from afluente import constants as C
from afluente.operators.filters import apply_filters
from afluente.plans.consolidate import TableMapping
from workloads.registry import query

_PRIORITY = "nullif(o_orderpriority, '5-LOW')"


def _orders(t):
    return t.orders.withColumn("prioridade", F.expr(_PRIORITY))


def _kept(df, *rules):
    return apply_filters(df, [FilterRule(*r) for r in rules])


@query("filter_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return _kept(t.orders, ("o_orderstatus", C.EQUAL, " F ")).select("o_orderkey", "o_orderstatus")


@query(
    "filter_ne",
    f"SELECT o_orderkey, {_PRIORITY} AS prioridade FROM orders WHERE {_PRIORITY} <> '1-URGENT'",
)
def _(t):
    return _kept(_orders(t), ("prioridade", C.NOT_EQUAL, "1-URGENT")).select("o_orderkey", "prioridade")


@query(
    "filter_gt",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 300000 AND o_orderpriority > '3'",
)
def _(t):
    kept = _kept(t.orders, ("o_totalprice", C.GREATER, "300000"), ("o_orderpriority", C.GREATER, "3"))
    return kept.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "filter_lt",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-17' AND o_custkey < 400",
)
def _(t):
    kept = _kept(t.orders, ("o_orderdate", C.LESS, "17/06/1995"), ("o_custkey", C.LESS, "400"))
    return kept.select("o_orderkey", "o_orderdate")


@query(
    "filter_between",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem
       WHERE l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-12-31' AND l_quantity BETWEEN 5 AND 10""",
)
def _(t):
    kept = _kept(
        t.lineitem, ("l_shipdate", C.BETWEEN, ["1994-01-01", "1997-12-31"]), ("l_quantity", C.BETWEEN, ["5", "10"])
    )
    return kept.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def _(t):
    return _kept(t.part, ("p_name", C.CONTAINS, "ring")).select("p_partkey", "p_name")


@query(
    "filter_not_contains",
    f"SELECT o_orderkey, {_PRIORITY} AS prioridade FROM orders WHERE NOT contains({_PRIORITY}, 'URGENT')",
)
def _(t):
    return _kept(_orders(t), ("prioridade", C.NOT_CONTAINS, "URGENT")).select("o_orderkey", "prioridade")


@query("filter_startswith", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def _(t):
    return _kept(t.part, ("p_name", C.STARTS_WITH, "red")).select("p_partkey", "p_name")


@query("filter_endswith", "SELECT p_partkey, p_name FROM part WHERE suffix(p_name, 'widget')")
def _(t):
    return _kept(t.part, ("p_name", C.ENDS_WITH, "widget")).select("p_partkey", "p_name")


@query("filter_is_blank", f"SELECT o_orderkey FROM orders WHERE {_PRIORITY} IS NULL")
def _(t):
    return _kept(_orders(t), ("prioridade", C.IS_BLANK)).select("o_orderkey")


@query("filter_not_blank", f"SELECT o_orderkey FROM orders WHERE {_PRIORITY} IS NOT NULL")
def _(t):
    return _kept(_orders(t), ("prioridade", C.NOT_BLANK)).select("o_orderkey")


@query(
    "filter_same_column_or",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
       WHERE (o_totalprice > 450000 OR o_totalprice < 2000 OR o_totalprice BETWEEN 100000 AND 110000)
         AND (o_orderstatus = 'F' OR o_orderstatus = 'P')""",
)
def _(t):
    kept = _kept(
        t.orders,
        ("o_totalprice", C.GREATER, "450000"),
        ("o_orderstatus", C.EQUAL, "F"),
        ("o_totalprice", C.LESS, "2000"),
        ("o_totalprice", C.BETWEEN, ["100000", "110000"]),
        ("o_orderstatus", C.EQUAL, "P"),
    )
    return kept.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    "filter_exclusions_and",
    """SELECT o_orderkey, o_orderpriority FROM orders
       WHERE o_orderpriority <> '1-URGENT' AND NOT contains(o_orderpriority, 'LOW') AND o_orderpriority <> '2-HIGH'""",
)
def _(t):
    kept = _kept(
        t.orders,
        ("o_orderpriority", C.NOT_EQUAL, "1-URGENT"),
        ("o_orderpriority", C.NOT_CONTAINS, "LOW"),
        ("o_orderpriority", C.NOT_EQUAL, "2-HIGH"),
    )
    return kept.select("o_orderkey", "o_orderpriority")


@query(
    "filter_rules",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, {_PRIORITY} AS prioridade FROM orders
        WHERE (({_PRIORITY} IS NULL OR contains({_PRIORITY}, 'I')) AND {_PRIORITY} <> '4-NOT SPECIFIED')
          AND (o_orderstatus = 'O' OR o_orderstatus = 'F')
          AND o_custkey <> 7
          AND o_orderdate > TIMESTAMP '1994-03-05'""",
)
def _(t):
    kept = _kept(
        _orders(t),
        ("prioridade", C.IS_BLANK),
        ("prioridade", C.CONTAINS, "I"),
        ("prioridade", C.NOT_EQUAL, "4-NOT SPECIFIED"),
        ("o_orderstatus", C.EQUAL, "O"),
        ("o_orderstatus", C.EQUAL, "F"),
        ("o_custkey", C.NOT_EQUAL, "7"),
        ("o_orderdate", C.GREATER, "1994-03-05"),
    )
    return kept.select("o_orderkey", "o_custkey", "o_orderstatus", "prioridade")


@query(
    "filter_missing_column",
    """SELECT c_name AS nome, c_mktsegment AS segmento, 'customer' AS "Origem" FROM customer
       WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT s_name, NULL, 'supplier' FROM supplier""",
)
def _(t):
    mapping = [
        TableMapping("customer", "c_name", "nome"),
        TableMapping("customer", "c_mktsegment", "segmento"),
        TableMapping("supplier", "s_name", "nome"),
    ]
    rules = [FilterRule("segmento", C.EQUAL, "BUILDING")]
    return consolidate_tables({"customer": t.customer, "supplier": t.supplier}, mapping, rules).consolidated


@query(
    "filter_incomplete",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = CAST(NULL AS BIGINT) OR o_custkey > 90",
)
def _(t):
    kept = _kept(
        t.orders,
        (None, C.EQUAL, "1"),
        ("o_orderstatus", C.EQUAL, "  "),
        ("o_orderstatus", None, "F"),
        ("o_orderstatus", C.IS_BLANK, None),
        ("o_totalprice", C.BETWEEN, ["1", " "]),
        ("o_totalprice", C.CONTAINS, "9"),
        ("nao_existe", C.EQUAL, "1"),
        ("o_custkey", C.EQUAL, "abc"),
        ("o_custkey", C.GREATER, "90"),
    )
    return kept.select("o_orderkey", "o_custkey")
