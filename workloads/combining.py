"""Union, common types and duplicates over customer, supplier, part, nation and orders."""

from pyspark.sql import functions as F

from afluente import Aggregation, DuplicateRule, FilterRule, SummaryRule, consolidate_tables
from afluente import constants as C
from afluente.operators.combine import (
    add_origin,
    census_table,
    combine,
    duplicate_counts,
    keep_first,
    removed_duplicates,
)
from afluente.operators.mapping import map_columns
from afluente.operators.outputs import row_accounting
from afluente.plans.consolidate import TableMapping
from workloads.registry import query

PARTIES = [
    TableMapping("customer", "c_name", "nome"),
    TableMapping("customer", "c_acctbal", "saldo", C.TYPE_FLOAT),
    TableMapping("customer", "c_nationkey", "pais", C.TYPE_INTEGER),
    TableMapping("customer", "c_mktsegment", "segmento"),
    TableMapping("supplier", "s_name", "nome"),
    TableMapping("supplier", "s_acctbal", "saldo", C.TYPE_FLOAT),
    TableMapping("supplier", "s_nationkey", "pais", C.TYPE_INTEGER),
    TableMapping("supplier", "s_suppkey", "codigo", C.TYPE_INTEGER, include=False),
]
ORDER = {"customer": ["c_custkey"], "supplier": ["s_suppkey"]}
FILTERS = [
    FilterRule("saldo", C.GREATER, "0"),
    FilterRule("segmento", C.NOT_EQUAL, "BUILDING"),
    FilterRule("pais", C.NOT_EQUAL, "3"),
]
SUMMARY = SummaryRule(
    ("pais", "Origem"), (Aggregation("saldo", C.MAXIMUM), Aggregation("nome", C.COUNT), Aggregation("segmento", C.UNIQUE_COUNT))
)

_PARTY_ROWS = """SELECT c_name AS nome, c_acctbal AS saldo, c_nationkey::BIGINT AS pais, c_mktsegment AS segmento,
        'customer' AS "Origem", 0 AS lugar, c_custkey AS chave FROM customer
    UNION ALL SELECT s_name, s_acctbal, s_nationkey, NULL, 'supplier', 1, s_suppkey FROM supplier"""
_FILTERED = f"""SELECT * FROM ({_PARTY_ROWS})
    WHERE saldo > 0 AND pais <> 3 AND ("Origem" = 'supplier' OR segmento <> 'BUILDING')"""
_FIRSTS = f"""SELECT *, row_number() OVER (PARTITION BY pais, segmento ORDER BY lugar, chave) AS vez FROM ({_FILTERED})"""
_VISIBLE = 'nome, saldo, pais, segmento, "Origem"'
SUMMARY_SQL = f"""SELECT pais, "Origem", max(saldo) AS "saldo_Máximo", count(nome) AS "nome_Contagem",
    (count(DISTINCT segmento) + max(CASE WHEN segmento IS NULL THEN 1 ELSE 0 END))::BIGINT AS "segmento_Contagem_Única"
    FROM ({_FIRSTS}) WHERE vez = 1 GROUP BY pais, "Origem" """


def parties(t):
    """The flagship run over two tables."""
    return consolidate_tables(
        {"customer": t.customer, "supplier": t.supplier},
        PARTIES,
        FILTERS,
        DuplicateRule(("pais", "segmento")),
        SUMMARY,
        ORDER,
    )


@query("consolidate", f"SELECT {_VISIBLE} FROM ({_FIRSTS}) WHERE vez = 1")
def _(t):
    return parties(t).consolidated


@query("consolidate_removed", f"SELECT {_VISIBLE} FROM ({_FIRSTS}) WHERE vez > 1")
def _(t):
    return parties(t).removed


@query("consolidate_summary", SUMMARY_SQL)
def _(t):
    return parties(t).summary


@query(
    "outputs",
    f"""SELECT 'consolidated' AS saida, count(*) AS linhas FROM ({_FIRSTS}) WHERE vez = 1
        UNION ALL SELECT 'removed', count(*) FROM ({_FIRSTS}) WHERE vez > 1
        UNION ALL SELECT 'summary', count(*) FROM ({SUMMARY_SQL})""",
)
def _(t):
    found = parties(t)
    counts = None
    for name in ("consolidated", "removed", "summary"):
        part = getattr(found, name).agg(F.count(F.lit(1)).alias("linhas")).select(F.lit(name).alias("saida"), "linhas")
        counts = part if counts is None else counts.unionAll(part)
    return counts


@query(
    "row_accounting",
    f"""SELECT "Origem", count(*) AS rows_before,
        count(*) FILTER (WHERE saldo > 0 AND ("Origem" = 'supplier' OR segmento <> 'BUILDING')) AS rows_after
        FROM ({_PARTY_ROWS}) GROUP BY "Origem" """,
)
def _(t):
    everything = consolidate_tables({"customer": t.customer, "supplier": t.supplier}, PARTIES).consolidated
    kept = (F.col("saldo") > 0) & ((F.col("Origem") == "supplier") | (F.col("segmento") != "BUILDING"))
    return row_accounting(everything, kept)


@query(
    "map_columns",
    "SELECT p_name AS produto, coalesce(nullif(p_brand, 'Brand#2'), p_type) AS marca, p_size AS tamanho FROM part",
)
def _(t):
    source = t.part.withColumn("p_brand", F.expr("nullif(p_brand, 'Brand#2')"))
    wanted = [("p_type", "marca"), ("p_name", "produto"), ("p_size", "tamanho"), ("p_brand", "marca"), ("sumiu", "x")]
    return source.select(*map_columns(source, wanted))


@query(
    "coalesce_columns",
    """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), nullif(o_orderstatus, 'F'), CAST(o_custkey AS VARCHAR)) AS valor
       FROM orders""",
)
def _(t):
    source = t.orders.select(
        "o_orderkey",
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("valor_a"),
        F.expr("nullif(o_orderstatus, 'F')").alias("valor_b"),
        F.col("o_custkey").cast("string").alias("valor_c"),
    )
    targets = [("o_orderkey", "o_orderkey"), ("valor_a", "valor"), ("valor_b", "valor"), ("valor_c", "valor")]
    return source.select(*map_columns(source, targets))


@query("add_origin", """SELECT s_suppkey, s_name, 'fornecedores.xlsx (Plan1)' AS "Origem" FROM supplier""")
def _(t):
    return add_origin(t.supplier.select("s_suppkey", "s_name", F.lit("old").alias("Origem")), "fornecedores.xlsx", "Plan1")


_UNION = {
    "customer": ("c_name AS nome", "c_acctbal AS saldo", "c_mktsegment AS segmento"),
    "supplier": ("s_name AS nome", "s_acctbal AS saldo"),
    "part": ("p_name AS nome", "p_retailprice AS preco"),
}


def _named_tables(t):
    return {name: getattr(t, name).selectExpr(*columns) for name, columns in _UNION.items()}


_UNION_SQL = " UNION ALL BY NAME ".join(
    f"""SELECT {', '.join(columns)}, '{name}' AS "Origem" FROM {name}""" for name, columns in _UNION.items()
)


@query("union_by_name", _UNION_SQL)
def _(t):
    return combine(_named_tables(t))


@query("origin_last", f'SELECT count(*) AS linhas, "Origem", 4 AS posicao FROM ({_UNION_SQL}) GROUP BY "Origem"')
def _(t):
    combined = combine(_named_tables(t))
    position = combined.columns.index(C.ORIGIN)
    return combined.groupBy(C.ORIGIN).agg(F.count(F.lit(1)).alias("linhas"), F.lit(position).alias("posicao"))


def _mixed_tables(t):
    return {
        "nation": t.nation.selectExpr("n_nationkey AS chave", "n_regionkey = 1 AS marca", "n_regionkey AS misto"),
        "customer": t.customer.selectExpr("c_acctbal AS chave", "c_nationkey AS marca", "NULL AS vazio"),
        "orders": t.orders.selectExpr("o_orderkey AS chave", "o_orderdate AS dia", "CAST(o_orderdate AS DATE) AS misto"),
        "lineitem": t.lineitem.selectExpr("l_linenumber AS chave", "CAST(l_shipdate AS DATE) AS dia", "NULL AS vazio"),
    }


@query(
    "harmonize_types",
    """SELECT n_nationkey::DOUBLE AS chave, (n_regionkey = 1)::VARCHAR AS marca, n_regionkey::VARCHAR AS misto,
              NULL::VARCHAR AS vazio, NULL::TIMESTAMP AS dia, 'nation' AS "Origem" FROM nation
       UNION ALL SELECT c_acctbal, c_nationkey::VARCHAR, NULL, NULL, NULL, 'customer' FROM customer
       UNION ALL SELECT o_orderkey, NULL, o_orderdate::DATE::VARCHAR, NULL, o_orderdate, 'orders' FROM orders
       UNION ALL SELECT l_linenumber, NULL, NULL, NULL, l_shipdate::DATE::TIMESTAMP, 'lineitem' FROM lineitem""",
)
def _(t):
    return combine(_mixed_tables(t))


@query(
    "type_census",
    """SELECT 'chave' AS "column", 'bigint,double,int' AS types, (SELECT count(*) FROM nation) +
              (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS filled
       UNION ALL SELECT 'marca', 'boolean,int', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)
       UNION ALL SELECT 'misto', 'date,int', (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders)
       UNION ALL SELECT 'vazio', 'void', 0
       UNION ALL SELECT 'dia', 'date,timestamp_ntz', (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem)""",
)
def _(t):
    return census_table(list(_mixed_tables(t).values()))


_KEYS = ["cliente", "situacao"]
_ORDER_ROWS = "SELECT o_orderkey, nullif(o_custkey, 10) AS cliente, nullif(o_orderstatus, 'P') AS situacao, o_totalprice FROM orders"
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY cliente, situacao ORDER BY o_orderkey) AS vez FROM ({_ORDER_ROWS})"


def _orders(t):
    return t.orders.selectExpr(
        "o_orderkey", "nullif(o_custkey, 10) AS cliente", "nullif(o_orderstatus, 'P') AS situacao", "o_totalprice"
    )


@query("dedup_keep_first", f"SELECT o_orderkey, cliente, situacao, o_totalprice FROM ({_RANKED}) WHERE vez = 1")
def _(t):
    return keep_first(_orders(t), _KEYS, ["o_orderkey"])


@query("dedup_removed", f"SELECT o_orderkey, cliente, situacao, o_totalprice FROM ({_RANKED}) WHERE vez > 1")
def _(t):
    return removed_duplicates(_orders(t), _KEYS, ["o_orderkey"])


@query(
    "dedup_counts",
    f"""SELECT count(*) AS rows_before, count(*) FILTER (WHERE vez > 1) AS rows_removed,
        count(*) FILTER (WHERE vez = 1) AS rows_left FROM ({_RANKED})""",
)
def _(t):
    return duplicate_counts(_orders(t), _KEYS)


_MONEY_SQL = """SELECT *, row_number() OVER (PARTITION BY fica, pais ORDER BY sheet_no, chave) AS vez FROM (
    SELECT 'customer' AS origin, 0 AS sheet_no, c_custkey AS chave, c_nationkey AS pais, c_acctbal > 0 AS fica FROM customer
    UNION ALL SELECT 'supplier', 2, s_suppkey, s_nationkey, s_acctbal > 0 FROM supplier)"""


@query(
    "table_accounting",
    f"""SELECT origin, 'processed' AS status, CASE sheet_no WHEN 2 THEN 'own origin column replaced' END AS detail, count(*) AS rows_read,
        0 AS rows_wide, count(*) FILTER (WHERE fica) AS rows_after_filter, count(*) FILTER (WHERE fica AND vez > 1) AS rows_removed,
        count(*) FILTER (WHERE fica AND vez = 1) AS rows_left FROM ({_MONEY_SQL}) GROUP BY origin, sheet_no
        UNION ALL SELECT 'orders', 'unmatched', NULL, 0, 0, 0, 0, 0""",
)
def _(t):
    """Rows of each table at each step of a run over tables; one table matches no column, one has an origin of its own."""
    mapping = [
        TableMapping("customer", "c_nationkey", "pais"),
        TableMapping("customer", "c_acctbal", "saldo", C.TYPE_FLOAT),
        TableMapping("supplier", "s_nationkey", "pais"),
        TableMapping("supplier", "s_acctbal", "saldo", C.TYPE_FLOAT),
        TableMapping("supplier", "s_name", C.ORIGIN),
    ]
    out = consolidate_tables(
        {"customer": t.customer, "orders": t.orders, "supplier": t.supplier},
        mapping,
        [FilterRule("saldo", C.GREATER, "0")],
        DuplicateRule(("pais",)),
        order={"customer": ["c_custkey"], "orders": ["o_orderkey"], "supplier": ["s_suppkey"]},
    )
    return out.accounting.drop("path", "sheet_no")
