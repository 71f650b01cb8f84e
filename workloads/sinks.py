"""Sinks read back, row numbers, chunks, widths and text that sheets can hold."""

from pyspark.sql import functions as F

from afluente.operators.outputs import (
    chunk_rows,
    display_widths,
    read_csv,
    row_index,
    sanitize_text,
    write_csv,
    write_parquet,
)
from workloads.registry import query

_CSV_SQL = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '  "' || lang || '|' || source || '"\\ ' END AS rotulo,
    replace(text, chr(13), '') AS texto, n_chars / 4 AS quarto, n_chars > 1000 AS longo FROM documents"""


def _texts(t):
    return t.documents.selectExpr(
        "doc_id",
        r"""CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('  "', lang, '|', source, '"\\ ') END AS rotulo""",
        "replace(text, '\r', '') AS texto",
        "n_chars / 4 AS quarto",
        "n_chars > 1000 AS longo",
    )


@query("write_csv", _CSV_SQL)
def _(t):
    place = t.written("texts_csv", lambda p: write_csv(_texts(t), p))
    return read_csv(t.spark, place, "doc_id bigint, rotulo string, texto string, quarto double, longo boolean")


@query("write_parquet", _CSV_SQL)
def _(t):
    return t.spark.read.parquet(t.written("texts_parquet", lambda p: write_parquet(_texts(t), p)))


@query(
    "row_index",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders",
)
def _(t):
    return row_index(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


@query(
    "row_index_text",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber) - 1 AS posicao
       FROM (SELECT DISTINCT ON (l_returnflag, l_orderkey, l_linenumber) * FROM lineitem)""",
)
def _(t):
    """Most rows share three values of the leading column."""
    order = ["l_returnflag", "l_orderkey", "l_linenumber"]
    rows = t.lineitem.select(*order).dropDuplicates(order)
    return row_index(rows, order, "posicao").drop("l_returnflag")


@query(
    "chunk_rows",
    """SELECT o_orderkey, 'Dados_Consolidados_' || ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1) AS chunk FROM orders""",
)
def _(t):
    return chunk_rows(t.orders.select("o_orderkey"), ["o_orderkey"], 1000)


@query("chunk_rows_single", "SELECT c_custkey, 'Dados_Consolidados' AS chunk FROM customer")
def _(t):
    return chunk_rows(t.customer.select("c_custkey"), ["c_custkey"])


_WIDE = {
    "orders": ["o_orderkey", "o_orderstatus", "o_orderpriority"],
    "documents": ["doc_id", "text", "lang"],
    "customer": ["c_custkey", "c_name", "c_mktsegment"],
}


def _width_sql(table: str, column: str) -> str:
    return f"""SELECT '{table}' AS tabela, '{column}' AS "column",
        least(greatest({len(column)}, coalesce(max(length(CAST({column} AS VARCHAR))), 0), 1) + 2, 60) AS width FROM {table}"""


@query("display_widths", " UNION ALL ".join(_width_sql(table, c) for table, columns in _WIDE.items() for c in columns))
def _(t):
    found = None
    for table, columns in _WIDE.items():
        part = display_widths(getattr(t, table).select(*columns)).select(F.lit(table).alias("tabela"), "column", "width")
        found = part if found is None else found.unionAll(part)
    return found


@query("sanitize_text", "SELECT page_id, url, html, chr(9) || chr(10) || chr(13) || url AS mantido FROM pages")
def _(t):
    dirty = t.pages.select(
        "page_id",
        F.concat(F.lit("\x07"), "url", F.lit("\x1f\x00")).alias("url"),
        F.concat(F.lit("\x0b\x0c"), "html", F.lit("\x08\x0e")).alias("html"),
        F.concat(F.lit("\t\n\r"), "url").alias("mantido"),
    )
    return sanitize_text(dirty)
