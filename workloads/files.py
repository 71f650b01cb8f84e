"""Files and workbooks that Spark derives from the tables, read back through the scans."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente import (
    Aggregation,
    DuplicateRule,
    FilterRule,
    SummaryRule,
    analyze_headers,
    consolidate,
    open_folder,
    preview,
    refresh_headers,
    write_run,
)
from afluente import constants as C
from afluente.operators.mapping import build_mapping, override_mapping
from afluente.sources.delimited import delimited_grid
from afluente.sources.folder import route
from afluente.sources.listing import list_sources
from afluente.session import shared_folder
from afluente.sources import stores
from afluente.sources.sheetgrid import sheet_grid, sheet_heads, sheet_tables
from afluente.sources.sheets import SheetRule, apply_sheet_rule, distinct_sheets, reconcile_sheets
from afluente.sources.workbooks import list_sheets, workbook_grid, workbook_heads
from workloads import workbook_bytes
from workloads.registry import query

# The book writer travels with the job, so executors need no copy of this package.
for _module in (workbook_bytes, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)


def _write_by_nation(t, place: str) -> None:
    """One folder per nation: its customers as .csv, each row twice, and its suppliers as .txt below a title."""
    customers = t.customer.unionAll(t.customer).selectExpr(
        "c_custkey AS Chave", "c_name AS Nome", "c_acctbal AS Saldo", "c_nationkey AS `País`", "c_mktsegment AS Segmento", "c_nationkey AS n"
    )
    customers.repartition("n").write.partitionBy("n").option("sep", ";").option("header", True).option(
        "encoding", "ISO-8859-1"
    ).csv(place)

    nations = t.supplier.select(F.col("s_nationkey").alias("n")).distinct()
    title = nations.select("n", F.lit(-2).cast("bigint").alias("at"), F.lit("Fornecedores do dia").alias("value"))
    header = nations.select("n", F.lit(-1).cast("bigint"), F.lit("Codigo;Razao Social;SALDO"))
    body = t.supplier.select(
        "s_nationkey", "s_suppkey", F.concat_ws(";", "s_suppkey", "s_name", F.format_string("%.2f", "s_acctbal"))
    )
    lines = title.unionAll(header).unionAll(body).repartition("n").sortWithinPartitions("n", "at")
    lines.select("value", "n").write.mode("append").partitionBy("n").text(place)
    for row in t.customer.select("c_nationkey").distinct().collect():  # at most as many as there are nations
        for name in ("vazio.csv", "_oculto.csv"):
            _touch(t, f"{place}/n={row[0]}/{name}")


def _touch(t, place: str) -> None:
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(t.spark._jsparkSession.sessionState().newHadoopConf()).create(path).close()


def _by_nation(t):
    place = t.written("by_nation", lambda p: _write_by_nation(t, p))
    return open_folder(t.spark, f"{place}/n=*")


def _nation():
    return F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("int").alias("n")


@query(
    "list_sources",
    """SELECT DISTINCT c_nationkey AS n, 'delimited' AS route, 1 AS rank, unnest(['listed', 'empty', 'skipped']) AS status FROM customer
       UNION ALL SELECT DISTINCT s_nationkey, 'delimited', 3, 'listed' FROM supplier""",
)
def _(t):
    return list_sources(_by_nation(t)).select(_nation(), "route", "rank", "status")


@query(
    "route_sources",
    """SELECT 'k' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' WHEN 2 THEN '.xlsx'
              WHEN 3 THEN '.Xls' ELSE '.pdf' END AS arquivo,
              CASE c_custkey % 5 WHEN 0 THEN 'delimited' WHEN 1 THEN 'delimited' WHEN 2 THEN 'workbook'
              WHEN 3 THEN 'workbook' ELSE 'unsupported' END AS route FROM customer""",
)
def _(t):
    ending = "CASE c_custkey % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.TXT' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.Xls' ELSE '.pdf' END"
    name = F.concat(F.lit("k"), "c_custkey", F.expr(ending))
    return t.customer.select(name.alias("arquivo")).withColumn("route", route(F.col("arquivo")))


# Far below the usual size, so that files are read as several blocks at every scale.
_BLOCK_BYTES = 128 << 10


def _write_orders(t, place: str) -> None:
    columns = [F.col("o_orderkey"), F.expr("nullif(o_orderpriority, '5-LOW')"), F.col("o_totalprice"), F.lit('"é"')]
    line = F.concat_ws(";", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    data = t.orders.select(line.alias("value"))
    data.write.option("encoding", "ISO-8859-1").option("quote", "").option("sep", "\x01").csv(place)


@query(
    "scan_delimited",
    """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prioridade, o_totalprice, '"é"' AS citado, 4 AS largura FROM orders""",
)
def _(t):
    folder = open_folder(t.spark, t.written("orders_csv", lambda p: _write_orders(t, p)))
    cells = delimited_grid(folder, small_file_bytes=0, bytes_per_block=_BLOCK_BYTES).select("cells")
    at = [F.nullif(F.get("cells", F.lit(i)), F.lit("")) for i in range(4)]
    return cells.select(
        at[0].cast("bigint").alias("o_orderkey"),
        at[1].alias("prioridade"),
        at[2].cast("double").alias("o_totalprice"),
        at[3].alias("citado"),
        F.size("cells").alias("largura"),
    )


_GROUPS = {
    "chave:numeric": ("Chave", "customer"),
    "nome:String": ("Nome", "customer"),
    "pais:numeric": ("País", "customer"),
    "segmento:String": ("Segmento", "customer"),
    "codigo:numeric": ("Codigo", "supplier"),
    "razaosocial:String": ("Razao Social", "supplier"),
}


@query(
    "analyze_headers",
    " UNION ALL ".join(
        f"SELECT '{group}' AS group_id, '{name}' AS suggested, count(DISTINCT {table[0]}_nationkey) AS fontes FROM {table}"
        for group, (name, table) in _GROUPS.items()
    )
    + """ UNION ALL SELECT 'saldo:numeric', 'Saldo', (SELECT count(DISTINCT c_nationkey) FROM customer) +
        (SELECT count(DISTINCT s_nationkey) FROM supplier)""",
)
def _(t):
    found = analyze_headers(_by_nation(t))
    members = found.members.groupBy("group_id").agg(F.count(F.lit(1)).alias("fontes"))
    return found.settings.join(members, "group_id").select("group_id", "suggested", "fontes")


_PARTIES_SQL = """SELECT c_name AS nome, c_acctbal AS "Saldo", c_nationkey::BIGINT AS "País", c_mktsegment AS "Segmento", '.csv' AS origem
    FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'"""
_ALL_SQL = f"""{_PARTIES_SQL} UNION ALL SELECT s_name, round(s_acctbal, 2), NULL, NULL, '.txt' FROM supplier WHERE round(s_acctbal, 2) > 0"""


@query("consolidate_files", _ALL_SQL)
def _(t):
    return _kind(_run(t).consolidated)


@query("consolidate_files_removed", _PARTIES_SQL)
def _(t):
    return _kind(_run(t).removed)


@query(
    "consolidate_files_summary",
    f"""SELECT "Segmento", max("Saldo") AS "Saldo_Máximo", count(nome) AS "nome_Contagem",
        (count(DISTINCT "País") + max(CASE WHEN "País" IS NULL THEN 1 ELSE 0 END))::BIGINT AS "País_Contagem_Única"
        FROM ({_ALL_SQL}) GROUP BY "Segmento" """,
)
def _(t):
    return _run(t).summary


@query(
    "run_audit",
    """SELECT DISTINCT c_nationkey AS n, '.csv' AS origem, unnest(['processed', 'empty', 'skipped']) AS status FROM customer
       UNION ALL SELECT DISTINCT s_nationkey, '.txt', 'processed' FROM supplier""",
)
def _(t):
    return _run(t).audit.select(_nation(), F.regexp_extract("origin", "([.][a-z]+)$", 1).alias("origem"), "status")


_BEFORE_SQL = """SELECT c_nationkey AS n, '.csv' AS origem, c_custkey AS k, vez, c_name AS nome, c_acctbal AS saldo, c_mktsegment AS segmento
    FROM customer, range(2) r(vez) UNION ALL SELECT s_nationkey, '.txt', s_suppkey, 0, s_name, round(s_acctbal, 2), NULL FROM supplier"""


@query(
    "run_accounting",
    f"""SELECT n, origem, 'processed' AS status, count(*) AS rows_read, 0 AS rows_wide, count(*) FILTER (WHERE fica) AS rows_after_filter,
        count(*) FILTER (WHERE fica AND vez = 1) AS rows_removed, count(*) FILTER (WHERE fica AND vez = 0) AS rows_left
        FROM (SELECT *, saldo > 0 AND coalesce(segmento <> 'BUILDING', true) AS fica FROM ({_BEFORE_SQL})) GROUP BY n, origem
        UNION ALL SELECT DISTINCT c_nationkey, '.csv', unnest(['empty', 'skipped']), 0, 0, 0, 0, 0 FROM customer""",
)
def _(t):
    counts = ("rows_read", "rows_wide", "rows_after_filter", "rows_removed", "rows_left")
    return _run(t).accounting.select(
        _nation(), F.regexp_extract("origin", "([.][a-z]+)$", 1).alias("origem"), "status", *counts
    )


@query(
    "run_totals",
    f"""SELECT count(*) AS rows_read, 0 AS rows_wide, count(*) FILTER (WHERE fica) AS rows_after_filter,
        count(*) FILTER (WHERE fica AND vez = 1) AS rows_removed, count(*) FILTER (WHERE fica AND vez = 0) AS rows_left
        FROM (SELECT *, saldo > 0 AND coalesce(segmento <> 'BUILDING', true) AS fica FROM ({_BEFORE_SQL}))""",
)
def _(t):
    """Totals counted while the outputs are written."""
    totals = write_run(_run(t), shared_folder(t.spark), which=("consolidated",)).totals
    names = ("rows_read", "rows_wide", "rows_after_filter", "rows_removed", "rows_left")
    return t.spark.createDataFrame([tuple(totals[n] for n in names)], ", ".join(f"{n} long" for n in names))


def _kind(df: DataFrame) -> DataFrame:
    """Spark makes up the file names, so only their extension is compared."""
    return df.withColumn("origem", F.regexp_extract(C.ORIGIN, "([.][a-z]+)$", 1)).drop(C.ORIGIN)


def _run(t):
    folder = _by_nation(t)
    found = analyze_headers(folder)
    changes = folder.spark.createDataFrame(
        [
            ("nome:String", "nome", None, None),
            ("razaosocial:String", "nome", None, None),
            ("saldo:numeric", None, C.TYPE_FLOAT, None),
            ("pais:numeric", None, C.TYPE_INTEGER, None),
            ("chave:numeric", None, None, False),
            ("codigo:numeric", None, None, False),
        ],
        "group_id string, final_name string, type string, include boolean",
    )
    mapping = build_mapping(found.members, override_mapping(found.settings, changes))
    return consolidate(
        folder,
        mapping,
        [FilterRule("Saldo", C.GREATER, "0"), FilterRule("Segmento", C.NOT_EQUAL, "BUILDING")],
        DuplicateRule(("nome", "Saldo", "País", "Segmento")),
        SummaryRule(
            ("Segmento",),
            (Aggregation("Saldo", C.MAXIMUM), Aggregation("País", C.UNIQUE_COUNT), Aggregation("nome", C.COUNT)),
        ),
        found.layout,
    )


# Workbooks of at most 500 customers each, with one sheet per market segment.
_CUSTOMERS_PER_BOOK = 500


def _book(rows: pd.DataFrame) -> pd.DataFrame:
    sheets = {
        segment: [["codigo", "nome", "saldo"], *part[["c_custkey", "c_name", "c_acctbal"]].values.tolist()]
        for segment, part in rows.sort_values("c_custkey").groupby("c_mktsegment", sort=True)
    }
    content = workbook_bytes.workbook_bytes(sheets)
    return pd.DataFrame({"uri": [f"/livros/{rows['book'].iloc[0]}.xlsx"], "length": [len(content)], "content": [content]})


def _books(t) -> DataFrame:
    # a book holds one range of keys, so no group grows with the table
    rows = t.customer.select("*", F.floor(F.col("c_custkey") / _CUSTOMERS_PER_BOOK).cast("bigint").alias("book"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        return _book(group)

    return rows.groupBy("book").applyInPandas(build, "uri string, length bigint, content binary")


def _book_no(path: str = "uri"):
    return F.regexp_extract(path, "([0-9]+)[.]xlsx", 1).cast("bigint").alias("livro")


_SHEETS_SQL = f"""SELECT livro, sheet, row_number() OVER (PARTITION BY livro ORDER BY sheet) - 1 AS sheet_no
    FROM (SELECT DISTINCT c_custkey // {_CUSTOMERS_PER_BOOK} AS livro, c_mktsegment AS sheet FROM customer)"""


# Every fifth book has a fault in the first data row of its first sheet.
_FAULTY = 5


def _damaged(books: pd.DataFrame) -> pd.DataFrame:
    return books.assign(content=[workbook_bytes.damaged(content) for content in books["content"]])


@query(
    "workbook_faults",
    f"""SELECT livro, sheet, sheet_no, livro % {_FAULTY} = 0 AND sheet_no = 0 AS falha,
        CASE WHEN livro % {_FAULTY} = 0 AND sheet_no = 0 THEN 0 ELSE 1 + (SELECT count(*) FROM customer
        WHERE c_custkey // {_CUSTOMERS_PER_BOOK} = livro AND c_mktsegment = sheet) END AS linhas FROM ({_SHEETS_SQL})""",
)
def _(t):
    books = _books(t)
    faulty = _book_no() % _FAULTY == 0

    def damage(batches):
        return map(_damaged, batches)

    books = books.where(~faulty).unionAll(books.where(faulty).mapInPandas(damage, books.schema))
    heads = workbook_heads(books)
    rows = workbook_grid(books).groupBy("uri", "sheet_no").agg(F.count(F.lit(1)).alias("linhas"))
    found = heads.where(F.col("error").isNull()).join(rows, ["uri", "sheet_no"])
    return found.unionByName(heads.where(F.col("error").isNotNull()).withColumn("linhas", F.lit(0))).select(
        _book_no(), "sheet", "sheet_no", F.col("error").isNotNull().alias("falha"), "linhas"
    )


@query("list_sheets", _SHEETS_SQL)
def _(t):
    return list_sheets(_books(t)).select(_book_no("path"), "sheet", "sheet_no")


@query(
    "scan_workbooks",
    f"""SELECT c_custkey // {_CUSTOMERS_PER_BOOK} AS livro, s.sheet_no, c_custkey AS codigo, c_name AS nome, c_acctbal AS saldo
        FROM customer JOIN ({_SHEETS_SQL}) s ON s.livro = c_custkey // {_CUSTOMERS_PER_BOOK} AND s.sheet = c_mktsegment""",
)
def _(t):
    rows = workbook_grid(_books(t)).where("line > 0")
    at = [F.get("cells", F.lit(i)) for i in range(3)]
    return rows.select(
        _book_no(),
        "sheet_no",
        at[0].cast("bigint").alias("codigo"),
        at[1].alias("nome"),
        at[2].cast("double").alias("saldo"),
    )


def _write_books(t, place: str) -> None:
    """The workbooks as files, every fifth with a fault, each written by the task that made it."""

    def save(batches):
        for books in batches:
            faulty = books["uri"].str.extract(r"([0-9]+)[.]xlsx")[0].astype(int) % _FAULTY == 0
            books = pd.concat([books[~faulty], _damaged(books[faulty])])
            for uri, content in zip(books["uri"], books["content"]):
                store, folder = stores.store_of(place)
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(f"{folder}/{uri.rpartition('/')[2]}") as out:
                    out.write(content)
            yield books[["uri"]]

    _books(t).mapInPandas(save, "uri string").write.format("noop").mode("overwrite").save()


def _book_folder(t):
    return open_folder(t.spark, t.written("livros", lambda p: _write_books(t, p)))


@query(
    "sheet_faults",
    f"""SELECT livro, sheet, sheet_no, livro % {_FAULTY} = 0 AND sheet_no = 0 AS falha,
        CASE WHEN livro % {_FAULTY} = 0 AND sheet_no = 0 THEN 0 ELSE 1 + (SELECT count(*) FROM customer
        WHERE c_custkey // {_CUSTOMERS_PER_BOOK} = livro AND c_mktsegment = sheet) END AS linhas FROM ({_SHEETS_SQL})""",
)
def _(t):
    tables = sheet_tables(_book_folder(t))
    rows = sheet_grid(tables).groupBy("uri", "sheet_no").agg(F.count(F.lit(1)).alias("linhas"))
    found = sheet_heads(tables).join(rows, ["uri", "sheet_no"], "left")
    fault = F.col("error").isNotNull()
    return found.select(_book_no(), "sheet", "sheet_no", fault.alias("falha"), F.when(fault, F.lit(0)).otherwise(F.col("linhas")).alias("linhas"))


@query(
    "consolidate_sheets",
    f"""SELECT c_custkey // {_CUSTOMERS_PER_BOOK} AS livro, s.sheet, c_custkey AS codigo, c_name AS nome, c_acctbal AS saldo
        FROM customer JOIN ({_SHEETS_SQL}) s ON s.livro = c_custkey // {_CUSTOMERS_PER_BOOK} AND s.sheet = c_mktsegment
        WHERE NOT (s.livro % {_FAULTY} = 0 AND s.sheet_no = 0) AND s.sheet <> 'BUILDING'""",
)
def _(t):
    out = consolidate(_book_folder(t), sheets=SheetRule("exclude", {"BUILDING"})).consolidated
    return out.select(
        _book_no(C.ORIGIN),
        F.regexp_extract(C.ORIGIN, r"\((.*)\)$", 1).alias("sheet"),
        F.col("codigo").cast("bigint").alias("codigo"),
        "nome",
        F.col("saldo").cast("double").alias("saldo"),
    )


# One customer in so many has a field more than its header names.
_LATE = 29


def _write_late(t, place: str) -> None:
    """One file per nation with its customers in order; a few lines have a third field that no header names."""
    nations = t.customer.select(F.col("c_nationkey").alias("n")).distinct()
    header = nations.select("n", F.lit(-1).cast("bigint").alias("at"), F.lit("Chave;Nome").alias("value"))
    late = F.when(F.col("c_custkey") % _LATE == 0, F.col("c_acctbal").cast("string"))
    body = t.customer.select("c_nationkey", "c_custkey", F.concat_ws(";", "c_custkey", "c_name", late))
    lines = header.unionAll(body).repartition("n").sortWithinPartitions("n", "at")
    lines.select("value", "n").write.partitionBy("n").text(place)


def _late_folder(t):
    return open_folder(t.spark, f"{t.written('tardias', lambda p: _write_late(t, p))}/n=*")


_LATE_SQL = f"SELECT c_nationkey AS n, c_custkey AS chave, c_name AS nome, CASE WHEN c_custkey % {_LATE} = 0 THEN c_acctbal END AS column_2 FROM customer"


@query("late_columns", f"SELECT chave, nome, column_2 FROM ({_LATE_SQL})")
def _(t):
    """Fields beyond the header that first occur below the sampled lines; the layout comes from the run itself."""
    return consolidate(_late_folder(t)).consolidated.select(
        F.col("Chave").cast("bigint").alias("chave"), F.col("Nome").alias("nome"), F.col("column_2").cast("double").alias("column_2")
    )


@query("late_columns_profile", f"SELECT n, CASE WHEN count(column_2) > 0 THEN 3 ELSE 2 END AS colunas, count(*) - count(column_2) AS vazias FROM ({_LATE_SQL}) GROUP BY n")
def _(t):
    """Columns that the profile of the whole files adds to their layout."""
    found = analyze_headers(_late_folder(t))
    lines = consolidate(_late_folder(t), layout=found.layout).accounting.select("path", "rows_read")
    each = found.fingerprints.join(lines, "path")
    late = F.round(F.col("null_ratio") * F.col("rows_read")).cast("bigint")
    return each.groupBy("path").agg(
        F.count(F.lit(1)).alias("colunas"),
        F.coalesce(F.max(F.when(F.col("column") == "column_2", late)), F.max("rows_read")).alias("vazias"),
    ).select(_nation(), "colunas", "vazias")


@query("preview_source", f"SELECT chave, nome FROM ({_LATE_SQL}) WHERE n = (SELECT min(c_nationkey) FROM customer) ORDER BY chave LIMIT 30")
def _(t):
    """The first rows of one file of the folder, in its order."""
    folder = _late_folder(t)
    nation = t.customer.agg(F.min("c_nationkey")).first()[0]
    path = list_sources(folder).where(_nation() == nation).first()["path"]
    return preview(folder, path, rows=30).select(F.col("Chave").cast("bigint").alias("chave"), F.col("Nome").alias("nome"))


def _write_hidden(t, place: str) -> None:
    """Text files whose names begin with an underscore, one per 500 customers, each written by a task."""
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", F.floor(F.col("c_custkey") / _CUSTOMERS_PER_BOOK).alias("book"))

    def save(group: pd.DataFrame) -> pd.DataFrame:
        store, folder = stores.store_of(place)
        store.create_dir(folder, recursive=True)
        lines = [f"{r.c_custkey};{r.c_name};{r.c_acctbal!r}" for r in group.sort_values("c_custkey").itertuples()]
        with store.open_output_stream(f"{folder}/_{group['book'].iloc[0]}.csv") as out:
            out.write("\r\n".join(["Chave;Nome;Saldo", *lines, ""]).encode("latin-1"))
        return group[["book"]]

    rows.groupBy("book").applyInPandas(save, "book bigint").write.format("noop").mode("overwrite").save()


@query("hidden_sources", "SELECT c_custkey AS chave, c_name AS nome, c_acctbal AS saldo FROM customer")
def _(t):
    """Rows of files that Spark's readers pass over, each cut into several blocks."""
    folder = open_folder(t.spark, t.written("ocultos", lambda p: _write_hidden(t, p)))
    return consolidate(folder, small_file_bytes=0, block_bytes=4 << 10).consolidated.select(
        F.col("Chave").cast("bigint").alias("chave"), F.col("Nome").alias("nome"), F.col("Saldo").cast("double").alias("saldo")
    )


@query(
    "refresh_headers",
    """SELECT DISTINCT c_nationkey AS n, 'customer' AS tabela, 'kept' AS mudanca, 3 AS colunas FROM customer
       UNION ALL SELECT DISTINCT s_nationkey, 'supplier', 'new', 2 FROM supplier WHERE s_nationkey % 5 = 0""",
)
def _(t):
    """An analysis after files of every fifth nation have joined the folder; only these are read."""
    place = shared_folder(t.spark)
    folder = open_folder(t.spark, f"{place}/entrada/n=*")

    def save(rows: DataFrame, columns: str) -> None:
        found = rows.selectExpr(*columns.split(", ")).repartition("n").write.mode("append").partitionBy("n")
        found.option("sep", ";").option("header", True).csv(f"{place}/entrada")

    save(t.customer, "c_custkey AS Chave, c_name AS Nome, c_mktsegment AS Segmento, c_nationkey AS n")
    refresh_headers(folder, f"{place}/layout")
    save(t.supplier.where("s_nationkey % 5 = 0"), "s_suppkey AS Codigo, s_name AS Fornecedor, s_nationkey AS n")
    found = refresh_headers(open_folder(t.spark, folder.location), f"{place}/layout")
    each = found.analysis.fingerprints.groupBy("path").agg(
        F.max(F.when(F.col("column") == "Codigo", "supplier").otherwise("customer")).alias("tabela"), F.count(F.lit(1)).alias("colunas")
    )
    return each.join(found.files, "path", "left").select(_nation(), "tabela", F.coalesce("change", F.lit("kept")).alias("mudanca"), "colunas")


def _inventory(t) -> DataFrame:
    """Sheets as found in many workbooks: a user is a workbook, a kind of event one of its sheets."""
    return t.events.select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("sheet")).distinct()


_INVENTORY_SQL = "(SELECT DISTINCT 'u' || user_id AS path, event_type AS sheet, user_id FROM events)"


@query("distinct_sheets", f"SELECT DISTINCT sheet FROM {_INVENTORY_SQL}")
def _(t):
    return distinct_sheets(_inventory(t))


@query("sheets_include", f"SELECT path, sheet FROM {_INVENTORY_SQL} WHERE sheet IN ('click', 'view')")
def _(t):
    return apply_sheet_rule(_inventory(t), SheetRule("include", {"click", "view", "nada"}))


@query("sheets_exclude", f"SELECT path, sheet FROM {_INVENTORY_SQL} WHERE sheet NOT IN ('click', 'view')")
def _(t):
    return apply_sheet_rule(_inventory(t), SheetRule("exclude", {"click", "view"}))


@query(
    "sheets_reconcile",
    f"SELECT path, sheet FROM {_INVENTORY_SQL} WHERE NOT (sheet = 'click' AND user_id % 4 = 0)",
)
def _(t):
    users = t.events.select("user_id").distinct()
    path = F.concat(F.lit("u"), "user_id").alias("path")
    choices = users.where("user_id % 4 < 2").select(
        path, F.lit("click").alias("sheet"), (F.col("user_id") % 4 == 1).alias("checked")
    )
    gone = users.select(path, F.lit("gone").alias("sheet"), F.lit(True).alias("checked"))
    return reconcile_sheets(_inventory(t), choices.unionAll(gone))


def _write_lineitem(t, place: str) -> None:
    """The order lines as plain text under a header, as few big files."""
    t.lineitem.selectExpr(
        "l_orderkey AS `Pedido`",
        "l_linenumber AS `Linha`",
        "l_quantity AS `Quantidade`",
        "l_extendedprice AS `Preço`",
        "l_returnflag AS `Retorno`",
        "CAST(l_shipdate AS DATE) AS `Envio`",
    ).write.option("sep", "|").option("header", True).option("encoding", "ISO-8859-1").csv(place)


def _lineitem_run(t):
    folder = open_folder(t.spark, t.written("lineitem_csv", lambda p: _write_lineitem(t, p)), "|")
    found = analyze_headers(folder, small_file_bytes=0)
    types = folder.spark.createDataFrame(
        [
            ("pedido:numeric", C.TYPE_INTEGER),
            ("linha:numeric", C.TYPE_INTEGER),
            ("quantidade:numeric", C.TYPE_FLOAT),
            ("preco:numeric", C.TYPE_FLOAT),
            ("envio:Datetime", C.TYPE_DATE),
        ],
        "group_id string, type string",
    )
    return consolidate(
        folder,
        build_mapping(found.members, override_mapping(found.settings, types)),
        [FilterRule("Envio", C.GREATER, "1993-01-01"), FilterRule("Retorno", C.NOT_EQUAL, "A")],
        DuplicateRule(("Pedido", "Envio"), generate_report=False),
        SummaryRule(("Retorno",), (Aggregation("Quantidade", C.COUNT), Aggregation("Envio", C.MAXIMUM))),
        found.layout,
        small_file_bytes=0,
        block_bytes=_BLOCK_BYTES,
    )


@query(
    "consolidate_big_files",
    """SELECT "Retorno", count(*) AS "Quantidade_Contagem", max("Envio") AS "Envio_Máximo" FROM (
        SELECT l_returnflag AS "Retorno", l_shipdate::DATE AS "Envio",
               row_number() OVER (PARTITION BY l_orderkey, l_shipdate::DATE ORDER BY file_row_number) AS vez
        FROM (SELECT *, row_number() OVER () AS file_row_number FROM lineitem)
        WHERE l_shipdate::DATE > DATE '1993-01-01' AND l_returnflag <> 'A') WHERE vez = 1 GROUP BY "Retorno" """,
)
def _(t):
    return _lineitem_run(t).summary
