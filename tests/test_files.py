"""Runs over small messy files, with hand-written expected rows."""

import glob
import io
import os
import re
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from afluente import Aggregation, DuplicateRule, FilterRule, SummaryRule, analyze_headers, consolidate, open_folder, preview
from afluente import constants as C
from afluente.operators.mapping import mapping_from_rows
from afluente.operators.combine import keep_first
from afluente.operators.outputs import chunk_rows
from afluente.plans.consolidate import write_outputs
from afluente.plans.layout import read_layout
from afluente.sources import stores
from afluente.sources.delimited import delimited_grid, delimited_lines
from afluente.sources.listing import list_sources
from afluente.sources.sheets import SheetRule, distinct_sheets
from afluente.sources.workbooks import list_sheets, workbook_files
from workloads.workbook_bytes import workbook_bytes

TITLED = "Relatório de vendas\n\nCódigo;Nome;Valor\n1;Ana;10\n2;Bia;20\n3;Caio;30\n4;Davi;40\n5;Eva;50\n"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def layout_of(spark, place, separator=";"):
    found = read_layout(open_folder(spark, place, separator)).collect()
    return {r["file"]: r for r in found}


def test_lists_and_routes_files_in_any_case(spark, folder_of):
    place = folder_of({"a.csv": "x", "B.TXT": "y", "c.xlsx": b"z", "d.xls": b"z", "e.pdf": b"q", "f é+1.CSV": "w"})
    found = list_sources(open_folder(spark, place)).select("file", "rank", "route").orderBy("rank", "file")
    assert [tuple(r) for r in found.collect()] == [
        ("c.xlsx", 0, "workbook"),
        ("a.csv", 1, "delimited"),
        ("f é+1.CSV", 1, "delimited"),
        ("d.xls", 2, "workbook"),
        ("B.TXT", 3, "delimited"),
    ]


def test_empty_folder(spark, folder_of):
    folder = open_folder(spark, folder_of({"note.pdf": b"q"}))
    assert list_sources(folder).count() == 0
    assert delimited_lines(folder) is None
    with pytest.raises(FileNotFoundError):
        read_layout(folder)


def test_separator_must_be_given(spark):
    with pytest.raises(ValueError):
        open_folder(spark, "/tmp", "")


@pytest.mark.parametrize("small", [0, 4 << 20])
def test_grid_keeps_quotes_cuts_nothing_and_drops_blank_lines(spark, folder_of, small):
    place = folder_of({"r.csv": 'a;b;c\r\n\r\n1;"x;y\\\r\n2\r\n;é;z;w\r\n'})
    found = delimited_grid(open_folder(spark, place), small).orderBy("block", "line")
    assert [(r["line"], r["cells"]) for r in found.collect()] == [
        (0, ["a", "b", "c"]),
        (1, ["1", '"x', "y\\"]),
        (2, ["2"]),
        (3, ["", "é", "z", "w"]),
    ]


@pytest.mark.parametrize("separator", ["|", "\t", "||", "\\"])
def test_separator_is_literal(spark, folder_of, separator):
    place = folder_of({"r.txt": separator.join(["x", "y", "z"]) + "\n"})
    found = delimited_grid(open_folder(spark, place, separator)).first()
    assert found["cells"] == ["x", "y", "z"]


@pytest.mark.parametrize("small", [0, 4 << 20])
def test_header_below_title(spark, folder_of, small):
    place = folder_of({"titled.csv": TITLED})
    found = read_layout(open_folder(spark, place), small_file_bytes=small).first()
    assert (found["header_line"], found["names"], found["status"]) == (1, ["Código", "Nome", "Valor"], "ok")


def test_header_names(spark, folder_of):
    place = folder_of(
        {
            "dup.csv": "Valor;Valor;;Nome\n1;2;3;x\n4;5;6;y\n",
            "clash.csv": "A;A;A_1\nx;x;z\nu;u;w\n",
            "one.csv": "a;b\n",
            "empty.csv": "",
            "blank.csv": "\n\n",
            "digits.csv": "1;2\n3;4\n5;6\n",
        }
    )
    found = layout_of(spark, place)
    assert found["dup.csv"]["names"] == ["Valor_1", "Valor_2", "column_2", "Nome"]
    assert (found["clash.csv"]["status"], found["clash.csv"]["names"]) == ("error", ["A_1", "A_2", "A_1"])
    assert [found[f]["status"] for f in ("one.csv", "blank.csv", "empty.csv")] == ["empty"] * 3
    assert found["digits.csv"]["header_line"] == 0


def test_analysis_groups_by_name_and_type(spark, folder_of):
    place = folder_of(
        {
            "a.csv": "CNPJ,valor,dia\n11,10,2024-01-02\n12,20,2024-01-03\n",
            "b.csv": "C.N.P.J.,valor,dia\n13,1.5,03/01/2024\n14,2.5,04/01/2024\n",
            "c.csv": "cnpj_cliente,Valor,dia\n15,abc,x\n16,def,y\n",
        }
    )
    result = analyze_headers(open_folder(spark, place, ","))
    types = {(r["file"], r["column"]): r["type"] for r in result.fingerprints.collect()}
    assert types[("a.csv", "valor")] == "Int64" and types[("b.csv", "valor")] == "Float64"
    assert types[("b.csv", "dia")] == "Datetime" and types[("c.csv", "dia")] == "String"
    groups = {r["group_id"]: (r["suggested"], r["final_name"]) for r in result.settings.collect()}
    assert groups == {
        "cnpj:numeric": ("CNPJ", "CNPJ"),
        "cnpjcliente:numeric": ("cnpj_cliente", "cnpj_cliente"),
        "valor:numeric": ("valor", "valor"),
        "valor:String": ("Valor", "Valor"),
        "dia:Datetime": ("dia", "dia"),
        "dia:String": ("dia", "dia"),
    }
    shown = [r["group_id"] for r in result.settings.orderBy("display").collect()]
    assert shown == ["cnpj:numeric", "valor:numeric", "valor:String", "dia:Datetime", "dia:String", "cnpjcliente:numeric"]
    assert result.mapping().count() == 9
    # names that differ only in letter case stay apart
    out = consolidate(open_folder(spark, place, ","), result.mapping(), layout=result.layout).consolidated
    assert out.columns == ["CNPJ", "valor", "dia", "cnpj_cliente", "Valor", "Origem"]
    assert rows(out.where("Origem = 'c.csv'").select("cnpj_cliente", "Valor")) == [("15", "abc"), ("16", "def")]


def paths_of(layout):
    return {r["file"]: r["path"] for r in layout.select("file", "path").collect()}


@pytest.mark.parametrize("small,limit", [(0, 0), (4 << 20, 1 << 20)])
def test_mapped_run(spark, folder_of, small, limit):
    place = folder_of(
        {
            "a.csv": "Relatório;;;\nid;nome;valor;valor2\n1;Ana;10;\n2;Bia;;20\n3;;x;\n",
            "b é.csv": "codigo;cliente\n1;Ana\n9;Zé\n",
            "c.txt": "nada;outro\n1;2\n3;4\n",
        }
    )
    folder = open_folder(spark, place)
    layout = read_layout(folder, small_file_bytes=small)
    paths = paths_of(layout)
    mapping = mapping_from_rows(
        spark,
        [
            ("id", paths["a.csv"], None, "id", C.TYPE_INTEGER, True),
            ("nome", paths["a.csv"], None, "nome", C.TYPE_TEXT, True),
            ("valor", paths["a.csv"], None, "valor", C.TYPE_FLOAT, True),
            ("valor2", paths["a.csv"], None, "valor", C.TYPE_FLOAT, True),
            ("codigo", paths["b é.csv"], None, "id", C.TYPE_INTEGER, True),
            ("cliente", paths["b é.csv"], None, "nome", C.TYPE_TEXT, True),
            ("nada", paths["c.txt"], None, "nada", C.TYPE_TEXT, False),
        ],
    )
    out = consolidate(folder, mapping, layout=layout, small_file_bytes=small, broadcast_limit=limit)
    assert out.consolidated.columns == ["id", "nome", "valor", "Origem"]
    assert sorted(out.consolidated.collect(), key=str) == sorted(
        [(1, "Ana", 10.0, "a.csv"), (2, "Bia", 20.0, "a.csv"), (3, None, None, "a.csv"), (1, "Ana", None, "b é.csv"), (9, "Zé", None, "b é.csv")],
        key=str,
    )
    assert {r["origin"]: r["status"] for r in out.audit.collect()} == {
        "a.csv": "processed", "b é.csv": "processed", "c.txt": "unmatched",
    }
    filtered = consolidate(
        folder, mapping, [FilterRule("valor", C.GREATER, "15")], layout=layout, small_file_bytes=small
    ).consolidated
    # the second file has no such column, so the rule leaves its rows alone
    assert sorted(r["id"] for r in filtered.collect()) == [1, 2, 9]
    deduplicated = consolidate(
        folder,
        mapping,
        duplicates=DuplicateRule(("nome",)),
        summary=SummaryRule(("nome",), (Aggregation("valor", C.SUM), Aggregation("valor", C.UNIQUE_COUNT))),
        layout=layout,
        small_file_bytes=small,
    )
    assert sorted(r["id"] for r in deduplicated.consolidated.collect()) == [1, 2, 3, 9]
    assert [tuple(r) for r in deduplicated.removed.collect()] == [(1, "Ana", None, "b é.csv")]
    assert [tuple(r) for r in deduplicated.summary.collect()] == [
        (None, 0.0, 1), ("Ana", 10.0, 1), ("Bia", 20.0, 1), ("Zé", 0.0, 1),
    ]


def test_unmapped_run_keeps_all_columns(spark, folder_of):
    place = folder_of({"a.csv": "x;Origem\n1;here\n2;there\n", "b.csv": "y;x\nq;3\nr;4\n"})
    out = consolidate(open_folder(spark, place)).consolidated
    assert out.columns == ["x", "y", "Origem"]
    assert sorted(tuple(r) for r in out.collect()) == [
        ("1", None, "a.csv"), ("2", None, "a.csv"), ("3", "q", "b.csv"), ("4", "r", "b.csv"),
    ]


def test_unknown_key_is_refused(spark, folder_of):
    place = folder_of({"a.csv": "x;y\n1;a\n2;b\n"})
    with pytest.raises(ValueError, match="zzz"):
        consolidate(open_folder(spark, place), duplicates=DuplicateRule(("zzz",)))


def test_line_order_across_blocks(spark, folder_of):
    lines = "".join(f"{i};{i % 7};texto {i}\n" for i in range(60_000))
    place = folder_of({"big.csv": "título\nid;grupo;texto\n" + lines, "small.csv": "id;grupo;texto\n-1;3;x\n-2;4;y\n"})
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        folder = open_folder(spark, place)
        grid = delimited_grid(folder, 1000).where("uri like '%big.csv'")
        assert grid.select("block").distinct().count() > 5
        for limit in (0, 1 << 20):
            out = consolidate(folder, duplicates=DuplicateRule(("grupo",)), small_file_bytes=1000, broadcast_limit=limit)
            assert out.removed.count() + out.consolidated.count() == 60_002
            kept = sorted(int(r["id"]) for r in out.consolidated.collect())
            assert kept == [0, 1, 2, 3, 4, 5, 6]
        everything = consolidate(folder, small_file_bytes=1000)
        chunks = everything.chunks(25_000)
        found = {r["chunk"]: (r["n"], r["low"], r["high"]) for r in chunks.groupBy("chunk").agg(
            F.count("*").alias("n"), F.min(F.col("id").cast("int")).alias("low"), F.max(F.col("id").cast("int")).alias("high")).collect()}
        assert found == {
            "Dados_Consolidados_1": (25_000, 0, 24_999),
            "Dados_Consolidados_2": (25_000, 25_000, 49_999),
            "Dados_Consolidados_3": (10_002, -2, 59_999),
        }
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_preview(spark, folder_of):
    place = folder_of({"titled.csv": TITLED, "one.csv": "a;b\n"})
    folder = open_folder(spark, place)
    paths = paths_of(read_layout(folder))
    found = preview(folder, paths["titled.csv"], rows=2)
    assert found.columns == ["Código", "Nome", "Valor"]
    assert [tuple(r) for r in found.collect()] == [("1", "Ana", "10"), ("2", "Bia", "20")]
    assert preview(folder, paths["one.csv"]) is None


@pytest.mark.parametrize("small", [0, 4 << 20])
def test_preview_gives_the_rows_asked_for(spark, folder_of, small):
    place = folder_of({"long.csv": "id;nome\n" + "".join(f"{i};x\n" for i in range(80))})
    folder = open_folder(spark, place)
    path = paths_of(read_layout(folder))["long.csv"]
    for asked, given in ((50, 50), (100, 80)):
        found = preview(folder, path, rows=asked, small_file_bytes=small)
        assert [r["id"] for r in found.collect()] == [str(i) for i in range(given)]


def books():
    return {
        "a.xlsx": workbook_bytes(
            {
                "Jan": [["Vendas"], ["id", "nome", "dia", "ok"], [1, "Ana", (45292,), True], [2.5, "Bia", (45293.5,), False]],
                "Fev": [["id", "nome"], [3, "Caio"], [None, None], [4, "Davi"]],
            }
        ),
        "b.xlsx": workbook_bytes({"Jan": [["id", "nome"], [5, "Eva"], [6, "Zé & <b>"]], "Notas": [["x"]]}),
        "broken.xlsx": b"not a workbook",
        "old.xls": b"\xd0\xcf\x11\xe0",
    }


def test_workbooks(spark, folder_of):
    place = folder_of({**books(), "c.csv": "id;nome\n7;Gil\n8;Hugo\n"})
    folder = open_folder(spark, place)
    inventory = list_sheets(workbook_files(folder))
    listed = inventory.where("sheet is not null").select("file", "sheet_no", "sheet")
    assert rows(listed) == [("a.xlsx", 0, "Jan"), ("a.xlsx", 1, "Fev"), ("b.xlsx", 0, "Jan"), ("b.xlsx", 1, "Notas")]
    assert inventory.where("error is not null").count() == 2
    assert [r["sheet"] for r in distinct_sheets(inventory).collect()] == ["Fev", "Jan", "Notas"]

    out = consolidate(folder)
    assert out.consolidated.columns == ["id", "nome", "dia", "ok", "Origem"]
    assert sorted((tuple(r) for r in out.consolidated.collect()), key=str) == [
        ("1", "Ana", "2024-01-01", "true", "a.xlsx (Jan)"),
        ("2.5", "Bia", "2024-01-02 12:00:00", "false", "a.xlsx (Jan)"),
        ("3", "Caio", None, None, "a.xlsx (Fev)"),
        ("4", "Davi", None, None, "a.xlsx (Fev)"),
        ("5", "Eva", None, None, "b.xlsx (Jan)"),
        ("6", "Zé & <b>", None, None, "b.xlsx (Jan)"),
        ("7", "Gil", None, None, "c.csv"),
        ("8", "Hugo", None, None, "c.csv"),
    ]
    assert {r["origin"]: r["status"] for r in out.audit.collect()} == {
        "a.xlsx (Jan)": "processed",
        "a.xlsx (Fev)": "processed",
        "b.xlsx (Jan)": "processed",
        "b.xlsx (Notas)": "empty",
        "broken.xlsx": "error",
        "old.xls": "error",
        "c.csv": "processed",
    }
    assert preview(folder, paths_of(read_layout(folder))["b.xlsx"], "Jan").first()["nome"] == "Eva"


@pytest.mark.parametrize(
    "rule,expected",
    [
        (SheetRule("include", {"Jan"}), {"a.xlsx (Jan)", "b.xlsx (Jan)", "c.csv"}),
        (SheetRule("exclude", {"Jan"}), {"a.xlsx (Fev)", "c.csv"}),
        (SheetRule("include", set()), {"a.xlsx (Jan)", "a.xlsx (Fev)", "b.xlsx (Jan)", "c.csv"}),
    ],
)
def test_sheet_rules(spark, folder_of, rule, expected):
    place = folder_of({**books(), "c.csv": "id;nome\n7;Gil\n8;Hugo\n"})
    out = consolidate(open_folder(spark, place), sheets=rule).consolidated
    assert {r["Origem"] for r in out.select("Origem").distinct().collect()} == expected


def test_sheet_choices(spark, folder_of):
    place = folder_of(books())
    folder = open_folder(spark, place)
    paths = paths_of(read_layout(folder))
    choices = spark.createDataFrame(
        [(paths["a.xlsx"], "Jan", False), (paths["a.xlsx"], "Gone", True)], "path string, sheet string, checked boolean"
    )
    layout = read_layout(folder, choices=choices)
    out = consolidate(folder, layout=layout).consolidated
    assert {r["Origem"] for r in out.select("Origem").distinct().collect()} == {"a.xlsx (Fev)", "b.xlsx (Jan)"}


def test_plan_does_not_grow_with_the_folder(spark, folder_of):
    def plan_lines(count):
        place = folder_of({f"f{i}.csv": f"id;nome\n{i};a\n{i};b\n" for i in range(count)})
        out = consolidate(open_folder(spark, place), duplicates=DuplicateRule(("id",)))
        assert out.consolidated.count() == count
        return len(out.consolidated._jdf.queryExecution().executedPlan().toString().splitlines())

    assert plan_lines(2) == plan_lines(60)


def test_data_is_joined_without_a_shuffle(spark, folder_of):
    place = folder_of({"a.csv": "id;nome\n1;a\n2;b\n"})
    plan = consolidate(open_folder(spark, place)).consolidated._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_head_of_a_big_file(spark, folder_of):
    place = folder_of({"big.csv": "id;nome\n" + "".join(f"{i};x\n" for i in range(50_000))})
    layout = read_layout(open_folder(spark, place), small_file_bytes=1000).first()
    assert (layout["names"], len(layout["rows"]), layout["status"]) == (["id", "nome"], 20, "ok")


@pytest.mark.parametrize("most", ["1", "3"])
def test_no_file_is_lost_to_packing(spark, folder_of, most):
    place = folder_of({f"f{k}.csv": "A;B\n" + "".join(f"{k};{n}\n" for n in range(5)) for k in range(6)})
    packed = spark.newSession()
    packed.conf.set("spark.sql.files.maxPartitionNum", most)
    found = consolidate(open_folder(packed, place, ";"), small_file_bytes=0).consolidated
    assert sorted((r["A"], r["B"]) for r in found.collect()) == sorted((str(k), str(n)) for k in range(6) for n in range(5))


@pytest.mark.parametrize("fault_row", [6, 21, 22, 40])
def test_a_faulty_sheet_does_not_touch_its_neighbours(spark, folder_of, fault_row):
    good = [["id", "nome"], *[[i, f"n{i}"] for i in range(1, 41)]]
    book = workbook_bytes({"A": good, "B": good, "C": good})
    place = folder_of({"livro.xlsx": with_bad_cell(book, "sheet1", fault_row), "outro.xlsx": workbook_bytes({"A": good})})
    folder = open_folder(spark, place)
    out = consolidate(folder)
    assert {r["Origem"]: r["count"] for r in out.consolidated.groupBy("Origem").count().collect()} == {
        "livro.xlsx (B)": 40, "livro.xlsx (C)": 40, "outro.xlsx (A)": 40,
    }
    audit = {r["origin"]: r["status"] for r in out.audit.collect()}
    assert audit == {"livro.xlsx (A)": "error", "livro.xlsx (B)": "processed", "livro.xlsx (C)": "processed", "outro.xlsx (A)": "processed"}
    # an excluded sheet is not even looked at
    without = consolidate(folder, sheets=SheetRule("exclude", {"A"}))
    assert {r["origin"]: r["status"] for r in without.audit.collect()} == {"livro.xlsx (B)": "processed", "livro.xlsx (C)": "processed"}
    assert without.consolidated.count() == 80


def with_bad_cell(book: bytes, sheet: str, row: int) -> bytes:
    """The book with a number that is none in one row of a sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            data = old.read(name).decode()
            if name.endswith(f"{sheet}.xml"):
                data, hits = re.subn(rf'(r="A{row}"><v>)[0-9]+', r"\1zz", data)
                assert hits == 1
            new.writestr(name, data)
    return out.getvalue()


def test_sheets_keep_columns_that_are_first_filled_late(spark, folder_of):
    body = [[i, "x"] for i in range(30)]
    body[28] = [28, "x", "tarde"]
    place = folder_of({"a.xlsx": workbook_bytes({"S": [["id", "nome"], *body]})})
    out = consolidate(open_folder(spark, place)).consolidated
    assert out.columns == ["id", "nome", "column_2", "Origem"]
    assert [r["column_2"] for r in out.where("id = '28'").collect()] == ["tarde"]


def test_hidden_and_empty_files_are_listed_and_audited(spark, folder_of, monkeypatch):
    good = "id;nome\n1;a\n2;b\n"
    place = folder_of({"_vendas.csv": good, ".oculto.txt": good, "_vazio.csv": "", "vazio.csv": "", "bom.csv": good, "_nota.pdf": b"q"})
    folder = open_folder(spark, place)
    listed = {r["file"]: r["status"] for r in list_sources(folder).collect()}
    assert listed == {"_vendas.csv": "listed", ".oculto.txt": "listed", "_vazio.csv": "skipped", "vazio.csv": "empty", "bom.csv": "listed"}
    out = consolidate(folder)
    audit = {r["origin"]: r["status"] for r in out.audit.collect()}
    assert audit == {"_vendas.csv": "processed", ".oculto.txt": "processed", "_vazio.csv": "skipped", "vazio.csv": "empty", "bom.csv": "processed"}
    assert out.consolidated.count() == 6
    # in a store that tasks cannot open, hidden names are only known
    monkeypatch.setattr(stores, "reachable", lambda *folders: False)
    far = consolidate(open_folder(spark, place))
    assert {r["origin"]: r["status"] for r in far.audit.collect()} == audit | {"_vendas.csv": "skipped", ".oculto.txt": "skipped"}
    assert far.consolidated.count() == 2


def test_accounting_of_a_run(spark, folder_of):
    place = folder_of(
        {
            "a.csv": "id;v\n1;10\n2;20;sobra\n1;10\n3;5\n",
            "b.csv": "id;v\n1;10\n4;40\n",
            "vazio.csv": "",
            "um.csv": "id;v\n",
        }
    )
    out = consolidate(open_folder(spark, place), filters=[FilterRule("v", C.NOT_EQUAL, "5")], duplicates=DuplicateRule(("id",)))
    columns = ("rows_read", "rows_wide", "rows_after_filter", "rows_removed", "rows_left")
    found = {r["origin"]: tuple(r[c] for c in columns) for r in out.accounting.collect()}
    assert found["a.csv"][0] == 4 and found["a.csv"][2:] == (3, 1, 2)
    assert found["b.csv"] == (2, 0, 2, 1, 1)
    assert found["vazio.csv"] == found["um.csv"] == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("kind", ["parquet", "csv", "sheets"])
def test_outputs_read_the_sources_once(spark, folder_of, kind):
    place = folder_of({"a.csv": "id;v\n1;10\n2;20\n1;10\n", "b.csv": "id;v\n1;10\n4;40\n"})
    out = consolidate(
        open_folder(spark, place), duplicates=DuplicateRule(("id",)), summary=SummaryRule(("id",), (Aggregation("v", C.COUNT),))
    )
    target = folder_of({}) + "/out"
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    seen = []
    rebuild = out.rebuild

    def watched(saved):
        again = rebuild(saved)
        seen.extend([again.consolidated, again.removed, again.summary])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
        # what comes from the sources is read as binaryFile or text, what was saved as parquet
        assert not any("binaryFile" in p or "Format: Text" in p or "mapInArrow" in p for p in plans)
        return again

    places = write_outputs(replace(out, rebuild=watched), target, kind)
    assert len(seen) == 3 and set(places) == {"consolidated", "removed", "summary", "accounting"}
    if kind != "csv":
        assert spark.read.parquet(places["consolidated"]).count() == 3
        removed = spark.read.parquet(places["removed"])
        assert removed.count() == 2
        assert ("chunk" in removed.columns) == (kind == "sheets")
    made = {f for f in os.listdir(shared) if glob.glob(f"{shared}/{f}/*.parquet")} - before
    assert not [f for f in made if "__kept" in spark.read.parquet(f"{shared}/{f}").columns]


def test_user_columns_with_the_names_of_helpers_survive(spark):
    rows = [(1, "p", "q", 7, 8, 9), (2, "r", "s", 1, 2, 3), (1, "t", "u", 4, 5, 6)]
    df = spark.createDataFrame(rows, "id int, _part string, _place string, _index int, _before int, _total int")
    assert sorted(tuple(r)[:-1] for r in chunk_rows(df, ["_index"]).collect()) == sorted(rows)
    assert sorted(tuple(r)[:-1] for r in chunk_rows(df, ["_part", "id"]).collect()) == sorted(rows)
    assert sorted(tuple(r) for r in keep_first(df, ["id"], ["_index"]).collect()) == sorted(rows[1:])


def test_types_are_those_of_all_rows(spark, folder_of):
    place = folder_of({"a.csv": "id;v\n" + "".join(f"{i};{i}\n" for i in range(30)) + "".join(f"{i};t\n" for i in range(70))})
    folder = open_folder(spark, place)

    def types(**options):
        return {r["column"]: r["type"] for r in analyze_headers(folder, **options).fingerprints.collect()}

    assert types() == types(small_file_bytes=0) == {"id": "Int64", "v": "String"}
    assert types(sample_rows=20) == {"id": "Int64", "v": "Int64"}
