"""Sheets read one by one, widest rows, totals of a run, outputs published together, dense numbers."""

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from afluente import (
    DuplicateRule,
    FilterRule,
    SummaryRule,
    Aggregation,
    analyze_headers,
    consolidate,
    consolidate_tables,
    open_folder,
    preview,
    refresh_headers,
    write_run,
)
from afluente import constants as C
from afluente.functions.text import normalize_name
from afluente.operators.mapping import build_mapping, default_settings
from afluente.operators.outputs import chunk_rows, row_index
from afluente.plans import consolidate as runs
from afluente.plans.layout import read_layout, source_heads
from afluente.plans.publish import MANIFEST
from afluente.sources import sheetgrid, stores
from afluente.sources.delimited import delimited_lines
from afluente.sources.folder import narrowed
from afluente.sources.listing import is_hidden, list_sources
from afluente.sources.sheets import SheetRule
from afluente.sources.workbooks import workbook_files, workbook_grid, workbook_heads
from tests.test_files import rows, with_bad_cell
from workloads.workbook_bytes import workbook_bytes


def sheet(n, first=0):
    return [["id", "nome"], *[[first + i, f"n{first + i}"] for i in range(n)]]


def tables_of(spark, place, rule=SheetRule()):
    folder = open_folder(spark, place)
    return folder, sheetgrid.sheet_tables(folder, rule)


def test_each_sheet_is_a_task(spark, folder_of):
    place = folder_of({"dez.xlsx": workbook_bytes({f"S{k}": sheet(200, 1000 * k) for k in range(10)})})
    folder, tables = tables_of(spark, place)
    found = sheetgrid.read_sheets(spark, f"{tables.paths[0]}/inventory")
    per_task = found.select(F.spark_partition_id().alias("task"), "sheet_no").distinct().collect()
    assert len(per_task) == len({r["task"] for r in per_task}) == 10
    # the saved rows are found again: nothing is parsed twice
    assert sheetgrid.sheet_tables(folder) is tables
    assert not any("afluente_sheets" in d._jdf.queryExecution().toString() for d in (sheetgrid.sheet_grid(tables), sheetgrid.sheet_heads(tables)))
    sheetgrid.forget(folder)
    assert not folder.saved and not os.path.exists(tables.paths[0].removeprefix("file:"))


def test_small_sheets_share_tasks(spark, folder_of):
    place = folder_of({f"b{k}.xlsx": workbook_bytes({"A": sheet(3), "B": sheet(2)}) for k in range(60)})
    _, tables = tables_of(spark, place)
    found = sheetgrid.read_sheets(spark, f"{tables.paths[0]}/inventory")
    assert found._jdf.toJavaRDD().getNumPartitions() < 60
    assert found.where("line >= 0").count() == 60 * 7


@pytest.mark.parametrize("rule", [SheetRule(), SheetRule("include", {"B", "gone"}), SheetRule("exclude", {"A"})])
def test_sheets_equal_the_reader_of_whole_books(spark, folder_of, rule):
    good = sheet(40)
    good[30] = [29, "n29", "tarde"]
    book = workbook_bytes({"A": good, "B": good, "C": [["x"], [None]], "D": []})
    place = folder_of(
        {"a.xlsx": with_bad_cell(book, "sheet1", 33), "b.xlsx": book, "ruim.xlsx": b"no book", "velho.xls": b"\xd0\xcf\x11\xe0", "c.csv": "id;nome\n1;a\n2;b\n"}
    )
    folder, tables = tables_of(spark, place, rule)
    names = frozenset(rule.names)
    sides = (names if names and rule.mode == "include" else None, names if rule.mode == "exclude" else frozenset())
    books = workbook_files(folder)
    wanted = workbook_heads(books, *sides).drop("length")
    if names:
        wanted = wanted.where(F.col("sheet").isin(*names) if rule.mode == "include" else F.col("sheet").isNull() | ~F.col("sheet").isin(*names))
    found = sheetgrid.sheet_heads(tables).drop("length")
    if rule.mode == "exclude" or not names:
        assert found.where("error is not null").count() == wanted.where("error is not null").count()
    key = lambda df: sorted((str(r) for r in df.where("sheet is not null").collect()))
    assert key(found) == key(wanted.select(*found.columns))
    same = lambda df: sorted(str(r) for r in df.collect())
    assert same(sheetgrid.sheet_grid(tables)) == same(workbook_grid(books, *sides))


def test_only_the_parts_of_a_sheet_are_read(folder_of, monkeypatch):
    noise = random.Random(1)
    big = [[noise.random(), noise.random()] for _ in range(40_000)]
    place = folder_of({"grande.xlsx": workbook_bytes({"A": big, "B": sheet(5)})})
    path, taken = f"{place}/grande.xlsx", []

    class Counted(io.FileIO):
        def read(self, size=-1):
            data = super().read(size)
            taken.append(len(data))
            return data

    monkeypatch.setattr(stores, "opened", lambda uri: Counted(uri.removeprefix("file:")))
    reader = sheetgrid.SheetReader({"inventory": "", "cores": "1"})
    with zipfile.ZipFile(path) as book:
        part = [p for _, p in sheetgrid.workbooks.sheet_parts(book)][1]
    batches = list(reader.read(sheetgrid.Sheets([(path, 1, part)])))
    assert sum(b.num_rows for b in batches) == 6
    assert sum(taken) < os.path.getsize(path) / 10


def test_stores_that_tasks_cannot_open_keep_the_other_reader(spark, folder_of, monkeypatch):
    place = folder_of({"a.xlsx": workbook_bytes({"A": sheet(3)})})
    monkeypatch.setattr(stores, "reachable", lambda *folders: False)
    folder = open_folder(spark, place)
    assert sheetgrid.sheet_tables(folder) is None
    assert consolidate(folder).consolidated.count() == 3
    assert not stores.store_of("file:///a%20b/c+d")[1].count("%") and stores.store_of("/x y")[1] == "/x y"


def test_preview_opens_one_source(spark, folder_of):
    place = folder_of({"um [1].csv": "id;nome\n1;a\n2;b\n3;c\n", "um 1.csv": "x;y\n1;2\n", "dois.xlsx": workbook_bytes({"A": sheet(500), "B": sheet(5)}), "mau.xlsx": b"no"})
    folder = open_folder(spark, place)
    paths = {r["file"]: r["path"] for r in list_sources(folder).collect()}
    assert preview(folder, paths["um [1].csv"], rows=2).collect() == [("1", "a"), ("2", "b")]
    one = narrowed(folder, [paths["um [1].csv"]])
    assert [f.rpartition("/")[2] for f in source_heads(one).inputFiles()] == ["um%20%5B1%5D.csv"]
    assert preview(folder, paths["dois.xlsx"], "B", rows=3).collect() == [("0", "n0"), ("1", "n1"), ("2", "n2")]
    other = narrowed(folder, [paths["dois.xlsx"]])
    tables = sheetgrid.sheet_tables(other, SheetRule("include", {"A"}), rows=25)
    assert tables.inventory.count() == 1 and tables.grid.count() == 25
    assert preview(folder, f"{place}/nada.csv") is None and preview(folder, paths["mau.xlsx"]) is None


@pytest.mark.parametrize("small", [0, 4 << 20])
def test_fields_first_met_late_are_columns(spark, folder_of, small):
    late = "".join(f"{i};n{i}{';tarde;mais' if i == 30 else ''}\n" for i in range(60))
    place = folder_of({"a.csv": "Título\nid;nome\n" + late, "b.csv": "id;nome\n1;x\n2;y\n", "vazio.csv": "", "um.csv": "id\n"})
    folder = open_folder(spark, place)
    out = consolidate(folder, small_file_bytes=small)
    assert out.consolidated.columns == ["id", "nome", "column_2", "column_3", "Origem"]
    assert rows(out.consolidated.where("column_2 is not null")) == [("30", "n30", "tarde", "mais", "a.csv")]
    assert out.accounting.agg(F.sum("rows_wide"), F.sum("rows_read")).first() == (0, 62)
    found = analyze_headers(folder, small_file_bytes=small)
    names = lambda layout: {r["file"]: (r["names"], r["header_line"], r["status"]) for r in layout.collect()}
    assert names(found.layout) == names(read_layout(folder, small_file_bytes=small))
    assert names(found.layout)["a.csv"] == (["id", "nome", "column_2", "column_3"], 1, "ok")
    assert {r["column"] for r in found.fingerprints.where("file = 'a.csv'").collect()} == {"id", "nome", "column_2", "column_3"}
    few = analyze_headers(folder, small_file_bytes=small, sample_rows=5)
    assert names(few.layout) == names(found.layout)


def test_a_late_column_does_not_take_the_name_of_another(spark, folder_of):
    place = folder_of({"a.csv": "id;column_2\n" + "1;2\n" * 30 + "1;2;3\n", "b.csv": "A||B\n1||2|||\n3||4\n"})
    assert {r["file"]: r["names"] for r in read_layout(open_folder(spark, place)).collect()}["a.csv"] == ["id", "column_2_1", "column_2_2"]
    assert {r["file"]: r["names"] for r in read_layout(open_folder(spark, place, "||")).collect()}["b.csv"] == ["A", "B", "column_2"]


def a_run(spark, folder_of, limit="5"):
    place = folder_of({"a.csv": "id;v\n1;10\n2;20\n1;10\n3;5\n", "b.csv": "id;v\n1;10\n4;40\n", "vazio.csv": ""})
    return consolidate(
        open_folder(spark, place),
        filters=[FilterRule("v", C.NOT_EQUAL, limit)],
        duplicates=DuplicateRule(("id",)),
        summary=SummaryRule(("id",), (Aggregation("v", C.COUNT),)),
    )


COUNTS = ("rows_read", "rows_wide", "rows_after_filter", "rows_removed", "rows_left")


@pytest.mark.parametrize("kind,which", [("parquet", ("consolidated", "removed", "summary", "accounting")), ("csv", ("summary",)), ("sheets", ("consolidated", "removed"))])
def test_totals_equal_the_accounting(spark, folder_of, kind, which):
    out = a_run(spark, folder_of)
    report = write_run(out, folder_of({}), kind, which)
    sums = out.accounting.agg(*[F.sum(c).alias(c) for c in COUNTS]).first().asDict()
    assert report.totals == sums == {"rows_read": 6, "rows_wide": 0, "rows_after_filter": 5, "rows_removed": 2, "rows_left": 3}


def test_totals_of_a_run_that_keeps_nothing(spark, folder_of):
    out = consolidate(open_folder(spark, folder_of({"a.csv": "id;v\n1;10\n2;20\n"})), filters=[FilterRule("v", C.GREATER, "zzz")], duplicates=DuplicateRule(("id",)))
    assert write_run(out, folder_of({})).totals == {"rows_read": 2, "rows_wide": 0, "rows_after_filter": 0, "rows_removed": 0, "rows_left": 0}


def test_accounting_and_totals_of_tables(spark, folder_of):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, Origem string")
    two = spark.createDataFrame([(1, "a")], "k int, v string")
    out = consolidate_tables({"one": one, "two": two}, filters=[FilterRule("k", C.LESS, "3")], duplicates=DuplicateRule(("k",)), order={"one": ["k"], "two": ["k"]})
    found = {r["origin"]: (r["status"], r["detail"], *(r[c] for c in COUNTS)) for r in out.accounting.collect()}
    assert found == {"one": ("processed", C.ORIGIN_REPLACED, 3, 0, 2, 0, 2), "two": ("processed", None, 1, 0, 1, 1, 0)}
    report = write_run(out, folder_of({}))
    assert report.totals == {"rows_read": 4, "rows_wide": 0, "rows_after_filter": 3, "rows_removed": 1, "rows_left": 2}
    plan = out.consolidated._jdf.queryExecution().optimizedPlan().toString()
    assert "__kept" not in plan  # the mark is gone once the rows are filtered


def test_a_replaced_origin_is_in_the_audit(spark, folder_of):
    place = folder_of({"a.csv": "x;Origem\n1;here\n2;there\n", "b.csv": "x;y\n1;2\n3;4\n"})
    audit = {r["origin"]: r["detail"] for r in consolidate(open_folder(spark, place)).audit.collect()}
    assert audit == {"a.csv": C.ORIGIN_REPLACED, "b.csv": None}


@pytest.mark.parametrize("failing", ["consolidated", "summary", "accounting"])
def test_a_failed_output_leaves_nothing(spark, folder_of, monkeypatch, failing):
    out, place = a_run(spark, folder_of), folder_of({"outro.txt": "fica"})
    write = runs._write_part

    def broken(outputs, part, target, kind, counted=None):
        write(outputs, part, target, kind, counted)
        if part == failing:
            raise RuntimeError("no more room")

    monkeypatch.setattr(runs, "_write_part", broken)
    with pytest.raises(RuntimeError, match="no more room"):
        write_run(out, place)
    assert os.listdir(place) == ["outro.txt"]
    monkeypatch.setattr(runs, "_write_part", write)
    report = write_run(out, place)
    assert sorted(f for f in os.listdir(place) if not f.startswith(".")) == sorted(["outro.txt", MANIFEST, *(p.rpartition("/")[2] for p in report.places.values())])
    with open(f"{place}/{MANIFEST}") as manifest:
        assert json.load(manifest)["totals"] == report.totals
    with pytest.raises(FileExistsError):
        write_run(out, place)
    assert spark.read.parquet(report.places["consolidated"]).count() == 3


def test_a_failed_move_takes_back_the_others(spark, folder_of, monkeypatch):
    from afluente.plans.publish import Store

    out, place, move = a_run(spark, folder_of), folder_of({}), Store.move

    def broken(self, source, target):
        if target.endswith(C.SHEET_SUMMARY):
            raise OSError("gone")
        move(self, source, target)

    monkeypatch.setattr(Store, "move", broken)
    with pytest.raises(OSError, match="gone"):
        write_run(out, place)
    assert os.listdir(place) == []


def test_numbers_take_one_exchange(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id").cast("string").alias("t"))
    for found in (row_index(df, ["k"], parts=6), chunk_rows(df, ["t", "k"], 700, parts=6)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Exchange hashpartitioning(k" not in plan
        assert "Window" not in plan.split("BroadcastExchange")[0]
    numbered = sorted((r["k"], r["row_index"]) for r in row_index(df, ["k"], parts=6).collect())
    assert [n for _, n in numbered] == list(range(5000))
    same = spark.createDataFrame([(1, k) for k in range(50)], "a int, b int")
    assert sorted(r["row_index"] for r in row_index(same, ["a", "b"]).collect()) == list(range(50))
    assert row_index(same.limit(0), ["a"]).count() == 0 and chunk_rows(same.limit(0), ["a"]).count() == 0


def test_names_in_other_scripts(spark):
    cases = {
        "Имя": "imia", "Imia": "imia", "Дата": "data", "Щука Ёж": "shchukaiozh", "объект": "obekt", "Київ": "kiyiv",
        "Ελλάδα": "ellada", "Ψυχή": "psukhe", "Ｎｏｍｅ　１": "nome1", "Straße": "strasse", "Nguyễn": "nguyen", "CNPJ": "cnpj", "日本": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    found = {r["n"]: r["p"] for r in df.select("n", normalize_name(F.col("n")).alias("p")).collect()}
    assert {k: found[k] for k in cases} == cases


def test_every_cyrillic_and_greek_letter_is_spelled(spark):
    from afluente.functions.text import CYRILLIC, GREEK

    table = {**CYRILLIC, **GREEK}
    letters = spark.createDataFrame([(a, b) for a in table for b in (a, a.upper())], "letter string, shown string")
    for r in letters.select("letter", normalize_name(F.col("shown")).alias("p")).collect():
        assert r["p"] == table[r["letter"]]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_hidden_files_are_cut_into_blocks_as_others_are(spark, folder_of, monkeypatch, block):
    rnd = random.Random(block)
    ends = ["\n", "\r\n", "\r", "\n\n"]
    text = "\xef\xbb\xbfid;nome\n" + "".join(f"{i};{'é' * rnd.randint(0, 9)}{rnd.choice(ends)}" for i in range(300)) + "fim;x"
    place = folder_of({"_a.csv": text, "_b.TXT": "\n", "c.csv": "id;nome\n", ".d.xlsx": workbook_bytes({"A": sheet(4)})})
    folder = open_folder(spark, place)
    monkeypatch.setattr("afluente.sources.listing._READ_BYTES", 16)
    found = delimited_lines(folder, bytes_per_block=block).where("uri like '%_a.csv'").orderBy("block", "line").collect()
    assert [r["value"] for r in found] == [line for line in text.removeprefix("\xef\xbb\xbf").replace("\r", "\n").split("\n") if line]
    heads = {r["file"]: (r["names"], r["status"]) for r in read_layout(folder).collect()}
    assert heads == {"_a.csv": (["id", "nome"], "ok"), "c.csv": (["id", "nome"], "empty"), ".d.xlsx": (["id", "nome"], "ok")}
    assert {is_hidden(n) for n in ("_x", ".x", "_n=1")} == {True, False}


def test_odd_files_of_a_glob_are_listed_by_tasks(spark, folder_of):
    place = folder_of({})
    for n in range(5):
        os.mkdir(f"{place}/n={n}")
        for name, text in (("vazio é.csv", ""), (f"_h{n} %.csv", "id;v\n1;2\n3;4\n"), ("b.csv", "id;v\n5;6\n7;8\n")):
            with open(f"{place}/n={n}/{name}", "w") as out:
                out.write(text)
    os.mkdir(f"{place}/n=1/_fake.csv")
    folder = open_folder(spark, f"{place}/n=*")
    found = {(r["path"].removeprefix(f"file:{place}"), r["status"]) for r in list_sources(folder).collect()}
    assert found == {(f"/n={n}/{f}", s) for n in range(5) for f, s in (("vazio é.csv", "empty"), (f"_h{n} %.csv", "listed"), ("b.csv", "listed"))}
    assert consolidate(folder).consolidated.count() == 20


def test_places_and_uris():
    for place in ("file:/a b/c+d [1] é%20.csv", "hdfs://host:9000/x y/z", "s3a://bucket/k#1"):
        assert stores.unquote(stores.quoted(place)) == place
    assert stores.quoted("file:/a b/é[") == stores.quoted("/a b/é[") == "file:/a%20b/é%5B"
    assert {stores.store_of(f"{start}/a%20b/%2520")[1] for start in ("file:", "file://")} == {"/a b/%20"}


def test_a_refresh_reads_only_what_changed(spark, folder_of, monkeypatch):
    text = "id;nome\n1;a\n2;b\n"
    place, kept = folder_of({"a.csv": text, "b.csv": text, "c.csv": text, "d.xlsx": workbook_bytes({"A": sheet(5)}), "e.csv": ""}), folder_of({})

    def refresh(**options):
        found = refresh_headers(open_folder(spark, place), f"{kept}/cache", **options)
        return found.analysis, {(r["path"].rpartition("/")[2], r["change"]) for r in found.files.collect()}

    def shown(analysis):
        layout = sorted((r["file"], r["sheet"], r["names"], r["status"]) for r in analysis.layout.select("file", F.coalesce("sheet", F.lit("")).alias("sheet"), "names", "status").collect())
        prints = sorted(str(r) for r in analysis.fingerprints.select("path", "sheet", "column", "type", "null_ratio").collect())
        return layout, prints, sorted(str(r) for r in analysis.settings.collect())

    first, changes = refresh()
    assert changes == {(f, "new") for f in ("a.csv", "b.csv", "c.csv", "d.xlsx", "e.csv")}
    assert refresh()[1] == set()
    with open(f"{place}/b.csv", "a") as out:
        out.write("3;c;tarde\n")
    os.remove(f"{place}/c.csv")
    with open(f"{place}/_f.csv", "w") as out:
        out.write("x;y\n1;2\n3;4\n")
    # an unchanged file is not opened again
    before = os.stat(f"{place}/a.csv")
    with open(f"{place}/a.csv", "r+") as out:
        out.write("zz")
    os.utime(f"{place}/a.csv", ns=(before.st_atime_ns, before.st_mtime_ns))
    again, changes = refresh()
    assert changes == {("b.csv", "changed"), ("c.csv", "gone"), ("_f.csv", "new")}
    layout = {r["file"]: r["names"] for r in again.layout.collect()}
    assert layout == {"a.csv": ["id", "nome"], "b.csv": ["id", "nome", "column_2"], "d.xlsx": ["id", "nome"], "_f.csv": ["x", "y"], "e.csv": []}
    with open(f"{place}/a.csv", "r+") as out:
        out.write("id")
    os.utime(f"{place}/a.csv", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert shown(again) == shown(analyze_headers(open_folder(spark, place)))
    assert len([f for f in os.listdir(f"{kept}/cache") if f.startswith("v-")]) == 1
    assert consolidate(open_folder(spark, place), again.mapping(), layout=again.layout).consolidated.count() == 2 + 3 + 5 + 2
    # other sheets, another start
    assert len(refresh(sheets=SheetRule("exclude", {"A"}))[1]) == 5


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_settings_reach_hot_groups_without_a_hot_task(spark, limit):
    members = spark.range(4000).select(
        F.when(F.col("id") % 3 > 0, F.lit("cnpj:numeric")).otherwise(F.concat(F.lit("g"), (F.col("id") % 500).cast("string"))).alias("group_id"),
        F.lit(0).alias("tier"), F.array().cast("array<int>").alias("lead"), F.lit("n").alias("normalized"), F.lit("numeric").alias("type_class"),
        F.concat(F.lit("c"), "id").alias("column"), F.concat(F.lit("f"), "id").alias("path"), F.lit(None).cast("string").alias("sheet"),
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit("f"), "id").alias("path"), F.lit(0).alias("sheet_no"), F.lit(0).alias("column_no")).alias("position"),
    )
    settings = default_settings(members)
    found = build_mapping(members, settings, broadcast_limit=limit)
    names = {r["group_id"]: r["final_name"] for r in settings.collect()}
    assert sorted((r["path"], r["final_name"]) for r in found.collect()) == sorted((r["path"], names[r["group_id"]]) for r in members.collect())
    if limit:
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert build_mapping(members.limit(0), settings.limit(0), broadcast_limit=limit).count() == 0


def test_an_old_layout_is_in_the_audit(spark, folder_of):
    place = folder_of({"a.csv": "id;v\n1;2\n3;4\n", "b.csv": "id;v\n1;2\n3;4\n", "c.csv": "id;v\n1;2\n3;4\n"})
    layout = read_layout(open_folder(spark, place))
    with open(f"{place}/a.csv", "a") as out:
        out.write("5;6\n")
    os.remove(f"{place}/b.csv")
    audit = {r["origin"]: r["status"] for r in consolidate(open_folder(spark, place), layout=layout).audit.collect()}
    assert audit == {"a.csv": "stale", "b.csv": "gone", "c.csv": "processed"}
