"""Operators against plain-Python models and invariants."""

import datetime as dt
import itertools
import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from afluente import Aggregation, DuplicateRule, FilterRule, SummaryRule, consolidate_tables, write_outputs
from afluente import constants as C
from afluente.functions.casts import fraction_to_text
from afluente.functions.text import normalize_name
from afluente.functions.types import common_type
from afluente.operators.combine import (
    combine,
    duplicate_counts,
    keep_first,
    removed_duplicates,
    union_frames,
)
from afluente.operators.filters import apply_filters, compile_filter
from afluente.operators.headers import header_line, with_unique_names
from afluente.operators.mapping import mapping_from_rows, merge_groups
from afluente.operators.outputs import read_csv, row_index, write_csv
from afluente.operators.summary import summary_table
from afluente.plans.consolidate import TableMapping
from afluente.session import shared_folder


# --- header row ---------------------------------------------------------------------------


def expected_header(grid):
    """The header rule, worked out row by row."""

    def score(row, below):
        filled = [c for c in row if c is not None]
        look = -100.0
        if filled:
            visible = [c.strip() for c in filled if c.strip()]
            look = len(set(filled)) / len(filled) * 3
            look += len(visible) / len(filled) * 3
            look -= sum(c.isnumeric() for c in visible) / len(filled) * 5
            look -= (len(row) - len(filled)) / len(row) * 2
        change = 0.0
        for a, b in zip(row, below):
            if (a is None) == (b is None):
                change -= 0.2
        return look + change / len(row) * 5

    scores = [score(a, b) for a, b in zip(grid, grid[1:])]
    return scores.index(max(scores)) if scores else 0


def test_header_line_follows_the_rule(spark):
    rng = random.Random(11)
    words = [None, None, "a", "b", "nome", "1", "22", " 3 ", "½", "x1", " ", "\xa0", "2,5"]
    grids = []
    for number in range(800):
        width = rng.randint(1, 7)
        grids.append((number, [[rng.choice(words) for _ in range(width)] for _ in range(rng.randint(0, 20))]))
    found = spark.createDataFrame(grids, "n int, rows array<array<string>>").select("n", header_line(F.col("rows")).alias("h"))
    assert {r["n"]: r["h"] for r in found.collect()} == {n: expected_header(g) for n, g in grids}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["A", "B", "A_1", "", "é"]), max_size=9), min_size=1, max_size=40))
def test_unique_names(spark, lists):
    def numbered(names):
        total, seen, result = Counter(names), Counter(), []
        for name in names:
            seen[name] += 1
            result.append(f"{name}_{seen[name]}" if total[name] > 1 else name)
        return result

    frame = spark.createDataFrame(list(enumerate(lists)), "n int, raw array<string>")
    found = with_unique_names(frame, F.col("raw")).select("n", "names").collect()
    assert {r["n"]: r["names"] for r in found} == {n: numbered(names) for n, names in enumerate(lists)}


def test_normalize_name_on_latin1(spark):
    special = {"ß": "ss", "æ": "ae", "ø": "o", "ð": "d", "þ": "th"}

    def plain(text):
        folded = "".join(special.get(c, c) for c in text.lower())
        return "".join(c for c in unicodedata.normalize("NFKD", folded) if c.isascii() and c.isalnum()).lower()

    texts = [chr(c) for c in range(0x20, 0x100)] + ["Endereço", "C.N.P.J.", "Nº do Pedido", "Straße", "valor_ICMS-2"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_name(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in found.collect()} == {t: plain(t) for t in texts}


# --- filters ------------------------------------------------------------------------------

TABLE = [
    (0, "abc", 5, 1.5, dt.date(2024, 1, 2), True),
    (1, "abd", -3, 2.5, dt.date(2024, 2, 3), False),
    (2, "", 0, 0.0, dt.date(1999, 12, 31), True),
    (3, None, None, None, None, None),
    (4, "Zb c", 12, -1.0, dt.date(2024, 1, 3), False),
]
SCHEMA = "n int, texto string, inteiro bigint, real double, dia date, sim boolean"


def kept(spark, *rules):
    return [r["n"] for r in apply_filters(spark.createDataFrame(TABLE, SCHEMA), [FilterRule(*r) for r in rules]).orderBy("n").collect()]


@pytest.mark.parametrize(
    "rules,expected",
    [
        ([("texto", C.EQUAL, " abc ")], [0]),
        ([("texto", C.NOT_EQUAL, "abc")], [1, 2, 4]),
        ([("texto", C.GREATER, "abc")], [1]),
        ([("texto", C.LESS, "abc")], [2, 4]),
        ([("texto", C.BETWEEN, ["abc", "abd"])], [0, 1]),
        ([("texto", C.CONTAINS, "b")], [0, 1, 4]),
        ([("texto", C.NOT_CONTAINS, "b")], [2]),
        ([("texto", C.STARTS_WITH, "ab")], [0, 1]),
        ([("texto", C.ENDS_WITH, "c")], [0, 4]),
        ([("texto", C.IS_BLANK)], [3]),
        ([("texto", C.NOT_BLANK)], [0, 1, 2, 4]),
        ([("inteiro", C.GREATER, "-1")], [0, 2, 4]),
        ([("inteiro", C.EQUAL, "5.0")], []),
        ([("real", C.LESS, "1.5")], [2, 4]),
        ([("dia", C.BETWEEN, ["01/01/2024", "2024-01-31"])], [0, 4]),
        ([("dia", C.EQUAL, "2024")], []),
        ([("sim", C.EQUAL, "TRUE")], [0, 2]),
        ([("sim", C.NOT_EQUAL, "true")], [1, 4]),
        ([("sim", C.EQUAL, "yes")], []),
        ([("inteiro", C.CONTAINS, "1")], [0, 1, 2, 3, 4]),
        ([("texto", C.EQUAL, "abc"), ("texto", C.IS_BLANK)], [0, 3]),
        ([("inteiro", C.GREATER, "6"), ("inteiro", C.LESS, "0"), ("inteiro", C.BETWEEN, ["0", "0"])], [1, 2, 4]),
        ([("texto", C.CONTAINS, "b"), ("texto", C.NOT_EQUAL, "abd"), ("texto", C.NOT_CONTAINS, "Zb")], [0]),
        ([("texto", C.CONTAINS, "b"), ("inteiro", C.GREATER, "0"), ("dia", C.NOT_EQUAL, "2024-01-02")], [4]),
        ([("inteiro", C.EQUAL, "x"), ("inteiro", C.EQUAL, "5")], [0]),
        ([("inteiro", C.NOT_EQUAL, "x")], []),
    ],
)
def test_filter_rules(spark, rules, expected):
    assert kept(spark, *rules) == expected


def test_ignored_rules_are_reported():
    types = {"texto": T.StringType(), "inteiro": T.LongType()}
    rules = [
        FilterRule(None, C.EQUAL, "1"),
        FilterRule("nada", C.EQUAL, "1"),
        FilterRule("texto", None, "1"),
        FilterRule("texto", C.IS_BLANK, None),
        FilterRule("texto", C.EQUAL, " "),
        FilterRule("texto", C.BETWEEN, ["a", ""]),
        FilterRule("texto", C.BETWEEN, "ab"),
        FilterRule("texto", "Parecido com", "a"),
        FilterRule("inteiro", C.ENDS_WITH, "1"),
    ]
    found = compile_filter(rules, types)
    assert found.predicate is None
    assert [i.rule for i in found.ignored] == rules


# --- types and union ----------------------------------------------------------------------


def test_common_type_over_all_mixtures():
    kinds = {
        "int": T.LongType(),
        "float": T.DoubleType(),
        "text": T.StringType(),
        "temporal": T.DateType(),
        "bool": T.BooleanType(),
        "null": T.NullType(),
    }

    def expected(names):
        rest = names - {"null"}
        if "text" in rest or not rest:
            return T.StringType()
        number = rest & {"int", "float"}
        if len(rest - number) + bool(number) > 1:
            return T.StringType()
        return kinds["float" if "float" in rest else next(iter(rest))]

    for size in range(1, 7):
        for names in map(set, itertools.combinations(kinds, size)):
            assert common_type(kinds[n] for n in names) == expected(names), names
    assert common_type([T.DateType(), T.TimestampNTZType()]) == T.TimestampNTZType()
    assert common_type([T.ShortType(), T.IntegerType()]) == T.LongType()
    assert common_type([T.FloatType(), T.DecimalType(9, 2)]) == T.DoubleType()


def test_union_keeps_first_seen_order_and_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "b int, a string")
    b = spark.createDataFrame([("y", 2.5, True)], "a string, c double, `d.e` boolean")
    found = combine({"um": a, "dois": b})
    assert found.columns == ["b", "a", "c", "d.e", "Origem"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "x", None, None, "um"), (1, "x", None, None, "um"), (None, "y", 2.5, True, "dois")], key=str
    )


def test_names_differing_in_case_are_refused_by_a_session_that_cannot_tell_them_apart(spark):
    with pytest.raises(ValueError, match="caseSensitive"):
        union_frames([spark.range(1).toDF("Valor"), spark.range(1).toDF("valor")])


# --- duplicates ---------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_duplicates_of_a_hot_key(spark, parts):
    rows = [(i, None if i % 3 == 0 else i % 50, "k" if i % 2 else None, i * 1.5) for i in range(4000)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "n int, chave int, outra string, valor double").repartition(parts)
    first = {}
    for row in sorted(rows):
        first.setdefault((row[1], row[2]), row[0])
    left = keep_first(frame, ["chave", "outra"], ["n"])
    gone = removed_duplicates(frame, ["chave", "outra"], ["n"])
    assert sorted(r["n"] for r in left.collect()) == sorted(first.values())
    assert sorted(r["n"] for r in gone.collect()) == sorted(set(range(4000)) - set(first.values()))
    counts = duplicate_counts(frame, ["chave", "outra"]).first()
    assert tuple(counts) == (4000, 4000 - len(first), len(first))


def test_no_key_gathers_its_rows(spark):
    """Only survivors, one per key and task, are shuffled by key."""
    frame = spark.range(1000).selectExpr("id", "id % 2 AS chave")
    plan = removed_duplicates(frame, ["chave"], ["id"])._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if "Exchange hashpartitioning(chave" in line]
    assert len(by_key) == 1
    below = plan[plan.index(by_key[0]):]
    assert "WindowGroupLimit" in below.splitlines()[1]


def test_unknown_key_is_refused(spark):
    with pytest.raises(ValueError, match="nada"):
        keep_first(spark.range(3), ["nada"], ["id"])


# --- summary ------------------------------------------------------------------------------


def test_summary_of_nulls(spark):
    frame = spark.createDataFrame(
        [("a", None, None), ("a", None, "x"), (None, 2, "y"), (None, 2, "y"), ("b", 3, None)], "g string, v int, t string"
    )
    operations = [C.SUM, C.MEAN, C.COUNT, C.MINIMUM, C.MAXIMUM, C.UNIQUE_COUNT]
    rule = SummaryRule(("g",), tuple(Aggregation("v", o) for o in operations) + (Aggregation("nada", C.SUM),))
    found = summary_table(frame, rule)
    assert found.columns == ["g", "v_Soma", "v_Média", "v_Contagem", "v_Mínimo", "v_Máximo", "v_Contagem_Única"]
    assert [tuple(r) for r in found.collect()] == [
        (None, 4, 2.0, 2, 2, 2, 1),
        ("a", 0, None, 0, None, None, 1),
        ("b", 3, 3.0, 1, 3, 3, 1),
    ]
    assert summary_table(frame, SummaryRule(("g",), (Aggregation("nada", C.SUM),))) is None
    with pytest.raises(ValueError, match="nada"):
        summary_table(frame, SummaryRule(("nada",), (Aggregation("v", C.SUM),)))


# --- outputs ------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [["n"], ["t", "n"], ["t2", "n"]])
def test_row_index_is_dense(spark, order):
    rows = [(i * 3, "hot" if i % 3 else "cold", None if i % 4 else "x") for i in range(3000)]
    random.Random(5).shuffle(rows)
    frame = spark.createDataFrame(rows, "n bigint, t string, t2 string")
    found = {r["n"]: r["row_index"] for r in row_index(frame, order, parts=13).collect()}
    place = {"n": 0, "t": 1, "t2": 2}
    ranked = sorted(rows, key=lambda r: [(r[place[o]] is not None, r[place[o]]) for o in order])
    assert found == {r[0]: i for i, r in enumerate(ranked)}


def test_csv_keeps_every_character(spark):
    rows = [(1, '  a|"b"\n\\c ', 1.5), (2, None, None), (3, '"', -0.25), (4, "é\t", 1e20)]
    path = shared_folder(spark)
    write_csv(spark.createDataFrame(rows, "n int, t string, v double"), path)
    assert sorted(map(tuple, read_csv(spark, path, "n int, t string, v double").collect())) == rows
    header = spark.read.text(path).where("value = 'n|t|v'").count()
    assert header >= 1


def tables(spark):
    left = spark.createDataFrame([(1, "x", "10"), (2, "x", "abc"), (3, "y\x07", "30")], "id int, nome string, valor string")
    right = spark.createDataFrame([(1, "x", 7.5)], "id int, nome string, valor double")
    mapping = [
        TableMapping("a", "nome", "nome"),
        TableMapping("a", "valor", "valor", C.TYPE_FLOAT),
        TableMapping("b", "nome", "nome"),
        TableMapping("b", "valor", "valor", C.TYPE_INTEGER),
        TableMapping("b", "id", "id", include=False),
    ]
    rule = SummaryRule(("nome",), (Aggregation("valor", C.SUM),))
    return consolidate_tables(
        {"a": left, "b": right}, mapping, [FilterRule("nada", C.EQUAL, "1")], DuplicateRule(("nome",)), rule, {"a": ["id"], "b": ["id"]}
    )


def test_tables_and_their_outputs(spark):
    out = tables(spark)
    # the last entry of a final name sets its type
    assert out.consolidated.dtypes == [("nome", "string"), ("valor", "bigint"), ("Origem", "string")]
    assert sorted(map(tuple, out.consolidated.collect())) == [("x", 10, "a"), ("y\x07", 30, "a")]
    assert sorted(map(tuple, out.removed.collect()), key=str) == [("x", 7, "b"), ("x", None, "a")]
    assert [i.reason for i in out.ignored_rules] == ["column not found"]

    places = write_outputs(out, shared_folder(spark))
    assert set(places) == {"consolidated", "removed", "summary", "accounting"}
    assert sorted(map(tuple, spark.read.parquet(places["summary"]).collect())) == [("x", 10), ("y\x07", 30)]
    assert spark.read.parquet(places["removed"]).count() == 2

    sheets = write_outputs(out, shared_folder(spark), "sheets", ["consolidated"])
    saved = spark.read.parquet(sheets["consolidated"])
    assert sorted(r["nome"] for r in saved.collect()) == ["x", "y"]
    assert {r["chunk"] for r in saved.collect()} == {"Dados_Consolidados"}

    csv = write_outputs(out, shared_folder(spark), "csv", ["consolidated", "summary"])
    assert read_csv(spark, csv["summary"], "nome string, soma bigint").count() == 2
    with pytest.raises(ValueError):
        write_outputs(out, shared_folder(spark), "xls")


def test_tables_without_row_order_cannot_lose_duplicates(spark):
    with pytest.raises(ValueError, match="order"):
        consolidate_tables({"a": spark.range(3)}, duplicates=DuplicateRule(("id",)))


def test_merging_takes_two_groups(spark):
    with pytest.raises(ValueError):
        merge_groups(spark.range(1), ["a", "a"], "b")


def test_mapping_rows_keep_their_order(spark):
    found = mapping_from_rows(spark, [("c", "p", None, "x", C.TYPE_TEXT, True), ("d", "p", None, "x", C.TYPE_DATE, True)])
    assert [r["entry"] for r in found.orderBy("entry").collect()] == [0, 1]


def test_null_in_the_order_is_a_value_like_any_other(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, 2, "y"), (1, 3, "z")], "k int, o int, v string")
    assert [r.v for r in keep_first(rows, ["k"], ["o"]).collect()] == ["x"]
    assert sorted(r.v for r in removed_duplicates(rows, ["k"], ["o"]).collect()) == ["y", "z"]


def test_fractions_become_plain_text(spark):
    values = [12345678.5, 1e7, 0.00012, 1.5, -2e8, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in rows.select(fraction_to_text(F.col("v"))).collect()]
    assert found == ["12345678.5", "10000000.0", "0.00012", "1.5", "-200000000.0", None]
