"""Profiles, groups and mapping edits over columns that the tables give."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.text import normalize_name
from afluente.operators.mapping import (
    build_mapping,
    default_settings,
    final_columns,
    join_mapping,
    merge_groups,
    override_mapping,
    split_groups,
)
from afluente.operators.profile import group_headers, table_fingerprints
from afluente.session import spread
from workloads.casts import DATETIME_SQL, FLOAT_SQL, INTEGER_SQL, NUMBERS
from workloads.registry import query

VISIBLE = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}]"


def normalized_sql(text: str) -> str:
    special = f"lower({text})"
    for letter, plain in {"ß": "ss", "æ": "ae", "ø": "o", "ð": "d", "þ": "th"}.items():
        special = f"replace({special}, '{letter}', '{plain}')"
    return f"regexp_replace(strip_accents({special}), '[^a-z0-9]', '', 'g')"


def type_sql(visible: str, values: str) -> str:
    """Type ladder over grouped values; ``visible`` selects the cells that count."""

    def all_fit(conversion: str) -> str:
        return f"bool_and(({conversion.format(values)}) IS NOT NULL) FILTER (WHERE {visible})"

    return f"""CASE WHEN count(*) FILTER (WHERE {visible}) = 0 THEN 'String'
        WHEN {all_fit(INTEGER_SQL)} THEN 'Int64' WHEN {all_fit(FLOAT_SQL)} THEN 'Float64'
        WHEN {all_fit(DATETIME_SQL)} THEN 'Datetime' ELSE 'String' END"""


@query(
    "normalize_names",
    f"""SELECT 'p' || p_partkey AS origem, {normalized_sql('p_name')} AS nome FROM part
        UNION ALL SELECT 'd' || doc_id, {normalized_sql('text')} FROM documents""",
)
def _(t):
    # whole texts: heavy per row
    parts = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("origem"), F.col("p_name").alias("texto"))
    texts = spread(t.documents.select(F.concat(F.lit("d"), "doc_id"), "text"))
    return parts.unionAll(texts).select("origem", normalize_name(F.col("texto")).alias("nome"))


_PROFILED = {
    "orders": [
        ("o_orderkey", "o_orderkey"),
        ("o_totalprice", "o_totalprice"),
        ("dia", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
        ("situacao", "nullif(o_orderstatus, 'F')"),
        ("Numero Misto", NUMBERS),
        ("vazio", "CASE WHEN o_orderkey % 3 = 0 THEN '  ' END"),
    ],
    "customer": [
        ("c_custkey", "nullif(c_custkey, 5)"),
        ("O-Totalprice", "c_acctbal"),
        ("Situação", "c_mktsegment"),
        ("DIA", "c_nationkey"),
    ],
    "events": [("dia", "CAST(CAST(ts AS DATE) AS STRING)"), ("valor", "value"), ("situacao", "event_type")],
}


def _fingerprints(t) -> DataFrame:
    return reduce(
        DataFrame.unionAll,
        [
            table_fingerprints(getattr(t, table).select(*[F.expr(e).alias(n) for n, e in columns]), table)
            for table, columns in _PROFILED.items()
        ],
    )


def _profile_sql() -> str:
    parts = []
    for table, columns in _PROFILED.items():
        for number, (name, expression) in enumerate(columns):
            cell = f"(SELECT CAST({expression} AS VARCHAR) AS v FROM {table})"
            kind = type_sql(f"regexp_matches(v, '{VISIBLE}')", "v")
            parts.append(
                f"""SELECT '{table}' AS path, {number} AS column_no, '{name}' AS "column", {normalized_sql(f"'{name}'")} AS normalized,
                {kind} AS type, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio FROM {cell}"""
            )
    return " UNION ALL ".join(parts)


_PROFILES = _profile_sql()


@query("profile_types", f'SELECT path, "column", type FROM ({_PROFILES})')
def _(t):
    return _fingerprints(t).select("path", "column", "type")


@query("null_ratio", f'SELECT path, "column", null_ratio FROM ({_PROFILES})')
def _(t):
    return _fingerprints(t).select("path", "column", "null_ratio")


@query("table_fingerprints", f"SELECT * FROM ({_PROFILES})")
def _(t):
    return _fingerprints(t).select("path", "column_no", "column", "normalized", "type", "null_ratio")


# Columns as found in many sources: each user is a source, each kind of event a column of it.
def _source_columns(t) -> DataFrame:
    return (
        t.events.select(
            F.concat(F.lit("u"), "user_id").alias("path"),
            F.expr("CASE WHEN user_id % 2 = 0 THEN event_type ELSE upper(event_type) END").alias("column"),
            F.expr(
                "CASE WHEN user_id % 5 = 0 THEN 'String' WHEN user_id % 3 = 0 THEN 'Float64' ELSE 'Int64' END"
            ).alias("type"),
            F.expr(
                "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
            ).alias("column_no"),
        )
        .distinct()
        .select(
            "path",
            "column",
            "type",
            "column_no",
            F.lit(0).alias("rank"),
            F.lit(None).cast("string").alias("sheet"),
            F.lit(0).alias("sheet_no"),
            normalize_name(F.col("column")).alias("normalized"),
        )
    )


def _members(t) -> DataFrame:
    return group_headers(_source_columns(t))


_COLUMNS_SQL = """(SELECT DISTINCT 'u' || user_id AS path, user_id,
    CASE WHEN user_id % 2 = 0 THEN event_type ELSE upper(event_type) END AS "column", event_type AS normalized,
    CASE WHEN user_id % 5 = 0 THEN 'String' ELSE 'numeric' END AS type_class,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS column_no
    FROM events)"""
_MEMBERS_SQL = f"""(SELECT normalized || ':' || type_class AS group_id, * FROM {_COLUMNS_SQL})"""
_FIRST = 'first("column" ORDER BY path, column_no)'


@query("group_headers", f'SELECT group_id, type_class, normalized, "column", path FROM {_MEMBERS_SQL}')
def _(t):
    return _members(t).select("group_id", "type_class", "normalized", "column", "path")


@query("suggested_name", f"SELECT group_id, {_FIRST} AS suggested FROM {_MEMBERS_SQL} GROUP BY group_id")
def _(t):
    return default_settings(_members(t)).select("group_id", "suggested")


# Changes made by a user: one per group that holds errors or clicks.
def _overrides(t) -> DataFrame:
    groups = _members(t).select("group_id", "normalized").distinct()
    return groups.where("normalized IN ('click', 'error', 'view')").select(
        "group_id",
        F.expr("CASE normalized WHEN 'click' THEN 'Cliques' WHEN 'view' THEN '  ' END").alias("final_name"),
        F.expr(f"CASE WHEN normalized = 'click' THEN '{C.TYPE_INTEGER}' END").alias("type"),
        F.expr("CASE WHEN normalized = 'error' THEN false END").alias("include"),
    )


_SETTINGS_SQL = f"""(SELECT group_id, {_FIRST} AS suggested,
    CASE any_value(normalized) WHEN 'click' THEN 'Cliques' WHEN 'view' THEN '  ' ELSE {_FIRST} END AS final_name,
    CASE WHEN any_value(normalized) = 'click' THEN '{C.TYPE_INTEGER}' ELSE '{C.TYPE_TEXT}' END AS type,
    any_value(normalized) <> 'error' AS include FROM {_MEMBERS_SQL} GROUP BY group_id)"""


def _settings(t) -> DataFrame:
    return override_mapping(default_settings(_members(t)), _overrides(t))


@query("override_mapping", f"SELECT group_id, final_name, type, include FROM {_SETTINGS_SQL}")
def _(t):
    return _settings(t).select("group_id", "final_name", "type", "include")


_MAPPING_SQL = f"""(SELECT m."column", m.path, coalesce(nullif(trim(s.final_name), ''), s.suggested) AS final_name, s.type, s.include
    FROM {_MEMBERS_SQL} m JOIN {_SETTINGS_SQL} s USING (group_id))"""


@query("build_mapping", f"SELECT * FROM {_MAPPING_SQL}")
def _(t):
    return build_mapping(_members(t), _settings(t)).select("column", "path", "final_name", "type", "include")


@query(
    "final_columns",
    f"""SELECT final_name, any_value(type) AS type, any_value(type) IN ('{C.TYPE_INTEGER}', '{C.TYPE_FLOAT}') AS "numeric"
        FROM {_MAPPING_SQL} WHERE include GROUP BY final_name""",
)
def _(t):
    return final_columns(build_mapping(_members(t), _settings(t)))


@query(
    "mapping_join",
    f"""SELECT path, "column", column_no, final_name FROM {_MEMBERS_SQL} JOIN {_MAPPING_SQL} USING (path, "column") WHERE include""",
)
def _(t):
    mapping = build_mapping(_members(t), _settings(t))
    return join_mapping(_source_columns(t), mapping).select("path", "column", "column_no", "final_name")


# One in four sources of the clicks moves out, and every member of one other group.
_MOVED = "(group_id = 'click:numeric' AND user_id % 4 = 1) OR group_id = 'view:String'"


@query(
    "split_group",
    f"""SELECT CASE WHEN {_MOVED} THEN 'novo:' || group_id ELSE group_id END AS grupo, count(*) AS membros,
        {_FIRST} AS suggested FROM {_MEMBERS_SQL} GROUP BY grupo""",
)
def _(t):
    members = _members(t)
    moves = members.where(
        "(group_id = 'click:numeric' AND CAST(substr(path, 2) AS BIGINT) % 4 = 1) OR group_id = 'view:String'"
    ).select("group_id", "column", "path", "sheet", F.concat(F.lit("novo:"), "group_id").alias("new_group_id"))
    found = default_settings(split_groups(members, moves))
    counts = split_groups(members, moves).groupBy("group_id").agg(F.count(F.lit(1)).alias("membros"))
    return found.join(counts, "group_id").select(F.col("group_id").alias("grupo"), "membros", "suggested")


@query(
    "merge_groups",
    f"""SELECT CASE WHEN group_id IN ('click:numeric', 'view:String', 'signup:numeric') THEN 'junto' ELSE group_id END AS grupo,
        count(*) AS membros,
        first("column" ORDER BY CASE group_id WHEN 'view:String' THEN 0 WHEN 'signup:numeric' THEN 1 ELSE 2 END, path, column_no) AS suggested
        FROM {_MEMBERS_SQL} GROUP BY grupo""",
)
def _(t):
    merged = merge_groups(_members(t), ["click:numeric", "signup:numeric", "view:String"], "junto")
    counts = merged.groupBy("group_id").agg(F.count(F.lit(1)).alias("membros"))
    return (
        default_settings(merged).join(counts, "group_id").select(F.col("group_id").alias("grupo"), "membros", "suggested")
    )
