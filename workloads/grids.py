"""Header discovery over documents: each text is a source, its lines are rows, its words are cells."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from afluente import constants as C
from afluente.functions.columns import computed
from afluente.functions.text import blank_to_null
from afluente.operators.headers import (
    detect_layout,
    drop_preamble,
    grid_heads,
    header_names,
    numbered_grid,
    positional_rename,
    row_stats,
    same_kind_count,
    transition_score,
    with_unique_names,
)
from afluente.operators.profile import source_fingerprints
from afluente.plans.preview import preview_rows
from afluente.session import spread, written
from afluente.sources.delimited import rectangular
from workloads.mappings import VISIBLE, normalized_sql, type_sql
from workloads.registry import query


def _lines(t) -> DataFrame:
    """All non-blank lines of all documents, numbered within their document."""
    lines = F.filter(F.split("text", "\n", -1), lambda v: F.length(v) > 0)
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(lines).alias("line", "texto"))


def _grid(t) -> DataFrame:
    words = F.transform(F.split("texto", " ", -1), blank_to_null)
    return _lines(t).select("doc_id", "line", words.alias("cells"))


def _heads(t) -> DataFrame:
    """First lines of each document, taken from its own row."""
    documents = spread(t.documents.select("doc_id", "text"))
    texts = computed(documents, lines=F.filter(F.split("text", "\n", -1), lambda v: F.length(v) > 0))
    cells = F.transform(F.slice("lines", 1, C.HEAD_ROWS), lambda v: F.split(v, " ", -1))
    path = F.col("doc_id").cast("string")
    return rectangular(texts, cells).select(
        "doc_id",
        "lines",
        path.alias("uri"),
        path.alias("path"),
        path.alias("file"),
        F.lit(0).alias("rank"),
        F.lit(None).cast("string").alias("sheet"),
        F.lit(0).alias("sheet_no"),
        "rows",
        F.lit(None).cast("string").alias("error"),
    )


def _layout(t) -> DataFrame:
    return detect_layout(_heads(t))


_SPLIT = "list_filter(string_split(text, chr(10)), lambda v: length(v) > 0)"
# One row per document: all lines, and the first ones as a rectangle of words.
_HEADS = f"""heads0 AS (SELECT doc_id, {_SPLIT} AS lines FROM documents),
heads1 AS (SELECT doc_id, lines, list_transform(lines[1:{C.HEAD_ROWS}], lambda l: string_split(l, ' ')) AS raw FROM heads0),
heads2 AS (SELECT *, list_max(list_transform(raw, lambda r: len(r))) AS width FROM heads1),
heads AS (SELECT doc_id, lines, width, list_transform(raw, lambda r:
    list_transform(list_resize(r, width), lambda c: nullif(c, ''))) AS "rows" FROM heads2)"""
_GRID = f"""{_HEADS},
grid AS (SELECT doc_id, width, unnest(range(len("rows"))) AS line, unnest("rows") AS cells FROM heads),
filled AS (SELECT *, list_filter(cells, lambda c: c IS NOT NULL) AS found,
    lead(cells) OVER (PARTITION BY doc_id ORDER BY line) AS below FROM grid),
stats AS (SELECT *, len(cells) - len(found) AS nulls, len(list_distinct(found)) AS uniques,
    len(list_filter(found, lambda c: regexp_matches(c, '{VISIBLE}'))) AS texts,
    len(list_filter(found, lambda c: regexp_full_match(regexp_replace(c, '^{VISIBLE.replace('[^', '[')}+|{VISIBLE.replace('[^', '[')}+$', '', 'g'), '\\p{{N}}+'))) AS numerics,
    CASE WHEN below IS NOT NULL THEN len(list_filter(range(1, len(cells) + 1), lambda i: (cells[i] IS NULL) = (below[i] IS NULL))) END AS same
    FROM filled),
moves AS (SELECT *, list_reduce(list_concat([0::DOUBLE], list_transform(range(same), lambda i: 0.2::DOUBLE)),
    lambda a, x: a - x) / width * 5::DOUBLE AS transition FROM stats),
scored AS (SELECT *, CASE WHEN len(found) = 0 THEN -100::DOUBLE ELSE
    (uniques::DOUBLE / len(found)) * 3::DOUBLE + (texts::DOUBLE / len(found)) * 3::DOUBLE
    - (numerics::DOUBLE / len(found)) * 5::DOUBLE - (nulls::DOUBLE / width) * 2::DOUBLE END + transition AS score FROM moves),
best AS (SELECT doc_id, coalesce(first(line ORDER BY score DESC, line) FILTER (WHERE below IS NOT NULL), 0) AS header_line
    FROM scored GROUP BY doc_id),
headers AS (SELECT h.doc_id, h.lines, h."rows", coalesce(header_line, 0)::INTEGER AS header_line,
    list_transform(h."rows"[coalesce(header_line, 0) + 1], lambda c, i: coalesce(c, 'column_' || (i - 1))) AS names
    FROM heads h LEFT JOIN best USING (doc_id)),
named0 AS (SELECT doc_id, unnest(range(len(names))) AS posicao, unnest(names) AS nome FROM headers),
named AS (SELECT doc_id, posicao, nome, CASE WHEN count(*) OVER (PARTITION BY doc_id, nome) > 1
    THEN nome || '_' || row_number() OVER (PARTITION BY doc_id, nome ORDER BY posicao) ELSE nome END AS unico FROM named0),
layout AS (SELECT h.doc_id, header_line, "rows", lines, CASE WHEN coalesce(len("rows"), 0) < 2 THEN 'empty'
    WHEN (SELECT count(DISTINCT unico) < count(*) FROM named n WHERE n.doc_id = h.doc_id) THEN 'error' ELSE 'ok' END AS status
    FROM headers h)"""


@query(
    "head_per_source",
    f"WITH {_HEADS} SELECT doc_id, unnest(range(least(len(lines), {C.HEAD_ROWS}))) AS line, unnest(lines[1:{C.HEAD_ROWS}]) AS texto FROM heads",
)
def _(t):
    return numbered_grid(_lines(t), ["doc_id"])


@query("grid_row_stats", f"WITH {_GRID} SELECT doc_id, line, width, nulls, texts, numerics, uniques FROM stats")
def _(t):
    rows = _heads(t).select("doc_id", F.posexplode("rows").alias("line", "cells"))
    return rows.select("doc_id", "line", F.inline(F.array(row_stats(F.col("cells")))))


@query(
    "grid_transition",
    f"WITH {_GRID} SELECT doc_id, line, same, round(transition, 9) AS transition FROM moves WHERE below IS NOT NULL",
)
def _(t):
    rows = F.col("rows")
    below = F.posexplode(F.slice(rows, F.lit(2), F.size(rows) - 1)).alias("line", "below")
    pairs = _heads(t).where(F.size(rows) > 1).select("doc_id", "rows", below)
    cells = F.get("rows", F.col("line"))
    counted = pairs.select("doc_id", "line", cells.alias("cells"), same_kind_count(cells, F.col("below")).alias("same"))
    return counted.select("doc_id", "line", "same", F.round(transition_score(F.col("same"), F.size("cells")), 9).alias("transition"))


@query("detect_header_row", f"WITH {_GRID} SELECT doc_id, header_line FROM headers")
def _(t):
    return _layout(t).select("doc_id", "header_line")


@query(
    "detect_header_exploded",
    f"WITH {_GRID} SELECT doc_id, header_line FROM headers WHERE len(lines) > 0",
)
def _(t):
    """The same from a grid whose rows lie apart."""
    heads = grid_heads(_grid(t), ["doc_id"]).withColumnRenamed("rows", "ragged")
    heads = rectangular(heads, F.col("ragged"))
    return detect_layout(heads.withColumn("error", F.lit(None).cast("string"))).select("doc_id", "header_line")


@query("header_names", f"WITH {_GRID} SELECT doc_id, posicao, nome FROM named")
def _(t):
    header = F.coalesce(F.get("rows", F.col("header_line")), F.array().cast("array<string>"))
    return _layout(t).select("doc_id", F.posexplode(header_names(header)).alias("posicao", "nome"))


@query("unique_headers", f"WITH {_GRID} SELECT doc_id, posicao, unico FROM named")
def _(t):
    header = F.coalesce(F.get("rows", F.col("header_line")), F.array().cast("array<string>"))
    named = with_unique_names(_layout(t).select("doc_id", "rows", "header_line"), header_names(header), "unicos")
    return named.select("doc_id", F.posexplode("unicos").alias("posicao", "unico"))


@query(
    "drop_preamble",
    f"""WITH {_GRID} SELECT doc_id, line, texto FROM (SELECT doc_id, header_line, unnest(range(len(lines))) AS line,
        unnest(lines) AS texto FROM layout) WHERE line > header_line""",
)
def _(t):
    # header and lines are on one row of the table, so nothing is joined or shuffled
    rows = _layout(t).select("doc_id", "header_line", F.posexplode("lines").alias("line", "texto"))
    return drop_preamble(rows).select("doc_id", "line", "texto")


@query(
    "positional_rename",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS cor, nullif(split_part(p_name, ' ', 2), '') AS coisa,
       NULL::VARCHAR AS "column_2" FROM part""",
)
def _(t):
    words = F.split("p_name", " ", -1)
    return t.part.select("p_partkey", *positional_rename(words, ["cor", "coisa", "column_2"]))


_CELLS = """cells AS (SELECT l.doc_id, n.posicao, n.unico, nullif(string_split(r.linha, ' ')[n.posicao + 1], '') AS v
    FROM layout l JOIN named n USING (doc_id), unnest(l.lines[l.header_line + 2:]) AS r(linha) WHERE l.status = 'ok')"""


@query(
    "column_fingerprints",
    f"""WITH {_GRID}, {_CELLS} SELECT doc_id, posicao, unico, {normalized_sql('unico')} AS normalized, type, null_ratio FROM
        (SELECT doc_id, posicao, unico, {type_sql(f"regexp_matches(v, '{VISIBLE}')", 'v')} AS type,
         avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS null_ratio FROM cells GROUP BY doc_id, posicao, unico)""",
)
def _(t):
    layout = written(_layout(t).drop("rows"))  # all lines of a document count, not only its head
    below = F.slice("lines", F.col("header_line") + 2, F.size("lines"))
    lines = layout.where("status = 'ok'").select("uri", "sheet_no", F.explode(below).alias("linha"))
    found = source_fingerprints(lines.select("uri", "sheet_no", F.split("linha", " ", -1).alias("cells")), layout)
    return found.select(
        F.col("path").cast("bigint").alias("doc_id"),
        F.col("column_no").alias("posicao"),
        F.col("column").alias("unico"),
        "normalized",
        "type",
        "null_ratio",
    )


@query(
    "preview",
    f"""WITH {_GRID} SELECT doc_id, line, texto FROM (SELECT doc_id, unnest(range(least(5, len("rows") - header_line - 1))) AS line,
        unnest(list_transform("rows"[header_line + 2:header_line + 6], lambda r: array_to_string(r, '|'))) AS texto
        FROM layout WHERE status = 'ok')""",
)
def _(t):
    rows = preview_rows(_layout(t), 5)
    return rows.select(F.col("path").cast("bigint").alias("doc_id"), "line", F.array_join("cells", "|").alias("texto"))


@query(
    "audit_sources",
    f"""WITH {_GRID} SELECT doc_id, status, CASE WHEN status = 'ok' THEN len(lines) - header_line - 1 ELSE 0 END AS linhas FROM layout""",
)
def _(t):
    rows = F.when(F.col("status") == "ok", F.size("lines") - F.col("header_line") - 1).otherwise(0)
    return _layout(t).select("doc_id", "status", rows.alias("linhas"))
