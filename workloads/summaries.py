"""Summary tables over lineitem."""

from pyspark.sql import functions as F

from afluente import Aggregation, SummaryRule
from afluente import constants as C
from afluente.operators.outputs import row_index
from afluente.operators.summary import summary_table
from workloads.registry import query

# One group has no value at all, and one group key is null.
_SQL_ROWS = """(SELECT nullif(l_returnflag, 'N') AS flag, l_linestatus AS status, l_extendedprice AS preco,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS qtd,
    nullif(l_linenumber, 7) AS linha FROM lineitem)"""


def _rows(t):
    return t.lineitem.select(
        F.expr("nullif(l_returnflag, 'N')").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("preco"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END").alias("qtd"),
        F.expr("nullif(l_linenumber, 7)").alias("linha"),
    )


def _summary(t, *aggregations, groups=("flag", "status")):
    return summary_table(_rows(t), SummaryRule(tuple(groups), tuple(Aggregation(*a) for a in aggregations)))


def _sql(results: str, groups: str = "flag, status") -> str:
    return f"SELECT {groups}, {results} FROM {_SQL_ROWS} GROUP BY {groups}"


_SUM = 'coalesce(sum(qtd), 0) AS "qtd_Soma"'
_MEAN = 'avg(qtd) AS "qtd_Média"'
_COUNT = 'count(qtd) AS "qtd_Contagem"'
_MIN = 'min(preco) AS "preco_Mínimo"'
_MAX = 'max(preco) AS "preco_Máximo"'
_UNIQUE = '(count(DISTINCT linha) + max(CASE WHEN linha IS NULL THEN 1 ELSE 0 END))::BIGINT AS "linha_Contagem_Única"'


@query("summary_sum", _sql(_SUM))
def _(t):
    return _summary(t, ("qtd", C.SUM))


@query("summary_mean", _sql(_MEAN))
def _(t):
    return _summary(t, ("qtd", C.MEAN))


@query("summary_count", _sql(_COUNT))
def _(t):
    return _summary(t, ("qtd", C.COUNT))


@query("summary_min", _sql(_MIN))
def _(t):
    return _summary(t, ("preco", C.MINIMUM))


@query("summary_max", _sql(_MAX))
def _(t):
    return _summary(t, ("preco", C.MAXIMUM))


@query("summary_n_unique", _sql(_UNIQUE))
def _(t):
    return _summary(t, ("linha", C.UNIQUE_COUNT))


_ALL = ", ".join([_SUM, _MEAN, _COUNT, _MIN, _MAX, _UNIQUE])


@query("summary_table", _sql(_ALL))
def _(t):
    return _summary(
        t,
        ("qtd", C.SUM),
        ("qtd", C.MEAN),
        ("qtd", C.COUNT),
        ("preco", C.MINIMUM),
        ("preco", C.MAXIMUM),
        ("linha", C.UNIQUE_COUNT),
    )


@query("summary_skip_missing", _sql(_COUNT, "status"))
def _(t):
    return _summary(t, ("nao_existe", C.SUM), ("qtd", C.COUNT), ("qtd", "Mediana"), groups=("status",))


@query(
    "summary_sorted",
    f"""SELECT flag, status, "qtd_Soma", row_number() OVER (ORDER BY flag NULLS FIRST, status NULLS FIRST) - 1 AS posicao
        FROM ({_sql(_SUM)})""",
)
def _(t):
    return row_index(_summary(t, ("qtd", C.SUM)), ["flag", "status"], "posicao")
