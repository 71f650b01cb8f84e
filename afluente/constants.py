"""Labels and limits that users see in rules and results."""

# Column types offered in a mapping; the first one is the default.
TYPE_TEXT = "Automático/String"
TYPE_INTEGER = "Inteiro"
TYPE_FLOAT = "Decimal (Float)"
TYPE_DATE = "Data"
TYPE_BOOLEAN = "Booleano"
COLUMN_TYPES = (TYPE_TEXT, TYPE_INTEGER, TYPE_FLOAT, TYPE_DATE, TYPE_BOOLEAN)
NUMERIC_TYPES = (TYPE_INTEGER, TYPE_FLOAT)

# Filter operators.
EQUAL = "Igual a"
NOT_EQUAL = "Diferente de"
CONTAINS = "Contém"
NOT_CONTAINS = "Não contém"
STARTS_WITH = "Começa com"
ENDS_WITH = "Termina com"
GREATER = "Maior que"
LESS = "Menor que"
BETWEEN = "Entre"
IS_BLANK = "Está em branco"
NOT_BLANK = "Não está em branco"

# Summary operations.
SUM = "Soma"
MEAN = "Média"
COUNT = "Contagem"
MINIMUM = "Mínimo"
MAXIMUM = "Máximo"
UNIQUE_COUNT = "Contagem Única"

# Result names.
ORIGIN = "Origem"
SHEET_CONSOLIDATED = "Dados_Consolidados"
SHEET_REMOVED = "Duplicatas_Removidas"
SHEET_SUMMARY = "Tabela_Resumo"
SHEET_ACCOUNTING = "Contagem_Linhas"
UNNAMED_COLUMN = "column_"

# Status of a source in the audit, besides those of its layout.
HIDDEN_NAME = "hidden name: not read"
ORIGIN_REPLACED = "own origin column replaced"

# Limits.
PREVIEW_ROWS = 50
HEAD_ROWS = 20
ROWS_PER_SHEET = 1_048_570
MAX_DISPLAY_WIDTH = 60
DISPLAY_PADDING = 2

# File kinds, in the order in which sources are taken.
EXTENSIONS = (".xlsx", ".csv", ".xls", ".txt")
DELIMITED_EXTENSIONS = (".csv", ".txt")
WORKBOOK_EXTENSIONS = (".xlsx", ".xls")
