"""Text helpers as Spark column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a cell is trimmed.
_WIDE_SPACES = "".join(chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_SPACE_SET = r"\s\x0B\x1c-\x1f\x85\xa0" + _WIDE_SPACES
SPACES = f"[{_SPACE_SET}]"

# Letters without a compatibility decomposition into ASCII.
SPECIAL_LETTERS = {"ß": "ss", "æ": "ae", "ø": "o", "ð": "d", "þ": "th"}

# Control characters that no sheet or XML text may hold.
ILLEGAL_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

LATIN1 = "ISO-8859-1"


def named(name: str) -> Column:
    """The column called exactly ``name``, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_visible(value: Column) -> Column:
    """True for a cell that holds something other than white space."""
    return value.isNotNull() & value.rlike(f"[^{_SPACE_SET}]")


# Letters of other scripts as they are written in Latin ones.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch",
    "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "ѐ": "ie", "ё": "io", "ђ": "dj",
    "ѓ": "gj", "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "ќ": "kj", "ѝ": "i",
    "ў": "u", "џ": "dzh", "ґ": "g",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps",
    "ω": "o",
}

# Latin-1 and extended Latin, Greek, Cyrillic, more extended Latin, accented Greek, full-width forms.
_FOLDED_RANGES = (range(0xA0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000), range(0xFF10, 0xFF5B))


def _plain(letter: str) -> str:
    """ASCII letters and digits that stand for a lower-case letter; accents are taken off first."""
    scripts = {**CYRILLIC, **GREEK} if ord(letter) >= 0x370 else {}  # the sign for micro is no letter
    known = {**SPECIAL_LETTERS, **scripts}
    if letter in known:
        return known[letter]
    parts = unicodedata.normalize("NFKD", letter).lower()
    return "".join(known.get(c, c if c.isascii() and c.isalnum() else "") for c in parts)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Lower-case letters and their ASCII form: those that become one letter, and the others."""
    single_from, single_to, longer = "", "", {}
    for code in (code for letters in _FOLDED_RANGES for code in letters):
        letter = chr(code)
        if letter != letter.lower():
            continue
        plain = _plain(letter)
        if len(plain) == 1:
            single_from += letter
            single_to += plain
        elif plain:
            longer[letter] = plain
    return single_from, single_to, longer


def normalize_name(value: Column) -> Column:
    """Lower-case name in Latin letters without accents that keeps only ``a-z`` and ``0-9``.

    Letters that become several are looked up one by one, and only in names that have any.
    """
    single_from, single_to, longer = _folding()
    folded = F.translate(F.lower(value.cast("string")), single_from, single_to)
    table = F.create_map(*[F.lit(text) for pair in longer.items() for text in pair])
    spelled = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    folded = F.when(folded.rlike(f"[{''.join(longer)}]"), spelled).otherwise(folded)
    return F.regexp_replace(folded, "[^a-z0-9]", "")


def strip_controls(value: Column) -> Column:
    return F.regexp_replace(value, ILLEGAL_CONTROLS, "")


def decode_latin1(data: Column) -> Column:
    return F.decode(data.cast("binary"), LATIN1)


def separator_pattern(separator: str) -> str:
    """``separator`` as a literal regular expression."""
    if not separator:
        raise ValueError("the separator must not be empty")
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in separator)


def split_cells(line: Column, separator: str) -> Column:
    """All fields of a line; quotes are ordinary characters."""
    return F.split(line, separator_pattern(separator), -1)


def blank_to_null(cell: Column) -> Column:
    """An empty field counts as null; white space does not."""
    return F.nullif(cell, F.lit(""))


def plain_path(uri: Column) -> Column:
    """File location without percent escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def any_case_glob(extension: str) -> str:
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", extension)
