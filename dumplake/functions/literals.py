"""SQL literal text in columns: quoting, unquoting, declarations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SINGLE = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_DOUBLE = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
_PLAIN = r"[^'\"()]++"
# Calls in a declaration may be nested this deep.
DEPTH = 32
_CALL = rf"\((?:{_PLAIN}|{_SINGLE}|{_DOUBLE})*+\)"
for _ in range(DEPTH - 1):
    _CALL = rf"\((?:{_PLAIN}|{_SINGLE}|{_DOUBLE}|{_CALL})*+\)"

# One item of a comma list of declarations: quoted strings, names in backticks, calls and plain text up to the next comma.
DECLARATION = rf"(?s)\G(?:^|,)((?:[^'\"`(),]++|`(?:[^`]|``)*+`|{_SINGLE}|{_DOUBLE}|{_CALL})*+)"

# Blanks around a literal.
BLANKS = " \t\n\r\x0b\f"

# Backslash escapes of MySQL string literals.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0", "Z": "\x1a"}


def add_slashes(c: Column) -> Column:
    """Backslash before quotes, backslash and NUL."""
    slashed = F.regexp_replace(c, r"([\\'\"])", r"\\$1")
    return F.replace(slashed, F.lit("\0"), F.lit("\\0"))


def quote(c: Column) -> Column:
    """A single-quoted SQL literal that holds exactly the text of ``c``."""
    body = F.when(c.rlike(r"[\\'\x00]"), F.replace(F.regexp_replace(c, r"([\\'])", r"\\$1"), F.lit("\0"), F.lit("\\0")))
    return F.concat(F.lit("'"), F.coalesce(body, c), F.lit("'"))


def _unescape_piece(piece: Column, mark: str) -> Column:
    out = F.regexp_replace(piece, rf"(?<!\\){mark}{mark}", mark)
    for letter, char in ESCAPES.items():
        out = F.replace(out, F.lit("\\" + letter), F.lit(char))
    return F.regexp_replace(out, r"(?s)\\([^%_])", "$1")


def _unescape(body: Column, mark: str) -> Column:
    """Escapes of a literal body; cutting at double backslashes first keeps pairs apart."""
    pieces = F.transform(F.split(body, r"\\\\", -1), lambda p: _unescape_piece(p, mark))
    return F.when(body.contains("\\"), F.array_join(pieces, "\\")).when(
        body.contains(mark), F.replace(body, F.lit(mark * 2), F.lit(mark))).otherwise(body)


def literal_text(item: Column) -> Column:
    """The text a literal stands for: unquoted strings, NULL and DEFAULT as null, rest as is."""
    word = F.btrim(item, F.lit(BLANKS))
    # By bytes: in text that is no UTF-8 a last letter may seem to take the closing quote with it.
    body = F.substring(word.cast("binary"), F.lit(2), F.octet_length(word) - 2).cast("string")
    return (
        F.when(word.startswith("'"), _unescape(body, "'"))
        .when(word.startswith('"'), _unescape(body, '"'))
        .when(F.upper(word).isin("NULL", "DEFAULT"), None)
        .when(F.upper(word) == "TRUE", "1")
        .when(F.upper(word) == "FALSE", "0")
        .otherwise(word)
    )


def number_text(item: Column) -> Column:
    """A number's digits, quoted or not; words such as NULL stay words and do not cast."""
    return F.btrim(item, F.lit(BLANKS + "'\""))
