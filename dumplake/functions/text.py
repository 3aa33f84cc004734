"""Line rules: trimming, comment and DELIMITER tests, and the quote-state pattern.

The same pattern text serves the JVM columns (batch) and Python's ``re`` (the first line
of a file with a byte-order mark, and the stateful stream), so both agree by construction.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six characters a trim removes, and the quote states by number.
TRIM = " \t\n\r\0\x0b"
STATES = ("", "'", '"')

# Statement keywords accepted for an undelimited tail (import dialect).
TAIL_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "SET", "LOCK", "UNLOCK",
    "START", "COMMIT", "ROLLBACK", "REPLACE", "TRUNCATE", "USE", "GRANT", "REVOKE",
    "SHOW", "DESCRIBE", "EXPLAIN", "CALL", "DELIMITER",
)

# Byte-order marks in the order they are tested.
BOMS = (
    b"\xef\xbb\xbf",
    b"\x00\x00\xfe\xff",
    b"\xff\xfe\x00\x00",
    b"\xfe\xff",
    b"\xff\xfe",
)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM))


def ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(TRIM))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(TRIM))


def count_of(c: Column, token: str) -> Column:
    """Non-overlapping occurrences of ``token``."""
    gone = F.length(F.replace(c, F.lit(token), F.lit("")))
    return ((F.length(c) - gone) / len(token)).cast("int")


def normalise_newlines(c: Column) -> Column:
    """CRLF and lone CR to LF, for a line cut at LF (so a final CR belongs to a CRLF)."""
    no_final = F.when(c.endswith("\r"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    unified = F.replace(F.replace(no_final, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(c.contains("\r"), unified).otherwise(c)


def _string(quote: str, strict: bool) -> str:
    """A complete quoted string, every loop possessive so that the match never recurses.

    By default a doubled quote counts before a backslash does and a quote is escaped when
    an odd run of backslashes precedes it; ``strict`` reads escapes left to right.
    """
    q = quote
    if strict:
        return rf"{q}(?:[^{q}\\]++|{q}{q}|\\.?+)*+{q}(?!{q})"
    inside = rf"[^{q}\\]++|\\*+{q}{q}|\\(?:\\\\)*+{q}(?!{q})|\\++(?!{q})"
    return rf"{q}(?:{inside})*+(?:\\\\)*+{q}(?!{q})"


def exit_pattern(strict: bool = False) -> str:
    """Group 1 is the quote left open at the end of a line that starts outside a string.

    A line that starts inside a string is the same line with the open quote put before it.
    """
    single, double = _string("'", strict), _string('"', strict)
    return rf"(?s)^(?:[^'\"]++|{single}|{double})*+(.?)"


DIRECTIVE = r"(?i)^DELIMITER(?: |$)"
DIRECTIVE_VALUE = r"(?i)^DELIMITER\s+([^\n]+)$"


def _digit(state: Column) -> Column:
    return F.when(state == "'", 1).when(state == '"', 2).otherwise(0)


def _starts_with_any(c: Column, markers: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for marker in markers:
        hit = hit | c.startswith(marker)
    return hit


def comment_or_blank(trimmed: Column, dialect: str, markers: tuple[str, ...]) -> Column:
    if dialect == "cli":
        return (trimmed == "") | _starts_with_any(trimmed, markers)
    dashes = trimmed.startswith("--")
    dash_comment = (F.length(trimmed) == 2) | trimmed.startswith("-- ")
    return (trimmed == "") | F.when(dashes, dash_comment).otherwise(_starts_with_any(trimmed, markers))


def default_markers(dialect: str) -> tuple[str, ...]:
    if dialect not in ("import", "cli"):
        raise ValueError(f"unknown dialect: {dialect}")
    return ("#", "-- ") if dialect == "cli" else ("#",)


def line_columns(value: Column, dialect: str, strict: bool, markers: tuple[str, ...]) -> dict[str, Column]:
    """What the scan needs to know of each line, evaluated in the JVM.

    ``code`` packs the state after the line for each of the three states before it, as
    base-3 digits; ``dropped`` says the line is no text when it starts outside a string;
    ``directive`` is the new delimiter ('' when the directive names none).
    """
    pattern = exit_pattern(strict)
    single, double = value.contains("'"), value.contains('"')

    def after(entry: str) -> Column:
        return F.regexp_extract(F.concat(F.lit(entry), value), pattern, 1)

    # With single quotes alone and no backslash every quote flips the state, doubled or not.
    odd = (F.octet_length(value) - F.octet_length(F.replace(value, F.lit("'"), F.lit("")))) % 2
    flips = ~value.contains("\\") & ~double
    from_none = F.when(flips, odd).when(single | double, _digit(after(""))).otherwise(0)
    from_single = F.when(flips, 1 - odd).when(single, _digit(after("'"))).otherwise(1)
    from_double = F.when(double, _digit(after('"'))).otherwise(2)

    trimmed = trim(value)
    is_directive = F.substring(trimmed, 1, 1).isin("d", "D") & trimmed.rlike(DIRECTIVE)
    new = trim(F.regexp_extract(trimmed, DIRECTIVE_VALUE, 1))
    return {
        "code": (from_none * 9 + from_single * 3 + from_double).cast("tinyint"),
        "dropped": is_directive | comment_or_blank(trimmed, dialect, markers),
        "directive": F.when(is_directive, F.when(new == "0", "").otherwise(new)),
        "semi": rtrim(value).endswith(";"),
    }


@lru_cache(maxsize=4)
def _compiled_exit(strict: bool) -> re.Pattern:
    return re.compile(exit_pattern(strict))


_DIRECTIVE_RE = re.compile(DIRECTIVE.replace("$", r"\Z"))
_DIRECTIVE_VALUE_RE = re.compile(DIRECTIVE_VALUE.replace("$", r"\Z"))


def classify_line(line: str, dialect: str, strict: bool, markers: tuple[str, ...]):
    """``line_columns`` for one line in Python: (exits by state, dropped, directive)."""
    exits = tuple(STATES.index(_compiled_exit(strict).match(s + line).group(1)) for s in STATES)
    text = line.strip(TRIM)
    directive = None
    if _DIRECTIVE_RE.match(text):
        found = _DIRECTIVE_VALUE_RE.match(text)
        directive = found.group(1).strip(TRIM) if found else ""
        directive = "" if directive == "0" else directive
    if dialect == "import" and text.startswith("--"):
        comment = len(text) == 2 or text[2] == " "
    else:
        comment = text == "" or text.startswith(markers)
    return exits, directive is not None or comment, directive


def without_bom(data: bytes) -> bytes:
    for mark in BOMS:
        if data.startswith(mark):
            return data[len(mark):]
    return data
