"""Escaping rules of the dump formats, as column expressions.

Every function takes and returns a string column and stays inside Catalyst. Columns
without the escape character skip the work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = "\\"


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _between_double_backslashes(c: Column, *steps) -> Column:
    """Apply the steps to the text around each escaped backslash, left to right."""
    pieces = F.split(c, r"\\\\")
    for step in steps:
        pieces = F.transform(pieces, step)
    return F.array_join(pieces, BACKSLASH)


# Escape letter -> character, per format.
COPY_ESCAPES = [("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")]
TSV_ESCAPES = [("t", "\t"), ("n", "\n"), ("r", "\r"), ("0", "\0")]
MYSQL_ESCAPES = [("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0")]


def copy_unescape(c: Column) -> Column:
    """COPY text: ``\\\\ \\n \\r \\t``; any other pair is kept."""
    plain = _between_double_backslashes(c, lambda x: _replace_all(x, COPY_ESCAPES))
    return F.when(F.contains(c, F.lit(BACKSLASH)), plain).otherwise(c)


def copy_escape(c: Column) -> Column:
    return _replace_all(c, [(BACKSLASH, "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])


def tsv_unescape(c: Column, escaped_by: str = BACKSLASH) -> Column:
    """Shell-dump TSV: COPY rules plus ``\\0``, with a chosen escape character ('' = none)."""
    if not escaped_by:
        return c
    e = escaped_by[0]
    pairs = [(e + letter, char) for letter, char in TSV_ESCAPES]
    if e == BACKSLASH:
        plain = _between_double_backslashes(c, lambda x: _replace_all(x, pairs))
    else:
        plain = _replace_all(c, [*pairs, (e + BACKSLASH, BACKSLASH)])
    return F.when(F.contains(c, F.lit(e)), plain).otherwise(c)


def tsv_escape(c: Column) -> Column:
    return F.replace(copy_escape(c), F.lit("\0"), F.lit("\\0"))


def mysql_unescape(c: Column) -> Column:
    """Text between the quotes of a MySQL literal: ``\\n \\r \\t \\0``, ``''`` and ``\\x`` -> x."""

    def quotes(x: Column) -> Column:
        doubled = F.contains(x, F.lit("\\'")) | F.contains(x, F.lit("''"))
        return F.when(doubled, F.regexp_replace(x, r"\\'|''", "'")).otherwise(x)

    def letters(x: Column) -> Column:
        return _replace_all(x, MYSQL_ESCAPES)

    def others(x: Column) -> Column:
        left = F.contains(x, F.lit(BACKSLASH))
        return F.when(left, F.regexp_replace(x, r"(?s)\\(.)", "$1")).otherwise(x)

    plain = _between_double_backslashes(c, quotes, letters, others)
    touched = F.contains(c, F.lit(BACKSLASH)) | F.contains(c, F.lit("''"))
    return F.when(touched, plain).otherwise(c)


def mysql_escape(c: Column) -> Column:
    return _replace_all(
        c,
        [(BACKSLASH, "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")],
    )


def split_fields(c: Column, separator: str = "\t") -> Column:
    """Fields of one COPY / TSV line; empty fields are kept."""
    return F.split(c, "\\Q" + separator + "\\E", -1)


def bare_name(c: Column) -> Column:
    """Identifier without ``public.``, double quotes or backticks; a schema in front stays, unquoted too."""
    c = F.regexp_replace(F.trim(c), r'(?i)^(?:"public"|public)\.', "")
    qualified = r'^(?:"([^"]+)"|(\w+))\.(?:"([^"]+)"|(\w+))$'
    plain = F.regexp_replace(c, r'^"([^"]*)"$|^`(.*)`$', "$1$2")
    return F.when(c.rlike(qualified), F.regexp_replace(c, qualified, "$1$2.$3$4")).otherwise(plain)


def name_list(c: Column) -> Column:
    """``"a", b`` -> array of bare names, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), bare_name), lambda x: x != "")
