"""SQL text as one stream of tokens, which everything that reads statements works on.

``tokens`` gives every character of a text, in order, as ``(kind, text)``: word, number, quoted name, string, comment,
space or sign. ``lexemes`` leaves space and comments out and tells where the others stand. Both are arrays:
keep them in a column of their own before using them more than once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r"'(?:[^']++|'')*+'?"
_QUOTED = r'"(?:[^"]++|"")*+"?'
_REST = r"--[^\n]*+|/\*.*?(?:\*/|\z)|\d++(?:\.\d++)?+(?!\w)|\d++(?:\.\d++)?+(?=ms\b)|\w++|\s++|."
STANDARD = rf"(?sU){_STRING}|{_QUOTED}|{_REST}"
# Backslashes in strings, and names in backticks.
MYSQL = rf"(?sU)'(?:[^'\\]++|\\.|'')*+'?|{_QUOTED}|`(?:[^`]++|``)*+`?|{_REST}"

KINDS = [("string", "'"), ("quoted", '"'), ("quoted", "`"), ("comment", "--"), ("comment", "/*")]


def _kind(text: Column) -> Column:
    first = reduce(lambda w, k: w.when(text.startswith(k[1]), k[0]), KINDS[1:], F.when(text.startswith(KINDS[0][1]), KINDS[0][0]))
    return (
        first.when(text.rlike(r"(?U)\A\d+(?:\.\d+)?\z"), "number")
        .when(text.rlike(r"(?U)\A\w"), "word")
        .when(text.rlike(r"(?U)\A\s"), "space")
        .otherwise("sign")
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """``rows.select(*columns)`` with each value computed once, however many columns and filters read it later."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def tokens(sql: Column, mysql: bool = False) -> Column:
    """Array of ``(kind, text)``; the texts joined are the input."""
    found = F.regexp_extract_all(sql, F.lit(MYSQL if mysql else STANDARD), F.lit(0))
    return F.transform(found, lambda t: F.struct(_kind(t).alias("kind"), t.alias("text")))


def lexemes(stream: Column) -> Column:
    """Array of ``(kind, text, upper, at)`` of what is neither space nor comment; ``at`` counts in the stream."""
    placed = F.transform(
        stream,
        lambda t, i: F.struct(t["kind"].alias("kind"), t["text"].alias("text"), F.upper(t["text"]).alias("upper"), i.alias("at")),
    )
    return F.filter(placed, lambda t: ~t["kind"].isin("space", "comment"))


def text_at(lex: Column, i: Column | int) -> Column:
    return F.get(lex, F.lit(i) if isinstance(i, int) else i)["text"]


def is_at(lex: Column, i: Column | int, *words: str) -> Column:
    """Whether these words or signs stand at a place, one after the other."""
    i = F.lit(i) if isinstance(i, int) else i
    same = [F.coalesce(F.get(lex, i + n)["upper"] == w, F.lit(False)) for n, w in enumerate(words)]
    return reduce(lambda a, b: a & b, same)


def places(lex: Column, *words: str) -> Column:
    """All places where the words stand."""
    every = F.transform(lex, lambda _, i: i)
    return F.filter(every, lambda i: is_at(lex, i, *words))


def place(lex: Column, *words: str) -> Column:
    """The first of ``places``, or null."""
    return F.get(places(lex, *words), F.lit(0))


def closing(lex: Column, opened: Column) -> Column:
    """Place of the parenthesis that closes the one at ``opened``, or null."""

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t["upper"] == "(", 1).when(t["upper"] == ")", -1).otherwise(0)
        done = s["end"].isNull() & (s["i"] >= opened) & (t["upper"] == ")") & (depth == s["floor"])
        floor = F.when(s["i"] == opened, s["depth"]).otherwise(s["floor"])
        return F.struct(
            (s["i"] + 1).alias("i"), depth.alias("depth"), floor.alias("floor"), F.when(done, s["i"]).otherwise(s["end"]).alias("end")
        )

    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(-1).alias("floor"), F.lit(None).cast("int").alias("end")
    )
    return F.aggregate(lex, start, step, lambda s: s["end"])


def between(stream: Column, lex: Column, opened: Column, closed: Column) -> Column:
    """The text between two places of ``lex``, as it was written."""
    a, b = F.get(lex, opened)["at"], F.get(lex, closed)["at"]
    return F.array_join(F.transform(F.slice(stream, a + 2, F.greatest(b - a - 1, F.lit(0))), lambda t: t["text"]), "")


def pieces(stream: Column, sign: str = ";") -> Column:
    """The texts between the signs, as they were written."""
    every = F.transform(stream, lambda t, i: F.when(t["text"] == sign, i))
    ends = F.concat(F.filter(every, lambda i: i.isNotNull()), F.array(F.size(stream)))

    def cut(found: Column) -> Column:
        def piece(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(found, k - 1) + 1)
            return F.array_join(F.transform(F.slice(stream, start + 1, end - start), lambda t: t["text"]), "")

        return F.transform(found, piece)

    return bound(ends, cut)
