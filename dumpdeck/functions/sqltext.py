"""Work on SQL and plan text held in a column, for logs of any length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpdeck.functions import tokens

# Words that are never taken for an alias.
KEYWORDS = [
    "SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER",
    "CROSS", "ON", "AND", "OR", "NOT", "IN", "EXISTS", "BETWEEN", "LIKE", "ORDER", "BY", "GROUP",
    "HAVING", "LIMIT", "OFFSET", "AS", "DISTINCT", "UNION", "ALL", "CREATE", "DROP", "ALTER",
]
# Formatter rules (words -> text in front), applied in this order.
LAYOUT = [
    ("SELECT", ""), ("FROM", "\n"), ("WHERE", "\n"), ("GROUP BY", "\n"), ("ORDER BY", "\n"),
    ("LIMIT", "\n"), ("OFFSET", " "), ("INNER JOIN", "\n"), ("LEFT JOIN", "\n"), ("RIGHT JOIN", "\n"),
    ("FULL JOIN", "\n"), ("CROSS JOIN", "\n"), ("JOIN", "\n"), ("HAVING", "\n"), ("VALUES", "\n"),
    ("SET", "\n"), ("AND", "\n  "), ("OR", "\n  "),
]


def statements(sql: Column) -> Column:
    """Array of the statements of a script, trimmed, without empty ones."""
    trimmed = F.transform(tokens.bound(tokens.tokens(sql), lambda stream: tokens.pieces(stream)), lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", ""))
    return F.filter(trimmed, lambda s: s != "")


def split_statements(log: DataFrame, id_col: str = "id", sql_col: str = "sql") -> DataFrame:
    """``(id, pos, statement)``, one row per statement."""
    return log.select(id_col, F.posexplode(statements(F.col(sql_col))).alias("pos", "statement"))


def _named(lex: Column, word: str) -> Column:
    """What follows each FROM or JOIN as a table and a word, which is its alias unless it is one of KEYWORDS."""

    def named(i: Column) -> Column:
        table, second = F.get(lex, i + 1), F.get(lex, i + 2)
        spoken = (second["upper"] == "AS") & (F.get(lex, i + 3)["kind"] == "word")
        alias = F.when(spoken, F.get(lex, i + 3)).otherwise(second)
        name = F.when(table["kind"] == "word", table["text"]).otherwise(
            F.nullif(F.regexp_extract(table["text"], r'(?U)\A"(\w+)"\z', 1), F.lit(""))
        )
        ok = name.isNotNull() & (alias["kind"] == "word") & ~alias["upper"].isin(KEYWORDS)
        return F.when(ok, F.struct(alias["text"].alias("alias"), name.alias("table_name")))

    return F.filter(F.transform(tokens.places(lex, word), named), lambda p: p.isNotNull())


def table_aliases(log: DataFrame, id_col: str = "id", sql_col: str = "sql") -> DataFrame:
    """``(id, alias, table_name)`` from FROM and JOIN; of equal aliases the later one wins,
    where all JOINs come after all FROMs."""
    lexed = tokens.lexemes(tokens.tokens(F.col(sql_col)))
    both = tokens.bound(lexed, lambda lex: F.concat(_named(lex, "FROM"), _named(lex, "JOIN")))

    def is_last(p: Column, i: Column) -> Column:
        later = F.slice(F.col("pairs"), i + 2, F.greatest(F.size("pairs"), F.lit(1)))
        return ~F.exists(later, lambda q: F.lower(q["alias"]) == F.lower(p["alias"]))

    return (
        log.select(id_col, both.alias("pairs"))
        .select(id_col, F.explode(F.filter("pairs", is_last)).alias("p"))
        .select(id_col, F.col("p.alias").alias("alias"), F.col("p.table_name").alias("table_name"))
    )


def format_sql(sql: Column) -> Column:
    """One clause per line, keywords in upper case; runs of white space become one blank.

    Words count wherever they stand, in strings too. The text is cut into words and what lies between them
    once, and each word is rendered by its rule; a rule of two words looks at its neighbour.
    """
    # A part is a word with what follows it up to the next one; white space is one blank by then.
    parts = F.regexp_extract_all(F.trim(F.regexp_replace(sql, r"(?U)\s+", " ")), F.lit(r"(?U)\w++\W*+|\W++"), F.lit(0))
    single = {w: before for w, before in LAYOUT if " " not in w}
    double = {tuple(w.split()): before for w, before in LAYOUT if " " in w}
    enders = {b: [a for a, c in double if c == b] for _, b in double}

    def word(part: Column) -> Column:
        return F.upper(F.regexp_extract(part, r"(?U)\A\w+", 0))

    def render(rows: Column) -> Callable[[Column, Column], Column]:
        def one(row: Column, i: Column) -> Column:
            name, rest = row["word"], row["rest"]
            before, after = F.get(rows, i - 1), F.get(rows, i + 1)["word"]
            shown = F.lit(None).cast("string")
            for (first, second), lead in double.items():
                meets = (name == first) & (after == second) & (rest == " ")
                shown = F.coalesce(shown, F.when(meets, lead + first))
            for second, firsts in enders.items():
                if second not in single:
                    met = (i > 0) & (name == second) & before["word"].isin(firsts) & (before["rest"] == " ")
                    shown = F.coalesce(shown, F.when(met, second))
            for w, lead in single.items():
                shown = F.coalesce(shown, F.when(name == w, lead + w))
            known = name.isin(sorted({*single, *(w for pair in double for w in pair)}))
            return F.when(known, F.concat(F.coalesce(shown, row["written"]), rest)).otherwise(row["part"])

        return one

    rows = F.transform(
        parts,
        lambda p: F.struct(
            p.alias("part"), word(p).alias("word"), F.regexp_extract(p, r"(?U)\A\w+", 0).alias("written"),
            F.regexp_extract(p, r"(?U)\W*\z", 0).alias("rest"),
        ),
    )
    shown = tokens.bound(rows, lambda r: F.transform(r, render(r)))
    return F.btrim(F.array_join(shown, ""), F.lit(" \n"))


def _timing(plan: Column, label: str) -> Column:
    """Milliseconds after the words "<label> time": a separator may stand between, the unit has to follow."""
    def found(lex: Column) -> Column:
        def value(i: Column) -> Column:
            at = i + F.when(tokens.is_at(lex, i + 2, ":") | tokens.is_at(lex, i + 2, "="), 3).otherwise(2)
            number, unit = F.get(lex, at), F.get(lex, at + 1)
            return F.when((number["kind"] == "number") & unit["upper"].startswith("MS"), number["text"])

        values = F.transform(tokens.places(lex, label.upper(), "TIME"), value)
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    return tokens.bound(tokens.lexemes(tokens.tokens(plan)), found).try_cast("double")


def planning_time(plan: Column) -> Column:
    """Milliseconds after ``Planning Time``, null when absent."""
    return _timing(plan, "Planning")


def execution_time(plan: Column) -> Column:
    return _timing(plan, "Execution")


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term, ignoring case."""
    if not term:
        return F.lit(0)
    literal = "\\E\\\\E\\Q".join(term.split("\\E"))
    return F.coalesce(F.regexp_count(text, F.lit(f"(?iu)\\Q{literal}\\E")), F.lit(0))


def matches(texts: DataFrame, term: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, n)`` for the texts that contain the term; counts stay on the row, no shuffle."""
    return texts.select(id_col, occurrences(F.col(text_col), term).alias("n")).filter("n > 0")


def match_totals(found: DataFrame) -> DataFrame:
    """One row ``(texts, total)`` over the result of ``matches``."""
    return found.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def has_order_by(sql: Column) -> Column:
    """ORDER BY outside strings, quoted names and comments."""
    lexed = tokens.lexemes(tokens.tokens(sql))
    return tokens.bound(lexed, lambda lex: F.size(tokens.places(lex, "ORDER", "BY"))) > 0


def has_limit(sql: Column) -> Column:
    """LIMIT as a word outside strings, quoted names and comments."""
    return F.exists(tokens.lexemes(tokens.tokens(sql)), lambda t: t["upper"] == "LIMIT")


def total_time(db: Column, fetch: Column, bind: Column) -> Column:
    """Total of a run: database and binding time may be unknown, fetch time is not."""
    return F.coalesce(db, F.lit(0)) + fetch + F.coalesce(bind, F.lit(0))
