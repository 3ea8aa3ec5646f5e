"""Which catalog columns a logged query can see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_aliases(aliases: DataFrame, catalog: DataFrame, id_col: str = "id") -> DataFrame:
    """``aliases(id, alias, table_name)`` with every column of ``catalog(table_name, column_name)``.

    Names compare without case. The log side may be dominated by one table; with a catalog over
    the broadcast limit the join shuffles and AQE splits that table's partition.
    """
    a, c = aliases.alias("a"), catalog.alias("c")
    return a.join(c, F.lower("a.table_name") == F.lower("c.table_name")).select(
        f"a.{id_col}", "a.alias", "c.table_name", "c.column_name"
    )
