"""Markdown tables out of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInputError
from ..functions.text import table_row


def markdown_table(df: DataFrame, columns: list[str], by: list[str], order: list[str], name: str = "md") -> DataFrame:
    """One pipe table for each group of by, its rows in order, the column names as header, a line break before and after."""
    if not columns:
        raise InvalidInputError("A table needs a header")
    head = table_row([F.lit(c) for c in columns])
    rule = F.lit("| " + " | ".join(["---"] * len(columns)) + " |")
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, table_row([F.col(c) for c in columns]).alias("tl_row")))).alias("r"))
    return rows.select(*by, F.concat(F.lit("\n"), head, F.lit("\n"), rule, F.lit("\n"), F.array_join("r.tl_row", "\n"), F.lit("\n")).alias(name))


def table_text(rows: list[list[object]]) -> str:
    """The same for one table held in Python; the first row is the header, empty rows go."""
    if not rows:
        raise InvalidInputError("A table needs a header")

    def line(cells: list[str]) -> str:
        return f"| {' | '.join(cells)} |"

    def cells(row: list[object]) -> list[str]:
        return [str(c).replace("|", "\\|") for c in row]

    body = [line(cells(r)) for r in rows[1:] if r]
    return "\n".join(["", line(cells(rows[0])), line(["---"] * len(rows[0])), *body, ""])
