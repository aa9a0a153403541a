"""Column names for intermediate results beside columns that callers bring."""

from pyspark.sql import DataFrame


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it as long as a column of the tables has it; case doesn't tell columns apart."""
    taken = {c.lower() for table in tables for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
