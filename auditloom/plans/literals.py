"""Small fixtures that a query and its SQL twin read alike."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def table(name: str, columns: str, rows: Sequence[tuple]) -> str:
    """A common table expression of the rows: `name(columns) AS (VALUES ...)`."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"


def quoted(pattern: str) -> str:
    """A pattern as a SQL string."""
    return _sql(pattern)
