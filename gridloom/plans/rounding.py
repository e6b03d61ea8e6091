"""What queries return: floating-point columns to six digits, as sums depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded to `digits`, with negative zero as zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def rounded_sql(sql: str, doubles: str, others: str = "", digits: int = 6) -> str:
    """The query's columns: `doubles` rounded, `others` as they are; sql ends in a table t."""
    cols = [*others.split(), *(f"round({c}, {digits}) + 0.0::double as {c}" for c in doubles.split())]
    return f"{sql} select {', '.join(cols)} from t"
