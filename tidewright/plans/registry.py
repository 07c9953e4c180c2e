"""Collects queries and the SQL that checks them."""

from __future__ import annotations

CUT = 0.499  # values are rounded half up; one within a thousandth of a half, whose side depends on the order in which doubles were added, goes up

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame and, where there is one, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = fixed_sql(sql)
        return f

    return add


def fixed(column, digits: int = 6):
    """A double rounded to a fixed number of digits, by the same arithmetic as ``fixed_sql``."""
    from pyspark.sql import functions as F

    scale = float(10**digits)
    c = F.col(column) if isinstance(column, str) else column
    x = c.cast("double") * scale + (1 - CUT)
    whole = F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x)  # Spark's floor is a long, which has no NaN and no infinity
    return whole / scale


def fixed_sql(sql: str) -> str:
    """``round(x, n)`` of the text as the arithmetic of ``fixed``."""
    at = sql.find("round(")
    while at >= 0:
        depth, i, comma = 1, at + 6, -1
        while depth:
            depth += (sql[i] == "(") - (sql[i] == ")")
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        scale = f"1e{int(sql[comma + 1: i - 1])}"
        sql = f"{sql[:at]}(floor(({sql[at + 6: comma]})::DOUBLE * {scale} + {1 - CUT:.3f}) / {scale})::DOUBLE{sql[i:]}"
        at = sql.find("round(")
    return sql


def rounded(df, columns, digits: int = 6):
    return df.select(*[fixed(c, digits).alias(c) if c in columns else c for c in df.columns])
